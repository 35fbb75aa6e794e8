"""Conversation prefix trie (operator 11) by a splitter skeleton.

Every conversation is a path of chained turn digests. The paths are range-partitioned and sorted. A node whose members lie in
two shards is a prefix of the path that starts the later one, so the trie of the shards' first paths - the skeleton - is
broadcast: a shard finishes every other node by itself while it streams its sorted paths through a stack, and gives partial
aggregates of skeleton nodes, which a grouped reduction combines. Texts never shuffle: only their digests and word counts do.

Defined results: turns are ordered by ``turn`` (null first), equal ones by their digest; null role or text is empty; rows
without conversation id belong to no conversation; repeated rows are turns of their own; no conversations, no nodes. The
turns of one conversation (16 bytes each) are held together, like the text of one document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, store

WORD = r"[^\x20\x09-\x0D]+"
KEY = 16
ROOT = bytes(KEY)
#: Turns a shard takes about, and the most shards: the skeleton broadcast holds at most one path per shard.
SHARD_TURNS, MAX_SHARDS = 20_000, 2048
#: Finished children held until their parent is finished; beyond it they go out and learn its conv_id in the last join.
HELD = 100_000
#: Conversation ids in one piece of a skeleton node's list.
PIECE = 4096

NODE = "key binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, parent binary, parent_conv_id long, named boolean, words long, above array<binary>, first long, piece string"


def turns_of(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turns array<struct<turn, digest, words>> in order."""
    role, text = (F.coalesce(column(conversations, c), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * KEY))
    rows = conversations.select(column(conversations, conv_col).cast("long").alias("conv_id"), F.struct(
        column(conversations, turn_col).alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).alias("words")).alias("t"))
    return rows.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(turns: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """Each conversation c with its first h turns taken from conversation c - c % group, h = crc32(c) % heads."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    lead = turns.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    own = turns.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return own.join(lead, "base", "left").select("conv_id", F.concat(head, rest).alias("turns"))


def paths_of(turns: DataFrame) -> DataFrame:
    """conv_id, path (a chained digest of ``KEY`` bytes per turn: equal bytes at a depth mean equal turns up to it), words."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = []
            for digests in b["digests"].to_pylist():
                key, path = ROOT, []
                for d in digests:
                    key = hashlib.blake2b(key + d, digest_size=KEY).digest()
                    path.append(key)
                paths.append(b"".join(path))
            yield pa.RecordBatch.from_arrays([b["conv_id"], pa.array(paths, pa.binary()), b["words"]], ["conv_id", "path", "words"])

    return turns.selectExpr("conv_id", "turns.digest as digests", "turns.words as words").mapInArrow(kernel, "conv_id long, path binary, words array<int>")


def first_paths(ordered: DataFrame) -> list[bytes]:
    """The first path of each shard: at most ``MAX_SHARDS`` rows."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.slice(0, 1)
                return

    return [bytes(r.path) for r in ordered.select("path").mapInArrow(first, "path binary").collect()]


class Node:
    """A node on the stack: what its subtree has given so far."""

    __slots__ = ("key", "words", "low", "n", "children", "leaves", "saved", "sha", "ends", "first", "kids", "named", "shared")

    def __init__(self, key: bytes, words: int, shared: bool):
        self.key, self.words, self.shared = key, words, shared
        self.low, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.sha, self.ends, self.first, self.kids, self.named = None, [], None, [], False


class Shard:
    """Streams sorted paths through a stack; ``out`` collects finished rows."""

    def __init__(self, skeleton: frozenset[bytes], held: int = HELD, piece: int = PIECE):
        self.skeleton, self.limit, self.piece = skeleton, held, piece
        self.stack, self.path, self.out, self.held = [Node(ROOT, 0, True)], b"", [], 0

    def add(self, conv: int, path: bytes, words: list[int]) -> None:
        old, depth = self.path, len(path) // KEY
        same = 0
        while same < depth and old[same * KEY:(same + 1) * KEY] == path[same * KEY:(same + 1) * KEY]:
            same += 1
        self.close(same)
        for d in range(same, depth):
            key = path[d * KEY:(d + 1) * KEY]
            self.stack.append(Node(key, words[d], key in self.skeleton))
        self.path = path
        top = self.stack[-1]
        top.n += 1
        top.low = conv if top.low is None else min(top.low, conv)
        if top.shared:
            top.first = conv if top.first is None else top.first
            top.ends.append(str(conv))
            if len(top.ends) >= self.piece:
                self.flush(top)
        elif top.sha is None:
            top.sha = hashlib.sha256(str(conv).encode())
        else:
            top.sha.update(b",%d" % conv)

    def flush(self, node: Node) -> None:
        if node.ends:
            self.out.append({"key": node.key, "first": node.first, "piece": ",".join(node.ends)})
            node.ends, node.first = [], None

    def close(self, depth: int) -> None:
        """Finish all nodes on the stack below ``depth``."""
        while len(self.stack) > depth + 1:
            node = self.stack.pop()
            up = self.stack[-1]
            up.n += node.n
            up.low = node.low if up.low is None else min(up.low, node.low)
            if node.shared:
                self.partial(node)
                continue
            leaves, saved = node.leaves or 1, node.saved + (node.n - 1) * node.words
            up.children, up.leaves, up.saved = up.children + 1, up.leaves + leaves, up.saved + saved
            for kid in node.kids:
                kid["parent_conv_id"] = node.low
            self.out += node.kids
            self.held -= len(node.kids)
            row = {"key": node.key if node.named else None, "depth": len(self.stack), "conv_id": node.low, "n_convs": node.n, "n_children": node.children, "n_leaves": leaves,
                   "saved_tokens": saved, "ends_sha256": (node.sha or hashlib.sha256()).hexdigest(), "named": node.named}
            if up.shared or up.named:
                self.out.append(row | {"parent": up.key})
            else:
                up.kids.append(row)
                self.held += 1
                if self.held > self.limit:
                    self.let_go()

    def let_go(self) -> None:
        for node in self.stack:
            if node.kids:
                self.out += [kid | {"parent": node.key} for kid in node.kids]
                node.kids, node.named = [], True
        self.held = 0

    def partial(self, node: Node) -> None:
        self.flush(node)
        self.out.append({"key": node.key, "depth": len(self.stack), "conv_id": node.low, "n_convs": node.n, "n_children": node.children, "n_leaves": node.leaves,
                         "saved_tokens": node.saved, "words": node.words, "above": [x.key for x in self.stack]})

    def end(self) -> None:
        self.close(0)
        root = self.stack.pop()
        if root.n:
            self.partial(root)


def shard_rows(ordered: DataFrame, skeleton: frozenset[bytes], held: int = HELD, piece: int = PIECE) -> DataFrame:
    """Finished nodes (``depth`` set, ``above`` null), partial skeleton nodes (``above`` set) and pieces (``piece`` set)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(NODE))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(skeleton, held, piece)
        for b in batches:
            for conv, path, words in zip(b["conv_id"].to_pylist(), b["path"].to_pylist(), b["words"].to_pylist()):
                shard.add(conv, path, words)
            if shard.out:
                yield pa.RecordBatch.from_pylist(shard.out, schema=schema)
                shard.out = []
        shard.end()
        if shard.out:
            yield pa.RecordBatch.from_pylist(shard.out, schema=schema)

    return ordered.select("conv_id", "path", "words").mapInArrow(kernel, NODE)


def list_digests(pieces: DataFrame) -> DataFrame:
    """key, ends_sha256 of the pieces of each list joined by commas; a list streams through its task piece by piece."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for b in batches:
            done = []
            for k, piece in zip(b["key"].to_pylist(), b["piece"].to_pylist()):
                if k == key:
                    sha.update(b"," + piece.encode())
                    continue
                if key is not None:
                    done.append((key, sha.hexdigest()))
                key, sha = k, hashlib.sha256(piece.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())], ["key", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([sha.hexdigest()])], ["key", "ends_sha256"])

    return pieces.select("key", "first", "piece").repartition("key").sortWithinPartitions("key", "first").select("key", "piece").mapInArrow(kernel, "key binary, ends_sha256 string")


def reduce_skeleton(rows: DataFrame) -> DataFrame:
    """Partial aggregates of skeleton nodes combined; what a subtree adds up goes to all nodes above it."""
    part = rows.where("above is not null").groupBy("key").agg(
        F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.first("words").alias("words"), F.first("above").alias("above"))
    part = store(part.withColumn("parent", F.expr("if(depth = 0, null, element_at(above, -1))")), "skeleton")
    kids = part.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("kids"))
    part = part.join(kids, "key", "left").withColumn("n_children", F.expr("n_children + coalesce(kids, 0)"))
    sums = part.select(F.explode(F.expr("concat(above, array(key))")).alias("key"), F.expr("n_leaves + int(n_children = 0)").alias("l"), F.expr("saved_tokens + (n_convs - 1) * words").alias("s"))
    sums = sums.groupBy("key").agg(F.sum("l").alias("n_leaves"), F.sum("s").alias("saved_tokens"))
    ends = list_digests(rows.where("piece is not null"))
    none = F.lit(hashlib.sha256().hexdigest())
    done = part.drop("n_leaves", "saved_tokens").join(sums, "key").join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", none))
    return store(done, "skeleton-nodes")


def prefix_trie(turns: DataFrame, shard_turns: int = SHARD_TURNS, held: int = HELD, piece: int = PIECE) -> DataFrame:
    """Nodes of the prefix trie of (conv_id, turns) as ``rebuilt`` gives them.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    paths = store(paths_of(turns), "paths")
    total = paths.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    shards = max(1, min(MAX_SHARDS, -(-total // shard_turns)))
    ordered = paths.repartitionByRange(shards, "path", "conv_id").sortWithinPartitions("path", "conv_id").checkpoint()
    skeleton = frozenset([ROOT]) | {p[i:i + KEY] for p in first_paths(ordered) for i in range(0, len(p), KEY)}
    rows = store(shard_rows(ordered, skeleton, held, piece), "trie")
    nodes = reduce_skeleton(rows)
    local = rows.where("depth is not null and above is null")
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    open_ = local.where("parent is not null").drop("parent_conv_id").select(*[c for c in out if c != "parent_conv_id"], "parent").unionByName(
        nodes.select(*[c for c in out if c != "parent_conv_id"], "parent"))
    names = local.where("named").select("key", "conv_id").union(nodes.select("key", "conv_id")).select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return local.where("parent is null").select(out).unionByName(open_.join(names, "parent", "left").select(out))


def conversation_trie(conversations: DataFrame, group: int = 20, heads: int = 4, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return prefix_trie(rebuilt(store(turns_of(conversations), "turns"), group, heads), shard_turns)


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of ASCII ``text``; needs the one-row table ``crc(tab)`` in scope."""
    chars = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {chars}), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295::BIGINT)"


CRC_SQL = """crc AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS v FROM range(256) r(i)))"""

ORACLE_SQL = f"""WITH {CRC_SQL},
raw AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS pos, role, text FROM raw),
convs AS (SELECT c AS conv_id, c - c % 20 AS base, {crc32_sql("c::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv_id AS c FROM raw), crc),
turns AS (
  SELECT c.conv_id, o.pos, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.base AND o.pos <= c.h
  UNION ALL SELECT c.conv_id, o.pos, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.pos > c.h),
placed AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS d, role, text FROM turns),
steps AS (SELECT conv_id, d, text, md5(length(role) || ':' || role || text) AS turn FROM placed),
paths AS (SELECT conv_id, d, text, md5(string_agg(turn, '') OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING)) AS key FROM steps),
members AS (
  SELECT conv_id, d, key, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words, lag(key, 1, 'root') OVER (PARTITION BY conv_id ORDER BY d) AS parent FROM paths
  UNION ALL SELECT conv_id, 0, 'root', 0, NULL FROM convs),
lens AS (SELECT conv_id, max(d) AS len FROM members GROUP BY conv_id),
nodes AS (
  SELECT key, max(d) AS depth, max(parent) AS parent, min(m.conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words,
         coalesce(string_agg(m.conv_id::VARCHAR, ',' ORDER BY m.conv_id) FILTER (WHERE len = d), '') AS ends
  FROM members m JOIN lens l ON l.conv_id = m.conv_id GROUP BY key),
kids AS (SELECT parent AS key, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
below AS (SELECT DISTINCT a.key AS top, b.key FROM members a JOIN members b ON b.conv_id = a.conv_id AND b.d >= a.d),
sums AS (
  SELECT top, sum((n.n_convs - 1) * n.words) AS saved, count(*) FILTER (WHERE k.n IS NULL) AS leaves
  FROM below JOIN nodes n ON n.key = below.key LEFT JOIN kids k ON k.key = below.key GROUP BY top)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, s.leaves AS n_leaves,
       s.saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.key = n.parent LEFT JOIN kids k ON k.key = n.key JOIN sums s ON s.top = n.key"""
