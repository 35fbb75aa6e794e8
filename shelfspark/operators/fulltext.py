"""Full-text match and cover-density ranking.

Documents are tokenised into ``(id, term, pos)`` occurrence rows; a query
batch into ``(query_id, term, term_idx, n_terms)``.  A query matches a
document when every one of its distinct terms occurs (AND semantics of a
plain text query).  The rank is the cover-density score: the document's
occurrences of query terms, in position order, are split into minimal
covers (shortest spans holding every query term), and each cover adds
``w / (1 + noise)`` where noise counts the non-query positions inside it.

Plan shape: the index shuffles texts by block, not occurrences, and a block's
postings are made in one Arrow kernel.  A search cuts the postings to the
batch's terms by a broadcast, meets the queries of a block in that block and
sends each posting once, however many queries name its term.  The per-pair
fold runs over that pair's occurrences, which all come from one document row.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

TOKEN_RE = r"[\p{L}\p{N}]+"
# default weight of unlabelled text (stored as a 4-byte float, read back as double)
COVER_WEIGHT = 0.10000000149011612

# fixed values: English stop words (the Snowball English list, as used by
# common full-text configurations)
ENGLISH_STOP_WORDS = """i me my myself we our ours ourselves you your yours yourself yourselves he him his
himself she her hers herself it its itself they them their theirs themselves what which who whom this that these
those am is are was were be been being have has had having do does did doing a an the and but if or because as
until while of at by for with about against between into through during before after above below to from up down
in out on off over under again further then once here there when where why how all any both each few more most
other some such no nor not only own same so than too very s t can will just don should now""".split()


SEPARATOR_RE = r"[^\p{L}\p{N}]+"


def tokens(c: Column) -> Column:
    """Lower-cased letter/digit runs of a text column, as an array.

    Same tokens as extracting ``TOKEN_RE`` matches, computed as a split on the complement
    class (several times cheaper than match extraction on long texts)."""
    parts = F.split(F.lower(F.coalesce(c, F.lit(""))), SEPARATOR_RE)
    return F.filter(parts, lambda x: x != "")


# Typed tokens (H05): the classes of a full-text parser, tried in this order at each place of the lower-cased text.
_HOST = r"(?:[a-z0-9][a-z0-9_-]*\.)+[a-z][a-z0-9]+"
TYPED_RE = "|".join([
    r"<[a-z/!][^<>]*>", r"&(?:[a-z][a-z0-9]*|#[0-9]+|#x[0-9a-f]+);", r"[a-z][a-z0-9+.-]*://",  # tags, references, protocols: not indexed
    r"[a-z0-9][a-z0-9._+-]*@(?:[a-z0-9][a-z0-9-]*\.)+[a-z][a-z0-9]*",  # e-mail
    _HOST + r"(?::[0-9]+)?/[^\s<>\"]*", _HOST,  # url, host
    r"[0-9]+(?:\.[0-9]+){2,}", r"[-+]?[0-9]+\.[0-9]+(?:e[-+]?[0-9]+)?",  # version, decimal number
    r"[0-9]+\p{L}[\p{L}\p{N}]*", r"[-+]?[0-9]+",  # word that starts with digits, whole number
    r"\p{L}[\p{L}\p{N}]*(?:-[\p{L}\p{N}]+)+", r"\p{L}[\p{L}\p{N}]*", r"[\p{L}\p{N}]+"])  # hyphenated compound, word
COMPOUND_RE = r"^\p{L}[\p{L}\p{N}]*-"
#: The same tokens, found faster: a word that nothing follows which could make it a part of a longer token is taken at once.
SCAN_RE = r"\p{L}[\p{L}\p{N}]*+(?![-_+@:]|\.[-a-z0-9._+@:])|" + TYPED_RE
#: Words, which stop words and stems apply to.
WORD_RE = r"^[\p{L}-]+$"


def typed_tokens(c: Column) -> Column:
    """Tokens as a full-text parser types them, each at its own place: a hyphenated compound is followed by its parts, a
    URL by its host and path; e-mail addresses, hosts and signed, decimal or version numbers are one token."""
    text = F.lower(F.coalesce(c, F.lit("")))
    found = F.regexp_extract_all(text, F.lit(SCAN_RE), F.lit(0))
    # the tokens of a text are gone through only where it has a character that such a token holds
    kept = F.when(text.contains("<") | text.contains("&") | text.contains("://"),
                  F.filter(found, lambda t: ~(t.startswith("<") | t.startswith("&") | t.endswith("://")))).otherwise(found)
    parts = F.flatten(F.transform(kept, lambda t: F.when(t.contains("@"), F.array(t))
                                  .when(t.contains("/"), F.array(t, F.regexp_extract(t, "^[^/]*", 0), F.regexp_extract(t, "/.*$", 0)))
                                  .when(t.rlike(COMPOUND_RE), F.concat(F.array(t), F.split(t, "-"))).otherwise(F.array(t))))
    return F.when(text.contains("/") | text.contains("-"), parts).otherwise(kept)


def mode_tokens(c: Column, mode: str) -> Column:
    if mode not in ("simple", "english"):
        raise ValueError(f"unknown analyzer mode {mode!r}")
    return tokens(c) if mode == "simple" else typed_tokens(c)


def analyze(df: DataFrame, id_cols: list[str], text: Column, mode: str = "simple", stems: DataFrame | None = None) -> DataFrame:
    """``(id..., term, pos)``; positions are 1-based token positions.

    ``english`` types its tokens, drops stop words but keeps their positions (gaps), and stems words, by the algorithm (inside
    each row's tokens, so nothing shuffles) or by a table ``stems(term, stem)``; ``simple`` keeps every letter/digit run.
    """
    found = mode_tokens(text, mode)
    if mode == "english" and stems is None:
        from ..functions.stem import stem_lists

        found = stem_lists(ENGLISH_STOP_WORDS)(found)
    out = df.select(*id_cols, F.posexplode(found).alias("pos0", "term"))
    out = out.select(*id_cols, "term", (F.col("pos0") + 1).alias("pos"))
    if mode == "simple":
        return out
    return out.where(F.col("term").isNotNull()) if stems is None else stem_terms(out.where(~F.col("term").isin(ENGLISH_STOP_WORDS)), stems=stems)


def stem_terms(df: DataFrame, col: str = "term", stems: DataFrame | None = None) -> DataFrame:
    """Replace ``col`` by its English stem: the stemmer runs once per distinct term (Arrow
    batches) and the stems are joined back on the term; a table ``stems(term, stem)`` takes its place where given."""
    if stems is not None:
        return df.join(stems.select(F.col("term").alias(col), F.col("stem").alias("_stem")), col, "left").withColumn(col, F.coalesce("_stem", col)).drop("_stem")
    from ..functions.stem import stem_udf

    vocab = df.select(col).distinct()
    stemmed = vocab.select(col, stem_udf(F.col(col)).alias("_stem"))
    return df.join(stemmed, col).withColumn(col, F.col("_stem")).drop("_stem")


def query_terms(queries: DataFrame, text: Column, mode: str = "simple", keep: list[str] | None = None, stems: DataFrame | None = None) -> DataFrame:
    """Distinct terms of each query with a dense index: ``(query_id, term, term_idx, n_terms, keep...)``."""
    keep = keep or []
    if mode == "english":
        terms = F.filter(typed_tokens(text), lambda t: ~t.isin(ENGLISH_STOP_WORDS))
        ex = stem_terms(queries.select("query_id", *keep, F.explode(terms).alias("term")), stems=stems).dropDuplicates(["query_id", "term"])
        w = Window.partitionBy("query_id")
        return ex.select("query_id", (F.dense_rank().over(w.orderBy("term")) - 1).cast("int").alias("term_idx"), "term",
                         F.count(F.lit(1)).over(w).cast("int").alias("n_terms"), *keep)
    q = queries.select("query_id", *keep, F.array_distinct(tokens(text)).alias("terms"))
    q = q.where(F.size("terms") > 0)  # an empty text query matches nothing
    return q.select(
        "query_id", F.posexplode("terms").alias("term_idx", "term"), F.size("terms").alias("n_terms"), *keep)


def matched_occurrences(doc_terms: DataFrame, qterms: DataFrame, extra_cols: list[str] | None = None) -> DataFrame:
    """Occurrence rows of query terms: ``(query_id, id, term_idx, n_terms, pos, extra...)``."""
    return doc_terms.join(qterms, "term").select(
        "query_id", "id", "term_idx", "n_terms", "pos", *(extra_cols or []))


def _cover_density(occ: Column, n_terms: Column) -> Column:
    """Fold over position-sorted ``array<struct<pos, term_idx>>``: sum of w/(1+noise) over minimal covers."""
    init = F.struct(
        F.array_repeat(F.lit(None).cast("long"), n_terms.cast("int")).alias("last_pos"),
        F.array_repeat(F.lit(None).cast("int"), n_terms.cast("int")).alias("last_idx"),
        F.lit(-1).cast("long").alias("prev_start"),
        F.lit(0).cast("int").alias("i"),
        F.lit(0.0).alias("score"),
    )

    def step(acc, x):
        t = x["term_idx"] + 1
        last_pos = F.transform(acc["last_pos"], lambda v, j: F.when(j + 1 == t, x["pos"].cast("long")).otherwise(v))
        last_idx = F.transform(acc["last_idx"], lambda v, j: F.when(j + 1 == t, acc["i"]).otherwise(v))
        complete = ~F.exists(last_pos, lambda v: v.isNull())
        start = F.array_min(last_pos)
        # index (in occurrence order) of the occurrence that opens the cover
        begin = F.aggregate(
            F.arrays_zip(last_pos.alias("p"), last_idx.alias("k")),
            F.lit(None).cast("int"),
            lambda a, z: F.when(z["p"] == start, z["k"]).otherwise(a),
        )
        new_cover = complete & (start != acc["prev_start"])
        noise = (x["pos"] - start) - (acc["i"] - begin)
        noise = F.when(noise < 0, F.floor((acc["i"] - begin) / 2)).otherwise(noise)
        add = F.when(new_cover, F.lit(COVER_WEIGHT) / (1 + noise)).otherwise(F.lit(0.0))
        return F.struct(
            last_pos.alias("last_pos"), last_idx.alias("last_idx"),
            F.when(new_cover, start).otherwise(acc["prev_start"]).alias("prev_start"),
            (acc["i"] + 1).alias("i"),
            (acc["score"] + add).alias("score"),
        )

    return F.aggregate(occ, init, step, lambda acc: acc["score"])


def match_and_rank(occ: DataFrame, keep_cols: list[str] | None = None) -> DataFrame:
    """H03 + H04: pairs holding every query term, with their cover-density rank.

    Returns ``(query_id, id, keep..., text_rank)``; the rank is rounded to a
    4-byte float like the text-search rank it reproduces.
    """
    keep_cols = keep_cols or []
    g = occ.groupBy("query_id", "id", *keep_cols).agg(
        F.max("n_terms").alias("n_terms"),
        F.count_distinct("term_idx").alias("n_found"),
        F.array_sort(F.collect_list(F.struct("pos", "term_idx"))).alias("occ"),
    ).where(F.col("n_found") == F.col("n_terms"))
    rank = _cover_density(F.col("occ"), F.col("n_terms")).cast("float").cast("double")
    return g.select("query_id", "id", *keep_cols, rank.alias("text_rank"))


def text_match(occ: DataFrame) -> DataFrame:
    """``(query_id, id)`` of documents containing every query term, from their occurrence rows."""
    return occ.groupBy("query_id", "id").agg(
        F.max("n_terms").alias("n_terms"), F.count_distinct("term_idx").alias("n_found")
    ).where(F.col("n_found") == F.col("n_terms")).select("query_id", "id")


# Inverted index -------------------------------------------------------------------------
# One posting row per (block of documents, term), stored once per catalogue snapshot.  Its narrow columns (documents that
# hold the term, most occurrences in one) tell in which blocks all terms of a query meet and how well a document there
# can rank at best; the wide ones (ids, positions) are read only there, the rarest term's first.  So a word that a third
# of the documents hold costs its narrow rows, not its postings.
BLOCK_DOCS = 1024
FOLDERS = 64
#: Blocks of one folder that are analysed and written together, as one file.
GROUP_BLOCKS = 16
#: Blocks of each query that are ranked before the others are held against its k-th rank.
FIRST_BLOCKS = 16
#: Folders of terms that stored postings lie in.
SHARDS = 16
#: Stems of a table of at most so many rows travel to the tasks that analyse, like the small side of a broadcast join.
SMALL_STEMS = 100_000
#: Posting rows of a block and shard of terms as one compressed record batch: no row per (block, term) passes the JVM when
#: an index is built, and a search unpacks the folders of its terms only.
PACKED = "shard int, folder int, block long, size long, rows binary"
CODEC = "zstd"


@dataclass
class TextIndex:
    """``postings``: folder, block, term, n_docs, max_tf, ids, positions; ``docs``: folder, block, id and the documents'
    own columns, in folders by block, so that joins which name folder and block read only theirs.  ``packed``: the same
    postings as they are stored, in folders by shards of terms."""

    postings: DataFrame | None
    docs: DataFrame
    packed: DataFrame | None = None


def placed(df: DataFrame, blocks: int) -> DataFrame:
    """``df`` with the block of each document (a hash of its id) and the block's folder."""
    return df.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn("folder", (F.col("block") % FOLDERS).cast("int"))


def _strings(column: pa.Array) -> list[str]:
    """Python strings of a column without nulls, several times faster than ``to_pylist``."""
    return column.to_numpy(zero_copy_only=False).tolist()


def _split(joined: pa.Array) -> pa.Array:
    """Lists of tokens from their space-joined strings; an empty string has none."""
    lists = pc.split_pattern(joined, " ")
    size = np.where(pc.equal(joined, "").to_numpy(zero_copy_only=False), 0, lists.value_lengths().to_numpy(zero_copy_only=False))
    words = lists.flatten().filter(pa.array(np.repeat(size > 0, np.maximum(size, 1))))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), words)


def _block_kernel(mode: str, out: pa.Schema, stems: dict[str, list[str]] | None = None) -> Callable:
    """(key, a block's documents[, its terms with their stems]) -> the posting rows of the block; ``stems`` are for all blocks."""
    from ..functions.stem import stem_or_keep

    def targets(terms: pa.Array, table: pa.Table | None) -> tuple[np.ndarray, pa.Array]:
        """(code, term) pairs: what each distinct token is indexed as; stop words as nothing, by a table with several stems as each."""
        if mode == "simple":
            return np.arange(len(terms)), terms
        known = stems or {} if table is None else dict(zip(table["term"].to_pylist(), table["stems"].to_pylist()))
        stop = frozenset(ENGLISH_STOP_WORDS)
        by_rule = table is None and stems is None
        pairs = [(c, x) for c, w in enumerate(_strings(terms)) if w not in stop for x in ([stem_or_keep(w)] if by_rule else known.get(w, [w]))]
        return np.array([c for c, _ in pairs], dtype=np.int64), pa.array([x for _, x in pairs], pa.string())

    def rows(key: tuple, docs: pa.Table, table: pa.Table | None = None) -> pa.Table:
        ids, found = docs["id"].combine_chunks(), _split(docs["tokens"].combine_chunks())
        order = pc.array_sort_indices(ids, null_placement="at_start")
        ids, found = ids.take(order).dictionary_encode(null_encoding="encode"), found.take(order)
        size = found.value_lengths().to_numpy(zero_copy_only=False)
        doc, n = np.repeat(ids.indices.to_numpy(), size), len(ids.dictionary)
        pos = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size) + 1
        tokens = found.flatten().dictionary_encode()
        code = tokens.indices.to_numpy()
        of, terms = targets(tokens.dictionary, table)
        terms = terms.dictionary_encode()
        term_of = terms.indices.to_numpy()
        per = np.bincount(of, minlength=len(tokens.dictionary))
        if len(per) and per.max() > 1:  # each occurrence once per term that its token is indexed as
            times = per[code]
            nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            doc, pos = np.repeat(doc, times), np.repeat(pos, times)
            code = term_of[np.repeat((np.cumsum(per) - per)[code], times) + nth]
        else:
            term_at = np.full(len(per), -1, dtype=term_of.dtype)
            term_at[of] = term_of
            code = term_at[code]
            held = code >= 0
            doc, pos, code = doc[held], pos[held], code[held]
        # occurrences come by document and position, unless documents repeat
        at = np.argsort(code, kind="stable") if n == len(ids) else np.lexsort((pos, doc, code))
        code, doc, pos = code[at], doc[at], pos[at]
        starts = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
        ends = np.append(starts, len(code))
        code, doc = code[starts], doc[starts]
        first = np.flatnonzero(np.diff(code, prepend=-1))
        lists = pa.array(np.append(first, len(code)), pa.int32())
        positions = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pos, pa.int32()))
        most = np.maximum.reduceat(np.diff(ends), first) if len(first) else first
        count = np.diff(np.append(first, len(code)))
        columns = [pa.array(np.full(len(first), key[0].as_py())), pa.array(np.full(len(first), key[2].as_py())), terms.dictionary.take(pa.array(code[first])), pa.array(count),
                   pa.array(most), pa.ListArray.from_arrays(lists, ids.dictionary.take(pa.array(doc))), pa.ListArray.from_arrays(lists, positions)]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, out)], schema=out)

    return rows


def shard_of(term: Column) -> Column:
    return (F.crc32(term) % SHARDS).cast("int")


def _gaps(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ascending runs that begin at ``starts`` as their first values and steps."""
    out = np.diff(values, prepend=0)
    out[starts] = values[starts]
    return out


def _from_gaps(gaps: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.cumsum(gaps)
    return total - np.repeat(total[starts] - gaps[starts], sizes)


def _narrow(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint16 if len(values) and values.max() < 1 << 16 else np.int32))


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _pack(rows: pa.Table) -> pa.Buffer:
    """Posting rows as flat arrays: ids by their places in the batch's ids, places and positions as steps."""
    ids = rows["ids"].combine_chunks()
    positions = rows["positions"].combine_chunks().flatten()
    flat = ids.flatten()
    known = flat.unique()
    known = known.take(pc.array_sort_indices(known, null_placement="at_start"))
    place = pc.index_in(flat, known).to_numpy(zero_copy_only=False).astype(np.int64)
    n_docs, tf = (x.value_lengths().to_numpy(zero_copy_only=False) for x in (ids, positions))
    parts = {"term": rows["term"].combine_chunks(), "n_docs": _narrow(n_docs), "tf": _narrow(tf), "ids": known, "place": _narrow(_gaps(place, _starts(n_docs))),
             "pos": _narrow(_gaps(positions.flatten().to_numpy(zero_copy_only=False).astype(np.int64), _starts(tf)))}
    lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in parts.values()]
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays(lists, names=list(parts))
    with pa.ipc.new_stream(sink, batch.schema) as to:
        to.write_batch(batch)
    return sink.getvalue()


def _unpack(data: pa.Buffer, terms: pa.Array | None, heads: bool) -> dict[str, pa.Array]:
    """Columns of the posting rows (of ``terms``) in a packed batch; ``heads``: the narrow ones."""
    batch = pa.ipc.open_stream(data).read_next_batch()
    term, n_docs, tf, known, place, pos = (x.flatten() for x in batch.columns)
    n_docs, tf = (x.to_numpy().astype(np.int64) for x in (n_docs, tf))
    at, doc_at = _starts(n_docs), _starts(tf)
    pick = np.arange(len(n_docs)) if terms is None else np.flatnonzero(pc.is_in(term, value_set=terms).to_numpy(zero_copy_only=False))
    size = n_docs[pick]
    docs = np.repeat(at[pick] - _starts(size), size) + np.arange(size.sum())
    many = tf[docs]
    out = {"term": term.take(pa.array(pick)), "n_docs": pa.array(size, pa.int32()),
           "max_tf": pa.array(np.maximum.reduceat(many, _starts(size)) if len(size) else size, pa.int32())}
    if heads:
        return out
    entries = np.repeat(doc_at[docs] - _starts(many), many) + np.arange(many.sum())
    places = _from_gaps(place.to_numpy().astype(np.int64)[docs], _starts(size), size)
    positions = _from_gaps(pos.to_numpy().astype(np.int64)[entries], _starts(many), many)
    ends = pa.array(np.append(0, np.cumsum(size)), pa.int32())
    inner = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)), pa.int32()), pa.array(positions, pa.int32()))
    return out | {"ids": pa.ListArray.from_arrays(ends, known.take(pa.array(places))), "positions": pa.ListArray.from_arrays(ends, inner)}


def _packed(rows: pa.Table, key: tuple, out: pa.Schema) -> pa.Table:
    """The posting rows of one block as one row per shard of terms."""
    terms = rows["term"].combine_chunks()
    shard = np.array([zlib.crc32(t.encode()) % SHARDS for t in _strings(terms)], dtype=np.uint8)
    order = pc.array_sort_indices(terms).to_numpy()
    order = order[np.argsort(shard[order], kind="stable")]
    # taken once, by shard and term; a shard's rows are a slice
    rows, shards, at = rows.take(pa.array(order)), *np.unique(shard[order], return_index=True)
    ends = np.append(at[1:], len(order))
    found = [(x, _pack(rows.slice(i, j - i))) for x, i, j in zip(shards.tolist(), at.tolist(), ends.tolist())]
    columns = [[x for x, _ in found], [key[0].as_py()] * len(found), [key[2].as_py()] * len(found), [d.size for _, d in found], [pa.compress(d, CODEC, asbytes=True) for _, d in found]]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)


def _rows_schema(id_type: str) -> str:
    return f"folder int, block long, term string, n_docs int, max_tf int, ids array<{id_type}>, positions array<array<int>>"


def unpacked(packed: DataFrame, id_type: str, terms: DataFrame | None = None, heads: bool = False) -> DataFrame:
    """Posting rows of a packed table, of ``terms`` or of all; with ``heads`` their narrow columns only."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = _rows_schema(id_type).partition(", ids ")[0] if heads else _rows_schema(id_type)
    out, cut = to_arrow_schema(packed.sparkSession.createDataFrame([], schema).schema), terms is not None

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                part = _unpack(pa.decompress(b["rows"][i].as_buffer(), b["size"][i].as_py(), CODEC), b["terms"][i].values if cut else None, heads)
                n = len(part["term"])
                if n:
                    part |= {c: pa.array(np.full(n, b[c][i].as_py())) for c in ("folder", "block")}
                    yield pa.RecordBatch.from_arrays([part[f.name].cast(f.type) for f in out], schema=out)

    if terms is not None:
        by_shard = terms.select(shard_of(F.col("term")).alias("shard"), "term").groupBy("shard").agg(F.collect_set("term").alias("terms"))
        read = [r.shard for r in by_shard.select("shard").collect()]  # at most ``SHARDS`` numbers, which cut the scan
        packed = packed.where(F.col("shard").isin(read)).join(by_shard, "shard")
    return packed.drop("shard").mapInArrow(kernel, schema)


def posting_rows(docs: DataFrame, text: Column, mode: str, blocks: int, stems: DataFrame | None = None, packed: bool = False) -> DataFrame:
    """The posting rows of ``docs`` (id and text), as they are or ``PACKED``.

    The texts are shuffled by groups of ``GROUP_BLOCKS`` blocks of one folder, a task for each group, and analysed there; a
    task makes the postings of one block at a time, whose documents bound it.  A small table of stems goes to every task; of
    a larger one the few terms of each block that it holds travel to the block, and the groups are dealt by hash."""
    from pyspark.sql.pandas.types import to_arrow_schema

    id_type = docs.schema["id"].dataType.simpleString()
    schema = PACKED if packed else _rows_schema(id_type)
    whole, out = (to_arrow_schema(docs.sparkSession.createDataFrame([], x).schema) for x in (_rows_schema(id_type), schema))
    key = ["folder", "part", "block"]
    by_term, known = None, None
    if mode == "english" and stems is not None:
        by_term = stems.where("term is not null").groupBy("term").agg(F.collect_list(F.coalesce("stem", "term")).alias("stems"))
        few = by_term.limit(SMALL_STEMS + 1).collect()
        if len(few) <= SMALL_STEMS:
            by_term, known = None, {r.term: list(r.stems) for r in few}
    folders = min(blocks, FOLDERS)
    groups = folders * -(-blocks // (FOLDERS * GROUP_BLOCKS))
    part = (F.floor(F.col("block") / (FOLDERS * GROUP_BLOCKS)) * folders + F.col("folder")).cast("int").alias("part")
    texts = placed(docs.select("id", text.alias("text")), blocks).select("folder", part, "block", "id", "text")
    # the groups are numbered, so each has a partition of its own; two sides (a large table of stems) only meet by hash, over
    # several partitions a group, so that few groups meet in one
    texts = texts.repartitionById(min(groups, 4096), F.col("part")) if by_term is None else texts.repartition(min(2 * groups, 4096), "folder", "part")
    texts = texts.sortWithinPartitions(*key)
    tokens = mode_tokens(F.col("text"), mode)
    found = texts.select(*key, "id", F.array_join(tokens, " ").alias("tokens"))  # no token holds a space; one string is sent, not each token
    rows = _block_kernel(mode, whole, known)
    made = (lambda k, *t: _packed(rows(k, *t), k, out)) if packed else rows
    if by_term is None:
        return found.groupBy(*key).applyInArrow(lambda k, t: made(k, t), schema)
    held = texts.select(*key, F.explode(F.array_distinct(tokens)).alias("term")).join(by_term, "term").dropDuplicates([*key, "term"])
    held = held.select(*[F.col(c).alias(f"of_{c}") for c in key], "term", "stems")  # own names: both sides come from ``texts``
    return found.groupBy(*key).cogroup(held.groupBy(*[f"of_{c}" for c in key])).applyInArrow(lambda k, t, s: made(k, t, s), schema)


def build_index(docs: DataFrame, keep: list[str], text: Column, mode: str = "simple", block_docs: int = BLOCK_DOCS,
                stems: DataFrame | None = None, packed: bool = False) -> TextIndex:
    """The index of ``docs`` (with a unique ``id``); ``keep`` names the columns that ranking and filters need.  ``packed``:
    for storing (``stored_index``)."""
    blocks = max(1, -(-docs.count() // block_docs))
    rows, kept = posting_rows(docs, text, mode, blocks, stems, packed), placed(docs.select("id", *keep), blocks)
    return TextIndex(None, kept, rows) if packed else TextIndex(rows, kept)


def write_by_folder(df: DataFrame, path: str) -> None:
    """One folder per group of blocks, sorted by term (where there is one) inside each file for row-group statistics; AQE
    splits large folders over several files and puts small ones together."""
    order = ["folder", *[c for c in ("term", "block") if c in df.columns]]
    df.hint("rebalance", "folder").sortWithinPartitions(*order).write.partitionBy("folder").parquet(path)


def write_postings(df: DataFrame, path: str) -> None:
    """As ``write_by_folder`` for posting rows, which lie in tasks by folder already: nothing is shuffled again."""
    df.sortWithinPartitions("folder", "term", "block").write.partitionBy("folder").parquet(path)


def write_packed(df: DataFrame, path: str) -> None:
    df.write.partitionBy("shard").option("compression", "zstd").parquet(path)


def stored_index(build, store) -> TextIndex:
    """The index that ``build()`` makes (``packed``), kept by ``store(name, build, write)``, which reads it back and need not build it again."""
    made = functools.cache(build)  # one count of the documents for both parts
    packed, docs = store("postings", lambda: made().packed, write_packed), store("docs", lambda: made().docs, write_by_folder)
    return TextIndex(unpacked(packed, docs.schema["id"].dataType.simpleString()), docs, packed)


def term_matches(index: TextIndex, qterms: DataFrame, pred: Column, keep: list[str]) -> DataFrame:
    """Every document that holds a term of a query and passes ``pred``: ``(query_id, id, term_idx, n_terms, pos, keep...)``
    with ``pos`` the array of positions."""
    hits = batch_postings(index, qterms).select("*", F.explode(F.arrays_zip("ids", F.col("positions").alias("pos"))).alias("d"))
    hits = hits.withColumn("id", F.col("d.ids")).withColumn("pos", F.col("d.pos")).drop("ids", "positions", "d")
    # the documents join the postings once per term; the queries that name the term come last
    return hits.join(index.docs, ["folder", "block", "id"]).join(qterms, "term").where(pred).select("query_id", "id", "term_idx", "n_terms", "pos", *keep)


def batch_postings(index: TextIndex, qterms: DataFrame) -> DataFrame:
    """The posting rows of the batch's terms, each once: cut in the scan while the terms are few enough to broadcast."""
    return _batch(index, qterms, False).select("folder", "block", "term", "ids", "positions")


def _batch(index: TextIndex, qterms: DataFrame, heads: bool) -> DataFrame:
    terms = qterms.select("term").distinct()
    if index.packed is not None:
        return unpacked(index.packed, index.docs.schema["id"].dataType.simpleString(), terms, heads)
    return index.postings.join(terms, "term", "left_semi")


def block_visits(index: TextIndex, qterms: DataFrame) -> DataFrame:
    """Blocks where all terms of a query occur: ``(query_id, folder, block, least, bound)``, from narrow columns only.

    ``least`` is the number of documents of the rarest term there.  ``bound``: each minimal cover starts at the last
    occurrence of some term before one of the rarest term's, so there are at most terms x occurrences of them."""
    heads = _batch(index, qterms, True).select("folder", "block", "term", "n_docs", "max_tf").join(qterms.select("query_id", "term", "n_terms"), "term")
    met = heads.groupBy("query_id", "folder", "block").agg(F.count("*").alias("found"), F.first("n_terms").alias("n_terms"), F.min("n_docs").alias("least"), F.min("max_tf").alias("tf"))
    bound = (F.lit(COVER_WEIGHT) * F.col("n_terms") * F.col("tf")).cast("float").cast("double")
    return met.where("found = n_terms").select("query_id", "folder", "block", "least", bound.alias("bound"))


def _matches_kernel(out: pa.Schema) -> Callable:
    """(key, a block's visits, its postings of the batch's terms) -> documents of the block that hold all terms of a query."""

    def rows(key: tuple, visits: pa.Table, postings: pa.Table) -> pa.Table:
        if not (visits.num_rows and postings.num_rows):
            return out.empty_table()
        row_of = {t: i for i, t in enumerate(postings["term"].to_pylist())}
        ids, positions = (postings[c].combine_chunks() for c in ("ids", "positions"))
        at = np.append(0, np.cumsum(ids.value_lengths().to_numpy()))
        docs = ids.flatten().dictionary_encode()
        doc = docs.indices.fill_null(-1).to_numpy()  # a null id matches nothing
        inner = positions.flatten()
        size, places = inner.value_lengths().to_numpy(), inner.flatten().to_numpy()
        starts = np.cumsum(size) - size
        n, got = len(docs.dictionary), []
        for q, terms in enumerate(visits["terms"].to_pylist()):
            own = [(row_of[x["term"]], x["term_idx"]) for x in terms if x["term"] in row_of]
            if not own:
                continue
            seen, where = np.zeros(n, dtype=np.int32), np.zeros((len(own), n), dtype=np.int64)
            for k, (r, _) in enumerate(own):
                d = doc[at[r]:at[r + 1]]
                ok = d >= 0
                seen[d[ok]] += 1
                where[k, d[ok]] = np.arange(at[r], at[r + 1])[ok]
            hit = np.flatnonzero(seen == len(own))
            if len(hit):
                entry = where[:, hit].ravel()
                many = size[entry]
                pos = places[np.repeat(starts[entry] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
                term = np.repeat(np.repeat(np.array([i for _, i in own]), len(hit)), many)
                nth = np.repeat(np.tile(np.arange(len(hit)), len(own)), many)
                order = np.lexsort((term, pos, nth))
                got.append((np.full(len(hit), q), np.full(len(hit), len(own)), hit, many.reshape(len(own), -1).sum(axis=0), pos[order], term[order]))
        if not got:
            return out.empty_table()
        q, n_terms, hit, many, pos, term = (np.concatenate(x) for x in zip(*got))
        occ = pa.StructArray.from_arrays([pa.array(pos, pa.int32()), pa.array(term, pa.int32())], ["pos", "term_idx"])
        columns = [visits["query_id"].combine_chunks().take(pa.array(q)), pa.array(np.full(len(q), key[0].as_py())), pa.array(np.full(len(q), key[1].as_py())), pa.array(n_terms),
                   docs.dictionary.take(pa.array(hit)), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)), pa.int32()), occ)]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, out)], schema=out)

    return rows


def block_matches(index: TextIndex, qterms: DataFrame, visits: DataFrame, pred: Column, keep: list[str]) -> DataFrame:
    """H03 in the visited blocks: documents that hold all terms and pass ``pred``: ``(query_id, id, keep..., n_terms, occ)``.

    A block's visits meet its postings of the batch's terms in one group, which the block bounds, so a posting is sent once
    however many queries name its term; ``occ`` holds the matches' (pos, term_idx) in order."""
    from pyspark.sql.pandas.types import to_arrow_schema

    params = [c for c in qterms.columns if c.startswith("q_")]
    terms = qterms.groupBy("query_id").agg(F.collect_list(F.struct("term", "term_idx")).alias("terms"))
    wanted = visits.select("query_id", "folder", "block").join(terms, "query_id").select("folder", "block", "query_id", "terms")
    blocks = visits.select("folder", "block").distinct()
    met = batch_postings(index, qterms).join(blocks, ["folder", "block"], "left_semi")
    types = {c: d.schema[c].dataType.simpleString() for d, c in ((qterms, "query_id"), (index.docs, "id"))}
    schema = f"query_id {types['query_id']}, folder int, block long, n_terms int, id {types['id']}, occ array<struct<pos: int, term_idx: int>>"
    kernel = _matches_kernel(to_arrow_schema(index.docs.sparkSession.createDataFrame([], schema).schema))
    hits = wanted.groupBy("folder", "block").cogroup(met.groupBy("folder", "block")).applyInArrow(lambda k, v, p: kernel(k, v, p), schema)
    hits = hits.join(index.docs, ["folder", "block", "id"]).join(qterms.where("term_idx = 0").select("query_id", *params), "query_id")
    return hits.where(pred).select("query_id", "id", *keep, "n_terms", "occ")


def ranked(matches: DataFrame, keep: list[str]) -> DataFrame:
    """``matches`` with the cover-density rank, rounded to a 4-byte float like the text-search rank it reproduces."""
    return matches.select("query_id", "id", *keep, _cover_density(F.col("occ"), F.col("n_terms")).cast("float").cast("double").alias("text_rank"))


def search_index_topk(index: TextIndex, qterms: DataFrame, k: int | None, pred: Column, keep: list[str], order: list[Column]) -> DataFrame:
    """H03 + H04 over the index: each query's ``k`` best documents by ``order`` (rank first), or all (``k`` None).

    Each query first ranks its ``FIRST_BLOCKS`` blocks of highest bound; of the others only those whose bound reaches the
    k-th rank found there are read."""
    from .vector import top_k_per_group
    from ..sources import io as IO

    qterms = IO.keep(qterms, "query-terms")
    visits = IO.keep(block_visits(index, qterms), "block-visits")
    if k is None:
        return ranked(block_matches(index, qterms, visits, pred, keep), keep)
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), F.desc("least"), "block"))
    first = visits.withColumn("nth", nth).where(F.col("nth") <= FIRST_BLOCKS)
    head = top_k_per_group(ranked(block_matches(index, qterms, first, pred, keep), keep), ["query_id"], order, k)
    if (visits.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0) <= FIRST_BLOCKS:
        return head
    head = IO.keep(head, "first-blocks")
    kth = head.where(F.col("rank") == k).select("query_id", F.col("text_rank").alias("kth"))
    rest = visits.join(first, ["query_id", "block"], "left_anti").join(kth, "query_id", "left").where("bound >= coalesce(kth, 0)")
    tail = ranked(block_matches(index, qterms, rest, pred, keep), keep)
    return top_k_per_group(head.drop("rank").unionByName(tail), ["query_id"], order, k)
