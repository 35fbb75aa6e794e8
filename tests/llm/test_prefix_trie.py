import hashlib
import random
import re
import zlib
from collections import defaultdict

from shelfspark.llm import prefix_trie


def brute(rows, group=20, heads=4):
    """rows: (conv_id, turn, role, text); nodes by whole prefixes held in memory."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn, (role or "", text or "")))
    order = lambda x: (x[0], x[1] or 0, hashlib.sha256(f"{len(x[2][0])}:{x[2][0]}{x[2][1]}".encode()).digest())
    own = {c: [t[2] for t in sorted(ts, key=order)] for c, ts in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        path = tuple(own.get(c - c % group, [])[:h] + ts[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, ms in members.items():
        s = (len(ms) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += s
            leaves[p[:d]] += not kids[p]
    return sorted((min(ms), len(p), min(members[p[:-1]]) if p else -1, len(ms), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, ms in members.items())


def got(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, b"k") for r in rows], "conv_id long, turn long, role string, text string, depth int, key binary")


def sample(n, seed=1):
    """Shared openings, copies of whole conversations, a hot first turn, gaps and ties in turn."""
    r = random.Random(seed)
    rows = []
    for c in range(n):
        k = r.choice([0, 1, 1, 2, 5, 9])
        hot = r.random() < 0.4
        for t in range(k):
            text = "hot start here" if hot and t == 0 else " ".join(r.choice("abc") for _ in range(r.randint(0, 2)))
            rows.append((c if r.random() < 0.98 else c + 1, r.choice([t, t, t, None, 3]), r.choice(["user", "assistant"]), text))
    return rows


def test_against_brute_force(spark):
    rows = sample(400)
    want = brute(rows)
    df = table(spark, rows)
    assert got(prefix_trie.conversation_trie(df)) == want
    turns = prefix_trie.store(prefix_trie.rebuilt(prefix_trie.turns_of(df)), "test")
    for shard_turns, held, piece in ((25, 100_000, 4096), (60, 3, 2), (10**9, 1, 1)):  # many shards, children let go, lists in pieces
        assert got(prefix_trie.prefix_trie(turns, shard_turns, held, piece)) == want


def test_odd_rows(spark):
    rows = [(20, None, None, None), (20, None, None, None), (20, 0, "user", "Zz"), (21, 5, "user", ""), (22, 1, "a", "1:b"), (22, 1, "a1:", "b"), (None, 0, "user", "lost"),
            (0, 1, "user", "x " * 300_000), (10**12, 0, "u", "\x1c one"), (39, 0, None, "é\tü\x0b\x85"), (40, -1, "user", "a"), (40, None, "user", "b")]
    assert got(prefix_trie.conversation_trie(table(spark, rows))) == brute(rows)


def test_one_conversation_is_most_of_the_table(spark):
    rows = [(7, t, "user", f"t {t % 13}") for t in range(150)] + [(c, 0, "user", "t 0") for c in range(20, 60)]
    assert got(prefix_trie.conversation_trie(table(spark, rows), shard_turns=40)) == brute(rows)


def test_empty_table(spark):
    assert got(prefix_trie.conversation_trie(table(spark, []))) == []
