import math
import random
import re
from collections import Counter

import helpers
import numpy as np
import pytest

from shelfspark.llm import lexical_rank

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    """docs, items: (id, text); (item_id, rank, doc_id, score) by the published formula in integers."""
    docs = [(i, Counter(terms(t))) for i, t in docs]
    docs = [(i, c) for i, c in docs if c]
    big_n, big_l = len(docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for i, ts in wanted.items():
        found = []
        for d, c in docs:
            m = 50 + 50 * c.total() * big_n // big_l
            score = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in ts if t in c)
            if score > 0:
                found.append((-score, d is not None, d or 0))
        out += [(i, r + 1, d if known else None, -s) for r, (s, known, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def got(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, df.collect()), key=repr)


def tables(spark, docs, items):
    return (spark.createDataFrame([(i, t, 1, 2.0, "x") for i, t in docs], "doc_id long, text string, m int, score double, term string"),
            spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, rank int"))


def random_docs(n, seed=3):
    """Lengths over a wide range, a very common word, one stratum with a third of all rows, ties."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["É", "x9"]
    out = []
    for i in range(n):
        size = 12 if i % 3 == 0 else int(math.exp(r.uniform(0, 6)))
        out.append((i, "".join(f"{r.choice(words) if r.random() < 0.7 else 'the'}{r.choice([' ', ', ', chr(10)])}" for _ in range(size))))
    return out + [(i + n, "W1 the the") for i in range(40)]


@pytest.mark.parametrize("block_docs, lot_postings, pairs", [(1024, 1 << 19, 1 << 16), (4, 60, 20), (1, 5, 1 << 16)])
def test_against_brute_force(spark, block_docs, lot_postings, pairs):
    docs = random_docs(300)
    items = [(k, t) for k, (_, t) in enumerate(docs[1:30:3])] + [(100, "THE"), (101, "unknown words"), (102, "w1 w1 W2")]
    d, q = tables(spark, docs, items)
    index = lexical_rank.build_index(d, block_docs=block_docs, lot_postings=lot_postings)
    assert got(lexical_rank.search(index, q, k=7, batch_pairs=pairs)) == brute(docs, items, 7)
    assert index.postings.where("term is not null").groupBy("block").agg({"m": "max"}).count() >= index.postings.where("docs is not null").count()


def test_blocks_are_skipped_by_their_bounds():
    """A block that cannot reach the k-th score is never scored."""
    import pyarrow as pa

    inverter, parts = lexical_rank.Inverter(0, 2, 1 << 19), []
    for k in range(40):
        words = ["rare"] * (k < 4) + ["common"]
        parts.append(inverter.add(60, k, pa.array(words), pa.array([1] * len(words), pa.int32())))
    parts.append(inverter.flush())
    rows = pa.Table.from_batches([p for p in parts if p is not None])
    batch = lexical_rank.Batch([7], {"common": 0, "rare": 1}, np.array([10, 5000]), np.array([0, 1, 2]), np.array([0, 0]))
    lot, scored = lexical_rank.Lot(rows, batch), []
    score = lot.score
    lot.score = lambda lo, hi, *a: (scored.append(lo), score(lo, hi, *a))[1]
    out = lexical_rank.top_of_lot(lot, np.array([True]), np.ones(1), 3)
    assert out["id"].to_pylist() == [0, 1, 2] and len(scored) == 2


def test_odd_rows(spark):
    docs = [(i, t) for i, t in helpers.ODD]
    items = [(1, "The SAME text"), (2, None), (3, ""), (4, "日本語 and 🎉"), (5, "over over thion"), (1, "extra blanks"), (None, "id no")]
    d, q = tables(spark, docs, items)
    assert got(lexical_rank.search(lexical_rank.build_index(d), q, k=50)) == brute(docs, items, 50)


def test_empty_tables(spark):
    d, q = tables(spark, [], [(1, "a")])
    assert got(lexical_rank.search(lexical_rank.build_index(d), q)) == []
    d, q = tables(spark, [(1, "a")], [])
    assert got(lexical_rank.search(lexical_rank.build_index(d), q)) == []


def test_long_text_goes_in_slices(monkeypatch):
    text = "Ab cd, " * 1000 + "tail"
    whole = lexical_rank.count_terms(text)
    monkeypatch.setattr(lexical_rank, "SLICE", 64)
    assert lexical_rank.count_terms(text) == whole == Counter({b"ab": 1000, b"cd": 1000, b"tail": 1})
