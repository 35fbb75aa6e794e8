"""SimHash near-duplicates against all pairs."""

import random

import numpy as np
import pytest
import xxhash

from shelfspark.llm import simhash


def brute_print(text, k=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(ids, marks, bits=4):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    m = np.array(marks, dtype=np.uint64)
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(m[i] ^ m[i + 1:]) <= bits) + i + 1:
            parent[find(int(j))] = find(i)
    out = {}
    for i in range(len(ids)):
        out.setdefault(find(i), []).append(ids[i])
    return {i: min(out[find(k)]) for k, i in enumerate(ids)}


def test_sf001_equals_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    marks = [brute_print(r.text) for r in rows]
    want = brute_components([r.doc_id for r in rows], marks)
    got = {r.doc_id: r for r in simhash.simhash_components(docs).collect()}
    assert len(got) == len(rows)
    for r, m in zip(rows, marks):
        assert got[r.doc_id].fingerprint == f"{m:016x}" and got[r.doc_id].component_id == want[r.doc_id]


def test_links_of_dense_groups_and_tiles(spark):
    rnd = random.Random(3)
    marks = set()
    for _ in range(4):  # balls of fingerprints round a few centres, and noise
        c = rnd.getrandbits(64)
        marks |= {c ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 5))) for _ in range(150)}
    marks |= {rnd.getrandbits(64) for _ in range(300)}
    marks = sorted(marks)
    signed = [m - (1 << 64) if m >> 63 else m for m in marks]
    want = brute_components(signed, marks)
    df = spark.createDataFrame([(s, s) for s in signed], "id long, fp long")
    for tile in (16, 2048):  # 16: large buckets are cut into chunks
        from shelfspark.llm.common import connected_components
        links = simhash.near_links(df.select("fp"), 4, tile=tile)
        root = {r.node: r.root for r in connected_components(links, "a", "b").collect()}
        assert {s: root.get(s, s) for s in signed} == want


def test_edge_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, " \n", "z"), (4, "one two", "x"), (4, "one two", "x"), (None, "ONE two", "q"), (5, "w " * 30000, "l")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.simhash_components(df).collect()
    assert len(got) == 7
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    assert by[1] == by[2] == by[3] == {("0" * 16, 1)}
    assert {c for _, c in by[4]} == {4} == {c for _, c in by[None]}
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 4, 5]
    empty = df.where("false")
    assert simhash.simhash_components(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0


@pytest.mark.parametrize("text,words", [("a b c", 3), ("a b c d e", 5)])
def test_fingerprint_matches_definition(text, words):
    assert simhash.text_fingerprint(text) == brute_print(text)
    assert simhash.text_fingerprint("Ä " + text.upper()) == brute_print("Ä " + text)
