import zlib
from collections import Counter, defaultdict

import numpy as np
from helpers import SF01, odd_rows

from shelfspark.llm import sharding


def laws(rows, shards=16):
    count = Counter(r.shard for r in rows)
    assert set(count) <= set(range(shards))
    assert max(count.values()) - min(count.get(s, 0) for s in range(shards)) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_documents_and_cut(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    rows = sharding.shard_rows(docs).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    laws(rows)
    assert len(rows) == len(text)
    groups = defaultdict(list)
    for r in rows:
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        groups[text[r.doc_id]].append(r.shard)
    linked = [v for v in groups.values() if len(v) > 1]
    together = sum(max(Counter(v).values()) for v in linked) / sum(map(len, linked))
    assert together > 0.9


def test_one_group_of_a_third(spark):
    rows = [(i, "copy" if i % 3 == 0 else f"text {i % 500 if i % 5 == 0 else i}") for i in range(1500)]
    got = sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    laws(got)
    hot = Counter(r.shard for r in got if r.doc_id % 3 == 0)
    assert sum(n for _, n in hot.most_common(8)) > 0.75 * 500  # kept in few shards, as far as they hold


def test_odd_rows(spark):
    got = sharding.shard_rows(odd_rows(spark)).collect()
    laws(got)
    assert len(got) == 17 and {r.size for r in got if r.doc_id in (1, 2)} == {1}
    assert sharding.shard_rows(odd_rows(spark).where("false")).count() == 0


def test_quotas_never_overfill():
    rng = np.random.default_rng(0)
    demand, load = rng.integers(0, 50, (16, 16)).astype(float), rng.integers(80, 120, 16).astype(float)
    np.fill_diagonal(demand, 0)
    moved = sharding.quotas(demand, load, np.full(16, 100.0)) * demand
    after = load + moved.sum(axis=0) - moved.sum(axis=1)
    assert (moved <= demand + 1e-9).all() and (after <= np.maximum(load, 100) + 1e-6).all()


def test_large_groups_find_shards_with_room(spark):
    """A third of the rows in one group (parts of at most 0.9 shard), groups of half and of a third of a shard: all fit."""
    for rows in (
            [(i, "copy" if i % 3 == 0 else f"text {i}") for i in range(3200)],
            [(i, f"group {i % 16}" if i < 1600 else f"text {i}") for i in range(3200)],
            [(i, f"group {i % 24}" if i < 1584 else f"text {i}") for i in range(3200)]):
        got = sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        laws(got)
        text, spread = dict(rows), defaultdict(Counter)
        for r in got:
            spread[text[r.doc_id]][r.shard] += 1
        for t, shards in spread.items():
            if t == "copy":  # 1,067 rows in parts of at most 180
                assert sum(n for _, n in shards.most_common(6)) == 1067
            else:
                assert len(shards) == 1, (t, shards)
