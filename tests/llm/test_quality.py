import zlib

import numpy as np
from helpers import SF001, odd_rows

from shelfspark.llm import quality


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    pos = label == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() - 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in quality.quality_scores(spark.read.parquet(f"{sf}/documents.parquet"), labels).collect()}
    assert len(got) == 10000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [(got[r.doc_id].score, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    score, label = (np.array(x, dtype=float) for x in zip(*held))
    assert auc(score, label) > 0.97
    assert ((score >= 0.5) == label).mean() > 0.95
    high = score > 0.5
    assert abs(score[high].mean() - label[high].mean()) < 0.05  # calibrated


def test_held_out_labels_do_not_matter(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 1 - quality, quality) as quality")
    a = {r.doc_id: r.score for r in quality.quality_scores(docs, labels).collect()}
    b = {r.doc_id: r.score for r in quality.quality_scores(docs, flipped).collect()}
    assert all(abs(a[k] - b[k]) < 1e-6 for k in a)


def test_odd_rows(spark):
    df = odd_rows(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(16)] + [(3, None), (None, 1), (9, 1)], "doc_id long, quality int")
    for known in (labels, labels.where("false"), labels.where("quality = 1")):
        got = quality.quality_scores(df, known).collect()
        assert len(got) == 17 and all(0 <= r.score <= 1 for r in got)
        same = [r.score for r in got if r.doc_id in (9, 10)]
        assert max(same) - min(same) < 1e-9
    assert quality.quality_scores(df.where("false"), labels).count() == 0


def test_contexts_are_sums_of_neighbours():
    rng = np.random.default_rng(0)
    place, sign = quality.index_vectors()
    rows, doc = rng.integers(0, 50, 300), np.sort(rng.integers(0, 9, 300))
    want = np.zeros((quality.WORDS, quality.DIMS))
    for i in range(300):
        for j in range(max(0, i - quality.WINDOW), min(300, i + quality.WINDOW + 1)):
            if i != j and doc[i] == doc[j]:
                np.add.at(want[rows[i]], place[rows[j]], sign[rows[j]])
    assert np.allclose(quality._contexts(rows, doc, place, sign), want)


def features_by_hand(texts):
    """Context vectors and pooled features by plain loops."""
    place, sign = quality.index_vectors()
    docs = [[zlib.crc32(w.encode()) % quality.WORDS for w in quality._TOKEN.findall(t)] for t in texts]
    vectors, count = np.zeros((quality.WORDS, quality.DIMS)), np.zeros(quality.WORDS)
    for d in docs:
        for i, w in enumerate(d):
            count[w] += 1
            for j in range(max(0, i - quality.WINDOW), min(len(d), i + quality.WINDOW + 1)):
                if i != j:
                    np.add.at(vectors[w], place[d[j]], sign[d[j]])
    used = count > 0
    vectors[used] -= count[used, None] * (vectors.sum(axis=0) / count.sum())
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = vectors / np.where(norm > 0, norm, 1)
    weight = 1e-3 / (1e-3 + count / count.sum())
    out = np.zeros((len(texts), quality.FEATURES))
    for k, d in enumerate(docs):
        if d:
            w, x = weight[d], vectors[d]
            mean = (w[:, None] * x).sum(axis=0) / w.sum()
            out[k] = [*mean, *np.sqrt(np.maximum(0, (w[:, None] * x**2).sum(axis=0) / w.sum() - mean**2)), np.log1p(len(d))]
    return out


def test_features_by_brute_force_also_in_slices(spark, monkeypatch):
    rng = np.random.default_rng(3)
    texts = ["", " ", "one", *(" ".join(f"w{k}" for k in rng.integers(0, 40, n)) + "!?" for n in (2, 5, 60, 700, 3000))]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    want = features_by_hand(texts)
    for chars, tokens in ((1 << 20, 1 << 18), (500, 100)):
        monkeypatch.setattr(quality, "SLICE_CHARS", chars)
        monkeypatch.setattr(quality, "SLICE_TOKENS", tokens)
        words = quality.WordRows()
        place, sign = quality.index_vectors()
        total = np.zeros((quality.WORDS, quality.DIMS))
        for t in texts:
            at, n = words.of([t])
            if len(at):
                total += quality._contexts(at, np.zeros(len(at), dtype=int), place, sign)
        assert "".join(quality.slices(texts[-1])) == texts[-1]
    got = {r.id: np.array(r.features) for r in quality.pooled(rows, *quality.word_vectors(rows)).collect()}
    assert np.allclose([got[k] for k in range(len(texts))], want, atol=1e-4)


def test_the_sample_is_bounded(spark):
    rows = [(i, ("good fine " if i % 2 else "bad awful ") * (1 + i % 4)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    labels = spark.createDataFrame([(i, i % 2) for i in range(3000)], "doc_id long, quality int")
    got = quality.quality_scores(docs, labels, max_rows=400).collect()
    assert len(got) == 3000 and np.mean([r.predicted == r.doc_id % 2 for r in got]) > 0.99
