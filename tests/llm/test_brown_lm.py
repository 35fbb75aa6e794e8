import math
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import ODD, SF01, odd_rows, texts

from shelfspark.llm import brown_lm


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def tokens(t):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", lower(t)) + [""]


def base(rows):
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, _ in rows]
    count = Counter(w for (_, t), h in zip(rows, held) if not h for w in tokens(t))
    n, v = sum(count.values()), len(count)
    out = []
    for (i, t), h in zip(rows, held):
        ws = tokens(t)
        out.append((i, h, len(ws), sum(count[w] > 0 for w in ws), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws)))
    return out


def same(got, want):
    key = lambda r: (r[0] is not None, r[0] or 0, r[2])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9)


def test_base_and_model(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    got = brown_lm.lm_scores(docs, block_bytes=200_000).collect()
    same(got, base(list(texts(SF01).items())))
    held = [r for r in got if r.held_out]
    per_token = lambda name: sum(r[name] for r in held) / sum(r.n_tokens for r in held)
    assert per_token("score") > per_token("base_score") + 0.1
    assert all(r.score < 0 and math.isclose(r.perplexity, 10 ** (-r.score / r.n_tokens), rel_tol=1e-9) for r in got)


def test_odd_rows(spark):
    df = odd_rows(spark)
    same(brown_lm.lm_scores(df).collect(), base(ODD))
    assert brown_lm.lm_scores(df.where("false")).count() == 0
    held_only = [(i, "a b") for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2]
    got = brown_lm.lm_scores(spark.createDataFrame(held_only, "doc_id long, text string")).collect()
    same(got, base(held_only))
    assert all(r.score == r.base_score for r in got)


def brute(rows, got, count):
    """Scores by plain loops from the symbols' classes: contexts, best class per word, class bigrams, emissions."""
    core, of = got.vocabulary.core, lambda w: int(got.symbol_classes[got.symbols.of(w)])
    train = [tokens(t) for i, t in rows if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2]
    c = Counter(w for d in train for w in d)
    after, before = {}, {}
    for d in train:
        for p, w, q in zip(["", *d], d, [*d[1:], None]):
            if w not in core:
                before.setdefault(w, np.zeros(count))[of(p)] += 1
                after.setdefault(w, np.zeros(count))[of(q)] += 1
    kind = {w: k for w, (_, k) in core.items()}
    for w in after:
        kind[w] = int(brown_lm.word_gains(after[w][None, :], before[w][None, :], got.symbol_pairs).argmax()) if c[w] >= 2 else of(w)
    pairs, of_class, once = np.zeros((count, count)), np.zeros(count), np.zeros(count)
    for d in train:
        for p, w in zip(["", *d], d):
            pairs[kind[p], kind[w]] += 1
    for w, n in c.items():
        of_class[kind[w]] += n
        once[kind[w]] += n == 1
    share = (of_class + 1) / (of_class.sum() + count)
    unseen = np.minimum(0.9, (once + 0.5) / (of_class + 1))
    scores = []
    for i, t in rows:
        score, last = 0.0, ""
        for w in tokens(t):
            a, b = kind.get(last, of(last)), kind.get(w, of(w))
            score += math.log10((pairs[a, b] + 10 * share[b]) / (pairs[a].sum() + 10))
            score += math.log10(c[w] * (1 - unseen[b]) / of_class[b]) if c[w] else math.log10(unseen[b])
            last = w
        scores.append((i, score))
    return kind, c, scores


def test_scores_and_classes_by_brute_force(spark):
    rows = list(texts("/root/testdata/sf0.001").items()) + [(None, "no id"), (900, ""), (901, None), (902, "zq zq zq \x0b the")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = brown_lm.train(df, min_share=2e-3, classes=12, block_bytes=50_000)
    kind, c, scores = brute(rows, got, 12)
    words = {r.word: (r["count"], r["class"]) for r in got.vocabulary.words.collect()} | got.vocabulary.core
    assert {w: n for w, (n, _) in words.items()} == dict(c)
    assert sum(words[w][1] != kind[w] for w in words) <= 1e-3 * len(words)  # equal gains may fall either way
    exact = dict(scores)
    found = {r.doc_id: r.score for r in brown_lm.lm_scores(df, min_share=2e-3, classes=12, block_bytes=50_000).collect()}
    assert found.keys() == exact.keys() and all(math.isclose(found[i], exact[i], rel_tol=1e-6) for i in found)


def test_core_words_are_exact(spark):
    """A word concentrated in one block and one spread thinly are both found, with exact counts."""
    rows = [(i, "thin " * (i % 9 == 0) + " ".join(f"f{(i * 7 + k) % 400}" for k in range(60))) for i in range(300)] + [(999, "thick " * 90)]
    got = brown_lm.train(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), min_share=2e-3, classes=8, block_bytes=3000)
    count = Counter(w for i, t in rows if not brown_lm.is_held_out(i) for w in tokens(t))
    total = sum(count.values())
    assert got.total == total and {w: n for w, (n, _) in got.vocabulary.core.items()} == {w: n for w, n in count.items() if n >= 2e-3 * total or w == ""}


def test_model_is_a_distribution():
    """Over all training words and, per class, its unseen word, the probabilities after any class sum to one."""
    rng = np.random.default_rng(1)
    pairs = rng.integers(0, 30, (5, 5)).astype(float)
    pairs[0, 0] = 0
    per_class = [rng.integers(1, 9, k) for k in (1, 4, 2, 6, 3)]
    of_class, once = np.array([x.sum() for x in per_class], dtype=float), np.array([(x == 1).sum() for x in per_class], dtype=float)
    model = brown_lm.ClassModel(pairs, of_class, once)
    emit = 10**model.unseen
    for k, x in enumerate(per_class):
        emit[k] += (x * 10 ** model.seen[k]).sum()
    assert np.allclose(emit, 1) and np.allclose((10**model.step).sum(axis=1), 1)


def test_exchange_finds_planted_classes(spark):
    rng = np.random.default_rng(2)
    kind = np.concatenate([[0], 1 + np.arange(40) % 4])  # symbols of class k are followed by class k % 4 + 1
    pairs = Counter()
    for a in range(1, 41):
        for b in rng.choice(np.flatnonzero(kind == kind[a] % 4 + 1), 60):
            pairs[a, int(b)] += 1
        pairs[0, a] += 1
        pairs[a, 0] += 1
    df = spark.createDataFrame([(a, b, n) for (a, b), n in pairs.items()], "a long, b long, n long")
    found, counts = brown_lm.exchange_classes(df, 41, 8, 12)
    start = np.concatenate([[0], 1 + np.arange(40) % 7])
    after, _ = brown_lm._class_contexts(df, start, 8)
    assert brown_lm._likelihood(counts) > brown_lm._likelihood(brown_lm._class_pairs(after, start, 8))
    pure = sum(Counter(kind[found == c].tolist()).most_common(1)[0][1] for c in set(found.tolist()))
    assert pure >= 0.9 * 41


@pytest.mark.parametrize("block_bytes", [1, 5000, 1 << 30])
def test_blocks_change_nothing(spark, block_bytes):
    rows = [(i, f"word{i % 7} other{i % 3} x{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same(brown_lm.lm_scores(df, block_bytes=block_bytes).collect(), base(rows))
