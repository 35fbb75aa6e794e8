"""Quality classifier (operator 5): random-indexing word vectors pooled per document, then a two-layer network.

Words are hashed to a fixed number of rows. Each row has a sparse random index vector; a word's vector is the sum of the
index vectors of the words next to it, over all documents: one table of fixed size, summed by an aggregate. A document
is the frequency-weighted mean and spread of its words' vectors. The network is fitted with numpy on labelled training
rows (at most ``max_rows`` of them, those with the smallest hash of the id) and its logits are calibrated by one
temperature on rows held back from the fit. Every document is scored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import slabs
from .common import column, store

WORDS = 4096
DIMS = 32
NONZERO = 2
WINDOW = 2
HIDDEN = 32
MAX_ROWS = 20_000
SEED = 5
FEATURES = 2 * DIMS + 1

#: Characters of a long text tokenised at once, and tokens whose neighbours are summed at once.
SLICE_CHARS, SLICE_TOKENS = 1 << 20, 1 << 18

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_BLANK = re.compile(r"\s")


def slices(text: str) -> Iterator[str]:
    """The text in parts cut at white space, which no token holds."""
    at = 0
    while at < len(text):
        blank = _BLANK.search(text, at + SLICE_CHARS)
        end = blank.start() if blank else len(text)
        yield text[at:end]
        at = end


class WordRows:
    """Row number of each word, remembered up to a bound."""

    def __init__(self, limit: int = 400_000):
        self.rows, self.limit = {}, limit

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of all tokens of the texts, and the number of tokens of each text; a long text goes slice by slice."""
        if len(texts) == 1 and len(texts[0]) > SLICE_CHARS:
            at = np.concatenate([self._of([part])[0] for part in slices(texts[0])])
            return at, np.array([len(at)])
        return self._of(texts)

    def _of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        tokens = [_TOKEN.findall(t) for t in texts]
        if len(self.rows) > self.limit:
            self.rows.clear()
        rows = self.rows
        for w in set(chain.from_iterable(tokens)).difference(rows):
            rows[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORDS
        count = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        return np.fromiter(map(rows.__getitem__, chain.from_iterable(tokens)), dtype=np.int64, count=int(count.sum())), count


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of each row's index vector."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, DIMS, (WORDS, NONZERO)), rng.choice([-1.0, 1.0], (WORDS, NONZERO))


def _contexts(rows: np.ndarray, doc: np.ndarray, place: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """Sum of the neighbours' index vectors for each word row."""
    out = np.zeros(WORDS * DIMS)
    for step in range(1, WINDOW + 1):
        for at in range(0, len(rows) - step, SLICE_TOKENS):
            end = min(at + SLICE_TOKENS, len(rows) - step)
            same = doc[at:end] == doc[at + step:end + step]
            left, right = rows[at:end][same], rows[at + step:end + step][same]
            for k in range(NONZERO):
                out += np.bincount(left * DIMS + place[right, k], weights=sign[right, k], minlength=WORDS * DIMS)
                out += np.bincount(right * DIMS + place[left, k], weights=sign[left, k], minlength=WORDS * DIMS)
    return out.reshape(WORDS, DIMS)


def word_vectors(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Unit word vectors [WORDS, DIMS] and token counts [WORDS] over all texts of ``rows`` (column text)."""
    dims = [f"d{i}" for i in range(DIMS)]

    def kernel(batches):
        words, (place, sign) = WordRows(), index_vectors()
        total, count = np.zeros((WORDS, DIMS)), np.zeros(WORDS, dtype=np.int64)
        for batch in batches:
            for part in slabs([t or "" for t in batch.column(0).to_pylist()]):
                at, n = words.of(part)
                if len(at):
                    total += _contexts(at, np.repeat(np.arange(len(n)), n), place, sign)
                    count += np.bincount(at, minlength=WORDS)
        used = np.flatnonzero(count)
        cols = [pa.array(used.astype(np.int32)), pa.array(count[used]), *(pa.array(total[used, i]) for i in range(DIMS))]
        yield pa.RecordBatch.from_arrays(cols, names=["word", "n", *dims])

    sums = rows.select("text").mapInArrow(kernel, "word int, n long, " + ", ".join(f"{d} double" for d in dims))
    table = sums.groupBy("word").agg(F.sum("n").alias("n"), *[F.sum(d).alias(d) for d in dims]).toPandas()  # at most WORDS rows
    vectors, count = np.zeros((WORDS, DIMS)), np.zeros(WORDS)
    at = table["word"].to_numpy(dtype=int)
    count[at] = table["n"].to_numpy(dtype=float)
    vectors[at] = table[dims].to_numpy(dtype=float)
    if len(at):
        vectors[at] -= count[at, None] * (vectors.sum(axis=0) / count.sum())  # what all words share says nothing
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norm > 0, norm, 1), count


def pooled(rows: DataFrame, vectors: np.ndarray, count: np.ndarray) -> DataFrame:
    """(id, features) of every row: weighted mean and spread of the word vectors, and the log of the length."""
    share = count / max(1.0, count.sum())
    weight = (1e-3 / (1e-3 + share)).astype(np.float32)
    table = np.concatenate([vectors * weight[:, None], vectors**2 * weight[:, None], weight[:, None]], axis=1).astype(np.float32)

    def features(words, texts):
        at, n = words.of(texts)
        out = np.zeros((len(texts), FEATURES))
        some = np.flatnonzero(n)
        if len(some):
            if len(some) == 1 and len(at) > SLICE_TOKENS:  # a long text: its rows' counts, not a vector for each token
                sums = (np.bincount(at, minlength=WORDS) @ table.astype(np.float64))[None, :]
            else:
                start = (np.cumsum(n) - n)[some]
                sums = np.add.reduceat(table[at], start, axis=0, dtype=np.float64)
            mass = sums[:, -1:]
            mean = sums[:, :DIMS] / mass
            out[some, :DIMS] = mean
            out[some, DIMS: 2 * DIMS] = np.sqrt(np.maximum(0, sums[:, DIMS: 2 * DIMS] / mass - mean**2))
            out[some, -1] = np.log1p(n[some])
        return out

    def kernel(batches):
        words = WordRows()
        for batch in batches:
            parts = [features(words, p) for p in slabs([t or "" for t in batch.column(1).to_pylist()])]
            flat = np.concatenate(parts) if parts else np.zeros((0, FEATURES))
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, FEATURES, dtype=np.int32)), pa.array(flat.ravel().astype(np.float32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), values], names=["id", "features"])

    return rows.select("id", "text").mapInArrow(kernel, rows.select("id").withColumn("features", F.lit(None).cast("array<float>")).schema)


class Network:
    """Input scaling, one hidden layer, one logit, one temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = 40, batch: int = 256, rate: float = 3e-3, decay: float = 1e-4):
        rng = np.random.default_rng(SEED)
        self.rate_of_one = float(y.mean()) if len(y) else 0.5
        self.fitted = len(y) >= 10 and 0 < y.sum() < len(y)
        if not self.fitted:  # nothing to learn from: every document gets the share of label 1
            return
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        held = np.arange(len(y)) % 5 == 0
        fit_x, fit_y = self._scaled(x[~held]), y[~held]
        p = self.weights = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        first, second, step = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p], 0
        best, kept = np.inf, None
        for _ in range(epochs):
            order = rng.permutation(len(fit_y))
            for at in range(0, len(order), batch):
                b = order[at: at + batch]
                h = np.tanh(fit_x[b] @ p[0] + p[1])
                miss = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - fit_y[b]) / len(b)
                back = np.outer(miss, p[2]) * (1 - h**2)
                grads = [fit_x[b].T @ back + decay * p[0], back.sum(axis=0), h.T @ miss + decay * p[2], miss.sum(keepdims=True)]
                step += 1
                for w, g, m, v in zip(p, grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            loss = self._loss(self._logits(self._scaled(x[held])), y[held])
            if loss < best:
                best, kept = loss, [w.copy() for w in p]
        self.weights = kept or p
        logits = self._logits(self._scaled(x[held]))
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 121))
        self.temperature = float(grid[np.argmin([self._loss(logits / t, y[held]) for t in grid])])

    def _scaled(self, x):
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def _logits(self, x):
        a, b, c, d = self.weights
        return np.tanh(x @ a + b) @ c + d[0]

    @staticmethod
    def _loss(logits, y):
        return float(np.mean(np.logaddexp(0, logits) - y * logits))

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.rate_of_one)
        return 1 / (1 + np.exp(-np.clip(self._logits(self._scaled(x)) / self.temperature, -30, 30)))


def held_out(doc_id: Column) -> Column:
    """True for the rows whose labels no model may see: crc32 of the id as text, modulo 3, is 1 (null id: empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def quality_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per row of ``df``: doc_id, held_out, score, predicted.

    Scores depend on the text alone. Null and empty texts are documents without words and get a score like any other.
    Null labels and labels of unknown ids are not used; of several labels of an id the largest counts. Repeated rows
    get equal scores. With no labels, or only one kind, every score is the share of label 1 (0.5 without labels). An
    empty table gives no rows; other columns are neither read nor returned.
    """
    rows = df.select(column(df, id_col).alias("id"), column(df, text_col).cast("string").alias("text"))
    vectors, count = word_vectors(rows)
    features = store(pooled(rows, vectors, count), "quality-features")
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where(F.col("label").isin(0, 1) & ~held_out(F.col("id")))
    known = store(known.groupBy("id").agg(F.max("label").alias("label")), "quality-labels")
    # a threshold on the hash of the id picks the sample before any features are fetched, so only the sample travels
    draw, total = F.pmod(F.xxhash64("id"), F.lit(1 << 30)), known.count()
    if total > max_rows:
        known = known.where(draw < int((1 << 30) * (max_rows - 6 * max_rows**0.5) / total))  # six deviations below the bound
    sample = features.join(known, "id").select(F.xxhash64("id").alias("h"), "id", "features", "label").limit(max_rows).collect()  # at most max_rows
    sample.sort(key=lambda r: (r["h"], str(r["id"])))
    x = np.array([r["features"] for r in sample], dtype=float).reshape(len(sample), FEATURES)
    network = Network(x, np.array([r["label"] for r in sample], dtype=float))

    def kernel(batches):
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(network.probability(flat.astype(float)))], names=["id", "score"])

    scored = features.mapInArrow(kernel, features.select("id").withColumn("score", F.lit(0.0)).schema)
    return scored.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
