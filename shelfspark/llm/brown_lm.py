"""LM scoring (operator 9): Brown class-based bigrams with exchange clustering.

P(text) = product over tokens of P(class | class before) * P(word | class).

* Every training word is clustered. Core words (at least ``min_share`` of the training tokens) and, for the others, the symbol of
  their last two letters go through rounds of exchange over the corpus' symbol bigrams, each move raising the likelihood
  of the class bigrams most. Then one round over the whole vocabulary, kept as Spark tables, moves every other word that
  occurs at least twice to the class that its own neighbours make likeliest. Only words seen once, or never in training,
  keep the class of their last two letters.
* Class bigrams, emissions and counts are those of the final classes over all training documents. Transitions are smoothed
  towards the class frequencies; in a class the unseen words together get the share of words seen once (Good-Turing).

The corpus lies in blocks of some megabytes, one row each: the block's dictionary and its documents as positions in it, so
counts of core words, symbol bigrams and contexts are narrow passes. One shuffle brings a word's contexts together, a row per
block and distinct word that is not core (so no hot word shuffles); counts and classes return to the blocks in packed rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, store

MIN_SHARE = 1e-4
CLASSES = 48
ROUNDS = 6
BLOCK_BYTES = 8 << 20
SUFFIX = 2
#: Training tokens a word needs for a class by its own contexts.
LEARN_FROM = 2
#: In a document's string of classes: marks a word without training tokens.
UNKNOWN = 64
#: The end of a text, as a word: no text has an empty word.
END = ""


def is_held_out(doc_id: int | None) -> bool:
    """Rows that the model does not learn from: crc32 of the id as text, modulo 7, is 2 (null id: empty text)."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words at ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


# ---- blocks ---------------------------------------------------------------------------------------------------------

BLOCK_DDL = "block long, words array<string>, n array<int>, doc_ids array<long>, held array<boolean>, ends array<int>, tokens binary"


def _blocks(rows: DataFrame, block_bytes: int) -> DataFrame:
    """One row per block: its dictionary with counts in the block's training documents, and its documents one after another
    (``tokens``: int32 positions in the dictionary, the end included; document i ends before ``ends[i]``)."""

    def block(number, ids, texts):
        flat, ends = [], []
        for t in texts:
            flat += words_of(t)
            flat.append(b"")
            ends.append(len(flat))
        held = np.array([is_held_out(i) for i in ids], dtype=bool)
        index = dict.fromkeys(flat)
        for k, w in enumerate(index):
            index[w] = k
        tokens = np.fromiter(map(index.__getitem__, flat), dtype=np.int32, count=len(flat))
        count = np.bincount(tokens[~np.repeat(held, np.diff(ends, prepend=0))], minlength=len(index))
        one = lambda x, kind: pa.array([x], pa.list_(kind))
        return pa.RecordBatch.from_arrays([
            pa.array([number], pa.int64()), one([w.decode("utf-8", "replace") for w in index], pa.string()), one(count, pa.int32()), one(ids, pa.int64()),
            one(held, pa.bool_()), one(ends, pa.int32()), pa.array([tokens.tobytes()], pa.binary())], names=["block", "words", "n", "doc_ids", "held", "ends", "tokens"])

    def kernel(batches):
        number, ids, texts, held = TaskContext.get().partitionId() << 24, [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):  # no more than a part of the batch twice in memory
                part = batch.slice(at, 500)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids.append(doc_id)
                    texts.append(text)
                    held += len(text or "")
                    if held >= block_bytes:
                        yield block(number, ids, texts)
                        number, ids, texts, held = number + 1, [], [], 0
        if ids:
            yield block(number, ids, texts)

    return rows.select("doc_id", "text").mapInArrow(kernel, BLOCK_DDL)


def _each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The blocks of a kernel's input one at a time; list columns as Arrow arrays, tokens as int32."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = {}
            for name, values in zip(batch.schema.names, batch.columns):
                v = values[k]
                row[name] = np.frombuffer(v.as_buffer(), dtype=np.int32) if name == "tokens" else v.values if isinstance(v, pa.ListScalar) else v.as_py()
            yield row


def _training(row: dict) -> np.ndarray:
    """The tokens of a block's training documents one after another; each document ends with the end."""
    ends = row["ends"].to_numpy()
    return row["tokens"][~np.repeat(row["held"].to_numpy(zero_copy_only=False), np.diff(ends, prepend=0))]


# ---- symbols and classes --------------------------------------------------------------------------------------------


class Symbols:
    """Numbers of the symbols: 0 the end, 1 the rest, then frequent words, then suffixes of the other words."""

    def __init__(self, words: list[str], suffixes: list[str]):
        self.words = {END: 0} | {w: i + 2 for i, w in enumerate(w for w in words if w != END)}
        self.suffixes = {s: i + 2 + len(self.words) - 1 for i, s in enumerate(suffixes)}
        self.size = 1 + len(self.words) + len(self.suffixes)

    def of(self, word: str) -> int:
        at = self.words.get(word)
        return self.suffixes.get(word[-SUFFIX:], 1) if at is None else at


def _sums(df: DataFrame, kernel, key: str) -> DataFrame:
    return df.mapInArrow(kernel, f"{key} string, c long").groupBy(key).agg(F.sum("c").alias("c"))


def core_symbols(blocks: DataFrame, total: int, min_share: float) -> tuple[Symbols, dict[str, int]]:
    """The symbols, and the exact counts of the core words (at most 1 / ``min_share`` of each).

    A core word has a fifth of the share in some block; where it has less, it loses at most that fifth. So candidates are
    words whose counts above it add up to four fifths, and a second pass counts the candidates exactly."""
    least = max(1.0, min_share * total)

    def frequent(batches):
        for row in _each_block(batches):
            n = row["n"].to_numpy()
            at = np.flatnonzero((n > 0) & (n >= n.sum() * min_share / 5))
            yield pa.RecordBatch.from_arrays([row["words"].take(pa.array(at)), pa.array(n[at].astype(np.int64))], names=["word", "c"])

    table = blocks.select("words", "n")
    wanted = {r.word for r in _sums(table, frequent, "word").where(F.col("c") >= 0.8 * least).collect()} | {END}

    def exact(batches):
        for row in _each_block(batches):
            n = row["n"].to_numpy()
            at = [k for k, w in enumerate(row["words"].to_pylist()) if w in wanted]
            yield pa.RecordBatch.from_arrays([row["words"].take(pa.array(at, pa.int64())), pa.array(n[at].astype(np.int64))], names=["word", "c"])

    counts = {r.word: r.c for r in _sums(table, exact, "word").collect()}
    core = {w: c for w, c in counts.items() if c >= least or w == END}

    def suffixes(batches):
        for row in _each_block(batches):
            found: dict[str, int] = {}
            for w, n in zip(row["words"].to_pylist(), row["n"].to_pylist()):
                if w not in core:
                    found[w[-SUFFIX:]] = found.get(w[-SUFFIX:], 0) + n
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["suffix", "c"])

    common = _sums(table, suffixes, "suffix").where(F.col("c") >= least).orderBy("suffix").collect()
    return Symbols(sorted(core, key=lambda w: (-core[w], w)), [r.suffix for r in common]), core


def _bigrams(blocks: DataFrame, symbols: Symbols) -> DataFrame:
    """(a, b, n): counts of neighbouring symbols in the training documents, each document between two ends."""
    size = symbols.size

    def kernel(batches):
        for row in _each_block(batches):
            words = row["words"].to_pylist()
            at = np.fromiter(map(symbols.of, words), dtype=np.int64, count=len(words))[_training(row)]
            code, n = np.unique(np.concatenate([[0], at[:-1]]) * size + at if len(at) else at, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code // size), pa.array(code % size), pa.array(n)], names=["a", "b", "n"])

    return blocks.select("words", "held", "ends", "tokens").mapInArrow(kernel, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _class_contexts(bigrams: DataFrame, classes: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol, how often each class follows it and precedes it: [symbol, class] twice (a bounded table)."""

    def kernel(batches):
        after, before = (np.zeros((len(classes), count), dtype=np.int64) for _ in range(2))
        for batch in batches:
            a, b, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            np.add.at(after, (a, classes[b]), n)
            np.add.at(before, (b, classes[a]), n)
        both = np.concatenate([after, before], axis=1)
        s, c = np.nonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(c), pa.array(both[s, c])], names=["s", "c", "n"])

    table = bigrams.mapInArrow(kernel, "s long, c long, n long").groupBy("s", "c").agg(F.sum("n").alias("n")).toPandas()
    both = np.zeros((len(classes), 2 * count))
    both[table["s"].to_numpy(dtype=int), table["c"].to_numpy(dtype=int)] = table["n"].to_numpy(dtype=float)
    return both[:, :count], both[:, count:]


def _likelihood(pairs: np.ndarray) -> float:
    """Class-bigram log likelihood, up to what no assignment changes."""
    def xlogx(x):
        return float((x * np.log(np.maximum(x, 1))).sum())
    return xlogx(pairs) - xlogx(pairs.sum(axis=1)) - xlogx(pairs.sum(axis=0))


def _class_pairs(after: np.ndarray, classes: np.ndarray, count: int) -> np.ndarray:
    pairs = np.zeros((count, count))
    np.add.at(pairs, classes, after)
    return pairs


def exchange_classes(bigrams: DataFrame, size: int, count: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Class of each symbol and the class bigram counts; the end keeps class 0 for itself."""
    rng = np.random.default_rng(9)
    classes = np.concatenate([[0], 1 + np.arange(size - 1) % (count - 1)])
    best, kept = -np.inf, (classes, np.zeros((count, count)))
    for turn in range(rounds + 1):
        after, before = _class_contexts(bigrams, classes, count)
        pairs = _class_pairs(after, classes, count)
        value = _likelihood(pairs)
        if value > best:
            best, kept = value, (classes, pairs)
        if turn == rounds:
            break
        move = word_gains(after, before, pairs).argmax(axis=1)
        some = rng.random(size) < 0.6  # all at once may swap places for ever
        some[0] = False
        classes = np.where(some, move, classes)
    return kept


# ---- the whole vocabulary -------------------------------------------------------------------------------------------

ANSWER = "word string, count long, class int, block long, at binary, c binary, kind binary"


@dataclass
class Vocabulary:
    """``words``: word, count, class of every training word that is not core; ``answers``: counts and classes for positions of
    a block's dictionary (int32, int64, uint8 packed); ``core``: count and class of the core words."""

    words: DataFrame
    answers: DataFrame
    core: dict[str, tuple[int, int]]


def word_gains(after: np.ndarray, before: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Gain in log likelihood, to first order, of each class for words with these neighbours; never the end's class."""
    log = np.log(pairs + 0.5)
    own = np.log(pairs.sum(axis=1) + 0.5) + np.log(pairs.sum(axis=0) + 0.5)
    gain = after @ log.T + before @ log - after.sum(axis=1)[:, None] * own[None, :]
    gain[:, 0] = -np.inf
    return gain


def _answer_rows(block: np.ndarray, at: np.ndarray, c: np.ndarray, kind: np.ndarray) -> list[dict]:
    order = np.argsort(block, kind="stable")
    cuts = np.flatnonzero(np.diff(block[order])) + 1
    return [{"block": int(block[p[0]]), "at": at[p].astype(np.int32).tobytes(), "c": c[p].astype(np.int64).tobytes(), "kind": kind[p].astype(np.uint8).tobytes()}
            for p in np.split(order, cuts) if len(p)]


def assign_words(blocks: DataFrame, symbols: Symbols, core: dict[str, int], classes: np.ndarray, pairs: np.ndarray) -> Vocabulary:
    """One exchange round over all words that are not core, by their neighbours' classes."""
    count, kinds = len(pairs), classes.astype(np.uint8)
    schema = pa.schema([("word", pa.string()), ("count", pa.int64()), ("class", pa.int32()), ("block", pa.int64()), ("at", pa.binary()), ("c", pa.binary()), ("kind", pa.binary())])

    def contexts(batches):
        """word, block, at, near: the classes before and after each training token of the word in the block, two bytes each."""
        for row in _each_block(batches):
            words = row["words"].to_pylist()
            kind = kinds[np.fromiter(map(symbols.of, words), dtype=np.int64, count=len(words))]
            rare = np.fromiter((w not in core for w in words), dtype=bool, count=len(words))
            flat = _training(row)
            near = np.stack([np.concatenate([kinds[:1], kind[flat][:-1]]), np.concatenate([kind[flat][1:], kinds[:1]])], axis=1)[: len(flat)] if len(flat) else np.zeros((0, 2), np.uint8)
            mine = np.flatnonzero(rare[flat])
            mine = mine[np.argsort(flat[mine], kind="stable")]
            at = np.flatnonzero(rare)
            sizes = np.bincount(flat[mine], minlength=len(words))[at]
            ends = np.concatenate([[0], 2 * np.cumsum(sizes)]).astype(np.int32)
            held = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(near[mine]))])
            for k in range(0, len(at), 100_000):
                part = pa.array(at[k:k + 100_000])
                yield pa.RecordBatch.from_arrays([row["words"].take(part), pa.array(np.full(len(part), row["block"], dtype=np.int64)), part.cast(pa.int32()), held.slice(k, 100_000)],
                                                 names=["word", "block", "at", "near"])

    def decide(batches):
        """Words come in order; each gets its count and class, which go to all its blocks."""
        out: list[tuple] = []
        last = None  # the word whose rows may go on: word, its neighbours' counts, block and at of its rows

        def finish(words, near, blocks_, ats, group):
            """Rows of the vocabulary, and the answers for the rows of ``group``."""
            after, before = near[:, count:], near[:, :count]
            c = after.sum(axis=1).astype(np.int64)
            kind = np.where(c >= LEARN_FROM, word_gains(after, before, pairs).argmax(axis=1), classes[[symbols.of(w) for w in words]])
            out.append((blocks_, ats, c[group], kind[group]))
            seen = np.flatnonzero(c > 0)
            return [{"word": words[i], "count": int(c[i]), "class": int(kind[i])} for i in seen]

        def flush():
            rows = _answer_rows(*(np.concatenate(x) for x in zip(*out))) if out else []
            out.clear()
            return rows

        for b in batches:
            for k in range(0, b.num_rows, 4096):
                part = b.slice(k, 4096)
                coded = part["word"].dictionary_encode()
                words, group = coded.dictionary.to_pylist(), coded.indices.to_numpy()
                ends, data = np.frombuffer(part["near"].buffers()[1], dtype=np.int32)[part["near"].offset:part["near"].offset + len(part) + 1], part["near"].buffers()[2]
                flat = np.frombuffer(data, dtype=np.uint8)[ends[0]:ends[-1]].reshape(-1, 2) if data is not None else np.zeros((0, 2), np.uint8)
                of = np.repeat(group, np.diff(ends) // 2).astype(np.int64)
                near = np.bincount(of * 2 * count + flat[:, 0], minlength=len(words) * 2 * count) + np.bincount(of * 2 * count + count + flat[:, 1], minlength=len(words) * 2 * count)
                near = near.reshape(len(words), 2 * count).astype(float)
                blocks_, ats = part["block"].to_numpy(), part["at"].to_numpy()
                rows = []
                if last is not None:
                    if words[0] == last[0]:
                        near[0] += last[1]
                        blocks_, ats, group = np.concatenate([last[2], blocks_]), np.concatenate([last[3], ats]), np.concatenate([np.zeros(len(last[2]), group.dtype), group])
                    else:
                        rows += finish([last[0]], last[1][None, :], last[2], last[3], np.zeros(len(last[2]), dtype=np.int64))
                keep = group == len(words) - 1
                last = (words[-1], near[-1], blocks_[keep], ats[keep])
                if len(words) > 1:
                    rows += finish(words[:-1], near[:-1], blocks_[~keep], ats[~keep], group[~keep])
                if sum(len(x[0]) for x in out) > 1_000_000:
                    rows += flush()
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
        rows = [] if last is None else finish([last[0]], last[1][None, :], last[2], last[3], np.zeros(len(last[2]), dtype=np.int64))
        rows += flush()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    fixed = {w: (c, int(classes[symbols.words[w]])) for w, c in core.items()}

    def core_answers(batches):
        for row in _each_block(batches):
            found = [(k, *fixed[w]) for k, w in enumerate(row["words"].to_pylist()) if w in fixed]
            at, c, kind = (np.array(x) for x in zip(*found))
            yield pa.RecordBatch.from_pylist(_answer_rows(np.full(len(at), row["block"]), at, c, kind), schema=schema)

    near = blocks.select("block", "words", "held", "ends", "tokens").mapInArrow(contexts, "word string, block long, at int, near binary")
    decided = store(near.repartition("word").sortWithinPartitions("word").mapInArrow(decide, ANSWER), "lm-words", "zstd")
    answers = decided.where("block is not null").select("block", "at", "c", "kind").unionByName(
        blocks.select("block", "words").mapInArrow(core_answers, ANSWER).select("block", "at", "c", "kind"))
    return Vocabulary(decided.where("block is null").select("word", "count", "class"), answers, fixed)


class ClassModel:
    """Probabilities of the class bigram model, as base-10 logarithms."""

    def __init__(self, pairs: np.ndarray, of_class: np.ndarray, singles: np.ndarray, strength: float = 10.0):
        """of_class, singles: per class, training tokens and words seen once."""
        count = len(pairs)
        share = (of_class + 1) / (of_class.sum() + count)
        self.step = np.log10((pairs + strength * share[None, :]) / (pairs.sum(axis=1, keepdims=True) + strength))
        unseen = np.minimum(0.9, (singles + 0.5) / (of_class + 1))
        self.unseen = np.log10(unseen)
        self.seen = np.log10((1 - unseen) / np.maximum(of_class, 1))

    def score(self, kinds: np.ndarray, ends: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """Per document (its classes end before ends[i]; ``logs``: its known words' log counts): its log probability."""
        known, at = kinds < UNKNOWN, kinds % UNKNOWN
        start = np.concatenate([[0], ends[:-1]])
        before = np.concatenate([[0], at[:-1]])
        before[start] = 0  # every text follows an end
        return logs + np.add.reduceat(self.step[before, at] + np.where(known, self.seen[at], self.unseen[at]), start)


# ---- the operator ---------------------------------------------------------------------------------------------------


DOCS = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, logs double, kinds binary"


def _documents(blocks: DataFrame, answers: DataFrame, symbols: Symbols, classes: np.ndarray, total: int, types: int) -> DataFrame:
    """Each document's base score, and its words as classes (a byte each)."""

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        row = next(_each_block(left.combine_chunks().to_batches()))
        at, c, kind = (np.frombuffer(b"".join(right[x].to_pylist()), dtype=t) for x, t in (("at", np.int32), ("c", np.int64), ("kind", np.uint8)))
        counts, kinds = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        counts[at], kinds[at] = c, kind
        tokens, ends = row["tokens"], row["ends"].to_numpy()
        start = np.concatenate([[0], ends[:-1]])
        known = counts > 0
        per = lambda x: np.add.reduceat(x[tokens], start)
        raw = (kinds + np.where(known, 0, UNKNOWN)).astype(np.uint8)[tokens].tobytes()
        return pa.table({
            "doc_id": row["doc_ids"], "held_out": row["held"], "n_tokens": pa.array((ends - start).astype(np.int64)), "n_known": pa.array(per(known.astype(np.int64))),
            "base_score": pa.array(per(np.log10((counts + 1) / (total + types + 1)))), "logs": pa.array(per(np.log10(np.maximum(counts, 1)))),
            "kinds": pa.array([raw[a:b] for a, b in zip(start.tolist(), ends.tolist())], pa.binary())})

    docs = blocks.select("block", "doc_ids", "held", "ends", "tokens")
    return docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(kernel, DOCS)


def _kind_slabs(batch: pa.RecordBatch, size: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of documents of a batch of about ``size`` tokens: (from, to, classes, ends)."""
    sizes = pa.compute.binary_length(batch["kinds"]).to_numpy()
    part = np.cumsum(sizes) // size
    for p in np.unique(part):
        i = np.flatnonzero(part == p)
        raw = b"".join(batch["kinds"].slice(i[0], len(i)).to_pylist())
        yield int(i[0]), int(i[-1]) + 1, np.frombuffer(raw, dtype=np.uint8).astype(np.int64), np.cumsum(sizes[i])


def class_pairs(docs: DataFrame, count: int) -> np.ndarray:
    """Class bigram counts of the training documents."""

    def kernel(batches):
        pairs = np.zeros(count * count, dtype=np.int64)
        for batch in batches:
            for _, _, at, _ in _kind_slabs(batch):
                at = at % UNKNOWN
                pairs += np.bincount(np.concatenate([[0], at[:-1]]) * count + at, minlength=count * count)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(pairs)), pa.array(pairs[pairs > 0])], names=["pair", "n"])

    out = np.zeros(count * count)
    for r in docs.where("not held_out").select("kinds").mapInArrow(kernel, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r.pair] = r.n
    return out.reshape(count, count)


@dataclass
class Trained:
    """What the corpus taught: symbols with their classes, the vocabulary, documents as classes, and the model."""

    symbols: Symbols
    symbol_classes: np.ndarray
    symbol_pairs: np.ndarray
    vocabulary: Vocabulary
    documents: DataFrame
    model: ClassModel
    total: int
    types: int


def train(rows: DataFrame, min_share: float = MIN_SHARE, classes: int = CLASSES, rounds: int = ROUNDS, block_bytes: int = BLOCK_BYTES) -> Trained:
    """The model of ``rows`` (doc_id, text)."""
    blocks = _blocks(rows, block_bytes)
    # a row is a block: row groups are closed by size, not after a hundred rows
    blocks = store(blocks, "lm-blocks", "zstd", **{"parquet.block.size": str(4 * block_bytes), "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1"})
    total = blocks.select(F.explode("n").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    symbols, core = core_symbols(blocks, total, min_share)
    of_symbol, pairs = exchange_classes(store(_bigrams(blocks, symbols), "lm-bigrams"), symbols.size, classes, rounds)
    vocabulary = assign_words(blocks, symbols, core, of_symbol, pairs)

    per_class = vocabulary.words.groupBy("class").agg(F.sum("count").alias("c"), F.count_if(F.col("count") == 1).alias("once"), F.count("*").alias("types")).collect()
    of_class, once, types = np.zeros(classes), np.zeros(classes), 0
    for c, kind in vocabulary.core.values():
        of_class[kind] += c
        once[kind] += c == 1
        types += c > 0
    for r in per_class:
        of_class[r["class"]] += r.c
        once[r["class"]] += r.once
        types += r.types
    docs = store(_documents(blocks, vocabulary.answers, symbols, of_symbol, total, types), "lm-documents", "zstd")
    return Trained(symbols, of_symbol, pairs, vocabulary, docs, ClassModel(class_pairs(docs, classes), of_class, once), total, types)


def lm_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_share: float = MIN_SHARE, classes: int = CLASSES,
              rounds: int = ROUNDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Null and empty texts have one token, the end. Null ids are trained on (crc32 of the empty text is 0); repeated rows
    are documents of their own, in the counts too. Without any training document both scores are those of the base. An
    empty table gives no rows; other columns are neither read nor returned.
    """
    rows = df.select(column(df, id_col).cast("long").alias("doc_id"), column(df, text_col).cast("string").alias("text"))
    got = train(rows, min_share, classes, rounds, block_bytes)
    model, total = got.model, got.total
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]

    def kernel(batches):
        for batch in batches:
            for a, b, kinds, ends in _kind_slabs(batch):
                part = batch.slice(a, b - a)
                base, n = part["base_score"].to_numpy(), part["n_tokens"].to_numpy()
                score = model.score(kinds, ends, part["logs"].to_numpy()) if total else base
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["held_out"], part["n_tokens"], part["n_known"], pa.array(np.full(len(n), total, dtype=np.int64)),
                                                  part["base_score"], pa.array(score), pa.array(10 ** np.minimum(300.0, -score / n))], names=names)

    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    return got.documents.mapInArrow(kernel, out)
