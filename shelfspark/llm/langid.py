"""Language ID (operator 1): Bayesian fusion of text, declared language, address suffix and host.

The text likelihood is a naive Bayes model of hashed byte trigrams, counted over all documents under their declared
languages. The texts' own most likely languages then give, by grouped aggregation, how far a declaration can be trusted
(language declared given language written) and the priors: all documents -> address suffix -> host, each smoothed
towards the level above it. A document's posterior multiplies the three. Documents without any letter, and documents
whose best language stays below ``min_posterior``, are rejected.

Every language that ``MIN_DOCS`` documents declare is a class at any size of the corpus. A declaration with fewer has too
little text for a model: it is one more candidate for the documents that make it, under evenly spread trigrams, and wins
where no class explains the text better than that.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, fresh, store

BUCKETS = 1 << 13
#: A declared language becomes a class with this many documents, or with this share of a small table's.
MIN_DOCS = 20
MIN_SHARE = 0.005
#: Cells of the (document, language) tables that a task holds at once.
CELLS = 1 << 21
#: Trigrams of a text are far from independent: together they count as this many at most.
EFFECTIVE = 96.0
SMOOTHING = 20.0
MIN_POSTERIOR = 0.5
UNKNOWN = "und"

_LETTERS = np.full(256, 0x20, dtype=np.uint32)
_LETTERS[0x80:] = np.arange(0x80, 0x100)
_LETTERS[ord("a"): ord("z") + 1] = _LETTERS[ord("A"): ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_TAG = re.compile(r"\s*([A-Za-z]{2,3})(?:$|[\s_-])")


def primary_tag(declared: str | None) -> str | None:
    """Primary subtag of a declared language ("en-US" -> "en"), or None where it has no such form."""
    m = _TAG.match(declared or "")
    return m[1].lower() if m else None


def trigrams(text: str) -> tuple[np.ndarray, int]:
    """Buckets of the text's byte trigrams round a letter, and the number of letter bytes."""
    b = _LETTERS[np.frombuffer(b" " + text.encode("utf-8", "surrogatepass") + b" ", dtype=np.uint8)]
    inner = b[1:-1] != 0x20
    code = ((b[:-2] << 16) | (b[1:-1] << 8) | b[2:])[inner]
    return ((code * np.uint32(2654435761)) >> np.uint32(19)).astype(np.int64), int(inner.sum())


def _counts(rows: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all rows; bucket -1 counts the documents."""

    def kernel(batches):
        held: dict[str, np.ndarray] = {}

        def emit():
            for lang, n in held.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array((at - 1).astype(np.int32)), pa.array(n[at])], names=["lang", "bucket", "n"])
            held.clear()

        for batch in batches:
            for text, declared in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lang = primary_tag(declared)
                if lang is None:
                    continue
                if lang not in held and len(held) >= 64:
                    yield from emit()
                n = held.setdefault(lang, np.zeros(BUCKETS + 1, dtype=np.int64))
                n[0] += 1
                n[1:] += np.bincount(trigrams(text or "")[0], minlength=BUCKETS)
        yield from emit()

    parts = rows.select("text", "declared").mapInArrow(kernel, "lang string, bucket int, n long")
    return parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def _model(rows: DataFrame, min_share: float) -> tuple[list[str], np.ndarray, dict[str, int]]:
    """Languages, log P(trigram bucket | language), and the documents of each declaration, of which there are at most
    26 ** 2 + 26 ** 3. The table takes 32 KB a language."""
    counts = store(_counts(rows), "langid-counts")
    docs = {r["lang"]: r["n"] for r in counts.where("bucket = -1").collect()}
    least = min(MIN_DOCS, min_share * sum(docs.values()))
    langs = sorted(k for k, n in docs.items() if n >= least)

    def dense(table: pa.Table) -> pa.Table:
        n = np.zeros(BUCKETS, dtype=np.int64)
        n[table["bucket"].to_numpy()] = table["n"].to_numpy()
        return pa.table({"lang": table["lang"][:1].cast(pa.string()), "n": pa.array([n.tobytes()], pa.binary())})

    logp = np.empty((BUCKETS, len(langs)), dtype=np.float32)
    at = {x: i for i, x in enumerate(langs)}
    logp[:] = np.log(1 / BUCKETS)
    for r in counts.where(F.col("lang").isin(langs) & (F.col("bucket") >= 0)).groupBy("lang").applyInArrow(dense, "lang string, n binary").toLocalIterator():
        n = np.frombuffer(r["n"], dtype=np.int64) + 0.5
        logp[:, at[r["lang"]]] = np.log(n / n.sum())
    return langs, logp, docs


def text_model(rows: DataFrame, min_share: float = MIN_SHARE) -> tuple[list[str], np.ndarray]:
    """Languages and log P(trigram bucket | language), [bucket, language]."""
    return _model(rows, min_share)[:2]


def _slices(batches, width: int):
    """Parts of the batches whose rows, with ``width`` cells each, make at most CELLS cells."""
    step = max(1, CELLS // width)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def _scored(rows: DataFrame, langs: list[str], logp: np.ndarray, docs: dict[str, int]) -> DataFrame:
    """Narrow rows: id, mark (hash of the text), tag, host, suffix, letters, text_lang (number), ll (tempered log
    likelihoods), and for declarations that are no class: own (the language), own_log (its log likelihood and prior).

    text_lang is null where the declaration's evenly spread trigrams explain the text better than any class.
    """
    kinds = {"tag": "string", "host": "string", "suffix": "string", "letters": "long", "text_lang": "int", "ll": "array<double>", "own": "string", "own_log": "double"}
    schema = rows.select("id", "mark", *[F.lit(None).cast(k).alias(n) for n, k in kinds.items()]).schema
    known, total = set(langs), sum(docs.values())

    def kernel(batches):
        for batch in _slices(batches, len(langs)):
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            tags, letters, best, lls, own, own_log = [], [], [], [], [], []
            for text, declared in zip(cols["text"].to_pylist(), cols["declared"].to_pylist()):
                tag = primary_tag(declared)
                tags.append(tag if tag in known else "other" if tag else "none")
                at, n = trigrams(text or "")
                ll = sum((logp[at[k: k + 65536]].sum(axis=0, dtype=np.float64) for k in range(0, len(at), 65536)), np.zeros(len(langs)))
                ll *= min(1.0, EFFECTIVE / max(1, len(at)))
                even = -np.log(BUCKETS) * min(EFFECTIVE, len(at))
                rare = bool(n) and tags[-1] == "other"
                own.append(tag if rare else None)
                own_log.append(even + np.log(docs[tag] / total) if rare else None)
                letters.append(n)
                best.append(int(np.argmax(ll)) if n and not (rare and even > ll.max()) else None)
                lls.append(ll)
            yield pa.RecordBatch.from_arrays(
                [cols["id"], cols["mark"], pa.array(tags), cols["host"], cols["suffix"], pa.array(letters, pa.int64()), pa.array(best, pa.int32()), pa.array(lls, pa.list_(pa.float64())),
                 pa.array(own, pa.string()), pa.array(own_log, pa.float64())],
                names=["id", "mark", *kinds])

    return rows.mapInArrow(kernel, schema)


def _log_prior(counts: DataFrame, key: str, classes: int, above, weight: float) -> DataFrame:
    """(key, prior): probabilities per language of each group, smoothed towards ``above``, an array column or literal."""
    return counts.withColumn("prior", F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: (F.coalesce(F.element_at("by", k), F.lit(0)) + F.lit(weight) * F.element_at(above, k + 1)) / (F.col("n") + F.lit(weight))))


def _by_language(scored: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, by): documents per group, and by language as a map; two aggregates, both combined map-side."""
    cells = scored.where("text_lang is not null").groupBy(*keys, "text_lang").agg(F.count("*").alias("n"))
    return cells.groupBy(*keys).agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("text_lang", "n"))).alias("by"))


def _undeclared(rows: DataFrame) -> DataFrame:
    """The rows of ``identify`` where no declaration names a language."""
    null = F.lit(None).cast("string")

    def kernel(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([trigrams(t or "")[1] for t in batch.column(2).to_pylist()], pa.int64())], names=["id", "mark", "letters"])

    out = rows.select("id", "mark", "text").mapInArrow(kernel, rows.select("id", "mark", F.lit(None).cast("long").alias("letters")).schema)
    return out.select("id", "mark", F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("posterior"), null.alias("text_lang"), null.alias("declared"), "letters", F.lit(False).alias("kept"))


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str | None = "lang", host_col: str | None = "source",
             address_col: str | None = None, min_posterior: float = MIN_POSTERIOR, min_share: float = MIN_SHARE) -> DataFrame:
    """One row per input row: id, mark (hash of the text), lang, posterior, text_lang, declared, letters, kept.

    ``address_col``, where given, is a web address: it names the host, and the suffix is the last label of the host's
    name; without it the suffix is taken from ``host_col``. Null or malformed declarations and hosts are groups of their
    own. Null, empty and letterless texts get the language "und", posterior 0 and are rejected, as is every row where no
    declaration names a language at all. Ties go to the language first in the alphabet. Repeated rows are judged alike;
    an empty table gives no rows; other columns of ``df`` are neither read nor returned.
    """
    null = F.lit(None).cast("string")
    address = column(df, address_col).cast("string") if address_col else null
    host = F.lower(F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)) if address_col else column(df, host_col).cast("string") if host_col else null
    host = F.coalesce(host, F.lit(""))
    rows = df.select(
        column(df, id_col).alias("id"), column(df, text_col).cast("string").alias("text"), F.xxhash64(column(df, text_col)).alias("mark"),
        (column(df, declared_col).cast("string") if declared_col else null).alias("declared"),
        host.alias("host"), F.regexp_extract(host, r"\.([^.]+)$", 1).alias("suffix"))
    langs, logp, docs = _model(rows, min_share)
    if not langs:
        return _undeclared(rows)
    size = len(langs)
    scored = store(_scored(rows, langs, logp, docs), "langid-scored")

    # trust in declarations and the top prior; of the (languages + 2) x languages cells only those with documents are held
    said, by_lang = {}, np.ones(size)
    for r in scored.where("text_lang is not null").groupBy("tag", "text_lang").count().collect():
        said.setdefault(r["tag"], {})[r["text_lang"]] = np.log(1 / (size + 2) + r["count"])
        by_lang[r["text_lang"]] += r["count"]
    top = by_lang / by_lang.sum()
    above = F.split(F.lit(",".join(repr(float(x)) for x in top)), ",").cast("array<double>")

    by_suffix = _log_prior(_by_language(scored, "suffix"), "suffix", size, above, SMOOTHING).select("suffix", F.col("prior").alias("above"))
    by_host = _by_language(scored, "host", "suffix").join(store(by_suffix, "langid-suffix"), "suffix")
    by_host = store(_log_prior(by_host, "host", size, F.col("above"), SMOOTHING).select("host", "prior"), "langid-host")

    joined = scored.join(by_host, "host", "left").select("id", "mark", "tag", "letters", "text_lang", "ll", F.coalesce("prior", above).alias("prior"), "own", "own_log")
    return _fused(joined, langs, said, by_lang, min_posterior)


def _fused(joined: DataFrame, langs: list[str], said: dict[str, dict[int, float]], by_lang: np.ndarray, min_posterior: float) -> DataFrame:
    """The rows of ``identify``: log likelihoods, trust and log priors added up, the declaration's own language beside them."""
    size = len(langs)
    schema = joined.select("id", "mark", *[F.lit(None).cast(k).alias(n) for n, k in (
        ("lang", "string"), ("posterior", "double"), ("text_lang", "string"), ("declared", "string"), ("letters", "long"), ("kept", "boolean"))]).schema
    never = np.log(1 / (size + 2)) - np.log(by_lang)

    def kernel(batches):
        for batch in _slices(batches, size):
            ident, mark, tag, letters, text_lang, ll, prior, own, own_log = batch.columns
            log = ll.flatten().to_numpy(zero_copy_only=False).reshape(-1, size) + np.log(prior.flatten().to_numpy(zero_copy_only=False).reshape(-1, size))
            tags = np.array(tag.to_pylist(), dtype=object)
            for t in set(tags.tolist()):
                trust, seen = never.copy(), said.get(t, {})
                at = list(seen)
                trust[at] = np.array(list(seen.values())) - np.log(by_lang[at])
                log[tags == t] += trust
            beside = own_log.fill_null(-np.inf).to_numpy(zero_copy_only=False)
            best, at = np.maximum(log.max(axis=1), beside), log.argmax(axis=1)
            mass = np.exp(log - best[:, None]).sum(axis=1) + np.exp(beside - best)
            some = letters.to_numpy() > 0
            posterior = np.where(some, 1 / mass, 0.0)
            owns = own.to_pylist()
            lang = [(o if o and b == top else langs[k]) if s else UNKNOWN for o, b, top, k, s in zip(owns, beside, best, at, some)]
            text = [langs[k] if k is not None else o for k, o in zip(text_lang.to_pylist(), owns)]
            yield pa.RecordBatch.from_arrays(
                [ident, mark, pa.array(lang, pa.string()), pa.array(posterior), pa.array(text, pa.string()), tag, letters, pa.array(posterior >= min_posterior)], names=schema.names)

    return joined.mapInArrow(kernel, schema)


def drop_unidentified(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` whose language is identified, all columns unchanged.

    Where no declaration names a language at all, nothing can be identified: then every row with a letter stays.
    The rejected rows, few and narrow, are matched by id and text; of rows that repeat both all go if one is rejected.
    """
    none, ident, mark = fresh(df, "llm_none", "llm_id", "llm_mark")
    gone = identify(df, id_col, text_col, **options).where(~F.col("kept") & ((F.col("lang") != UNKNOWN) | (F.col("letters") == 0)))
    gone = store(gone.select(F.col("id").isNull().alias(none), F.coalesce(F.col("id").cast("string"), F.lit("")).alias(ident), F.col("mark").alias(mark)).distinct(), "langid-rejected")
    keyed = df.withColumns({none: column(df, id_col).isNull(), ident: F.coalesce(column(df, id_col).cast("string"), F.lit("")), mark: F.xxhash64(column(df, text_col))})
    return keyed.join(gone, [none, ident, mark], "left_anti").select(*["`" + c.replace("`", "``") + "`" for c in df.columns])
