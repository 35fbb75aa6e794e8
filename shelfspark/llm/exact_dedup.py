"""Exact de-duplication (operator 2): two passes over a Bloom filter single out rows that may repeat.

Pass 1 writes, for each text, its SHA-256 and finds the filter cells that two or more rows touch. Pass 2 tests each row
against these cells: a row with an untouched cell is unique and passes straight through; only the others shuffle, by
their hash, and are grouped exactly. False positives of the filter cost a shuffled row, never a wrong answer.

The filter is an array of 64-bit words with two bits a row in one word (a register-blocked filter). ``filter_words``
fixes its size and so bounds what is broadcast: 16 bytes a word, 32 MB by default, whatever the input. Past some 30
million rows the filter fills up and more rows take the exact shuffle, which is right at any size; give more words then.

Everything is a DataFrame function; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, column, fresh, lower_az, store

FILTER_WORDS = 1 << 21


def _cell(key: Column, words: int) -> tuple[Column, Column, Column]:
    """Word and the two bits of a row's hash."""
    bit = lambda at: F.shiftrightunsigned(key, at).bitwiseAND(F.lit(63)).cast("int")
    return F.pmod(key, F.lit(words)), bit(40), bit(52)


def _key(sha: Column) -> Column:
    return F.xxhash64(sha)


def repeat_filter(hashes: DataFrame, sha: str, words: int = FILTER_WORDS) -> DataFrame:
    """(word, bits): the cells that at least two rows touch; at most ``words`` rows."""
    word, first, second = _cell(_key(F.col(sha)), words)
    cells = hashes.select(word.alias("word"), F.explode(F.array_distinct(F.array(first, second))).alias("bit"))
    twice = cells.groupBy("word", "bit").agg(F.count("*").alias("n")).where("n > 1")
    return twice.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))


def _flagged(df: DataFrame, sha: str, flt: DataFrame, words: int, flag: str, word: str, bits: str) -> DataFrame:
    """``df`` with ``flag``: true where both cells of the row's hash are touched by two or more rows."""
    at, first, second = _cell(_key(F.col(sha)), words)
    side = F.broadcast(flt.select(F.col("word").alias(word), F.col("bits").alias(bits)))
    on = df.withColumn(word, at).join(side, word, "left")
    hit = lambda bit: F.call_function("getbit", F.coalesce(F.col(bits), F.lit(0).cast("long")), bit) == 1
    return on.withColumn(flag, hit(first) & hit(second)).drop(word, bits)


def _groups(candidates: DataFrame) -> DataFrame:
    """Exact groups of the shuffled rows; written, so that the join back can split a hash with very many rows."""
    return store(candidates.groupBy("sha").agg(F.max("id").alias("keep"), F.count("*").alias("size")), "exact-groups")


def _prepare(df: DataFrame, id_col: str, text_col: str, words: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    hashes = store(df.select(column(df, id_col).alias("id"), F.sha2(lower_az(column(df, text_col)), 256).alias("sha")), "exact-hashes")
    flt = store(repeat_filter(hashes, "sha", words), "exact-filter")
    flagged = _flagged(hashes, "sha", flt, words, "again", "word", "bits")
    return flagged, flt, _groups(flagged.where("again"))


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_words: int = FILTER_WORDS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null is the empty text. Of equal texts the row with the
    largest id stays. A null id is below any other; where a group has only null ids, keep_id is null and all of its
    rows say kept. Rows that repeat an id with an equal text carry the same verdict, and group_size counts each of them.
    An empty table gives no rows; other columns of ``df`` are neither read nor returned.
    """
    flagged, _, groups = _prepare(df, id_col, text_col, filter_words)
    alone = flagged.where("not again").select("id", "sha", F.col("id").alias("keep"), F.lit(1).cast("long").alias("size"))
    again = flagged.where("again").select("id", "sha").join(groups, "sha").select("id", "sha", "keep", "size")
    return alone.union(again).select(
        F.col("id").alias("doc_id"), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_words: int = FILTER_WORDS) -> DataFrame:
    """The rows of ``df`` that stay, all columns unchanged: of equal texts one row, that with the largest id.

    Rows with untouched filter cells never shuffle. Of several rows with the same id and an equal text any one stays.
    """
    _, flt, groups = _prepare(df, id_col, text_col, filter_words)
    sha, flag, word, bits, keep = fresh(df, "llm_sha", "llm_again", "llm_word", "llm_bits", "llm_keep")
    rows = df.withColumn(sha, F.sha2(lower_az(column(df, text_col)), 256))
    rows = _flagged(rows, sha, flt, filter_words, flag, word, bits)
    again = rows.where(F.col(flag)).join(groups.select(F.col("sha").alias(sha), F.col("keep").alias(keep)), sha)
    again = again.where(column(again, id_col).eqNullSafe(F.col(keep))).dropDuplicates([sha])
    names = ["`" + c.replace("`", "``") + "`" for c in df.columns]
    return rows.where(~F.col(flag)).select(*names).union(again.select(*names))


ORACLE_SQL = f"""
with t as (select doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')) as text_sha256 from documents),
g as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from t group by text_sha256)
select t.doc_id, g.keep_id, g.group_size, t.doc_id is not distinct from g.keep_id as kept, t.text_sha256
from t join g on t.text_sha256 = g.text_sha256
"""
