"""Catalogue tables: typed scans, validity, filters, schema evolution, keyed upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as TX

# Domain schemas --------------------------------------------------------
PRODUCTS = T.StructType([
    T.StructField("url", T.StringType(), False),
    T.StructField("name", T.StringType()),
    T.StructField("brand", T.StringType()),
    T.StructField("sku", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("price", T.StringType()),
    T.StructField("currency", T.StringType()),
    T.StructField("availability", T.StringType()),
    T.StructField("images", T.ArrayType(T.StringType())),
    T.StructField("html", T.StringType()),
    T.StructField("markdown", T.StringType()),
    T.StructField("json_data", T.StringType()),
    T.StructField("num_reviews", T.IntegerType()),
    T.StructField("average_rating", T.DoubleType()),
    T.StructField("made_in_canada", T.BooleanType()),
    T.StructField("made_in_canada_reason", T.StringType()),
    T.StructField("source_site", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("scraped_at", T.TimestampNTZType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("updated_at", T.TimestampNTZType()),
])

LISTINGS = T.StructType([
    T.StructField("url", T.StringType(), False),
    T.StructField("name", T.StringType()),
    T.StructField("products", T.StringType()),
    T.StructField("manufactured_in", T.StringType()),
    T.StructField("where_to_buy", T.StringType()),
    T.StructField("website", T.StringType()),
    T.StructField("canadian_owned", T.BooleanType()),
    T.StructField("canadian_owned_text", T.StringType()),
    T.StructField("canadian_owned_reason", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("subcategory", T.StringType()),
    T.StructField("made_in_canada", T.BooleanType()),
    T.StructField("made_in_canada_reason", T.StringType()),
    T.StructField("is_shopify_store", T.BooleanType()),
    T.StructField("shopify_meta", T.StringType()),
    T.StructField("shopify_reason", T.StringType()),
    T.StructField("raw_text", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("scraped_at", T.TimestampNTZType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("updated_at", T.TimestampNTZType()),
])


def conform(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """Add the missing columns of ``schema`` (NULL or a default), cast the present ones,
    keep extra columns at the end."""
    defaults = defaults or {}
    have = set(df.columns)
    cols = []
    for f in schema.fields:
        if f.name in have:
            c = F.col(f.name).cast(f.dataType)
            if f.name in defaults:
                c = F.coalesce(c, F.lit(defaults[f.name]).cast(f.dataType))
        else:
            c = F.lit(defaults.get(f.name)).cast(f.dataType)
        cols.append(c.alias(f.name))
    extra = [c for c in df.columns if c not in {f.name for f in schema.fields}]
    return df.select(*cols, *extra)


def typed_products(df: DataFrame) -> DataFrame:
    return conform(df, PRODUCTS)


def read_catalog(spark, path: str, kind: str = "products") -> DataFrame:
    """Typed scan of a products / listings parquet folder."""
    schema = PRODUCTS if kind == "products" else LISTINGS
    return spark.read.schema(schema).parquet(path)


def dump_urls(df: DataFrame) -> DataFrame:
    """Sorted distinct URLs."""
    return df.select("url").distinct().orderBy("url")


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """A10: first ``n`` rows by url plus how many remain (one aggregate, one top-n)."""
    total = df.agg(F.count(F.lit(1))).scalar()  # scalar subquery, evaluated once
    head = df.select("name", "url").orderBy("url").limit(n)
    return head.select("name", "url", (total - n).alias("remaining"))


def source_count(df: DataFrame, source_site: str | None = None, by_site: bool = False) -> DataFrame:
    """Row count, optionally for one source site or per site."""
    if by_site:
        return df.groupBy("source_site").agg(F.count(F.lit(1)).alias("n"))
    if source_site is not None:
        df = df.where(F.col("source_site") == source_site)
    return df.agg(F.count(F.lit(1)).alias("n"))


def valid_only(df: DataFrame):
    """Rows with a non-empty name sorted by url, and (valid, skipped) counts."""
    ok = F.coalesce(F.col("name"), F.lit("")) != ""
    counts = df.agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("skipped"))
    return df.where(ok).orderBy("url"), counts


def price_filter(df: DataFrame, min_price=None, max_price=None) -> DataFrame:
    """Keep rows whose numeric price is within the set bounds (NULL price drops out)."""
    out = df.withColumn("price_num", TX.price_number("price"))
    if min_price is not None:
        out = out.where(F.col("price_num") >= F.lit(float(min_price)))
    if max_price is not None:
        out = out.where(F.col("price_num") <= F.lit(float(max_price)))
    return out


def rating_filter(df: DataFrame, min_rating=None) -> DataFrame:
    """C04."""
    return df if min_rating is None else df.where(F.col("average_rating") >= F.lit(float(min_rating)))


def brand_filter(df: DataFrame, brand=None) -> DataFrame:
    """Case-insensitive substring match (ILIKE '%b%')."""
    if not brand:
        return df
    return df.where(F.lower(F.col("brand")).contains(brand.lower()))


def origin_filter(df: DataFrame, wanted: bool = False) -> DataFrame:
    """Only rows whose origin flag is true (NULL excluded) when wanted."""
    return df.where(F.col("made_in_canada") == F.lit(True)) if wanted else df


# A07 / A08 -------------------------------------------------------------------
def upsert_by_key(old: DataFrame, new: DataFrame, key: str = "url", seq: str | list[str] | None = None,
                  preserve: list[str] | None = None, now: str | None = None) -> DataFrame:
    """Whole-row upsert: the latest row per key wins whole (NULLs overwrite), ``created_at``
    keeps the first value, ``preserve`` columns keep the value first stored for the key — a stored
    NULL too — and rows written by this batch get ``scraped_at`` / ``updated_at`` = ``now``.

    Rows of a key are ordered by (batch, ``seq`` columns) and, where these tie, by the row itself.
    One ``groupBy(key)`` with the largest and the smallest row: partial aggregation runs before
    the shuffle, so a key repeated in many input rows is combined map-side.
    """
    seqs = [seq] if isinstance(seq, str) else list(seq or [])
    cols = [c for c in old.columns if c != key]
    kept = [c for c in (preserve or []) if c in cols]
    row = F.struct(*cols).alias("_row")
    o = old.select(key, F.lit(0).alias("_batch"), *[F.lit(0).cast("long").alias(f"_seq{i}") for i in range(len(seqs))], row)
    have = [F.col(c) if c in new.columns else F.lit(None).cast(old.schema[c].dataType) for c in cols]
    n = new.select(key, F.lit(1).alias("_batch"), *[F.col(s).cast("long").alias(f"_seq{i}") for i, s in enumerate(seqs)],
                   F.struct(*[c.cast(old.schema[x].dataType).alias(x) for c, x in zip(have, cols)]).alias("_row"))
    whole = F.struct("_batch", *[f"_seq{i}" for i in range(len(seqs))], "_row")
    first = F.struct("_batch", *[f"_seq{i}" for i in range(len(seqs))], F.struct(F.lit(0).alias("_"), *[F.col(f"_row.{c}").alias(c) for c in kept]).alias("_row"))
    aggs = [F.max(whole).alias("_last"), F.min(first).alias("_first")]
    if "created_at" in cols:
        aggs.append(F.min("_row.created_at").alias("_created"))
    g = o.unionByName(n).groupBy(key).agg(*aggs)
    touched, added = F.col("_last._batch") == 1, F.col("_first._batch") == 1
    ts = F.lit(now).cast("timestamp_ntz") if now else F.localtimestamp()

    def value(c):
        if c in ("scraped_at", "updated_at"):
            return F.when(touched, ts).otherwise(F.col(f"_last._row.{c}"))
        if c == "created_at":
            return F.coalesce("_created", F.when(added, ts))
        return F.col(f"_first._row.{c}" if c in kept else f"_last._row.{c}")

    return g.select(key, *[value(c).alias(c) for c in cols])


def upsert_quarantine(new: DataFrame, valid: F.Column | None = None, key: str = "url"):
    """Split a batch into rows that can be saved and rejects with a reason; counts."""
    if valid is None:
        valid = F.coalesce(F.col(key), F.lit("")) != ""
    reason = F.when(~F.coalesce(valid, F.lit(False)), F.lit("invalid row"))
    tagged = new.withColumn("_reason", reason)
    good = tagged.where(F.col("_reason").isNull()).drop("_reason")
    rejects = tagged.where(F.col("_reason").isNotNull()).select(key, F.col("_reason").alias("reason"))
    counts = tagged.agg(F.count_if(F.col("_reason").isNull()).alias("saved"),
                        F.count_if(F.col("_reason").isNotNull()).alias("failed"))
    return good, rejects, counts


# D04 / G04 -------------------------------------------------------------------
def secondary_source(df: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """Left join of a keyed side table (service replies re-aimed as tables: enrichment,
    embeddings, rerank scores).  Spark picks the join by the sizes it finds."""
    return df.join(side, key, "left")


def ordered_distinct(df: DataFrame, group: list[str], key: str, order: str) -> DataFrame:
    """First occurrence of each ``key`` within ``group`` (by ``order``); order kept.

    The first row is ``min(struct(order, rest...))`` per (group, key): an aggregate that is
    combined map-side, so a key repeated in a third of the rows does not fill one task."""
    rest = [c for c in df.columns if c not in (*group, key, order)]
    first = df.groupBy(*group, key).agg(F.min(F.struct(order, *rest)).alias("_f"))
    return first.select(*group, key, *[F.col(f"_f.{c}").alias(c) for c in (order, *rest)]).select(*df.columns)
