"""Post-retrieval ranking: greedy de-dupe (H09, F04), rerank (H13, H14), cards (H15), funnel.

The de-dupe is order dependent (a row is dropped only by an earlier *kept*
row), so it is a fold.  It runs per query over the ranked candidate list,
whose length is a parameter of the funnel, inside one aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as TX
from ..functions import urls as U
from .vector import top_k_per_group

def dedupe_keys(df: DataFrame) -> DataFrame:
    brand_lc = F.lower(F.coalesce(F.col("brand"), F.lit("")))
    ptype = TX.product_type("name")
    return df.select(
        "*",
        F.concat(TX.normalize_name("name"), F.lit("|"), brand_lc).alias("_name_key"),
        U.url_base(F.coalesce(F.col("url"), F.lit(""))).alias("_url_base"),
        F.when(ptype != "", F.concat(brand_lc, F.lit("|"), ptype)).alias("_bt_key"),
    )


def greedy_dedupe(ranked: DataFrame, max_per_brand_type: int = 0, rank_col: str = "rank",
                  group: str = "query_id") -> DataFrame:
    """Keep a row iff no earlier kept row has its name key or url base (and the
    (brand, type) cap is not reached).  Adds ``dedupe_rank`` (1-based, in kept order).

    The fold needs a query's ranked list in order: the list is the funnel's, so its length is the
    candidate parameter, not the data.  Each row travels whole in the list and the kept ones are
    unfolded from it, so nothing is joined back."""
    k = dedupe_keys(ranked)
    rows = F.struct(*[c for c in ranked.columns if c != group])
    items = F.array_sort(F.collect_list(F.struct(
        F.col(rank_col).alias("r"), F.col("_name_key").alias("n"), F.col("_url_base").alias("u"),
        F.col("_bt_key").alias("b"), rows.alias("row"))))
    init = F.struct(F.array().cast("array<string>").alias("names"), F.array().cast("array<string>").alias("urls"),
                    F.array().cast("array<string>").alias("bts"), F.array().cast("array<int>").alias("kept"),
                    F.lit(1).alias("at"))

    def step(acc, x):
        dup = F.array_contains(acc["names"], x["n"]) | F.array_contains(acc["urls"], x["u"])
        if max_per_brand_type > 0:
            capped = x["b"].isNotNull() & (F.size(F.filter(acc["bts"], lambda b: b == x["b"])) >= max_per_brand_type)
            dup = dup | capped
        keep = ~dup
        return F.struct(
            F.when(keep, F.array_append(acc["names"], x["n"])).otherwise(acc["names"]).alias("names"),
            F.when(keep, F.array_append(acc["urls"], x["u"])).otherwise(acc["urls"]).alias("urls"),
            F.when(keep & x["b"].isNotNull(), F.array_append(acc["bts"], x["b"])).otherwise(acc["bts"]).alias("bts"),
            F.when(keep, F.array_append(acc["kept"], acc["at"])).otherwise(acc["kept"]).alias("kept"),
            (acc["at"] + 1).alias("at"),
        )

    g = k.groupBy(group).agg(items.alias("_items"))
    keys = F.transform("_items", lambda x: F.struct(x["n"].alias("n"), x["u"].alias("u"), x["b"].alias("b")))
    g = g.withColumn("_kept", F.aggregate(keys, init, step, lambda a: a["kept"]))
    g = g.select(group, "_items", F.posexplode("_kept").alias("_pos", "_at"))
    g = g.select(group, F.element_at("_items", F.col("_at"))["row"].alias("_row"), (F.col("_pos") + 1).alias("dedupe_rank"))
    return g.select(*[F.col(group) if c == group else F.col(f"_row.{c}").alias(c) for c in ranked.columns], "dedupe_rank")


def cap_per_group(ranked: DataFrame, n: int, rank_col: str = "rank", group: str = "query_id") -> DataFrame:
    """F04 stand-alone: at most ``n`` rows per (brand, product type) in rank order; untyped rows uncapped."""
    brand_lc = F.lower(F.coalesce(F.col("brand"), F.lit("")))
    ptype = TX.product_type("name")
    df = ranked.withColumn("_bt", F.when(ptype != "", F.concat(brand_lc, F.lit("|"), ptype)))
    from pyspark.sql import Window
    w = Window.partitionBy(group, "_bt").orderBy(rank_col)
    return df.withColumn("_i", F.row_number().over(w)).where(F.col("_bt").isNull() | (F.col("_i") <= n)).drop("_bt", "_i")


def rerank_document(df: DataFrame) -> Column:
    """The text a relevance model scores for one candidate."""
    mic, reason = F.col("made_in_canada"), F.col("made_in_canada_reason")
    has_reason = F.coalesce(reason, F.lit("")) != ""
    reason_txt = F.when(has_reason, TX.filled(fixed.RERANK_REASON, reason)).otherwise(F.lit(""))
    origin = (F.when(mic == F.lit(True), F.concat(F.lit(fixed.RERANK_MADE), reason_txt))
              .when(mic == F.lit(False), F.concat(F.lit(fixed.RERANK_NOT_MADE), reason_txt))
              .otherwise(F.lit(fixed.RERANK_MADE_UNKNOWN)))
    n = F.coalesce(F.col("num_reviews"), F.lit(0))
    smoothed = TX.smooth_rating("average_rating", "num_reviews")
    quality = F.when(n == 0, F.lit(fixed.RERANK_NO_REVIEWS)).otherwise(
        TX.filled(fixed.RERANK_REVIEWS, F.format_number(smoothed, 1), n))
    price = F.when(F.coalesce(F.col("price"), F.lit("")) != "",
                   F.concat(F.lit(fixed.RERANK_PRICE), F.col("price"), F.lit(" "), F.coalesce(F.col("currency"), F.lit("")))
                   ).otherwise(F.lit(""))
    desc = F.when(F.coalesce(F.col("description"), F.lit("")) != "",
                  F.concat(F.lit(fixed.RERANK_DESCRIPTION), F.left(F.col("description"), F.lit(fixed.MAX_DESCRIPTION_LENGTH)))
                  ).otherwise(F.lit(""))
    return F.concat(F.lit(fixed.RERANK_NAME), F.coalesce(F.col("name"), F.lit("")), F.lit(fixed.RERANK_BRAND),
                    F.coalesce(F.col("brand"), F.lit("")), price, origin, quality, desc)


def rerank(ranked: DataFrame, scores: DataFrame | None = None, score_col: Column | None = None,
           top_n: int = fixed.RERANK_TOP_N, rank_col: str = "rank", group: str = "query_id") -> DataFrame:
    """Reorder each query's rows by a relevance score (NULL last, then prior rank); keep ``top_n``.

    ``scores`` is a ``(query_id, url, score)`` table from an external scorer;
    without it ``score_col`` (a column of ``ranked``) is the score.
    """
    if scores is not None:
        df = ranked.join(scores.select(group, "url", F.col("score").alias("rerank_score")), [group, "url"], "left")
    else:
        df = ranked.withColumn("rerank_score", score_col if score_col is not None else F.lit(None).cast("double"))
    return top_k_per_group(df, [group], [F.desc_nulls_last("rerank_score"), F.asc(rank_col)], top_n, "rerank_rank")


def clean_display_name(name) -> Column:
    x = F.coalesce(TX.col(name), F.lit("Unknown Product"))
    x = F.regexp_replace(x, "(?iu)" + fixed.CARD_SIZE_TAIL, "")
    x = F.regexp_replace(x, "(?iu)" + fixed.CARD_BIG_SIZE_TAIL, "")
    x = F.regexp_replace(x, "(?iu)" + fixed.CARD_GENDER_TAIL, "")
    return F.regexp_replace(x, "^[ \\-–]+|[ \\-–]+$", "")


def result_cards(ranked: DataFrame, rank_col: str = "rerank_rank", base_url: str = "http://localhost:8000",
                 tracking: bool = True, text_col: str | None = None) -> DataFrame:
    """One display row per result; ``text_col`` names a page text whose beginning the row carries too."""
    mic, reason = F.col("made_in_canada"), F.col("made_in_canada_reason")
    short = F.when(F.length(reason) > 100, F.concat(F.left(reason, F.lit(100)), F.lit("..."))).otherwise(reason)
    origin = (F.when(mic == F.lit(True), F.concat(F.lit("Yes"), F.when(F.coalesce(short, F.lit("")) != "",
                                                                       F.concat(F.lit(" — "), short)).otherwise(F.lit(""))))
              .when(mic == F.lit(False), F.concat(F.lit("No"), F.when(F.coalesce(reason, F.lit("")) != "",
                                                                      F.concat(F.lit(" — "), reason)).otherwise(F.lit(""))))
              .otherwise(F.lit("Unknown")))
    desc = TX.squeeze(F.coalesce(F.col("description"), F.lit("")))
    snippet = F.when(F.length(desc) > 200, F.concat(F.left(desc, F.lit(200)), F.lit("..."))).otherwise(desc)
    has_rating = F.coalesce(F.col("average_rating"), F.lit(0.0)) != 0.0
    has_n = F.coalesce(F.col("num_reviews"), F.lit(0)) != 0
    rating = F.when(has_rating & has_n, F.concat(F.lit("⭐ "), F.format_number(F.col("average_rating").cast("double"), 1),
                                                  F.lit(" ("), F.col("num_reviews").cast("string"), F.lit(" reviews)"))
                    ).otherwise(F.lit(""))
    price = F.when(F.coalesce(F.col("price"), F.lit("")) != "",
                   F.concat(F.lit("$"), F.col("price"), F.lit(" "), F.coalesce(F.col("currency"), F.lit("CAD")))
                   ).otherwise(F.lit("Price N/A"))
    link = U.tracked_url(F.col("url"), base_url=base_url, enabled=tracking, source=F.col("source_site"),
                         source_type="product", product_name=F.col("name"))
    image = (F.get_json_object(F.col("images_json"), "$[0]") if "images_json" in ranked.columns
             else F.try_element_at(F.col("images"), F.lit(1)) if "images" in ranked.columns
             else F.lit(None).cast("string"))
    extra = []
    if text_col is not None:
        whole, cut = F.col(text_col), F.left(F.col(text_col), F.lit(fixed.MAX_PAGE_TEXT_LENGTH))
        extra = [F.when(F.length(whole) > fixed.MAX_PAGE_TEXT_LENGTH, F.concat(cut, F.lit("..."))).otherwise(whole).alias("page_text")]
    return ranked.select(
        "query_id", F.col(rank_col).alias("ordinal"), "url",
        clean_display_name("name").alias("title"), image.alias("image"),
        TX.brand_display("brand", "source_site").alias("brand_display"),
        price.alias("price_text"), rating.alias("rating_text"), origin.alias("origin_text"),
        snippet.alias("snippet"), link.alias("link"), *extra,
    )


def funnel(scored: DataFrame, deduped: DataFrame, reranked: DataFrame, limit: int = fixed.INITIAL_SEARCH_LIMIT) -> DataFrame:
    """Rows per query at each stage (sql -> de-duped -> limited -> re-ranked)."""
    a = scored.groupBy("query_id").agg(F.count(F.lit(1)).alias("sql"))
    b = deduped.groupBy("query_id").agg(F.count(F.lit(1)).alias("deduped"),
                                         F.count_if(F.col("dedupe_rank") <= limit).alias("limited"))
    c = reranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("reranked"))
    j = a.join(b, "query_id", "left").join(c, "query_id", "left")
    stack = F.expr("stack(4, 'sql', sql, 'deduped', deduped, 'limited', limited, 'reranked', reranked) as (stage, n)")
    return j.select("query_id", stack).select("query_id", "stage", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
