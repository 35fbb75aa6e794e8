"""Hybrid product search over a batch of queries (H07, H08 and their pieces).

Stages per query (all queries of a batch in one plan):
  parse (I01-I07) -> vector top-k  ∪  text top-k  (filters applied before k)
  -> url base (H06) -> merge per base (E12) -> min-max per query (F01)
  -> blended score -> top-k (G01) -> greedy de-dupe (H09) -> rerank (H14)

The two top-k branches shrink each query to at most 2k candidates; the
display columns are fetched by joining that bounded set back to products.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import fixed
from ..functions import queryparse as QP
from ..functions import text as TX
from ..functions import urls as U
from ..sources import io as IO
from . import fulltext as FT
from .vector import q6, top_k_per_group, vector_topk

DISPLAY = ["name", "brand", "description", "price", "currency", "url", "source_site", "num_reviews",
           "average_rating", "images", "made_in_canada", "made_in_canada_reason"]
FILTER_COLS = ["price_num", "average_rating", "brand_lc", "made_in_canada"]


def prepare_products(products: DataFrame) -> DataFrame:
    p = products
    if "images" not in p.columns:
        p = p.withColumn("images", F.lit(None).cast("array<string>"))
    if "id" not in p.columns:
        p = p.withColumn("id", F.xxhash64("url"))
    return p.withColumn("price_num", TX.price_number("price")).withColumn("brand_lc", F.lower("brand"))


def prepare_queries(queries: DataFrame) -> DataFrame:
    """Parsed batch: query_id, query_vector, intent, filter parameters (``q_`` prefixed)."""
    cols = QP.parse_columns(F.col("text"))
    return queries.select(
        "query_id", "query_vector",
        cols["intent"].alias("intent"),
        cols["min_price"].alias("q_min_price"), cols["max_price"].alias("q_max_price"),
        cols["min_rating"].alias("q_min_rating"), F.lower(cols["brand"]).alias("q_brand"),
        cols["wants_origin"].alias("q_origin"),
    )


def filter_pred(use_parsed: bool = True, origin_only: Column | None = None) -> Column:
    """Per (product, query) predicate; NULL product values fail a set filter."""
    origin_wanted = F.col("q_origin") if origin_only is None else origin_only
    pred = ~origin_wanted | (F.col("made_in_canada") == F.lit(True))
    if use_parsed:
        pred = (pred
                & (F.col("q_min_price").isNull() | (F.col("price_num") >= F.col("q_min_price")))
                & (F.col("q_max_price").isNull() | (F.col("price_num") <= F.col("q_max_price")))
                & (F.col("q_min_rating").isNull() | (F.col("average_rating") >= F.col("q_min_rating")))
                & (F.col("q_brand").isNull() | F.col("brand_lc").contains(F.col("q_brand"))))
    return F.coalesce(pred, F.lit(False))


def search_text(p: DataFrame) -> Column:
    return F.concat_ws(" ", F.coalesce(p["name"], F.lit("")), F.coalesce(p["brand"], F.lit("")),
                       F.coalesce(p["description"], F.lit("")))


def search_index(products: DataFrame, mode: str = "simple", block_docs: int = FT.BLOCK_DOCS, stems: DataFrame | None = None,
                 packed: bool = False) -> FT.TextIndex:
    """Inverted index of the searchable text with the filter attributes the text branch needs (``packed``: for storing)."""
    p = prepare_products(products)
    return FT.build_index(p, ["url", *FILTER_COLS], search_text(p), mode, block_docs, stems, packed)


def _terms(pq: DataFrame, mode: str, stems: DataFrame | None = None) -> DataFrame:
    return FT.query_terms(pq, F.col("intent"), mode, [c for c in pq.columns if c.startswith("q_")], stems)


def text_occurrences(p: DataFrame, pq: DataFrame, pred: Column, mode: str = "simple", index: FT.TextIndex | None = None, stems: DataFrame | None = None) -> DataFrame:
    """The documents that hold a term of a query and pass its filters: ``(query_id, id, term_idx, n_terms, pos)``,
    one row per term with its positions.  ``index`` is a stored ``search_index``; without it the documents are analysed here."""
    terms = IO.keep(_terms(pq, mode, stems), "query-terms")  # Spark plans by their true size
    return FT.term_matches(search_index(p, mode, stems=stems) if index is None else index, terms, pred, [])


def text_match(p: DataFrame, pq: DataFrame, pred: Column, mode: str = "simple", index: FT.TextIndex | None = None, stems: DataFrame | None = None) -> DataFrame:
    """``(query_id, id)`` of the documents that hold every intent term and pass the filters."""
    index, terms = search_index(p, mode, stems=stems) if index is None else index, IO.keep(_terms(pq, mode, stems), "query-terms")
    visits = IO.keep(FT.block_visits(index, terms), "block-visits")
    return FT.block_matches(index, terms, visits, pred, []).select("query_id", "id")


def text_topk(p: DataFrame, pq: DataFrame, k: int | None, pred: Column, mode: str = "simple",
              index: FT.TextIndex | None = None, stems: DataFrame | None = None) -> DataFrame:
    """Text branch: documents matching every intent term and the filters, with their rank; top k per query, or all
    (``k`` None)."""
    index = search_index(p, mode, stems=stems) if index is None else index
    return FT.search_index_topk(index, _terms(pq, mode, stems), k, pred, ["url"], [F.desc("text_rank"), F.asc("url")])


def candidates(products: DataFrame, queries: DataFrame, k: int = fixed.SQL_CANDIDATES, use_parsed: bool = True,
               origin_only: bool | None = None, mode: str = "english", index: FT.TextIndex | None = None, stems: DataFrame | None = None) -> DataFrame:
    """Vector ∪ text candidates with display columns (duplicates kept)."""
    p = prepare_products(products)
    # the parsed batch is read by both branches: written once, so the regex parse runs and plans once and Spark
    # plans the joins with its true size
    pq = IO.keep(prepare_queries(queries), "parsed-queries")
    pred = filter_pred(use_parsed, None if origin_only is None else F.lit(bool(origin_only)))
    vec = vector_topk(p, pq, k, use_parsed, origin_only)
    txt = text_topk(p, pq, k, pred, mode, index, stems)
    cand = vec.select("query_id", "id", "vector_similarity", F.lit(0.0).alias("text_rank"),
                      F.lit("vector").alias("branch")).unionByName(
        txt.select("query_id", "id", F.lit(None).cast("double").alias("vector_similarity"), "text_rank",
                   F.lit("text").alias("branch")))
    # at most 2k rows per query, written first: Spark then joins by their true size, and where they are few enough to
    # broadcast, the stored catalogue's folder key prunes its scan instead of the catalogue being shuffled
    cand = IO.keep(cand, "candidates")
    keys = ["id"]
    if "id_bucket" in p.columns:
        from ..sources.adapters import id_bucket

        cand = cand.withColumn("id_bucket", id_bucket("id"))
        keys = ["id_bucket", "id"]
    return p.select(*keys, *DISPLAY).join(cand, keys).drop("id_bucket")


def merge_candidates(cand: DataFrame, key: str = "url_base") -> DataFrame:
    """One row per (query, key); every column maximised independently."""
    c = cand.withColumn("url_base", U.url_base("url")) if key == "url_base" else cand
    aggs = [F.max(x).alias(x) for x in ["url", "name", "brand", "description", "price", "currency", "source_site",
                                         "made_in_canada_reason"] if x != key]
    return c.groupBy("query_id", key).agg(
        *aggs,
        F.max(F.coalesce("vector_similarity", F.lit(0.0))).alias("vector_similarity"),
        F.max(F.coalesce("text_rank", F.lit(0.0))).alias("text_rank"),
        F.max("num_reviews").alias("num_reviews"),
        F.max("average_rating").alias("average_rating"),
        F.max(F.to_json("images")).alias("images_json"),
        F.bool_or("made_in_canada").alias("made_in_canada"),
    )


def minmax_norm(df: DataFrame, col: str, out: str, constant: float) -> DataFrame:
    """(x - min) / (max - min) within each query; ``constant`` when all equal."""
    w = Window.partitionBy("query_id")
    lo, hi = F.min(col).over(w), F.max(col).over(w)
    return df.withColumn(out, F.when(hi > lo, (F.col(col) - lo) / (hi - lo)).otherwise(F.lit(constant)))


def hybrid_score(alpha: float = fixed.ALPHA, origin_boost: float = fixed.ORIGIN_BOOST_MAIN,
                 min_reviews: int = fixed.MIN_REVIEWS_FOR_TRUST) -> Column:
    base = 0.6 * (alpha * F.col("vector_similarity_norm") + (1 - alpha) * F.col("text_rank_norm"))
    origin = F.when(F.col("made_in_canada") == F.lit(True), F.lit(origin_boost)).otherwise(F.lit(0.0))
    rating = F.when(F.col("num_reviews").isNull() | (F.col("num_reviews") < min_reviews), F.lit(0.0)).otherwise(
        (F.coalesce(F.col("average_rating").cast("double"), F.lit(4.0)) - 4.0) * 0.2)
    return base + origin + rating


def hybrid_search(products: DataFrame, queries: DataFrame, k: int = fixed.SQL_CANDIDATES,
                  final_k: int = fixed.SQL_CANDIDATES, alpha: float = fixed.ALPHA,
                  origin_boost: float = fixed.ORIGIN_BOOST_MAIN, min_reviews: int = fixed.MIN_REVIEWS_FOR_TRUST,
                  mode: str = "english", index: FT.TextIndex | None = None, stems: DataFrame | None = None) -> DataFrame:
    """Ranked candidates per query with ``hybrid_score`` (before de-dupe and rerank)."""
    merged = merge_candidates(candidates(products, queries, k, mode=mode, index=index, stems=stems))
    scored = minmax_norm(merged, "vector_similarity", "vector_similarity_norm", 1.0)
    scored = minmax_norm(scored, "text_rank", "text_rank_norm", 0.0)
    scored = scored.withColumn("hybrid_score", q6(hybrid_score(alpha, origin_boost, min_reviews)))
    return top_k_per_group(scored, ["query_id"], [F.desc("hybrid_score"), F.asc("url")], final_k)


def hybrid_search_basic(products: DataFrame, queries: DataFrame, k: int = fixed.INITIAL_SEARCH_LIMIT,
                        limit: int = 25, origin_boost: float = fixed.ORIGIN_BOOST_API,
                        origin_only: bool = False, mode: str = "english", index: FT.TextIndex | None = None, stems: DataFrame | None = None) -> DataFrame:
    """Un-normalised ``0.5 v + 0.5 t + boost`` over candidates merged by exact url.

    Only the request's origin flag filters; parsed price / rating / brand do not.
    """
    cand = candidates(products, queries, k, use_parsed=False, origin_only=origin_only, mode=mode, index=index, stems=stems)
    merged = merge_candidates(cand, key="url")
    score = (0.5 * F.col("vector_similarity") + 0.5 * F.col("text_rank")
             + F.when(F.col("made_in_canada") == F.lit(True), F.lit(origin_boost)).otherwise(F.lit(0.0)))
    merged = merged.withColumn("score", q6(score))
    return top_k_per_group(merged, ["query_id"], [F.desc("score"), F.asc("url")], limit)
