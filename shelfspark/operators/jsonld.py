"""JSON-LD product extraction from landed pages (B10-B16) and ratings found in it.

Python parses JSON and walks nested values, in Arrow kernels over the block rows (one block per
row, standard-library ``json``), so Spark still partitions the work.  Everything that reads a found
object — fields, score, images, file names — is a Column expression over its JSON text.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import markup

BLOCK_RE = r"""(?is)<script[^>]*type\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script>"""


def _decoded(*texts):
    """The first of the texts that is JSON, parsed; repeated keys keep their last value."""
    for t in texts:
        try:
            return t, json.loads(t)
        except ValueError:
            continue
    return None, None


def _valid_kernel(batches):
    for b in batches:
        url, pos, raw, salvaged = (b.column(i) for i in range(4))
        found = [_decoded(r, s)[0] for r, s in zip(raw.to_pylist(), salvaged.to_pylist())]
        yield pa.RecordBatch.from_arrays([url, pos, pa.array(found, pa.string())], names=["url", "block_pos", "json"])


def jsonld_blocks(pages: DataFrame) -> DataFrame:
    """``(url, block_pos, json)`` for every decodable JSON-LD block (salvaging trailing commas)."""
    raw = pages.select("url", F.posexplode(F.regexp_extract_all("html", F.lit(BLOCK_RE), F.lit(1))).alias("block_pos", "raw"))
    raw = raw.select("url", (F.col("block_pos") + 1).alias("block_pos"),
                     F.regexp_replace("raw", r"^\s+|\s+$", "").alias("raw")).where(F.col("raw") != "")
    salvaged = F.regexp_replace(F.regexp_replace("raw", r",\s*}", "}"), r",\s*]", "]")
    return raw.select("url", "block_pos", "raw", salvaged.alias("salvaged")).mapInArrow(
        _valid_kernel, "url string, block_pos int, json string").where(F.col("json").isNotNull())


def objects_in_order(value):
    """Every object of a JSON value, outer before inner, in document order, with an explicit stack (any depth)."""
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, dict):
            yield v
            stack.extend(reversed(v.values()))
        elif isinstance(v, list):
            stack.extend(reversed(v))


def _types(obj: dict) -> list[str]:
    t = obj.get("@type") or obj.get("type") or []
    return [str(x).lower() for x in (t if isinstance(t, list) else [t])]


def _rating(obj: dict):
    """The rating that an object is or holds, as an object."""
    if "aggregaterating" in _types(obj)[:1]:
        return obj
    held = obj.get("aggregateRating")
    return held if isinstance(held, dict) else None


def _found_kernel(pick):
    def run(batches):
        for b in batches:
            out = []
            for url, pos, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                hits = filter(None, map(pick, objects_in_order(json.loads(text))))
                out += [(url, pos, i, json.dumps(o, ensure_ascii=False)) for i, o in enumerate(hits, 1)]
            cols = list(zip(*out)) or [[], [], [], []]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["url", "block_pos", "pos", "product"])

    return run


FOUND = "url string, block_pos long, pos long, product string"


def _kind(v: Column, path: str) -> Column:
    """Type name of the value at ``path`` of a variant; NULL when absent."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def product_fields(product: Column) -> dict[str, Column]:
    """Fields and score of a product object given as JSON text."""
    v = F.try_parse_json(product)
    get = lambda path: F.get_json_object(product, path)
    is_text = lambda path: F.coalesce(_kind(v, path) == "STRING", F.lit(False))
    first = F.coalesce(_kind(v, "$.offers"), F.lit("")).startswith("ARRAY")
    offer = lambda k: F.when(first, get(f"$.offers[0].{k}")).otherwise(get(f"$.offers.{k}"))
    images = F.filter(F.try_variant_get(v, "$.image", "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING")
    images = F.transform(images, lambda x: x.cast("string"))
    said = lambda path: F.coalesce(~get(path).isin("", "0", "0.0", "false", "[]", "{}"), F.lit(False)).cast("int")
    return {
        "score": 2 * said("$.name") + 2 * said("$.offers") + said("$.image"),
        "name": get("$.name"), "description": get("$.description"), "sku": get("$.sku"),
        "brand": F.when(is_text("$.brand"), get("$.brand")).otherwise(get("$.brand.name")),
        "images": F.coalesce(F.when(is_text("$.image"), F.array(get("$.image"))), images, F.array().cast("array<string>")),
        "price": offer("price"), "currency": offer("priceCurrency"), "availability": offer("availability"),
    }


def jsonld_products(blocks: DataFrame) -> DataFrame:
    """B11 (+B13 fields): every product object of every block, in document order."""
    found = blocks.select("url", "block_pos", "json").mapInArrow(_found_kernel(lambda o: o if "product" in _types(o) else None), FOUND)
    return found.select("*", *[c.alias(k) for k, c in product_fields(F.col("product")).items()])


def jsonld_aggregate_rating(blocks: DataFrame) -> DataFrame:
    """B17 source: per page the rating and review count of the first aggregate rating, at any depth, of the first block
    where either is a number: ``(url, jr, jc)``."""
    found = blocks.select("url", "block_pos", "json").mapInArrow(_found_kernel(_rating), FOUND).where("pos = 1")
    get = lambda k: F.get_json_object("product", f"$.{k}")
    rating = get("ratingValue").try_cast("double")
    count = F.when(get("reviewCount").isNotNull(), get("reviewCount")).otherwise(get("ratingCount")).try_cast("int")
    found = found.select("url", "block_pos", rating.alias("jr"), count.alias("jc"))
    found = found.where((F.coalesce("jr", F.lit(0.0)) != 0) | (F.coalesce("jc", F.lit(0)) != 0))
    return found.groupBy("url").agg(F.min(F.struct("block_pos", "jr", "jc")).alias("_f")).select("url", "_f.jr", "_f.jc")


def best_schema(products: DataFrame) -> DataFrame:
    """Per page the highest score (name 2, offers 2, image 1); ties keep the first."""
    w = Window.partitionBy("url").orderBy(F.desc("score"), "block_pos", "pos")
    return products.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def image_dedupe(df: DataFrame) -> DataFrame:
    """Order-preserving distinct non-empty images and how many were removed."""
    imgs = F.coalesce(F.col("images"), F.array().cast("array<string>"))
    d = F.array_distinct(F.filter(imgs, lambda x: x.isNotNull() & (x != "")))
    return df.withColumn("images_removed", F.size(imgs) - F.size(d)).withColumn("images", d)


def safe_filename(c) -> Column:
    """File name of at most 180 characters; a longer one ends in a hash of the whole, so that names stay distinct."""
    s = F.regexp_replace(F.regexp_replace(c, fixed.UNSAFE_FILE_CHARS, "_"), "^_+|_+$", "")
    long = F.concat(F.left(s, F.lit(163)), F.lit("_"), F.lower(F.lpad(F.hex(F.xxhash64(c)), 16, "0")))
    return F.when(s == "", F.lit("file")).when(F.length(s) > 180, long).otherwise(s)


def image_manifest(products: DataFrame, cap: int | None = None) -> DataFrame:
    """Images per product (the first ``cap`` where given) -> ``(url, idx, image_url, file_name)``."""
    images = F.coalesce("images", F.array().cast("array<string>"))
    ex = products.select("url", F.posexplode(images if cap is None else F.slice(images, 1, cap)).alias("idx", "image_url"))
    path = F.regexp_extract("image_url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    last = F.regexp_extract(path, r"([^/]*)$", 1)
    ext = F.regexp_extract(last, r"[^.](\.[^.]*)$", 1)
    ext = F.when(ext == "", F.lit(".jpg")).otherwise(ext)
    name = safe_filename(F.concat(F.col("url"), F.lit("_img"), F.col("idx").cast("string"), ext))
    return ex.select("url", "idx", "image_url", name.alias("file_name"))


# B14 ------------------------------------------------------------------------
def _meta(page: Column, prop: str) -> Column:
    """``content`` of the first ``<meta property="prop">``, stripped; NULL when absent or empty."""
    first = F.get(F.filter(page["meta"], lambda m: m["property"] == prop), 0)["content"]
    return F.nullif(F.regexp_replace(first, r"^\s+|\s+$", ""), F.lit(""))


def og_fallback(products: DataFrame, pages: DataFrame) -> DataFrame:
    """Fill name / description from og:title / og:description when missing (empty), and
    images from og:image when there are none; ``(url, ...)`` of ``products`` joined to ``pages``."""
    j = products.join(pages.select("url", "html"), "url", "right")
    page = markup.page(F.col("html"))
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    title, desc, img = (_meta(page, f"og:{x}") for x in ("title", "description", "image"))
    imgs = F.coalesce(F.col("images"), F.array().cast("array<string>"))
    return j.select(
        "url",
        F.when(empty("name") & (F.coalesce(title, F.lit("")) != ""), title).otherwise(F.col("name")).alias("name"),
        F.when(empty("description") & (F.coalesce(desc, F.lit("")) != ""), desc).otherwise(F.col("description")).alias("description"),
        F.when((F.size(imgs) == 0) & (F.coalesce(img, F.lit("")) != ""), F.array(img)).otherwise(imgs).alias("images"),
    )
