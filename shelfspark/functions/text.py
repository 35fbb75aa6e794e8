"""Column expressions for product text: names, types, ratings, prices, truncation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squeeze(c) -> Column:
    """Collapse whitespace runs to one space and trim the ends."""
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def blank_to_null(c) -> Column:
    return F.nullif(col(c), F.lit(""))


def normalize_name(c) -> Column:
    """Lower-case name without size suffix, colours, gender prefix, modifiers."""
    x = F.lower(F.coalesce(col(c), F.lit("")))
    x = F.regexp_replace(x, r"(?iu)\s*[-–]\s*" + fixed.SIZE_WORDS + r"\s*$", "")
    x = F.regexp_replace(x, r"(?iu)\s*\(\s*" + fixed.SIZE_WORDS + r"\s*\)\s*$", "")
    x = F.regexp_replace(x, r"(?iu)\b(" + "|".join(fixed.COLOR_WORDS) + r")\b", "")
    x = F.regexp_replace(x, "(?iu)" + fixed.GENDER_PREFIX, "")
    x = F.regexp_replace(x, r"(?iu)\b(" + "|".join(fixed.MODIFIER_WORDS) + r")\b", "")
    return squeeze(x)


def product_type(c) -> Column:
    """First type word (in list order) contained in the lower-cased name, else ''."""
    low = F.lower(F.coalesce(col(c), F.lit("")))
    return F.coalesce(*[F.when(low.contains(t), F.lit(t)) for t in fixed.PRODUCT_TYPES], F.lit(""))


def smooth_rating(rating, num_reviews, prior=fixed.RATING_PRIOR, confidence=fixed.RATING_CONFIDENCE,
                  min_reviews=fixed.MIN_REVIEWS_FOR_TRUST) -> Column:
    """Empirical-Bayes shrink of high ratings with few reviews (never below the prior)."""
    r, n = col(rating).cast("double"), col(num_reviews)
    shrunk = (F.lit(float(confidence * prior)) + n * r) / (F.lit(confidence) + n)
    return (
        F.when(r.isNull(), F.lit(float(prior)))
        .when(n.isNull() | (n < min_reviews), F.lit(float(prior)))
        .when(r <= prior, r)
        .otherwise(F.greatest(shrunk, F.lit(float(prior))))
    )


def price_number(c) -> Column:
    """Numeric price from free text ('$1,299.00 CAD' -> 1299.0); unparsable -> NULL."""
    digits = F.nullif(F.regexp_replace(col(c), r"[^0-9.]", ""), F.lit(""))
    return digits.try_cast("double")


def truncate(c, n: int, ellipsis: bool = False) -> Column:
    """First ``n`` characters, optionally with '...' when cut."""
    x = col(c)
    if not ellipsis:
        return F.left(x, F.lit(n))
    return F.when(F.length(x) > n, F.concat(F.left(x, F.lit(n)), F.lit("..."))).otherwise(x)


def python_title(c) -> Column:
    """``str.title()``: upper-case a letter after a non-letter, lower-case the rest."""
    chars = F.split(F.coalesce(col(c), F.lit("")), "")
    return F.array_join(
        F.transform(
            chars,
            lambda ch, i: F.when(
                (i == 0) | (F.lower(F.element_at(chars, i)) == F.upper(F.element_at(chars, i))),
                # title case of the sharp s is "Ss" (upper case alone differs between engines)
                F.when(ch == "ß", F.lit("Ss")).otherwise(F.upper(ch)),
            ).otherwise(F.lower(ch)),
        ),
        "",
    )


def brand_display(brand, source_site) -> Column:
    """Brand, else mapped / title-cased site, else 'Unknown Brand'."""
    site = col(source_site)
    mapped = F.coalesce(*[F.when(site == k, F.lit(v)) for k, v in fixed.SITE_TO_BRAND.items()])
    derived = python_title(F.replace(F.replace(F.replace(site, F.lit("www."), F.lit("")), F.lit(".com"), F.lit("")),
                                     F.lit(".ca"), F.lit("")))
    return (
        F.when(F.coalesce(col(brand), F.lit("")) != "", col(brand))
        .when(F.coalesce(site, F.lit("")) != "", F.coalesce(mapped, derived))
        .otherwise(F.lit("Unknown Brand"))
    )


def owned_flag(c) -> Column:
    """yes/true/✓/✔ -> true, no/false/✗/✘ -> false, anything else -> NULL."""
    low = F.lower(F.trim(col(c)))
    return F.when(low.isin("yes", "true", "✓", "✔"), F.lit(True)).when(
        low.isin("no", "false", "✗", "✘"), F.lit(False))


def product_embedding_text(name, description, url) -> Column:
    """B31 (products): 'Product: n | Description: d', or the url when both are empty."""
    parts = F.concat_ws(
        " | ",
        F.when(F.coalesce(col(name), F.lit("")) != "", F.concat(F.lit("Product: "), col(name))),
        F.when(F.coalesce(col(description), F.lit("")) != "", F.concat(F.lit("Description: "), col(description))),
    )
    return F.when(parts != "", parts).otherwise(col(url))


def listing_embedding_text(name, products, description, manufactured_in, url) -> Column:
    """B31 (listings): company, products, description (first 500), manufactured in."""
    def part(label, c, n=None):
        v = col(c)
        return F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(label), F.left(v, F.lit(n)) if n else v))
    parts = F.concat_ws(" | ", part("Company: ", name), part("Products: ", products),
                        part("Description: ", description, 500), part("Manufactured in: ", manufactured_in))
    return F.when(parts != "", parts).otherwise(col(url))


def slug(c, max_len: int = 30) -> Column:
    """Lower-case, non-alphanumerics to '_', trimmed of '_', first ``max_len`` chars."""
    s = F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "_")
    s = F.regexp_replace(s, "^_+|_+$", "")
    return F.left(s, F.lit(max_len))


def filled(wording: str, *values) -> Column:
    """``wording`` with each ``{}`` replaced by the next value, as a column."""
    parts = wording.split("{}")
    out = [F.lit(parts[0])]
    for v, part in zip(values, parts[1:]):
        out += [col(v).cast("string"), F.lit(part)]
    return F.concat(*out)
