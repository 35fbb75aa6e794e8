"""Personal data (operator 10): weak supervision over span candidates.

One pass over the texts finds candidates of four kinds in linear time: the base spans, whose rules are exact, and looser
ones. Five labelers vote on each candidate (strict rule, check sum or range, gazetteer, context words, shape). The counts
of the vote patterns over all documents, a table of bounded size, go through expectation-maximisation, which estimates how
reliable each labeler is; its posteriors train a logistic span classifier, which decides on the looser candidates. Base
spans always stay.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, store

KINDS = ("email", "ip", "card", "phone")
LABELERS = 5
SIZES = 6  # length buckets of the classifier
THRESHOLD = 0.9

# Fixed values of the gazetteer and context labelers.
TOP_DOMAINS = frozenset("com org net edu gov int mil info biz io de fr es it uk eu nl at ch us ca au jp cn in br ru pl se".split())
CUES = {
    "email": ("mail", "email", "e-mail", "contact", "write to", "reach"),
    "ip": ("ip", "host", "hosts", "server", "servers", "address"),
    "card": ("card", "cards", "visa", "mastercard", "amex", "credit", "payment"),
    "phone": ("phone", "telephone", "call", "tel", "mobile", "fax", "cell"),
}
COUNTER_CUES = ("version", "isbn", "page", "token", "order", "serial", "id", "section", "v")
COUNTER_SIGNS = "=#$"
# cues are whole words
CUE = {k: re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, words)) + r")(?!\w)") for k, words in CUES.items()}
COUNTER_CUE = re.compile(r"(?:(?<!\w)(?:" + "|".join(COUNTER_CUES) + r")[.:]?|[" + COUNTER_SIGNS + r"])\s*\Z")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
PLUS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOOSE_NUMBER = re.compile(r"(?<![0-9A-Za-z_.+-])\(?[0-9](?:[ .()-]{0,2}+[0-9])++")
LOOSE_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]++)( ?[(\[]at[)\]] ?| at )([A-Za-z0-9-]++(?:(?:\.| ?[(\[]dot[)\]] ?| dot )[A-Za-z0-9-]++)++)")
DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@domain.part: looks at each @ once, back over the run before it and on over the domain."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            free = found.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))
    return out


def _ips(text: str) -> list[tuple[int, int]]:
    """Four numbers in a row of dotted numbers, then the next four."""
    out = []
    for m in DOTTED.finditer(text):
        parts = m.group().split(".")
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k: k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in four):
                out.append((at, end))
            at = end + 1
    return out


def _cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in DIGITS.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def _phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PLUS.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the base rules, by kind, then start."""
    out = []
    if "@" in text:
        out += [(0, a, b) for a, b in _emails(text)]
    if DIGIT.search(text):
        out += [(1, a, b) for a, b in _ips(text)] + [(2, a, b) for a, b in _cards(text)]
        if "+" in text:
            out += [(3, a, b) for a, b in _phones(text)]
    return out


def _loose(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates beyond the base rules, none of which overlaps a base span or an earlier candidate."""
    found = []
    if " at " in text or "at)" in text or "at]" in text:
        found += [(0, *m.span()) for m in LOOSE_EMAIL.finditer(text)]
    if DIGIT.search(text):
        for m in LOOSE_NUMBER.finditer(text):
            if text[m.end(): m.end() + 1].isalnum() or text[m.end(): m.end() + 1] == "_":
                continue
            n = sum(c.isdigit() for c in m.group())
            kind = 1 if m.group().count(".") == 3 and n <= 12 and " " not in m.group() else 2 if 13 <= n <= 19 else 3 if 7 <= n <= 12 else None
            if kind is not None:
                found.append((kind, *m.span()))
    out, busy = [], sorted((a, b) for _, a, b in taken)
    k, last = 0, 0
    for kind, a, b in sorted(found, key=lambda s: (s[1], s[2])):
        while k < len(busy) and busy[k][1] <= a:
            k += 1
        if a >= last and not (k < len(busy) and busy[k][0] < b):
            out.append((kind, a, b))
            last = b
    return out


def votes(text: str, kind: int, start: int, end: int, strict: bool) -> tuple[int, ...]:
    """Votes of the labelers on one candidate: 1 for, -1 against, 0 none."""
    span, name = text[start:end], KINDS[kind]
    digits = "".join(c for c in span if c.isdigit())
    before = text[max(0, start - 24): start].lower()
    rule = 1 if strict else -1
    if name == "email":
        parts = re.split(r"\.| ?[(\[]dot[)\]] ?| dot ", re.split(r"@| ?[(\[]at[)\]] ?| at ", span)[-1])
        check = 1 if len(parts) > 1 and all(parts) and parts[-1].isalpha() and len(parts[-1]) >= 2 else -1
        listed = 1 if parts[-1].lower() in TOP_DOMAINS else -1
        shape = 1 if " " not in span else 0 if "(" in span or "[" in span else -1
    elif name == "ip":
        parts = [int(p[:4]) for p in re.split(r"[^0-9]+", span) if p]
        check = 1 if len(parts) == 4 and max(parts) <= 255 else -1
        listed = 1 if parts and 0 < parts[0] < 224 else -1
        shape = 1 if span.count(".") == 3 else -1
    elif name == "card":
        check = 1 if luhn(digits) else -1
        listed = 1 if digits[:1] in "3456" else -1
        groups = [len(g) for g in re.split("[ -]", span)]
        shape = 1 if groups == [4, 4, 4, 4] else 0 if groups == [len(digits)] else -1
    else:
        check = 1 if 8 <= len(digits) <= 15 else -1
        listed = 1 if span.startswith("+") and digits[:1] != "0" else 1 if re.fullmatch(r"\(?[0-9]{3}\)?[ -][0-9]{3}-[0-9]{4}", span) else -1
        shape = 1 if span[-5:-4] in "- ." and span[-5:-4] else 0
    context = 1 if CUE[name].search(before) else -1 if COUNTER_CUE.search(before) else 0
    return rule, check, listed, context, shape


def code(kind: int, vote: tuple[int, ...], length: int) -> int:
    """Number of a candidate's pattern: kind, votes and length bucket; below 4 * 3**5 * 6."""
    out = kind
    for v in vote:
        out = out * 3 + v + 1
    return out * SIZES + min(SIZES - 1, length // 5)


def decode(number: int) -> tuple[int, tuple[int, ...], int]:
    number, size = divmod(number, SIZES)
    vote = []
    for _ in range(LABELERS):
        number, v = divmod(number, 3)
        vote.append(v - 1)
    return number, tuple(reversed(vote)), size


def spans_of(text: str) -> list[tuple[int, int, int, bool, int]]:
    """(kind, start, end, base, pattern code) of every candidate, by kind, then start."""
    base = base_spans(text)
    all_spans = [(*s, True) for s in base] + [(*s, False) for s in _loose(text, base)]
    return sorted((k, a, b, strict, code(k, votes(text, k, a, b, strict), b - a)) for k, a, b, strict in all_spans)


SPAN_TYPE = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("code", pa.int32())]))
SPAN_DDL = "array<struct<kind:int,start:bigint,end:bigint,base:boolean,code:int>>"


def candidate_spans(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, spans) for every row: all candidates with their pattern codes."""
    rows = df.select(column(df, id_col).alias("id"), column(df, text_col).cast("string").alias("text"))
    keys = ("kind", "start", "end", "base", "code")

    def kernel(batches):
        for batch in batches:
            spans = [[dict(zip(keys, s)) for s in spans_of(t or "")] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, type=SPAN_TYPE)], names=["id", "spans"])

    return rows.mapInArrow(kernel, rows.select("id").withColumn("spans", F.lit(None).cast(SPAN_DDL)).schema)


def reliabilities(patterns: dict[int, int], rounds: int = 60) -> tuple[dict[int, float], np.ndarray]:
    """Expectation-maximisation over counts of patterns: posterior that each pattern is personal data, and the
    probability of each vote given the truth, [kind, truth, labeler, vote]."""
    codes = sorted(patterns)
    weight = np.array([patterns[c] for c in codes], dtype=float)
    parts = [decode(c) for c in codes]
    kind = np.array([p[0] for p in parts])
    vote = np.array([p[1] for p in parts]) + 1
    post = np.clip(0.5 + 0.18 * (vote - 1).sum(axis=1), 0.02, 0.98)
    given = np.zeros((len(KINDS), 2, LABELERS, 3))
    for _ in range(rounds):
        for k in range(len(KINDS)):
            for z in (0, 1):
                mass = weight * (post if z else 1 - post) * (kind == k)
                for j in range(LABELERS):
                    # a labeler is taken to be right more often than not; the prior counts say so
                    prior = np.array([1.0, 4.0, 20.0]) if z else np.array([20.0, 4.0, 1.0])
                    n = np.bincount(vote[:, j], weights=mass, minlength=3) + prior
                    given[k, z, j] = n / n.sum()
        share = np.array([((weight * post)[kind == k].sum() + 1) / (weight[kind == k].sum() + 2) for k in range(len(KINDS))])
        odds = np.log(share / (1 - share))[kind]
        for j in range(LABELERS):
            odds = odds + np.log(given[kind, 1, j, vote[:, j]]) - np.log(given[kind, 0, j, vote[:, j]])
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return dict(zip(codes, post.tolist())), given


def _features(codes: list[int]) -> np.ndarray:
    x = np.zeros((len(codes), 1 + len(KINDS) + 2 * LABELERS + SIZES))
    for i, c in enumerate(codes):
        kind, vote, size = decode(c)
        x[i, 0] = x[i, 1 + kind] = x[i, 1 + len(KINDS) + 2 * LABELERS + size] = 1
        for j, v in enumerate(vote):
            if v:
                x[i, 1 + len(KINDS) + 2 * j + (v > 0)] = 1
    return x


def span_classifier(patterns: dict[int, int], posterior: dict[int, float], rounds: int = 400, rate: float = 0.5, ridge: float = 1e-3) -> dict[int, float]:
    """Logistic regression on the posteriors, weighted by the patterns' (log) counts; probability per pattern."""
    codes = sorted(patterns)
    x, y = _features(codes), np.array([posterior[c] for c in codes])
    weight = np.log1p(np.array([patterns[c] for c in codes], dtype=float))
    weight /= weight.sum()
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ beta))
        beta -= rate * (x.T @ (weight * (p - y)) + ridge * beta) * 8
    return dict(zip(codes, (1 / (1 + np.exp(-x @ beta))).tolist()))


def accepted_patterns(spans: DataFrame, threshold: float = THRESHOLD) -> list[int]:
    """Codes of the patterns that the classifier accepts, from the counts over all documents (a bounded table)."""
    counted = spans.select(F.explode("spans").alias("s")).groupBy(F.col("s.code").alias("code")).agg(F.count("*").alias("n"))
    patterns = {r["code"]: r["n"] for r in counted.collect()}
    if not patterns:
        return []
    posterior, _ = reliabilities(patterns)
    return sorted(c for c, p in span_classifier(patterns, posterior).items() if p >= threshold and posterior[c] >= threshold)


def find_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, spans) for every row: base spans and those that the classifier accepts, by kind, then start.

    Positions are code points, ends exclusive. Null and empty texts have no spans; repeated rows and null ids are rows
    like any other; an empty table gives no rows; other columns are neither read nor returned.
    """
    spans = store(candidate_spans(df, id_col, text_col), "pii-spans")
    good = accepted_patterns(spans, threshold)
    return spans.select("id", F.filter("spans", lambda s: s["base"] | s["code"].isin(good)).alias("spans"))


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with each span replaced by its kind in square brackets; ``length_col``, where ``df`` has it, is the new length.

    Overlapping spans of two kinds are covered together and named by the first. A null text stays null.
    """
    good = frozenset(accepted_patterns(store(candidate_spans(df, id_col, text_col), "pii-spans"), threshold))
    at = df.columns.index(text_col)

    def mask(text):
        if not text:
            return text
        out, end = [], 0
        for kind, a, b, base, pattern in sorted(spans_of(text), key=lambda s: (s[1], s[2])):
            if base or pattern in good:
                if a >= end:
                    out += [text[end:a], f"[{KINDS[kind].upper()}]"]
                end = max(end, b)
        return "".join([*out, text[end:]]) if out else text

    def kernel(batches):
        for batch in batches:
            masked = pa.array([mask(t) for t in batch.column(at).to_pylist()], type=pa.string())
            yield pa.RecordBatch.from_arrays([masked if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    out = df.mapInArrow(kernel, df.schema)
    if length_col in df.columns:
        kind = df.schema[length_col].dataType
        out = out.withColumn(length_col, F.when(column(out, text_col).isNull(), column(out, length_col)).otherwise(F.char_length(column(out, text_col))).cast(kind))
    return out


def span_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row."""
    found = find_spans(df, id_col, text_col)
    names = F.array(*[F.lit(k) for k in KINDS])
    said = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat(F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"], F.lit(":"), s["end"])))
    base = F.filter("spans", lambda s: s["base"])
    kind = lambda k: F.filter("spans", lambda s: s["base"] & (s["kind"] == k))
    counts = [F.size(kind(k)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
