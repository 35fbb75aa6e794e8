import hashlib
import re

import pytest
from helpers import LONG, SF01, odd_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfspark.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(s):
    d = [int(c) for c in s][::-1]
    return sum(x if i % 2 == 0 else (2 * x if 2 * x < 10 else 2 * x - 9) for i, x in enumerate(d)) % 10 == 0


def brute(text):
    digits = lambda s: [c for c in s if c.isdigit()]
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m.group())) <= 15]


CASES = [
    "", "a@b.c", "x..y@a-b.co.uk.", "a@b.com-c@d.org", "a@b.com_foo@x.yy", "@b.c a@@b.c a@b a@b..c", "1.2.3.4.5.6.7.8.9", "256.1.1.1.2.3.4", "0001.2.3.4 1.2.3",
    "4111 1111 1111 1111", "4111-1111 11111111 and 41111111111111112", "+1 (017) 555-7713.", "+12(( ", "+1 2", "++49 30 1234567 +49 30 12345678901234", "é +1 (301) 555-0346 日本 r.23@mail3.example.com",
]


def test_base_spans_equal_the_rules(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").collect()
    for text in CASES + [r.text or "" for r in docs]:
        assert pii.base_spans(text) == brute(text)


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="a@.1-9+ ()%_25", max_size=40))
def test_base_spans_of_random_texts(text):
    assert pii.base_spans(text) == brute(text)


def test_query_columns(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    got = pii.span_digests(docs).collect()
    assert len(got) == len(text)
    for r in got:
        want = brute(text[r.doc_id])
        said = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for k, _, _ in want) for j in range(4)]
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert set(filter(None, said.split(","))) <= set(filter(None, r.spans.split(",")))
        if not any(c.isdigit() or c == "@" for c in text[r.doc_id]):
            assert r.spans == ""


def test_long_texts_take_linear_time():
    import time

    t = time.time()
    for text in ("1" * 300000, "1 " * 200000 + "a", "a" * 300000 + "@", "1." * 200000, "+1" + " " * 300000, LONG, "a@" * 100000, "( 1" * 100000):
        pii.spans_of(text)
    assert time.time() - t < 20


def test_labelers_and_classifier_find_looser_spans(spark):
    rows = [(i, f"call me: {i % 800 + 200}-555-{1000 + i}. mail {chr(97 + i % 26)}b [at] mail.example.com now" if i % 2 else f"+1 ({i % 800 + 200}) 555-{1000 + i} or x{i}@mail.example.com, see page 12345678") for i in range(400)]
    got = pii.span_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in got:
        assert r.n_phone == r.n_email == (r.doc_id + 1) % 2
        assert "page" not in r.spans and sum(s.startswith("phone") for s in r.spans.split(",")) <= 1


def test_redaction_and_odd_rows(spark):
    df = odd_rows(spark)
    assert len(pii.span_digests(df).collect()) == 17
    out = pii.redact(df)
    assert out.columns == df.columns
    assert sorted(str(tuple(r)) for r in out.collect()) == sorted(str(tuple(r)) for r in df.collect())  # nothing to redact
    assert pii.span_digests(df.where("false")).count() == 0 and pii.redact(df.where("false")).count() == 0
    one = spark.createDataFrame([(1, "to a@b.com, +1 (301) 555-0346!", 30)], "doc_id long, text string, n_chars int")
    assert tuple(pii.redact(one).first()) == (1, "to [EMAIL], [PHONE]!", 20)


@pytest.mark.parametrize("before, kind, want", [("Pavlov ", "phone", 0), ("v ", "phone", -1), ("ISBN: ", "card", -1), ("hotel ", "phone", 0), ("automatically ", "phone", 0), ("Tel. ", "phone", 1),
                                               ("shipping ", "ip", 0), ("the IP ", "ip", 1), ("# ", "card", -1), ("my credit card ", "card", 1), ("discard ", "card", 0)])
def test_cues_are_whole_words(before, kind, want):
    text = before + {"phone": "555-123-4567", "ip": "1.2.3.4", "card": "4111 1111 1111 1111"}[kind]
    at = len(before)
    number = pii.KINDS.index(kind)
    assert pii.votes(text, number, at, len(text), False)[3] == want
