"""English stemmer against published algorithm outputs, and the english analyser mode."""

import pytest
from pyspark.sql import functions as F

from shelfspark.functions.stem import stem
from shelfspark.operators import fulltext as FT

CASES = {
    "caresses": "caress", "ponies": "poni", "ties": "tie", "cries": "cri", "gaps": "gap", "gas": "gas",
    "kiwis": "kiwi", "running": "run", "hopping": "hop", "hoping": "hope", "agreed": "agre", "happy": "happi",
    "generously": "generous", "relational": "relat", "conditional": "condit", "national": "nation",
    "generalization": "general", "consign": "consign", "consigned": "consign", "consigning": "consign",
    "consignment": "consign", "consistency": "consist", "consolation": "consol", "conspiracy": "conspiraci",
    "constable": "constabl", "knackeries": "knackeri", "kneeling": "kneel", "knightly": "knight",
    "knitting": "knit", "knives": "knive", "skies": "sky", "dying": "die", "news": "news",
    "communication": "communic", "arsenal": "arsenal", "jackets": "jacket", "boots": "boot", "by": "by",
    "say": "say", "cry": "cri", "luxuriating": "luxuri",
}


@pytest.mark.parametrize("word,expect", sorted(CASES.items()))
def test_stem(word, expect):
    assert stem(word) == expect


def test_english_mode_matches_inflections(spark):
    docs = spark.createDataFrame([(1, "Warm knitted jackets for the winter"), (2, "a jacket")], "id int, text string")
    qs = spark.createDataFrame([(9, "the jacket knitting")], "query_id int, q string")
    dt = FT.analyze(docs, ["id"], F.col("text"), mode="english")
    assert {r["term"] for r in dt.where("id = 1").collect()} == {"warm", "knit", "jacket", "winter"}
    # stop words removed but positions keep their gaps
    assert [r["pos"] for r in dt.where("id = 1").orderBy("pos").collect()] == [1, 2, 3, 6]
    qt = FT.query_terms(qs, F.col("q"), mode="english")
    occ = FT.matched_occurrences(dt, qt)
    assert [r["id"] for r in FT.match_and_rank(occ).collect()] == [1]


def test_endings_asked_at_once_hold_all_endings_of_a_step():
    """most words have no ending of a step and skip it; a worker remembers the words of several blocks of documents."""
    from shelfspark.functions import stem as ST

    assert all(x.endswith(ST.ENDINGS_1B) for x in ("eedly", "ingly", "edly", "eed", "ing", "ed"))
    assert {x for x, _ in ST.STEP2} <= set(ST.ENDINGS_2) and {x for x, _ in ST.STEP3} <= set(ST.ENDINGS_3) and set(ST.STEP4) <= set(ST.ENDINGS_4)
    assert ST.stem_or_keep.cache_info().maxsize >= 4 * 100_000
