import hashlib

from shelfspark.llm import exact_dedup


def norm(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or ""))


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[norm(t)] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[norm(t)]), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return out


ROWS = [(1, None), (2, ""), (3, "Ab Ä"), (4, "aB Ä"), (5, "ab ä"), (6, "x" * 200000), (7, "X" * 200000), (7, "x" * 200000), (None, "ab Ä"), (None, "q"), (8, "lone")]


def test_against_brute_force(spark):
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in ROWS], "doc_id long, text string, sha string, id int")
    for words in (1, 64, exact_dedup.FILTER_WORDS):  # a filter that is full gives the same answer
        got = [tuple(r) for r in exact_dedup.exact_duplicates(df, filter_words=words).collect()]
        assert sorted(map(str, got)) == sorted(map(str, brute(ROWS)))
        kept = exact_dedup.drop_exact_duplicates(df, filter_words=words)
        assert kept.columns == df.columns
        assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["2", "4", "5", "7", "None", "8"])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_duplicates(df).count() == 0 and exact_dedup.drop_exact_duplicates(df).count() == 0


def test_no_python_and_unique_rows_do_not_shuffle(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = exact_dedup.exact_duplicates(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert "BroadcastHashJoin" in plan
