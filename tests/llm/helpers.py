"""Rows that every operator must take: nulls, empty and very long texts, ties, repeats, clashing names."""

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"

LONG = "Thion are, over " * 20000

ODD = [
    (1, None), (2, ""), (3, "  two  blanks \n\n and\ttabs \r\n"), (4, "  nbsp em \x1c sep \0 nul"), (5, "ends <|endoftext|> here"),
    (6, "▁marks▁▁x ▁"), (7, "日本語 and emoji 🎉🎉 don't we'll"), (8, LONG), (9, "same text"), (9, "same text"), (10, "same text"), (None, "no id"), (11, "\n"), (12, " "),
    (13, "a\nb\n\nc \n d"), (14, "́combining​"), (15, "x" * 70000),
]


def odd_rows(spark):
    """The odd rows with further columns whose names operators might use themselves."""
    rows = [(i, t, "en", "s", len(t or ""), 7, "z", 1.5, True) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id int, fp string, shard double, `kept` boolean")


def texts(path):
    import pyarrow.parquet as pq

    t = pq.read_table(f"{path}/documents.parquet")
    return dict(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))
