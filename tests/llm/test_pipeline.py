"""The pipeline against the same stages by brute force, and its hold on the registry."""

import sys

import __spark_entry__ as entry
import corpus_pipeline
import public_tokenizers
from helpers import SF001, odd_rows, texts
from test_exact_dedup import norm
from test_pii import brute as personal
from test_packing import checked
from test_simhash import brute_components, brute_print
from tokenizers import Tokenizer


def masked(text):
    out, end = [], 0
    for kind, a, b in sorted(personal(text), key=lambda s: s[1:]):
        if a >= end:
            out += [text[end:a], "[" + ("EMAIL", "IP", "CARD", "PHONE")[kind] + "]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def test_run_equals_brute_force(spark):
    kept = {}
    for i, t in sorted(texts(SF001).items()):  # every text of these tables has letters of a declared language
        kept[norm(t)] = (i, t)  # the largest id comes last
    docs = dict(kept.values())
    ids = sorted(docs)
    comp = brute_components(ids, [brute_print(docs[i]) for i in ids])
    docs = {i: masked(docs[i]) for i in ids if comp[i] == i}
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = corpus_pipeline.run(spark, SF001).collect()
    checked(rows, [(i, tk.encode(t, add_special_tokens=False).ids + [0]) for i, t in docs.items()])


def test_stages_keep_columns_and_take_odd_rows(spark):
    docs = odd_rows(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF001)
        assert out.columns == docs.columns and stage(spark, docs.where("false"), SF001).count() == 0
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert {r.doc_id for r in docs.collect()} == {3, 4, 5, 6, 7, 8, 10, 13, 14, 15, None} - ({None} if docs.where("doc_id is null").count() == 0 else set())
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF001).count() > 0


def test_registry():
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 14)}
    assert "pipeline" in names and "shelfspark.llm" in sys.modules
