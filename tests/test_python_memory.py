"""Python functions of whole texts get few of them at a time."""

import unicodedata

from pyspark.sql import functions as F

from lexigrain.functions import text as tx
from lexigrain.operators import grounding as gr

TEXTS = ["Straße_No. 1", "Café ½ ²", "İı ſ µ ŉ", "á_b٣ⅷ", "日本 語、", "", None, "_-_"]


def test_relaxed_keys_are_letters_and_digits(spark):
    got = spark.createDataFrame([(x,) for x in TEXTS], "t string").select("t", tx.relaxed_key("t").alias("k")).collect()
    assert all(r["k"] == (None if r["t"] is None else "".join(c for c in unicodedata.normalize("NFC", r["t"]).casefold() if c.isalnum())) for r in got)


def test_whole_texts_are_not_sent_in_arrow_batches(spark):
    docs = spark.createDataFrame([("d", "some  text")], "document_id string, text string")
    evidence = spark.createDataFrame([("d", "some text", 0, 9), ("d", None, 0, 1)], "document_id string, quote string, char_start int, char_end int")
    checked = gr.check_evidence(evidence, docs)
    for df in (docs.select(tx.relaxed_key("text")), docs.select(tx.document_key("text")), checked):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
    assert [(r["found_start"], r["found_end"]) for r in checked.where(F.col("quote").isNotNull()).collect()] == [(0, 10)]
