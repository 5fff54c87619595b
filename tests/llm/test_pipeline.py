"""The pipeline's stages on a small table with planted cases."""

import random

import corpus_pipeline
from lexigrain.llm.common import materialise


def build(spark, tmp_path):
    rng = random.Random(11)
    text = lambda n: " ".join(f"w{rng.randrange(3000)}x" for _ in range(n))
    rows, labels = [], []
    for i in range(300):
        bad = i % 5 == 0
        t = text(120)
        rows.append((i, t.upper().replace(" ", "!! ") if bad else t, "en", "s", 0))
        labels.append((i, int(not bad), 0))
    rows.append((300, rows[1][1], "en", "s", 0))
    rows.append((301, rows[2][1] + " more", "en", "s", 0))
    passage = text(80)
    rows += [(302, text(60) + " " + passage + " " + text(60), "en", "s", 0), (303, text(70) + " " + passage + " " + text(50), "en", "s", 0)]
    rows += [(304, None, None, None, None), (305, "", "en", "s", 0), (None, text(50), "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return {r[0]: r[1] or "" for r in rows}, passage


def test_pipeline_stages(spark, tmp_path):
    texts, passage = build(spark, tmp_path)
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, str(tmp_path)), f"test-{name}")
        kept.append({r["doc_id"]: r for r in docs.collect()})
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    quality, near, subs, packed = kept
    assert not any(i in quality for i in range(0, 300, 5)) and all(i in quality for i in range(300) if i % 5)
    assert 1 in near and 300 not in near and None in near
    assert 2 in near and 301 not in near
    assert passage in subs[302]["text"] and passage not in subs[303]["text"] and len(subs[303]["text"]) < len(texts[303])
    assert subs[303]["n_chars"] == len(subs[303]["text"]) and all(subs[i]["text"] == texts[i] for i in subs if i in range(3, 300))
    assert set(packed) == set(subs)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_pipeline_of_no_rows_and_other_columns(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    rows = [(i % 4, None if i == 3 else f"w{i % 4} " * 50, "en", None, None, "x", "y") for i in range(8)]
    more = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, component_id string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, more, str(tmp_path))
        assert kept.columns == list(corpus_pipeline.COLUMNS) and kept.count() > 0
