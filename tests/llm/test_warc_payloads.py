"""op9_warc reads the payloads that it wrote."""

import pytest
from pyspark.sql import functions as F

from lexigrain.llm import queries, warc

PAGES = [(1, "http://a", "<p>one</p>"), (2, "http://b", "<p>one</p>"), (3, None, None), (4, "http://d", "<p>tw\u00f6</p>")]


def spoil(spark, monkeypatch, column):
    """Lets write_archive spoil ``column`` of one stored payload."""
    write = warc.write_archive

    def spoilt(pages, path, **kw):
        write(pages, path, **kw)
        rows = [(r["digest"], bytes(r["payload"])) for r in spark.read.parquet(f"{path}/payloads").collect()]
        changed = [(d, b"<p>other</p>" if p == b"<p>one</p>" else p) for d, p in rows]
        if column == "digest":  # digest and payload agree, the header does not
            fresh = spark.createDataFrame(changed, "old string, payload binary").withColumn("digest", F.sha2("payload", 256))
            records = spark.read.parquet(f"{path}/records").join(fresh.select("old", F.col("digest").alias("new")), F.col("digest") == F.col("old"))
            records.select("page_id", F.col("new").alias("digest"), "header", "has_payload").write.parquet(f"{path}/records2")
            spark.read.parquet(f"{path}/records2").write.mode("overwrite").parquet(f"{path}/records")
            fresh.select("digest", "payload").write.mode("overwrite").parquet(f"{path}/payloads")
        else:
            spark.createDataFrame(changed, "digest string, payload binary").write.mode("overwrite").parquet(f"{path}/payloads")

    monkeypatch.setattr(warc, "write_archive", spoilt)


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    return str(tmp_path)


def test_sound_payloads(spark, folder):
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in queries.op9_warc(spark, folder).collect()}
    assert got == {1: (10, "response", None), 2: (10, "revisit", 1), 3: (0, "response", None), 4: (11, "response", None)}


@pytest.mark.parametrize(("column", "message"), [("payload", "does not have its digest"), ("digest", "of its header")])
def test_spoilt_payloads_fail(spark, folder, monkeypatch, column, message):
    spoil(spark, monkeypatch, column)
    with pytest.raises(Exception, match=message):
        queries.op9_warc(spark, folder).collect()
