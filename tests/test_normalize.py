"""Normal forms on hand-made values."""

from pyspark.sql import functions as F

from lexigrain.functions import normalize as nz

DATES = {"March 15, 2019": "2019-03-15", "15th day of March, 2019": "2019-03-15", "3/15/19": "2019-03-15", "March 2019": "2019-03", "[]/[]/2020": "2020", "5/8/14": "2014-05-08",
         "12/[]/97": "1997-12", "until terminated": "PERPETUAL", "[]": "UNSPECIFIED", "soon": None}
DAYS = {"30 days": 30, "thirty (30) days": 30, "one month": 30, "3 months": 90, "one year": 365, "6 weeks": 42, "two quarters": 180, "30 business days": 30, "later": None}


def test_dates_and_days_are_idempotent(spark):
    rows = spark.createDataFrame([(k, v) for k, v in DATES.items()], "v string, want string").withColumn("n", nz.normalize_date(F.col("v")))
    for r in rows.withColumn("again", nz.normalize_date(F.col("n"))).collect():
        assert r["n"] == r["want"] == r["again"], r["v"]
    rows = spark.createDataFrame([(k, v) for k, v in DAYS.items()], "v string, want int").withColumn("n", nz.normalize_days(F.col("v")))
    for r in rows.withColumn("again", nz.normalize_days(F.col("n").cast("string"))).collect():
        assert r["n"] == r["want"] == r["again"], r["v"]


def test_durations_and_parties(spark):
    rows = spark.createDataFrame([("successive one (1) year periods",), ("may be extended for one year",), ("never",)], "v string")
    got = [r["d"] and tuple(r["d"]) for r in rows.select(nz.normalize_duration(F.col("v")).alias("d")).collect()]
    assert got == [(365, True), (365, False), None]
    parties = spark.createDataFrame([('Birch Inc. ("Company"); Mount LLC;',)], "v string").select(nz.normalize_parties(F.col("v"))).first()[0]
    assert [tuple(p) for p in parties] == [("Birch Inc.", "Company"), ("Mount LLC", None)]
