"""What the patterns find where they read only a part of a text: the same as on whole texts."""

import random
import re

from pyspark.sql import functions as F

from lexigrain.operators import baseline as bl

PHRASES = [
    "governed by the laws of the State of Delaware, without", "GOVERNED  BY THE LAW OF Nowhere, and", "construed in accordance with the laws of England and Wales.", "ſubject to the laws of France;",
    "by and between Acme Corporation and Beta Limited.", "between one and another. ", "among Foo Inc. and Bar LLC; ", "7th day of September, 1999", "the day of days", "March 3, 2001", "ın perpetuity ", "INTO PERPETUAL motion",
    "in  perpetuity", "xuntil terminated", "until terminated", "untİl terminated", "remain in force and effect until terminated.", "until then ", "maybe in May 12, 1998", "31 day of  Mİy 2001", "́remain in force and effect until terminated",
]


def _bare(pattern):
    """Without the look at the first letter."""
    return re.sub(r"^\(\?iU\)\(\?=\[\w+\]\)", "(?iU)", pattern)


def _whole(docs):
    """Each pattern on whole texts: (document_id, clause type, what it says, where it ends)."""
    def all_of(text, pattern, group):
        pattern = _bare(pattern)
        return F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("said"), F.transform(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x, i: bl._place(F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), i)).alias("end"))

    opening = F.substring("text", 1, bl.RECITAL_WINDOW)
    companies = lambda x: F.size(F.regexp_extract_all(x, F.lit(bl.COMPANY), F.lit(0)))
    kinds = {"governing_law": F.filter(all_of(F.col("text"), bl.LAW, 1), lambda m: bl._named(m["said"]).isNotNull()),
             "effective_date": F.concat(all_of(F.col("text"), bl.DAY_OF_MONTH, 0), all_of(F.col("text"), bl.MONTH_FIRST, 0)),
             "parties": F.filter(all_of(opening, bl.RECITAL, 1), lambda m: companies(m["said"]) > 1),
             "expiration_date": all_of(F.col("text"), bl.PERPETUAL, 0)}
    out = None
    for kind, found in kinds.items():
        rows = docs.select("document_id", F.lit(kind).alias("kind"), F.get(found, F.lit(0)).alias("m")).where("m is not null").select("document_id", "kind", "m.end")
        out = rows if out is None else out.unionByName(rows)
    return sorted(map(tuple, out.collect()))


def test_parts_of_texts_give_what_whole_texts_give(spark):
    rng = random.Random(8)
    fill = lambda: " ".join(rng.choice(["words", "and", "until", "subjects", "9", "days", "été", "Kelvin"]) for _ in range(rng.choice([0, 3, 40, 900])))
    texts = [*PHRASES, *(f" {fill()} ".join(rng.sample(PHRASES, rng.randrange(1, 5))) for _ in range(150)), "", None, "x " * 3000 + PHRASES[4]]
    docs = spark.createDataFrame(list(enumerate(texts)), "document_id int, text string").repartition(4).localCheckpoint()
    got = bl.find_clauses(docs).select("document_id", F.col("clause_type").alias("kind"), F.col("char_end").alias("end"))
    assert sorted(map(tuple, got.collect())) == _whole(docs.withColumn("text", F.coalesce("text", F.lit(""))))


def test_patterns_read_from_the_first_word_that_may_begin_a_match(spark):
    docs = spark.createDataFrame([("plain " * 50, ), ("plain " * 50 + "until 7", ), ("perpetual", )], "text string").withColumn("low", F.lower("text"))
    assert [tuple(r) for r in docs.select(bl._skipped("perpetual"), bl._skipped("law")).collect()] == [(None, None), (300 - bl._LOOK_BACK, None), (0, None)]
