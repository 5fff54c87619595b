"""Text primitives, chunks, sources and tables on hand-made rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lexigrain.functions import text as tx
from lexigrain.operators import chunking as ck
from lexigrain.sources import documents as src


WHITE = [("a  b", "a b"), ("a\nb", "a b"), (" a ", "a"), ("a\t\r\nb", "a b"), ("", ""), (" a b\x1c", "a b"), ("a", "a"), ("  ", ""), ("a \n\n b", "a b")]


def test_normalize_whitespace(spark):
    got = spark.createDataFrame(WHITE, "t string, want string").select("t", "want", tx.normalize_whitespace("t").alias("n")).collect()
    assert all(r["n"] == r["want"] == " ".join(r["t"].split()) for r in got)


def test_span_status(spark):
    text = "The Agreement shall  be governed\nby Delaware law."
    spans = [(4, "Agreement", "exact", None), (0, "Agreement", "mismatch", 4), (0, "absent text", "mismatch", None), (999, "law", "out_of_bounds", 38), (-1, "The", "out_of_bounds", 0),
             (14, "shall be governed by", "whitespace_only", None), (45, "law and much more", "out_of_bounds", None)]
    df = spark.createDataFrame([(text, *s) for s in spans], "t string, at int, g string, want string, offset int")
    for r in df.withColumn("s", tx.span_status("t", "at", "g")).withColumn("o", tx.actual_offset("t", "g", F.col("s"))).collect():
        assert (r["s"], r["o"]) == (r["want"], r["offset"]), r["g"]


def test_offsets_are_code_points(spark):
    df = spark.createDataFrame([("a😀b é",)], "t string")
    assert df.select(tx.find("t", F.lit("b")), tx.slice_text("t", F.lit(1), F.lit(3))).first() == (2, "😀b")


def test_keys(spark):
    df = spark.createDataFrame([("Café No. 1",), ("Café No. 1",), (None,)], "t string")
    assert [r[0] for r in df.select(tx.document_key("t")).collect()] == ["Café No. 1", "Café No. 1", None]
    assert [r[0] for r in df.select(tx.relaxed_key("t")).collect()] == ["caféno1", "caféno1", None]


INTS = [("30", 30), (" 30 ", 30), ("+30", 30), ("-5", -5), ("1_000", 1000), ("1__0", None), ("3.0", None), ("", None), ("abc", None)]


def test_python_int(spark):
    got = spark.createDataFrame(INTS, "t string, want int").select("want", tx.python_int("t").cast("int").alias("n")).collect()
    assert all(r["n"] == r["want"] for r in got)


def test_partial_dates(spark):
    rows = ["2019", "2019-03", "2019-03-15", "2019-13", "2019-02-30", "3/15/19", "0000-01"]
    got = [(r["p"] and tuple(r["p"]), r["d"] and str(r["d"])) for r in spark.createDataFrame([(r,) for r in rows], "t string").withColumn("p", tx.partial_date("t")).withColumn("d", tx.date_lower_bound(F.col("p"))).collect()]
    assert got == [((2019, None, None), None), ((2019, 3, None), "2019-03-01"), ((2019, 3, 15), "2019-03-15"), ((2019, 13, None), None), ((2019, 2, 30), None), (None, None), ((0, 1, None), None)]


CHUNK_TEXTS = [
    "1. TERM. This runs. 2. not a heading\n2. LAW. Delaware.", "no structure at all here", "run on    1. ALPHA. one two three     2. BETA. four", "ARTICLE IV\nThe text.\nSection 4.2 Title here",
    "   padded   ", "naïve café 😀 words " * 9, "", "\n\n",
]


@pytest.mark.parametrize("text", CHUNK_TEXTS)
def test_chunks_are_slices(text):
    for a, b, _, n in ck.chunk_text(text, ck.ChunkLimits(8, 2, 1)):
        assert text[a:b] == text[a:b].strip() and n == len(text[a:b].split()) > 0


def test_chunk_cases():
    limits = ck.ChunkLimits
    many = ck.chunk_text("1. TERM. " + "word " * 300 + "  2. LAW. " + "word " * 300, limits(50, 0, 0))
    assert len(many) > 4
    assert len(ck.chunk_text("word " * 500, limits(40, 0, 0))) == 13
    assert ck.chunk_text(" \n ", limits()) == []
    assert len(ck.chunk_text("1. A. x\n2. B. y", limits(50, 0, 0))) == 2
    assert len(ck.chunk_text("1. A. x\n2. B. y\n3. C. z", limits(50, 10, 0))) == 1
    starts = [c[0] for c in ck.chunk_text("w " * 200, limits(20, 0, 19))]
    assert starts == sorted(set(starts))
    paragraphs = ck.chunk_text("a b c\n\nd e f\n\ng h i j k", limits(6, 0, 0))
    assert [p[3] for p in paragraphs] == [6, 5]
    with pytest.raises(ValueError):
        limits(0)


def test_headings():
    assert [h[1] for h in ck.headings("1. TERM. x\n2.1 Law of y     11.3 A Party")] == ["1", "2.1", "11.3"]
    for none in ("in 1934 The Act", "pursuant to Section 13 of the Exchange Act", "pay 5 dollars"):
        assert ck.headings(none) == []
    assert ck.headings("Section 4.2 Title here\nbody")[0][1:] == ("Section 4.2", "Section 4.2 Title here")


def test_native_split_equals_general_chunks(spark):
    rng = random.Random(2)
    rows = [(str(i), " ".join("w" * rng.randrange(1, 9) for _ in range(n)).replace(" w", "\nw", 2)) for i, n in enumerate([1, 19, 20, 21, 35, 36, 100, 501])]
    docs, limits = spark.createDataFrame(rows, "document_id string, text string"), ck.ChunkLimits(20, 0, 5)
    pick = ["chunk_id", "text", "char_start", "char_end", "ordinal", "token_count"]
    assert sorted(ck.split_long_text(docs, limits).select(*pick).collect()) == sorted(ck.chunk_documents(docs, limits).select(*pick).collect())
    assert ck.chunk_violations(ck.split_long_text(docs, limits), docs).count() == 0


def test_read_span_limits(spark):
    docs = spark.createDataFrame([("d", "x" * 20_000)], "document_id string, text string")
    reads = [(1, i, "d", 500, 510) for i in range(8)] + [(2, 0, "d", 5, 5), (2, 1, "d", 30_000, 30_010), (2, 2, "d", 0, 15_000)]
    got = {(r["run_id"], r["seq"]): (r["status"], r["from_char"], r["to_char"]) for r in ck.read_span(docs, spark.createDataFrame(reads, "run_id long, seq long, document_id string, char_start int, char_end int")).collect()}
    assert got[(1, 5)] == ("ok", 100, 910) and got[(1, 6)][0] == "read_limit"
    assert got[(2, 0)][0] == got[(2, 1)][0] == "out_of_bounds" and got[(2, 2)] == ("ok", 0, 8400)


def test_documents_keep_line_ends(spark, tmp_path):
    (tmp_path / "b.v1.txt").write_bytes("x\r\ny\rz é".encode())
    (tmp_path / "Café a+b.txt").write_text("hi", encoding="utf-8")
    docs = src.documents(spark, f"{tmp_path}/*.txt", metadata={"k": "v"}).collect()
    assert {d["document_id"]: d["text"] for d in docs} == {"b.v1": "x\r\ny\rz é", "Café a+b": "hi"} and docs[0]["metadata"] == {"k": "v"}
    only = spark.createDataFrame([("Café a+b",)], "document_id string")
    assert src.documents(spark, f"{tmp_path}/*.txt", only).count() == 1 and src.documents(spark, f"{tmp_path}/*.txt", only.limit(0)).count() == 0


def test_annotations_splits_and_cases(spark, tmp_path):
    qa = {"data": [{"title": "A", "paragraphs": [{"context": "c", "qas": [{"id": "A__Parties", "answers": [{"text": "p", "answer_start": 1}, {"text": "q", "answer_start": 5}]}, {"id": "A__Cap__x", "answers": []}]}]}]}
    (tmp_path / "qa.json").write_text(json.dumps(qa))
    got = src.read_annotations(spark, f"{tmp_path}/qa.json").collect()
    assert sorted((r["category"], r["char_start"]) for r in got if r["text"]) == [("Parties", 1), ("Parties", 5)] and [r["category"] for r in got if r["text"] is None] == ["Cap__x"]
    (tmp_path / "split.json").write_text(json.dumps({"splits": {"dev": ["a"]}}))
    assert src.load_split(spark, f"{tmp_path}/split.json", "dev") == ["a"]
    with pytest.raises(KeyError, match="dev"):
        src.load_split(spark, f"{tmp_path}/split.json", "x")
    cases = spark.createDataFrame([("c", "d", "parties", True, [(1, 2)], 1, 10)], "case_id string, document_id string, clause_type string, present boolean, gold_spans array<struct<s:int,e:int>>, length_quartile int, document_chars int")
    src.save_cases(cases, f"{tmp_path}/cases")
    assert src.load_cases(spark, f"{tmp_path}/cases").collect() == cases.collect()


def test_master_answers_ties(spark, tmp_path):
    (tmp_path / "m.csv").write_text("Filename,Law-Answer,Cap-Answer,Other\n1,b,Yes,x\n2,a,No,x\n3,b,,x\n4,a,Yes,x\n")
    got = {r["category"]: r for r in src.read_master_answers(spark, f"{tmp_path}/m.csv").collect()}
    assert set(got) == {"Law-Answer", "Cap-Answer"} and got["Law-Answer"]["top_values"] == "b|a"
    assert got["Cap-Answer"]["is_boolean"] and (got["Cap-Answer"]["yes_count"], got["Cap-Answer"]["filled"]) == (2, 3)


def test_published_tables(spark, tmp_path):
    kind = "document_id string, text string"
    docs = spark.createDataFrame([("a", "one two"), ("b", "three")], kind)
    folder = f"file://{tmp_path}/index"
    src.index_documents(spark, folder, docs, ck.split_long_text(docs))
    new = spark.createDataFrame([("b", "four five six"), ("c", "")], kind)
    src.index_documents(spark, folder, new, ck.split_long_text(new))
    assert sorted(map(tuple, src.current(spark, folder, "documents").collect())) == [("a", "one two"), ("b", "four five six"), ("c", "")]
    assert sorted(r["text"] for r in src.current(spark, folder, "chunks").collect()) == ["four five six", "one two"]


def test_cache_modes(spark, tmp_path):
    entry = spark.createDataFrame([("abcd", ("m", 5.0, 1), ([("text", None, None, "hi")], "end_turn", "m", (1, 2, None, None)))], src.CACHE)
    src.write_cache(entry, f"{tmp_path}/cache")
    stored = src.read_cache(spark, f"{tmp_path}/cache")
    assert stored.first()["response"]["usage"]["input_tokens"] == 1
    asked = spark.createDataFrame([("abcd",), ("ffff",)], "key string")
    hits = lambda mode: [r["hit"] for r in src.lookup_cache(asked, stored, mode).orderBy("key").collect()]
    assert hits("read_write") == [True, False] and hits("off") == hits("refresh") == [False, False]
    with pytest.raises(Exception, match="not in the cache"):
        hits("read_only")


def test_jurisdictions(spark, tmp_path):
    ids, aliases = src.load_jurisdictions(spark)
    assert ids.where("kind = 'jurisdiction'").count() == 93 and ids.where("kind = 'sentinel'").count() == 3
    assert aliases.where("alias = 'prc'").first()["id"] == "CN"
    (tmp_path / "j.json").write_text(json.dumps({"jurisdictions": [{"id": "X", "canonical": "Xland", "aliases": ["XX"]}], "sentinels": [{"id": "S"}]}))
    assert src.load_jurisdictions(spark, f"{tmp_path}/j.json")[1].count() == 2


def test_texts_share_files_and_come_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(src, "LONG_TEXT", 1000)
    odd = ["x\r\ny\rz é", " \n", "a|b||", f"{src.RECORD}{src.FIELD}{src.MARK}", f"{src.MARK}B{src.MARK}AC", "w" * 1000, "w" * 1500, "😀\n\n"]
    rows = [(f"k{src.FIELD}{i}", odd[i % len(odd)]) for i in range(598)] + [(None, "no key"), ("no text", None)]
    texts = spark.createDataFrame(rows, "key string, text string").coalesce(1)
    src.write_texts(texts, f"file://{tmp_path}/t")
    assert sorted(map(tuple, src.read_bundles(spark, f"file://{tmp_path}/t").collect()), key=str) == sorted(rows, key=str)
    assert len(list(tmp_path.glob("t/short/part-*"))) == 3 and len(list(tmp_path.glob("t/long/part-*"))) == sum(len(x or "") >= 1000 for _, x in rows)
