"""Fusion, search, reranking, embeddings and evidence checks on hand-made rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrain.functions import stemming
from lexigrain.functions import text as tx
from lexigrain.operators import grounding as gr
from lexigrain.operators import operations as op
from lexigrain.operators import retrieval as rt

RANKED = "query_id long, retriever string, pos int, chunk_id string"


def fused(spark, lists, k=60, limit=None, arms=("dense", "lexical")):
    rows = [(1, arm, i, c) for arm, chunks in lists.items() for i, c in enumerate(chunks, 1)]
    return rt.fuse(spark.createDataFrame(rows, RANKED), k, limit, arms).orderBy("fused_rank").collect()


def test_fusion_order_and_scores(spark):
    one = fused(spark, {"lexical": ["a", "b"]})
    assert [(r["chunk_id"], r["score"]) for r in one] == [("a", 1 / 61), ("b", 1 / 62)] and one[0]["ranks"] == {"lexical": 1}
    both = fused(spark, {"dense": ["x", "both"], "lexical": ["y", "both"]})
    assert both[0]["chunk_id"] == "both" and both[0]["ranks"] == {"dense": 2, "lexical": 2}
    deep = fused(spark, {"dense": ["top"] + [f"d{i}" for i in range(199)] + ["deep"], "lexical": [f"l{i}" for i in range(200)] + ["deep"]})
    assert [r["chunk_id"] for r in deep].index("top") < [r["chunk_id"] for r in deep].index("deep")


def test_fusion_ties_duplicates_and_limits(spark):
    assert [r["chunk_id"] for r in fused(spark, {"dense": ["d"], "lexical": ["a"]})] == ["d", "a"]
    twice = fused(spark, {"lexical": ["a", "a", "b"]})
    assert [(r["chunk_id"], r["score"]) for r in twice] == [("a", 1 / 61), ("b", 1 / 63)]
    assert [r["chunk_id"] for r in fused(spark, {"dense": ["x", "z"], "lexical": ["y", "z"]}, limit=1)] == ["z"]
    with pytest.raises(ValueError):
        fused(spark, {"dense": ["a"]}, k=0)
    with pytest.raises(ValueError):
        rt.hybrid_search(None, None, None, arms=())


CORPUS = [("m1", "governing law of Delaware"), ("m2", "either party may terminate"), ("d1", "terminated by the distributor"), ("d2", "laws of New York")]


def test_lexical_search(spark):
    post = rt.postings(spark.createDataFrame(CORPUS, "chunk_id string, text string"))
    ask = spark.createDataFrame([(1, "governing law Delaware"), (2, "zzzz"), (3, "?!"), (4, "party's law OR terminate")], "query_id long, query string")
    got = rt.lexical_search(post, ask).orderBy("query_id", "pos").collect()
    assert [(r["query_id"], r["chunk_id"]) for r in got] == [(1, "m1"), (4, "m2"), (4, "m1")]
    assert got[0]["score"] == pytest.approx(0.3 / 1.3)
    stems = stemming.stem_postings(post)
    assert {r["chunk_id"] for r in stems.where("term = 'termin'").collect()} == {"m2", "d1"}
    assert stems.where("term in ('of', 'the', 'by')").count() == 0


@pytest.mark.parametrize(("word", "stem"), [("terminated", "termin"), ("terminate", "termin"), ("agreements", "agreement"), ("generously", "generous"), ("skies", "sky"), ("hopping", "hop"),
                                            ("hoping", "hope"), ("conditional", "condit"), ("relational", "relat"), ("happily", "happili"), ("dying", "die"), ("national", "nation"), ("is", "is")])
def test_porter2(word, stem):
    assert stemming.porter2(word) == stem


def test_query_terms(spark):
    rows = [("party's rights", ["party", "s", "rights"]), ("Section 4.2", ["section", "4", "2"]), ("", [])]
    for q, want in rows:
        assert spark.createDataFrame([(q,)], "q string").select(tx.query_terms("q")).first()[0] == want


def test_dense_search_and_embedding(spark):
    rows = rt.hash_embed(spark.createDataFrame([*CORPUS, ("e", "")], "chunk_id string, text string"), dim=64)
    v = {r["chunk_id"]: np.array(r["embedding"]) for r in rows.collect()}
    assert all(np.linalg.norm(x) == pytest.approx(1) for x in v.values()) and v["e"][0] == 1
    ask = rows.where("chunk_id = 'm1'").select(F.lit(1).alias("query_id"), F.col("embedding").alias("vector"))
    withnull = rows.select("chunk_id", "embedding").unionByName(spark.createDataFrame([("n", None)], "chunk_id string, embedding array<double>"))
    best = rt.dense_search(withnull, ask).orderBy("pos").collect()
    assert best[0]["chunk_id"] == "m1" and best[0]["score"] == pytest.approx(1) and "n" not in {r["chunk_id"] for r in best}


def test_filters(spark):
    docs = spark.createDataFrame([("a",), ("b",)], "document_id string")
    assert rt.restrict(docs, None).count() == rt.restrict(docs, docs.limit(0)).count() == 2
    assert rt.restrict(docs, docs.limit(0), empty_means_all=False).count() == 0 and rt.restrict(docs, docs.where("document_id = 'a'")).count() == 1


def test_rerank_ties_keep_fused_order(spark):
    rows = [(1, "a", 1, 0.5), (1, "b", 2, 0.9), (1, "c", 3, 0.5)]
    got = rt.rerank(spark.createDataFrame(rows, "query_id long, chunk_id string, fused_rank int, rerank_score double"), 2).orderBy("rerank_rank").collect()
    assert [r["chunk_id"] for r in got] == ["b", "a"]


def test_near_duplicate_queries(spark):
    rows = [(1, 0, "governing law clause"), (1, 1, "Governing law clauses"), (1, 2, "termination notice"), (2, 0, "governing law clause")]
    q = spark.createDataFrame(rows, "run_id long, seq long, query string")
    assert {(r["run_id"], r["seq"]) for r in op.reject_near_duplicates(q).collect() if r["accepted"]} == {(1, 0), (1, 2), (2, 0)}
    assert {(r["run_id"], r["seq"]) for r in op.near_duplicate_trace(q).collect() if r["near_duplicate"]} == {(1, 1)}


CONTRACT = "This CLAUSE is governed\nby the laws of Delaware. A CLAUSE may bind. Last CLAUSE here."
FOOTER = "The fee is payable within\n12\nSource: ACME INC, 10-K, 3/15/2019\nthirty days of receipt."


def check(spark, rows):
    """Checks of [(quote, start, end, text)], in order."""
    ev = [(str(i), "c", 0, 0, q, a, b) for i, (q, a, b, _) in enumerate(rows)]
    kind = "document_id string, clause_type string, seq int, ev_ord int, quote string, char_start int, char_end int"
    docs = spark.createDataFrame([(str(i), t) for i, (*_, t) in enumerate(rows)], "document_id string, text string")
    return sorted(gr.check_evidence(spark.createDataFrame(ev, kind), docs).collect(), key=lambda r: int(r["document_id"]))


CHECKS = [
    ("This CLAUSE", 0, 11, "exact", (0, 11)),
    ("governed by the laws", 15, 35, "normalized", (15, 35)),
    ("governed by the laws", 0, 0, "relocated", (15, 35)),
    ("by the laws", 3, 14, "relocated", (24, 35)),
    ("by the laws of Texas", 24, 44, "not_found", (None, None)),
    ("invented", 0, 0, "not_found", (None, None)),
    ("absent", 99_999, 100_005, "out_of_bounds", (None, None)),
    (" \n ", 0, 3, "empty", (None, None)),
]


def test_grounding_statuses(spark):
    for r, (quote, _, _, status, found) in zip(check(spark, [(q, a, b, CONTRACT) for q, a, b, *_ in CHECKS]), CHECKS, strict=True):
        assert (r["status"], (r["found_start"], r["found_end"])) == (status, found), quote
        if status == "relocated":
            assert r["found_quote"] == CONTRACT[found[0] : found[1]]


def test_grounding_occurrences_and_footers(spark):
    r, *rest = check(spark, [("CLAUSE", 50, 56, CONTRACT), ("payable within thirty days", 0, 0, FOOTER), ("payable within days", 0, 0, FOOTER), ("payable within sixty days", 0, 0, FOOTER)])
    assert (r["status"], r["found_start"], r["other_occurrences"]) == ("relocated", 5, 2)
    assert [x["status"] for x in rest] == ["artifact_elided", "not_found", "not_found"]


def test_grounding_report_and_repair(spark):
    kind = "document_id string, clause_type string, seq int, ev_ord int, quote string, char_start int, char_end int"
    ev = spark.createDataFrame([("d", "c", 0, 0, "This CLAUSE", 0, 11), ("d", "c", 0, 1, "by the laws", 0, 0), ("d", "c", 0, 2, "nowhere", 1, 8)], kind)
    checked = gr.check_evidence(ev, spark.createDataFrame([("d", CONTRACT)], "document_id string, text string"))
    r = gr.report(checked).first()
    assert (r["total"], r["ungrounded"], r["strict"]) == (3, 1, 2) and r["violation_rate"] == pytest.approx(1 / 3)
    assert gr.report(checked.limit(0)).first()["violation_rate"] == 0
    clauses = spark.createDataFrame([("d", "c", 0), ("d", "e", 1)], "document_id string, clause_type string, seq int")
    got = {r["clause_type"]: [e["char_start"] for e in r["evidence"]] for r in gr.repaired_clauses(clauses, checked).collect()}
    assert got == {"c": [0, 24], "e": []}
