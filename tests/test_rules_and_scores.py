"""Checks, routing, scores, sampling, operations and streams on hand-made rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lexigrain import dims
from lexigrain.functions import intervals as iv
from lexigrain.functions import stats as st
from lexigrain.operators import baseline as bl
from lexigrain.operators import operations as op
from lexigrain.operators import rules as ru
from lexigrain.operators import sampling as sa
from lexigrain.operators import scoring as sc
from lexigrain.streaming import incremental

TYPES = [c for c, *_ in dims.CLAUSE_TYPES]
CLAUSE = "document_id string, seq int, clause_type string, present boolean, value string, raw_text string, confidence double"
EVIDENCE = "document_id string, clause_type string, seq int, ev_ord int, quote string, char_start int, char_end int"
TEXT = "This agreement is governed by the laws of Delaware and binds both parties."


def violations_of(spark, cases):
    """{name: [(rule, severity, types)]} of {name: (clauses, evidence)}, all in one run.

    clauses: {type: (present, value, raw_text, confidence)} or a list of (type, ...).
    """
    rows, cited = [], []
    for name, (clauses, evidence) in cases.items():
        items = list(clauses.items()) if isinstance(clauses, dict) else clauses
        rows += [(name, i, c, *v) for i, (c, v) in enumerate(items)]
        cited += [(name, *e) for e in evidence]
    docs = spark.createDataFrame([(name, TEXT) for name in cases], "document_id string, text string")
    found = ru.apply_rules(spark.createDataFrame(rows, CLAUSE), spark.createDataFrame(cited, EVIDENCE), docs, dims.clause_types(spark))
    out = {name: [] for name in cases}
    for r in ru.in_order(found).collect():
        out[r["document_id"]].append((r["rule_id"], r["severity"], r["clause_types"]))
    return out


def ids(found):
    return {f[0] for f in found}


def full(**changed):
    base = {c: (False, None, None, 0.5 + i / 100) for i, c in enumerate(TYPES)}
    base["parties"] = (True, "A; B", None, 0.9)
    return base | changed


CITED = [("parties", 1, 0, "binds both parties", 55, 73)]


FIRING = [
    ({"governing_law": (True, "Atlantis", None, 0.9)}, "governing_law_unknown_jurisdiction"),
    ({"governing_law": (True, "us-de", None, 0.9)}, "governing_law_unknown_jurisdiction"),
    ({"effective_date": (True, "3/15/19", None, 0.9)}, "date_unparseable"),
    ({"effective_date": (True, "1850", None, 0.9)}, "date_implausible_year"),
    ({"effective_date": (False, "PERPETUAL", None, 0.9)}, "perpetual_effective_date"),
    ({"notice_period_to_terminate_renewal": (True, "abc", None, 0.9)}, "notice_period_not_integer"),
    ({"notice_period_to_terminate_renewal": (True, "0", None, 0.9)}, "notice_period_non_positive"),
    ({"notice_period_to_terminate_renewal": (True, "9999", None, 0.9)}, "notice_period_implausible"),
    ({"uncapped_liability": (True, None, None, 0.9)}, "uncapped_without_cap"),
    ({"renewal_term": (True, "365", None, 0.9)}, "renewal_term_without_notice_period"),
    ({"expiration_date": (True, "2020", None, 0.9)}, "expiration_without_effective"),
    ({"non_compete": (True, None, None, 0.9)}, "non_compete_without_exclusivity"),
    ({"non_compete": (True, None, None, 0.69)}, "tier3_low_confidence"),
    ({"renewal_term": (True, "365", None, 0.39)}, "very_low_confidence"),
    ({"exclusivity": (False, "x", None, 0.9)}, "boolean_clause_carries_no_value"),
    ({"renewal_term": (True, None, None, 0.9)}, "valued_clause_missing_value"),
    ({"renewal_term": (False, None, "text", 0.9)}, "absence_forbids_raw_text"),
    ({"parties": (True, "x", "governed by the law of Texas", 0.9)}, "raw_text_not_verbatim"),
    ({"parties": (False, None, None, 0.9)}, "parties_absent"),
]
ORDERS = [("2020", "2019", True), ("2019", "2019", False), ("2019-03-15", "2019", False), ("2019-03-15", "2019-03", True), ("2019-03", "2019-03-15", False),
          ("2019-13", "2019-01", False), ("2020", "PERPETUAL", False), ("2021", "UNSPECIFIED", False)]
BAD_EVIDENCE = [("parties", 1, 0, "too short", 9, 9), ("parties", 1, 1, "long enough quote here", 5, 900), ("parties", 1, 2, "long enough quote here", 5, 900)]


def test_rules(spark):
    cases = {"clean": (full(), CITED), "evidence": (full(), BAD_EVIDENCE), "none": ([], [])}
    cases |= {f"fires {i}": (full(**change), CITED) for i, (change, _) in enumerate(FIRING)}
    cases |= {f"known {v}": (full(governing_law=(True, v, None, 0.9)), CITED) for v in ("US-DE", "US-NY; GB-EAW", "UNSPECIFIED")}
    cases |= {f"order {a} {b}": (full(effective_date=(True, a, None, 0.9), expiration_date=(True, b, None, 0.9)), CITED) for a, b, _ in ORDERS}
    cases["absent"] = ({c: (False, None, None, 0.8) for c in TYPES}, [])
    cases["all"] = ({c: (True, None, None, i / 20) for i, c in enumerate(TYPES)}, [])
    cases["twice"] = ([("parties", (True, "x", None, 0.9)), ("parties", (False, None, None, 0.8))], [])
    got = violations_of(spark, cases)
    assert got["clean"] == []
    for i, (_, rule) in enumerate(FIRING):
        assert rule in ids(got[f"fires {i}"]), rule
    for name, found in got.items():
        if name.startswith("known"):
            assert "governing_law_unknown_jurisdiction" not in ids(found)
    for a, b, fires in ORDERS:
        assert ("effective_after_expiration" in ids(got[f"order {a} {b}"])) == fires, (a, b)
    assert {"nothing_extracted", "confidence_is_constant"} <= ids(got["absent"]) and got["absent"][0][1] == "error"
    assert "everything_present" in ids(got["all"])
    assert ("duplicate_clause_types", "error", "parties") in got["twice"] and "parties_absent" in ids(got["twice"])
    missing = next(v for v in got["twice"] if v[0] == "incomplete_clause_coverage")
    assert missing[2] == ",".join(sorted(set(TYPES) - {"parties"}))
    assert ids(got["none"]) == {"incomplete_clause_coverage"} and len(got["none"][0][2].split(",")) == 12
    assert {"evidence_too_short", "evidence_offsets_inverted", "evidence_outside_document", "evidence_duplicated"} <= ids(got["evidence"])


def test_registry_has_thirty_checks():
    rules = ru.registry()
    assert len(rules) == len({r.rule_id for r in rules}) == 30 and len({e[0] for r in rules for e in r.emits}) == 32


def test_review_reasons(spark):
    docs = spark.createDataFrame([("d",), ("ok",)], "document_id string")
    v = spark.createDataFrame([("d", "r", "error", ""), ("ok", "r", "warning", "")], "document_id string, rule_id string, severity string, clause_types string")
    c = spark.createDataFrame([("d", 0, "non_compete", True, None, None, 0.5), ("ok", 0, "parties", True, None, None, 0.1)], CLAUSE)
    runs = spark.createDataFrame([("d", True, 2, "boom")], "document_id string, stopped_on_budget boolean, ungrounded int, agent_error string")
    got = {r["document_id"]: r for r in ru.needs_review(docs, v, c, dims.clause_types(spark), runs).collect()}
    assert len(got["d"]["reasons"]) == 5 and not got["ok"]["needs_review"]


# statistics and intervals


def test_wilson(spark):
    rows = [(0, 0), (0, 10), (10, 10), (7, 20)]
    low, high = st.wilson("s", "n")
    for r in spark.createDataFrame(rows, "s long, n long").select("s", "n", low.alias("l"), high.alias("h")).collect():
        s, n, z = r["s"], r["n"], 1.96
        if n == 0:
            assert (r["l"], r["h"]) == (0, 1)
            continue
        p, mid = s / n, s / n + z * z / (2 * n)
        w = z * math.sqrt((p * (1 - p) + z * z / (4 * n)) / n)
        assert r["l"] == pytest.approx(max(0, (mid - w) / (1 + z * z / n))) and r["h"] == pytest.approx(min(1, (mid + w) / (1 + z * z / n)))


def test_intervals_against_sets(spark):
    rng = random.Random(1)
    draw = lambda: [(a, a + rng.randrange(0, 6)) for a in (rng.randrange(30) for _ in range(rng.randrange(5)))]
    rows = [(i, draw(), draw()) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, a array<struct<s:int,e:int>>, b array<struct<s:int,e:int>>")
    got = df.select("i", iv.covered(iv.merge(F.col("a"))).alias("n"), iv.intersection(iv.merge(F.col("a")), iv.merge(F.col("b"))).alias("x"), iv.span_f1(F.col("a"), F.col("b")).alias("f"), iv.overlap(F.col("a"), F.col("b")).alias("o")).collect()
    for r in got:
        a, b = ({x for s, e in rows[r["i"]][k] for x in range(s, e)} for k in (1, 2))
        assert (r["n"], r["x"], r["o"]) == (len(a), len(a & b), bool(a & b))
        want = 1.0 if not a and not b else 0.0 if not a & b else 2 * len(a & b) / (len(a) + len(b))
        assert r["f"] == pytest.approx(want)
    touching = spark.createDataFrame([([(5, 9), (0, 5), (3, 3)],)], "a array<struct<s:int,e:int>>")
    assert [tuple(x) for x in touching.select(iv.merge(F.col("a"))).first()[0]] == [(0, 9)]


def test_precision_at_recall(spark):
    kind = "k string, ordinal int, confidence double, actual boolean"
    run = lambda rows: [(r["precision"], r["threshold"]) for r in sc.precision_at_recall(spark.createDataFrame(rows, kind), ["k"], 0.8).collect()]
    assert run([("a", 0, 0.9, True), ("a", 1, 0.8, False), ("a", 2, 0.7, True)]) == [(2 / 3, 0.7)]
    assert run([("a", 0, 0.9, False)]) == []
    assert run([("a", 0, 0.5, True), ("a", 1, 0.5, False)]) == [(1.0, 0.5)]
    assert run([("a", 0, 0.5, False), ("a", 1, 0.5, True)]) == [(0.5, 0.5)]


def test_paired_scoring_excludes_incomplete(spark):
    types = dims.clause_types(spark)
    case = "case_id string, document_id string, clause_type string, present boolean, gold_spans array<struct<s:int,e:int>>, length_quartile int"
    cases = spark.createDataFrame([("1", "a", "parties", True, [(0, 5)], 1), ("2", "b", "parties", True, [(0, 5)], 1)], case)
    said = "arm string, document_id string, clause_type string, present boolean, evidence array<struct<s:int,e:int>>, confidence double"
    pred = spark.createDataFrame([("x", "a", "parties", True, [(9, 12)], 0.9), ("x", "b", "parties", True, [(2, 12)], 0.9), ("y", "a", "parties", True, [(1, 2)], 0.9)], said)
    runs = spark.createDataFrame([("x", "a", "completed", 1.0), ("x", "b", "completed", 1.0), ("y", "a", "completed", 2.0), ("y", "b", "incomplete_max_turns", 4.0)], "arm string, document_id string, status string, cost_usd double")
    got = {r["arm"]: r for r in sc.score_paired(cases, pred, runs, types).collect()}
    assert (got["x"]["fn"], got["x"]["tp"], got["x"]["cost_usd"]) == (1, 0, 2.0) and (got["y"]["tp"], got["y"]["cost_usd"]) == (1, 6.0)
    only = sc.score_rows(cases, pred.where("arm = 'x'"), types, spark.createDataFrame([], "document_id string"))
    assert only.count() == 0 and sc.score_rows(cases, pred.where("arm = 'x'"), types).count() == 2


def test_query_scores(spark):
    ranked = spark.createDataFrame([("a", 1, i, int(i in (2, 7))) for i in range(1, 9)], "arm string, query_id long, pos int, rel int")
    queries = spark.createDataFrame([("a", 1), ("a", 2)], "arm string, query_id long")
    got = {r["query_id"]: r for r in sc.query_scores(ranked, queries).collect()}
    assert got[1]["rr"] == 0.5 and got[1]["recall_5"] == 1 and got[1]["ndcg_5"] == pytest.approx(1 / math.log2(3) / (1 + 1 / math.log2(3)))
    assert got[2]["missed"] == 1 and got[2]["ndcg_10"] == 0
    assert sc.arm_scores(sc.query_scores(ranked, queries)).first()["misses"] == 1


def test_gate(spark):
    kind = "metric string, kind string, value double"
    now = spark.createDataFrame([("f1", "score", 0.70), ("mrr", "score", 0.69), ("rate", "rate", 0.02), ("new", "score", 0.0)], kind)
    then = spark.createDataFrame([("f1", "score", 0.71), ("mrr", "score", 0.80), ("rate", "rate", 0.0)], kind)
    assert {r["metric"]: r["passed"] for r in sc.gate(now, then).collect()} == {"f1": True, "mrr": False, "rate": False}


# sampling


def docs_of(spark, n):
    return spark.createDataFrame([(f"d{i:04d}", 100 + 10 * (i // 2)) for i in range(n)], "document_id string, size int")


def test_quartiles(spark):
    got = sa.length_quartiles(docs_of(spark, 100)).orderBy("document_id").collect()
    assert [r["length_quartile"] for r in got] == [1 + i // 25 for i in range(100)]


@pytest.mark.parametrize("n", [1, 7, 60, 100, 199])
def test_exact_sample_sizes(spark, n):
    rows = sa.length_quartiles(docs_of(spark, 200))
    a, b = (sa.stratified_sample(rows, n, 42) for _ in range(2))
    assert a.count() == n and sorted(a.collect()) == sorted(b.collect())


def test_split_is_disjoint_and_covers(spark):
    got = sa.build_split(docs_of(spark, 510)).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"dev": 60, "golden": 100, "reserve": 350}


def test_even_shares():
    assert sa.even_shares(10, [1, 100, 100]) == [1, 5, 4] and sa.even_shares(10, [2, 2]) == [2, 2] and sa.even_shares(0, [3]) == [0]


# operations


def test_costs_and_ledger(spark):
    kind = "model string, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long"
    rows = spark.createDataFrame([("m", 1_000_000, 100_000, None, 0), ("?", 5, 5, 5, 5)], kind)
    got = {r["model"]: r["cost_usd"] for r in op.with_cost(rows, op.price_table(spark, {"m": (2.0, 10.0, 0.2, 2.5)})).collect()}
    assert got == {"m": 3.0, "?": 0.0}
    asks = spark.createDataFrame([(1, 0, 20.0, 25.0), (1, 1, 5.0, 5.0), (1, 2, 0.0, 0.01)], "k long, i long, cost_usd double, worst_case double")
    assert [r["allowed"] for r in op.ledger_check(asks, 25.0, ["k"], "i").orderBy("i").collect()] == [True, True, False]


def test_null_latency_nulls_the_run(spark):
    rows = [(1, 1, 0.1, 5.0, 0), (1, 2, 0.1, None, 0), (2, 1, 0.1, 5.0, 1)]
    t = spark.createDataFrame(rows, "run_id long, turn long, cost_usd double, model_ms double, retries int")
    assert {r["run_id"]: r["latency_ms"] for r in op.run_totals(t).collect()} == {1: None, 2: 5.0}
    stops = {r["run_id"]: (r["turn"], r["stop_reason"]) for r in op.budget_stop(t, 2, 9.0, 1e9, 0).collect()}
    assert stops == {1: (2, "max_turns"), 2: (1, "max_retries")}


def test_status_of_runs(spark):
    rows = [("submitted", 0), ("end_turn", 0), ("end_turn", 3), ("max_turns", 3), ("odd", 0)]
    got = [r["status"] for r in op.run_status(spark.createDataFrame(rows, "stop_reason string, n_clauses int")).collect()]
    assert got == ["completed", "error", "completed", "incomplete_max_turns", "error"]


def test_first_resolution_is_final(spark):
    q = spark.createDataFrame([(1, "a", "open"), (2, "b", "open"), (3, "c", "accepted")], "id long, document_id string, status string")
    d = spark.createDataFrame([(1, "corrected", "r", None, None, 1, 0), (1, "accepted", "r", None, None, 2, 1), (1, "rejected", "r", None, None, 3, 2), (2, "corrected", "r", None, "fix", 1, 0), (3, "rejected", "r", None, None, 9, 0)],
                              "id long, resolution string, reviewer string, note string, correction string, decided_at long, seq int")
    assert {r["id"]: r["status"] for r in op.resolve(q, d).collect()} == {1: "accepted", 2: "corrected", 3: "accepted"}


def test_histogram(spark):
    v = spark.createDataFrame([("s", 0.5), ("s", 1.0), ("s", 7.0), ("s", None)], "stage string, x double")
    got = {r["le"]: r["cumulative"] for r in op.histogram(v, ["stage"], "x", [0.5, 1.0]).collect()}
    assert got == {"0.5": 1, "1": 2, "+Inf": 3}


def test_cache_key_is_canonical(spark):
    rows = spark.createDataFrame([('{"b": 1, "a": "é"}',), ('{"a":"é","b":1}',), (None,)], "request string")
    keys = [r["cache_key"] for r in op.cache_key(rows).collect()]
    assert keys[0] == keys[1] and len(keys[0]) == 64 and keys[2] is None


def test_baseline(spark):
    text = "Made as of the 7th day of September, 1999 by and between Acme Corporation and Beta Limited. Governed by the laws of the State of Delaware, always. March 3, 2001. Remain in force and effect until terminated."
    docs = spark.createDataFrame([("d", text), ("e", "between the parties hereto. governed by the laws of Nowhere,")], "document_id string, text string")
    got = {(r["document_id"], r["clause_type"]): r for r in bl.run_baseline(docs, dims.clause_types(spark)).collect()}
    assert len(got) == 24 and got[("d", "governing_law")]["value"] == "US-DE" and got[("d", "effective_date")]["value"] == "1999-09-07"
    assert got[("d", "parties")]["value"] == "Acme Corporation and Beta Limited" and got[("d", "expiration_date")]["value"] == "PERPETUAL"
    law = got[("d", "governing_law")]
    assert text[law["char_start"] : law["char_end"]].startswith("Governed by") and not any(r["present"] for (d, _), r in got.items() if d == "e")


# streams


def test_reindex_stream(spark, tmp_path):
    from lexigrain.sources import documents as src

    folder = tmp_path / "in"
    kind = "document_id string, text string"
    folder_uri, index = f"file://{folder}", f"file://{tmp_path}/index"
    for rows in ([("a", "one two"), ("b", "x")], [("a", "one two"), ("b", "changed now")]):
        spark.createDataFrame(rows, kind).write.mode("append").parquet(folder_uri)
        s = incremental.reindex_stream(spark.readStream.schema(kind).parquet(folder_uri), index, f"{tmp_path}/cp")
        s.processAllAvailable()
        s.stop()
    assert sorted(r["text"] for r in src.current(spark, index, "chunks").collect()) == ["changed now", "one two"]


def test_budget_stream(spark, tmp_path):
    rows = [(1, i, 0.4) for i in range(1, 6)] + [(2, 1, 0.1)]
    spark.createDataFrame(rows, "run_id long, turn long, cost_usd double").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("run_id long, turn long, cost_usd double").parquet(f"{tmp_path}/in")
    q = incremental.budget_stops(stream, 10, 1.0).writeStream.format("memory").queryName("stops").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("stops").collect()] == [(1, 3, "max_cost")]
