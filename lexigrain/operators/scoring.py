"""Scores of predictions against gold cases, retrieval ablation, paired runs and the gate.

cases: case_id, document_id, clause_type, present, gold_spans, length_quartile.
predictions: arm, document_id, clause_type, present, evidence (spans), confidence.
runs: arm, document_id, status, cost_usd, latency_ms, retries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrain.functions import intervals as iv
from lexigrain.functions import stats as st

K_VALUES = (5, 10, 20)
GATE_DROP, GATE_RATE = 0.02, 0.01


def score_rows(cases: DataFrame, predictions: DataFrame, types: DataFrame, scoreable: DataFrame | None = None) -> DataFrame:
    """One row per scored case: what counts as predicted, and span F1 of positives.

    A positive case counts as found only with the flag and an overlapping span;
    a negative one as claimed with the flag alone.  scoreable: (document_id) of
    completed runs; others are left out, not scored as absent.
    """
    order = Window.partitionBy("document_id", "clause_type").orderBy(F.desc("seq")) if "seq" in predictions.columns else None
    p = predictions if order is None else predictions.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    p = p.select("document_id", "clause_type", F.col("present").alias("said"), F.col("evidence").alias("spans"), "confidence")
    kept = cases if scoreable is None else cases.join(scoreable.select("document_id").distinct(), "document_id", "left_semi")
    joined = kept.join(p, ["document_id", "clause_type"], "left").join(F.broadcast(types.select("clause_type", "tier")), "clause_type")
    none = F.array().cast("array<struct<s:int,e:int>>")
    spans, said = F.coalesce("spans", none), F.coalesce("said", F.lit(False))
    hit = said & (iv.overlap(spans, F.col("gold_spans")) | (F.size("gold_spans") == 0))
    return joined.select(
        "case_id", "document_id", "clause_type", "tier", "length_quartile", "present",
        F.when(F.col("present"), hit).otherwise(said).alias("predicted"),
        F.when(F.col("present"), iv.span_f1(spans, F.col("gold_spans"))).alias("span_f1"),
        "confidence", F.col("said").isNotNull().alias("has_prediction"),
    )


def presence(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Confusion counts and rates of (predicted, present) per key."""
    counted = rows.groupBy(*keys).agg(*st.confusion(F.col("predicted"), F.col("present")))
    return counted.select(*keys, "tp", "fp", "tn", "fn", *[c.alias(n) for n, c in st.rates().items()])


def presence_slices(rows: DataFrame) -> DataFrame:
    """Overall, by clause type, by tier and by length quartile, in one pass."""
    sets = [[], ["clause_type"], ["tier"], ["length_quartile"]]
    counted = rows.groupingSets(sets, "clause_type", "tier", "length_quartile").agg(
        *st.confusion(F.col("predicted"), F.col("present")), F.avg("span_f1").alias("span_f1"))
    return counted.select("clause_type", "tier", "length_quartile", "tp", "fp", "tn", "fn", "span_f1", *[c.alias(n) for n, c in st.rates().items()])


def precision_at_recall(scored: DataFrame, keys: list[str], target: float = 0.80) -> DataFrame:
    """Best precision at a recall of at least ``target``: (keys, precision, threshold).

    scored: keys, confidence, actual, ordinal.  The threshold falls row by row
    (ties in input order); the first best point wins; unreachable keys are absent.
    """
    positives = scored.groupBy(*keys).agg(F.sum(F.col("actual").cast("int")).alias("positives"))
    # counts by confidence tell which confidences can matter; only their rows are ranked one by one
    by_value = scored.groupBy(*keys, "confidence").agg(F.count("*").alias("rows"), F.sum(F.col("actual").cast("int")).alias("hits"))
    before = Window.partitionBy(*keys).orderBy(F.desc("confidence")).rowsBetween(Window.unboundedPreceding, -1)
    by_value = by_value.withColumns({"rows_before": F.coalesce(F.sum("rows").over(before), F.lit(0)), "hits_before": F.coalesce(F.sum("hits").over(before), F.lit(0))})
    by_value = by_value.join(positives.where("positives > 0"), [*keys])
    can_reach = by_value.where((F.col("hits_before") + F.col("hits")) / F.col("positives") >= target)
    tied = scored.join(can_reach.drop("rows", "hits"), [*keys, "confidence"])
    within = Window.partitionBy(*keys, "confidence").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    swept = tied.select(*keys, "confidence", "positives", (F.col("rows_before") + F.count("*").over(within)).alias("n"),
                        (F.col("hits_before") + F.sum(F.col("actual").cast("int")).over(within)).alias("tp"))
    reached = swept.where(F.col("tp") / F.col("positives") >= target)
    best = F.max_by(F.struct("n", "confidence"), F.struct(F.col("tp") / F.col("n"), -F.col("n")))
    found = reached.groupBy(*keys).agg(F.max(F.col("tp") / F.col("n")).alias("precision"), best.alias("b"))
    return found.select(*keys, "precision", F.col("b.confidence").alias("threshold"))


def summary(values: DataFrame, keys: list[str], column: str) -> DataFrame:
    """n, mean, total, nearest-rank p50 and p95 of a column; nulls are not values."""
    at = lambda q: F.coalesce(F.expr(f"percentile_disc({q}) within group (order by `{column}`)").cast("double"), F.lit(0.0))
    mean, total = F.coalesce(F.avg(column), F.lit(0.0)), F.coalesce(F.sum(column), F.lit(0.0))
    return values.groupBy(*keys).agg(
        F.count(column).alias("n"), mean.alias("mean"), total.alias("total"), at(0.5).alias("p50"), at(0.95).alias("p95"))


def within_budget(runs: DataFrame, budget: Column | float, keys: list[str], order: str) -> DataFrame:
    """Runs that start while less than ``budget`` has been spent on the earlier ones."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum("cost_usd").over(before), F.lit(0.0))
    return runs.withColumn("spent_before", spent).where(F.col("spent_before") < budget)


def completed_everywhere(runs: DataFrame, status: str = "completed") -> DataFrame:
    """(document_id) of documents that every arm completed."""
    arms = runs.agg(F.countDistinct("arm").alias("n_arms"))
    done = runs.groupBy("document_id").agg(F.countDistinct(F.when(F.col("status") == status, F.col("arm"))).alias("done"))
    return done.join(F.broadcast(arms)).where("done = n_arms").select("document_id")


def score_paired(cases: DataFrame, predictions: DataFrame, runs: DataFrame, types: DataFrame) -> DataFrame:
    """Quality per arm on the documents that all arms completed, costs over all runs."""
    paired = completed_everywhere(runs)
    arms = runs.select("arm").distinct()
    per_arm = cases.join(paired, "document_id", "left_semi").join(F.broadcast(arms))
    keyed = predictions.select("arm", "document_id", "clause_type", F.col("present").alias("said"), F.col("evidence").alias("spans"))
    joined = per_arm.join(keyed, ["arm", "document_id", "clause_type"], "left")
    none = F.array().cast("array<struct<s:int,e:int>>")
    spans, said = F.coalesce("spans", none), F.coalesce("said", F.lit(False))
    hit = said & (iv.overlap(spans, F.col("gold_spans")) | (F.size("gold_spans") == 0))
    rows = joined.select("arm", "document_id", "present", F.when(F.col("present"), hit).otherwise(said).alias("predicted"))
    quality = presence(rows, ["arm"]).select("arm", "tp", "fp", "tn", "fn", "precision", "recall", "f1")
    pairs = rows.groupBy("arm").agg(F.countDistinct("document_id").alias("paired_documents"))
    cost = runs.groupBy("arm").agg(F.count("*").alias("runs"), F.sum("cost_usd").alias("cost_usd"), F.count_if(F.col("status") == "completed").alias("completed"))
    return cost.join(quality, "arm", "left").join(pairs, "arm", "left")


def gate(current: DataFrame, frozen: DataFrame, drop: float = GATE_DROP, rate: float = GATE_RATE) -> DataFrame:
    """(metric, frozen, current, passed): scores may fall by ``drop``, rates may reach ``rate``.

    Both frames: metric, kind ('score' or 'rate'), value.  Metrics without a
    frozen value are not checked.
    """
    joined = current.alias("c").join(frozen.alias("f"), "metric").select("metric", F.col("c.kind").alias("kind"), F.col("f.value").alias("frozen"), F.col("c.value").alias("current"))
    ok = F.when(F.col("kind") == "rate", F.col("current") <= rate).otherwise(F.col("frozen") - F.col("current") <= drop)
    return joined.select("metric", "frozen", "current", ok.alias("passed"))


def relevance(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """Adds rel: 1 if the hit's span overlaps a gold span of its (document, query)."""
    g = gold.select("query_id", "document_id", F.col("s").alias("gs"), F.col("e").alias("ge"))
    touching = (F.least(F.col("char_end"), F.col("ge")) - F.greatest(F.col("char_start"), F.col("gs"))) > 0
    found = hits.join(g, ["query_id", "document_id"]).where(touching).select(*hits.columns).distinct().withColumn("rel", F.lit(1))
    return hits.join(found.select("arm", "query_id", "pos", "rel"), ["arm", "query_id", "pos"], "left").fillna(0, ["rel"])


def query_scores(ranked: DataFrame, queries: DataFrame) -> DataFrame:
    """Per (arm, query): hit@k, reciprocal rank, nDCG@k and misses.

    ranked: arm, query_id, pos (from 1), rel.  queries: arm, query_id; queries
    without hits are misses.  The ideal ranking holds the relevant hits that
    were retrieved.
    """
    aggs = [F.sum("rel").alias("n_rel"), F.min(F.when(F.col("rel") == 1, F.col("pos"))).alias("first")]
    for k in K_VALUES:
        in_k = F.when(F.col("pos") <= k, F.col("rel")).otherwise(0)
        aggs.append(F.sum(in_k / F.log2(F.col("pos") + 1.0)).alias(f"dcg_{k}"))
    per = queries.join(ranked.groupBy("arm", "query_id").agg(*aggs), ["arm", "query_id"], "left").fillna(0, ["n_rel"])
    out = [F.col("arm"), F.col("query_id"), (F.col("n_rel") == 0).cast("long").alias("missed"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr")]
    for k in K_VALUES:
        n = F.least(F.col("n_rel"), F.lit(k)).cast("int")
        ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
        out.append(F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0)).alias(f"recall_{k}"))
        out.append(F.when(n == 0, 0.0).otherwise(F.col(f"dcg_{k}") / ideal).alias(f"ndcg_{k}"))
    return per.select(*out)


def arm_scores(scores: DataFrame, latencies: DataFrame | None = None) -> DataFrame:
    """Means per arm; with latencies (arm, latency_ms) their p50, p95 and total."""
    means = [F.avg(f"{m}_{k}").alias(f"{m}_{k}") for m in ("recall", "ndcg") for k in K_VALUES]
    out = scores.groupBy("arm").agg(F.count("*").alias("queries"), F.sum("missed").alias("misses"), F.avg("rr").alias("mrr"), *means)
    return out if latencies is None else out.join(latency_scores(latencies), "arm", "left")


def latency_scores(latencies: DataFrame) -> DataFrame:
    """Interpolated median, the value at index int(0.95 n), and the total in seconds.

    The index is looked up among counts by value, which aggregate per task.
    """
    per_arm = latencies.groupBy("arm").agg(F.median("latency_ms").alias("latency_p50"), F.count("latency_ms").alias("n"), (F.sum("latency_ms") / 1000).alias("total_s"))
    counts = latencies.where("latency_ms is not null").groupBy("arm", "latency_ms").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("arm").orderBy("latency_ms"))
    rank = F.least(F.col("n") - 1, F.floor(F.lit(0.95) * F.col("n"))) + 1
    reached = counts.withColumn("upto", upto).join(F.broadcast(per_arm.select("arm", "n")), "arm").where(F.col("upto") >= rank)
    p95 = reached.groupBy("arm").agg(F.min("latency_ms").alias("latency_p95"))
    return per_arm.join(p95, "arm", "left").select("arm", "latency_p50", "latency_p95", "total_s")
