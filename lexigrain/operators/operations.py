"""Costs, budgets, replayed agent runs, the review queue and service aggregates."""

from __future__ import annotations

import difflib
import hashlib
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrain import dims
from lexigrain.functions import stats as st
from lexigrain.functions import text as tx

COUNTERS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")
STOP_STATUS = {
    "submitted": "completed", "max_turns": "incomplete_max_turns", "max_cost": "incomplete_max_cost", "timeout": "incomplete_timeout",
    "max_retries": "incomplete_max_retries", "api_error": "error", "refusal": "error", "end_turn": "error",
}


def price_table(spark: SparkSession, prices: dict[str, tuple[float, float, float, float]] = dims.PRICES) -> DataFrame:
    return spark.createDataFrame([(m, *p) for m, p in prices.items()], "model string, p_in double, p_out double, p_read double, p_write double")


def with_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds cost_usd to model and the four counters; null counters and unknown models cost nothing."""
    joined = usage.join(F.broadcast(prices), "model", "left")
    parts = [F.coalesce(F.col(c), F.lit(0)) * F.col(p) for c, p in zip(COUNTERS, ("p_in", "p_out", "p_read", "p_write"), strict=True)]
    cost = (parts[0] + parts[1] + parts[2] + parts[3]) / 1_000_000
    return joined.withColumn("cost_usd", F.coalesce(cost, F.lit(0.0))).drop("p_in", "p_out", "p_read", "p_write")


def total_usage(usage: DataFrame, keys: list[str]) -> DataFrame:
    """Field-wise sums of the counters and the cost."""
    return usage.groupBy(*keys).agg(*[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in COUNTERS], F.sum("cost_usd").alias("cost_usd"))


def strict_sum(column: str) -> Column:
    """The sum, null as soon as one value is missing."""
    return F.when(F.count("*") == F.count(column), F.sum(column))


def ledger_entries(events: DataFrame) -> DataFrame:
    """Entries that cost something."""
    return events.where("cost_usd > 0")


def ledger_balance(entries: DataFrame, cap: float = 25.0) -> DataFrame:
    spent = F.coalesce(F.sum("cost_usd"), F.lit(0.0))
    return entries.agg(spent.alias("spent"), F.greatest(F.lit(0.0), F.lit(cap) - spent).alias("remaining"), F.count("*").alias("entries"))


def ledger_check(requests: DataFrame, cap: float, keys: list[str], order: str) -> DataFrame:
    """Adds spent_before and allowed: a worst case over the rest is refused."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum("cost_usd").over(before), F.lit(0.0))
    return requests.withColumn("spent_before", spent).withColumn("allowed", F.col("worst_case") <= F.lit(cap) - F.col("spent_before") + 1e-9)


def budget_stop(turns: DataFrame, max_turns: int, max_cost: float, max_ms: float, max_retries: int) -> DataFrame:
    """(run_id, turn, stop_reason): the first turn at which a run must stop.

    turns: run_id, turn, cost_usd, model_ms, retries.  Limits are looked at in
    the order turns, cost, time, retries.
    """
    upto = Window.partitionBy("run_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    cost, ms, retries = (F.sum(F.coalesce(F.col(c), F.lit(0))).over(upto) for c in ("cost_usd", "model_ms", "retries"))
    n = F.count("*").over(upto)
    reason = F.when(n >= max_turns, "max_turns").when(cost >= max_cost, "max_cost").when(ms >= max_ms, "timeout").when(retries > max_retries, "max_retries")
    found = turns.select("run_id", "turn", reason.alias("stop_reason")).where("stop_reason is not null")
    return found.groupBy("run_id").agg(F.min("turn").alias("turn"), F.min_by("stop_reason", "turn").alias("stop_reason"))


def run_status(runs: DataFrame) -> DataFrame:
    """Adds status: the stop reason's, but an error with clauses is a completion."""
    known = F.create_map(*[F.lit(x) for kv in STOP_STATUS.items() for x in kv])
    base = F.coalesce(F.try_element_at(known, F.col("stop_reason")), F.lit("error"))
    return runs.withColumn("status", F.when((base == "error") & (F.col("n_clauses") > 0), "completed").otherwise(base))


def run_totals(turns: DataFrame) -> DataFrame:
    """Per run: turns, cost, retries and latency, which is null if any turn's is."""
    return turns.groupBy("run_id").agg(F.count("*").alias("turns"), F.sum("cost_usd").alias("cost_usd"), F.sum("retries").alias("retries"), strict_sum("model_ms").alias("latency_ms"))


def tool_use(calls: DataFrame) -> DataFrame:
    return calls.groupBy("tool").agg(F.count("*").alias("calls"), F.count_if("is_error").alias("errors"))


def cache_stats(lookups: DataFrame, keys: list[str]) -> DataFrame:
    hits, n = F.count_if("hit"), F.count("*")
    return lookups.groupBy(*keys).agg(hits.alias("hits"), (n - hits).alias("misses"), st.ratio(hits, n).alias("hit_rate"))


def preflight(checks: list[tuple[str, DataFrame]]) -> DataFrame:
    """(ordinal, name, passed, detail): a check passes if its frame has no rows."""
    out = None
    for i, (name, offending) in enumerate(checks):
        n = offending.agg(F.count("*").alias("n"))
        row = n.select(F.lit(i).alias("ordinal"), F.lit(name).alias("name"), (F.col("n") == 0).alias("passed"), F.col("n").alias("offending"))
        out = row if out is None else out.unionByName(row)
    return out


CANARY = "the of and"


def run_preflight(cases: DataFrame, indexed: DataFrame, chunks: DataFrame, members: DataFrame, config: DataFrame, recorded: str, entries: DataFrame, canary: str = CANARY) -> DataFrame:
    """(ordinal, name, passed, offending): what must hold before an evaluation run.

    cases, indexed, members: document_id; chunks: document_id, text, embedding;
    config: name, value, which ``recorded`` must contain; entries: latency_ms.
    Recorded responses without a latency are counted, but fail nothing.
    """
    wanted = cases.select("document_id").distinct()
    own = chunks.join(wanted, "document_id", "left_semi")
    first = wanted.agg(F.min("document_id").alias("document_id")).where("document_id is not null")
    asked = F.array(*[F.lit(w) for w in dict.fromkeys(re.findall("[a-z0-9]+", canary.lower()))])
    answers = own.where(F.arrays_overlap(tx.query_terms("text"), asked))
    found = preflight([
        ("index covers case set", wanted.join(indexed, "document_id", "left_anti")),
        ("every document has chunks", wanted.join(chunks, "document_id", "left_anti")),
        ("chunks are embedded", own.where("embedding is null")),
        ("retrieval canary", first.join(answers, "document_id", "left_anti")),
        ("split membership", wanted.join(members, "document_id", "left_anti")),
        ("frozen config recorded", config.where(~F.contains(F.lit(recorded), F.col("value").cast("string")))),
        ("latency stored at capture", entries.where("latency_ms is null")),
    ])
    return found.withColumn("passed", F.col("passed") | (F.col("name") == "latency stored at capture"))


def canonical_json(value) -> str:
    """Sorted keys, no spaces, ASCII."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def cache_key(requests: DataFrame, column: str = "request") -> DataFrame:
    """Adds cache_key: SHA-256 of the canonical form of a JSON request."""

    @F.pandas_udf("string")
    def key(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else hashlib.sha256(canonical_json(json.loads(t)).encode()).hexdigest())

    return requests.withColumn("cache_key", key(column))


def prompt_version(prompt: Column, tools: Column) -> Column:
    """First 12 hexadecimal digits of the SHA-256 of both texts."""
    return F.substring(F.sha2(F.concat(prompt, tools), 256), 1, 12)


def replay(entries: DataFrame) -> DataFrame:
    """One row per cached response: usage split, stop reason, tool calls, latency or null."""
    r, u = F.col("response"), F.col("response.usage")
    zero = lambda c: F.coalesce(u[c], F.lit(0)).cast("long")
    calls = F.filter(r["content"], lambda x: x["type"] == "tool_use")
    return entries.select(
        "key", r["model"].alias("model"), r["stop_reason"].alias("stop_reason"), zero("input_tokens").alias("input_tokens"),
        zero("output_tokens").alias("output_tokens"), zero("cache_read_input_tokens").alias("cache_read_tokens"),
        zero("cache_creation_input_tokens").alias("cache_write_tokens"), F.size(calls).cast("long").alias("tool_calls"),
        F.transform(calls, lambda x: x["name"]).alias("tools"), F.col("meta.latency_ms").alias("latency_ms"),
    )


# review queue


def enqueue(queue: DataFrame, items: DataFrame, order: list[str], ranges: int = 256) -> DataFrame:
    """``queue`` with ``items`` behind it, numbered from the largest id on in ``order``.

    Items are dealt to ranges of the first ``order`` column, cut at quantiles;
    a range is numbered by itself behind the count of the ranges before it.
    """
    base = queue.agg(F.coalesce(F.max("id"), F.lit(0)).alias("base"))
    number = {"timestamp": F.unix_micros, "timestamp_ntz": lambda c: F.unix_micros(c.cast("timestamp")), "date": F.unix_date}
    kind = dict(items.dtypes)[order[0]]
    if kind not in number and kind not in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        at = F.lit(0)  # no quantiles of texts: one range
    else:
        key = number.get(kind, lambda c: c)(F.col(order[0]))
        cuts = items.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 10_000)).first()[0] or []
        edges = F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
        at = F.when(key.isNull(), -1).otherwise(F.size(F.filter(edges, lambda e: e < key)))
    dealt = items.withColumn("_range", at)
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_c"))  # one row a range
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_range", before.alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    new = dealt.withColumn("_n", own).join(F.broadcast(sizes), "_range").join(F.broadcast(base))
    new = new.withColumn("id", (F.col("base") + F.col("_before") + F.col("_n")).cast("long")).withColumn("status", F.lit("open"))
    return queue.unionByName(new.drop("_n", "_before", "_range", "base"), allowMissingColumns=True)


def queue_items(queue: DataFrame, status: str | None = "open", limit: int = 50) -> DataFrame:
    """The oldest items first."""
    rows = queue if status is None else queue.where(F.col("status") == status)
    return rows.orderBy("created_at", "id").limit(limit)


def resolve(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """Applies the first valid decision of each open item; later ones change nothing.

    decisions: id, resolution, reviewer, note, correction, decided_at, seq.  A
    correction is given exactly if the resolution is 'corrected'.
    """
    valid = F.col("resolution").isin("accepted", "rejected", "corrected") & ((F.col("resolution") == "corrected") == F.col("correction").isNotNull())
    order = Window.partitionBy("id").orderBy("decided_at", "seq")
    first = decisions.where(valid).withColumn("_n", F.row_number().over(order)).where("_n = 1")
    joined = queue.alias("q").join(first.alias("d"), "id", "left")
    take = (F.col("q.status") == "open") & F.col("d.resolution").isNotNull()
    return joined.select(
        "id", "q.document_id", F.when(take, F.col("d.resolution")).otherwise(F.col("q.status")).alias("status"),
        F.when(take, F.col("d.reviewer")).alias("reviewer"), F.when(take, F.col("d.correction")).alias("correction"),
        F.when(take, F.col("d.decided_at")).alias("resolved_at"),
    )


def queue_violations(queue: DataFrame) -> DataFrame:
    """Items that break a constraint; must be empty."""
    status = F.col("status")
    bad = ~status.isin("open", "accepted", "corrected", "rejected") | ((status == "open") & F.col("resolved_at").isNotNull())
    bad = bad | ((status != "open") & F.col("resolved_at").isNull()) | ((status == "corrected") != F.col("correction").isNotNull())
    return queue.where(bad).select("id", "status")


# service aggregates


def histogram(values: DataFrame, keys: list[str], column: str, bounds: list[float]) -> DataFrame:
    """Cumulative buckets (le), +Inf last, with the sum and the count per key."""
    counts = [F.count_if(F.col(column) <= b).alias(f"_b{i}") for i, b in enumerate(bounds)]
    n = F.count(column)
    per = values.groupBy(*keys).agg(*counts, n.alias("n"), F.sum(column).alias("total"))
    rows = [F.struct(F.lit(f"{b:g}").alias("le"), F.col(f"_b{i}").alias("cumulative")) for i, b in enumerate(bounds)]
    rows.append(F.struct(F.lit("+Inf").alias("le"), F.col("n").alias("cumulative")))
    return per.select(*keys, F.explode(F.array(*rows)).alias("b"), "n", "total").select(*keys, "b.le", "b.cumulative", "n", "total")


def counters(values: DataFrame, labels: list[str]) -> DataFrame:
    return values.groupBy(*labels).agg(F.count("*").alias("count"))


def job_status(results: DataFrame) -> DataFrame:
    """Per job: failed if any document failed, and how many did."""
    bad = F.count_if(F.col("error").isNotNull())
    return results.groupBy("job_id").agg(
        F.count("*").alias("documents"), bad.alias("failed"), F.when(bad > 0, "failed").otherwise("completed").alias("status"))


# traces


def similar(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio()


def reject_near_duplicates(queries: DataFrame, at_least: float = 0.90) -> DataFrame:
    """(run_id, seq, query, accepted): a query much like an accepted earlier one of its run is rejected.

    A run's queries are judged one after the other, each against the accepted ones.
    """

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, kept, flags = pdf.sort_values("seq"), [], []
        for q in pdf["query"]:
            ok = q is not None and all(similar(q, k) < at_least for k in kept)
            flags.append(ok)
            if ok:
                kept.append(q)
        return pdf.assign(accepted=flags)

    rows = queries.select("run_id", "seq", "query")
    return rows.groupBy("run_id").applyInPandas(judge, "run_id long, seq long, query string, accepted boolean")


def near_duplicate_trace(queries: DataFrame, at_least: float = 0.80) -> DataFrame:
    """(run_id, seq, near_duplicate): against all earlier queries of the run."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similar(x, y) for x, y in zip(a, b, strict=True)])

    q = queries.select("run_id", "seq", "query").where("query is not null")
    pairs = q.alias("a").join(q.alias("b"), (F.col("a.run_id") == F.col("b.run_id")) & (F.col("b.seq") < F.col("a.seq")))
    near = pairs.withColumn("r", ratio("b.query", "a.query")).where(F.col("r") >= at_least).select(F.col("a.run_id"), F.col("a.seq")).distinct()
    return q.join(near.withColumn("near_duplicate", F.lit(True)), ["run_id", "seq"], "left").select("run_id", "seq", F.coalesce("near_duplicate", F.lit(False)).alias("near_duplicate"))


def overlapping_reads(reads: DataFrame) -> DataFrame:
    """(run_id, seq, overlaps): how many earlier reads of the run share a position."""
    r = reads.select("run_id", "seq", "char_start", "char_end")
    shared = F.least(F.col("a.char_end"), F.col("b.char_end")) > F.greatest(F.col("a.char_start"), F.col("b.char_start"))
    pairs = r.alias("a").join(r.alias("b"), (F.col("a.run_id") == F.col("b.run_id")) & (F.col("b.seq") < F.col("a.seq")) & shared, "left")
    return pairs.groupBy(F.col("a.run_id"), F.col("a.seq")).agg(F.count(F.col("b.seq")).alias("overlaps"))


def targeted_clauses(queries: DataFrame, keywords: dict[str, str]) -> DataFrame:
    """(run_id, seq, clause_types): types whose keyword pattern the query matches, in the order given."""
    hits = F.array_compact(F.array(*[F.when(F.lower("query").rlike(p), F.lit(c)) for c, p in keywords.items()]))
    return queries.select("run_id", "seq", F.array_join(hits, ",").alias("clause_types"))
