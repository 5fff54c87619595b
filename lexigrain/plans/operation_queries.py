"""Costs, budgets, replay, review queue and service aggregates over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrain import dims
from lexigrain.operators import operations as op
from lexigrain.plans.registry import Inputs, query
from lexigrain.sources import documents as src

USAGE = """usage AS (SELECT event_id, user_id, CASE event_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'unknown' END AS model, event_id % 1000 AS input_tokens,
    event_id % 300 AS output_tokens, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 70 END AS cache_read_tokens, event_id % 11 AS cache_write_tokens FROM {events})"""
PRICED = f"""{USAGE}, priced AS (SELECT *, CASE model WHEN 'a' THEN (input_tokens * 2.0::double + output_tokens * 10.0::double + coalesce(cache_read_tokens, 0) * 0.2::double + cache_write_tokens * 2.5::double) / 1000000
    WHEN 'b' THEN (input_tokens * 1.0::double + output_tokens * 5.0::double + coalesce(cache_read_tokens, 0) * 0.1::double + cache_write_tokens * 1.25::double) / 1000000 ELSE 0 END AS cost_usd FROM usage)"""


def _usage(t: Inputs):
    e = F.col("event_id")
    model = F.when(e % 3 == 0, "a").when(e % 3 == 1, "b").otherwise("unknown")
    rows = t.events.select("event_id", "user_id", model.alias("model"), (e % 1000).alias("input_tokens"), (e % 300).alias("output_tokens"),
                           F.when(e % 5 != 0, e % 70).alias("cache_read_tokens"), (e % 11).alias("cache_write_tokens"))
    return op.with_cost(rows, op.price_table(t.spark, {"a": (2.0, 10.0, 0.2, 2.5), "b": (1.0, 5.0, 0.1, 1.25)}))


@query("A29_compute_cost", f"WITH {PRICED} SELECT event_id, round(cost_usd, 12) AS cost_usd FROM priced")
def _(t: Inputs):
    return _usage(t).select("event_id", F.round("cost_usd", 12).alias("cost_usd"))


@query("A29_token_usage", f"""
    WITH {PRICED} SELECT user_id, cast(sum(input_tokens) AS bigint) AS input_tokens, cast(sum(output_tokens) AS bigint) AS output_tokens,
        cast(coalesce(sum(cache_read_tokens), 0) AS bigint) AS cache_read_tokens, cast(sum(cache_write_tokens) AS bigint) AS cache_write_tokens, round(sum(cost_usd), 9) AS cost_usd FROM priced GROUP BY 1""")
def _(t: Inputs):
    return op.total_usage(_usage(t), ["user_id"]).withColumn("cost_usd", F.round("cost_usd", 9))


@query("A30_ledger_balance", "SELECT sum(cost_usd) AS spent, greatest(0, 25 - sum(cost_usd)) AS remaining, count(*) AS entries FROM {turns} WHERE cost_usd > 0")
def _(t: Inputs):
    return op.ledger_balance(op.ledger_entries(t.turns))


@query("A30_ledger_check", """
    SELECT run_id, turn, spent_before, model_ms / 100 <= 25 - spent_before + 1e-9 AS allowed FROM (
        SELECT *, coalesce(sum(cost_usd) OVER (PARTITION BY run_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent_before FROM {turns})""")
def _(t: Inputs):
    r = t.turns.withColumn("worst_case", F.col("model_ms") / 100)
    return op.ledger_check(r, 25.0, ["run_id"], "turn").select("run_id", "turn", "spent_before", "allowed")


@query("A31_budget_stop", """
    WITH w AS (SELECT run_id, turn, sum(cost_usd) OVER o AS c, sum(coalesce(model_ms, 0)) OVER o AS ms, sum(retries) OVER o AS r FROM {turns} WINDOW o AS (PARTITION BY run_id ORDER BY turn ROWS UNBOUNDED PRECEDING)),
    s AS (SELECT run_id, turn, CASE WHEN turn >= 12 THEN 'max_turns' WHEN c >= 3 THEN 'max_cost' WHEN ms >= 2000 THEN 'timeout' WHEN r > 1 THEN 'max_retries' END AS stop_reason FROM w)
    SELECT run_id, min(turn) AS turn, arg_min(stop_reason, turn) AS stop_reason FROM s WHERE stop_reason IS NOT NULL GROUP BY 1""")
def _(t: Inputs):
    return op.budget_stop(t.turns, 12, 3.0, 2000.0, 1).select("run_id", F.col("turn").cast("long").alias("turn"), "stop_reason")


@query("A32_cache_stats", """
    SELECT event_type, count(*) FILTER (WHERE event_id % 3 = 0) AS hits, count(*) FILTER (WHERE event_id % 3 <> 0) AS misses, count(*) FILTER (WHERE event_id % 3 = 0)::double / count(*) AS hit_rate FROM {events} GROUP BY 1""")
def _(t: Inputs):
    entries = t.events.where("event_id % 3 = 0").select(F.col("event_id").cast("string").alias("key"))
    looked = src.lookup_cache(t.events.select(F.col("event_id").cast("string").alias("key"), "event_type"), entries)
    return op.cache_stats(looked, ["event_type"])


@query("A33_tool_use", "SELECT event_type AS tool, count(*) AS calls FROM {events} GROUP BY 1")
def _(t: Inputs):
    return op.tool_use(t.events.select(F.col("event_type").alias("tool"), F.lit(False).alias("is_error"))).select("tool", "calls")


@query("A34_preflight", """
    SELECT * FROM (VALUES (0, 'documents have text'), (1, 'embeddings are not null'), (2, 'labels name documents'), (3, 'documents are labelled')) v(ordinal, name)
    JOIN LATERAL (SELECT n = 0 AS passed, n AS offending FROM (SELECT CASE v.ordinal WHEN 0 THEN (SELECT count(*) FROM {docs} WHERE text IS NULL) WHEN 1 THEN (SELECT count(*) FROM {embeddings} WHERE embedding IS NULL)
        WHEN 2 THEN (SELECT count(*) FROM {labels} WHERE doc_id NOT IN (SELECT doc_id FROM {docs})) ELSE (SELECT count(*) FROM {docs} WHERE doc_id NOT IN (SELECT doc_id FROM {labels})) END AS n)) ON true""")
def _(t: Inputs):
    return op.preflight([
        ("documents have text", t.docs.where("text is null")),
        ("embeddings are not null", t.embeddings.where("embedding is null")),
        ("labels name documents", t.labels.join(t.docs, "doc_id", "left_anti")),
        ("documents are labelled", t.docs.join(t.labels, "doc_id", "left_anti")),
    ])


@query("A34_run_preflight", """
    WITH wanted AS (SELECT * FROM {docs} WHERE doc_id % 5 = 0), indexed AS (SELECT * FROM {docs} WHERE doc_id % 35 <> 0), ch AS (SELECT * FROM indexed WHERE text <> '' AND doc_id % 45 <> 0),
    n AS (SELECT 0 AS ordinal, 'index covers case set' AS name, count(*) AS offending FROM wanted WHERE doc_id NOT IN (SELECT doc_id FROM indexed)
    UNION ALL SELECT 1, 'every document has chunks', count(*) FROM wanted WHERE doc_id NOT IN (SELECT doc_id FROM ch)
    UNION ALL SELECT 2, 'chunks are embedded', count(*) FROM ch WHERE doc_id % 5 = 0 AND doc_id % 55 = 0
    UNION ALL SELECT 3, 'retrieval canary', count(*) FROM (SELECT min(document_id) AS document_id FROM wanted) WHERE document_id NOT IN
        (SELECT document_id FROM ch WHERE list_has_any(regexp_extract_all(lower(text), '[a-z0-9]+'), ['the', 'of', 'and']))
    UNION ALL SELECT 4, 'split membership', count(*) FROM wanted WHERE doc_id % 10 = 5
    UNION ALL SELECT 5, 'frozen config recorded', 1
    UNION ALL SELECT 6, 'latency stored at capture', count(*) FROM {events} WHERE event_id % 4 = 0)
    SELECT *, offending = 0 OR ordinal = 6 AS passed FROM n""")
def _(t: Inputs):
    ids = lambda where: t.docs.where(where).select("document_id")
    chunks = t.docs.where("doc_id % 35 <> 0 and text <> '' and doc_id % 45 <> 0")
    chunks = chunks.select("document_id", "text", F.when(F.col("doc_id") % 55 != 0, F.array(F.lit(1.0))).alias("embedding"))
    config = t.spark.createDataFrame([("model", "m-1"), ("prompt", "p-7"), ("max_turns", "12")], "name string, value string")
    entries = t.events.select(F.when(F.col("event_id") % 4 != 0, F.lit(1.0)).alias("latency_ms"))
    return op.run_preflight(ids("doc_id % 5 = 0"), ids("doc_id % 35 <> 0"), chunks, ids("doc_id % 10 <> 5"), config, "model m-1, 12 turns", entries)


@query("A7b_run_totals", """
    SELECT run_id, count(*) AS turns, sum(cost_usd) AS cost_usd, cast(sum(retries) AS bigint) AS retries, CASE WHEN count(*) = count(model_ms) THEN sum(model_ms) END AS latency_ms FROM {turns} GROUP BY 1""")
def _(t: Inputs):
    return op.run_totals(t.turns)


@query("F1_prompt_version", "SELECT document_id, substring(sha256(text || lang), 1, 12) AS version FROM {docs}")
def _(t: Inputs):
    return t.docs.select("document_id", op.prompt_version(F.col("text"), F.col("lang")).alias("version"))


@query("F2_cache_key", """SELECT event_id, sha256('{{"event":"' || event_type || '","user":' || user_id || '}}') AS cache_key FROM {events}""".replace("{{", "{").replace("}}", "}"))
def _(t: Inputs):
    r = t.events.select("event_id", F.format_string('{"user": %d, "event": "%s"}', "user_id", "event_type").alias("request"))
    return op.cache_key(r).select("event_id", "cache_key")


@query("F3_replay", """
    SELECT event_id::varchar AS key, event_id % 50 AS input_tokens, 0::bigint AS cache_read_tokens, (event_id % 3)::bigint AS tool_calls, CASE WHEN event_id % 4 <> 0 THEN (event_id % 90)::double END AS latency_ms FROM {events}""")
def _(t: Inputs):
    e = F.col("event_id")
    block = F.struct(F.lit("tool_use").alias("type"), F.lit("x").alias("id"), F.lit("search").alias("name"), F.lit(None).cast("string").alias("text"))
    text = F.struct(F.lit("text").alias("type"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name"), F.lit("hi").alias("text"))
    usage = F.struct((e % 50).alias("input_tokens"), (e % 7).alias("output_tokens"), F.lit(None).cast("long").alias("cache_read_input_tokens"), F.lit(None).cast("long").alias("cache_creation_input_tokens"))
    response = F.struct(F.concat(F.array(text), F.array_repeat(block, (e % 3).cast("int"))).alias("content"), F.lit("end_turn").alias("stop_reason"), F.lit("m").alias("model"), usage.alias("usage"))
    meta = F.struct(F.when(e % 4 != 0, (e % 90).cast("double")).alias("latency_ms"))
    entries = t.events.select(e.cast("string").alias("key"), meta.alias("meta"), response.alias("response"))
    return op.replay(entries).select("key", "input_tokens", "cache_read_tokens", "tool_calls", "latency_ms")


@query("Q1_enqueue", """
    WITH q AS (SELECT id, document_id FROM {reviews} WHERE id % 2 = 0), n AS (SELECT document_id, row_number() OVER (ORDER BY created_at, id) AS r FROM {reviews} WHERE id % 2 = 1)
    SELECT id, document_id FROM q UNION ALL SELECT (SELECT max(id) FROM q) + r, document_id FROM n""")
def _(t: Inputs):
    queue = t.reviews.where("id % 2 = 0")
    items = t.reviews.where("id % 2 = 1").select(F.col("id").alias("old_id"), "document_id", "created_at")
    return op.enqueue(queue, items, ["created_at", "old_id"]).select("id", "document_id")


@query("Q2_open_items", "SELECT id, document_id FROM {reviews} WHERE status = 'open' ORDER BY created_at, id LIMIT 50")
def _(t: Inputs):
    return op.queue_items(t.reviews).select("id", "document_id")


@query("Q3_get", "SELECT id, document_id, status FROM {reviews} WHERE id = (SELECT min(id) FROM {reviews})")
def _(t: Inputs):
    first = t.reviews.agg(F.min("id").alias("id"))
    return t.reviews.join(F.broadcast(first), "id").select("id", "document_id", "status")


def _decisions(t: Inputs):
    r = F.expr("case seq when 0 then case when id % 4 = 0 then 'corrected' else 'accepted' end else 'rejected' end")
    rows = t.reviews.select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("seq"), "created_at")
    return rows.select("id", "seq", r.alias("resolution"), F.lit("me").alias("reviewer"), F.lit(None).cast("string").alias("note"),
                       F.when((F.col("id") % 8 == 0) & (F.col("seq") == 0), "fixed").alias("correction"), (F.col("created_at") + F.make_dt_interval(mins=F.col("seq") + 1)).alias("decided_at"))


@query("Q4_resolve", """
    SELECT id, CASE WHEN status <> 'open' THEN status WHEN id % 4 <> 0 THEN 'accepted' WHEN id % 8 = 0 THEN 'corrected' ELSE 'rejected' END AS status,
           CASE WHEN status = 'open' AND id % 8 = 0 THEN 'fixed' END AS correction FROM {reviews}""")
def _(t: Inputs):
    return op.resolve(t.reviews, _decisions(t)).select("id", "status", "correction")


@query("Q5_queue_violations", "SELECT id, status FROM {reviews} WHERE false")
def _(t: Inputs):
    return op.queue_violations(op.resolve(t.reviews.where("status = 'open'"), _decisions(t)))


@query("T1_latency_histogram", f"""
    WITH v AS (SELECT event_type, model_ms / 1000 AS s FROM {{turns}})
    SELECT event_type, le, CASE WHEN le = '+Inf' THEN count(s) ELSE count(*) FILTER (WHERE s <= try_cast(le AS double)) END AS cumulative, count(s) AS n, round(sum(s), 9) AS total
    FROM v CROSS JOIN (SELECT unnest([{', '.join(f"'{b:g}'" for b in dims.LATENCY_BUCKETS)}, '+Inf']) AS le) b GROUP BY 1, 2""")
def _(t: Inputs):
    v = t.turns.select("event_type", (F.col("model_ms") / 1000).alias("s"))
    return op.histogram(v, ["event_type"], "s", dims.LATENCY_BUCKETS).withColumn("total", F.round("total", 9))


@query("T2_counters", "SELECT event_type, user_id % 3 AS shard, count(*) AS count FROM {events} GROUP BY 1, 2")
def _(t: Inputs):
    return op.counters(t.events.withColumn("shard", F.col("user_id") % 3), ["event_type", "shard"])


@query("T4_job_status", """
    SELECT user_id AS job_id, count(*) AS documents, count(*) FILTER (WHERE event_type = 'error') AS failed, CASE WHEN count(*) FILTER (WHERE event_type = 'error') > 0 THEN 'failed' ELSE 'completed' END AS status FROM {events} GROUP BY 1""")
def _(t: Inputs):
    return op.job_status(t.events.select(F.col("user_id").alias("job_id"), F.when(F.col("event_type") == "error", "boom").alias("error")))


@query("P5_windowed_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM {events} GROUP BY 1, 2")
def _(t: Inputs):
    from lexigrain.streaming import incremental

    return incremental.windowed_counts(t.events).withColumn("total", F.round("total", 6))
