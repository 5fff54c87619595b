"""Retrieval, fusion, reranking and traces over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrain.operators import operations as op
from lexigrain.operators import retrieval as rt
from lexigrain.plans.registry import Inputs, query

TERMS = "regexp_extract_all(lower({}), '[a-z0-9]+')"
LEXICAL = f"""
    t AS (SELECT document_id AS chunk_id, unnest({TERMS.format('text')}) AS term FROM {{docs}}),
    post AS (SELECT term, chunk_id, count(*) AS tf FROM t GROUP BY 1, 2),
    q AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest({TERMS.format('query')}) AS term FROM {{queries}})),
    lex AS (SELECT query_id, chunk_id, sum(tf) AS matches FROM post JOIN q USING (term) GROUP BY 1, 2),
    lexr AS (SELECT query_id, chunk_id, matches * 0.1::double / (matches * 0.1::double + 1) AS score,
                    row_number() OVER (PARTITION BY query_id ORDER BY matches DESC, chunk_id) AS pos FROM lex)"""
DENSE = """
    cos AS (SELECT query_id, chunk_id, list_cosine_similarity(embedding::double[], vector::double[]) AS score FROM {vectors} CROSS JOIN {queries}
            WHERE embedding IS NOT NULL),
    cosr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS pos FROM cos)"""
FUSED = f"""{LEXICAL}, {DENSE},
    arms AS (SELECT query_id, chunk_id, pos, 'lexical' AS arm FROM lexr WHERE pos <= 50 UNION ALL SELECT query_id, chunk_id, pos, 'dense' FROM cosr WHERE pos <= 50),
    f AS (SELECT query_id, chunk_id, min(CASE WHEN arm = 'dense' THEN pos END) AS dense_rank, min(CASE WHEN arm = 'lexical' THEN pos END) AS lexical_rank FROM arms GROUP BY 1, 2),
    s AS (SELECT *, coalesce(1.0::double / (60 + dense_rank), 0) + coalesce(1.0::double / (60 + lexical_rank), 0) AS score FROM f),
    fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CASE WHEN dense_rank IS NULL THEN 1 ELSE 0 END, coalesce(dense_rank, lexical_rank), chunk_id) AS fused_rank FROM s)"""


def _post(t: Inputs):
    return rt.postings(t.docs, "document_id")


def _chunks(t: Inputs):
    return t.docs.select(F.col("document_id").alias("chunk_id"), "text")


def _flat(fused):
    ranks = [F.try_element_at("ranks", F.lit(a)).cast("long").alias(f"{a}_rank") for a in ("dense", "lexical")]
    return fused.select("query_id", "chunk_id", F.round("score", 9).alias("score"), *ranks, F.col("fused_rank").cast("long").alias("fused_rank"))


@query("R1_or_query", f"SELECT query_id, array_to_string({TERMS.format('query')}, ' | ') AS q FROM {{queries}} WHERE len({TERMS.format('query')}) > 0 UNION ALL SELECT 99, NULL")
def _(t: Inputs):
    from lexigrain.functions import text as tx

    extra = t.spark.createDataFrame([(99, "?!")], "query_id long, query string")
    return t.queries.select("query_id", "query").unionByName(extra).select("query_id", tx.or_query("query").alias("q"))


@query("R2_postings", f"SELECT term, document_id AS chunk_id, count(*) AS tf FROM (SELECT document_id, unnest({TERMS.format('text')}) AS term FROM {{docs}}) GROUP BY 1, 2")
def _(t: Inputs):
    return _post(t)


@query("R2_stemmed_postings")
def _(t: Inputs):
    return rt.postings(t.docs, "document_id", english=True)


@query("R3_lexical_search", f"WITH {LEXICAL} SELECT query_id, chunk_id, round(score, 9) AS score, pos FROM lexr WHERE pos <= 50")
def _(t: Inputs):
    r = rt.lexical_scan(t.docs, t.queries, id_col="document_id")
    return r.select("query_id", "chunk_id", F.round("score", 9).alias("score"), F.col("pos").cast("long").alias("pos"))


@query("R4_dense_search", f"WITH {DENSE} SELECT query_id, chunk_id, round(score, 9) AS score, pos FROM cosr WHERE pos <= 50")
def _(t: Inputs):
    r = rt.dense_search(t.vectors, t.queries)
    return r.select("query_id", "chunk_id", F.round("score", 9).alias("score"), F.col("pos").cast("long").alias("pos"))


@query("R5_document_filter", f"""
    WITH {LEXICAL.replace('{docs}', "(SELECT * FROM {docs} WHERE doc_id % 5 = 0)")}
    SELECT query_id, chunk_id, round(score, 9) AS score, pos FROM lexr WHERE pos <= 50""")
def _(t: Inputs):
    kept = rt.restrict(t.docs, t.docs.where("doc_id % 5 = 0"))
    r = rt.lexical_scan(kept, t.queries, id_col="document_id")
    return r.select("query_id", "chunk_id", F.round("score", 9).alias("score"), F.col("pos").cast("long").alias("pos"))


# the same arms in English: stems and stop-words; tests/ compare them with DuckDB, which gets the stems as a table


@query("R3_english_search")
def _(t: Inputs):
    return rt.lexical_scan(t.docs, t.queries, id_col="document_id", english=True)


@query("R5_english_filter")
def _(t: Inputs):
    kept = rt.restrict(t.docs, t.docs.where("doc_id % 5 = 0"))
    return rt.lexical_scan(kept, t.queries, id_col="document_id", english=True)


@query("R7_english_hybrid")
def _(t: Inputs):
    return _flat(rt.hybrid_search(None, t.vectors, t.queries, chunks=_chunks(t), english=True))


@query("R8_english_rerank")
def _(t: Inputs):
    fused = rt.hybrid_search(None, t.vectors, t.queries, limit=50, chunks=_chunks(t), english=True)
    shared = lambda: lambda pairs: [float(len(set(q.split()) & set(p.split()))) for q, p in pairs]
    scored = rt.rerank(rt.model_rerank(fused, t.queries, _chunks(t), shared), 10)
    return scored.select("query_id", "chunk_id", "rerank_score", F.col("rerank_rank").cast("long").alias("rerank_rank"))


@query("R6_reciprocal_rank_fusion", """
    WITH r AS (SELECT user_id AS query_id, event_type AS retriever, cast(event_id % 13 AS string) AS chunk_id,
                      row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS pos FROM {events} WHERE event_type IN ('click', 'view', 'error', 'purchase')),
    f AS (SELECT query_id, chunk_id, retriever, min(pos) AS pos FROM r GROUP BY 1, 2, 3),
    s AS (SELECT query_id, chunk_id, sum(1.0::double / (60 + pos)) AS score, count(*) AS arms FROM f GROUP BY 1, 2)
    SELECT query_id, chunk_id, round(score, 9) AS score, arms FROM s""")
def _(t: Inputs):
    from pyspark.sql import Window

    e = t.events.where("event_type in ('click', 'view', 'error', 'purchase')")
    ranked = e.select(F.col("user_id").alias("query_id"), F.col("event_type").alias("retriever"), (F.col("event_id") % 13).cast("string").alias("chunk_id"),
                      F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id")).alias("pos"))
    fused = rt.fuse(ranked, limit=None, arms=("click", "view", "error", "purchase"))
    return fused.select("query_id", "chunk_id", F.round("score", 9).alias("score"), F.size("ranks").cast("long").alias("arms"))


@query("R7_hybrid_rrf_topk", f"WITH {FUSED} SELECT query_id, chunk_id, round(score, 9) AS score, dense_rank, lexical_rank, fused_rank FROM fused WHERE fused_rank <= 10")
def _(t: Inputs):
    return _flat(rt.hybrid_search(None, t.vectors, t.queries, chunks=_chunks(t)))


@query("R8_rerank", f"""
    WITH {FUSED}, r AS (SELECT *, cast(length(chunk_id) * 7 + cast(chunk_id AS bigint) % 5 AS double) AS rerank_score FROM fused WHERE fused_rank <= 10)
    SELECT query_id, chunk_id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, fused_rank) AS rerank_rank FROM r""")
def _(t: Inputs):
    fused = rt.hybrid_search(None, t.vectors, t.queries, chunks=_chunks(t))
    scored = fused.withColumn("rerank_score", (F.length("chunk_id") * 7 + F.col("chunk_id").cast("long") % 5).cast("double"))
    return rt.rerank(scored).select("query_id", "chunk_id", "rerank_score", F.col("rerank_rank").cast("long").alias("rerank_rank"))


@query("R9_identity_reranker", f"WITH {FUSED} SELECT query_id, chunk_id, (1 - fused_rank)::double AS rerank_score, fused_rank AS rerank_rank FROM fused WHERE fused_rank <= 10")
def _(t: Inputs):
    fused = rt.identity_scores(rt.hybrid_search(None, t.vectors, t.queries, chunks=_chunks(t)))
    return rt.rerank(fused).select("query_id", "chunk_id", "rerank_score", F.col("rerank_rank").cast("long").alias("rerank_rank"))


@query("R11_hashing_embedder")
def _(t: Inputs):
    return rt.hash_embed(t.docs.select("document_id", "text"), dim=64).select("document_id", "embedding")


@query("R13_top_k_per_source", """
    SELECT source, document_id, pos FROM (SELECT source, document_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, document_id) AS pos FROM {docs}) WHERE pos <= 3""")
def _(t: Inputs):
    return rt.top_k(t.docs, ["source"], [F.desc("n_chars"), F.col("document_id")], 3).select("source", "document_id", F.col("pos").cast("long").alias("pos"))


@query("R14_near_duplicate_queries")
def _(t: Inputs):
    return op.reject_near_duplicates(t.chat.where("role = 'user'"))


@query("R15_trace_near_duplicates")
def _(t: Inputs):
    return op.near_duplicate_trace(t.chat)


@query("R15_overlapping_reads", """
    SELECT a.run_id, a.seq, count(b.seq) AS overlaps FROM {reads} a
    LEFT JOIN {reads} b ON a.run_id = b.run_id AND b.seq < a.seq AND least(a.char_end, b.char_end) > greatest(a.char_start, b.char_start) GROUP BY 1, 2""")
def _(t: Inputs):
    return op.overlapping_reads(t.reads)


@query("R15_targeted_clauses", """
    SELECT run_id, seq, array_to_string(list_filter([CASE WHEN regexp_matches(lower(query), 'the|der') THEN 'governing_law' END,
        CASE WHEN regexp_matches(lower(query), 'and|und') THEN 'parties' END], lambda x: x IS NOT NULL), ',') AS clause_types FROM {chat}""")
def _(t: Inputs):
    return op.targeted_clauses(t.chat, {"governing_law": "the|der", "parties": "and|und"})


@query("R16_tool_log", "SELECT event_type AS tool, count(*) AS calls, count(*) FILTER (WHERE event_id % 9 = 0) AS errors FROM {events} GROUP BY 1")
def _(t: Inputs):
    return op.tool_use(t.events.select(F.col("event_type").alias("tool"), (F.col("event_id") % 9 == 0).alias("is_error")))
