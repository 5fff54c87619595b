"""Deterministic inputs of the engine's entities, derived from the driver's tables.

Each binding is one SELECT that Spark and DuckDB both run: ``{name}`` stands for
a table or for another binding.  Spark gets DataFrames for the names, DuckDB
gets common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from lexigrain import dims

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_TYPES = " UNION ALL ".join(
    f"SELECT '{c}' AS clause_type, {i} AS ordinal, {t} AS tier, '{g}' AS category, {str(b).lower()} AS presence_only"
    for i, (c, t, g, b) in enumerate(dims.CLAUSE_TYPES)
)

BINDINGS: dict[str, str] = {
    "docs": "SELECT cast(doc_id AS string) AS document_id, doc_id, text, lang, source, n_chars FROM {documents}",
    "types": _TYPES,
    "clause_grid": """
        SELECT d.document_id, d.doc_id, d.text, t.ordinal, t.clause_type,
               CASE WHEN d.doc_id % 50 = 1 THEN false WHEN d.doc_id % 50 = 2 THEN true
                    ELSE (d.doc_id * 7 + t.ordinal * 5) % 3 <> 0 END AS present
        FROM {docs} d CROSS JOIN {types} t
        WHERE d.doc_id % 50 <> 6 AND (d.doc_id % 50 <> 4 OR t.ordinal < 8)""",
    "clause_values": """
        SELECT *, CASE
            WHEN ordinal = 0 THEN CASE doc_id % 6 WHEN 0 THEN 'US-DE' WHEN 1 THEN 'US-NY; GB-EAW' WHEN 2 THEN 'Atlantis'
                WHEN 3 THEN 'UNSPECIFIED' WHEN 4 THEN 'us-de' ELSE NULL END
            WHEN ordinal = 1 THEN CASE WHEN doc_id % 9 = 0 THEN NULL ELSE 'Acme Inc.; Beta LLC' END
            WHEN ordinal = 2 THEN CASE doc_id % 8 WHEN 0 THEN '2019-03-15' WHEN 1 THEN '2019-03' WHEN 2 THEN '2019' WHEN 3 THEN '3/15/19'
                WHEN 4 THEN '1850' WHEN 5 THEN 'PERPETUAL' WHEN 6 THEN '2019-13-01' ELSE NULL END
            WHEN ordinal = 3 THEN CASE doc_id % 7 WHEN 0 THEN '2019-02-01' WHEN 1 THEN 'PERPETUAL' WHEN 2 THEN '2019-03' WHEN 3 THEN '2018'
                WHEN 4 THEN 'UNSPECIFIED' WHEN 5 THEN '2020-01-01' ELSE '2150' END
            WHEN ordinal = 4 THEN CASE WHEN doc_id % 4 = 0 THEN NULL ELSE '365' END
            WHEN ordinal = 5 THEN CASE doc_id % 8 WHEN 0 THEN '30' WHEN 1 THEN ' 30 ' WHEN 2 THEN '+30' WHEN 3 THEN 'abc' WHEN 4 THEN '0'
                WHEN 5 THEN '9999' WHEN 6 THEN 'UNSPECIFIED' ELSE '1_000' END
            WHEN doc_id % 11 = 0 THEN 'summary' ELSE NULL END AS raw_value
        FROM {clause_grid}""",
    "clauses": """
        SELECT document_id, doc_id, ordinal AS seq, clause_type, present,
               CASE WHEN present OR doc_id % 13 = 0 THEN raw_value END AS value,
               CASE WHEN present AND doc_id % 10 = 3 THEN 'a paraphrase of the clause' WHEN present AND doc_id % 10 = 4 THEN ''
                    WHEN present THEN substring(text, 1 + ordinal * 10, 40) WHEN doc_id % 17 = 0 THEN 'stray' END AS raw_text,
               CASE WHEN doc_id % 50 = 3 THEN cast(0.8 AS double)
                    ELSE cast((doc_id * 7919 + ordinal * 104729) % 1000 AS double) / 1000 END AS confidence
        FROM {clause_values}
        UNION ALL
        SELECT document_id, doc_id, 12, 'governing_law', false, NULL, NULL, cast(0.9 AS double) FROM {docs} WHERE doc_id % 50 = 5""",
    "evidence_base": """
        SELECT c.document_id, c.doc_id, c.seq, c.clause_type, d.text, c.seq * 20 AS s, substring(d.text, 1 + c.seq * 20, 30) AS q,
               (c.doc_id + c.seq * 3) % 9 AS k
        FROM {clauses} c JOIN {docs} d ON c.document_id = d.document_id
        WHERE (c.present AND (c.doc_id + c.seq) % 5 <> 0) OR (NOT c.present AND c.doc_id % 19 = 0)""",
    "evidence": """
        SELECT document_id, doc_id, clause_type, seq, 0 AS ev_ord,
               CASE k WHEN 2 THEN replace(q, ' ', chr(10)) WHEN 3 THEN replace(q, ' ', '  ') WHEN 4 THEN q || 'zzqx' WHEN 5 THEN '   '
                      WHEN 6 THEN 'zzqx is never there' WHEN 8 THEN substring(q, 1, 5) ELSE q END AS quote,
               cast(CASE k WHEN 1 THEN s + 7 WHEN 3 THEN s + 7 WHEN 6 THEN 99999990 WHEN 7 THEN 0 ELSE s END AS int) AS char_start,
               cast(CASE k WHEN 1 THEN CASE WHEN doc_id % 23 = 0 THEN s + 7 ELSE s + 7 + length(q) END WHEN 3 THEN s + 7 + length(q)
                      WHEN 6 THEN 99999999 WHEN 7 THEN 0 WHEN 8 THEN s + least(5, length(q)) ELSE s + length(q) END AS int) AS char_end
        FROM {evidence_base}
        UNION ALL
        SELECT document_id, doc_id, clause_type, seq, 1, q, cast(s AS int), cast(s + length(q) AS int) FROM {evidence_base} WHERE k = 0 AND doc_id % 6 = 0""",
    "queries": """
        SELECT b.item_id AS query_id, b.text AS query, e.embedding AS vector
        FROM {benchmark} b JOIN {embeddings} e ON e.vec_id = b.item_id * 3 % 500""",
    "vectors": "SELECT cast(vec_id AS string) AS chunk_id, embedding FROM {embeddings}",
    "gold": """
        SELECT d.document_id, d.doc_id, d.lang, d.source, l.quality = 1 AS actual, d.n_chars % 4 <> 0 AS predicted,
               cast(d.doc_id * 7919 % 1000 AS double) / 1000 AS confidence, d.n_chars
        FROM {docs} d JOIN {labels} l ON d.doc_id = l.doc_id""",
    "spans": """
        SELECT c.document_id, c.doc_id, c.clause_type, c.seq, n.n AS k,
               cast((c.doc_id * 13 + c.seq * 17 + n.n * 29) % 300 AS int) AS s,
               cast((c.doc_id * 13 + c.seq * 17 + n.n * 29) % 300 + (c.doc_id + n.n) % 4 * 20 AS int) AS e,
               n.n % 2 = 0 AS is_gold
        FROM {clauses} c CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) n
        WHERE c.seq < 12 AND (c.doc_id + c.seq + n.n) % 3 <> 0""",
    "turns": """
        SELECT user_id AS run_id, cast(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS bigint) AS turn, event_id, event_type, ts,
               cast(event_id % 40 AS double) / 64 AS cost_usd,
               CASE WHEN event_id % 37 = 0 THEN NULL ELSE cast(event_id % 500 AS double) END AS model_ms,
               CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS retries
        FROM {events}""",
    "runs": """
        SELECT a.arm, d.document_id, d.doc_id,
               CASE WHEN (d.doc_id + a.n) % 7 = 0 THEN 'incomplete_max_turns' ELSE 'completed' END AS status,
               cast((d.doc_id * 31 + a.n * 7) % 64 AS double) / 256 AS cost_usd,
               CASE WHEN (d.doc_id + a.n) % 11 = 0 THEN NULL ELSE cast((d.doc_id * 17 + a.n) % 900 AS double) END AS latency_ms,
               cast((d.doc_id + a.n) % 3 AS int) AS retries
        FROM {docs} d CROSS JOIN (SELECT 'agent' AS arm, 1 AS n UNION ALL SELECT 'full_context', 2 UNION ALL SELECT 'regex', 3) a""",
    "chat": "SELECT conv_id AS run_id, turn AS seq, role, text AS query FROM {conversations}",
    "reads": """
        SELECT conv_id AS run_id, turn AS seq, cast(conv_id % 100 AS string) AS document_id,
               cast((turn * 37 + conv_id * 11) % 900 AS int) AS char_start, cast((turn * 37 + conv_id * 11) % 900 + (turn % 5) * 90 - 30 AS int) AS char_end
        FROM {conversations}""",
    "reviews": """
        SELECT event_id AS id, cast(user_id AS string) AS document_id, ts AS created_at,
               CASE WHEN event_id % 3 = 0 THEN 'accepted' ELSE 'open' END AS status
        FROM {events} WHERE event_type = 'error'""",
}


def _needs(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{([a-z_]+)\}", sql)))


def bind(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or a binding as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = BINDINGS[name]
    return spark.sql(sql, **{n: bind(spark, sf_dir, n) for n in _needs(sql)})


def oracle(sql: str) -> str:
    """DuckDB text of ``sql``, its bindings as common table expressions."""
    order: list[str] = []

    def visit(text: str) -> None:
        for n in _needs(text):
            if n in BINDINGS and n not in order:
                visit(BINDINGS[n])
                order.append(n)

    visit(sql)
    names = {n: n for n in [*TABLES, *BINDINGS]}
    ctes = ",\n".join(f"{n} AS ({BINDINGS[n].format(**names)})" for n in order)
    body = re.sub(r"\{([a-z_]+)\}", lambda m: names[m[1]], sql).strip()
    if not ctes:
        return body
    recursive = body.upper().startswith("WITH RECURSIVE")
    if body.upper().startswith("WITH "):
        body = ", " + body[len("WITH RECURSIVE ") if recursive else len("WITH ") :]
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{body}"
