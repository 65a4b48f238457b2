"""Submission-shaped tables derived from the given ones, in Spark and in DuckDB from the same text.

A template holds SQL that both engines read alike, but for a few spellings that DIALECT fills in.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

NOW = "2024-01-31 00:00:00"

DIALECT = {
    "spark": {"SHA": "sha2", "S256": ", 256", "TS0": "timestamp '2024-01-01 00:00:00'", "MIN": "make_interval(0,0,0,0,0,int(", "MINE": "),0)", "STR": "string"},
    "duckdb": {"SHA": "sha256", "S256": "", "TS0": "timestamp '2024-01-01 00:00:00'", "MIN": "to_minutes(cast(", "MINE": " as bigint))", "STR": "varchar"},
}

TEMPLATES = {
    "submissions": """
select doc_id as doc_num, concat('DOC-', lpad(cast(doc_id as {STR}), 12, '0')) as doc_id,
  case doc_id % 4 when 0 then 'drug' when 1 then 'medical_device' when 2 then 'clinical_trial' else 'sae' end as submission_type,
  case (doc_id % 16 - doc_id % 4) / 4 when 0 then 'sugam' when 1 then 'md_online' when 2 then 'manual' else 'sae_feed' end as portal_source,
  case doc_id % 6 when 0 then 'ingested' when 1 then 'queued' when 2 then 'preprocessing' when 3 then 'processed' when 4 then 'failed' else 'rejected' end as status,
  concat('file_', cast(doc_id as {STR}), '.pdf') as original_filename, {SHA}(text{S256}) as checksum_sha256, n_chars as file_size_bytes,
  {TS0} + {MIN}(doc_id * 41) % 43200{MINE} as created_at, lang, source, text from documents""",
    "reg_text": """
select doc_num, doc_id, submission_type, lang, concat(text,
  case when doc_num % 3 = 0 then concat(' . Aadhaar 1234 5678 ', lpad(cast(doc_num % 10000 as {STR}), 4, '0')) else '' end,
  case when doc_num % 4 = 0 then concat(' . Patient ID PT-', lpad(cast(doc_num as {STR}), 6, '0')) else '' end,
  case when doc_num % 5 = 0 then concat(' . email u', cast(doc_num as {STR}), '@example.org phone 9876', lpad(cast(doc_num % 1000000 as {STR}), 6, '0')) else '' end,
  case when doc_num % 7 = 0 then ' . Outcome: death reported after the dose. Causality possible.' else '' end,
  case when doc_num % 6 = 0 then ' . Drug name and indication and phase and sponsor are stated here.' else '' end) as text from submissions""",
    "event_log": """
select concat('e-', cast(event_id as {STR})) as event_id,
  case event_type when 'signup' then 'raw.documents.ingested' when 'view' then 'documents.preprocessed' when 'click' then 'documents.anonymised'
    when 'purchase' then 'documents.classified' else 'reports.generated' end as topic,
  event_id % 6 as part, event_id as off, concat('DOC-', lpad(cast(user_id as {STR}), 12, '0')) as doc_id,
  case when event_type = 'error' then 'failed' when event_id % 11 = 0 then 'dlq' when event_id % 7 = 0 then 'processing' else 'success' end as processing_status,
  cast(floor(value * 100) as int) as processing_duration_ms, ts as produced_at from events""",
    "dlq_events": """
select event_id, topic as original_topic, doc_id, case off % 3 when 0 then 'ValueError' when 1 then 'TimeoutError' else 'SchemaError' end as error_type,
  case off % 5 when 0 then 'reprocessing' when 1 then 'dismissed' when 2 then 'resolved' else 'pending' end as status, off % 4 as retry_count, produced_at as failed_at
  from event_log where processing_status in ('failed', 'dlq')""",
    "assessments": """
select s.doc_id, t.source_event, case when (doc_num + t.k) % 9 = 0 then 'blocked' when (doc_num + t.k) % 4 = 0 then 'review_required' else 'pass' end as decision,
  ((doc_num + t.k) % 9 = 0 or (doc_num + t.k) % 4 = 0) as human_review_required, (doc_num + t.k) % 9 = 0 as blocked,
  s.created_at + {MIN}t.k * 10{MINE} as assessed_at
  from submissions s join (select 1 as k, 'documents.anonymised' as source_event, 1 as one union all select 2, 'documents.summarised', 1 union all select 3, 'documents.classified', 1) t on t.one = 1""",
    "request_log": """
select event_id as req_id, concat('10.0.0.', cast(user_id as {STR})) as ip, user_id, event_type as endpoint, ts from events""",
    "group_offsets": """
select concat('g', cast(o_custkey % 4 as {STR})) as group_id, o_orderpriority as topic, o_orderkey % 6 as part, max(o_orderkey) as end_offset,
  min(o_orderkey) + cast(floor(avg(o_totalprice)) as bigint) % 500 as committed_offset from orders group by 1, 2, 3""",
}
GIVEN = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _text(name: str, engine: str) -> str:
    return re.sub(r"\{(\w+)\}", lambda m: DIALECT[engine][m[1]], TEMPLATES[name])


def _needs(name: str) -> list[str]:
    """Tables that a derived one reads, in order, itself last."""
    words = re.findall(r"\w+", TEMPLATES[name])
    below = [n for other in TEMPLATES if other != name and other in words for n in _needs(other)]
    return [*dict.fromkeys(below), name]


def duck(sql: str) -> str:
    """A DuckDB query with the derived tables that it names as common table expressions in front."""
    words = re.findall(r"\w+", sql)
    needed = list(dict.fromkeys(n for t in TEMPLATES if t in words for n in _needs(t)))
    ctes = [f"{n} as ({_text(n, 'duckdb')})" for n in needed]
    own = sql.strip()
    if own.lower().startswith("with "):
        return "with " + ", ".join([*ctes, own[5:]])
    return ("with " + ", ".join(ctes) + "\n" if ctes else "") + own


class Tables:
    """Lazy access to the given and the derived tables of a folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def given(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _derived(self, name: str) -> DataFrame:
        words = set(re.findall(r"\w+", TEMPLATES[name]))
        parts = {t: getattr(self, t) for t in [*GIVEN, *TEMPLATES] if t in words and t != name and re.search(rf"(from|join) {t}\b", TEMPLATES[name])}
        text = _text(name, "spark")
        for t in parts:
            text = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", text)
        return self.spark.sql(text, **parts)

    def __getattr__(self, name: str) -> DataFrame:
        if name in GIVEN:
            return self.given(name)
        if name in TEMPLATES:
            return self._derived(name)
        raise AttributeError(name)
