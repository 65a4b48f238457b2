"""Queries over the audit log."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossierlake.operators import audit as a
from dossierlake.plans.registry import query

#: an audit log by rule: each hash from its id, with some links and hashes broken
LOG = """select event_id as id, case when event_id = 0 then repeat('0', 64) when event_id % 97 = 3 then repeat('f', 64) else {sha}(cast(event_id - 1 as {str}){n}) end as prev_hash,
    case when event_id % 131 = 5 then 'short' else {sha}(cast(event_id as {str}){n}) end as entry_hash from {{events}}"""
DUCK_LOG = LOG.format(sha="sha256", str="varchar", n="").replace("{events}", "events")


def log(t):
    return t.spark.sql(LOG.format(sha="sha2", str="string", n=", 256"), events=t.events)


query(
    "audit_chain_build",
    f"""select doc_id, count(*) as n, list_reduce(list_prepend('{a.GENESIS}', list(concat('{{"off":', cast(off as varchar), ',"topic":"', topic, '"}}') order by off)), lambda x, y: sha256(concat(x, y))) as head from event_log group by 1""",
)(lambda t: a.audit_chain_build(t.event_log.withColumn("payload", a.canonical(t.event_log, "topic", "off")), "doc_id", "off", "payload").groupBy("doc_id").agg(F.count("*").alias("n"), F.max_by("entry_hash", "id").alias("head")))
query(
    "audit_chain_verify",
    f"""select id, reason from (select id, case when prev_hash is distinct from coalesce(lag(entry_hash) over (order by id), repeat('0', 64)) then 'prev_hash_mismatch' when length(entry_hash) <> 64 then 'invalid_entry_hash_format' end as reason from ({DUCK_LOG})) where reason is not null""",
)(lambda t: a.audit_chain_verify(log(t), 1000))
query("append_only_check", f"select id, case when id % 50 = 7 then 'deleted' else 'changed' end as violation from ({DUCK_LOG}) where id % 50 = 7 or id % 77 = 1")(
    lambda t: a.append_only_check(log(t), log(t).where("id % 50 <> 7").withColumn("entry_hash", F.when(F.col("id") % 77 == 1, "x").otherwise(F.col("entry_hash"))))
)
query(
    "audit_rows",
    """select doc_id, 'ai_decision' as event_type, 'system' as actor, decision as outcome, concat('{"decision":"', decision, '","doc_id":"', doc_id, '","source_event":"', source_event, '"}') as payload,
    'managed-by-audit-logger' as prev_hash from assessments""",
)(lambda t: a.audit_rows(t.assessments))
