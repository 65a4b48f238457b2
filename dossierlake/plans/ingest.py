"""Queries over ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossierlake.operators import ingest as i
from dossierlake.plans.registry import query


def feed(t, drug: bool):
    """Feeds of each customer's orders as the portals send them."""
    o = t.orders
    key = F.col("o_orderkey").cast("string")
    url = F.when(F.col("o_orderkey") % 4 != 0, F.concat(F.lit("http://x/"), key))
    file = F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("f"), key))
    when = F.when(F.col("o_orderkey") % 7 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    kinds = F.get(F.array(*[F.lit(x) for x in ("NewDrug", "IND", "MedicalDevice", "SAE", "Other")]), (F.col("o_orderkey") % 5).cast("int"))
    if drug:
        docs = F.array(F.struct(key.alias("DocumentID"), file.alias("FileName"), url.alias("DownloadURL")))
        row = F.struct(key.alias("ApplicationID"), F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderstatus")).alias("ApplicantName"), kinds.alias("ApplicationType"), when.alias("SubmittedAt"), docs.alias("Documents"))
        body = F.struct(F.collect_list(row).alias("applications"))
    else:
        docs = F.array(F.struct(key.alias("AttachmentID"), file.alias("OriginalFileName"), url.alias("DownloadLink")))
        row = F.struct(key.alias("SubmissionID"), F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderstatus")).alias("ManufacturerName"), F.lit("B").alias("DeviceClass"), when.alias("SubmissionDate"), docs.alias("Attachments"))
        body = F.struct(F.collect_list(row).alias("submissions"))
    return o.groupBy("o_custkey").agg(F.to_json(body).alias("json"))


FEED = """select cast(o_orderkey as varchar) as external_id, case when o_orderkey % 6 <> 0 then o_orderstatus else 'Unknown' end as applicant, {kind} as submission_type,
    case when o_orderkey % 7 <> 0 then strftime(o_orderdate, '%Y-%m-%d') end as day, case when o_orderkey % 5 <> 0 then concat('f', cast(o_orderkey as varchar)) else cast(o_orderkey as varchar) end as filename
    from orders where o_orderkey % 4 <> 0"""


def flat(df):
    return df.select("external_id", "applicant", "submission_type", F.date_format("submitted_at", "yyyy-MM-dd").alias("day"), F.get("documents", F.lit(0))["filename"].alias("filename"))


query("portal_feed_sugam", FEED.format(kind="case o_orderkey % 5 when 1 then 'clinical_trial' when 2 then 'medical_device' when 3 then 'sae' else 'drug' end"))(lambda t: flat(i.portal_feed_sugam(feed(t, True))))
query("portal_feed_md_online", FEED.format(kind="'medical_device'"))(lambda t: flat(i.portal_feed_md_online(feed(t, False))))
NAMES = "case doc_num % 7 when 0 then '' when 1 then repeat('x', 256) when 2 then concat('../', original_filename) when 3 then concat('/', original_filename) when 4 then concat('C:', original_filename) when 5 then concat(original_filename, '?') else original_filename end"
query("validate_filename", "select doc_id, case doc_num % 7 when 0 then 'empty' when 1 then 'too_long' when 2 then 'traversal' when 3 then 'absolute' when 4 then 'absolute' when 5 then 'characters' end as reason from submissions")(
    lambda t: t.submissions.select("doc_id", i.validate_filename(F.expr(NAMES)).alias("reason"))
)
query("validate_size", "select doc_id, case when file_size_bytes * 30000 > 104857600 then 'too_large' end as reason from submissions")(lambda t: t.submissions.select("doc_id", i.validate_size(F.col("file_size_bytes") * 30_000).alias("reason")))
query(
    "validate_mime",
    "select event_id, case when event_id % 4 = 3 then 'unknown' when event_id % 4 = 2 then 'not_allowed' when event_id % 3 = 0 or (event_id % 3 = 1 and event_id % 4 <> 0) or (event_id % 3 = 2 and event_id % 4 <> 1) then null else 'mismatch' end as reason from events",
)(
    lambda t: t.events.select(
        "event_id",
        i.validate_mime(
            F.when(F.col("event_id") % 4 == 0, "text/csv").when(F.col("event_id") % 4 == 1, "application/pdf").when(F.col("event_id") % 4 == 2, "image/png"),
            F.when(F.col("event_id") % 3 == 0, "application/octet-stream").when(F.col("event_id") % 3 == 1, "application/pdf").otherwise("text/plain"),
            ("text/csv", "application/pdf"),
        ).alias("reason"),
    )
)
query(
    "validate_mime_detect",
    "select page_id, case when page_id % 3 = 0 then 'application/pdf' when page_id % 3 = 1 then 'application/xml' end as mime from pages",
)(lambda t: t.pages.select("page_id", i.detect_mime(F.concat(F.when(F.col("page_id") % 3 == 0, "%PDF-1.4").when(F.col("page_id") % 3 == 1, "<?xml ").otherwise(""), "html").cast("binary")).alias("mime")))
query(
    "validate_zip_bomb",
    "select o_custkey as doc_id, case when max(o_totalprice) * 10000 > 1073741824 then 'member_too_large' when sum(cast(o_totalprice * 10000 as bigint)) / sum(o_orderkey) > 100 then 'ratio' end as reason from orders group by 1",
)(lambda t: i.validate_zip_bomb(t.orders.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderstatus").alias("member"), (F.col("o_totalprice") * 10_000).cast("long").alias("size"), F.col("o_orderkey").alias("packed"))))
query("validate_xxe", "select page_id, case when page_id % 2 = 0 and contains(lower(html), '<!doctype') then 'external_entity' end as reason from pages")(
    lambda t: t.pages.select("page_id", i.validate_xxe(F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("<!ENTITY x>"), "html")).otherwise(F.lit("plain"))).alias("reason"))
)
query("validate_cascade", "select doc_id, case when doc_num % 7 <> 6 then 'FILENAME' when file_size_bytes * 30000 > 104857600 then 'FILE_SIZE' when doc_num % 2 = 0 then 'MIME_TYPE' when doc_num % 3 = 0 then 'ZIP_BOMB' end as error_code from submissions")(
    lambda t: t.submissions.select(
        "doc_id",
        i.validate_cascade(F.expr(NAMES), F.col("file_size_bytes") * 30_000, F.when(F.col("doc_num") % 2 == 0, "x"), F.when(F.col("doc_num") % 3 == 0, "y"), F.lit(None).cast("string"), F.lit("application/zip")).alias("error_code"),
    )
)
query("validate_domains", "select doc_id, case when doc_num % 5 = 0 then 'submission_type' when doc_num % 3 = 0 then 'portal' end as reason from submissions")(
    lambda t: t.submissions.select("doc_id", i.validate_domains(F.when(F.col("doc_num") % 5 != 0, F.col("submission_type")), F.when(F.col("doc_num") % 3 != 0, F.col("portal_source"))).alias("reason"))
)
query("content_checksum", "select doc_id, sha256(text) as checksum from documents")(lambda t: t.documents.select("doc_id", i.content_checksum(F.col("text").cast("binary")).alias("checksum")))
HASHED = "concat('DOC-', lpad(to_base(cast(concat('0x', substr(sha256({key}), 1, 15)) as bigint), 36), 12, '0'))"
query("assign_doc_id", f"select doc_id as doc_num, {HASHED.format(key="concat(coalesce(source || '|', ''), cast(doc_id as varchar))")} as doc_id from documents")(lambda t: t.documents.select(F.col("doc_id").alias("doc_num"), i.assign_doc_id(F.concat_ws("|", "source", F.col("doc_id").cast("string"))).alias("doc_id")))
query("assign_doc_id_collisions", f"select d as doc_id, count(*) as keys from (select {HASHED.format(key='cast(doc_id as varchar)')} as d from documents) group by 1 having count(*) > 1")(
    lambda t: i.id_collisions(t.documents.select(F.col("doc_id").cast("string").alias("k")).select("k", i.assign_doc_id(F.col("k")).alias("doc_id")), "k")
)
PATH = "concat('raw/', submission_type, '/', strftime(created_at, '%Y/%m/%d'), '/', doc_id, '/', original_filename)"
query("storage_path", f"select doc_id, {PATH} as path from submissions")(lambda t: t.submissions.select("doc_id", i.storage_path(F.col("submission_type"), F.col("created_at"), F.col("doc_id"), F.col("original_filename")).alias("path")))
query("parse_storage_path", "select doc_id, submission_type, strftime(created_at, '%d') as d, original_filename as filename from submissions")(
    lambda t: t.submissions.select(i.parse_storage_path(i.storage_path(F.col("submission_type"), F.col("created_at"), F.col("doc_id"), F.col("original_filename"))).alias("p")).select("p.doc_id", "p.submission_type", "p.d", "p.filename")
)
query("select_extractor", "select event_id, case event_type when 'click' then 'pdf' when 'view' then 'csv' when 'signup' then 'xml' else 'tika' end as extractor from events")(
    lambda t: t.events.select("event_id", i.select_extractor(F.when(F.col("event_type") == "click", "application/pdf").when(F.col("event_type") == "view", "text/plain").when(F.col("event_type") == "signup", "text/xml").otherwise("image/png")).alias("extractor"))
)
query(
    "dedup_exact",
    "select doc_id, case when f <> doc_id then f end as duplicate_of from (select doc_id, first_value(doc_id) over (partition by checksum_sha256 order by created_at, doc_id) as f from submissions)",
)(lambda t: i.dedup_exact(t.submissions).select("doc_id", "duplicate_of"))


def reconciled(t):
    s = t.submissions.withColumn("batch_id", F.col("doc_num") % 10)
    files = s.where("doc_num % 4 <> 0").select("batch_id", F.col("original_filename").alias("filename"), F.col("checksum_sha256").alias("checksum"), F.when(F.col("doc_num") % 9 == 0, "MIME_TYPE").alias("error_code"))
    known = s.where("doc_num % 7 = 3").groupBy(F.col("checksum_sha256").alias("checksum")).agg(F.min("doc_id").alias("existing_id"))
    return i.bulk_reconcile(s.select("batch_id", F.col("original_filename").alias("filename")), files, known)


RECONCILED = """select doc_num % 10 as batch_id, original_filename as filename, case when doc_num % 4 = 0 then 'FILE_NOT_IN_ZIP' when doc_num % 9 = 0 then 'MIME_TYPE' when k.existing_id is not null then 'DUPLICATE' else 'OK' end as outcome, k.existing_id as known_id
    from submissions s left join (select checksum_sha256 as c, min(doc_id) as existing_id from submissions where doc_num % 7 = 3 group by 1) k on k.c = s.checksum_sha256"""
query("bulk_reconcile", f"select batch_id, filename, outcome, case when outcome = 'DUPLICATE' then known_id end as existing_id from ({RECONCILED})")(reconciled)
query("bulk_batch_totals", f"select batch_id, count(*) as total, count(*) filter (outcome = 'OK') as successful, count(*) filter (outcome <> 'OK') as failed from ({RECONCILED}) group by 1")(lambda t: i.bulk_batch_totals(reconciled(t)))
query("resolve_submitter", "select o_orderkey, case when o_custkey % 3 = 0 then o_custkey end as owner from orders")(
    lambda t: i.resolve_submitter(t.orders.select("o_orderkey", F.col("o_custkey").alias("submitted_by")), t.customer.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("user_id"))).select("o_orderkey", "owner")
)
query("scan_ingest_payload", "select event_id, event_type from events where event_id % 3 <> 0")(
    lambda t: i.split_valid(t.events.select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("event_type")), ("event_id", "event_type"))[0]
)
