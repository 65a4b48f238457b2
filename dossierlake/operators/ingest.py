"""Ingestion: portal feeds, validation, checksums, deduplication, storage paths."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: fixed values
SUGAM_TYPES = {"NewDrug": "drug", "GenericDrug": "drug", "NDA": "drug", "ANDA": "drug", "ClinicalTrial": "clinical_trial", "IND": "clinical_trial", "MedicalDevice": "medical_device", "SAE": "sae"}
SUBMISSION_TYPES = ("drug", "medical_device", "clinical_trial", "sae")
PORTALS = ("sugam", "md_online", "manual", "sae_feed")
TEXT_FAMILY = ("text/plain", "text/csv", "application/json", "application/xml", "text/xml")
SIGNATURES = [("25504446", "application/pdf"), ("504B0304", "application/zip"), ("504B0506", "application/zip"), ("89504E47", "image/png"), ("FFD8FF", "image/jpeg"), ("D0CF11E0", "application/msword"), ("3C3F786D6C", "application/xml")]
EXTRACTORS = {
    "application/pdf": "pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/xml": "xml",
    "text/xml": "xml",
    "text/csv": "csv",
    "text/tab-separated-values": "csv",
    "text/plain": "csv",
}
MB = 1024 * 1024

SUGAM_FEED = "array<struct<ApplicationID:string,ApplicantName:string,ApplicationType:string,SubmittedAt:string,Documents:array<struct<DocumentID:string,DocumentType:string,FileName:string,DownloadURL:string>>>>"
DEVICE_FEED = "array<struct<SubmissionID:string,ManufacturerName:string,DeviceClass:string,SubmissionDate:string,Attachments:array<struct<AttachmentID:string,OriginalFileName:string,DownloadLink:string>>>>"


def _canonical(rows: DataFrame, ident: str, name: str, when: str, docs: str, doc_id: str, file: str, url: str, kind: Column, portal: str) -> DataFrame:
    """Submissions with at least one document that has a URL; a bad time becomes null and the row stays."""
    has_url = lambda d: F.coalesce(d[url], F.lit("")) != ""
    fallback = lambda d: F.coalesce(F.nullif(d[file], F.lit("")), F.nullif(d[doc_id], F.lit("")), F.lit("document"))
    kept = F.transform(F.filter(F.col(docs), has_url), lambda d: F.struct(fallback(d).alias("filename"), d[url].alias("url")))
    return rows.select(
        F.col(ident).alias("external_id"), F.coalesce(F.nullif(name, F.lit("")), F.lit("Unknown")).alias("applicant"), kind.alias("submission_type"), F.lit(portal).alias("portal_source"),
        F.try_to_timestamp(F.col(when)).alias("submitted_at"), kept.alias("documents"),
    ).where(F.size("documents") > 0)


def portal_feed_sugam(feed: DataFrame, json: str = "json") -> DataFrame:
    """Canonical submissions of a drug portal's feed, a JSON object {applications: [...]} a row."""
    rows = feed.select(F.explode(F.from_json(json, f"struct<applications:{SUGAM_FEED}>")["applications"]).alias("a")).select("a.*")
    kind = F.lit("drug")
    for k, v in SUGAM_TYPES.items():
        kind = F.when(F.col("ApplicationType") == k, v).otherwise(kind)
    return _canonical(rows, "ApplicationID", "ApplicantName", "SubmittedAt", "Documents", "DocumentID", "FileName", "DownloadURL", kind, "sugam")


def portal_feed_md_online(feed: DataFrame, json: str = "json") -> DataFrame:
    """The same for a device portal, {submissions: [...]}: every class is a medical device."""
    rows = feed.select(F.explode(F.from_json(json, f"struct<submissions:{DEVICE_FEED}>")["submissions"]).alias("a")).select("a.*")
    return _canonical(rows, "SubmissionID", "ManufacturerName", "SubmissionDate", "Attachments", "AttachmentID", "OriginalFileName", "DownloadLink", F.lit("medical_device"), "md_online")


def validate_filename(name: Column) -> Column:
    """Null if a file name is fine, else the first rule that it breaks."""
    trimmed = F.trim(name)
    return (
        F.when(name.isNull() | (trimmed == ""), "empty")
        .when(F.length(trimmed) > 255, "too_long")
        .when(F.contains(trimmed, F.lit("\0")), "nul")
        .when(trimmed.rlike(r"\.\.[/\\]|[/\\]\.\."), "traversal")
        .when(trimmed.rlike(r"^[/\\]|^.:"), "absolute")
        .when(trimmed.rlike(r'[<>:"|?*\x00-\x1f]'), "characters")
    )


def validate_size(size: Column, max_mb: int = 100) -> Column:
    return F.when(size > max_mb * MB, "too_large")


def detect_mime(content: Column) -> Column:
    """Type by the first bytes; null if no signature fits."""
    head = F.hex(F.substring(content, 1, 8))
    out = F.lit(None).cast("string")
    for sign, mime in reversed(SIGNATURES):
        out = F.when(head.startswith(sign), mime).otherwise(out)
    return out


def validate_mime(detected: Column, claimed: Column, allowed: tuple[str, ...]) -> Column:
    """Null if the detected type is allowed and agrees with the claim; text kinds may stand for one another."""
    same_family = detected.isin(*TEXT_FAMILY) & claimed.isin(*TEXT_FAMILY)
    return F.when(detected.isNull(), "unknown").when(~detected.isin(*allowed), "not_allowed").when((claimed != "application/octet-stream") & (claimed != detected) & ~same_family, "mismatch")


def zip_members(files: DataFrame, id_col: str = "doc_id", content: str = "content") -> DataFrame:
    """(id, member, size, packed) of each zip file; a bad file gives one row with a null member."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, data in zip(pdf[id_col], pdf[content], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        rows += [(i, m.filename, m.file_size, m.compress_size) for m in z.infolist()]
                except zipfile.BadZipFile:
                    rows.append((i, None, None, None))
            yield pd.DataFrame(rows, columns=[id_col, "member", "size", "packed"])

    kind = files.schema[id_col].dataType.simpleString()
    return files.select(id_col, content).mapInPandas(run, f"{id_col} {kind}, member string, size long, packed long")


def validate_zip_bomb(members: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, reason): bad files, a member over 1 GiB, or a ratio over 100; null if fine.  Files without members are fine."""
    sums = members.groupBy(id_col).agg(F.bool_or(F.col("member").isNull()).alias("bad"), F.max("size").alias("largest"), F.sum("size").alias("size"), F.sum("packed").alias("packed"))
    return sums.select(id_col, F.when(F.col("bad"), "bad_zip").when(F.col("largest") > 1024 * MB, "member_too_large").when((F.col("packed") > 0) & (F.col("size") / F.when(F.col("packed") > 0, F.col("packed")) > 100), "ratio").alias("reason"))


def validate_xxe(head: Column) -> Column:
    """An external-entity declaration among the first 65,536 characters."""
    low = F.lower(F.substring(head, 1, 65_536))
    bad = F.contains(low, F.lit("<!doctype")) & (F.contains(low, F.lit("<!entity")) | (F.contains(low, F.lit("system")) & F.contains(low, F.lit("<!"))))
    return F.when(bad, "external_entity")


def validate_domains(submission_type: Column, portal: Column) -> Column:
    return F.when(~F.coalesce(submission_type.isin(*SUBMISSION_TYPES), F.lit(False)), "submission_type").when(~F.coalesce(portal.isin(*PORTALS), F.lit(False)), "portal")


def validate_cascade(name: Column, size: Column, mime_reason: Column, zip_reason: Column, xxe_reason: Column, claimed: Column, max_mb: int = 100) -> Column:
    """First failing code in fixed order; null if all pass."""
    return F.coalesce(
        F.when(validate_filename(name).isNotNull(), "FILENAME"), F.when(validate_size(size, max_mb).isNotNull(), "FILE_SIZE"), F.when(mime_reason.isNotNull(), "MIME_TYPE"),
        F.when(claimed.contains("zip") & zip_reason.isNotNull(), "ZIP_BOMB"), F.when(claimed.contains("xml") & xxe_reason.isNotNull(), "XML_XXE"),
    )


def content_checksum(content: Column) -> Column:
    return F.sha2(content, 256)


def assign_doc_id(key: Column) -> Column:
    """DOC- and 12 base-36 digits from the hash of a key; the same key gives the same id."""
    return F.concat(F.lit("DOC-"), F.lpad(F.conv(F.substring(F.sha2(key, 256), 1, 15), 16, 36), 12, "0"))


def id_collisions(rows: DataFrame, key: str) -> DataFrame:
    """Ids that more than one key has."""
    return rows.groupBy("doc_id").agg(F.countDistinct(key).alias("keys")).where("keys > 1")


def storage_path(kind: Column, created: Column, doc_id: Column, filename: Column) -> Column:
    return F.concat_ws("/", F.lit("raw"), kind, F.date_format(created, "yyyy"), F.date_format(created, "MM"), F.date_format(created, "dd"), doc_id, filename)


def parse_storage_path(path: Column) -> Column:
    """struct<submission_type, y, m, d, doc_id, filename> of a storage path."""
    part = lambda i: F.regexp_extract(path, r"raw/([^/]+)/(\d{4})/(\d{2})/(\d{2})/([^/]+)/([^/]+)$", i)
    return F.struct(*[part(i).alias(n) for i, n in enumerate(("submission_type", "y", "m", "d", "doc_id", "filename"), 1)])


def select_extractor(mime: Column) -> Column:
    out = F.lit("tika")
    for k, v in EXTRACTORS.items():
        out = F.when(mime == k, v).otherwise(out)
    return out


def dedup_exact(rows: DataFrame, checksum: str = "checksum_sha256", order: tuple[str, ...] = ("created_at", "doc_id")) -> DataFrame:
    """rows plus duplicate_of: the first document with the same checksum, null for the first itself.

    The first comes from an aggregate joined back, so a checksum that many rows share is no window in one task.
    """
    first = rows.groupBy(checksum).agg(F.min(F.struct(*order)).alias("f")).select(checksum, F.col("f.doc_id").alias("first_id"))
    return rows.join(first, checksum).withColumn("duplicate_of", F.when(F.col("first_id") != F.col("doc_id"), F.col("first_id"))).drop("first_id")


def bulk_reconcile(manifest: DataFrame, files: DataFrame, known: DataFrame) -> DataFrame:
    """Manifest entries (batch_id, filename) with their outcome: FILE_NOT_IN_ZIP, DUPLICATE and the known id, a
    validation code, or OK.  files: batch_id, filename, checksum, error_code.  known: checksum, existing_id."""
    joined = manifest.join(files.withColumn("_there", F.lit(True)), ["batch_id", "filename"], "left").join(known.dropDuplicates(["checksum"]), "checksum", "left")
    outcome = F.when(F.col("_there").isNull(), "FILE_NOT_IN_ZIP").when(F.col("error_code").isNotNull(), F.col("error_code")).when(F.col("existing_id").isNotNull(), "DUPLICATE").otherwise("OK")
    return joined.select("batch_id", "filename", outcome.alias("outcome"), F.when(outcome == "DUPLICATE", F.col("existing_id")).alias("existing_id"))


def bulk_batch_totals(reconciled: DataFrame) -> DataFrame:
    ok = F.count_if(F.col("outcome") == "OK")
    return reconciled.groupBy("batch_id").agg(F.count("*").alias("total"), ok.alias("successful"), (F.count("*") - ok).alias("failed"))


def resolve_submitter(rows: DataFrame, users: DataFrame) -> DataFrame:
    """rows plus owner: the submitter if there is such a user."""
    return rows.join(users.select(F.col("user_id").alias("owner")).distinct(), F.col("submitted_by") == F.col("owner"), "left")


def split_valid(rows: DataFrame, required: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Rows with all required fields, and the others with the names of those that are missing."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))
    marked = rows.withColumn("missing_fields", missing)
    return marked.where(F.size("missing_fields") == 0).drop("missing_fields"), marked.where(F.size("missing_fields") > 0)


def retain_newest(rows: DataFrame, key: str, order: str) -> DataFrame:
    newest = W.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r")
