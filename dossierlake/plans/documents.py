"""Queries over text preparation, chunks and vectors."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossierlake.operators import chunks as c
from dossierlake.operators import text as x
from dossierlake.operators import vectors as v
from dossierlake.operators.knn_index import build_index, search
from dossierlake.operators.language import detect_languages, learn_profiles
from dossierlake.plans.fixtures import NOW
from dossierlake.plans.registry import query

MESSY = r"concat('  ', text, case when doc_num % 2 = 0 then concat(chr(13), chr(10), chr(10), chr(10), chr(10), '  dated 7/3/2021 and 31-12-1999 or 45/3/2020 ') else '' end, ' on March 5, 2020 or 17 august 2019', chr(9), chr(9), ' end', chr(1))"
DUCK_CLEAN = rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({MESSY}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '\r\n|\r', chr(10), 'g'),
    '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g'), '(^|\n) ', '\1', 'g'), ' (\n|$)', '\1', 'g')"""


def messy(t):
    return t.submissions.select("doc_id", F.expr(MESSY).alias("text"))


DATED = rf"""regexp_replace(regexp_replace(regexp_replace({DUCK_CLEAN}, '\b7/3/2021\b', '2021-03-07', 'g'), '\b31-12-1999\b', '1999-12-31', 'g'), 'March 5, 2020 or 17 august 2019', '2020-03-05 or 2019-08-17', 'g')"""
query("normalise_text", f"select doc_id, trim({DATED}, chr(10) || ' ') as text from submissions")(lambda t: messy(t).select("doc_id", x.normalise_text(F.col("text")).alias("text")))
MONTH = "case doc_num % 12 " + " ".join(f"when {i} then '{m}'" for i, m in enumerate(x.MONTHS)) + " end"
#: days up to 33 and months up to 14, some with a nought in front, months by name in both orders and any case
DATES = f"""concat(cast(1 + doc_num % 33 as {{s}}), '/', cast(1 + doc_num % 14 as {{s}}), '/2021 or 0', cast(1 + doc_num % 9 as {{s}}), '-', cast(1 + doc_num % 12 as {{s}}), '-1999, ', {MONTH}, ' ', cast(1 + doc_num % 31 as {{s}}),
    case when doc_num % 2 = 0 then ', 2020 or ' else ' 2020 or ' end, cast(1 + doc_num % 29 as {{s}}), ' ', lower({MONTH}), ' 2019 of ', doc_id, ' 12/2020 ', upper({MONTH}), ' 2018')"""


def duck_dates(text: str) -> str:
    """Numeric dates turned round, then each month's name in both orders, then single digits filled."""
    out = rf"regexp_replace({text}, '\b(0[1-9]|[12]\d|3[01]|[1-9])[/-](0[1-9]|1[0-2]|[1-9])[/-](\d{{4}})\b', '\3-\2-\1', 'g')"
    for i, m in enumerate(x.MONTHS, 1):
        out = rf"regexp_replace(regexp_replace({out}, '(?i)\b{m}\s+(\d{{1,2}}),?\s+(\d{{4}})\b', '\2-{i:02d}-\1', 'g'), '(?i)\b(\d{{1,2}})\s+{m}\s+(\d{{4}})\b', '\2-{i:02d}-\1', 'g')"
    return rf"regexp_replace(regexp_replace({out}, '\b(\d{{4}})-(\d)-', '\1-0\2-', 'g'), '\b(\d{{4}}-\d{{2}})-(\d)\b', '\1-0\2', 'g')"


query("dates_to_iso", f"select doc_id, {duck_dates(DATES.format(s='varchar'))} as text from submissions")(
    lambda t: t.submissions.select("doc_id", x.dates_to_iso(F.expr(DATES.format(s="string"))).alias("text"))
)
query(
    "normalise_log",
    """select doc_id, 0 as nuls, 1 as control_chars, case when doc_num % 2 = 0 then 1 else 0 end * 2 as blank_lines, 0 as hyphen_chars, case when doc_num % 2 = 0 then 5 - 1 else 2 end as dates from submissions""",
)(lambda t: x.normalise_log(messy(t)).select("doc_id", "nuls", "control_chars", "blank_lines", "hyphen_chars", "dates"))
WORDS = "[" + ", ".join(f"'{w}'" for w in x.COMMON_WORDS) + "]"
query(
    "gibberish_windows",
    f"""select doc_id, count(*) filter (n >= 5 and hits < 0.3 * n) as windows from (select doc_id, len(w) as n, len(list_filter(w, lambda y: list_contains({WORDS}, y))) as hits from (
    select doc_id, regexp_extract_all(lower(substr(text, k * 100 + 1, 100)), '[a-z]+') as w from (select doc_id, text, unnest(range((length(text) + 99) // 100)) as k from submissions))) group by 1""",
)(lambda t: t.submissions.select("doc_id", x.gibberish_windows(F.col("text")).cast("long").alias("windows")))
query("language_detect")(lambda t: detect_languages(t.documents, learn_profiles(t.documents)).select("doc_id", "lang", "language", "probability", "multilingual"))
TITLED = """concat(case doc_num % 5 when 0 then '' when 1 then concat(chr(10), chr(10), '# Short', chr(10)) when 2 then concat('## no title', chr(10)) else concat('# ', case when doc_num % 7 = 0 then '#  ' else '' end, 'Title of ', doc_id, chr(10)) end,
    case doc_num % 4 when 0 then 'Rev ' when 1 then 'v' else 'Version ' end, cast(doc_num % 7 as {s}), case when doc_num % 4 = 0 then ' ' else concat('.', cast(doc_num % 3 as {s})) end, case when doc_num % 6 = 0 then '.2' else '' end, ' application no: ab-',
    cast(100000 + doc_num as {s}), ' on ', case when doc_num % 3 = 0 then '02-01-2020' else concat('2020-01-', lpad(cast(1 + doc_num % 28 as {s}), 2, '0')) end, chr(10), 'applicant name: Firm ', doc_id, chr(10), text)""".replace("\n", " ")


def titled(t):
    return t.submissions.withColumn("text", F.expr(TITLED.format(s="string")))


DUCK_HEAD = f"substr({TITLED.format(s='varchar')}, 1, 2000)"
HEADINGS = f"list_filter(list_transform(list_filter(string_split({TITLED.format(s='varchar')}, chr(10))[1:20], lambda l: starts_with(l, '# ')), lambda l: trim(regexp_replace(l, '^[# ]+', ''))), lambda l: length(l) > 5 and length(l) < 200)"
query("extract_title", rf"select doc_id, coalesce(({HEADINGS})[1], translate(regexp_replace(original_filename, '\.[^.]*$', ''), '_-', '  ')) as title from submissions")(
    lambda t: titled(t).select("doc_id", x.extract_title(F.col("text"), F.col("original_filename")).alias("title"))
)
DUCK_VERSION = "coalesce(" + ", ".join(f"nullif(regexp_extract({DUCK_HEAD}, '{p}', 1), '')" for p in x.VERSION_PATTERNS) + ")"
query("extract_version", f"select doc_id, {DUCK_VERSION} as version from submissions")(lambda t: titled(t).select("doc_id", x.extract_version(F.col("text")).alias("version")))
query("extract_app_number", f"select doc_id, upper(nullif(regexp_extract({DUCK_HEAD}, '{x.APP_NUMBER}', 1), '')) as number from submissions")(lambda t: titled(t).select("doc_id", x.extract_app_number(F.col("text")).alias("number")))
query("extract_first_date", f"select doc_id, nullif(regexp_extract({DUCK_HEAD}, '{x.ISO_DATE}', 1), '') as day from submissions")(lambda t: titled(t).select("doc_id", x.extract_first_date(F.col("text")).alias("day")))
FIELDS = sorted({f for fields in x.TYPE_FIELDS.values() for f in fields})


def duck_field(field: str) -> str:
    """A labelled field of the titled text, null where its type has none or it is blank."""
    found = {k: fields[field] for k, fields in x.TYPE_FIELDS.items() if field in fields}
    return "nullif(trim(case submission_type " + " ".join(f"when '{k}' then regexp_extract(substr(titled, 1, 5000), '{p}', 1)" for k, p in found.items()) + f" end), '') as {field}"


LABELLED = "concat({t}, ' \nSponsor name: Acme & Sons, ', {doc}, '\nINN: para zol\nevent type: DEATH\nDevice Class: class C\nreport type: follow-up\nsuspect drug: X-', cast(doc_num as {s}), '\n')"
DUCK_TITLED = "select *, " + LABELLED.format(t=TITLED.format(s="varchar"), doc="replace(doc_id, '-', ' ')", s="varchar").replace("\n", "' || chr(10) || '") + " as titled from submissions"


def labelled(t):
    return t.submissions.withColumn("text", F.expr(LABELLED.format(t=TITLED.format(s="string"), doc="replace(doc_id, '-', ' ')", s="string").replace("\n", "' || chr(10) || '")))


query("extract_type_fields", f"select doc_id, {', '.join(map(duck_field, FIELDS))} from ({DUCK_TITLED})")(
    lambda t: labelled(t).select("doc_id", x.extract_type_fields(F.col("text"), F.col("submission_type")).alias("m")).select("doc_id", *[F.col("m")[f].alias(f) for f in FIELDS])
)
UNIVERSAL = rf"""coalesce(({HEADINGS})[1], translate(regexp_replace(original_filename, '\.[^.]*$', ''), '_-', '  ')) as title, {DUCK_VERSION} as version,
    upper(nullif(regexp_extract({DUCK_HEAD}, '{x.APP_NUMBER}', 1), '')) as application_number, nullif(regexp_extract({DUCK_HEAD}, '{x.ISO_DATE}', 1), '') as document_date"""
query("extract_metadata", f"select doc_id, {UNIVERSAL}, {', '.join(map(duck_field, FIELDS))} from ({DUCK_TITLED})")(
    lambda t: x.extract_metadata(labelled(t)).select("doc_id", *[F.col("metadata")[f].alias(f) for f in ("title", "version", "application_number", "document_date", *FIELDS)])
)
query("strip_meta_headers", "select doc_id, text from submissions")(lambda t: t.submissions.select("doc_id", x.strip_meta_headers(F.concat(F.lit("Author: a\nPages: 3\n\n"), "text")).alias("text")))
query("table_markdown", "select r_regionkey, concat('| k | n |', chr(10), '| --- | --- |', chr(10), string_agg(concat('| ', cast(n_nationkey as varchar), ' | ', n_name, ' |'), chr(10) order by n_nationkey)) as md from region join nation on n_regionkey = r_regionkey group by 1")(
    lambda t: t.nation.groupBy(F.col("n_regionkey").alias("r_regionkey"))
    .agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("r"))
    .select("r_regionkey", x.table_markdown(F.array(F.lit("k"), F.lit("n")), F.transform("r", lambda y: F.array(y["n_nationkey"].cast("string"), y["n_name"]))).alias("md"))
)
query("csv_delimiter", "select event_id, case when event_id % 4 = 0 then ',' when event_id % 4 = 1 then ';' when event_id % 4 = 2 then '|' else ',' end as d from events")(
    lambda t: t.events.select("event_id", x.csv_delimiter(F.when(F.col("event_id") % 4 == 0, "a,b,c;d").when(F.col("event_id") % 4 == 1, "a;b;c,d").when(F.col("event_id") % 4 == 2, "a|b").otherwise(F.col("event_type"))).alias("d"))
)
query("pii_columns", "select doc_id, case doc_num % 3 when 0 then 'patient_name,email' when 1 then 'dob' else '' end as pii from submissions")(
    lambda t: t.submissions.select("doc_id", F.array_join(x.pii_columns(F.when(F.col("doc_num") % 3 == 0, F.array(F.lit("Patient Name"), F.lit("Email"), F.lit("x"))).when(F.col("doc_num") % 3 == 1, F.array(F.lit("DOB"))).otherwise(F.array(F.col("lang")))), ",").alias("pii"))
)
PLAIN = "array_to_string(list_filter(list_transform(string_split_regex(html, '" + x.MARKUP + "'), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> ''), chr(10))"
for name, char in x.REFERENCES:
    PLAIN = f"replace({PLAIN}, '{name.replace(chr(39), chr(39) * 2)}', '{char.replace(chr(39), chr(39) * 2)}')"
query("markup_recover_text", f"select page_id, {PLAIN} as text from pages")(lambda t: x.markup_recover_text(t.pages))
BLOCKS = "select l_orderkey as doc_id, l_linenumber as page, case when l_quantity < 25 then 'Header' else l_returnflag end as text, cast(l_quantity * 16 as double) as y0, 800.0 as height from lineitem"
query(
    "header_footer_lines",
    f"select distinct doc_id, text from (select doc_id, floor(y0 / 20) as b, text, count(*) as n from ({BLOCKS}) where (y0 < 80 or y0 > 720) and page <= 10 and doc_id in (select doc_id from ({BLOCKS}) group by 1 having max(page) >= 3) group by 1, 2, 3) where n >= 3",
)(lambda t: x.header_footer_lines(t.lineitem.selectExpr("l_orderkey as doc_id", "l_linenumber as page", "case when l_quantity < 25 then 'Header' else l_returnflag end as text", "double(l_quantity * 16) as y0", "double(800) as height")))
query("image_coverage", "select l_orderkey as doc_id, l_suppkey % 2 as page, round(least(1.0, sum(cast(l_quantity as double) * 10) / 1000.0), 6) as coverage, least(1.0, sum(cast(l_quantity as double) * 10) / 1000.0) > 0.6 as hybrid from lineitem group by 1, 2")(
    lambda t: x.image_coverage(t.lineitem.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_suppkey") % 2).alias("page"), F.col("l_quantity").cast("double").alias("width"), F.lit(10.0).alias("height"), F.lit(1000.0).alias("page_area"))).withColumn("coverage", F.round("coverage", 6))
)
CANDIDATES = "(l_linenumber - 1) // 3 + 1 as page, case l_linenumber % 3 when 1 then 6 when 2 then 3 else 11 end as mode, cast(l_quantity as int) * 4 as chars"
query(
    "ocr_candidate_pick",
    f"""select doc_id, page, mode from (select *, row_number() over (partition by doc_id, page order by (chars >= 100) desc, case when chars >= 100 then 0 else -chars end, case mode when 6 then 1 when 3 then 2 else 3 end) as r
    from (select l_orderkey as doc_id, {CANDIDATES} from lineitem)) where r = 1""",
)(lambda t: x.ocr_candidate_pick(t.lineitem.selectExpr("l_orderkey as doc_id", *CANDIDATES.replace("//", "div").split(", "))).select("doc_id", F.col("page").cast("int").alias("page"), "mode"))
query("ocr_routing", "select event_id as doc_id, event_id % 3 <> 0 as needs_ocr, case when event_id % 3 <> 0 then 'hybrid' else 'text' end as method from events")(
    lambda t: x.ocr_routing(t.events.selectExpr("event_id as doc_id", "1 as page", "event_type as text", "event_id % 3 as n_images"), t.events.where("event_id % 2 = 0").selectExpr("event_id as doc_id", "1 as page", "props as text")).select("doc_id", "needs_ocr", "method")
)
query("reading_order", "select l_orderkey as doc_id, l_linenumber as block_id, row_number() over (partition by l_orderkey order by case when l_suppkey % 100 < 50 then 0 else 1 end, l_quantity, l_linenumber) as position from lineitem")(
    lambda t: x.reading_order(t.lineitem.selectExpr("l_orderkey as doc_id", "1 as page", "l_linenumber as block_id", "l_suppkey % 100 as x0", "l_quantity as y0", "100 as page_width")).select("doc_id", "block_id", "position")
)
query("font_heading", "select l_orderkey as doc_id, l_linenumber as n, case when l_quantity > 1.15 * median(l_quantity) over (partition by l_orderkey) then concat('## ', l_returnflag) else l_returnflag end as text from lineitem")(
    lambda t: x.font_heading(t.lineitem.selectExpr("l_orderkey as doc_id", "1 as page", "l_linenumber as n", "double(l_quantity) as size", "l_returnflag as text")).select("doc_id", "n", "text")
)
query("table_continuation", "select doc_id, table_no, coalesce(h = lag(h) over (partition by doc_id order by table_no), false) as continues from (select l_orderkey as doc_id, l_linenumber as table_no, case when l_linenumber % 4 <> 0 then min(l_returnflag) end as h from lineitem group by 1, 2)")(
    lambda t: x.table_continuation(t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("header")).selectExpr("l_orderkey as doc_id", "1 as page", "l_linenumber as table_no", "header", "case when l_linenumber % 4 <> 0 then 2 else 1 end as n_rows")).select("doc_id", "table_no", "continues")
)
query("doc_page_totals", "select conv_id as doc_id, count(*) as n_pages, cast(sum(length(text)) as bigint) as n_chars, coalesce(string_agg(text, chr(10) || chr(10) order by turn) filter (trim(text) <> ''), '') as text from conversations group by 1")(
    lambda t: x.doc_page_totals(t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text")).select("doc_id", "n_pages", F.col("n_chars").cast("long").alias("n_chars"), "text")
)

# --- chunks --------------------------------------------------------------------------------------------------------


def headed(t):
    return t.documents.select("doc_id", F.concat(F.lit("intro line\n# First part\n"), "text", F.lit("\nSECOND PART, 2\nbody\nUnder\n-----\ntail")).alias("text"))


query("split_sections", "select doc_id, unnest([0, 1]) as no, unnest([null, 'First part']) as title, unnest(['intro line', concat('# First part', chr(10), lower(replace(text, chr(10), ' ')))]) as body from documents")(
    lambda t: t.documents.select("doc_id", F.posexplode(c.split_sections(F.concat(F.lit("intro line\n# First part\n"), F.lower(F.replace("text", F.lit("\n"), F.lit(" ")))))).alias("no", "s")).select("doc_id", "no", "s.title", "s.body")
)
query("merge_small_sections")(lambda t: headed(t).select("doc_id", F.size(c.merge_small_sections(c.split_sections(F.col("text")))).alias("n")))
query("chunk_text")(lambda t: c.chunk_text(headed(t)))
query("chunk_links")(lambda t: c.chunk_links(c.chunk_text(headed(t))).select("doc_id", "chunk_id", "total_chunks", "prev_chunk_id", "next_chunk_id"))
query("all_chunks")(
    lambda t: c.chunk_text(headed(t)).select(F.col("doc_id").cast("string").alias("doc_id"), "chunk_id", F.lit("text").alias("chunk_type")).unionByName(c.chunk_tables(tables(t)).select("doc_id", "chunk_id", F.lit("table").alias("chunk_type")))
)


def runs(t):
    """A run of each document: every ninth failed, every third was read by OCR."""
    n, words = F.col("doc_id"), F.size(F.split("text", " "))
    return t.documents.select(
        "doc_id", F.when(n % 9 == 0, "ValueError: unreadable").alias("error"), (n % 3 == 0).alias("ocr_used"), (n % 3 == 0).cast("int").alias("ocr_pages"), (0.5 + n % 5 / 10).alias("ocr_mean"), (1 + n % 4).cast("int").alias("page_count"),
        words.alias("word_count"), (n % 2).cast("int").alias("table_count"), F.col("lang").alias("language"), F.when(n % 4 == 0, 0.5).otherwise(0.99).alias("language_confidence"), (n % 8 == 0).alias("multilingual"),
        F.when(n % 3 == 0, F.array(F.lit("pdf"), F.lit("ocr"))).otherwise(F.array(F.lit("pdf"))).alias("extractors_used"), F.array(F.lit("Stripped lines")).alias("changes"), F.when(n % 5 == 0, F.array(F.lit("CORRUPTED page"))).otherwise(F.array().cast("array<string>")).alias("warnings"),
        F.lit("2024-01-05 10:00:00").cast("timestamp").alias("started_at"), (F.lit("2024-01-05 10:00:00").cast("timestamp") + F.make_dt_interval(secs=(n % 50).cast("int"))).alias("finished_at"),
    )


def pieces(t):
    """A chunk of each conversation's turn, as the documents' chunks."""
    return t.conversations.select(F.col("conv_id").alias("doc_id"))


LOG = """select d.doc_id, d.doc_id % 9 = 0 as failed, d.lang, round(greatest(0, 1 - (case when d.doc_id % 3 = 0 then 0.15 + greatest(0, 0.8 - (0.5 + (d.doc_id % 5) / 10)) else 0 end + case when d.doc_id % 4 = 0 then 0.1 else 0 end + case when d.doc_id % 5 = 0 then 0.05 else 0 end)), 3) as conf,
    len(string_split(text, ' ')) as words, coalesce(n, 0) as n, doc_id % 3 = 0 as ocr, doc_id % 2 > 0 as tables, doc_id % 8 = 0 as multi, doc_id % 5 = 0 as corrupt from documents d left join (select conv_id, count(*) as n from conversations group by 1) c on c.conv_id = d.doc_id"""
query(
    "processing_log_rows",
    f"""select doc_id, '1.0.0' as pipeline_version, case when failed then 'ValueError: unreadable' end as error_detail, case when not failed then conf end as extraction_confidence, case when not failed then words end as word_count, case when not failed then n end as chunk_count,
    case when not failed then lang end as language, case when not failed then case when ocr then 'pdf,ocr' else 'pdf' end end as extractors, case when not failed then '["Stripped lines"]' end as normalisation_changes, case when not failed then doc_id % 50 * 1000 end as processing_duration_ms,
    case when not failed then concat('{{"needs_review":', conf < 0.7, ',"low_confidence":', conf < 0.5, ',"has_tables":', tables, ',"is_multilingual":', multi, ',"ocr_used":', ocr, ',"encrypted":false,"corrupted":', corrupt, ',"needs_translation":', lang <> 'en', ',"has_pii":false}}') end as flags from ({LOG})""",
)(
    lambda t: c.processing_log(runs(t), pieces(t)).select(
        "doc_id", "pipeline_version", "error_detail", "extraction_confidence", "word_count", "chunk_count", "language", F.array_join("extractors_used", ",").alias("extractors"), "normalisation_changes", "processing_duration_ms", "flags"
    )
)
query("processed_submissions", f"select doc_id, case when failed then 'queued' else 'processed' end as status, case when not failed then conf end as preprocessing_confidence, case when not failed then n end as chunk_count from ({LOG})")(
    lambda t: c.processed_submissions(t.documents.select("doc_id", F.lit("queued").alias("status")), c.processing_log(runs(t), pieces(t)), F.lit(NOW).cast("timestamp")).select("doc_id", "status", "preprocessing_confidence", "chunk_count")
)
query("chunk_runs", "select doc_id, case when trim(text) = '' then 'failed' else 'processed' end as status from documents")(lambda t: c.processing_log_rows(t.documents, c.chunk_text(t.documents)).select("doc_id", "status"))
query("chunks_to_text", "select conv_id as doc_id, coalesce(string_agg(trim(text), chr(10) || chr(10) order by turn) filter (trim(text) <> ''), '') as text from conversations group by 1")(
    lambda t: c.chunks_to_text(t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index"), "text"))
)


def tables(t):
    """Orders of a customer as one table of two columns."""
    line = F.array(F.col("o_orderkey").cast("string"), F.col("o_orderstatus"))
    rows = t.orders.groupBy(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("doc_id")).agg(F.array_sort(F.collect_list(line)).alias("rows"))
    # every order is a row of six parts, so that some customers' tables are longer than one chunk
    rows = rows.withColumn("rows", F.flatten(F.transform("rows", lambda r: F.array_repeat(r, 6))))
    return rows.select("doc_id", F.lit(1).alias("table_no"), F.lit(1).alias("page"), F.array(F.lit("order"), F.lit("status")).alias("headers"), "rows")


query(
    "chunk_tables",
    """select doc_id, part, case when n > 50 then least(25, n - (part - 1) * 25) else n end as n_rows, case when n > 50 then (n + 24) // 25 else 1 end as parts from (
    select *, unnest(range(1, case when n > 50 then (n + 24) // 25 else 1 end + 1)) as part from (select concat('C', cast(o_custkey as varchar)) as doc_id, count(*) * 6 as n from orders group by 1))""",
)(lambda t: c.chunk_tables(tables(t)).select("doc_id", F.col("part").cast("long").alias("part"), F.col("n_rows").cast("long").alias("n_rows"), F.max("part").over(W.partitionBy("doc_id")).cast("long").alias("parts")))
query("extraction_confidence", "select event_id, round(greatest(0, 1 - (case when event_id % 2 = 0 then 0.15 + greatest(0, 0.8 - 0.7) else 0 end + case when event_id % 3 = 0 then 0.1 else 0 end + 0.05 * (event_id % 4))), 3) as confidence from events")(
    lambda t: t.events.select("event_id", c.extraction_confidence(F.col("event_id") % 2 == 0, F.lit(0.7), F.when(F.col("event_id") % 3 == 0, 0.5).otherwise(0.9), F.col("event_id") % 4).alias("confidence"))
)
query("quality_flags", "select event_id, (event_id % 10) / 10 < 0.7 as needs_review, event_id % 3 > 0 as has_tables, event_id % 5 = 0 as corrupted, event_id % 2 = 1 as needs_translation from events")(
    lambda t: t.events.select("event_id", c.quality_flags((F.col("event_id") % 10) / 10, F.col("event_id") % 3, F.lit(False), F.lit(False), F.when(F.col("event_id") % 2 == 1, "fr").otherwise("en"), F.when(F.col("event_id") % 5 == 0, F.array(F.lit("file CORRUPTED"))).otherwise(F.array(F.col("event_type")))).alias("f"))
    .select("event_id", "f.needs_review", "f.has_tables", "f.corrupted", "f.needs_translation")
)

# --- vectors -------------------------------------------------------------------------------------------------------

COLLECTION = "case label % 4 when 0 then 'drug_applications' when 1 then 'medical_devices' when 2 then 'clinical_trials' else 'adverse_events' end"


def vectors(t):
    return t.embeddings.select("vec_id", F.expr(COLLECTION).alias("collection"), F.col("embedding").cast("array<double>").alias("v"))


query("collection_of", "select doc_id, case submission_type when 'drug' then 'drug_applications' when 'medical_device' then 'medical_devices' when 'clinical_trial' then 'clinical_trials' else 'adverse_events' end as collection from submissions")(
    lambda t: t.submissions.select("doc_id", v.collection_of(F.col("submission_type")).alias("collection"))
)
query("l2_normalise", "select vec_id, i, round(embedding[i] / sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) as x from (select vec_id, embedding, unnest(range(1, len(embedding) + 1)) as i from embeddings)")(
    lambda t: vectors(t).select("vec_id", F.posexplode(v.l2_normalise(F.col("v"))).alias("i", "x")).select("vec_id", (F.col("i") + 1).cast("long").alias("i"), F.round("x", 6).alias("x"))
)
KNN = f"""select query_id, vec_id, d, rank from (select *, row_number() over (partition by query_id order by d, vec_id) as rank from (select q.vec_id as query_id, c.vec_id, 1 - list_dot_product(q.v, c.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(c.v, c.v)) as d
    from (select vec_id, {COLLECTION} as k, embedding::double[] as v from embeddings where vec_id % 20 = 0) q join (select vec_id, {COLLECTION} as k, embedding::double[] as v from embeddings) c using (k))) where rank <= 6"""
query("knn_exact", f"select query_id, vec_id, rank from ({KNN}) where query_id <> vec_id")(lambda t: v.knn_exact(vectors(t).where("vec_id % 20 = 0"), vectors(t)).where("query_id <> vec_id").select("query_id", "vec_id", "rank"))
query("topk_neighbours", f"select query_id, vec_id, round(d, 6) as distance, rank from ({KNN})")(
    lambda t: search(build_index(vectors(t)), vectors(t).where("vec_id % 20 = 0")).select("query_id", "vec_id", F.round("distance", 6).alias("distance"), "rank")
)


def planted(t):
    """The corpus and, of every fifth vector, a copy with one component raised by a tenth of the vector's length."""
    rows = vectors(t)
    length = F.sqrt(v.dot(F.col("v"), F.col("v")))
    copies = rows.where("vec_id % 5 = 0").select((F.col("vec_id") + 10_000_000).alias("vec_id"), "collection", F.transform("v", lambda y, i: F.when(i == F.col("vec_id") % 64, y + 0.1 * length).otherwise(y)).alias("v"))
    return rows.unionByName(copies)


PLANTED = f"""select vec_id, k, v from (select vec_id, {COLLECTION} as k, embedding::double[] as v from embeddings)
    union all select vec_id + 10000000, k, list_transform(v, lambda y, i: case when i - 1 = vec_id % 64 then y + 0.1 * sqrt(list_dot_product(v, v)) else y end) from (select vec_id, {COLLECTION} as k, embedding::double[] as v from embeddings where vec_id % 5 = 0)"""
PLANTED_KNN = f"""select query_id, vec_id, d from (select *, row_number() over (partition by query_id order by d, vec_id) as rank from (select q.vec_id as query_id, c.vec_id, 1 - list_dot_product(q.v, c.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(c.v, c.v)) as d
    from (select * from ({PLANTED}) where vec_id % 20 = 0) q join ({PLANTED}) c using (k))) where rank <= 6"""
query("duplicate_candidates", f"select query_id, vec_id, round(1 - d, 4) as similarity from ({PLANTED_KNN}) where query_id <> vec_id and round(1 - d, 4) >= 0.92")(
    lambda t: v.duplicate_candidates(search(build_index(planted(t)), planted(t).where("vec_id % 20 = 0")))
)
query("embed_texts")(lambda t: t.documents.select("doc_id", v.embed_texts(F.col("text")).alias("e")).select("doc_id", F.round(v.dot(F.col("e"), F.col("e")), 6).alias("norm"), F.round(F.get("e", F.lit(0)), 6).alias("first")))
query("embedding_cache_join", "select doc_id, sha256(text) in (select sha256(text) from documents where doc_id % 3 = 0) as hit from documents")(
    lambda t: v.embedding_cache_join(
        t.documents.select("doc_id", "text"), t.documents.where("doc_id % 3 = 0").select(F.sha2("text", 256).alias("hash"), F.array(F.lit(0.5)).alias("v"), F.lit(NOW).cast("timestamp").alias("cached_at")).dropDuplicates(["hash"]), NOW, 7
    ).select("doc_id", "hit")
)
query("doc_vector")(lambda t: v.doc_vector(c.chunk_text(t.documents), c.chunk_text(t.documents).select("chunk_id", v.embed_texts(F.col("text")).alias("v"))).select("doc_id", "chunk_id", F.round(F.get("v", F.lit(0)), 6).alias("first")))
query("vector_metadata")(lambda t: v.vector_metadata(c.chunk_text(t.documents)))
