"""Text preparation: normalising, dates, gibberish, language, metadata, tables, markup."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from dossierlake.functions.batches import small_batches
from dossierlake.functions.spans import let

#: fixed values
COMMON_WORDS = """the a an and or but in on at to for of with by from as is was are were be been being have has had do does did will would could should
may might shall can not this that these those he she it we they i you all any both each few more most other some such than too very just also patient drug dose mg
ml tablet capsule report india cdsco clinical trial submission application device medical regulatory approval study data adverse event safety efficacy treatment therapy""".split()
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
VERSION_PATTERNS = (r"(?i)\b(?:v|version)\s*([0-9]+\.[0-9]+(?:\.[0-9]+)?)\b", r"(?i)\b(?:rev|revision)\s*([0-9]+)\b")
APP_NUMBER = r"(?i)\b(?:application|app|file)\s*(?:no|num|number)?\s*[:.-]?\s*([A-Z0-9-]{6,15})\b"
ISO_DATE = r"\b(\d{4}-\d{2}-\d{2})\b"
TYPE_FIELDS = {
    "drug": {
        "applicant": r"(?:applicant|sponsor|company)[\s\w]*?:\s*([A-Za-z0-9\s.,&]{5,50})(?:\n|$)",
        "inn": r"(?:generic name|inn|active ingredient)[\s\w]*?:\s*([A-Za-z\s-]{3,40})(?:\n|$)",
        "brand": r"(?:brand name|trade name)[\s\w]*?:\s*([A-Za-z0-9\s-]{3,40})(?:\n|$)",
        "indication": r"(?:proposed indication|indication|therapeutic use)[\s\w]*?:\s*([A-Za-z0-9\s.,-]{10,150})(?:\n|$)",
    },
    "sae": {
        "event_type": r"(?i)(?:event|reaction)[\s\w]*?:\s*(death|hospitali[zs]ation|disability|life[- ]threatening|anomaly)",
        "suspect_drug": r"(?:suspect(?:ed)? drug|medication)[\s\w]*?:\s*([A-Za-z0-9\s-]{3,40})(?:\n|$)",
        "report_type": r"(?i)(?:report type)[\s\w]*?:\s*(initial|follow[- ]up|final)",
    },
    "medical_device": {
        "device_name": r"(?:device name|product name)[\s\w]*?:\s*([A-Za-z0-9\s-]{3,40})(?:\n|$)",
        "device_class": r"(?i)(?:device class|class of device)[\s\w]*?:\s*class\s*([A-D])",
        "manufacturer": r"(?:manufacturer)[\s\w]*?:\s*([A-Za-z0-9\s.,&]{5,50})(?:\n|$)",
    },
}


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


#: a character from U+0300 on; those below neither change nor combine under NFC
BEYOND_LATIN = r"[^\x00-\u02FF]"


def nfc(text: Column) -> Column:
    """Unicode NFC; only texts with characters that it may change travel to Python, in small batches."""
    session = SparkSession.getActiveSession()
    if session is not None:
        small_batches(session)
    return F.coalesce(_nfc(F.when(text.rlike(BEYOND_LATIN), text)), text)


#: what ends a line for Java's ^ and $, beside the newline
OTHER_ENDS = ("\x85", "\u2028", "\u2029")


def _any(test: Callable[[str], Column], parts: Iterable[str]) -> Column:
    return reduce(or_, map(test, parts))


def where_it_may(text: Column, needs: Callable[[Column], Column], change: Callable[[Column], Column]) -> Column:
    """change(text) where the text has what the change needs, else the text: to find a few bytes costs far less than a regex."""
    return let(text, lambda t: F.when(needs(t), change(t)).otherwise(t))


def _replaced(text: Column, needs: Callable[[Column], Column], pattern: str, by: str) -> Column:
    return where_it_may(text, needs, lambda t: F.regexp_replace(t, pattern, by))


def _holds(*parts: str) -> Callable[[Column], Column]:
    return lambda t: _any(t.contains, parts)


def _finds(pattern: str) -> Callable[[Column], Column]:
    return lambda t: t.rlike(pattern)


def _blank_at_ends(t: Column) -> Column:
    """Whether a line may end with blanks or tabs."""
    return _any(t.endswith, " \t") | _holds(" \n", "\t\n", *OTHER_ENDS)(t)


def _blank_at_edges(t: Column) -> Column:
    return _blank_at_ends(t) | _any(t.startswith, " \t") | _holds("\n ", "\n\t")(t)


def dates_to_iso(text: Column) -> Column:
    """d/m/yyyy with a possible day and month, Month d, yyyy and d Month yyyy as yyyy-mm-dd."""
    day, month = r"(0[1-9]|[12]\d|3[01]|[1-9])", r"(0[1-9]|1[0-2]|[1-9])"
    out = _replaced(text, _finds(r"\d[/-]\d{4}"), rf"\b{day}[/-]{month}[/-](\d{{4}})\b", "$3-0$2-0$1")
    out = _replaced(out, _finds(r"\d{4}-\d"), r"\b(\d{4})-0?(\d{2})-0?(\d{2})\b", "$1-$2-$3")
    # only months whose names a text holds are replaced, in the order of the year
    months = [
        F.struct(
            F.lit(name.lower()).alias("name"), F.lit(rf"(?i)\b{name}\s+(\d{{1,2}}),?\s+(\d{{4}})\b").alias("month_first"), F.lit(f"$2-{i:02d}-0$1").alias("as_first"),
            F.lit(rf"(?i)\b(\d{{1,2}})\s+{name}\s+(\d{{4}})\b").alias("day_first"), F.lit(f"$2-{i:02d}-0$1").alias("as_second"),
        )
        for i, name in enumerate(MONTHS, 1)
    ]
    replace = lambda t, m: F.regexp_replace(F.regexp_replace(t, m["month_first"], m["as_first"]), m["day_first"], m["as_second"])

    def named(t: Column) -> Column:
        held = lambda low: F.filter(F.array(*months), lambda m: F.contains(low, m["name"]))
        return let(F.lower(t), lambda low: F.aggregate(held(low), t, replace))

    return _replaced(where_it_may(out, _finds(r"\s\d{4}"), named), _holds("-0"), r"\b(\d{4})-(\d{2})-0(\d{2})\b", "$1-$2-$3")


def count_dates(text: Column) -> Column:
    names = "|".join(MONTHS)
    parts = (r"\b(0?[1-9]|[12]\d|3[01])[/-](0?[1-9]|1[0-2])[/-]\d{4}\b", rf"(?i)\b(?:{names})\s+\d{{1,2}},?\s+\d{{4}}\b", rf"(?i)\b\d{{1,2}}\s+(?:{names})\s+\d{{4}}\b")
    return sum((F.regexp_count(text, F.lit(p)) for p in parts), F.lit(0))


def clean_lines(text: Column, unicode_form: bool = True) -> Column:
    """Everything before the dates: NFC, control characters, line ends, blank lines, hyphen breaks, quotes, dashes, spaces."""
    out = nfc(text) if unicode_form else text
    out = F.regexp_replace(out, CONTROL, "")
    out = _replaced(out, _holds("\r"), "\r\n|\r", "\n")
    out = _replaced(out, _holds("\n\n\n"), "\n{3,}", "\n\n")
    out = _replaced(out, _blank_at_ends, r"(?m)[^\S\n]+$", "")
    out = _replaced(out, _holds("-\n"), r"(\w)-\n([a-z])", "$1$2")
    out = where_it_may(out, lambda t: (F.octet_length(t) > F.length(t)) & _holds(*"‘’‚‛“”„‟‒‑")(t), lambda t: F.translate(t, "‘’‚‛“”„‟‒‑", "''''\"\"\"\"--"))
    out = _replaced(out, _holds("–", "—"), "[–—]", " - ")
    out = _replaced(out, _holds("  ", "\t"), "[ \t]+", " ")
    return _replaced(out, _blank_at_edges, r"(?m)^[^\S\n]+|[^\S\n]+$", "")


def normalise_text(text: Column, unicode_form: bool = True) -> Column:
    # Java's $ also stands before a line's end that is the last character
    needs = lambda t: _any(t.startswith, " \t\n\v\f\r") | _any(t.endswith, [*" \t\n\v\f\r", *OTHER_ENDS])
    return _replaced(dates_to_iso(clean_lines(text, unicode_form)), needs, r"^\s+|\s+$", "")


def gibberish_windows(text: Column, width: int = 100) -> Column:
    """Windows of `width` characters with at least five words of which fewer than 30 per cent are common ones."""
    words = F.array(*[F.lit(w) for w in COMMON_WORDS])

    def suspect(at: Column) -> Column:
        tokens = F.regexp_extract_all(F.lower(F.substring(text, at, width)), F.lit("[a-z]+"), F.lit(0))
        return let(tokens, lambda t: (F.size(t) >= 5) & (F.size(F.filter(t, lambda w: F.array_contains(words, w))) < 0.3 * F.size(t)))

    return F.when(F.length(text) > 0, F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(width)), suspect))).otherwise(0)


def normalise_log(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs plus the counters of what normalising changes (over texts in NFC form)."""
    t = F.col(text)
    no_nul = F.replace(t, F.lit("\0"), F.lit(""))
    plain = F.regexp_replace(F.regexp_replace(no_nul, CONTROL, ""), "\r\n|\r", "\n")
    folded = F.regexp_replace(plain, "\n{3,}", "\n\n")
    stripped = F.regexp_replace(folded, r"(?m)[^\S\n]+$", "")
    return docs.withColumns(
        {
            "nuls": F.length(t) - F.length(no_nul),
            "control_chars": F.length(no_nul) - F.length(F.regexp_replace(no_nul, CONTROL, "")),
            "blank_lines": F.length(plain) - F.length(folded),
            "hyphen_chars": 2 * F.regexp_count(stripped, F.lit(r"\w-\n[a-z]")),
            "gibberish": gibberish_windows(t),
            "dates": count_dates(t),
        }
    )


def extract_title(text: Column, filename: Column) -> Column:
    """The first of 20 lines that is a heading of 6 to 199 characters, else the file's stem."""
    heads = F.transform(F.filter(F.slice(F.split(text, "\n"), 1, 20), lambda x: x.startswith("# ")), lambda x: F.trim(F.regexp_replace(x, "^[# ]+", "")))
    stem = F.translate(F.regexp_replace(filename, r"\.[^.]*$", ""), "_-", "  ")
    return F.coalesce(F.get(F.filter(heads, lambda x: (F.length(x) > 5) & (F.length(x) < 200)), F.lit(0)), stem)


def _first(head: Column, *patterns: str) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(head, p, 1), F.lit("")) for p in patterns])


def extract_version(text: Column) -> Column:
    return _first(F.substring(text, 1, 2000), *VERSION_PATTERNS)


def extract_app_number(text: Column) -> Column:
    return F.upper(_first(F.substring(text, 1, 2000), APP_NUMBER))


def extract_first_date(text: Column) -> Column:
    return _first(F.substring(text, 1, 2000), ISO_DATE)


def extract_type_fields(text: Column, kind: Column, case_sensitive: bool = True) -> Column:
    """map of the labelled fields of a submission type found in the first 5,000 characters; blank values are dropped."""
    head, none = F.substring(text, 1, 5000), F.create_map().cast("map<string,string>")
    out = none
    for k, fields in TYPE_FIELDS.items():
        pairs = [F.struct(F.lit(f).alias("key"), F.trim(F.regexp_extract(head, p if case_sensitive else "(?i)" + p, 1)).alias("value")) for f, p in fields.items()]
        out = F.when(kind == k, F.map_from_entries(F.filter(F.array(*pairs), lambda e: F.coalesce(e["value"], F.lit("")) != ""))).otherwise(out)
    return out


def extract_metadata(docs: DataFrame, text: str = "text", kind: str = "submission_type", filename: str = "original_filename") -> DataFrame:
    """docs plus metadata map<string,string> of universal and type fields without empty ones."""
    t = F.col(text)
    universal = {"title": extract_title(t, F.col(filename)), "version": extract_version(t), "application_number": extract_app_number(t), "document_date": extract_first_date(t)}
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in universal.items()]), lambda e: F.coalesce(e["value"], F.lit("")) != "")
    return docs.withColumn("metadata", F.map_concat(F.map_from_entries(entries), extract_type_fields(t, F.col(kind))))


def strip_meta_headers(text: Column) -> Column:
    """Without the leading block of `key: value` lines up to the first blank line."""
    return F.regexp_replace(text, r"^(?:[^\n:]+:[^\n]*\n)+\n", "")


def table_markdown(headers: Column, rows: Column) -> Column:
    """A markdown table; short rows are padded to the headers' width."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    padded = lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), F.size(headers))), F.lit(1), F.size(headers))
    return F.array_join(F.concat(F.array(line(headers), line(F.transform(headers, lambda _: F.lit("---")))), F.transform(rows, lambda r: line(padded(r)))), "\n")


def csv_delimiter(first_line: Column) -> Column:
    """Most frequent of comma, tab, semicolon and bar; ties in that order, none: comma."""
    count = lambda d: F.length(first_line) - F.length(F.replace(first_line, F.lit(d), F.lit("")))
    best = F.array_max(F.array(*[F.struct(count(d).alias("n"), F.lit(-i).alias("order"), F.lit(d).alias("d")) for i, d in enumerate(",\t;|")]))
    return best["d"]


#: column names that hold personal data (fixed values)
PII_COLUMNS = ("name", "patient_name", "email", "phone", "mobile", "address", "aadhaar", "pan", "dob", "date_of_birth", "patient_id", "subject_id")


def pii_columns(headers: Column) -> Column:
    clean = F.transform(headers, lambda h: F.translate(F.lower(F.trim(h)), " -", "__"))
    return F.array_intersect(clean, F.array(*[F.lit(c) for c in PII_COLUMNS]))


#: tags, comments and declarations of markup; what stands between them is data
MARKUP = r"(?s)<!--.*?-->|</?[A-Za-z][^>]*>|<[!?][^>]*>"
#: named references that text holds (fixed values); the ampersand last
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&"))


def markup_recover_text(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """(id, text): the non-blank data of possibly malformed markup, a piece a line.

    A tag that never closes is data.  References other than REFERENCES stay as they are.  Null markup has an empty text.
    """
    pieces = F.transform(F.split(F.coalesce(F.col(html), F.lit("")), MARKUP, -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    text = F.array_join(F.filter(pieces, lambda x: x != ""), "\n")
    for name, char in REFERENCES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return pages.select(id_col, text.alias("text"))


def header_footer_lines(blocks: DataFrame, min_pages: int = 3, first_pages: int = 10) -> DataFrame:
    """(doc, text) seen at least three times in one height bucket of the top or bottom tenth of the first pages."""
    per = blocks.groupBy("doc_id").agg(F.max("page").alias("pages")).where(F.col("pages") >= min_pages)
    edge = (F.col("y0") < 0.1 * F.col("height")) | (F.col("y0") > 0.9 * F.col("height"))
    found = blocks.where(edge & (F.col("page") <= first_pages)).join(per.select("doc_id"), "doc_id", "left_semi")
    return found.groupBy("doc_id", F.floor(F.col("y0") / 20).alias("bucket"), "text").agg(F.count("*").alias("n")).where("n >= 3").select("doc_id", "text").distinct()


def image_coverage(images: DataFrame, hybrid: float = 0.6) -> DataFrame:
    """Share of each page that images cover, at most 1, and whether the page is hybrid."""
    share = F.least(F.lit(1.0), F.sum(F.col("width") * F.col("height")) / F.max("page_area"))
    return images.groupBy("doc_id", "page").agg(share.alias("coverage")).withColumn("hybrid", F.col("coverage") > hybrid)


def ocr_routing(pages: DataFrame, ocr: DataFrame, least: int = 50) -> DataFrame:
    """Pages with images and little text take the text of their OCR result where there is one."""
    needs = (F.col("n_images") > 0) & (F.length(F.trim("text")) < least)
    joined = pages.join(ocr.select("doc_id", "page", F.col("text").alias("ocr_text")), ["doc_id", "page"], "left")
    return joined.select("doc_id", "page", needs.alias("needs_ocr"), F.when(needs & F.col("ocr_text").isNotNull(), F.concat_ws("\n", "text", "ocr_text")).otherwise(F.col("text")).alias("text"), F.when(needs, "hybrid").otherwise("text").alias("method"))


def ocr_candidate_pick(candidates: DataFrame, enough: int = 100) -> DataFrame:
    """Per page the first mode in order 6, 3, 11 with enough characters, else that with most (first on a tie)."""
    order = F.when(F.col("mode") == 6, 1).when(F.col("mode") == 3, 2).otherwise(3)
    good = F.col("chars") >= enough
    rank = W.partitionBy("doc_id", "page").orderBy(F.desc(good), F.when(good, 0).otherwise(-F.col("chars")), order)
    return candidates.withColumn("_r", F.row_number().over(rank)).where("_r = 1").drop("_r")


def reading_order(blocks: DataFrame) -> DataFrame:
    """Position of each block of a page: left column first, then height."""
    w = W.partitionBy("doc_id", "page").orderBy(F.when(F.col("x0") < F.col("page_width") / 2, 0).otherwise(1), "y0", "block_id")
    return blocks.withColumn("position", F.row_number().over(w))


def font_heading(spans: DataFrame, factor: float = 1.15, default: float = 10.0) -> DataFrame:
    """Spans larger than `factor` times the page's median size get a heading mark."""
    medians = spans.groupBy("doc_id", "page").agg(F.median("size").alias("median"))
    joined = spans.join(medians, ["doc_id", "page"])
    return joined.withColumn("text", F.when(F.col("size") > factor * F.coalesce("median", F.lit(default)), F.concat(F.lit("## "), "text")).otherwise(F.col("text"))).drop("median")


def table_continuation(tables: DataFrame) -> DataFrame:
    """Whether a table's header row equals that of the table before it in the document; one-row tables have no header."""
    header = F.when(F.col("n_rows") > 1, F.col("header"))
    w = W.partitionBy("doc_id").orderBy("page", "table_no")
    return tables.withColumn("continues", F.coalesce(header == F.lag(header).over(w), F.lit(False)))


def doc_page_totals(pages: DataFrame) -> DataFrame:
    """Per document the non-empty page texts joined in order, with words, characters and pages."""
    per = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"), F.count("*").alias("n_pages"))
    text = F.array_join(F.transform(F.filter("p", lambda x: F.trim(x["text"]) != ""), lambda x: x["text"]), "\n\n")
    words = F.aggregate("p", F.lit(0), lambda a, x: a + F.size(F.filter(F.split(x["text"], r"\s+"), lambda w: w != "")))
    return per.select("doc_id", text.alias("text"), words.alias("n_words"), F.aggregate("p", F.lit(0), lambda a, x: a + F.length(x["text"])).alias("n_chars"), "n_pages", (F.trim(text) == "").alias("is_empty"))
