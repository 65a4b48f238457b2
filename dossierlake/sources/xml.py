"""XML documents as rows, by column expressions: tokens by one pattern, depths by sums, paths by the last tag of each level.

A document's tokens (tags, texts, character data, comments, instructions) are an array of its row.  The depth of a tag is
the running count of what is open; the path of an element is the name last opened on each level above it; a closing tag must
follow, on its own level, an opening one of its name.  Only the check for repeated ids moves documents, once; tokens stay in
their row, and no parser runs in Python.  Documents that don't hold together are reported, not read in part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossierlake.functions.spans import let, running_sum

#: levels below the root that a flattened document shows (fixed value)
MAX_DEPTH = 12
NAME = r"[\p{L}_:][\p{L}\p{N}_:.\-]*+"
ATTRIBUTE = rf"""\s++({NAME})\s*+=\s*+("[^"<]*+"|'[^'<]*+')"""
#: comment, character data, instruction, document type, closing tag, opening tag, text; at last whatever else begins with <
TOKEN = rf"""(?s)<!--(?:(?!--).)*+-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<!DOCTYPE[^>]*+>|</{NAME}\s*+>|<{NAME}(?:{ATTRIBUTE})*+\s*+/?>|[^<]++|<"""
#: names of character references (fixed values)
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"))
REFERENCE = r"&#(?:x[0-9A-Fa-f]{1,6}|[0-9]{1,7});"
#: resources and attributes that make and carry clinical documents, and elements passed over (fixed values)
FHIR_ROOTS = ("Bundle", "Patient", "Observation", "MedicationStatement", "MedicationRequest", "Condition", "AllergyIntolerance", "AdverseEvent", "Device", "Practitioner", "Organization")
FHIR_NAMESPACE = "hl7.org/fhir"
FHIR_ATTRIBUTES, FHIR_SKIPPED = ("value", "system", "code", "display", "url"), ("text", "div", "status")


def _character(ref: Column) -> Column:
    """The character of a numeric reference; a number that is none gives an empty text."""
    digits = F.regexp_extract(ref, r"&#x?([0-9A-Fa-f]+);", 1)
    number = F.when(ref.startswith("&#x"), F.conv(digits, 16, 10)).otherwise(digits).cast("long")
    fine = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
    return F.when(fine, F.decode(F.unhex(F.lpad(F.hex(F.when(fine, number).otherwise(F.lit(32).cast("long"))), 8, "0")), "UTF-32")).otherwise("")


def unescape(text: Column) -> Column:
    """References to characters resolved, those to & last; most texts have none."""
    whole = F.zip_with(F.split(text, REFERENCE, -1), F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)), _character), lambda gap, ch: F.concat(gap, F.coalesce(ch, F.lit(""))))
    out = F.when(text.contains("&#"), F.array_join(whole, "")).otherwise(text)
    for name, ch in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(ch))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def _local(name: Column) -> Column:
    return F.regexp_extract(name, r"([^:]*)$", 1)


def _attributes(tag: Column) -> Column:
    """array<struct<name, value>> of an opening tag, without those that declare name spaces."""
    names, values = F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(1)), F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(2))
    pairs = F.zip_with(names, values, lambda n, v: F.struct(n.alias("name"), unescape(F.substring(v, F.lit(2), F.length(v) - 2)).alias("value")))
    return F.transform(F.filter(pairs, lambda p: ~p["name"].rlike(r"^xmlns(:|$)")), lambda p: F.struct(_local(p["name"]).alias("name"), p["value"].alias("value")))


def _declared(tag: Column) -> Column:
    """What the name space declarations of a tag name."""
    return F.array_join(F.regexp_extract_all(tag, F.lit(r"""\sxmlns(?::[^\s=]+)?\s*=\s*("[^"]*"|'[^']*')"""), F.lit(1)), " ")


def _tokens(text: Column) -> Column:
    """array<struct<seq, token, kind, name, depth>> of a document; the depth of a tag is the number of elements open around it."""

    def mark(t: Column, i: Column) -> Column:
        kind = (
            F.when(~t.startswith("<"), F.when(t.contains("]]>"), "broken").otherwise("text")).when(t.startswith("<![CDATA["), "data").when(t.startswith("<!") | t.startswith("<?"), "other").when(t == "<", "broken")
            .when(t.startswith("</"), "close").when(t.endswith("/>"), "self").otherwise("open")
        )
        return F.struct(i.alias("seq"), t.alias("token"), kind.alias("kind"), F.when(t.startswith("<"), F.regexp_extract(t, rf"^</?({NAME})", 1)).alias("name"))

    def placed(marks: Column) -> Column:
        sums = running_sum(F.transform(marks, lambda m: F.when(m["kind"] == "open", 1).when(m["kind"] == "close", -1).otherwise(0)))
        return F.zip_with(marks, sums, lambda m, d: F.struct(*[m[c].alias(c) for c in ("seq", "token", "kind", "name")], (d - F.when(m["kind"] == "open", 1).otherwise(0)).alias("depth")))

    return let(F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), mark), placed)


def _holds(ts: Column, opened: Column) -> Column:
    """Whether a document holds together: tags match on their level, one root, nothing but white space outside it."""
    repeated = lambda t: F.size(F.array_distinct(F.regexp_extract_all(t, F.lit(ATTRIBUTE), F.lit(1)))) < F.size(F.regexp_extract_all(t, F.lit(ATTRIBUTE), F.lit(1)))
    stray = lambda t: t.rlike(r"&(?!(lt|gt|quot|apos|amp|#[0-9]{1,7}|#x[0-9A-Fa-f]{1,6});)")
    broken = F.exists(ts, lambda x: (x["kind"] == "broken") | (x["kind"].isin("open", "self") & repeated(x["token"])) | (~x["kind"].isin("data", "other") & stray(x["token"])))
    outside = F.exists(ts, lambda x: x["kind"].isin("text", "data") & (x["depth"] == 0) & (F.trim(F.regexp_replace(x["token"], r"\s+", " ")) != ""))
    # the tags of a level in order: a closing one must follow an opening one of its name, and the last must be a closing one
    levels = F.array_sort(F.transform(F.filter(ts, lambda x: x["kind"].isin("open", "close")), lambda x: F.struct(x["depth"], x["seq"], x["kind"], x["name"])))

    def paired(tags: Column) -> Column:
        def fits(x: Column, i: Column) -> Column:
            other = F.get(tags, F.when(x["kind"] == "close", i - 1).otherwise(i + 1))
            return F.coalesce((other["depth"] == x["depth"]) & (other["kind"] != x["kind"]) & (other["name"] == x["name"]), F.lit(False))

        return F.forall(F.transform(tags, fits), lambda x: x)

    roots = F.size(F.filter(opened, lambda x: x["depth"] == 0))
    return (roots == 1) & ~F.exists(ts, lambda x: x["depth"] < 0) & ~broken & ~outside & let(levels, paired)


def _paths(opened: Column) -> Column:
    """Names from the root to each element: those open above it, cut behind level MAX_DEPTH, and its own.

    The fold goes block by block, so that a long document costs its length times a block and not its square.
    """
    names, found = "array<string>", "array<array<string>>"

    def step(acc: Column, x: Column) -> Column:
        path = F.when(x["depth"] > MAX_DEPTH, acc["open"]).otherwise(F.concat(F.slice(acc["open"], F.lit(1), x["depth"]), F.array(_local(x["name"]))))
        return let(path, lambda p: F.struct(p.alias("open"), F.concat(acc["out"], F.array(p)).alias("out")))

    def block(acc: Column, at: Column) -> Column:
        start = F.struct(acc["open"].alias("open"), F.array().cast(found).alias("out"))
        return let(F.aggregate(F.slice(opened, at, F.lit(256)), start, step), lambda a: F.struct(a["open"].alias("open"), F.concat(acc["out"], F.array(a["out"])).alias("out")))

    zero = F.struct(F.array().cast(names).alias("open"), F.array().cast(f"array<{found}>").alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.size(opened), F.lit(256)), zero, block, lambda a: F.flatten(a["out"]))


def _elements(text: Column) -> Column:
    """Elements of a document in the order of their opening tags, null if it does not hold together."""

    def made(ts: Column) -> Column:
        def rows(tags: Column, opened: Column) -> Column:
            # a text belongs to the element whose opening tag was the last tag before it
            said = lambda x: F.when(x["kind"] == "data", F.substring(x["token"], F.lit(10), F.length(x["token"]) - 12)).otherwise(unescape(x["token"]))
            behind = lambda x, i: F.slice(ts, x["seq"] + 2, F.get(tags, i + 1)["seq"] - x["seq"] - 1)
            own = lambda x, i: F.when(x["kind"] == "open", F.array_join(F.transform(F.filter(behind(x, i), lambda y: y["kind"].isin("text", "data")), said), "")).otherwise("")
            whole = F.filter(F.transform(tags, lambda x, i: F.when(x["kind"] != "close", F.struct(x["seq"].alias("seq"), x["depth"].alias("depth"), x["name"].alias("name"), x["token"].alias("token"), own(x, i).alias("text")))), lambda x: x.isNotNull())
            element = lambda x, p: F.struct(x["seq"].alias("seq"), x["depth"].alias("depth"), _local(x["name"]).alias("name"), p.alias("path"), _attributes(x["token"]).alias("attributes"), F.regexp_replace(x["text"], r"^\s+|\s+$", "").alias("text"), _declared(x["token"]).alias("declared"))
            return F.zip_with(whole, _paths(opened), element)

        opened = F.filter(ts, lambda x: x["kind"].isin("open", "self"))
        tags = F.filter(ts, lambda x: x["kind"].isin("open", "close", "self"))
        return let(opened, lambda o: F.when(_holds(ts, o), let(tags, lambda g: rows(g, o))))

    return let(_tokens(text), made)


def _documents(files: DataFrame, xml: str, id_col: str) -> DataFrame:
    """(id, refused, text): a row a document, one for all of a repeated id, with the reason why it is not read."""
    one = W.partitionBy(id_col)
    docs = files.select(id_col, F.col(xml).alias("x"), F.count("*").over(one).alias("_n"), F.row_number().over(one.orderBy(id_col)).alias("_k")).where("_k = 1")
    refused = F.when(F.col(id_col).isNull() | (F.col("_n") > 1), "id").when(F.trim(F.coalesce("x", F.lit(""))) == "", "empty")
    return docs.select(id_col, refused.alias("refused"), F.regexp_replace("x", "^﻿", "").alias("text"))


def _read(docs: DataFrame, id_col: str, made: Callable[[Column], Column]) -> DataFrame:
    """(id, error, made): made of the elements of each document, once a row."""
    found = let(F.when(F.col("refused").isNull(), _elements(F.col("text"))), lambda e: F.struct(F.coalesce("refused", F.when(e.isNull(), "malformed")).alias("error"), made(e).alias("made")))
    # unnested, so that no filter behind it is put before it and makes the elements again
    return docs.select(id_col, F.explode(F.array(found)).alias("d")).select(id_col, "d.error", "d.made")


def xml_elements(files: DataFrame, xml: str = "xml", id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(elements, malformed): a row an element of each well-formed document, and (id, error) of each other one.

    elements: id, seq (that of its opening tag among the document's tokens), depth (the root's is 0), name, path (a list, from
    the root), attributes (name and value), text (what stands between the opening tag and the first element inside it, trimmed),
    declared (name spaces).  Ids name documents; a document whose id is null or repeated is malformed, as is a null or blank one.
    """
    read = _read(_documents(files, xml, id_col), id_col, lambda e: e)
    return read.where("error is null").select(id_col, F.inline("made")), read.where("error is not null").select(id_col, "error")


def xml_flatten(files: DataFrame, xml: str = "xml", id_col: str = "doc_id") -> DataFrame:
    """(id, seq, path, value) of attributes and texts in document order; malformed documents give one row with path null.

    A path joins the names of the elements from the root by dots, an attribute's ends in [@name]; blank values are left out,
    and so is what lies deeper than MAX_DEPTH.  Declarations of entities must have been refused before (validate_xxe).
    """

    def held(e: Column) -> Column:
        return let(
            F.array_join(e["path"], "."),
            lambda here: F.concat(
                F.transform(e["attributes"], lambda a: F.struct(F.concat(here, F.lit("[@"), a["name"], F.lit("]")).alias("path"), F.regexp_replace(a["value"], r"^\s+|\s+$", "").alias("value"))),
                F.array(F.struct(here.alias("path"), e["text"].alias("value"))),
            ),
        )

    shown = lambda es: F.filter(F.flatten(F.transform(F.filter(es, lambda e: e["depth"] <= MAX_DEPTH), held)), lambda r: r["value"] != "")
    none = F.array(F.struct(F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("value")))
    read = _read(_documents(files, xml, id_col), id_col, lambda es: F.when(es.isNull(), none).otherwise(shown(es)))
    return read.select(id_col, F.posexplode("made").alias("seq", "r")).select(id_col, "seq", "r.path", "r.value")


def is_fhir(elements: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids of the documents whose root is a clinical resource or in its name space."""
    return elements.where((F.col("depth") == 0) & (F.col("name").isin(*FHIR_ROOTS) | F.col("declared").contains(FHIR_NAMESPACE))).select(id_col)


def fhir_flatten(files: DataFrame, xml: str = "xml", id_col: str = "doc_id") -> DataFrame:
    """(id, key, value) of clinical documents: the first value of each key, keys being element.attribute or element.

    Elements that hold text for people or a status are passed over, those inside them are not.
    """

    def held(e: Column) -> Column:
        return F.concat(
            F.transform(F.filter(e["attributes"], lambda a: a["name"].isin(*FHIR_ATTRIBUTES) & (a["value"] != "")), lambda a: F.struct(F.concat(e["name"], F.lit("."), a["name"]).alias("key"), a["value"].alias("value"))),
            F.filter(F.array(F.struct(e["name"].alias("key"), e["text"].alias("value"))), lambda r: r["value"] != ""),
        )

    def first(es: Column) -> Column:
        told = F.flatten(F.transform(F.filter(es, lambda e: ~e["name"].isin(*FHIR_SKIPPED)), held))
        ordered = F.array_sort(F.transform(told, lambda r, i: F.struct(r["key"].alias("key"), i.alias("at"), r["value"].alias("value"))))
        return let(ordered, lambda o: F.filter(o, lambda r, i: F.coalesce(F.get(o, i - 1)["key"] != r["key"], F.lit(True))))

    clinical = lambda es: F.get(es, F.lit(0))["name"].isin(*FHIR_ROOTS) | F.get(es, F.lit(0))["declared"].contains(FHIR_NAMESPACE)
    read = _read(_documents(files, xml, id_col), id_col, lambda es: F.when(clinical(es), first(es)))
    return read.select(id_col, F.explode("made").alias("r")).select(id_col, "r.key", "r.value")
