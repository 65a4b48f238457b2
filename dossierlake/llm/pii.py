"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

DataFrame functions only.  Each pattern finds what the plainly written one in its comment finds; possessive repeats
and look-behinds only keep long runs of digits or letters from being scanned again and again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierlake.functions.spans import let, regex_spans, span_list

LOCAL = "[A-Za-z0-9._%+-]"
#: Lengths of the national IBANs, by country code (registry of ISO 13616)
IBAN = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
LISTED = "(?:" + "|".join(c for cs in IBAN.values() for c in cs.split()) + ")"
FIXED = "|".join(rf"(?:{'|'.join(cs.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, cs in IBAN.items())
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+   begins a run of local characters, or where the last match ended
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    # [0-9]([\x20-]?[0-9])+ of 13 or more digits
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # country, two check digits, letters or digits in groups: as many as the country has, so that the words behind are
    # left; 11 to 30 for a country without an entry, up to the start of a listed one
    "iban": rf"(?<![A-Za-z0-9])(?:{FIXED}|(?!{LISTED})[A-Z]{{2}}[0-9]{{2}}(?:[A-Z0-9]|\x20(?!{LISTED}[0-9]{{2}})[A-Z0-9]){{11,30}}+)(?![A-Za-z0-9])",
}
BASE = ("email", "ip", "card", "phone")

#: score of a confirmed span, and lower-case words that raise or lower it in the 48 characters before it (fixed values)
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9}
RAISING = {
    "email": "mail|contact|write",
    "ip": "\\bip\\b|address|host|server|login",
    "card": "card|visa|credit|payment|kreditkarte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|telefon",
    "iban": "iban|bank|account|konto|compte|cuenta",
}
LOWERING = {"email": "example", "ip": "version|release", "card": "order|serial|isbn|ticket", "phone": "serial|order", "iban": "serial|order"}
CONTEXT, STEP = 48, 0.1


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True where a string of digits passes the Luhn checksum."""
    chars = F.split(F.reverse(digits), "")
    values = F.transform(F.filter(chars, lambda c: c != ""), lambda c, i: c.cast("int") * (i % 2 + 1))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v - F.when(v > 9, 9).otherwise(0)) % 10 == 0


def mod97(code: Column) -> Column:
    """True where letters and digits, the first four moved to the end and letters read as 10 to 35, leave 1 modulo 97."""
    turned = F.concat(F.substring(code, 5, 1_000), F.substring(code, 1, 4))
    chars = F.filter(F.split(turned, ""), lambda c: c != "")
    step = lambda a, c: F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(chars, F.lit(0), step) == 1


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        small = lambda p: let(F.ltrim(p, F.lit("0")), lambda x: (F.length(x) <= 3) & (F.coalesce(x.try_cast("int"), F.lit(0)) <= 255))
        return F.forall(F.split(match, r"\."), small)
    if kind == "card":
        return let(_digits(match), lambda d: F.length(d).between(13, 19) & luhn(d))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "iban":
        return mod97(F.replace(match, F.lit(" "), F.lit("")))
    return F.lit(True)


def _score(kind: str, before: Column) -> Column:
    low = F.lower(before)
    return F.round(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), SCORES[kind] + F.when(low.rlike(RAISING[kind]), STEP).otherwise(0.0) - F.when(low.rlike(LOWERING[kind]), 2 * STEP).otherwise(0.0))),
        2,
    )


def find_pii(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, email, ip, card, phone, iban): arrays of struct<start,end,match,score> over the whole text, by start.

    Code points, end exclusive.  Each kind is matched leftmost and without overlap on its own, and matches whose
    checksum or bounds fail are dropped without another try.  Null and empty texts give empty arrays; repeated rows
    and ids keep all their rows; other columns are not read.
    """
    found = docs.select(F.col(id_col), *[regex_spans(F.col(text), p, CONTEXT).alias(k) for k, p in PATTERNS.items()])

    def confirmed(kind: str) -> Column:
        kept = F.filter(F.col(kind), lambda s: _valid(kind, s["match"]))
        return F.transform(kept, lambda s: F.struct(s["start"], s["end"], s["match"], _score(kind, s["before"]).alias("score"))).alias(kind)

    return found.select(id_col, *[confirmed(k) for k in PATTERNS])


def pii_digest(docs: DataFrame) -> DataFrame:
    """Per document the counts, the hash of the base spans, all spans, and the score of each span in the same order."""
    found = find_pii(docs)
    base = F.concat(*[span_list(k, F.col(k)) for k in BASE])
    spans = found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS], base.alias("base"), span_list("iban", F.col("iban")).alias("more"),
        F.array_join(F.concat(*[F.transform(F.col(k), lambda s: s["score"].cast("string")) for k in PATTERNS]), ",").alias("scores"),
    )
    return spans.select(
        "doc_id", *[f"n_{k}" for k in BASE], F.sha2(F.array_join("base", ","), 256).alias("base_sha256"),
        F.array_join(F.concat("base", "more"), ",").alias("spans"), "n_iban", "scores",
    )
