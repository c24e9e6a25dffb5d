"""Scalar and predicate expressions over vote, bill and person columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from votemill import constants as C


def _lit_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


# --- dates, numbers, codes ----------------------------------------------------
def iso_day(text: Column) -> Column:
    """Date of a timestamp text such as ``2024-03-01 12:00`` or ``2024-02-25T10:00``; else null."""
    head = F.substring(F.translate(F.trim(text), "T", " "), 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(head, "yyyy-MM-dd"))


def fi_date(text: Column) -> Column:
    """``d.m.yyyy`` to ISO text, an ISO prefix as it is, else null."""
    t = F.trim(text)
    dotted = r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$"

    def part(i):
        return F.regexp_extract(t, dotted, i)

    return (F.when(t.rlike(dotted), F.concat_ws("-", part(3), F.lpad(part(2), 2, "0"), F.lpad(part(1), 2, "0")))
            .when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(t, 1, 10)))


def normalize_party(code: Column) -> Column:
    """Group code: trimmed, lower-cased, running number dropped; blank becomes null."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(code)), r"\d+$", ""), F.lit(""))


def vote_value(raw: Column, aliases: dict[str, str] = C.RAW_VALUE_ALIASES) -> Column:
    """Canonical vote value; unknown values pass through, blank becomes null."""
    v = F.trim(raw)
    return F.when(raw != "", F.coalesce(F.element_at(_lit_map(aliases), v), v))


def to_int(raw: Column, kind: str = "bigint") -> Column:
    return F.trim(raw).try_cast(kind)


def blank_to_null(col: Column) -> Column:
    return F.nullif(F.trim(col), F.lit(""))


def doc_type(item: Column) -> Column:
    """First word of a bill id; blank for a missing id."""
    return F.coalesce(F.regexp_extract(item, r"^\s*(\S+)", 1), F.lit(""))


def party_code(name: Column, codes: dict[str, str] | None = None) -> Column:
    """Group code of a party name as written in a survey; unknown names give null."""
    codes = C.SURVEY_PARTY_CODES if codes is None else codes
    return F.element_at(_lit_map(codes), F.lower(F.trim(name)))


def round_even(value: Column, digits: int = 0) -> Column:
    """Half-to-even rounding (indices, percentages, ratings)."""
    return F.bround(value, digits)


# --- predicates ---------------------------------------------------------------
def is_procedural(*titles: Column, hints=C.PROCEDURAL_HINTS) -> Column:
    """1 where any hint phrase occurs in the joined titles."""
    blob = F.lower(F.concat_ws(" ", *titles))
    return reduce(lambda a, b: a | b, [F.contains(blob, F.lit(h)) for h in hints]).cast("int")


def is_bill_passage(title: Column) -> Column:
    """True where yes means passing and no means rejecting the bill."""
    sides = F.split(F.coalesce(title, F.lit("")), "/")
    yes = F.lower(F.trim(F.get(sides, F.lit(0))))
    no = F.lower(F.trim(F.coalesce(F.get(sides, F.lit(1)), F.lit(""))))
    opens = reduce(lambda a, b: a | b, [F.startswith(yes, F.lit(p)) for p in C.PASSAGE_YES_PREFIXES])
    rejects = reduce(lambda a, b: a | b, [F.contains(no, F.lit(p)) for p in C.PASSAGE_NO_PARTS])
    return opens & rejects


def is_clean_vote(title: Column, with_reports: bool = True) -> Column:
    """Looser accept-or-reject test on the title, used when exporting work lists."""
    low = F.lower(title)
    clean = low.like("hyväksyminen / hylk%")
    return clean | (low.like("mietintö /%") & low.like("%hylk%")) if with_reports else clean


def reluctance(text: Column, markers=C.RELUCTANCE_MARKERS) -> Column:
    """First marker, in list order, that the text contains; else null."""
    low = F.lower(text)
    return F.coalesce(*[F.when(F.contains(low, F.lit(m)), F.lit(m)) for m in markers])


def is_substantive(value: Column) -> Column:
    return value.isin(*C.SUBSTANTIVE)


def is_cast(value: Column) -> Column:
    return value.isin(*C.CAST_VALUES)


def active_in(terms: Column, start_year: int, end_year: int) -> Column:
    """Any term (``start``, ``end`` texts) overlaps the years; no terms at all counts as active."""
    def overlaps(t):
        first = F.coalesce(F.substring(t["start"], 1, 4).cast("int"), F.lit(1900))
        last = F.coalesce(F.substring(t["end"], 1, 4).cast("int"), F.lit(2999))
        return (last >= start_year) & (first <= end_year)

    return F.when(F.size(terms) > 0, F.exists(terms, overlaps)).otherwise(F.lit(True))


# --- text assembly ------------------------------------------------------------
def joined(*parts: Column) -> Column:
    """Parts joined by a space, null and empty parts left out."""
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])


def preview(text: Column, chars: int) -> Column:
    return F.substring(text, 1, chars)


def speaker_label(first: Column, last: Column, party: Column) -> Column:
    return F.concat(first, F.lit(" "), last, F.lit(" ("), party, F.lit(")"))


DOC_BASE_URL = "https://www.eduskunta.fi/FI/vaski"


def document_url(doc_id: Column, kind: str, base: str = DOC_BASE_URL) -> Column:
    """Page of a document: blanks become ``_``, slashes ``+``."""
    return F.concat(F.lit(f"{base}/{kind}/Sivut/"), F.translate(doc_id, " /", "_+"), F.lit(".aspx"))


def row_url(table: str, column: str, value: Column, base: str) -> Column:
    return F.concat(F.lit(f"{base}/tables/{table}/rows?columnName={column}&columnValue="), value.cast("string"))


def file_page_url(thumb_url: Column, site: str = "https://commons.wikimedia.org/") -> Column:
    """File page behind a thumbnail address, or the site root."""
    name = F.regexp_extract(thumb_url, r"/commons/thumb/[0-9a-f]/[0-9a-f]{2}/([^/]+)/", 1)
    return F.when(name != "", F.concat(F.lit(site + "wiki/File:"), name)).otherwise(F.lit(site))


def json_list(text: Column, element: str) -> Column:
    """Parsed JSON list; null, empty or broken text gives an empty list."""
    kind = f"array<{element}>"
    return F.coalesce(F.from_json(text, kind), F.array().cast(kind))


def card_rarity(badges: Column, is_minister: Column, n_speeches: Column, first_year: Column) -> Column:
    return (F.when((badges > 0) | (is_minister == 1), "legendaarinen")
            .when((F.coalesce(n_speeches, F.lit(0)) >= 400) | (first_year <= 2011), "harvinainen")
            .otherwise("perus"))


def card_traits(is_minister: Column, first_year: Column, absent_pct: Column) -> Column:
    return F.array_compact(F.array(
        F.when(is_minister == 1, "Ministeri"),
        F.when(first_year <= 2011, "Konkari"),
        F.when(absent_pct < 8, "Ahkera äänestäjä")))
