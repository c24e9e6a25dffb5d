"""Document XML to rows.  A broken document gives no rows instead of failing the job.

Documents nest freely and mix name spaces, which the built-in XML functions
cannot follow, so each one is walked by a small helper inside ``mapInPandas``.
"""

from __future__ import annotations

import unicodedata
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from votemill import constants as C
from votemill.functions import scalars as S, text as X


def _local(name: str) -> str:
    return name.rpartition("}")[2]


def _attrs(node) -> dict:
    return {_local(k): v for k, v in node.attrib.items()}


def _text(node) -> str | None:
    t = (node.text or "").strip() if node is not None else ""
    return unicodedata.normalize("NFC", t) or None


def _parse(doc: str | None):
    try:
        return ET.fromstring(doc) if doc else None
    except ET.ParseError:
        return None


def _all(node, name: str):
    return (e for e in node.iter() if _local(e.tag) == name)


def _one(node, name: str):
    return next(_all(node, name), None)


def _child(node, name: str) -> str | None:
    return next((_text(c) for c in node if _local(c.tag) == name), None)


def _map_documents(df: DataFrame, walk, schema: str, keys: list[str], keep_broken: bool = False) -> DataFrame:
    """Runs ``walk(root) -> list of dicts`` over the ``xml`` column, the key columns passed along.

    A document that cannot be read gives no row, or one of its keys alone.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.strip().split(" ", 1)[0] for f in _split_fields(schema)]
        for pdf in batches:
            out = []
            for key, doc in zip(pdf[keys].itertuples(index=False), pdf["xml"]):
                root = _parse(doc)
                if root is not None:
                    out.extend({**dict(zip(keys, key)), **row} for row in walk(root))
                elif keep_broken:
                    out.append({**dict.fromkeys(names), **dict(zip(keys, key))})
            yield pd.DataFrame(out, columns=names)

    return df.select(*keys, "xml").mapInPandas(run, schema)


def _split_fields(schema: str) -> list[str]:
    fields, depth, cur = [], 0, ""
    for ch in schema:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            fields.append(cur)
            cur = ""
        else:
            cur += ch
    return [*fields, cur]


# --- plenary minutes ------------------------------------------------------------
MINUTES_SCHEMA = ("ptk_id string, session_key string, external_key string, speaker string, speech_type string, "
                  "started_at string, legislative_item string, text string")


def _speeches(root) -> list[dict]:
    rows = []

    def paragraphs(node):
        for c in node:
            if _local(c.tag) == "PuheenjohtajaRepliikki":
                continue
            if _local(c.tag) == "KappaleKooste" and _text(c):
                yield _text(c)
            yield from paragraphs(c)

    def visit(node, item):
        name = _local(node.tag)
        if name == "Asiakohta":
            item = _attrs(node).get("eduskuntaTunnus")
        if name == "PuheenvuoroToimenpide":
            kids = {_local(c.tag): c for c in reversed(list(node))}
            part = kids.get("PuheenvuoroOsa")
            body = "\n\n".join(paragraphs(part)) if part is not None else ""
            if body:
                who = _one(kids["Toimija"], "Henkilo") if "Toimija" in kids else None
                meta = _attrs(node)
                rows.append({
                    "external_key": _attrs(part).get("muuTunnus") or f"#{meta.get('puheenvuoroJNro')}",
                    "speaker": _attrs(who).get("muuTunnus") if who is not None else None,
                    "speech_type": meta.get("puheenvuoroLuokitusKoodi"),
                    "started_at": meta.get("puheenvuoroAloitusHetki"),
                    "legislative_item": item, "text": body})
        for c in node:
            visit(c, item)

    visit(root, None)
    return rows


def minutes_speeches(documents: DataFrame) -> DataFrame:
    """Minutes ``(ptk_id, session_key, xml)`` to one row per speech; chair interjections are left out."""
    raw = _map_documents(documents, _speeches, MINUTES_SCHEMA, ["ptk_id", "session_key"])
    numbered = F.startswith("external_key", F.lit("#"))
    return raw.select(
        F.when(numbered, F.concat("ptk_id", "external_key")).otherwise(F.col("external_key")).alias("external_key"),
        F.when(F.col("speaker").rlike(r"^\d+$"), F.col("speaker").try_cast("bigint")).alias("person_id"),
        "speech_type", "started_at", "legislative_item", "session_key", "ptk_id", "text",
        X.word_count(F.col("text")).alias("word_count"))


def longest_document(documents: DataFrame, key: str) -> DataFrame:
    """The fullest XML version of each document."""
    return documents.where(F.col("xml").isNotNull()).groupBy(key).agg(
        F.max_by("xml", F.struct(F.length("xml"), F.col("xml"))).alias("xml"))


# --- biographies ------------------------------------------------------------------
MEMBER_SCHEMA = (
    "person_id bigint, birth_year string, gender string, profession string, electoral_district string, "
    "now_code string, now_name string, now_start string, "
    "groups array<struct<code:string,name:string,start:string,end:string>>, "
    "terms array<struct<start:string,end:string>>, "
    "roles array<struct<title:string,government:string,start:string,end:string>>")


def _member(root) -> list[dict]:
    now_area, now = _one(root, "NykyinenVaalipiiri"), _one(root, "NykyinenEduskuntaryhma")
    area = _child(now_area, "Nimi") if now_area is not None else None
    earlier = [n for n in (_child(v, "Nimi") for v in _all(root, "VaaliPiiri")) if n]

    def span(node):
        return {"start": _child(node, "AlkuPvm"), "end": _child(node, "LoppuPvm")}

    groups = []
    for g in _all(root, "Eduskuntaryhma"):
        who = {"code": _child(g, "Tunnus"), "name": _child(g, "Nimi")}
        if who["code"] or who["name"]:
            stays = [c for c in g if _local(c.tag) == "Jasenyys"]
            groups += [{**who, **span(s)} for s in stays] or [{**who, "start": None, "end": None}]
    cabinet = _one(root, "ValtioneuvostonJasenyydet")
    roles = [{"title": _child(r, "Nimi") or _child(r, "Ministeriys"), "government": _child(r, "Hallitus"), **span(r)}
             for r in (cabinet if cabinet is not None else ()) if _local(r.tag) == "Jasenyys"]
    return [{
        "birth_year": _text(_one(root, "SyntymaPvm")), "gender": _text(_one(root, "SukuPuoliKoodi")),
        "profession": _text(_one(root, "Ammatti")),
        "electoral_district": area or (earlier[-1] if earlier else None),
        "now_code": _child(now, "Tunnus") if now is not None else None,
        "now_name": _child(now, "Nimi") if now is not None else None,
        "now_start": _child(now, "AlkuPvm") if now is not None else None,
        "groups": groups, "terms": [span(t) for t in _all(root, "Edustajatoimi")],
        "roles": [r for r in roles if r["title"] or r["government"]]}]


def member_profiles(rows: DataFrame) -> DataFrame:
    """Biographies ``(person_id, xml)`` to attributes, terms, group history and minister roles.

    The current group falls back to the latest membership.  Persons whose XML is
    missing or broken keep a row without attributes.
    """
    raw = _map_documents(rows, _member, MEMBER_SCHEMA, ["person_id"], keep_broken=True)

    def dated(s, *names):
        return F.struct(*[s[n].alias(n) for n in names],
                        S.fi_date(s["start"]).alias("start"), S.fi_date(s["end"]).alias("end"))

    group = "struct<code:string,name:string,start:string,end:string>"
    has_now = F.coalesce("now_code", "now_name").isNotNull()
    now = F.when(has_now, F.array(F.struct(
        S.normalize_party(F.col("now_code")).alias("code"), F.col("now_name").alias("name"),
        S.fi_date(F.col("now_start")).alias("start"), F.lit(None).cast("string").alias("end"))))
    past = F.transform("groups", lambda g: F.struct(
        S.normalize_party(g["code"]).alias("code"), g["name"].alias("name"),
        S.fi_date(g["start"]).alias("start"), S.fi_date(g["end"]).alias("end")))
    terms = F.filter(F.transform("terms", lambda t: dated(t)), lambda t: t["start"].isNotNull() | t["end"].isNotNull())
    parsed = raw.select(
        "person_id", "birth_year", "gender", "profession", "electoral_district", has_now.alias("_now"),
        F.concat(F.coalesce(now, F.array().cast(f"array<{group}>")), past).alias("parties"),
        terms.alias("terms"), F.transform("roles", lambda r: dated(r, "title", "government")).alias("minister_roles"))
    stays = F.transform("parties", lambda p: F.struct(
        F.coalesce(p["end"], F.lit("9999")).alias("until"), F.coalesce(p["start"], F.lit("")).alias("since"),
        p["code"].alias("code"), p["name"].alias("name")))
    first, latest = F.get("parties", F.lit(0)), F.try_element_at(F.array_sort(stays), F.lit(-1))
    use_first = F.col("_now") & first["code"].isNotNull()
    return parsed.select(
        "person_id", "birth_year", "gender", "profession", "electoral_district",
        F.when(use_first, first["code"]).otherwise(latest["code"]).alias("party_current"),
        F.when(use_first, first["name"]).otherwise(latest["name"]).alias("party_current_name"),
        "parties", "terms", "minister_roles")


# --- bills ------------------------------------------------------------------------
LEGISLATION_SCHEMA = "eduskunta_tunnus string, title string, summary string"


def bill_texts(documents: DataFrame, paragraphs: int = 8, max_chars: int = 4000) -> DataFrame:
    """Bills ``(eduskunta_tunnus, xml)`` to title and summary (opening paragraphs)."""
    def walk(root):
        titles = (_text(e) for tag in C.TITLE_TAGS for e in _all(root, tag))
        paras = [p for p in map(_text, _all(root, "KappaleKooste")) if p][:paragraphs]
        return [{"title": next((t for t in titles if t), None), "summary": " ".join(paras)[:max_chars]}]

    return _map_documents(documents, walk, LEGISLATION_SCHEMA, ["eduskunta_tunnus"])
