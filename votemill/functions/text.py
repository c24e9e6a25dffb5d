"""Text expressions: tokens, prefix and phrase counts, search terms, snippets.

All but :func:`nfc` of texts that need it are built-in expressions that run inside the JVM.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

TOKEN_RUN = r"[\p{L}\p{N}_-]+"
NON_TOKEN_RUN = r"[^\p{L}\p{N}_-]+"


@F.pandas_udf(T.StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Canonical composition; the sources apply it once at load, not per query.

    Every text of characters below U+0300 is composed already and stays in the
    JVM; the Python worker gets the others only.
    """
    plain = (F.octet_length(text) == F.length(text)) | ~F.rlike(text, F.lit(r"[^\x{0000}-\x{02FF}]"))
    return F.coalesce(_composed(F.when(~plain, text)), text)


def _plain(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "<[^>]+>", " ")


def tokens(text: Column) -> Column:
    """Lower-cased word tokens, tags removed; hyphen and underscore stay inside words."""
    return F.regexp_extract_all(_plain(text), F.lit(TOKEN_RUN), F.lit(0))


def token_line(text: Column) -> Column:
    """The tokens as one string with a single space before, between and after them."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(_plain(text), NON_TOKEN_RUN, " ")), F.lit(" "))


def line_length(line: Column) -> Column:
    """Number of tokens in a :func:`token_line`."""
    spaces = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit("")))
    return F.when(F.trim(line) == "", F.lit(0)).otherwise(spaces - 1)


def prefix_count(line: Column, keyword: str) -> Column:
    """Positions of a :func:`token_line` where successive tokens start with the keyword's parts.

    A look-ahead keeps later parts unconsumed, so overlapping positions all count.
    """
    first, *rest = keyword.split()
    if not rest:
        needle = " " + first
        # byte lengths are stored with the text, character lengths have to be counted
        gone = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(needle), F.lit("")))
        return (gone / F.lit(len(needle.encode()))).cast("int")
    ahead = "[^ ]* ".join(re.escape(p) for p in rest)
    found = F.regexp_count(line, F.lit(f" {re.escape(first)}[^ ]*(?= {ahead})"))
    return F.when(F.contains(line, F.lit(" " + rest[-1])), found).otherwise(F.lit(0))


def _one_of(prefixes: list[str]) -> str:
    """A pattern for any of the prefixes that branches letter by letter, so that most positions fail at the first one."""
    if "" in prefixes:
        return ""
    branches: dict[str, list[str]] = {}
    for p in sorted(set(prefixes)):
        branches.setdefault(p[0], []).append(p[1:])
    return "(?:" + "|".join(re.escape(c) + _one_of(rest) for c, rest in branches.items()) + ")"


def candidate_line(line: Column, keywords: list[str]) -> Column:
    """What a lexicon can match of a :func:`token_line`, in one pass over it.

    Each token that starts with the first part of any keyword stands on a line
    of its own, with as many tokens behind it as the longest keyword has parts.
    """
    parts = [k.split() for k in keywords]
    behind = max(map(len, parts), default=1) - 1
    found = F.regexp_extract_all(line, F.lit(f" (?=({_one_of([p[0] for p in parts])}[^ ]*(?: [^ ]+){{0,{behind}}}))"), F.lit(1))
    return F.concat(F.lit("\n"), F.array_join(found, "\n"))


def candidate_count(candidates: Column, keyword: str) -> Column:
    """:func:`prefix_count` of a keyword of the lexicon, from the :func:`candidate_line`."""
    first, *rest = keyword.split()
    if not rest:
        needle = "\n" + first
        gone = F.octet_length(candidates) - F.octet_length(F.replace(candidates, F.lit(needle), F.lit("")))
        return (gone / F.lit(len(needle.encode()))).cast("int")
    ahead = "[^ \n]* ".join(re.escape(p) for p in rest)
    found = F.regexp_count(candidates, F.lit(f"\n{re.escape(first)}[^ \n]* {ahead}"))
    return F.when(F.contains(candidates, F.lit(" " + rest[-1])), found).otherwise(F.lit(0))


def lexicon_hits(toks: Column, single: list[str], phrases: list[str]) -> Column:
    """Array of every exact word and every exact phrase met; overlaps count for both."""
    hits = [F.filter(toks, lambda t: t.isin(single))] if single else []
    by_len: dict[int, list[str]] = {}
    for p in phrases:
        by_len.setdefault(len(p.split()), []).append(" ".join(p.split()))
    hits += [_phrase_hits(toks, n, group) for n, group in sorted(by_len.items())]
    return F.concat(*hits)


def _phrase_hits(toks: Column, n: int, phrases: list[str]) -> Column:
    """Runs of ``n`` tokens that are one of the phrases: neighbours are joined place by place."""
    grams = toks
    for k in range(1, n):
        ahead = F.slice(toks, F.lit(k + 1), F.greatest(F.size(toks) - k, F.lit(0)))
        grams = F.zip_with(grams, ahead, lambda a, b: F.concat(a, F.lit(" "), b))
    return F.filter(grams, lambda g: g.isin(phrases))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+"))


# letters that decompose into a base letter and a mark; ø, ł and đ do not and stay
FOLD_FROM = "àáâãäåāăąçćčďèéêëēėęěìíîïīįñńňòóôõöōőŕřśšťùúûüūůűųýÿźżž"
FOLD_TO = "aaaaaaaaacccdeeeeeeeeiiiiiinnnooooooorrsstuuuuuuuuyyzzz"
MARKS = r"[\u0300-\u036F]+"
SEARCH_CHAR = r"[\p{L}\p{N}]"


def search_tokens(text: Column) -> Column:
    """Index tokens: letters and digits only, lower-cased, diacritics folded."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), MARKS, "")
    return F.regexp_extract_all(F.translate(bare, FOLD_FROM, FOLD_TO), F.lit(f"{SEARCH_CHAR}+"), F.lit(0))


def fts_query(query: Column, min_length: int = 1, joiner: str = " ") -> Column:
    """The quoted form of a free-text query: one phrase per word, joined by blanks (all) or ``OR`` (any)."""
    phrases = F.transform(query_terms(query, min_length), lambda t: F.concat(F.lit('"'), t, F.lit('"')))
    return F.when(F.size(phrases) == 0, F.lit('""')).otherwise(F.array_join(phrases, joiner))


def query_terms(query: Column, min_length: int = 1) -> Column:
    """Search words of a free-text query: quotes removed, split on blanks."""
    parts = F.split(F.translate(F.coalesce(query, F.lit("")), '"', " "), r"\s+")
    return F.filter(parts, lambda t: F.length(t) >= min_length)


def snippet(text: Column, terms: Column, width: int = 12, before: str = "<mark>",
            after: str = "</mark>", ellipsis: str = "…") -> Column:
    """Window of ``width`` words starting at the first hit, hits marked.

    The first hit is searched in the text as a whole; only the words of the
    window are looked at one by one.
    """
    text = F.coalesce(text, F.lit(""))
    # a mark that is a word by itself stays, so that words can be counted
    line = F.translate(F.regexp_replace(F.lower(text), r"[\u0300-\u036F](?<=\S[\u0300-\u036F])", ""), FOLD_FROM, FOLD_TO)
    whole = F.array_join(F.filter(terms, lambda t: t.rlike(rf"\A{SEARCH_CHAR}+\z")), r"\E|\Q")
    hit = F.concat(F.lit(rf"(?<!{SEARCH_CHAR})(?={SEARCH_CHAR})(?:\Q"), whole, F.lit(rf"\E)(?!{SEARCH_CHAR})"))

    def is_hit(word):
        return F.arrays_overlap(search_tokens(word), terms)

    def place(s):
        return F.struct(s["words"], F.when(F.size(s["ahead"]) < 2, 0).otherwise(1 + F.regexp_count(s["ahead"][0], F.lit(r"\S+\s"))).alias("first"))

    def shown(s):
        words, first = s["words"], s["first"]
        start = F.greatest(F.lit(1), F.least(first, F.size(words) - (width - 1)))
        marked = F.transform(F.slice(words, start, width), lambda w: F.when(is_hit(w), F.concat(F.lit(before), w, F.lit(after))).otherwise(w))
        return F.when(first == 0, F.lit(None)).otherwise(F.concat(
            F.when(start > 1, F.lit(ellipsis)).otherwise(F.lit("")),
            F.array_join(marked, " "),
            F.when(start + width <= F.size(words), F.lit(ellipsis)).otherwise(F.lit(""))))

    # arrays of one row, so that each step is worked out once
    once = F.array(F.struct(F.array_remove(F.split(text, r"\s+"), "").alias("words"), F.split(line, hit, 2).alias("ahead")))
    return F.get(F.transform(F.transform(once, place), shown), F.lit(0))
