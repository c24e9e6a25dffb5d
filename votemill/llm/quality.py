"""Line-first quality rules.

Every line of a text is judged by itself: a line is *navigation* when
separators make up a fifth of its words, *boilerplate* when it is short and
holds a stock phrase, and fails *punctuation* when it is short and holds no
sentence mark although other lines of the text do, or when symbols make up a
tenth of its characters.
Failing lines are removed; a text that loses more than ``max_lost`` of its
word characters that way, or has no word, is rejected.

Null and empty texts have no words: every count is 0 and they are rejected.
Repeated rows are judged one by one, each the same; very long texts are read
whole.  Other columns of the input pass through untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from votemill.llm import caches, textblocks as tb

# Phrases of lines that belong to a site, not to its text.
PHRASES = (
    "all rights reserved", "terms of service", "terms of use", "privacy policy", "cookie policy", "accept cookies",
    "uses cookies", "enable javascript", "lorem ipsum", "licensed under the", "click here", "subscribe to our",
    "sign up for our", "powered by", "copyright (c)", "copyright ©", "follow us on", "share this",
)
# Marks that end or part sentences.
ASCII_MARKS = ".!?:;"
WIDE_MARKS = "…。！？؟।"
SEPARATORS = "|>•·»›"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    """Limits of the rules; the first three are the base rules every text has to meet."""

    window: int = 5
    min_words: int = 10
    max_repeat_pct: int = 20
    nav_min: int = 3
    nav_pct: int = 20
    symbol_pct: int = 10
    short_line: int = 30
    unmarked_words: int = 8
    max_lost: float = 0.5


FIELDS = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()),
          ("n_repeat_words", T.LongType()), ("n_lines", T.LongType()), ("n_bad_lines", T.LongType()), ("lost_chars", T.LongType()),
          ("base_failed", T.BooleanType()), ("kept", T.BooleanType())]


def _marked(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars if ord(c) < 128]] = True
    return out


_MARKS, _SEPARATORS, _SYMBOLS = _marked(ASCII_MARKS), _marked(SEPARATORS), _marked(SYMBOLS)


def _hits(raw: bytes, needle: bytes) -> list[int]:
    out, at = [], raw.find(needle)
    while at >= 0:
        out.append(at)
        at = raw.find(needle, at + 1)
    return out


def _sum(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[end] - total[start]


def _repeated(codes: np.ndarray, row: np.ndarray, width: int, n: int) -> np.ndarray:
    """Words per row that lie in a window found twice or more in that row."""
    window = tb.combine(codes, width)
    at = np.flatnonzero(row[:len(window)] == row[width - 1:width - 1 + len(window)])
    key = tb.mix(window[at] ^ tb.mix(row[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(codes) + width + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + width, -1)
    return tb.per_row(np.cumsum(cover)[:len(codes)] > 0, row, n)


def judge_block(buf: np.ndarray, off: np.ndarray, rules: Rules) -> tuple[list[np.ndarray], tuple]:
    """The columns of FIELDS for the rows of one block, and its lines with their verdicts."""
    n = len(off) - 1
    start, end, row = tb.words(buf, off)
    sums = tb.prefix_sums(buf)
    codes = tb.span_hash(sums, start, end)
    char = ((buf & 0xC0) != 0x80) & ~tb.SPACE[buf]
    n_words = np.bincount(row, minlength=n).astype(np.int64)
    word_chars, n_symbols = _sum(char, off[:-1], off[1:]), _sum(_SYMBOLS[buf], off[:-1], off[1:])

    l_start, l_end, l_row = tb.lines(buf, off)
    l_words = np.searchsorted(start, l_end) - np.searchsorted(start, l_start)
    l_chars = _sum(char, l_start, l_end)
    solid = l_words > 0
    key = tb.mix(tb.span_hash(sums, l_start, l_end) ^ tb.mix(l_row.astype(np.uint64) + np.uint64(1)))[solid]
    _, first = np.unique(key, return_index=True)
    n_dup = np.bincount(l_row[solid], minlength=n) - np.bincount(l_row[solid][first], minlength=n)

    marks, parts = _sum(_MARKS[buf], l_start, l_end), _sum(_SEPARATORS[buf], l_start, l_end)
    low = tb.LOWER[buf].tobytes()

    def count_at(places: list[int]) -> np.ndarray:
        at = np.asarray(places, np.int64)
        line = np.searchsorted(l_start, at, "right") - 1
        return np.bincount(line, minlength=len(l_start))

    for c in WIDE_MARKS:
        if places := _hits(low, c.encode()):
            marks = marks + count_at(places)
    for c in SEPARATORS:
        if ord(c) > 127 and (places := _hits(low, c.encode())):
            parts = parts + count_at(places)
    stock = np.zeros(len(l_start), np.int64)
    for phrase in PHRASES:
        if places := _hits(low, phrase.encode()):
            stock += count_at(places)
    l_symbols = _sum(_SYMBOLS[buf], l_start, l_end)
    navigation = (parts >= rules.nav_min) & (100 * parts >= rules.nav_pct * l_words)
    boilerplate = (stock > 0) & (l_words <= rules.short_line)
    writes_marks = tb.per_row(marks, l_row, n)[l_row] > 0
    unmarked = (marks == 0) & writes_marks & (l_words >= rules.unmarked_words) & (l_words <= rules.short_line)
    symbolic = 100 * l_symbols > rules.symbol_pct * l_chars
    bad = solid & (navigation | boilerplate | unmarked | symbolic)
    lost = tb.per_row(np.where(bad, l_chars, 0), l_row, n)

    repeated = _repeated(codes, row, rules.window, n)
    base_failed = (n_words < rules.min_words) | (100 * repeated > rules.max_repeat_pct * n_words)
    kept = ~base_failed & (n_words > 0) & (lost <= rules.max_lost * word_chars)
    return ([n_words, word_chars, n_symbols, n_dup, repeated, np.bincount(l_row, minlength=n), np.bincount(l_row[bad], minlength=n),
             lost, base_failed, kept], (l_start, l_end, l_row, bad))


def _columns(column: pa.Array, rules: Rules, cleaned: bool) -> list[pa.Array]:
    caches.enter("quality")
    parts, texts = [], []
    for _, buf, off in tb.text_blocks(column):
        cols, (l_start, l_end, l_row, bad) = judge_block(buf, off, rules)
        parts.append(cols)
        if cleaned:
            touched = set(l_row[bad].tolist())
            lo = np.searchsorted(l_row, np.arange(len(off)))
            raw = buf.tobytes()
            for r in range(len(off) - 1):
                if r in touched:
                    keep = [i for i in range(lo[r], lo[r + 1]) if not bad[i]]
                    texts.append(b"\n".join(raw[l_start[i]:l_end[i]] for i in keep))
                else:
                    texts.append(raw[off[r]:off[r + 1]])
    merged = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(len(FIELDS))]
    out = [pa.array(m, pa.bool_() if t == T.BooleanType() else pa.int64()) for m, (_, t) in zip(merged, FIELDS)]
    return [*out, pa.array(texts, pa.binary()).cast(pa.string(), safe=False)] if cleaned else out


def judge(df: DataFrame, text: str = "text", keep: list[str] | None = None, rules: Rules = Rules(), cleaned: bool = True) -> DataFrame:
    """``row`` (struct of the kept columns), the columns of FIELDS and, if ``cleaned``, the text without its failing lines."""
    fields = [*FIELDS, *([("clean_text", T.StringType())] if cleaned else [])]
    return tb.map_texts(df, text, keep or df.columns, lambda column: _columns(column, rules, cleaned), fields)


def clean_documents(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Accepted documents only, with their columns; ``text`` loses its failing lines and ``n_chars``, if there, follows."""
    out = judge(docs, rules=rules).where("kept")
    changed = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    return out.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
