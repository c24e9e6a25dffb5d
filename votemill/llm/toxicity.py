"""Toxicity from subword bags: character n-gram embeddings, averaged, into a linear softmax.

A word is its character n-grams, with borders marked; each hashes
to an embedding.  A word's vector is the mean of its n-grams' vectors, a
window's vector the mean over its words, and a softmax layer turns that into
two classes; embeddings and layer are trained together in numpy.  A text is as
toxic as its most toxic window of ``window`` words, wherever it starts, so a
long text is not washed out.  A misspelling shares most n-grams, hence most of its vector, with
the word it is made from.

Fitting uses at most ``max_docs`` labelled texts of at most ``max_bytes``
bytes, the first in the order of a hash of their key; scoring reads every
text whole.  Null and empty texts get the share of toxic labels among the
training texts as score.  Null labels are not used; a text labelled more than
once counts with each of its labels.  With no toxic or no clean training text
every score is that share.  Equally toxic windows give the same score whichever
is taken; repeated rows get equal scores.  Scoring a table without rows gives no
rows, and fitting without texts a model whose scores are 0.  The kept columns
travel as one struct, so none clashes with a result.
"""

from __future__ import annotations

from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from votemill.llm import caches, textblocks as tb

#: Words remembered per worker; a full memory keeps the words met again, and is emptied where those are over half of it.
MEMORY = 100_000
#: Words whose n-grams are hashed together in fitting, and bytes of text that are scored together.
LOT, TEXT_BYTES = 20_000, 1 << 19


@dataclass(frozen=True)
class Settings:
    max_docs: int = 6_000
    max_bytes: int = 16_384
    buckets: int = 1 << 17
    dim: int = 8
    shortest: int = 3
    longest: int = 5
    window: int = 6
    #: a shorter text counts as this long, so that one word alone does not weigh far more than in a window
    least: int = 5
    #: toxic texts of so many windows' length or more are long
    spread: int = 25
    min_texts: int = 8
    epochs: int = 40
    batch: int = 128
    rate: float = 0.3
    decay: float = 5e-4
    seed: int = 7


def _crc_table() -> np.ndarray:
    """What each byte adds to a CRC-32 (reflected polynomial 0xEDB88320)."""
    rest = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        rest = np.where(rest & 1, np.uint32(0xEDB88320) ^ (rest >> np.uint32(1)), rest >> np.uint32(1))
    return rest


_CRC = _crc_table()


def _extended(state: np.ndarray, points: np.ndarray) -> np.ndarray:
    """CRC states after the UTF-8 bytes of one more code point each."""

    def step(state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        return _CRC[(state ^ byte) & 255] ^ (state >> np.uint32(8))

    lead = points.copy()
    for least, mark, shift in ((0x80, 0xC0, 6), (0x800, 0xE0, 12), (0x10000, 0xF0, 18)):
        wide = points >= least
        lead[wide] = np.uint32(mark) | points[wide] >> np.uint32(shift)
    state = step(state, lead)
    for least, shift in ((0x10000, 12), (0x800, 6), (0x80, 0)):
        wide = np.flatnonzero(points >= least)
        if len(wide):
            state[wide] = step(state[wide], np.uint32(0x80) | points[wide] >> np.uint32(shift) & np.uint32(0x3F))
    return state


def ngrams(words: list[str], settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every character n-gram of the words with their borders marked, by length and place.

    The bucket is the CRC-32 of the n-gram's UTF-8, worked out for all words at
    once: an n-gram's state is that of the one a character shorter, carried on.
    """
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    points = np.frombuffer(f"<{'><'.join(words)}>".encode("utf-32-le", "replace"), "<u4")
    length = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), length)
    room = np.cumsum(length)[word] - np.arange(len(points))  # characters up to the end of the word
    owner, bucket, at = [], [], np.arange(len(points))
    state = np.full(len(points), 0xFFFFFFFF, np.uint32)
    for size in range(1, settings.longest + 1):
        fits = room[at] >= size
        at, state = at[fits], state[fits]
        state = _extended(state, points[at + size - 1])
        if size >= settings.shortest:
            owner.append(word[at])
            bucket.append((state ^ np.uint32(0xFFFFFFFF)).astype(np.int64) % settings.buckets)
    return np.concatenate(owner), np.concatenate(bucket)


def tokens(text: str) -> list[str]:
    return text.lower().split()


@dataclass
class Model:
    settings: Settings
    prior: float
    #: logit of each n-gram: its embedding times the difference of the two softmax rows
    weight: np.ndarray
    bias: float
    memory: dict = field(default_factory=dict)
    #: words met again since the memory was last cut
    again: set = field(default_factory=set)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "memory": {}, "again": set()}

    def forget(self) -> None:
        self.memory.clear()
        self.again.clear()

    def learn(self, words: set[str]) -> None:
        """Works out the words not in memory yet; a full memory keeps those met again."""
        known = words & self.memory.keys()
        new = list(words - known)
        self.again |= known
        if len(self.memory) + len(new) > MEMORY:
            kept = {w: self.memory[w] for w in self.again | known} if len(self.again) <= MEMORY // 2 else {w: self.memory[w] for w in known}
            self.memory, self.again = kept, set()
        word, bucket = ngrams(new, self.settings)
        sums, sizes = np.bincount(word, weights=self.weight[bucket], minlength=len(new)), np.bincount(word, minlength=len(new))
        self.memory.update(zip(new, (sums / np.maximum(sizes, 1)).tolist()))

    def scores(self, texts: list[str]) -> list[float]:
        found = [tokens(t) for t in texts]
        self.learn(set().union(*found))
        return [self._of_words(words) for words in found]

    def score(self, text: str) -> float:
        return self.scores([text])[0]

    def _of_words(self, found: list[str]) -> float:
        if not found:
            return self.prior
        logits = np.fromiter(map(self.memory.__getitem__, found), float, len(found))
        size = min(self.settings.window, len(found))
        sums = np.concatenate([[0.0], np.cumsum(logits)])
        top = float((sums[size:] - sums[:-size]).max()) / max(size, self.settings.least) + self.bias
        return 1 / (1 + np.exp(-np.clip(top, -30, 30)))


class Bags:
    """Training texts as rows of word ids, the windows at every word of them, words as rows of kept n-gram ids."""

    def __init__(self, texts: list[str], settings: Settings):
        vocabulary: dict[str, int] = {}
        ids, lengths = array("i"), np.zeros(len(texts), np.int64)
        for d, text in enumerate(texts):
            found = tokens(text)
            for word in found:
                ids.append(vocabulary.setdefault(word, len(vocabulary)))
            lengths[d] = len(found)
        self.words = len(vocabulary)
        owner, gram, words = array("i"), array("i"), list(vocabulary)
        del vocabulary
        for at in range(0, self.words, LOT):
            word, bucket = ngrams(words[at:at + LOT], settings)
            order = np.argsort(word, kind="stable")
            owner.frombytes((word[order] + at).astype(np.int32).tobytes())
            gram.frombytes(bucket[order].astype(np.int32).tobytes())
        del words
        self.ids, owner, gram = (np.frombuffer(x, np.int32) if len(x) else np.zeros(0, np.int32) for x in (ids, owner, gram))
        self.gram_sizes = np.bincount(owner, minlength=self.words)
        word_of = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
        begin = np.cumsum(lengths) - lengths
        count = np.where(lengths > 0, np.maximum(lengths - settings.window, 0) + 1, 0)
        self.lengths, self.start = lengths, _ranges(begin, begin + count)
        #: the texts that have words, and the first window of each
        self.used = np.flatnonzero(count)
        self.first = (np.cumsum(count) - count)[self.used]
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), count)
        self.end = self.start + np.minimum(settings.window, lengths)[self.doc]
        # n-grams of too few texts would only be learnt by heart
        word_doc = np.unique(self.ids.astype(np.int64) * (len(texts) + 1) + word_of)
        per_word = np.bincount(word_doc // (len(texts) + 1), minlength=self.words)
        used = np.bincount(gram, weights=per_word[owner], minlength=settings.buckets)[gram] >= settings.min_texts
        self.gram, self.gram_word = gram[used], owner[used]


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All integers of the ranges [start, end), one range after the other."""
    size = end - start
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _sum_rows(values: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(key, weights=values[:, k], minlength=n) for k in range(values.shape[1])], axis=1)


def fit(texts: list[str], labels: np.ndarray, settings: Settings = Settings()) -> Model:
    """Embeddings and softmax layer by mini-batches, each text standing for its window that is most toxic so far."""
    labels = np.asarray(labels, float)
    prior = float(labels.mean()) if len(labels) else 0.0
    if not 0 < prior < 1:
        return Model(settings, prior, np.zeros(settings.buckets), float(np.log((prior + 1e-6) / (1 - prior + 1e-6))))
    rng = np.random.default_rng(settings.seed)
    bags = Bags(texts, settings)
    n_words, share = bags.words, 1 / np.maximum(bags.end - bags.start, settings.least)
    table, layer = rng.normal(0, 0.1, (settings.buckets, settings.dim)), rng.normal(0, 1, (settings.dim, 2))
    offset = np.log([1 - prior, prior])
    squares = [np.full_like(table, 1e-6), np.full_like(layer, 1e-6), np.full(2, 1e-6)]
    first_gram = np.searchsorted(bags.gram_word, np.arange(n_words + 1))

    spread = ((bags.lengths >= settings.spread * settings.window) & (labels == 1))[bags.doc]
    blocks = len(bags.ids) // settings.window + 1

    def margins() -> np.ndarray:
        by_gram = (table @ (layer[:, 1] - layer[:, 0]))[bags.gram]
        by_word = np.bincount(bags.gram_word, weights=by_gram, minlength=n_words) / bags.gram_sizes
        sums = np.concatenate([[0.0], np.cumsum(by_word[bags.ids])])
        return (sums[bags.end] - sums[bags.start]) * share

    for epoch in range(settings.epochs if len(bags.start) else 0):
        # half of the stretches of longer toxic texts sit out each time, so that every toxic word is learnt, not only the plainest
        away = rng.random(blocks) < 0.5
        hidden = spread & (away[bags.start // settings.window] | away[(bags.end - 1) // settings.window])
        margin = np.where(hidden, -np.inf, margins())
        top = np.zeros(len(texts))
        top[bags.used] = np.maximum.reduceat(margin, bags.first)
        at = np.flatnonzero(margin == top[bags.doc])
        best = at[np.append(True, bags.doc[at][1:] != bags.doc[at][:-1])]
        rate = settings.rate * (1 - epoch / settings.epochs)
        for wins in np.array_split(rng.permutation(best), max(1, len(best) // settings.batch)):
            words, inverse = np.unique(bags.ids[_ranges(bags.start[wins], bags.end[wins])], return_inverse=True)
            win_of = np.repeat(np.arange(len(wins)), bags.end[wins] - bags.start[wins])
            gram = bags.gram[_ranges(first_gram[words], first_gram[words + 1])]
            gram_word = np.repeat(np.arange(len(words)), first_gram[words + 1] - first_gram[words])
            scale = 1 / bags.gram_sizes[words][:, None]
            vector = _sum_rows(table[gram], gram_word, len(words)) * scale
            mean = _sum_rows(vector[inverse], win_of, len(wins)) * share[wins][:, None]
            logit = mean @ layer + offset
            error = 1 / (1 + np.exp(logit[:, 0] - logit[:, 1])) - labels[bags.doc[wins]]
            out = np.stack([-error, error], axis=1) / len(wins)
            back = (out @ layer.T) * share[wins][:, None]
            to_word = _sum_rows(back[win_of], inverse, len(words)) * scale
            touched, place = np.unique(gram, return_inverse=True)
            slope = _sum_rows(to_word[gram_word], place, len(touched)) + settings.decay * table[touched] / len(wins)
            squares[0][touched] += slope * slope
            table[touched] -= rate * slope / np.sqrt(squares[0][touched])
            for k, (parameter, by) in enumerate(((layer, mean.T @ out), (offset, out.sum(0))), 1):
                squares[k] += by * by
                parameter -= rate * by / np.sqrt(squares[k])
    seen = np.zeros(settings.buckets, bool)
    seen[bags.gram] = True
    weight = np.where(seen, table @ (layer[:, 1] - layer[:, 0]), 0.0)
    return Model(settings, prior, weight, float(offset[1] - offset[0]))


def training_sample(docs: DataFrame, labels: DataFrame, usable: Column, settings: Settings = Settings(), key: str = "doc_id", label: str = "toxic") -> tuple[list[str], np.ndarray]:
    """At most ``max_docs`` labelled texts: those of the first labels in the order of a hash of the key."""
    marked = labels.where(usable & F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(label).cast("double").alias("_label")).distinct()
    chosen = marked.orderBy(F.xxhash64("_key"), "_key", "_label").limit(settings.max_docs)
    texts = docs.select(F.col(key).alias("_key"), F.col("text")).where(F.octet_length("text") <= settings.max_bytes)
    # at most max_docs keys: a bounded broadcast, so the texts stay where they are
    found = texts.join(F.broadcast(chosen), "_key").select("text", "_label", F.xxhash64("_key", "text").alias("_order"))
    table = found.orderBy("_order", "text", "_label").limit(settings.max_docs).toArrow()
    return table.column("text").to_pylist(), table.column("_label").to_numpy()


def score(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (struct of the kept columns) and ``score``, 0 to 1."""
    handle = df.sparkSession.sparkContext.broadcast(model)  # bounded by the number of buckets

    def run(column: pa.Array) -> list[pa.Array]:
        own = handle.value
        caches.enter("toxicity", own.forget)
        out, held, size = [], [], 0
        for r in range(len(column)):
            held.append(column[r].as_py() or "")
            size += len(held[-1])
            if size >= TEXT_BYTES or r + 1 == len(column):
                out += own.scores(held)
                held, size = [], 0
        return [pa.array(out, pa.float64())]

    return tb.map_texts(df, text, keep or df.columns, run, [("score", T.DoubleType())])
