"""Byte-level BPE by a lazily determinised transducer, and streaming decoding.

A sequence of tokens is the encoding of its bytes exactly when every token
encodes to itself and no two neighbours would have been merged across their
border.  The transducer reads a piece byte by byte and holds every reading
that is still possible: the tokens not yet emitted and the node of the token
tree that the current token has reached.  Tokens on which all readings agree
are emitted at once; a reading starts at most at every byte of the longest
token, so lookahead and states are bounded.  Sets of readings become numbered
states on first use, with one table entry per (state, byte) seen.

A piece that is itself a token is that token, as the rank files' library has
it.  Null and empty texts have no tokens; unpaired bytes cannot occur in a
Spark string that came from text, and are replaced when they do.
"""

from __future__ import annotations

import base64
import functools
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from votemill import runtime
from votemill.llm import caches, textblocks as tb
from votemill.llm.pretokens import PreTokens

#: States and transitions kept; beyond it the tables are emptied and built again.
MAX_TRANSITIONS = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Transducer:
    """Encoder of one rank table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.child: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                nxt = self.child[node].get(byte)
                if nxt is None:
                    nxt = self.child[node][byte] = len(self.child)
                    self.child.append({})
                    self.token_at.append(-1)
                node = nxt
            self.token_at[node] = rank
        self._whole: dict[int, bool] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.step: dict[int, tuple[tuple[int, ...], int]] = {}
        self.final: dict[int, tuple[int, ...]] = {}
        self.start = self._state((((), -1, 0),))

    def _state(self, readings: tuple) -> int:
        got = self.number.get(readings)
        if got is None:
            got = self.number[readings] = len(self.states)
            self.states.append(readings)
        return got

    def merge(self, data: bytes) -> list[int]:
        """Merge the lowest-ranked neighbours until none is left: the definition, for short strings only."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while True:
            best = min(((self.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.ranks), default=None)
            if best is None:
                return [self.ranks[p] for p in parts]
            i = best[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]

    def _self_encoding(self, token: int) -> bool:
        got = self._whole.get(token)
        if got is None:
            got = self._whole[token] = self.merge(self.bytes_of[token]) == [token]
        return got

    def _neighbours(self, left: int, right: int) -> bool:
        got = self._fits.get((left, right))
        if got is None:
            if len(self._fits) > MAX_TRANSITIONS:
                self._fits.clear()
            got = self._fits[left, right] = self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return got

    def _may_end(self, last: int, node: int) -> int:
        """The token at ``node`` if a reading whose last token is ``last`` may close with it, else -1."""
        token = self.token_at[node]
        if token < 0 or not self._self_encoding(token) or last >= 0 and not self._neighbours(last, token):
            return -1
        return token

    def _advance(self, state: int, byte: int) -> tuple[tuple[int, ...], int]:
        readings = []
        for pending, last, node in self.states[state]:
            grown = self.child[node].get(byte)
            if grown is not None:
                readings.append((pending, last, grown))
            if node and (token := self._may_end(last, node)) >= 0 and (begun := self.child[0].get(byte)) is not None:
                readings.append(((*pending, token), token, begun))
        shared = 0
        if readings:
            least = min(len(p) for p, _, _ in readings)
            first = readings[0][0]
            while shared < least and all(p[shared] == first[shared] for p, _, _ in readings):
                shared += 1
        emitted = readings[0][0][:shared] if readings else ()
        return emitted, self._state(tuple(sorted((p[shared:], last, node) for p, last, node in readings)))

    def _close(self, state: int) -> tuple[int, ...]:
        for pending, last, node in self.states[state]:
            if not node:
                return pending
            if (token := self._may_end(last, node)) >= 0:
                return (*pending, token)
        raise ValueError("the rank table lacks a byte of this text")

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.step) + len(self.states) > MAX_TRANSITIONS:
            self._reset()
        state, out, step = self.start, [], self.step
        for byte in piece:
            key = state << 8 | byte
            move = step.get(key)
            if move is None:
                move = step[key] = self._advance(state, byte)
            if move[0]:
                out += move[0]
            state = move[1]
        end = self.final.get(state)
        if end is None:
            end = self.final[state] = self._close(state)
        return [*out, *end]


class Utf8Stream:
    """Text of a byte stream that arrives in any cuts.

    The state is the unfinished character: its bytes so far and how many it
    still needs, read off its lead byte.  Malformed bytes become U+FFFD.
    """

    NEED = np.array([1] * 0xC0 + [2] * 0x20 + [3] * 0x10 + [4] * 8 + [1] * 8)

    def __init__(self) -> None:
        self.rest = b""

    def feed(self, data: bytes) -> str:
        data = self.rest + data
        cut = len(data)
        for back in range(1, min(4, len(data) + 1)):
            byte = data[-back]
            if byte >= 0xC0:
                if self.NEED[byte] > back:
                    cut = len(data) - back
                break
            if byte < 0x80:
                break
        self.rest = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        left, self.rest = self.rest, b""
        return left.decode("utf-8", "replace")


class Codec:
    """Texts to ids and back: pieces by the pattern, ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, pattern: str):
        self.transducer = Transducer(read_ranks(path))
        self.values = PreTokens(pattern, self._encode, b"".join)
        self.tokens = [self.transducer.bytes_of.get(i, b"") for i in range(max(self.transducer.bytes_of) + 1)]

    def _encode(self, piece: str) -> bytes:
        ids = self.transducer.encode(piece.encode("utf-8", "replace"))
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        return b"".join(self.values(text))

    def decode(self, ids: bytes, at_once: int = 1 << 16) -> str:
        stream, out = Utf8Stream(), []
        numbers = np.frombuffer(ids, "<u4")
        for at in range(0, len(numbers), at_once):
            out.append(stream.feed(b"".join(map(self.tokens.__getitem__, numbers[at:at + at_once].tolist()))))
        return "".join([*out, stream.close()])


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _texts(column: pa.Array):
    for row in range(len(column)):
        yield column[row].as_py() or ""


def _default(path: str | None) -> str:
    return path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def encode(df: DataFrame, text: str = "text", keep: list[str] | None = None, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``row`` (struct of the kept columns), ``ids`` (little-endian unsigned 32-bit bytes) and ``n_tokens``."""
    path = _default(path)

    def run(column: pa.Array) -> list[pa.Array]:
        caches.enter("bpe", codec.cache_clear)
        own = codec(path, pattern)
        ids = [own.encode(t) for t in _texts(column)]
        return [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]

    return tb.map_texts(df, text, keep or df.columns, run, [("ids", T.BinaryType()), ("n_tokens", T.LongType())])


def decode(df: DataFrame, ids: str = "ids", path: str | None = None, pattern: str = public_tokenizers.PATTERN, out: str = "decoded") -> DataFrame:
    """The input with a column ``out`` of the text behind ``ids`` (null ids: empty)."""
    path = _default(path)
    runtime.ship(df.sparkSession)
    at = df.columns.index(ids)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def run(batches):
        caches.enter("bpe", codec.cache_clear)
        own = codec(path, pattern)
        for batch in batches:
            column = batch.column(at)
            texts = [own.decode(column[r].as_py() or b"") for r in range(len(column))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.fieldNames())

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, text: str = "text", keep: list[str] | None = None, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``encode`` and ``decode`` of its ids in one pass, in one Python worker a task."""
    path = _default(path)

    def run(column: pa.Array) -> list[pa.Array]:
        caches.enter("bpe", codec.cache_clear)
        own = codec(path, pattern)
        ids = [own.encode(t) for t in _texts(column)]
        return [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([own.decode(x) for x in ids], pa.string())]

    return tb.map_texts(df, text, keep or df.columns, run, [("ids", T.BinaryType()), ("n_tokens", T.LongType()), ("decoded", T.StringType())])
