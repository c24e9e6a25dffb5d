"""Token counts under a unigram vocabulary, one dynamic programme for all pre-tokens that share a prefix.

A pre-token is cut into vocabulary tokens so that the sum of their
log-probabilities is largest (equal sums: fewest tokens).  Distinct
pre-tokens are put into one trie; the forward score of a trie node (best sum
and token count of the bytes from the root) depends on the path alone, so it
is computed once per shared prefix, and the count at a pre-token's last node
is its answer.  Tokens that end at a node are found by walking the reversed
vocabulary upwards from it.

The rank file gives no probabilities; a token of rank r gets the Zipf share
1 / (r + 1).  Null and empty texts count 0 tokens; repeated rows count alike.
"""

from __future__ import annotations

import functools
import math
from array import array

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from votemill.llm import caches, textblocks as tb
from votemill.llm.bpe import read_ranks
from votemill.llm.pretokens import PreTokens

#: Trie nodes kept per worker; beyond it the trie is emptied and grows anew (counts do not depend on it).
MAX_NODES = 1_000_000


class UnigramTrie:
    def __init__(self, scores: dict[bytes, float]):
        self.back: list[dict[int, int]] = [{}]
        self.back_score: list[float | None] = [None]
        for token, score in scores.items():
            node = 0
            for byte in reversed(token):
                nxt = self.back[node].get(byte)
                if nxt is None:
                    nxt = self.back[node][byte] = len(self.back)
                    self.back.append({})
                    self.back_score.append(None)
                node = nxt
            self.back_score[node] = score
        self._reset()

    def _reset(self) -> None:
        self.child: dict[int, int] = {}
        self.score, self.count = array("d", [0.0]), array("q", [0])

    def _forward(self, data: bytes, path: list[int]) -> tuple[float, int]:
        """Best (score, token count) of the first ``len(path)`` bytes, given those of its prefixes."""
        best, least, node, at = -math.inf, 0, 0, len(path)
        back, back_score, score, count = self.back, self.back_score, self.score, self.count
        while at:
            at -= 1
            nxt = back[node].get(data[at])
            if nxt is None:
                break
            node = nxt
            own = back_score[node]
            if own is not None:
                total, tokens = score[path[at]] + own, count[path[at]] + 1
                if total > best or total == best and tokens < least:
                    best, least = total, tokens
        return best, least

    def tokens(self, data: bytes) -> int:
        if len(self.score) > MAX_NODES:
            self._reset()
        child, node, path = self.child, 0, [0]
        for i, byte in enumerate(data):
            key = node << 8 | byte
            nxt = child.get(key)
            if nxt is None:
                total, tokens = self._forward(data, path)
                nxt = child[key] = len(self.score)
                self.score.append(total)
                self.count.append(tokens)
            node = nxt
            path.append(node)
        return self.count[node]


def zipf_scores(ranks: dict[bytes, int]) -> dict[bytes, float]:
    norm = math.log(sum(1 / (r + 1) for r in ranks.values()))
    return {token: -math.log(r + 1) - norm for token, r in ranks.items()}


class Counter:
    def __init__(self, path: str, pattern: str):
        self.trie = UnigramTrie(zipf_scores(read_ranks(path)))
        self.values = PreTokens(pattern, lambda piece: self.trie.tokens(piece.encode("utf-8", "replace")), sum)

    def __call__(self, text: str) -> int:
        return sum(self.values(text))


@functools.lru_cache(maxsize=2)
def counter(path: str, pattern: str) -> Counter:
    return Counter(path, pattern)


def token_counts(df: DataFrame, text: str = "text", keep: list[str] | None = None, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``row`` (struct of the kept columns) and ``n_tokens``."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(column: pa.Array) -> list[pa.Array]:
        caches.enter("token counts", counter.cache_clear)
        own = counter(path, pattern)
        return [pa.array([own(column[r].as_py() or "") for r in range(len(column))], pa.int64())]

    return tb.map_texts(df, text, keep or df.columns, run, [("n_tokens", T.LongType())])
