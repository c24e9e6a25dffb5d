"""The document queries on a table of awkward rows, against plain versions."""

import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

import brute
from brute import NASTY
from votemill.llm import bpe, quality, queries


def rows(spark, name, folder, *columns):
    return [tuple(r[c] for c in columns) for r in queries.QUERIES[name](spark, folder).collect()]


def test_empty_tables(spark, empty):
    for name, query in queries.QUERIES.items():
        assert query(spark, empty).collect() == [], name


def test_op1(spark, nasty):
    got = rows(spark, "op1_ngram_join", nasty, "doc_id", "n_shingles", "component_id")
    assert Counter(got) == Counter(brute.components(NASTY))


def test_op2(spark, nasty):
    got = rows(spark, "op2_packing", nasty, "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, total = Counter(), 0
    for i, text in NASTY:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        total += len(ids)
        edges = [0, *range((len(ids) - 1) % 1024 + 1, len(ids), 1024), len(ids)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            want[i, k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))] += 1
    assert Counter(r[:5] for r in got) == want
    sequences = defaultdict(list)
    for *_, length, _, sequence, offset in got:
        sequences[sequence].append((offset, length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert -(-total // 1024) <= len(sequences) <= brute.first_fit(Counter(r[3] for r in got), 1024)


def test_op3(spark, nasty):
    got = rows(spark, "op3_lm", nasty, "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    key = lambda r: (r[0] is None, r[0] or 0, *r[2:4])
    want = sorted(brute.base_scores(NASTY), key=key)
    for mine, plain in zip(sorted(got, key=key), want, strict=True):
        assert mine[:5] == plain[:5] and mine[5] == pytest.approx(plain[5]) and mine[6] < 0


def test_op4(spark, nasty):
    from votemill.llm.token_counts import zipf_scores
    scores = zipf_scores(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    split = bpe.PreTokens(public_tokenizers.PATTERN, len, sum).split

    def count(data):
        best = [(0.0, 0)]
        for end in range(1, len(data) + 1):
            ways = [(best[a][0] + scores[data[a:end]], -(best[a][1] + 1)) for a in range(max(0, end - 130), end) if data[a:end] in scores]
            top = max(ways)
            best.append((top[0], -top[1]))
        return best[-1][1]

    few = [(i, t) for i, t in NASTY if i not in (50, 51)]
    got = dict(Counter(rows(spark, "op4_token_counts", nasty, "doc_id", "n_tokens")))
    for i, text in few:
        assert (i, sum(count(p.encode()) for p in split(text or ""))) in got
    assert sum(got.values()) == len(NASTY)


def test_op5(spark, nasty):
    got = rows(spark, "op5_suffix_dedup", nasty, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert Counter(got) == Counter((*r[:4], brute.sha(r[4])) for r in brute.cut(NASTY))


def test_op7(spark, nasty):
    got = rows(spark, "op7_toxicity", nasty, "doc_id", "held_out", "score", "predicted")
    assert len(got) == len(NASTY)
    for i, held, score, predicted in got:
        assert held == (brute.crc_mod(i, 4) in (2, None)) and 0 <= score <= 1 and predicted == int(score >= 0.3)


def test_op9(spark, nasty):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    want = Counter()
    for i, text in NASTY:
        ids = library.encode_ordinary(text or "")
        want[i, len(ids), brute.sha(struct.pack(f"<{len(ids)}I", *ids)), brute.sha((text or "").encode())] += 1
    assert Counter(rows(spark, "op9_bpe", nasty, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) == want


def test_op10(spark, nasty):
    got = rows(spark, "op10_quality", nasty, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    want = Counter()
    for i, text in NASTY:
        n = brute.quality(text)
        want[i, *n, n[0] < 10 or 100 * n[4] > 20 * n[0]] += 1
    assert Counter(r[:7] for r in got) == want
    assert not any(r[6] and r[7] for r in got)
    kept = {r[0]: r[7] for r in got}
    assert kept[12] and kept[300] and not kept[2] and not kept[51]


def test_cleaning_removes_failing_lines(spark, nasty):
    docs = queries.documents(spark, nasty)
    cleaned = {r.doc_id: r for r in quality.clean_documents(docs).where("doc_id = 54 or doc_id = 12").collect()}
    assert cleaned[54].text == "Real sentence with enough words to stay in place here." and cleaned[54].n_chars == len(cleaned[54].text)
    assert cleaned[12].text == dict(NASTY)[12] and cleaned[12].row == "row"
