"""The pieces the operators are made of."""

import itertools
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import brute
from votemill import runtime
from votemill.llm import bpe, components, lbl, ngram_join, packing, shared_keys as sk, suffix_dedup, textblocks as tb, toxicity

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab .\n\t\x0b|é中\x85", max_size=40)), max_size=12)


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.integers(1, 60))
def test_words_and_lines(texts, block):
    words, lines = [[] for _ in texts], [[] for _ in texts]
    for low, buf, off in tb.text_blocks(pa.array(texts, pa.string()), block):
        raw = buf.tobytes()
        for out, spans in ((words, tb.words(buf, off)), (lines, tb.lines(buf, off))):
            for a, b, r in zip(*[x.tolist() for x in spans]):
                out[low + r].append(raw[a:b].decode())
    assert words == [brute.words(t) for t in texts] and lines == [(t or "").split("\n") for t in texts]


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_shingles(texts):
    column, got = pa.array(texts, pa.string()), []
    for _, buf, off in tb.text_blocks(column):
        codes, row = tb.distinct_per_row(*tb.shingles(tb.LOWER[buf], off, 5))
        got += [frozenset(codes[row == r].tolist()) for r in range(len(off) - 1)]
    want = [brute.shingles(t) for t in texts]
    for a, b in itertools.combinations(range(len(texts)), 2):
        assert len(got[a] & got[b]) == len(want[a] & want[b])
    assert [len(s) for s in got] == [len(s) for s in want]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcxyzéß中🙂 \n\t\x1c\x85 12.,!'sl<|>", max_size=80))
def test_transducer_equals_the_library(text):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = bpe.codec(path, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.transducer.ranks, special_tokens={})
    ids = own.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text) and own.decode(ids, at_once=1) == text


def test_transducer_emits_before_the_end_and_forgets_safely(monkeypatch):
    own = bpe.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).transducer
    long = ("abcdefghij" * 300).encode()
    whole = own.encode(long)
    state, early = own.start, 0
    for byte in long:
        emitted, state = own.step[state << 8 | byte]
        early += len(emitted)
    assert early > len(whole) - 60  # only a bounded rest waits for the end
    monkeypatch.setattr(bpe, "MAX_TRANSITIONS", 10)
    assert own.encode(long) == whole


@given(st.text(max_size=30), st.lists(st.integers(1, 5), min_size=1, max_size=60))
def test_utf8_stream(text, cuts):
    stream, data, out = bpe.Utf8Stream(), text.encode("utf-8", "replace"), ""
    for n in itertools.cycle(cuts):
        if not data:
            break
        out, data = out + stream.feed(data[:n]), data[n:]
    assert out + stream.close() == text.encode("utf-8", "replace").decode()


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(0, 3), max_size=5), st.integers(0, 25))
def test_fullest_combination(counts, slack):
    table = [counts.get(n, 0) for n in range(30)]
    best = max(sum(n * k for n, k in zip(counts, ks)) for ks in itertools.product(*[range(c + 1) for c in counts.values()])
               if sum(n * k for n, k in zip(counts, ks)) <= slack)
    got = packing.fullest(table, slack)
    assert sum(n * k for n, k in got.items()) == best and all(k <= table[n] for n, k in got.items())


def test_plan_uses_every_piece_once():
    rng = random.Random(3)
    histogram = {n: rng.randint(1, 40) for n in rng.sample(range(1, 101), 60)}
    steps = packing.plan(histogram, 100)
    used = {n: 0 for n in histogram}
    for combination, times in steps:
        assert sum(n * k for n, k in combination.items()) <= 100
        for n, k in combination.items():
            used[n] += k * times
    assert used == histogram
    assert sum(t for _, t in steps) <= brute.first_fit(histogram, 100)


@pytest.mark.parametrize("q", [2, 3, 5, 7, 13])
def test_difference_set(q):
    period, found = q * q + q + 1, suffix_dedup.difference_set(q)
    assert len(found) == q + 1 and {(a - b) % period for a in found for b in found} == set(range(period))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=40), st.integers(1, 12))
def test_least_of_neighbours(values, width):
    spread = [v << 40 for v in values]  # the low bits hold positions
    want = [min(range(i, i + width), key=lambda j: (values[j], j)) for i in range(len(values) - width + 1)]
    assert suffix_dedup._least(np.array(spread, np.uint64), width).tolist() == want


def test_choice_lengthens_the_prefix_only_where_candidates_cost():
    own = ngram_join.Settings()
    rare, common = np.full(100, 2), np.full(100, 5000)
    assert ngram_join.choose(100, rare, own)[0] <= ngram_join.choose(100, common, own)[0]
    l, taken = ngram_join.choose(100, common, own)
    assert taken == 100 - 75 + l
    assert ngram_join.choose(100, common[:80], own)[1] == ngram_join.choose(100, common[:80], own)[0] + 25 - 20


def test_repeated_keys():
    blobs = [(7, sk.pack(np.array([5, 9, 5]), np.array([0, 1, 0]))), (8, sk.pack(np.array([9, 4]), np.array([2, 3])))]
    got = {block: [x.tolist() for x in sk.unpack(data, 3)] for block, data in sk.repeated(blobs)}
    assert got == {7: [[0, 1, 0], [5, 9, 5], [2, 2, 2]], 8: [[2], [9], [2]]}


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60) if i != 30] + [(100, 100), (5, 3), (3, 5)]
    labels = {r.node: r.comp for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({labels[i] for i in range(31)}) == 1 and len({labels[i] for i in range(31, 61)}) == 1 and labels[0] != labels[60]


def test_rounds_of_few_edges_write_one_file_each(spark, monkeypatch):
    files, write = [], runtime.materialize

    def counted(df, name):
        out = write(df, name)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(runtime, "materialize", counted)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edges = [(i, i + 1) for i in range(300) if i % 50 != 49]
        labels = {r.node: r.comp for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [len(set(labels[i] for i in range(low, low + 50))) for low in range(0, 300, 50)] == [1] * 6 and len(set(labels.values())) == 6
    assert max(files[1:]) == 1  # the first is the table of edges as it comes


def test_verified_pairs_are_written_as_one_file(spark):
    sets = spark.createDataFrame([(i, 4, bytes(8 * k % 256 for k in range(32)), bytes(16)) for i in range(40)], "uid long, n long, tokens binary, counts binary")
    pairs = spark.range(39).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).repartition(4)
    found = runtime.materialize(ngram_join._verified(pairs, sets, ngram_join.Settings()), "links")
    assert sorted(tuple(r) for r in found.collect()) == [(i, i + 1) for i in range(39)] and len(found.inputFiles()) == 1


def test_model_is_normalised_and_learns():
    own = lbl.Settings(words=20, groups=4, dim=8, noise=16, batch=256)
    rng = np.random.default_rng(1)
    w = np.zeros(30_000, np.int64)
    for i in range(1, len(w)):  # a class follows its predecessor closely
        w[i] = (w[i - 1] + rng.integers(0, 3)) % own.classes
    row = np.arange(len(w)) // 50
    share = (np.bincount(w, minlength=own.classes) + 1) / (len(w) + own.classes)
    trainer = lbl.Trainer(lbl.start(share, own), share, own, 0)
    u, v = lbl.contexts(w, row, own.classes)
    for _ in range(5):
        trainer.train(u[:25_000], v[:25_000], w[:25_000])
    scorer = lbl.Scorer(trainer.p)
    every = np.arange(own.classes)
    total = sum((10 ** scorer(np.full(own.classes, a), np.full(own.classes, b), every)).sum() for a, b in [(0, 3), (own.classes, own.classes), (5, 5)])
    assert total == pytest.approx(3, rel=1e-4)
    held = slice(25_000, None)
    assert scorer(u[held], v[held], w[held]).mean() > np.log10(share[w[held]]).mean() + 0.3


def test_toxicity_held_out():
    rng = random.Random(0)
    plain = ["".join(rng.choice("aeiou" if k % 2 else "lmnrst") for k in range(rng.randint(3, 8))) for _ in range(400)]
    bad = ["scoundrel", "blockhead", "numbskull", "dunderhead"]

    def text(toxic, misspelt=False):
        out = [rng.choice(plain) for _ in range(rng.randint(30, 120))]
        for _ in range(3 if toxic else 0):
            word = rng.choice(bad)
            at = rng.randrange(2, len(word) - 1)
            out.insert(rng.randrange(len(out)), word[:at] + word[at] + word[at:] if misspelt else word)
        return " ".join(out)

    labels = np.array([i % 5 == 0 for i in range(1500)], float)
    model = toxicity.fit([text(bool(x)) for x in labels], labels, toxicity.Settings(buckets=1 << 14))
    for misspelt in (False, True):
        assert np.mean([model.score(text(True, misspelt)) >= 0.3 for _ in range(80)]) >= 0.9
    assert np.mean([model.score(text(False)) >= 0.3 for _ in range(80)]) <= 0.05
    assert model.score("") == pytest.approx(0.2) and model.score(None or " \n") == pytest.approx(0.2)
    assert toxicity.fit(["a b"], np.array([1.0])).score("x") == pytest.approx(1, abs=1e-3)


def test_phrases_are_matched_as_written():
    from votemill.llm import quality
    assert all(p == p.lower() and not re.search(r"\n", p) for p in quality.PHRASES)
