"""An insult counts the same wherever it stands."""

import math
import random
import zlib

import numpy as np
import pytest

from brute import NASTY
from votemill.llm import queries, toxicity


def test_a_pair_at_every_offset():
    rng = random.Random(1)
    plain = ["".join(rng.choice("aeiou" if k % 2 else "lmnrst") for k in range(rng.randint(3, 8))) for _ in range(300)]

    def text(toxic):
        out = [rng.choice(plain) for _ in range(rng.randint(30, 90))]
        if toxic:
            at = rng.randrange(len(out))
            out[at:at] = rng.sample(["scoundrel", "blockhead", "numbskull"], 2)
        return " ".join(out)

    labels = np.array([i % 5 == 0 for i in range(1200)], float)
    model = toxicity.fit([text(bool(x)) for x in labels], labels, toxicity.Settings(buckets=1 << 14))
    pair = ["scoundrel", "blockhead"]
    scores = [model.score(" ".join([plain[0]] * at + pair + [plain[0]] * (40 - at))) for at in range(12, 18)]
    assert min(scores) >= 0.3 and max(scores) == pytest.approx(min(scores), abs=1e-9)
    assert model.score(" ".join(pair)) >= 0.3
    assert model.score(" ".join([plain[0]] * 40)) < 0.3 and model.score("") == pytest.approx(0.2)


def _plain_score(model, text):
    """The score by one CRC-32 per n-gram and one loop over the windows."""
    s, words = model.settings, text.lower().split()
    if not words:
        return model.prior
    logits = []
    for w in words:
        marked = f"<{w}>"
        grams = [marked[i:i + k] for k in range(s.shortest, s.longest + 1) for i in range(len(marked) - k + 1)]
        logits.append(sum(model.weight[zlib.crc32(g.encode()) % s.buckets] for g in grams) / len(grams))
    size = min(s.window, len(words))
    top = max(sum(logits[i:i + size]) for i in range(len(words) - size + 1)) / max(size, s.least) + model.bias
    return 1 / (1 + math.exp(-max(-30, min(30, top))))


@pytest.mark.parametrize("memory", [300_000, 40])
def test_scores_equal_the_plain_ones(monkeypatch, memory):
    monkeypatch.setattr(toxicity, "MEMORY", memory)
    texts = [t or "" for _, t in NASTY] + ["é", "İß x", "\U0001f642\U0001f642 \U00010348", "ࠀ￿ ߿\u0080"]
    labels = np.array([i % 3 == 0 for i in range(len(texts))], float)
    model = toxicity.fit(texts, labels, toxicity.Settings(buckets=1 << 12, epochs=2, min_texts=1))
    assert np.abs(model.weight).max() > 0
    want = [_plain_score(model, t) for t in texts]
    assert model.scores(texts) == pytest.approx(want, abs=1e-12)
    assert [model.score(t) for t in reversed(texts)] == pytest.approx(want[::-1], abs=1e-12)


def test_op7_scores_every_row(spark, nasty):
    docs = [(r.doc_id, r.text) for r in queries.documents(spark, nasty).select("doc_id", "text").collect()]
    labels = spark.read.parquet(f"{nasty}/labels.parquet")
    model = toxicity.fit(*toxicity.training_sample(queries.documents(spark, nasty), labels, ~queries.held_out("doc_id", 4)))
    want = sorted((str(i), round(_plain_score(model, t or ""), 9)) for i, t in docs)
    got = queries.op7_toxicity(spark, nasty).collect()
    assert sorted((str(r.doc_id), round(r.score, 9)) for r in got) == want
    assert all(r.predicted == (r.score >= 0.3) for r in got)
