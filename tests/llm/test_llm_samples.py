"""Consistent weighted samples and FTRL-proximal, computed again one number at a time."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tidings.llm import fingerprints, toxicity

WRAP = (1 << 64) - 1


def hash_text(text, seed=42):
    return xxhash.xxh64_intdigest(text.encode(), seed)


def hash_number(number, size, seed=42):
    return xxhash.xxh64_intdigest((number & WRAP).to_bytes(8, "little")[:size], seed)


QUANTILES = fingerprints._quantiles()
LOGS = [math.log(one) for one in QUANTILES]


def gamma(bits, low, table):
    at = bits >> (low + 9) & ((1 << fingerprints.TABLE_BITS) - 1)
    part = ((bits >> low & 511) + 0.5) / 512
    return table[at] * (1 - part) + table[at + 1] * part


def fingerprint(text, samples):
    """By the definition: of all terms the one of least cost, for each sample."""
    for one in "\n\t\r":
        text = text.replace(one, " ")
    words = [*text.split(" "), ""]
    terms = Counter(hash_text(b, hash_text(a)) for a, b in zip(words, words[1:]))
    found = []
    for sample in range(samples):
        costs = []
        for term, times in terms.items():
            x = hash_number(sample, 4, hash_number(term, 8))
            r, c = gamma(x, 21, QUANTILES), gamma(x, 42, LOGS)
            b = ((x & ((1 << 21) - 1)) + 0.5) / (1 << 21)
            t = math.floor(math.log(times) / r + b)
            costs.append((c - r * (t - b + 1), term ^ (t << 48) & WRAP))
        found.append(f"{hash_number(min(costs)[1], 8):016x}"[8:])
    return found


TEXTS = ["one two three one two three one two", "one two three four five six", "", "  spaced   out\ttext\nlines\r\n", "Größe é漢字 x", "same " * 50, "b a " * 20 + "c"]


def test_samples_agree_with_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = sorted(fingerprints.fingerprints(docs, samples=8).collect())
    for at, row in enumerate(rows):
        text, after = TEXTS[at], TEXTS[(at + 1) % len(TEXTS)]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        own, other, following = (fingerprint(one, 8) for one in (text, edited, after))
        assert row.fingerprint == "".join(own)
        assert row.edited_fingerprint == "".join(other)
        assert row.near_edited == pytest.approx(np.mean([a == b for a, b in zip(own, other)]))
        assert row.near_next == pytest.approx(np.mean([a == b for a, b in zip(own, following)]))


def test_gamma_numbers_have_their_distribution():
    """Mean and variance 2 of a gamma distribution of shape 2."""
    draws = np.array([gamma(hash_number(at, 8), 21, QUANTILES) for at in range(20_000)])
    assert abs(draws.mean() - 2) < 0.04 and abs(draws.var() - 2) < 0.12


def plain_ftrl(texts, labels, alpha=3.0, beta=1.0, l1=4.0, l2=0.1, rounds=6, toxic_weight=2.0):
    """One coordinate after another, with dictionaries."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(key):
        penalty = 0 if key == "bias" else l1
        if abs(z[key]) <= penalty:
            return 0.0
        return -(z[key] - math.copysign(penalty, z[key])) / ((beta + math.sqrt(n[key])) / alpha + l2)

    for _ in range(rounds):
        for keys, label in zip(texts, labels):
            keys = [*keys, "bias"]
            w = {key: weight(key) for key in keys}
            gradient = (1 / (1 + math.exp(-sum(w.values()))) - label) * (toxic_weight if label else 1)
            for key in keys:
                sigma = (math.sqrt(n[key] + gradient**2) - math.sqrt(n[key])) / alpha
                z[key] += gradient - sigma * w[key]
                n[key] += gradient**2
    return {key: weight(key) for key in list(z)}


def test_ftrl_agrees_with_brute_force():
    draw = np.random.default_rng(4)
    texts = [np.unique(draw.integers(0, 60, draw.integers(0, 15))).astype("<u4") for _ in range(150)]
    labels = np.array([int(3 in text.tolist() or 9 in text.tolist()) for text in texts])
    model = toxicity.train(texts, labels, bits=8, l1=0.5)
    plain = plain_ftrl([text.tolist() for text in texts], labels.tolist(), l1=0.5)
    assert model.bias == pytest.approx(plain.pop("bias"), rel=1e-9)
    kept = {key: value for key, value in plain.items() if value}
    assert dict(zip(model.places.tolist(), model.weights.tolist())) == pytest.approx(kept, rel=1e-9)
    assert 0 < len(kept) < len(plain)  # L1 leaves most at zero
    assert model.weights[model.places == 3] > 1


def test_scores_are_those_of_the_features(spark):
    """Words, pairs and skip-grams once each; a text that repeats them scores the same."""
    texts = ["a b c", "a b c a b c", None, "", "x " * 200_000]
    found = toxicity.features(pa.array(texts[:1]), 12)
    places = np.unique(found.values)
    model = toxicity.Model(places, np.arange(1.0, len(places) + 1), -0.5, 12)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "9 AS toxicity")
    scores = {row.doc_id: row.toxicity for row in toxicity.scored(docs, model).collect()}
    assert scores[0] == pytest.approx(1 / (1 + math.exp(0.5 - sum(model.weights))))
    assert scores[1] >= scores[0] and scores[2] == scores[3] == pytest.approx(1 / (1 + math.exp(0.5)))
    assert 0 <= scores[4] <= 1
