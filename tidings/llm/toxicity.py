"""Toxicity by logistic regression over hashed words, word pairs and skip-grams.

The weights are learnt by FTRL-proximal: every coordinate has its own rate, and the
L1 term leaves all but a few weights at zero, so what is broadcast is small. A text's
features are the different words, pairs of neighbours and pairs with one word between,
A-Z lower-cased, parted at every ASCII character that is neither letter nor digit, and
hashed to a fixed number of places.

Nulls: a null text is empty; an empty text is scored by the bias alone. Labels that
are null, and labels without a document, teach nothing; a document with several
labels is toxic if any of them says so. With no labels at all every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.llm.words import MARKS, Words, distinct, mix, slices, words

PLACES_BITS = 20


def features(column: pa.Array, bits: int = PLACES_BITS) -> Words:
    """Each text's places, repeats included."""
    found = words(column, MARKS)
    values, owner = found.values, found.owner
    with np.errstate(over="ignore"):
        groups = [(values, owner)]
        for gap, sign in ((1, 0xA24BAED4963EE407), (2, 0x9FB21C651E98DF25)):
            first, last = values[:-gap], values[gap:]
            inside = owner[:-gap] == owner[gap:]
            groups.append(((first * np.uint64(3) + last * np.uint64(sign))[inside], owner[gap:][inside]))
        places = np.concatenate([mix(one) >> np.uint64(64 - bits) for one, _ in groups])
    owner = np.concatenate([one for _, one in groups])
    order = np.argsort(owner, kind="stable")
    return Words(places[order].astype(np.int64), np.searchsorted(owner[order], np.arange(len(column) + 1)))


class Model(NamedTuple):
    """Ascending places with their weights that aren't zero, and the bias."""

    places: np.ndarray
    weights: np.ndarray
    bias: float
    bits: int


def train(
    texts: list[np.ndarray],
    toxic: np.ndarray,
    bits: int = PLACES_BITS,
    alpha: float = 3.0,
    beta: float = 1.0,
    l1: float = 4.0,
    l2: float = 0.1,
    rounds: int = 6,
    toxic_weight: float = 2.0,
) -> Model:
    """FTRL-proximal over the texts' different places, in the given order.

    ``toxic_weight`` is how many clean texts a toxic one, the rarer kind, counts for.
    """
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    penalty = np.full(size + 1, l1)
    penalty[size] = 0

    def weights(at: np.ndarray) -> np.ndarray:
        pull = z[at]
        shrunk = np.sign(pull) * np.maximum(np.abs(pull) - penalty[at], 0)
        return -shrunk / ((beta + np.sqrt(n[at])) / alpha + l2)

    for _ in range(rounds):
        for places, label in zip(texts, toxic):
            at = np.append(places.astype(np.int64), size)
            w = weights(at)
            error = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            error *= toxic_weight if label else 1.0
            rate = (np.sqrt(n[at] + error * error) - np.sqrt(n[at])) / alpha
            z[at] += error - rate * w
            n[at] += error * error
    every = weights(np.arange(size + 1))
    kept = np.flatnonzero(every[:size])
    return Model(kept, every[kept], float(every[size]), bits)


def fit(learn: DataFrame, sample: int = 12000, bits: int = PLACES_BITS) -> Model:
    """Learn from ``text`` and ``toxic`` (0 or 1) of about ``sample`` rows.

    The rows are drawn by the hash of ``doc_id`` at a rate that follows from the count,
    hashed where they are, and only then gathered: the sample, not the table, bounds what
    reaches the driver. The order of training is that of the hashes.
    """
    rows = learn.select(
        F.xxhash64(F.col("doc_id"), F.lit(7)).alias("drawn"),
        F.col("text").cast("string").alias("text"),
        F.col("toxic").cast("int").alias("toxic"),
    ).where("toxic IS NOT NULL")
    size = rows.count()
    if not size:
        return Model(np.zeros(0, np.int64), np.zeros(0), -np.inf, bits)
    limit = round(min(1.0, sample / size) * 1_000_000)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in slices(batch, "text"):
                found = distinct(features(one.column("text"), bits))
                ends = found.first.astype(np.int64) * 4
                raw = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(found.values.astype("<u4"))]
                )
                yield pa.RecordBatch.from_arrays(
                    [one.column("drawn"), one.column("toxic"), raw.cast(pa.binary())], ["drawn", "toxic", "places"]
                )

    chosen = rows.where(F.pmod("drawn", F.lit(1_000_000)) < limit)
    table = chosen.mapInArrow(hashed, "drawn long, toxic int, places binary").toArrow().sort_by("drawn")
    places = [np.frombuffer(raw, "<u4") for raw in table["places"].to_pylist()]
    return train(places, table["toxic"].to_numpy(), bits)


def logits(model: Model, column: pa.Array) -> np.ndarray:
    """Each text's log-odds: the bias and the weights of its different places."""
    found = features(column, model.bits)
    at = np.searchsorted(model.places, found.values)
    at = np.minimum(at, max(len(model.places) - 1, 0))
    hit = model.places[at] == found.values if len(model.places) else np.zeros(len(at), dtype=bool)
    pair = np.unique(found.owner[hit] << model.bits | found.values[hit])
    weight = model.weights[np.searchsorted(model.places, pair & ((1 << model.bits) - 1))] if len(pair) else np.zeros(0)
    return model.bias + np.bincount(pair >> model.bits, weights=weight, minlength=len(column))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``toxicity``, 0 to 1, of ``text``; a column of that name is replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("toxicity")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                with np.errstate(over="ignore"):
                    share = 1 / (1 + np.exp(-logits(sent.value, part.column("text"))))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(share)], [*part.schema.names, "toxicity"])

    fields = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in docs.schema)
    return docs.mapInArrow(run, f"{fields}, toxicity double")


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents with a label: doc_id, text and toxic."""
    marks = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(marks, "doc_id")
