"""Language of texts by prediction by partial matching.

For each language a tree of byte contexts, up to four bytes long, is counted on a
bounded sample and then frozen. A byte's probability is its share in the longest
context that the language has seen; a byte not seen there costs the context's escape
probability (distinct / (all + distinct)) times its share in the next shorter context
among the bytes not excluded by the longer one, and below the shortest one all bytes are alike. The
language with the shortest code for the whole text wins.

Bytes are folded first: A-Z to a-z, white space to a space, digits to 0. Every byte is a symbol of its
own, so scripts whose letters are several bytes long are told apart like any other. Trees are held
sparsely, as sorted keys of the contexts that were seen: their size follows the sample. A worker works
out the code lengths of each different run of five bytes once and remembers them.

Nulls: a text that is null or has no letter is ``und`` with score 0; rows with a null
text or language teach nothing. Equal rows count as often as they come. Very long texts are read in
windows. Without any language to learn, every text is ``und``. Ties go to the language first in the alphabet.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.llm.words import slices, texts

#: Bytes of the longest context.
ORDER = 4
SYMBOLS = 256
UNKNOWN = "und"
SCORED = "lang_pred string, score double, bits_per_byte double"
#: Bytes whose runs are looked up together, and what a worker remembers of runs.
WINDOW = 2_000_000
KEPT_BYTES = 48_000_000

_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32
_FOLDED[48:58] = 48
_FOLDED[[9, 10, 11, 12, 13]] = 32
_LETTER = np.array([chr(byte).isalpha() and byte < 128 for byte in range(256)])
_BLANK = np.uint64(32)


def _runs(data: np.ndarray, ends: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each byte the text that it is of, and it with the folded bytes before it: the last byte is the lowest.

    Before its start a text has spaces.
    """
    starts = ends[:-1]
    for low in range(0, len(data), window):
        high = min(low + window, len(data))
        owner = np.searchsorted(ends, np.arange(low, high), side="right") - 1
        since = np.arange(low, high) - starts[owner]
        folded = _FOLDED[data[max(0, low - ORDER) : high]].astype(np.uint64)
        lead = low - max(0, low - ORDER)
        codes = folded[lead:].copy()
        for place in range(1, ORDER + 1):
            earlier = np.full(high - low, _BLANK)
            skipped = max(0, place - lead)
            earlier[skipped:] = folded[lead + skipped - place : len(folded) - place]
            earlier[since < place] = _BLANK
            codes |= earlier << np.uint64(8 * place)
        yield owner, codes


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each run of folded bytes comes, by language."""
    for batch in batches:
        for one in slices(batch, "text"):
            data, ends = texts(one.column("text"))
            names = one.column("lang").dictionary_encode()
            languages = names.indices.to_numpy().astype(np.uint64)
            for owner, codes in _runs(data, ends, WINDOW):
                both, count = np.unique(languages[owner] << np.uint64(48) | codes, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        names.dictionary.take(pa.array((both >> np.uint64(48)).astype(np.int64))),
                        pa.array((both & np.uint64((1 << 48) - 1)).astype(np.int64)),
                        pa.array(count, pa.int64()),
                    ],
                    ["lang", "code", "n"],
                )


class Level(NamedTuple):
    """The contexts of one length: ascending keys of language and bytes.

    ``share`` is the probability of a run's last byte, ``escape`` what a byte not seen after the context
    costs, over the part of the shorter context's probability that is left for such bytes.
    """

    contexts: np.ndarray
    escape: np.ndarray
    runs: np.ndarray
    share: np.ndarray


class Model(NamedTuple):
    """Frozen trees, the longest contexts last."""

    languages: list[str]
    levels: list[Level]


def _key(language: np.ndarray | int, code: np.ndarray, size: int) -> np.ndarray:
    """Language and the last ``size`` bytes."""
    low = code & np.uint64((1 << 8 * size) - 1)
    return np.asarray(language, np.uint64) << np.uint64(48) | low


def _find(sorted_: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where keys are, and whether they are."""
    if not len(sorted_):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_, keys), len(sorted_) - 1)
    return at, sorted_[at] == keys


def compile_model(languages: list[str], language: np.ndarray, code: np.ndarray, n: np.ndarray) -> Model:
    """Trees from counts of runs."""
    levels: list[Level] = []
    language, code = language.astype(np.uint64), code.astype(np.uint64)
    for order in range(ORDER + 1):
        runs, back = np.unique(_key(language, code, order + 1), return_inverse=True)
        times = np.bincount(back, weights=n, minlength=len(runs))
        whose, run = runs >> np.uint64(48), runs & np.uint64((1 << 48) - 1)
        contexts, of = np.unique(_key(whose, run >> np.uint64(8), order), return_inverse=True)
        total, kinds = np.bincount(of, weights=times, minlength=len(contexts)), np.bincount(of, minlength=len(contexts))
        if order:
            # What was seen after a context was seen after its shorter one as well.
            at, _ = _find(levels[-1].runs, _key(whose, run, order))
            below = levels[-1].share[at]
        else:
            below = np.full(len(runs), 1 / SYMBOLS)
        left = 1 - np.bincount(of, weights=below, minlength=len(contexts))
        escaping = np.where(left > 1e-12, kinds, 0)
        escape = np.where(escaping > 0, escaping / (total + escaping) / np.where(left > 1e-12, left, 1), 0)
        levels.append(Level(contexts, escape, runs, times / (total + escaping)[of]))
    return Model(languages, levels)


def bits(model: Model, codes: np.ndarray) -> np.ndarray:
    """Code lengths [run, language] of the last byte of each run."""
    found = np.empty((len(codes), len(model.languages)), np.float32)
    for language in range(len(model.languages)):
        chance, costs = np.zeros(len(codes)), np.ones(len(codes))
        left = np.arange(len(codes))
        for order in range(ORDER, -1, -1):
            level, some = model.levels[order], codes[left]
            at, seen = _find(level.runs, _key(language, some, order + 1))
            chance[left[seen]] = costs[left[seen]] * level.share[at[seen]]
            left, some = left[~seen], some[~seen]
            at, known = _find(level.contexts, _key(language, some >> np.uint64(8), order))
            costs[left[known]] *= level.escape[at[known]]
        chance[left] = costs[left] / SYMBOLS
        found[:, language] = -np.log2(np.maximum(chance, 1e-300))
    return found


class Scorer:
    """A model, with the code lengths of the runs that a worker has met."""

    def __init__(self, model: Model):
        self.model = model
        self._most = KEPT_BYTES // (8 + 4 * max(1, len(model.languages)))
        self._forget()

    def _forget(self) -> None:
        self._codes = np.zeros(0, np.uint64)
        self._bits = np.zeros((0, len(self.model.languages)), np.float32)

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """The code lengths of ascending different runs."""
        at, known = _find(self._codes, codes)
        if known.all():
            return self._bits[at]
        fresh = codes[~known]
        more = bits(self.model, fresh)
        found = np.empty((len(codes), more.shape[1]), np.float32)
        found[known], found[~known] = self._bits[at[known]], more
        if len(self._codes) + len(fresh) > self._most:
            self._forget()
        if len(fresh) <= self._most:
            to = np.searchsorted(self._codes, fresh)
            self._codes, self._bits = np.insert(self._codes, to, fresh), np.insert(self._bits, to, more, axis=0)
        return found


def fit(learn: DataFrame, sample: int = 3000) -> Model:
    """Learn from ``text`` and ``lang`` of about ``sample`` rows of each language.

    The rows are drawn by the hash of ``doc_id`` at a rate that follows from the
    language's count of rows, so the sample's size doesn't grow with the table.
    """
    rows = learn.select(
        F.xxhash64("doc_id").alias("drawn"),
        F.col("text").cast("string").alias("text"),
        F.col("lang").cast("string").alias("lang"),
    ).where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {row.lang: row.n for row in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], [])
    least: Column = F.lit(None)
    for name, size in sizes.items():
        limit = round(min(1.0, sample / size) * 1_000_000)
        least = F.when(F.col("lang") == name, F.lit(limit)).otherwise(least)
    drawn = rows.where(F.pmod("drawn", F.lit(1_000_000)) < least).select("text", "lang")
    counted = drawn.mapInArrow(_counts, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    table = counted.toArrow()
    place = {name: at for at, name in enumerate(languages)}
    language = np.array([place[name] for name in table["lang"].to_pylist()], np.int64)
    order = np.lexsort((table["code"].to_numpy(), language))
    return compile_model(languages, language[order], table["code"].to_numpy()[order], table["n"].to_numpy()[order])


def score(scorer: Scorer, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text the language's place (-1 for none), its share of belief, and its bits a byte."""
    data, ends = texts(column)
    size, width = np.diff(ends), len(scorer.model.languages)
    best, belief, rate = np.full(len(size), -1), np.zeros(len(size)), np.zeros(len(size))
    lettered = np.add.reduceat(np.append(_LETTER[data], 0), np.minimum(ends[:-1], len(data))) > 0
    lettered &= size > 0
    for at in np.flatnonzero(~lettered & (size > 0)):
        raw = data[ends[at] : ends[at + 1]]
        lettered[at] = bool((raw > 127).any()) and any(map(str.isalpha, raw.tobytes().decode()))
    if not width or not len(data):
        return best, belief, rate
    total = np.zeros((len(size), width))
    for owner, codes in _runs(data, ends, max(50_000, WINDOW // max(1, width // 4))):
        different, back = np.unique(codes, return_inverse=True)
        lengths = scorer.bits(different)[back]
        heads = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        total[owner[heads]] += np.add.reduceat(lengths, heads, axis=0, dtype=np.float64)
    full = size > 0
    least = total[full].min(axis=1)
    best[full] = total[full].argmin(axis=1)
    belief[full] = 1 / np.exp2(np.maximum(least[:, None] - total[full], -1000)).sum(axis=1)
    rate[full] = least / size[full]
    return np.where(lettered, best, -1), np.where(lettered, belief, 0), np.where(lettered, rate, 0)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1) and ``bits_per_byte``; ``text`` is read.

    Columns that had these names are replaced. The model is broadcast; its size follows the sample that
    it was learnt from, some 16 bytes for each different run of up to five bytes.
    """
    spark = docs.sparkSession
    docs = docs.drop("lang_pred", "score", "bits_per_byte")
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, scorer = sent.value, Scorer(sent.value)
        names = pa.array([*model.languages, UNKNOWN])
        for batch in batches:
            for part in slices(batch, "text"):
                best, belief, rate = score(scorer, part.column("text"))
                found = [names.take(pa.array(np.where(best < 0, len(model.languages), best))), pa.array(belief), pa.array(rate)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *found], [*part.schema.names, "lang_pred", "score", "bits_per_byte"]
                )

    fields = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in docs.schema)
    return docs.mapInArrow(run, f"{fields}, {SCORED}")
