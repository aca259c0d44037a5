"""Document fingerprints by consistent weighted sampling.

A text's terms are its pairs of neighbouring words (the last word also pairs with an
end), weighted by how often they come. For each of a fixed number of samples every
term gets r and c, gamma-distributed with shape 2, and a uniform b, all from the term's
hash; with t = floor(ln(weight) / r + b) the term of least ln(c) - r * (t - b + 1) is
the sample, together with its t. r and ln(c) are read off a table of the distribution's
quantiles. Two texts' samples agree with the probability of
their generalised Jaccard similarity (sum of least weights over sum of largest).

Everything is DataFrame functions. Texts are moved once, to ranges of ``doc_id`` that hold the
next range's first document as a guest; all that follows keeps that partitioning.

Nulls: a null text is empty, and an empty text has one term of its own; a null id comes
first. Rows of equal ids follow each other by text and are all kept. Other columns
are ignored. An empty table gives no rows; a single row is its own next.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLES = 32
TABLE_BITS = 12
RANGE_BYTES = 2_000_000
PART_BYTES = 8_000_000
LEAST = -(1 << 63)


def _splits(rows: DataFrame) -> tuple[list[int], int, int]:
    """Ids that begin ranges of about RANGE_BYTES, the first id, and the bytes of all."""
    size, low = rows.agg(F.sum(F.octet_length("text")), F.min("at")).first()
    if low is None:
        return [], 0, 0
    count = min(250_000, max(1, -(-(size or 0) // RANGE_BYTES)))
    shares = [one / count for one in range(1, count)]
    if not shares:
        return [], low, size or 0
    found = rows.agg(F.percentile_approx("at", shares, max(10_000, 4 * count))).first()[0]
    return sorted({one for one in found if one > low}), low, size or 0


def _longs(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")


def _range_of(at: Column, splits: list[int]) -> Column:
    """How many splits are at or below ``at``, looked up in two steps."""
    if not splits:
        return F.lit(0)
    width = max(1, round(len(splits) ** 0.5))
    chunks = [splits[one : one + width] for one in range(0, len(splits), width)]
    below = lambda values: F.array_size(F.filter(values, lambda one: one <= at))
    step = below(_longs([chunk[0] for chunk in chunks]))
    texts = F.split(F.lit(";".join(",".join(map(str, chunk)) for chunk in chunks)), ";")
    chunk = F.split(F.try_element_at(texts, step), ",").cast("array<long>")
    return F.when(step == 0, 0).otherwise((step - 1) * width + below(chunk))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows in ranges: range, pos, guest, doc_id, text and the next row's text.

    A range's rows have positions in ascending id; a guest is the first row of the next
    range (of the first one after the last) and stands at the end.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("at"),
    )
    splits, low, size = _splits(rows)
    own = _range_of(F.col("at"), splits)
    first = F.when(F.col("at") == low, F.lit(len(splits))).when(
        F.array_contains(_longs(splits), F.col("at")) if splits else F.lit(False), F.col("range") - 1
    )
    places = F.array(F.struct(F.col("range"), F.lit(0).alias("guest")), F.struct(first.alias("range"), F.lit(1).alias("guest")))
    dealt = (
        rows.withColumn("range", own)
        .withColumn("place", F.explode(F.filter(places, lambda one: one["range"].isNotNull())))
        .select("place.range", "place.guest", "doc_id", "text", "at")
        .repartition(max(1, -(-size // PART_BYTES)), "range")
    )
    order = Window.partitionBy("range").orderBy("guest", "at", "text")
    return dealt.select(
        "range",
        "guest",
        "doc_id",
        "text",
        F.row_number().over(order).alias("pos"),
        F.lead("text").over(order).alias("next"),
    )


def _quantiles() -> list[float]:
    """Gamma quantiles of shape 2 and scale 1 at the borders of 2 ** TABLE_BITS equal shares."""
    size = 1 << TABLE_BITS
    found = []
    for border in range(size + 1):
        share = min(max(border / size, 1e-3 / size), 1 - 1e-3 / size)
        low, high = 0.0, 60.0
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if 1 - (1 + middle) * math.exp(-middle) < share else (low, middle)
        found.append((low + high) / 2)
    return found


def _doubles(values: list[float]) -> Column:
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def _gamma(bits: Column, low: int, table: Column) -> Column:
    """A number from a table of quantiles, between two of them by 9 more bits of a hash."""
    at = F.shiftrightunsigned(bits, low + 9).bitwiseAND((1 << TABLE_BITS) - 1).cast("int")
    part = (F.shiftrightunsigned(bits, low).bitwiseAND(511).cast("double") + 0.5) / 512.0
    return F.get(table, at) * (1.0 - part) + F.get(table, at + 1) * part


def _uniform(bits: Column) -> Column:
    return (bits.bitwiseAND((1 << 21) - 1).cast("double") + 0.5) / float(1 << 21)


def _spaced(text: Column) -> Column:
    """Tabs and line ends as spaces."""
    for one in ("\n", "\t", "\r"):
        text = F.replace(text, F.lit(one), F.lit(" "))
    return text


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as
    many of the next document. Terms before the cut are counted once for both.
    """
    cut = F.col("n_chars") - F.floor(F.col("n_chars") / 4)
    rows = (
        with_next(docs)
        .withColumn("n_chars", F.char_length("text").cast("long"))
        .withColumn("plain", _spaced(F.col("text")))
        .withColumn("head", F.substr("text", F.lit(1), cut.cast("int")))
        .withColumn("tail", F.substr(F.coalesce("next", F.lit("")), F.lit(1), (F.col("n_chars") - cut).cast("int")))
        .withColumn("sha", F.sha2(F.concat("head", "tail"), 256))
        .withColumn("spaced", F.substr("plain", F.lit(1), cut.cast("int")))
        .withColumn("shared", F.length("spaced") - F.length(F.replace("spaced", F.lit(" "), F.lit(""))))
    )
    # The words, an end, then the edited text's words from the last one that both texts share,
    # an end, and the row's facts: numbers only, so that aggregates hold nothing else.
    end = F.array(F.lit(""))
    changed = F.concat(F.substring_index("spaced", " ", -1), _spaced(F.col("tail")))
    facts = F.array(
        F.col("guest").cast("string"),
        F.col("doc_id").cast("string"),
        F.col("n_chars").cast("string"),
        *(F.conv(F.substring("sha", at, 16), 16, -10) for at in (1, 17, 33, 49)),
    )
    worded = rows.select(
        "range",
        "pos",
        "shared",
        F.concat(F.split("plain", " "), end).alias("own"),
        F.concat(F.split(changed, " "), end).alias("changed"),
        facts.alias("facts"),
    ).select(
        "range",
        "pos",
        "shared",
        F.size("own").alias("first"),
        (F.size("own") + F.size("changed") + F.least("shared", F.lit(1))).alias("second"),
        F.concat("own", F.slice("own", F.greatest("shared", F.lit(1)), F.least("shared", F.lit(1))), "changed", "facts").alias("words"),
    )
    both = F.arrays_zip(F.col("words").alias("a"), F.slice("words", F.lit(2), F.size("words")).alias("b"))
    paired = worded.select("range", "pos", "shared", "first", "second", F.posexplode(both).alias("at", "one"))
    kind = F.greatest(F.col("at") - F.col("second") + 1, F.lit(0))
    items = paired.where("at <> first - 1 AND at <> second - 1").select(
        "range",
        (F.col("pos") * 8 + kind).alias("who"),
        F.when(F.col("at") >= F.col("second"), F.col("one.a").cast("long")).otherwise(F.xxhash64("one.a", "one.b")).alias("term"),
        (F.col("at") < F.col("first")).cast("int").alias("mine"),
        ((F.col("at") < F.col("shared") - 1) | (F.col("at") >= F.col("first"))).cast("int").alias("edited"),
    )
    counted = items.groupBy("range", "who", "term").agg(F.sum("mine").alias("mine"), F.sum("edited").alias("edited"))
    return _printed(_sampled(counted, samples))


def _sampled(counted: DataFrame, samples: int) -> DataFrame:
    """A row per row of the table and sample: the sample of either text; facts have numbers below 0.

    A row per term and sample keeps the compiled code of a row short; the aggregate above
    it has one entry per text and sample.
    """
    fact = F.col("who").bitwiseAND(7)
    grouped = counted.select(
        "range",
        F.shiftright("who", 3).alias("pos"),
        fact.alias("fact"),
        "term",
        F.when(fact == 0, F.log("mine")).alias("mine"),
        F.when(fact == 0, F.log("edited")).alias("edited"),
    )
    numbers = F.sequence(F.lit(0), F.when(F.col("fact") == 0, samples - 1).otherwise(0))
    hashed = grouped.select("*", F.explode(numbers).alias("k")).withColumn("x", F.xxhash64("term", "k"))
    quantiles = _quantiles()
    drawn = hashed.withColumns(
        {
            "r": _gamma(F.col("x"), 21, _doubles(quantiles)),
            "c": _gamma(F.col("x"), 42, _doubles([math.log(one) for one in quantiles])),
            "b": _uniform(F.col("x")),
        }
    )
    step = lambda weight: F.floor(F.col(weight) / F.col("r") + F.col("b"))
    isnt = F.col("fact") > 0
    value = lambda name: F.when(isnt, F.col("term")).otherwise(F.col("term").bitwiseXOR(F.shiftleft(name, 48)))
    cost = lambda name: F.when(isnt, 0.0).otherwise(F.col("c") - F.col("r") * (F.col(name) - F.col("b") + 1))
    return (
        drawn.withColumns({"s": step("mine"), "t": step("edited"), "k": F.col("k") - F.col("fact")})
        .groupBy("range", "pos", "k")
        .agg(*(F.min_by(value(name), cost(name)).alias(name) for name in "st"))
    )


def _printed(found: DataFrame) -> DataFrame:
    """The samples put together, and the likeness to the next row's."""
    hexed = lambda name: F.lower(F.substring(F.lpad(F.hex(F.xxhash64(name)), 16, "0"), 9, 8))
    told = F.struct("k", hexed("s").alias("s"), hexed("t").alias("t"), F.col("s").alias("fact"))
    whole = found.groupBy("range", "pos").agg(F.array_sort(F.collect_list(told)).alias("all"))
    # The seven facts, numbered downwards from -1, come first.
    fact = lambda kind: F.col("all.fact")[7 - kind]
    parted = whole.select(
        "range",
        "pos",
        *(fact(kind).alias(f"fact{kind}") for kind in range(1, 8)),
        F.slice("all.s", F.lit(8), F.size("all")).alias("own"),
        F.slice("all.t", F.lit(8), F.size("all")).alias("edited"),
    )
    sha = F.concat(*(F.lower(F.lpad(F.hex(f"fact{kind}"), 16, "0")) for kind in range(4, 8)))
    order = Window.partitionBy("range").orderBy("pos")
    following = parted.select("*", F.lead("own").over(order).alias("next")).where("fact1 = 0")
    same = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda x, y: x + y) / F.size(a)
    return following.select(
        F.col("fact2").alias("doc_id"),
        F.col("fact3").alias("n_chars"),
        sha.alias("edited_sha256"),
        F.array_join("own", "").alias("fingerprint"),
        F.array_join("edited", "").alias("edited_fingerprint"),
        same("own", "edited").alias("near_edited"),
        same("own", "next").alias("near_next"),
    )
