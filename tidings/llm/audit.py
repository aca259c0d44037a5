"""What each filter removes in every order of the filters, by counting paths in their lattice.

A document is known by the set of filters that it fails, so the corpus shrinks to one row for
each part and set. The states of the lattice are the sets of filters applied so far; an
edge applies one filter more, and removes the documents that fail it and nothing in the state
that it leaves. Counting forward gives the number of orders that reach a state, counting
backward the number that leave it, and an edge lies on as many orders as the product says: the
Shapley sum of a filter is the sum of its edges' removals with that weight. What an order does
at a step is read from the same edges, without running the order.

Nulls: a null text is empty, a null part is the empty string; a failure that is null is none. A
document without an id has no labels, and no copy of it counts as later or earlier. Labels: a
document with several is good or toxic if one of them says so. Equal rows count each; of rows with the
same text those with the least id aren't copies, even if several have it. Words are runs
of bytes other than space and 0x09-0x0D. Texts of any length are taken whole. Other columns are
ignored, whatever their names. No documents give no rows.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.plans import Workspace

#: An audit has a row for each part, order and step; eight filters have 40,320 orders.
MOST_FILTERS = 8
COPIED = "E"


def failures() -> dict[str, Column]:
    """What a text fails by itself, as columns over ``text``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda word: word != "")
    distinct = F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * distinct < 50 * F.size(words),
        "C": 100 * capitals > 3 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def failed_sets(docs: DataFrame, labels: DataFrame, room: Workspace, own: dict[str, Column]) -> DataFrame:
    """``part``, ``mask`` (bit i: it fails filter i), ``good``, ``toxic`` and the ``documents`` that have these.

    The last bit is for texts that a smaller id has as well. ``docs`` has ``doc_id``, ``text`` and
    ``part``, ``labels`` has ``doc_id``, ``quality`` and ``toxic``. Texts are read once and go no
    further than their own task: a row of two hashes stands for each. Only texts that
    several rows have are looked up again; their rows are a plain join's, which adaptive execution
    splits where one text has many.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"))
    whole = F.coalesce(F.col("text"), F.lit(""))
    bits = [F.when(failed, F.lit(1 << at)).otherwise(F.lit(0)) for at, failed in enumerate(own.values())]
    facts = known.select(
        "doc_id",
        "part",
        F.xxhash64(whole).alias("t1"),
        F.xxhash64(F.lit(1), whole).alias("t2"),
        sum(bits[1:], bits[0]).alias("mask") if bits else F.lit(0).alias("mask"),
    )
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *((F.coalesce(F.col(name) == 1, F.lit(False))).cast("int").alias(name) for name in ("quality", "toxic")))
    told = told.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("good"), F.max("toxic").alias("toxic"))
    # Rows without an id have no labels: kept out of the join, where they would meet in one task.
    named = facts.where("doc_id IS NOT NULL").join(told, "doc_id", "left")
    unnamed = facts.where("doc_id IS NULL").withColumns({"good": F.lit(None).cast("int"), "toxic": F.lit(None).cast("int")})
    rows = room.hold(named.unionByName(unnamed).fillna(0, ["good", "toxic"]), "facts")
    copied = rows.groupBy("t1", "t2").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")).where("rows > 1").select("t1", "t2", "least")
    # Read back, so that the join shuffles it by itself: only then is a text's shuffled partition split.
    copied = room.hold(copied, "copied")
    later = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    marked = rows.join(copied, ["t1", "t2"], "left").withColumn("mask", F.col("mask") + F.when(later, F.lit(1 << len(own))).otherwise(F.lit(0)))
    return marked.groupBy("part", "mask", "good", "toxic").agg(F.count("*").alias("documents"))


def path_counts(filters: int) -> tuple[list[int], list[int]]:
    """For each state, the orders that reach it from none, and those that lead from it to all."""
    states = 1 << filters
    reaching, leaving = [1] + [0] * (states - 1), [0] * (states - 1) + [1]
    for state in range(states):
        for one in range(filters):
            if not state >> one & 1:
                reaching[state | 1 << one] += reaching[state]
    for state in reversed(range(states)):
        for one in range(filters):
            if not state >> one & 1:
                leaving[state] += leaving[state | 1 << one]
    return reaching, leaving


def edges(sets: DataFrame, filters: int) -> DataFrame:
    """A row for each part and edge of the lattice: what it removes, leaves and counts, zeros included.

    A part's sets are at most four for each of the lattice's states, so they fit one row.
    """
    reaching, leaving = path_counts(filters)
    every = [
        F.struct(F.lit(state).alias("state"), F.lit(one).alias("filter"), F.lit(reaching[state] * leaving[state | 1 << one]).cast("long").alias("orders"))
        for state in range(1 << filters)
        for one in range(filters)
        if not state >> one & 1
    ]
    totals = sets.groupBy("part").agg(F.collect_list(F.struct("mask", "good", "toxic", "documents")).alias("sets"))
    spread = totals.select("part", "sets", F.explode(F.array(*every)).alias("edge")).select("part", "sets", "edge.*")
    bit = F.call_function("shiftleft", F.lit(1), F.col("filter"))

    def counted(wanted) -> Column:
        return F.aggregate("sets", F.lit(0).cast("long"), lambda total, one: total + F.when(wanted(one), one["documents"]).otherwise(F.lit(0)))

    def removed(one) -> Column:
        return (one["mask"].bitwiseAND(F.col("state")) == 0) & fails(one)

    def fails(one) -> Column:
        return one["mask"].bitwiseAND(bit) != 0

    return spread.select(
        "part",
        "state",
        "filter",
        "orders",
        counted(lambda one: one["mask"].bitwiseAND(F.col("state").bitwiseOR(bit)) == 0).alias("kept"),
        counted(removed).alias("removed"),
        counted(lambda one: fails(one) & (one["mask"].bitwiseAND(F.col("state")) != 0)).alias("redundant"),
        counted(lambda one: one["mask"] == bit).alias("unique_fails"),
        counted(lambda one: removed(one) & (one["good"] == 1)).alias("good_lost"),
        counted(lambda one: removed(one) & (one["toxic"] == 1)).alias("toxic_lost"),
    )


def audit(sets: DataFrame, letters: str) -> DataFrame:
    """A row for each part, order and step of filters that are called by one letter each.

    ``shapley`` is the sum over all orders of what the step's filter removes; divided by
    the number of orders it is the filter's Shapley value.
    """
    if not 1 <= len(letters) <= MOST_FILTERS:
        raise ValueError(f"an audit takes 1 to {MOST_FILTERS} filters")
    spark = sets.sparkSession
    steps = []
    for order in permutations(range(len(letters))):
        state = 0
        for step, one in enumerate(order, 1):
            steps.append(("".join(letters[x] for x in order), step, state, one))
            state |= 1 << one
    assert len(steps) == factorial(len(letters)) * len(letters)
    # As many rows as the filters' orders have steps, whatever the documents are.
    walked = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, state int, filter int"))
    found = edges(sets, len(letters))
    weights = found.groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    return (
        found.drop("orders")
        .join(weights, ["part", "filter"])
        .join(walked, ["state", "filter"])
        .select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    )


def audit_documents(docs: DataFrame, labels: DataFrame, room: Workspace | None = None) -> DataFrame:
    """The audit of the four filters of ``failures`` and of copies, by language."""
    own, room = failures(), room or Workspace(docs.sparkSession)
    parts = docs.select("doc_id", "text", F.col("lang").alias("part"))
    sets = room.hold(failed_sets(parts, labels, room, own), "sets")
    return audit(sets, "".join(own) + COPIED)
