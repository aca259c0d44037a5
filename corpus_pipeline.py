"""From raw documents to packed sequences: each stage reads what the one before it wrote.

Every stage takes (spark, docs, sf_dir). All but the last keep the columns of
documents. Nulls: a text that is null is dropped by the first stage, a null id stays with its
row. Equal rows and ids are left to the third stage, which keeps one; rows without an id all stay
there. Further columns pass through, whatever their names. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.llm import language, leaks, near, packing, toxicity
from tidings.llm.queries import WORD_TOKENIZER, tokenizer
from tidings.llm.words import fresh, give_back
from tidings.plans import Workspace
from tidings.session import importable

#: A text that costs more bits a byte in every learnt language is in none of them.
MOST_BITS = 6.0
TOXIC = 0.7
#: Columns that the models add.
LANGUAGE = ["lang_pred", "score", "bits_per_byte"]
TOXICITY = ["toxicity"]


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters, and those that fit no learnt language."""
    found = language.predict(_aside(docs, LANGUAGE), language.fit(docs))
    give_back()  # of the sample; the driver has later stages to plan
    fits = (F.col("lang_pred") != language.UNKNOWN) & (F.col("bits_per_byte") <= MOST_BITS)
    return _back(found.where(fits), docs, LANGUAGE)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the labels' model finds toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(toxicity.labelled(docs, labels))
    found = toxicity.scored(_aside(docs, TOXICITY), model)
    give_back()
    return _back(found.where(F.col("toxicity") < TOXIC), docs, TOXICITY)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each group of near-duplicates."""
    return near.firsts(docs, 80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return leaks.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 0.8)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut what is left into sequences of a power of two of tokens."""
    return packing.digests(packing.pack(docs, tokenizer(WORD_TOKENIZER), end_id=1, most=2048))


def _renamed(docs: DataFrame, added: list[str]) -> dict[str, str]:
    """Other names for the columns that have those which a model adds."""
    taken = [*docs.columns, *added]
    return {name: fresh(f"_{name}", taken) for name in docs.columns if name.lower() in added}


def _aside(docs: DataFrame, added: list[str]) -> DataFrame:
    return docs.withColumnsRenamed(_renamed(docs, added))


def _back(found: DataFrame, docs: DataFrame, added: list[str]) -> DataFrame:
    """The columns of ``docs`` again, in their order."""
    renamed = _renamed(docs, added)
    return found.select(*(F.col(f"`{renamed.get(name, name)}`").alias(name) for name in docs.columns))


STAGES = [
    ("language", languages),
    ("toxicity", without_toxic),
    ("near_dedup", without_copies),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: Two stages' models can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the cluster's shared folder and reread."""
    room = Workspace(spark)
    docs = importable(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = room.hold(stage(spark, docs, sf_dir), name)
    return docs
