"""The stages one by one: nulls, repeated rows, ties, long texts, empty tables and clashing names."""

import corpus_pipeline
import pytest
from brute import brute_components, encoded
from pyspark.sql import functions as F

from tidings.llm import queries

MORE = {"score": "2.5D", "bits_per_byte": "'b'", "lang_pred": "array(1)", "Toxicity": "-1", "_id": "3", "_held": "4", "_score": "5", "key": "6", "value": "7", "a b": "8"}


@pytest.fixture(scope="module")
def folder(spark, sf_dir, tmp_path_factory):
    """The given documents with copies, nulls and a very long text, and columns of the stages' own names."""
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = docs.where("doc_id = 3")
    extra = first.select(
        F.explode(F.expr("array(null, 900001, 900002)")).cast("long").alias("doc_id"), "text", "lang", "source", "n_chars"
    )
    odd = spark.createDataFrame(
        [(900010, None, "en", "s", 0), (900011, "", "en", "s", 0), (900012, " \n ", None, None, None), (900013, "12 34 !!", "en", "s", 8), (None, None, None, None, None)],
        docs.schema,
    )
    long = first.select(F.lit(900020).cast("long").alias("doc_id"), F.repeat(F.concat("text", F.lit("\n")), 400).alias("text"), "lang", "source", "n_chars")
    docs = docs.unionByName(extra).unionByName(first).unionByName(odd).unionByName(long)
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return folder


def wide(docs):
    return docs.selectExpr("*", *(f"{value} AS `{name}`" for name, value in MORE.items()))


def plain(docs):
    return sorted(map(repr, docs.select("doc_id", "text", "lang", "source", "n_chars").collect()))


@pytest.mark.parametrize("at", range(4))
def test_columns_pass_through_whatever_their_names(spark, folder, at):
    name, stage = corpus_pipeline.STAGES[at]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = stage(spark, wide(docs), folder)
    assert found.columns == [*docs.columns, *MORE]
    rows = found.cache()
    try:
        assert plain(rows) == plain(stage(spark, docs, folder))
        own = rows.select(*(f"`{name}`" for name in MORE)).distinct().collect()
        assert own == wide(docs).select(*(f"`{name}`" for name in MORE)).distinct().collect()
    finally:
        rows.unpersist()


def ids(docs):
    return {row.doc_id for row in docs.select("doc_id").collect()}


def test_language_drops_what_has_no_letters_and_keeps_the_rest(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = corpus_pipeline.languages(spark, docs, folder)
    assert {900010, 900011, 900012, 900013}.isdisjoint(ids(found))
    assert {None, 900001, 900002, 900020} <= ids(found)
    assert found.where("doc_id = 3").count() == 2


def test_near_dedup_keeps_one_of_each_group(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id IS NULL OR doc_id < 120 OR doc_id > 900000")
    found = corpus_pipeline.without_copies(spark, docs, folder)
    rows = [(row.doc_id, row.text) for row in docs.collect()]
    roots = brute_components(rows, 80)
    assert ids(found) - {None} == {one for one, (_, root) in roots.items() if root == one}
    assert found.where("doc_id = 3").count() == 1
    assert found.where("doc_id IS NULL").count() == 2


def test_decontamination_by_ids(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = corpus_pipeline.without_benchmark(spark, docs, folder)
    gone = ids(docs) - ids(found)
    assert gone and len(gone) < 0.2 * docs.count()
    nothing = spark.read.parquet(f"{folder}/benchmark.parquet").limit(0)
    from tidings.llm import leaks

    assert leaks.clean(docs, nothing).count() == docs.count()


def test_packing_holds_every_token_of_every_row(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id IS NULL OR doc_id < 30 OR doc_id > 900000")
    found = corpus_pipeline.packed(spark, docs, folder)
    texts = [row.text for row in docs.collect()]
    wanted = sorted(len(one) for one in encoded(queries.WORD_TOKENIZER, texts, 1))
    assert sorted(row.doc_tokens for row in found.where("start = 0").collect()) == wanted
    assert found.agg(F.sum("length")).first()[0] == sum(wanted)
    assert found.groupBy("sequence_id").count().where("count > 1").isEmpty()
