"""Registered queries against SQL, and the pipeline against brute force."""

import os

import corpus_pipeline
import duckdb
import pytest
from brute import brute_components, shingles

from tidings.llm import packing, queries

TABLES = ["documents", "pages", "benchmark", "labels"]


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query_equals_sql(spark, sf_dir, name):
    with duckdb.connect() as database:
        for table in TABLES:
            database.sql(f"CREATE VIEW {table} AS FROM '{sf_dir}/{table}.parquet'")
        relation = database.sql(queries.oracle_sql()[name])
        columns = sorted(relation.columns)
        expected = relation.select(*(f'"{column}"' for column in columns)).fetchall()
    found = queries.queries()[name](spark, sf_dir)
    assert sorted(found.columns) == columns
    assert sorted(repr(tuple(row[column] for column in columns)) for row in found.collect()) == sorted(map(repr, expected))


def test_pipeline_equals_brute_force(spark, sf_dir):
    """The stages of models by their own scores, the others by plain sets."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fits = corpus_pipeline.languages(spark, docs, sf_dir)
    assert fits.columns == docs.columns
    clean = corpus_pipeline.without_toxic(spark, fits, sf_dir)
    rows = [(row.doc_id, row.text) for row in clean.collect()]
    assert 0.7 * docs.count() < len(rows) < docs.count()
    roots = brute_components(rows, 80)
    items = [shingles(row.text) for row in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    left = set()
    for one, text in rows:
        held = shingles(text)
        if roots[one][1] == one and not any(item and len(item & held) >= 0.8 * len(item) for item in items):
            left.add(one)
    packed = corpus_pipeline.run(spark, sf_dir)
    expected = packing.digests(packing.pack(docs.where(docs.doc_id.isin(list(left))), queries.tokenizer(queries.WORD_TOKENIZER), 1))
    columns = ["doc_id", "start", "length", "doc_tokens", "ids_crc32"]
    assert sorted(packed.select(columns).collect()) == sorted(expected.select(columns).collect())


def test_stages_take_no_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).collect() == []


def test_every_operator_is_registered():
    assert [int(name[2:].split("_")[0]) for name in queries.queries()] == list(range(1, 14))
    assert os.path.exists(queries.tokenizer(queries.BYTE_TOKENIZER))


def test_redirect_sql_knows_links(spark, tmp_path):
    """Blocks carried over canonical links and redirects of every form, chains, hubs and stars of them."""
    forms = [
        "http://x.net/es/1", "//x.net/es/1", "HTTPS://X.net/es/1", "/es/b", "b", "./b", "../b", "../../../b", "a/../b", "a/./b", "..", ".", "../", "?q=1", "#part", "c/d/..", "c/d/.", "?", "b?x=../y", "b#c", "mailto:me@x.net", "/", "//", "b/", "é",
    ]
    urls = ["http://h.org/dir/sub/page.html", "http://h.org", "http://h.org/dir/", "http://H.org/a?q=/x/y", "http://h.org/dir/../e", "no scheme", None, "http://"]
    pages, targets = [], ["http://h.org/b", "http://h.org/dir/b", "http://h.org/dir/sub/b", "http://h.org/es/b", "http://x.net/es/1", "http://h.org/dir/sub/", "http://h.org/dir/sub/c/"]
    for at, form in enumerate(forms):
        for url in urls:
            tag = f"<link rel=canonical href='{form}'>" if at % 2 else f'<META http-equiv="Refresh" content="0; url={form}">'
            # A host for each, so that one page's link doesn't join another's.
            pages.append((url and url.replace("org", f"o{at}.org"), f"<head>{tag}</head>"))
    pages += [(url.replace("org", f"o{at}.org"), "<link rel=canonical href=http://x.net/es/1>" if at % 3 else None) for at in range(len(forms)) for url in targets]
    pages += [(f"http://spoke.org/{at}", "<link rel='canonical' href='/hub'>") for at in range(300)]
    pages += [("http://spoke.org/hub", "<link href='http://example.com/en/1' rel='canonical'>"), ("http://www.example.com/en/2", "<link rel=canonical href='http://spoke.org/hub'>"), ("http://example.com/en/1", None)]
    table = spark.createDataFrame([(at, *page) for at, page in enumerate(pages)], "page_id long, url string, html string")
    table.coalesce(2).write.parquet(f"{tmp_path}/pages.parquet")
    with duckdb.connect() as database:
        database.sql(f"CREATE VIEW pages AS FROM '{tmp_path}/pages.parquet/*.parquet'")
        relation = database.sql(queries.oracle_sql()["op8_redirects"])
        columns = relation.columns
        expected = sorted(map(repr, relation.fetchall()))
    found = queries.op8_redirects(spark, str(tmp_path)).select(*columns).collect()
    assert sorted(repr(tuple(row)) for row in found) == expected
    by = [row.by for row in found]
    assert by.count("alias") > 330 and by.count("default") > 50
