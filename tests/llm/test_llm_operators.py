"""The operators against brute force on a small table, and on no rows at all."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from brute import brute_components, crc, encoded, ordered, shingles, split
from pyspark.sql import functions as F

from tidings.llm import (
    fingerprints,
    language,
    leaks,
    licences,
    near,
    packing,
    token_files,
    toxicity,
    urls,
)
from tidings.llm.components import components
from tidings.llm.queries import BYTE_TOKENIZER, RULES, WORD_TOKENIZER, tokenizer
from tidings.plans import Workspace


def test_token_files_round_trip(spark, docs, rows, tmp_path):
    token_files.write_tokens(docs, str(tmp_path), tokenizer(BYTE_TOKENIZER), end_id=2, vocabulary=50_257, parts=4)
    found = token_files.read_tokens(spark, str(tmp_path)).collect()
    expected, start = [], 0
    for (one, _), ids in zip(ordered(rows), encoded(BYTE_TOKENIZER, [text for _, text in ordered(rows)], 2)):
        expected.append((one, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, found), key=lambda row: row[1]) == expected


def test_token_files_of_nothing(spark, no_docs, tmp_path):
    token_files.write_tokens(no_docs, str(tmp_path), tokenizer(BYTE_TOKENIZER), end_id=2)
    assert token_files.read_tokens(spark, str(tmp_path)).collect() == []


def test_packing_holds_every_id_once(docs, rows, no_docs):
    pieces = packing.pack(docs, tokenizer(WORD_TOKENIZER), end_id=1, most=64).collect()
    assert len({row.sequence_id for row in pieces}) == len(pieces)
    assert all(row.offset == 0 and row.length & (row.length - 1) == 0 and row.length <= 64 for row in pieces)
    whole = {}
    for row in sorted(pieces, key=lambda row: row.start):
        ids = np.frombuffer(row.ids, "<u4").tolist()
        assert len(ids) == row.length
        if row.doc_id != 7:
            assert row.start == len(whole.setdefault(row.doc_id, []))
            whole[row.doc_id] += ids
    for (one, _), ids in zip(rows, encoded(WORD_TOKENIZER, [text for _, text in rows], 1)):
        if one != 7:
            assert whole[one] == ids
    assert packing.pack(no_docs, tokenizer(WORD_TOKENIZER), 1).collect() == []
    with pytest.raises(ValueError):
        packing.pack(docs, tokenizer(WORD_TOKENIZER), 1, most=100)


def test_language_prefers_what_it_learnt(spark, no_docs):
    learn = [(at, "the cat and the other thing that " * 3, "en") for at in range(5)]
    learn += [(10 + at, "der Hund und die andere Sache mit ß " * 3, "de") for at in range(5)]
    learn += [(20, None, "fr"), (21, "ignored text", None)]
    model = language.fit(spark.createDataFrame(learn, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en"]
    asked = [(1, "that other cat"), (2, "und der Hund"), (3, None), (4, "12 34"), (5, ""), (6, "é"), (7, "the " * 50_000)]
    asked = spark.createDataFrame(asked, "doc_id long, score string").withColumnsRenamed({"score": "text"})
    found = {row.doc_id: row for row in language.predict(asked, model).collect()}
    assert [found[at].lang_pred for at in (1, 2, 3, 4, 5, 7)] == ["en", "de", "und", "und", "und", "en"]
    assert found[6].lang_pred in ("de", "en") and all(0 <= row.score <= 1 for row in found.values())
    nothing = language.fit(no_docs)
    assert {row.lang_pred for row in language.predict(asked, nothing).collect()} == {"und"}
    assert language.predict(no_docs, model).collect() == []


def test_held_out_accuracy(spark, sf_dir):
    from tidings.llm import queries

    found = queries.op2_language(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id").where("held_out")
    rows = found.select("lang", "lang_pred").collect()
    assert np.mean([row.lang == row.lang_pred for row in rows]) > 0.95


def test_toxicity_finds_the_word(spark, no_docs):
    words = [f"plain{at}" for at in range(50)]
    texts = [" ".join(words[(at * 7 + i) % 50] for i in range(20)) for at in range(300)]
    rows = [(at, text + (" Vile!" if at % 4 == 0 else ""), int(at % 4 == 0)) for at, text in enumerate(texts)]
    docs = spark.createDataFrame([row[:2] for row in rows] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(row[0], row[2]) for row in rows[:200]] + [(5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(toxicity.labelled(docs, labels))
    found = {row.doc_id: row.toxicity for row in toxicity.scored(docs, model).collect()}
    assert all((found[at] >= 0.7) == bool(label) for at, _, label in rows)
    assert found[900] == found[901] < 0.7
    none = toxicity.fit(toxicity.labelled(docs, labels.limit(0)))
    assert {row.toxicity for row in toxicity.scored(docs, none).collect()} == {0.0}
    assert toxicity.scored(no_docs, model).collect() == []


def test_fingerprints_agree_with_brute_force(docs, rows, no_docs):
    found = sorted((row for row in fingerprints.fingerprints(docs).collect()), key=lambda row: (row.doc_id is not None, row.doc_id or 0))
    told = ordered(rows)
    assert [row.doc_id for row in found] == [one for one, _ in told]
    by_text = {}
    for at, (row, (_, text)) in enumerate(zip(found, told)):
        text, after = text or "", told[(at + 1) % len(told)][1] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(text, row.fingerprint) == row.fingerprint
        assert by_text.setdefault(edited, row.edited_fingerprint) == row.edited_fingerprint
    near_copies = [row.near_next for row in found if row.doc_id in range(10, 21)]
    assert np.mean(near_copies) > 0.85
    assert fingerprints.fingerprints(no_docs).collect() == []


def test_fingerprints_estimate_generalised_jaccard(spark):
    text = " ".join(f"a{at % 60}" for at in range(200))
    other = " ".join(f"a{at % 60}" if at < 120 else f"b{at}" for at in range(200))
    bags = [Counter(zip(one.split(), [*one.split()[1:], ""])) for one in (text, other)]
    keys = bags[0].keys() | bags[1].keys()
    exact = sum(min(b[k] for b in bags) for k in keys) / sum(max(b[k] for b in bags) for k in keys)
    pair = spark.createDataFrame([(1, text), (2, other)], "doc_id long, text string")
    found = fingerprints.fingerprints(pair, samples=512).collect()
    assert abs(found[0].near_next - exact) < 0.09


@pytest.mark.parametrize("long, pivots", [(128, 128), (6, 8)])
def test_near_duplicates_agree_with_brute_force(docs, rows, no_docs, monkeypatch, long, pivots):
    """Also with lists cut so short that the rounds over long lists do the work."""
    monkeypatch.setattr(near, "LONG", long)
    monkeypatch.setattr(near, "PIVOTS", pivots)
    found = {row.doc_id: (row.n_shingles, row.component_id) for row in near.classes(docs, 85).collect() if row.doc_id is not None}
    assert found == brute_components(rows, 85)
    if long == 128:
        assert near.classes(no_docs, 85).collect() == []


def test_firsts_keep_one_of_each_group(docs, rows, no_docs):
    kept = near.firsts(docs, 80).collect()
    roots = brute_components(rows, 80)
    assert Counter(row.doc_id for row in kept) == Counter([None, *(one for one, (_, root) in roots.items() if one == root)])
    assert near.firsts(docs, 80).columns == docs.columns
    assert near.firsts(no_docs, 80).collect() == []


def test_components_of_a_path_and_a_star(spark):
    links = [(at, at + 1) for at in range(40)] + [(100, at) for at in range(101, 160)] + [(5, 5), (None, 3), (0, 1)]
    found = components(spark.createDataFrame(links, "u long, v long"), Workspace(spark))
    expected = {at: 0 for at in range(1, 41)} | {at: 100 for at in range(101, 160)}
    assert {row.u: row.root for row in found.collect()} == expected


def test_leaks_agree_with_brute_force(spark, docs, rows, no_docs):
    texts = dict(rows)
    long = texts[0].split()
    items = [(1, " ".join(long[3000:3040])), (2, " ".join(long[100:300])), (3, "one two"), (4, None), (5, ""), (6, "never seen words anywhere in this")]
    items += [(7, " ".join([*long[500:530], "x", *long[531:560]])), (8, texts[50]), (9, " ".join(long[40:46]))]
    table = spark.createDataFrame(items, "item_id long, text string")
    expected = set()
    for one, text in rows:
        for item, asked in items:
            wanted = shingles(asked)
            if wanted and len(wanted & shingles(text)) / len(wanted) >= 0.8:
                expected.add((one, item, round(len(wanted & shingles(text)) / len(wanted), 6)))
    for block in (2, 5000):
        found = leaks.find(docs, table, 0.8, block).collect()
        assert {(row.doc_id, row.item_id, round(row.containment, 6)) for row in found} == expected
    left = leaks.clean(docs, table).select("doc_id").collect()
    assert {row.doc_id for row in left} == {one for one, _ in rows} - {one for one, *_ in expected}
    assert leaks.find(no_docs, table).collect() == leaks.find(docs, table.limit(0)).collect() == []


def test_urls_rules_aliases_and_precedence(spark):
    canonical = '<head><LINK href="{}" rel="canonical"></head>'
    refresh = "<meta http-equiv='refresh' content='0; url={}'>"
    pages = [
        (1, "http://a.example.com/en/x", None),
        (2, "https://www.EXAMPLE.com/en/x?y#z", ""),
        (3, "http://b.org/1", canonical.format("http://c.org/2")),
        (4, "http://c.org/2#top", refresh.format("/3")),
        (5, "http://c.org/3", canonical.format("https://x.net/es/a&amp;b")),
        (6, "https://x.net/es/a&b", None),
        (7, "http://d.com/", canonical.format("http://x.net/es/a&amp;b")),
        (8, "http://e.org", None),
        (9, None, "<link rel=canonical href=http://x.net/es/a>"),
        (10, "no url", None),
        (11, "http://notexample.com/en/", None),
        (11, "http://notexample.com/en/", None),
    ]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS rule", "2 AS node")
    found = {row.page_id: (row.host, row.path, row.rule, row.verdict, row.by) for row in urls.judge(table, RULES).collect()}
    assert found[1] == ("a.example.com", "/en/x", "example.com/en/", "block", "rule")
    assert found[2] == ("www.example.com", "/en/x", "www.example.com/en/", "allow", "rule")
    assert [found[at][3:] for at in (3, 4, 5)] == [("block", "alias")] * 3
    assert found[6][2:] == ("net/es/", "block", "rule")
    assert found[7][2:] == ("com/", "allow", "rule")
    assert found[8] == ("e.org", "", None, "allow", "default")
    assert found[9][:4] == found[10][:4] == ("", "", None, "allow")
    assert found[11][2] == "com/"
    assert urls.judge(table.limit(0), RULES).collect() == []


@pytest.mark.parametrize(
    "url, target, alias",
    [
        ("h.org/dir/a.html", "b.html", "h.org/dir/b.html"),
        ("h.org/dir/a.html", "./b?q#f", "h.org/dir/b?q"),
        ("h.org/dir/sub/a", "../b", "h.org/dir/b"),
        ("h.org/dir/a", "../../../b", "h.org/b"),
        ("h.org/dir/sub/a", "..", "h.org/dir/"),
        ("h.org/dir/sub/", ".", "h.org/dir/sub/"),
        ("h.org/dir/a?p=1", "?p=2", "h.org/dir/a?p=2"),
        ("h.org", "?p=2", "h.org/?p=2"),
        ("h.org", "b", "h.org/b"),
        ("h.org/dir/a?x=/y/z", "b?u=http://x.org/../c", "h.org/dir/b?u=http://x.org/../c"),
        ("h.org/dir/a", "/x/./y/../b", "h.org/x/b"),
        ("h.org/dir/a", "c/d:e/", "h.org/dir/c/d:e/"),
        ("h.org/dir/a", "//i.org/b", "i.org/b"),
        ("h.org/dir/a", "https://i.org/b", "i.org/b"),
        ("h.org/dir/a", "#top", "h.org/dir/a"),
        ("h.org/dir/a", "mailto:b", "h.org/dir/a"),
    ],
)
def test_relative_targets(spark, url, target, alias):
    """As RFC 3986 resolves them; a target that is no other page joins nothing."""
    page = [(1, f"http://{url}", f"<meta http-equiv=refresh content='0; url={target}'>")]
    found = urls.edges(urls.with_parts(spark.createDataFrame(page, "page_id long, url string, html string"))).collect()
    own, other = url if "/" in url else f"{url}/", alias
    assert list(map(tuple, found)) == ([] if own == other else [(own, other)])


def test_relative_links_carry_a_block(spark):
    pages = [
        (1, "http://h.org/dir/a.html", "<link rel=canonical href='../es/b.html'>"),
        (2, "http://h.org/es/b.html", "<link rel=canonical href='http://x.net/es/1'>"),
        (3, "http://x.net/es/1", None),
        (4, "http://h.org/dir/c", "<link rel=canonical href='b.html'>"),
        (5, "http://h.org/b.html", "<link rel=canonical href='http://x.net/es/1'>"),
    ]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = {row.page_id: (row.verdict, row.by) for row in urls.judge(table, RULES).collect()}
    assert found == {1: ("block", "alias"), 2: ("block", "alias"), 3: ("block", "rule"), 4: ("allow", "default"), 5: ("block", "alias")}


def test_licences_by_line_paragraph_and_text(spark, no_docs):
    long = licences.TEMPLATES["MIT-long"]
    halves = long.replace("of charge, ", "of charge,\n")
    texts = [(1, "x\nreleased UNDER the mit licence.\ny"), (2, "Released under the MIT License."), (3, f"a b\n\n{halves}\n\nc d"), (4, None), (5, ""), (6, "word"), (7, "free words only here")]
    texts += [(8, "Released under the MIT License.\r\n" * 2)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS dice", "2 AS n")
    found = licences.scan(docs).collect()
    assert {(row.doc_id, row.kind, row.licence) for row in found} >= {(2, "line", "MIT"), (3, "paragraph", "MIT-long"), (8, "line", "MIT")}
    assert {row.doc_id for row in found} <= {1, 2, 3, 8}
    assert sum(row.doc_id == 8 and row.kind == "line" for row in found) == 2
    assert licences.scan(no_docs).collect() == []


MIT = """Copyright (c) 2020 A. Writer

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:
1. Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright
   notice, this list of conditions and the following disclaimer in the
   documentation and/or other materials provided with the distribution.
3. Neither the name of the University nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.
"""
GPL = """/* x.c
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details. */
"""
APACHE = """   2. Grant of Copyright License. Subject to the terms and conditions of
      this License, each Contributor hereby grants to You a perpetual,
      worldwide, non-exclusive, no-charge, royalty-free, irrevocable
      copyright license to reproduce, prepare Derivative Works of,
      publicly display, publicly perform, sublicense, and distribute the
      Work and such Derivative Works in Source or Object form.
"""


def test_licences_real_texts_and_notices(spark):
    texts = {
        1: (MIT, "MIT-grant"),
        2: (BSD, "BSD-3-Clause-conditions"),
        3: (GPL, "GPL-as-is"),
        4: (f"Some words.\n\n{APACHE}\nmore", "Apache-2.0-copyright"),
        5: ("Licensed under the MIT License.", "MIT-licensed"),
        6: ("This software is released under the MIT License.", "MIT-software"),
        7: ("We wrote it all last year. It is old. Released under the MIT License. Have fun with what we made!", "MIT"),
        8: ("A first line here. Licensed under the\nApache License, Version 2.0. And some more words follow it.", "Apache-2.0"),
        9: ("See above. This work is licensed under a Creative Commons Attribution 4.0 International License.", "CC-BY-4.0-work"),
    }
    docs = spark.createDataFrame([(at, text) for at, (text, _) in texts.items()], "doc_id long, text string")
    found = {(row.doc_id, row.licence) for row in licences.scan(docs).collect()}
    assert found >= {(at, name) for at, (_, name) in texts.items()}
    rows = [tuple(row)[1:4] for row in licences.scan(docs.where("doc_id IN (7, 8)")).collect() if row.licence in ("MIT", "Apache-2.0")]
    assert sorted(rows) == [("sentence", 1, "Apache-2.0"), ("sentence", 2, "MIT")]


def test_licences_sentences_that_are_lines_come_once(spark):
    texts = [(1, "One line.\nReleased under the MIT License.\nThe end."), (2, "Released under\nthe MIT License.\n\nA longer end of many words that match nothing at all.")]
    found = licences.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sorted((row.doc_id, row.kind) for row in found if row.licence == "MIT") == [(1, "line"), (2, "paragraph")]


def test_licences_best_and_identifier(spark):
    """One notice resembles several wordings; one row says which licence it is."""
    texts = {
        1: (licences.TEMPLATES["GPL-3.0-long"], "GPL-3.0"),
        2: (licences.TEMPLATES["AGPL-3.0-grant"], "AGPL-3.0"),
        3: ("Released under the MIT License.", "MIT"),
        4: ("This work is licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0"),
    }
    found = licences.scan(spark.createDataFrame([(at, text) for at, (text, _) in texts.items()], "doc_id long, text string")).collect()
    best = {row.doc_id: row for row in found if row.best}
    assert {at: row.identifier for at, row in best.items()} == {at: name for at, (_, name) in texts.items()}
    assert sum(row.best for row in found) == len({(row.doc_id, row.kind, row.place) for row in found})
    assert len(found) > len(best)
    for row in found:
        assert row.dice <= best[row.doc_id].dice
    same = {"B-one": "alpha beta gamma", "A-two": "alpha beta gamma", "C-three": "alpha beta gamma delta"}
    tied = licences.scan(spark.createDataFrame([(1, "alpha beta gamma")], "doc_id long, text string"), same, 0.5).collect()
    assert {(row.licence, row.identifier, row.best) for row in tied} == {("A-two", "A-two", True), ("B-one", "B-one", False), ("C-three", "C-three", False)}
    assert licences.identifier("BSD-3-Clause-names") == "BSD-3-Clause" and licences.identifier("BSD-source") == "BSD"
    assert {licences.identifier(name) for name in licences.TEMPLATES} <= set(licences.IDENTIFIERS)


def test_licences_sql_knows_every_kind_of_unit(spark, tmp_path):
    """Lines, paragraphs, sentences and texts, at the ends of lines, paragraphs and texts."""
    import duckdb

    from tidings.llm import queries

    notice, split = "Released under the MIT License.", "Released under\nthe MIT License."
    shapes = [
        notice, f"{notice}\n", f"\n\n\n{notice}", f"One. {notice} Two.", f"One. {notice}\nTwo.", f"One.\n{notice}\nTwo.", f"One. {split} Two.", f"{split}\n", f"{split}\nMore words here.", f"So!  {notice}  \n  And?",
        f"({notice}) And. \"{notice}\" So.", f"a\n\n{split}\n\nb. {split}", f"a \n \t\n\n{notice} b", f"x. {notice}\r\ny. {split}\r\rz", "", " \n ", "Licensed under\n CC BY 4.0. Or not. Licensed\nunder CC BY 4.0.\n", MIT, BSD, GPL, APACHE, f"{MIT}\n\n{notice} {notice}",
    ]
    docs = spark.createDataFrame([*enumerate(shapes), (100, None)], "doc_id long, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents")
    with duckdb.connect() as database:
        database.sql(f"CREATE VIEW documents AS FROM '{tmp_path}/documents/*.parquet'")
        relation = database.sql(queries.oracle_sql()["op10_licences"])
        columns = relation.columns
        expected = sorted(relation.fetchall())
    found = licences.scan(docs).select(*columns).collect()
    assert sorted(map(tuple, found)) == expected
    assert {row.kind for row in found} == {"line", "paragraph", "sentence", "text"}


def test_special_tokens_that_a_text_spells_out(spark, tmp_path):
    """They are encoded as the library does it, in the middle of texts and at their ends."""
    texts = ["<|endoftext|>", "a <|endoftext|> b", "a<|startoftext|>  \n<|endoftext|>", "<| not one |>", "plain words here", None, "", "x <|", "|> <|endoftext|", "é <|endoftext|>é"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    for name in (BYTE_TOKENIZER, WORD_TOKENIZER):
        expected = {one: ids for one, ids in enumerate(encoded(name, texts, 1))}
        found = {}
        for row in sorted(packing.pack(docs, tokenizer(name), 1).collect(), key=lambda row: row.start):
            found.setdefault(row.doc_id, []).extend(np.frombuffer(row.ids, "<u4").tolist())
        assert found == expected
    token_files.write_tokens(docs, str(tmp_path), tokenizer(BYTE_TOKENIZER), end_id=2, parts=2)
    assert {row.doc_id: row.ids_crc32 for row in token_files.read_tokens(spark, str(tmp_path)).collect()} == {
        one: crc(ids) for one, ids in enumerate(encoded(BYTE_TOKENIZER, texts, 2))
    }


def test_stages_keep_columns_that_have_their_names(spark, docs):
    """Names that the operators use for themselves, in any case."""
    few = docs.where("doc_id IS NULL OR doc_id < 60")
    more = few.selectExpr("*", "7 AS _id", "8 AS __id", "9 AS _HELD", "1 AS rep", "2 AS own", "3 AS root")
    kept = near.firsts(more, 80)
    assert kept.columns == more.columns
    rows = kept.collect()
    roots = brute_components([(row.doc_id, row.text) for row in few.collect()], 80)
    assert Counter(row.doc_id for row in rows) == Counter([None, *(one for one, (_, root) in roots.items() if one == root)])
    assert {(row._id, row["__id"], row._HELD, row.rep, row.own, row.root) for row in rows} == {(7, 8, 9, 1, 2, 3)}
    items = spark.createDataFrame([(1, "w1 w2")], "item_id long, text string").unionByName(docs.where("doc_id = 30").selectExpr("2L AS item_id", "text"))
    clean = leaks.clean(more, items)
    assert clean.columns == more.columns
    assert {30, 31, 32}.isdisjoint(row.doc_id for row in clean.collect())
    assert {row._HELD for row in clean.collect()} == {9}


def test_buckets_hold_every_sequence_and_are_read_apart(spark, docs, tmp_path):
    pieces = packing.pack(docs, tokenizer(WORD_TOKENIZER), end_id=1, most=64)
    packing.write_buckets(pieces, str(tmp_path))
    back = packing.read_buckets(spark, str(tmp_path))
    columns = sorted(pieces.columns)
    assert sorted(back.columns) == columns
    assert sorted(map(repr, back.select(*columns).collect())) == sorted(map(repr, pieces.select(*columns).collect()))
    some = packing.read_buckets(spark, str(tmp_path), [8, 64])
    assert {row["length"] for row in some.collect()} <= {8, 64}
    assert {len(row.ids) for row in some.collect()} == {4 * row["length"] for row in some.select("length").distinct().collect()}
    assert all("length=" in file for file in some.inputFiles())


def test_token_files_of_rows_without_ids_are_spread(spark, tmp_path):
    """Many rows without an id, and many of one id, in the order of their texts."""
    texts = [f"{at:04d} words of it" for at in range(300)]
    rows = [(None, text) for text in texts] + [(5, text) for text in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    told = token_files.write_tokens(docs, str(tmp_path), tokenizer(BYTE_TOKENIZER), end_id=2, parts=6).collect()
    assert len(told) == 6 and max(row.n_docs for row in told) < 300
    found = sorted(map(tuple, token_files.read_tokens(spark, str(tmp_path)).collect()), key=lambda row: row[1])
    assert [(row[0], row[3]) for row in found] == [(one, crc(ids)) for (one, _), ids in zip(rows, encoded(BYTE_TOKENIZER, [text for _, text in rows], 2))]


def test_token_files_are_as_many_as_a_shuffle_sends_unsorted(spark, tmp_path, monkeypatch):
    """With more partitions a task gathers texts in memory beside the row group that it reads."""
    texts = [f"text {at} of them" for at in range(400)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "300")
    try:
        told = token_files.write_tokens(docs, f"{tmp_path}/out", tokenizer(BYTE_TOKENIZER), end_id=2, vocabulary=50_257).collect()
        assert 150 < len(told) <= 200
        monkeypatch.setattr(token_files, "PART_BYTES", 1)
        assert token_files._part_count(docs) == 300
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert token_files._part_count(docs) == int(before)
    found = sorted(map(tuple, token_files.read_tokens(spark, f"{tmp_path}/out").collect()))
    assert [row[3] for row in found] == [crc(ids) for ids in encoded(BYTE_TOKENIZER, texts, 2)]


def test_token_files_of_bytes_that_are_not_utf8(spark, tmp_path):
    """A table's strings may hold any bytes; Spark doesn't look at them as it reads."""
    texts = [b"plain words", b"ab \xff\xfe\xc3xyz def", b"cut \xe4\xb8", b"\xc3  two  spaces \xa0 x", b"<| \xf0\x9f\x98 |>", "é 漢字".encode()]
    ends = pa.array(np.cumsum([0, *map(len, texts)]), pa.int32())
    column = pa.Array.from_buffers(pa.string(), len(texts), [None, ends.buffers()[1], pa.py_buffer(b"".join(texts))])
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts))), "text": column}), f"{tmp_path}/docs.parquet")
    docs = spark.read.parquet(f"{tmp_path}/docs.parquet")
    token_files.write_tokens(docs, f"{tmp_path}/out", tokenizer(BYTE_TOKENIZER), end_id=2, parts=2)
    found = sorted(map(tuple, token_files.read_tokens(spark, f"{tmp_path}/out").collect()))
    assert [row[3] for row in found] == [crc(ids) for ids in encoded(BYTE_TOKENIZER, [text.decode(errors="replace") for text in texts], 2)]


def test_token_files_need_a_file_system_on_a_cluster():
    for folder in ("file:/shared/tokens", "file:///shared/tokens", "hdfs://name/tokens"):
        token_files._shared(folder, "spark://host:7077")
    token_files._shared("/shared/tokens", "local[4]")
    with pytest.raises(ValueError, match="file system"):
        token_files._shared("/shared/tokens", "spark://host:7077")


def test_short_items_are_never_missed(spark):
    """Five to nine words at any place of texts of any length, also half of them apart from the others."""
    import random

    draw = random.Random(8)
    words = [f"v{at}" for at in range(3000)]
    items = [(at, " ".join(draw.sample(words, 5 + at % 8))) for at in range(120)]
    rows = []
    for at, item in items:
        for size in (0, 3, 40, 900):
            left, right = (" ".join(draw.choice(words) for _ in range(draw.randrange(size + 1))) for _ in range(2))
            rows.append((len(rows), f"{left} {item} {right}", at))
    docs = spark.createDataFrame(rows, "doc_id long, text string, item long").repartition(8)
    found = {(row.doc_id, row.item_id) for row in leaks.find(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found >= {(one, at) for one, _, at in rows}


@pytest.mark.parametrize(("percent", "estimate"), [(85, True), (60, False)])
def test_family_around_the_threshold(spark, percent, estimate):
    """Variants of a text with similarities from 0.4 to 1, linked one by one: sizes, bitmaps and rounds lose no link."""
    import random

    draw = random.Random(5)
    base = [f"b{draw.randrange(500)}" for _ in range(150)]
    rows = []
    for at in range(160):
        words = list(base)
        for _ in range(draw.randrange(12)):
            words[draw.randrange(len(words))] = f"c{draw.randrange(9)}"
        rows.append((at, " ".join(words[draw.randrange(4) : len(words) - draw.randrange(4)])))
    rows += [(200 + at, " ".join(f"{at}x{draw.randrange(300)}" for _ in range(60)) + " " + " ".join(base[:40])) for at in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {row.doc_id: (row.n_shingles, row.component_id) for row in near.classes(docs, percent, estimate=estimate).collect()}
    assert found == brute_components(rows, percent)


def test_bitmaps_bound_the_difference():
    draw = np.random.default_rng(2)
    sets = [np.unique(draw.integers(0, 400, size).astype(np.uint64)) for size in (0, 1, 30, 31, 200, 300)]
    found = near.Words(np.concatenate(sets), np.concatenate(([0], np.cumsum([len(one) for one in sets]))))
    words = near.bitmaps(found)
    assert all(word[0] == 0 for word in words)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            differ = sum(int(word[i] ^ word[j]).bit_count() for word in words)
            assert differ <= len(np.setxor1d(a, b)) and differ % 2 == len(np.setxor1d(a, b)) % 2


@pytest.mark.parametrize("percent", [70, 80, 85, 95])
def test_sets_at_the_threshold_share_a_group(percent):
    draw = np.random.default_rng(percent)
    by = near.parts(percent)
    for at in range(600):
        n = int(draw.integers(1, (20, 100, 1500)[at % 3]))
        m = int(draw.integers(-(-percent * n // 100), n + 1))
        both = -(-percent * (n + m) // (100 + percent))
        if both <= m:
            values = draw.permutation(np.unique(draw.integers(0, 1 << 64, n + m - both, dtype=np.uint64)))
            one, other = np.sort(values[:n]), np.sort(np.concatenate((values[:both], values[n:])))
            pair = near.Words(np.concatenate((one, other)), np.array([0, n, n + m]))
            owner, found = near.grouped(pair, percent, by)
            assert len(np.intersect1d(found[owner == 0], found[owner == 1]))


def test_long_texts_that_share_a_passage_are_seldom_paired(spark, monkeypatch):
    texts, paired, with_sets = 40, [], near._with_sets

    def counted(pairs, sets, column):
        paired.append(pairs.count())
        return with_sets(pairs, sets, column)

    monkeypatch.setattr(near, "_with_sets", counted)
    passage = " ".join(f"p{at}" for at in range(60))
    rows = [(one, " ".join(f"w{one}x{at}" for at in range(1000)) + f" {passage}") for one in range(texts)]
    found = near.classes(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()
    assert all(row.kept for row in found) and len(found) == texts
    assert sum(paired) < texts * (texts - 1) / 2 / 4


def test_of_lists_of_the_same_classes_one_is_left(spark):
    lists = {1: [7, 8], 2: [7, 8], 3: [7, 9], 4: [7, 8, 9], 5: [9], 6: [8, 7]}
    members = spark.createDataFrame([(value, key) for value, keys in lists.items() for key in keys], "value long, key long")
    left = {}
    for row in near._different(members).collect():
        left.setdefault(row.value, set()).add(row.key)
    assert left == {1: {7, 8}, 3: {7, 9}, 4: {7, 8, 9}}


def test_a_family_is_paired_with_its_middle(spark, monkeypatch):
    """Variants by one to five words, most of them less like each other than like the text that they come from."""
    import random

    draw, paired, with_sets = random.Random(8), [], near._with_sets

    def counted(pairs, sets, column):
        paired.append(pairs.count())
        return with_sets(pairs, sets, column)

    monkeypatch.setattr(near, "_with_sets", counted)
    base = [f"b{at}" for at in range(400)]
    rows = [(0, " ".join(base))]
    for at in range(1, 101):
        words = list(base)
        for place in draw.sample(range(400), 1 + at % 5):
            words[place] = f"c{at}x{place}"
        rows.append((at, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {row.doc_id: (row.n_shingles, row.component_id) for row in near.classes(docs, 90).collect()}
    assert found == brute_components(rows, 90)
    assert max(paired) < 3 * len(rows)


def test_a_family_below_the_threshold_is_dropped_where_it_meets(spark, monkeypatch):
    """Texts of 400 words with a few changed ones each: likenesses of about 0.75, few of 0.8 but that of two changed less."""
    import random

    draw, paired, with_sets = random.Random(9), [], near._with_sets

    def counted(pairs, sets, column):
        paired.append(pairs.count())
        return with_sets(pairs, sets, column)

    monkeypatch.setattr(near, "_with_sets", counted)
    base = [f"b{at}" for at in range(400)]
    rows = []
    for at in range(60):
        words = list(base)
        for place in draw.sample(range(80), 6 if at > 1 else 4):
            words[5 * place] = f"c{at}x{place}"
        rows.append((at, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {row.doc_id: (row.n_shingles, row.component_id) for row in near.classes(docs, 80).collect()}
    assert found == brute_components(rows, 80)
    assert found[1] == (396, 0) and len({root for _, root in found.values()}) > 40
    assert max(paired) < 3 * len(rows)
