"""The operators over the given tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.llm import (
    audit,
    fingerprints,
    language,
    leaks,
    licences,
    lines,
    near,
    packing,
    scoring,
    search,
    token_files,
    toxicity,
    urls,
)
from tidings.plans import Workspace
from tidings.session import importable

BYTE_TOKENIZER = "byte_bpe_50k.json"
WORD_TOKENIZER = "word_bpe_49k.json"

RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{folder}/{name}.parquet")


def _held_out(parts: int, part: int) -> Column:
    """Whether a document isn't learnt from; one without an id never is."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == part, F.lit(True))


def op1_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of all documents, read back from the files."""
    out = f"{Workspace(spark).path}/tokens"
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    token_files.write_tokens(docs, out, tokenizer(BYTE_TOKENIZER), end_id=2, vocabulary=50_257)
    return token_files.read_tokens(spark, out)


def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").withColumn("held_out", _held_out(5, 0))
    model = language.fit(docs.where("NOT held_out"))
    return language.predict(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op3_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprints(_table(spark, folder, "documents"))


def op4_bloom_lm(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    found = scoring.score(docs, docs.where(~_held_out(7, 2)))
    return found.withColumn("held_out", _held_out(7, 2))


def op5_bottom_k(spark: SparkSession, folder: str) -> DataFrame:
    return near.classes(_table(spark, folder, "documents"), 85)


def op6_containment(spark: SparkSession, folder: str) -> DataFrame:
    """A row per document and benchmark item of which it holds at least 0.8."""
    return leaks.find(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"), 0.8)


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text").withColumn("held_out", _held_out(3, 1))
    model = toxicity.fit(toxicity.labelled(docs.where("NOT held_out"), _table(spark, folder, "labels")))
    found = toxicity.scored(docs, model).withColumnRenamed("toxicity", "score")
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_redirects(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(_table(spark, folder, "pages"), RULES)


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Sequences of all documents, read back from their buckets."""
    out = f"{Workspace(spark).path}/buckets"
    packing.write_buckets(packing.pack(_table(spark, folder, "documents"), tokenizer(WORD_TOKENIZER), end_id=1, most=2048), out)
    return packing.digests(packing.read_buckets(spark, out))


def op10_licences(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(_table(spark, folder, "documents"))


def op11_ranked(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    return search.ranked(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"), most=10)


def op12_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit.audit_documents(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op13_lines(spark: SparkSession, folder: str) -> DataFrame:
    """All documents are put into an index, and what it keeps of each is digested."""
    docs = _table(spark, folder, "documents")
    index = lines.LineIndex(spark, Workspace(spark), least_docs=10, least_chars=1)
    index.insert(docs)
    return index.clean(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Each takes a session and the folder of the tables."""
    every = (
        op1_token_files,
        op2_language,
        op3_fingerprints,
        op4_bloom_lm,
        op5_bottom_k,
        op6_containment,
        op7_toxicity,
        op8_redirects,
        op9_packing,
        op10_licences,
        op11_ranked,
        op12_audit,
        op13_lines,
    )
    return {query.__name__: query for query in every}


_WORDS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"""


def _shingles(table: str, key: str) -> str:
    """SQL for the different shingles of a table's texts."""
    return f"""
        SELECT DISTINCT {key}, array_to_string(w[i:i + 4], ' ') AS shingle
        FROM (SELECT {key}, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i
              FROM (SELECT {key}, {_WORDS} AS w FROM {table}) WHERE len(w) > 0)"""


_NEAR = f"""
    WITH RECURSIVE shingles AS MATERIALIZED ({_shingles("documents", "doc_id")}),
    sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    links AS MATERIALIZED (
        SELECT a, b FROM (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
            FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
            GROUP BY ALL)
        JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b
        WHERE 100 * common >= 85 * (s.n + t.n - common)),
    reach AS (
        SELECT a, b FROM links
        UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
    least AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles,
           least(d.doc_id, coalesce(low, d.doc_id)) AS component_id,
           d.doc_id = least(d.doc_id, coalesce(low, d.doc_id)) AS kept,
           count(*) OVER (PARTITION BY d.doc_id) AS n_rows
    FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON a = d.doc_id"""

_LEAKS = f"""
    WITH held AS ({_shingles("documents", "doc_id")}), asked AS ({_shingles("benchmark", "item_id")}),
    sizes AS (SELECT item_id, count(*) AS item_shingles FROM asked GROUP BY item_id)
    SELECT doc_id, item_id, count(*) / item_shingles AS containment, item_shingles
    FROM held JOIN asked USING (shingle) JOIN sizes USING (item_id)
    GROUP BY doc_id, item_id, item_shingles HAVING count(*) / item_shingles >= 0.8"""


def _urls_sql() -> str:
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def parted(url: str) -> str:
        after = f"CASE WHEN position('://' IN {url}) > 0 THEN substr({url}, position('://' IN {url}) + 3) END"
        return f"{lower.format(f'''coalesce(regexp_extract({after}, '^[^/?#]*'), '')''')} AS host, coalesce(substr({after}, length(regexp_extract({after}, '^[^/?#]*')) + 1), '') AS rest"

    name = "CASE WHEN host <> '' THEN host || coalesce(nullif(regexp_extract(rest, '^[^#]*'), ''), '/') END"
    fits = "((host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}'))"
    ordered = sorted(RULES, key=lambda one: -len(one[1] + one[2]))
    rule = " ".join(f"WHEN {fits.format(h=h, p=p)} THEN '{h}{p}'" for _, h, p in ordered)
    verdict = " ".join(f"WHEN {fits.format(h=h, p=p)} THEN '{v}'" for v, h, p in ordered)
    href = r"""regexp_extract(tag, '(?is)\b' || kind || '\s*=\s*["'']?\s*([^"''\s>]+)', 1)"""
    return rf"""
    WITH RECURSIVE parts AS (SELECT page_id, html, {parted("url")} FROM pages),
    named AS MATERIALIZED (
        SELECT page_id, html, host, regexp_extract(rest, '^[^?#]*') AS path, {name} AS name FROM parts),
    tags AS (SELECT host, path, name, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag
             FROM named WHERE name IS NOT NULL),
    kinds AS (SELECT *, CASE WHEN regexp_matches(tag, '(?is)^<link\b.*\brel\s*=\s*["'']?canonical\b') THEN 'href'
                             WHEN regexp_matches(tag, '(?is)^<meta\b.*\bhttp-equiv\s*=\s*["'']?refresh\b') THEN 'url' END AS kind
              FROM tags),
    targets AS (SELECT row_number() OVER () AS id, host AS own, path, name, target, regexp_extract(target, '^[^?#]*') AS cut FROM (
        SELECT host, path, name, replace({href}, '&amp;', '&') AS target FROM kinds WHERE kind IS NOT NULL) WHERE target <> ''),
    -- RFC 3986, 5.2: a path is merged with the page's, then its dot segments are removed one after another.
    merged AS (SELECT *, CASE WHEN starts_with(target, '//') OR regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN 'whole'
                              WHEN starts_with(target, '#') THEN 'here' WHEN starts_with(target, '?') THEN 'query' ELSE 'path' END AS form,
                      CASE WHEN starts_with(cut, '/') THEN cut
                           ELSE coalesce(nullif(regexp_extract(path, '^(?s:.*)/'), ''), '/') || cut END AS whole FROM targets),
    dots AS (
        SELECT id, string_split(whole, '/')[2:] AS segments, 1 AS i, CAST([] AS VARCHAR[]) AS kept FROM merged WHERE form = 'path'
        UNION ALL
        SELECT id, segments, i + 1, CASE segments[i] WHEN '.' THEN kept WHEN '..' THEN kept[:len(kept) - 1] ELSE list_append(kept, segments[i]) END
        FROM dots WHERE i <= len(segments)),
    plain AS (SELECT id, '/' || array_to_string(CASE WHEN segments[-1] IN ('.', '..') THEN list_append(kept, '') ELSE kept END, '/') AS whole
              FROM dots WHERE i > len(segments)),
    absolute AS (SELECT name AS u, CASE form WHEN 'whole' THEN CASE WHEN starts_with(target, '//') THEN 'http:' || target ELSE target END
                        WHEN 'here' THEN 'http://' || name
                        WHEN 'query' THEN 'http://' || own || coalesce(nullif(path, ''), '/') || target
                        ELSE 'http://' || own || plain.whole || substr(target, length(cut) + 1) END AS url
                 FROM merged LEFT JOIN plain USING (id)),
    ends AS (SELECT u, {parted("url")} FROM absolute),
    ways AS MATERIALIZED (SELECT u, {name} AS v FROM ends WHERE {name} <> u),
    links AS MATERIALIZED (SELECT u, v FROM ways UNION SELECT v, u FROM ways),
    judged AS MATERIALIZED (
        SELECT page_id, host, path, name, CASE {rule} END AS rule, CASE {verdict} END AS verdict FROM named),
    bad AS (SELECT DISTINCT name FROM judged WHERE verdict = 'block'
            UNION SELECT v AS name FROM bad JOIN links ON bad.name = links.u)
    SELECT page_id, host, path, rule,
           coalesce(verdict, CASE WHEN name IN (FROM bad) THEN 'block' ELSE 'allow' END) AS verdict,
           CASE WHEN rule IS NOT NULL THEN 'rule' WHEN name IN (FROM bad) THEN 'alias' ELSE 'default' END AS "by"
    FROM judged"""


def _licences_sql() -> str:
    known = [
        (name, pairs)
        for name, text in licences.TEMPLATES.items()
        if (pairs := licences._pairs_of(text))
    ]
    rows = ", ".join(f"('{name}', '{licences.identifier(name)}', ['{"', '".join(pairs)}'])" for name, pairs in known)
    unit = "SELECT doc_id, '{}' AS kind, unnest(range(len(u))) AS place, unnest(u) AS unit FROM (SELECT doc_id, string_split_regex(text, '{}') AS u FROM texts)"
    several = r"len(string_split_regex(trim(unit), '\n')) > 1"
    return rf"""
    WITH texts AS (SELECT doc_id, regexp_replace(text, '\r\n?', chr(10), 'g') AS text FROM documents WHERE text IS NOT NULL),
    -- A sentence ends with . ! or ? before white space or with its paragraph: chr(2) where a line ends as well, else chr(1).
    paragraphs AS (
        SELECT doc_id, unnest(range(len(u))) AS paragraph, regexp_replace(unnest(u), '^[ \t\n]+|[ \t\n]+$', '', 'g') AS unit
        FROM (SELECT doc_id, string_split_regex(translate(text, chr(1) || chr(2), '  '), '\n[ \t]*\n') AS u FROM texts)),
    ended AS (
        SELECT doc_id, paragraph,
               string_split(regexp_replace(regexp_replace(unit, '([.!?][)"''\]]*)[ \t]*\n', '\1' || chr(2), 'g'),
                                           '([.!?][)"''\]]*)[ \t]+', '\1' || chr(1), 'g'), chr(2)) AS runs FROM paragraphs),
    runs AS (
        SELECT doc_id, paragraph, unnest(range(len(runs))) AS run, string_split(unnest(runs), chr(1)) AS sentences,
               len(runs) AS many FROM ended),
    sentences AS (
        SELECT doc_id, paragraph, run, unnest(range(len(sentences))) AS sentence, unnest(sentences) AS unit,
               -- Not the whole paragraph, and not a line by itself.
               (many > 1 OR len(sentences) > 1) AND (len(sentences) > 1 OR contains(sentences[1], chr(10))) AS own FROM runs),
    numbered AS (
        SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY paragraph, run, sentence) - 1 AS place FROM sentences),
    units AS (
        {unit.format("line", r"\n")}
        UNION ALL SELECT * FROM ({unit.format("paragraph", r"\n[ \t]*\n")}) WHERE {several}
        UNION ALL SELECT doc_id, 'sentence', place, unit FROM numbered WHERE own
        UNION ALL SELECT doc_id, 'text', 0, text FROM texts WHERE len(string_split_regex(trim(text), '\n[ \t]*\n')) > 1),
    worded AS (
        SELECT doc_id, kind, place, string_split(trim(regexp_replace(lower(unit), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM units),
    paired AS (
        SELECT doc_id, kind, place,
               list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS pairs
        FROM worded WHERE len(w) > 1),
    templates(licence, identifier, wanted) AS (VALUES {rows}),
    matched AS (
        SELECT doc_id, kind, place, licence, identifier, len(wanted) AS m,
               2.0::DOUBLE * len(list_intersect(pairs, wanted)) / (len(pairs) + len(wanted)) AS dice
        FROM paired, templates WHERE len(pairs) BETWEEN len(wanted) / 3 AND 3 * len(wanted))
    SELECT doc_id, kind, place, licence, identifier, dice,
           row_number() OVER (PARTITION BY doc_id, kind, place ORDER BY dice DESC, m DESC, licence) = 1 AS best
    FROM matched WHERE dice >= 0.8"""


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_TERMS = rf"""unnest(regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"""

_RANKED = f"""
    WITH held AS MATERIALIZED (SELECT row, doc_id, term, count(*) AS tf FROM (
             SELECT row, doc_id, {_TERMS} FROM (SELECT row_number() OVER () AS row, doc_id, text FROM documents)) GROUP BY ALL),
    sizes AS MATERIALIZED (SELECT row, CAST(sum(tf) AS BIGINT) AS n FROM held GROUP BY row),
    total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens FROM sizes),
    weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
                FROM held, total GROUP BY term, docs),
    lengths AS (SELECT row, 100 - 90 + ((90 * n * docs) // tokens) AS m FROM sizes, total),
    asked AS (SELECT DISTINCT item, item_id, term FROM (
        SELECT item, item_id, {_TERMS} FROM (SELECT row_number() OVER () AS item, item_id, text FROM benchmark))),
    scored AS (SELECT item, item_id, row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
               FROM asked JOIN weights USING (term) JOIN held USING (term) JOIN lengths USING (row) GROUP BY ALL)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
        SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
    WHERE rank <= 10"""

_AUDIT = r"""
    WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part,
                         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
    firsts AS (SELECT text, min(doc_id) AS least FROM docs GROUP BY text),
    told AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
    failed AS (
        SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
               CASE WHEN len(words) < 200 THEN 'A' ELSE '' END ||
               CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END ||
               CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END ||
               CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END ||
               CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails
        FROM docs JOIN firsts USING (text) LEFT JOIN told USING (doc_id)),
    sets AS (SELECT part, good, toxic, fails, count(*) AS n FROM failed GROUP BY ALL),
    letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
    orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
               FROM letters a, letters b, letters c, letters d, letters e
               WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
    steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS filter, substr(filter_order, 1, step - 1) AS earlier
              FROM (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM orders)),
    met AS (SELECT part, good, toxic, fails, n, filter_order, step, filter, contains(fails, filter) AS hit,
                   translate(fails, earlier, '') <> fails AS gone FROM sets, steps),
    counted AS (
        SELECT part, filter_order, step, filter,
               sum(CASE WHEN NOT gone AND NOT hit THEN n ELSE 0 END) AS kept,
               sum(CASE WHEN NOT gone AND hit THEN n ELSE 0 END) AS removed,
               sum(CASE WHEN gone AND hit THEN n ELSE 0 END) AS redundant,
               sum(CASE WHEN fails = filter THEN n ELSE 0 END) AS unique_fails,
               sum(CASE WHEN NOT gone AND hit AND good THEN n ELSE 0 END) AS good_lost,
               sum(CASE WHEN NOT gone AND hit AND toxic THEN n ELSE 0 END) AS toxic_lost
        FROM met GROUP BY ALL)
    SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
           CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
           CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
           CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
    FROM counted"""

_LINES = rf"""
    WITH parted AS MATERIALIZED (
        SELECT doc_id, lines, list_transform(lines, lambda line:
                   {_LOWER.format(r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')")}) AS keys
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)),
    common AS MATERIALIZED (
        SELECT list(key) AS every FROM (
            SELECT key FROM (SELECT unnest(list_distinct(keys)) AS key FROM parted) WHERE key <> '' GROUP BY key HAVING count(*) >= 10)),
    left_over AS (
        SELECT doc_id, lines, list_filter(lines, lambda line, i: NOT list_contains(coalesce(every, []), keys[i])) AS kept
        FROM parted, common)
    SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped,
           sha256(array_to_string(kept, chr(10))) AS kept_sha256
    FROM left_over"""


def oracle_sql() -> dict[str, str]:
    """The same results from SQL over the tables."""
    return {
        "op5_bottom_k": _NEAR,
        "op6_containment": _LEAKS,
        "op8_redirects": _urls_sql(),
        "op10_licences": _licences_sql(),
        "op11_ranked": _RANKED,
        "op12_audit": _AUDIT,
        "op13_lines": _LINES,
    }
