"""Allow and block decisions for pages, propagated over redirects and canonical links.

The longest rule that fits a page decides it: a rule has a host, which fits itself and its
subdomains, and a path prefix. A page without a rule takes over a block from its aliases:
pages joined by canonical links and by redirects (a refresh in the head) over any
number of steps. A page that a rule allows stays allowed whatever its aliases are; without
any blocked alias the verdict is allow.

A url's identity for links is its host, path and query, without scheme and fragment.
A relative target is resolved against its page's url: from the directory of its path, with ``.``
and ``..`` segments removed; a query alone is on the page's own path. A base element isn't heeded.
Everything is DataFrame functions; links never reach the driver.

Nulls: a null url, or one without ``://``, has an empty host and path, fits no rule and has
no alias. Null html has no links. Rows of equal urls are aliases; every row is judged. Other
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.llm.components import components
from tidings.plans import Workspace

Rules = list[tuple[str, str]]


def _lowered(text: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _host_and_rest(url: Column) -> tuple[Column, Column]:
    """The host, and what follows it."""
    at = F.locate("://", url)
    after = F.when(at > 0, F.substr(url, at + 3, F.lit(1 << 30)))
    host = F.coalesce(F.regexp_extract(after, r"\A([^/?#]*)", 1), F.lit(""))
    return _lowered(host), F.coalesce(F.substr(after, F.length(host) + 1, F.lit(1 << 30)), F.lit(""))


def with_parts(pages: DataFrame) -> DataFrame:
    """page_id, url, html, host, path and the identity of the url, null without a host."""
    host, rest = _host_and_rest(F.col("url"))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
    )
    split = rows.withColumns({"host": host, "rest": rest})
    path = F.regexp_extract("rest", r"\A([^?#]*)", 1)
    return split.select("page_id", "url", "html", "host", path.alias("path"), _identity(F.col("host"), F.col("rest")).alias("name"))


def _identity(host: Column, rest: Column) -> Column:
    plain = F.regexp_extract(rest, r"\A([^#]*)", 1)
    plain = F.when(plain == "", F.lit("/")).otherwise(plain)
    return F.when(host != "", F.concat(host, plain))


def _without_dots(path: Column) -> Column:
    """A path that begins with a slash, without its segments ``.`` and ``..``."""
    parts = F.split(path, "/")
    held = F.aggregate(
        F.slice(parts, F.lit(2), F.size(parts)),
        F.array().cast("array<string>"),
        lambda kept, one: F.when(one == ".", kept)
        .when(one == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
        .otherwise(F.concat(kept, F.array(one))),
        lambda kept: F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept),
    )
    return F.when(path.rlike(r"/\.\.?(?:/|\z)"), F.concat(F.lit("/"), F.array_join(held, "/"))).otherwise(path)


def _absolute(target: Column, host: Column, path: Column, name: Column) -> Column:
    """The target as a url; one with a scheme stays as it is."""
    cut = F.regexp_extract(target, r"\A([^?#]*)", 1)
    after = F.substr(target, F.length(cut) + 1, F.lit(1 << 30))
    folder = F.regexp_extract(path, r"(?s)\A(.*/)", 1)
    whole = F.when(target.startswith("/"), cut).otherwise(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), cut))
    return (
        F.when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.rlike(r"\A[A-Za-z][A-Za-z0-9+.\-]*:"), target)
        .when(target.startswith("#"), F.concat(F.lit("http://"), name))
        .when(target.startswith("?"), F.concat(F.lit("http://"), host, F.when(path == "", F.lit("/")).otherwise(path), target))
        .otherwise(F.concat(F.lit("http://"), host, _without_dots(whole), after))
    )


def _target(html: Column) -> Column:
    """Urls that the page names as canonical or redirects to."""
    tags = F.regexp_extract_all(F.substring(html, 1, 1 << 30), F.lit(r"(?is)(<(?:link|meta)\b[^>]*>)"), F.lit(1))
    canonical = F.filter(tags, lambda tag: tag.rlike(r"(?is)\A<link\b.*\brel\s*=\s*[\"']?canonical\b"))
    refresh = F.filter(tags, lambda tag: tag.rlike(r"(?is)\A<meta\b.*\bhttp-equiv\s*=\s*[\"']?refresh\b"))
    links = F.transform(canonical, lambda tag: F.regexp_extract(tag, r"(?is)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)", 1))
    moves = F.transform(refresh, lambda tag: F.regexp_extract(tag, r"(?is)\burl\s*=\s*[\"']?\s*([^\"'\s>]+)", 1))
    return F.filter(F.transform(F.concat(links, moves), lambda one: F.replace(one, F.lit("&amp;"), F.lit("&"))), lambda one: one != "")


def edges(parted: DataFrame) -> DataFrame:
    """Identities that a page's canonical link or redirect joins: u and v."""
    has = F.col("html").isNotNull() & F.col("html").rlike(r"(?i)canonical|http-equiv") & F.col("name").isNotNull()
    found = parted.where(has).select("host", "path", "name", F.explode(_target(F.col("html"))).alias("target"))
    absolute = _absolute(F.col("target"), F.col("host"), F.col("path"), F.col("name"))
    host, rest = _host_and_rest(F.col("absolute"))
    to = found.withColumn("absolute", absolute).withColumns({"to_host": host, "to_rest": rest})
    named = to.select("name", _identity(F.col("to_host"), F.col("to_rest")).alias("to")).where("`to` IS NOT NULL AND `to` <> name")
    return named.select(F.col("name").alias("u"), F.col("to").alias("v"))


def _rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as a struct of rule and verdict."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, of, prefix in sorted(rules, key=lambda one: (len(one[1]) + len(one[2]), one), reverse=False):
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(prefix)
        found = F.when(fits, F.struct(F.lit(of + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], room: Workspace | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    ``rules`` lists verdict, host and path prefix; it is part of the plan and so meant for up to
    some hundred entries. ``by`` says what decided: rule, alias or default.
    """
    room = room or Workspace(pages.sparkSession)
    parted = with_parts(pages)
    ruled = parted.withColumn("decided", _rule(F.col("host"), F.col("path"), rules))
    slim = ruled.select("page_id", "host", "path", "name", "decided.*")
    held = room.hold(slim, "judged")
    roots = components(edges(parted), room)
    placed = held.join(roots, held["name"] == roots["u"], "left").withColumn("alias", F.coalesce("root", "name"))
    blocked = placed.where("verdict = 'block' AND alias IS NOT NULL").select(F.col("alias").alias("bad")).distinct()
    joined = placed.join(blocked, F.col("alias") == F.col("bad"), "left")
    by_alias = F.when(F.col("bad").isNotNull(), "block").otherwise("allow")
    by = F.when(F.col("rule").isNotNull(), "rule").when(F.col("bad").isNotNull(), "alias").otherwise("default")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("verdict", by_alias).alias("verdict"), by.alias("by"))
