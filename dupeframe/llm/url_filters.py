"""Operator 7: allow and block lists for URLs, by longest match in a trie."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from dupeframe.llm.words import ascii_lower

# (verdict, host, path)
Rule = tuple[str, str, str]
TRIE_BYTES = 64 << 20
PATHS, ENDS = 0, 1  # keys that are no label or segment

RULES: list[Rule] = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path:
    from there up to ``?``, ``#`` or the end. Both empty without a url or ``://``."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.substring_index(F.substring_index(F.substring_index(rest, "/", 1), "?", 1), "#", 1)
    tail = F.substr(rest, F.length(host) + 1)
    path = F.substring_index(F.substring_index(tail, "?", 1), "#", 1)
    return ascii_lower(host), path


def build_trie(rules: list[Rule]) -> dict:
    """Nested dictionaries over reversed host labels, then path segments.

    A label's node is under the label, a host's paths are under ``PATHS``. Path segments include
    their leading slash; what a rule's path ends with need not be a whole segment, so the ends are
    under ``ENDS`` as {partial last segment: rule}. Between equal rules block wins.
    """
    trie: dict = {}
    for verdict, host, path in rules:
        node = trie
        for label in reversed(host.split(".")):
            node = node.setdefault(label, {})
        node = node.setdefault(PATHS, {})
        *whole, last = _segments(path)
        for segment in whole:
            node = node.setdefault(segment, {})
        ends = node.setdefault(ENDS, {})
        if ends.get(last, ("", "allow"))[1] != "block":
            ends[last] = (host + path, verdict)
    return trie


def _segments(path: str) -> list[str]:
    """``/en/1`` as ``/en``, ``/1``; an empty path as one empty segment."""
    head, *rest = path.split("/")
    return ([head] if head or not rest else []) + ["/" + part for part in rest]


def longest_match(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """The rule with the most host labels, then the longest path, that fits."""
    found, node = None, trie
    segments = _segments(path)
    for label in reversed(host.split(".")):
        node = node.get(label)
        if node is None:
            break
        here = node.get(PATHS)
        deepest = None
        for segment in [*segments, None]:
            if here is None:
                break
            fits = [end for end in here.get(ENDS, ()) if (segment or "").startswith(end)]
            if fits:
                deepest = here[ENDS][max(fits, key=len)]
            here = here.get(segment)
        found = deepest or found
    return found


def judge_urls(
    pages: DataFrame,
    rules: list[Rule],
    default: str = "allow",
    url_col: str = "url",
    trie_bytes: int = TRIE_BYTES,
) -> DataFrame:
    """All columns of ``pages`` and a struct column ``_url``: host, path, rule, verdict.

    A rule fits its host and all subdomains if the path starts with the rule's path; the most
    specific host wins, then the longest path, then block. ``rule`` is host and path together,
    null where none fits; the verdict is then ``default``. The trie is broadcast if the rules
    take at most ``trie_bytes``; longer lists are joined by host, with the same result.
    Null, empty and odd urls have empty hosts or paths and are judged like any other; an
    existing column ``_url`` is replaced; repeated rows are kept.
    """
    host, path = host_and_path(F.col(url_col).cast("string"))
    own = [F.col(f"`{c}`") for c in pages.columns if c != "_url"]
    read = pages.select(F.struct(*own).alias("_page"), host.alias("_host"), path.alias("_path"))
    if sum(len(host) + len(path) + 256 for _, host, path in rules) > trie_bytes:
        return _by_join(read, rules, default)
    shared = pages.sparkSession.sparkContext.broadcast(build_trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def look_up(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        trie = shared.value
        for hosts, paths in parts:
            found = [longest_match(trie, h, p) or (None, default) for h, p in zip(hosts, paths)]
            yield pd.DataFrame(found, columns=["rule", "verdict"])

    return read.withColumn("_found", look_up("_host", "_path")).select("_page.*", F.struct(
        F.col("_host").alias("host"), F.col("_path").alias("path"), "_found.rule", "_found.verdict").alias("_url"))


def _by_join(read: DataFrame, rules: list[Rule], default: str) -> DataFrame:
    """The same by an equi-join of every host suffix of a url with the rules' hosts."""
    table = read.sparkSession.createDataFrame(
        [(v, h, p) for v, h, p in rules], "_v string, _h string, _p string")
    labels = F.split("_host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keyed = read.withColumn("_row", F.monotonically_increasing_id())
    hits = keyed.select("_row", "_path", F.explode(suffixes).alias("_h")).join(table, "_h").where(
        F.startswith("_path", "_p"))
    best = hits.groupBy("_row").agg(F.max(F.struct(
        F.size(F.split("_h", r"\.")).alias("labels"), F.length("_p").alias("n"), "_v",
        F.concat("_h", "_p").alias("rule"))).alias("_best"))
    return keyed.join(best, "_row", "left").select("_page.*", F.struct(
        F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_best.rule").alias("rule"),
        F.coalesce("_best._v", F.lit(default)).alias("verdict")).alias("_url"))


def op7_url_filters(spark, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of all pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, RULES).select(
        "page_id", "_url.host", "_url.path", "_url.rule", "_url.verdict")


ORACLE_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), hosts AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts
), rules(verdict, rule_host, rule_path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fits AS (
  SELECT page_id, verdict, rule_host || rule_path AS rule,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS place
  FROM hosts JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM hosts LEFT JOIN (SELECT * FROM fits WHERE place = 1) USING (page_id)
"""
