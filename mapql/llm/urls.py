"""URL rules in a trie over reversed host labels and path segments.

A rule names a host and the start of a path. It fits that host and its subdomains if the path starts with the
rule's. Of the rules that fit, the longest decides: the one whose host has most labels, and among those the one
whose path is longest. The trie is walked once for a URL, whatever the number of rules: down the host's labels
from the last, and at each host that has rules down the path's segments; a rule's last segment may end within a
segment of the URL, so a node holds the segments' starts by length.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DEFAULT = "allow"
#: Rules of up to so many bytes of text are broadcast as a trie; more are joined by host.
TRIE_BYTES = 32 << 20


@dataclass(slots=True)
class Node:
    """A point of the trie: whole steps below it, partial last steps by length, and the rule that ends here."""

    below: dict[str, Node] = field(default_factory=dict)
    paths: Node | None = None
    partial: dict[int, dict[str, tuple[str, str]]] = field(default_factory=dict)
    rule: tuple[str, str] | None = None


def build(rules: Iterable[tuple[str, str, str]]) -> Node:
    """The trie of (verdict, host, path); of rules that say the same twice the first stays, block before allow."""
    root = Node()
    for verdict, host, path in sorted(set(rules), key=lambda r: (r[1], r[2], r[0] != "block")):
        node = root
        for label in reversed(host.split(".")) if host else ():
            node = node.below.setdefault(label, Node())
        if node.paths is None:
            node.paths = Node()
        node = node.paths
        *whole, last = path.split("/")
        for step in whole:
            node = node.below.setdefault(step, Node())
        said = (host + path, verdict)
        if last:
            node.partial.setdefault(len(last), {}).setdefault(last, said)
        elif node.rule is None:
            node.rule = said
    return root


def _path_rule(node: Node, path: str) -> tuple[str, str] | None:
    best = node.rule
    steps = path.split("/")
    for i, step in enumerate(steps):
        for n, starts in node.partial.items():
            if n <= len(step) and step[:n] in starts:
                best = max((best, starts[step[:n]]), key=lambda r: len(r[0]) if r else -1)
        if i == len(steps) - 1 or (node := node.below.get(step)) is None:
            break
        best = node.rule or best
    return best


def look_up(root: Node, host: str, path: str) -> tuple[str | None, str | None]:
    """The rule that decides, as host and path written together, and its verdict."""
    best, node = root.paths and _path_rule(root.paths, path), root
    for label in reversed(host.split(".")) if host else ():
        if (node := node.below.get(label)) is None:
            break
        if node.paths is not None:
            best = _path_rule(node.paths, path) or best
    return best or (None, None)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without one."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _free(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return df.drop(*(c for c in df.columns if c.lower() in names))


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, default: str = DEFAULT, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """``pages`` with host, path, rule and verdict added (columns of these names are replaced).

    Needs url. Defined for odd rows: a url that is null or has no ``://`` has an empty host and path, which only
    a rule with an empty host and path would fit; a url no rule fits has a null rule and the default verdict;
    repeated rows are judged each; an empty table gives an empty table.
    """
    rules = sorted(set(rules))
    df = _free(pages, ("host", "path", "rule", "verdict")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    if sum(len(h) + len(p) for _, h, p in rules) > trie_bytes:
        return judge_by_join(df, rules, default)
    shared = df.sparkSession.sparkContext.broadcast(rules)

    def walk(batches):
        trie = build(shared.value)
        for batch in batches:
            names = batch.schema.names
            hosts, paths = (batch.column(names.index(c)).to_pylist() for c in ("host", "path"))
            found = [look_up(trie, h, p) for h, p in zip(hosts, paths, strict=True)]
            batch = batch.append_column("rule", pa.array([r for r, _ in found], pa.string()))
            yield batch.append_column("verdict", pa.array([v or default for _, v in found], pa.string()))

    schema = T.StructType([*df.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])
    return df.mapInArrow(walk, schema)


def judge_by_join(df: DataFrame, rules: list[tuple[str, str, str]], default: str) -> DataFrame:
    """For more rules than a task should hold: each url's host suffixes joined to the rules by host.

    A url has at most 127 labels, so rows grow with the number of their labels only. Of rules that say the same the
    block stays, as in the trie.
    """
    spark = df.sparkSession
    table = spark.createDataFrame(rules, "v string, h string, p string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    urls = df.select("host", "path").distinct()
    urls = urls.withColumn("s", F.explode(F.array_distinct(F.concat(suffixes, F.array(F.lit(""))))))
    hit = urls.join(table, (F.col("s") == F.col("h")) & F.startswith("path", F.col("p")))
    best = hit.groupBy("host", "path").agg(F.max(F.struct(F.length("h"), F.length("p"), F.concat("h", "p"), "v")).alias("m"))
    best = best.select(F.col("host").alias("_h"), F.col("path").alias("_p"), F.col("m.col3").alias("rule"), F.col("m.v").alias("_v"))
    out = df.join(best, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left")
    return out.withColumn("verdict", F.coalesce("_v", F.lit(default))).drop("_h", "_p", "_v")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).drop("url")


OP5_SQL = r"""
WITH u AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), r(v, h, p) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), m AS (
  SELECT u.*, h || p AS rule, v, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(h) DESC NULLS LAST, length(p) DESC) AS k
  FROM u LEFT JOIN r ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1
"""
