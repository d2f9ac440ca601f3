"""URL allow and block lists: a trie over reversed host labels and path segments."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules that may be held in a broadcast trie; beyond it rules are joined by their keys.
MAX_TRIE_RULES = 200_000


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = str.maketrans(_UPPER, _UPPER.lower())


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str  # fits this host and all its subdomains
    path: str  # fits paths that start with it


def with_host_path(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path of `url`: empty for a null or for one without `://`."""
    u = F.col(url)
    rest = F.when(F.instr(u, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)"))
    return df.withColumn("host", F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _UPPER.lower()), F.lit(""))).withColumn("path", F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit("")))


def build_trie(rules: Iterable[Rule]) -> dict:
    """Nodes are dicts. Host labels, last first, lead to a node whose "/" holds the path trie;
    there, whole segments lead on, and "*" lists (rest of the rule's path, rule) that must
    start what is left of the path."""
    root: dict = {}
    for rule in rules:
        node = root
        for label in reversed(rule.host.split(".")):
            node = node.setdefault("." + label, {})
        node = node.setdefault("/", {})
        *whole, rest = rule.path.split("/")
        for segment in whole:
            node = node.setdefault("s" + segment, {})
        node.setdefault("*", []).append((rest, rule))
        node["*"].sort(key=lambda x: (-len(x[0]), x[1].verdict != "block"))  # of equal rules, block wins
    return root


def longest(trie: dict, host: str, path: str) -> Rule | None:
    """The fitting rule with the longest host and, among these, the longest path."""
    nodes, node = [], trie
    for label in reversed(host.split(".")):
        node = node.get("." + label)
        if node is None:
            break
        if "/" in node:
            nodes.append(node["/"])
    for node in reversed(nodes):
        best, at = None, 0
        while node is not None:
            best = next((rule for rest, rule in node.get("*", ()) if path.startswith(rest, at)), best)
            end = path.find("/", at)
            if end < 0:
                break
            node, at = node.get("s" + path[at:end]), end + 1
        if best:
            return best
    return None


def judge(df: DataFrame, rules: list[Rule], default: str = "allow", max_trie_rules: int = MAX_TRIE_RULES) -> DataFrame:
    """Adds host, path, rule (host and path of the fitting rule, else null) and verdict.

    Null, empty and odd urls have an empty host and path, no rule and the `default` verdict;
    repeated rows are judged each; an empty table stays one; other columns stay, those named as a
    result are replaced. A url costs time in proportion to its length, and of a long host or path only what rules reach is walked.
    A-Z in the hosts of rules count as lower case. Up to `max_trie_rules` rules are broadcast as a trie; a longer list becomes a table that
    is joined on every (host suffix, path prefix) a url has, so it never has to fit a task.
    """
    spark, df = df.sparkSession, with_host_path(df)
    rules = [r._replace(host=r.host.translate(_LOWER)) for r in rules]
    if len(rules) <= max_trie_rules:
        trie = spark.sparkContext.broadcast(build_trie(rules))

        @F.pandas_udf("struct<rule string, verdict string>")
        def look(host: pd.Series, path: pd.Series) -> pd.DataFrame:
            hits = [longest(trie.value, h, p) for h, p in zip(host, path)]
            return pd.DataFrame({"rule": [h and h.host + h.path for h in hits], "verdict": [h.verdict if h else default for h in hits]})

        return df.withColumn("_rm_hit", look("host", "path")).withColumns({"rule": F.col("_rm_hit.rule"), "verdict": F.col("_rm_hit.verdict")}).drop("_rm_hit")
    listed = spark.createDataFrame(rules, "r_verdict string, r_host string, r_path string")
    listed = listed.groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict"))  # block wins
    lengths = listed.select(F.length("r_path").alias("n")).distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    n = [r.n for r in lengths.collect()]  # as many as there are lengths of a rule's path
    urls = df.select("host", "path").distinct()
    keys = urls.withColumn("r_host", F.explode(suffixes)).withColumn("k", F.explode(F.array(*[F.lit(x) for x in n]))).where(F.col("k") <= F.length("path")).withColumn("r_path", F.expr("left(path, k)"))
    best = keys.join(listed, ["r_host", "r_path"]).groupBy("host", "path").agg(F.max_by(F.struct("r_host", "r_path", "r_verdict"), F.struct(F.length("r_host"), "k")).alias("_rm_hit"))
    out = df.join(best, ["host", "path"], "left")
    return out.withColumns({"rule": F.concat("_rm_hit.r_host", "_rm_hit.r_path"), "verdict": F.coalesce("_rm_hit.r_verdict", F.lit(default))}).drop("_rm_hit")
