"""URL filter: a trie over reversed host labels and path segments, with the longest rule winning.

The trie is broadcast inside the Arrow function. It is built from the rule list alone, whose length is checked:
beyond ``max_trie_rules`` the same verdicts come from a join on host suffixes.

Defined results: a null url, or one without ``://``, has an empty host and path and no rule. A url without a rule
gets ``default``. Between fitting rules the one with most characters (host and path) wins, then the longer host, then
block. Repeated rows each get their verdict; an empty table gives an empty result; columns of the input that bear
the name of a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import UPPER, need, new_names, ship

Rule = tuple[str, str, str]  # verdict, host, path
MAX_TRIE_RULES = 200_000


class HostTrie:
    """Host labels from the right; at each host, a trie over path segments whose ends hold string tails."""

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault("labels", {}).setdefault(label, {})
            *segments, tail = path.split("/")
            place = node.setdefault("paths", {})
            for segment in segments:
                place = place.setdefault("segments", {}).setdefault(segment, {})
            new = (len(host) + len(path), len(host), verdict == "block", host + path, verdict)
            tails = place.setdefault("tails", {})
            tails[tail] = max(new, tails.get(tail, new))

    def match(self, host: str, path: str) -> tuple | None:
        best, node, parts = None, self.root, path.split("/")
        for label in reversed(host.split(".")):
            node = node.get("labels", {}).get(label)
            if node is None:
                break
            place = node.get("paths")
            for depth, part in enumerate(parts):
                if place is None:
                    break
                for tail, found in place.get("tails", {}).items():
                    if part.startswith(tail) and (best is None or found > best):
                        best = found
                place = place.get("segments", {}).get(part) if depth + 1 < len(parts) else None
        return best


def split_url(url):
    """Host and path of a url column, both empty where there is none."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))), F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, UPPER.lower())
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def filter_urls(pages: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow", max_trie_rules: int = MAX_TRIE_RULES) -> DataFrame:
    """Adds host, path, rule and verdict to every row."""
    need(pages, url)
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = split_url(pages[url])
    parsed = pages.select(*(pages[c] for c in kept), host.alias("host"), path.alias("path"))
    if len(rules) > max_trie_rules:
        return _by_join(parsed, rules, default)
    ship(pages.sparkSession)
    trie = HostTrie(rules)

    @F.pandas_udf("rule string, verdict string")
    def judge(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        found = [trie.match(h, p) for h, p in zip(hosts, paths)]
        return pd.DataFrame({"rule": [x and x[3] for x in found], "verdict": [x[4] if x else default for x in found]}, dtype=object)

    (name,) = new_names(parsed, "found")
    judged = parsed.withColumn(name, judge("host", "path"))
    return judged.select(*kept, "host", "path", F.col(f"{name}.rule").alias("rule"), F.col(f"{name}.verdict").alias("verdict"))


def _by_join(parsed: DataFrame, rules: Sequence[Rule], default: str) -> DataFrame:
    """For lists too long to broadcast: suffixes of each distinct host and beginnings of its path meet the rules by
    equality, in a shuffled join. A rule has a row for its path up to the last slash, and so has each url for every
    directory that its path is in; what comes behind the slash is compared as it is. So a host suffix that many urls and
    many rules share, such as a top-level domain, is split by directory."""
    spark = parsed.sparkSession
    rows = spark.createDataFrame([(h, p[: p.rfind("/") + 1], p, v) for v, h, p in rules], "r_host string, r_dir string, r_path string, r_verdict string")
    pairs = parsed.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.split("path", "/")
    dirs = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.when(n == 0, "").otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/"))))
    rank = F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"), F.col("r_verdict") == "block", F.concat("r_host", "r_path"), "r_verdict")
    best = (
        pairs.withColumn("suffix", F.explode(suffixes))
        .withColumn("dir", F.explode(F.array_distinct(dirs)))
        .join(rows, (F.col("suffix") == F.col("r_host")) & (F.col("dir") == F.col("r_dir")))
        .where(F.expr("startswith(path, r_path)"))
        .groupBy("host", "path")
        .agg(F.max(rank).alias("best"))
    )
    out = parsed.join(best, ["host", "path"], "left")
    return out.select(*parsed.columns, F.col("best.col4").alias("rule"), F.coalesce(F.col("best.r_verdict"), F.lit(default)).alias("verdict"))
