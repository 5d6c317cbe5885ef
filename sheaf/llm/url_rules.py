"""URL rules by a sorted sweep over reversed-host keys.

`www.example.com` becomes `com.example.www.`: all hosts under a rule's host then form one interval of the sorted keys,
and intervals of different rules nest or are disjoint. Each partition of urls is sorted by key (a sort that spills) and
merged with the sorted rules; a stack holds the rules' hosts whose interval is open, the innermost on top. Urls are not
shuffled. That needs the rules in each task, so their size is checked first (`MAX_RULE_BYTES`); larger rule sets take
the other path: each distinct (host, path) meets the rules of each of its parent domains in an equi-join.

Defined cases: a null url, or one without "://", has an empty host and path and matches nothing unless a rule has an
empty host; of equally long rules the one with the longer host wins, then the smaller string; repeated urls each get
their verdict; a null rule host, path or verdict is an error of the rule table and such rules are left out; urls that
no rule fits get the default verdict.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_RULE_BYTES = 32 << 20
DEFAULT = "allow"
#: The rules of the query (host, path, verdict).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def host_and_path(url):
    """Columns for the host (A-Z lower-cased) and the path of a url column."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def reversed_key(host: str) -> str:
    return "".join(f"{x}." for x in reversed(host.split("."))) if host else ""


class Sweep:
    """Walks ascending keys past the sorted rules, keeping the open nested hosts on a stack."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        hosts: dict[str, dict[str, tuple[int, int, str, str]]] = {}
        for host, path, verdict in rules:
            own = hosts.setdefault(reversed_key(host), {})
            own.setdefault(path, (len(host) + len(path), len(host), host + path, verdict))
        self.hosts = sorted(hosts.items())
        self.lengths = [sorted({len(p) for p in own}, reverse=True) for _, own in self.hosts]
        self.at, self.stack = 0, []

    def move(self, key: str) -> None:
        while self.at < len(self.hosts) and self.hosts[self.at][0] <= key:
            start = self.hosts[self.at][0]
            while self.stack and not start.startswith(self.hosts[self.stack[-1]][0]):
                self.stack.pop()
            self.stack.append(self.at)
            self.at += 1
        while self.stack and not key.startswith(self.hosts[self.stack[-1]][0]):
            self.stack.pop()

    def best(self, path: str) -> tuple[str | None, str | None]:
        found = None
        for i in self.stack:
            own = self.hosts[i][1]
            for n in self.lengths[i]:
                if n <= len(path) and (hit := own.get(path[:n])) is not None:
                    if found is None or (hit[0], hit[1]) >= (found[0], found[1]):
                        found = hit
                    break
        return (found[2], found[3]) if found else (None, None)


def _swept(rules):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sweep, last = Sweep(rules), None
        for batch in batches:
            names, verdicts, seen = [], [], {}
            for key, path in zip(batch["_key"], batch["_path"], strict=True):
                if key != last:
                    sweep.move(key)
                    last, seen = key, {}
                if path not in seen:
                    seen[path] = sweep.best(path)
                rule, verdict = seen[path]
                names.append(rule)
                verdicts.append(verdict)
            yield batch.drop(columns=["_key"]).assign(_rule=pd.Series(names, dtype=object), _verdict=pd.Series(verdicts, dtype=object))

    return run


def judge(urls: DataFrame, rules: DataFrame, id_column: str = "page_id", max_rule_bytes: int = MAX_RULE_BYTES, default: str = DEFAULT) -> DataFrame:
    """id, host, path, rule, verdict for every row of urls; rules have host, path, verdict."""
    host, path = host_and_path(F.col("url"))
    points = urls.select(F.col(id_column).alias("_id"), host.alias("_host"), path.alias("_path"))
    rules = rules.select("host", "path", "verdict").dropna().dropDuplicates(["host", "path"])
    held = rules.agg(F.coalesce(F.sum(F.length("host") + F.length("path") + 64), F.lit(0))).first()[0]
    if held <= max_rule_bytes:
        parts = F.reverse(F.split("_host", r"\."))
        keyed = points.withColumn("_key", F.when(F.col("_host") == "", "").otherwise(F.concat(F.array_join(parts, "."), F.lit(".")))).sortWithinPartitions("_key")
        kind = urls.schema[id_column].dataType.simpleString()
        out = keyed.mapInPandas(_swept(sorted(map(tuple, rules.collect()))), f"_id {kind}, _host string, _path string, _rule string, _verdict string")
    else:
        out = _joined(points, rules)
    return out.select(F.col("_id").alias(id_column), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.coalesce("_verdict", F.lit(default)).alias("verdict"))


def _joined(points: DataFrame, rules: DataFrame) -> DataFrame:
    """The path without a broadcast: copies of a url are judged once, so a hot host costs its distinct paths."""
    labels = F.split("_host", r"\.")
    levels = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, n, F.size(labels)), "."))
    distinct = points.select("_host", "_path").distinct()
    r = rules.select(F.col("host").alias("_level"), F.col("path").alias("_prefix"), F.col("verdict").alias("_v"))
    met = distinct.withColumn("_level", F.explode(levels)).join(r, "_level").where(F.expr("startswith(_path, _prefix)"))
    name = F.concat("_level", "_prefix")
    best = met.groupBy("_host", "_path").agg(F.max_by(F.struct(name.alias("_rule"), F.col("_v").alias("_verdict")), F.struct(F.length(name), F.length("_level"))).alias("_b"))
    return points.join(best, ["_host", "_path"], "left").select("_id", "_host", "_path", "_b._rule", "_b._verdict")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), rules)


ORACLE = """
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, lower(regexp_extract(rest, '^([^/?#]*)', 1)) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
hits AS (SELECT u.host, u.path, max(struct_pack(n := length(h || p), r := h || p, v := v)) AS b FROM (SELECT DISTINCT host, path FROM parts) u JOIN rules ON (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, p) GROUP BY 1, 2)
SELECT page_id, parts.host, parts.path, b.r AS rule, coalesce(b.v, 'allow') AS verdict FROM parts LEFT JOIN hits USING (host, path)"""
