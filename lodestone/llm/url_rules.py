"""URL filters: a sort-merge range join of pages with host and path rules.

The reversed-host key of `www.example.net` is `net.example.www.`, so that a host and all its
subdomains are one interval of keys, and the intervals of different hosts nest or are disjoint.
Pages are range-sorted by key; each rule goes to every range its interval meets; one sorted sweep
over a range keeps the stack of the hosts whose interval is open.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import lower_ascii, materialise

OUT = "page_id long, host string, path string, rule string, verdict string"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or end, A-Z lower-cased; path: then up to
    `?`, `#` or end. A null url or one without `://` has both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    return lower_ascii(host), F.regexp_extract(tail, r"^[^?#]*", 0)


def host_key(host: Column) -> Column:
    """`www.example.net` -> `net.example.www.`; an empty host has an empty key."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


class _Open:
    """An open host interval: its key and its rules by length of path."""

    def __init__(self, key: str) -> None:
        self.key, self.rules = key, {}

    def add(self, path: str, rule: str, verdict: str) -> None:
        at = self.rules.setdefault(len(path), {})
        if path not in at or verdict == "block":
            at[path] = (rule, verdict)

    def best(self, path: str) -> tuple[str, str] | None:
        for n in sorted(self.rules, reverse=True):
            if n <= len(path) and (found := self.rules[n].get(path[:n])):
                return found
        return None


def _sweep(default: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stack, pid = [], None
        for pdf in batches:
            out = []
            for p, key, is_page, page_id, host, path, rule, verdict in zip(
                *(pdf[c] for c in ("pid", "key", "is_page", "page_id", "host", "path", "rule", "verdict"))
            ):
                if p != pid:
                    stack, pid = [], p
                while stack and not key.startswith(stack[-1].key):
                    stack.pop()
                if not is_page:
                    if not stack or stack[-1].key != key:
                        stack.append(_Open(key))
                    stack[-1].add(path, rule, verdict)
                    continue
                fits = [b for o in reversed(stack) if (b := o.best(path))]
                # longest text wins; of equal ones the longer host, which comes first
                won = max(fits, key=lambda b: len(b[0])) if fits else (None, default)
                out.append((page_id, host, path, *won))
            yield pd.DataFrame(out, columns=["page_id", "host", "path", "rule", "verdict"]).astype({"page_id": "Int64"})

    return run


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """One row per page: page_id, host, path, rule (host and path of the rule that won, else null)
    and verdict.

    pages: page_id, url and any others. rules: host, path, verdict (allow or block), of any number.
    A rule fits its host and all subdomains if the page's path starts with the rule's path; the
    longest (host and path together) wins, of equal ones that with the longer host. Of rules of
    the same host and path, block wins. Null path: empty. Rules with no host fit nothing. Pages
    whose url is null or has no `://`, or for which no rule fits, get the default. Repeated pages
    give repeated rows; a null page_id stays null.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    keyed = pages.select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path")).withColumn("key", host_key(F.col("host")))
    # the salt lets many pages of one host go to several ranges
    keyed = keyed.withColumn("salt", F.xxhash64("page_id", "path")).repartitionByRange("key", "salt").withColumn("pid", F.spark_partition_id())
    keyed = materialise(keyed.drop("salt"))
    # as many rows as there are ranges
    ranges = keyed.groupBy("pid").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy("pid").collect()
    strings = lambda x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    pids = F.array(*(F.lit(r.pid) for r in ranges)) if ranges else F.array().cast("array<int>")
    start = host_key(lower_ascii(F.col("host")))
    rules = rules.where("host <> ''").select(start.alias("key"), lower_ascii(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.lower("verdict").alias("verdict"))
    rules = rules.withColumn("rule", F.concat("host", "path")).distinct()
    # keys that start with the rule's own are below it with its last character, a dot, made a slash
    end = F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("/"))
    first = F.size(F.filter(strings([r.hi for r in ranges]), lambda x: x < F.col("key")))
    past = F.size(F.filter(strings([r.lo for r in ranges]), lambda x: x < end))
    copies = rules.withColumn("pid", F.explode(F.slice(pids, first + 1, F.greatest(past - first, F.lit(0)))))
    nothing = F.lit(None)
    rows = keyed.select("pid", "key", F.lit(True).alias("is_page"), "page_id", "host", "path", nothing.cast("string").alias("rule"), nothing.cast("string").alias("verdict")).unionByName(
        copies.select("pid", "key", F.lit(False).alias("is_page"), nothing.cast("long").alias("page_id"), "host", "path", "rule", "verdict")
    )
    n = max(1, len(ranges), int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(n, "pid").sortWithinPartitions("pid", "key", "is_page").mapInPandas(_sweep(default), OUT)
