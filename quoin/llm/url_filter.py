"""URL filters as a sort-merge range join.

A host is turned round label by label, so that a rule for a host and all its subdomains is one interval of the
sorted keys. Each partition sorts its urls by (key, path) and sweeps them once against the sorted rules. A stack holds
the rules whose host interval is open; below it, a second stack holds those whose path prefix is open.

Rules that are at most ``max_broadcast_rules`` are broadcast, and nothing is shuffled. A longer list is dealt by ranges of
keys instead: a rule goes to every range that its interval meets (beyond its own, only rules above a range's first key do),
urls go to the range of their key, ranges with many urls are dealt over several tasks, and the same sweep merges both.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoin.llm.common import LOWER, UPPER, in_batches, table

#: The rules of the registered query: (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
RULE_SCHEMA = "host string, path string, action string"


def url_host(url: Column) -> Column:
    """From behind the first '://' up to '/', '?', '#' or the end, A-Z in lower case; empty without '://' or url."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """From behind the host up to '?', '#' or the end; empty without '://' or url."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: str) -> str:
    """'www.example.net' -> 'net.example.www.': hosts below a host have its key as prefix."""
    return ".".join(reversed(host.split("."))) + "."


def key_of(host: Column) -> Column:
    """host_key as an expression."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


Rule = tuple[str, str, str, str]  # key, path, name, action


class Sweep:
    """Rules are opened and urls judged in one common order of keys, a key's rules before its urls; urls of one key in the order of
    their paths. Of the rules that fit, the longest (host and path together) wins; on a tie the one with the longer host."""

    def __init__(self):
        self.hosts: list[tuple[str, list[Rule]]] = []
        self.key: str | None = None

    def open(self, rule: Rule) -> None:
        self.close(rule[0])
        if self.hosts and self.hosts[-1][0] == rule[0]:
            self.hosts[-1][1].append(rule)
        else:
            self.hosts.append((rule[0], [rule]))
        self.key = None

    def close(self, key: str) -> None:
        while self.hosts and not key.startswith(self.hosts[-1][0]):
            self.hosts.pop()

    def judge(self, key: str, path: str) -> Rule | None:
        if key != self.key:
            self.close(key)
            self.by_path = sorted((r for _, held in self.hosts for r in held), key=lambda r: r[1])
            self.key, self.paths, self.next = key, [], 0
        while self.next < len(self.by_path) and self.by_path[self.next][1] <= path:
            rule = self.by_path[self.next]
            while self.paths and not rule[1].startswith(self.paths[-1][0]):
                self.paths.pop()
            rank = (len(rule[0]) - 1 + len(rule[1]), len(rule[0]), rule)
            self.paths.append((rule[1], max(rank, self.paths[-1][1]) if self.paths else rank))
            self.next += 1
        while self.paths and not path.startswith(self.paths[-1][0]):
            self.paths.pop()
        return self.paths[-1][1][2] if self.paths else None


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", max_broadcast_rules: int = 100_000, task_urls: int = 1_000_000) -> DataFrame:
    """Judge every row's url: adds host, path, rule (like 'net/', or null) and verdict, replacing columns so named.

    rules has host, path and action ('allow' or 'block'); rules with a null in them are left out, and of equal rules the
    alphabetically last action holds. Where no rule fits, ``default`` holds. Null urls and urls without '://' have an
    empty host and path and fit no rule. Rows that are equal stay separate rows; an empty table gives an empty table.
    """
    clean = rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "action").dropna().groupBy("host", "path").agg(F.max("action").alias("action"))
    clean = clean.select(key_of(F.col("host")).alias("key"), "path", F.concat("host", "path").alias("name"), "action")
    made = ["host", "path", "rule", "verdict"]
    kept = [c for c in pages.columns if c.lower() not in made]
    source = F.col(url) if url in kept else pages[url]
    parsed = pages.select(F.struct(*kept).alias("row"), url_host(source).alias("host"), url_path(source).alias("path"))
    parsed = parsed.withColumn("key", key_of(F.col("host")))
    taken = clean.limit(max_broadcast_rules + 1).collect()
    judged = _by_broadcast(parsed, [tuple(r) for r in taken], default) if len(taken) <= max_broadcast_rules else _by_ranges(parsed, clean, default, max_broadcast_rules, task_urls)
    return judged.select("row.*", "host", "path", "rule", "verdict")


def _verdicts(batch: pa.RecordBatch, found: list[Rule | None], default: str) -> pa.RecordBatch:
    rule, verdict = pa.array([r and r[2] for r in found], pa.string()), pa.array([r[3] if r else default for r in found], pa.string())
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "host", "path")), rule, verdict], names=["row", "host", "path", "rule", "verdict"])


def _judged(parsed: DataFrame) -> T.StructType:
    text = [T.StructField(c, T.StringType()) for c in ("rule", "verdict")]
    return T.StructType([*(parsed.schema[c] for c in ("row", "host", "path")), *text])


def _by_broadcast(parsed: DataFrame, rules: list[Rule], default: str) -> DataFrame:
    shared = parsed.sparkSession.sparkContext.broadcast(sorted(rules))

    def judge(batches):
        rules_here, sweep, ahead = shared.value, Sweep(), 0
        for batch in batches:
            found = []
            for key, path in zip(batch.column("key").to_pylist(), batch.column("path").to_pylist(), strict=True):
                while ahead < len(rules_here) and rules_here[ahead][0] <= key:
                    sweep.open(rules_here[ahead])
                    ahead += 1
                found.append(sweep.judge(key, path))
            yield _verdicts(batch, found, default)

    return in_batches(parsed.sortWithinPartitions("key", "path"), judge, _judged(parsed))


def _by_ranges(parsed: DataFrame, rules: DataFrame, default: str, range_rules: int, task_urls: int) -> DataFrame:
    """The same for rules too many to broadcast. The driver holds one key in range_rules and the ranges' numbers of urls."""

    def marks(batches):
        seen = 0
        for batch in batches:
            keys = batch.column(0).to_pylist()
            some = [k for i, k in enumerate(keys, seen) if i % range_rules == 0]
            seen += len(keys)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], names=["key"])

    bounds = sorted({r.key for r in in_batches(rules.select("key").orderBy("key"), marks, "key string").collect()})

    def number(df: DataFrame, low: str, high: str, kind: str) -> DataFrame:
        """A row for each range that [low, high] meets."""

        def make(batches):
            for batch in batches:
                lows, highs = batch.column(low).to_pylist(), batch.column(high).to_pylist()
                spans = [range(bisect_right(bounds, a), bisect_right(bounds, b) + 1) for a, b in zip(lows, highs, strict=True)]
                rows = batch.take(pa.array([i for i, x in enumerate(spans) for _ in x], pa.int64()))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([k for x in spans for k in x], pa.int32())], names=[*rows.schema.names, kind])

        return in_batches(df, make, T.StructType([*df.schema.fields, T.StructField(kind, T.IntegerType())]))

    urls = number(parsed, "key", "key", "range")
    tasks = F.ceil(F.col("count") / task_urls).cast("long").alias("tasks")
    sizes = urls.groupBy("range").count().select("range", tasks)
    urls = urls.join(F.broadcast(sizes), "range").select("range", F.pmod(F.xxhash64("host", "path", F.monotonically_increasing_id()), "tasks").alias("task"), "key", F.lit(1).alias("kind"), "path", "row", "host")
    dealt = number(rules.withColumn("last", F.concat("key", F.lit("\U0010ffff"))), "key", "last", "range").join(F.broadcast(sizes), "range")
    dealt = dealt.select("range", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)).alias("task"), "key", F.lit(0).alias("kind"), "path", F.lit(None).cast(parsed.schema["row"].dataType).alias("row"), F.lit(None).cast("string").alias("host"), "name", "action")
    both = urls.withColumns({"name": F.lit(None).cast("string"), "action": F.lit(None).cast("string")}).unionByName(dealt)

    def judge(batches):
        sweep, part = Sweep(), None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("range", "task", "kind", "key", "path", "name", "action")]
            at, found = [], []
            for i, (span, task, kind, *rule) in enumerate(zip(*columns, strict=True)):
                if part != (span, task):
                    sweep, part = Sweep(), (span, task)
                if kind:
                    at.append(i)
                    found.append(sweep.judge(rule[0], rule[1]))
                else:
                    sweep.open(tuple(rule))
            yield _verdicts(batch.take(pa.array(at, pa.int64())), found, default)

    parts = both.repartition("range", "task").sortWithinPartitions("range", "task", "key", "kind", "path")
    return in_batches(parts, judge, _judged(parsed))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, spark.createDataFrame(RULES, RULE_SCHEMA)).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = """
with cut as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
parts as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         substr(regexp_extract(rest, '^[^?#]*'), length(regexp_extract(rest, '^[^/?#]*')) + 1) as path from cut),
rules(rhost, rpath, action) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits as (
  select page_id, rhost || rpath as rule, action, row_number() over (partition by page_id order by length(rhost || rpath) desc, length(rhost) desc) as k
  from parts join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath))
select p.page_id, coalesce(host, '') as host, coalesce(path, '') as path, f.rule, coalesce(f.action, 'allow') as verdict
from parts p left join fits f on f.page_id = p.page_id and f.k = 1
"""
