"""URL rules applied by a sort-merge range join.

A host is written with its labels reversed (``blog.example.com`` -> ``com.example.blog.``),
so a rule's host and all its subdomains form one interval of keys. Urls are cut into
ranges of that key by sampled splitters; a rule goes to every range that its interval
meets. Each range is sorted with rules and urls mixed and swept once: hosts with rules whose
interval covers the current key form a stack of nested intervals, each with its paths by text,
so a url costs a lookup per host above it and different path length, however many rules
there are. The active rule with the longest
``host + path`` whose path begins the url's path decides (of equal length the one with the
longer host, then block before allow).

Neither side is broadcast or held whole. A busy host is spread over ranges by the url's
identifier; the rules on top of it are copied to each of its ranges.

Defined results: a null url or one without ``://`` has empty host and path, fits no rule
and gets the default verdict; an identifier may be null or repeated, each row is judged;
rules with a null part are ignored, repeated ones count once; an empty table gives no rows,
an empty rule list default verdicts; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinloom.functions.names import ref
from twinloom.llm.registry import query, table
from twinloom.llm.shared import inline, leading, tasks

DEFAULT = "allow"
SPLITTER_CHARS = 200
SAMPLES_PER_RANGE = 64
RULES = [
    {"action": "block", "host": "net", "path": "/"},
    {"action": "allow", "host": "example.net", "path": "/en/"},
    {"action": "block", "host": "example.com", "path": "/de/"},
    {"action": "allow", "host": "org", "path": "/fr/"},
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url):
    """Host (A-Z lowered) and path of a url column; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    host = F.when(at > 0, F.translate(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1), _UPPER, _LOWER))
    path = F.when(at > 0, F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1))
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def reversed_host(host):
    """``a.b.c`` -> ``c.b.a.``: the keys of a host and its subdomains begin alike."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _splitters(keys: DataFrame, ranges: int) -> list[tuple[str, int]]:
    """Bounds of about equal ranges of (key, tie), from a bounded sample in hash order."""
    sample = keys.orderBy(F.xxhash64("tie", "key")).limit(SAMPLES_PER_RANGE * ranges)
    seen = sorted((r["k"], r["tie"]) for r in sample.select(F.substring("key", 1, SPLITTER_CHARS).alias("k"), "tie").collect())
    return sorted({seen[len(seen) * i // ranges] for i in range(1, ranges)}) if seen else []


class _Host:
    """The rules of one host that cover the current key: paths by text, and their different lengths."""

    def __init__(self, key: str, host: str):
        self.key, self.host = key, host
        self.actions: dict[str, str] = {}
        self.lengths: list[int] = []

    def add(self, path: str, action: str) -> None:
        self.actions[path] = max(action, self.actions.get(path, action))  # block before allow
        if len(path) not in self.lengths:
            self.lengths = sorted([*self.lengths, len(path)], reverse=True)

    def longest(self, path: str) -> tuple[int, int, str, str] | None:
        """The longest path that begins ``path``, ready to be compared with other hosts' rules."""
        for n in self.lengths:
            if n <= len(path) and path[:n] in self.actions:
                return len(self.host) + n, len(self.host), self.actions[path[:n]], self.host + path[:n]
        return None


def _sweep(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rules and urls of whole ranges -> urls with their rule; holds only the stack."""
    stack: list[_Host] = []
    at = None
    for frame in rows:
        rules, actions = [], []
        for part, is_url, key, host, path, action in zip(
            frame["range"], frame["is_url"], frame["key"], frame["host"], frame["path"], frame["action"]
        ):
            if part != at:
                at, stack = part, []
            while stack and not key.startswith(stack[-1].key):
                stack.pop()
            best = None
            if is_url:
                best = max(filter(None, (h.longest(path) for h in stack)), default=None)
            else:
                if not stack or stack[-1].key != key:
                    stack.append(_Host(key, host))
                stack[-1].add(path, action)
            rules.append(best and best[3])
            actions.append(best and best[2])
        out = frame[["id", "host", "path"]].assign(rule=rules, verdict=actions)
        yield out[frame["is_url"]]


def filter_urls(
    pages: DataFrame,
    rules: DataFrame,
    default: str = DEFAULT,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule (null if none fits), verdict.

    ``rules`` has action (block or allow), host, path.
    """
    spark = pages.sparkSession
    ranges = tasks(spark)
    host, path = host_and_path(ref(url_col))
    urls = pages.select(ref(id_col).cast("string").alias("id"), host.alias("host"), path.alias("path")).select(
        "*", reversed_host(F.col("host")).alias("key"), F.xxhash64("id", "path").alias("tie")
    )
    bounds = _splitters(urls, ranges)
    cuts = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(t).alias("tie")) for k, t in bounds])

    def number(key, tie):
        """How many bounds lie at or before (key, tie)."""
        if not bounds:
            return F.lit(0)
        return leading(cuts, len(bounds), lambda c: c <= F.struct(key.alias("key"), tie.alias("tie")))

    listed = rules.select("action", "host", "path").dropna().distinct()
    listed = listed.withColumn("key", reversed_host(F.col("host")))
    lowest, highest = F.lit(-(2**63)), F.lit(2**63 - 1)
    # the interval of a rule's keys ends below its key with the last '.' replaced by '/'
    past = F.concat(F.substring("key", 1, F.length("key") - 1), F.lit("/"))
    spread = listed.select(
        F.explode(F.sequence(number(F.col("key"), lowest), number(past, highest))).alias("range"),
        F.lit(False).alias("is_url"),
        F.lit(None).cast("string").alias("id"),
        "host",
        "path",
        "key",
        lowest.alias("tie"),
        "action",
    )
    placed = urls.select(
        number(F.col("key"), F.col("tie")).alias("range"),
        F.lit(True).alias("is_url"),
        "id",
        "host",
        "path",
        "key",
        "tie",
        F.lit(None).cast("string").alias("action"),
    )
    mixed = placed.unionByName(spread).repartitionById(ranges, "range")
    swept = mixed.sortWithinPartitions("range", "key", "is_url", "host", "path", "action", "tie").mapInPandas(
        _sweep, "id string, host string, path string, rule string, verdict string"
    )
    return swept.select(
        F.col("id").cast(pages.schema[id_col].dataType).alias(id_col),
        "host",
        "path",
        "rule",
        F.coalesce("verdict", F.lit(default)).alias("verdict"),
    )


@query(
    "op2_url_filter",
    r"""
with cut as (select page_id, case when url like '%://%' then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
split as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from (select page_id, coalesce(rest, '') as rest from cut)),
rules(action, rhost, rpath) as (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
  ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fit as (
  select s.*, r.rhost || r.rpath as rule, r.action,
         row_number() over (partition by s.page_id order by length(r.rhost || r.rpath) desc nulls last) as place
  from split s left join rules r on (s.host = r.rhost or ends_with(s.host, '.' || r.rhost)) and starts_with(s.path, r.rpath))
select page_id, host, path, rule, coalesce(action, 'allow') as verdict from fit where place = 1""",
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = inline(spark, RULES, "action string, host string, path string")
    return filter_urls(table(spark, sf_dir, "pages"), rules)
