"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over host + path, the literal tokens that every match contains, and perhaps another
expression that takes the match back.  Rules come as a table (action, kind, value, unless): a host with its subdomains, a
site (host and path prefix), a path prefix of any host, a token anywhere, or a regular expression, whose literals are not
known.  Tokens of all rules are counted over the URLs, and each rule is filed under its rarest.  A URL's tokens fetch
candidate rules by an equi-join, and only those run their regular expression.  Rules without literals, few by their
nature and counted, meet every URL.  Work is done once for each distinct URL.

Null URLs, and those without ://, have empty host and path; only rules without literals can meet them.  Repeated rows get
the same verdict, null ids their own row.  With no rules every URL gets the default.  Very long URLs are matched whole.
Columns are taken by name; others are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .texts import table

#: The contract's rules as (action, host, path).
SITE_RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: General rules, below all of these: action, kind, value, and what takes a match back.
GENERAL_RULES = (
    ("block", "token", "casino", "(?:^|[^A-Za-z0-9])(?:history|museum|regulation)(?:[^A-Za-z0-9]|$)"),
    ("block", "token", "viagra", None),
    ("block", "token", "porn", "(?:^|[^A-Za-z0-9])(?:addiction|research)(?:[^A-Za-z0-9]|$)"),
    ("block", "token", "xxx", None),
    ("block", "token", "torrent", None),
    ("block", "path", "/wp-admin/", None),
    ("block", "path", "/cgi-bin/", None),
    ("block", "host", "doubleclick.net", None),
    ("block", "site", "ads.example.org/click/", None),
)
RULE_SCHEMA = "rule string, action string, pattern string, literals array<string>, rank int"
#: Rules may have exceptions.
EXCEPTED = RULE_SCHEMA + ", unless string"
#: Rules without literals that meet every URL, at most.
OPEN_RULES = 10_000


def _java(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/_])", r"\\\1", text)


def _whole(path: str) -> list[str]:
    """The tokens of a path prefix; the last one may go on in the URL."""
    return [x for x in re.split(r"[^A-Za-z0-9]+", path)[:-1] if x]


def _host_tokens(host: str) -> list[str]:
    return [x for x in re.split(r"[^a-z0-9]+", host) if x]


def site_rule(action: str, host: str, path: str) -> tuple:
    """A rule for a host with all its subdomains and a path prefix; its rank is its length: the longest wins."""
    return host + path, action, f"^(?:[^/]*\\.)?{_java(host)}{_java(path)}", sorted({*_host_tokens(host), *_whole(path)}), len(host) + len(path), None


def general_rule(action: str, kind: str, value: str, unless: str | None = None) -> tuple:
    """A rule below all site rules; it has no name in the results."""
    if kind == "token":
        pattern, literals = f"(?:^|[^A-Za-z0-9]){_java(value)}(?:[^A-Za-z0-9]|$)", [value]
    elif kind == "path":
        pattern, literals = f"^[^/]*{_java(value)}", _whole(value)
    elif kind == "host":
        pattern, literals = f"^(?:[^/]*\\.)?{_java(value)}(?:[:/]|$)", _host_tokens(value)
    elif kind == "site":
        host, slash, path = value.partition("/")
        pattern, literals = f"^(?:[^/]*\\.)?{_java(host)}{_java(slash + path)}", [*_host_tokens(host), *_whole(slash + path)]
    elif kind == "regex":
        pattern, literals = value, []
    else:
        raise ValueError(f"no such kind of rule: {kind}")
    return None, action, pattern, sorted(set(literals)), 0, unless


def compiled(rules: DataFrame) -> DataFrame:
    """A table of general rules (action, kind, value, unless) in the form of EXCEPTED."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [dict(zip(names, general_rule(r["action"], r["kind"], r["value"], r["unless"]), strict=True)) for r in batch.to_pylist()]
            yield from pa.Table.from_pylist(made, schema=layout).to_batches()

    names = [part.split()[0] for part in EXCEPTED.split(", ")]
    layout = pa.schema([("rule", pa.string()), ("action", pa.string()), ("pattern", pa.string()), ("literals", pa.list_(pa.string())), ("rank", pa.int32()), ("unless", pa.string())])
    return rules.select("action", "kind", "value", "unless").mapInArrow(rows, EXCEPTED)


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens_of(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, r"[^A-Za-z0-9]+"), lambda x: x != ""))


def rule_index(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """Each rule under the token of it that the fewest URLs have; a rule without literals under the empty token."""
    own = [c for c in ("rule", "action", "pattern", "rank", "unless") if c in rules.columns]
    each = rules.withColumn("token", F.explode(F.when(F.size("literals") > 0, F.col("literals")).otherwise(F.array(F.lit("")))))
    counts = tokens.join(each.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    ranked = each.join(counts, "token", "left").withColumn("at", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))
    return ranked.groupBy(*own).agg(F.min("at").alias("at")).select(*own, F.col("at.token").alias("token"))


def verdicts(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """url, host, path, rule and verdict, one row for each distinct URL (null included).  Of the rules that match, the
    one of the highest rank wins, then block, then the least pattern.  rules: RULE_SCHEMA, or EXCEPTED."""
    rules = rules if "unless" in rules.columns else rules.withColumn("unless", F.lit(None).cast("string"))
    parts = urls.select(F.col(url_col).alias("url")).distinct().withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    parts = parts.withColumn("key", F.concat("host", "path"))
    tokens = parts.select("url", "key", F.explode(tokens_of(F.col("key"))).alias("token"))
    columns = ["url", "key", "rule", "action", "pattern", "rank", "unless"]
    index = rule_index(rules, tokens.select("token"))
    hits = tokens.join(index.where("token <> ''"), "token").select(*columns)
    open_rules = index.where("token = ''").drop("token")
    n = open_rules.count()
    if n > OPEN_RULES:
        raise ValueError(f"{n} rules without a literal token; at most {OPEN_RULES} can meet every URL")
    if n:  # a counted set of rules against all URLs
        hits = hits.unionByName(parts.join(F.broadcast(open_rules)).select(*columns))
    hits = hits.where("regexp(key, pattern) AND NOT coalesce(regexp(key, unless), false)")
    best = hits.groupBy("url").agg(F.min(F.struct((-F.col("rank")).alias("order"), F.when(F.col("action") == "block", 0).otherwise(1).alias("then"), "pattern", "rule", "action")).alias("best"))
    # the null URL can only have met open rules; it is joined by itself
    found = parts.join(best.withColumnRenamed("url", "hit"), F.col("url").eqNullSafe(F.col("hit")), "left")
    return found.select("url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


def production_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*(site_rule(*r) for r in SITE_RULES), *(general_rule(*r) for r in GENERAL_RULES)], EXCEPTED)


def filtered(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    found = verdicts(pages, rules, url_col, default).select(F.col("url").alias("known"), "host", "path", "rule", "verdict")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    return rows.join(found, F.col("url").eqNullSafe(F.col("known")), "left").select("page_id", "host", "path", "rule", "verdict")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(table(spark, sf_dir, "pages"), production_rules(spark))


_FITS = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for a, h, p in sorted(SITE_RULES, key=lambda r: -len(r[1] + r[2])))
OP7_SQL = f"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) path FROM pages),
r AS (SELECT *, host || path k, CASE {_FITS} END rule FROM p),
g AS (SELECT *, regexp_matches(k, '(^|[^A-Za-z0-9])(viagra|xxx|torrent)([^A-Za-z0-9]|$)')
  OR (regexp_matches(k, '(^|[^A-Za-z0-9])casino([^A-Za-z0-9]|$)') AND NOT regexp_matches(k, '(^|[^A-Za-z0-9])(history|museum|regulation)([^A-Za-z0-9]|$)'))
  OR (regexp_matches(k, '(^|[^A-Za-z0-9])porn([^A-Za-z0-9]|$)') AND NOT regexp_matches(k, '(^|[^A-Za-z0-9])(addiction|research)([^A-Za-z0-9]|$)'))
  OR regexp_matches(k, '^[^/]*/(wp-admin|cgi-bin)/') OR regexp_matches(k, '^([^/]*\\.)?doubleclick\\.net([:/]|$)') OR regexp_matches(k, '^([^/]*\\.)?ads\\.example\\.org/click/') general FROM r)
SELECT page_id, host, path, rule, CASE {' '.join(f"WHEN rule = '{h}{p}' THEN '{a}'" for a, h, p in SITE_RULES)} WHEN general THEN 'block' ELSE 'allow' END verdict FROM g
"""
