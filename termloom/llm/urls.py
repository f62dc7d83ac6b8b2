"""URL filters: host-suffix and path-prefix expressions joined to rules on short hash prefixes.

A URL's expressions are every suffix of its host at a dot, each with every
prefix of its path whose length occurs among the rules' paths. An expression
meets the rules by an equi-join on the first `PREFIX` hex digits of its
SHA-256; the full digest is confirmed before a rule counts, and the longest
matching rule wins.

The rule table is broadcast only when its counted rows are few. Beyond the
bound both sides are shuffled by prefix. The expressions of each prefix are counted
first (map-side); a prefix above a share of `1 / MAX_HOT` of them is hot, and the rules
of the hot prefixes, `MAX_HOT` prefixes at most, are broadcast instead, so a prefix that half of all
URLs share isn't one task. Matches are reduced per URL.

Defined results: a null URL, or one without `://`, has an empty host and path
and matches no rule; a host keeps its port; repeated rows give one row each;
an empty table gives an empty result; other columns of the pages are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX = 8
MAX_HOT = 10_000
MAX_BROADCAST_RULES = 100_000


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased."""
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes(host: Column) -> Column:
    """`a.b.c` gives `a.b.c`, `b.c` and `c`; the empty host gives none."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    every = F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, n - i), "."))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.filter(every, lambda s: s != ""))


def rule_table(spark, rules) -> DataFrame:
    """rules: (action, host, path) tuples. One row per expression; the last of equal ones counts."""
    last = {host.lower() + path: (action, host.lower(), path) for action, host, path in rules}
    rows = [(action, host, path) for action, host, path in last.values()]
    return spark.createDataFrame(rows, "action string, host string, path string")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", max_broadcast_rules: int = MAX_BROADCAST_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for every page."""
    rule = F.concat("host", "path")
    digest = F.sha2(rule, 256)
    known = rules.select(rule.alias("rule"), F.col("action"), digest.alias("digest"), F.substring(digest, 1, PREFIX).alias("prefix"))
    # the distinct path lengths are as many as the longest path has characters, at most
    lengths = sorted(x[0] for x in rules.select(F.length("path")).distinct().collect())
    base = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    prefixes = F.transform(
        F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path")),
        lambda n: F.substr("path", F.lit(1), n),
    )
    # the first expression is an empty stand-in that keeps every page and counts its repeats
    expressions = F.concat(
        F.array(F.lit(None).cast("string")),
        F.flatten(F.transform(suffixes(F.col("host")), lambda h: F.transform(prefixes, lambda p: F.concat(h, p)))),
    )
    spread = base.select("page_id", "url", "host", "path", F.explode(expressions).alias("expression"))
    spread = spread.withColumn("full", F.sha2("expression", 256)).withColumn("prefix", F.substring("full", 1, PREFIX))
    if known.limit(max_broadcast_rules + 1).count() <= max_broadcast_rules:
        joined = spread.join(F.broadcast(known), "prefix", "left")
    else:
        joined = joined_by_prefix(spread, known)
    confirmed = F.when(F.col("full") == F.col("digest"), F.struct(F.length("rule").alias("n"), F.col("rule"), F.col("action")))
    repeats = F.count_if(F.col("expression").isNull())
    best = joined.groupBy("page_id", "url", "host", "path").agg(F.max(confirmed).alias("best"), repeats.alias("n"))
    return best.select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.action", F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("_"),
    ).drop("_")


def joined_by_prefix(spread: DataFrame, known: DataFrame) -> DataFrame:
    """The expressions that share a prefix with a rule, and every stand-in, where the rules are too many to broadcast."""
    own = spread.filter(F.col("expression").isNotNull())
    counts = own.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).join(known.select("prefix").distinct(), "prefix", "left_semi")
    share = counts.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(counts.filter(F.col("n") > share / MAX_HOT).select("prefix"))
    some = own.join(hot, "prefix", "left_semi").join(F.broadcast(known.join(hot, "prefix", "left_semi")), "prefix")
    rest = own.join(hot, "prefix", "left_anti").join(known.join(hot, "prefix", "left_anti"), "prefix")
    stand_ins = spread.filter(F.col("expression").isNull())
    return some.unionByName(rest).unionByName(stand_ins, allowMissingColumns=True)
