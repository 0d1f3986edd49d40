"""URL filters (operator 3): prefix rules over reversed hosts, applied by one sorted sweep.

A rule ``(host, path)`` is the key ``reversed host + path``; the keys that start with it form an interval.
An url has one key for each suffix of its host, so that a rule for a host also meets its subdomains. Rules
of one host nest or are disjoint, so sorting interval bounds together with url keys and sweeping over them
needs a stack: an opening bound pushes its rule, a closing bound restores the rule below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Urls of a host that one sweep takes; a host with more is dealt over as many sweeps as it needs, its bounds copied to each.
SWEEP_URLS = 100_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``? #`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _reversed(labels: Column) -> Column:
    return F.array_join(F.reverse(labels), ".")


def rule_bounds(rules: DataFrame) -> DataFrame:
    """Interval bounds of ``rules`` (``host, path, verdict``), each with the rule on top of the stack after it.

    Within a host the depth after a bound is a running sum of +1 and -1; the rule on top at that depth is
    the last one that was opened at it. Rows: ``rhost, at`` (binary), ``kind`` (0 close, 1 open), ``rule,
    verdict`` (null when the stack is empty), ``size``.
    """
    rules = (
        rules.select("host", "path", "verdict")
        .where(F.col("host").isNotNull() & F.col("path").isNotNull())
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))  # of rules that contradict each other, "block" < "warn"; one is kept
        .select(
            _reversed(F.split("host", r"\.")).alias("rhost"),
            F.encode("path", "UTF-8").alias("path"),
            F.concat("host", "path").alias("rule"),
            "verdict",
            F.length(F.concat("host", "path")).alias("size"),
        )
    )
    opened = rules.select("rhost", F.col("path").alias("at"), F.lit(1).alias("kind"), "rule", "verdict", "size")
    # byte FF is in no UTF-8 text, so it closes the interval behind every key that starts with the path
    closed = rules.select("rhost", F.concat("path", F.unhex(F.lit("FF"))).alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("int").alias("size"))
    by_key = Window.partitionBy("rhost").orderBy("at", "kind")
    bounds = opened.union(closed).withColumn("depth", F.sum(F.when(F.col("kind") == 1, 1).otherwise(-1)).over(by_key.rowsBetween(Window.unboundedPreceding, 0)))
    at_depth = Window.partitionBy("rhost", "depth").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    top = F.last(F.when(F.col("kind") == 1, F.struct("rule", "verdict", "size")), ignorenulls=True).over(at_depth)
    return bounds.withColumn("top", F.when(F.col("depth") > 0, top)).select("rhost", "at", "kind", "top.rule", "top.verdict", "top.size")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """Adds ``host, path, rule, verdict`` to ``pages``; columns of these names are replaced.

    The longest rule (host and path together, then the longer host) that fits decides; without one,
    ``rule`` is null and ``verdict`` is ``default``. Null urls and urls without ``://`` have an empty host and
    path, which no rule fits. Repeated rows stay; an empty table or empty rules are fine. Null hosts or paths
    of rules are ignored, repeated rules count once.

    Distinct ``(host, path)`` pairs are judged and joined back, so a hot url costs one sweep row. The verdicts are written
    before that join, so that Spark can split a hot url's pages; pages without a host take no part in it.
    """
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    pages = pages.select(*kept, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    bounds = rule_bounds(rules)
    deepest = rules.agg(F.coalesce(F.max(F.size(F.split("host", r"\."))), F.lit(0))).scalar()
    keys = cut(
        pages.select("host", "path").distinct()
        .where(F.col("host") != "")
        .withColumn("labels", F.split("host", r"\."))
        .withColumn("most", F.least(F.size("labels"), deepest))
        .where(F.col("most") > 0)
        .select("host", "path", "labels", F.explode(F.sequence(F.lit(1), F.col("most"))).alias("n"))
        .select("host", "path", _reversed(F.expr("slice(labels, -n, n)")).alias("rhost"), F.encode("path", "UTF-8").alias("at"), F.lit(2).alias("kind"))
        .join(bounds.select("rhost").distinct(), "rhost", "left_semi")
    )
    sweeps = cut(keys.groupBy("rhost").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(SWEEP_URLS))).cast("int").alias("sweeps")), short=True)  # a row for a rule's host at most
    keys = keys.join(sweeps, "rhost").withColumn("split", F.pmod(F.xxhash64("host", "path"), "sweeps").cast("int"))
    nothing = {"rule": "string", "verdict": "string", "size": "int"}
    events = keys.select("rhost", "split", "at", "kind", *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()], "host", "path").unionByName(
        bounds.join(sweeps, "rhost").withColumn("split", F.explode(F.sequence(F.lit(0), F.col("sweeps") - 1))).drop("sweeps").withColumn("host", F.lit(None).cast("string")).withColumn("path", F.lit(None).cast("string"))
    )
    sweep = Window.partitionBy("rhost", "split").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    # a closing bound sets the stack's new top too, which may be none: hence the struct around it
    last = F.last(F.when(F.col("kind") < 2, F.struct("rule", "verdict", "size")), ignorenulls=True).over(sweep)
    found = cut(
        events.withColumn("top", last)
        .where((F.col("kind") == 2) & F.col("top.rule").isNotNull())
        .groupBy("host", "path")
        .agg(F.max(F.struct("top.size", F.length("rhost").alias("host_size"), "top.rule", "top.verdict")).alias("best"))
        .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    )
    judged = pages.where(F.col("host") != "").join(found, ["host", "path"], "left").select(*kept, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
    return judged.unionByName(pages.where(F.col("host") == "").withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default)))
