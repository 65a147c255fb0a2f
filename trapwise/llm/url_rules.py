"""URL filters: a sort-merge range join of URLs with nested prefix rules.

A rule ``host/path`` fits its host and all subdomains when the URL's path
starts with the rule's path.  Both parts become prefixes of canonical keys:
the host with a leading dot, reversed (``ten.elpmaxe.``), and the path as it
is.  A prefix is the key interval ``[p, p + 0xFF)``, and prefix intervals are
nested or disjoint.  Two sweeps over sorted keys find the rules:

1. distinct hosts against distinct rule hosts, with the whole stack of open
   intervals (every rule host that fits);
2. distinct paths below each fitting rule host against that host's rule paths,
   with the top of the stack only (the longest path).

The longest rule string over the fitting hosts wins, then the longer host; of
one rule with both verdicts, ``block`` wins.  A sweep is distributed: range
partitions, with the open depth and the last interval opened at each depth
carried from partition to partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trapwise.llm.common import _ROW_BITS, ascii_lower, need, running_before, shuffle_width, stage_table

#: example rule set: (rule, verdict)
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
DEFAULT_VERDICT = "allow"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return (ascii_lower(F.regexp_extract(rest, "^([^/?#]*)", 1)),
            F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1))


def host_key(host: Column) -> Column:
    """Reversed host with its leading dot: a domain's key is a prefix of its
    subdomains' keys, label by label."""
    return F.reverse(F.concat(F.lit("."), host))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """Rules as rows (rule, verdict)."""
    return spark.createDataFrame(list(rules), "rule string, verdict string")


def sweep(points: DataFrame, rules: DataFrame, whole_stack: bool, name: str) -> DataFrame:
    """(point, opened): for every distinct point key the rule prefixes that are
    open there - all of them, or the innermost only.

    ``points(point)`` and ``rules(prefix)`` hold distinct strings.
    """
    no = F.lit(None).cast("string")
    start = F.col("prefix").cast("binary")
    events = rules.select(start.alias("key"), F.lit(0).alias("kind"), F.lit(1).alias("step"), F.col("prefix").alias("opened"), no.alias("point")) \
        .unionByName(rules.select(F.concat(start, F.unhex(F.lit("FF"))).alias("key"), F.lit(0).alias("kind"), F.lit(-1).alias("step"), no.alias("opened"), no.alias("point"))) \
        .unionByName(points.select(F.col("point").cast("binary").alias("key"), F.lit(1).alias("kind"), F.lit(0).alias("step"), no.alias("opened"), "point"))
    n = shuffle_width(points.sparkSession)
    ev = stage_table(events.repartitionByRange(n, "key", "kind").sortWithinPartitions("key", "kind")
                     .withColumn("_mid", F.monotonically_increasing_id())
                     .withColumn("_part", F.shiftright("_mid", _ROW_BITS)).drop("key", "kind"), name)
    # depth of the stack after each event
    before = running_before(ev.groupBy("_part").agg(F.sum("step").alias("_n")), "_n")
    here = Window.partitionBy("_part").orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    deep = ev.join(F.broadcast(before), "_part").withColumn("_depth", F.sum("step").over(here) + F.col("_before")) \
             .where("step >= 0 and _depth > 0")
    # a point looks at its open depths, an opened interval sits at its own
    own = F.when(F.col("point").isNull() | F.lit(not whole_stack), F.array("_depth")).otherwise(F.sequence(F.lit(1), F.col("_depth")))
    slots = deep.select("_part", "_mid", "point", "opened", F.explode(own).alias("_level"))
    # the last interval opened at a depth in earlier partitions
    last = slots.where("opened is not null").groupBy("_level", "_part").agg(F.max_by("opened", "_mid").alias("_carried"))
    following = F.lead("_part").over(Window.partitionBy("_level").orderBy("_part"))
    carried = last.withColumn("_to", F.coalesce(following, F.lit(n).cast("long"))) \
        .select("_level", "_carried", F.explode(F.sequence(F.col("_part") + 1, F.col("_to"))).alias("_part"))
    level = Window.partitionBy("_part", "_level").orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    found = slots.withColumn("_top", F.last("opened", ignorenulls=True).over(level)).where("point is not null")
    return found.join(carried, ["_part", "_level"], "left") \
        .select("point", F.coalesce("_top", "_carried").alias("opened"))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages(page_id, url)``.

    ``rules(rule, verdict)``.  A null URL or one without ``://`` has empty host
    and path, fits no rule and gets the default verdict, as does every URL
    when there are no rules.  Rules without a host are ignored; repeated rows stay repeated.
    """
    host, path = url_parts(F.col("url"))
    urls = need(pages, page_id="long", url="string").select("page_id", host.alias("host"), path.alias("path"))
    known = need(rules, rule="string", verdict="string").where("rule is not null")
    slash = F.instr("rule", "/")
    known = known.select(
        "rule", "verdict",
        ascii_lower(F.when(slash > 0, F.substring("rule", F.lit(1), slash - 1)).otherwise(F.col("rule"))).alias("rule_host"),
        F.when(slash > 0, F.substring("rule", slash, F.length("rule"))).otherwise(F.lit("")).alias("rule_path"))
    known = known.where("rule_host <> ''").groupBy("rule_host", "rule_path") \
                 .agg(F.max(F.struct("verdict", "rule")).alias("r")).select("rule_host", "rule_path", "r.*")
    places = urls.select("host", "path").where("host <> ''").distinct()

    hosts = sweep(places.select(host_key(F.col("host")).alias("point")).distinct(),
                  known.select(host_key(F.col("rule_host")).alias("prefix")).distinct(), True, "url-hosts")
    below = places.withColumn("point", host_key(F.col("host"))).join(hosts, "point") \
        .select("host", "path", F.col("opened").alias("_domain"))
    tagged = F.concat(F.col("_domain"), F.lit("\n"), F.col("path"))
    fits = sweep(below.select(tagged.alias("point")).distinct(),
                 known.select(F.concat(host_key(F.col("rule_host")), F.lit("\n"), F.col("rule_path")).alias("prefix")), False, "url-paths")
    named = known.select("rule", "verdict", "rule_host",
                         F.concat(host_key(F.col("rule_host")), F.lit("\n"), F.col("rule_path")).alias("opened"))
    best = below.withColumn("point", tagged).join(fits, "point").join(named, "opened").groupBy("host", "path").agg(
        F.max(F.struct(F.length("rule").alias("n"), F.length("rule_host").alias("h"), "rule", "verdict")).alias("best"))
    return urls.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
