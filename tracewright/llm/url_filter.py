"""Operator 7: judge captures by the block lists of the day they were fetched.

List entries are dated: a domain is added to a list, removed, perhaps added again.  A list's
entries of a domain become validity intervals [since, until).  A capture is blocked if its
host, or a domain the host is part of, was on a list when it was fetched.

The verdict depends on host and date alone, so each pair of them is judged once, however
many captures it has.  The as-of join is an equi-join on the domain: each domain's
intervals are one array, so a pair meets one row per label of its host.

Of several entries the longest domain tells, then the first list by code point.  Of
actions of one day "add" wins.  Entries without list, domain, date or with another action
say nothing.  A capture without URL, host or date is not blocked.  Equal rows are captures
of their own.  Ids may be null or equal; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"


def host_of(url: Column) -> Column:
    """Host of an absolute URL in lower case, without dots at its ends; '' without one."""
    return F.coalesce(F.btrim(F.lower(F.regexp_extract(url.cast("string"), HOST, 1)), F.lit(".")), F.lit(""))


def domains_of(host: Column, least: int = 1) -> Column:
    """The host and the domains it is part of, down to ``least`` labels."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.when((host == "") | (n < least), F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), n - least + 1), lambda i: F.array_join(F.slice(labels, i, n), ".")))


def validity(entries: DataFrame) -> DataFrame:
    """(list, domain, since, until) from (list, domain, day, action); until is null while open."""
    known = entries.select(
        F.col("list").cast("string").alias("list"), F.btrim(F.lower(F.col("domain").cast("string")), F.lit(".")).alias("domain"),
        F.col("day").cast("date").alias("day"), F.lower(F.col("action")).alias("action"))
    known = known.filter(F.col("action").isin("add", "remove") & (F.col("domain") != "")).dropna()
    # one row per day, combined before the shuffle
    days = known.groupBy("list", "domain", "day").agg(F.max(F.col("action") == "add").alias("added"))
    after = Window.partitionBy("list", "domain").orderBy("day")
    # of consecutive additions only the first begins an interval
    turns = days.withColumn("before", F.lag("added", 1, False).over(after)).filter("added <> before")
    return turns.withColumn("until", F.lead("day").over(after)).filter("added").select(
        "list", "domain", F.col("day").alias("since"), "until")


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url",
                day_col: str = "fetched") -> DataFrame:
    """(id, url, host, fetched, blocked, list, domain, since)."""
    seen = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"),
                           F.col(day_col).cast("date").alias("fetched"))
    pairs = seen.select("host", "fetched").filter("host <> '' AND fetched IS NOT NULL").distinct()
    asked = pairs.withColumn("domain", F.explode(domains_of(F.col("host"))))
    active = validity(entries).groupBy("domain").agg(F.collect_list(F.struct("list", "since", "until")).alias("intervals"))
    then = F.filter("intervals", lambda x: (x["since"] <= F.col("fetched")) & (x["until"].isNull() | (F.col("fetched") < x["until"])))
    hits = asked.join(active, "domain").withColumn("entry", F.array_min(then)).filter("entry IS NOT NULL")
    verdicts = hits.groupBy("host", "fetched").agg(
        F.max_by(F.struct("domain", "entry.list", "entry.since"), F.length("domain")).alias("hit"))
    return seen.join(verdicts, ["host", "fetched"], "left").select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), "host", F.col("fetched").alias(day_col),
        F.col("hit").isNotNull().alias("blocked"), F.col("hit.list").alias("list"), F.col("hit.domain").alias("domain"),
        F.col("hit.since").alias("since"))
