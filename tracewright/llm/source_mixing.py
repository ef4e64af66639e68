"""Operator 10: mix sources to target token weights by entropy balancing.

A document's size is its number of words.  Targets follow from the sources' weights, capped
at ``cap`` times a source's size, the excess shared again by weight.  Among all rates with
sum(rate * size) = target and rate <= cap in each source, entropy balancing takes the
one closest to "every document once" in relative entropy.  It is an exponential tilt,
rate = min(cap, exp(lambda * size / mean size)), and Newton steps on the convex dual
find every source's lambda, from the number of documents of each size.

Rates become whole copies by systematic rounding in the order of size: the k-th document
takes floor(R + 1/2) of the rates' running sum R, less what the ones before took.  Since
sizes only grow in that order, a source's words miss its target by one document's size at
most.  Then single copies are added or taken away where that brings a source nearer.

Everything is DataFrame operations.  Newton steps and windows run over the sizes of one source (bounded by
the longest text), and over blocks of documents of one source and size.

Null text: size 0.  A null source is a source of its own, after all others.  Equal rows are
documents of their own and interchangeable; reruns give the same rows.  Empty tables give
no rows.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exchange import checkpointed, shuffle_partitions

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_ROWS = 50_000
MAX_STEPS = 60
#: parts of a source's rows that meet its one row of totals apart
SALTS = 64
#: rounds of single-copy corrections
CORRECTIONS = 4


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _numbered(sources: DataFrame) -> DataFrame:
    """``nr`` from 0 in the order of the sources, null last: ranges are numbered apart,
    then each gets the number of rows before it (one count per range)."""
    order = [F.col("source").isNull(), F.col("source")]
    ranged = checkpointed(sources.repartitionByRange(shuffle_partitions(sources.sparkSession), *order)
                          .withColumn("range", F.spark_partition_id()))
    sizes = sorted((r["range"], r["count"]) for r in ranged.groupBy("range").count().collect())
    before, offsets = 0, []
    for part, count in sizes:
        offsets += [F.lit(part), F.lit(before)]
        before += count
    own = F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1
    offset = F.element_at(F.create_map(*offsets), F.col("range")) if offsets else F.lit(0)
    return ranged.withColumn("nr", own + offset).drop("range")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2) -> DataFrame:
    """(key, source, source_size, documents, weight, target) from (key, source, size)."""
    stats = sizes.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"),
                                     F.count(F.lit(1)).alias("documents"))
    cycle = F.array(*(F.lit(w) for w in weights))
    named = checkpointed(_numbered(stats).withColumn(
        "weight", F.element_at(cycle, (F.col("nr") % len(weights) + 1).cast("int"))).drop("nr"))
    whole = named.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        above = F.col("weight") * level > cap * F.col("source_size")
        full, open_, n = named.agg(
            F.sum(F.when(above, cap * F.col("source_size")).otherwise(0)),
            F.sum(F.when(~above, F.col("weight")).otherwise(0)), F.count_if(above)).first()
        if n == capped or not open_:
            break
        level, capped = (share * whole - full) / open_, n
    return named.withColumn("target", F.least(F.col("weight") * F.lit(level), (cap * F.col("source_size")).cast("double")))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tilts(counts: DataFrame, targets: DataFrame, cap: int = 2, tolerance: float = 1e-9) -> DataFrame:
    """(key, tilt): lambda of each source, null where every document is taken ``cap`` times.

    ``counts`` is (key, size, n).  Newton on log(words taken) = log(target), kept within
    the bracket of the steps before.  A source's sizes are added up in their order, so reruns agree to the last bit."""
    scale = targets.select("key", "target", (F.col("source_size") / F.col("documents")).alias("mean"),
                           (F.col("target") >= cap * F.col("source_size")).alias("full"))
    points = counts.filter("size > 0").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("size", "n"))).alias("points"))
    none = F.lit(None).cast("double")

    def added(sums: Column, point: Column, tilt: Column) -> Column:
        x, here = point["size"] / F.col("mean"), point["n"] * point["size"]
        return _let(F.least(F.lit(float(cap)), F.exp(tilt * x)), lambda rate: F.struct(
            (sums["words"] + here * rate).alias("words"),
            (sums["slope"] + F.when(rate < cap, here * x * rate).otherwise(0.0)).alias("slope")))

    def moved(state: Column, sums: Column, gap: Column) -> Column:
        done = F.abs(gap) <= tolerance
        return _let(F.struct(F.when(gap > 0, state["tilt"]).otherwise(state["low"]).alias("low"),
                             F.when(gap <= 0, state["tilt"]).otherwise(state["high"]).alias("high"),
                             F.when(sums["slope"] > 0, state["tilt"] + gap * sums["words"] / sums["slope"]).alias("step")),
                    lambda to: F.struct(
                        F.when(done, state["tilt"]).when(_inside(to), to["step"]).otherwise(_aside(to)).alias("tilt"),
                        to["low"].alias("low"), to["high"].alias("high"), done.alias("done")))

    def step(state: Column, _) -> Column:
        sums = F.aggregate("points", F.struct(F.lit(0.0).alias("words"), F.lit(0.0).alias("slope")),
                           lambda sums, point: added(sums, point, state["tilt"]))
        return F.when(state["done"], state).otherwise(
            _let(sums, lambda sums: _let(F.log(F.col("target") / sums["words"]), lambda gap: moved(state, sums, gap))))

    start = F.struct(F.lit(0.0).alias("tilt"), none.alias("low"), none.alias("high"), F.lit(False).alias("done"))
    found = scale.filter("not full").join(points, "key").select("key", F.aggregate(
        F.sequence(F.lit(1), F.lit(MAX_STEPS)), start, step, lambda state: state["tilt"]).alias("tilt"))
    return scale.select("key").join(found, "key", "left")


def _inside(to: Column) -> Column:
    """Whether a step stays within its bracket."""
    return (to["step"].isNotNull() & (to["low"].isNull() | (to["step"] > to["low"]))
            & (to["high"].isNull() | (to["step"] < to["high"])))


def _aside(to: Column) -> Column:
    """A step that widens the bracket, or halves it."""
    return (F.when(to["low"].isNull(), 2 * F.least(to["high"], F.lit(-1.0)))
            .when(to["high"].isNull(), 2 * F.greatest(to["low"], F.lit(1.0)))
            .otherwise((to["low"] + to["high"]) / 2))


def _with_source(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """Rows with the columns of their source; a large source's rows are dealt out."""
    spread = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.hash("size", "nr"), F.lit(SALTS))).join(spread, ["key", "salt"]).drop("salt")


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2) -> DataFrame:
    """(id, source, size, source_size, target, rate, copies, taken) of every document."""
    source = F.col(source_col).cast("string")
    docs = checkpointed(df.select(
        F.col(id_col).alias("id"), source.alias("source"), F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("key"),
        words(F.col(text_col)).alias("size"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("order")))
    targets = checkpointed(source_targets(docs.select("key", "source", "size"), weights, share, cap))
    counts = checkpointed(docs.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")))
    mean = F.col("source_size") / F.col("documents")
    # no word in the source: nothing to tilt, every document once
    rate = F.when(F.col("source_size") == 0, F.lit(1.0)).otherwise(F.coalesce(
        F.least(F.lit(float(cap)), F.exp(F.col("tilt") * F.col("size") / mean)), F.lit(float(cap))))
    rates = counts.join(targets.join(tilts(counts, targets, cap), "key"), "key").withColumn("rate", rate)
    by_size = Window.partitionBy("key").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    rates = rates.select("key", "size", "n", "rate", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(by_size), F.lit(0.0)).alias("base"))

    # written, so that the join alone deals by (key, size) and a frequent size can be split
    blocked = checkpointed(docs.join(rates, ["key", "size"]).withColumn(
        "block", F.pmod("order", F.ceil(F.col("n") / BLOCK_ROWS)).cast("int")))
    blocks = blocked.groupBy("key", "size", "block").agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "before", F.coalesce(F.sum("rows").over(Window.partitionBy("key", "size").orderBy("block").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0))).drop("rows")
    ranked = blocked.join(blocks, ["key", "size", "block"]).withColumn(
        "nr", F.col("before") + F.row_number().over(Window.partitionBy("key", "size", "block").orderBy("order", "id")))
    upto = lambda k: F.floor(F.col("base") + k * F.col("rate") + 0.5)
    rounded = checkpointed(ranked.select(
        "id", "source", "key", "size", "rate", "nr", F.least(upto(F.col("nr")) - upto(F.col("nr") - 1), F.lit(cap)).alias("copies")))

    for _ in range(CORRECTIONS):
        missing = rounded.groupBy("key").agg(F.sum(F.col("copies") * F.col("size")).alias("taken")).join(targets, "key").select(
            "key", (F.col("target") - F.col("taken")).alias("missing"))
        change = F.when(F.col("missing") > 0, 1).otherwise(-1)
        able = F.when(F.col("missing") > 0, F.col("copies") < cap).otherwise(F.col("copies") > 0)
        left = F.abs(F.col("missing") - change * F.col("size"))
        best = (_with_source(rounded, missing).filter(able & (left < F.abs("missing"))).groupBy("key").agg(
            F.min(F.struct(left.alias("left"), F.col("size").alias("size"), F.col("nr").alias("nr"), change.alias("change"))).alias("best"))
            .select("key", F.col("best.size").alias("size"), F.col("best.nr").alias("nr"), F.col("best.change").alias("change")))
        rounded = rounded.join(best, ["key", "size", "nr"], "left").withColumn(
            "copies", F.col("copies") + F.coalesce("change", F.lit(0))).drop("change")
        rounded = checkpointed(rounded)
    return _with_source(rounded, targets.select("key", "source_size", "target")).select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "rate", "copies",
        (F.col("copies") * F.col("size")).alias("taken"))
