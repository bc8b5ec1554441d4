"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from hostvigil.llm.common import SPACED_WORD, named, share_broadcast, without
from hostvigil.session import materialize

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
KEY_BUCKETS = 1 << 16
MAX_SHARED_SOURCES, MAX_SHARED_BORDER = 10_000, 200_000
OUTPUT = ("size", "source_size", "target", "taken")


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """Between 0.25 and 1: words of three to nine characters on average weigh most, by distance from six."""
    mean = F.length(text) / F.greatest(size, F.lit(1)) - 1
    return F.coalesce(F.greatest(F.lit(0.25), 1 - F.abs(mean - 6) / 12), F.lit(0.25))


def uniform(key: Column, text: Column, seed: int) -> Column:
    """A number between 0 and 1, the same in every run: 52 bits of the MD5 of seed, key and text digest."""
    name = F.concat_ws("|", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("-")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return (F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """Add rank, weight and target to a table (source, source_size) with one row per source.

    Sources are ranked by code point, null last; ranks come from positions inside ranges of the sorted sources and the
    sizes of the ranges before. Weights repeat along the ranks. The words of all sources are shared by weight; what
    exceeds ``most`` times a source's size goes to the others by weight, round by round, until nothing exceeds.
    """
    ranged = materialize(sizes.repartitionByRange(F.asc_nulls_last("source")).withColumn("part", F.spark_partition_id()), "source-ranges")
    ahead = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    ahead = ahead.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))  # one row per range
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_last("source"))) - 1
    ranked = ranged.withColumn("inside", inside).join(ahead, "part")
    order = (F.col("ahead") + F.col("inside")).alias("rank")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    table = ranked.select("source", "source_size", order).withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")))
    table = materialize(table.withColumn("full", F.lit(False)), "source-weights")
    total = table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    while True:
        open_weight, full_size = table.agg(F.sum(F.when(~F.col("full"), F.col("weight"))), F.coalesce(F.sum(F.when(F.col("full"), F.col("source_size"))), F.lit(0))).first()
        rest = float(total - most * full_size)
        share = F.lit(rest) * F.col("weight") / F.lit(open_weight or 1.0)
        above = ~F.col("full") & (share > most * F.col("source_size"))
        if not open_weight or not table.where(above).limit(1).count():
            break
        table = materialize(table.withColumn("full", F.col("full") | above), "source-weights")
    target = F.when(F.col("full"), (most * F.col("source_size")).cast("double")).otherwise(share)
    return materialize(table.select("source", "source_size", "rank", "weight", target.alias("target")), "source-targets")


def running_sums(cells: DataFrame, width: int = 256) -> DataFrame:
    """(s, bucket, n, upto): running sums over the buckets of each source, in two levels.

    Buckets are summed by groups of ``width``, the groups are summed along, and the buckets along within their group, so
    a window holds KEY_BUCKETS / width rows at most, or ``width``.
    """
    fine = cells.select(F.col("source").alias("s"), "bucket", "n", F.floor(F.col("bucket") / width).cast("int").alias("g"))
    groups = fine.groupBy("s", "g").agg(F.sum("n").alias("all"))
    ahead = F.sum("all").over(Window.partitionBy("s").orderBy("g").rowsBetween(Window.unboundedPreceding, 0)) - F.col("all")
    groups = groups.select(F.col("s").alias("of"), F.col("g").alias("at"), ahead.alias("ahead"))
    inside = F.sum("n").over(Window.partitionBy("s", "g").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    joined = fine.withColumn("inside", inside).join(groups, F.col("s").eqNullSafe(F.col("of")) & (F.col("g") == F.col("at")))
    return joined.select("s", "bucket", "n", (F.col("ahead") + F.col("inside")).alias("upto"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, seed: int = 42, quality: Column | None = None, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Add size, source_size, target and taken to every row.

    taken is the number of words the mix takes of a document. A source whose target is e times its size and a rest
    takes every document e times, then documents in the order of u^(1/w), greatest first, where u is a fixed random number
    of the row and w its quality weight, until the rest is used up; the document on the border is taken in part. So the
    taken words of a source add up to its target, rounded, and no document is taken beyond ``most`` times its size.
    Null texts have size 0 and are taken 0 times; a null source is a source of its own; repeated rows are mixed as rows.
    Columns of these four names are replaced; ``columns`` names the columns to keep (default: all).

    The order inside a source is found by buckets of the sampling number: sizes are summed per (source, bucket), running
    sums over buckets tell whether a bucket is taken, and only the one bucket on the border of a source is sorted. No
    task sorts a source.
    """
    rows = without(docs, *OUTPUT)
    kept = list(columns) if columns is not None else rows.columns
    own, plain = named(text).cast("string"), F.col("text")
    # The caller's columns travel in one struct, so no name of theirs can meet one of these.
    given = rows.select(F.struct(*[named(c) for c in kept]).alias("doc"), named(source).alias("source"), named(key).alias("key"), own.alias("text"), word_count(own).alias("size"), (F.lit(0.0) if quality is None else quality).alias("weight"))
    given = given.withColumn("weight", quality_weight(plain, F.col("size"))) if quality is None else given
    draw = F.pow(uniform(F.col("key"), plain, seed), 1 / F.col("weight"))
    sized = given.withColumn("_hv_draw", draw).withColumn("_hv_bucket", F.least(F.floor((1 - F.col("_hv_draw")) * KEY_BUCKETS), F.lit(KEY_BUCKETS - 1)).cast("int"))
    sized = sized.select("doc", F.col("source").alias("_hv_source"), F.col("size").alias("_hv_size"), "_hv_draw", "_hv_bucket", F.monotonically_increasing_id().alias("_hv_row"))
    sized = materialize(sized, "sized")
    cells = sized.groupBy(F.col("_hv_source").alias("source"), F.col("_hv_bucket").alias("bucket")).agg(F.sum("_hv_size").alias("n"))
    cells = materialize(cells, "source-buckets")
    targets = source_targets(cells.groupBy("source").agg(F.sum("n").alias("source_size")), weights, most)
    plan = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0).cast("long"))
    plan = plan.withColumn("rest", F.when(F.col("epochs") >= most, F.lit(0)).otherwise(F.round(F.col("target") - F.col("epochs") * F.col("source_size"))).cast("long"))
    border = running_sums(cells)
    joined = plan.join(border, plan["source"].eqNullSafe(border["s"]), "left")
    first = joined.where(F.col("upto") >= F.col("rest")).groupBy("source").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"))).alias("b"))
    plan = plan.join(first.withColumnRenamed("source", "s"), plan["source"].eqNullSafe(F.col("s")), "left").drop("s")
    plan = materialize(plan.select(F.col("source").alias("_hv_of"), "source_size", "target", "epochs", "rest", F.coalesce("b.bucket", F.lit(-1)).alias("edge"), F.coalesce("b.before", F.lit(0)).alias("before")), "mix-plan")
    planned = sized.join(share_broadcast(plan, MAX_SHARED_SOURCES), F.col("_hv_source").eqNullSafe(F.col("_hv_of")))
    edge = planned.where("_hv_bucket = edge and rest > 0").select("_hv_of", "_hv_row", "_hv_size", "_hv_draw", "rest", "before")
    order = Window.partitionBy("_hv_of").orderBy(F.desc("_hv_draw"), "_hv_row").rowsBetween(Window.unboundedPreceding, 0)
    ahead = F.sum("_hv_size").over(order) - F.col("_hv_size") + F.col("before")
    partly = edge.withColumn("_hv_part", F.greatest(F.lit(0), F.least(F.col("_hv_size"), F.col("rest") - ahead))).select("_hv_row", "_hv_part")
    partly = materialize(partly, "mix-border")
    out = planned.join(share_broadcast(partly, MAX_SHARED_BORDER), "_hv_row", "left")
    once = F.when(F.col("_hv_part").isNotNull(), F.col("_hv_part")).when((F.col("rest") > 0) & (F.col("_hv_bucket") < F.col("edge")), F.col("_hv_size")).otherwise(0)
    return out.select("doc.*", F.col("_hv_size").alias("size"), "source_size", "target", (F.col("epochs") * F.col("_hv_size") + once).cast("long").alias("taken"))
