"""Mixing sources to target weights by systematic sampling.

A source's target is its share of all words by weight, but at most so many times its own words; what the limit
cuts off goes to the other sources by weight, until none is above. Each document of a source is expected
target / source_size times. Documents are laid out by size, their expected copies summed up, one offset per
source added, and a document is taken once for every whole number that its stretch of the sum passes. Laying out
by size makes the taken words follow the target closely, and no document is taken more often than the limit.

The running sum needs positions within a source, and a source may hold a third of all rows. So positions come
from counts: a source is cut into size bands and buckets of about bucket_rows rows, only the counts are summed up
along the source, and rows are ranked within their bucket.

The offset is a hash of the source name, so reruns agree. Nulls: a null source is a source of its own, the last
one; a null text has size 0. A source without words has target 0 and nothing is taken. Rows of equal size and id
are interchangeable; repeated rows are rows. Extra columns pass through.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from logspark.llm.frames import stored, unused

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), times: int = 3) -> DataFrame:
    """Rows (source, source_size) with the target of each source, in words.

    A source that reaches its limit does so in the order of size / weight, so with running sums in that order the
    level of the others is known at once: what is left of the total, over the weights that are left.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("n", F.row_number().over(by_name))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("n") - 1, F.lit(len(weights))) + 1).cast("int"))
    every = Window.partitionBy()
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "n")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    from_here = order.rowsBetween(0, Window.unboundedFollowing)
    summed = (
        ranked.withColumn("weight", weight.cast("bigint"))
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("left", F.col("total") - times * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(from_here))
        .withColumn("limited", times * F.col("source_size") * F.col("open") < F.col("left") * F.col("weight"))
    )
    level = F.min(F.when(~F.col("limited"), F.struct("n_order", "left", "open"))).over(every)
    summed = summed.withColumn("n_order", F.row_number().over(order)).withColumn("level", level)
    free = F.col("level.left") * F.col("weight") / F.col("level.open")
    return summed.select(
        "source", "source_size",
        F.coalesce(F.when(F.col("limited"), times * F.col("source_size")).otherwise(free), F.lit(0)).cast("double").alias("target"),
    )


def offset(source: Column) -> Column:
    """A number from 0 to 1 that depends on the source name alone."""
    return F.conv(F.substring(F.md5(F.coalesce(source, F.lit("\u0000")).cast("binary")), 1, 8), 16, 10).cast("double") / 2.0**32


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), times: int = 3, bucket_rows: int = 256,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", name: str = "mix",
) -> DataFrame:
    """The documents with a struct: size, source_size, target, copies. A column of that name is replaced."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)).cast("bigint"), F.lit(0).cast("bigint"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    sized = docs.select(whole, F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"))
    sized = sized.withColumn("band", F.length(F.bin("size")))
    bands = stored(sized.groupBy("source", "band").agg(F.count("*").alias("rows"), F.sum("size").alias("words")))
    levels = targets(bands.groupBy("source").agg(F.sum("words").alias("source_size")), weights, times)
    levels = levels.withColumnRenamed("source", "s")
    along = Window.partitionBy("source").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    plan = bands.withColumn("before", F.coalesce(F.sum("rows").over(along), F.lit(0)))
    plan = plan.join(levels, F.col("source").eqNullSafe(F.col("s"))).select(
        "s", F.col("source").alias("of"), F.col("band").alias("in_band"), "before", "source_size", "target",
        F.ceil(F.col("rows") / bucket_rows).cast("bigint").alias("buckets"),
    ).drop("s")
    rows = sized.join(plan, F.col("source").eqNullSafe(F.col("of")) & (F.col("band") == F.col("in_band"))).drop("of", "in_band")
    rows = rows.withColumn("bucket", F.pmod(F.coalesce("id", F.lit(0)), "buckets"))
    counts = stored(rows.groupBy("source", "band", "bucket").agg(F.count("*").alias("rows")))
    along = Window.partitionBy("source", "band").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        F.col("source").alias("of"), F.col("band").alias("in_band"), F.col("bucket").alias("in_bucket"),
        F.coalesce(F.sum("rows").over(along), F.lit(0)).alias("earlier"),
    )
    rows = rows.join(counts, F.col("source").eqNullSafe(F.col("of")) & (F.col("band") == F.col("in_band"))
                     & (F.col("bucket") == F.col("in_bucket")))
    within = Window.partitionBy("source", "band", "bucket").orderBy("size", F.col("id").asc_nulls_first())
    position = F.col("before") + F.col("earlier") + F.row_number().over(within)
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    u = offset(F.col("source"))
    copies = (F.floor(position * share + u) - F.floor((position - 1) * share + u)).cast("bigint")
    return rows.select(
        *[F.col(f"row.`{c}`") for c in docs.columns if c != name],
        F.struct("size", "source_size", "target", copies.alias("copies")).alias(name),
    )


def repeated(docs: DataFrame, name: str = "mix", **more) -> DataFrame:
    """The mixed documents: each row as often as it is taken."""
    extra = unused(docs, name)
    mixed = mix(docs, name=extra, **more).where(F.col(f"{extra}.copies") > 0)
    each = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(f"{extra}.copies")))
    return mixed.withColumn(extra, each).drop(extra)
