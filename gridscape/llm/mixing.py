"""Mixing sources to target weights: a time-varying curriculum, in DataFrame functions only.

Each source has a weight and a schedule: its rate of tokens at training time t in [0, 1] is proportional to 1 + slope * (2t - 1), which integrates
to the cumulative demand D(t) = target * ((1 - slope) t + slope t^2). A source's documents, in the order of a hash and repeated in passes
until the target is met, each begin at a cumulative offset; the training position of a document is D^-1 of that offset, found by
the quadratic's closed form. Sorting by position by range gives the training order.

Documents are taken whole: the one at which a source's target ends is in the mix if at least half of it lies before that end.

Prefix sums never gather a source in one task: documents fall by hash into buckets of a bounded expected size, whose sums are added up first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridscape.llm.common import WORD_PATTERN, cut, named

BUCKET_ROWS = 2_000
PASSES = 3


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = PASSES) -> DataFrame:
    """source, source_size, weight, target of (source, source_size): shares by weight of the sum of all sizes, none above `most` times its size.

    Sources by code point, null last, take the weights in turn. Filling up: by the ratio of cap to weight, sources reach their caps in order,
    and the rest share what is left by weight, so one pass of running sums gives the limit of resharing.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("k", F.row_number().over(order) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("k") % len(weights) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("cap", F.col("source_size") * most)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "k")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    ranked = (
        ranked.withColumn("left", F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weights_left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("capped", F.col("cap").cast("decimal(38,0)") * F.col("weights_left") < F.col("left").cast("decimal(38,0)") * F.col("weight"))
    )
    # the first uncapped source sees what all uncapped ones share
    rest = ranked.withColumn("first_free", F.min(F.when(~F.col("capped"), F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col("k").alias("i"), F.col("left").alias("l"), F.col("weights_left").alias("w")))).over(whole))
    share = (F.col("weight") * F.col("first_free.l")).cast("double") / F.col("first_free.w")
    return rest.select("source", "source_size", "weight", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), slopes: tuple[float, ...] = (0.0, 0.5, -0.5), *, seed: int = 8, most: int = PASSES, keep: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, passes, more, offset, and the columns named in `keep`.

    taken = passes * size + more: `passes` whole repeats, and `more`, either the size or 0, for the last pass. The document at which a source's target
    ends is taken if that brings the source nearer to its target, so taken words differ from the target by half of that document at most.
    A null text has size 0 and is taken 0 times; a null source is a source of its own, the last; documents of one id follow each other by size, and
    exact repeats each count. No words at all: targets are 0. Other columns, whatever their names, are left alone. An empty table gives an empty
    result. `slopes` is each source's schedule in turn, |slope| < 1.
    """
    extra = [named(c).alias(f"keep_{c}") for c in keep or []]
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    plain = [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words().alias("size"), key.alias("h")]
    sized = cut(docs.select(*plain))
    rows = docs.select(*plain, *extra) if extra else sized
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    goal = targets(by_source.select("source", "source_size"), weights, most).join(by_source.select(F.col("source").alias("s2"), "n"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    order = Window.orderBy(F.col("source").asc_nulls_last())
    slope = F.element_at(F.array(*[F.lit(float(s)) for s in slopes]), ((F.row_number().over(order) - 1) % len(slopes) + 1).cast("int"))
    goal = goal.select(F.col("source").alias("g_source"), "source_size", "target", F.greatest(F.lit(1), F.ceil(F.col("n") / BUCKET_ROWS)).cast("long").alias("buckets"), slope.alias("slope"))
    goal = cut(goal)
    # buckets are ranges of h, so (bucket, h) sorts as h does
    bucket = F.floor((F.conv(F.substring("h", 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))) * F.col("buckets")).cast("long")
    placed = lambda x: x.join(goal, F.col("source").eqNullSafe(F.col("g_source"))).drop("g_source").withColumn("bucket", bucket)
    sums = placed(sized).groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s2"), F.col("bucket").alias("b2"), F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)).alias("base"))
    rows = placed(rows).join(sums, F.col("source").eqNullSafe(F.col("s2")) & (F.col("bucket") == F.col("b2"))).drop("s2", "b2")
    inside = Window.partitionBy("source", "bucket").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    goal_words = F.floor("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(goal_words / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0).cast("long")
    rows = rows.withColumn("offset", offset).withColumn("passes", passes)
    middle = 2 * F.col("offset") + F.col("size")
    more = F.when(middle <= 2 * (goal_words - F.col("passes") * F.col("source_size")), F.col("size")).otherwise(0)
    rows = rows.withColumn("more", more.cast("long")).withColumn("taken", F.col("passes") * F.col("size") + F.col("more"))
    return rows.drop("bucket", "base", "buckets")


def position(offset: Column) -> Column:
    """t with D(t) = offset, of a row that has target and slope."""
    u = F.when(F.col("target") > 0, F.least(F.lit(1.0), offset / F.col("target"))).otherwise(0.0)
    b = 1 - F.col("slope")
    return F.when(F.col("slope") == 0, u).otherwise((F.sqrt(F.greatest(F.lit(0.0), b * b + 4 * F.col("slope") * u)) - b) / (2 * F.col("slope")))


def ordered(mixed: DataFrame) -> DataFrame:
    """The rows of `mix` with `position`, where a document's first repeat begins, sorted by range of it; documents not taken have none and come first."""
    placed = mixed.withColumn("position", F.when(F.col("taken") > 0, position(F.col("offset"))))
    return placed.repartitionByRange(F.col("position"), F.col("h")).sortWithinPartitions("position", "h")


def training_order(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), slopes: tuple[float, ...] = (0.0, 0.5, -0.5), *, seed: int = 8, most: int = PASSES) -> DataFrame:
    """The mix itself: the columns of docs, one row per document and pass, whole, sorted by range of training position.

    Written to files, the order is that of the part files and of the rows in them, which `common.in_written_order` brings back. A document beyond its
    source's target isn't there. Null and empty texts take no part. See `mix` for the other cases.
    """
    mixed = mix(docs, weights, slopes, seed=seed, most=most, keep=docs.columns)
    copies = mixed.where(F.col("taken") > 0).withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes") - F.when(F.col("more") > 0, 0).otherwise(1))))
    copies = copies.withColumn("position", position(F.col("pass") * F.col("source_size") + F.col("offset")))
    return copies.repartitionByRange(F.col("position"), F.col("h"), F.col("pass")).sortWithinPartitions("position", "h", "pass").select(*[named(f"keep_{c}").alias(c) for c in docs.columns])
