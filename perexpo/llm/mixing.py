"""Mixing sources to target weights by hash thresholds.

Every source gets a number of words. A document is taken whole, zero or more times: as
often as the target holds the whole source, and once more if its hash is below the
source's threshold. The threshold comes from histograms: the words of a source are summed
by the leading bits of the hash, the bucket in which the running sum passes the budget is
the boundary, and only that bucket's documents are looked at with the next bits. After the
last step a threshold decides every document, and taking them is a filter: nothing is
sorted, and no source is ever gathered in one task. Since thresholds are nested, a smaller
budget takes a subset of the documents.

Only built-in functions are used.

Defined cases: a null text has size 0, a null source is a source of its own and comes last.
Rows with the same doc_id share a hash and are taken or left together. Documents of size 0
are taken with the others. Without rows the result is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perexpo.llm.common import SPACE, stored

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
#: The hash has BITS * STEPS bits; one histogram has 2**BITS buckets for each source.
BITS = 12
STEPS = 4


def words(text: Column) -> Column:
    """Number of runs of characters other than white space."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("bigint")


def position(doc_id: Column) -> Column:
    """The document's place on the hash line: the first 48 bits of the MD5 of its id as text."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, BITS * STEPS // 4), 16, 10).cast("bigint")


def targets(
    sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """(source, source_size) and the words that the mix takes from each source.

    Weights repeat over the sources in order of code points. A source whose share would be
    above ``most`` times its size stops there, and the rest goes to the others by weight.
    With the sources in order of size by weight those that stop are the first ones, so
    running sums find the level of the others. The window sees one row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    place = (F.row_number().over(order) - 1) % len(weights)
    weighed = sources.withColumn("weight", F.get(F.array(*map(F.lit, weights)), place).cast("double")).withColumn(
        "cap", F.lit(most) * F.col("source_size")
    )
    full = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    after = full.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    left = F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / F.sum("weight").over(after)
    # The level rises with every source that stops and falls from the first that does not.
    found = weighed.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return found.select("source", "source_size", F.least("cap", F.col("weight") * F.col("level")).alias("target"))


def _sized(docs: DataFrame, text: str, source: str, doc_id: str) -> DataFrame:
    """The few columns that the histograms need; texts are read once."""
    return stored(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).cast("string").alias("source"),
            words(F.col(text)).alias("size"),
            position(F.col(doc_id)).alias("place"),
        ),
        "sizes",
    )


def _plan(rows: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """For every source its size, target, how often all of it is taken, and the limit below
    which a place is taken once more."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(1)
    plan = stored(
        targets(sizes, weights, share, most)
        .withColumn("times", whole.cast("int"))
        .withColumn("budget", F.col("target") - F.col("times") * F.col("source_size"))
        .withColumn("low", F.lit(0).cast("bigint")),
        "plan",
    )
    for step in range(1, STEPS + 1):
        plan = stored(_refined(rows, plan, step), "plan")
    return plan.select(F.col("source").alias("of"), "source_size", "target", F.col("times").alias("all"), F.col("low").alias("limit"))


def _times(place: Column, most: float) -> Column:
    once_more = F.when(place < F.col("limit"), 1).otherwise(0)
    return F.least(F.col("all") + once_more, F.lit(int(most)))


def mix(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, times) of every row; ``times`` is how often it is taken."""
    rows = _sized(docs, text, source, doc_id)
    joined = rows.join(_plan(rows, weights, share, most), F.col("source").eqNullSafe(F.col("of")))
    return joined.select(
        "doc_id", "source", "size", "source_size", "target", _times(F.col("place"), most).alias("times")
    )


def mixed(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    plan = _plan(_sized(docs, text, source, doc_id), weights, share, most)
    columns = docs.columns
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
    joined = own.join(plan, F.col(f"row.{source}").cast("string").eqNullSafe(F.col("of")))
    times = _times(position(F.col(f"row.{doc_id}")), most)
    taken = joined.select("row", F.explode(F.array_repeat(F.lit(0), times)))
    return taken.select(*[F.col(f"row.`{c}`").alias(c) for c in columns])


def _refined(rows: DataFrame, plan: DataFrame, step: int) -> DataFrame:
    """The plan with the lower end of the boundary bucket at one more step, and the budget left for it.

    At the last step a bucket holds single places, and the boundary itself is taken if that
    comes nearer to the budget.
    """
    width = 1 << (BITS * (STEPS - step))
    outer = width << BITS
    bounds = plan.select(F.col("source").alias("of"), F.col("low").alias("from"), "budget")
    inside = rows.join(
        bounds,
        F.col("source").eqNullSafe(F.col("of"))
        & (F.col("place") >= F.col("from"))
        & (F.col("place") < F.col("from") + outer),
    )
    bucket = F.floor((F.col("place") - F.col("from")) / width)
    histogram = inside.groupBy("of", "from", "budget", bucket.alias("bucket")).agg(F.sum("size").alias("n"))
    running = Window.partitionBy("of").orderBy("bucket")
    summed = histogram.withColumn("upto", F.sum("n").over(running)).withColumn("before", F.col("upto") - F.col("n"))
    if step < STEPS:
        passed = F.col("upto") <= F.col("budget")
    else:
        passed = F.col("upto") - F.col("budget") <= F.col("budget") - F.col("before")
    edge = summed.groupBy("of").agg(
        F.min(F.when(~passed, F.struct("bucket", "before"))).alias("at"),
        F.max(F.struct("bucket", F.col("upto").alias("before"))).alias("last"),
        F.first("from").alias("from"),
    )
    # Without a boundary all of the bucket is taken: the limit is the end of it.
    limit = F.coalesce(F.col("from") + F.col("at.bucket") * width, F.col("from") + outer)
    used = F.coalesce(F.col("at.before"), F.col("last.before"))
    found = edge.select("of", limit.cast("bigint").alias("new_low"), used.alias("used"))
    return plan.join(found, F.col("source").eqNullSafe(F.col("of")), "left").select(
        "source",
        "source_size",
        "target",
        "times",
        (F.col("budget") - F.coalesce("used", F.lit(0))).alias("budget"),
        F.coalesce("new_low", "low").alias("low"),
    )
