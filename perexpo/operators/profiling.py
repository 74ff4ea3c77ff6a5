"""Data-quality checks. Each is one aggregate, so a table is scanned once per check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from perexpo.functions.cleaning import stored_type
from perexpo.functions.daytime import parse_timestamp
from perexpo.sources.tables import save


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("row_count"))


def domain(df: DataFrame, col: str) -> DataFrame:
    """Distinct values of a category, NULL included."""
    return df.select(col).distinct()


def value_range(df: DataFrame, col: str, ts_format: str | None = None) -> DataFrame:
    """Smallest and largest value as stored and, with a format, in time order.

    Text order of a month-first timestamp is not time order; both are shown side by side.
    """
    out = [F.min(col).alias("min_value"), F.max(col).alias("max_value")]
    if ts_format is not None:
        ts = parse_timestamp(col, ts_format)
        out += [F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts")]
    return df.agg(*out)


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Row count and NULLs of every listed column in one pass."""
    cols = df.columns if cols is None else cols
    return df.agg(
        F.count("*").alias("row_count"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in cols],
    )


def missing(df: DataFrame, col: str) -> DataFrame:
    """Number of rows without the key; the NULL test reaches the scan."""
    return df.where(F.col(col).isNull()).agg(F.count("*").alias("missing"))


def distinct_count(df: DataFrame, col: str, approx: bool = False) -> DataFrame:
    counter = F.approx_count_distinct if approx else F.count_distinct
    return df.agg(counter(F.col(col)).alias("distinct_values"))


def type_profile(df: DataFrame, col: str) -> DataFrame:
    """How many values of a text column really hold integers, decimals, text or nothing."""
    return df.groupBy(stored_type(col).alias("stored_type")).agg(F.count("*").alias("row_count"))


def unreadable(df: DataFrame, col: str, read: Column) -> DataFrame:
    """How many values of a text column a conversion makes NULL although they hold something."""
    lost = F.col(col).isNotNull() & read.isNull()
    return df.agg(F.count("*").alias("row_count"), F.count_if(lost).alias("unreadable"))


def dependency_counts(df: DataFrame, key: str, deps: Sequence[str]) -> DataFrame:
    """Per key, the number of distinct values of each dependent column.

    Repeated rows collapse before the shuffle (the first aggregate combines map-side), so
    the distinct counts run over combinations, not over facts, and a key that holds a
    large share of the rows costs no more than any other.
    """
    combos = df.select(key, *deps).distinct()
    return combos.groupBy(key).agg(*[F.count_distinct(F.col(d)).alias(f"n_{d}") for d in deps])


def fd_violations(df: DataFrame, key: str, deps: Sequence[str]) -> DataFrame:
    """Keys with more than one value in some dependent column; empty means key -> deps.

    The facts are read once: every row gives a (key, column, value) for each dependent
    column, repeats collapse before the shuffle, and the values of a key are counted by column.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def text(d: str) -> Column:
        """Equal exactly if the values are; the two zeros of a double are one value."""
        c = F.col(f"`{d}`")
        return (c + F.lit(0.0).cast(kinds[d]) if isinstance(kinds[d], (FloatType, DoubleType)) else c).cast("string")

    values = F.posexplode(F.array(*[text(d) for d in deps])).alias("_at", "_value")
    found = df.select(F.col(f"`{key}`").alias(key), values).where("_value IS NOT NULL").distinct()
    counts = found.groupBy(key).agg(*[F.count_if(F.col("_at") == i).alias(f"n_{d}") for i, d in enumerate(deps)])
    return counts.where(F.greatest(*[F.col(f"n_{d}") for d in deps], F.lit(0)) > 1)


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, worst first."""
    return (
        df.groupBy(*keys)
        .agg(F.count("*").alias("row_count"))
        .where(F.col("row_count") > 1)
        .orderBy(F.desc("row_count"), *keys)
    )


def group_sizes(df: DataFrame, key: str, col: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(col).alias("present"))


def coverage(df: DataFrame, key: str, col: str, expected: int) -> DataFrame:
    """Keys with fewer than the expected number of values."""
    return group_sizes(df, key, col).where(F.col("present") < expected)


def coverage_range(df: DataFrame, key: str, col: str) -> DataFrame:
    """Smallest and largest per-key coverage."""
    return group_sizes(df, key, col).agg(
        F.min("present").alias("min_present"), F.max("present").alias("max_present")
    )


def _totals(df: DataFrame, stage: str, measure: str | None) -> DataFrame:
    total = F.lit(0) if measure is None else F.sum(measure)
    return df.agg(F.count("*").alias("n"), total.cast("bigint").alias("m")).withColumn("stage", F.lit(stage))


def reconcile(
    before: DataFrame,
    after: DataFrame,
    before_measure: str | None = None,
    after_measure: str | None = None,
) -> DataFrame:
    """Rows and measure totals of two stages side by side, with verdicts."""
    both = _totals(before, "before", before_measure).unionByName(
        _totals(after, "after", after_measure)
    )

    def pick(stage: str, col: str) -> Column:
        return F.max(F.when(F.col("stage") == stage, F.col(col)))

    return both.agg(
        pick("before", "n").alias("rows_before"),
        pick("after", "n").alias("rows_after"),
        pick("before", "m").alias("measure_before"),
        pick("after", "m").alias("measure_after"),
    ).select(
        "*",
        (F.col("rows_before") == F.col("rows_after")).alias("rows_equal"),
        F.col("measure_before").eqNullSafe(F.col("measure_after")).alias("measure_equal"),
    )


def observed(df: DataFrame, name: str, measure: str) -> tuple[DataFrame, Observation]:
    """Totals gathered while ``df`` is being written, without a pass of their own."""
    seen = Observation(name)
    return (
        df.observe(seen, F.count("*").alias("rows"), F.sum(measure).cast("bigint").alias("measure")),
        seen,
    )


def row_checksum(df: DataFrame, cols: Sequence[str] | None = None) -> Column:
    """Aggregate over whole rows that neither order nor splitting changes, but any changed value does.

    Hashes add up as decimals, so repeated rows count as often as they occur and nothing overflows.
    """
    cols = df.columns if cols is None else cols
    return F.coalesce(F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in cols]).cast("decimal(20,0)")), F.lit(0)).cast("string")


def observed_write(df: DataFrame, path: str, measure: str, name: str) -> tuple[DataFrame, dict]:
    """Write ``df`` and gather rows, sum of the measure and checksum of the rows on the way.

    Returns the table as read back and the totals; nothing is read a second time for them.
    """
    seen = Observation(name)
    totals = [
        F.count("*").alias("rows"),
        F.sum(measure).cast("bigint").alias("measure"),
        row_checksum(df).alias("checksum"),
    ]
    stored = save(df.observe(seen, *totals), path)
    return stored, seen.get


def compare_totals(spark: SparkSession, before: dict, after: dict, stage: str) -> DataFrame:
    """One row: the totals of two observed stages and whether rows, measure and contents agree.

    Contents can differ although rows and measure agree, for instance after two values
    were swapped.
    """
    row = (
        stage,
        before["rows"],
        after["rows"],
        before["measure"],
        after["measure"],
        before["rows"] == after["rows"],
        before["measure"] == after["measure"],
        before["checksum"] == after["checksum"],
    )
    return spark.createDataFrame(
        [row],
        "stage string, rows_before bigint, rows_after bigint, measure_before bigint, measure_after bigint, "
        "rows_equal boolean, measure_equal boolean, contents_equal boolean",
    )


def summary(df: DataFrame, by: str | Column, measure: str, alias: str | None = None) -> DataFrame:
    """Groups with their number of rows and the sum of the measure, largest first."""
    key = F.col(by) if isinstance(by, str) else by
    if alias is not None:
        key = key.alias(alias)
    return (
        df.groupBy(key)
        .agg(F.count("*").alias("clusters"), F.sum(measure).cast("bigint").alias(measure))
        .orderBy(F.desc(measure))
    )


def missing_attribute(df: DataFrame, attr: str, cols: Sequence[str]) -> DataFrame:
    """Rows that lack the attribute."""
    return df.where(F.col(attr).isNull()).select(*cols)


def missing_raw_values(df: DataFrame, attr: str, raw: DataFrame, key: str) -> DataFrame:
    """The original rows behind missing attributes, to see what could not be read."""
    return raw.join(df.where(F.col(attr).isNull()).select(key), key, "left_semi")
