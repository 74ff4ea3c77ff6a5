"""Correlation, simple regression and residual outliers over per-site tables."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perexpo.operators.rates import top_k
from perexpo.sources.tables import materialize

#: Ranks of columns with few values, one for each partner and value, are broadcast up to this number in all.
BROADCAST_NUMBERS = 1_000_000


def _corr(x: Column, y: Column) -> Column:
    """Linear correlation over the rows where both are known; NULL where a column does not vary."""
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.try_divide(F.covar_pop(x, y), spread)


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """Linear correlation over the rows where both are known."""
    return df.agg(_corr(F.col(x), F.col(y)).alias("pearson"), F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).alias("n"))


def _ranked(counts: DataFrame) -> DataFrame:
    """(v, rank) from (v, n), one row per value: the average rank of the n rows that hold it.

    Values are dealt out by range, so a running sum in each part and the totals of the parts
    before it give the rank. A value that holds many rows is one row here. The number of parts
    follows the session's setting, so no part has to grow with the table; the driver reads the
    totals, one number per part.
    """
    parts = counts.repartitionByRange("v").withColumn("part", F.spark_partition_id())
    parts = materialize(parts, "ranges")
    totals = {r["part"]: r["total"] for r in parts.groupBy("part").agg(F.sum("n").alias("total")).collect()}
    starts = F.lit([sum(n for p, n in totals.items() if p < i) for i in range(max(totals, default=0) + 1)])
    inside = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    below = F.get(starts, F.col("part")) + F.coalesce(F.sum("n").over(inside), F.lit(0))
    return parts.select("v", (below + (F.col("n") + 1) / 2).alias("rank"))


def average_ranks(df: DataFrame, outs: Mapping[str, str]) -> DataFrame:
    """Rank of each value, ties sharing the average of their ranks; NULL has none.

    ``outs`` maps each column to the name of its rank. Only the different values with their
    numbers of rows are put in order; the ranks come back by a join on the value, in which a
    value with many rows is a skewed key with a single match.
    """
    for c, out in outs.items():
        known = df.where(F.col(c).isNotNull())
        ranks = _ranked(known.groupBy(F.col(c).alias("v")).agg(F.count("*").alias("n")))
        ranks = ranks.select(F.col("v").alias("_v"), F.col("rank").cast("double").alias(out))
        joined = known.join(ranks, F.col(c) == F.col("_v"), "left").drop("_v")
        df = joined.unionByName(df.where(F.col(c).isNull()), allowMissingColumns=True)
    return df


def average_rank(df: DataFrame, col: str, out: str) -> DataFrame:
    return average_ranks(df, {col: out})


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation over the rows where both are known.

    The rows become different pairs with their numbers first; ranks, and the sums of the
    correlation, are weighted by these. The mean of average ranks is (n + 1) / 2.
    """
    pairs = materialize(
        df.select(F.col(x).alias("x"), F.col(y).alias("y")).dropna().groupBy("x", "y").agg(F.count("*").alias("n")),
        "pairs",
    )
    ranked = pairs
    for c in ("x", "y"):
        ranks = _ranked(pairs.groupBy(F.col(c).alias("v")).agg(F.sum("n").alias("n")))
        ranked = ranked.join(ranks.select(F.col("v").alias(c), F.col("rank").alias(f"r{c}")), c)
    total = pairs.agg(F.sum("n").alias("n")).scalar()
    middle = (total + 1) / 2
    w, a, b = F.col("n").cast("double"), F.col("rx") - middle, F.col("ry") - middle
    sums = ranked.agg(
        F.sum(w * a * b).alias("ab"), F.sum(w * a * a).alias("aa"), F.sum(w * b * b).alias("bb"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")
    )
    return sums.select(F.try_divide(F.col("ab"), F.sqrt("aa") * F.sqrt("bb")).alias("spearman"), "n")


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x, y, pearson, spearman, n) for every two of the columns, each over the rows where both are known.

    The values of all columns are ranked together, in one pass over (column, value): a value
    counts once for every partner column, by the rows in which that partner is known, because those
    are the rows its rank is among. What is multiplied are deviations from the mean, of values and of
    ranks. Of two columns, the one with more different values is ``c`` below: the rows get its ranks,
    which are summed up by the values of the partner, and only these sums meet the partner's ranks.
    Ranks of columns with few values are broadcast; for the others a row is shuffled once
    per column, whatever the number of partners. The driver reads, for each two columns, the number
    of rows and the means, and for each column its number of different values.
    """
    p, names = len(cols), list(cols)
    each = range(p)
    rows = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(names)])
    melted = rows.select(
        *[F.col(f"c{j}").isNotNull().alias(f"k{j}") for j in each], F.posexplode(F.array(*[f"c{i}" for i in each])).alias("c", "v")
    ).where(F.col("v").isNotNull())
    counts = melted.groupBy("c", "v").agg(*[F.count_if(f"k{j}").alias(f"n{j}") for j in each])
    ranks, facts = _partner_ranks(counts, p)
    means = F.array(*[F.lit(m).cast("double") for c in each for m in facts[c]["means"]])

    def off(v: Column, c: Column, partner: Column) -> Column:
        return v - F.get(means, c * p + partner)

    order = sorted(each, key=lambda c: (facts[c]["n_values"], c))
    few, numbers = set(), 0
    for c in order:
        numbers += p * facts[c]["n_values"]
        if numbers <= BROADCAST_NUMBERS:
            few.add(c)

    def ranks_of(some: set[int]) -> DataFrame:
        found = ranks.where(F.col("c").isin(*some)).select("c", "v", "ranks")
        return F.broadcast(found) if some <= few else found

    c, v, partner, u = F.col("c"), F.col("v"), F.col("partner"), F.col("u")
    paired = F.array(*[F.lit(order.index(j) < order.index(i)) for i in each for j in each])
    sums = []
    for some in (few, set(each) - few):
        if some:
            of_rows = rows.select("*", F.posexplode(F.array(*[F.when(F.lit(i in some), F.col(f"c{i}")) for i in each])).alias("c", "v"))
            placed = of_rows.where(v.isNotNull()).join(ranks_of(some), ["c", "v"])
            met = placed.select("c", "v", "ranks", F.posexplode(F.array(*[f"c{i}" for i in each])).alias("partner", "u"))
            met = met.where(u.isNotNull() & F.get(paired, c * p + partner))
            sums.append(
                met.groupBy("c", "partner", "u").agg(
                    F.sum(F.get("ranks", partner)).alias("r"), F.sum(off(v, c, partner) * off(u, partner, c)).alias("l")
                )
            )
    summed = functools.reduce(DataFrame.unionByName, sums)
    others = ranks_of(set(order[:-1])).select(c.alias("partner"), v.alias("u"), "ranks")
    products = summed.join(others, ["partner", "u"]).groupBy("c", "partner").agg(
        F.sum(F.get("ranks", c) * F.col("r")).alias("rr"), F.sum("l").alias("ll")
    )
    squares = ranks.select("c", "v", "ranks", F.posexplode("ns").alias("partner", "n")).where(F.col("n") > 0)
    w, a, d = F.col("n").cast("double"), F.get("ranks", partner), off(v, c, partner)
    squares = squares.groupBy("c", "partner").agg(F.sum(w * a * a).alias("rr"), F.sum(w * d * d).alias("ll"))
    i, j = F.least("c", "partner").alias("i"), F.greatest("c", "partner").alias("j")
    moments = products.select(i, j, F.lit(2).alias("side"), "rr", "ll").unionByName(
        squares.select(i, j, (c > partner).cast("int").alias("side"), "rr", "ll")
    )
    of = {(m, at): F.sum(F.when(F.col("side") == at, F.col(m))) for m in ("rr", "ll") for at in range(3)}
    found = moments.groupBy("i", "j").agg(
        *[F.try_divide(of[m, 2], F.sqrt(of[m, 0]) * F.sqrt(of[m, 1])).alias(r) for m, r in (("ll", "pearson"), ("rr", "spearman"))]
    )
    labels = [
        F.struct(*[F.lit(of).alias(name) for of, name in ((i, "i"), (j, "j"), (names[i], "x"), (names[j], "y"))],
                 F.lit(facts[i]["sizes"][j]).cast("long").alias("n"))
        for i in each
        for j in range(i + 1, p)
    ]
    listed = df.sparkSession.range(1).select(F.inline(F.array(*labels)))
    return listed.join(F.broadcast(found), ["i", "j"], "left").select("x", "y", "pearson", "spearman", "n")


def _partner_ranks(counts: DataFrame, p: int) -> tuple[DataFrame, dict[int, dict]]:
    """(c, v, ns, ranks) from (c, v, n0, n1, ...), and for each column its number of values, and by partner its rows and mean.

    ``ranks`` holds for each partner how far the average rank of v in column c is from the mean rank.
    Columns and values are dealt out by range together; a running sum in each part and the
    totals of the parts before it give the ranks of all columns at once.
    """
    parts = materialize(counts.repartitionByRange("c", "v").withColumn("part", F.spark_partition_id()), "column-ranges")
    each, held = range(p), [F.when(F.col(f"n{j}") > 0, F.col("v")) for j in range(p)]
    totals = parts.groupBy("c", "part").agg(
        F.count("*").alias("n_values"),
        *[F.sum(f"n{j}").alias(f"t{j}") for j in each],
        *[F.sum(held[j] * F.col(f"n{j}")).alias(f"sum{j}") for j in each],
        *[F.min(held[j]).alias(f"min{j}") for j in each],
        *[F.max(held[j]).alias(f"max{j}") for j in each],
    )
    totals = materialize(totals, "column-totals")
    # Rounded, the mean of equal values may be another number than they are.
    mean = [F.greatest(F.min(f"min{j}"), F.least(F.max(f"max{j}"), F.sum(f"sum{j}") / F.sum(f"t{j}"))) for j in each]
    facts = totals.groupBy("c").agg(
        F.sum("n_values").alias("n_values"),
        F.array(*[F.sum(f"t{j}") for j in each]).alias("sizes"),
        F.array(*[F.when(F.sum(f"t{j}") > 0, mean[j]) for j in each]).alias("means"),
    )
    read = {c: {"n_values": 0, "sizes": [0] * p, "means": [None] * p} for c in each}
    read |= {r["c"]: r.asDict() for r in facts.collect()}
    # A column has one row here for each part that it touches.
    earlier = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("c")
    starts = totals.select(
        "c",
        "part",
        *[F.coalesce(F.sum(f"t{j}").over(earlier), F.lit(0)).alias(f"s{j}") for j in each],
        *[F.sum(f"t{j}").over(whole).alias(f"size{j}") for j in each],
    )
    inside = Window.partitionBy("c", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = parts.select("c", "part", "v", *[f"n{j}" for j in each], *[F.sum(f"n{j}").over(inside).alias(f"b{j}") for j in each])
    rank = [F.col(f"s{j}") + F.coalesce(f"b{j}", F.lit(0)) + (F.col(f"n{j}") - F.col(f"size{j}")) / 2 for j in each]
    ranked = ranked.join(starts, ["c", "part"]).select("c", "v", *[f"n{j}" for j in each], *[r.alias(f"r{j}") for j, r in enumerate(rank)])
    # Written column by column: lists of numbers take several times as long.
    flat = materialize(ranked, "column-ranks")
    return flat.select("c", "v", F.array(*[f"n{j}" for j in each]).alias("ns"), F.array(*[f"r{j}" for j in each]).alias("ranks")), read


def log10(df: DataFrame, col: str, out: str) -> DataFrame:
    return df.withColumn(out, F.log10(F.col(col)))


def _fit(x: str, y: str) -> Column:
    return F.struct(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def ols(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line of ``y`` on ``x``."""
    return df.agg(_fit(x, y).alias("fit"), F.regr_count(y, x).alias("n")).select("fit.slope", "fit.intercept", "n")


def with_residuals(df: DataFrame, models: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """Fitted value and what is left of the observation, per row, for several lines.

    ``models`` lists (x, y, name of the fitted value, name of the residual). All lines are
    fitted in one pass; their coefficients enter the projection as a one-row subquery.
    """
    fits = df.agg(F.struct(*[_fit(x, y).alias(res) for x, y, _, res in models]).alias("fits"))
    out = df.withColumn("_fits", fits.scalar())
    for x, y, expected, residual in models:
        line = F.col("_fits")[residual]
        out = out.withColumn(expected, line["intercept"] + line["slope"] * F.col(x)).withColumn(
            residual, F.col(y) - F.col(expected)
        )
    return out.drop("_fits")


def with_residual(df: DataFrame, x: str, y: str, expected: str, residual: str) -> DataFrame:
    return with_residuals(df, [(x, y, expected, residual)])


def residual_table(attr_set: DataFrame) -> DataFrame:
    """Both models on one sample: rate on log exposure, and rate on the attribute."""
    return with_residuals(
        log10(attr_set, "exposure", "log_exposure"),
        [
            ("log_exposure", "rate", "expected_from_exposure", "exposure_residual"),
            ("attr", "rate", "expected_from_attr", "attr_residual"),
        ],
    )


def residual_outliers(residuals: DataFrame, col: str, k: int = 10, side: str = "above") -> DataFrame:
    """The ``k`` sites farthest above or below what the model expects."""
    return top_k(residuals, col, k, ascending=side == "below")
