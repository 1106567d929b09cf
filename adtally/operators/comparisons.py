"""Comparing groups: two-way analysis of variance and Tukey's pairwise test.

Both start from one pass that leaves a count, a mean and a sum of squared
deviations per cell or group; the merging of partial deviations is the
engine's own, so large means do not cancel small spreads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from adtally.functions.columns import is_number
from adtally.operators.connected import check_connected
from adtally.session import materialize

#: The additive model is solved until its residual has shrunk by this factor; sums of squares are off by its square.
SOLVED = 1e-10

#: What may be left of the residual, computed anew from the solution; more is an error.
SOLUTION_ERROR = 1e-8

#: Groups in a block that pairs are made from, and the most tasks that make them.
PAIR_BLOCK = 128
PAIR_TASKS = 4_096


_SUMS = (
    "ss_both double, around_few double, around_many double, rss double, n long, cells long, first_levels long, "
    "second_levels long, ss_first double, ss_second double"
)


def _moments(frame: DataFrame, keys: list[str], y: str) -> DataFrame:
    rows = frame.select(*keys, F.col(y).cast("double").alias("_y")).where(is_number(F.col("_y"))).dropna(subset=keys)
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("_y").alias("mean"),
        (F.var_pop("_y") * F.count(F.lit(1))).alias("within"),
    )


def anova_two_way(frame: DataFrame, a: str, b: str, y: str) -> DataFrame:
    """``term, sum_sq, df, f`` of ``y ~ a + b + a:b``, type II, for any cell sizes.

    ``f`` is NULL where a term has no degrees of freedom, as with a factor of
    one level. Designs that fall apart into unconnected blocks are an error.
    """
    cells = materialize(_moments(frame, [a, b], y).select(F.col(a).alias("_a"), F.col(b).alias("_b"), "n", "mean", "within"), "cells")
    size = cells.agg(
        F.count_distinct("_a").alias("a"), F.count_distinct("_b").alias("b"),
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"),
    ).first()
    if not size["a"]:
        raise ValueError("no rows to compare")
    centred = cells.withColumn("mean", F.col("mean") - F.lit(size["mean"]))
    (many, first), (few, second) = (("_a", a), ("_b", b)) if size["b"] <= size["a"] else (("_b", b), ("_a", a))
    row = _additive_sums(centred, many, few, size[few[1:]])
    row |= {"first_levels": size[many[1:]], "second_levels": size[few[1:]]}
    row |= {"ss_first": row["around_few"] - row["ss_both"], "ss_second": row["around_many"] - row["ss_both"]}
    return _terms(frame.sparkSession.createDataFrame([row], _SUMS), first, second, a, b)


def _additive_sums(cells: DataFrame, many: str, few: str, levels: int) -> dict[str, float]:
    """Sums of squares of the additive model, for any numbers of levels.

    The effects of ``many`` are eliminated level by level. What is left are normal
    equations in the effects of ``few``, solved by conjugate gradients scaled by their diagonal:
    a product with their matrix is two grouped sums over the cells, so no matrix is ever made. A step
    writes one table, and the sums it needs are observed while that is written.
    """
    check_connected(cells.select(F.col(many).alias("group"), F.col(few).alias("node")), levels)
    weighted = F.sum(F.col("n") * F.col("value")) / F.sum("n")
    means = cells.groupBy(many).agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("level"), F.sum("n").alias("whole"))
    right = cells.join(means, many).groupBy(few).agg(
        F.sum(F.col("n") * (F.col("mean") - F.col("level"))).alias("r"),
        F.greatest(F.sum(F.col("n") - F.col("n") * F.col("n") / F.col("whole")), F.lit(1e-9)).alias("d"),
    )
    state, sums = _observed(right.select(few, F.lit(0.0).alias("x"), "r", "d", (F.col("r") / F.col("d")).alias("p")), rz=F.col("r") * F.col("r") / F.col("d"))
    left = start = sums["rz"]
    turns = 2 * levels + 20

    def times_matrix(name: str) -> DataFrame:
        spread = cells.join(state.select(few, F.col(name).alias("value")), few)
        of_level = spread.groupBy(many).agg(weighted.alias("level"))
        return spread.join(of_level, many).groupBy(few).agg(F.sum(F.col("n") * (F.col("value") - F.col("level"))).alias("product"))

    while start and left > SOLVED**2 * start and turns:
        step, sums = _observed(state.join(times_matrix("p"), few), along=F.col("p") * F.col("product"))
        if not sums["along"] or sums["along"] <= 0:
            break
        rate = left / sums["along"]
        moved = step.select(
            few, (F.col("x") + rate * F.col("p")).alias("x"), (F.col("r") - rate * F.col("product")).alias("r"), "d", "p"
        )
        now = moved.agg(F.sum(F.col("r") * F.col("r") / F.col("d"))).first()[0]
        state = moved.select(few, "x", "r", "d", (F.col("r") / F.col("d") + (now / left) * F.col("p")).alias("p"))
        left, turns = now, turns - 1
    effects = state.select(few, F.col("x").alias("value"), "d")
    around_few = cells.groupBy(few).agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean_few"))
    fitted = cells.join(effects, few).join(around_few, few)
    of_many = fitted.groupBy(many).agg(
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean_many"), weighted.alias("shift")
    )
    gap = F.col("mean") - F.col("value") - (F.col("mean_many") - F.col("shift"))
    by_few = fitted.join(of_many, many).groupBy(few, "d").agg(
        F.sum(F.col("n") * gap).alias("missed"),
        F.sum(F.col("n") * gap * gap).alias("ss_both"),
        F.sum(F.col("n") * (F.col("mean") - F.col("mean_few")) ** 2).alias("around_few"),
        F.sum(F.col("n") * (F.col("mean") - F.col("mean_many")) ** 2).alias("around_many"),
        F.sum("within").alias("rss"),
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("cells"),
    )
    sums = ("ss_both", "around_few", "around_many", "rss", "n", "cells")
    row = by_few.agg(*[F.sum(name).alias(name) for name in sums], F.sum(F.col("missed") ** 2 / F.col("d")).alias("missed")).first()
    # What the solution leaves of the normal equations, computed from the fit itself.
    if not row["missed"] <= SOLUTION_ERROR**2 * start:
        raise ArithmeticError(f"the additive model is not solved: a residual of {(row['missed'] / start) ** 0.5:.1e} is left")
    return row.asDict()


def _observed(frame: DataFrame, **each: Column) -> tuple[DataFrame, dict[str, float]]:
    """The frame written as a table, with its number of rows and sums over them taken on the way."""
    seen = Observation()
    sums = [F.sum(column).alias(name) for name, column in each.items()]
    written = materialize(frame.observe(seen, *sums), "effects")
    return written, {name: value or 0.0 for name, value in seen.get.items()}


def _terms(sums: DataFrame, first: str, second: str, a: str, b: str) -> DataFrame:
    """One row of sums to one row per term."""
    df_first, df_second = F.col("first_levels") - 1, F.col("second_levels") - 1
    df_both = F.col("cells") - F.col("first_levels") - F.col("second_levels") + 1
    df_rest = F.col("n") - F.col("cells")

    def term(name: str, sum_sq: str, df: Column, tested: bool = True) -> Column:
        ratio = (F.col(sum_sq) / df) / (F.col("rss") / df_rest)
        usable = F.lit(tested) & (df > 0) & (df_rest > 0) & (F.col("rss") > 0)
        return F.struct(
            F.lit(name).alias("term"),
            F.when(df > 0, F.col(sum_sq)).otherwise(F.lit(0.0)).alias("sum_sq"),
            df.cast("bigint").alias("df"),
            F.when(usable, ratio).alias("f"),
        )

    return sums.select(
        F.inline(
            F.array(
                term(first, "ss_first", df_first),
                term(second, "ss_second", df_second),
                term(f"{a}:{b}", "ss_both", df_both),
                term("Residual", "rss", df_rest, tested=False),
            )
        )
    )


def _pairs(groups: DataFrame, number: int) -> DataFrame:
    """Every pair of groups once, as ``one`` and ``two`` in the order of their names.

    Groups are put into blocks by a hash, and each pair of blocks is a cell of a triangular grid, made
    by one task: a group is sent to as many cells as there are blocks. Their number follows from that of the groups, so tasks
    are many when pairs are, however few bytes the groups have.
    """
    blocks = max(1, -(-number // PAIR_BLOCK))
    tasks = min(blocks * (blocks + 1) // 2, PAIR_TASKS)
    placed = groups.select(F.struct("name", "n", "mean").alias("it"), F.pmod(F.xxhash64("name"), F.lit(blocks)).cast("int").alias("block"))
    row = placed.select("it", F.col("block").alias("row"), F.explode(F.sequence("block", F.lit(blocks - 1))).alias("column"))
    column = placed.select("it", F.explode(F.sequence(F.lit(0), "block")).alias("row"), F.col("block").alias("column"))
    left = row.withColumnRenamed("it", "left").repartition(tasks, "row", "column")
    right = column.withColumnRenamed("it", "right").repartition(tasks, "row", "column")
    met = left.join(right, ["row", "column"]).where((F.col("row") < F.col("column")) | (F.col("left.name") < F.col("right.name")))
    turned = F.col("left.name") > F.col("right.name")
    return met.select(F.when(turned, F.col("right")).otherwise(F.col("left")).alias("one"), F.when(turned, F.col("left")).otherwise(F.col("right")).alias("two"))


def tukey_hsd(frame: DataFrame, group: str, y: str, q_critical: float) -> DataFrame:
    """Every pair of groups compared: mean difference, interval, and whether it is significant.

    ``q_critical`` is the studentized range's critical value for the number of
    groups, the residual degrees of freedom and the level wanted.
    """
    groups = materialize(_moments(frame, [group], y).withColumnRenamed(group, "name"), "groups")
    totals = groups.agg((F.sum("n") - F.count(F.lit(1))).alias("df"), F.sum("within").alias("within"), F.count(F.lit(1)).alias("groups")).first()
    df = F.lit(totals["df"]).cast("bigint")
    pairs = _pairs(groups, totals["groups"] or 0)
    variance = F.lit(totals["within"]) / F.nullif(df, F.lit(0))
    scale = F.sqrt(variance / 2 * (1 / F.col("one.n") + 1 / F.col("two.n")))
    measured = pairs.select(
        F.col("one.name").alias("group1"),
        F.col("two.name").alias("group2"),
        (F.col("two.mean") - F.col("one.mean")).alias("meandiff"),
        scale.alias("scale"),
        df.alias("df"),
    ).withColumn("q", F.abs("meandiff") / F.nullif(F.col("scale"), F.lit(0.0)))
    half = F.lit(float(q_critical)) * F.col("scale")
    return measured.select(
        "group1",
        "group2",
        "meandiff",
        (F.col("meandiff") - half).alias("lower"),
        (F.col("meandiff") + half).alias("upper"),
        "q",
        "df",
        (F.col("q") > F.lit(float(q_critical))).alias("reject"),
    )
