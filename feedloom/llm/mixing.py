"""Mixing sources to target weights by iterative proportional fitting (raking), in DataFrame functions only.

Documents are summed into cells (one value of every dimension). Raking scales the cells' token mass to the target shares
of one dimension after the other, round after round, until all marginals fit. A cell's factor is its fitted over its
observed mass. The draw is a hash of the document's id: the same document always falls the same way.

With a ``size``, a share of the observed mass, the targets are masses that sum up to it. No document stays more than once:
a value whose target is beyond its mass gives all it has, the other values share the rest, and the raking holds every
cell at its mass. The factor is the probability with which a cell's documents stay, so a rare value changes what the others
keep by no more than its own mass. ``reach`` tells what a value falls short of.

Without a size, the probability is the factor divided by the greatest factor of any cell. The expected mass then has the
target shares exactly, but one small cell with a great factor (a single short row of a new source) sets the rate of the
whole corpus. A single cell, or one document, stays whole only so.

Nulls in a dimension are the value ''. Every document weighs at least one token, so empty texts take part. Rows that
repeat an id are drawn alike.

Empty tables give no rows, other columns may have any name, and a text's length matters by its weight alone. Equal
cells get equal factors.
"""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from feedloom.session import stored

#: Rounds of raking; marginals that agree with each other fit to rounding after a few.
ROUNDS = 10
#: Rounds between two writes of the cells, which cut the lineage.
WRITE_EVERY = 5
#: Probabilities and draws are compared at this many decimal places.
PLACES = 9


def tempered(power: float):
    """Target shares proportional to the observed mass to a power: 1 keeps the mix, 0 makes all values equal."""

    def targets(cells: DataFrame, dim: str) -> DataFrame:
        mass = cells.groupBy(dim).agg(F.sum("mass").alias("seen"))
        return mass.select(dim, (F.pow("seen", F.lit(power)) / F.sum(F.pow("seen", F.lit(power))).over(
            Window.partitionBy())).alias(f"target_{dim}"))

    return targets


def shares(wanted: Mapping[str, float]):
    """Target shares by value; a value that is not named gets none, and shares are taken relative to their sum."""

    def targets(cells: DataFrame, dim: str) -> DataFrame:
        given = cells.sparkSession.createDataFrame(list(wanted.items()), f"{dim} string, share double")
        there = cells.select(dim).distinct().join(given, dim, "left").fillna(0.0, ["share"])
        return there.select(dim, (F.col("share") / F.sum("share").over(Window.partitionBy())).alias(f"target_{dim}"))

    return targets


def within_reach(cells: DataFrame, shares: DataFrame, dim: str, size: float) -> DataFrame:
    """Target masses instead of shares: ``size`` of all mass, where no value has more than its own mass; what it cannot
    take goes to the others by their shares."""
    share, name = F.col(f"target_{dim}"), f"target_{dim}"
    values = cells.groupBy(dim).agg(F.sum("mass").alias("seen")).join(shares, dim)
    # Values fill up in the order of mass to share: before the first that does not, all do.
    order = Window.orderBy(F.when(share > 0, F.col("seen") / share).otherwise(float("inf")), dim)
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    wanted = F.sum("seen").over(Window.partitionBy()) * size - F.coalesce(F.sum("seen").over(before), F.lit(0.0))
    left = F.sum(share).over(after)
    levels = values.withColumns({"wanted": wanted, "left": left}).withColumn(
        "level", F.when(F.col("left") > 0, F.col("wanted") / F.col("left")).otherwise(0.0))
    full = (share > 0) & (F.col("level") * share >= F.col("seen"))
    level = F.coalesce(F.max(F.when(~full, F.col("level"))).over(Window.partitionBy()), F.lit(0.0))
    return levels.select(dim, F.when(full, F.col("seen")).otherwise(F.greatest(F.lit(0.0), level) * share).alias(name))


def cell_factors(rows: DataFrame, targets: Mapping, rounds: int = ROUNDS, size: float | None = None) -> DataFrame:
    """One row per cell: the dimensions, ``mass`` and ``probability``. ``rows`` has the dimensions and ``weight``."""
    if size is not None and not 0 < size <= 1:
        raise ValueError("size is a share of the observed mass, above 0 and at most 1")
    dims = list(targets)
    cells = stored(rows.groupBy(*dims).agg(F.sum("weight").cast("double").alias("mass")))
    fitted = cells.withColumn("fit", F.col("mass"))
    for dim, target in targets.items():
        wanted = target(cells, dim)
        fitted = fitted.join(wanted if size is None else within_reach(cells, wanted, dim, size), dim)
    fitted = stored(fitted)
    for k in range(rounds):
        for dim in dims:
            total = F.sum("fit").over(Window.partitionBy(dim))
            fit = F.when(total > 0, F.col("fit") * F.col(f"target_{dim}") / total).otherwise(0.0)
            fitted = fitted.withColumn("fit", fit if size is None else F.least("mass", fit))
        if k % WRITE_EVERY == WRITE_EVERY - 1 or k == rounds - 1:
            fitted = stored(fitted)
    factor = F.col("fit") / F.col("mass")
    most = F.max("factor").over(Window.partitionBy()) if size is None else F.lit(1.0)
    return stored(fitted.select(*dims, "mass", factor.alias("factor")).withColumn(
        "probability", F.round(F.col("factor") / most, PLACES)).drop("factor"))


def draw(id_col: Column, seed: str) -> Column:
    """A number from 0 to 1 that depends on the id and the seed alone."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"))
    return F.round(F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52)), PLACES)


def _drawn(docs: DataFrame, dims: Mapping[str, Column], weight: Column, targets: Mapping, id_col: str, seed: str,
           rounds: int, size: float | None) -> DataFrame:
    """``docs`` with the dimensions (as __mix_<name>), __weight, __probability and __kept."""
    keyed, slim = _keyed(docs, dims, weight)
    cells = cell_factors(slim, targets, rounds, size).drop("mass").toDF(*(f"__mix_{d}" for d in targets), "__probability")
    # No hint: the cells are a written table, so Spark knows their size; beyond its limit it splits skewed cells itself.
    return keyed.join(cells, [f"__mix_{d}" for d in targets]).withColumn(
        "__kept", draw(F.col(id_col), seed) < F.col("__probability"))


def _keyed(docs: DataFrame, dims: Mapping[str, Column], weight: Column) -> tuple[DataFrame, DataFrame]:
    """``docs`` with the dimensions (as __mix_<name>) and __weight, and these alone under their own names."""
    named = {f"__mix_{d}": F.coalesce(c.cast("string"), F.lit("")) for d, c in dims.items()}
    keyed = docs.withColumns({**named, "__weight": F.greatest(F.lit(1), weight).cast("long")})
    slim = keyed.select(*(F.col(f"__mix_{d}").alias(d) for d in dims), F.col("__weight").alias("weight"))
    return keyed, slim


def reach(docs: DataFrame, dims: Mapping[str, Column], weight: Column, targets: Mapping, size: float,
          rounds: int = ROUNDS) -> DataFrame:
    """One row per value of every dimension: dimension, value, seen, wanted and expected mass. Where ``expected`` is below
    ``wanted``, the value's cells hold too little to reach its share of ``size`` without repeats."""
    cells = cell_factors(_keyed(docs, dims, weight)[1], targets, rounds, size)
    out = None
    for dim, target in targets.items():
        whole = F.sum("seen").over(Window.partitionBy()) * size
        rows = cells.groupBy(dim).agg(F.sum("mass").alias("seen"), F.sum(F.col("mass") * F.col("probability")).alias("expected")).join(
            target(cells, dim), dim).select(F.lit(dim).alias("dimension"), F.col(dim).alias("value"), "seen",
                                            (F.col(f"target_{dim}") * whole).alias("wanted"), "expected")
        out = rows if out is None else out.union(rows)
    return out


def mix(docs: DataFrame, dims: Mapping[str, Column], weight: Column, targets: Mapping, id_col: str = "doc_id",
        seed: str = "mix", rounds: int = ROUNDS, size: float | None = None) -> DataFrame:
    """One row per document: id, the dimensions, weight, probability, kept."""
    return _drawn(docs, dims, weight, targets, id_col, seed, rounds, size).select(
        id_col, *(F.col(f"__mix_{d}").alias(d) for d in dims), F.col("__weight").alias("weight"),
        F.col("__probability").alias("probability"), F.col("__kept").alias("kept"))


def sample(docs: DataFrame, dims: Mapping[str, Column], weight: Column, targets: Mapping, id_col: str = "doc_id",
           seed: str = "mix", rounds: int = ROUNDS, size: float | None = None) -> DataFrame:
    """The drawn rows with their own columns."""
    return _drawn(docs, dims, weight, targets, id_col, seed, rounds, size).filter("__kept").select(
        *(F.col(f"`{c}`") for c in docs.columns))
