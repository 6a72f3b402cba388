"""Feature specifications and their compilation into one aggregation.

Every entity feature is a function of frequency tables: how many rows of each
state an entity has for each value of a column.  ``entity_features`` builds
the tables for all needed columns in one pass over the rows and reduces them
to one row per entity:

1. each row becomes one narrow row per value column (the columns stay inside
   the stage; nothing is expanded across the network before it is counted);
2. rows are counted per entity, column and value, once for each row state;
3. where medians or sums in order are asked for, each value learns how many
   rows lie below it;
4. the counts are reduced per entity: sums for counts and means, non-zero
   tests for distinct counts, the values at the middle ranks for medians.

Both groupings combine on the map side, so an entity with a third of all rows
reaches the second one as partial sums.  No step keeps an entity's values in
memory where they may be many: ranks come from sorted rows, which spill, and
values of large entities are ranked bin by bin, the bins in order of value.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from couponlab.functions import fields, labels
from couponlab.operators import skew

# Row states, from receipt, purchase and 15-day label.
_REDEEMED, _LATE, _UNUSED, _NO_COUPON, _NEITHER = range(5)

#: Row filters as sets of states.
STATES = {
    "all": (_REDEEMED, _LATE, _UNUSED, _NO_COUPON, _NEITHER),
    "recv": (_REDEEMED, _LATE, _UNUSED),
    "not_recv": (_NO_COUPON, _NEITHER),
    "used": (_REDEEMED, _LATE, _NO_COUPON),
    "not_used": (_UNUSED, _NEITHER),
    "recv_used": (_REDEEMED, _LATE),
    "recv_not_used": (_UNUSED,),
    "not_recv_used": (_NO_COUPON,),
    "redeemed": (_REDEEMED,),
}

#: Value columns a feature may use, with the type of their minima and maxima.
VALUE_TYPES = {
    "user_id": "bigint",
    "merchant_id": "bigint",
    "coupon0": "bigint",
    "distance": "int",
    "discount_rate": "double",
    "min_cost_of_manjian": "int",
    "reduce_manjian": "int",
    "threshold_cost": "int",
    "redeem_gap": "int",
}


#: Bins to each factor of e in a value's size; 182,000 a side at most for doubles.
BINS = 256


@dataclass(frozen=True)
class Feature:
    """One output column.

    ``kind`` is count, distinct, min, max, mean, median or frequency_class;
    ``rows`` names a row filter; ``value`` a column of ``VALUE_TYPES``.
    """

    name: str
    kind: str
    rows: str = "all"
    value: str | None = None


@dataclass(frozen=True)
class Ratio:
    """One column over another, 0 when the divisor is 0."""

    name: str
    part: str
    whole: str


def ratio_columns(ratios: list[Ratio]) -> list[Column]:
    return [F.coalesce(F.try_divide(r.part, r.whole), F.lit(0.0)).alias(r.name) for r in ratios]


def _state() -> Column:
    received, used = fields.received(), fields.used()
    on_time = labels.redeemed(F.col("date_received"), F.col("date_used")) == 1
    return (
        F.when(received & used & on_time, _REDEEMED)
        .when(received & used, _LATE)
        .when(received, _UNUSED)
        .when(used, _NO_COUPON)
        .otherwise(_NEITHER)
    )


def _value(name: str) -> Column:
    if name == "threshold_cost":
        return F.when(F.col("is_manjian") == 1, F.col("min_cost_of_manjian"))
    if name == "redeem_gap":
        gap = labels.gap_days(F.col("date_received"), F.col("date_used"))
        return F.when(gap <= labels.REDEEM_DAYS, gap)
    return F.col(name)


def _frequencies(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows per entity, slot (value column) and value, one count per state."""
    slots = []
    for slot, name in enumerate(values):
        value, real = _value(name), VALUE_TYPES[name] == "double"
        slots.append(
            F.struct(
                F.lit(slot).alias("slot"),
                (F.lit(None) if real else value).cast("bigint").alias("whole"),
                (value if real else F.lit(None)).cast("double").alias("real"),
            )
        )
    tall = rows.select(*keys, _state().alias("state"), F.inline(F.array(*slots)))
    present = F.col("whole").isNotNull() | F.col("real").isNotNull()
    return (
        tall.where(present)
        .groupBy(*keys, "slot", "whole", "real")
        .agg(*[F.count_if(F.col("state") == s).alias(f"n{s}") for s in STATES["all"]])
    )


def _weight(rows: str) -> str:
    return "(" + " + ".join(f"n{s}" for s in STATES[rows]) + ")"


#: A value that a decimal with nine places holds whole.  Such values are summed exactly, all others in their order.
_SHORT = "try_cast(real AS decimal(17,9))"
_IS_SHORT = f"coalesce(cast({_SHORT} AS double) = real, false)"


def _needs_order(feature: Feature) -> bool:
    return feature.kind == "median" or (feature.kind == "mean" and VALUE_TYPES[feature.value] == "double")


def _bin() -> Column:
    """A whole number that never falls as the value grows; nan lies above all."""
    value = F.coalesce("real", F.col("whole").cast("double"))
    size = F.floor(F.signum(value) * F.log1p(F.abs(value)) * BINS)
    return F.when(F.isnan(value), F.lit(2**63 - 1)).otherwise(size)


def _ranked(counted: DataFrame, keys: list[str], filters: list[str], binned: bool) -> DataFrame:
    """The frequency tables with, for each row filter, the rows ``below`` a value, all rows (``total``),
    and ``rest``, the sum up to here, in ascending order, of values that are not short decimals.

    Sorted within an entity's column; or, ``binned``, within a bin of values, the bins of a
    column being sorted by themselves and their sums added to their values.
    """
    weights = {name: F.expr(_weight(name)) for name in filters}
    rest = {name: F.expr(f"CASE WHEN {_weight(name)} > 0 AND NOT {_IS_SHORT} THEN real * {_weight(name)} END") for name in filters}
    group = [*keys, "slot"]

    def sums(rows: DataFrame, by: list[str], order: list[str], weight, left, prefix: str, *kept: str) -> DataFrame:
        ordered = Window.partitionBy(*by).orderBy(*order)
        before = ordered.rowsBetween(Window.unboundedPreceding, -1)
        so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        added = []
        for name in filters:
            added += [
                F.coalesce(F.sum(weight[name]).over(before), F.lit(0)).alias(f"{prefix}below_{name}"),
                F.sum(weight[name]).over(whole).alias(f"{prefix}total_{name}"),
                F.sum(left[name]).over(so_far).alias(f"{prefix}rest_{name}"),
            ]
        return rows.select(*(kept or ["*"]), *added)

    if not binned:
        return sums(counted, group, ["whole", "real"], weights, rest, "")
    inner = sums(counted.withColumn("bin", _bin()), [*group, "bin"], ["whole", "real"], weights, rest, "")
    totals = [F.max(f"total_{name}").alias(f"weight_{name}") for name in filters]
    ends = [F.max_by(f"rest_{name}", F.coalesce("real", F.lit(0.0))).alias(f"left_{name}") for name in filters]
    bins = inner.groupBy(*group, "bin").agg(*totals, *ends)
    bins = sums(
        bins,
        group,
        ["bin"],
        {name: F.col(f"weight_{name}") for name in filters},
        {name: F.col(f"left_{name}") for name in filters},
        "bins_",
        *[F.col(c).alias(f"of_{c}") for c in (*group, "bin")],
    )
    met = None
    for c in (*group, "bin"):
        same = F.col(c).eqNullSafe(F.col(f"of_{c}"))
        met = same if met is None else met & same
    kept = [c for c in counted.columns]
    return inner.join(bins, met).select(
        *kept,
        *[(F.col(f"below_{name}") + F.col(f"bins_below_{name}")).alias(f"below_{name}") for name in filters],
        *[F.col(f"bins_{part}_{name}").alias(f"{part}_{name}") for part in ("total", "rest") for name in filters],
    )


def _reduce(feature: Feature, values: list[str], base: int, ranked: bool) -> str:
    """The reduction of the frequency tables for one feature, as SQL text; what needs order reads ranks if there are any."""
    weight = _weight(feature.rows)
    if feature.kind in ("count", "frequency_class"):
        count = f"coalesce(sum(CASE WHEN slot = {base} THEN {weight} END), 0L)"
        if feature.kind == "count":
            return count
        return f"CASE WHEN {count} >= 6 THEN 2 WHEN {count} >= 4 THEN 1 ELSE 0 END"
    dtype = VALUE_TYPES[feature.value]
    value = "real" if dtype == "double" else "whole"
    here = f"slot = {values.index(feature.value)}"
    if feature.kind == "distinct":
        return f"count_if({here} AND {weight} > 0)"
    chosen = f"CASE WHEN {here} AND {weight} > 0 THEN {value} END"
    if feature.kind in ("min", "max"):
        return f"coalesce(cast({feature.kind}({chosen}) AS {dtype}), cast(0 AS {dtype}))"
    if feature.kind == "median" and not ranked:
        return f"coalesce(percentile({chosen}, 0.5D, {weight}), 0D)"
    if feature.kind == "median":
        below, total = f"below_{feature.rows}", f"total_{feature.rows}"

        def at(rank: str) -> str:
            return f"max(CASE WHEN {here} AND {below} <= {rank} AND {rank} < {below} + {weight} THEN {value} END)"

        return f"coalesce(0.5D * {at(f'(({total} - 1) div 2)')} + 0.5D * {at(f'({total} div 2)')}, 0D)"
    if feature.kind == "mean":
        total = f"cast(sum(CASE WHEN {here} THEN {value} * {weight} END) AS double)"
        if dtype == "double":
            # Either sum is independent of the order in which rows arrive.
            exact = f"sum(CASE WHEN {here} AND {_IS_SHORT} THEN {_SHORT} * {weight} END)"
            rest = f"max_by(CASE WHEN {here} THEN rest_{feature.rows} END, CASE WHEN {here} THEN real END)"
            if not ranked:
                left = f"collect_list(CASE WHEN {here} AND {weight} > 0 AND NOT {_IS_SHORT} THEN struct({value} AS v, {weight} AS w) END)"
                rest = f"aggregate(array_sort({left}), 0D, (a, x) -> a + x.v * x.w)"
            total = f"coalesce(cast({exact} AS double), 0D) + coalesce({rest}, 0D)"
        return f"coalesce(try_divide({total}, sum(CASE WHEN {here} THEN {weight} END)), 0D)"
    raise ValueError(f"unknown feature kind {feature.kind!r}")


def _reduced(rows: DataFrame, keys: list[str], features: list[Feature], ranks: str | None = None) -> DataFrame:
    """One row per entity.  ``ranks`` is None (counters of values are kept), "sorted" or "binned"."""
    values = list(dict.fromkeys(f.value for f in features if f.value))
    # Counts are read off one column that is never null; the key itself if need be.
    never_null = [v for v in values if v not in ("threshold_cost", "redeem_gap")] or [keys[-1]]
    values = list(dict.fromkeys([*values, never_null[0]]))
    base = values.index(never_null[0])
    filters = list(dict.fromkeys(f.rows for f in features if _needs_order(f))) if ranks else []
    reduced = [F.expr(f"{_reduce(f, values, base, bool(filters))} AS {f.name}") for f in features]
    counted = _frequencies(rows, keys, values)
    if filters:
        counted = _ranked(counted, keys, filters, ranks == "binned")
    return counted.groupBy(*keys).agg(*reduced)


def entity_features(
    rows: DataFrame,
    key: str,
    features: list[Feature],
    *,
    many: bool = False,
    hot: DataFrame | None = None,
    within: Sequence[str] = (),
    few_values: bool = True,
) -> DataFrame:
    """One row per ``within`` and ``key`` with all ``features``; 0 where no row qualifies.

    ``rows`` is a cleaned log.  ``many`` says that keys are many and have few
    rows each, so counting before the shuffle would not shrink anything: then
    the narrow log is partitioned by key once and both groupings run inside
    that partitioning, except for the ``hot`` keys, which count first.  There
    are as many tasks as the rows ask for, since a task holds its counts.

    Medians of cold keys come from sorted rows, those of hot keys from bins.
    ``few_values`` says that the columns of all other entities have small
    domains, as distances, discounts and days have: one counter per distinct
    value is then kept.  Without it (prices) they are ranked in bins too, which
    reads the frequency tables twice and gives the same.
    """
    keys = [*within, key]
    if not many:
        return _reduced(rows, keys, features, None if few_values else "binned")
    cold, heavy = skew.split_hot(rows, [key], hot)
    reduced = _reduced(cold.repartition(skew.tasks(rows), *keys), keys, features, "sorted")
    return reduced if heavy is None else reduced.unionByName(_reduced(heavy, keys, features, "binned"))
