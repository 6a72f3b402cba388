"""Row-preserving counts: how many rows share a row's values in some columns.

Two ways of getting the same numbers:

* counts led by the user run as windows.  One exchange by user serves them
  all, and one sort serves every chain of nested column sets.  The sorts of a
  task hold all its rows, so tasks are as many as the rows ask for;
* all other counts, and the counts of hot users, are taken on the grain: the
  distinct combinations of the columns with their row counts.  Each count is
  a sum over the grain in two phases, by key and salt and then by key; they
  meet there under key and salt, and the grain joins back to the rows once.
  Counts whose keys are few are sent to the rows instead, which stay in place.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from couponlab.operators import skew

#: Tasks that the rows of one key are spread over where they are joined.
SALTS = 64
_SALT, _COPY = "__salt", "__copy"

#: Columns the interaction counts combine, in naming order.
COLUMNS = {
    "user_id": "user_id",
    "merchant_id": "merchant_id",
    "coupon_id": "coupon0",
    "discount_rate": "discount_rate",
    "distance": "distance",
    "date_received": "date_received",
}

#: The first-pipeline counts: output name -> columns.
BASIC_COUNTS = {
    "simple_user_id_receive_cnt": ["user_id"],
    "simple_user_id_coupon_id_receive_cnt": ["user_id", "coupon0"],
    "simple_user_id_date_received_receive_cnt": ["user_id", "date_received"],
    "simple_user_id_coupon_id_date_received_receive_cnt": ["user_id", "coupon0", "date_received"],
    "simple_user_id_distance_user_distance_receive": ["user_id", "distance"],
    "simple_user_id_merchant_id_user_merchant_id_receive": ["user_id", "merchant_id"],
}

#: The counts of the smaller row feature set.
ROW_COUNTS_V0 = {
    name: BASIC_COUNTS[name]
    for name in (
        "simple_user_id_coupon_id_receive_cnt",
        "simple_user_id_date_received_receive_cnt",
        "simple_user_id_coupon_id_date_received_receive_cnt",
    )
}

#: Repeat flags: output name -> columns that must repeat.
COUPON_REPEAT = {
    "simple_user_id_coupon_id_date_received_receive_receive": ["user_id", "coupon0", "date_received"]
}
MERCHANT_REPEAT = {
    "simple_user_id_merchant_id_date_received_receive_receive": ["user_id", "merchant_id", "date_received"]
}


def interaction_counts(size: int) -> dict[str, list[str]]:
    """Names and columns of the interaction counts over ``size`` columns."""
    # Combinations that are not built, and the longer ones that
    # carry the "unite" prefix.
    missing = {
        ("distance", "date_received"),
        ("user_id", "merchant_id", "coupon_id", "distance", "date_received"),
    }
    unite = {
        ("user_id", "merchant_id", "date_received"),
        ("user_id", "merchant_id", "coupon_id", "discount_rate"),
        ("user_id", "merchant_id", "coupon_id", "discount_rate", "distance"),
    }
    found = {}
    for names in combinations(COLUMNS, size):
        if names in missing or (size == 3 and names[0] != "user_id"):
            continue
        prefix = "unite" if size <= 2 or names in unite else "simple"
        found[f"{prefix}_{'_'.join(names)}_receive_cnt"] = [COLUMNS[name] for name in names]
    return found


def _chains(sets: list[list[str]], order: list[str]) -> list[list[list[str]]]:
    """Group column sets into chains of nested sets, largest sets first."""
    chains: list[list[list[str]]] = []
    for columns in sorted(sets, key=lambda s: (-len(s), [order.index(c) for c in s])):
        for chain in chains:
            if set(columns) <= set(chain[-1]):
                chain.append(columns)
                break
        else:
            chains.append([columns])
    return chains


def _windowed(rows: DataFrame, counts: Mapping[str, list[str]], lead: list[str], tasks: int) -> DataFrame:
    """Counts as windows over one partitioning by ``lead``, which all counts include.

    Floating columns are partitioned by their text: Spark normalises floating
    window keys, and would then not recognise the sort the windows share.
    """
    texts = {c: f"{c}_text" for c, kind in rows.dtypes if kind in ("double", "float")}
    sets = {name: [texts.get(c, c) for c in columns] for name, columns in counts.items()}
    order = list(dict.fromkeys([*lead, *(c for columns in sets.values() for c in columns)]))
    result = rows.repartition(tasks, *lead).withColumns({text: F.col(c).cast("string") for c, text in texts.items()})
    for chain in _chains(list(sets.values()), order):
        # Sort by the smallest set first, then by what each larger one adds.
        sort = list(lead)
        for columns in reversed(chain):
            sort += [c for c in columns if c not in sort]
        windows = {}
        for name, columns in sets.items():
            if columns in chain:
                by = Window.partitionBy(*[c for c in sort if c in columns])
                windows[name] = F.count(F.lit(1)).over(by)
        result = result.sortWithinPartitions(*sort).withColumns(windows)
    return result.drop(*texts.values())


def _salt(columns: Sequence[str]) -> Column:
    """Spreads rows that share other columns; one value where there is nothing to tell them apart."""
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int") if columns else F.lit(0)


def _totals(base: DataFrame, keys: Sequence[str], salt: Column, name: str) -> DataFrame:
    """The rows of each key under every salt that the key has.

    Sums are taken by key and salt first, so the window over a key holds ``SALTS`` rows at most.
    """
    parts = base.withColumn(_SALT, salt).groupBy(*keys, _SALT).agg(F.sum("rows_here").alias("rows_of_salt"))
    whole = F.sum("rows_of_salt").over(Window.partitionBy(*keys))
    return parts.select(*keys, _SALT, whole.alias(name))


def _few(source: DataFrame, counts: Mapping[str, list[str]]) -> list[str]:
    """The counts whose keys are few, found in one pass that moves a sketch of each."""
    asked = [F.approx_count_distinct(F.xxhash64(*keys)).alias(name) for name, keys in counts.items()]
    found = source.agg(*asked).head()
    return [name for name in counts if found[name] <= skew.SMALL_TABLE]


def _joined(rows: DataFrame, counts: Mapping[str, list[str]], source: DataFrame) -> DataFrame:
    """Counts over ``source``, joined to ``rows``; those of few keys go to the rows.

    Rows that lack any of the counted columns have no counts.
    """
    few = _few(source, counts)
    columns = list(dict.fromkeys(c for keys in counts.values() for c in keys))
    order = [*columns, *(c for c in rows.columns if c not in columns), *counts]
    rest = {name: keys for name, keys in counts.items() if name not in few}
    result = _from_grain(rows, rest, source) if rest else rows
    for name in few:
        known = source.groupBy(*counts[name]).agg(F.count(F.lit(1)).alias(name))
        result = result.join(F.broadcast(known), counts[name], "left")
    filled = reduce(and_, [F.col(c).isNotNull() for c in columns])
    return result.select(*order).withColumns({name: F.when(filled, F.col(name)) for name in counts})


def _from_grain(rows: DataFrame, counts: Mapping[str, list[str]], source: DataFrame | None = None) -> DataFrame:
    """Counts taken on the grain of ``source`` (by default ``rows`` itself), joined to ``rows``.

    The counts meet on the grain, which then joins back once.  No join is on a
    key alone: a count comes with its key under each salt of the key's other
    columns, and copies of a combination are told apart by a hash of the row.
    How a count meets the grain is left to adaptive execution, which sees its
    real size.
    """
    source = rows if source is None else source
    columns = list(dict.fromkeys(c for keys in counts.values() for c in keys))
    copy = _salt(source.columns)
    grain = base = source.withColumn(_COPY, copy).groupBy(*columns, _COPY).agg(F.count(F.lit(1)).alias("rows_here"))
    for name, keys in counts.items():
        salt = _salt([c for c in [*columns, _COPY] if c not in keys])
        grain = grain.withColumn(_SALT, salt).join(_totals(base, keys, salt, name), [*keys, _SALT], "left").drop(_SALT)
    return rows.withColumn(_COPY, copy).join(grain.drop("rows_here"), [*columns, _COPY], "left").drop(_COPY)


def attach_counts(
    rows: DataFrame,
    counts: Mapping[str, list[str]],
    hot_users: DataFrame | None = None,
    within: Sequence[str] = (),
) -> DataFrame:
    """Add one count column per entry of ``counts``, separately for each ``within``.

    ``rows`` are cleaned receipts: every counted column is filled.  They are
    read several times and should be a written table.
    """
    counts = {name: [*within, *keys] for name, keys in counts.items()}
    led = {name: keys for name, keys in counts.items() if "user_id" in keys}
    rest = {name: keys for name, keys in counts.items() if "user_id" not in keys}
    result = rows
    if led:
        cold, heavy = skew.split_hot(rows, ["user_id"], hot_users)
        result = _windowed(cold, led, [*within, "user_id"], skew.tasks(rows))
        if heavy is not None:
            result = result.unionByName(_from_grain(heavy, led))
    return _joined(result, rest, source=rows) if rest else result


def attach_repeats(
    rows: DataFrame, flags: Mapping[str, list[str]], within: Sequence[str] = (), source: DataFrame | None = None
) -> DataFrame:
    """Add 1 where the combination occurs more than once in ``source`` (by default ``rows``), else 0.

    Combinations are counted before they are shuffled, and meet their rows
    under each salt that these have.  ``rows`` are those of ``source``, with
    columns added.
    """
    source = rows if source is None else source
    salt = _salt(source.columns)
    for name, keys in flags.items():
        keys = [*within, *keys]
        counted = source.withColumn(_SALT, salt).groupBy(*keys, _SALT).agg(F.count(F.lit(1)).alias("rows_here"))
        known = _totals(counted, keys, F.col(_SALT), "rows_of_key")
        known = known.select(*keys, _SALT, (F.col("rows_of_key") > 1).cast("int").alias(name))
        rows = rows.withColumn(_SALT, salt).join(known, [*keys, _SALT], "left").drop(_SALT)
    return rows


def attach_basic_counts(rows: DataFrame, hot_users: DataFrame | None = None) -> DataFrame:
    """The first-pipeline counts and the same-day repeat flag."""
    return _with_coupon_repeat(attach_counts(rows, BASIC_COUNTS, hot_users))


def attach_row_counts_v0(
    rows: DataFrame, hot_users: DataFrame | None = None, within: Sequence[str] = ()
) -> DataFrame:
    """The smaller set of row counts."""
    return _with_coupon_repeat(attach_counts(rows, ROW_COUNTS_V0, hot_users, within))


def _with_coupon_repeat(rows: DataFrame) -> DataFrame:
    (flag,) = COUPON_REPEAT
    same = F.col("simple_user_id_coupon_id_date_received_receive_cnt")
    return rows.withColumn(flag, (same > 1).cast("int"))
