"""Finding the row at a given place of each group's order, without sorting a group.

For each group and place there is an interval of the order that holds the row.  A pass
takes some rows of the interval by hash, of which the two that should lie closely around
the place cut it; it counts the rows between the cuts and keeps the stretch that holds the
place, as a table that the next pass reads.  Passes go on until few rows are left, which
are ranked.  Each pass leaves about a twentieth, whatever the values are: all rows may
share a day, or their leading value may be a timestamp.  Groups are few.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from couponlab.session import stored

#: Rows that are ranked in one task, and rows of an interval that its cuts are chosen from.
SMALL, SPLITTERS = 10_000, 4096


@dataclass
class _Search:
    """The rows above ``low`` up to ``high`` (None: no bound) are ``n``; the row sought is number ``place`` of them."""

    group: int
    quota: int
    low: tuple | None
    high: tuple | None
    place: int
    n: int


def _inside(marked: DataFrame, searches: dict[int, _Search], at: T.StructType) -> DataFrame:
    """The rows of each search under its number ``search``; they are marked by group or, once kept, by search."""
    by = "group" if "group" in marked.columns else "search"
    kinds = {"group": T.IntegerType(), "number": T.IntegerType(), "low": at, "high": at}
    schema = T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])
    rows = [(s.group, i, s.low, s.high) for i, s in searches.items()]
    bounds = F.broadcast(marked.sparkSession.createDataFrame(rows, schema))
    same = marked["group"] == bounds["group"] if by == "group" else marked["search"] == bounds["number"]
    above = F.col("low").isNull() | (F.col("at") > F.col("low"))
    below = F.col("high").isNull() | (F.col("at") <= F.col("high"))
    return marked.join(bounds, same).where(above & below).select(F.col("number").alias("search"), "at")


def _cuts(drawn: list[tuple], search: _Search) -> list[tuple]:
    """One or two of the sorted rows drawn from an interval, which should lie closely around the place."""
    m, share = len(drawn), search.place / search.n
    off = min(int(3 * sqrt(m * share * (1 - share))) + 1, max(1, m // 4))
    near = int(share * m)
    return sorted({drawn[min(max(near + step, 0), m - 1)] for step in (-off, off)}) if drawn else []


def _narrowed(marked: DataFrame, searches: dict[int, _Search], at: T.StructType, turn: int, least: dict[int, tuple]) -> None:
    """One pass over the rows of all searches.  Those of ``least`` are cut there."""
    inside = _inside(marked, searches, at)
    rates = F.create_map(*[F.lit(x) for i, s in searches.items() for x in (i, max(1, s.n // SPLITTERS))])
    chosen = F.pmod(F.xxhash64("at", F.lit(turn)), rates[F.col("search")]) == 0
    drawn: dict[int, list[tuple]] = {i: [] for i in searches}
    # Copies share a hash: one of them is enough.
    for row in inside.where(chosen).distinct().collect():
        drawn[row["search"]].append(tuple(row["at"]))
    cuts = {i: [least[i]] if i in least else _cuts(sorted(drawn[i]), s) for i, s in searches.items()}
    schema = T.StructType([T.StructField("search", T.IntegerType()), T.StructField("first", at), T.StructField("second", at)])
    table = F.broadcast(marked.sparkSession.createDataFrame([(i, *(*c, None, None)[:2]) for i, c in cuts.items()], schema))
    passed_cuts = [F.coalesce((F.col("at") > F.col(c)).cast("int"), F.lit(0)) for c in ("first", "second")]
    stretch = (passed_cuts[0] + passed_cuts[1]).alias("stretch")
    counted = inside.join(table, "search").groupBy("search", stretch).agg(F.count(F.lit(1)).alias("n")).collect()
    sizes = {(r["search"], r["stretch"]): r["n"] for r in counted}
    for i, search in searches.items():
        passed = 0
        for k in range(len(cuts[i]) + 1):
            n = sizes.get((i, k), 0)
            if passed + n >= search.place:
                break
            passed += n
        search.low = cuts[i][k - 1] if k else search.low
        search.high = cuts[i][k] if k < len(cuts[i]) else search.high
        search.place, search.n = search.place - passed, n


def places(rows: DataFrame, by: list[str], quotas: list[Column], order: list[Column]) -> DataFrame:
    """For each group the order value of the last row inside each quota.

    ``rows`` is read several times and should be a written table; ``order`` tells its rows apart and holds no nulls.
    A quota is a number of rows, as a column that may use ``rows_of_group``.  The result has a row for each group:
    ``by``, and for each quota ``none_i`` (no row is inside), ``edge_i`` (null: all rows are).
    """
    spark = rows.sparkSession
    counted = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows_of_group"))
    asked = counted.select(*by, "rows_of_group", *[q.cast("bigint").alias(f"quota_{i}") for i, q in enumerate(quotas)])
    groups = asked.collect()
    keys = T.StructType([*(rows.schema[c] for c in by), T.StructField("group", T.IntegerType())])
    numbers = F.broadcast(spark.createDataFrame([(*(g[c] for c in by), i) for i, g in enumerate(groups)], keys))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"g.{c}")) for c in by]
    marked = rows.select(*by, F.struct(*order).alias("at")).alias("r").join(numbers.alias("g"), same).select("group", "at")
    at = marked.schema["at"].dataType
    searches = [
        _Search(g, i, None, None, int(row[f"quota_{i}"]), row["rows_of_group"])
        for g, row in enumerate(groups)
        for i in range(len(quotas))
        if 0 < row[f"quota_{i}"] < row["rows_of_group"]
    ]
    found: dict[tuple[int, int], tuple] = {}
    turn, left, least = 0, dict(enumerate(searches)), {}
    while wide := {i: s for i, s in left.items() if s.n > SMALL}:
        before = {i: (s.low, s.high, s.n) for i, s in wide.items()}
        _narrowed(marked, wide, at, turn, least)
        turn += 1
        stalled = {i: s for i, s in wide.items() if s.n == before[i][2]}
        ends = F.min("at").alias("least"), F.max("at").alias("most")
        least = {}
        for row in _inside(marked, stalled, at).groupBy("search").agg(*ends).collect() if stalled else []:
            # Rows that the order does not tell apart cannot be narrowed down: the place is among them.
            if row["least"] == row["most"]:
                search = left.pop(row["search"])
                found[search.group, search.quota] = tuple(row["most"])
            else:
                least[row["search"]] = tuple(row["least"])
        # The next pass reads what is left, once that is much less.
        if left and 4 * sum(s.n for s in left.values()) < sum(n for _, _, n in before.values()):
            marked = stored(_inside(marked, left, at), "stretches")
    if left:
        place = F.row_number().over(Window.partitionBy("search").orderBy("at"))
        wanted = F.create_map(*[F.lit(x) for i, s in left.items() for x in (i, s.place)])
        ranked = _inside(marked, left, at).withColumn("place", place).where(F.col("place") == wanted[F.col("search")])
        for row in ranked.collect():
            search = left[row["search"]]
            found[search.group, search.quota] = tuple(row["at"])
    fields = [rows.schema[c] for c in by]
    for i in range(len(quotas)):
        fields += [T.StructField(f"none_{i}", T.BooleanType()), T.StructField(f"edge_{i}", at)]
    table = []
    for g, row in enumerate(groups):
        values = [row[c] for c in by]
        for i in range(len(quotas)):
            values += [row[f"quota_{i}"] <= 0, found.get((g, i))]
        table.append(tuple(values))
    return spark.createDataFrame(table, T.StructType(fields))
