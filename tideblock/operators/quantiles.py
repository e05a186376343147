"""Exact linear-interpolated quantiles of groups of any size.

The built-in ``percentile`` gathers a group's distinct values in one task. Here values are counted per (group,
value) first, then ranked by a chunked running sum, and only the rows at the wanted ranks are kept. :class:`Index` keeps
the ordered values for several groupings, and carries sums of other columns along the order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideblock.operators import ordered

# The quantiles of the summary bundle.
SUMMARY_POINTS = {"p10": 0.10, "p25": 0.25, "median": 0.50, "p75": 0.75, "p90": 0.90, "p99": 0.99}
GRID = 1024


def _may_hold(points: Sequence[float], before: Column, upto: Column, total: Column) -> Column:
    """Whether a row of these ranks may hold one of the points: looked up in a grid, so that few rows compare themselves with all points."""
    cells = [False] * GRID
    for p in points:
        for slack in (-1e-9, 1e-9):
            cells[min(max(int((p + slack) * GRID), 0), GRID - 1)] = True
    cell = lambda rank: F.least(F.greatest(F.floor(rank * GRID / F.greatest(total - 1, F.lit(1))), F.lit(0)), F.lit(GRID - 1)).cast("int")
    low, high, held = cell(before - 1), cell(upto), F.array(*[F.lit(c) for c in cells])
    return (high - low > 1) | F.get(held, low) | F.get(held, high)


class Index:
    """Values of groups counted and put in order once, for ranks, thresholds and counts of any coarser grouping.

    Rows are counted per (keys, finest, value), with ``sums`` of other columns, chunked in order of value within ``keys`` and written.
    Every grouping by some of ``finest`` is then a scan of the same chunks, so groupings don't multiply the rows.
    """

    def __init__(
        self, df: DataFrame, keys: Sequence[str], value: str | Column, finest: Sequence[str] = (), sums: dict[str, Column] | None = None,
        weight: str | None = None,
    ) -> None:
        self.keys, self.finest, self.sums = list(keys), list(finest), list(sums or {})
        column = (F.col(value) if isinstance(value, str) else value).cast("double")
        copies = F.lit(1) if weight is None else F.col(weight)
        counted = (
            df.select(*keys, *finest, column.alias("_x"), copies.cast("bigint").alias("_n"), *[c.alias(n) for n, c in (sums or {}).items()])
            .filter(F.col("_x").isNotNull() & ~F.isnan("_x"))
            .withColumn("_x", F.col("_x") + F.lit(0.0))
            .groupBy(*keys, *finest, "_x")
            .agg(F.sum("_n").alias("_n"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in self.sums])
        )
        self.chunks = ordered.chunk(counted, self.keys, ["_x", *finest])

    def totals(self, group: Sequence[str] = ()) -> DataFrame:
        """(keys, group, ``total_n``, ``total_`` of each sum)."""
        return self.chunks.groupBy(*self.keys, *group).agg(F.sum("_n").alias("total_n"), *[F.sum(n).alias(f"total_{n}") for n in self.sums])

    def _near(self, points: Sequence[float], groupings: Sequence[Sequence[str]]) -> tuple[DataFrame, list[str]]:
        """Rows at the wanted ranks of every grouping, with running sums, totals and the point (``p``); and the columns of a group.

        The chunks' totals tell which chunk holds a rank, so only such chunks are scanned, each with what lies before it.
        """
        label = lambda i, group: F.struct(F.lit(i).alias("_g"), F.concat_ws("\x01", F.lit(i), *[F.coalesce(F.col(c).cast("string"), F.lit("\x02")) for c in group]).alias("_group"))
        labels = F.inline(F.array(*[label(i, g) for i, g in enumerate(groupings)]))
        place = [*self.keys, "_g", "_group"]
        names = ["n", "xn", *self.sums]
        own = {"n": F.col("_n"), "xn": F.col("_x") * F.col("_n"), **{n: F.col(n) for n in self.sums}}
        small = self.chunks.groupBy(*self.keys, *self.finest, ordered.CHUNK).agg(*[F.sum(own[n]).alias(f"_c_{n}") for n in names])
        small = small.select("*", labels).groupBy(*place, ordered.CHUNK).agg(*[F.sum(f"_c_{n}").alias(f"_c_{n}") for n in names])
        whole = Window.partitionBy(*place)
        earlier = whole.orderBy(ordered.CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        sums = {f"_b_{n}": F.coalesce(F.sum(f"_c_{n}").over(earlier), F.lit(0)) for n in names}
        carried = small.select("*", *[c.alias(n) for n, c in sums.items()], *[F.sum(f"_c_{n}").over(whole).alias(f"total_{n}") for n in names])
        inside = lambda r, low, high: ((F.floor(r) >= low) & (F.floor(r) < high)) | ((F.ceil(r) >= low) & (F.ceil(r) < high))
        asked = F.array(*[F.struct(F.lit(float(p)).alias("p"), (F.lit(float(p)) * (F.col("total_n") - 1)).alias("r")) for p in points])
        low, high = F.col("_b_n"), F.col("_b_n") + F.col("_c_n")
        wanted = carried.withColumn("_wanted", F.filter(asked, lambda w: inside(w["r"], low, high))).filter(F.size("_wanted") > 0)
        wanted = wanted.drop(*[f"_c_{n}" for n in names])
        rows = self.chunks.select("*", labels).join(wanted, [*place, ordered.CHUNK])
        series = Window.partitionBy(*place, ordered.CHUNK).orderBy("_x", *self.finest).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranked = rows.withColumns({f"_u_{n}": F.col(f"_b_{n}") + F.sum(own[n]).over(series) for n in ["n", *self.sums]})
        upto, before = F.col("_u_n"), F.col("_u_n") - F.col("_n")
        ranked = ranked.filter(_may_hold(points, before, upto, F.col("total_n")))
        near = ranked.withColumn("_w", F.explode(F.filter("_wanted", lambda w: inside(w["r"], before, upto)))).select(
            "*", F.col("_w.p").alias("p"), F.col("_w.r").alias("_rank")
        )
        covers = lambda r: (r < upto) & (r >= before)
        return near.withColumns({"_low": covers(F.floor("_rank")), "_high": covers(F.ceil("_rank"))}), place

    def at(self, points: Sequence[float], group: Sequence[str] = ()) -> DataFrame:
        """(keys, group, ``p``, ``q``) for every point; groups without a finite value are absent.

        With ``sums``, also ``below_`` and ``upto_``: the sums (and ``n``, the count) of the rows below q, and of those up to it. These need the
        finest grouping, in which values are distinct.
        """
        if self.sums and list(group) != self.finest:
            raise ValueError("sums at a quantile need the finest grouping")
        near, place = self._near(points, [group])
        names = ["n", *self.sums] if self.sums else []
        ends = near.groupBy(*place, "p").agg(
            *[F.any_value(c).alias(c) for c in group],
            F.max(F.when(F.col("_low"), F.col("_x"))).alias("_lo"),
            F.max(F.when(F.col("_high"), F.col("_x"))).alias("_hi"),
            F.max(F.col("_rank") - F.floor("_rank")).alias("_part"),
            *[F.max(F.when(F.col("_low"), F.col(f"_u_{n}"))).alias(f"_lo_{n}") for n in names],
            *[F.max(F.when(F.col("_high"), F.col(f"_u_{n}"))).alias(f"_hi_{n}") for n in names],
            *[F.max(F.when(F.col("_high"), F.col(f"_u_{n}") - F.col("_n" if n == "n" else n))).alias(f"_under_{n}") for n in names],
        ).withColumn("q", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_part"))
        # Between two neighbouring values lies nothing, so what is below the quantile is what is up to the lower one.
        top = F.col("q") == F.col("_hi")
        sides = [
            c
            for n in names
            for c in (
                F.when(top, F.col(f"_under_{n}")).otherwise(F.col(f"_lo_{n}")).alias(f"below_{n}"),
                F.when(top, F.col(f"_hi_{n}")).otherwise(F.col(f"_lo_{n}")).alias(f"upto_{n}"),
            )
        ]
        return ends.select(*self.keys, *group, "p", "q", *sides)

    def columns(self, named: dict[str, float], *groupings: Sequence[str]) -> DataFrame:
        """One row per group of each grouping (by number in ``grouping``), one column per named quantile, ``count`` and ``mean``.

        A column of the finest grouping that a grouping does without is null.
        """
        groupings = groupings or ((),)
        near, place = self._near(list(dict.fromkeys(named.values())), groupings)
        pick = lambda p, side, c: F.max(F.when((F.col("p") == p) & F.col(side), F.col(c)))
        part = lambda p: F.max(F.when(F.col("p") == p, F.col("_rank") - F.floor("_rank")))
        value = lambda p: pick(p, "_low", "_x") + (pick(p, "_high", "_x") - pick(p, "_low", "_x")) * part(p)
        has = {c: [i for i, g in enumerate(groupings) if c in g] for c in self.finest}
        shown = [F.any_value(F.when(F.col("_g").isin(has[c]), F.col(c)), ignoreNulls=F.lit(True)).alias(c) for c in self.finest if has[c]]
        out = near.groupBy(*place).agg(
            *shown, F.any_value("total_n").alias("count"), (F.any_value("total_xn") / F.any_value("total_n")).alias("mean"),
            *[value(p).alias(n) for n, p in named.items()],
        )
        return out.withColumnRenamed("_g", "grouping").drop("_group")

    def summary(self, *groupings: Sequence[str]) -> DataFrame:
        """``count``, ``mean`` and the summary quantiles of each group of each grouping; see :meth:`columns`."""
        return self.columns(SUMMARY_POINTS, *groupings)


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str | Column, points: Sequence[float], weight: str | None = None
) -> DataFrame:
    """(keys, ``p``, ``q``) for every point; groups without a finite value are absent. ``weight`` counts copies."""
    return Index(df, keys, value, weight=weight).at(points)


def quantile_columns(df: DataFrame, keys: Sequence[str], value: str | Column, named: dict[str, float]) -> DataFrame:
    """One row per group, one column per named quantile."""
    return Index(df, keys, value).columns(named).drop("grouping", "count", "mean")


def summary(df: DataFrame, keys: Sequence[str], value: str | Column) -> DataFrame:
    """``count``, ``mean`` and the summary quantiles of each group; without keys one row, also of no value."""
    found = Index(df, keys, value).summary().drop("grouping")
    if keys:
        return found
    one = df.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("_none"))
    return one.join(F.broadcast(found), how="left").select(F.coalesce("count", "_none").alias("count"), *found.columns[1:])
