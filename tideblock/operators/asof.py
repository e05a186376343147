"""As-of join: for each probe the last quote at or before it, or the first at or after it.

Work is done per distinct instant, not per row. Quotes and probe times are first combined to one row per
(key, instant) (partial aggregation before the shuffle), so a bucket of ``bucket_ms`` milliseconds holds at most
``bucket_ms`` rows whatever the size of the key. Each bucket receives the nearest quote of the buckets beside it as
one extra row. The answers then join back to the probes on (key, instant), an equi-join that adaptive
execution splits where many probes share an instant. :func:`lookups` answers several questions of a row in one such pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideblock import scratch

HOUR_MS = 3_600_000


def asof(
    probes: DataFrame,
    quotes: DataFrame,
    keys: Sequence[str],
    *,
    at: str | Column,
    quote_at: str,
    payload: Sequence[str],
    ties: Sequence[str],
    direction: str = "backward",
    strict: bool = False,
    into: str = "quote",
    bucket_ms: int = HOUR_MS,
) -> DataFrame:
    """Left as-of join. Adds the struct column ``into`` (``payload`` fields and ``at_ms``), null where none matches.

    ``ties`` orders quotes of one instant: backward takes the last, forward the first. A matched quote whose
    payload fields are null is still a match. ``strict`` excludes quotes at the probe's own instant.
    """
    backward = direction == "backward"
    probe_at = F.col(at) if isinstance(at, str) else at
    found = F.struct(*[F.col(c) for c in payload], F.col(quote_at).alias("at_ms"))
    marks = quotes.filter(F.col(quote_at).isNotNull()).select(
        *keys,
        F.col(quote_at).alias("_t"),
        found.alias("_q"),
        F.struct(*[F.col(c) for c in ties]).alias("_tie"),
        F.lit(False).alias("_probe"),
    )
    asked = (
        probes.select(*keys, probe_at.alias("_t"))
        .filter(F.col("_t").isNotNull())
        .withColumn("_probe", F.lit(True))
    )
    pick = F.max_by if backward else F.min_by
    instants = (
        marks.unionByName(asked, allowMissingColumns=True)
        .groupBy("_t", *keys)
        .agg(pick("_q", "_tie").alias("_q"), F.max("_probe").alias("_probe"))
        .withColumn("_bucket", F.floor(F.col("_t") / F.lit(bucket_ms)))
    )
    # Read twice below, so written: Spark doesn't share the work of equal branches above an inline or explode. Times come first in keys of
    # sorts: comparing the first few bytes then settles most pairs of rows.
    instants = scratch.keep(instants, "instants")
    place = ["_bucket", *keys]
    sense = F.col("_t") if backward else -F.col("_t")
    edge = F.max_by(F.col("_q"), F.when(F.col("_q").isNotNull(), sense))
    buckets = instants.groupBy(*place).agg(edge.alias("_q"), F.max("_probe").alias("_probe"))
    across = Window.partitionBy(*keys).orderBy("_bucket" if backward else F.col("_bucket").desc())
    head = (
        buckets.withColumn("_q", F.last("_q", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1)))
        .filter(F.col("_probe") & F.col("_q").isNotNull())
        .select(*place, "_q", F.lit(0).alias("_slot"))
    )
    within = Window.partitionBy(*place).orderBy("_slot", sense.asc_nulls_last())
    upto = within.rowsBetween(Window.unboundedPreceding, -1 if strict else Window.currentRow)
    answers = (
        instants.withColumn("_slot", F.lit(1))
        .unionByName(head, allowMissingColumns=True)
        .withColumn(into, F.last("_q", ignorenulls=True).over(upto))
        .filter((F.col("_slot") == 1) & F.col("_probe") & F.col(into).isNotNull())
        .select(*keys, "_t", into)
    )
    return probes.withColumn("_t", probe_at).join(answers, ["_t", *keys], "left").drop("_t")


@dataclass(frozen=True)
class Source:
    """Quotes to look up: their time, the fields of an answer, the order of one instant, and a further key."""

    quotes: DataFrame
    at: str
    payload: Sequence[str]
    ties: Sequence[str]
    extra: Column | None = None


@dataclass(frozen=True)
class Ask:
    """A question of every row: the last quote of a source at or before a time, or the first at or after it."""

    source: str
    at: Column
    direction: str = "backward"
    extra: Column | None = None


def lookups(rows: DataFrame, keys: Sequence[str], asks: dict[str, Ask], sources: dict[str, Source], bucket_ms: int = HOUR_MS) -> DataFrame:
    """Several left as-of joins in one pass. Adds a struct column (payload fields and ``at_ms``) for each ask, null where none matches.

    The rows are written once. Their questions become narrow probes (row, key, time), and quotes of all sources and probes share one reduction
    to instants, one pass over the buckets in either direction, and one join back: by row, or by instant where there is only one question.
    Sources with a further key go in a pass of their own, so that all others share their instants. A question or quote with a null further
    key matches nothing.
    """
    passes = [{n: a for n, a in asks.items() if (sources[a.source].extra is not None) == keyed} for keyed in (False, True)]
    if any((a.extra is not None) != keyed for keyed, mine in enumerate(passes) for a in mine.values()):
        raise ValueError("a question has a further key where its source has one, and only there")
    many = any(len(mine) > 1 for mine in passes)
    held = scratch.keep(rows.withColumn("_row", F.monotonically_increasing_id()) if many else rows, "probes")
    out = held
    for mine in filter(None, passes):
        found = _found(held, keys, mine, {a.source: sources[a.source] for a in mine.values()}, bucket_ms)
        if len(mine) > 1:
            out = out.join(found, "_row", "left")
        else:
            place = _place(*mine.values())
            out = out.withColumns(place).join(found, [*place, *keys], "left").drop(*place)
    return out.select(*rows.columns, *asks)


def _place(a: Ask) -> dict[str, Column]:
    """The instant of a question, with its further key."""
    further = {} if a.extra is None else {"_extra": a.extra.cast("string")}
    return {"_t": a.at.cast("bigint"), **further}


def _is_flat(s: Source) -> bool:
    """Whether the reduction can hash: fields of fixed width, one whole number for ties. Spark sorts to aggregate structs and strings."""
    types = dict(s.quotes.dtypes)
    whole = ("tinyint", "smallint", "int", "bigint")
    return len(s.ties) == 1 and types[s.ties[0]] in whole and all(types[c] in (*whole, "boolean", "float", "double", "date", "timestamp") for c in s.payload)


def _found(held: DataFrame, keys: Sequence[str], asks: dict[str, Ask], sources: dict[str, Source], bucket_ms: int) -> DataFrame:
    """(``_row``, a struct of each ask) of the rows with an answer; of a single ask by instant instead. Either all sources have a further key or none has."""
    keyed = any(s.extra is not None for s in sources.values())
    further = lambda c: [c.cast("string").alias("_extra")] if keyed else []
    key = [*keys, "_extra"] if keyed else list(keys)
    known = F.col("_t").isNotNull() & (F.col("_extra").isNotNull() if keyed else F.lit(True))
    flat = {n: _is_flat(s) for n, s in sources.items()}
    width = {n: len(s.payload) if flat[n] else 1 for n, s in sources.items()}
    marks = None
    for n, s in sources.items():
        cells = [F.col(c) for c in s.payload] if flat[n] else [F.struct(*s.payload)]
        tie = F.coalesce(F.col(s.ties[0]).cast("bigint"), F.lit(-(2**63))) if flat[n] else F.struct(*s.ties)
        part = s.quotes.select(
            *keys, *further(s.extra), F.col(s.at).cast("bigint").alias("_t"), F.lit(True).alias(f"_is_{n}"), tie.alias(f"_tie_{n}"),
            *[c.alias(f"_{n}_{i}") for i, c in enumerate(cells)],
        ).filter(known)
        marks = part if marks is None else marks.unionByName(part, allowMissingColumns=True)
    row = ["_row"] if len(asks) > 1 else []
    questions = [F.struct(F.lit(i).alias("_ask"), *[c.alias(n) for n, c in _place(a).items()]) for i, a in enumerate(asks.values())]
    probes = held.select(*row, *keys, F.inline(F.array(*questions))).filter(known)
    # Only the directions asked for. Times come first in keys of sorts: comparing the first few bytes then settles most pairs of rows.
    ways = sorted({(a.source, a.direction) for a in asks.values()})
    picks = {"backward": (F.max_by, F.max), "forward": (F.min_by, F.min)}
    cell = lambda n, d: [f"_{n}_{i}_{d}" for i in range(width[n])]
    instants = (
        marks.unionByName(probes.select(*key, "_t", F.lit(True).alias("_probe")), allowMissingColumns=True)
        .groupBy("_t", *key)
        .agg(
            *[F.max(f"_is_{n}").alias(f"_is_{n}") for n in sources], F.max("_probe").alias("_probe"),
            *[picks[d][0](f"_{n}_{i}", f"_tie_{n}").alias(c) for n, d in ways for i, c in enumerate(cell(n, d))],
        )
        .withColumn("_bucket", F.floor(F.col("_t") / F.lit(bucket_ms)))
    )
    # Read twice below, so written: Spark doesn't share the work of equal branches above an inline or explode.
    instants = scratch.keep(instants, "instants")
    place = ["_bucket", *key]
    at = lambda n: F.when(F.col(f"_is_{n}"), F.col("_t"))
    buckets = instants.groupBy(*place).agg(
        F.max("_probe").alias("_probe"), *[picks[d][1](at(n)).alias(f"_at_{n}_{d}") for n, d in ways],
        *[picks[d][0](c, at(n)).alias(c) for n, d in ways for c in cell(n, d)],
    )

    def quote(n: str, d: str, at_ms: Column) -> Column:
        cells = [F.col(c) for c in cell(n, d)] if flat[n] else [F.col(cell(n, d)[0])[c] for c in sources[n].payload]
        return F.when(at_ms.isNotNull(), F.struct(*[c.alias(f) for c, f in zip(cells, sources[n].payload, strict=True)], at_ms.alias("at_ms")))

    last = lambda q, rows, end: F.last(q, ignorenulls=True).over(rows.rowsBetween(Window.unboundedPreceding, end))
    across = lambda d: Window.partitionBy(*key).orderBy("_bucket" if d == "backward" else F.col("_bucket").desc())
    beside = buckets.select(*place, "_probe", *[last(quote(n, d, F.col(f"_at_{n}_{d}")), across(d), -1).alias(f"_q_{n}_{d}") for n, d in ways])
    beside = beside.filter("_probe").drop("_probe")
    # What lies beside a bucket has no time of its own and comes first.
    series = instants.select(*place, "_t", "_probe", *[quote(n, d, at(n)).alias(f"_q_{n}_{d}") for n, d in ways]).unionByName(beside, allowMissingColumns=True)
    within = lambda d: Window.partitionBy(*place).orderBy(F.col("_t").asc_nulls_first() if d == "backward" else F.col("_t").desc_nulls_first())
    answers = series.select(*key, "_t", "_probe", *[last(F.col(f"_q_{n}_{d}"), within(d), Window.currentRow).alias(f"_q_{n}_{d}") for n, d in ways])
    answers = answers.filter("_probe").drop("_probe")
    answer = lambda a: F.col(f"_q_{a.source}_{a.direction}")
    if len(asks) == 1:
        return answers.select("_t", *key, *[answer(a).alias(n) for n, a in asks.items()])
    met = probes.join(answers, ["_t", *key])
    fields = lambda a: [*sources[a.source].payload, "at_ms"]
    one = lambda i, a, f: F.any_value(F.when(F.col("_ask") == i, answer(a)[f]), ignoreNulls=F.lit(True))
    found = met.groupBy("_row").agg(*[one(i, a, f).alias(f"_{i}_{f}") for i, a in enumerate(asks.values()) for f in fields(a)])
    whole = lambda i, a: F.when(F.col(f"_{i}_at_ms").isNotNull(), F.struct(*[F.col(f"_{i}_{f}").alias(f) for f in fields(a)]))
    return found.select("_row", *[whole(i, a).alias(n) for i, (n, a) in enumerate(asks.items())])
