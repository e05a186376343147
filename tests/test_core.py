"""Chunked scans, as-of joins and exact quantiles against brute force, with one hot key."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideblock.operators import ordered as o
from tideblock.operators.asof import Ask, Source, asof, lookups
from tideblock.operators.quantiles import Index, quantiles, summary


def series(n=600, seed=1, span=60):
    """Half of the rows under one key, many ties of time, some nulls."""
    rng = random.Random(seed)
    return [
        ("hot" if rng.random() < 0.5 else f"k{rng.randrange(3)}", rng.randrange(span), i, rng.choice([None, 1.0, 2.5, -1.0, 4.0]))
        for i in range(n)
    ]


def by_key(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        out[r[0]].append(r)
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_scan_equals_a_plain_loop(spark, many_chunks, parts):
    rows = series()
    df = spark.createDataFrame(rows, "k string, t bigint, i bigint, v double").repartition(parts)
    x = F.col("v")
    out = o.over(
        df, ["k"], ["t", "i"], s=o.running_sum(x), hi=o.running_max(x), lo=o.running_min(x), last=o.last_seen(x), before=o.last_before(x),
        prev=o.previous(x), nxt=o.following(x), n=o.row_count(),
    )
    got = {r.i: (r.s, r.hi, r.lo, r.last, r.before, r.prev, r.nxt, r.n) for r in out.collect()}
    assert len(got) == len(rows)
    for ks in by_key(rows).values():
        s = hi = lo = last = prev = None
        for j, (_, _, i, v) in enumerate(ks):
            before = last
            if v is not None:
                s, last = (s or 0.0) + v, v
                hi, lo = (v if hi is None else max(hi, v)), (v if lo is None else min(lo, v))
            nxt = ks[j + 1][3] if j + 1 < len(ks) else None
            assert got[i] == (s, hi, lo, last, before, prev, nxt, j + 1)
            prev = v


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("strict", [False, True])
def test_asof_equals_a_search(spark, direction, strict):
    rows = series()
    keyed = by_key(rows)
    rng = random.Random(2)
    asked = [(rng.choice(["hot", "k0", "k1", "none"]), rng.choice([None, *range(-3, 64)]), i) for i in range(300)]
    probes = spark.createDataFrame(asked, "k string, t bigint, p bigint")
    quotes = spark.createDataFrame(rows, "k string, t bigint, i bigint, v double")
    out = asof(
        probes, quotes, ["k"], at="t", quote_at="t", payload=["v", "i"], ties=["i"], direction=direction, strict=strict, bucket_ms=7
    ).collect()
    assert len(out) == len(asked)
    for r in out:
        fits = []
        if r.t is not None:
            for q in keyed.get(r.k, []):
                late = q[1] > r.t if direction == "backward" else q[1] < r.t
                if not late and not (strict and q[1] == r.t):
                    fits.append(q)
        best = None
        if fits:
            best = max(fits, key=lambda q: (q[1], q[2])) if direction == "backward" else min(fits, key=lambda q: (q[1], q[2]))
        assert (None if r.quote is None else (r.quote.v, r.quote.i, r.quote.at_ms)) == (None if best is None else (best[3], best[2], best[1]))


def test_quantiles_equal_numpy(spark, many_chunks):
    rng = np.random.default_rng(3)
    rows = [("a", float(round(x, 1))) for x in rng.normal(size=500)] + [("b", 2.0)] * 300 + [("c", 7.0), ("d", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    points = [0.0, 0.1, 0.25, 0.333, 0.5, 0.99, 1.0]
    got = {(r.k, r.p): r.q for r in quantiles(df, ["k"], "x", points).collect()}
    assert {k for k, _ in got} == {"a", "b", "c"}
    for k in "abc":
        xs = [x for g, x in rows if g == k]
        for p in points:
            assert got[k, p] == pytest.approx(float(np.quantile(xs, p)), abs=1e-12)


def test_weighted_quantiles_and_summary(spark):
    rows = [(1.0, 3), (2.0, 1), (5.0, 4)]
    flat = [1.0] * 3 + [2.0] + [5.0] * 4
    df = spark.createDataFrame(rows, "x double, w bigint")
    got = {r.p: r.q for r in quantiles(df, [], "x", [0.25, 0.4, 0.5], weight="w").collect()}
    assert got == {p: pytest.approx(float(np.quantile(flat, p))) for p in (0.25, 0.4, 0.5)}
    s = summary(spark.createDataFrame([(x,) for x in flat], "x double"), [], "x").first()
    assert (s["count"], s["mean"], s["median"], s["p90"]) == (8, 25 / 8, 3.5, 5.0)


@pytest.mark.parametrize(("parts", "block"), [(1, 2), (7, 4), (7, 256)])
def test_fold_equals_a_plain_loop(spark, many_chunks, parts, block):
    """An operation that is associative but not commutative: joining texts, cut to their last 40 characters."""
    rows = series()
    df = spark.createDataFrame(rows, "k string, t bigint, i bigint, v double").repartition(parts)
    chunks = o.chunk(df, ["k"], ["t", "i"])
    out = o.fold(chunks, ["k"], ["t", "i"], "text", F.concat(F.col("i").cast("string"), F.lit(" ")), lambda a, b: F.right(F.concat(a, b), F.lit(40)), block)
    got = {r.i: r.text for r in out.collect()}
    assert len(got) == len(rows) and set(out.columns) == {"k", "t", "i", "v", o.CHUNK, "text"}
    for ks in by_key(rows).values():
        want = ""
        for _, _, i, _ in ks:
            want = (want + f"{i} ")[-40:]
            assert got[i] == want


def test_fold_of_no_rows(spark):
    none = spark.createDataFrame([], "k string, t bigint")
    assert o.fold(o.chunk(none, ["k"], ["t"]), ["k"], ["t"], "x", F.col("t"), lambda a, b: a + b).count() == 0


def test_lookups_equal_single_asof_joins(spark, many_chunks):
    """Three sources, one with a further key, both directions, null times and keys, in buckets of a few instants."""
    rng = random.Random(8)
    probes = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(4)}", None if i % 23 == 0 else rng.randrange(80), i, rng.choice(["x", "y", None])) for i in range(200)]
    quotes = series(300, 5, 80)
    rows = spark.createDataFrame(probes, "k string, t bigint, i bigint, side string")
    q = spark.createDataFrame([(*r, "xyz"[r[2] % 3] if r[2] % 7 else None) for r in quotes], "k string, t bigint, n bigint, v double, s string")
    other = q.filter("n % 5 = 0").select("k", "t", "n", (F.col("n") * 2).cast("string").alias("w"))
    asks = {
        "back": Ask("all", F.col("t")), "late": Ask("all", F.col("t") + 7, "forward"), "sided": Ask("side", F.col("t"), extra=F.col("side")),
        "sided_next": Ask("side", F.col("t"), "forward", F.col("side")), "other": Ask("other", F.col("t") - 3),
    }
    sources = {"all": Source(q, "t", ["n", "v"], ["n"]), "side": Source(q, "t", ["n"], ["n"], F.col("s")), "other": Source(other, "t", ["w"], ["n"])}
    got = {r.i: r for r in lookups(rows, ["k"], asks, sources, bucket_ms=9).collect()}
    assert len(got) == 200 and set(got[0].asDict()) == {"k", "t", "i", "side", *asks}

    def one(ask):
        source = sources[ask.source]
        keys = ["k"] if source.extra is None else ["k", "_x"]
        extra = F.lit("") if source.extra is None else source.extra
        asked = rows.withColumn("_x", F.lit("") if ask.extra is None else ask.extra)
        # An as-of join in its own right; null further keys match nothing there either.
        out = asof(asked, source.quotes.withColumn("_x", extra), keys, at=ask.at, quote_at="t", payload=list(source.payload), ties=list(source.ties), direction=ask.direction, into="a")
        return {r.i: r.a for r in out.collect()}

    for name, ask in asks.items():
        want = one(ask)
        assert all(got[i][name] == want[i] for i in want)
        assert any(x is None for x in want.values()) and any(x is not None for x in want.values())


def test_index_serves_several_groupings_and_sums(spark, many_chunks):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else "k", rng.choice("ab"), rng.choice([None, float("nan"), *[i / 4 for i in range(30)]]), rng.choice([None, 1.0, 1e17, -2.5])) for _ in range(500)]
    df = spark.createDataFrame(rows, "k string, g string, x double, y double")
    points = [0.0, 0.2, 0.5, 0.9, 1.0]
    ok = [r for r in rows if r[2] is not None and r[2] == r[2]]
    index = Index(df, ["k"], "x", ["g"])
    for group in ([], ["g"]):
        for r in index.at(points, group).collect():
            x = [v for k, g, v, _ in ok if k == r.k and (not group or g == r.g)]
            assert r.q == pytest.approx(np.quantile(x, r.p))
        for r in index.summary(group).withColumn("g", F.lit(None) if not group else F.col("g")).collect():
            x = [v for k, g, v, _ in ok if k == r.k and (not group or g == r.g)]
            assert (r["count"], r["mean"], r["median"]) == (len(x), pytest.approx(np.mean(x)), pytest.approx(np.median(x)))
    both = index.summary([], ["g"]).collect()
    assert sorted((r.k, r.g or "", r.grouping, r["count"]) for r in both) == sorted(
        (k, g, i, sum(r[0] == k and (not g or r[1] == g) for r in ok)) for k in ("hot", "k") for i, gs in enumerate(([""], ["a", "b"])) for g in gs
    )
    sums = Index(df, ["k", "g"], "x", sums={"y": F.col("y").cast("decimal(38,18)")}).at(points)
    for r in sums.collect():
        own = [(v, y or 0.0) for k, g, v, y in ok if (k, g) == (r.k, r.g)]
        assert (r.below_n, r.upto_n) == (sum(v < r.q for v, _ in own), sum(v <= r.q for v, _ in own))
        assert (float(r.below_y), float(r.upto_y)) == (math.fsum(y for v, y in own if v < r.q), math.fsum(y for v, y in own if v <= r.q))
    with pytest.raises(ValueError, match="finest"):
        Index(df, ["k"], "x", ["g"], sums={"y": F.col("y")}).at(points)
