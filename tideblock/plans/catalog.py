"""Registry of queries: a Spark callable and, where SQL can say the same, the SQL text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideblock.plans.views import with_ctes

Build = Callable[[SparkSession, str], DataFrame]
# How results are compared: doubles to nine digits behind the point, fewer for large ones, so to 9 to 12 significant digits. A hundredth of
# the last unit or so is added first: an exact tie must not hang on the last bit of a sum.
STEPS = [(1e9, 0), (1e6, 3), (1e3, 6), (0.0, 9)]
TIE = 0.0137


@dataclass(frozen=True)
class Query:
    build: Build
    needs: str
    text: str | None
    doubles: str
    ints: str
    digits: int = 9

    @property
    def sql(self) -> str | None:
        """The SQL with its views, and with columns rounded and cast like the Spark side of :meth:`compared`."""
        if self.text is None:
            return None
        swaps = [f"{_rounded_sql(f'CAST({c} AS DOUBLE)', self.digits)} AS {c}" for c in self.doubles.split()]
        swaps += [f"CAST({c} AS BIGINT) AS {c}" for c in self.ints.split()]
        inner = with_ctes(self.needs, self.text) if self.needs else self.text
        return f"SELECT * REPLACE ({', '.join(swaps)}) FROM ({inner})" if swaps else inner

    def compared(self, spark: SparkSession, sf: str) -> DataFrame:
        """The result as it is compared with the SQL: doubles rounded, decimals as doubles, small integers as bigint. ``build`` alters nothing."""
        df = self.build(spark, sf)
        out = {}
        for f in df.schema.fields:
            if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
                out[f.name] = _rounded(F.col(f.name).cast("double"), self.digits)
            elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
                out[f.name] = F.col(f.name).cast("bigint")
        return df.withColumns(out) if out else df


def _rounded(x: Column, most: int) -> Column:
    out = None
    steps = [(least, min(digits, most)) for least, digits in STEPS]
    for least, digits in reversed(steps):
        value = F.round(x + F.lit(TIE * 10.0**-digits), digits) + F.lit(0.0)
        out = value if out is None else F.when(F.abs(x) >= least, value).otherwise(out)
    return out


def _rounded_sql(x: str, most: int) -> str:
    steps = [(least, min(digits, most)) for least, digits in STEPS]
    cases = " ".join(f"WHEN abs({x}) >= {least!r}::DOUBLE THEN round({x} + {TIE * 10.0**-digits!r}::DOUBLE, {digits})" for least, digits in steps)
    return f"(CASE {cases} END + 0.0::DOUBLE)"


QUERIES: dict[str, Query] = {}


def query(name: str, needs: str = "", sql: str | None = None, doubles: str = "", ints: str = "", digits: int = 9) -> Callable[[Build], Build]:
    """Register a query. ``needs`` names the CTEs of ``sql``; ``doubles`` and ``ints`` its columns to round or cast, to at most ``digits``."""

    def register(build: Build) -> Build:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(build, needs, sql, doubles, ints, digits)
        return build

    return register
