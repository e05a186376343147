"""A place for user code on blocks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame

from tideblock.operators import ordered
from tideblock.operators.blocks import BLOCK


def user_strategy(
    blocks: DataFrame, keys: Sequence[str], decide: Callable[[pd.DataFrame], pd.DataFrame], schema: str
) -> DataFrame:
    """Apply ``decide`` to the blocks of each key in time order, a chunk at a time; orders do not feed back.

    ``decide`` gets pandas rows sorted by time and returns rows of ``schema``. Earlier state it needs must be a
    column (see the running columns in :mod:`tideblock.operators.ordered`).
    """
    chunks = ordered.chunk(blocks, keys, BLOCK)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return decide(pdf.sort_values(BLOCK).drop(columns=[ordered.CHUNK]))

    return chunks.groupBy(*keys, ordered.CHUNK).applyInPandas(run, schema)
