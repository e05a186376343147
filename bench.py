"""Time the headline queries. Prints one JSON line; BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "e16_mean_markout_by_symbol",
    "c1_bucket_trades",
    "h1_h8_block_features",
    "b9_market_state_columns",
    "e3_rolling_signed_volume",
    "d2_ohlcv_1m",
    "d18_edge_screen",
    "d24_risk_window_f1",
    "e8_c17_position_ledger",
    "e6_drawdown",
    "d5_inventory_stats",
    "c5_c6_realized_spread_markout",
    "d9_window_split_pnl",
    "d26_d27_ab_summary",
    "b14_quote_whatif",
    "c16_j2_fill_upper",
    "d32_fill_decomp",
    "d38_reject_breakdown",
    "d41_latency_stats",
    "i4_stream_ohlcv",
]


def main() -> None:
    from tideblock.plans import all_queries
    from tideblock.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    known = all_queries()
    names = sys.argv[1:] or HEADLINE
    known["d4_run_basics"].build(spark, folder).write.format("noop").mode("overwrite").save()  # start the JVM and the codecs
    times = {}
    for name in names:
        start = time.perf_counter()
        known[name].build(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(folder).name.removeprefix("sf")}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
