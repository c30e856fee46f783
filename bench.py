"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the data and the local cores. Every query is run to completion into a no-op
sink, so all of its columns and rows are computed.
"""

from __future__ import annotations

import json
import os
import time

from marketpulse.checks.registry import Frames
from marketpulse.operators import attribution as K
from marketpulse.operators import auction as A
from marketpulse.operators import coherency as G
from marketpulse.operators import latest as L
from marketpulse.operators import scopes as Z
from marketpulse.operators import screening as H
from marketpulse.operators import strength as S
from marketpulse.plans import candidates as N
from marketpulse.plans import dashboards as D
from marketpulse.session import build_session


def queries(t: Frames):
    return {
        "g2_group_strength": lambda: S.group_strength(t.bars, t.current),
        "g5_multi_period": lambda: S.multi_period_strength(t.bars, t.current),
        "g5_multi_period_long": lambda: S.multi_period_strength(t.long_bars, t.long_members, min_members=3),
        "k2_daily_attribution": lambda: K.daily_attribution(
            t.bars, t.members, t.groups, t.scope.select("group_id").distinct()),
        "m1_dashboard": lambda: D.intraday_dashboard(t.ticks, t.scope, t.groups, t.members, "14:30").members,
        "m9_replay": lambda: D.replay(t.ticks, t.scope),
        "g6_coherency": lambda: G.coherency(t.bars, t.current),
        "g6_coherency_long": lambda: G.coherency(t.long_bars, t.long_members),
        "g11_auction_groups": lambda: A.auction_groups(
            A.auction_score(A.auction_factors(t.ticks, L.prev_volume(t.bars), "09:25")), t.custom, t.custom_names),
        "m6_candidates": lambda: N.candidates(t.bars, t.members, t.groups, t.watched),
        "g15_classify_hits": lambda: H.classify_hits(
            Z.screen(t.bars, change_lo=7.0).select("trade_date", "code", t.bars["code"].alias("name"), "change_ratio"),
            t.custom, t.custom_names).groups,
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
                          spark__ui__enabled="false", spark__driver__memory="12g",
                          spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    frames = Frames(spark, sf_dir)
    frames.table("events").count()  # start the executors before the clock
    timings = {}
    only = os.environ.get("BENCH_ONLY")
    for name, build in queries(frames).items():
        if only and name not in only.split(","):
            continue
        began = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({
        "metric": "total wall time of the headline queries", "value": round(sum(timings.values()), 3),
        "unit": "sec", "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }), flush=True)


if __name__ == "__main__":
    main()
