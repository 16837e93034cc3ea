"""Exact nearest-rank percentiles of one column without gathering its values: cells of an interval are counted, and each
target's cell becomes the next interval. A pass sees every row once and brings CELLS rows a target to the driver at most."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import stage

CELLS = 2048


def nearest_rank(df: DataFrame, column: str, permilles: tuple[int, ...], empty: float | None = None, passes: int = 60) -> DataFrame:
    """One row ``p<permille>``: the value of rank max(1, ceil(p n)); null and NaN are no values; ``empty`` if there are none."""
    v = F.col("v")
    data = stage(df.select(F.col(column).cast("double").alias("v")).where("v is not null and not isnan(v)"), "column")
    n, low, high = data.agg(F.count("*"), F.min("v"), F.max("v")).first()
    targets = {p: [low, high, max(1, -(-n * p // 1000)), n] for p in permilles} if n else {}
    for _ in range(passes):
        open_ = sorted({(t[0], t[1]) for t in targets.values() if t[0] < t[1]})
        if not open_:
            break
        parts = []
        for lo, hi in open_:
            # the ends are told apart whatever the rounding; halves, so that the width is a number
            share = (v / 2 - lo / 2) / (hi / 2 - lo / 2) if abs(lo) < float("inf") and abs(hi) < float("inf") else F.lit(0.5)
            cell = F.when(v <= lo, 0).when(v >= hi, CELLS + 1).otherwise(1 + F.least(F.lit(CELLS - 1), F.floor(share * CELLS))).cast("int")
            rows = data.where((v >= lo) & (v <= hi)).groupBy(cell.alias("cell")).agg(F.count("*").alias("c"), F.min("v").alias("a"), F.max("v").alias("b"))
            parts.append((lo, hi, sorted(rows.collect(), key=lambda r: r["cell"])))
        for t in targets.values():
            for lo, hi, cells in parts:
                if (t[0], t[1]) == (lo, hi):
                    for r in cells:
                        if t[2] <= r["c"]:
                            t[:] = [r["a"], r["b"], t[2], r["c"]]
                            break
                        t[2] -= r["c"]
                    break
    else:
        raise RuntimeError("the intervals did not close")
    values = [float(targets[p][0]) if n else empty for p in permilles]
    return df.sparkSession.createDataFrame([tuple(values)], ", ".join(f"p{p} double" for p in permilles))
