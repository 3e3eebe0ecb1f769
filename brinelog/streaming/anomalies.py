"""The pairwise track anomalies over a stream of positions, with one position of state per vessel."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "mmsi long, t double, code string, severity double"


def pair_anomalies(positions: DataFrame) -> DataFrame:
    """Speed drops and gaps of a stream (mmsi, ordinal, t, speed). Within a micro-batch positions are put in order; late ones
    (before the last position seen) make no pair. State is the last position of each vessel."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        rows = pd.concat(batches).sort_values(["t", "ordinal"])
        found = []
        for t, speed in zip(rows["t"], rows["speed"], strict=True):
            if last is not None and t < last[0]:
                continue
            if last is not None:
                dt, drop = t - last[0], last[1] - speed
                if 0 < dt <= 600 and drop > 5:
                    found.append((int(key[0]), t, "speed_drop", min(1.0, drop / 15)))
                if dt > 1800:
                    found.append((int(key[0]), t, "ais_gap_long" if dt > 2700 else "ais_gap_short", min(1.0, dt / 60 / 180)))
            last = (float(t), float(speed))
        state.update(last)
        yield pd.DataFrame(found, columns=["mmsi", "t", "code", "severity"]).astype({"code": object})

    return positions.groupBy("mmsi").applyInPandasWithState(run, OUT, "t double, speed double", "append", GroupStateTimeout.NoTimeout)
