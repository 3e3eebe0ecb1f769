"""Folds of ordered rows as they come, with a few numbers of state or the positions of one dwell: no track and no log is ever
held. Each takes a table that Spark has partitioned and ordered; those of tracks take Arrow batches.

Rows with a null in what is folded are passed over."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.functions import lit, udtf

RADIUS_KM = 6371.0
FEW = 32


def apart_km(phi: float, lam: float, phi2: np.ndarray | float, lam2: np.ndarray | float) -> np.ndarray | float:
    across = (lam2 - lam + math.pi) % (2 * math.pi) - math.pi
    a = np.sin((phi2 - phi) / 2) ** 2 + np.cos(phi) * np.cos(phi2) * np.sin(across / 2) ** 2
    return 2 * RADIUS_KM * np.arcsin(np.minimum(1.0, np.sqrt(a)))


def distance_km(phi: float, lam: float, phi2: float, lam2: float) -> float:
    across = (lam2 - lam + math.pi) % (2 * math.pi) - math.pi
    a = math.sin((phi2 - phi) / 2) ** 2 + math.cos(phi) * math.cos(phi2) * math.sin(across / 2) ** 2
    return 2 * RADIUS_KM * math.asin(min(1.0, math.sqrt(a)))


def dwells_of(rows: Iterator[tuple], km: float, least: float) -> Iterator[tuple]:
    """(mmsi, dwell) of the first dwell near a moving anchor, of tracks of three or more positions: rows (mmsi, t, phi, lam) in order; None
    after each batch is handed on."""
    mmsi, n, dwell, since, phi, lam = None, 0, None, None, 0.0, 0.0
    for row in rows:
        if row is None:
            yield None
            continue
        if row[0] != mmsi:
            if dwell is not None and n >= 3:
                yield mmsi, dwell
            mmsi, n, dwell, since = row[0], 0, None, None
        n += 1
        if dwell is None:
            if since is None or distance_km(phi, lam, row[2], row[3]) > km:
                _, since, phi, lam = row
            elif row[1] - since > least:
                dwell = row[1] - since
    if dwell is not None and n >= 3:
        yield mmsi, dwell


def stays_of(rows: Iterator[tuple], km: float, least: float) -> Iterator[tuple]:
    """(mmsi, true) where all that follows some position stays near it for long: keeps the positions that nothing has left yet, which are
    those of one dwell at most; many as an array."""
    mmsi, found, starts = None, False, []
    for row in rows:
        if row is None:
            yield None
            continue
        if row[0] != mmsi:
            mmsi, found, starts = row[0], False, []
        if found:
            continue
        _, t, phi, lam = row
        if isinstance(starts, list):
            starts = [s for s in starts if distance_km(phi, lam, s[1], s[2]) <= km]
        else:
            starts = starts[:, apart_km(phi, lam, starts[1], starts[2]) <= km]
            starts = starts if starts.shape[1] > FEW else list(zip(*starts.tolist(), strict=True))
        first = (starts[0][0] if starts else t) if isinstance(starts, list) else starts[0, 0]
        if t - first > least:
            found = True
            yield mmsi, True
        elif isinstance(starts, list):
            starts.append((t, phi, lam))
            starts = starts if len(starts) <= FEW else np.array(starts).T
        else:
            starts = np.concatenate([starts, [[t], [phi], [lam]]], axis=1)


@udtf(returnType="key string, id long, t double, since double, opens boolean")
class Windows:
    """Of a key's moments in order, which open a window (the first, and each that comes no sooner than `width` after the last that
    did), and since when the window of each is open."""

    def __init__(self) -> None:
        self.last = None

    def eval(self, row: Row, width: float) -> Iterator[tuple]:
        key, identity, t = row
        if t is None:
            return
        opens = self.last is None or t >= self.last + width
        if opens:
            self.last = t
        yield key, identity, t, self.last, opens


def first_dwells(track: DataFrame, km: float, least: float) -> DataFrame:
    """mmsi, dwell (seconds)."""
    return folded(track, dwells_of, "dwell double", km, least)


def stays_near(track: DataFrame, km: float, least: float) -> DataFrame:
    """mmsi, loiters."""
    return folded(track, stays_of, "loiters boolean", km, least)


def folded(track: DataFrame, fold: Callable[..., Iterator[tuple]], value: str, km: float, least: float) -> DataFrame:
    """mmsi and a value of the vessels that the fold finds; a task sees its vessels one after another, each in order of time."""
    schema = f"mmsi {track.schema['mmsi'].dataType.simpleString()}, {value}"
    known = track.where("mmsi IS NOT NULL AND t IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, held = [], []

        def rows() -> Iterator[tuple]:
            for batch in batches:
                kinds[:] = [batch.schema.field("mmsi").type]
                yield from zip(*(batch.column(c).to_pylist() for c in ("mmsi", "t", "phi", "lam")), strict=True)
                yield None

        def made() -> pa.RecordBatch:
            kind = pa.float64() if value.endswith("double") else pa.bool_()
            return pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], kinds[0]), pa.array([h[1] for h in held], kind)], ["mmsi", value.split()[0]])

        for found in fold(rows(), km, least):
            if found is not None:
                held.append(found)
            elif held:
                yield made()
                held.clear()
        if held:
            yield made()

    placed = known.select("mmsi", "t", F.radians(F.col("lat").cast("double")).alias("phi"), F.radians(F.col("lon").cast("double")).alias("lam"), "ordinal")
    in_order = placed.repartition("mmsi").sortWithinPartitions("mmsi", "t", "ordinal").select("mmsi", "t", "phi", "lam")
    return in_order.mapInArrow(run, schema)


def windows(moments: DataFrame, width: float) -> DataFrame:
    """key, id, t, since, opens of each row of (key, id, t); moments that tie open once, the smallest id."""
    rows = moments.select(F.col("key").cast("string").alias("key"), F.col("id").cast("long").alias("id"), F.col("t").cast("double").alias("t"))
    return Windows(rows.asTable().partitionBy("key").orderBy("t", "id"), lit(width))
