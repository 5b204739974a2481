"""Streams of points: windowed sums of late data, and contours split at gaps as points arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """``start, object, n, total`` for each window of time, closed ``late`` after its end."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    sums = events.withWatermark("ts", late).groupBy(window.alias("w"), "object").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return sums.select(F.col("w.start").alias("start"), "object", "n", "total")


def sessions(events: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """``start, end, object, n`` of runs of events without a pause of ``gap``."""
    runs = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "object").agg(F.count("*").alias("n"))
    return runs.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "object", "n")


def split_stream(points: DataFrame, most: float) -> DataFrame:
    """``object, idx, contour`` of points ``object, idx, z, value`` that arrive in order of ``idx`` for each object.

    The state of an object is its last point and contour number.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        z, value, contour = state.get if state.exists else (None, None, 0)
        for pdf in batches:
            rows = []
            for idx, new_z, new in pdf.sort_values("idx")[["idx", "z", "value"]].itertuples(index=False):
                if z is None or new_z != z or abs(new - value) > most:
                    contour += 1
                z, value = int(new_z), float(new)
                rows.append((key[0], int(idx), contour))
            yield pd.DataFrame(rows, columns=["object", "idx", "contour"])
        if z is not None:
            state.update((z, value, contour))

    kind = points.schema["object"].dataType.simpleString()
    return points.groupBy("object").applyInPandasWithState(step, f"object {kind}, idx long, contour int", "z int, value double, contour int", "append", GroupStateTimeout.NoTimeout)
