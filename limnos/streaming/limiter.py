"""Request limits on a live stream: a counter per user, path and window, kept while the window is open."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from limnos.operators.limits import DEFAULT_LIMIT, DEFAULT_PERIOD, windowed

KEY = ["user_id", "path", "window_start", "limit", "period"]
# Groups that counters are kept in.
SHARDS = 256


def flag_stream(
    requests: DataFrame,
    limit: int = DEFAULT_LIMIT,
    period: int = DEFAULT_PERIOD,
    watermark: str = "10 minutes",
    event: str = "event_id",
    shards: int = SHARDS,
) -> DataFrame:
    """A stream of requests with ``window_start`` and ``limited``, each flagged in the micro-batch that it arrives in.

    The first ``limit`` requests of a window pass: those of earlier micro-batches first, within one by time and ``event``. So where
    requests arrive in their order the flags are those of :func:`limnos.operators.limits.flag_limited`. The counter of a window is the only
    state; it goes when the watermark has passed the window's end, and the state shrinks to the windows that are still open. A request that arrives behind the
    watermark is left out and counted in the query's progress; one without a time is left out. A row's own ``limit`` and ``period`` come first.

    Counters lie together in ``shards`` by the hash of their window, so a micro-batch calls Python once for each shard, however many windows it brings;
    the number is fixed for the life of a checkpoint. A task takes one shard after another and holds no more than ``limit`` requests of each of its windows,
    however many arrive at once.
    """
    keyed = windowed(requests.filter(F.col("ts").isNotNull()).withWatermark("ts", watermark), limit, period)
    untold = F.raise_error(F.lit("a request has no limit or no period"))
    keyed = keyed.withColumns({c: F.coalesce(F.col(c).cast("long"), untold) for c in ("limit", "period")})
    # pandas makes whole numbers with nulls floats: they go without their nulls, which go beside them.
    whole = [f.name for f in keyed.schema if f.nullable and isinstance(f.dataType, T.IntegralType)]
    absent = {c: f"_no_{c}" for c in whole}
    kept = keyed.withColumns({name: F.col(c).isNull() for c, name in absent.items()})
    kept = kept.withColumns({
        "_window": F.to_json(F.array(*[F.col(c).cast("string") for c in KEY])),
        "_end": F.coalesce(F.col("window_start") + F.col("period"), F.lit(0)),
        "_shard": F.pmod(F.xxhash64(*KEY), F.lit(shards)),
    })
    kept = kept.withColumns({c: F.coalesce(c, F.lit(0).cast(keyed.schema[c].dataType)) for c in whole})
    handed = [f for f in kept.schema if f.name not in ("_window", "_end", "_shard")]
    names = [f.name for f in handed]
    flagged = T.StructType([*handed, T.StructField("limited", T.BooleanType())])
    order = ["_window", "ts", *([absent[event]] if event in absent else []), event]

    def judge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before, ends = _unpacked(state.get[0]) if state.exists else ({}, {})
        seen, passing = dict(before), None
        for frame in () if state.hasTimedOut else frames:
            code, windows = pd.factorize(frame["_window"])
            end = np.zeros(len(windows), dtype="int64")
            end[code] = frame["_end"].to_numpy()
            for window, many, until in zip(windows, np.bincount(code).tolist(), end.tolist(), strict=True):
                seen[window] = seen.get(window, 0) + many
                ends[window] = until
            free = frame["limit"].to_numpy() - np.array([before.get(window, 0) for window in windows], dtype="int64")[code]
            if (free <= 0).any():
                yield told(frame[free <= 0], True)
            # The first so far may still be overtaken by a request of a later part; what does not fit beside them cannot pass.
            frame = frame[free > 0].assign(_free=free[free > 0])
            held = (frame if passing is None else pd.concat([passing, frame])).sort_values(order, kind="stable", na_position="last")
            over = (held.groupby("_window", sort=False).cumcount() >= held["_free"]).to_numpy()
            if over.any():
                yield told(held[over], True)
            passing = held[~over]
        if passing is not None and len(passing):
            yield told(passing, False)
        # Requests of a window that the watermark has passed are not handed on from the next micro-batch.
        watermark = state.getCurrentWatermarkMs()
        ends = {window: end for window, end in ends.items() if end * 1000 > watermark}
        if ends:
            state.update((_packed(seen, ends),))
            state.setTimeoutTimestamp(min(ends.values()) * 1000)
        elif state.exists:
            state.remove()

    def told(frame: pd.DataFrame, limited: bool) -> pd.DataFrame:
        return frame[names].assign(limited=limited)

    judged = kept.groupBy("_shard").applyInPandasWithState(judge, flagged, "counters binary", "append", GroupStateTimeout.EventTimeTimeout)
    return judged.withColumns({c: F.when(~F.col(name), F.col(c)) for c, name in absent.items()}).select(
        *requests.columns, *[c for c in ("window_start",) if c not in requests.columns], "limited"
    )


def _packed(seen: dict[str, int], ends: dict[str, int]) -> bytes:
    """The counters of a shard's open windows as an Arrow stream."""
    table = pa.table({"window": pa.array([*ends], pa.string()), "seen": [seen[window] for window in ends], "end": [*ends.values()]})
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as stream:
        stream.write_table(table)
    return out.getvalue().to_pybytes()


def _unpacked(packed: bytes) -> tuple[dict[str, int], dict[str, int]]:
    counters = pa.ipc.open_stream(bytes(packed)).read_all().to_pydict()
    return dict(zip(counters["window"], counters["seen"], strict=True)), dict(zip(counters["window"], counters["end"], strict=True))
