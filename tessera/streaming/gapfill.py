"""Gap filling over a stream of pixels with state bounded by the date limit.

A value is settled once the stream has passed its date by ``limit_days``: then
every neighbour it may use has been seen.  State holds the last ``limit_days``
usable values of a pixel and those still waiting.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.interpolation import CLEAR, FILLED, LEFT_OUT

OUT = "tag string, y int, x int, band int, date int, value double, state int"
STATE = "dates array<int>, values array<double>, flags array<boolean>, done int"


def settle_series(dates: list[int], values: list[float], flags: list[bool], done: int, limit: int, final: bool) -> tuple[list[tuple[int, float | None, int]], int]:
    """Values that can be settled now (date, value, state), and the last settled date."""
    rows = sorted(zip(dates, values, flags, strict=True))
    newest = rows[-1][0] if rows else done
    # the nearest usable value on either side, by one pass each way
    before, after = [None] * len(rows), [None] * len(rows)
    for side, order in ((before, range(len(rows))), (after, range(len(rows) - 1, -1, -1))):
        last = waiting = None
        for i in order:
            d, v, flag = rows[i]
            if waiting is not None and waiting[0] != d:
                last, waiting = waiting, None
            side[i] = last
            if not flag:
                waiting = (d, v)
    out = []
    for (d, v, flag), left, right in zip(rows, before, after, strict=True):
        if d <= done or (not final and d + limit > newest):
            continue
        done = d
        if not flag:
            out.append((d, v, CLEAR))
            continue
        left = left if left and left[0] >= d - limit else None
        right = right if right and right[0] <= d + limit else None
        if left and right:
            out.append((d, left[1] + (d - left[0]) * (right[1] - left[1]) / (right[0] - left[0]), FILLED))
        elif left or right:
            out.append((d, (left or right)[1], FILLED))
        else:
            out.append((d, v, LEFT_OUT))
    return out, done


def fill(stream: DataFrame, limit_days: int = 5, idle: int | None = None) -> DataFrame:
    """``stream`` has tag, y, x, band, date, value and flag (asks for interpolation), dates rising by pixel.

    With ``idle``, a pixel without news for so many milliseconds is taken as ended: what
    waits is settled with the neighbours it has, and its state goes.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        dates, values, flags, done = ([*state.get[0]], [*state.get[1]], [*state.get[2]], state.get[3]) if state.exists else ([], [], [], -(2**31))
        for pdf in batches:
            dates += pdf["date"].tolist()
            values += pdf["value"].tolist()
            flags += pdf["flag"].astype(bool).tolist()
        ended = state.hasTimedOut
        out, done = settle_series(dates, values, flags, done, limit_days, ended)
        # a settled date no waiting one can reach is forgotten
        keep = [i for i, d in enumerate(dates) if d > done - limit_days]
        if ended:
            state.remove()
        else:
            state.update(([dates[i] for i in keep], [values[i] for i in keep], [flags[i] for i in keep], done))
            if idle is not None:
                state.setTimeoutDuration(idle)
        if out:
            tag, y, x, band = key
            yield pd.DataFrame({"tag": tag, "y": y, "x": x, "band": band, "date": [o[0] for o in out], "value": [o[1] for o in out], "state": [o[2] for o in out]})

    return stream.groupBy("tag", "y", "x", "band").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout)
