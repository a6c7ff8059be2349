"""Animations whose frames arrive as a stream, composed with one canvas of state for each."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.animation import MAX_DURATION

STATE = "next long, frame_idx long, start_ms long, duration_ms long, canvas string, waiting string"
OUT = "anim_id long, frame_idx long, start_ms long, duration_ms long, canvas string"


def merged_frames(frames: DataFrame, idle: str = "10 minutes") -> DataFrame:
    """``frames(anim_id, frame_idx, duration_ms, canvas, ts)``, numbered from 0, in any order -> runs of equal canvases, as they
    end; an animation that is idle for as long as ``idle`` (by watermark of ``ts``) gives what it still has and is forgotten.

    State is, for each live animation, one open run (the canvas's name, its first frame, start and duration so far), the number of
    the next frame, and the frames that came before it and wait. Of two frames with one number the first to come counts. A gap
    that isn't filled before the animation goes idle is passed over then. A run whose duration would pass the format's 24
    bits is closed and begun anew.
    """
    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, *run, waiting = state.get if state.exists else (0, None, None, None, None, "{}")
        run = None if run[0] is None else tuple(run)
        waiting = {int(k): v for k, v in json.loads(waiting).items()}
        out, ended, latest = [], state.hasTimedOut, 0
        if not ended:
            rows = pd.concat(list(batches))
            latest = int(rows.ts.max().timestamp() * 1000)
            for r in rows.itertuples(index=False):
                if r.frame_idx >= number:
                    waiting.setdefault(int(r.frame_idx), [int(r.duration_ms), r.canvas])
        while waiting and (ended or number in waiting):
            number = number if number in waiting else min(waiting)
            duration, canvas = waiting.pop(number)
            if run is not None and run[3] == canvas and run[2] + duration <= MAX_DURATION:
                run = (run[0], run[1], run[2] + duration, canvas)
            else:
                if run is not None:
                    out.append((key[0], *run))
                run = (number, run[1] + run[2] if run is not None else 0, duration, canvas)
            number += 1
        if ended:
            out += [(key[0], *run)] if run is not None else []
            state.remove()
        else:
            state.update((number, *(run or (None,) * 4), json.dumps(waiting)))
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), latest) + 1 + pd.Timedelta(idle).value // 1_000_000)
        yield pd.DataFrame(out, columns=["anim_id", "frame_idx", "start_ms", "duration_ms", "canvas"])

    return frames.withWatermark("ts", idle).groupBy("anim_id").applyInPandasWithState(fold, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
