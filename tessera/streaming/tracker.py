"""The tracker over a stream: one state per source, frames put in order before they are tracked."""

from __future__ import annotations

import pickle

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.tracking import TRACKS, Tracker, run_tracker

COLUMNS = [c.split()[0] for c in TRACKS.split(", ")]
OUTPUT = TRACKS + ", track_id long"


class SourceState:
    """A tracker, ids given so far, and rows of frames that wait for an earlier frame."""

    def __init__(self):
        self.tracker, self.next_frame, self.ids = Tracker(), 0, {}
        self.next_id, self.waiting = 1, None

    def feed(self, rows: pd.DataFrame) -> pd.DataFrame:
        """Track the frames that now follow in order. A frame is complete when it comes, or marked by a null det_idx."""
        if self.waiting is not None:
            rows = pd.concat([self.waiting, rows])
        have = set(rows["frame_index"])
        upto = self.next_frame
        while upto in have:
            upto += 1
        ready, rest = rows[(rows["frame_index"] < upto) & (rows["frame_index"] >= self.next_frame)], rows[rows["frame_index"] >= upto]
        self.waiting = rest if len(rest) else None
        self.next_frame = upto
        if not len(ready):
            return pd.DataFrame(columns=[*COLUMNS, "track_id"])
        out = run_tracker(ready, self.tracker)
        # births come in frame and detection order, so ids are those of one serial run
        for birth in sorted(set(zip(out["birth_frame"], out["birth_det"])) - set(self.ids)):
            self.ids[birth], self.next_id = self.next_id, self.next_id + 1
        out["track_id"] = [self.ids[b] for b in zip(out["birth_frame"], out["birth_det"])]
        alive = {t.birth for t in self.tracker.live}
        self.ids = {b: i for b, i in self.ids.items() if b in alive}
        return out


def track_stream(detections: DataFrame) -> DataFrame:
    """Streaming counterpart of track(): rows of DETECTIONS, a null det_idx for an empty frame.

    Rows of a source may come in any order of frames, but those of one frame come in one batch. Retention
    goes by media time within the state, so late frames are neither dropped nor expired by a watermark.
    A tentative track that ends in its first frames still takes an id, as it was returned there.
    """

    def update(key, batches, state: GroupState):
        own: SourceState = pickle.loads(state.get[0]) if state.exists else SourceState()
        out = own.feed(pd.concat(list(batches)))
        state.update((pickle.dumps(own),))
        yield out

    return detections.groupBy("source").applyInPandasWithState(update, OUTPUT, "state binary", "append", GroupStateTimeout.NoTimeout)
