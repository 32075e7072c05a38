"""Transcripts while the call goes on: batches of fragments, and overlapping batches of turns folded into one list.

State is small: fewer fragments than a batch, or the last few turns, since older ones can't change any more. A row marked
`last` ends its session and empties the state; without one the state is emptied once the watermark has passed the session's
latest row by `idle`. Rows of a session in one micro-batch are taken in order; across micro-batches they must arrive in
order, and the rows of one batch of turns together. Null messages are blank, and blank fragments are skipped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from callweave.functions import matching

FRAGMENTS, TAIL = 3, 8


def _later(state: GroupState, frame: pd.DataFrame, idle_ms: int) -> None:
    """Sets the time at which the state of an open session is emptied."""
    latest = int(frame["ts"].max().timestamp() * 1000)
    state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + idle_ms)


def fragment_batches(rows: DataFrame, size: int = FRAGMENTS, late: str = "10 minutes", idle_ms: int = 180_000) -> DataFrame:
    """session_id, batch, n, speaker, message: every `size` fragments of a session joined by blanks, and what is left at its
    end; a lone last fragment is the agent's, the others' speaker is open (null). rows: session_id, seq, pos, ts, message, last."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        batch, kept = json.loads(state.get[0]) if state.exists else (0, [])
        done, ended = [], state.hasTimedOut
        if not ended:
            frame = pd.concat(list(frames)).sort_values(["seq", "pos"])
            kept += [m for m in frame["message"] if isinstance(m, str) and m.strip()]
            ended = bool(frame["last"].eq(True).any())
        while len(kept) >= size or (ended and kept):
            part, kept = kept[:size], kept[size:]
            done.append((key[0], batch, len(part), "agent" if len(part) == 1 else None, " ".join(part)))
            batch += 1
        if ended:
            state.remove()
        else:
            state.update((json.dumps([batch, kept]),))
            _later(state, frame, idle_ms)
        yield pd.DataFrame(done, columns=["session_id", "batch", "n", "speaker", "message"])

    out = "session_id long, batch long, n long, speaker string, message string"
    return rows.withWatermark("ts", late).groupBy("session_id").applyInPandasWithState(step, out, "open string", "append", GroupStateTimeout.EventTimeTimeout)


def transcript_merge(rows: DataFrame, most: int = TAIL, least: float = 0.93, late: str = "10 minutes", idle_ms: int = 180_000) -> DataFrame:
    """session_id, turn, speaker, message: operators.transcripts.merge_batches on a stream. A turn is given out once no later
    batch can reach it. rows: session_id, batch, seq, ts, speaker, message, last."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        turn, tail, open_turn = json.loads(state.get[0]) if state.exists else (0, [], [])
        tail, open_turn = [tuple(t) for t in tail], [tuple(t) for t in open_turn]
        settled, ended = [], state.hasTimedOut
        if not ended:
            frame = pd.concat(list(frames)).sort_values(["batch", "seq"])
            for _, part in frame.groupby("batch", sort=True):
                merged = matching.append_turns(tail, list(zip(part["speaker"], part["message"].fillna(""))), most, least)
                settled += merged[: max(0, len(merged) - most)]
                tail = merged[max(0, len(merged) - most) :]
            ended = bool(frame["last"].eq(True).any())
        if ended:
            settled, tail = settled + tail, []
        tidy = matching.tidy_turns(open_turn + settled)
        # the newest tidy turn can still take in the next one
        given, open_turn = (tidy, []) if ended else (tidy[:-1], tidy[-1:])
        done = [(key[0], turn + i, s, m) for i, (s, m) in enumerate(given)]
        if ended:
            state.remove()
        else:
            state.update((json.dumps([turn + len(given), tail, open_turn]),))
            _later(state, frame, idle_ms)
        yield pd.DataFrame(done, columns=["session_id", "turn", "speaker", "message"])

    out = "session_id long, turn long, speaker string, message string"
    return rows.withWatermark("ts", late).groupBy("session_id").applyInPandasWithState(step, out, "open string", "append", GroupStateTimeout.EventTimeTimeout)
