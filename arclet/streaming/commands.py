"""Commands to a running animation: a stateful stream in which each session has a place, a velocity, a radius and a time.

A command table has session, seq (its order in the session), command and up to two numbers a and b. Commands are "place" (a, b:
where the source starts; its time is 0 again), "time" (a), "step" (a steps of the session's own length, 1 where null; each
shows a frame), "velocity" (a, b), "radius" (a) and "show" (a frame as things stand). Others, and null ones, change and show
nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..plans.session import share_code

STATE = "x double, y double, vx double, vy double, radius double, t double, dt double, shown long"
FRAMES = "session string, seq long, frame long, t double, qx double, qy double, radius double"
#: Of a session without commands: x, y, vx, vy, radius, t, dt, frames shown.
START = (0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.1, 0)


def obeyed(state: tuple, rows: Iterable[tuple]) -> tuple[tuple, list[tuple]]:
    """What commands (seq, command, a, b), in their order, make of a state, and the frames (seq, frame, t, qx, qy, radius) that they
    show."""
    x, y, vx, vy, radius, t, dt, shown = state
    frames = []
    for seq, command, a, b in rows:
        steps = 0
        if command == "place":
            x, y, t, steps = a, b, 0.0, 1
        elif command == "time":
            t = a
        elif command == "velocity":
            vx, vy = a, b
        elif command == "radius":
            radius = a
        elif command == "show":
            steps = 1
        elif command == "step":
            steps = 1 if pd.isna(a) else int(a)
        for _ in range(steps):
            t += dt if command == "step" else 0.0
            frames.append((seq, shown, t, x + vx * t, y + vy * t, radius))
            shown += 1
    return (x, y, vx, vy, radius, t, dt, shown), frames


def _table(session: str, frames: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(session, *f) for f in frames], columns=["session", "seq", "frame", "t", "qx", "qy", "radius"])


def _rows(pdf: pd.DataFrame) -> Iterator[tuple]:
    return pdf.sort_values("seq", kind="stable")[["seq", "command", "a", "b"]].itertuples(index=False, name=None)


def frames_of(commands: DataFrame, dt: float = 0.1) -> DataFrame:
    """The frames that a stream of commands shows: session, seq, frame (numbered in the session), t, qx, qy, radius.

    A session's state is eight numbers and lives as long as the stream. Commands of one batch are taken by seq; those of a
    later batch come after them, whatever their seq. Rows of null session are left out.
    """
    share_code(commands.sparkSession)

    def obey(key, batches, state):
        own, rows = state.get if state.exists else (*START[:6], dt, START[7]), list(batches)
        own, frames = obeyed(own, _rows(pd.concat(rows)))
        state.update(own)
        yield _table(key[0], frames)

    known = commands.where("session is not null")
    return known.groupBy("session").applyInPandasWithState(obey, FRAMES, STATE, "append", "NoTimeout")


def frames_of_table(commands: DataFrame, dt: float = 0.1) -> DataFrame:
    """The same for a finished table of commands, a session a task: what the stream must show."""
    share_code(commands.sparkSession)

    def obey(pdf: pd.DataFrame) -> pd.DataFrame:
        return _table(pdf["session"].iloc[0], obeyed((*START[:6], dt, START[7]), _rows(pdf))[1])

    return commands.where("session is not null").groupBy("session").applyInPandas(obey, FRAMES)
