"""Key gestures into recording commands (R09): a double tap toggles, a tap and a hold records while held.

Timers are applied when the next event comes, at the moment they were due; a session's last open timer runs out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from loomline.operators.fold import Fold, fold_sorted

# Fixed values, in ms: longest tap, shortest hold, longest pause between taps, shortest recording a tap can stop.
TAP, HOLD, PAUSE, COOLDOWN = 300, 500, 400, 1000


class Gestures(Fold):
    """The state of one keyboard: a name and the time it was entered."""

    def __init__(self) -> None:
        self.state, self.since = "idle", 0

    def go(self, state: str, at: int) -> None:
        self.state, self.since = state, at

    def overdue(self, now: int | None):
        """Timers that ran out before ``now`` (None: all)."""
        limits = {"first": TAP, "between": PAUSE, "second": HOLD}
        due = self.since + limits.get(self.state, 0)
        if self.state not in limits or (now is not None and now < due):
            return
        if self.state == "second":
            self.go("holding", due)
            yield due, "start", "hold"
        else:
            self.go("idle", due)

    def step(self, row):
        at, event = row
        yield from self.overdue(at)
        if event == "down":
            if self.state == "idle":
                self.go("first", at)
            elif self.state == "between":
                self.go("second", at)
            elif self.state == "toggled" and at - self.since >= COOLDOWN:
                self.go("idle", at)
                yield at, "stop", "double_tap"
        elif event == "up":
            if self.state == "first":
                self.go("between", at)
            elif self.state == "second":
                self.go("toggled", at)
                yield at, "start", "double_tap"
            elif self.state == "holding":
                self.go("idle", at)
                yield at, "stop", "hold"

    def end(self):
        return self.overdue(None)


def commands(events: DataFrame) -> DataFrame:
    """``session_id, at_ms, command, gesture`` of key events (``session_id, at_ms, event``: down or up)."""
    return fold_sorted(events, "session_id", ["at_ms", "event"], ["at_ms", "event"], Gestures, "session_id string, at_ms long, command string, gesture string")
