"""The state of a running audit, as an interface shows it: what may follow what, progress and time left."""

from __future__ import annotations

import threading
import time
from dataclasses import dataclass, field

FOLLOWS = {
    "queued": {"running", "cancelled"},
    "running": {"paused", "complete", "failed", "cancelled"},
    "paused": {"running", "cancelled"},
    "cancelled": {"discarded", "complete"},  # a cancelled audit may still be reported in part
    "complete": {"discarded"},
    "failed": {"discarded"},
    "discarded": set(),
}
ENDED = {"complete", "failed", "discarded"}


@dataclass
class Job:
    """One audit. A crawl asks `go_on` between levels: it waits while the job is paused, and is False once it is cancelled."""

    state: str = "queued"
    events: list[dict] = field(default_factory=list)
    begun: float | None = None
    changed: threading.Condition = field(default_factory=threading.Condition, repr=False)

    def to(self, state: str) -> None:
        with self.changed:
            if state not in FOLLOWS[self.state]:
                raise ValueError(f"{self.state} isn't followed by {state}")
            if state == "running" and self.begun is None:
                self.begun = time.monotonic()
            self.state = state
            self.events.append({"state": state, "at": time.time()})
            self.changed.notify_all()

    def go_on(self) -> bool:
        with self.changed:
            while self.state == "paused":
                self.changed.wait()
            return self.state == "running"

    def progress(self, done: int, waiting: int, most: int | None = None) -> dict:
        """Share done in percent (92 at most before reports are made), pages a minute, and seconds left at that pace."""
        total = most or done + waiting
        took = time.monotonic() - self.begun if self.begun is not None else 0.0
        pace = done / took if took > 0 else 0.0
        left = max(0, total - done) / pace if pace else None
        event = {
            "percent": min(92, round(90 * done / total) + 2) if total else None,
            "per_minute": 60 * pace,
            "seconds_left": left,
            "done": done,
            "waiting": waiting
        }
        self.events.append(event)
        return event
