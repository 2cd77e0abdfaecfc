"""Background compaction: a daemon thread that folds the delta once it is large enough."""

from __future__ import annotations

import threading

from ..table import Table


class BackgroundCompactor:
    def __init__(self, table: Table, threshold: int = 1000, poll_seconds: float = 1.0) -> None:
        self.table, self.threshold, self.poll = table, threshold, poll_seconds
        self._stop = threading.Event()
        self._thread = threading.Thread(target=self._run, daemon=True)

    def __enter__(self) -> BackgroundCompactor:
        self._thread.start()
        return self

    def __exit__(self, *_: object) -> None:
        self._stop.set()
        self._thread.join()

    def _run(self) -> None:
        while not self._stop.wait(self.poll):
            if self.table.delta_size() >= self.threshold:
                self.table.compact()
