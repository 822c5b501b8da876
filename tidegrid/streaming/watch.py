"""Repeated execution of one statement: single-flight, keeps the last good result, can be cancelled."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

DEFAULT_SECONDS, LEAST_SECONDS, MOST_SECONDS = 5, 1, 3600


def choose(editor: str, last: str, tick: bool) -> str:
    """The statement to run: a tick repeats the last one, or takes the editor's text if there is none; by hand it is the other way round."""
    first, second = (last, editor) if tick else (editor, last)
    return first.strip() or second.strip()


class Watch:
    def __init__(self, spark: SparkSession, run: Callable[[], DataFrame], take: Callable[[DataFrame], object], seconds: float = DEFAULT_SECONDS):
        """take: makes the bounded result of a refresh, for example a limited collect."""
        self.spark, self.run, self.take = spark, run, take
        self.seconds = self._clamped(seconds)
        self.result, self.error, self.refreshes, self.dropped = None, None, 0, 0
        self._busy, self._stop, self._thread = threading.Lock(), threading.Event(), None
        self.tag = f"watch-{uuid.uuid4().hex}"

    @staticmethod
    def _clamped(seconds: float) -> float:
        return max(LEAST_SECONDS, min(MOST_SECONDS, seconds))

    def adjust(self, by: float) -> float:
        self.seconds = self._clamped(self.seconds + by)
        return self.seconds

    def refresh(self) -> bool:
        """Run once, unless a run is under way: then the tick is dropped. A failure leaves the last good result."""
        if not self._busy.acquire(blocking=False):
            self.dropped += 1
            return False
        try:
            self.spark.addTag(self.tag)
            self.result, self.error = self.take(self.run()), None
            self.refreshes += 1
        except Exception as e:
            self.error = str(e)
        finally:
            self.spark.removeTag(self.tag)
            self._busy.release()
        return self.error is None

    def cancel(self) -> None:
        """Stop what runs now; the watch goes on."""
        self.spark.interruptTag(self.tag)

    def start(self) -> None:
        if self._thread is not None and self._thread.is_alive():
            return
        self._stop.clear()

        def loop() -> None:
            while not self._stop.is_set():
                began = time.monotonic()
                self.refresh()
                self._stop.wait(max(0.0, self.seconds - (time.monotonic() - began)))

        self._thread = threading.Thread(target=loop, daemon=True)
        self._thread.start()

    def stop(self) -> None:
        self._stop.set()
        self.cancel()
        if self._thread is not None:
            self._thread.join()
