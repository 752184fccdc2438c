"""What a run is doing, in a file that others can read while it goes on."""

from __future__ import annotations

import json
import os
import time
import uuid
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener


def write_status(path: str, **values: Any) -> None:
    """Replace the file as a whole, so that a reader never sees half of it."""
    folder, name = os.path.split(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    temporary = os.path.join(folder, f".{name}-{uuid.uuid4().hex}")
    with open(temporary, "w", encoding="utf-8") as file:
        json.dump({"updated_unix_ns": time.time_ns()} | values, file)
    os.replace(temporary, path)


def read_status(path: str) -> dict[str, Any]:
    with open(path, encoding="utf-8") as file:
        return json.load(file)


class Running:
    """Around a run: running, then done with its totals, or failed with the error."""

    def __init__(self, path: str | None, command: str):
        self.path, self.known = path, {"command": command, "started_unix_ns": time.time_ns()}

    def tell(self, **values: Any) -> None:
        self.known |= values
        if self.path:
            write_status(self.path, **self.known)

    def __enter__(self) -> Running:
        self.tell(state="running")
        return self

    def __exit__(self, kind, error, trace) -> None:
        self.tell(**{"state": "failed", "error": str(error)[:2000]} if error else {"state": "done"})


class Progress(StreamingQueryListener):
    """Writes each batch's progress of the streams of a session."""

    def __init__(self, path: str):
        self.path = path

    def onQueryStarted(self, event) -> None:
        write_status(self.path, query=str(event.id), state="running")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        write_status(self.path, query=str(p.id), state="running", batch=p.batchId, rows=p.numInputRows, rows_per_second=p.processedRowsPerSecond)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        write_status(self.path, query=str(event.id), **({"state": "failed", "error": event.exception} if event.exception else {"state": "done"}))


def watch_streams(spark: SparkSession, path: str) -> Progress:
    """From now on the session's streams report to a file; ``spark.streams.removeListener`` ends it."""
    listener = Progress(path)
    spark.streams.addListener(listener)
    return listener
