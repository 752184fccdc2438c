"""Two sides of a scan meet by folder: batches come unordered, in parts, and each side ends with a final one."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from grovespark.ship import by_value

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What comes in: parts of a folder's listing, numbered from 0, the last one final. A part is one page of files.
BATCH_SCHEMA = "folder string, side string, sequence long, final boolean, files array<struct<name:string,size:long,mtime:long>>"
OUT_SCHEMA = "folder string, name string, kind string, source_size long, target_size long"


def outcome(source: tuple | None, target: tuple | None, mode: str = "time") -> str:
    if target is None:
        return "new"
    if source is None:
        return "target_only"
    same = source[0] == target[0] and (mode == "size" or source[1] == target[1])
    return "skip" if same else "changed"


#: Rows that are sent on at once.
AT_ONCE = 10_000


class Rendezvous(StatefulProcessor):
    """State of a folder: each side's files, by name, and the numbers of its parts.

    A file is compared as soon as both sides have it and then forgotten; what one
    side has alone is told when both sides are whole, as are all parts from 0 to
    the final one. Files are map state, one entry each, so a folder of a million
    files is never one value; parts are counted as they come, and parts that come
    twice do no harm. Of a folder that is done one mark stays, for parts that come
    again; a stream without end should scan each time under a root of its own.
    """

    def __init__(self, mode: str = "time"):
        self.mode = mode

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.files = {s: handle.getMapState(f"files_{s}", "name string", "size long, mtime long") for s in "ST"}
        self.seen = {s: handle.getMapState(f"parts_{s}", "sequence long", "final boolean") for s in "ST"}
        self.counts = {s: handle.getValueState(f"counts_{s}", "parts long, last long") for s in "ST"}
        self.told = handle.getValueState("told", "done boolean")

    def counted(self, side: str, sequence: int, final: bool) -> bool:
        """Takes note of a part; whether it is new."""
        if self.seen[side].containsKey((sequence,)):
            return False
        self.seen[side].updateValue((sequence,), (final,))
        parts, last = self.counts[side].get() if self.counts[side].exists() else (0, -1)
        self.counts[side].update((int(parts) + 1, sequence if final else int(last)))
        return True

    def whole(self, side: str) -> bool:
        if not self.counts[side].exists():
            return False
        parts, last = self.counts[side].get()
        return int(last) >= 0 and int(parts) == int(last) + 1

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        out = self.outcomes(key[0], rows)
        while some := list(itertools.islice(out, AT_ONCE)):
            frame = pd.DataFrame(some, columns=["folder", "name", "kind", "source_size", "target_size"])
            yield frame.astype({"source_size": "Int64", "target_size": "Int64"})

    def outcomes(self, folder: str, rows: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        done = self.told.exists()
        for frame in rows:
            for row in frame.itertuples(index=False):
                if not done and self.counted(row.side, int(row.sequence), bool(row.final)):
                    yield from self.compared(folder, row.side, row.files)
        if not done and self.whole("S") and self.whole("T"):
            yield from ((folder, k[0], "new", v[0], None) for k, v in self.files["S"].iterator())
            yield from ((folder, k[0], "target_only", None, v[0]) for k, v in self.files["T"].iterator())
            for state in (*self.files.values(), *self.seen.values(), *self.counts.values()):
                state.clear()
            self.told.update((True,))

    def compared(self, folder: str, side: str, files: Any) -> Iterator[tuple]:
        other = "T" if side == "S" else "S"
        for file in files if files is not None else ():
            name, mine = file["name"], (int(file["size"]), int(file["mtime"]))
            if self.files[other].containsKey((name,)):
                theirs = tuple(self.files[other].getValue((name,)))
                s, t = (mine, theirs) if side == "S" else (theirs, mine)
                yield folder, name, outcome(s, t, self.mode), s[0], t[0]
                self.files[other].removeKey((name,))
            else:
                self.files[side].updateValue((name,), mine)

    def close(self) -> None:
        pass


def rendezvous(batches: DataFrame, mode: str = "time") -> DataFrame:
    """The stream of outcomes of a stream of batches (``BATCH_SCHEMA``).

    Needs the RocksDB state store: set ``spark.sql.streaming.stateStore.providerClass``
    to ``STORE`` on the session that starts the query.
    """
    by_value(__name__)
    return batches.groupBy("folder").transformWithStateInPandas(Rendezvous(mode), OUT_SCHEMA, "Append", "None")


def rendezvous_batch(batches: DataFrame, mode: str = "time") -> DataFrame:
    """The same of a bounded table, as a join on folder and name; only folders whole on both sides tell what one side lacks."""
    parts = batches.groupBy("folder", "side").agg(
        (F.count_distinct("sequence") == F.max(F.when(F.col("final"), F.col("sequence"))) + 1).alias("whole")
    )
    whole = parts.groupBy("folder").agg((F.count_if(F.col("whole")) == 2).alias("both"))
    once = batches.dropDuplicates(["folder", "side", "sequence"])
    files = once.select("folder", "side", F.inline("files"))
    s, t = (
        files.where(F.col("side") == side).select("folder", "name", F.col("size").alias(f"{n}_size"), F.col("mtime").alias(f"{n}_mtime"))
        for side, n in (("S", "source"), ("T", "target"))
    )
    out = s.join(t, ["folder", "name"], "full_outer").join(whole, "folder")
    same = F.col("source_size") == F.col("target_size")
    if mode != "size":
        same = same & (F.col("source_mtime") == F.col("target_mtime"))
    kind = (
        F.when(F.col("target_size").isNull(), "new").when(F.col("source_size").isNull(), "target_only").when(same, "skip").otherwise("changed")
    )
    out = out.withColumn("kind", kind).where(F.col("both") | F.col("kind").isin("skip", "changed"))
    return out.select("folder", "name", "kind", "source_size", "target_size")
