"""Changes of a source tree as a stream: a source of differences of listings, and bursts of them, each one update."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.ignore import SKIP_DIRS

KINDS = ("create", "modify", "remove")
#: The debounce: a burst is over so long after its first event, whatever follows.
GAP_MS = 600


class TreeSource(DataSource):
    """spark.readStream.format("corvane_tree").option("root", ...).option("state", ...): (kind, path, mtime_ms).

    An offset is the digest of a listing (path, size, time of change), which is kept below state, a folder that outlives the
    query; a batch is the difference of two listings, so that a restart goes on from what was last seen. root and state are
    paths or URIs of file systems that pyarrow reads.
    """

    @classmethod
    def name(cls) -> str:
        return "corvane_tree"

    def schema(self) -> str:
        return "kind string, path string, mtime_ms long"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TreeReader(self.options["root"], self.options["state"])


class Between(InputPartition):
    def __init__(self, before: str, after: str) -> None:
        super().__init__(0)
        self.before, self.after = before, after


def _system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class TreeReader(DataSourceStreamReader):
    def __init__(self, root: str, state: str) -> None:
        self.root, self.state = root, state

    def initialOffset(self) -> dict:
        return {"listing": ""}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        system, base = _system(self.root)
        found = system.get_file_info(fs.FileSelector(base, recursive=True))
        rows = sorted((f.path[len(base) :].lstrip("/"), f.size, (f.mtime_ns or 0)) for f in found if f.is_file)
        digest = hashlib.sha256(json.dumps(rows).encode()).hexdigest()
        keep, at = _system(self.state)
        keep.create_dir(at, recursive=True)
        if keep.get_file_info(f"{at}/{digest}").type == fs.FileType.NotFound:
            with keep.open_output_stream(f"{at}/{digest}.part") as out:
                out.write(json.dumps(rows).encode())
            keep.move(f"{at}/{digest}.part", f"{at}/{digest}")
        return {"listing": digest}

    def _listing(self, digest: str) -> dict[str, tuple[int, int]]:
        if not digest:
            return {}
        keep, at = _system(self.state)
        with keep.open_input_stream(f"{at}/{digest}") as f:
            return {p: (size, t) for p, size, t in json.loads(f.read())}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Between(start["listing"], end["listing"])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        before, after = self._listing(partition.before), self._listing(partition.after)
        for path, (size, t) in after.items():
            if before.get(path) != (size, t):
                yield ("modify" if path in before else "create", path, t // 1_000_000)
        for path in before.keys() - after.keys():
            yield "remove", path, before[path][1] // 1_000_000


def watch(spark: SparkSession, root: str, state: str) -> DataFrame:
    spark.dataSource.register(TreeSource)
    return spark.readStream.format("corvane_tree").option("root", root).option("state", state).load()


def relevant(events: DataFrame, skip: tuple[str, ...] = SKIP_DIRS) -> DataFrame:
    """Events (kind, path, ...) that can change the index: of KINDS, with no component of the path in skip."""
    return events.where(F.col("kind").isin(*KINDS)).where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, skip))))


class Debounce(StatefulProcessor):
    """Per key, a window of gap ms from the first event on, which later events join and do not extend; one row when it is over."""

    def __init__(self, gap_ms: int = GAP_MS) -> None:
        self.gap = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "at long, n long")
        self.paths = handle.getMapState("paths", "path string", "n long")

    def _row(self, key: tuple) -> pd.DataFrame:
        at, n = self.open.get()
        paths = sorted(p for p, in self.paths.keys())
        self.open.clear()
        self.paths.clear()
        return pd.DataFrame({"key": [key[0]], "opened_ms": [at], "n": [n], "paths": [paths]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for x in rows:
            times = x["ts"].astype("datetime64[ns]").astype("int64") // 1_000_000
            for path, t in sorted(zip(x["path"], times), key=lambda r: r[1]):
                if self.open.exists() and t >= self.open.get()[0] + self.gap:
                    for timer in list(self.handle.listTimers()):
                        self.handle.deleteTimer(timer)
                    yield self._row(key)
                if not self.open.exists():
                    self.open.update((int(t), 0))
                    self.handle.registerTimer(int(t) + self.gap)
                at, n = self.open.get()
                self.open.update((at, n + 1))
                if path is not None:
                    self.paths.updateValue((path,), (1,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            yield self._row(key)

    def close(self) -> None:
        pass


def debounced(events: DataFrame, gap_ms: int = GAP_MS, late: str = "0 seconds") -> DataFrame:
    """(key, opened_ms, n, paths) of a stream (key, path, ts): a row per burst, once time, as the events tell it, has passed its end.

    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass). Events that come later than `late` are dropped.
    """
    kind = events.schema["key"].dataType.simpleString()
    return events.select("key", "path", "ts").withWatermark("ts", late).groupBy("key").transformWithStateInPandas(Debounce(gap_ms), f"key {kind}, opened_ms long, n long, paths array<string>", "Append", "EventTime")


def on_bursts(events: DataFrame, act: Callable[[DataFrame, int], None], every: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """act(changed paths, batch id) for each trigger that brings relevant events: for sources whose events have no time of their own."""

    def batch(df: DataFrame, number: int) -> None:
        paths = relevant(df).select("path").distinct()
        if not paths.isEmpty():
            act(paths, number)

    w = events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start()
