"""Two streaming sources with offsets of their own: the tail of a growing log, and a replay that keeps to a clock.

``LogTail`` follows one log and what it is rotated to in its folder (names that begin with its stem, then a dot, a dash or an underscore). A
file is known by its identity, not its name, and the offset has the byte up to which each file has been read. Of the log itself only whole
lines are read: what stands behind its last line feed is held back. A file that has been rotated away gets no more lines, so it is read to
its end. A file that is shorter than its offset has been cut and is read anew. As the offsets are in the query's checkpoint, a restart goes on
where the last finished micro-batch ended. Large backlogs are split into ranges of ``SPLIT_BYTES``, each a task that reads the lines beginning in it.

``Replay`` admits recorded packets by the clock: those whose time since ``first_us`` is at most the time since ``anchor_us`` by the
clock, times the speed. Both anchors are options, so a restart or a second reader admits the same. ``speed`` 0 admits all at once.

Cases: a log that isn't there yet gives no lines until it is; an empty one none; bytes that are no UTF-8 become replacement
characters; a log in a compressed archive is not read.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SPLIT_BYTES = 64 << 20
CHUNK = 1 << 16
PACKED = (".gz", ".zst", ".bz2", ".xz", ".zip")
LINE = "value string, file string, position long, header string"


def _identity(stat: os.stat_result) -> str:
    return f"{stat.st_dev}:{stat.st_ino}"


def series(path: str) -> dict[str, tuple[str, int]]:
    """The log and its rotated files: identity to name and size."""
    folder, name = os.path.split(os.path.abspath(path))
    stem = name.split(".")[0]
    found = {}
    for x in os.listdir(folder) if os.path.isdir(folder) else ():
        if (x == name or (x.startswith(stem) and x[len(stem) : len(stem) + 1] in (".", "-", "_"))) and not x.endswith(PACKED):
            try:
                stat = os.stat(os.path.join(folder, x))
            except FileNotFoundError:
                continue
            found[_identity(stat)] = (os.path.join(folder, x), stat.st_size)
    return found


def whole_lines(path: str, size: int) -> int:
    """The place behind the last line feed in the first ``size`` bytes."""
    with open(path, "rb") as f:
        while size > 0:
            begin = max(0, size - CHUNK)
            f.seek(begin)
            at = f.read(size - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            size = begin
    return 0


def header_of(path: str) -> str | None:
    """Separator and field names from the lines at a file's head that begin with "#", as JSON; None without field names."""
    separator, fields = "\t", None
    with open(path, "rb") as f:
        for raw in f:
            line = raw.decode("utf-8", "replace").rstrip("\r\n")
            if line and not line.startswith("#"):
                break
            if line.startswith("#separator"):
                separator = line.split(None, 1)[1].encode().decode("unicode_escape")
            if line.startswith("#fields"):
                fields = line.split(separator if separator in line else "\t")[1:]
    return None if fields is None else json.dumps({"separator": separator, "fields": fields})


@dataclass
class Stretch(InputPartition):
    """Lines of a file that begin in begin:until; the file is read up to ``limit``."""

    path: str
    identity: str
    start: int
    begin: int
    until: int
    limit: int
    header: str | None


class TailReader(DataSourceStreamReader):
    def __init__(self, path: str, from_start: bool, split_bytes: int) -> None:
        self.path, self.from_start, self.split_bytes = os.path.abspath(path), from_start, split_bytes

    def initialOffset(self) -> dict:
        """Files that were rotated away before the stream began are not read."""
        return {k: at for k, at in self.latestOffset().items() if not self.from_start or series(self.path)[k][0] != self.path}

    def latestOffset(self) -> dict:
        return {k: whole_lines(name, size) if name == self.path else size for k, (name, size) in series(self.path).items()}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        now, out = series(self.path), []
        for k, until in sorted(end.items()):
            begin = start.get(k, 0)
            begin = 0 if until < begin else begin
            if until == begin:
                continue
            if k not in now:
                raise FileNotFoundError(f"{self.path}: bytes {begin} to {until} of a rotated file that is gone")
            header = header_of(now[k][0])
            out += [Stretch(now[k][0], k, begin, at, min(at + self.split_bytes, until), until, header) for at in range(begin, until, self.split_bytes)]
        return out

    def read(self, part: Stretch) -> Iterator[pa.RecordBatch]:
        path = part.path
        if _identity(os.stat(path)) != part.identity:  # rotated since it was planned
            path = series(self.path)[part.identity][0]
        with open(path, "rb") as f:
            at = part.begin
            if at > part.start:  # the line that holds the byte before belongs to the stretch before
                f.seek(at - 1)
                at += len(f.readline(part.limit - at + 1)) - 1
            f.seek(at)
            lines, places = [], []
            while at < part.until:
                line = f.readline(part.limit - at)
                if not line:
                    break
                lines.append(line.rstrip(b"\r\n").decode("utf-8", "replace"))
                places.append(at)
                at += len(line)
                if len(lines) == 10_000:
                    yield self._batch(part, lines, places)
                    lines, places = [], []
            if lines:
                yield self._batch(part, lines, places)

    def _batch(self, part: Stretch, lines: list[str], places: list[int]) -> pa.RecordBatch:
        n = len(lines)
        columns = [pa.array(lines, pa.string()), pa.array([part.path] * n, pa.string()), pa.array(places, pa.int64()), pa.array([part.header] * n, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["value", "file", "position", "header"])


class LogTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return LINE

    def streamReader(self, schema: StructType) -> TailReader:
        return TailReader(self.options["path"], self.options.get("fromStart", "true").lower() == "true", int(self.options.get("splitBytes", SPLIT_BYTES)))


def lines(spark: SparkSession, path: str, from_start: bool = True, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """A stream of a growing log's lines, with their file, place, and its header."""
    spark.dataSource.register(LogTail)
    return spark.readStream.format("log_tail").option("fromStart", str(from_start)).option("splitBytes", split_bytes).load(path)


@dataclass
class Admitted(InputPartition):
    """Rows of some files with times above ``after_us`` and up to ``until_us``."""

    files: list
    after_us: int
    until_us: int


class ReplayReader(DataSourceStreamReader):
    #: The wall clock in microseconds; a test sets its own
    clock = staticmethod(lambda: time.time_ns() // 1000)

    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.schema = options["path"].removeprefix("file://"), schema
        self.ts, self.speed = options.get("ts", "timestamp_us"), float(options["speed"])
        self.first_us, self.last_us, self.anchor_us = (int(options[k]) for k in ("firstUs", "lastUs", "anchorUs"))

    def initialOffset(self) -> dict:
        return {"us": self.first_us - 1}

    def latestOffset(self) -> dict:
        passed = (self.clock() - self.anchor_us) * self.speed
        return {"us": self.last_us if not self.speed else max(self.first_us - 1, min(self.last_us, self.first_us + int(passed)))}

    def partitions(self, start: dict, end: dict) -> list[Admitted]:
        if end["us"] <= start["us"]:
            return []
        return [Admitted([name], start["us"], end["us"]) for name in ds.dataset(self.path, format="parquet").files]

    def read(self, part: Admitted) -> Iterator[pa.RecordBatch]:
        inside = (ds.field(self.ts) > part.after_us) & (ds.field(self.ts) <= part.until_us)
        wanted = to_arrow_schema(self.schema)
        for b in ds.dataset(part.files, format="parquet").to_batches(columns=wanted.names, filter=inside):
            if b.num_rows:
                yield b.cast(wanted)


class Replay(DataSource):
    @classmethod
    def name(cls) -> str:
        return "replay"

    def schema(self) -> StructType:
        raise ValueError("a replay is read with the schema of its table")

    def streamReader(self, schema: StructType) -> ReplayReader:
        return ReplayReader(self.options, schema)


def replay(spark: SparkSession, path: str, speed: float, anchor_us: int | None = None, ts: str = "timestamp_us") -> DataFrame:
    """A stream of the table of packets at ``path`` (Parquet), as fast as it was recorded times ``speed`` (0: all at once).

    The first packet is admitted at ``anchor_us`` by the clock (now, unless given); name it to go on after a restart.
    """
    table = spark.read.parquet(path)
    first, last = table.selectExpr(f"min({ts})", f"max({ts})").first()
    spark.dataSource.register(Replay)
    anchor = ReplayReader.clock() if anchor_us is None else anchor_us
    options = {"speed": speed, "firstUs": first or 0, "lastUs": -1 if last is None else last, "anchorUs": anchor, "ts": ts}
    return spark.readStream.format("replay").schema(table.schema).options(**{k: str(v) for k, v in options.items()}).load(path)
