"""Growing and rotated log files as a stream of lines.

Files lie in folders that driver and executors mount alike. A file is known by its inode and a hash of its first line, not by its
name: renamed by rotation it goes on where it was, and one that is emptied and written anew is another. Offsets are
bytes up to the last line that is complete; a line whose end is not yet written waits. What was written between the last batch and
an emptying is gone, as it is for any reader. Large files are split over tasks by bytes, lines by where they begin.
"""

from __future__ import annotations

import glob
import hashlib
import os
from collections import deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..session import ship

#: Bytes of a task, bytes read at once, rows of a batch, bytes of a first line that tell files apart.
TASK_BYTES, CHUNK, BATCH, HEAD = 64 << 20, 1 << 20, 1000, 4096
SCHEMA = "file string, log string, at long, line string, before array<string>, context array<string>"
_ARROW = pa.schema([("file", pa.string()), ("log", pa.string()), ("at", pa.int64()), ("line", pa.string()), ("before", pa.list_(pa.string())), ("context", pa.list_(pa.string()))])


def identity(path: str) -> str | None:
    """What a file is known by; None as long as its first line is not complete."""
    try:
        with open(path, "rb") as f:
            head = f.readline(HEAD)
            inode = os.fstat(f.fileno()).st_ino
    except FileNotFoundError:
        return None
    return f"{inode}-{hashlib.sha256(head).hexdigest()[:16]}" if head.endswith(b"\n") or len(head) == HEAD else None


def complete(path: str) -> int:
    """Bytes up to the end of the last complete line, found from the end of the file."""
    with open(path, "rb") as f:
        end = f.seek(0, os.SEEK_END)
        while end > 0:
            start = max(0, end - CHUNK)
            f.seek(start)
            k = f.read(end - start).rfind(b"\n")
            if k >= 0:
                return start + k + 1
            end = start
    return 0


def back(f, at: int, lines: int) -> int:
    """Where the line begins that is so many lines before the one that begins at a byte; 0 where there are fewer."""
    end, left = at - 1, lines
    while left and end > 0:
        start = max(0, end - CHUNK)
        f.seek(start)
        block = f.read(end - start)
        k = len(block)
        while left and (k := block.rfind(b"\n", 0, k)) >= 0:
            left -= 1
            if not left:
                return start + k + 1
        end = start
    return 0 if left else at


def present(pattern: str) -> dict[str, str]:
    """Paths by identity; of hard links the first."""
    found: dict[str, str] = {}
    for path in sorted(glob.glob(pattern)):
        key = identity(path) if os.path.isfile(path) else None
        if key:
            found.setdefault(key, path)
    return found


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows), _ARROW)], schema=_ARROW)


class _Range(InputPartition):
    def __init__(self, key: str, path: str, start: int, stop: int, end: int) -> None:
        super().__init__((key, path, start, stop, end))


class _Tail(DataSourceStreamReader):
    def __init__(self, pattern: str, context: int, task_bytes: int) -> None:
        self.pattern, self.context, self.task_bytes = pattern, context, task_bytes

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Of each file that is there how far it is complete; files that are gone are forgotten."""
        ends: dict[str, int] = {}
        for key, path in present(self.pattern).items():
            try:
                ends[key] = complete(path)
            except FileNotFoundError:
                continue
        return ends

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        paths = present(self.pattern)
        out = []
        for key, stop in sorted(end.items()):
            # a file that has shrunk under its identity begins again
            at = start.get(key, 0) if start.get(key, 0) <= stop else 0
            if key in paths:
                out += [_Range(key, paths[key], k, min(k + self.task_bytes, stop), stop) for k in range(at, stop, self.task_bytes)]
        return out

    def _open(self, key: str, path: str):
        """The file of an identity, under the name that it has by now."""
        for p in (path, present(self.pattern).get(key)):
            if p and identity(p) == key:
                f = open(p, "rb")
                # renamed between the two: looked for once more
                if str(os.fstat(f.fileno()).st_ino) == key.split("-")[0]:
                    return f, p
                f.close()
        return None, path

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        """Lines that begin in a range, each with lines around it, which may lie outside of the range but not beyond what is complete."""
        key, path, start, stop, end = partition.value
        f, path = self._open(key, path)
        if f is None:
            return
        text = lambda raw: raw.rstrip(b"\r\n").decode("utf-8", "replace")
        with f:
            if start:
                f.seek(start - 1)
                f.readline()
            at = f.tell()
            before: deque[str] = deque(maxlen=self.context)
            f.seek(back(f, at, self.context))
            while f.tell() < at:
                before.append(text(f.readline()))
            held: deque[tuple[int, str]] = deque()
            rows: list[tuple] = []
            while True:
                # a line of the range and what comes after it
                while at < end and len(held) <= self.context and (at < stop or held):
                    raw = f.readline()
                    if not raw:
                        end = at
                        break
                    held.append((at, text(raw)))
                    at += len(raw)
                if not held or held[0][0] >= stop:
                    break
                place, line = held.popleft()
                rows.append((path, key, place, line, list(before), [x for _, x in held]))
                before.append(line)
                if len(rows) == BATCH:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    def commit(self, end: dict) -> None:
        """Offsets are in the query's checkpoint."""


class Logs(DataSource):
    """spark.readStream.format("log_tail").option("context", 5).load(pattern)"""

    @classmethod
    def name(cls):
        return "log_tail"

    def schema(self):
        return SCHEMA

    def streamReader(self, schema):
        return _Tail(self.options["path"].removeprefix("file://").removeprefix("file:"), int(self.options.get("context", 0)), int(self.options.get("taskBytes", TASK_BYTES)))


def tail(spark: SparkSession, pattern: str, context: int = 0, **options: str) -> DataFrame:
    """(file, log, at, line, before, context) of the files that a pattern names, as a stream; log is the file's identity, at the byte at which a line begins, before and context so many lines on either side of it."""
    ship(spark)
    spark.dataSource.register(Logs)
    return spark.readStream.format("log_tail").options(context=str(context), **options).load(pattern)


def findings(lines: DataFrame, flagged: Sequence[str], suppressed: Sequence[str] = (), trace: str = r"^(?:Traceback |\w*(?:Error|Exception)\b)") -> DataFrame:
    """(file, log, at, line, context) of lines that match a flagged pattern and no suppressed one.

    Context ends before the next such line that is no part of a trace, and leaves out blank and suppressed lines. A
    part of a trace that lies in the context of a line that is none is in that line's finding only; elsewhere it is one of its own.
    """
    any_of = lambda x, patterns: F.regexp_like(x, F.lit("|".join(f"(?:{p})" for p in patterns))) if patterns else F.lit(False)
    wanted = lambda x: any_of(x, flagged) & ~any_of(x, suppressed)
    traced = lambda x: F.regexp_like(x, F.lit(trace))
    leads = lambda x: wanted(x) & ~traced(x)
    stop = F.array_position(F.transform("context", leads), True)
    near = F.when(stop > 0, F.slice("context", F.lit(1), (stop - 1).cast("int"))).otherwise(F.col("context"))
    kept = F.transform(F.filter(near, lambda x: (F.rtrim(x) != "") & ~any_of(x, suppressed)), F.rtrim)
    own = wanted(F.col("line")) & ~(traced(F.col("line")) & F.exists("before", leads))
    return lines.where(own).select("file", "log", "at", F.rtrim("line").alias("line"), kept.alias("context"))
