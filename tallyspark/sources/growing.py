"""Logs that grow, as a stream: a data source that reads on where it stopped in each file.

An offset holds for each log how many of its bytes are read, up to the end of a line: a line that is still being written stays for
later, and each comes once, also after a restart from a checkpoint. A log that became shorter, or has another first line, was
written anew and is read from its beginning. What has come since the last offset is cut into ranges of bytes, which tasks read by themselves.

Each trigger lists the folders and looks for the last line's end in the logs that grew. Offsets name every log, so a source is for
the live folders of a machine or team; what has come to rest belongs to ``refresh``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

MAX_DEPTH = 8
#: Bytes of a log that a task reads, but for its last line; and of a look for a line's end.
RANGE_BYTES, LOOK_BYTES = 32 << 20, 1 << 16
#: Bytes of a first line by which a log is known again.
HEAD_BYTES = 512


@dataclass
class Range(InputPartition):
    """Lines of a log that begin at ``start`` or later, and before ``end``."""

    root: str
    path: str
    start: int
    end: int
    begun: bool  # a line begins at ``start``


def _opened(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


class GrowingReader(DataSourceStreamReader):
    def __init__(self, roots: list[str], range_bytes: int):
        self.roots, self.range_bytes = roots, range_bytes
        self.seen: dict[str, tuple[int, int, str]] = {}  # by log: its size when it was looked at, the end of its last line, a hash of its first

    def initialOffset(self) -> dict:
        return {"logs": {}}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        found = {}
        for root in self.roots:
            system, top = _opened(root)
            for info in system.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True)):
                below = info.path[len(top) :].strip("/")
                if info.type != fs.FileType.File or not below.endswith(".jsonl") or below.count("/") >= MAX_DEPTH:
                    continue
                key = f"{root}|{below}"
                size, end, head = self.seen.get(key, (-1, 0, ""))
                if info.size != size:
                    end, head = _looked_at(system, info.path, info.size)
                    self.seen[key] = (info.size, end, head)
                found[key] = {"end": end, "head": head}
        return {"logs": found}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for key, now in end["logs"].items():
            before = start["logs"].get(key, {"end": 0, "head": now["head"]})
            since = before["end"] if before["head"] == now["head"] and before["end"] <= now["end"] else 0
            root, below = key.split("|", 1)
            for at in range(since, now["end"], self.range_bytes):
                out.append(Range(root, below, at, min(at + self.range_bytes, now["end"]), at == since))
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        system, top = _opened(partition.root)
        with system.open_input_file(f"{top.rstrip('/')}/{partition.path}") as f:
            at = partition.start if partition.begun else partition.start - 1
            f.seek(at)
            rest, first, began = b"", not partition.begun, at
            while began < partition.end or first:
                data = f.read(LOOK_BYTES)
                if not data:
                    return
                rest += data
                *lines, rest = rest.split(b"\n")
                for line in lines:
                    if first:  # the end of a line that another range has
                        first = False
                    elif began < partition.end:
                        if text := line.decode("utf-8", "replace").removeprefix("﻿").rstrip("\r"):
                            yield (f"{partition.root.rstrip('/')}/{partition.path}", partition.path, 0, began, text)
                    else:
                        return
                    began += len(line) + 1


def _looked_at(system, path: str, size: int) -> tuple[int, str]:
    """The place after the last line's end before ``size``, and a hash of the beginning of the first line; 0 where none has ended."""
    with system.open_input_file(path) as f:
        at = size
        while at > 0:
            begin = max(0, at - LOOK_BYTES)
            f.seek(begin)
            if (hit := f.read(at - begin).rfind(b"\n")) >= 0:
                f.seek(0)
                return begin + hit + 1, hashlib.sha256(f.read(min(begin + hit, HEAD_BYTES)).split(b"\n")[0]).hexdigest()[:16]
            at = begin
    return 0, ""


class GrowingLogs(DataSource):
    """Options: ``roots``, one a line, and ``rangebytes``."""

    @classmethod
    def name(cls) -> str:
        return "growing_logs"

    def schema(self) -> str:
        return "path string, rel_path string, block_start bigint, line_seq bigint, value string"

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(self.options["roots"].split("\n"), int(self.options.get("rangebytes", RANGE_BYTES)))


def stream_lines(spark: SparkSession, roots: list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The lines of logs under the roots as a stream, with the columns of ``logs.read_lines`` that order them; ``line_seq`` is a
    line's first byte. Roots are addresses, as ``file:///logs``."""
    spark.dataSource.register(GrowingLogs)
    return spark.readStream.format("growing_logs").option("roots", "\n".join(r.rstrip("/") for r in roots)).option("rangebytes", range_bytes).load()
