"""A stream over a folder of text files whose batches close by rows or by age, as a Python data source.

Spark's file streams count files. This reader keeps offsets of its own, a file and a row in
it, so a batch ends in the middle of a file: after so many rows, or when the oldest row that
waits has waited long enough. Files come into the folder whole (by a rename) and do not
change; they are taken in the order of their times and names. Where many batches wait, a
trigger may take several: every row says which batch it is of.
"""

from __future__ import annotations

import json
import sys
import time
from collections.abc import Iterator
from itertools import islice

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

# The reader travels to the executors by value: they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

START = {"time": 0, "file": "", "row": 0, "batch": 0}
#: Lines from one whose place in its file is known to the next.
MARK = 1 << 10


class Piece(InputPartition):
    """Rows [first, last) of a file; row ``first // MARK * MARK`` begins at byte ``seek``, and ``before`` rows since the start of ``batch``."""

    def __init__(self, file: str, first: int, last: int, seek: int, before: int = 0, batch: int = 0):
        self.file, self.first, self.last, self.seek, self.before, self.batch = file, first, last, seek, before, batch


class MessageReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.log = options["path"], options["log"]
        self.rows, self.seconds = int(options["rows"]), float(options["seconds"])
        self.together = int(options.get("together", 1))
        self.at: dict | None = None
        self.marks: dict[str, tuple[int, list[int]]] = {}

    def _fs(self, path: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def _files(self) -> list[tuple[int, str]]:
        """Time and path of every file, in order."""
        from pyarrow import fs

        store, root = self._fs(self.path)
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return sorted((f.mtime_ns // 1000, f.path) for f in found if f.is_file and not f.base_name.startswith(("_", ".")))

    def _lines(self, file: str, seek: int = 0) -> Iterator[bytes]:
        store, _ = self._fs(self.path)
        with store.open_input_file(file) as raw:
            raw.seek(seek)
            rest = b""
            while block := raw.read(1 << 20):
                lines = (rest + block).split(b"\n")
                rest = lines.pop()
                yield from lines
            if rest:
                yield rest

    def _marked(self, file: str) -> tuple[int, list[int]]:
        """Lines of a file, and the byte at which every MARKth begins; a file is read once for this."""
        if file not in self.marks:
            count, at, marks = 0, 0, []
            for line in self._lines(file):
                if count % MARK == 0:
                    marks.append(at)
                count, at = count + 1, at + len(line) + 1
            self.marks[file] = count, marks
        return self.marks[file]

    def _pieces(self, start: dict, most: int | None, end: dict | None = None) -> list[tuple[int, Piece]]:
        """What lies between two offsets, or `most` rows after the first."""
        found, left, before = [], most, 0
        for at, file in self._files():
            if (at, file) < (start["time"], start["file"]):
                self.marks.pop(file, None)
                continue
            if end and (at, file) > (end["time"], end["file"]):
                continue
            first = start["row"] if file == start["file"] else 0
            count, marks = self._marked(file)
            last = end["row"] if end and file == end["file"] else count
            if left is not None:
                last = min(last, first + left)
                left -= max(0, last - first)
            if last > first:
                found.append((at, Piece(file, first, last, marks[first // MARK], before, start.get("batch", 0))))
                before += last - first
            if left == 0:
                break
        return found

    def initialOffset(self) -> dict:
        return START

    def latestOffset(self) -> dict:
        """The end of the next batch, or of as many full ones as wait; the last offset again while its rows may still wait."""
        if self.at is None:
            store, log = self._fs(self.log)
            info = store.get_file_info(f"{log}/offset")
            if info.is_file:
                with store.open_input_stream(f"{log}/offset") as file:
                    self.at = json.loads(file.read())
            else:
                self.at = START
        found = self._pieces(self.at, self.rows * self.together)
        if found:
            waiting, many = time.time() - found[0][0] / 1e6, sum(p.last - p.first for _, p in found)
            if many >= self.rows or waiting >= self.seconds:
                if many > self.rows:
                    many -= many % self.rows
                    found = self._pieces(self.at, many)
                last_at, last = found[-1]
                batch = self.at.get("batch", 0) + -(-many // self.rows)
                self.at = {"time": last_at, "file": last.file, "row": last.last, "batch": batch}
                self._note()
        return self.at

    def _note(self) -> None:
        """Writes down where the next batch ends. A restart counts on from here; where it begins Spark knows."""
        store, log = self._fs(self.log)
        store.create_dir(log)
        with store.open_output_stream(f"{log}/offset.new") as file:
            file.write(json.dumps(self.at).encode())
        store.move(f"{log}/offset.new", f"{log}/offset")

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return [piece for _, piece in self._pieces(start, None, end)]

    def read(self, piece: Piece) -> Iterator[tuple[str, int]]:
        known = piece.first // MARK * MARK
        lines = islice(self._lines(piece.file, piece.seek), piece.first - known, piece.last - known)
        for n, line in enumerate(lines, piece.before):
            yield line.decode(), piece.batch + n // self.rows


class MessageFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "message_files"

    def schema(self) -> str:
        return "value string, batch long"

    def streamReader(self, schema) -> MessageReader:
        return MessageReader(dict(self.options))


def message_batches(spark: SparkSession, path: str, log: str, rows: int, seconds: float, together: int = 1) -> DataFrame:
    """Message values of a growing folder in batches of ``rows``, or fewer when the oldest has waited ``seconds``.

    ``batch`` numbers them. Of full batches that wait a trigger takes up to ``together``.

    ``log`` is a folder of the stream's own, beside its checkpoint. Both paths are reached by the
    driver and the executors: a mounted folder or a store that Arrow knows. Needs a trigger by time:
    with `availableNow` Spark asks for one end only.
    """
    spark.dataSource.register(MessageFiles)
    return spark.readStream.format("message_files").options(
        path=path, log=log, rows=rows, seconds=seconds, together=together).load()
