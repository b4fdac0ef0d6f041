"""Speaker turns as RTTM files: a data source that reads files in parts and writes them all or not at all."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "audio_id string, speaker_id string, start_time double, end_time double, record string, error string"
KIND = "SPEAKER"
FIELDS = 9
#: Bytes of a file that one task reads.
PART_BYTES = 32 << 20
PENDING = "_pending-"


def parse_line(line: str) -> tuple | None:
    """The row of a line; None for blank lines and lines of other kinds.

    A turn that cannot be read has the line in ``record`` and says why in ``error``.
    """
    cells = line.split()
    if not cells or cells[0] != KIND:
        return None
    if len(cells) < FIELDS:
        return (cells[1] if len(cells) > 1 else None, None, None, None, line, f"fewer than {FIELDS} fields")
    try:
        start, length = Decimal(cells[3]), Decimal(cells[4])
    except InvalidOperation:
        return (cells[1], cells[7], None, None, line, "turn without readable times")
    if not (start.is_finite() and length.is_finite()) or start < 0 or length < 0:
        return (cells[1], cells[7], None, None, line, "turn with times out of range")
    return (cells[1], cells[7], float(start), float(start + length), None, None)


def format_line(audio_id: str, speaker_id: str, start: float, end: float) -> str:
    """A line that gives the same times when read, to the last digit. What has no line is an error."""
    for name in (audio_id, speaker_id):
        if not name or re.search(r"\s", name):
            raise ValueError(f"{name!r} cannot be a field of an RTTM line")
    if start is None or end is None or not 0 <= start <= end < float("inf"):
        raise ValueError(f"a turn cannot last from {start} to {end}")
    first, length = Decimal(repr(start)), Decimal(repr(end)) - Decimal(repr(start))
    return f"{KIND} {audio_id} 1 {first:f} {length:f} <NA> <NA> {speaker_id} <NA> <NA>"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if re.match(r"\w+:/", path) else "file://" + os.path.abspath(path))


@dataclass
class Part(InputPartition):
    path: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    path: str
    rows: int


class RttmReader(DataSourceReader):
    def __init__(self, path: str, part_bytes: int) -> None:
        self.path, self.part_bytes = path, part_bytes

    def partitions(self) -> list[Part]:
        store, root = _store(self.path)
        info = store.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(root, recursive=True))
        files = [
            f for f in found if f.is_file and f.size and not any(p[:1] in "._" for p in f.path[len(root) :].split("/") if p)
        ]
        return [
            Part(f.path, a, min(a + self.part_bytes, f.size)) for f in files for a in range(0, f.size, self.part_bytes)
        ] or [Part("", 0, 0)]

    def _lines(self, part: Part) -> Iterator[str]:
        """Lines that begin in the part."""
        if not part.path:
            return
        store, _ = _store(self.path)
        with store.open_input_file(part.path) as file:
            at = max(part.start - 1, 0)
            file.seek(at)
            held, skip = b"", part.start > 0
            while at < part.end:
                block = file.read(1 << 20)
                lines = (held + block).split(b"\n")
                held = lines.pop() if block else b""
                for line in lines:
                    if at >= part.end:
                        return
                    if skip:
                        skip = False  # the rest of a line of the part before
                    else:
                        yield line.decode("utf-8", "replace")
                    at += len(line) + 1
                if not block:
                    return

    def read(self, partition: Part) -> Iterator[tuple]:
        for line in self._lines(partition):
            row = parse_line(line)
            if row is not None:
                yield row


class RttmWriter(DataSourceArrowWriter):
    """Each task writes a hidden file; all are given their names once all tasks are done."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _store(self.path)
        folder = f"{root}/{PENDING}{self.run}"
        store.create_dir(folder, recursive=True)
        path, rows = f"{folder}/{uuid.uuid4().hex}.rttm", 0
        with store.open_output_stream(path) as out:
            for batch in iterator:
                columns = [batch.column(n).to_pylist() for n in ("audio_id", "speaker_id", "start_time", "end_time")]
                lines = [format_line(*row) for row in zip(*columns, strict=True)]
                out.write("".join(line + "\n" for line in lines).encode())
                rows += len(lines)
        return Written(path, rows)

    def commit(self, messages: list[Written]) -> None:
        store, root = _store(self.path)
        old = [f.path for f in store.get_file_info(fs.FileSelector(root)) if f.is_file and f.base_name.endswith(".rttm")]
        for number, message in enumerate(m for m in messages if m is not None and m.rows):
            store.move(message.path, f"{root}/part-{number:05d}-{self.run}.rttm")
        if self.overwrite:
            for path in old:
                store.delete_file(path)
        store.delete_dir(f"{root}/{PENDING}{self.run}")

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        folder = f"{root}/{PENDING}{self.run}"
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)


class RttmSource(DataSource):
    """``spark.read.format("rttm")`` and ``df.write.format("rttm")``; see ``read_rttm`` and ``write_rttm``."""

    @classmethod
    def name(cls) -> str:
        return "rttm"

    def schema(self) -> str:
        return SCHEMA

    def _path(self) -> str:
        if not self.options.get("path"):
            raise ValueError("an RTTM source has a path")
        return self.options["path"].rstrip("/")

    def reader(self, schema) -> RttmReader:
        return RttmReader(self._path(), int(self.options.get("partbytes", PART_BYTES)))

    def writer(self, schema, overwrite: bool) -> RttmWriter:
        missing = {"audio_id", "speaker_id", "start_time", "end_time"} - set(schema.names)
        if missing:
            raise ValueError(f"no column {sorted(missing)} to write")
        return RttmWriter(self._path(), overwrite)


def read_rttm(spark: SparkSession, path: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """All turns below ``path``, good and bad, in parts of ``part_bytes``: ``SCHEMA``.

    Bad lines have an ``error`` and the line as ``record``; blank lines and lines of other kinds
    are passed over. Files and folders that begin with a dot or underscore do not count. Paths
    are local or of any store that Arrow reads.
    """
    spark.dataSource.register(RttmSource)
    return spark.read.format("rttm").option("partbytes", part_bytes).load(path)


def write_rttm(turns: DataFrame, path: str, mode: str = "append") -> None:
    """Turns (audio_id, speaker_id, start_time, end_time) as RTTM files below ``path``.

    Files get their names when all tasks are done; if one fails, for a turn without a line of its
    own too (blanks in a name, no times), nothing is left behind. ``overwrite`` takes the
    files of earlier writes away after that.
    """
    turns.sparkSession.dataSource.register(RttmSource)
    rows = turns.select("audio_id", "speaker_id", "start_time", "end_time")
    rows.write.format("rttm").mode(mode).save(path)
