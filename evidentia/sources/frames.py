"""A cache of sampled frames as a Spark source: chunk files of binary records under a manifest.

A write puts each task's rows into one chunk file and, once all tasks are done, the manifest that lists the chunks; a
folder without a manifest holds no cache, so a write that fails leaves none. A read makes a partition of each chunk that
has any of the positions asked for; in a chunk only their records are read.
Files are reached through pyarrow's file systems, so the folder can lie in any store that they know.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

MANIFEST = "manifest.json"
SCHEMA = "position long, at double, frame binary"
_MARK = b"FRAMES1\n"
#: Records of one batch that a task holds.
ROWS = 1024


@dataclass
class Chunk(InputPartition):
    """A chunk file with the bounds of its positions, and what is asked for of it."""

    file: str
    least: int
    most: int
    rows: int
    wanted: tuple = ()


@dataclass
class Written(WriterCommitMessage):
    file: str
    least: int
    most: int
    rows: int


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _may(least: int, most: int, wanted: tuple) -> bool:
    """Whether any position from ``least`` to ``most`` may be among those asked for."""
    tests = {"in": lambda v: any(least <= x <= most for x in v), ">=": lambda v: most >= v, "<": lambda v: least < v}
    return all(tests[sign](value) for sign, value in wanted)


def _passing(positions: np.ndarray, wanted: tuple) -> np.ndarray:
    keep = np.ones(len(positions), bool)
    for sign, value in wanted:
        keep &= np.isin(positions, value) if sign == "in" else positions >= value if sign == ">=" else positions < value
    return np.flatnonzero(keep)


class FrameReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.wanted = tuple((sign, int(options[name])) for name, sign in (("least", ">="), ("below", "<")) if name in options)
        if "positions" in options:
            self.wanted += (("in", tuple(map(int, filter(None, options["positions"].split(","))))),)

    def partitions(self) -> list[Chunk]:
        store, root = _opened(self.path)
        with store.open_input_stream(f"{root}/{MANIFEST}") as file:
            chunks = json.loads(file.read())["chunks"]
        return [Chunk(**c, wanted=self.wanted) for c in chunks if _may(c["least"], c["most"], self.wanted)]

    def read(self, partition: Chunk | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        store, root = _opened(self.path)
        with store.open_input_file(f"{root}/{partition.file}") as file:
            if file.read(len(_MARK)) != _MARK:
                raise ValueError(f"{partition.file} is no chunk of frames")
            file.seek(file.size() - 8)
            (index,) = struct.unpack("<q", file.read(8))
            file.seek(index)
            table = np.frombuffer(file.read(24 * partition.rows), np.int64).reshape(3, partition.rows)
            positions, times, ends = table[0], table[1].view(np.float64), table[2]
            starts = np.append(len(_MARK), ends[:-1])
            chosen = _passing(positions, partition.wanted)
            for lo in range(0, len(chosen), ROWS):
                part = chosen[lo : lo + ROWS]
                frames = []
                for k in part:
                    file.seek(int(starts[k]))
                    frames.append(file.read(int(ends[k] - starts[k])))
                yield pa.RecordBatch.from_arrays([pa.array(positions[part]), pa.array(times[part], from_pandas=True), pa.array(frames, pa.binary())], ["position", "at", "frame"])


class FrameWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        store, root = _opened(self.path)
        if not overwrite and store.get_file_info(f"{root}/{MANIFEST}").type != fs.FileType.NotFound:
            raise FileExistsError(f"{self.path} holds a cache of frames")
        store.create_dir(root)

    def write(self, iterator: Iterator) -> Written:
        """One chunk of this task's rows: frames one after another, then an index of positions, times and ends."""
        store, root = _opened(self.path)
        name, index = f"chunk-{uuid4().hex}.bin", []
        with store.open_output_stream(f"{root}/{name}") as file:
            file.write(_MARK)
            at = len(_MARK)
            for row in iterator:
                frame = bytes(row["frame"] or b"")
                file.write(frame)
                at += len(frame)
                index.append((row["position"], float("nan") if row["at"] is None else row["at"], at))
            columns = list(zip(*index, strict=True)) or [(), (), ()]
            file.write(np.array(columns[0], np.int64).tobytes() + np.array(columns[1], np.float64).tobytes() + np.array(columns[2], np.int64).tobytes())
            file.write(struct.pack("<q", at))
        return Written(name, min(columns[0], default=0), max(columns[0], default=-1), len(index))

    def commit(self, messages: list[Written | None]) -> None:
        """The manifest makes the chunks a cache; it appears as a whole or not at all."""
        store, root = _opened(self.path)
        chunks = sorted((vars(m) for m in messages if m is not None and m.rows), key=lambda c: (c["least"], c["file"]))
        made = f"{root}/.{MANIFEST}.{uuid4().hex}"
        with store.open_output_stream(made) as file:
            file.write(json.dumps({"chunks": chunks}).encode())
        store.move(made, f"{root}/{MANIFEST}")

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _opened(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(f"{root}/{m.file}")


class FrameCache(DataSource):
    """``position long, at double, frame binary`` in chunk files; ``path`` names the folder."""

    @classmethod
    def name(cls) -> str:
        return "frame_cache"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return FrameReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return FrameWriter(self.options, overwrite)


def write_cache(frames: DataFrame, path: str, chunks: int) -> None:
    """Keeps ``frames`` (``position, at, frame``; positions not null) in about ``chunks`` chunks by ranges of the position."""
    spark = frames.sparkSession
    spark.dataSource.register(FrameCache)
    rows = frames.selectExpr("cast(position as long) position", "cast(at as double) at", "frame").repartitionByRange(chunks, "position").sortWithinPartitions("position")
    rows.write.format("frame_cache").mode("append").save(path)


def read_cache(spark: SparkSession, path: str, least: int | None = None, below: int | None = None, positions: list[int] | None = None) -> DataFrame:
    """The frames of a cache: all, those from ``least`` to ``below`` (itself excluded), or those at single ``positions``.

    What is asked for decides which chunks become partitions and which records are read. It goes by options of this
    read: the filters that Spark 4.1 pushes into a Python source stay with the source, and so hold, wrongly, for every
    other use of the same DataFrame. Filters on the result work as on any other.
    """
    spark.dataSource.register(FrameCache)
    asked = {"least": least, "below": below, "positions": None if positions is None else ",".join(map(str, positions))}
    return spark.read.format("frame_cache").options(**{k: str(v) for k, v in asked.items() if v is not None}).load(path)
