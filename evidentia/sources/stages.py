"""Stages that are skipped, resumed or redone by what their manifests say.

A stage writes its rows as Parquet into a folder named by the digest of what it was made from, and only then puts down its
manifest, in one rename. So a manifest is there as a whole or not at all: a run that was stopped, or lost its driver,
redoes the stage it was in and skips those before it; a stage whose inputs or parameters have changed is redone, and
the rows it replaces go once the new ones stand. All files are reached through Spark's own file systems.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterable, Mapping
from dataclasses import asdict, dataclass
from typing import Any
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Status:
    """What is known of a stage: ``pending``, ``running``, ``done`` or ``error``."""

    stage: str
    status: str
    digest: str = ""
    path: str = ""
    seconds: float = 0.0
    error: str = ""


class Folder:
    """Small files and folders of a store that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _of(self, name: str) -> tuple[Any, Any]:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        place, store = self._of(name)
        return store.exists(place)

    def delete(self, name: str = "") -> None:
        place, store = self._of(name)
        store.delete(place, True)

    def read(self, name: str) -> str | None:
        place, store = self._of(name)
        if not store.exists(place):
            return None
        stream = store.open(place)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """The file as a whole or not at all: written beside its place, then renamed."""
        made = f".{name}.{uuid4().hex}"
        place, store = self._of(made)
        stream = store.create(place, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        target, _ = self._of(name)
        if store.exists(target):
            store.delete(target, False)
        if not store.rename(place, target):
            raise OSError(f"{name} could not be put down in {self.path}")


def digest_of(frames: Iterable[DataFrame], parameters: Mapping[str, Any]) -> str:
    """A digest of the parameters, the frames' columns, the names of the files they read, and their folders' sizes and times.

    The store is asked once for each folder, not for each file.
    """
    told = [json.dumps(parameters, sort_keys=True, default=str)]
    for df in frames:
        spark = df.sparkSession
        names = sorted(df.inputFiles())
        told += [df.schema.json(), *names]
        for folder in sorted({n.rpartition("/")[0] for n in names}):
            place = spark._jvm.org.apache.hadoop.fs.Path(folder)
            store = place.getFileSystem(spark._jsc.hadoopConfiguration())
            told.append(f"{folder} {store.getContentSummary(place).getLength()} {store.getFileStatus(place).getModificationTime()}")
    return hashlib.sha256("\n".join(told).encode()).hexdigest()


class Stages:
    """The stages of one run in ``path``; a later run in the same folder takes up where this one ended."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, Folder(spark, path)

    def status(self, stage: str) -> Status:
        text = self.folder.read(f"{stage}.json")
        return Status(**json.loads(text)) if text else Status(stage, "pending")

    def _put(self, status: Status) -> None:
        self.folder.write(f"{status.stage}.json", json.dumps(asdict(status)))

    def run(self, stage: str, make: Callable[[], DataFrame], inputs: Iterable[DataFrame], **parameters: Any) -> DataFrame:
        """The stage's rows, read back: those that stand if they were made from the same, else those that ``make`` gives.

        A failure is kept as the stage's status and raised.
        """
        digest, old = digest_of(inputs, {"stage": stage, **parameters}), self.status(stage)
        if old.status == "done" and old.digest == digest and self.folder.exists(f"{old.path}/_SUCCESS"):
            return self.spark.read.parquet(f"{self.folder.path}/{old.path}")
        path, began = f"{stage}-{digest[:16]}-{uuid4().hex[:8]}", time.time()
        self._put(Status(stage, "running", digest, old.path))
        try:
            make().write.parquet(f"{self.folder.path}/{path}")
        except Exception as failed:
            self.folder.delete(path)
            self._put(Status(stage, "error", digest, old.path, round(time.time() - began, 3), str(failed)[:500]))
            raise
        self._put(Status(stage, "done", digest, path, round(time.time() - began, 3)))
        if old.path:
            self.folder.delete(old.path)
        return self.spark.read.parquet(f"{self.folder.path}/{path}")

    def drop(self, stage: str) -> None:
        """Forgets a stage and its rows."""
        path = self.status(stage).path
        self.folder.delete(f"{stage}.json")
        if path:
            self.folder.delete(path)

    def table(self, names: Iterable[str]) -> DataFrame:
        """``stage, status, digest, path, seconds, error`` of the named stages, in order."""
        rows = [tuple(asdict(self.status(n)).values()) for n in names]
        return self.spark.createDataFrame(rows, "stage string, status string, digest string, path string, seconds double, error string")
