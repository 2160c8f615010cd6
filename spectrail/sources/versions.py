"""Numbered files of a folder, each of which is put there once, whoever comes first."""

from __future__ import annotations

import json
import os
import uuid
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession


class Versions:
    """``00000001.json`` and so on. A local folder links a finished file to its name, which fails where the name is taken;
    elsewhere the file system's own rename does, which HDFS makes atomic and lets fail then. Stores whose rename copies need one writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        plain = path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")
        self.local = None if "://" in plain else Path(plain)

    @staticmethod
    def _name(version: int) -> str:
        return f"{version:08d}.json"

    def last(self) -> int:
        """The highest version that is there; 0 for none."""
        if self.local is not None:
            names = [p.name for p in self.local.glob("*.json")]
        else:
            files, root = self._hadoop(self.path)
            names = [s.getPath().getName() for s in files.listStatus(root)] if files.exists(root) else []
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def read(self, upto: int | None = None) -> list[dict]:
        """What the versions hold, in order, up to one of them or to the last."""
        upto = self.last() if upto is None else upto
        if self.local is not None:
            return [json.loads((self.local / self._name(v)).read_text()) for v in range(1, upto + 1)]
        if not upto:
            return []
        rows = self.spark.read.text([f"{self.path}/{self._name(v)}" for v in range(1, upto + 1)], wholetext=True).selectExpr("_metadata.file_name AS name", "value").collect()  # one row for each change
        return [json.loads(r["value"]) for r in sorted(rows, key=lambda r: r["name"])]

    def put(self, version: int, content: dict) -> bool:
        """Whether this was the first to put the version there. What others see is whole."""
        text = json.dumps(content)
        if self.local is not None:
            self.local.mkdir(parents=True, exist_ok=True)
            draft = self.local / f".{uuid.uuid4().hex}"
            draft.write_text(text)
            try:
                os.link(draft, self.local / self._name(version))
                return True
            except FileExistsError:
                return False
            finally:
                draft.unlink()
        jvm = self.spark._jvm
        files, root = self._hadoop(self.path)
        files.mkdirs(root)
        draft = jvm.org.apache.hadoop.fs.Path(root, f".{uuid.uuid4().hex}")
        out = files.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        target = jvm.org.apache.hadoop.fs.Path(root, self._name(version))
        try:
            # a file system may only report the failure, or raise
            return bool(files.rename(draft, target))
        except PySparkException:
            return False
        finally:
            if files.exists(draft):
                files.delete(draft, False)

    def _hadoop(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place
