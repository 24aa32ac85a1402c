"""Several tables that change together: one pointer names the newest version of each."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quillspark.scratch import remove


class Stores:
    """Named tables in a shared folder; a commit replaces some or all of them at once, or none.

    Rows are written first, by the tasks, each table to a folder of its own; then the pointer moves,
    in one rename. A job that dies before leaves the old versions as they are, and one that repeats a
    commit's number changes nothing. One job writes at a time. Versions that nothing points to stay
    until vacuum().
    """

    def __init__(self, spark: SparkSession, path: str, schemas: Mapping[str, T.StructType]):
        self.spark, self.path, self.schemas = spark, path.rstrip("/"), dict(schemas)
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at(self.path))

    def _pointers(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(self.path))]
        return sorted(int(n[8:-5]) for n in names if n.startswith("pointer-") and n.endswith(".json"))

    def _pointer(self) -> dict:
        numbers = self._pointers()
        if not numbers:
            return {"number": -1, "tables": {}}
        text = self.spark.read.text(f"{self.path}/pointer-{numbers[-1]}.json", wholetext=True).first()[0]
        return {"number": numbers[-1], "tables": json.loads(text)}

    @property
    def number(self) -> int:
        """The number of the last commit, -1 before the first."""
        return self._pointer()["number"]

    def read(self, name: str) -> DataFrame:
        version = self._pointer()["tables"].get(name)
        schema = self.schemas[name]
        return self.spark.createDataFrame([], schema) if version is None else self.spark.read.schema(schema).parquet(f"{self.path}/{version}")

    def commit(self, tables: Mapping[str, DataFrame], number: int | None = None) -> bool:
        """Make these the newest versions, all at once; False if the number is not beyond the last commit's."""
        now = self._pointer()
        number = now["number"] + 1 if number is None else number
        if number <= now["number"]:
            return False
        versions = dict(now["tables"])
        for name, rows in tables.items():
            versions[name] = f"{name}-{uuid.uuid4().hex}"
            rows.select(*self.schemas[name].names).write.parquet(f"{self.path}/{versions[name]}")
        return self._move(versions, number)

    def clear(self, number: int | None = None) -> bool:
        """Empty all tables at once."""
        now = self._pointer()
        number = now["number"] + 1 if number is None else number
        return number > now["number"] and self._move({}, number)

    def _move(self, versions: dict[str, str], number: int) -> bool:
        draft = self._at(f"{self.path}/draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        out.write(json.dumps(versions).encode())
        out.close()
        pointer = self._at(f"{self.path}/pointer-{number}.json")
        return not self._fs.exists(pointer) and self._fs.rename(draft, pointer)

    def vacuum(self) -> None:
        """Delete pointers before the newest, and versions and drafts that it does not name."""
        now = self._pointer()
        keep = {f"pointer-{now['number']}.json", *now["tables"].values()}
        for status in self._fs.listStatus(self._at(self.path)):
            name = status.getPath().getName()
            if name not in keep:
                remove(self.spark, f"{self.path}/{name}")
