"""Tables in versions: folders that never change, and one small file a version that names them.

A version is put in place by renaming its finished file to a name that must
not exist yet. So a reader finds the old version or the new one, never none
and never half of one, and of two writers that start from the same version
the second fails. This needs a store whose rename is atomic and doesn't
overwrite, as HDFS has; on a local disk the check and the rename are two steps.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Somebody else has put a version since the one that was read."""


@dataclass(frozen=True)
class Version:
    """Its number, the folders of each part with their bytes, the schema, and what the writer noted."""

    number: int
    parts: Mapping[str, Sequence[Sequence]]
    schema: T.StructType
    note: Mapping[str, object] = field(default_factory=dict)

    def folders(self, parts: Sequence[str] | None = None) -> list[str]:
        return [name for p in (self.parts if parts is None else parts) for name, _ in self.parts.get(p, ())]


class VersionedTable:
    """A folder of versions."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._Path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _pointer(self, number: int) -> str:
        return f"{self.path}/_versions/{number:020d}.json"

    def numbers(self) -> list[int]:
        """Numbers of the versions that are there, ascending."""
        try:
            found = self._fs.listStatus(self._Path(f"{self.path}/_versions"))
        except Py4JJavaError as e:
            if "FileNotFoundException" in str(e.java_exception):
                return []
            raise
        return sorted(int(f.getPath().getName()[:-5]) for f in found if f.getPath().getName().endswith(".json"))

    def version(self, number: int) -> Version:
        stream = self._fs.open(self._Path(self._pointer(number)))
        try:
            body = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Version(number, body["parts"], T.StructType.fromJson(body["schema"]), body["note"])

    def current(self) -> Version | None:
        """The newest version; None if there is none yet."""
        numbers = self.numbers()
        return self.version(numbers[-1]) if numbers else None

    def read(self, version: Version | None = None, parts: Sequence[str] | None = None) -> DataFrame:
        """The rows of a version, the newest unless one is given, or of some of its parts."""
        version = version or self.current()
        if version is None:
            raise FileNotFoundError(f"{self.path} has no version")
        folders = [f"{self.path}/{f}" for f in version.folders(parts)]
        return self.spark.read.schema(version.schema).parquet(*folders) if folders else self.spark.createDataFrame([], version.schema)

    def stage(self, df: DataFrame, by: str | None = None) -> dict[str, list]:
        """Write rows to a new folder, which no version names yet: its parts by the values of `by`, which leaves the rows, or one part named all."""
        name = f"data/{uuid.uuid4().hex}"
        (df.write.partitionBy(by) if by else df.write).parquet(f"{self.path}/{name}")
        if not by:
            return {"all": [name, self._bytes(name)]}
        inner = [f.getPath().getName() for f in self._fs.listStatus(self._Path(f"{self.path}/{name}")) if f.isDirectory()]
        return {d.split("=", 1)[1]: [f"{name}/{d}", self._bytes(f"{name}/{d}")] for d in inner}

    def _bytes(self, name: str) -> int:
        return self._fs.getContentSummary(self._Path(f"{self.path}/{name}")).getLength()

    def put(self, parts: Mapping[str, Sequence[Sequence]], schema: T.StructType, based_on: Version | None, note: Mapping[str, object] | None = None) -> Version:
        """Make the parts the version after based_on, or the first; Conflict if that number is taken."""
        number = based_on.number + 1 if based_on else 0
        body = json.dumps({"parts": parts, "schema": schema.jsonValue(), "note": dict(note or {})})
        draft = self._Path(f"{self.path}/_versions/.{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        try:
            stream.write(bytearray(body.encode()))
        finally:
            stream.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        nothing = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, self._Path(self._pointer(number)), nothing)
        except Py4JJavaError as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"version {number} of {self.path} is there already") from e
            raise
        return Version(number, parts, schema, note or {})

    def write(self, df: DataFrame, based_on: Version | None) -> Version:
        """All rows as the next version; df may read the version that it is based on."""
        parts = {p: [f] for p, f in self.stage(df).items()}
        try:
            return self.put(parts, df.schema, based_on)
        except Conflict:
            self.drop(f for v in parts.values() for f, _ in v)
            raise

    def drop(self, folders) -> None:
        for f in folders:
            self._fs.delete(self._Path(f"{self.path}/{f}"), True)

    def expire(self, keep: int = 2) -> int:
        """Drop all but the newest `keep` versions, and the folders that only those name; how many versions went.

        Readers of a version that goes fail, so keep as many as readers may lag.
        """
        numbers = self.numbers()
        old, new = numbers[:-keep], numbers[-keep:]
        named = {f for n in new for f in self.version(n).folders()}
        gone = {f for n in old for f in self.version(n).folders()} - named
        for n in old:
            self._fs.delete(self._Path(self._pointer(n)), False)
        self.drop(gone)
        return len(old)
