"""Tables that change by commits: every version stays readable, and a commit is seen whole or not at all.

A table's rows are dealt to buckets by a hash of their keys, and a version is a small file that names a folder for each bucket. A
change reads and rewrites the buckets of the keys that it touches, into a new folder, and then puts the next version's file in
place, which fails if another writer was faster. If the other one touched none of the same buckets, the change is put on top
of it; else it is a conflict, and nothing of it is seen. What breaks off before the last step leaves files that no version names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(Exception):
    """Another writer has changed buckets of the same keys since the version that a change was made from."""


class VersionedTable:
    """The table at ``path``, a folder that all executors share. ``keys`` are the columns that tell rows apart."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets

    def _fs(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def version(self) -> int:
        """The newest version; -1 without any."""
        fs, at = self._fs("versions")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return max([int(n) for n in names if n.isdigit()], default=-1)

    def _manifest(self, version: int) -> dict:
        rows = self.spark.read.text(f"{self.path}/versions/{version:08d}", wholetext=True).collect()
        return json.loads(rows[0][0])

    def _put(self, version: int, manifest: dict) -> bool:
        """Writes a version's file under another name and gives it its own, unless that is taken."""
        fs, to = self._fs(f"versions/{version:08d}")
        _, draft = self._fs(f"versions/draft-{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        jvm = self.spark._jvm
        try:
            if fs.getScheme() == "file":  # a local rename would replace the file; a link doesn't
                paths = [jvm.java.nio.file.Paths.get(p.toUri()) for p in (fs.makeQualified(to), fs.makeQualified(draft))]
                jvm.java.nio.file.Files.createLink(*paths)
                fs.delete(draft, False)
                return True
            return bool(fs.rename(draft, to))
        except Exception as error:
            if "FileAlreadyExists" in str(error):
                fs.delete(draft, False)
                return False
            raise

    def _bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, touched: list[int]) -> dict[str, str]:
        folder = uuid.uuid4().hex
        rows.withColumn("_bucket", self._bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{folder}")
        return {str(b): folder for b in touched}

    def create(self, rows: DataFrame) -> int:
        """Version 0 with ``rows``; a table that is there already is a conflict."""
        if self.version() >= 0:
            raise Conflict(f"{self.path} has versions")
        folders = self._write(rows, list(range(self.buckets)))
        if not self._put(0, {"schema": rows.schema.json(), "buckets": self.buckets, "keys": self.keys, "folders": folders, "changed": sorted(map(int, folders))}):
            raise Conflict(f"{self.path} has versions")
        return 0

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows at a version, the newest without one; ``only`` reads some buckets."""
        from pyspark.sql.types import IntegerType, StructField, StructType

        m = self._manifest(self.version() if version is None else version)
        schema = StructType.fromJson(json.loads(m["schema"]))
        of: dict[str, list[int]] = {}
        for b, folder in m["folders"].items():
            if only is None or int(b) in only:
                of.setdefault(folder, []).append(int(b))
        out = self.spark.createDataFrame([], schema)
        for folder, buckets in of.items():
            part = self.spark.read.schema(StructType([*schema.fields, StructField("_bucket", IntegerType())])).parquet(f"{self.path}/data/{folder}")
            out = out.unionByName(part.where(F.col("_bucket").isin(buckets)).drop("_bucket"))
        return out

    def change(self, make: Callable[[DataFrame], DataFrame], touched: DataFrame, base: int | None = None) -> int:
        """Replaces the rows of the buckets of ``touched`` (the keys) at version ``base`` by ``make`` of them, and commits; returns the version.

        ``make`` must give rows of these buckets only: those whose keys it doesn't change as they are, new ones with keys of ``touched``.
        """
        base = self.version() if base is None else base
        buckets = sorted(r[0] for r in touched.select(self._bucket().alias("b")).distinct().collect())  # not more than the table's buckets
        if not buckets:
            return base
        rows = make(self.read(base, buckets))
        folders = self._write(rows, buckets)
        while True:
            now = self.version()
            for v in range(base + 1, now + 1):
                if both := set(self._manifest(v)["changed"]) & set(buckets):
                    raise Conflict(f"version {v} has changed {len(both)} of the same buckets")
            m = self._manifest(now)
            if self._put(now + 1, m | {"folders": m["folders"] | folders, "changed": buckets}):
                return now + 1

    def upsert(self, rows: DataFrame, base: int | None = None) -> int:
        """Puts ``rows`` in the place of those with their keys, or adds them."""
        return self.change(lambda old: old.join(rows.select(*self.keys), self.keys, "left_anti").unionByName(rows), rows, base)

    def delete(self, keys: DataFrame, base: int | None = None) -> int:
        """Takes the rows with ``keys`` out."""
        return self.change(lambda old: old.join(keys.select(*self.keys), self.keys, "left_anti"), keys, base)

    def update(self, where: str, values: dict[str, F.Column], base: int | None = None) -> int:
        """Sets columns of the rows that match a condition, in one commit."""
        base = self.version() if base is None else base

        def make(old: DataFrame) -> DataFrame:
            hit = F.coalesce(F.expr(where), F.lit(False))
            return old.select(*(F.when(hit, values[c]).otherwise(F.col(c)).cast(kind).alias(c) if c in values else F.col(c) for c, kind in old.dtypes))

        return self.change(make, self.read(base).where(where), base)
