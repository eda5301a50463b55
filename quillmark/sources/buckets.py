"""A keyed table of plain files that is merged by buckets: copy on write, with a manifest that is written last.

Rows lie in a fixed number of buckets by a hash of their key. A commit reads, merges and writes the buckets that its keys fall
into; the others keep the files that they have. ``manifest/<n>`` says which commit wrote each bucket's live files, so a reader
sees a commit whole or not at all, and a commit that was cut off has left files that no manifest names. A commit whose number is
there already changes nothing, so a batch may be replayed.

The manifest has one entry a bucket, whatever the number of rows; it is all that the driver holds.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Manifests that are kept, and with them the files that they name.
KEPT = 2


@dataclass
class BucketTable:
    """folder: on a file system that all executors share; buckets may not change once there are commits."""

    spark: SparkSession
    folder: str
    key: str
    buckets: int = 64

    def _path(self, *parts: str) -> object:
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))

    @property
    def _files(self) -> object:
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def commits(self) -> list[int]:
        """Numbers of the commits that are kept, ascending."""
        place = self._path("manifest")
        if not self._files.exists(place):
            return []
        return sorted(int(f.getPath().getName()) for f in self._files.listStatus(place) if f.getPath().getName().isdigit())

    def manifest(self, number: int | None = None) -> dict[int, int]:
        """For each bucket with rows the commit that wrote it; of the last commit, or of a numbered one."""
        known = self.commits()
        if number is None and not known:
            return {}
        stream = self._files.open(self._path("manifest", str(known[-1] if number is None else number)))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        found = json.loads(text)
        if found["buckets"] != self.buckets or found["key"] != self.key:
            raise ValueError(f"the table has {found['buckets']} buckets by {found['key']}")
        return {int(b): v for b, v in found["live"].items()}

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _live(self, manifest: dict[int, int]) -> DataFrame | None:
        paths = [f"{self.folder}/data/commit={v}/bucket={b}" for b, v in sorted(manifest.items())]
        return self.spark.read.option("mergeSchema", True).parquet(*paths) if paths else None

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of the last commit (or of a kept one); an error if there is none."""
        rows = self._live(self.manifest(number))
        if rows is None:
            raise ValueError(f"{self.folder} has no rows")
        return rows

    def merge(self, rows: DataFrame, number: int, order: str | None = None, deleted: DataFrame | None = None) -> bool:
        """Commit number: rows replace those of the same key, keys of ``deleted`` go. False if that commit is there already.

        Of rows that repeat a key that with the largest ``order`` counts; without an order keys must be unique. Columns that one side lacks are null. Rows
        with a null key are left out. Numbers ascend; a commit of nothing is a commit. Two writers at once: the second one fails.
        """
        known = self.commits()
        if known and number <= known[-1]:
            return False
        before = self.manifest() if known else {}
        rows = rows.filter(F.col(self.key).isNotNull())
        if order is not None:
            rows = rows.groupBy(self.key).agg(F.max_by(F.struct(*(F.col(c) for c in rows.columns)), F.col(order)).alias("_r")).select("_r.*")
        keys = rows.select(self.key) if deleted is None else rows.select(self.key).unionByName(deleted.select(self.key).filter(F.col(self.key).isNotNull()))
        touched = sorted(r[0] for r in keys.select(self.bucket(F.col(self.key))).distinct().collect())
        fresh = rows.withColumn("bucket", self.bucket(F.col(self.key)))
        old = self._live({b: v for b, v in before.items() if b in set(touched)})
        if old is not None:
            gone = keys.distinct()
            fresh = old.join(gone, self.key, "left_anti").withColumn("bucket", self.bucket(F.col(self.key))).unionByName(fresh, allowMissingColumns=True)
        place = f"{self.folder}/data/commit={number}"
        if touched:
            fresh.repartition(max(1, min(len(touched), self.buckets)), "bucket").write.partitionBy("bucket").mode("overwrite").parquet(place)
        written = {int(f.getPath().getName().split("=")[1]) for f in self._files.listStatus(self._path("data", f"commit={number}")) if "=" in f.getPath().getName()} if touched else set()
        live = {b: v for b, v in before.items() if b not in set(touched)} | dict.fromkeys(sorted(written), number)
        self._commit(number, live)
        self._tidy()
        return True

    def _commit(self, number: int, live: dict[int, int]) -> None:
        """The manifest is written aside and takes its name as the last step; a name that is taken is another writer's."""
        aside, place = self._path("manifest", f".{number}.new"), self._path("manifest", str(number))
        out = self._files.create(aside, True)
        out.write(bytearray(json.dumps({"key": self.key, "buckets": self.buckets, "live": live}).encode()))
        out.close()
        try:
            done = not self._files.exists(place) and self._files.rename(aside, place)
        except Py4JJavaError:
            done = False
        if not done:
            raise RuntimeError(f"commit {number} of {self.folder} was made by another writer")

    def _tidy(self) -> None:
        """Files go that no kept manifest names."""
        known = self.commits()
        if len(known) <= KEPT:
            return
        kept = [self.manifest(n) for n in known[-KEPT:]]
        named = {(v, b) for m in kept for b, v in m.items()}
        for n in known[:-KEPT]:
            for b, v in self.manifest(n).items():
                if (v, b) not in named:
                    self._files.delete(self._path("data", f"commit={v}", f"bucket={b}"), True)
            self._files.delete(self._path("manifest", str(n)), False)
