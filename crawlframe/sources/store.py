"""Job tables in immutable versions: a new folder for every commit, a pointer file written last."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; an own one only where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = f"file://{tempfile.mkdtemp(prefix='crawlframe-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_scratch: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/crawlframe/{label}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def _clean() -> None:
    from pyspark import SparkContext

    sc = SparkContext._active_spark_context
    if sc is None or sc._jsc is None:
        return
    try:
        for path in _scratch:
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the JVM may be gone already; what stays is scratch data
        return


atexit.register(_clean)


class Store:
    """Named tables at a path. ``commit`` writes all tables of a version, then its marker; readers take the last marker."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The last committed version, 0 if there is none."""
        marks = self._fs.globStatus(self._path(f"{self.path}/committed-*"))
        return max((int(m.getPath().getName().split("-")[1]) for m in marks or []), default=0)

    def commit(self, **tables: DataFrame) -> int:
        """Write ``tables`` as the next version; tables that aren't given carry over. Fails if another writer was first."""
        now = self.version()
        new, token = now + 1, uuid.uuid4().hex
        given = self.tables(now)
        places = given | {name: f"{self.path}/{token}/{name}" for name in tables}
        for name, df in tables.items():
            df.write.mode("errorifexists").parquet(places[name])
        out = self._fs.create(self._path(f"{self.path}/committed-{new}"), False)  # no overwriting: the first writer wins
        out.write(bytearray("\n".join(f"{k}\t{v}" for k, v in sorted(places.items())).encode()))
        out.close()
        return new

    def tables(self, version: int) -> dict[str, str]:
        if not version:
            return {}
        text = self.spark.read.text(f"{self.path}/committed-{version}").collect()  # one line a table
        return dict(r["value"].split("\t") for r in text if r["value"])

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        place = self.tables(self.version() if version is None else version).get(name)
        return self.spark.read.parquet(place) if place else None

    def health(self) -> bool:
        return self.spark.range(1).count() == 1
