"""Session helpers: table access and cutting lineage in the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session may lack the setting; it gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    made = getattr(shared_folder, "_made", None)
    if made is None or not os.path.isdir(made):
        made = tempfile.mkdtemp(prefix="quarrygraph-")
        shared_folder._made = made  # type: ignore[attr-defined]
        atexit.register(_remove_tree, made)
    return f"file://{made}"


def _remove_tree(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once per context, so that their Python workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_quarrygraph_shipped", False):
        return
    package = Path(__file__).resolve().parent
    made = tempfile.mkdtemp(prefix="quarrygraph-code-")
    atexit.register(_remove_tree, made)
    with zipfile.ZipFile(f"{made}/quarrygraph.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(f"{made}/quarrygraph.zip")
    sc._quarrygraph_shipped = True  # type: ignore[attr-defined]


class Scratch:
    """Intermediate tables of one operator run, written as Parquet into the shared folder.

    Writing a table cuts the lineage and survives lost executors. ``drop`` removes one that is no longer read; what is
    left goes with ``release`` or when the driver process ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/quarry-{uuid.uuid4().hex}"
        self.n = 0
        atexit.register(self.close)
        _LIVE.append(self)

    def told(self, df: DataFrame, **figures: Column) -> tuple[DataFrame, dict[str, object]]:
        """``cut``, and aggregates over all rows taken while they are written."""
        seen = Observation()
        out = self.cut(df.observe(seen, *[c.alias(k) for k, c in figures.items()]))
        return out, seen.get

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.n}"
        self.n += 1
        schema = df.schema
        df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path  # type: ignore[attr-defined]
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            if path := getattr(df, "_scratch_path", None):
                self._delete(path)

    def close(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session may be gone already
            pass

    def _delete(self, path: str) -> None:
        if path.startswith(("file:", "/")):
            return _remove_tree(path.removeprefix("file://").removeprefix("file:"))
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Removes all intermediate tables that this process has made in the shared folder. Frames that still read them fail afterwards."""
    for work in list(_LIVE):
        work.spark = spark
        work.close()
    _LIVE.clear()


_LIVE: list[Scratch] = []
