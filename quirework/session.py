"""Session settings, table access and checkpointing shared by every operator."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_STEPS: dict[int, list[str]] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.maxPlanStringLength": "100000",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Settings that results depend on; sizes and memory stay the deployer's."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    _ship(spark)
    return spark


def _ship(spark: SparkSession) -> None:
    """Gives the Python workers this package, once a context; Spark's own file server hands it out."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parent
    if getattr(sc, "_quirework_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="quirework-")) / "quirework.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(path))
    sc._quirework_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; only where none is named, as in tests, a local one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="quirework-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """Cuts the lineage: writes df once to the shared folder and reads it back.

    Survives the loss of executors, as no part of it stays on them only. The shuffles behind it
    are deleted once it is written, not whenever the driver collects its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    _STEPS.setdefault(id(spark.sparkContext), []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(step: DataFrame) -> None:
    """Deletes a stored step that nothing will read again, before the query ends."""
    sc = step.sparkSession.sparkContext
    for path in step.inputFiles()[:1]:
        folder = path.rsplit("/", 1)[0]
        mine = [p for p in _STEPS.get(id(sc), []) if p.rsplit("/", 1)[-1] == folder.rsplit("/", 1)[-1]]
        for p in mine:
            _delete(sc, p)
            _STEPS[id(sc)].remove(p)


def clear(spark: SparkSession) -> None:
    """Deletes what this session's steps wrote to the shared folder; call it when their results are done with."""
    sc = spark.sparkContext
    for path in _STEPS.pop(id(sc), []):
        _delete(sc, path)


@contextmanager
def steps(spark: SparkSession) -> Iterator[None]:
    """Within it, queries may be built and their results read or written; at its end their steps are deleted."""
    before = list(_STEPS.get(id(spark.sparkContext), []))
    try:
        yield
    finally:
        sc = spark.sparkContext
        for path in [p for p in _STEPS.get(id(sc), []) if p not in before]:
            _delete(sc, path)
        _STEPS[id(sc)] = before


def _delete(sc, path: str) -> None:  # noqa: ANN001
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _at_end() -> None:
    """What is left of the steps goes when the program ends."""
    sc = SparkContext._active_spark_context
    for path in _STEPS.pop(id(sc), []) if sc is not None and sc._jsc is not None else []:
        try:
            _delete(sc, path)
        except Exception:  # noqa: BLE001, S110
            pass


def tasks(spark: SparkSession) -> int:
    """Tasks that run at a time, for sizing Python stages."""
    return max(2, spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as tasks run at a time, if it comes in fewer: a few large row
    groups would leave most cores idle in a Python stage. Larger inputs pass as they are."""
    n = tasks(df.sparkSession)
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df
