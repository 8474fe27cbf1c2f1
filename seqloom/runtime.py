"""What every plan needs from the cluster: a session, a shared folder, and a join that skewed keys cannot hurt."""

from __future__ import annotations

import atexit
import gc
import io
import os
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than 1/HOT_SHARE of the rows is hot, so there are fewer than HOT_SHARE hot keys in any input.
HOT_SHARE = 1000
#: Below so many rows for a key no task can be overloaded by it.
HOT_LEAST = 500

_shipped: set[str] = set()
_roots: dict[str, str] = {}


def session(app: str = "seqloom", cpus: int | str = "*") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster pass your own session to the operators."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once for each Spark application, so that Python workers can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, str(p.relative_to(here.parent)))
    path = os.path.join(tempfile.mkdtemp(prefix="seqloom-"), "seqloom.zip")
    Path(path).write_bytes(packed.getvalue())
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, which driver and executors share.

    The setting is read from the session. Only where it is unset (tests on one
    machine) a temporary folder stands in for it.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="seqloom-shared-")
        _roots[app] = f"{base.rstrip('/')}/seqloom-{app}"
        atexit.register(_remove_quietly, spark, _roots[app])
    return _roots[app]


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session may have ended before the interpreter does
        pass


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whichever file system holds it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs whose results are written.

    It does so when the driver collects what refers to them, which a driver with
    little to do may put off until the next stages have filled the disks.
    """
    for _ in range(2):  # what listeners still hold in the first round goes in the second
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive any executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def keep(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """Write df and return what reads it back; the schema is passed on, so that empty tables work too."""
        path = self.path(name)
        df.write.options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *frames: DataFrame) -> None:
        """Delete the files below the given kept tables."""
        for df in frames:
            for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
                remove(self.spark, parent)


def hot_keys(sizes: DataFrame, size: Column, total: int) -> Column:
    """True for groups too large for one task; by HOT_SHARE at most 1000 groups can be."""
    return size > F.lit(max(HOT_LEAST, total // HOT_SHARE))


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of rows with one row per key, safe for keys that hold a large share of the rows.

    groups[size] is how many rows have the key, total how many rows there are.
    Groups above total/HOT_SHARE rows are fewer than HOT_SHARE, whatever the
    input, so they are broadcast; all other keys go through a shuffle join in
    which no key can be large. A null key matches nothing.
    """
    hot = groups.filter(hot_keys(groups, F.col(size), total))
    cold = groups.filter(~hot_keys(groups, F.col(size), total))
    few = F.broadcast(hot)
    return rows.join(few, key).unionByName(
        rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold.hint("shuffle_merge"), key)
    )
