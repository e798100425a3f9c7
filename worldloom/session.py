"""Session settings and the shared scratch folder.

Intermediate tables that cut lineage are written as parquet below ``spark.checkpoint.dir``,
which all executors share, so losing an executor only costs the tasks it was running.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

_own_scratch: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def build(app: str = "worldloom", master: str = "local[*]", **extra: str) -> SparkSession:
    """A session with the settings above; a running session is returned as it is."""
    b = SparkSession.builder.master(master).appName(app)
    for k, v in (DEFAULTS | extra).items():
        b = b.config(k, v)
    return b.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only where none is named and all runs on one machine.

    On a cluster a machine's own folder would lose data with the machine, so a missing setting is an error there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    app = spark.sparkContext.applicationId
    if app not in _own_scratch:
        _own_scratch[app] = tempfile.mkdtemp(prefix="worldloom-")
    return _own_scratch[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{scratch_root(spark)}/worldloom-{uuid.uuid4().hex[:12]}-{label}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Delete the intermediate tables this application wrote; results that still read them must be written first."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    return len(paths)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, on whatever file system it names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the scratch folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def count_rows(df: DataFrame) -> int:
    """Rows of a materialized table; answered from parquet footers."""
    return df.agg(F.count(F.lit(1))).collect()[0][0]


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application (as ``--py-files`` would)."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    staged = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="worldloom-"), os.path.basename(here)), "zip", os.path.dirname(here), os.path.basename(here))
    sc.addPyFile(staged)
    _shipped.add(sc.applicationId)
