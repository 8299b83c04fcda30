"""What is written for the time of a run: intermediate results in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a local one is made only where none is set and the master is local."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path


_RUNS: dict[str, str] = {}


def run_dir(spark: SparkSession) -> str:
    """One folder in the shared one for all that this application writes; ``clean_up`` removes it, at the end at the latest."""
    app = spark.sparkContext.applicationId
    if app not in _RUNS:
        _RUNS[app] = f"{shared_dir(spark)}/corpusloom-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(clean_up, spark)
    return _RUNS[app]


def clean_up(spark: SparkSession) -> None:
    """Removes what was stashed; results that were not yet written can't be read after it."""
    try:
        path = _RUNS.pop(spark.sparkContext.applicationId, None)
        if path:
            jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
    except Exception:  # the session has ended: a shared folder outlives it, a local one is removed by the interpreter
        pass


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives the loss of an executor."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
