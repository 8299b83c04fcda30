"""ORC: stages as functions on one session, each writing a table that the next ones read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Stage = Callable[[SparkSession, Callable[[str], DataFrame]], DataFrame]


class Pipeline:
    """Named stages; a stage's result is a Parquet table in ``folder`` under its name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.stages = spark, folder, {}

    def stage(self, name: str, fn: Stage) -> Pipeline:
        self.stages[name] = fn
        return self

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def status(self) -> dict[str, str]:
        """complete or pending, by whether the stage's table exists."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        out = {}
        for name in self.stages:
            p = hadoop.Path(self.path(name) + "/_SUCCESS")
            out[name] = "complete" if p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p) else "pending"
        return out

    def run(self, names: list[str] | None = None, resume: bool = False) -> dict[str, str]:
        """Runs the stages in order and goes on after a failure; with ``resume`` complete ones are left alone."""
        done = self.status() if resume else {}
        out = {}
        for name in names or list(self.stages):
            if done.get(name) == "complete":
                out[name] = "skipped"
                continue
            try:
                self.stages[name](self.spark, self.read).write.mode("overwrite").parquet(self.path(name))
                out[name] = "complete"
            except Exception as e:  # noqa: BLE001
                out[name] = f"failed: {type(e).__name__}"
        return out
