"""State that a recurring job hands from run to run: one version for the end of each run's span.

A run that starts at an instant reads the newest version up to that instant. So a run that is repeated reads what it read
the first time, and its new version takes the place of the one it wrote before.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.spans import as_datetime
from .commits import CommitLog


class RunStates:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = CommitLog(spark, f"{self.path}/commits")

    @staticmethod
    def version(instant) -> str:
        """Name of a version; names sort like instants."""
        return as_datetime(instant).strftime("%Y%m%dT%H%M%S%f")

    def versions(self) -> list[str]:
        return self.log.names()

    def before(self, start) -> dict[str, DataFrame]:
        """The frames of the newest version up to an instant; none before the first."""
        known = [v for v in self.versions() if v <= self.version(start)]
        if not known:
            return {}
        record = self.log.read(known[-1])
        return {
            name: self.spark.read.schema(schema).parquet(f"{self.path}/{record['folder']}/{name}") for name, schema in record["frames"].items()
        }

    def write(self, end, frames: dict[str, DataFrame]) -> None:
        """Store the state at the end of a run. Frames become visible together, once all are written."""
        version = self.version(end)
        folder = f"{version}-{uuid.uuid4().hex}"
        for name, frame in frames.items():
            frame.write.parquet(f"{self.path}/{folder}/{name}")
        kinds = {n: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields) for n, frame in frames.items()}
        self.log.add(version, {"folder": folder, "frames": kinds}, replace=True)

    def forget(self, before) -> None:
        """Remove versions that end before an instant, but for the newest of them."""
        for version in [v for v in self.versions() if v < self.version(before)][:-1]:
            folder = self.log.read(version)["folder"]
            self.log.drop(version)
            CommitLog(self.spark, self.path).folder.delete(folder)
