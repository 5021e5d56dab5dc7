"""Numbered folders of Parquet: written whole, replaced when written again, read only where the write came to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def whole(spark: SparkSession, path: str) -> bool:
    """Whether a folder's write came to its end."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


class Numbered:
    """Folders `<name>=<number>` below `path`."""

    def __init__(self, spark: SparkSession, path: str, name: str):
        self.spark, self.path, self.name = spark, path.rstrip("/"), name

    def folders(self) -> dict[int, str]:
        """The whole folders by number."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(root):
            return {}
        found = [x.getPath() for x in files.listStatus(root) if x.getPath().getName().startswith(f"{self.name}=")]
        return {int(x.getName().split("=")[1]): x.toString() for x in found if whole(self.spark, x.toString())}

    def write(self, df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{self.name}={number}")

    def read(self) -> DataFrame:
        """All whole folders; a ValueError if there is none."""
        found = self.folders()
        if not found:
            raise ValueError(f"nothing has been written to {self.path}")
        return self.spark.read.parquet(*(found[i] for i in sorted(found)))
