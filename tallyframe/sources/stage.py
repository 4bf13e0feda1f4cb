"""Intermediate tables in a shared folder that the caller names.

Many answers over one slice would otherwise each re-read and re-parse the
source.  A ``StageFolder`` writes a table once as Parquet and reads it back:
later plans start from those files, so a lost executor costs a re-read, not
a re-run of the parse.  Leaving the folder's ``with`` block deletes it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only for a
    local session that names none (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("name a folder that all executors share, or set spark.checkpoint.dir")
    folder = tempfile.mkdtemp(prefix="tallyframe-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


class StageFolder:
    """A new folder under ``root`` (shared by driver and executors) for one run.

    ``root`` defaults to ``spark.checkpoint.dir``; without either there is no
    folder that all executors see, and none is made up.
    """

    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        root = root or spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            raise ValueError("name a folder that all executors share, or set spark.checkpoint.dir")
        self.spark = spark
        self.root = root.rstrip("/")
        self.path = f"{self.root}/tallyframe-{uuid.uuid4().hex}"
        self.root_is_new = not self._files(self.root)[0].exists(self._files(self.root)[1])

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written to the folder and read back."""
        path = f"{self.path}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _files(self, path: str):
        """The path's file system and the path."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()), folder

    def delete(self) -> None:
        """Delete the folder, and its root if that was made for it and holds nothing else."""
        fs, folder = self._files(self.path)
        fs.delete(folder, True)
        fs, root = self._files(self.root)
        if self.root_is_new and fs.exists(root) and not len(fs.listStatus(root)):
            fs.delete(root, False)

    def __enter__(self) -> StageFolder:
        return self

    def __exit__(self, *_: object) -> None:
        self.delete()
