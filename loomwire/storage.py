"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set, a session on one machine (`local`, as in tests) gets a temporary one; on a cluster that is an
    error, since executors would not see it.
    """
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not at:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        at = context.getCheckpointDir()
    return at.rstrip("/")


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/loomwire-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and read back: later stages start from files, whichever executor is lost."""
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that `stored` returned; only after everything made of them has itself been stored."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


class Manifests:
    """Small numbered files that say what is current. Each appears under its name in one step, and its number only once."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._at = self._path(f"{self.root}/manifests")
        self._fs = self._at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def newest(self) -> dict | None:
        names = sorted(x.getPath().getName() for x in self._fs.listStatus(self._at)) if self._fs.exists(self._at) else []
        names = [n for n in names if n.endswith(".json")]
        return json.loads(self.spark.read.text(f"{self.root}/manifests/{names[-1]}", wholetext=True).first()[0]) if names else None

    def publish(self, number: int, state: dict) -> None:
        draft, final = self._path(f"{self.root}/drafts/{uuid.uuid4().hex}"), self._path(f"{self.root}/manifests/{number:020d}.json")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        self._fs.mkdirs(self._at)
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise RuntimeError(f"another writer has published {final}")
