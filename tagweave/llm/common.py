"""What the operators of this subpackage share: shared storage, the word pattern, doc_id hashing."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zlib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch that goes to a Python worker, unless the session sets its own: a batch of long texts stays small.
BATCH_BYTES = 8 << 20
_BYTES_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package, and bound the Arrow batches that they get by bytes, where the session has no bound of its own."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    if spark.conf.get(_BYTES_SETTING, "1") == "1":
        spark.conf.set(_BYTES_SETTING, str(BATCH_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset and Spark runs on one machine, one is made and set."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    context = spark.sparkContext
    if folder := context.getCheckpointDir():
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tagweave-checkpoint-"))
    return context.getCheckpointDir().rstrip("/")


_SCRATCH = "_tagweave_scratch"


def materialize(df: DataFrame, label: str, narrow: bool = False) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there, and lost executors cost no recomputation.

    narrow: the rows are few and short, so they go to fewer files than there are shuffle partitions. drop() deletes the files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tagweave-{label}-{uuid.uuid4().hex}"
    if narrow:
        df = df.coalesce(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    setattr(out, _SCRATCH, path)
    return out


def drop(*tables: DataFrame) -> None:
    """Delete the files of tables that materialize() made and that nothing reads any more."""
    for df in tables:
        if path := getattr(df, _SCRATCH, None):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def crc_of(doc_id: int | None) -> int:
    return zlib.crc32(str(doc_id).encode())


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id's digits divisible by 5. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))
