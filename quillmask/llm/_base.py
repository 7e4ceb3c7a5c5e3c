"""What the training-data operators share: shipping the package to workers, cutting lineage, reading tables."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()

#: Upper- to lower-case for A-Z only, as arguments of translate().
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Bytes of an Arrow batch that goes to a Python worker, unless the session says otherwise; a longer text is a batch of its own.
BATCH, BATCH_BYTES, SPARKS_OWN = "spark.sql.execution.arrow.maxBytesPerBatch", "4m", "67108864b"


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the Python workers, once per application, through Spark's own file server; bound what a worker gets at a time."""
    sc = spark.sparkContext
    if spark.conf.get(BATCH) == SPARKS_OWN:
        spark.conf.set(BATCH, BATCH_BYTES)
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(), f"{package.name}.zip")
    with zipfile.ZipFile(target, "w") as out:
        for p in sorted(package.rglob("*.py")):
            out.write(p, p.relative_to(package.parent))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only where none is set and there is but one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp())
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again; the folder goes when the application ends, or before by drop()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at, files = _files(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def drop(df: DataFrame) -> None:
    """Delete the folder of a frame that stored() returned and that nothing reads any more."""
    at, files = _files(df.sparkSession, df._folder)
    files.delete(at, True)


def _files(spark: SparkSession, path: str) -> tuple:
    """Hadoop's path, and the file system that it lies in."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def filtered(docs: DataFrame, keeps: Callable[[list[str]], list[bool]], text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose texts (null: empty) keeps() says True for; nothing is shuffled."""
    ship(docs.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield b.filter(pa.array(keeps([t or "" for t in b.column(text_col).to_pylist()]), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id (long) and text (null: empty) only, so that no other column of docs can clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def crc_mod(id_col: str, n: int) -> Column:
    """crc32(id as text) mod n; null ids count as the text ''."""
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "utf-8")) % n


def spread(docs: DataFrame) -> int:
    """How many partitions a shuffle of this session makes at most."""
    return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
