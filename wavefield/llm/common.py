"""What several corpus operators share: tables, the shared work folder, ids of rows and learned splits."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words, inside a regular expression's brackets.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share. Only a local session
    without that setting (a test) gets a temporary folder of the machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="wavefield-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "part") -> DataFrame:
    """The rows of df, written to the shared folder and read back: lineage ends here, so that
    a lost executor costs a re-read and not the work before it."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}-{name}"
    df.write.parquet(path)
    table_ = spark.read.schema(df.schema).parquet(path)
    _PATHS[table_] = path
    return table_


#: Where each stored table lies.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing lazy reads any more."""
    for x in tables:
        path = _PATHS.pop(x, None)
        if path is not None:
            there = x.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(x.sparkSession._jsc.hadoopConfiguration()).delete(there, True)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the third of the rows that nothing is learned from; a null id counts as the text ''."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 3 == 1


def let(value: Column, body) -> Column:
    """body applied to value, which is computed once a row even if lambdas below use it often."""
    return F.transform(F.array(value), body)[0]
