"""Helpers shared by the corpus operators: word rules, row keys, tables on shared storage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: White space that separates words (space, tab, line feed, vertical tab, form feed, carriage return).
SPACE_WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset (tests, a local session) a folder under the warehouse is used; a cluster
    without the setting is refused, as a machine-local folder would be unreadable elsewhere.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/corvane-work"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and returns it read back.

    Cuts the lineage: what follows reads files that outlive any executor.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._corvane_path = path
    return out


def release(df: DataFrame) -> None:
    """Deletes the files of a table made by ``materialize`` that nothing reads any more."""
    path = getattr(df, "_corvane_path", None)
    if path:
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def id_type(docs: DataFrame, name: str) -> str:
    """The type in which an id column is kept: whole numbers as bigint, all others (text ids, say) as they are."""
    t = docs.schema[name].dataType
    return "bigint" if isinstance(t, IntegralType) else t.simpleString()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def same(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Joins on equal keys where null equals null; the right side's keys are dropped."""
    renamed = right.select(*[F.col(c).alias(f"__{c}") if c in keys else F.col(c) for c in right.columns])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(renamed[f"__{k}"])
        cond = c if cond is None else cond & c
    out = left.join(renamed, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"__{k}" for k in keys])


#: Rows of a table of keys that may be broadcast (some tens of MB); a larger one is joined by a shuffle.
BROADCAST_ROWS = 500_000


def sized(keys: DataFrame, name: str, bound: int = BROADCAST_ROWS) -> DataFrame:
    """``keys`` written and counted, marked for broadcast if they have at most ``bound`` rows.

    Documents that are joined with it then stay where they lie: no exchange of texts by a key that may be hot.
    """
    kept = materialize(keys, name)
    out = F.broadcast(kept) if kept.count() <= bound else kept
    out._corvane_path = kept._corvane_path
    return out
