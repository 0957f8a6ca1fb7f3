"""Shared storage for tables that cut lineage, and size-checked broadcasts."""

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    path = tempfile.mkdtemp(prefix="driftpool-")
    spark.sparkContext.setCheckpointDir(path)
    return path


_marked = set()


def new_folder(spark: SparkSession) -> str:
    """A new path below a folder of this application, which is removed when the application ends."""
    context = spark.sparkContext
    home = f"{shared_folder(spark)}/staged-{context.applicationId}"
    if home not in _marked:
        path = context._jvm.org.apache.hadoop.fs.Path(home)
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _marked.add(home)
    return f"{home}/{uuid.uuid4().hex}"


def staged(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` once to shared storage and read it back.

    Later jobs start from the files, so a lost executor costs a re-read and
    not a recomputation, and several readers share one computation.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._staged_at = path
    return kept


def unstaged(df: DataFrame) -> None:
    """Remove the files of a table that ``staged`` returned; nothing may read it any more."""
    context = df.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(df._staged_at)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def bounded_side(df: DataFrame, max_rows: int = 100_000, max_bytes: int = 32 << 20) -> tuple[DataFrame, bool]:
    """Stage a join side and mark it for broadcast only if its rows and their bytes are few."""
    kept = staged(df)
    size = F.octet_length(F.to_json(F.struct("*")))
    rows, total = kept.limit(max_rows + 1).agg(F.count("*"), F.sum(size)).first()
    small = rows <= max_rows and (total or 0) <= max_bytes
    return (F.broadcast(kept) if small else kept), small


def bounded_groups(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Stage ``df`` and refuse it if any group is too large to be packed into one row."""
    kept = staged(df)
    large = kept.groupBy(*keys).count().filter(F.col("count") > most).limit(1).collect()
    if large:
        raise ValueError(f"group {large[0]} has more than {most} rows and cannot be packed")
    return kept


def join_bounded(rows: DataFrame, side: DataFrame, on: list[str], how: str = "inner",
                 max_rows: int = 100_000, salts: int = 64) -> DataFrame:
    """Join a long table to a normally tiny one.

    Within ``max_rows`` and the bytes of ``bounded_side`` the side is broadcast and the long table stays where it
    is. Beyond that the side is copied ``salts`` times and the long table is
    spread over the copies by a hash of its columns, so one hot key is shared
    by ``salts`` tasks; rows should carry a distinguishing column such as ``seq``.
    """
    side, small = bounded_side(side, max_rows)
    if small:
        return rows.join(side, on, how)
    spread = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    copies = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, on + ["_salt"], how).drop("_salt")


_shipped = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    base = os.path.join(tempfile.mkdtemp(prefix="driftpool-code-"), "driftpool")
    # only the driver reads this archive from disk, Spark hands it to the executors
    context.addPyFile(shutil.make_archive(base, "zip", root, "driftpool"))
    _shipped.add(context.applicationId)
