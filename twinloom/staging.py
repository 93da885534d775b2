"""Intermediate tables in the shared folder, and joins against small tables of checked size."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from twinloom.functions.names import ref

# A table is broadcast only when its row count times its stated row width fits in this.
BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 64


def checkpoint_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one the cluster names in ``spark.checkpoint.dir``."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    return _local_folder().name


@lru_cache(1)
def _local_folder() -> tempfile.TemporaryDirectory:
    """Stands in for the shared folder on a local master only; removed when the process ends."""
    return tempfile.TemporaryDirectory(prefix="twinloom-")


def tasks(spark: SparkSession) -> int:
    """Partitions for work that is heavy per row: the session's shuffle setting.

    Such steps name the number, because adaptive execution merges partitions by their
    bytes and would leave a small but costly input to one task.
    """
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# rows of each staged table of this session, by folder, and the folders' paths
_STAGED_ROWS: dict[str, int] = {}
_STAGED_PATHS: list[str] = []


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once and read it back: fixes its content and cuts the lineage.

    Used for tables with one row per feature (or smaller), whose later size check and
    repeated use must not recompute them, and for inputs that are scanned several times.
    The row count is taken along while writing.
    """
    spark = df.sparkSession
    path = new_folder(spark, "stage")
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    _STAGED_ROWS[path.split("/")[-1]] = seen.get["rows"]
    return spark.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession, kind: str) -> str:
    """A folder of its own among the intermediate tables, deleted with them by ``drop_staged``."""
    path = f"{checkpoint_root(spark)}/{kind}-{uuid.uuid4().hex}"
    _STAGED_PATHS.append(path)
    return path


def drop_staged(spark: SparkSession) -> None:
    """Delete all tables and folders staged so far, once nothing that reads them is needed any more."""
    jvm = spark.sparkContext._jvm
    for path in _STAGED_PATHS:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    _STAGED_PATHS.clear()
    _STAGED_ROWS.clear()


def at_most(small: DataFrame) -> int:
    """Upper bound of the rows of a selection from one staged table; counted for any other."""
    folders = {f.rsplit("/", 2)[-2] for f in small.inputFiles()}
    if len(folders) == 1 and folders <= _STAGED_ROWS.keys():
        return _STAGED_ROWS[folders.pop()]
    return small.count()


def attach(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    row_bytes: int = 512,
    how: str = "inner",
    limit: int | None = None,
) -> DataFrame:
    """Equi-join ``big`` with a staged per-feature table or a column and row selection of it.

    Its row count is checked first. Up to ``limit`` bytes it is broadcast; beyond that
    both sides are salted, so one hot key is spread over ``SALTS`` tasks.
    """
    limit = BROADCAST_BYTES if limit is None else limit
    if at_most(small) * row_bytes <= limit:
        return big.join(F.broadcast(small), on, how)
    salted = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = big.withColumn(
        "__salt", F.pmod(F.xxhash64(*[ref(c) for c in big.columns]), F.lit(SALTS)).cast("int")
    )
    return spread.join(salted, [*on, "__salt"], how).drop("__salt")
