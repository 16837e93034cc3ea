"""Reading tables, staging intermediate results and size-checked broadcasts.

Everything that has to survive the loss of an executor goes through
:func:`stage`, which writes Parquet into the folder that all executors share.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A side is broadcast only if a count has shown that it has at most so many rows.
BROADCAST_ROWS = 200_000
#: ... and that its values have at most so many bytes.
BROADCAST_BYTES = 64 << 20

_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the data folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder for staged tables: below ``spark.checkpoint.dir`` if the session
    names one, else (single machine, as in tests) a temporary folder."""
    sc = spark.sparkContext
    if sc.applicationId not in _dirs:
        base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="sparrowloom-")
        _dirs[sc.applicationId] = f"{base.rstrip('/')}/staged-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _dirs[sc.applicationId])
    return _dirs[sc.applicationId]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may be gone already
        pass


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, and
    what follows can be recomputed from the files whatever executor is lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(StructType.fromJson(df.schema.jsonValue())).parquet(path)


def _width(name: str, kind) -> Column:
    c, simple = F.col(f"`{name}`"), kind.simpleString()
    if simple in ("string", "binary"):
        return F.coalesce(F.octet_length(c), F.lit(0))
    if simple.startswith("array<") and simple[6:-1] in ("float", "double", "int", "bigint"):
        return 8 * F.coalesce(F.size(c), F.lit(0))
    if simple.startswith(("array<", "map<", "struct<")):
        return F.coalesce(F.octet_length(F.to_json(c)), F.lit(0))
    return F.lit(8)


def small_or_none(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame | None:
    """``broadcast(df)`` if it has at most ``rows`` rows of ``size`` bytes together, else
    None. ``df`` should be staged or cheap; what is measured stops as soon as the rows are passed."""
    width = sum((_width(f.name, f.dataType) for f in df.schema.fields), F.lit(0))
    n, held = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and held <= size else None


def join_checked(left: DataFrame, right: DataFrame, on, how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join that broadcasts ``right`` only when its counted size allows, and leaves
    the choice to the shuffle join (with adaptive skew handling) otherwise."""
    small = small_or_none(right, rows)
    return left.join(small if small is not None else right, on, how)


def latest(df: DataFrame, key: str) -> DataFrame:
    """One row per ``key``: copies of a delivery carry the same content, so any of them will do
    and no ordering is needed; the time of arrival, which tells them apart, is dropped. Rows
    with a null key are kept as they are. Filter first: a condition on other columns cannot pass this."""
    rows = df.drop("ingested_at")
    known = rows.where(F.col(key).isNotNull()).dropDuplicates([key])
    return known.unionByName(rows.where(F.col(key).isNull())) if df.schema[key].nullable else known


def once(spark: SparkSession, sf_dir: str, name: str, key: str = "id", where: Column | str | None = None, columns: list[str] | None = None) -> DataFrame:
    """The table with every delivery once; the condition and the columns reach the scan, and only what is left is shuffled."""
    rows = table(spark, sf_dir, name)
    rows = rows if where is None else rows.where(where)
    return latest(rows if columns is None else rows.select(*dict.fromkeys([key, *columns])), key)


def ranked(df: DataFrame, *order, name: str = "rank") -> DataFrame:
    """Adds the number of each row, from 1, in the order of these columns over all rows: a
    range-partitioned sort, and the counts of the partitions added up; no task sees more than
    its own range. Ties have to be told apart by the order itself."""
    sorted_ = stage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = {r["_part"]: r["count"] for r in sorted_.groupBy("_part").count().collect()}  # a row per partition
    before, total = {}, 0
    for part in sorted(sizes):
        before[part], total = total, total + sizes[part]
    offsets = F.create_map(*(F.lit(x) for pair in before.items() for x in pair))[F.col("_part")] if before else F.lit(0)
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return sorted_.withColumn(name, (inner + offsets).cast("bigint")).drop("_part")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor."""
    import os
    import shutil

    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    here = os.path.dirname(os.path.abspath(__file__))
    made = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="sparrowloom-"), "sparrowloom"), "zip", os.path.dirname(here), os.path.basename(here))
    sc.addPyFile(made)
