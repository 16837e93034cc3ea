"""Writes as DataFrames: a table and a change give the new table. :func:`replace_table` puts it on disk as a new version
and then moves the pointer, so that a reader never sees half a write and a lost executor costs a retry."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _same(df: DataFrame, other: DataFrame, keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & df[k].eqNullSafe(other[k])
    return cond


def replace(table: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the batch take the place of rows with their keys."""
    return table.join(batch.select(*keys).distinct(), keys, "left_anti").unionByName(batch, allowMissingColumns=True)


def insert_new(table: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Only rows with new keys are added."""
    return table.unionByName(batch.join(table.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def upsert(table: DataFrame, batch: DataFrame, keys: list[str], now: Column, created: str = "created_at", updated: str = "updated_at") -> DataFrame:
    """Merges field by field: a null field of the batch keeps the old value; ``created`` is set on insert only, ``updated`` whenever the batch
    has the key. Keys are unique on both sides."""
    fields = [c for c in table.columns if c not in (*keys, created, updated)]
    old, new = table.withColumn("_old", F.lit(True)).alias("o"), batch.withColumn("_new", F.lit(True)).alias("n")
    both = old.join(new, keys, "full_outer")
    merged = [F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in batch.columns else F.col(f"o.{c}") for c in fields]
    return both.select(*keys, *merged, F.when(F.col("_old"), F.col(f"o.{created}")).otherwise(now).alias(created), F.when(F.col("_new"), now).otherwise(F.col(f"o.{updated}")).alias(updated))


def update(table: DataFrame, changes: DataFrame, key: str, now: Column | None = None, updated: str = "updated_at") -> DataFrame:
    """Sets the non-null fields of the changes on rows that exist; others of the changes are ignored."""
    fields = [c for c in changes.columns if c != key]
    both = table.alias("o").join(changes.withColumn("_hit", F.lit(True)).alias("n"), key, "left")
    out = [F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in fields else F.when(F.col("_hit"), now).otherwise(F.col(f"o.{c}")).alias(c) if c == updated and now is not None else F.col(c if c == key else f"o.{c}") for c in table.columns]
    return both.select(*out)


def delete(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return table.join(keys.select(*on).distinct(), on, "left_anti")


def deleted_and_kept(df: DataFrame, before: Column, strict: bool = False) -> DataFrame:
    """How many rows retention drops and keeps; ``strict`` drops those at the cutoff, too. Rows without a time stay."""
    gone = F.coalesce((F.col("ts") <= before) if strict else (F.col("ts") < before), F.lit(False))
    return df.agg(F.count_if(gone).alias("deleted"), F.count_if(~gone).alias("kept"))


def apply_changes(table: DataFrame, changes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The table after a log of (seq, op, key, fields...) with ops insert, update and delete, and one row of counts. The last change of a key
    decides; an update of a key that is not there does nothing; deletions count the rows they remove."""
    last = changes.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("seq")))).where("_k = 1").drop("_k")
    gone = last.where("op = 'delete'")
    known = last.where("op = 'update'").join(table.select(key), key, "left_semi")
    kept = delete(table, gone, [key])
    fields = [c for c in table.columns if c in changes.columns]
    result = replace(update(kept, known.select(*fields), key), last.where("op = 'insert'").select(*fields), [key])
    counted = changes.agg(F.count_if(F.col("op") == "insert").alias("inserted"), F.count_if(F.col("op") == "update").alias("updated"))
    return result, counted.crossJoin(table.join(gone.select(key), key, "left_semi").agg(F.count("*").alias("deleted")))


def add_messages(messages: DataFrame, new: DataFrame) -> DataFrame:
    """Appends messages behind the last of their thread; those of unknown threads are ignored."""
    last = messages.groupBy("thread_id").agg(F.max("seq").alias("_last"))
    w = Window.partitionBy("thread_id").orderBy("ts", "message_id")
    added = new.join(last, "thread_id").withColumn("seq", F.col("_last") + F.row_number().over(w)).drop("_last")
    return messages.unionByName(added.select(*messages.columns))


def context(messages: DataFrame, n: int = 20) -> DataFrame:
    """The last ``n`` messages of every thread as (thread_id, seq, role, content), system messages apart."""
    from .windows import last_n

    return last_n(messages.where("role <> 'system' and thread_id is not null"), n).select("thread_id", "seq", "role", "content")


def encode_hash(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (id, field, value) as a store of string hashes holds them: structures as JSON, nulls left out."""
    plain = lambda f: F.to_json(f.name) if f.dataType.simpleString().startswith(("array", "map", "struct")) else F.date_format(f.name, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") if f.dataType.simpleString() == "timestamp" else F.col(f.name).cast("string")
    pairs = F.array(*(F.struct(F.lit(f.name).alias("field"), plain(f).alias("value")) for f in df.schema.fields if f.name in columns))
    return df.select("id", F.inline(pairs)).where("value is not null")


def decode_hash(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The typed rows back from :func:`encode_hash`: ``columns`` maps names to Spark types."""
    wide = rows.groupBy("id").agg(*(F.max(F.when(F.col("field") == c, F.col("value"))).alias(c) for c in columns))
    typed = {c: F.from_json(c, t) if t.startswith(("array", "map", "struct")) else F.col(c).cast(t) for c, t in columns.items()}
    return wide.select("id", *(v.alias(c) for c, v in typed.items()))


def replace_table(df: DataFrame, path: str) -> str:
    """Writes a new version below ``path`` and then points to it; returns the version's folder."""
    spark = df.sparkSession
    version = f"{path.rstrip('/')}/v-{uuid.uuid4().hex}"
    df.write.parquet(version)
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}/current")
    return version


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The version that is pointed to."""
    return spark.read.parquet(spark.read.json(f"{path.rstrip('/')}/current").first()["version"])
