"""Refreshes of a relation: rows that come and keys that go, as batches or as a stream of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The column that tells the batches of changes apart.
BATCH = "__batch"


def refreshed(df: DataFrame, key: str, inserts: DataFrame, deletes: DataFrame) -> DataFrame:
    """df without the rows whose key is in deletes (column `key`), and with the rows of inserts."""
    gone = deletes.select(F.col("key").alias("__gone")).distinct()
    return df.join(gone, df[key] == gone["__gone"], "left_anti").unionByName(inserts)


def apply_stream(changes: DataFrame, key: str, path: str, checkpoint: str):
    """Start a stream of changes (the columns of the relation and `deleted`) that `current` puts together.

    Each micro-batch writes its own changes alone, to <path>/__batch=N, and reads nothing
    that came before; a batch that is run again after a failure writes the same
    changes again. Of a batch, deletes apply to what came before it.
    """

    def step(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{BATCH}={n}")

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(changes: DataFrame, key: str, base: DataFrame | None = None, version: str = BATCH) -> DataFrame:
    """The relation after all changes (its columns, `deleted` and the batch number in `version`), from `base`, if given.

    A row stays if no later batch deletes its key: one aggregation of the deleted keys,
    which are few against the rows, and one join. A null key is never deleted. Of a
    path that apply_stream wrote to, changes are spark.read.parquet(path).
    """
    rows = changes.where("not deleted").drop("deleted")
    if base is not None:
        rows = rows.unionByName(base.withColumn(version, F.lit(-1)))
    gone = changes.where("deleted").groupBy(F.col(key).alias("__gone")).agg(F.max(version).alias("__until"))
    out = rows.join(gone, (rows[key] == gone["__gone"]) & (rows[version] < gone["__until"]), "left_anti")
    return out.drop(version)
