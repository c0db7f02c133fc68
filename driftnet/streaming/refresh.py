"""A dimension that is exchanged while a stream runs: whole versions behind one pointer, which every micro-batch reads anew.

A new version is written beside the old one and seen only once its commit file is there, so a refresh that breaks off changes nothing. A
micro-batch uses one version throughout and writes a folder of its own; if it is repeated, the folder is replaced as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftnet.operators.stored import Snapshot, Store

#: Seconds between two refreshes, and the name under which the time of the last is kept.
EVERY, LOADED = 24 * 3600, "loaded"


class Dimension(Store):
    """A look-up table by key, in parts by the key's hash; each version is complete."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType | str, key: str, parts: int = 16):
        super().__init__(spark, root, schema)
        self.key, self.parts = key, parts

    def read(self, held: Snapshot | None = None) -> DataFrame:
        return self.rows(held or self.snapshot()).drop("v", "part")

    def replace(self, rows: DataFrame, now: int) -> Snapshot:
        """A new version that holds just these rows. If writing fails, readers keep the one before."""
        version = self.snapshot().version + 1
        part = F.pmod(F.crc32(F.col(self.key).cast("string").cast("binary")), F.lit(self.parts)).cast("string")
        full = self.write(rows.select(*self.schema.names).withColumn("part", F.coalesce(part, F.lit("0"))), version, [self.key])
        return self.commit(Snapshot(version, {p: [version] for p in full}, {LOADED: now}))

    def refresh(self, load, now: int, every: int = EVERY) -> bool:
        """Takes what load() gives as a new version, unless the last is younger than `every` seconds. Gives whether it did."""
        held = self.snapshot()
        if held.version and now - held.batches.get(LOADED, 0) < every:
            return False
        self.replace(load(), now)
        return True


def lookup_stream(arrivals: DataFrame, dimension: Dimension, on: str, out: str, checkpoint: str, refresh=None) -> None:
    """Arrivals with the columns of the dimension (null where its key is not there) and the version that they met, below out.

    refresh(k) is called before micro-batch k and may exchange the dimension. Arrivals with a null key meet nothing.
    """

    def each(batch: DataFrame, k: int) -> None:
        if refresh is not None:
            refresh(k)
        held = dimension.snapshot()
        met = batch.join(dimension.read(held), on, "left").withColumn("version", F.lit(held.version))
        met.write.mode("overwrite").parquet(f"{out}/batch={k}")

    arrivals.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
