"""Tables that are changed in place: Parquet in parts, and a commit file that names the folders of each part.

A change writes only the parts that its keys touch, as a new version beside the old ones, and then puts down one commit file; until then no
reader sees it, and a repeated try overwrites its own folder. Parts that are not touched keep their files. A change can carry the number of its
stream's batch: one that is in already is left out, and a state before a batch can still be read. There is one writer a table.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftnet.operators import mutate as M
from driftnet.operators.search import query_tokens, search_index, tokens

#: Buckets of the search index, and versions of a bucket from which it is merged.
BUCKETS, MOST_VERSIONS = 64, 4
#: Characters of a token that choose its bucket; prefixes as long read one bucket.
HEAD = 2


@dataclass
class Snapshot:
    """version, the versions whose folders make up each part, and the last batch of each stream that is in."""

    version: int = 0
    parts: dict[str, list[int]] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)

    def has(self, batch: tuple[str, int] | None) -> bool:
        return batch is not None and self.batches.get(batch[0], -1) >= batch[1]


class Store:
    """Commits and part folders below root: commits/<version>.json, data/v=<version>/part=<part>."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType | str):
        self.spark, self.root = spark, root.rstrip("/")
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def at(self, path: str):
        """(file system, path) below root."""
        jvm = self.spark._jvm
        found = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")
        return found.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), found

    def names(self, path: str) -> list[str]:
        fs, found = self.at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(found)) if fs.exists(found) else []

    def load(self, name: str) -> Snapshot:
        fs, found = self.at(f"commits/{name}")
        stream = fs.open(found)
        try:
            return Snapshot(**json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def snapshot(self, before: tuple[str, int] | None = None) -> Snapshot:
        """The last state, or the last one that lacks the given batch of a stream."""
        for name in reversed([n for n in self.names("commits") if n.endswith(".json")]):
            held = self.load(name)
            if before is None or not held.has(before):
                return held
        return Snapshot()

    def commit(self, held: Snapshot) -> Snapshot:
        fs, made = self.at(f"commits/{held.version:010d}.tmp")
        _, final = self.at(f"commits/{held.version:010d}.json")
        if fs.exists(final):
            raise RuntimeError(f"version {held.version} of {self.root} was written by another writer")
        stream = fs.create(made, True)
        stream.write(bytearray(json.dumps(held.__dict__).encode()))
        stream.close()
        if not fs.rename(made, final):
            raise RuntimeError(f"version {held.version} of {self.root} could not be committed")
        return held

    def rows(self, held: Snapshot, parts: list[str] | None = None) -> DataFrame:
        """Rows of some parts, or of all, with part and the version v that they stand in."""
        own = held.parts if parts is None else {p: held.parts[p] for p in parts if p in held.parts}
        paths = [f"{self.root}/data/v={v}/part={p}" for p, versions in own.items() for v in versions]
        kinds = T.StructType(self.schema.fields + [T.StructField("v", T.IntegerType()), T.StructField("part", T.StringType())])
        return self.spark.read.schema(kinds).option("basePath", f"{self.root}/data").parquet(*paths) if paths else self.spark.createDataFrame([], kinds)

    def write(self, rows: DataFrame, version: int, sort: list[str]) -> list[str]:
        """Writes rows (with part) as a version; large parts become several files. Gives the parts that have rows."""
        ready = rows.hint("rebalance", F.col("part")).sortWithinPartitions("part", *sort)
        ready.write.mode("overwrite").option("compression", "zstd").partitionBy("part").parquet(f"{self.root}/data/v={version}")
        return [n.removeprefix("part=") for n in self.names(f"data/v={version}") if n.startswith("part=")]

    def staged(self, rows: DataFrame, version: int | str) -> DataFrame:
        """A batch as it is, written down: it is read several times and may not change between."""
        rows.write.mode("overwrite").parquet(f"{self.root}/staging/{version}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.root}/staging/{version}")


class StoredTable(Store):
    """Rows by the first digits of a hexadecimal key; each part lies in one version."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType | str, key: str = "info_hash", digits: int = 2):
        super().__init__(spark, root, schema)
        self.key, self.digits = key, digits

    def part(self) -> Column:
        return F.substring(self.key, 1, self.digits)

    def read(self, held: Snapshot | None = None, parts: list[str] | None = None) -> DataFrame:
        return self.rows(held or self.snapshot(), parts).drop("v", "part")

    def parts_of(self, rows: DataFrame) -> list[str]:
        """The parts that keys fall in; there are at most 16 ** digits."""
        return sorted(r[0] for r in rows.select(self.part()).distinct().collect())

    def change(self, batch: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame], number: tuple[str, int] | None = None) -> Snapshot:
        """Replaces the touched parts by how(their rows, batch)."""
        held = self.snapshot()
        if held.has(number):
            return held
        version = held.version + 1
        batch = self.staged(batch, version)
        touched = self.parts_of(batch)
        new = how(self.read(held, touched), batch).select(*self.schema.names).withColumn("part", self.part())
        full = self.write(new, version, [self.key])
        parts = {p: v for p, v in held.parts.items() if p not in touched} | {p: [version] for p in full}
        return self.commit(Snapshot(version, parts, held.batches | ({number[0]: number[1]} if number else {})))

    def upsert(self, batch: DataFrame, order: list[Column], keep: list[str] = (), number: tuple[str, int] | None = None) -> Snapshot:
        return self.change(batch, lambda old, new: M.upsert(old, new, order, self.key, keep), number)

    def delete(self, keys: DataFrame, number: tuple[str, int] | None = None) -> Snapshot:
        return self.change(keys.select(self.key), lambda old, gone: old.join(gone, self.key, "left_anti"), number)

    def insert_ignore(self, batch: DataFrame, at: str, number: tuple[str, int] | None = None) -> Snapshot:
        return self.change(batch.select(self.key, at), lambda old, new: M.insert_ignore(old, new, at, self.key), number)

    def copy_from(self, rows: DataFrame, order: list[Column], name: str = "copy", chunks: int = 16) -> Snapshot:
        """A migration in `chunks` changes by the key's hash; one that was broken off goes on with the chunk it had reached."""
        held = self.snapshot()
        for k in range(held.batches.get(name, -1) + 1, chunks):
            held = self.upsert(rows.filter(F.pmod(F.crc32(F.col(self.key).cast("binary")), F.lit(chunks)) == k), order, number=(name, k))
        return held


class StoredIndex(Store):
    """Words of names by bucket, sorted; changes are added as versions of the buckets they touch and merged from time to time."""

    def __init__(self, spark: SparkSession, root: str, key: str = "info_hash", column: str = "name", buckets: int = BUCKETS):
        super().__init__(spark, root, f"token string, `{key}` string, live boolean")
        self.key, self.column, self.buckets = key, column, buckets

    def bucket(self, token: Column) -> Column:
        return (F.crc32(F.substring(token, 1, HEAD).cast("binary")) % self.buckets).cast("string")

    def buckets_of(self, words: list[str]) -> list[str] | None:
        """The buckets that hold the words of a query, the last of which is a prefix; None (all) where it is shorter than HEAD."""
        if len(words[-1]) < HEAD:
            return None
        return sorted({str(zlib.crc32(w[:HEAD].encode()) % self.buckets) for w in words})

    def words(self, rows: DataFrame, sign: int) -> DataFrame:
        return rows.select(self.key, F.explode(F.array_distinct(tokens(F.col(self.column)))).alias("token"), F.lit(sign).alias("sign"))

    def apply(self, old: DataFrame, new: DataFrame, number: tuple[str, int] | None = None) -> Snapshot:
        """Adds the difference between the old and the new rows of the keys that changed: words that came and words that went."""
        held = self.snapshot()
        if held.has(number):
            return held
        version = held.version + 1
        both = self.words(old, -1).unionByName(self.words(new, 1)).groupBy("token", self.key).agg(F.sum("sign").alias("sign")).filter("sign != 0")
        full = self.write(both.select("token", self.key, (F.col("sign") > 0).alias("live"), self.bucket(F.col("token")).alias("part")), version, ["token"])
        parts = held.parts | {p: [*held.parts.get(p, []), version] for p in full}
        return self.commit(Snapshot(version, parts, held.batches | ({number[0]: number[1]} if number else {})))

    def follow(self, table: StoredTable, before: Snapshot, after: Snapshot, keys: DataFrame, number: tuple[str, int] | None = None) -> Snapshot:
        """Takes over a change of the table: keys (as many as were changed) between two of its states."""
        touched = table.parts_of(keys)
        own = lambda held: table.read(held, touched).join(keys.select(self.key).distinct(), self.key, "left_semi").select(self.key, self.column)
        return self.apply(own(before), own(after), number)

    def current(self, held: Snapshot, parts: list[str] | None = None, only: Column | None = None) -> DataFrame:
        """token, key: what the last version of each says. only: a condition on token, which is pushed to the scan."""
        own = self.rows(held, parts)
        own = own.filter(only) if only is not None else own
        if all(len(held.parts[p]) == 1 for p in held.parts if parts is None or p in parts):
            return own.filter("live").select("token", self.key)
        return own.groupBy("token", self.key).agg(F.max_by("live", "v").alias("live")).filter("live").select("token", self.key)

    def search(self, query: str, held: Snapshot | None = None) -> DataFrame:
        """Keys that match: every token but the last equals a word, the last begins one. Reads the buckets of the tokens only."""
        words, held = query_tokens(query), held or self.snapshot()
        if not words:
            return self.rows(held, []).select(self.key)
        parts = self.buckets_of(words)
        hit = F.col("token").startswith(words[-1])
        only = F.col("token").isin(words[:-1]) | hit if words[:-1] else hit
        return search_index(self.current(held, parts, only), query, self.key)

    def merge(self, most: int = MOST_VERSIONS) -> Snapshot:
        """Rewrites the buckets that have more than `most` versions as one each."""
        held = self.snapshot()
        due = [p for p, versions in held.parts.items() if len(versions) > most]
        if not due:
            return held
        version = held.version + 1
        rows = self.current(held, due).withColumns({"live": F.lit(True), "part": self.bucket(F.col("token"))})
        full = self.write(rows, version, ["token"])
        parts = {p: v for p, v in held.parts.items() if p not in due} | {p: [version] for p in full}
        return self.commit(Snapshot(version, parts, held.batches))


def schema_of(rows: DataFrame) -> T.StructType:
    """The schema of rows, all columns nullable."""
    return T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields])

