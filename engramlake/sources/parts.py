"""Tables in parts, of which a change writes only those that it touches.

Rows lie in folders by part. A numbered manifest says which folder holds each part now, so a change writes
new folders for some parts and then one small file; all other files stay as they are, by the same names.
Only one writer can make a manifest of a number (``files.Conflict``).

``Keyed`` is such a table with one row for each key, kept up by batches of changes: the last entry of a key by its
version wins, in the batch and against what is there, so batches may come late, twice or in any order.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from engramlake.session import stored
from engramlake.sources.files import Folder


@dataclass
class Manifest:
    """Which load holds each part, the schema of the rows, and what else a table keeps beside them."""

    number: int = 0
    parts: dict[int, str] = field(default_factory=dict)
    schema: StructType | None = None
    meta: dict = field(default_factory=dict)


class Parts:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._folder = Folder(spark, f"{self.root}/manifests")

    def manifest(self) -> Manifest:
        names = [n for n in self._folder.names() if n.isdigit()]
        if not names:
            return Manifest()
        said = json.loads(self._folder.read(names[-1]))
        return Manifest(int(names[-1]), {int(k): v for k, v in said["parts"].items()}, StructType.fromJson(said["schema"]), said["meta"])

    def read(self, m: Manifest | None = None, parts: list[int] | None = None) -> DataFrame:
        """The rows, with their ``part``; or those of some parts, of which alone the files are opened."""
        m = m or self.manifest()
        if m.schema is None:
            raise ValueError("the table has no rows yet")
        at = [f"{self.root}/data/load={load}/part={k}" for k, load in m.parts.items() if parts is None or k in parts]
        schema = StructType(list(m.schema.fields)).add("part", IntegerType())
        if not at:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/data").parquet(*at).select(*schema.names)

    def write(self, rows: DataFrame, before: Manifest, touched: list[int] | None = None, meta: dict | None = None) -> Manifest:
        """A new manifest in which ``rows`` (with ``part``) are all that the touched parts hold; all parts, if none are named."""
        load = f"l{uuid.uuid4().hex}"
        rows.hint("rebalance", "part").write.partitionBy("part").parquet(f"{self.root}/data/load={load}")
        made = [int(n.split("=")[1]) for n in Folder(self.spark, f"{self.root}/data/load={load}").names() if n.startswith("part=")]
        kept = {} if touched is None else {k: v for k, v in before.parts.items() if k not in set(touched)}
        fields = [f for f in rows.schema.fields if f.name != "part"]
        m = Manifest(before.number + 1, kept | dict.fromkeys(made, load), StructType(fields), before.meta if meta is None else meta)
        self._folder.claim(f"{m.number:012d}", json.dumps({"parts": m.parts, "schema": m.schema.jsonValue(), "meta": m.meta}))
        return m


class Keyed:
    """One row for each key, below ``root``: the key, a version, whether it is deleted, and further columns."""

    def __init__(self, spark: SparkSession, root: str, key: str = "key", version: str = "version", parts: int = 64):
        self.table, self.key, self.version, self.n = Parts(spark, root), key, version, parts

    def _part(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.n)).cast("int")

    def rows(self, deleted: bool = False) -> DataFrame:
        out = self.table.read().drop("part")
        return out if deleted else out.filter("not deleted").drop("deleted")

    def merge(self, changes: DataFrame, batch: int | None = None) -> list[int]:
        """Takes in changes (key, version, ``deleted`` where it has one, and the rest) and gives the parts that it wrote.

        A change counts if its version is beyond that of its key; of equal versions the first that came stays. ``batch``
        numbers the batches of one stream: a number that was taken in already is a repeat and changes nothing.
        A deleted key keeps its version, so that an older change does not bring it back.
        """
        before = self.table.manifest()
        if batch is not None and batch <= before.meta.get("batch", -1):
            return []
        if "deleted" not in changes.columns:
            changes = changes.withColumn("deleted", F.lit(False))
        rest = [c for c in changes.columns if c != self.key]
        order = F.struct(self.version, F.xxhash64(*rest))  # a tie inside a batch is settled by the content alone
        last = changes.groupBy(self.key).agg(F.max_by(F.struct(*rest), order).alias("_x")).select(self.key, "_x.*")
        last = stored(last.withColumn("part", self._part(F.col(self.key))))
        touched = sorted(r[0] for r in last.select("part").distinct().collect())  # at most as many as the table has parts
        meta = before.meta | ({} if batch is None else {"batch": batch})
        names = [*last.columns]
        if before.schema is None:
            self.table.write(last, before, None, meta)
            return touched
        old = self.table.read(before, touched)
        versions = old.select(self.key, F.col(self.version).alias("_v"))
        newer = stored(last.join(versions, self.key, "left").filter(F.col("_v").isNull() | (F.col(self.version) > F.col("_v"))).drop("_v"))
        changed = sorted(r[0] for r in newer.select("part").distinct().collect())
        if not changed:
            if batch is not None:
                self.table.write(last.limit(0), before, [], meta)
            return []
        left = old.filter(F.col("part").isin(changed)).join(newer.select(self.key), self.key, "left_anti")
        self.table.write(left.unionByName(newer.select(*names), allowMissingColumns=True), before, changed, meta)
        return changed
