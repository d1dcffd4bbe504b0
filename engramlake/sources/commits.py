"""A revision log of numbered commits in a folder that all executors share.

A commit is a folder of Parquet files, written first, and then a small file that names it. That file has
the commit's number as its name and only one writer can create it: of two writers that read the same
head one fails with ``Conflict``, and nothing of its commit is ever seen. Readers list the numbers and read
the folders that they name, so they see whole commits only.

Revisions lie in folders by a hash of their user, so a reader of some users opens no more than those. Within
the log, ``log_pos`` orders the revisions of an id: the commit's number, and the order inside the commit.

Edge cases: a commit of no rows is made (it moves the head); null users share one folder; a log without commits
reads as an empty table of a given schema; columns that later commits add are null in earlier ones.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from engramlake.sources.files import Conflict, Folder

#: Folders of users in each commit.
BUCKETS = 64
#: Users up to which their list is sent to the tasks; more of them are joined by a shuffle.
BROADCAST_USERS = 200_000
_SHIFT = 32


@dataclass(frozen=True)
class Commit:
    number: int
    folder: str
    replaces: bool
    schema: StructType


class CommitLog:
    """The log below ``root``. ``user`` and ``key`` are the columns of the owner and of the id."""

    def __init__(self, spark: SparkSession, root: str, user: str = "user_id", key: str = "id", buckets: int = BUCKETS):
        self.spark, self.root, self.user, self.key, self.buckets = spark, root.rstrip("/"), user, key, buckets

    def commits(self, upto: int | None = None) -> list[Commit]:
        """The commits that make the log (or made it at commit ``upto``) in their order: those since the last one that replaced all before."""
        folder = Folder(self.spark, f"{self.root}/commits")
        names = [n for n in folder.names() if n.isdigit()]
        out: list[Commit] = []
        for name in reversed([n for n in names if upto is None or int(n) <= upto]):
            said = json.loads(folder.read(name))
            out.append(Commit(int(name), said["folder"], said["replaces"], StructType.fromJson(said["schema"])))
            if said["replaces"]:  # what came before is in it
                break
        return out[::-1]

    def head(self) -> int:
        """The number of the last commit; 0 before the first."""
        made = self.commits()
        return made[-1].number if made else 0

    def append(self, rows: DataFrame, order: list[str] | None = None, head: int | None = None) -> int:
        """Adds revisions as one commit after ``head`` (the present one by default) and gives its number.

        ``order``: columns that order revisions of one id inside the batch. ``Conflict`` if the head has moved.
        """
        return self._commit(rows, (self.head() if head is None else head) + 1, order, False)

    def _commit(self, rows: DataFrame, number: int, order: list[str] | None, replaces: bool) -> int:
        folder = f"c{uuid.uuid4().hex}"
        if not replaces:
            by = Window.partitionBy(self.key).orderBy(*(order or [self.key]))
            rows = rows.drop("log_pos").withColumn("log_pos", F.lit(number << _SHIFT) + F.row_number().over(by))
        rows.withColumn("_bucket", self.bucket(F.col(self.user))).write.partitionBy("_bucket").parquet("/".join((self.root, "data", f"commit={folder}")))
        said = {"folder": folder, "replaces": replaces, "schema": rows.schema.jsonValue()}
        try:
            Folder(self.spark, f"{self.root}/commits").claim(f"{number:012d}", json.dumps(said))
        except Conflict:
            Folder(self.spark, f"{self.root}/data").remove(f"commit={folder}")
            raise
        return number

    def replace(self, rows: DataFrame, head: int) -> int:
        """A commit after ``head`` that holds all revisions (with their ``log_pos``): what came before is no longer read, but stays for its readers."""
        return self._commit(rows.repartition(self.bucket(F.col(self.user))), head + 1, None, True)

    def compact(self) -> int:
        """Writes all revisions anew, so that reads open few files; ``Conflict`` if somebody commits meanwhile."""
        head = self.head()
        return self.replace(self.revisions(upto=head), head)

    def bucket(self, user: Column) -> Column:
        return F.pmod(F.xxhash64(user.cast("string")), F.lit(self.buckets)).cast("int")

    def revisions(self, upto: int | None = None, users: DataFrame | None = None, schema: StructType | None = None) -> DataFrame:
        """All revisions, or those of commits up to ``upto``, or those of ``users`` (a table of one column).

        Of the files only the users' folders are opened.
        """
        made = self.commits(upto)
        if not made:
            if schema is None:
                raise ValueError("the log has no commit yet; a schema is needed")
            return self.spark.createDataFrame([], schema)
        wide = StructType()
        for c in made:  # columns that a later commit adds are null in the files of earlier ones
            for f in c.schema.fields:
                if f.name not in wide.names:
                    wide.add(f)
        base = "/".join((self.root, "data"))
        out = self.spark.read.schema(StructType(list(wide.fields)).add("_bucket", IntegerType())).option("basePath", base).parquet(*[f"{base}/commit={c.folder}" for c in made])
        if users is None:
            return out.drop("_bucket", "commit")
        asked = users.select(F.col(users.columns[0]).alias(self.user)).distinct()
        touched = [r[0] for r in asked.select(self.bucket(F.col(self.user)).alias("b")).distinct().collect()]  # at most ``buckets`` numbers
        few = asked.count() <= BROADCAST_USERS
        return out.filter(F.col("_bucket").isin(touched)).drop("_bucket", "commit").join(F.broadcast(asked) if few else asked, self.user, "left_semi")

    def current(self, users: DataFrame | None = None, upto: int | None = None, schema: StructType | None = None) -> DataFrame:
        """The last revision of each id."""
        rows = self.revisions(upto, users, schema)
        rest = [c for c in rows.columns if c != self.key]
        return rows.groupBy(self.key).agg(F.max_by(F.struct(*rest), "log_pos").alias("_x")).select(self.key, "_x.*").select(*rows.columns)

    def history(self, record_id, users: DataFrame | None = None) -> DataFrame:
        """All revisions of one id in log order, numbered from 1."""
        w = Window.partitionBy(self.key).orderBy("log_pos")
        return self.revisions(users=users).filter(F.col(self.key) == record_id).withColumn("revision", F.row_number().over(w))

