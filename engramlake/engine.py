"""One object with the verbs of the library: messages in, and lists, searches, answers, graphs and cleanups out, as DataFrames."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engramlake.functions import answers, rules, scoring
from engramlake.operators import graph, graph_build, ingest, reconcile, retention, retrieval, search, task_updates
from engramlake.session import shared_folder, stored
from engramlake.sources import log
from engramlake.sources.commits import CommitLog

_DECIDED = ("memory_status", "superseded_by", "consolidated_into", "reason", "conflict_ids", "evidence_ids", "evidence_session_ids", "first_observed_at", "last_observed_at", "summary")
VIEWS = ("revisions", "current", "visible", "nodes", "aliases", "edges", "chunks")


@dataclass
class Engine:
    """The verbs over a log of revisions below ``root``. ``now`` is given with each call: nothing here reads a clock.

    ``scorer`` reranks (a column of the question and the text); ``embed`` adds ``vector`` to a DataFrame with ``text``.
    Two engines may share a root: of two that take messages in at once, one gets ``commits.Conflict`` and can try again.
    """

    spark: SparkSession
    scorer: search.Scorer | None = None
    embed: object = None
    limit: int = 5
    root: str | None = None
    _graph: tuple | None = field(default=None, repr=False)
    _chunks: DataFrame | None = field(default=None, repr=False)

    def __post_init__(self):
        self.root = self.root or f"{shared_folder(self.spark)}/log-{uuid.uuid4().hex}"
        self.commits = CommitLog(self.spark, self.root)

    @property
    def log(self) -> DataFrame:
        """The last revision of each record."""
        return self.commits.current()

    def process(self, messages: DataFrame, now: Column) -> DataFrame:
        """Records of messages, a record for each clause, without keeping them."""
        return ingest.process_clauses(messages, now)

    def ingest(self, messages: DataFrame, now: Column) -> DataFrame:
        """Takes messages in, a record for each clause: what is the same and what contradicts, what happens to tasks. Gives the revisions that it adds.

        Only the records of users in ``messages`` are read and decided (of all others no more than ids and
        owners), and only what changed gets a revision, all in one commit. Records that have a problem are
        left out, as is an id that another user has; a message that comes again changes nothing.
        """
        head = self.commits.head()
        fresh = stored(ingest.process_clauses(messages, now))
        told = F.struct("task_status", "due", "next_due_at", "tier")
        if head:
            owners = self.commits.revisions(head).select("id", F.col("user_id").alias("_owner")).join(fresh.select("id").distinct(), "id", "left_semi").distinct()
            fresh = stored(fresh.join(owners, "id", "left").filter("_owner is null or _owner = user_id").drop("_owner"))
        users = stored(fresh.filter("problem is null").select("user_id").distinct())
        kept = stored(self.commits.current(users, head)) if head else None
        fresh = ingest.once_each(fresh, kept.select("id", "user_id", "content") if head else None).filter("problem is null").withColumn("stated", told)
        every = fresh
        if head:  # a task is folded from what was first said of it, so nothing is done to it twice
            before = kept.withColumns({c: F.col(f"stated.{c}") for c in ("task_status", "due", "next_due_at", "tier")})
            every = fresh.unionByName(before.select(*[c for c in fresh.columns if c in before.columns]), allowMissingColumns=True)
        new = self._decided(stored(every)).withColumns({"updated_at": now, "recorded_at": now})
        if head:
            own = [c for c in new.columns if c not in ("updated_at", "recorded_at")]
            state = F.to_json(F.struct(*sorted(own)))
            was = kept.select("id", F.to_json(F.struct(*[F.col(c) if c in kept.columns else F.lit(None).cast(new.schema[c].dataType).alias(c) for c in sorted(own)])).alias("_was"))
            new = new.join(was, "id", "left").filter(F.col("_was").isNull() | (F.col("_was") != state)).drop("_was")
        number = self.commits.append(stored(new), head=head)
        self._graph = self._chunks = None
        return self.commits.revisions(number).filter(F.shiftright("log_pos", 32) == number)

    def _decided(self, every: DataFrame) -> DataFrame:
        """The states of all records of some users."""
        c = F.col
        states = stored(reconcile.reconciled(every))
        support = reconcile.evidence(every, states).drop("user_id")
        state = states.select("id", c("status").alias("memory_status"), "superseded_by", "consolidated_into", "reason", "conflict_ids")
        changed = task_updates.current(every, stored(task_updates.revised(every)))
        new = every.drop(*_DECIDED).join(state, "id").join(support, "id", "left")
        tasks = changed.select("id", c("task_status").alias("_status"), c("due_at").alias("_due"), c("next_due_at").alias("_next"))
        new = new.join(tasks, "id", "left").withColumns({"task_status": F.coalesce("_status", "task_status"), "due": F.coalesce("_due", "due"), "next_due_at": F.when(c("_status").isNotNull(), c("_next")).otherwise(c("next_due_at"))}).drop("_status", "_due", "_next")
        closed = F.coalesce(c("task_status").isin(*log.CLOSED), F.lit(False))
        recurs = F.coalesce((c("category") == "task") & c("recurrence").isNotNull(), F.lit(False))
        seen = F.coalesce("last_observed_at", "created_at")  # a repeated statement lasts from when it was last made
        own = (c("role") == "user") & rules.self_disclosure(c("content"))
        new = new.withColumn("tier", F.when(closed, "archive").otherwise(c("tier")))
        return new.withColumn("expires_at", scoring.expiry(c("category"), c("tier"), closed, recurs, c("due"), seen, own))

    def revisions(self) -> DataFrame:
        """All revisions in the log."""
        return self.commits.revisions()

    def history(self, record_id) -> DataFrame:
        """The revisions of one record, the first one first."""
        return self.commits.history(record_id)

    def forget(self, user: str) -> int:
        """A commit without any revision of a user."""
        head = self.commits.head()
        self._graph = self._chunks = None
        return self.commits.replace(self.commits.revisions(head).filter(~F.col("user_id").eqNullSafe(user)), head)

    def list(self, now: Column, **asked) -> DataFrame:
        return log.listed(self._records(), now, **asked)

    def search(self, text: str, now: Column, **asked) -> DataFrame:
        return log.searched(self._records(), text, now, **asked)

    def get(self, record_id) -> DataFrame:
        return self.log.filter(F.col("id") == record_id)

    def stats(self) -> DataFrame:
        return log.statistics(self.log, "category", log.CATEGORIES)

    def resolve(self, record_id, now: Column) -> DataFrame:
        """The revisions that choosing a statement by hand makes."""
        return reconcile.selected(self._records().withColumn("updated_at", F.coalesce("last_observed_at", "created_at")), F.col("id") == record_id, now)

    def reconcile(self) -> DataFrame:
        """The state of all records, decided anew; the same log gives the same states."""
        return reconcile.reconciled(self.log)

    def index(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Nodes, aliases and edges of all revisions, and chunks of the records; made once for each state of the log."""
        if self._graph is None:
            rows = self._with_scores(self.revisions()).withColumns({"position": F.col("log_pos"), "updated_at": F.coalesce("last_observed_at", "created_at")})
            self._graph = tuple(stored(t) for t in graph_build.build(rows))
            cut = retrieval.chunks(self.log.select("id", F.col("content").alias("text"))).join(self.log.select("id", "user_id"), "id")
            self._chunks = stored(self.embed(cut) if self.embed else cut)
        return self._graph

    def graph(self, now: Column, entity: str | None = None, predicate: str | None = None) -> DataFrame:
        """Edges that hold now, by what is known now, with the labels of both ends."""
        nodes, _, edges = self.index()
        return graph.labelled(graph.touching(graph.as_of(edges, now, now), entity, predicate), nodes)

    def ask(self, questions: DataFrame, now: Column, least: float | None = None) -> tuple[DataFrame, DataFrame]:
        """(statements, hits) of questions (query_id, user_id, text): one statement for each source; none where ``least`` is given and an answer should be held back."""
        if self.embed:
            questions = self.embed(questions)
        visible = self._records().filter(log.is_visible(now))
        graph_tables = self.index()
        hits = stored(search.hybrid(questions, visible, now, self.limit, self._chunks, graph_tables, self.scorer))
        sources = hits.select("query_id", F.col("id").alias("source_id"), "text", F.col("reranker").alias("score"))
        held = answers.abstentions(questions.select("query_id", "text"), sources, least) if least is not None else None
        return answers.extracted(sources, held), hits

    def cleanup(self, user: str, now: Column, apply: bool = False, **options) -> dict:
        """What a cleanup of a user does to the revisions of the log; ``apply`` commits it."""
        head = self.commits.head()
        out = retention.cleanup(self._with_scores(self.commits.revisions(head)).withColumn("position", F.col("log_pos")), user, now, apply=apply, **options)
        if apply:
            names = self.commits.revisions(head).columns
            self.commits.replace(out["log"].select(*[c for c in names if c in out["log"].columns]), head)
            self._graph = self._chunks = None
        return out

    def views(self, now: Column) -> list[str]:
        """Registers the log and what is derived from it for Spark SQL."""
        nodes, aliases, edges = self.index()
        tables = {"revisions": self.revisions(), "current": self._records(), "visible": self._records().filter(log.is_visible(now)), "nodes": nodes, "aliases": aliases, "edges": edges, "chunks": self._chunks}
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
        return list(tables)

    def _records(self) -> DataFrame:
        return self._with_scores(self.log)

    @staticmethod
    def _with_scores(rows: DataFrame) -> DataFrame:
        none = F.lit(None).cast("timestamp_ntz")
        rows = rows.withColumns({"importance_score": F.col("importance"), "last_accessed_at": none})
        return rows.withColumn("last_observed_at", F.coalesce("last_observed_at", "created_at"))
