"""Hybrid search for a table of queries: channels, fusion, successors of what is stale, reranking, and order by structure.

Queries: query_id, user_id, text, and, for the semantic channel, vector. Records (those that may be found): id, user_id,
content, created_at, category, tier, importance, and, where there, speaker, session_date and summary. Chunks: id (of
the record), user_id, chunk_id, start, text and vector. A graph is what ``graph_build.build`` makes. Every step is a
DataFrame keyed by query_id.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramlake.functions import rules, scoring
from engramlake.operators import graph as G
from engramlake.operators import ids, retrieval, vectors
from engramlake.session import stored

#: A reranker: the score of a text for a question, from both as columns.
Scorer = Callable[[Column, Column], Column]

LEAST_SIMILARITY, CHUNKS_PER_PLACE, TEXTS_PER_RECORD = 0.35, 3, 3
#: How far below the best score a record still counts as relevant, and how many of those may be versions of each other.
BAND, VERSION_MEMBERS = 3.0, 10
STEPS = ("graph", "validity", "chain")
#: Words that never tell what two statements are about.
NO_TOPIC = (
    "a an the and or but if of to in on at by for with from as is are was were be been being am do does did done have has had having i me my mine we our you your he him his she her they them their it its this that "
    "these those there here what which who whom whose where when why how whats s t d ll m re ve not no yes so very just about into over after before up down out off again further then once than too can could will "
    "would shall should may might must also only own same such any all both each few more most other some nor now currently current days nowadays moment right latest recent recently lately newest anymore still today "
    "end ended turn turned change update correction switch move originally original initially first previously previous prior used earlier formerly former back ago last year during tell told say said mentioned like "
    "get got go went"
).split()


def document_text(records: DataFrame) -> Column:
    """What a record is found by: speaker and date in lines before the content, a summary that says something else behind it."""
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    parts = [F.when(has(c), F.concat(F.lit(f"{c}: "), F.col(c))) for c in ("speaker", "session_date") if c in records.columns]
    parts.append(F.col("content"))
    if "summary" in records.columns:
        parts.append(F.when(has("summary") & (F.col("summary") != F.col("content")), F.concat(F.lit("Summary: "), F.col("summary"))))
    return F.concat_ws("\n", *parts)


def topics(text: Column) -> Column:
    """The words that tell what a text is about."""
    w = F.filter(rules.tokens(text), lambda x: (F.length(x) > 1) & ~x.rlike("^[0-9]+$"))
    return F.array_except(w, F.array(*map(F.lit, NO_TOPIC)))


def keyword_channel(queries: DataFrame, records: DataFrame, pool: int, now: Column, weights: dict[str, float] = scoring.RANK_WEIGHTS) -> DataFrame:
    """(query_id, id, score, rank): the store's keyword search, ``pool`` records for each query, of its own user."""
    c = F.col
    whole = scoring.rank_score(F.lit(0.0), c("category"), c("tier"), scoring.half_life(c("created_at"), now), c("importance"), weights)
    texts = records.select("id", document_text(records).alias("text"), whole.alias("rest"), F.unix_micros(c("created_at").cast("timestamp")).alias("made"), c("user_id").alias("owner"))
    asked = queries.select("query_id", "text", c("user_id").alias("owner"))
    return retrieval.keyword_ranked(asked, texts, pool, weights["keyword"] / sum(weights.values())).select("query_id", "id", "score", "rank")


def recency_channel(queries: DataFrame, records: DataFrame, pool: int) -> DataFrame:
    """(query_id, id, rank): the newest records of each query's user."""
    w = Window.partitionBy("user_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    newest = records.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= pool).select("user_id", "id", "rank")
    return queries.select("query_id", "user_id").join(newest, "user_id").select("query_id", "id", "rank")


def semantic_channel(queries: DataFrame, chunks: DataFrame, pool: int, least: float = LEAST_SIMILARITY) -> DataFrame:
    """(query_id, id, chunk_id, text, cosine, rank): records by their best chunk, of the best chunks of each query's user."""
    key = F.xxhash64("chunk_id").alias("id")
    asked = queries.select("query_id", "vector", F.col("user_id").alias("owner"))
    hits = vectors.top_k(asked, chunks.select(key, "vector", F.col("user_id").alias("owner")), pool * CHUNKS_PER_PLACE, least).select("query_id", F.col("id").alias("_c"), F.col("score").alias("cosine"))
    found = hits.join(chunks.select(F.xxhash64("chunk_id").alias("_c"), "id", "chunk_id", "text"), "_c").drop("_c")
    best = retrieval.best_chunk(found.withColumn("score", F.col("cosine")), "id").drop("score")
    w = Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "chunk_id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= pool)


def graph_channel(queries: DataFrame, records: DataFrame, graph: tuple[DataFrame, DataFrame, DataFrame], pool: int, valid: Column, known: Column, hops: int = 2, most: int = 100) -> tuple[DataFrame, DataFrame]:
    """((query_id, id, rank), paths): the sources of paths from what a query names, all of whose edges it hints at, behind
    the sources of negative statements about it. Paths: query_id, edges, sources, place."""
    nodes, aliases, edges = graph
    allowed = records.select(F.col("id").alias("source_id"), "user_id")
    held = stored(G.as_of(edges, valid, known).join(allowed, ["source_id", "user_id"], "left_semi"))
    q = queries.select("query_id", "user_id", "text", G.cued(F.col("text")).alias("cues"))
    of_user = aliases.select("user_id", "node_id", "alias", "known_from")
    named = G.mentions(q, of_user, "query_id", "text", known)
    own = q.filter(rules.says(F.col("text"), r"\b(?:my|me|i)\b")).withColumn("_u", F.lit("User"))
    me = G.called(own, of_user, "query_id", "_u", known)
    seeds = named.unionByName(me).select("query_id", "node_id").distinct().join(nodes.select(F.col("id").alias("node_id"), "user_id"), "node_id").join(q.select("query_id", "user_id", "cues"), ["query_id", "user_id"])
    seeds = stored(seeds.select("query_id", F.col("node_id").alias("node"), "cues").distinct())
    walked = G.paths(held, seeds.select(F.col("query_id").alias("group"), "node"), hops, "both", most)  # the first ones of each query, over all its seeds
    mine = q.select("query_id", "cues").join(walked.select(F.col("group").alias("query_id"), "hop", "edges"), "query_id")
    cued = stored(G.by_cues(mine.distinct(), held, F.col("cues")).select("query_id", "edges", "sources", "place"))
    against = held.filter("not positive").select(F.col("source_id").cast("string").alias("source"), "subject", "object", "predicate")
    no = seeds.join(against, (F.col("node") == F.col("subject")) | (F.col("node") == F.col("object")))
    no = no.filter((F.size("cues") == 0) | F.array_contains("cues", F.col("predicate"))).select("query_id", "source", F.lit(0).alias("place"), F.lit(0).alias("i"))
    yes = cued.select("query_id", "place", F.posexplode("sources").alias("i", "source")).select("query_id", "source", "place", "i")
    each = no.unionByName(yes).groupBy("query_id", "source").agg(F.min(F.struct("place", "i")).alias("at"))
    w = Window.partitionBy("query_id").orderBy("at", "source")
    ranked = each.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= pool)
    return ranked.select("query_id", F.col("source").cast(ids.kind(records)).alias("id"), "rank"), cued


def validity(edges: DataFrame, now: Column) -> DataFrame:
    """(user_id, source_id, stale, current, predicates, successors) of each record with edges, as known now.

    A record is stale if all of its edges have ended; its successors hold the edge that followed each of them.
    """
    held = edges.filter(G.during(now, "known_from", "known_to"))
    ended = F.coalesce(F.col("valid_to") <= now, F.lit(False))
    each = held.groupBy("user_id", "source_id").agg(F.bool_and(ended).alias("stale"), F.bool_or((F.col("valid_from") <= now) & ~ended).alias("current"), F.collect_set("predicate").alias("predicates"))
    after = G.successors(held, now).join(held.select(F.col("id").alias("stale_id"), "source_id"), "stale_id").join(held.select(F.col("id").alias("next_id"), F.col("source_id").alias("next")), "next_id")
    after = after.groupBy("source_id").agg(F.array_sort(F.collect_set(F.col("next"))).alias("successors"))
    return each.join(after, "source_id", "left").withColumn("successors", F.coalesce("successors", F.array().cast(after.schema["successors"].dataType)))


def candidate_texts(pool: DataFrame, queries: DataFrame, chunks: DataFrame, dense: DataFrame | None = None) -> DataFrame:
    """(query_id, id, n, text): up to three different texts of each record in a pool: the chunk that was found, then those that share
    most words with the query, earlier ones first."""
    asked = queries.select("query_id", rules.tokens(F.col("text")).alias("q"))
    c = pool.select("query_id", "id").join(chunks.select("id", "start", "text"), "id").join(asked, "query_id")
    c = c.select("query_id", "id", "text", F.lit(1).alias("after"), (-F.size(F.array_intersect("q", rules.tokens(F.col("text"))))).alias("less"), "start")
    if dense is not None:
        found = dense.join(pool.select("query_id", "id"), ["query_id", "id"]).select("query_id", "id", "text", F.lit(0).alias("after"), F.lit(0).alias("less"), F.lit(0).alias("start"))
        c = c.unionByName(found)
    once = c.groupBy("query_id", "id", "text").agg(F.min(F.struct("after", "less", "start")).alias("at"))
    w = Window.partitionBy("query_id", "id").orderBy("at", "text")
    return once.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= TEXTS_PER_RECORD).select("query_id", "id", "n", "text")


def reranked(texts: DataFrame, queries: DataFrame, scorer: Scorer) -> DataFrame:
    """(query_id, id, text, reranker): each record's best text; without a finite score for every text a query has none at all."""
    s = texts.join(queries.select("query_id", F.col("text").alias("_q")), "query_id").withColumn("reranker", scorer(F.col("_q"), F.col("text")).cast("double"))
    fine = F.coalesce(~F.isnan("reranker") & (F.abs("reranker") < float("inf")), F.lit(False))
    s = stored(s.withColumn("_fine", fine).drop("_q"))
    whole = s.groupBy("query_id").agg(F.bool_and("_fine").alias("applied")).filter("applied").select("query_id")
    best = s.join(whole, "query_id").groupBy("query_id", "id").agg(F.max_by(F.struct("text", "reranker"), F.struct("reranker", -F.col("n"))).alias("x"))
    return best.select("query_id", "id", "x.text", "x.reranker")


class _Order:
    """The candidates of one query, by (on a path, score); "B takes A's place" puts B just before A and moves nothing else."""

    def __init__(self, f: pd.DataFrame, steps: tuple[str, ...]):
        self.f = f.sort_values(["reranker", "fusion", "id"], ascending=[False, False, True]).reset_index(drop=True)
        self.steps, self.row = steps, {r.id: r for r in self.f.itertuples()}
        top = self.f["reranker"].max()
        self.relevant = {i for i, r in self.row.items() if r.reranker >= top - BAND}
        on_path = lambda i: "graph" in steps and i in self.relevant and len(self.row[i].partners) > 0
        self.key = {i: (int(on_path(i)), r.reranker) for i, r in self.row.items()}
        self.notes = {i: ["graph_path"] if self.key[i][0] else [] for i in self.row}

    def before(self, winner: int, loser: int, note: str) -> bool:
        place = (self.key[loser][0], self.key[loser][1] + 1e-6)
        if self.key[winner] >= place:
            return False
        self.key[winner] = place
        self.notes[winner].append(f"{note}:{loser}")
        return True

    def by_validity(self) -> None:
        for i in sorted((i for i, r in self.row.items() if r.asked_stale), key=self.key.get, reverse=True):
            if i in self.relevant:
                for s in self.row[i].successors:
                    if s in self.key:
                        self.before(s, i, "supersedes")

    def by_version(self, newest: bool, about: set[str]) -> None:
        members = [i for i in self.f["id"] if i in self.relevant][:VERSION_MEMBERS]
        note = "newer_version_of" if newest else "older_version_of"

        def version(a, b) -> bool:  # whether b is the wanted version of what a says
            same = (a.speaker or None) == (b.speaker or None) and a.created_at != b.created_at and (b.created_at > a.created_at) == newest
            shared = (about - set((a.speaker or "").lower().split())) & set(a.topics) & set(b.topics)
            return bool(same and shared and not (a.current and b.current))

        for _ in members:
            moved = False
            for i in sorted(members, key=self.key.get, reverse=True):
                for j in members:
                    if i != j and self.key[j] <= self.key[i] and version(self.row[i], self.row[j]):
                        moved |= self.before(j, i, note)
            if not moved:
                break

    def chained(self, ranked: list[int]) -> list[int]:
        out: dict[int, None] = {}
        for i in ranked:
            if i in out:
                continue
            out[i] = None
            if i in self.relevant:
                for p in self.row[i].partners:
                    if p in self.row and p not in out:
                        out[p] = None
                        self.notes[p].append(f"chain_partner_of:{i}")
        return list(out)

    def result(self) -> list[tuple]:
        q = self.f.iloc[0]
        if "validity" in self.steps and q["present"] and q["intent"] != "history":
            self.by_validity()
        if "versions" in self.steps and q["present"] and q["intent"] != "neutral":
            self.by_version(q["intent"] == "current", set(q["about"]))
        place = {i: n for n, i in enumerate(self.f["id"])}
        ranked = sorted(place, key=lambda i: (-self.key[i][0], -self.key[i][1], place[i]))
        if "chain" in self.steps:
            ranked = self.chained(ranked)
        return [(q["query_id"], i, n, self.notes[i]) for n, i in enumerate(ranked, 1)]


def structured_order(candidates: DataFrame, steps: tuple[str, ...] = STEPS) -> DataFrame:
    """(query_id, id, rank, notes) of scored candidates, a pool of at most some hundred for each query.

    ``candidates``: query_id, id, reranker, fusion, partners (sources of its cued paths, shortest first), asked_stale,
    successors, current, speaker, created_at, topics, and of the query intent, present and about (its topics).
    """
    schema = f"query_id {ids.kind(candidates, 'query_id')}, id {ids.kind(candidates)}, rank int, notes array<string>"
    return candidates.groupBy("query_id").applyInPandas(lambda f: pd.DataFrame(_Order(f, steps).result(), columns=["query_id", "id", "rank", "notes"]), schema)


def hybrid(
    queries: DataFrame, records: DataFrame, now: Column, limit: int = 5, chunks: DataFrame | None = None, graph: tuple[DataFrame, DataFrame, DataFrame] | None = None, scorer: Scorer | None = None,
    pool: int | None = None, steps: tuple[str, ...] = STEPS, present: bool = True, year: int = 2026,
) -> DataFrame:
    """(query_id, id, rank, text, fusion, reranker, cosine, signals, notes, status): the ``limit`` best records of each query.

    Channels that have no input are left out. ``status`` is applied, disabled (no scorer) or fallback (a score was
    missing or not finite: then the fused order stands, and no successor is added). ``present`` is false for a
    search of an earlier time.
    """
    if not 0 <= limit <= 100:
        raise ValueError("a limit from 0 to 100")
    kind = ids.kind(records)
    size = scoring.pool_size(limit, scorer is not None, pool)
    q = queries.filter(F.coalesce(F.trim("text"), F.lit("")) != "").withColumns({"cues": G.cued(F.col("text")), "intent": rules.time_intent(F.col("text"), year)})
    if chunks is None:
        texts = records.select(F.col("id").cast(kind).alias("id"), document_text(records).alias("text"))
        chunks = retrieval.chunks(texts).join(records.select("id", "user_id"), "id")
    channel = lambda name, df: df.select("query_id", F.lit(name).alias("channel"), "id", "rank")
    dense = stored(semantic_channel(q, chunks, size)) if "vector" in queries.columns and "vector" in chunks.columns else None
    found = [channel("keyword", keyword_channel(q, records, size, now))]
    if dense is not None:
        found.append(channel("semantic", dense))
    cued = None
    if graph is not None:
        ranked, cued = graph_channel(q, records, graph, size, now, now)
        found.append(channel("graph", ranked))
    channels = stored(reduce(DataFrame.unionByName, found))
    depth = min(size, max(20, 4 * limit))
    fused = retrieval.head_and_tail(channels, depth).filter(F.col("rank") <= size).select("query_id", "id", F.col("score").alias("fusion"), F.col("rank").alias("place"))
    signals = channels.groupBy("query_id", "id").agg(F.map_from_entries(F.collect_list(F.struct("channel", "rank"))).alias("signals"))
    fused = stored(fused.join(signals, ["query_id", "id"]))
    if scorer is None:
        first = retrieval_text(fused, q, chunks, dense).join(fused, ["query_id", "id"])
        return _hits(first.withColumns({"rank": F.col("place"), "reranker": F.lit(None).cast("double"), "notes": F.array().cast("array<string>"), "status": F.lit("disabled")}), dense, limit)
    everything = fused
    state = None
    if graph is not None:
        state = stored(validity(graph[2], now).select("user_id", F.col("source_id").cast(kind).alias("id"), "stale", "current", "predicates", F.col("successors").cast(f"array<{kind}>").alias("successors")))
        asked = fused.join(q.select("query_id", "user_id", "cues", "intent"), "query_id").join(state, ["user_id", "id"])
        more = asked.filter(F.lit(present) & (F.col("intent") != "history") & F.col("stale") & F.arrays_overlap("predicates", "cues")).select("query_id", "user_id", F.explode("successors").alias("id"))
        more = more.distinct().join(records.select("id", "user_id"), ["id", "user_id"], "left_semi").join(fused.select("query_id", "id"), ["query_id", "id"], "left_anti")
        everything = fused.unionByName(more.join(signals, ["query_id", "id"], "left").select("query_id", "id", F.lit(0.0).alias("fusion"), F.lit(None).cast("int").alias("place"), "signals"))
    scored = stored(reranked(candidate_texts(everything, q, chunks, dense), q, scorer))
    pool_rows = everything.join(scored, ["query_id", "id"]).join(q.select("query_id", "user_id", "cues", "intent", topics(F.col("text")).alias("about")), "query_id")
    about = records.select("id", "created_at", (F.col("speaker") if "speaker" in records.columns else F.lit(None).cast("string")).alias("speaker"), topics(F.col("content")).alias("topics"))
    pool_rows = pool_rows.join(about, "id")
    none = F.array().cast(f"array<{kind}>")
    if state is not None:
        pool_rows = pool_rows.join(state, ["user_id", "id"], "left")
        pool_rows = pool_rows.withColumn("asked_stale", F.coalesce(F.col("stale") & F.arrays_overlap("predicates", "cues"), F.lit(False)))
        of = cued.select("query_id", F.explode("sources").alias("id"), "sources", F.size("edges").alias("n"), "place").groupBy("query_id", F.col("id").cast(kind).alias("id"))
        partners = of.agg(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", "place", "sources"))), lambda x: x["sources"]))).cast(f"array<{kind}>").alias("partners"))
        pool_rows = pool_rows.join(partners, ["query_id", "id"], "left")
    else:
        pool_rows = pool_rows.withColumns({"asked_stale": F.lit(False), "current": F.lit(False), "successors": none, "partners": none})
    pool_rows = pool_rows.withColumns({"current": F.coalesce("current", F.lit(False)), "successors": F.coalesce("successors", none), "partners": F.coalesce("partners", none), "present": F.lit(present)})
    wanted = pool_rows.select("query_id", "id", "reranker", "fusion", "partners", "asked_stale", "successors", "current", "speaker", "created_at", "topics", "intent", "present", "about")
    ordered = structured_order(wanted, steps if graph is not None else ())
    done = everything.drop("place").join(ordered, ["query_id", "id"]).join(scored, ["query_id", "id"]).withColumn("status", F.lit("applied"))
    missed = fused.join(scored.select("query_id").distinct(), "query_id", "left_anti")
    rest = missed.join(retrieval_text(missed, q, chunks, dense), ["query_id", "id"])
    rest = rest.withColumns({"rank": F.col("place"), "reranker": F.lit(None).cast("double"), "notes": F.array().cast("array<string>"), "status": F.lit("fallback")})
    return _hits(done.unionByName(rest.select(done.columns)), dense, limit)


def retrieval_text(pool: DataFrame, queries: DataFrame, chunks: DataFrame, dense: DataFrame | None) -> DataFrame:
    """(query_id, id, text): the chunk that was found, or else the one that shares most words with the query."""
    return candidate_texts(pool, queries, chunks, dense).filter("n = 1").select("query_id", "id", "text")


def _hits(rows: DataFrame, dense: DataFrame | None, limit: int) -> DataFrame:
    cosine = rows.join(dense.select("query_id", "id", "cosine"), ["query_id", "id"], "left") if dense is not None else rows.withColumn("cosine", F.lit(None).cast("double"))
    return cosine.filter(F.col("rank") <= limit).select("query_id", "id", F.col("rank").cast("int").alias("rank"), "text", "fusion", "reranker", "cosine", "signals", "notes", "status")


def overlap_scorer(question: Column, text: Column) -> Column:
    """A reranker for tests: how many words both share."""
    return F.size(F.array_intersect(rules.tokens(question), rules.tokens(text))).cast("double")
