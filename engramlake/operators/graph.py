"""The bitemporal graph: labels, aliases, paths, successors and closure, as joins.

Edges: id, subject, predicate, object, positive, source_id, valid_from, valid_to (and known_from,
known_to). Nodes: id, kind, label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramlake.functions import rules
from engramlake.functions.claims import value_of
from engramlake.session import stored
from engramlake.sources.log import CLOSED, during

#: Kinds of nodes, and words of a question with the predicates that they hint at.
NODE_TYPES = ("person", "organization", "project", "location", "task", "concept", "literal")
CUES = (
    ("live|lives|lived|home|residence|city", ("lives_in",)), (r"(?:work|works|worked|employer|company|office|based|headquarter)\w*", ("works_at", "based_in")), (r"report(?:s|ed)? to|manager|supervisor", ("reports_to",)),
    (r"(?:prefer|prefers|preference|like|likes|favorite|favourite)\w*", ("likes",)), (r"(?:allerg|allergy)\w*", ("allergic_to",)), ("occupation|profession|job|role", ("occupation",)), ("task|deadline|due", ("has_task", "task_status", "due_at")),
    ("project|depends|dependency", ("works_on", "depends_on")), ("member|membership|belongs", ("member_of",)), ("owner|owned", ("owned_by",)),
)


def as_of(edges: DataFrame, valid: Column, known: Column) -> DataFrame:
    """Edges that held at ``valid`` by what was known at ``known``; both intervals are half-open."""
    return edges.filter(during(valid, "valid_from", "valid_to") & during(known, "known_from", "known_to"))


def labelled(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the labels of both ends; edges to unknown nodes go."""
    s = nodes.select(F.col("id").alias("subject"), F.col("label").alias("subject_label"))
    o = nodes.select(F.col("id").alias("object"), F.col("label").alias("object_label"))
    return edges.join(s, "subject").join(o, "object")


def called(texts: DataFrame, aliases: DataFrame, id_column: str, text_column: str, known: Column) -> DataFrame:
    """(id, node_id, alias) where a text is an alias, by what was known at ``known``."""
    a = aliases.filter(F.col("known_from") <= known).select("node_id", "alias")
    return texts.select(id_column, value_of(F.col(text_column)).alias("alias")).join(a, "alias").select(id_column, "node_id", "alias")


def mentions(texts: DataFrame, aliases: DataFrame, id_column: str, text_column: str, known: Column | None = None) -> DataFrame:
    """(id, node_id, alias) where an alias occurs in a text as whole words; with ``known``, an alias that was known then (known_from).

    Instead of trying each alias on each text, the texts' words join with one word of each alias, its longest, and
    only texts that hold that word are looked at again for aliases of several words.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w+"), 0)
    if known is not None:
        aliases = aliases.filter(F.col("known_from") <= known)
    w = F.split("phrase", " ")
    longest = F.array_max(F.transform(w, lambda x: F.struct(F.length(x), x.alias("word"))))["word"]
    known = aliases.select("node_id", "alias", F.array_join(words(F.col("alias")), " ").alias("phrase")).filter("phrase <> ''").withColumns({"word": longest, "n": F.size(w)})
    held = texts.select(F.col(id_column), F.explode(F.array_distinct(words(F.col(text_column)))).alias("word"))
    met = stored(held.join(known, "word").select(id_column, "node_id", "alias", "phrase", "n"))
    one = met.filter("n = 1").select(id_column, "node_id", "alias")
    few = met.filter("n > 1").drop("n").distinct().withColumnRenamed(id_column, "_id")
    again = texts.select(id_column, F.col(text_column).alias("_text")).join(few, F.col(id_column).eqNullSafe(F.col("_id")))
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    return one.unionByName(again.filter(F.contains(padded(F.array_join(words(F.col("_text")), " ")), padded(F.col("phrase")))).select(id_column, "node_id", "alias"))


def touching(edges: DataFrame, entity: str | None = None, predicate: str | None = None, negative: bool = True) -> DataFrame:
    """Edges with an entity on either end, of one predicate, and, if asked for, positive ones only."""
    if entity is not None:
        edges = edges.filter((F.col("subject") == entity) | (F.col("object") == entity))
    if predicate is not None:
        edges = edges.filter(F.col("predicate") == predicate)
    return edges if negative else edges.filter("positive")


def cued(query: Column) -> Column:
    """The predicates that a question hints at."""
    met = [F.when(rules.says(query, rf"\b(?:{words})\b"), F.array(*map(F.lit, found))) for words, found in CUES]
    return F.array_distinct(F.flatten(F.array_compact(F.array(*met))))


def paths(edges: DataFrame, seeds: DataFrame, hops: int, direction: str = "outgoing", most: int | None = None) -> DataFrame:
    """All paths without a repeated node from each seed (node) over positive edges, or the first ``most`` of each seed.

    Where seeds have a ``group`` (a query, say), paths carry it, and ``most`` cuts all paths of a group together. One join for each hop, 1 to 4 of them; a path is (seed, node, hop, nodes, edges). ``direction``: outgoing,
    incoming or both. Fewer hops come first, then edges by id, so ``most`` cuts each hop before the next one joins.
    """
    if not 1 <= hops <= 4 or direction not in ("outgoing", "incoming", "both") or not (most is None or 1 <= most <= 1000):
        raise ValueError("from 1 to 4 hops, from 1 to 1000 paths, outgoing, incoming or both")
    out = edges.filter("positive").select("subject", "object", F.col("id").alias("edge"))
    back = out.select(F.col("object").alias("subject"), F.col("subject").alias("object"), "edge")
    step = {"outgoing": out, "incoming": back, "both": out.unionByName(back)}[direction]
    of = ["group"] if "group" in seeds.columns else []
    at = seeds.select(*of, F.col("node").alias("seed"), "node", F.lit(0).alias("hop"), F.array("node").alias("nodes"), F.array().cast("array<string>").alias("edges"))
    found = None
    for hop in range(1, hops + 1):
        at = (
            at.join(step, at.node == step.subject)
            .filter(~F.array_contains("nodes", F.col("object")))
            .select(*of, "seed", F.col("object").alias("node"), F.lit(hop).alias("hop"), F.array_append("nodes", F.col("object")).alias("nodes"), F.array_append("edges", F.col("edge").cast("string")).alias("edges"))
        )
        if most is not None:  # a path beyond the first ones of its hop is beyond them at the end, too
            at = first_paths(at, most, *of)
        found = at if found is None else found.unionByName(at)
    return found if most is None else first_paths(found, most, *of)


def first_paths(found: DataFrame, most: int, of: str = "seed") -> DataFrame:
    """The first ``most`` paths of each seed, or of each ``of``: fewest hops, then edges in order."""
    w = Window.partitionBy(of).orderBy("hop", "edges", "seed")
    return found.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most).drop("n")


def by_cues(found: DataFrame, edges: DataFrame, cues: Column) -> DataFrame:
    """Paths (query_id, edges) all of whose edges have a predicate of ``cues``, with sources (of their edges, each once, in order) and
    place: more edges first, then fewer hops, then sources in order."""
    e = edges.select(F.col("id").cast("string").alias("edge"), "predicate", F.col("source_id").cast("string").alias("source_id"))
    steps = found.select("*", F.posexplode("edges").alias("_i", "edge")).join(e, "edge")
    kept = [c for c in found.columns if c != "edges"]
    each = steps.withColumn("_cued", F.array_contains(cues, F.col("predicate"))).groupBy(*kept, "edges").agg(F.count_if("_cued").alias("n_cued"), F.transform(F.array_sort(F.collect_list(F.struct("_i", "source_id"))), lambda x: x["source_id"]).alias("s"))
    each = each.filter(F.col("n_cued") == F.size("edges")).withColumn("sources", F.array_distinct("s")).drop("s")
    w = Window.partitionBy("query_id").orderBy(F.col("n_cued").desc(), F.size("edges"), "sources", "edges")
    return each.withColumn("place", F.row_number().over(w))


def known_revisions(revisions: DataFrame, edges: DataFrame, valid: Column, known: Column) -> DataFrame:
    """The revisions that made the edges which held at ``valid`` by what was known at ``known``, the last of each record, if it had
    not expired and is no closed task. Other text says nothing about that time, so it is left out."""
    held = as_of(edges, valid, known).select(F.col("source_id").alias("id"), F.col("asserted_position").alias("position")).distinct()
    rows = revisions.join(held, ["id", "position"], "left_semi").filter(F.coalesce("recorded_at", "updated_at") <= known)
    last = rows.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(F.col("position").desc()))).filter("_n = 1").drop("_n")
    fresh = F.col("expires_at").isNull() | (F.col("expires_at") > valid)
    return last.filter(fresh & (F.col("task_status").isNull() | ~F.col("task_status").isin(*CLOSED)))


def stale_sources(edges: DataFrame, now: Column) -> DataFrame:
    """Per source: whether every edge of it has ended."""
    return edges.groupBy("source_id").agg(F.bool_and(F.coalesce(F.col("valid_to") <= now, F.lit(False))).alias("stale"), F.count("*").alias("n_edges"))


def successors(edges: DataFrame, now: Column) -> DataFrame:
    """For each ended edge, the edge that follows: same subject, predicate and polarity, another source,
    begun between then and now, still valid, nearest to the end; ties stay."""
    old = edges.filter(F.col("valid_to") <= now).select(F.col("id").alias("stale_id"), "subject", "predicate", "positive", F.col("source_id").alias("stale_source"), F.col("valid_from").alias("stale_from"), F.col("valid_to").alias("stale_to"))
    new = edges.filter((F.col("valid_from") <= now) & (F.col("valid_to").isNull() | (F.col("valid_to") > now))).select(F.col("id").alias("next_id"), "subject", "predicate", "positive", "source_id", "valid_from")
    pairs = old.join(new, ["subject", "predicate", "positive"]).filter("source_id <> stale_source and valid_from >= stale_from")
    gap = F.abs(F.unix_micros(F.col("valid_from").cast("timestamp")) - F.unix_micros(F.col("stale_to").cast("timestamp")))
    w = Window.partitionBy("stale_id").orderBy("gap")
    return pairs.withColumn("gap", gap).withColumn("_r", F.rank().over(w)).filter("_r = 1").select("stale_id", "next_id", (F.col("gap") / 1e6).cast("bigint").alias("gap_seconds"))


#: Rounds of single steps after which chains are taken by pointers that double.
SHALLOW = 8


def reachable(links: DataFrame, roots: DataFrame) -> DataFrame:
    """Ids reachable from ``roots`` (id) over ``links`` (src, dst), roots included.

    Each round joins the newest ids with the links and stores those not seen before; what was found in
    earlier rounds is read, never written again. If that takes more than ``SHALLOW`` rounds, ids with a single link
    get pointers 1, 2, 4 and so on links ahead, and a round takes whole chains by them: a chain of n ids takes
    about 2 log n joins instead of n.
    """
    links = links.select("src", "dst")  # a link that is there twice is met twice: what it leads to is told apart below
    seen = newest = stored(roots.select("id").distinct())
    jumps: list[DataFrame] | None = None
    rounds = 0
    while not newest.isEmpty():
        if rounds == SHALLOW:
            links = stored(links.distinct())
            jumps = _jumps(links)
        rounds += 1
        if jumps:
            ahead = newest
            for j in reversed(jumps):  # of any distance, as a sum of powers of two
                ahead = stored(ahead.union(ahead.join(j, ahead.id == j.src).select(F.col("dst").alias("id"))).distinct())
            more = stored(ahead.join(seen, "id", "left_anti"))
            seen, newest = seen.union(more), more.union(newest)
        met = newest.join(links, newest.id == links.src).select(F.col("dst").alias("id")).distinct()
        newest = stored(met.join(seen, "id", "left_anti"))
        seen = seen.union(newest)
    return seen


def _jumps(links: DataFrame) -> list[DataFrame]:
    """(src, dst) tables of where ids with a single link are 1, 2, 4 and so on links ahead, as long as all of these are such ids."""
    at = stored(links.groupBy("src").agg(F.min("dst").alias("dst"), F.count("*").alias("n")).filter("n = 1").select("src", "dst"))
    n, out = at.count(), [at]
    while 2 ** len(out) <= n:  # no chain is longer, and cycles end here too
        a, b = out[-1].alias("a"), out[-1].alias("b")
        at = stored(a.join(b, F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst"))
        if at.isEmpty():
            break
        out.append(at)
    return out
