"""The bitemporal graph of a revision log: what each revision states, which nodes it means, and edge versions.

Revisions: user_id, id, position (of the log), role, category, content, claims, memory_status, created_at,
updated_at, and, where there, recorded_at, last_confirmed_at, decided_at (when a contest was decided),
task_status, due, next_due_at, confidence, evidence_ids, speaker, entities (id, type, label, aliases) and
relations (subject, predicate, object, positive, valid_from, valid_to).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramlake.functions import claims as C
from engramlake.operators.graph import NODE_TYPES
from engramlake.session import stored

#: The edge of a claim's predicate, and the kind of its object. Other predicates keep their name and mean a concept.
EDGES = {
    "residence": ("lives_in", "location"), "employer": ("works_at", "organization"), "manager": ("reports_to", "person"), "headquarters": ("based_in", "location"), "works_on": ("works_on", "project"),
    "member_of": ("member_of", "organization"), "owned_by": ("owned_by", "organization"), "depends_on": ("depends_on", "project"), "knows": ("knows", "person"), "taste": ("likes", "concept"),
    "allergy": ("allergic_to", "concept"), "name": ("named", "literal"), "occupation": ("occupation", "concept"),
}
MOST_ENTITIES, MOST_RELATIONS = 100, 200

_ENTITY = "array<struct<id: string, type: string, label: string, aliases: array<string>>>"
_RELATION = "array<struct<subject: string, predicate: string, object: string, positive: boolean, valid_from: timestamp_ntz, valid_to: timestamp_ntz>>"
_END = "struct<kind: string, key: string, label: string, named: boolean>"
_OPTIONAL = {
    "recorded_at": "timestamp_ntz", "last_confirmed_at": "timestamp_ntz", "decided_at": "timestamp_ntz", "task_status": "string", "due": "timestamp_ntz", "next_due_at": "timestamp_ntz", "confidence": "double",
    "evidence_ids": "array<string>", "speaker": "string", "entities": _ENTITY, "relations": _RELATION,
}


def metadata_problem(entities: Column, relations: Column, created_at: Column) -> Column:
    """Why a record's entities and relations can't be taken in, or null: size, entity, alias, relation or interval."""
    ids = F.transform(entities, lambda e: e["id"])
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    bad_entity = F.exists(entities, lambda e: blank(e["id"]) | blank(e["label"]) | ~F.coalesce(e["type"].isin(*NODE_TYPES), F.lit(False)) | (e["id"] == "self")) | (F.size(F.array_distinct(ids)) < F.size(ids))
    bad_alias = F.exists(entities, lambda e: F.exists(F.coalesce(e["aliases"], F.array().cast("array<string>")), blank))
    known = F.array_append(ids, F.lit("self"))
    bad_relation = F.exists(relations, lambda r: ~F.coalesce(F.array_contains(known, r["subject"]) & F.array_contains(known, r["object"]) & r["predicate"].rlike(r"^[a-z][a-z0-9_]{0,63}\z"), F.lit(False)))
    bad_interval = F.exists(relations, lambda r: F.coalesce(r["valid_to"] <= F.coalesce(r["valid_from"], created_at), F.lit(False)))
    return (
        F.when((F.size(entities) > MOST_ENTITIES) | (F.size(relations) > MOST_RELATIONS), "size").when(bad_entity, "entity").when(bad_alias, "alias").when(bad_relation, "relation").when(bad_interval, "interval")
    )


def node_id(user: Column, kind: Column, key: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\u0001", user, kind, key), 256), 1, 32)


def _end(kind: Column, key: Column, label: Column, named: bool = False) -> Column:
    """An end of an edge; ``named`` means that it may be a node which is known by that name already."""
    return F.struct(kind.alias("kind"), key.alias("key"), label.alias("label"), F.lit(named).alias("named")).cast(_END)


def facts(revisions: DataFrame) -> DataFrame:
    """A row for each fact that a user's revision states: n (its place), subject, predicate, object, positive, start, end."""
    c = F.col
    r = revisions.withColumns({n: (c(n) if n in revisions.columns else F.lit(None)).cast(t) for n, t in _OPTIONAL.items()}).filter("role = 'user'")
    spoken = F.coalesce(c("speaker"), F.lit("")) != ""
    me = _end(F.lit("person"), F.when(spoken, C.value_of(c("speaker"))).otherwise("self"), F.when(spoken, c("speaker")).otherwise("User"))
    r = r.withColumn("_me", me)
    fact = lambda s, p, o, positive, start, end: F.struct(s.alias("subject"), p.alias("predicate"), o.alias("object"), positive.alias("positive"), start.alias("start"), end.alias("end"))
    never = F.lit(None).cast("timestamp_ntz")
    by_id = F.map_from_arrays(F.transform("entities", lambda e: e["id"]), F.transform("entities", lambda e: _end(e["type"], C.value_of(e["id"]), e["label"])))
    at = lambda i: F.when(i == "self", c("_me")).otherwise(F.try_element_at(c("_ids"), i))
    r = r.withColumn("_ids", by_id)
    stated = F.transform("relations", lambda x: fact(at(x["subject"]), x["predicate"], at(x["object"]), F.coalesce(x["positive"], F.lit(True)), F.coalesce(x["valid_from"], c("created_at")), x["valid_to"]))
    names = F.create_map(*[F.lit(x) for k, v in EDGES.items() for x in (k, v[0])])
    kinds = F.create_map(*[F.lit(x) for k, v in EDGES.items() for x in (k, v[1])])
    other = lambda x: F.regexp_replace(x["predicate"], "[^a-z0-9_]", "_")
    subject = lambda x: F.when(x["subject"] == "self", c("_me")).otherwise(_end(F.coalesce(x["subject_type"], F.lit("person")), F.regexp_replace(x["subject"], "^[^:]*:", ""), x["display_subject"], True))
    claimed = F.transform("claims", lambda x: fact(subject(x), F.coalesce(F.try_element_at(names, x["predicate"]), other(x)), _end(F.coalesce(F.try_element_at(kinds, x["predicate"]), F.lit("concept")), x["value"], x["display_value"], True), x["positive"], c("created_at"), never))
    task = _end(F.lit("task"), c("id").cast("string"), c("content"))
    status = F.coalesce(c("task_status"), F.lit("active"))
    due = F.coalesce("next_due_at", "due")
    said = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    of_task = F.array(fact(c("_me"), F.lit("has_task"), task, F.lit(True), c("created_at"), never), fact(task, F.lit("task_status"), _end(F.lit("literal"), status, status, True), F.lit(True), c("updated_at"), never))
    of_task = F.when(due.isNotNull(), F.array_append(of_task, fact(task, F.lit("due_at"), _end(F.lit("literal"), F.lower(said(due)), said(due), True), F.lit(True), c("updated_at"), never))).otherwise(of_task)
    none = F.array().cast("array<struct<subject: {0}, predicate: string, object: {0}, positive: boolean, start: timestamp_ntz, end: timestamp_ntz>>".format(_END))
    every = F.concat(F.coalesce(stated, none), F.coalesce(claimed, none), F.when(c("category") == "task", of_task).otherwise(none))
    rows = r.select("user_id", "id", "position", F.coalesce("recorded_at", "updated_at").alias("known"), "entities", "_me", F.posexplode(every).alias("n", "f"))
    return rows.select("user_id", "id", "position", "known", "entities", "_me", "n", "f.*")


def build(revisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, aliases, edges) of a log.

    Nodes: user_id, id, kind, label; aliases: user_id, alias, node_id, known_from; edges: as ``operators.graph`` has them.
    A name means a node that is known by it, if it is the only one of its kind and was known before; else the
    node of that name itself.
    """
    stated = stated_ends(stored(facts(revisions)))
    ends, named = stated
    resolved = stored(_resolve(ends, named))
    nodes = resolved.groupBy("user_id", F.col("node_id").alias("id")).agg(F.min(F.struct("position", "n", "side", "kind", "label")).alias("x")).select("user_id", "id", "x.kind", "x.label")
    own = resolved.select("user_id", C.value_of(F.col("label")).alias("alias"), "node_id", "known")
    extra = named.select("user_id", "alias", "node_id", "known")
    aliases = own.unionByName(extra).groupBy("user_id", "alias", "node_id").agg(F.min("known").alias("known_from"))
    return nodes, aliases, _edges(revisions, resolved)


def stated_ends(f: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ends of all facts (user_id, id, position, n, side, kind, key, label, named, known and the fact), and the names that
    entities and name claims give to nodes (user_id, kind, alias, node_id, position, n, known)."""
    c = F.col
    side = lambda s: f.select("user_id", "id", "position", "known", "n", F.lit(s).alias("side"), f"{s}.kind", f"{s}.key", f"{s}.label", f"{s}.named", "predicate", "positive", "start", "end")
    ends = side("subject").unionByName(side("object"))
    entity = f.filter("n = 0 and entities is not null").select("user_id", "position", "known", F.explode("entities").alias("e"))
    entity = entity.select("user_id", c("e.type").alias("kind"), node_id(c("user_id"), c("e.type"), C.value_of(c("e.id"))).alias("node_id"), "position", F.lit(-1).alias("n"), "known", F.explode(F.concat(F.array("e.label"), F.coalesce("e.aliases", F.array().cast("array<string>")))).alias("a"))
    given = entity.select("user_id", "kind", C.value_of(c("a")).alias("alias"), "node_id", "position", "n", "known")
    own = ends.filter("not named").select("user_id", "kind", C.value_of(c("label")).alias("alias"), node_id(c("user_id"), c("kind"), c("key")).alias("node_id"), "position", "n", "known")
    told = f.filter("predicate = 'named' and positive").select("user_id", c("subject.kind").alias("kind"), C.value_of(c("object.label")).alias("alias"), node_id(c("user_id"), c("subject.kind"), c("subject.key")).alias("node_id"), "position", "n", "known")
    return ends, stored(given.unionByName(own).unionByName(told))


def _resolve(ends: DataFrame, named: DataFrame) -> DataFrame:
    """``ends`` with node_id. Places of a name are summed up first, so that a frequent name is no group of rows:
    when a first and a second other node got it, and when the node of that name itself was there."""
    c = F.col
    key = ["user_id", "kind", "alias"]
    place = F.struct("position", "n")
    is_own = c("node_id") == node_id(c("user_id"), c("kind"), c("alias"))
    own_given = named.filter(is_own).groupBy(*key).agg(F.min(place).alias("own"))
    each = named.filter(~is_own).groupBy(*key, "node_id").agg(F.min(place).alias("at"))
    foreign = each.groupBy(*key).agg(F.slice(F.array_sort(F.collect_list(F.struct("at", "node_id"))), 1, 2).alias("two"))
    foreign = foreign.select(*key, c("two")[0]["at"].alias("first"), c("two")[0]["node_id"].alias("other"), F.get("two", F.lit(1))["at"].alias("second"))
    asked = ends.withColumn("alias", c("key")).withColumn("place", place)
    by_name = asked.filter("named").join(foreign, key).groupBy(*key).agg(F.min(F.when(c("place") <= c("first"), c("place"))).alias("before"))
    known = foreign.join(own_given, key, "left").join(by_name, key, "left").withColumn("own_from", F.least("own", "before"))
    at = asked.join(known.select(*key, "first", "second", "other", "own_from"), key, "left")
    taken = c("named") & (c("first") < c("place")) & (c("second").isNull() | (c("second") >= c("place"))) & (c("own_from").isNull() | (c("own_from") >= c("place")))
    return at.withColumn("node_id", F.when(F.coalesce(taken, F.lit(False)), c("other")).otherwise(node_id(c("user_id"), c("kind"), c("key")))).drop("alias", "place", "first", "second", "other", "own_from")


def _edges(revisions: DataFrame, ends: DataFrame) -> DataFrame:
    """Edge versions. An episode of a fact opens when its record becomes active, or is active with other facts than before; it
    closes when they change, or when the record is superseded. Each later revision tells all episodes anew, as far as it knows."""
    c = F.col
    s = ends.filter("side = 'subject'").select("user_id", "id", "position", "n", c("node_id").alias("subject"), "predicate", "positive", "start", "end")
    o = ends.filter("side = 'object'").select("user_id", "id", "position", "n", c("node_id").alias("object"))
    whole = s.join(o, ["user_id", "id", "position", "n"])
    material = whole.groupBy("user_id", "id", "position").agg(F.array_sort(F.collect_list(F.struct("n", "subject", "predicate", "object", "positive", "start", "end"))).alias("material"))
    r = revisions.withColumns({n: (c(n) if n in revisions.columns else F.lit(None)).cast(t) for n, t in _OPTIONAL.items()})
    r = r.select("user_id", "id", "position", "memory_status", "updated_at", "last_confirmed_at", "decided_at", "confidence", "evidence_ids", F.coalesce("recorded_at", "updated_at").alias("known_from"))
    r = r.join(material, ["user_id", "id", "position"], "left")
    w = Window.partitionBy("user_id", "id").orderBy("position")
    before, state = F.lag("memory_status").over(w), c("memory_status")
    r = r.withColumns({"_before": before, "_same": c("material").eqNullSafe(F.lag("material").over(w)), "known_to": F.lead("known_from").over(w), "_number": F.row_number().over(w)})
    changed = c("_before").isNotNull() & ~c("_same")
    again = (state == "active") & (c("_before") == "active") & changed
    opens = (state == "active") & ((F.coalesce(c("_before"), F.lit("")) != "active") | changed)
    closing = F.when(again, c("updated_at")).when((state == "superseded") & (c("_before") == "active"), F.coalesce("decided_at", "updated_at"))
    r = r.withColumns({"_opens": opens, "_closing": closing, "_changed": changed})
    later = w.rowsBetween(1, Window.unboundedFollowing)
    close = F.first(F.when(c("_closing").isNotNull(), F.struct("position", "_closing")), ignorenulls=True).over(later)
    r = stored(r.withColumn("_close", close))
    e = r.filter("_opens").select("user_id", "id", c("position").alias("opened"), "_close", "last_confirmed_at", "_changed", "updated_at", F.explode("material").alias("f"))
    start = F.greatest(c("f.start"), F.coalesce("last_confirmed_at", "f.start"), F.when(c("_changed"), c("updated_at")).otherwise(c("f.start")))
    e = e.select("user_id", "id", "opened", c("_close.position").alias("closed"), c("_close._closing").alias("closing"), c("f.n").alias("n"), c("f.subject").alias("subject"), c("f.predicate").alias("predicate"), c("f.object").alias("object"), c("f.positive").alias("positive"), start.alias("valid_from"), c("f.end").alias("end"))
    told = r.filter("memory_status <> 'consolidated'").select("user_id", "id", "position", "known_from", "known_to", "confidence", "evidence_ids")
    at = told.join(e, ["user_id", "id"]).filter("opened <= position")
    at = at.withColumn("valid_to", F.when(c("closed") <= c("position"), F.least("end", "closing")).otherwise(c("end")))
    at = at.filter("valid_to is null or valid_to > valid_from")
    name = F.substring(F.sha2(F.concat_ws("\u0001", c("id").cast("string"), c("position").cast("string"), c("opened").cast("string"), c("n").cast("string")), 256), 1, 32)
    return at.select(
        "user_id", name.alias("id"), "subject", "predicate", "object", "positive", c("id").alias("source_id"), c("position").alias("source_position"), c("opened").alias("asserted_position"), "valid_from", "valid_to",
        "known_from", "known_to", "confidence", F.coalesce("evidence_ids", F.array(c("id").cast("string"))).alias("evidence_ids"),
    )
