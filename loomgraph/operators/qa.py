"""Blurred names, path contexts, QA records and their validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.ids import hash_fraction, hash_order
from loomgraph.functions.text import strip

#: Order of the sections of a context.
SECTIONS = ["Document", "Chunk", "Assertion", "Entity", "Image", "Table", "Formula"]
REQUIRED = ["q", "a", "cot", "task_type", "evidence"]
#: Templates by class of entity type; our own wording.
BLUR = {
    "person": (["person", "researcher", "scientist", "author"], ["a certain researcher", "a scholar in the field", "one of the authors"]),
    "organization": (["organization", "company", "institution"], ["a certain organisation", "an institution in the field", "one of the companies"]),
    "location": (["location", "place", "city", "country"], ["a certain place", "a region in question", "one of the locations"]),
    "number": (["number", "count", "amount", "quantity"], ["a certain quantity", "some number", "an amount in question"]),
}


def _category(entity_type: str) -> Column:
    out = F.when(F.lit(False), "")
    for name, (types, _) in BLUR.items():
        out = out.when(F.col(entity_type).isin(types), name)
    return out


def blur(nodes: DataFrame, seed: str, probability: float = 0.5, entity_type: str = "entity_type") -> DataFrame:
    """Adds is_blurry (by seeded chance) and, for entities, blurry_name; other types keep their names."""
    chosen = hash_fraction(seed, "id") < probability
    pick = F.pmod(F.conv(F.substring(hash_order(seed + "/template", "id"), 1, 6), 16, 10).cast("long"), F.lit(3)).cast("int")
    name = F.when(F.lit(False), "")
    for kind, (_, templates) in BLUR.items():
        name = name.when(_category(entity_type) == kind, F.element_at(F.array(*map(F.lit, templates)), pick + 1))
    name = name.otherwise(F.concat(F.lit("a certain "), F.coalesce(entity_type, F.lit("thing"))))
    blurred = F.when(chosen & (F.col("type") == "Entity"), name)
    return nodes.withColumns({"is_blurry": chosen, "blurry_name": blurred})


def _node_text(n: Column) -> Column:
    or_ = lambda c, d: F.coalesce(n[c], F.lit(d))
    line = lambda *p: F.concat(*p)
    body = {
        "Document": [line(F.lit("document: "), or_("name", "")), line(F.lit("content: "), or_("content", "none"))],
        "Chunk": [line(F.lit("chunk: "), or_("name", "")), line(F.lit("content: "), or_("content", "none"))],
        "Assertion": [line(F.lit("assertion: "), or_("name", "")), line(F.lit("triple: "), or_("head", ""), F.lit("->"), or_("relation", ""), F.lit("->"), or_("tail", ""))],
        "Image": [line(F.lit("image: "), or_("name", "")), line(F.lit("class: "), or_("class", "unknown")), line(F.lit("description: "), or_("desc", "none")), line(F.lit("content: "), or_("content", ""))],
        "Table": [line(F.lit("table: "), or_("name", "")), line(F.lit("content: "), or_("content", "none")), line(F.lit("description: "), or_("desc", "none"))],
        "Formula": [line(F.lit("formula: "), or_("name", "")), line(F.lit("content: "), or_("content", "")), line(F.lit("description: "), or_("desc", "none")), line(F.lit("context: "), or_("context", "none"))],
    }
    out = F.when(n["type"] == "Entity", F.concat(n["number"].cast("string"), F.lit(". "), F.coalesce(n["blurry_name"], n["name"], F.lit("")), F.when(F.length(n["desc"]) > 0, F.concat(F.lit("\ndescription: "), n["desc"])).otherwise("")))
    for kind, lines in body.items():
        out = out.when(n["type"] == kind, F.concat_ws("\n", *lines))
    return out


CONTEXT_FIELDS = ["name", "content", "head", "relation", "tail", "class", "desc", "context", "blurry_name"]


def path_contexts(path_nodes: DataFrame, path_relations: DataFrame, need: list[str] | None = None) -> DataFrame:
    """(path_id, context, need_info): the text that a question is written from.

    path_nodes: path_id, pos, type and CONTEXT_FIELDS; path_relations: path_id, pos, head,
    relation, tail, desc (names). Sections come in a fixed order, entities are numbered in
    path order, the answer is the first node. need_info holds the sections of the types in need.
    """
    node = F.struct("pos", "type", *(F.col(c).alias(c) if c in path_nodes.columns else F.lit(None).cast("string").alias(c) for c in CONTEXT_FIELDS))
    rows = path_nodes.groupBy("path_id").agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    rel = F.concat(F.lit("("), "head", F.lit(", "), "relation", F.lit(", "), "tail", F.lit("): "), F.coalesce("desc", F.lit("")))
    rels = path_relations.groupBy("path_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", rel.alias("t")))), lambda r: r["t"]), "\n").alias("rels"))
    entities = F.filter("nodes", lambda n: n["type"] == "Entity")
    numbered = F.transform(
        F.col("nodes"),
        lambda n, i: n.withField("number", F.size(F.filter(F.slice("nodes", 1, i + 1), lambda m: m["type"] == "Entity"))),
    )

    def section(kind: str) -> Column:
        own = F.filter("numbered", lambda n: n["type"] == kind)
        body = F.array_join(F.transform(own, _node_text), "\n")
        return F.when(F.size(own) > 0, F.concat(F.lit(f"## {kind}\n"), body))

    found = rows.join(rels, "path_id", "left").withColumn("numbered", numbered)
    head = F.concat(F.lit("## Path\nentities: "), F.array_join(F.transform(entities, lambda n: n["name"]), " -> "), F.lit("\nrelations: "), F.coalesce("rels", F.lit("")))
    answer = F.concat(F.lit("## Answer\n"), F.coalesce(F.element_at("nodes", 1)["name"], F.lit("unknown")))
    needed = F.concat_ws("\n", *(section(k) for k in SECTIONS if k in (need or [])))
    return found.select("path_id", F.concat_ws("\n", head, *(section(k) for k in SECTIONS), answer).alias("context"), needed.alias("need_info"))


def qa_records(parsed: DataFrame, path_nodes: DataFrame, path_relations: DataFrame) -> DataFrame:
    """Parsed answers with their evidence: key = path_id. Unparsed responses give records that validation rejects."""
    pick = lambda c: F.col(c) if c in path_nodes.columns else F.lit(None).cast("string")
    node = F.struct("pos", "id", F.coalesce("name", F.lit("")).alias("name"), "type", *(F.coalesce(pick(c), F.lit("")).alias(c) for c in ("img_path", "content", "desc")))
    nodes = path_nodes.groupBy("path_id").agg(F.array_sort(F.collect_list(node)).alias("ns"))
    rels = path_relations.groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct("pos", "head", "relation", "tail", "desc"))).alias("rs"))
    j = parsed.withColumnRenamed("key", "path_id").join(nodes, "path_id", "left").join(rels, "path_id", "left")
    evidence = F.struct(
        F.transform("ns", lambda n: F.struct(n["name"].alias("name"), n["type"].alias("type"), n["img_path"].alias("img_path"), n["content"].alias("content"), n["desc"].alias("desc"))).alias("nodes"),
        F.transform("rs", lambda r: F.struct(r["head"].alias("head"), r["relation"].alias("relation"), r["tail"].alias("tail"), r["desc"].alias("desc"))).alias("relations"),
    )
    present = F.when(F.col("ok"), F.array(*map(F.lit, REQUIRED))).otherwise(F.array(F.lit("task_type")))
    return j.select(
        "path_id", F.col("question").alias("q"), F.col("answer").alias("a"), "cot", *(["task_type"] if "task_type" in j.columns else [F.lit("").alias("task_type")]),
        F.array_distinct(F.transform("ns", lambda n: n["type"])).alias("node_types"), F.transform("ns", lambda n: n["id"]).alias("node_ids"),
        F.transform("ns", lambda n: n["name"]).alias("node_name"), evidence.alias("evidence"), present.alias("present"),
    )


def validate(records: DataFrame, present: str = "present") -> DataFrame:
    """Adds is_valid, error and error_type: a required key is absent (null values are fine)."""
    lacking = F.array_except(F.array(*map(F.lit, REQUIRED)), present)
    return records.withColumns({
        "is_valid": F.size(lacking) == 0, "error": F.when(F.size(lacking) > 0, F.concat(F.lit("missing fields: "), F.array_join(lacking, ", "))),
        "error_type": F.when(F.size(lacking) > 0, "MISSING_FIELD"),
    })


def num_hops(ids: str = "node_ids") -> Column:
    """Entities on the path less one; not below 0, 0 for no list."""
    return F.coalesce(F.greatest(F.size(F.filter(ids, lambda x: F.startswith(strip(x), F.lit("ent-")))) - 1, F.lit(0)), F.lit(0)).cast("long")
