"""Entity resolution: last-wins, merges by id and by similarity class, dictionary rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.ids import node_id


def last_wins(nodes: DataFrame, keys: list[str], order: Column | str = "seq") -> DataFrame:
    """Of rows with one key the last; an aggregate with map-side combine instead of a sort.

    Rows that tie are ordered by their other columns, maps left out.
    """
    rest = [c for c in nodes.columns if c not in keys]
    if rest == [order] and dict(nodes.dtypes)[order] in ("int", "bigint"):
        return nodes.groupBy(*keys).agg(F.max(order).alias(order))  # by hash; a struct would be sorted twice
    ordered = [c for c in rest if not dict(nodes.dtypes)[c].startswith("map")]
    picked = nodes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, *ordered)).alias("r"))
    return picked.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def merge_attributes(nodes: DataFrame, key: str = "id", attr: str = "attr") -> DataFrame:
    """Per id a map attribute -> distinct values, sorted; empty values drop."""
    pairs = nodes.select(key, F.explode(attr).alias("k", "vs")).select(key, "k", F.explode("vs").alias("v")).where("v is not null and v <> ''")
    per = pairs.groupBy(key, "k").agg(F.array_sort(F.collect_set("v")).alias("vs"))
    return per.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "vs")))).alias(attr))


def merge_entities_by_id(entities: DataFrame) -> DataFrame:
    """One row an id: base values from the first row not from a modality, aliases and sources gathered.

    In: id, name, alias (array, may be null), desc, src_id, from_modal, seq.
    """
    base = F.min_by(F.struct("name", "desc"), F.struct(F.coalesce("from_modal", F.lit(False)), F.col("seq")))
    names = F.coalesce("alias", F.array("name"))
    return entities.groupBy("id").agg(
        base["name"].alias("name"), base["desc"].alias("desc"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(names)))).alias("alias"),
        F.array_sort(F.collect_set("src_id")).alias("src_id_list"),
    )


def merge_by_standard_name(entities: DataFrame, alias_map: DataFrame, components: DataFrame) -> DataFrame:
    """Similarity merge: members of a class take the standard name their alias maps to.

    components: (name, component, size). Members of a class of several that no alias names
    are dropped; single ones stay as they are. Out: id, name, alias, src_id_list.
    """
    known = entities.join(components, "name").join(F.broadcast(alias_map) if alias_map.isLocal() else alias_map, "name", "left")
    kept = known.where("size = 1 OR standard is not null").withColumn("standard", F.coalesce("standard", "name"))
    return kept.groupBy("standard").agg(
        F.array_sort(F.collect_set("name")).alias("alias"), F.array_sort(F.collect_set("src_id")).alias("src_id_list")
    ).select(node_id("Entity", "standard").alias("id"), F.col("standard").alias("name"), "alias", "src_id_list")


def rewrite(rows: DataFrame, mapping: DataFrame, *columns: str) -> DataFrame:
    """Each column through a (old, new[, seq]) map; what the map lacks stays.

    Of repeated olds the last by seq counts, without seq or at ties the largest new. Null
    olds map nothing, an empty map changes nothing, and repeated rows stay repeated.
    """
    order = F.struct("seq", "new") if "seq" in mapping.columns else F.col("new")
    unique = mapping.where("old is not null").groupBy("old").agg(F.max_by("new", order).alias("new"))
    for c in columns:
        own = unique.select(F.col("old").alias("__rewritten_old"), F.col("new").alias("__rewritten_new"))
        joined = rows.join(own, F.col(c) == F.col("__rewritten_old"), "left").withColumn(c, F.coalesce("__rewritten_new", c))
        rows = joined.drop("__rewritten_old", "__rewritten_new")
    return rows


def missing_entities(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """Heads and tails that no entity is named by, exactly and case-sensitively."""
    names = triples.select(F.explode(F.array("head", "tail")).alias("name")).distinct()
    return names.join(entities.select("name").distinct(), "name", "left_anti")


def merge_assertions(assertions: DataFrame) -> DataFrame:
    """By (head, relation, tail): descriptions newline-joined in order, sources gathered; classes of modal rows only are dropped."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "desc"))), lambda r: r["desc"])
    merged = assertions.groupBy("head", "relation", "tail").agg(
        F.array_join(ordered, "\n").alias("desc"), F.array_sort(F.collect_set("src_id")).alias("src_id_list"),
        F.bool_and(F.coalesce("from_modal", F.lit(False))).alias("modal_only"),
    )
    return merged.where("NOT modal_only").drop("modal_only").select(node_id("Assertion", F.concat_ws("|", "head", "relation", "tail")).alias("id"), "*")


def upsert(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """Rows of both; of one key the new one."""
    both = old.withColumn("upsert_rank", F.lit(0)).unionByName(new.withColumn("upsert_rank", F.lit(1)))
    return last_wins(both, list(key), "upsert_rank").drop("upsert_rank")


def standard_relations(responses: DataFrame) -> DataFrame:
    """Lines tag, standard, comma-separated olds -> (old, new)."""
    line = F.explode(F.split("response", "\n")).alias("line")
    parts = responses.select(line).select(F.split("line", r"<\|#\|>").alias("p")).where("size(p) = 3 AND trim(p[0]) = 'relation_std_map'")
    return parts.select(F.explode(F.split(F.col("p")[2], ",")).alias("old"), F.trim(F.col("p")[1]).alias("new")).select(F.trim("old").alias("old"), "new").where("old <> ''")


# ---- by similarity --------------------------------------------------------------------


def class_requests(classes: DataFrame, template: str, least: int = 2) -> DataFrame:
    """One request a class of ``least`` names or more: component, names (sorted), prompt and hash.

    classes: (name, component). A class's names go into one prompt, which bounds it.
    """
    from loomgraph.operators.models import TEMPLATES, fill, requests

    grouped = classes.groupBy("component").agg(F.array_sort(F.collect_set("name")).alias("names")).where(F.size("names") >= least)
    prompt = fill(TEMPLATES[template], {"names": F.array_join("names", "\n")})
    return requests(grouped, template, prompt, "", "component", "names")


def sized(classes: DataFrame) -> DataFrame:
    """(name, component, size): how many names each class has."""
    return classes.join(classes.groupBy("component").agg(F.count("*").alias("size")), "component").select("name", "component", "size")


def merge_entities_by_similarity(entities: DataFrame, classes: DataFrame, responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged entities, alias map) from classes of names and the replayed answers about them.

    entities: name, src_id; classes: (name, component). Members of a class of several that
    the answers name nowhere are dropped, single ones stay.
    """
    from loomgraph.operators.models import replay
    from loomgraph.operators.parse import alias_map

    answered = replay(class_requests(classes, "entity_standard"), responses).where("response is not null")
    ordered = answered.select("response", F.col("component").alias("ordinal"))
    names = alias_map(ordered)
    return merge_by_standard_name(entities, names, sized(classes)), names


def merge_assertions_by_similarity(assertions: DataFrame, classes: DataFrame, responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged assertions, relation map): relations standardised by class, then one row a (head, relation, tail).

    assertions: head, relation, tail, desc, src_id, from_modal, seq. alias holds the
    relation names as they were; groups of modal rows only are dropped.
    """
    from loomgraph.operators.models import replay

    answered = replay(class_requests(classes, "relation_standard"), responses).where("response is not null")
    mapping = standard_relations(answered)
    kept = rewrite(assertions.withColumn("alias", F.col("relation")), mapping, "relation")
    aliases = kept.groupBy("head", "relation", "tail").agg(F.array_sort(F.collect_set("alias")).alias("alias"))
    return merge_assertions(kept).join(aliases, ["head", "relation", "tail"]), mapping


def merge(nodes: dict[str, DataFrame], similar: dict[str, tuple[DataFrame, DataFrame]] | None = None) -> dict[str, DataFrame]:
    """The merges in their order: documents, chunks, entities, assertions, tables, formulas, images by id,
    then entities ("Entity") and assertions ("Assertion") by similarity, where (classes, responses) are given."""
    out = {}
    for kind in ("Document", "Chunk", "Entity", "Assertion", "Table", "Formula", "Image"):
        if kind not in nodes:
            continue
        rows = nodes[kind]
        out[kind] = merge_entities_by_id(rows) if kind == "Entity" else merge_assertions(rows) if kind == "Assertion" else last_wins(rows, ["id"])
    similar = similar or {}
    if "Entity" in similar and "Entity" in out:
        out["Entity"], names = merge_entities_by_similarity(nodes["Entity"].select("name", "src_id"), *similar["Entity"])
        if "Assertion" in out:
            renamed = rewrite(nodes["Assertion"], names.select(F.col("name").alias("old"), F.col("standard").alias("new")), "head", "tail")
            out["Assertion"], nodes = merge_assertions(renamed), {**nodes, "Assertion": renamed}
    if "Assertion" in similar and "Assertion" in out:
        out["Assertion"], _ = merge_assertions_by_similarity(nodes["Assertion"], *similar["Assertion"])
    return out
