"""Node construction: typed rows from content blocks and triples, contexts, lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.ids import node_id
from loomgraph.functions.text import labels

TYPES = ["Document", "Chunk", "Assertion", "Entity", "Table", "Image", "Formula"]


def assertion_nodes(triples: DataFrame) -> DataFrame:
    """One Assertion a distinct (head, relation, tail): id over head|relation|tail."""
    return triples.select("head", "relation", "tail").distinct().select(
        node_id("Assertion", F.concat_ws("|", "head", "relation", "tail")).alias("id"), "head", "relation", "tail"
    )


def entity_nodes(triples: DataFrame) -> DataFrame:
    """Entities of the distinct heads and tails; one explode instead of two scans."""
    return triples.select(F.explode(F.array("head", "tail")).alias("name")).distinct().select(node_id("Entity", "name").alias("id"), "name")


def document_nodes(blocks: DataFrame) -> DataFrame:
    """A document's content: its text blocks in order, each followed by a blank line."""
    texts = F.array_sort(F.collect_list(F.when(F.col("type") == "text", F.struct("pos", "text"))))
    content = F.array_join(F.transform(texts, lambda t: F.concat(t["text"], F.lit("\n\n"))), "")
    return blocks.groupBy("doc_name").agg(content.alias("content")).select(node_id("Document", "doc_name").alias("id"), F.col("doc_name").alias("name"), "content")


def _typed(blocks: DataFrame, kind: str) -> DataFrame:
    return blocks.where(F.col("type") == kind).withColumn("doc_id", node_id("Document", "doc_name"))


def chunk_nodes(blocks: DataFrame) -> DataFrame:
    return _typed(blocks, "text").select(node_id("Chunk", "text").alias("id"), "doc_id", F.col("text").alias("content"), F.col("text").alias("name"), "seq")


def _caption(c: str) -> Column:
    return F.array_join(c, " ")


def table_nodes(blocks: DataFrame) -> DataFrame:
    return _typed(blocks, "table").select(node_id("Table", "table_body").alias("id"), "doc_id", F.col("table_body").alias("content"), _caption("table_caption").alias("caption"), "img_path", "seq")


def image_nodes(blocks: DataFrame) -> DataFrame:
    return _typed(blocks, "image").select(node_id("Image", "img_path").alias("id"), "doc_id", "img_path", _caption("image_caption").alias("caption"), "seq")


def formula_nodes(blocks: DataFrame) -> DataFrame:
    """Formulas with the nearest text block before and after as context."""
    forth = Window.partitionBy("doc_name").orderBy("pos", "seq").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy("doc_name").orderBy(F.desc("pos"), F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    text = F.when(F.col("type") == "text", F.col("text"))
    before = F.last(text, True).over(forth)
    after = F.last(text, True).over(back)  # a frame that grows is kept up row by row; one that shrinks is read anew for each row
    # the windows see all blocks, so the type filter comes after them
    framed = blocks.withColumns({"context": F.concat_ws("\n", before, after), "doc_id": node_id("Document", "doc_name")})
    return framed.where("type = 'equation'").select(node_id("Formula", "text").alias("id"), "doc_id", F.col("text").alias("content"), "context", "seq")


def label_map(nodes: DataFrame, field: str, patterns: list[str]) -> DataFrame:
    """(doc_id, label) -> id: a node's first label; of nodes with one label the last counts."""
    first = nodes.withColumn("label", F.try_element_at(labels(field, patterns), F.lit(1))).where("label is not null")
    return first.groupBy("doc_id", "label").agg(F.max_by("id", "seq").alias("id"))


def label_mentions(chunks: DataFrame, patterns: list[str], field: str = "content") -> DataFrame:
    return chunks.select("doc_id", F.col("id").alias("chunk_id"), F.col("seq").alias("chunk_seq"), field, F.explode(labels(field, patterns)).alias("label"))


def modal_context(chunks: DataFrame, nodes: DataFrame, field: str, patterns: list[str]) -> DataFrame:
    """id -> the texts of the chunks that refer to it, in order, newline-joined."""
    found = label_mentions(chunks, patterns).join(label_map(nodes, field, patterns), ["doc_id", "label"])
    joined = F.array_sort(F.collect_list(F.struct("chunk_seq", "content")))
    return found.groupBy("id").agg(F.array_join(F.transform(joined, lambda c: c["content"]), "\n").alias("context"))


def flatten(*frames: DataFrame) -> DataFrame:
    """Typed lists as one frame; absent columns are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def group_by_source(nodes: DataFrame, *columns: str) -> DataFrame:
    """Rows of each source chunk, by seq; rows without source are skipped."""
    rows = F.array_sort(F.collect_list(F.struct("seq", *columns)))
    return nodes.where("src_id is not null").groupBy("src_id").agg(F.transform(rows, lambda r: F.struct(*(r[c].alias(c) for c in columns))).alias("rows"))


def split_failed(responses: DataFrame, column: str = "response") -> tuple[DataFrame, DataFrame]:
    """(rows with a response, rows for the error sink)."""
    return responses.where(F.col(column).isNotNull()), responses.where(F.col(column).isNull())


def merge_pages(chunks: DataFrame) -> DataFrame:
    """Texts of a document concatenated in order, page indexes averaged."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return chunks.groupBy("doc_name").agg(F.array_join(F.transform(rows, lambda r: r["text"]), "").alias("text"), F.avg("page_idx").alias("page_idx"))


# ---- modal analyses, recall, calls without a model ------------------------------------

#: The fields an analysis must give, by type.
ANALYSED = {"Table": ("name", "caption", "desc"), "Formula": ("name", "caption", "desc"), "Image": ("name", "class", "caption", "content", "desc")}


def with_analysis(nodes: DataFrame, kind: str, responses: DataFrame) -> DataFrame:
    """Nodes (id, ...) with the parsed answers about them laid over; responses: (src_id, response).

    A table or an image keeps the caption it has; a table is named by its caption; of a
    formula every parsed field counts. Answers that lack a required field change nothing
    (llm_ok is false); a node without an answer stays as it is.
    """
    from loomgraph.operators.parse import modal_analysis

    fields = ANALYSED[kind]
    found = modal_analysis(responses, fields).select("src_id", F.col("ok").alias("llm_ok"), *(F.col(f).alias(f"__{f}") for f in fields))
    out = nodes.join(found, nodes["id"] == found["src_id"], "left").drop(found["src_id"]).withColumn("llm_ok", F.coalesce("llm_ok", F.lit(False)))
    for f in fields:
        own = F.col(f) if f in nodes.columns else F.lit(None).cast("string")
        said = F.when(F.col("llm_ok"), F.col(f"__{f}"))
        kept = f == "caption" and kind != "Formula"
        out = out.withColumn(f, F.coalesce(F.nullif(own, F.lit("")), said) if kept else F.coalesce(said, own))
    if kind == "Table":
        out = out.withColumn("name", F.coalesce(F.nullif("caption", F.lit("")), "name"))
    return out.drop(*(f"__{f}" for f in fields))


def modal_entities(nodes: DataFrame, responses: DataFrame) -> DataFrame:
    """Entities extracted from tables, images and formulas, flagged from_modal; their relations are not taken.

    responses: (src_id, ordinal, response) about the nodes' ids.
    """
    from loomgraph.operators.parse import entities

    found = entities(responses.join(nodes.select(F.col("id").alias("src_id")), "src_id", "left_semi"))
    return found.drop("pos").withColumn("from_modal", F.lit(True))


def relation_recall(chunks: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Per chunk the request for relations not found yet: its entities, and the relations to leave out.

    chunks: id, content; entities: src_id, name; relations: src_id, head, relation, tail.
    Chunks without entities are not asked.
    """
    from loomgraph.operators.models import TEMPLATES, fill, requests

    names = entities.groupBy("src_id").agg(F.array_join(F.array_sort(F.collect_set("name")), "\n").alias("entities"))
    line = F.concat_ws(" ", "head", "relation", "tail")
    known = relations.groupBy("src_id").agg(F.array_join(F.array_sort(F.collect_set(line)), "\n").alias("relations"))
    rows = chunks.join(names, chunks["id"] == names["src_id"]).drop("src_id").join(known, chunks["id"] == known["src_id"], "left").drop("src_id")
    prompt = fill(TEMPLATES["recall_relations"], {c: F.col(c) for c in ("entities", "relations", "content")})
    return requests(rows, "recall_relations", prompt, "", "id")


def entity_recall(chunks: DataFrame, relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Per chunk the request for heads and tails of its relations that no entity is named by (exactly)."""
    from loomgraph.operators.models import TEMPLATES, fill, requests

    ends = relations.select("src_id", F.explode(F.array("head", "tail")).alias("name")).distinct()
    lacking = ends.join(entities.select("name").distinct(), "name", "left_anti")
    names = lacking.groupBy("src_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("names"))
    rows = chunks.join(names, chunks["id"] == names["src_id"]).drop("src_id")
    prompt = fill(TEMPLATES["recall_entities"], {c: F.col(c) for c in ("names", "content")})
    return requests(rows, "recall_entities", prompt, "", "id", "names")


def call_without_model(nodes: DataFrame) -> DataFrame:
    """Documents and chunks take part in the calls' uniform shape with an empty answer, which any check accepts."""
    return nodes.withColumns({"llm_out": F.lit(""), "llm_out_error": F.lit(None).cast("string")})


def accepted(answers: DataFrame) -> DataFrame:
    """The check of types whose answers need no fields: nothing is wrong with any."""
    return answers.withColumn("llm_out_error", F.lit(None).cast("string"))


def finish_documents(documents: DataFrame) -> DataFrame:
    """Documents end with an empty description and no attributes."""
    return documents.withColumns({"desc": F.lit(""), "attr": F.create_map().cast("map<string,array<string>>")})
