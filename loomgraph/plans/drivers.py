"""The three entry points as DAGs of DataFrames: structured and unstructured ingestion, and
synthesis, filtering, export and evaluation. Model answers are replayed from a response table."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import metrics as M
from loomgraph.functions.ids import hash_order, node_id, packed, unpacked
from loomgraph.functions.text import FORMULA_LABELS, IMAGE_LABELS, TABLE_LABELS
from loomgraph.operators import edges as E
from loomgraph.operators import export, judge, models, qa, sampling, traces
from loomgraph.operators import graph as G
from loomgraph.operators import nodes as N
from loomgraph.operators import parse as P
from loomgraph.operators import resolve as R
from loomgraph.operators import stats as S
from loomgraph.operators.similarity import greedy_dedup
from loomgraph.scratch import materialize
from loomgraph.sources import readers, sinks


@dataclass(frozen=True)
class Config:
    """Defaults of the whole run."""

    entity_types: list[str] = field(default_factory=lambda: ["person", "organization", "location", "event", "concept", "object"])
    sampler: str = "no_subgraph_sampling"
    subgraphs: int = 1
    order: int = 100
    low_degree: int = 0
    high_degree: int = 200
    max_steps: int = 4
    traces: int = 250
    mode: str = "in"
    blur: float = 0.0
    need_info: list[str] = field(default_factory=list)
    seed: str = "loom"
    judge_models: tuple[str, ...] = ("judge-0", "judge-1", "judge-2")
    export_format: str = "messages"


def structured(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Triples -> (nodes, graph edges), fully deterministic."""
    entities = N.entity_nodes(triples).withColumns({"type": F.lit("Entity"), "seq": F.lit(0).cast("long")})
    assertions = N.assertion_nodes(triples).withColumns({"type": F.lit("Assertion"), "seq": F.lit(0).cast("long")})
    keyed = triples if "seq" in triples.columns else triples.withColumn("seq", F.xxhash64("head", "relation", "tail"))
    edges = E.deduplicate(E.relation_edges(keyed))
    return N.flatten(entities, assertions), G.collapse(G.valid_edges(edges, entities))


def unstructured(blocks: DataFrame, responses: DataFrame, config: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """Content blocks and replayed extraction answers -> (nodes, edges)."""
    chunks, tables, images, formulas = N.chunk_nodes(blocks), N.table_nodes(blocks), N.image_nodes(blocks), N.formula_nodes(blocks)
    documents = N.document_nodes(blocks).withColumn("seq", F.lit(0).cast("long"))
    prompt = models.fill(models.TEMPLATES["extract"], {"types": F.lit(", ".join(config.entity_types)), "content": F.col("content")})
    asked = models.requests(R.last_wins(chunks, ["id"]), "extract", prompt, "", "id")
    answered, _ = N.split_failed(models.replay(asked, responses))
    answered = materialize(answered.select(F.col("id").alias("src_id"), F.lit(0).alias("ordinal"), "response"), "answers")  # parsed twice
    # what a second look at each chunk finds: relations not listed, and entities that relations name but none describes
    first_entities, first_relations = P.entities(answered), P.relations(answered)
    again = models.replay(N.relation_recall(chunks.select("id", "content").distinct(), first_entities, first_relations), responses).where("response is not null")
    relations = first_relations.unionByName(P.relations(again.select(F.col("id").alias("src_id"), F.lit(1).alias("ordinal"), "response")))
    lacking = models.replay(N.entity_recall(chunks.select("id", "content").distinct(), relations, first_entities), responses).where("response is not null")
    described = first_entities.unionByName(P.entities(lacking.select(F.col("id").alias("src_id"), F.lit(1).alias("ordinal"), "response")))
    # tables, images and formulas: their analyses, and the entities in them
    analysed = {}
    for kind, rows, template in (("Table", tables, "table"), ("Image", images, "image"), ("Formula", formulas, "formula")):
        values = {"content": F.col("content") if "content" in rows.columns else F.lit(""), "context": F.col("context") if "context" in rows.columns else F.lit("")}
        asked_ = models.requests(R.last_wins(rows, ["id"]), template, models.fill(models.TEMPLATES[template], values), "", "id")
        said = models.replay(asked_, responses).where("response is not null").select(F.col("id").alias("src_id"), "response")
        analysed[kind] = N.with_analysis(rows, kind, said).drop("llm_ok")
    tables, images, formulas = analysed["Table"], analysed["Image"], analysed["Formula"]
    bodies = N.flatten(*(df.select("id", F.col("content") if "content" in df.columns else F.lit(None).cast("string").alias("content")) for df in analysed.values()))
    bodies = bodies.where("content is not null").distinct()
    modal_asked = models.requests(bodies, "extract", models.fill(models.TEMPLATES["extract"], {"types": F.lit(", ".join(config.entity_types)), "content": F.col("content")}), "", "id")
    modal_said = models.replay(modal_asked, responses).where("response is not null").select(F.col("id").alias("src_id"), F.lit(0).alias("ordinal"), "response")
    from_modal = N.modal_entities(bodies, modal_said)
    found = described.select("id", "src_id", "name", "entity_type", "desc", F.col("pos").cast("long").alias("seq"), F.lit(False).alias("from_modal"))
    found = found.unionByName(from_modal.withColumn("seq", F.lit(0).cast("long")))
    merged = R.merge_entities_by_id(found.withColumn("alias", F.lit(None).cast("array<string>")))
    relations = relations.withColumn("seq", F.col("pos").cast("long"))
    assertions = R.last_wins(relations.drop("pos"), ["id"])
    typed = lambda df, t: df.withColumn("type", F.lit(t))
    nodes = N.flatten(
        typed(documents, "Document"), typed(chunks, "Chunk"), typed(tables, "Table"), typed(images, "Image"), typed(formulas, "Formula"),
        typed(merged.withColumn("seq", F.lit(0).cast("long")), "Entity"), typed(assertions, "Assertion"),
    )
    sources = typed(chunks.select("id"), "Chunk")
    for kind, rows in analysed.items():
        sources = sources.unionByName(typed(rows.select("id"), kind))
    sources = sources.distinct()
    edges = [
        E.chunk_edges(chunks), E.refer_edges(chunks, tables, "caption", TABLE_LABELS), E.refer_edges(chunks, images, "caption", IMAGE_LABELS),
        E.refer_edges(chunks, formulas, "content", FORMULA_LABELS), E.assertion_source_edges(assertions.withColumn("src_id_list", F.lit(None).cast("array<string>"))),
        E.relation_edges(assertions.select("head", "relation", "tail")), E.entity_source_edges(found, sources), E.modal_edges(tables, images, formulas),
    ]
    every = edges[0]
    for e in edges[1:]:
        every = every.unionByName(e)
    return nodes, every.distinct()


def traced(nodes: DataFrame, edges: DataFrame, config: Config = Config()) -> DataFrame:
    """(subgraph_id, task_type, path_id, start, companions, path): the traces of every (subgraph, task).

    Subgraphs are apart: nodes of one never meet edges of another. Each task walks its own
    number of steps; at most config.traces a (subgraph, task), by hash. Subgraphs without an
    edge give nothing. The number of subgraphs is a setting, so the loop is short.
    """
    spark = nodes.sparkSession
    tasks = traces.task_info(spark)
    edges = G.stored(edges)
    sample = materialize(sampling.samples(nodes, edges, config.sampler, config.subgraphs, config.order, config.seed), "samples")
    out = None
    for k in range(config.subgraphs):
        seed = f"{config.seed}/{k}"
        inside = materialize(nodes.join(sample.where(F.col("subgraph_id") == k).select("id"), "id", "left_semi").select("id", "type"), "inside")
        sub = G.induced_subgraph(edges, G.few(inside.select("id").distinct()).select(packed("id").alias("id"))).distinct()
        sub = materialize(sub.select(unpacked("head").alias("head"), unpacked("tail").alias("tail")), "subgraph")
        starts = materialize(traces.start_candidates(sub, inside, tasks, seed), "starts")
        near = traces.companions(starts, sub, inside, tasks, seed).groupBy("task", "start").agg(F.array_sort(F.collect_list("id")).alias("companions"))  # as many as the task requires
        for most in sorted({t[-1] for t in traces.TASKS}):
            steps = min(most, config.max_steps)
            own = starts.join(F.broadcast(tasks.where(F.col("max_steps") == most).select(F.col("task_type").alias("task"))), "task")
            walked = traces.dfs_traces(own.select("id"), sub, steps, seed, config.low_degree, config.high_degree, mode=config.mode)
            found = own.join(walked, own.id == walked.start).select("task", "start", "path").join(near, ["task", "start"], "left")
            rank = F.row_number().over(Window.partitionBy("task").orderBy(hash_order(seed, "task", "start"), "start"))
            found = found.withColumn("r", rank).where(F.col("r") <= config.traces).select(
                F.lit(k).alias("subgraph_id"), F.col("task").alias("task_type"), F.concat_ws("/", F.lit(str(k)), "task", "start").alias("path_id"), "start",
                F.coalesce("companions", F.array().cast("array<string>")).alias("companions"), "path",
            )
            out = found if out is None else out.unionByName(found)
    return out


def synthesis(nodes: DataFrame, edges: DataFrame, responses: DataFrame, config: Config = Config()) -> DataFrame:
    """Graph -> samples -> traces of every (subgraph, task) -> contexts -> replayed questions -> records (with present keys).

    A path's nodes are its start, the companions that the task requires, and the steps; its
    evidence holds every edge among them.
    """
    paths = materialize(traced(nodes, edges, config), "traces")
    members = F.array_distinct(F.concat(F.slice("path", 1, 1), "companions", F.slice("path", 2, F.greatest(F.size("path") - 1, F.lit(0)))))
    kept = nodes.drop("seq", "src_id", "head", "relation", "tail")
    kept = qa.blur(kept, config.seed, config.blur, "class" if "class" in kept.columns else "type") if config.blur else kept
    placed = materialize(paths.select("path_id", "task_type", F.posexplode(members).alias("pos", "id")).join(kept, "id"), "placed")
    ends = placed.select("path_id", F.col("id"), "name", "pos")
    rels = edges.select(F.col("head").alias("h"), "relation", F.col("tail").alias("t"))
    rels = rels.join(ends.select("path_id", F.col("id").alias("h"), F.col("name").alias("head"), "pos"), "h").join(ends.select("path_id", F.col("id").alias("t"), F.col("name").alias("tail")), ["path_id", "t"])
    rels = rels.select("path_id", "pos", "head", "relation", "tail", F.lit("").alias("desc")).distinct()
    contexts = qa.path_contexts(placed, rels, config.need_info).join(paths.select("path_id", "task_type"), "path_id")
    asked = models.qa_requests(contexts, traces.task_info(nodes.sparkSession))
    answered = models.replay(asked, responses).select(F.col("path_id").alias("key"), "response")
    parsed = P.qa(answered).join(contexts.select(F.col("path_id").alias("key"), "task_type", "need_info"), "key")
    asks = F.when(F.length("need_info") > 0, F.concat_ws("\n", "need_info", "question")).otherwise(F.col("question"))
    return qa.qa_records(parsed.withColumn("question", asks).drop("need_info"), placed, rels)


def filtering(
    records: DataFrame, votes: DataFrame | None = None, answers: DataFrame | None = None, reviews: DataFrame | None = None,
    vectors: DataFrame | None = None, threshold: float = 0.95, path: str | None = None,
) -> DataFrame:
    """Validation, semantic deduplication of the questions, then the enabled judges; nothing is removed by its score.

    vectors: (path_id, vector) of the questions; without them none is a duplicate. path:
    where invalid rows, their report and the statistics go.
    """
    checked = qa.validate(records)
    valid = sinks.split_invalid(checked, f"{path}/checked") if path else checked.where("is_valid")
    if vectors is not None:
        own = vectors.join(valid.select("path_id"), "path_id", "left_semi").withColumnRenamed("path_id", "id")
        kept = greedy_dedup(own, threshold)
        lost = own.select("id").join(kept, "id", "left_anti")  # rows without a vector stay
        valid = valid.join(lost, valid.path_id == lost.id, "left_anti")
    scored = judge.score_records(valid, "path_id", votes, answers, reviews).withColumn("num_hops", qa.num_hops())
    if path:
        scored = sinks.stage(records.sparkSession, path, "scored", lambda: scored)
        sinks.save_statistics(summarise(scored), f"{path}/statistics")
    return scored


def evaluation(predictions: DataFrame) -> DataFrame:
    """Adds all metrics to (model_name, example_id, task_type, query, gold_answer, response)."""
    p = predictions.withColumn("prediction", P.answer("response")).where("prediction is not null")
    return p.withColumns({
        "em": M.exact_match(F.col("prediction"), F.col("gold_answer")), "acc": M.accuracy("prediction", "gold_answer"), "f1": M.token_f1("prediction", "gold_answer"),
        "rouge1": M.rouge_n("prediction", "gold_answer", 1, True), "rouge2": M.rouge_n("prediction", "gold_answer", 2, True), "rougeL": M.rouge_l("prediction", "gold_answer", True),
    })


def evaluate(path: str, examples: DataFrame, names: list[str], responses: DataFrame, version: str) -> DataFrame:
    """One evaluation run: what the last snapshot lacks is asked, scored and merged; then the means and the pivot.

    examples: example_id, task_type, query, gold_answer; responses: model_name, example_id,
    response. Rows of earlier runs are not scored again. Writes below path: snapshots, the
    rows of each run as CSV (appended), the means and the pivot. Returns the new snapshot.
    """
    spark = examples.sparkSession
    table = f"{path}/evaluations"
    before = sinks.snapshots(spark, table)
    asked = spark.createDataFrame([(m,) for m in names], "model_name string")
    if before:
        todo = S.pending(examples, asked, spark.read.parquet(before[-1]))
    else:
        todo = examples.select("example_id").crossJoin(F.broadcast(asked))  # a short list of models
    said = todo.join(examples, "example_id").join(responses, ["model_name", "example_id"])
    scored = materialize(evaluation(said).drop("response"), "scored")
    merged = sinks.merge_evaluations(spark, table, scored, version)
    sinks.append_csv(scored, f"{path}/rows")
    S.model_means(merged).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/means")
    tasks = sorted(r[0] for r in merged.select("task_type").distinct().collect())  # a registry's names
    sinks.save_pivot(S.model_task_pivot(merged, "f1", tasks, names), f"{path}/pivot")
    return merged


def run(blocks: DataFrame, responses: DataFrame, path: str, config: Config = Config(), vectors: DataFrame | None = None) -> DataFrame:
    """Everything in order: ingestion, synthesis, filtering, export; each stage is kept below path and read again on a resumed run."""
    spark = blocks.sparkSession
    made: dict[str, tuple[DataFrame, DataFrame]] = {}

    def ingested(k: int) -> DataFrame:
        made.setdefault("graph", unstructured(blocks, responses, config))
        return made["graph"][k]

    nodes = sinks.stage(spark, path, "nodes", lambda: ingested(0))
    edges = sinks.stage(spark, path, "edges", lambda: ingested(1))
    records = sinks.stage(spark, path, "records", lambda: synthesis(nodes, edges, responses, config))
    scored = filtering(records, vectors=vectors, path=path)
    return sinks.stage(spark, path, "export", lambda: export_records(scored, config))


def run_workbooks(spark: SparkSession, books: str, responses: DataFrame, path: str, config: Config = Config()) -> DataFrame:
    """The variant whose source are workbooks: the first column of each is a document of text blocks; no evaluation follows."""
    cells = readers.workbooks(spark, books)
    none = lambda t: F.lit(None).cast(t)
    blocks = cells.select("*", none("string").alias("table_body"), none("array<string>").alias("table_caption"), none("array<string>").alias("image_caption"),
                          none("string").alias("img_path"), F.lit(0.0).alias("page_idx"), (F.xxhash64("doc_name").bitwiseAND(0x7FFFFFFF) * 1_000_000 + F.col("pos")).alias("seq"))
    return run(blocks, responses, path, config)


def load_config(spark: SparkSession, path: str) -> Config:
    """Settings from a JSON file over the defaults; unknown names are errors."""
    given = json.loads(spark.read.text(path, wholetext=True).first()[0])
    unknown = set(given) - {f.name for f in fields(Config)}
    if unknown:
        raise ValueError(f"unknown settings {sorted(unknown)}")
    return Config(**{k: tuple(v) if k == "judge_models" else v for k, v in given.items()})


def export_records(scored: DataFrame, config: Config = Config()) -> DataFrame:
    return export.convert(scored, config.export_format, key="path_id")


def summarise(scored: DataFrame) -> DataFrame:
    return S.statistics(scored, [t[0] for t in traces.TASKS])


def run_structured(spark: SparkSession, triples: DataFrame) -> DataFrame:
    """The minimum slice: three-step paths of the graph of the triples."""
    _, edges = structured(triples)
    return traces.khop_paths(edges, 3).select(F.array_join("path", "->").alias("path"), F.col("len").cast("long").alias("len"))


__all__ = ["Config", "structured", "unstructured", "synthesis", "filtering", "evaluation", "evaluate", "run", "run_workbooks", "load_config", "traced", "export_records", "summarise", "run_structured", "node_id"]
