"""Model calls: requests as rows, responses from a replayed table or from calls in executors.

A stage builds requests (a pure DataFrame), gets responses, and parses them (pure again).
Replay joins on the request hash, so a run repeats without any model. Live calls run in
mapInPandas, at most ``concurrency`` at a time in each task: partitions x concurrency is the
load on the service.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACE = re.compile(r"\{\{\{(\w+)\}\}\}")


def fill(template: str, values: dict[str, Column]) -> Column:
    """The template with {{{name}}} places filled from columns."""
    parts, at = [], 0
    for m in PLACE.finditer(template):
        parts += [F.lit(template[at : m.start()]), F.coalesce(values[m[1]].cast("string"), F.lit(""))]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def chat(system: str, user: Column) -> Column:
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(message("system", F.lit(system)), message("user", user))


def requests(rows: DataFrame, stage: str, prompt: Column, model: str = "", *keep: str) -> DataFrame:
    """keep columns, stage, model, prompt and the hash of what is asked."""
    made = rows.select(*keep, F.lit(stage).alias("stage"), F.lit(model).alias("model"), prompt.alias("prompt"))
    return made.withColumn("request_hash", F.md5(F.concat_ws("\u0001", "stage", "model", "prompt")))


def replay(asked: DataFrame, responses: DataFrame) -> DataFrame:
    """The last recorded response of each request; null where none is recorded."""
    last = responses.groupBy("request_hash").agg(F.max_by("response", "ordinal").alias("response"))
    return asked.join(last, "request_hash", "left")


def retrying(call: Callable[[str, str], str], tries: int = 3, wait: float = 1.0) -> Callable[[str, str], str | None]:
    """Up to ``tries`` attempts with waits of wait * 2^k; null after the last failure, for the error sink."""

    def run(model: str, prompt: str) -> str | None:
        for k in range(tries):
            try:
                return call(model, prompt)
            except Exception:
                if k + 1 < tries:
                    time.sleep(wait * 2**k)
        return None

    return run


def endpoint(base: str) -> str:
    """The chat endpoint of a service's base address."""
    base = base.rstrip("/")
    if base.endswith("/chat/completions"):
        return base
    return base + ("/chat/completions" if re.search(r"/v\d+$", base) else "/v1/chat/completions")


def http_chat(base: str, key: str = "", system: str = "", timeout: float = 120.0, json_mode: bool = False, **options) -> Callable[[str, str], str]:
    """call(model, prompt) over HTTP for live(): one chat message, its answer's text. Errors raise, retrying() waits."""
    url = endpoint(base)

    def call(model: str, prompt: str) -> str:
        import json
        from urllib import request

        messages = ([{"role": "system", "content": system}] if system else []) + [{"role": "user", "content": prompt}]
        body = {"model": model, "messages": messages, **options} | ({"response_format": {"type": "json_object"}} if json_mode else {})
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
        with request.urlopen(request.Request(url, json.dumps(body).encode(), headers), timeout=timeout) as answer:
            return json.loads(answer.read())["choices"][0]["message"]["content"]

    return call


def mime(path: Column | str) -> Column:
    """The media type of an image by its suffix; JPEG where the suffix says nothing."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    known = F.when(suffix.isin("png", "gif", "webp", "bmp"), suffix).otherwise("jpeg")
    return F.concat(F.lit("image/"), known)


def data_url(path: Column | str, content: Column | str) -> Column:
    """An image's bytes as a data address; addresses on the web and data addresses stay as they are."""
    path = F.col(path) if isinstance(path, str) else path
    encoded = F.concat(F.lit("data:"), mime(path), F.lit(";base64,"), F.regexp_replace(F.base64(content), r"\s", ""))
    return F.when(F.regexp_like(path, F.lit(r"^(?i)(https?://|data:)")), path).otherwise(encoded)


def vision_payload(prompt: Column, image: Column) -> Column:
    """The JSON body's messages of a question about an image."""
    part = lambda kind, text, url: F.struct(F.lit(kind).alias("type"), text.alias("text"), url.alias("image_url"))
    none, no_url = F.lit(None).cast("string"), F.lit(None).cast("struct<url:string>")
    return F.to_json(F.array(F.struct(F.lit("user").alias("role"), F.array(part("text", prompt, no_url), part("image_url", none, F.struct(image.alias("url")))).alias("content"))))


def http_vision(base: str, key: str = "", timeout: float = 120.0, **options) -> Callable[[str, str], str]:
    """call(model, payload) for live(), where the prompt column holds vision_payload()."""
    url = endpoint(base)

    def call(model: str, payload: str) -> str:
        import json
        from urllib import request

        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
        body = {"model": model, "messages": json.loads(payload), **options}
        with request.urlopen(request.Request(url, json.dumps(body).encode(), headers), timeout=timeout) as answer:
            return json.loads(answer.read())["choices"][0]["message"]["content"]

    return call


def live(asked: DataFrame, call: Callable[[str, str], str], concurrency: int = 8, tries: int = 3) -> DataFrame:
    """Adds the response of call(model, prompt); call must be picklable and is used by threads."""
    from pyspark.sql import types as T

    schema = T.StructType(asked.schema.fields + [T.StructField("response", T.StringType())])

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run = retrying(call, tries)
        with ThreadPoolExecutor(concurrency) as pool:
            for f in frames:
                yield f.assign(response=list(pool.map(run, f["model"], f["prompt"])))

    return asked.mapInPandas(ask, schema)


def embed(rows: DataFrame, text: str, encode: Callable[[list[str]], list[list[float]]], column: str = "vector") -> DataFrame:
    """Adds vectors, one batched request for each Arrow batch."""
    from pyspark.sql import types as T

    schema = T.StructType(rows.schema.fields + [T.StructField(column, T.ArrayType(T.DoubleType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(**{column: encode(f[text].fillna("").tolist())})

    return rows.mapInPandas(run, schema)


#: Our own wording of the prompts, by stage.
TEMPLATES = {
    "extract": "List the entities and relations of the text, one a line, as entity<|#|>name<|#|>type<|#|>description or relation<|#|>head<|#|>tail<|#|>relation<|#|>description; end with <|COMPLETE|>. Types: {{{types}}}.\n{{{content}}}",
    "recall_relations": "Known entities:\n{{{entities}}}\nKnown relations, not to repeat:\n{{{relations}}}\nList further relations of the text.\n{{{content}}}",
    "recall_entities": "Describe these entities of the text, one a line as entity<|#|>name<|#|>type<|#|>description: {{{names}}}\n{{{content}}}",
    "table": "Analyse the table. Return JSON with name, caption and desc between <myjson> tags.\n{{{content}}}",
    "formula": "Analyse the formula in its context. Return JSON with name, caption and desc between <myjson> tags.\n{{{content}}}\n{{{context}}}",
    "image": "Describe the image. Return JSON with name, class, caption, content and desc between <myjson> tags.\n{{{context}}}",
    "entity_standard": "Group names of one entity. Return a JSON list of name, alias list and desc between <myjson> tags.\n{{{names}}}",
    "relation_standard": "Group relations of one meaning, one a line as relation_std_map<|#|>standard<|#|>a,b.\n{{{names}}}",
    "qa": "Write one question from the graph below as JSON with question, answer and reasoning_path.\n{{{graph_context}}}",
    "support": "Do the evidence and reasoning support the answer? Reply 1 or 0.\n{{{evidence}}}\n{{{q}}}\n{{{a}}}",
    "answer": "Answer the question from the evidence as JSON with answer.\n{{{evidence}}}\n{{{q}}}",
    "complexity": "Rate the reasoning from 1 to 5. Reply with 'complexity score: n' and 'reason: text'.\n{{{q}}}\n{{{cot}}}",
}


def llm_map(rows: DataFrame, template: str, responses: DataFrame, *keep: str, model: str = "") -> DataFrame:
    """Fills a template from columns of the same names and replays its responses."""
    names = PLACE.findall(TEMPLATES[template])
    return replay(requests(rows, template, fill(TEMPLATES[template], {n: F.col(n) for n in names}), model, *keep), responses)


#: What the question of a kind of task is to use; our own wording.
TASK_HINTS = {
    "table": "Use the cells of the tables.", "chart": "Use what the images show.", "formula": "Use the formulas.", "text": "Use the passages.",
    "multihop": "The answer must need every step of the path.", "multi": "Combine all the pieces.",
}


def task_prompt(task: Column | str, context: Column) -> Column:
    """The QA prompt of a task: the common template, with the hints whose words the task's name holds."""
    task = F.col(task) if isinstance(task, str) else task
    hints = F.concat_ws(" ", *(F.when(F.contains(task, F.lit(word)), F.lit(hint)) for word, hint in TASK_HINTS.items()))
    base = fill(TEMPLATES["qa"], {"graph_context": context})
    return F.concat(base, F.when(F.length(hints) > 0, F.concat(F.lit("\n"), hints)).otherwise(""))


def qa_requests(contexts: DataFrame, tasks: DataFrame, model: str = "") -> DataFrame:
    """(path_id, task_type, prompt, ...): contexts (path_id, task_type, context) of registered tasks; others are not asked."""
    known = contexts.join(F.broadcast(tasks.select("task_type")), "task_type")  # one row a task
    return requests(known, "qa", task_prompt("task_type", F.col("context")), model, "path_id", "task_type")


def judge_requests(records: DataFrame, stage: str, models: list[str]) -> DataFrame:
    """(path_id, model_index, model, prompt, ...): one request a record and judge, evidence as JSON."""
    columns = {"evidence": F.to_json("evidence") if dict(records.dtypes).get("evidence", "string") != "string" else F.col("evidence"), "q": F.col("q"), "a": F.col("a"), "cot": F.col("cot")}
    prompt = fill(TEMPLATES[stage], {n: columns[n] for n in PLACE.findall(TEMPLATES[stage])})
    asked = records.select("path_id", prompt.alias("prompt"), F.posexplode(F.array(*map(F.lit, models))).alias("model_index", "model"))
    made = asked.withColumn("stage", F.lit(stage))
    return made.withColumn("request_hash", F.md5(F.concat_ws("\u0001", "stage", "model", "prompt")))
