"""Schemas at the stage boundaries, as DDL."""

from __future__ import annotations

TRIPLE = "head string, relation string, tail string, seq bigint"
CONTENT_BLOCK = "type string, text string, table_body string, table_caption array<string>, image_caption array<string>, img_path string, page_idx double"
CONTENT = "doc_name string, pos int, seq bigint, type string, text string, table_body string, table_caption array<string>, image_caption array<string>, img_path string, page_idx double"
NODE = (
    "id string, type string, seq bigint, doc_id string, src_id string, src_id_list array<string>, name string, alias array<string>, content string, "
    "caption string, img_path string, class string, context string, desc string, head string, relation string, tail string, from_modal boolean, attr map<string,array<string>>"
)
EDGE = "head string, relation string, tail string, desc string, attr map<string,array<string>>, seq bigint"
RESPONSE = "request_hash string, stage string, ordinal int, response string"
EVIDENCE = (
    "struct<nodes: array<struct<name: string, type: string, img_path: string, content: string, desc: string>>, "
    "relations: array<struct<head: string, relation: string, tail: string, desc: string>>>"
)
QA = f"q string, a string, cot string, task_type string, node_types array<string>, node_ids array<string>, node_name array<string>, evidence {EVIDENCE}"
EVAL = (
    "example_id int, model_name string, domain string, task_type string, query string, gold_answer string, prediction string, "
    "em double, acc double, f1 double, rouge1 double, rouge2 double, rougeL double"
)
TASK = "task_type string, max_steps int, requirement map<string,int>, ans_types array<string>, question_need_info array<string>"
