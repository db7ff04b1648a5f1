import corpus_pipeline
import pytest

from loomgraph.llm import decontaminate, jaccard_join
from loomgraph.llm.queries import ORACLE, QUERIES
from tests.llm.test_jaccard_join import brute
from tests.oracle import oracle_rows, rows_of

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_oracle(spark, name):
    names, want = oracle_rows(DATA, ORACLE[name])
    df = QUERIES[name](spark, DATA)
    assert sorted(df.columns) == names and rows_of(df) == want


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "decontamination", "packing"]
    one = corpus_pipeline.keep_one_of_near_duplicates(spark, docs, DATA)
    assert one.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in one.collect()) == sorted({c for _, _, c in brute(rows, 5, 80, 100)})
    cut = corpus_pipeline.cut_benchmark_passages(spark, docs, DATA)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    assert decontaminate.find_leaks(cut, bench).where("size(leak_spans) > 0").count() == 0
    same = docs.join(decontaminate.find_leaks(docs, bench).where("size(leak_spans) = 0").select("doc_id"), "doc_id", "left_semi")
    assert same.select(*docs.columns).exceptAll(cut).isEmpty()


def test_whole_run(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    kept = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    assert 0 < len(kept) < spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert jaccard_join.similarity_classes(spark.read.parquet(f"{DATA}/documents.parquet").where(f"doc_id in ({','.join(map(str, kept))})")).where("doc_id <> component_id").count() == 0
