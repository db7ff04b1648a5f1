import pytest

from loomgraph.plans import registry
from tests.conftest import DATA
from tests.oracle import oracle_rows, rows_of


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_oracle(spark, name):
    df = registry.QUERIES[name](spark, DATA)
    names, want = oracle_rows(DATA, registry.ORACLE[name])
    assert sorted(df.columns) == names
    assert rows_of(df) == want


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.entry(spark).take(1)) == 1


def test_bfs_and_chain_samples(spark):
    for kind, least in (("bfs_sampler", 200), ("acs_sampler", 2)):
        rows = registry.QUERIES[kind](spark, DATA).collect()
        assert len(rows) == len(set(rows)) >= least


def test_dfs_traces_are_simple_and_bounded(spark):
    for r in registry.QUERIES["dfs_traces"](spark, DATA).collect():
        path = r.path.split("->")
        assert path[0] == r.start and len(set(path)) == len(path) <= 5


def test_greedy_dedup_equals_a_loop(spark):
    import duckdb
    import numpy as np

    from loomgraph.plans.text_queries import THRESHOLD

    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{DATA}/embeddings.parquet' ORDER BY vec_id").fetchall()
    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    kept = []
    for i in range(len(x)):
        if not kept or (x[kept] @ x[i]).max() < THRESHOLD:
            kept.append(i)
    assert sorted(r.id for r in registry.QUERIES["greedy_dedup"](spark, DATA).collect()) == [rows[i][0] for i in kept]
