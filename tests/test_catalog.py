from __future__ import annotations

import duckdb
import pytest

from vantalume.plans.catalog import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    return round(v, 9) + 0.0 if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", QUERIES)
def test_query_agrees_with_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in sorted(want.columns)]
    got = sorted(repr([norm(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    assert got == sorted(repr([norm(r[i]) for i in at]) for r in want.fetchall())


def test_top_k_plans_without_a_shuffle(spark, sf_dir):
    plan = QUERIES["knn_l2_topk"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan
    plan = QUERIES["insert_conflicts"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "c_acctbal" not in plan.split("ReadSchema")[1]


def test_batch_search_takes_every_hundredth_row(spark, tmp_path, monkeypatch):
    """Against brute force, with queries in one block and in many."""
    import numpy as np

    x = np.random.default_rng(3).integers(-3, 4, (1205, 4)).astype(float)
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    want = []
    for q in range(0, 1205, 100):
        d = ((x - x[q]) ** 2).sum(1)
        want += [(q, int(i), float(d[i]), r + 1) for r, i in enumerate(np.lexsort((np.arange(1205), d))[:5])]
    for block in (1_000, 4):
        monkeypatch.setattr("vantalume.operators.search.QUERY_BLOCK", block)
        got = QUERIES["knn_batch_topk"](spark, str(tmp_path)).select("query_id", "id", "distance", "rank").collect()
        assert sorted((r.query_id, r.id, r.distance, r.rank) for r in got) == sorted(want)


def test_entry(spark, sf_dir):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())
