"""Queries of estimated emissions against their SQL in DuckDB, on the smallest tables; their posteriors are never broadcast."""

from pathlib import Path

import duckdb
import pytest

from silvatrack.plans import fixtures as fx
from silvatrack.plans import queries

FOLDER = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", ["a5_params_roundtrip", "g6_parameter_report", "e7_emission_normalize"])
def test_emissions(spark, monkeypatch, name):
    if not FOLDER.is_dir():
        pytest.skip("no tables here")
    plans = []
    normalize = queries.emission.normalize
    monkeypatch.setattr(queries.emission, "normalize", lambda *a: plans.append(normalize(*a)) or plans[-1])
    got = queries.queries()[name](spark, str(FOLDER))
    con = duckdb.connect()
    for f in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    found = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in found.description]
    want = sorted(map(tuple, found.fetchall()), key=str)
    mine = sorted((tuple(r) for r in got.select(*names).collect()), key=str)
    assert len(mine) == len(want) > 0 and all(a == pytest.approx(b, abs=2e-6) for a, b in zip(mine, want))
    assert len(plans) == 1 and "BroadcastHashJoin [chrom" not in plans[0]._jdf.queryExecution().executedPlan().toString()


def test_nodes_are_made_by_many_tasks(spark, monkeypatch):
    d = fx.Data(spark, str(FOLDER))
    d.__dict__["chunks"] = spark.range(200).selectExpr("id AS chunk_id", "'c1' AS chrom", "id AS number", "10 * id AS start", "10 * id + 5 AS end").coalesce(1)
    monkeypatch.setattr(fx, "TASK_NODES", 1000)
    assert d.nodes.count() == 5000 and d.nodes.rdd.getNumPartitions() == 4
