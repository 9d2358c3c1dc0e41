"""Queries against their SQL in DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from silvatrack.plans import queries

FOLDER = Path("/root/testdata/sf0.001")
NAMES = ["a1_reads", "a2_samples", "a6_posteriors_by_level", "e1_tree", "e3_spread_centres", "e4_start_variance", "e6_gaussian_ll", "f11_independent_gaussian", "g6_theta_slice", "c4_calls", "c5_diagnostics", "d6_chunks", "d8_coverage", "e2_normalize", "e5_bernoulli_ll", "f2_jacobi", "f11_independent", "f12_clique_pair", "f18_viterbi_chain", "g2_bed", "h4_gradient"]


@pytest.fixture(scope="module")
def duck():
    if not FOLDER.is_dir():
        pytest.skip("no tables here")
    con = duckdb.connect()
    for f in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(round(r[i], 6) + 0.0) if isinstance(r[i], float) else str(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    got = queries.queries()[name](spark, str(FOLDER))
    found = duck.execute(queries.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(got.columns)
    assert plain(got.columns, got.collect()) == plain(names, found.fetchall())


def test_every_query_has_a_name_for_its_job():
    assert set(queries.oracle_sql()) <= set(queries.queries())
