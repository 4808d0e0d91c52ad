"""Every query with SQL against DuckDB at the smallest scale; the others run and keep their columns."""

import pytest

from quillmesh.plans import catalogue
from tests.compare import compare, duck


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sf_dir, con, name):
    df = catalogue.queries()[name](spark, sf_dir)
    if name in catalogue.oracle_sql():
        ok, said = compare(df, con, catalogue.oracle_sql()[name])
        assert ok, said
    else:
        assert df.columns and df.count() >= 0


def test_the_search_fuses_all_lists(spark, sf_dir, monkeypatch):
    from quillmesh.operators import fusion

    seen, fuse = [], fusion.fuse
    monkeypatch.setattr(fusion, "fuse", lambda lists, *a, **b: seen.append(lists) or fuse(lists, *a, **b))
    catalogue.queries()["search_end_to_end"](spark, sf_dir)
    assert {r["list_id"] for x in seen for r in x.select("list_id").distinct().collect()} == {"hash_a", "hash_b", "hash_c", "graph"}
