import pytest

from tessera.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(same, name):
    same(catalog.QUERIES[name], catalog.ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_blend_weights_sum_to_one(spark):
    from conftest import SF

    rows = catalog.QUERIES["meta_blend"](spark, SF).collect()
    assert abs(sum(r["weight"] for r in rows) - 1) < 1e-9 and {r["model"] for r in rows} == {"a", "b", "c"}


def test_importances_name_every_component(spark):
    from conftest import SF

    rows = catalog.QUERIES["feature_importance"](spark, SF).collect()
    assert {r["feature"] for r in rows} == {f"e{i}" for i in range(len(rows))} and all(r["importance"] >= 0 and r["mean_abs"] >= 0 for r in rows)
