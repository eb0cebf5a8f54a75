import __spark_entry__ as se
from evalspark.plans import registry


def test_entry_smoke(spark):
    df = se.entry(spark)
    assert df.columns == ["model", "grp", "precision", "recall", "f1", "balanced_accuracy", "support"]
    assert df.count() > 0


def test_registry_consistent():
    q, o = se.queries(), se.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 90
    for name in registry.QUERIES:  # the names opN_ are for the training-data package
        assert not name.lower().startswith("op")
        assert name in q
