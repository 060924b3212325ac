"""Helpers of the operators."""
from railyard.llm import common


def test_stored_tables_can_be_cleared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_path", lambda spark, *parts: "/".join([str(tmp_path), *parts]))
    assert not common.clear_stored(spark)
    kept = common.stored(spark.range(5), "numbers")
    assert kept.count() == 5 and any((tmp_path / "llm").iterdir())
    assert common.clear_stored(spark) and not (tmp_path / "llm").exists()
