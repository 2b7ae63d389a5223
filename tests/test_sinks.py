"""Versions of a table: those that were made and not deleted, empty ones too."""

from tidemark.sources import sinks


def test_versions_without_entries_are_listed(spark, tmp_path):
    rows = spark.range(5)
    for name, some in (("a", rows), ("b", rows.where("id > 1")), ("c", rows.where("id > 9")), ("1", rows.where("id = 1")), ("01", rows.where("id > 9"))):
        sinks.checkpoint_create(some, str(tmp_path), name)
    sinks.checkpoint_delete(spark, str(tmp_path), "b")
    assert sorted(sinks.checkpoint_list(spark, str(tmp_path)).collect()) == [("01", 0), ("1", 1), ("a", 5), ("c", 0)]


def test_no_version_holds_entries(spark, tmp_path):
    for name in ("x", "y"):
        sinks.checkpoint_create(spark.range(3).where("id > 9").groupBy("id").count(), str(tmp_path), name)
    assert sorted(sinks.checkpoint_list(spark, str(tmp_path)).collect()) == [("x", 0), ("y", 0)]
    sinks.checkpoint_delete(spark, str(tmp_path), "x")
    assert sinks.checkpoint_list(spark, str(tmp_path)).collect() == [("y", 0)]
    sinks.checkpoint_delete(spark, str(tmp_path), "y")
    assert sinks.checkpoint_list(spark, str(tmp_path)).collect() == []
