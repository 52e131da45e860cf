"""Versions of a stored vector index."""

import pytest
from pyspark.sql import functions as F

from webrec.operators import vectors as V


def _rows(df):
    return sorted((r.vec_id, r.label) for r in df.collect())


@pytest.fixture
def stored(spark, tmp_path):
    path = str(tmp_path / "index")
    first = spark.createDataFrame([(1, [1.0, 0.0], 5), (2, [0.0, 1.0], 6)], "vec_id long, embedding array<double>, label int")
    V.vector_rebuild(first, path)
    return path, first


def test_upserts_are_versions(spark, stored):
    path, first = stored
    old = V.vector_current(spark, path)
    V.vector_store_upsert(first.where("vec_id = 2").withColumn("label", F.lit(60)).unionByName(first.where("vec_id = 1").withColumn("vec_id", F.lit(3).cast("long"))), path)
    assert _rows(V.vector_current(spark, path)) == [(1, 5), (2, 60), (3, 5)]
    assert _rows(old) == _rows(V.vector_current(spark, path, 1)) == [(1, 5), (2, 6)]
    assert V.vector_versions(spark, path) == [1, 2]
    assert V.vector_rebuild(first.limit(0), path).count() == 0
    assert V.vector_versions(spark, path) == [1, 2, 3]


def test_a_failed_write_leaves_the_old_version(spark, stored):
    path, first = stored
    bad = first.withColumn("label", F.when(F.col("vec_id") == 2, F.raise_error("lost").cast("int")).otherwise(F.col("label")))
    with pytest.raises(Exception, match="lost"):
        V.vector_rebuild(bad, path)
    assert V.vector_versions(spark, path) == [1]
    assert _rows(V.vector_current(spark, path)) == [(1, 5), (2, 6)]


def test_of_two_writers_at_one_version_the_second_fails(spark, stored, monkeypatch):
    path, first = stored
    V.vector_rebuild(first.where("vec_id = 1"), path)
    real, calls = V.vector_versions, []

    def late(spark, path):
        calls.append(path)
        return [1] if len(calls) == 1 else real(spark, path)  # what the slower one saw as it began

    monkeypatch.setattr(V, "vector_versions", late)
    with pytest.raises(Exception, match="(?i)exist"):
        V.vector_rebuild(first, path)
    monkeypatch.undo()
    assert _rows(V.vector_current(spark, path)) == [(1, 5)]


def test_no_version(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        V.vector_current(spark, str(tmp_path / "none"))
