"""Fits of MLlib's classifiers."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml.classification import RandomForestClassifier

from tidemark.operators import models as M


def test_forest_leaves_memory_to_its_binned_rows(spark, monkeypatch):
    """The packed rows of a forest take no memory while it is fitted and are freed afterwards; its trees are those of
    rows in memory."""
    rows = [(i, i % 3 == 0, float(i % 7), float(i * i % 11)) for i in range(200)]
    df = spark.createDataFrame(rows, "subject_id long, y boolean, a double, b double").withColumn("y", M.F.col("y").cast("int"))
    fit, seen = RandomForestClassifier.fit, []

    def watched(self, data, params=None):
        seen.append((data, data.storageLevel))
        return fit(self, data, params)

    monkeypatch.setattr(RandomForestClassifier, "fit", watched)
    fitted = M.fit_forest(df, df, ["a", "b"], grid=[(3, 2, 1), (3, 4, 1)])
    assert [level for _, level in seen] == [StorageLevel.DISK_ONLY] * 2
    assert not seen[0][0].is_cached
    held = seen[0][0].persist()
    assert RandomForestClassifier(numTrees=3, maxDepth=fitted.setting[1], minInstancesPerNode=1, weightCol="w", seed=42,
                                  featureSubsetStrategy="sqrt").fit(held).toDebugString.splitlines()[1:] == fitted.model.toDebugString.splitlines()[1:]
    held.unpersist()
