"""Passes that neither copy rows nor build a table for each group, against the plain forms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelcast.operators import moments, resampling, splits
from panelcast.operators.models import grove, kernel, linear
from panelcast.plans import catalog


def test_fold_errors_without_copies_of_rows(spark):
    """errors of folds and samples are those of rows copied for each fold, and the rows are not copied."""
    rng = np.random.default_rng(3)
    rows = [(i, ["a", "b", None][i % 3], float(rng.normal()), None if i % 41 == 0 else float(rng.normal()), float("nan") if i % 37 == 0 else float(rng.normal())) for i in range(600)]
    df = spark.createDataFrame(rows + rows[:50], "id long, g string, x1 double, x2 double, y double")
    grid = [{"lambda": v} for v in (0.0, 0.1, 2.0)]
    for folds in (resampling.KFold(["id"], 4, 3), resampling.Bootstrap(["id"], 6)):
        out = resampling.fold_search(df, "y", ["x1", "x2"], grid, ["g"], folds)
        assert "Generate explode" not in out._jdf.queryExecution().optimizedPlan().toString()
        got = {(r["g"], r["fold"], r["point"]): r["mae_test"] for r in out.collect() if r["g"]}
        if isinstance(folds, resampling.KFold):
            copies = splits.repeated_kfold(df, ["id"], 4, 3).withColumn("fold", F.col("repeat") * 4 + F.col("fold"))
        else:
            copies = df.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(5)))).where(splits.hash_uniform(["id"], F.col("fold"), 42) < resampling.UNDRAWN)
        want = {(r["g"], r["fold"], r["point"]): r["mae"] for r in linear.score_points(copies, "y", ["x1", "x2"], out, ["g", "fold"], ["g", "fold"]).collect()}
        assert all(k[0] for k in want)  # rows without a group count nowhere
        assert want.keys() == got.keys() and len(got) == 2 * 3 * (12 if isinstance(folds, resampling.KFold) else 6)
        assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_key_groups_and_vectors_of_a_batch():
    batch = pa.RecordBatch.from_pydict({"g": ["b", None, "a", "b"], "d": [1, 1, None, 1], "x": [[1.0, None], [2.0, 3.0], [4.0, 5.0], [6.0, 7.0]]})
    got = {tuple(k.values()): at.tolist() for k, at in moments.key_groups(batch, ["g", "d"])}
    assert got == {("b", 1): [0, 3], (None, 1): [1], ("a", None): [2]}
    assert np.isnan(moments.matrix(batch.column("x"))[0, 1]) and moments.matrix(batch.column("x"))[3].tolist() == [6.0, 7.0]
    with pytest.raises(ValueError):
        moments.matrix(pa.array([[1.0, 2.0], None, [1.0, 2.0]]))


def test_fold_check_counts_repeated_and_missing_keys(spark, tmp_path):
    """one shuffle of the rows before they are copied; rows with a missing key have no key, repeated ones one."""
    rows = [(1, 1, 1, 1), (1, 1, 1, 1), (2, 1, 1, 1), (None, 1, 1, 1), (3, 1, 1, None)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = catalog.QUERIES["s4_kfold_check"](spark, str(tmp_path))
    assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()
    copies = splits.repeated_kfold(spark.createDataFrame(rows, "a long, b int, c long, d long"), list("abcd"), 5, 4)
    want = copies.groupBy("repeat").agg(F.count("*"), F.count_distinct(*"abcd"), F.count_distinct("fold"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("depth", [1, 3, 5, 8])
def test_rows_in_trees_by_all_nodes_and_step_by_step(depth):
    """the node of each row from comparisons at every node is the one that steps down the tree end in."""
    rng = np.random.default_rng(depth)
    nodes = (2 << depth) - 1
    feature = np.where(rng.random((4, nodes)) < 0.8, rng.integers(0, 3, (4, nodes)), -1)
    feature[:, (1 << depth) - 1 :] = -1
    threshold, value = rng.normal(size=feature.shape), rng.normal(size=feature.shape)
    threshold[rng.random(feature.shape) < 0.1] = np.inf
    x = rng.normal(size=(500, 3))
    x[rng.random(x.shape) < 0.1] = np.nan
    x[0] = np.inf
    want = np.take_along_axis(value, grove.descend(x, feature, threshold, depth + 1), axis=1)
    assert (grove.evaluated(x, feature, threshold, value) == want).all()
    at = grove.paths(lambda k: ~(x[:, feature[0, k]] <= threshold[0, k]) if feature[0, k] >= 0 else None, depth, len(x))
    stepped = grove.descend(x, feature[:1], threshold[:1], depth)[0] - ((1 << depth) - 1)
    assert (at[stepped >= 0] == stepped[stepped >= 0]).all()


def test_columns_of_arrays_from_rows():
    assert grove._listed(np.array([[1.0, 2.0], [3.0, 4.0]]).T).to_pylist() == [[1.0, 3.0], [2.0, 4.0]]


def test_features_of_the_radial_kernel(spark):
    """the map is worked out on whole columns; a missing predictor gives missing features, as before."""
    df = spark.createDataFrame([(1.0, 2.0), (None, 1.0), (0.5, -1.0)], "a double, b double")
    rng = np.random.default_rng(42)
    w, c = rng.normal(scale=np.sqrt(0.2), size=(2, 4)), rng.uniform(0, 2 * np.pi, 4)
    column = kernel.fourier_map(["a", "b"], 0.1, 4)
    out = df.select("a", "b", column.alias("z"))
    for r in out.collect():
        if r["a"] is None:
            assert r["z"] == [None] * 4
        else:
            assert np.allclose(r["z"], np.sqrt(0.5) * np.cos(np.array([r["a"], r["b"]]) @ w + c))
    assert df.limit(0).select(column).count() == 0
