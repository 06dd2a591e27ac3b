import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionlens.ml import evaluate, frame
from sessionlens.ml.autoencoder import Autoencoder, _forward, _unpack, gradient, initial_weights
from sessionlens.ml.iforest import IsolationForest, average_path, subsamples
from sessionlens.ml.quantile import exact_quantile, kth_smallest
from sessionlens.ml.scaler import StandardScaler
from sessionlens.plans import pipeline
from sessionlens.schema import FEATURE_COLUMNS


def values_frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v double")


VALUE_SETS = {
    "spread": [random.Random(1).gauss(0, 9) for _ in range(3000)],
    "few distinct": [float(random.Random(2).randrange(1, 5)) for _ in range(50)] * 40,
    "one heavy value": [7.0] * 2000 + [random.Random(3).random() for _ in range(1000)],
    "two heavy ends": [0.0] * 1500 + [1.0] * 1500 + [0.5, 0.25],
    "constant": [3.5] * 500,
}


@pytest.mark.parametrize("case", VALUE_SETS)
@pytest.mark.parametrize("q", [0.0, 0.05, 0.5, 0.95, 1.0])
def test_exact_quantile(spark, case, q):
    values = VALUE_SETS[case]
    got = exact_quantile(values_frame(spark, [*values, None]), "v", q, small=20)
    assert got == pytest.approx(float(np.quantile(values, q)))


def test_kth_smallest_of_large_integers(spark):
    rng = random.Random(4)
    values = [rng.randrange(2**60) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for k in (1, 2, 777, 2000):
        assert kth_smallest(df, "v", k, small=10) == sorted(values)[k - 1]


def test_quantile_of_nothing(spark):
    assert exact_quantile(values_frame(spark, [None]), "v", 0.5) is None


@pytest.mark.parametrize("n", [1, 7, 10, 333])
def test_split_has_the_exact_size_and_repeats(spark, n):
    rows = spark.range(n).select(F.col("id").cast("string").alias("session_id"))
    held = [r[0] for r in frame.split_train_test(rows).where("held_out").collect()]
    again = [r[0] for r in frame.split_train_test(rows.repartition(5)).where("held_out").collect()]
    assert len(held) == math.ceil(0.3 * n) and sorted(held) == sorted(again)


def test_scaler_uses_population_deviation(spark):
    rows = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    scaled = StandardScaler.fit(rows, ["a", "b"]).transform(rows).collect()
    assert [tuple(r) for r in scaled] == [(-1.0, 0.0), (1.0, 0.0)]


def test_labels_and_null_fill(spark):
    rows = spark.createDataFrame(
        [("a", "bot", None), ("b", "normal", 0.5), ("c", None, None), ("d", "fraud", 1.0)],
        "session_id string, agent_type string, cart_to_purchase_ratio double",
    )
    got = {r["session_id"]: (r["label"], r["cart_to_purchase_ratio"]) for r in frame.training_frame(rows).collect()}
    assert got == {"a": (1, 0.0), "b": (0, 0.5), "c": (0, 0.0), "d": (1, 1.0)}


@pytest.fixture(scope="module")
def sessions(spark):
    """400 sessions around one point and 20 planted far away."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(420):
        odd = i >= 400
        x = rng.normal(8.0 if odd else 0.0, 1.0, 9) + (10.0 if odd else 0.0)
        rows.append((f"s{i}", "bot" if odd else "normal", *map(float, x)))
    schema = "session_id string, agent_type string, " + ", ".join(f"{c} double" for c in FEATURE_COLUMNS)
    return spark.createDataFrame(rows, schema)


def test_average_path_length():
    assert list(average_path(np.array([0, 1, 2]))) == [0.0, 0.0, 1.0]
    assert float(average_path(256)) == pytest.approx(10.244770920)


def test_every_tree_gets_its_rows(spark):
    rows = spark.range(5000).select(F.col("id").cast("string").alias("session_id"), F.col("id").cast("double").alias("x"))
    own = subsamples(rows, "session_id", ["x"], 10, 100, 1)
    assert {r["count"] for r in own.groupBy("tree").count().collect()} == {100}
    assert 700 < own.select("x").distinct().count() < 1400  # drawn from one bounded pool
    few = subsamples(rows.limit(60), "session_id", ["x"], 10, 50, 1)
    assert [r["count"] for r in few.groupBy("tree").count().collect()] == [50] * 10
    assert few.dropDuplicates(["tree", "x"]).count() == 500


def test_forest_puts_planted_outliers_on_top(sessions):
    scored = IsolationForest.fit(sessions, trees=50, sample_rows=128).score(sessions)
    top = scored.orderBy(F.desc("score")).limit(20).collect()
    assert {r["agent_type"] for r in top} == {"bot"}


def test_forest_scores_match_walking_the_trees(sessions):
    forest = IsolationForest.fit(sessions, trees=7, sample_rows=64)
    trees = {t: g.set_index("node") for t, g in forest.nodes.groupby("tree")}
    for row in forest.score(sessions).limit(40).collect():
        lengths = []
        for nodes in trees.values():
            node = nodes.loc[0]
            while node["feature"] >= 0:
                value = row[forest.columns[int(node["feature"])]]
                node = nodes.loc[int(node["left"] if value <= node["threshold"] else node["right"])]
            lengths.append(node["length"])
        expected = 2 ** (-np.mean(lengths) / float(average_path(64)))
        assert row["score"] == pytest.approx(expected)


def test_forest_run_flags_the_share_and_repeats(sessions):
    first = pipeline.isolation_forest_run(sessions, contamination=0.1)
    again = pipeline.isolation_forest_run(sessions.repartition(3), contamination=0.1)
    assert first.where("prediction = 1").count() == pytest.approx(42, abs=1)
    columns = ["session_id", "prediction"]
    assert sorted(first.select(columns).collect()) == sorted(again.select(columns).collect())


def test_gradient_matches_finite_differences():
    layers = (4, 3, 2, 3, 4)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6, 4))
    for output in ("sigmoid", "linear"):
        flat = initial_weights(layers, 3) + rng.normal(0, 0.05, len(initial_weights(layers, 3)))

        def loss(w):
            return np.mean((_forward(x, _unpack(w, layers), output)[-1] - x) ** 2)

        found = gradient(flat, x, layers, output)
        for i in range(0, len(flat), 5):
            step = np.zeros_like(flat)
            step[i] = 1e-6
            numeric = (loss(flat + step) - loss(flat - step)) / 2e-6
            assert found[i] == pytest.approx(numeric, abs=1e-6)


def test_weights_do_not_depend_on_the_cores(sessions):
    normal = sessions.where("agent_type = 'normal'")
    assert Autoencoder.fit(normal, epochs=2).weights == pytest.approx(
        Autoencoder.fit(normal.coalesce(1), epochs=2, shards=8).weights
    )


def test_autoencoder_learns_repeats_and_finds_outliers(sessions):
    normal = sessions.where("agent_type = 'normal'")
    start = Autoencoder.fit(normal, epochs=0, shards=2, output="linear")
    model = Autoencoder.fit(normal, epochs=25, shards=2, output="linear")
    again = Autoencoder.fit(normal.repartition(5), epochs=25, shards=2, output="linear")
    assert len(model.weights) == 131
    assert model.weights == pytest.approx(again.weights)

    def error(m, rows):
        return pipeline.reconstruction_errors(m, rows).agg(F.avg("error")).first()[0]

    assert error(model, normal) < error(start, normal)
    odd = sessions.where("agent_type = 'bot'")
    assert error(model, odd) > 10 * error(model, normal)


def test_autoencoder_run_evaluates_held_out_normals_and_all_anomalies(sessions):
    flagged = pipeline.autoencoder_run(sessions, epochs=3, shards=2)
    counts = {r["label"]: r["count"] for r in flagged.groupBy("label").count().collect()}
    assert counts == {0: 120, 1: 20}
    assert flagged.where("label = 1 and prediction = 1").count() == 20


def test_report_matches_plain_arithmetic(spark):
    rng = random.Random(6)
    pairs = [(rng.randrange(2), rng.randrange(2)) for _ in range(200)]
    rows = spark.createDataFrame(pairs, "label int, prediction int")
    got = {r["class"]: r for r in evaluate.classification_report(rows).collect()}
    f1s, supports = {}, {}
    for c in (0, 1):
        tp = sum(label == c and p == c for label, p in pairs)
        precision, recall = tp / sum(p == c for _, p in pairs), tp / sum(label == c for label, _ in pairs)
        f1s[c], supports[c] = 2 * precision * recall / (precision + recall), sum(label == c for label, _ in pairs)
        row = got[str(c)]
        assert (row["precision"], row["recall"], row["f1"]) == pytest.approx((precision, recall, f1s[c]))
        assert row["support"] == supports[c]
    assert got["accuracy"]["f1"] == pytest.approx(sum(a == b for a, b in pairs) / 200)
    assert got["macro avg"]["f1"] == pytest.approx((f1s[0] + f1s[1]) / 2)
    weighted = sum(f1s[c] * supports[c] for c in (0, 1)) / 200
    assert got["weighted avg"]["f1"] == pytest.approx(weighted)


def test_report_without_predicted_anomalies(spark):
    rows = spark.createDataFrame([(0, 0), (1, 0)], "label int, prediction int")
    got = {r["class"]: r for r in evaluate.classification_report(rows).collect()}
    assert (got["1"]["precision"], got["1"]["recall"], got["1"]["f1"]) == (0.0, 0.0, 0.0)


def test_recall_per_agent_and_run_log(spark, tmp_path):
    rows = spark.createDataFrame(
        [("bot", 1, 1), ("bot", 1, 0), ("fraud", 1, 1), ("normal", 0, 0)],
        "agent_type string, label int, prediction int",
    )
    agents = evaluate.recall_by_agent(rows)
    got = {r["agent_type"]: (r["total"], r["caught"], r["missed"], r["recall"]) for r in agents.collect()}
    assert got["bot"] == (2, 1, 1, 0.5) and got["fraud"] == (1, 1, 0, 1.0)
    logged = evaluate.run_rows(spark, "r1", {"contamination": 0.2}, evaluate.classification_report(rows), agents)
    for _ in range(2):
        evaluate.log_run(logged, str(tmp_path / "runs"))
    runs = spark.read.parquet(str(tmp_path / "runs"))
    assert runs.where("kind = 'param'").count() == 2
    assert {r["key"] for r in runs.where("kind = 'metric'").collect()} == {
        "precision_anomaly", "recall_anomaly", "f1_anomaly", "bot_recall", "fraud_recall",
    }
