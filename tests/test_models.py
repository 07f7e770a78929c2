import numpy as np
import pytest

from strideflow.operators.features import LOCATION_AWARE_FEATURES
from strideflow.plans import models as M
from strideflow.plans import recognition as R
from strideflow.plans import training as Tr
from strideflow.schemas import TRACE_COLUMNS


@pytest.fixture(scope="module")
def separable(spark):
    """Traces whose acceleration tells the activity, for both hands."""
    rng = np.random.default_rng(1)
    rows = []
    for hand in (True, False):
        for i, label in enumerate(["Cooking", "Studying", "Walking", "Biking"]):
            for k in range(24 * 250):
                t = i * 10_000_000 + k * 20
                rows.append((f"u{hand}", hand, t, i * 3 + rng.normal() * 0.3, -i + rng.normal() * 0.3, 9 + rng.normal() * 0.1,
                             47.0 + (k * 1e-6 if i >= 2 else 0.0), 7.9, label))
    return spark.createDataFrame(rows, "user string, dominanthand boolean, timestamp long, x double, y double, z double, latitude double, longitude double, activity string")


@pytest.fixture(scope="module")
def trained(spark, separable, pois, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("models"))
    metrics = Tr.run_training(separable, pois, base, (M.DECISION_TREE, M.RANDOM_FOREST, M.NAIVE_BAYES))
    return base, metrics.collect()


def test_all_variants_learn_a_separable_set(trained):
    _, metrics = trained
    assert len(metrics) == 12
    assert {(r.locationaware, r.dominanthand, r.algorithm) for r in metrics} == {
        (a, h, m) for a, h in M.VARIANTS for m in (M.DECISION_TREE, M.RANDOM_FOREST, M.NAIVE_BAYES)}
    for r in metrics:
        assert r.n_vectors > 90 and 0 < r.n_test < r.n_vectors
        assert r.accuracy > (0.9 if r.algorithm != M.NAIVE_BAYES else 0.5), metrics


def test_training_set_layout(separable, pois):
    aware = Tr.training_set(separable, pois, True, True)
    assert aware.columns[-28:] == LOCATION_AWARE_FEATURES
    rows = aware.select("activity", "label", "cluster_id", "avg_speed", *[f"tf_{i}" for i in range(8)]).distinct().collect()
    for r in rows:
        assert r.label == {"Cooking": 0, "Studying": 4, "Walking": 6, "Biking": 7}[r.activity]
        trip = r.activity in ("Walking", "Biking")
        assert r.cluster_id == (-1 if trip else 1)
        assert (r.avg_speed > 0) == trip
        assert (sum(r[f"tf_{i}"] for i in range(8)) > 0) == (not trip)
    assert Tr.training_set(separable, None, False).columns[-16:] == LOCATION_AWARE_FEATURES[12:]


def test_training_on_clustered_regions(separable, pois):
    rows = Tr.training_set(separable, pois, True, True, regions="cluster").select("activity", "cluster_id").distinct().collect()
    assert {r.activity for r in rows if r.cluster_id >= 0} >= {"Cooking", "Studying"}


def test_models_know_eight_classes(spark, separable):
    train, _ = Tr.split(Tr.training_set(separable, None, False, True))
    assert M.train_decision_tree(train, False).stages[-1].numClasses == 8
    assert M.train_random_forest(train, False).stages[-1].getNumTrees == 10


def test_split_is_a_partition_and_repeatable(separable):
    vectors = Tr.training_set(separable, None, False)
    a, b = Tr.split(vectors)
    n, na, nb = vectors.count(), a.count(), b.count()
    assert na + nb == n and 0.6 < na / n < 0.8
    assert a.select(*Tr.VECTOR_ID).exceptAll(Tr.split(vectors)[0].select(*Tr.VECTOR_ID)).isEmpty()
    other = Tr.split(vectors, seed=7)[0]
    assert not a.select(*Tr.VECTOR_ID).exceptAll(other.select(*Tr.VECTOR_ID)).isEmpty()


def test_reloaded_models_predict_the_same(spark, separable, pois, trained, tmp_path):
    train, test = Tr.split(Tr.training_set(separable, None, False, True))
    for algorithm, train_model in M.TRAINERS.items():
        model = train_model(train, False)
        path = M.model_path(str(tmp_path), algorithm, False, True)
        M.save_model(model, path)
        again = M.PipelineModel.load(path)
        cols = [*Tr.VECTOR_ID, "prediction"]
        assert model.transform(test).select(*cols).exceptAll(again.transform(test).select(*cols)).isEmpty()
        with pytest.raises(Exception):
            M.save_model(model, path, overwrite=False)


def test_model_paths_differ():
    assert len({M.model_path("b", a, *v) for a in M.TRAINERS for v in M.VARIANTS}) == 12


def test_recognise_all(spark, separable, pois, trained):
    base, _ = trained
    forests = M.load_models(base)
    traces = separable.select(*TRACE_COLUMNS)
    out = R.recognise_all(traces, pois, forests, run_start=50_000, latest=2000).collect()
    assert {(r.locationaware, r.dominanthand) for r in out} == set(M.VARIANTS)
    assert {r.timestamp for r in out} == {40_000}
    # The latest records of every user were labelled Biking.
    plain = [r for r in out if not r.locationaware]
    assert len(plain) == 16 and {r.activity for r in plain} == {"Biking"}
    one = R.recognise(traces, None, forests[False, True], False, True, latest=2000).collect()
    assert sorted((r.window_start, r.predicted) for r in one) == sorted(
        (r.window_start, r.activity) for r in plain if r.dominanthand)


def test_accuracy_and_confusion(spark):
    p = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 1.0)], "label double, prediction double")
    assert tuple(M.accuracy(p).first()) == (4, 0.75)
    assert {tuple(r) for r in M.confusion_matrix(p).collect()} == {(0.0, 0.0, 1), (0.0, 1.0, 1), (1.0, 1.0, 2)}


def test_unknown_regions_are_refused(separable):
    with pytest.raises(ValueError):
        Tr.training_set(separable, None, False, regions="guess")



def test_a_hand_that_nobody_wears_is_left_out(spark, separable, pois, tmp_path):
    base = str(tmp_path / "m")
    one = separable.where("dominanthand")
    report = Tr.run_training(one, pois, base, (M.DECISION_TREE, M.RANDOM_FOREST)).collect()
    assert len(report) == 8
    for r in report:
        assert (r.n_vectors > 0) == (r.n_test > 0) == (r.accuracy is not None) == r.dominanthand
    forests = M.load_models(base)
    assert set(forests) == {(False, True), (True, True)}
    rows = separable.select(*TRACE_COLUMNS)
    found = R.recognise_all(rows, pois, forests, 50_000).collect()
    assert found and all(r.dominanthand for r in found)
    by_data = R.recognise_all(rows, pois, M.compiled_trees(spark, base), 50_000).collect()
    assert sorted(map(tuple, by_data)) == sorted(map(tuple, found))
    with pytest.raises(FileNotFoundError):
        M.load_models(str(tmp_path / "none"))


def test_trees_as_data_predict_what_the_models_do(spark, separable, pois, trained):
    base, _ = trained
    for algorithm in (M.DECISION_TREE, M.RANDOM_FOREST):
        trees = M.compiled_trees(spark, base, algorithm)
        for (aware, hand), model in M.load_models(base, algorithm).items():
            rows = Tr.training_set(separable, pois, aware, hand).withColumn("locationaware", M.F.lit(aware))
            # values between and beyond those trained on
            rows = rows.withColumns({c: M.F.expr(f"{c} * (1 + (hash(seg_id, win_id, '{c}') % 100) / 80D)") for c in M.feature_columns(aware)})
            cols = [*Tr.VECTOR_ID, "prediction", "predicted"]
            want = sorted(map(tuple, M.predict_activity(model, rows).select(*cols).collect()))
            got = sorted(map(tuple, M.predict_compiled(rows, trees, (aware,)).select(*cols).collect()))
            assert got == want and len({r[-2] for r in want}) > 1
    plan = M.predict_compiled(rows, trees, (aware,))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "BroadcastHashJoin" in plan
