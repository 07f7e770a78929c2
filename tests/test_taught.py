"""The model queries train on all labels of the records, not on the rule that their SQL can state alone."""

import pytest
from conftest import SF

from strideflow import catalog
from strideflow.catalog import QUERIES
from strideflow.plans import models as M
from strideflow.plans import training as Tr

NAMES = ["train_decision_tree", "train_random_forest", "confusion_matrix", "load_models", "predict_activity"]


@pytest.mark.parametrize("name", NAMES)
def test_models_are_taught_the_labels_of_the_records(spark, traces, pois, monkeypatch, name):
    taught = []

    def recorded(algorithm, train):
        def fit(rows, aware):
            taught.append((algorithm, {r["label"] for r in rows.select("label").distinct().collect()}))
            return train(rows, aware)
        return fit

    monkeypatch.setattr(M, "TRAINERS", {a: recorded(a, M.train_decision_tree) for a in M.TRAINERS})
    found = QUERIES[name](spark, SF)
    sides = [Tr.split(Tr.training_set(traces, pois if aware else None, aware)) for aware in (False, True)]
    own, labels = ([{r["label"] for r in kind[side].select("label").distinct().collect()} for kind in sides] for side in (0, 1))
    assert all(len(x) > 2 for x in own)
    algorithm = M.DECISION_TREE if name in ("train_decision_tree", "confusion_matrix") else M.RANDOM_FOREST
    # once for each kind of features; the hand is the same throughout this table
    assert [x for a, x in taught if a == algorithm and len(x) > 2] == own
    if "taught" in found.columns:
        assert {r["label"] for r in found.where(f"taught = '{catalog.ACTIVITY}'").collect()} == labels[0] | labels[1]
    elif "n_labels" in found.columns:
        assert {r["locationaware"]: r["n_labels"] for r in found.collect()} == {aware: len(labels[aware]) for aware in (False, True)}
    else:
        assert all(r["n_own_known"] == r["n_right"] == r["n_test"] > 0 for r in found.collect())
