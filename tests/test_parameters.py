"""The registered queries use the full parameters of their operators."""

import inspect

import pytest

from belated.operators import inference, learners, policy
from belated.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


class Called(Exception):
    pass


@pytest.mark.parametrize("name, module, function, want", [
    ("value_cascade", policy, "cascade", {"trees": 500}), ("bootstrap_precision", inference, "bootstrap", {"replicates": 1000}),
    ("classifier_scores", learners, "classify", {"trees": 500}), ("vector_clusters", learners, "components", {"k": 50}), ("vector_clusters", learners, "clusters", {"k": 50, "starts": 10})])
def test_full_parameters(spark, monkeypatch, name, module, function, want):
    signature = inspect.signature(getattr(module, function))

    def record(*a, **k):
        bound = signature.bind(*a, **k)
        bound.apply_defaults()
        raise Called({x: bound.arguments[x] for x in want})

    monkeypatch.setattr(module, function, record)
    with pytest.raises(Called) as got:
        QUERIES[name](spark, SF)
    assert got.value.args[0] == want
