import itertools
import math
import random

import pytest

from evalloom.operators.metrics import MAX_BOOTSTRAP_VALUES, MetricError, binomial_ci, bootstrap_mean_ci, pass_rate_ci
from evalloom.plans.verify import derived_record


def test_bootstrap():
    assert bootstrap_mean_ci([]) == {"mean": 1.0, "lower": 1.0, "upper": 1.0, "iterations": 0, "seed": 0}
    assert bootstrap_mean_ci([1, 1, 0], seed=17) == {"mean": 0.666667, "lower": 0.0, "upper": 1.0, "iterations": 1000, "seed": 17}
    values = [random.Random(1).random() for _ in range(50)]
    assert bootstrap_mean_ci(values, seed=3) == bootstrap_mean_ci(values, seed=3) != bootstrap_mean_ci(values, seed=4)
    for bad in ({"iterations": 99}, {"iterations": True}, {"confidence": 1}, {"confidence": True}):
        with pytest.raises(MetricError):
            bootstrap_mean_ci([1], **bad)
    for values in ([float("nan")], [1.0] * 10_001):
        with pytest.raises(MetricError):
            bootstrap_mean_ci(values)


def test_measures():
    got = derived_record(["noise", "target", "target"], ["target"], {"target"}, {"target"}, [{"supported": True}], 2)
    assert (got["reciprocal_rank"], got["precision_at_k"], got["recall_at_k"]) == (0.5, 0.5, 1.0)
    got = derived_record(["a", "c"], ["a", "b"], {"a", "bad"}, {"a", "b", "c"}, [{"supported": True}], 3)
    assert (got["citation_precision"], got["citation_recall"], got["failures"]) == (0.5, 0.5, ["retrieval_miss", "invalid_citation"])
    got = derived_record([], [], set(), {"a"}, [], 3)
    assert got["passed"] and got["precision_at_k"] == got["ndcg_at_k"] == got["citation_precision"] == 1.0


def test_interval_of_counts():
    for n, hits in ((1, 1), (9, 0), (40, 13), (3000, 2990)):
        mass = [math.comb(n, k) * hits**k * (n - hits) ** (n - k) for k in range(n + 1)]
        below, total = list(itertools.accumulate(mass)), n**n
        want = tuple(next(k for k, b in enumerate(below) if b * 1000 >= q * total) / n for q in (25, 975))
        assert binomial_ci(n, hits) == want
    low, high = binomial_ci(10**9, 10**8)
    assert abs(low - 0.1 + 1.96 * math.sqrt(0.09e-9)) < 1e-8 and abs(high - 0.1 - 1.96 * math.sqrt(0.09e-9)) < 1e-8


def test_a_large_suite_has_an_interval(spark):
    n = MAX_BOOTSTRAP_VALUES
    rows = spark.range(n + 1).selectExpr("'large' as suite_id", "cast(id as int) as question_pos", "string(id) as question_id", "id % 4 = 0 as passed")
    small = rows.limit(200).selectExpr("'small' as suite_id", "question_pos", "question_id", "passed")
    got = {r.suite_id: r for r in pass_rate_ci(rows.unionByName(small)).collect()}
    assert got["large"].iterations == 0 and got["large"].lower < got["large"].mean < got["large"].upper and got["small"].iterations == 1000
    assert abs(got["large"].upper - got["large"].lower - 2 * 1.96 * math.sqrt(0.25 * 0.75 / n)) < 5e-4
