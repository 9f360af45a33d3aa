"""Sign flips over whole curves against brute force."""

import itertools

import numpy as np

from tessera.operators import statistics as T
from tessera.plans import registry


def test_draws_and_patterns(spark):
    rng = np.random.default_rng(1)
    groups = {"few": rng.normal(0.3, 1, 9), "many": rng.normal(0.2, 1, 40)}
    rows = [(g, k, float(v)) for g, x in groups.items() for k, v in enumerate(x)]
    got = {r.group: r for r in T.sign_flip(spark.createDataFrame(rows[::-1], "group string, k int, x double")).collect()}
    x = groups["few"]
    s = np.array([np.mean(x * p) for p in itertools.product((1, -1), repeat=9)])
    assert (got["few"].patterns, got["few"].p_greater) == (512, np.mean(s >= x.mean() - 1e-12))
    x = groups["many"]
    s = np.random.RandomState(42).choice(np.array([-1.0, 1.0]), size=(200_000, 40)) @ x / 40
    one, two = (s >= x.mean() - 1e-12).sum(), (abs(s) >= abs(x.mean()) - 1e-12).sum()
    r = got["many"]
    assert (r.patterns, r.p_greater, r.p_two_sided) == (200_000, (1 + one) / 200_001, (1 + two) / 200_001)


def test_query_takes_whole_curves(spark, sf_dir):
    rows = registry.QUERIES["b51_sign_flip_whole"](spark, sf_dir).collect()
    assert rows and max(r.n for r in rows) > 16
    assert all(r.patterns == (2**r.n if r.n <= 16 else 200_000) for r in rows)
