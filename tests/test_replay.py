"""Every strategy is replayed under every configuration."""

from tessera.operators import statistics as T
from tessera.plans import registry


def test_strategies_are_replayed_apart(spark, sf_dir):
    raws = {0: ["risk"] * 4, 1: ["normal", "risk", "risk", "normal"]}
    days = [(f"2024-01-0{i + 1}", 0.01 * (i + 1)) for i in range(4)]
    got = T.gate_replay(
        spark.createDataFrame(days, "date string, ret double"),
        spark.createDataFrame([(s, days[i][0], r) for s, x in raws.items() for i, r in enumerate(x)], "strategy_id int, date string, raw string"),
        spark.createDataFrame([(0, 1, 1, 0.0, 0.5), (1, 2, 1, 0.0, 0.5)], "config_id int, enter int, leave int, risk_exposure double, caution_exposure double"),
    ).collect()
    held = {(0, 0): [1, 0, 0, 0], (0, 1): [1, 0.5, 0, 0], (1, 0): [1, 1, 0, 0], (1, 1): [1, 1, 0.5, 0]}
    assert {(r.strategy_id, r.config_id): (r.days, r.mean_exposure) for r in got} == {k: (4, sum(v) / 4) for k, v in held.items()}
    for r in got:
        v, total = held[r.strategy_id, r.config_id], 1.0
        for i in range(4):
            total *= 1 + v[i] * days[i][1] - (abs(v[i] - v[i - 1]) if i else 0) * 1e-3
        assert abs(r.total - (total - 1)) < 1e-12
    rows = registry.QUERIES["b43_gate_replay"](spark, sf_dir).collect()
    assert sorted((r.strategy_id, r.config_id) for r in rows) == [(s, c) for s in range(5) for c in range(4)]
