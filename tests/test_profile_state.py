"""Profiles of parts, merged, against the whole."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import profile_state as ps
from ledgerloom.plans.shared import fresh_path


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(8)
    rows = [(k, rng.gauss(1e6, 3.0) if rng.random() < 0.8 else None, float(rng.randrange(5)), None,
             rng.gauss(0, 1) if rng.random() < 0.9 else None, rng.choice(["a", "a", "a", "b", None, f"v{k % 50}"])) for k in range(4000)]
    return spark.createDataFrame(rows, "id long, x double, few double, none double, y double, t string").repartition(4)


def test_parts_give_the_whole(spark, table):
    folder = fresh_path(spark, "states")
    columns = ["x", "few", "none"]
    for k in range(3):  # the last part again, as after a failure
        ps.store_state(ps.number_state(table.where(F.col("id") % 3 == k), columns, "y"), folder, str(k))
    ps.store_state(ps.number_state(table.where("id % 3 = 2"), columns, "y"), folder, "2")
    merged = {r.feature: r for r in ps.number_report(ps.merge_number_states(ps.read_states(spark, folder))).collect()}
    whole = {r.feature: r for r in ps.number_report(ps.number_state(table, columns, "y")).collect()}
    data = [r.asDict() for r in table.collect()]
    for c in columns:
        values = sorted(r[c] for r in data if r[c] is not None)
        m, w = merged[c], whole[c]
        assert m.present == w.present == len(values) and m.missing_fraction == pytest.approx(1 - len(values) / 4000)
        assert (m.min, m.max) == (w.min, w.max) and m.n_distinct == pytest.approx(len(set(values)), rel=0.05)
        for name in ("mean", "stddev", "corr"):
            a, b = getattr(m, name), getattr(w, name)
            assert a == b or a == pytest.approx(b, rel=1e-9, abs=1e-9)
        for share, q in zip((0.25, 0.5, 0.75), m.quantiles):
            if not values:
                assert q is None
            else:
                assert sum(v < q for v in values) / len(values) - 0.02 <= share <= sum(v <= q for v in values) / len(values) + 0.02
    exact = table.agg(F.avg("x"), F.stddev("x"), F.corr("few", "y")).first()
    both = table.where("few is not null and y is not null").agg(F.corr("few", "y")).first()[0]
    assert merged["x"].mean == pytest.approx(exact[0]) and merged["x"].stddev == pytest.approx(exact[1], rel=1e-6)
    assert merged["few"].corr == pytest.approx(both, abs=1e-9) and merged["none"].mean is None


def test_frequent_values_of_parts(spark, table):
    states = [ps.text_state(table.where(F.col("id") % 2 == k), ["t"]) for k in range(2)]
    found = ps.text_report(ps.merge_text_states(states[0].unionByName(states[1])), 2).first()
    counts = {r.t: r["count"] for r in table.where("t is not null").groupBy("t").count().collect()}
    best = sorted(counts.items(), key=lambda i: -i[1])[:2]
    assert [tuple(r) for r in found.top] == best
    assert found.present == sum(counts.values())


def test_state_of_no_rows(spark, table):
    empty = ps.number_state(table.where("false"), ["x"], "y")
    both = ps.merge_number_states(empty.unionByName(ps.number_state(table, ["x"], "y")))
    assert ps.number_report(both).first().present == ps.number_report(ps.number_state(table, ["x"])).first().present
