"""Gate, fallback, merging and rerun on small cases with known results."""

import pytest

from triskele.operators import gate as G
from triskele.operators import windows as W

T = ["task"]


def frame(spark, *rows):
    data = [(1, i, *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "task int, ordinal int, start_j bigint, end_j bigint, best bigint, second bigint, support bigint")


def kept(trace):
    return [(r.start_j, r.end_j) for r in trace.filter("after_gate").orderBy("sorted_rank").collect()]


def test_merge_with_gap(spark):
    got = W.merge(frame(spark, (10, 20, 95, 80, 1), (18, 30, 110, 90, 1), (50, 60, 70, None, 1)), T, 3).orderBy("start_j").collect()
    assert [(r.start_j, r.end_j, r.best, r.second, r.support) for r in got] == [(10, 30, 110, 95, 2), (50, 60, 70, None, 1)]


def test_gate_v1_with_window_and_bp_limits(spark):
    w = frame(spark, (1, 10, 90, 89, 1), (20, 30, 95, None, 2), (40, 55, 105, 104, 1), (70, 90, 92, 80, 1))
    t = G.gate(w, T, G.GateConfig("v1", max_windows=2, max_bp=30))
    assert kept(t) == [(40, 55), (20, 30)]
    c = G.counters(t).first()
    assert (c.by_support, c.by_margin, c.by_max_windows, c.by_max_bp) == (1, 1, 1, 0)


def test_gate_reasons(spark):
    w = frame(spark, (1, 10, 70, 65, 2), (20, 30, 95, None, 1), (40, 52, 105, 104, 1), (60, 72, 102, 90, 2))
    t = G.gate(w, T, G.GateConfig("v1", max_windows=1)).orderBy("ordinal").collect()
    # the window at rank 1 is trimmed, the one at rank 0 stays
    assert [r.reject_reason for r in t] == ["min_peak_score", "singleton_missing_margin", "kept", "max_windows"]


def test_gate_v2_rescues_one_singleton(spark):
    w = frame(spark, (1, 10, 85, None, 1), (20, 30, 90, None, 1), (40, 55, 105, 104, 1), (70, 82, 70, 65, 2))
    t = G.gate(w, T, G.GateConfig("v2"))
    assert kept(t) == [(40, 55), (20, 30)]
    assert G.counters(t).first().rescued == 1


def test_off_keeps_all(spark):
    assert G.gate(frame(spark, (1, 2, 1, None, 1)), T, G.GateConfig("off")).first().after_gate


@pytest.mark.parametrize(
    "rows, config, expected",
    [
        ([(1, 10, 85, None, 1), (20, 32, 90, None, 1), (40, 56, 79, 60, 1)], G.FallbackConfig(), [(20, 32)]),
        ([(60, 72, 96, 80, 1), (20, 32, 92, None, 1), (1, 10, 86, None, 1)], G.FallbackConfig(), [(60, 72), (20, 32)]),
        ([(60, 72, 102, 80, 1), (20, 32, 90, None, 1)], G.FallbackConfig(), [(60, 72)]),
        ([(10, 40, 95, 80, 1), (20, 32, 92, None, 1)], G.FallbackConfig(), [(10, 40)]),
        ([(60, 72, 96, 80, 1), (20, 32, 77, 75, 1), (40, 52, 70, 68, 1)], G.FallbackConfig(band_75_79=True), [(60, 72), (20, 32)]),
        ([(60, 72, 96, 80, 1), (20, 32, 70, 68, 1)], G.FallbackConfig(band_75_79=True), [(60, 72)]),
    ],
)
def test_fallback(spark, rows, config, expected):
    assert kept(G.selective_fallback(G.gate(frame(spark, *rows), T), T, config)) == expected


def test_blockers(spark):
    gated = G.gate(frame(spark, (60, 72, 102, 80, 1), (20, 32, 90, None, 1)), T)
    assert G.blockers(gated, T).first().blocker == "score_gap"
    gated = G.gate(frame(spark, (10, 40, 95, 80, 1), (20, 32, 92, None, 1)), T)
    assert G.blockers(gated, T).first().blocker == "covered_by_kept"


def test_rerun(spark):
    t = G.gate(frame(spark, (10, 20, 105, 104, 1), (30, 40, 70, None, 1), (50, 58, 70, None, 1)), T)
    r = G.rerun_upgrade(t, t, T).first()
    assert (r.added_windows, r.added_bp, r.upgraded) == (2, 20, True)


def test_budget_skips_and_continues(spark):
    w = spark.createDataFrame([(1, 0, 10), (1, 1, 25), (1, 2, 8), (1, 3, 3)], "task int, rank int, bp bigint")
    assert [r.admitted for r in W.budget(w, T, 22).orderBy("rank").collect()] == [True, False, True, True]
