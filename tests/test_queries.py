"""Every bound query against DuckDB on the same tables."""

import os

import duckdb
import pytest

from triskele.kernels import align
from triskele.plans import kernel_queries, panel_queries, queries, round_trip_queries
from triskele.plans.search import SearchConfig, plan_tasks, thresholds, two_stage_windows

QUERIES, SQL = (queries.QUERIES | panel_queries.QUERIES | round_trip_queries.QUERIES | kernel_queries.QUERIES), (
    queries.SQL | panel_queries.SQL | round_trip_queries.SQL | kernel_queries.SQL
)

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    cols = sorted(names)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    want = sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in found.fetchall())
    assert got == want


@pytest.fixture
def small(spark, monkeypatch):
    """A few sequences in the place of the documents, one of them close to the query."""
    rna = kernel_queries.RNA
    seqs = [(1, "GATTACA" * 20 + rna + "CCTT" * 30), (2, "ACGT" * 40), (3, rna[::-1] + rna[5:45] + "TTTTCCCC" * 9), (4, ""), (5, "A" * 130)]
    monkeypatch.setattr(kernel_queries.Q, "dna", lambda spark, d: spark.createDataFrame(seqs, "doc_id bigint, seq string"))
    return dict(seqs)


def tasks_by_hand(spark, config):
    return [r.asDict() for r in plan_tasks(kernel_queries.Q.dna(spark, DATA), config).collect()]


def test_column_maxima_by_hand(spark, small):
    got = {}
    for r in kernel_queries.QUERIES["column_maxima"](spark, DATA).collect():
        got.setdefault((r.doc_id, r.fragment_index, r.strand), {})[r.position] = r.score
    for t in tasks_by_hand(spark, kernel_queries.CONFIG):
        best = align.column_maxima(align.encode(kernel_queries.RNA), align.encode(t["target"]))[0]
        assert got.pop((t["doc_id"], t["fragment_index"], t["strand"])) == dict(enumerate(best.tolist()))
    assert not got


def test_fast_search_by_hand(spark, small):
    """Every hit's interval scores what it says; every task's highest column is met or beaten by the filter."""
    hits = kernel_queries.fast_hits(kernel_queries.Q.dna(spark, DATA), kernel_queries.RNA, kernel_queries.CONFIG).collect()
    tasks = {(t["doc_id"], t["fragment_index"], t["strand"]): t for t in tasks_by_hand(spark, kernel_queries.CONFIG)}
    assert hits and len({tuple(h) for h in hits}) == len(hits)
    for h in hits:
        t = tasks[h.doc_id, h.fragment_index, h.strand]
        cut = align.encode(t["target"][h.start_j - 1 : h.end_j])
        assert align.local(align.encode(kernel_queries.RNA[h.query_start - 1 : h.query_end]), cut)[0] == h.raw_score
        n = len(t["target"])
        at = (n - h.start_j + 1, n - h.end_j + 1) if t["reverse"] else (h.start_j, h.end_j)
        assert (h.start_in_seq, h.end_in_seq) == (at[0] + t["fragment_start"], at[1] + t["fragment_start"])
        assert h.identity >= 60 and h.stability >= 0.5 and h.direction == ("R" if h.start_in_seq < h.end_in_seq else "L")


def test_exact_search_finds_the_planted_copy(spark, small):
    config = SearchConfig(rule=1, cut=120, overlap=20, stability=-5000.0, pairs=30, identity=0.0)
    hits = kernel_queries.exact_hits(kernel_queries.Q.dna(spark, DATA), kernel_queries.RNA, config).collect()
    least = {(r.query, r.target): r.least for r in thresholds(plan_tasks(kernel_queries.Q.dna(spark, DATA), config, kernel_queries.RNA), None, 30).collect()}
    want = 0
    for t in tasks_by_hand(spark, config):
        want += len(align.k_best(align.encode(kernel_queries.RNA), align.encode(t["target"]), least[kernel_queries.RNA, t["target"]]))
    assert len(hits) == want > 0


def test_two_stage_searches_stay_in_their_windows(spark, small, monkeypatch):
    monkeypatch.setattr(kernel_queries, "CONFIG", SearchConfig(rule=1, cut=120, overlap=20, stability=-5000.0, pairs=30, identity=0.0, pad=8, gap=4))
    key = ["doc_id", "fragment_index", "parallel", "rule", "reverse"]
    tasks = plan_tasks(kernel_queries.Q.dna(spark, DATA), kernel_queries.CONFIG, kernel_queries.RNA)
    windows = two_stage_windows(tasks, kernel_queries.RNA, key, 8, 4, 10).collect()
    for name in ("two_stage_search", "deferred_search"):
        hits = kernel_queries.QUERIES[name](spark, DATA).collect()
        assert len({tuple(h) for h in hits}) == len(hits)
    full = kernel_queries.two_stage_hits(kernel_queries.Q.dna(spark, DATA), kernel_queries.RNA, ["doc_id"], kernel_queries.CONFIG).collect()
    assert full
    for h in full:
        assert any((w.doc_id, w.fragment_index, w.parallel, w.rule, w.reverse) == (h.doc_id, h.fragment_index, h.parallel, h.rule, h.reverse) and w.start_j <= h.start_j and h.end_j <= w.end_j for w in windows)


def test_search_output_is_ordered(spark, small):
    rows = kernel_queries.QUERIES["search_output"](spark, DATA).collect()
    key = [(r.doc_id, r.Class, r.QueryStart, r.QueryEnd, r.StartInSeq, r.EndInSeq) for r in rows]
    assert key == sorted(key) and all(r.Class > 0 and r["Nt(bp)"] > 20 for r in rows)


def test_several_queries_meet_every_task(spark, small):
    two = spark.createDataFrame([("a", kernel_queries.RNA), ("b", "GGAAGGAGGAAGGGAGAAAGG")], "query_name string, query string")
    both = kernel_queries.fast_hits(kernel_queries.Q.dna(spark, DATA), two, kernel_queries.CONFIG).collect()
    one = kernel_queries.fast_hits(kernel_queries.Q.dna(spark, DATA), kernel_queries.RNA, kernel_queries.CONFIG).count()
    assert sum(r.query_name == "a" for r in both) == one and {r.query_name for r in both} == {"a", "b"}


def test_groups_that_pass_batch_borders_cluster_whole(spark):
    """Groups of all sizes, one without a name, with batches of three rows, against each group by hand; and no Python call per group."""
    import numpy as np

    from triskele.kernels.cluster import density_clusters
    from triskele.operators import coverage

    rng = np.random.default_rng(1)
    rows = [(None if g == 7 else g, k, int(m), int(nt)) for g in range(60) for k, (m, nt) in enumerate(zip(rng.integers(0, 120, g % 9 + 1), rng.integers(8, 30, g % 9 + 1)))]
    want = set()
    for g in range(60):
        own = [r for r in rows if r[0] == (None if g == 7 else g)]
        cls, center = density_clusters(np.array([r[2] for r in own if r[3] > 12] or [0]), 15)
        each = iter(zip(cls.tolist(), center.tolist()))
        want |= {(*r, *(next(each) if r[3] > 12 else (0, r[2]))) for r in own}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        out = coverage.clusters(spark.createDataFrame(rows, "seq int, ordinal int, midpoint bigint, nt int"), ["seq"], length=12)
        got = [tuple(r) for r in out.collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows) and set(got) == want
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()


def test_ranking_reads_its_windows_once(spark):
    """Features come of one scan and two shuffles, and the fits read what was written of them."""
    plan = queries.features(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange hashpartitioning") <= 2 and "Join" not in plan
    out = QUERIES["task_ranking"](spark, DATA)
    assert not any("lineitem" in f for f in out.inputFiles())
    assert out.count() == queries.features(spark, DATA).count()


@pytest.mark.parametrize("top", [7, 256])
def test_peaks_are_suppressed_in_the_kernel(spark, small, top):
    """The same peaks as those of all column maxima suppressed afterwards, of which none leaves the kernel now."""
    from triskele.operators import windows as W
    from triskele.plans import search

    tasks = plan_tasks(kernel_queries.Q.dna(spark, DATA), kernel_queries.CONFIG).select(*kernel_queries.TASK, "target")
    want = W.suppress(search.column_peaks(tasks, kernel_queries.RNA, top), kernel_queries.TASK, 10, floor=0)
    got = search.suppressed_peaks(tasks, kernel_queries.RNA, 10, top)
    columns = [*kernel_queries.TASK, "position", "score"]
    rows = lambda df: sorted(tuple(r) for r in df.select(*columns).collect())
    assert rows(got) == rows(want) and got.count() > 0
    assert all(r.n == len(r.target) for r in got.join(tasks, kernel_queries.TASK).collect())
    plan = two_stage_windows(tasks, kernel_queries.RNA, kernel_queries.TASK, 8, 4, 10)._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and "Join" not in plan.replace("BroadcastNestedLoopJoin", "")


def test_boxes_of_all_windows(spark):
    pairs = lambda name: {tuple(r) for r in QUERIES[name](spark, DATA).collect()}
    some, every = pairs("box_overlap"), pairs("box_overlap_all")
    assert some < every and {r for r in every if r[2] <= 2} == some


def test_thresholds_of_all_tasks(spark, monkeypatch):
    from hashlib import md5

    from triskele.kernels.threshold import threshold
    from triskele.plans.search import SearchConfig, plan_tasks

    seqs = spark.createDataFrame([(1, "GGAGGAAGAGCTTCCTTTGA")], "doc_id bigint, seq string")
    monkeypatch.setattr(kernel_queries.Q, "dna", lambda spark, d: seqs)
    targets = {r.target for r in plan_tasks(seqs, SearchConfig(cut=120, overlap=20)).select("target").collect()}
    got = {r.h: r.least for r in kernel_queries.QUERIES["score_thresholds"](spark, DATA).collect()}
    assert len(targets) > 2 and got == {md5(t.encode()).hexdigest(): threshold(kernel_queries.RNA, t, 500) for t in targets}
    assert {r.rule for r in kernel_queries.QUERIES["exact_search"](spark, DATA).select("rule").collect()} <= set(range(19))


def test_registered_kernels_by_hand(spark, small):
    got = {r.doc_id: r for r in QUERIES["registered_kernels"](spark, DATA).collect()}
    q = align.encode(kernel_queries.RNA)
    assert set(got) == {1, 2, 3, 5}
    for k, r in got.items():
        assert r.score == r.top == align.best_score(q, align.encode(small[k])[None, :])[0]
    assert "50M" in got[1].cigar


def test_entry(spark):
    import __spark_entry__

    assert set(SQL) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
