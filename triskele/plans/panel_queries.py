"""The operators of ``operators.panel`` and the scalar functions bound to the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores as X
from ..functions import sequence as S
from ..operators import attribution as AT
from ..operators import gate as G
from ..operators import panel as P
from . import queries as Q
from .bindings import bound, with_views

QUERIES: dict = {}
SQL: dict[str, str] = {}
T = ["task"]
RESCUE = G.GateConfig(mode="v1", min_peak=70, max_windows=4, max_bp=60)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql)
        return f

    return add


W1 = "best DESC, support DESC, m DESC NULLS LAST, start_j, end_j, ordinal"


@query(Q.GATE + f""", able AS (SELECT *, peak_ok AND (support_ok OR margin_ok OR strong_ok) AS base, support = 1 AND second IS NULL AND NOT (peak_ok AND (support_ok OR margin_ok OR strong_ok)) AND best >= 85 AS able FROM b),
  able2 AS (SELECT *, able AND row_number() OVER (PARTITION BY task, able ORDER BY {W1}) = 1 AS one, row_number() OVER (PARTITION BY task ORDER BY {W1}) = 1 AS lead FROM able),
  each AS (SELECT *, 'all_singletons' AS strategy, able AS rescued FROM able2 UNION ALL SELECT *, 'one_singleton', one FROM able2 UNION ALL SELECT *, 'one_if_first', one AND lead FROM able2),
  place AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY task, strategy ORDER BY {W1}) - 1 AS k FROM each WHERE base OR rescued),
  fold AS (SELECT task, strategy, k, CASE WHEN bp <= 45 THEN bp ELSE 0 END AS total, bp <= 45 AS taken FROM place WHERE k = 0
    UNION ALL SELECT q.task, q.strategy, q.k, CASE WHEN fold.total + q.bp <= 45 THEN fold.total + q.bp ELSE fold.total END, fold.total + q.bp <= 45 FROM fold JOIN place q ON q.task = fold.task AND q.strategy = fold.strategy AND q.k = fold.k + 1 AND q.k < 3)
  SELECT p.task, p.strategy, p.ordinal, p.rescued FROM place p JOIN fold ON fold.task = p.task AND fold.strategy = p.strategy AND fold.k = p.k AND fold.taken""")
def safeguard_strategies(spark, d):
    return P.safeguard(Q.trace(spark, d), T, Q.CONFIG).select("task", "strategy", "ordinal", "rescued")


@query("""WITH RECURSIVE o AS MATERIALIZED (SELECT task, best, ordinal, start_j, end_j, row_number() OVER (PARTITION BY task ORDER BY best DESC, ordinal) AS k FROM windows),
  f AS (SELECT task, k, [{'lo': start_j, 'hi': end_j}] AS taken, true AS kept, ordinal, best FROM o WHERE k = 1
    UNION ALL SELECT o.task, o.k, CASE WHEN len(f.taken) >= 3 OR len(list_filter(f.taken, lambda x: x.lo <= o.end_j AND o.start_j <= x.hi)) > 0 THEN f.taken ELSE list_append(f.taken, {'lo': o.start_j, 'hi': o.end_j}) END,
      NOT (len(f.taken) >= 3 OR len(list_filter(f.taken, lambda x: x.lo <= o.end_j AND o.start_j <= x.hi)) > 0), o.ordinal, o.best FROM f JOIN o ON o.task = f.task AND o.k = f.k + 1)
  SELECT task, ordinal, best AS score FROM f WHERE kept""")
def disjoint_boxes(spark, d):
    return P.disjoint(bound(spark, d, "windows").select("task", F.col("best").alias("score"), "ordinal", F.col("start_j").alias("lo"), F.col("end_j").alias("hi")), T, 3)


@query(Q.GATE + f""", u AS (SELECT * FROM cov WHERE NOT after_gate AND NOT covered)
  (SELECT task, 'task_proxy_score_x_bp' AS strategy, ordinal FROM u QUALIFY row_number() OVER (PARTITION BY task ORDER BY best * bp DESC, {W1}) = 1)
  UNION ALL (SELECT task, 'task_proxy_score_x_support', ordinal FROM u QUALIFY row_number() OVER (PARTITION BY task ORDER BY best * support DESC, {W1}) = 1)""")
def task_proxies(spark, d):
    return P.proxy_rows(G.covered(Q.trace(spark, d), T), T).select("task", "strategy", "ordinal")


@query(Q.GATE + f""", o AS (SELECT * FROM gated WHERE NOT after_gate QUALIFY row_number() OVER (PARTITION BY task, rule, strand ORDER BY {W1}) = 1),
  mi AS (SELECT task, 1 + l_suppkey % 6 AS rule, strand, count_if(line = 1) AS top_n, sum(score) AS weight, count(*) AS n FROM hits WHERE (task * 7 + line) % 10 >= 8 GROUP BY ALL)
  SELECT o.task, o.rule, o.strand, o.ordinal FROM o LEFT JOIN mi ON mi.task = o.task AND mi.rule = o.rule AND mi.strand = o.strand
  QUALIFY row_number() OVER (PARTITION BY o.task ORDER BY coalesce(top_n, 0) DESC, coalesce(weight, 0) DESC, coalesce(n, 0) DESC, best DESC, support DESC, m DESC NULLS LAST, start_j, end_j, ordinal) = 1""")
def dominant_objects(spark, d):
    from ..operators.replay import rule_strand_objects

    missing = bound(spark, d, "hits").filter("(task * 7 + line) % 10 >= 8").groupBy("task", (1 + F.col("l_suppkey") % 6).alias("rule"), "strand").agg(
        F.count_if(F.col("line") == 1).alias("top_n"), F.sum("score").alias("weight"), F.count("*").alias("n")
    )
    objects = rule_strand_objects(Q.trace(spark, d), T).drop("n", "total_bp", "object_rank")
    return P.dominant_objects(objects, missing, T).select("task", "rule", "strand", "ordinal")


@query(Q.GATE + f""", pick AS MATERIALIZED (SELECT task, ordinal, bp FROM s2 WHERE near QUALIFY row_number() OVER (PARTITION BY task ORDER BY {W1}) = 1),
  bl AS (SELECT task, max(n_kept) AS n_kept, CASE WHEN max(n_kept) = 0 THEN 'empty_after_gate' WHEN max(n_kept) > 2 THEN 'max_kept_windows' WHEN bool_or(near) THEN 'selected' WHEN NOT bool_or(single) THEN 'no_singleton_missing_margin'
    WHEN NOT bool_or(qual) THEN 'singleton_override' WHEN NOT bool_or(opn) THEN 'covered_by_kept' ELSE 'score_gap' END AS blocker FROM s2 GROUP BY task),
  ta AS (SELECT bl.*, pick.task IS NOT NULL AS picked FROM bl LEFT JOIN pick ON pick.task = bl.task),
  c1 AS (SELECT count_if(reject_reason = 'min_peak_score')::BIGINT AS rejected_by_peak, count_if(reject_reason IN ('singleton_missing_margin', 'low_support_or_margin') AND NOT support_ok)::BIGINT AS rejected_by_support,
    count_if(reject_reason IN ('singleton_missing_margin', 'low_support_or_margin') AND NOT margin_ok)::BIGINT AS rejected_by_margin, count_if(reject_reason = 'max_windows')::BIGINT AS trimmed_by_windows, count_if(reject_reason = 'max_bp')::BIGINT AS trimmed_by_bp,
    count_if(reject_reason = 'singleton_rescued' AND after_gate)::BIGINT AS rescued_windows, coalesce(sum(bp) FILTER (WHERE reject_reason = 'singleton_rescued' AND after_gate), 0)::BIGINT AS rescued_bp,
    count(DISTINCT task) FILTER (WHERE reject_reason = 'singleton_rescued' AND after_gate) AS rescued_tasks FROM gated),
  c2 AS (SELECT count_if(picked)::BIGINT AS fallback_tasks, count_if(n_kept > 0)::BIGINT AS nonempty_tasks, count_if(n_kept > 0 AND blocker = 'max_kept_windows')::BIGINT AS nonempty_by_max_kept, count_if(n_kept > 0 AND blocker = 'no_singleton_missing_margin')::BIGINT AS nonempty_by_no_singleton,
    count_if(n_kept > 0 AND blocker = 'singleton_override')::BIGINT AS nonempty_by_override, count_if(n_kept > 0 AND blocker = 'covered_by_kept')::BIGINT AS nonempty_covered, count_if(n_kept > 0 AND blocker = 'score_gap')::BIGINT AS nonempty_by_gap,
    count_if(n_kept > 0 AND picked)::BIGINT AS nonempty_fallback_tasks FROM ta),
  c3 AS (SELECT count(*) AS selected_windows, coalesce(sum(bp), 0)::BIGINT AS selected_bp FROM pick)
  SELECT * FROM c1, c2, c3""")
def all_gate_counters(spark, d):
    return P.all_counters(Q.trace(spark, d), T, Q.FALLBACK)


@query(Q.GATE + """, p AS (SELECT task % 16 AS tile, task, count(*) AS n0, count_if(after_gate) AS n1 FROM gated GROUP BY ALL)
  SELECT tile, count(*) AS tasks, count_if(n0 > 0)::BIGINT AS tasks_before, count_if(n1 > 0)::BIGINT AS tasks_after, sum(n0)::BIGINT AS windows_before, sum(n1)::BIGINT AS windows_after,
  'ok' AS status, count_if(n1 > 0) = 0 AS predicted_skip FROM p GROUP BY tile""")
def discovery_tiles(spark, d):
    return P.discovery(Q.trace(spark, d).withColumn("tile", F.col("task") % 16), T, ["tile"])


@query("""SELECT config, count(*) AS n, sum(wall)::DOUBLE / count(wall) AS mean_wall, min(wall)::DOUBLE AS min_wall, coalesce(sum(CASE WHEN recall > 99 THEN topk END)::DOUBLE / nullif(count(CASE WHEN recall > 99 THEN topk END), 0), 0) AS mean_rare,
  coalesce(min(CASE WHEN recall > 99 THEN topk END), 0)::DOUBLE AS min_rare FROM runs GROUP BY config""")
def metric_summaries(spark, d):
    r = bound(spark, d, "runs").withColumn("rare", F.when(F.col("recall") > 99, F.col("topk")))
    return P.metric_summary(r, ["config"], ["wall", "rare"])


@query("""SELECT 'every' AS side, count(score) AS n, min(score) AS least, max(score) AS largest, sum(score)::DOUBLE / count(score) AS mean FROM hits UNION ALL SELECT 'none', 0, NULL, NULL, NULL""")
def score_summaries(spark, d):
    h = bound(spark, d, "hits")
    side = lambda n, x: P.score_summary(x).select(F.lit(n).alias("side"), "n", "least", "largest", "mean")
    return side("every", h).unionByName(side("none", h.filter("score < -1")))


ROLL = Q.ATTRIBUTED + """, pt AS (SELECT task % 8 AS tile, class, count(*) AS n, sum(score) AS weight FROM att GROUP BY ALL),
  al AS (SELECT sum(n) AS all_n, sum(weight) AS all_w FROM pt), su AS (SELECT class, sum(n) AS n, sum(weight) AS w FROM pt GROUP BY class)"""
CLASSES = ["inside_kept", "inside_rejected", "near_kept", "far_outside"]


def _attributed(spark, d):
    return AT.attribute(Q.missing_hits(spark, d), Q.trace(spark, d), T, ["task", "line", "h0", "h1"], 12)


@query(ROLL + """ SELECT c AS class, coalesce(n, 0)::BIGINT AS n, coalesce(w, 0)::BIGINT AS weight, coalesce(n, 0)::DOUBLE / all_n::DOUBLE AS n_share, coalesce(w, 0)::DOUBLE / all_w::DOUBLE AS weight_share
  FROM (SELECT unnest(['inside_kept', 'inside_rejected', 'near_kept', 'far_outside']) AS c) LEFT JOIN su ON su.class = c, al""")
def panel_shares(spark, d):
    per = _attributed(spark, d).groupBy((F.col("task") % 8).alias("tile"), "class").agg(F.count("*").alias("n"), F.sum("score").alias("weight"))
    return P.panel_shares(per, CLASSES)


@query(ROLL + """ SELECT c AS class, coalesce(w, 0)::BIGINT AS weight, coalesce(w, 0)::DOUBLE / all_w::DOUBLE AS share_of_missing, coalesce(w, 0)::DOUBLE / (SELECT sum(score) FROM hits)::DOUBLE AS share_of_reference
  FROM (SELECT unnest(['inside_kept', 'inside_rejected', 'near_kept', 'far_outside']) AS c) LEFT JOIN su ON su.class = c, al""")
def class_weights(spark, d):
    return P.class_weights(_attributed(spark, d), CLASSES, bound(spark, d, "hits").agg(F.sum("score").alias("total")))


@query("""SELECT config, sum(wall)::BIGINT AS wall, sum(topk)::BIGINT AS topk, CASE WHEN min(l) IS NULL THEN 'disabled' WHEN min(l) = max(l) THEN min(l) ELSE 'mixed' END AS backend
  FROM (SELECT *, CASE recall % 3 WHEN 0 THEN NULL WHEN 1 THEN 'cpu' ELSE 'vector' END AS l FROM runs WHERE top_hit < 2) GROUP BY config""")
def metric_sums(spark, d):
    r = bound(spark, d, "runs").filter("top_hit < 2").withColumn("backend", F.when(F.col("recall") % 3 == 0, "disabled").when(F.col("recall") % 3 == 1, "cpu").otherwise("vector"))
    return P.metric_sums(r, ["config"], ["wall", "topk"], "backend")


@query("""SELECT CASE WHEN n <= 8192 THEN 'le_8192' WHEN n <= 65535 THEN 'le_65535' ELSE 'gt_65535' END AS bin, count(*) AS tasks, sum(n)::BIGINT AS bp FROM (SELECT length(text) AS n FROM documents WHERE text IS NOT NULL) GROUP BY 1""")
def target_length_bins(spark, d):
    return P.length_bins(Q.read(spark, d, "documents").filter("text is not null"), F.length("text"))


@query("""WITH h AS (SELECT file, score, md5(concat_ws('\t', CAST(task AS VARCHAR), CAST(line AS VARCHAR), CAST(score AS VARCHAR))) AS h FROM hits), k AS (SELECT file, score, ('0x' || substr(h, 1, 8))::BIGINT AS a, ('0x' || substr(h, 9, 8))::BIGINT AS b FROM h)
  SELECT file, count(*) AS n, min(score) AS least, sum(a)::BIGINT AS sum_a, sum(b)::BIGINT AS sum_b, bit_xor(a) AS xor_a, bit_xor(b) AS xor_b FROM k GROUP BY file""")
def frontier_digest(spark, d):
    return P.digest(bound(spark, d, "hits"), ["file"], ["task", "line", "score"], "score")


@query("""SELECT concat_ws('->', a, b) AS transition, count(*) AS n FROM (SELECT CASE recall % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'ordering_or_format_only' ELSE 'content_diff' END AS a,
  CASE top_hit % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'ordering_or_format_only' ELSE 'content_diff' END AS b FROM runs) GROUP BY 1""")
def class_transitions(spark, d):
    name = lambda c: F.when(F.col(c) % 3 == 0, "none").when(F.col(c) % 3 == 1, "ordering_or_format_only").otherwise("content_diff")
    r = bound(spark, d, "runs")
    return P.transitions(r.select("run", name("recall").alias("label")), r.select("run", name("top_hit").alias("label")), ["run"], "label")


@query(Q.GATE + """, g AS (SELECT task % 16 AS tile, count(DISTINCT task) FILTER (WHERE after_gate) AS inv, count(*) AS n0, count_if(after_gate) AS n1, sum(bp) FILTER (WHERE after_gate) AS bp1, sum(bp) AS bp0, count(DISTINCT task) AS all_tasks FROM gated GROUP BY 1)
  SELECT tile, all_tasks - inv > 0 AS skip_created, inv < all_tasks AS threshold_work_reduced, n1 < n0 AS window_work_reduced, bp1 < bp0 AS refine_bp_reduced FROM g""")
def gate_value(spark, d):
    t = Q.trace(spark, d).withColumn("tile", F.col("task") % 16)
    per = t.groupBy("tile").agg(
        F.count_distinct("task").alias("tasks"), F.count_distinct(F.when(F.col("after_gate"), F.col("task"))).alias("threshold_invoked"), F.count("*").alias("windows_before"), F.count_if("after_gate").alias("windows_after"),
        F.sum(F.when(F.col("after_gate"), F.col("bp"))).alias("refine_total_bp"), F.sum("bp").alias("bp0"),
    ).withColumn("skipped_after_gate", F.col("tasks") - F.col("threshold_invoked"))
    deferred = per.select("tile", F.col("tasks").alias("threshold_invoked"), F.col("bp0").alias("refine_total_bp"))
    return P.gate_value(deferred, per, ["tile"])


@query("""SELECT doc_id, CASE WHEN q <= 0 OR q > 8192 THEN 'query_gt_8192' WHEN t <= 0 THEN 'empty_target' WHEN t > 8192 THEN 'target_gt_8192' WHEN s < 0 THEN 'negative_min_score' ELSE 'eligible' END AS reason
  FROM (SELECT doc_id, (doc_id % 5) * 3000 AS q, length(coalesce(text, '')) AS t, doc_id % 7 - 1 AS s FROM documents)""")
def batch_reasons(spark, d):
    r = Q.read(spark, d, "documents")
    return r.select("doc_id", P.batch_reason((F.col("doc_id") % 5) * 3000, F.length(F.coalesce("text", F.lit(""))), F.col("doc_id") % 7 - 1).alias("reason"))


SECOND = """, q0 AS (SELECT *, best - second AS m, end_j - start_j + 1 AS bp, CASE WHEN best < 70 THEN 'x' WHEN NOT (support >= 2 OR coalesce(best - second >= 6, false) OR best >= 100) THEN 'x' ELSE 'kept' END AS r FROM windows),
  q1 AS MATERIALIZED (SELECT *, CASE WHEN r = 'kept' THEN row_number() OVER (PARTITION BY task, r = 'kept' ORDER BY """ + W1 + """) - 1 END AS k FROM q0),
  qf AS (SELECT task, k, CASE WHEN bp <= 60 THEN bp ELSE 0 END AS total, bp <= 60 AS taken FROM q1 WHERE k = 0
    UNION ALL SELECT q.task, q.k, CASE WHEN qf.total + q.bp <= 60 THEN qf.total + q.bp ELSE qf.total END, qf.total + q.bp <= 60 FROM qf JOIN q1 q ON q.task = qf.task AND q.k = qf.k + 1 AND q.k < 4),
  rescue AS MATERIALIZED (SELECT q1.*, coalesce(qf.taken, false) AS after_gate FROM q1 LEFT JOIN qf ON qf.task = q1.task AND qf.k = q1.k AND q1.k < 4),
  added AS MATERIALIZED (SELECT task, start_j, end_j, best, second, support FROM rescue WHERE after_gate EXCEPT SELECT task, start_j, end_j, best, second, support FROM gated WHERE after_gate)"""


def rescue_trace(spark, d):
    return G.gate(bound(spark, d, "windows"), T, RESCUE)


@query(Q.GATE + SECOND + " SELECT * FROM added")
def added_windows(spark, d):
    return P.added_windows(Q.trace(spark, d), rescue_trace(spark, d), T)


@query(Q.GATE + SECOND + """, mi AS (SELECT task, line, h0, h1 FROM hits WHERE (task * 7 + line) % 10 >= 8) SELECT DISTINCT task, line FROM mi SEMI JOIN added ON added.task = mi.task AND added.start_j <= mi.h0 AND added.end_j >= mi.h1""")
def rescued_hits(spark, d):
    added = P.added_windows(Q.trace(spark, d), rescue_trace(spark, d), T)
    return AT.containment_join(Q.missing_hits(spark, d), added, T, bin_size=64).select("task", "line").distinct()


@query(Q.GATE + SECOND + """ SELECT a.task, a.rule, a.strand, a.n AS n_base, b.n AS n_rescue FROM (SELECT task, rule, strand, count(*) AS n FROM gated GROUP BY ALL HAVING bool_or(after_gate)) a
  JOIN (SELECT task, rule, strand, count(*) AS n FROM rescue GROUP BY ALL) b ON b.task = a.task AND b.rule = a.rule AND b.strand = a.strand""")
def common_tasks(spark, d):
    return P.common_tasks(Q.trace(spark, d), rescue_trace(spark, d), ["task", "rule", "strand"])


@query(Q.MATCHED + """, x AS (SELECT *, CASE WHEN c IS NULL THEN 'missing_in_candidate' WHEN r IS NULL THEN 'missing_in_reference' WHEN abs(c - r) > 1e-6 THEN 'score_changed' END AS kind FROM m)
  SELECT kind, file, l_partkey, l_suppkey, line, strand, r AS ref_score, c AS cand_score, CAST(row_number() OVER (PARTITION BY kind ORDER BY file, l_partkey, l_suppkey, line, strand) AS INTEGER) AS nth FROM x WHERE kind IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY kind ORDER BY file, l_partkey, l_suppkey, line, strand) <= 10""")
def difference_examples(spark, d):
    return P.difference_examples(Q.pairs(spark, d), ["file", *Q.KEY]).select("kind", "file", *Q.KEY, "ref_score", "cand_score", "nth")


@query("""SELECT * FROM (VALUES ('same', 'none', true), ('reordered', 'ordering_or_format_only', true), ('other', 'content_diff', false)) t(pair, difference, tolerant_equal)""")
def difference_classes(spark, d):
    """The hits against themselves, against themselves in another order, and against the candidates."""
    h = bound(spark, d, "hits").withColumn("at", F.col("task") * 8 + F.col("line"))
    shuffled = h.withColumn("at", -F.col("at"))
    c = bound(spark, d, "candidates").withColumn("at", F.col("task") * 8 + F.col("line"))
    sides = [("same", h), ("reordered", shuffled), ("other", c)]
    out = [P.difference(h, x, ["task", "line", "l_partkey", "l_suppkey"], "at").select(F.lit(n).alias("pair"), "difference", "tolerant_equal") for n, x in sides]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(Q.FEATURES + """, low AS (SELECT task, count_if(x AND reject_reason = 'low_support_or_margin')::BIGINT AS n_low, coalesce(sum(bp) FILTER (WHERE x AND reject_reason = 'low_support_or_margin'), 0) AS low_bp FROM rej GROUP BY task),
  ent AS (SELECT task, CAST(round(greatest(log2(sum(n)) - sum(n * log2(n)) / sum(n), 0.0) * 1000) AS BIGINT) AS e FROM (SELECT task, rule, strand, count(*)::DOUBLE AS n FROM windows GROUP BY ALL) GROUP BY task),
  tr AS (SELECT f.*, low.n_low, low.low_bp, ent.e, f.task % 8 AS tile, row_number() OVER (PARTITION BY f.task % 8 ORDER BY best_rejected DESC NULLS LAST, f.task) AS by_best, row_number() OVER (PARTITION BY f.task % 8 ORDER BY score_x_bp DESC, best_rejected DESC NULLS LAST, f.task) AS by_mass,
    coalesce(score_gap, 1000000000000000000) AS gap, CASE WHEN best_rejected IS NULL THEN 1000000000000000000 ELSE -best_rejected END AS bst FROM feats f JOIN low ON low.task = f.task JOIN ent ON ent.task = f.task)
  SELECT task, CAST(row_number() OVER (PARTITION BY tile ORDER BY band_ge85 + band_80_84 + band_75_79 DESC, bst, gap, rejected_bp DESC, n_kept, task) AS INTEGER) AS sparse_gap,
  CAST(row_number() OVER (PARTITION BY tile ORDER BY n_low DESC, bin_support2 + bin_support3plus DESC, bst, gap, n_rejected DESC, rejected_bp DESC, task) AS INTEGER) AS support_pressure,
  CAST(row_number() OVER (PARTITION BY tile ORDER BY top3_sum DESC, score_x_bp DESC, gap, bst, by_best, by_mass, task) AS INTEGER) AS score_mass,
  CAST(row_number() OVER (PARTITION BY tile ORDER BY 2 * bin_support3plus + bin_support2 DESC, low_bp DESC, score_x_support DESC, e DESC, gap, by_mass, task) AS INTEGER) AS support_reason FROM tr""")
def task_orders(spark, d):
    cov = G.covered(Q.trace(spark, d), T)
    low = ~F.col("after_gate") & ~F.col("covered") & (F.col("reject_reason") == "low_support_or_margin")
    extra = cov.groupBy("task").agg(F.count_if(low).alias("n_low_support"), F.coalesce(F.sum(F.when(low, F.col("bp"))), F.lit(0)).alias("low_support_bp"))
    entropy = AT.entropy(bound(spark, d, "windows"), T, ["rule", "strand"]).select("task", F.round(F.col("entropy") * 1000).cast("bigint").alias("entropy_milli"))
    f = AT.task_features(cov, T).join(extra, "task").join(entropy, "task").withColumn("tile", F.col("task") % 8)
    w = Window.partitionBy("tile")
    f = f.withColumns({
        "by_best": F.row_number().over(w.orderBy(F.col("best_rejected").desc_nulls_last(), "task")), "by_mass": F.row_number().over(w.orderBy(F.col("score_x_bp").desc(), F.col("best_rejected").desc_nulls_last(), "task")),
    })
    for kind in ("sparse_gap", "support_pressure", "score_mass", "support_reason"):
        f = P.ranked_by(f, kind, ["tile"], f"o_{kind}")
    return f.select("task", *[F.col(f"o_{k}").alias(k) for k in ("sparse_gap", "support_pressure", "score_mass", "support_reason")])


@query(Q.ATTRIBUTED + """, tk AS (SELECT a.task, a.task % 8 AS tile, count_if(a.class = 'inside_rejected' AND a.line <= 2)::BIGINT AS mt, coalesce(sum(a.score) FILTER (WHERE a.class = 'inside_rejected'), 0)::BIGINT AS mw, count(*) AS n FROM att a GROUP BY a.task)
  SELECT task, CAST(row_number() OVER (PARTITION BY tile ORDER BY mt DESC, mw DESC, n DESC, tile, task) AS INTEGER) AS ambiguity, CAST(row_number() OVER (PARTITION BY tile ORDER BY mt DESC, n DESC, mw DESC, task % 5, tile, task) AS INTEGER) AS rescue_gain FROM tk""")
def rescue_orders(spark, d):
    a = _attributed(spark, d)
    inside = F.col("class") == "inside_rejected"
    t = a.groupBy("task").agg(F.count_if(inside & (F.col("line") <= 2)).alias("mt"), F.coalesce(F.sum(F.when(inside, F.col("score"))), F.lit(0)).alias("mw"), F.count("*").alias("n")).withColumn("tile", F.col("task") % 8)
    t = t.withColumns({"missing_top10": F.col("mt"), "missing_weight": F.col("mw"), "n_rejected": F.col("n"), "score_gap": F.lit(None).cast("bigint"), "top5_gain": F.col("mt"), "top10_gain": F.col("n"), "weight_gain": F.col("mw"), "added_bp": F.col("task") % 5})
    return P.ranked_by(P.ranked_by(t, "ambiguity", ["tile"], "ambiguity"), "rescue_gain", ["tile"], "rescue_gain").select("task", "ambiguity", "rescue_gain")


@query("""WITH c AS (SELECT config, topk, topk % 9 AS suppress_bp, sum(wall)::DOUBLE / count(*) AS mean_wall, min(top_hit) AS min_top_hit, min(recall) AS min_recall FROM runs GROUP BY ALL)
  SELECT config, topk, CAST(row_number() OVER (PARTITION BY config ORDER BY mean_wall, min_top_hit DESC, min_recall DESC, topk, suppress_bp) AS INTEGER) AS place,
  CAST(row_number() OVER (PARTITION BY config ORDER BY (min_recall > 5)::INT DESC, min_top_hit DESC, min_recall DESC, mean_wall, suppress_bp DESC, topk) AS INTEGER) AS candidate_place FROM c""")
def run_orders(spark, d):
    c = bound(spark, d, "runs").groupBy("config", "topk").agg(F.try_divide(F.sum("wall").cast("double"), F.count("*")).alias("mean_wall"), F.min("top_hit").alias("min_top_hit"), F.min("recall").alias("min_recall")).withColumn("suppress_bp", F.col("topk") % 9)
    c = c.withColumns({"passes": F.col("min_recall") > 5, "delta_top10": F.col("min_top_hit"), "delta_weighted": F.col("min_recall"), "delta_bp": F.col("mean_wall"), "jaccard": F.col("suppress_bp"), "name": F.col("topk")})
    return P.ranked_by(P.ranked_by(c, "configuration", ["config"]), "candidate", ["config"], "candidate_place").select("config", "topk", "place", "candidate_place")


@query(Q.GATE + """, p AS (SELECT task % 64 AS tile, task, count(*) AS n0, count_if(after_gate) AS n1, sum(best) AS h FROM gated GROUP BY ALL), t AS (SELECT tile, tile % 4 AS anchor, sum(n0) AS n0, sum(n1) AS n1, sum(h) AS h FROM p GROUP BY ALL)
  SELECT tile, CAST(row_number() OVER (PARTITION BY anchor ORDER BY (n1 = 0)::INT DESC, n0 - n1 DESC, n0 DESC, h DESC, tile) AS INTEGER) AS discovery, CAST(row_number() OVER (ORDER BY anchor, CAST(tile % 3 AS VARCHAR), tile % 5, tile) AS INTEGER) AS tile_place FROM t""")
def tile_orders(spark, d):
    t = Q.trace(spark, d).withColumn("tile", F.col("task") % 64)
    per = P.discovery(t, T, ["tile"]).join(t.groupBy("tile").agg(F.sum("best").alias("hits")), "tile")
    per = per.withColumns({"anchor": F.col("tile") % 4, "start_bp": F.col("tile"), "kind": (F.col("tile") % 3).cast("string"), "bucket_bp": F.col("tile") % 5, "nth": F.col("tile"), "end_bp": F.col("tile"), "path": F.lit("")})
    return P.ranked_by(P.ranked_by(per, "discovery", ["anchor"], "discovery"), "tile", [F.lit(1)], "tile_place").select("tile", "discovery", "tile_place")


@query("""SELECT task, start_j, end_j, best AS score FROM windows QUALIFY row_number() OVER (PARTITION BY task ORDER BY best DESC, start_j, end_j, ordinal) <= 2""")
def task_top_hits(spark, d):
    return P.first_per_task(bound(spark, d, "windows").select("task", "start_j", "end_j", F.col("best").alias("score")), T, 2)


@query("""SELECT doc_id, length(text) AS n, (row_number() OVER (PARTITION BY length(text) ORDER BY doc_id) - 1) // 2 AS batch FROM documents WHERE text IS NOT NULL""")
def equal_length_batches(spark, d):
    r = Q.read(spark, d, "documents").filter("text is not null").select("doc_id", F.length("text").cast("bigint").alias("n"))
    return P.length_batches(r, "n", "doc_id", 2)


@query("""SELECT user_id, count(*) AS calls, coalesce(sum((event_type = prev)::INT), 0)::BIGINT AS mergeable FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events) GROUP BY user_id""")
def mergeable_calls(spark, d):
    return P.mergeable_calls(Q.read(spark, d, "events"), ["user_id"], "event_id", ["event_type"])


# ---------------------------------------------------------------- scalar functions


@query("""SELECT l_orderkey, l_linenumber, list_filter([n // 2, n - n // 2], lambda x: x > 0) AS parts, n // 3 AS device, n % 3 AS slot, floor(l_quantity / 4 + 0.5)::BIGINT AS rounded,
  n::DOUBLE / (n % 13 + 1) AS density, n <= 65535 AND l_partkey <= 65535 AS fits, concat_ws('|', l_returnflag, CAST(l_linenumber AS VARCHAR), CAST(n AS VARCHAR)) AS tile_key, least(greatest(n, 5), 40) AS clamped
  FROM (SELECT *, l_partkey % 60 AS n FROM lineitem)""")
def number_functions(spark, d):
    r = Q.read(spark, d, "lineitem").withColumn("n", F.col("l_partkey") % 60)
    device, slot = P.workers(F.col("n"), 3)
    return r.select(
        "l_orderkey", "l_linenumber", P.bisected(F.col("n")).alias("parts"), device.alias("device"), slot.alias("slot"), X.half_up(F.col("l_quantity") / 4).alias("rounded"),
        X.density(F.col("n"), F.col("n") % 13 + 1).alias("density"), X.fits_16_bits(F.col("n"), F.col("l_partkey")).alias("fits"), X.tile_key("l_returnflag", "l_linenumber", "n").alias("tile_key"), X.clamped(F.col("n"), 5, 40).alias("clamped"),
    )


@query("""SELECT doc_id, replace(replace(replace(replace(replace(substr(coalesce(text, ''), 1, 20), '-', ''), ' ', '-'), 'e', '-'), '-', ''), 'x', '') AS stripped,
  CASE upper(substr(text, 1, 1)) WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 ELSE 4 END AS code, coalesce(list_extract([1, 15, 2, 12, 3, 13, 11, 8, 16, 6, 7, 6, 10, 4, 5, 14, 9, 17, 7], CAST(nullif(strpos('ABCDGHKMNPQRSTUVWXY', nullif(upper(substr(text, 1, 1)), '')), 0) AS INTEGER)), 0) AS iupac FROM documents""")
def base_functions(spark, d):
    first = F.substring("text", 1, 1)
    gapped = F.translate(F.translate(F.substring(F.coalesce("text", F.lit("")), 1, 20), " e", "--"), "x", "")
    return Q.read(spark, d, "documents").select("doc_id", S.strip_gaps(gapped).alias("stripped"), S.base_code(first).alias("code"), S.iupac_code(first).alias("iupac"))


@query("""SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k, coalesce(TRY_CAST(json_extract_string(props, '$.none') AS BIGINT), 7) AS none FROM events""")
def json_defaults(spark, d):
    return Q.read(spark, d, "events").select("event_id", X.json_value("props", "$.k", "bigint", -1).alias("k"), X.json_value("props", "$.none", "bigint", 7).alias("none"))


@query("""SELECT o_orderkey, [a, b] AS numbers FROM (SELECT o_orderkey, o_orderkey % 50 AS a, o_custkey AS b FROM orders)""")
def integer_lists(spark, d):
    o = Q.read(spark, d, "orders")
    return o.select("o_orderkey", X.integers(F.concat_ws(", ", (F.col("o_orderkey") % 50).cast("string"), F.col("o_custkey").cast("string")), 0).alias("numbers"))


# ---------------------------------------------------------------- filters and joins of hits

HITS_OF = """, h AS (SELECT task, ordinal, rule, strand, start_j AS query_start, end_j AS query_end, end_j - start_j + 1 AS nt, best AS score, CAST(45 + best % 40 AS FLOAT) AS identity, CAST(support AS FLOAT) / 2 AS stability FROM windows)"""


def _hits_of(spark, d):
    w = bound(spark, d, "windows")
    return w.select(
        "task", "ordinal", "rule", "strand", F.col("start_j").alias("query_start"), F.col("end_j").alias("query_end"), (F.col("end_j") - F.col("start_j") + 1).alias("nt"), F.col("best").alias("score"),
        (45 + F.col("best") % 40).cast("float").alias("identity"), (F.col("support").cast("float") / 2).cast("float").alias("stability"),
    )


@query("WITH " + HITS_OF[2:] + " SELECT task, ordinal, score FROM h WHERE score >= 70 AND identity >= 60 AND stability >= 1")
def quality_hits(spark, d):
    from ..operators import sequences as SQ

    return SQ.good_hits(_hits_of(spark, d), 70).select("task", "ordinal", "score")


@query("WITH " + HITS_OF[2:] + " SELECT task, ordinal, nt FROM h WHERE score >= 70 AND identity >= 60 AND stability >= 1 AND nt >= 12")
def fast_quality_hits(spark, d):
    from ..operators import sequences as SQ

    return SQ.good_hits(_hits_of(spark, d), 70, least_nt=12).select("task", "ordinal", "nt")


@query("WITH " + HITS_OF[2:] + " SELECT task, ordinal FROM h WHERE nt BETWEEN 10 AND 20")
def span_hits(spark, d):
    from .search import span_between

    return span_between(_hits_of(spark, d), 10, 20).select("task", "ordinal")


@query("WITH " + HITS_OF[2:] + " SELECT task, ordinal, score FROM h WHERE rule <= 2 UNION ALL SELECT task, ordinal, score FROM h WHERE rule >= 2")
def concatenated_hits(spark, d):
    h = _hits_of(spark, d).select("task", "ordinal", "score", "rule")
    return h.filter("rule <= 2").unionByName(h.filter("rule >= 2")).drop("rule")


@query("WITH " + HITS_OF[2:] + ", t AS (SELECT task, sum(score)::BIGINT AS a, min(nt) AS b FROM h GROUP BY task) SELECT task, a, b FROM t")
def matching_tiles(spark, d):
    from ..operators import compare as C

    h = _hits_of(spark, d)
    return C.require_same_keys(h.groupBy("task").agg(F.sum("score").alias("a")), h.groupBy("task").agg(F.min("nt").alias("b")), T)


@query("WITH " + HITS_OF[2:] + " SELECT task, ordinal, score FROM h WHERE nt > 14")
def clustered_candidates(spark, d):
    """Hits long enough to be clustered: those the clusterer gives a class."""
    from ..operators import coverage as COV

    h = _hits_of(spark, d).withColumn("midpoint", F.expr("(query_start + query_end) div 2"))
    return COV.clusters(h, ["task"], reach=15, length=14).filter("class > 0").select("task", "ordinal", "score")


@query("""WITH t AS (SELECT doc_id, 5000 AS n, (doc_id % 90 + 1)::INT AS a, (doc_id % 90 + 30)::INT AS b, (doc_id % 2)::INT AS r FROM documents)
  SELECT doc_id, CASE WHEN r = 1 THEN n - b + 1 ELSE a END AS s0, CASE WHEN r = 1 THEN n - a + 1 ELSE b END AS s1 FROM t""")
def mirrored_windows(spark, d):
    from .search import source_interval

    r = Q.read(spark, d, "documents")
    lo, hi = source_interval((F.col("doc_id") % 90 + 1).cast("int"), (F.col("doc_id") % 90 + 30).cast("int"), F.lit(5000), (F.col("doc_id") % 2).cast("int"))
    return r.select("doc_id", lo.alias("s0"), hi.alias("s1"))
