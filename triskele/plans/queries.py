"""Every relational operator bound to the driver tables, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scores as X
from ..functions import sequence as S
from ..operators import attribution as AT
from ..operators import compare as C
from ..operators import coverage as COV
from ..operators import frontier as FR
from ..operators import gate as G
from ..operators import replay as R
from ..operators import sequences as SQ
from ..operators import windows as W
from .bindings import bound, with_views

QUERIES: dict = {}
SQL: dict[str, str] = {}
T = ["task"]
KEY = ["l_partkey", "l_suppkey", "line", "strand"]
CONFIG = G.GateConfig(mode="v2", max_windows=3, max_bp=45)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql)
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def dna(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", S.only_bases(F.col("text")).alias("seq"))


DNA = "dna AS (SELECT doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents)"
FRAGS = DNA + """, frags AS (SELECT doc_id, CAST(s / 100 AS INTEGER) AS fragment_index, s AS fragment_start, substr(seq, s + 1, 120) AS fragment
  FROM (SELECT doc_id, seq, CAST(unnest(generate_series(0, length(seq) - 1, 100)) AS INTEGER) AS s FROM dna WHERE length(seq) > 0))"""


@query(f"WITH {FRAGS} SELECT doc_id, fragment_index, fragment_start, length(fragment) AS n, md5(fragment) AS h FROM frags")
def fragmenter(spark, d):
    return SQ.fragments(dna(spark, d), cut=120, overlap=20).select("doc_id", "fragment_index", "fragment_start", F.length("fragment").cast("bigint").alias("n"), F.md5(F.col("fragment").cast("binary")).alias("h"))


def _rule_values() -> str:
    rows = []
    for p, fwd, rev in ((1, S.PARALLEL_FORWARD, S.PARALLEL_REVERSE), (-1, S.ANTIPARALLEL_FORWARD, S.ANTIPARALLEL_REVERSE)):
        for k, (a, b) in enumerate(zip(fwd, rev), start=1):
            rows += [f"({p}, {k}, 0, '{a}')", f"({p}, {k}, 1, '{b}')"]
    return "rules AS (SELECT * FROM (VALUES " + ", ".join(rows) + ") t(parallel, rule, reverse, image))"


TASKS = f"""WITH {FRAGS}, {_rule_values()},
  live AS (SELECT * FROM frags WHERE NOT regexp_full_match(fragment, 'A*|C*|G*|T*')),
  tasks AS (SELECT *, CASE WHEN parallel = 1 THEN CASE WHEN reverse = 0 THEN 'ParaPlus' ELSE 'ParaMinus' END ELSE CASE WHEN reverse = 0 THEN 'AntiPlus' ELSE 'AntiMinus' END END AS strand,
    CASE WHEN reverse = 1 THEN reverse(translate(fragment, 'ATGCN', image)) ELSE translate(fragment, 'ATGCN', image) END AS target FROM live, rules)"""


@query(TASKS + " SELECT strand, rule, count(*) AS n, count(DISTINCT target) AS n_targets, sum(length(replace(target, 'T', '')))::BIGINT AS not_t FROM tasks GROUP BY 1, 2")
def task_enumeration(spark, d):
    t = SQ.tasks(SQ.fragments(dna(spark, d), cut=120, overlap=20))
    return t.groupBy("strand", "rule").agg(F.count("*").alias("n"), F.count_distinct("target").alias("n_targets"), F.sum(F.length(F.replace("target", F.lit("T"), F.lit("")))).alias("not_t"))


@query(TASKS + " SELECT doc_id, fragment_index, strand, rule, md5(target) AS h FROM tasks WHERE rule = 2 AND parallel = 1")
def rule_transform(spark, d):
    t = SQ.tasks(SQ.fragments(dna(spark, d), cut=120, overlap=20), rule=2, strand=1)
    return t.select("doc_id", "fragment_index", "strand", "rule", F.md5(F.col("target").cast("binary")).alias("h"))


@query(TASKS + """ SELECT doc_id, fragment_index, count(*) AS n FROM tasks SEMI JOIN (SELECT doc_id AS d, (doc_id % 6) + 1 AS r, parallel AS p FROM frags, (SELECT 1 AS parallel) q WHERE doc_id % 3 = 0) s
  ON tasks.doc_id = s.d AND tasks.rule = s.r AND tasks.parallel = s.p GROUP BY 1, 2""")
def selected_tasks(spark, d):
    t = SQ.tasks(SQ.fragments(dna(spark, d), cut=120, overlap=20))
    chosen = dna(spark, d).filter("doc_id % 3 = 0").select("doc_id", (F.col("doc_id") % 6 + 1).cast("int").alias("rule"), F.lit(1).alias("parallel"))
    return SQ.select_tasks(t, chosen, ["doc_id", "rule", "parallel"]).groupBy("doc_id", "fragment_index").agg(F.count("*").alias("n"))


@query(f"""WITH {DNA} SELECT doc_id, md5(reverse(seq)) AS rev, md5(translate(seq, 'ACGT', 'TGCA')) AS comp, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) AS revcomp,
  regexp_full_match(seq, 'A*|C*|G*|T*') AS homopolymer FROM dna""")
def source_transforms(spark, d):
    h = lambda c: F.md5(c.cast("binary"))
    s = F.col("seq")
    return dna(spark, d).select(
        "doc_id", h(S.source_transform(s, "reverse")).alias("rev"), h(S.source_transform(s, "complement")).alias("comp"), h(S.source_transform(s, "reverse_complement")).alias("revcomp"), S.is_homopolymer(s).alias("homopolymer")
    )


@query("""SELECT doc_id, md5(reverse(translate(regexp_replace(translate(text, 'acgtu', 'ACGTU'), '[^ACGTU]', 'N', 'g'), 'ACGTU', 'TGCAA'))) AS h FROM documents WHERE text IS NOT NULL""")
def rna_reverse_complement(spark, d):
    return read(spark, d, "documents").filter("text is not null").select("doc_id", F.md5(S.reverse_complement_rna(F.col("text")).cast("binary")).alias("h"))


@query("""SELECT p_partkey, s AS start FROM (SELECT p_partkey, unnest(CASE WHEN p_size * 10 <= 60 THEN [1::BIGINT]
  ELSE list_distinct(list_concat(generate_series(1::BIGINT, (p_size * 10 - 59)::BIGINT, 40::BIGINT), [(p_size * 10 - 59)::BIGINT])) END) AS s FROM part)""")
def tile_starts(spark, d):
    return read(spark, d, "part").select("p_partkey", F.explode(SQ.tile_starts(F.col("p_size").cast("bigint") * 10, 60, 40)).alias("start"))


@query("""SELECT task, ordinal, CASE WHEN a < b THEN 'R' ELSE 'L' END AS direction, least(a, b) + g - 1 AS start_in_genome, greatest(a, b) + g - 1 AS end_in_genome, (a + b) // 2 AS midpoint
  FROM (SELECT task, ordinal, CASE WHEN strand = 'R' THEN end_j ELSE start_j END AS a, CASE WHEN strand = 'R' THEN start_j ELSE end_j END AS b, task * 10 AS g FROM windows)""")
def genome_projection(spark, d):
    w = bound(spark, d, "windows")
    flip = F.col("strand") == "R"
    w = w.select("task", "ordinal", F.when(flip, F.col("end_j")).otherwise(F.col("start_j")).alias("start_in_seq"), F.when(flip, F.col("start_j")).otherwise(F.col("end_j")).alias("end_in_seq"), (F.col("task") * 10).alias("start_genome"))
    return SQ.genome_coordinates(w).select("task", "ordinal", "direction", "start_in_genome", "end_in_genome", "midpoint")


@query("""SELECT task, ordinal, greatest(end_j - greatest(least(trunc((best + 24.0) / (9 * 0.6::DOUBLE - 4) + 1.0)::BIGINT, end_j), 1) + 1, 1) AS seed_start, end_j AS seed_end FROM windows""")
def peak_seeds(spark, d):
    a, b = X.seed_interval(F.col("best"), F.col("end_j"))
    return bound(spark, d, "windows").select("task", "ordinal", a.alias("seed_start"), b.alias("seed_end"))


@query("""SELECT task, line, greatest(h0 - 8, 1) AS start_j, least(h1 + 8, 200) AS end_j, score AS best, 1::BIGINT AS support FROM hits WHERE greatest(h0 - 8, 1) <= least(h1 + 8, 200)""")
def padded_windows(spark, d):
    h = bound(spark, d, "hits").withColumnsRenamed({"h0": "start_j", "h1": "end_j"})
    return W.padded(h, 200, 8).select("task", "line", "start_j", "end_j", "best", "support")


MERGED = """WITH r AS (SELECT *, max(end_j) OVER (PARTITION BY task ORDER BY start_j, end_j, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM windows),
  g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_j > reach + 3 + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY task ORDER BY start_j, end_j, ordinal ROWS UNBOUNDED PRECEDING) AS part FROM r),
  merged AS (SELECT task, part, min(start_j) AS start_j, max(end_j) AS end_j, max(best) AS best, sum(support)::BIGINT AS support,
    list_reverse_sort(list_concat(list(best), list(second) FILTER (WHERE second IS NOT NULL))) AS v FROM g GROUP BY task, part)"""


@query(MERGED.replace("list_concat(list(best), list(second) FILTER (WHERE second IS NOT NULL))", "list_concat(list(best), coalesce(list(second) FILTER (WHERE second IS NOT NULL), []))") + " SELECT task, start_j, end_j, best, v[2] AS second, support FROM merged")
def merged_windows(spark, d):
    return W.merge(bound(spark, d, "windows"), T, gap=3).select("task", "start_j", "end_j", "best", "second", "support")


RANK = "row_number() OVER (PARTITION BY task ORDER BY best DESC, support DESC, best - second DESC NULLS LAST, start_j, end_j, ordinal) - 1"


@query(f"SELECT task, ordinal, CAST({RANK} AS INTEGER) AS rank FROM windows QUALIFY {RANK} < 3")
def top_windows(spark, d):
    return W.top(bound(spark, d, "windows"), T, 3).select("task", "ordinal", F.col("rank").cast("int").alias("rank"))


@query(f"""WITH RECURSIVE r AS (SELECT task, ordinal, {RANK} AS k, end_j - start_j + 1 AS bp FROM windows),
  f AS (SELECT task, ordinal, k, CASE WHEN bp <= 60 THEN bp ELSE 0 END AS total, bp <= 60 AS admitted FROM r WHERE k = 0
    UNION ALL SELECT r.task, r.ordinal, r.k, CASE WHEN f.total + r.bp <= 60 THEN f.total + r.bp ELSE f.total END, f.total + r.bp <= 60 FROM f JOIN r ON r.task = f.task AND r.k = f.k + 1)
  SELECT task, ordinal, admitted FROM f""")
def budget_fold(spark, d):
    r = W.ranked(bound(spark, d, "windows"), T).withColumn("bp", X.window_bp(F.col("start_j"), F.col("end_j")))
    return W.budget(r, T, 60).select("task", "ordinal", "admitted")


@query("""WITH RECURSIVE p AS (SELECT DISTINCT task, best AS score, start_j AS position FROM windows WHERE best > 65),
  o AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY score DESC, position) AS k FROM p),
  f AS (SELECT task, k, [position] AS kept FROM o WHERE k = 1
    UNION ALL SELECT o.task, o.k, CASE WHEN len(list_filter(f.kept, lambda x: abs(x - o.position) < 20)) > 0 THEN f.kept ELSE list_append(f.kept, o.position) END FROM f JOIN o ON o.task = f.task AND o.k = f.k + 1),
  l AS (SELECT task, arg_max(kept, k) AS kept FROM f GROUP BY task)
  SELECT p.task, p.position, max(p.score) AS score FROM l JOIN p ON p.task = l.task AND list_contains(l.kept, p.position) GROUP BY 1, 2""")
def peak_suppression(spark, d):
    return W.suppress(bound(spark, d, "windows").select("task", F.col("best").alias("score"), F.col("start_j").alias("position")), T, 20, floor=65)


@query("""WITH o AS (SELECT user_id, event_type, event_id, CAST(round(value * 100) AS BIGINT) AS v, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS position FROM events),
  m AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY position) THEN 0 ELSE 1 END AS fresh FROM o),
  r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY position ROWS UNBOUNDED PRECEDING) AS run FROM m)
  SELECT user_id, event_type, min(position) AS first, max(position) AS last, count(*) AS n, max(v) AS peak, (list(position ORDER BY v DESC, position))[1] AS peak_at FROM r GROUP BY user_id, run, event_type""")
def event_islands(spark, d):
    e = read(spark, d, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = e.select("user_id", "event_type", F.round(F.col("value") * 100).cast("bigint").alias("v"), F.row_number().over(order).cast("bigint").alias("position"))
    return W.islands(e, ["user_id"], "position", 1, ["event_type"], "v").select("user_id", "event_type", "first", "last", "n", "peak", "peak_at")


@query("""WITH RECURSIVE o AS (SELECT task, start_j, end_j, best AS score, row_number() OVER (PARTITION BY task ORDER BY start_j, end_j, best DESC) AS k FROM windows),
  f AS (SELECT task, k, start_j AS a, end_j AS b, score AS s, true AS kept, start_j, end_j, score FROM o WHERE k = 1
    UNION ALL SELECT o.task, o.k, CASE WHEN i THEN a ELSE o.start_j END, CASE WHEN i THEN b ELSE o.end_j END, CASE WHEN i THEN s ELSE o.score END, NOT i, o.start_j, o.end_j, o.score
    FROM (SELECT f.*, o2.start_j AS x, o2.end_j AS y, o2.score AS z, (f.a <= o2.start_j AND f.b >= o2.end_j AND f.s >= o2.score) AS i FROM f JOIN o o2 ON o2.task = f.task AND o2.k = f.k + 1) q JOIN o ON o.task = q.task AND o.k = q.k + 1)
  SELECT task, start_j, end_j, score FROM f WHERE kept""")
def neighbour_dedupe(spark, d):
    return W.drop_neighbours(bound(spark, d, "windows").withColumnRenamed("best", "score"), T)


@query("""SELECT task, start_j, max(best) AS score, (list(end_j ORDER BY best DESC, ordinal))[1] AS end_i, min(end_j) AS top, max(end_j) AS bottom FROM windows GROUP BY 1, 2""")
def candidate_boxes(spark, d):
    r = bound(spark, d, "windows").select("task", "start_j", F.col("best").alias("score"), "ordinal", F.col("end_j").alias("end_i"), F.col("start_j").alias("score_end_j"), F.col("start_j").alias("min_end_j"), F.col("end_j").alias("max_end_j"))
    return W.candidate_states(r, ["task", "start_j"]).select("task", "start_j", "score", "end_i", "top", "bottom")


@query("SELECT task, sum(end_j - start_j + 1)::BIGINT AS bp FROM windows GROUP BY 1")
def window_bp_totals(spark, d):
    return W.total_bp(bound(spark, d, "windows"), T)


GATE = f"""WITH RECURSIVE b AS (SELECT *, best - second AS m, end_j - start_j + 1 AS bp, best >= 80 AS peak_ok, support >= 2 AS support_ok, coalesce(best - second >= 6, false) AS margin_ok, best >= 100 AS strong_ok FROM windows),
  r0 AS (SELECT *, CASE WHEN NOT peak_ok THEN 'min_peak_score' WHEN NOT (support_ok OR margin_ok OR strong_ok) THEN CASE WHEN support = 1 AND second IS NULL THEN 'singleton_missing_margin' ELSE 'low_support_or_margin' END ELSE 'kept' END AS r FROM b),
  r1 AS (SELECT * REPLACE (CASE WHEN r = 'singleton_missing_margin' AND best >= 85 AND row_number() OVER (PARTITION BY task, (r = 'singleton_missing_margin' AND best >= 85) ORDER BY best DESC, ordinal) = 1 THEN 'singleton_rescued' ELSE r END AS r) FROM r0),
  r2 AS (SELECT *, CASE WHEN r IN ('kept', 'singleton_rescued') THEN row_number() OVER (PARTITION BY task, r IN ('kept', 'singleton_rescued') ORDER BY best DESC, support DESC, m DESC NULLS LAST, start_j, end_j, ordinal) - 1 END AS k FROM r1),
  r3 AS MATERIALIZED (SELECT * REPLACE (CASE WHEN k >= 3 THEN 'max_windows' ELSE r END AS r) FROM r2),
  f AS (SELECT task, k, CASE WHEN bp <= 45 THEN bp ELSE 0 END AS total, bp <= 45 AS taken FROM r3 WHERE k = 0
    UNION ALL SELECT q.task, q.k, CASE WHEN f.total + q.bp <= 45 THEN f.total + q.bp ELSE f.total END, f.total + q.bp <= 45 FROM f JOIN r3 q ON q.task = f.task AND q.k = f.k + 1 AND q.k < 3),
  gated AS MATERIALIZED (SELECT r3.* EXCLUDE (r), coalesce(f.taken, false) AS after_gate, CASE WHEN f.taken = false THEN 'max_bp' ELSE r3.r END AS reject_reason FROM r3 LEFT JOIN f ON f.task = r3.task AND f.k = r3.k AND r3.k < 3),
  inner_ AS (SELECT DISTINCT g.task, g.ordinal FROM gated g JOIN gated k ON k.task = g.task AND k.after_gate AND k.start_j <= g.start_j AND k.end_j >= g.end_j WHERE NOT g.after_gate),
  cov AS MATERIALIZED (SELECT g.*, i.ordinal IS NOT NULL AS covered FROM gated g LEFT JOIN inner_ i ON i.task = g.task AND i.ordinal = g.ordinal),
  st AS MATERIALIZED (SELECT *, sum(after_gate::INT) OVER (PARTITION BY task) AS n_kept, max(CASE WHEN after_gate THEN best END) OVER (PARTITION BY task) AS best_kept,
    NOT after_gate AND reject_reason = 'singleton_missing_margin' AND support = 1 AND second IS NULL AS single FROM cov),
  s2 AS (SELECT *, single AND best >= 85 AS qual, single AND best >= 85 AND NOT covered AS opn,
    CASE WHEN n_kept = 0 THEN single AND best >= 85 ELSE single AND best >= 85 AND NOT covered AND best_kept - best <= 6 AND n_kept <= 2 END AS near FROM st)"""


def trace(spark, d) -> DataFrame:
    return G.gate(bound(spark, d, "windows"), T, CONFIG)


@query(GATE + " SELECT task, ordinal, after_gate, reject_reason, CAST(k AS INTEGER) AS sorted_rank FROM gated")
def window_gate(spark, d):
    return trace(spark, d).select("task", "ordinal", "after_gate", "reject_reason", F.col("sorted_rank").cast("int").alias("sorted_rank"))


@query(GATE + """ SELECT count(*) AS before_gate, count_if(after_gate)::BIGINT AS after_gate, count_if(reject_reason = 'min_peak_score')::BIGINT AS by_peak,
  count_if(reject_reason IN ('singleton_missing_margin', 'low_support_or_margin') AND NOT support_ok)::BIGINT AS by_support, count_if(reject_reason IN ('singleton_missing_margin', 'low_support_or_margin') AND NOT margin_ok)::BIGINT AS by_margin,
  count_if(reject_reason = 'max_windows')::BIGINT AS by_max_windows, count_if(reject_reason = 'max_bp')::BIGINT AS by_max_bp, count_if(reject_reason = 'singleton_rescued' AND after_gate)::BIGINT AS rescued FROM gated""")
def gate_counters(spark, d):
    return G.counters(trace(spark, d))


FALLBACK = G.FallbackConfig(max_kept=2, max_gap=6)


@query(GATE + """, pick AS (SELECT task, ordinal FROM s2 WHERE near QUALIFY row_number() OVER (PARTITION BY task ORDER BY best DESC, support DESC, m DESC NULLS LAST, start_j, end_j, ordinal) = 1)
  SELECT s2.task, s2.ordinal, after_gate OR pick.ordinal IS NOT NULL AS after_gate, pick.ordinal IS NOT NULL AS selected, CASE WHEN pick.ordinal IS NOT NULL THEN 'selective_fallback' ELSE reject_reason END AS reject_reason
  FROM s2 LEFT JOIN pick ON pick.task = s2.task AND pick.ordinal = s2.ordinal""")
def selective_fallback(spark, d):
    return G.selective_fallback(trace(spark, d), T, FALLBACK).select("task", "ordinal", "after_gate", F.col("selective_fallback_selected").alias("selected"), "reject_reason")


@query(GATE + """ SELECT task, CASE WHEN max(n_kept) = 0 THEN 'empty_after_gate' WHEN max(n_kept) > 2 THEN 'max_kept_windows' WHEN bool_or(near) THEN 'selected' WHEN NOT bool_or(single) THEN 'no_singleton_missing_margin'
  WHEN NOT bool_or(qual) THEN 'singleton_override' WHEN NOT bool_or(opn) THEN 'covered_by_kept' ELSE 'score_gap' END AS blocker, max(n_kept)::BIGINT AS n_kept, sum((NOT after_gate)::INT)::BIGINT AS n_rejected FROM s2 GROUP BY task""")
def task_blockers(spark, d):
    return G.blockers(trace(spark, d), T, FALLBACK)


@query(GATE + """ SELECT task, sum((NOT after_gate)::INT)::BIGINT AS added_windows, sum(CASE WHEN after_gate THEN 0 ELSE bp END)::BIGINT AS added_bp, sum((NOT after_gate)::INT) > 0 AS upgraded FROM gated WHERE task % 4 = 1 GROUP BY task""")
def rerun_upgrade(spark, d):
    t = trace(spark, d)
    return G.rerun_upgrade(t, t.filter("task % 4 = 1"), T)


@query(GATE + """ SELECT task, ordinal, CASE WHEN best < 85 THEN 'score_lt_85' WHEN support = 1 AND second IS NOT NULL THEN 'support1_margin_present' WHEN support = 2 THEN 'support2'
  WHEN support >= 3 AND reject_reason = 'low_support_or_margin' THEN 'support3plus_low_support_or_margin' ELSE 'other' END AS class,
  CASE WHEN best < 85 THEN CASE WHEN best >= 80 THEN '80_84' WHEN best >= 75 THEN '75_79' ELSE 'lt_75' END END AS band85, CASE WHEN best < 75 THEN CASE WHEN best >= 70 THEN '70_74' WHEN best >= 65 THEN '65_69' ELSE 'lt_65' END END AS band75
  FROM gated WHERE NOT after_gate""")
def window_classes(spark, d):
    b = AT.score_lt_bands()
    return trace(spark, d).filter("not after_gate").select("task", "ordinal", AT.window_class().alias("class"), b["band85"].alias("band85"), b["band75"].alias("band75"))


MATCHED = """WITH a AS (SELECT file, l_partkey, l_suppkey, line, strand, max(score) AS r FROM hits GROUP BY ALL), b AS (SELECT file, l_partkey, l_suppkey, line, strand, max(score) AS c FROM candidates GROUP BY ALL),
  m AS (SELECT * FROM a FULL JOIN b USING (file, l_partkey, l_suppkey, line, strand))"""


def pairs(spark, d) -> DataFrame:
    return C.matched(bound(spark, d, "hits"), bound(spark, d, "candidates"), KEY, ["file"])


@query("SELECT l_partkey, l_suppkey, line, strand, max(score) AS score FROM hits GROUP BY ALL")
def key_scores(spark, d):
    return C.best_scores(bound(spark, d, "hits"), KEY)


@query(MATCHED + """, s AS (SELECT file, count(r) AS n_ref, count(c) AS n_cand, count_if(r IS NOT NULL AND c IS NOT NULL) AS n_both FROM m GROUP BY file)
  SELECT file, n_ref, n_cand, n_both::BIGINT AS n_both, coalesce(n_both::DOUBLE / nullif(n_cand, 0), 0) AS precision, coalesce(n_both::DOUBLE / nullif(n_ref, 0), 0) AS recall, coalesce(n_both::DOUBLE / nullif(n_ref + n_cand - n_both, 0), 1) AS jaccard FROM s""")
def set_comparison(spark, d):
    return C.set_metrics(pairs(spark, d), ["file"])


@query(MATCHED + """, x AS (SELECT *, (c IS NOT NULL)::INT AS kept, max(r) OVER (PARTITION BY file) AS top, row_number() OVER (PARTITION BY file ORDER BY r DESC, l_partkey, l_suppkey, line, strand) AS k FROM m WHERE r IS NOT NULL)
  SELECT file, sum(kept * (r = top)::INT)::DOUBLE / sum((r = top)::INT) AS top_hit_retention, sum(kept * (k <= 5)::INT)::DOUBLE / sum((k <= 5)::INT) AS top5_retention, sum(kept * (k <= 100)::INT)::DOUBLE / sum((k <= 100)::INT) AS top100_retention,
  sum(r * kept)::DOUBLE / sum(r)::DOUBLE AS weighted_recall FROM x GROUP BY file""")
def retention(spark, d):
    return C.retention(pairs(spark, d), KEY, [5, 100], ["file"])


@query(MATCHED + """, x AS (SELECT file, c - r AS d FROM m) SELECT file, count(d) AS matched, count_if(d <> 0)::BIGINT AS changed, min(d) AS min_delta, max(d) AS max_delta, sum(d)::DOUBLE / count(d) AS mean_delta,
  count_if(d > 0)::BIGINT AS positive, count_if(d < 0)::BIGINT AS negative, count_if(d = 0)::BIGINT AS zero FROM x GROUP BY file""")
def score_changes(spark, d):
    return C.score_changes(pairs(spark, d), ["file"])


@query("""SELECT l_partkey, l_suppkey, line, strand, max(score) AS score FROM hits ANTI JOIN candidates USING (l_partkey, l_suppkey, line, strand) GROUP BY ALL""")
def missing_keys(spark, d):
    return C.missing(bound(spark, d, "hits"), bound(spark, d, "candidates"), KEY)


@query("SELECT l_partkey, strand FROM hits UNION SELECT l_partkey, strand FROM candidates")
def key_union(spark, d):
    return bound(spark, d, "hits").select("l_partkey", "strand").union(bound(spark, d, "candidates").select("l_partkey", "strand")).distinct()


@query("SELECT l_partkey, l_suppkey, score FROM hits INTERSECT SELECT l_partkey, l_suppkey, score FROM candidates")
def key_intersection(spark, d):
    return bound(spark, d, "hits").select("l_partkey", "l_suppkey", "score").intersect(bound(spark, d, "candidates").select("l_partkey", "l_suppkey", "score"))


@query("""WITH h AS (SELECT l_partkey, l_suppkey, line, score FROM hits), c AS (SELECT l_partkey, l_suppkey, line, score FROM candidates)
  SELECT a AS only_a, b AS only_b, CASE WHEN a = 0 AND b = 0 THEN 'none' ELSE 'content_diff' END AS difference FROM (SELECT count(*) AS a FROM (SELECT * FROM h EXCEPT ALL SELECT * FROM c)), (SELECT count(*) AS b FROM (SELECT * FROM c EXCEPT ALL SELECT * FROM h))""")
def difference_class(spark, d):
    cols = ["l_partkey", "l_suppkey", "line", "score"]
    return C.difference_class(bound(spark, d, "hits").select(*cols), bound(spark, d, "candidates").select(*cols))


@query(MATCHED + """, s AS (SELECT strand, count(r) AS a, count(c) AS b, count_if(r IS NOT NULL AND c IS NOT NULL) AS x FROM m GROUP BY strand)
  SELECT strand, CASE WHEN b = 0 THEN 1.0::DOUBLE ELSE x::DOUBLE / b END AS precision, CASE WHEN a = 0 THEN 1.0::DOUBLE ELSE x::DOUBLE / a END AS recall, CASE WHEN a + b - x = 0 THEN 1.0::DOUBLE ELSE x::DOUBLE / (a + b - x) END AS jaccard FROM s""")
def set_overlap(spark, d):
    return C.overlap(pairs(spark, d), ["strand"])


@query("SELECT l_partkey, l_suppkey, line, strand, score, CAST(row_number() OVER (PARTITION BY strand ORDER BY score DESC, l_partkey, l_suppkey, line) AS INTEGER) AS nth FROM (SELECT l_partkey, l_suppkey, line, strand, max(score) AS score FROM hits GROUP BY ALL) QUALIFY nth <= 10")
def key_ranking(spark, d):
    order = Window.partitionBy("strand").orderBy(F.col("score").desc(), "l_partkey", "l_suppkey", "line")
    return C.best_scores(bound(spark, d, "hits"), KEY).withColumn("nth", F.row_number().over(order)).filter("nth <= 10")


@query("WITH h AS (SELECT file, sha256(concat_ws(chr(9), task, line, score)) AS x FROM hits), p AS (SELECT file, " + ", ".join(f"sum(('0x' || substr(x, {8 * k + 1}, 8))::BIGINT)::VARCHAR AS s{k}" for k in range(8)) + """, count(*) AS n_rows FROM h GROUP BY file)
  SELECT file, sha256(concat_ws(',', s0, s1, s2, s3, s4, s5, s6, s7, n_rows::VARCHAR)) AS content_sha256, n_rows FROM p""")
def content_hash(spark, d):
    return C.content_hash(bound(spark, d, "hits"), ["task", "line", "score"], ["file"])


@query("SELECT n_name, sha256(string_agg(x || chr(10), '' ORDER BY k)) AS raw_sha256 FROM (SELECT n_name, s_suppkey AS k, s_name || chr(9) || s_suppkey AS x FROM supplier JOIN nation ON s_nationkey = n_nationkey) GROUP BY n_name")
def raw_hash(spark, d):
    s = read(spark, d, "supplier").join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return C.raw_hash(s.select("n_name", "s_suppkey", F.concat_ws("\t", "s_name", F.col("s_suppkey").cast("string")).alias("x")), "x", ["s_suppkey"], ["n_name"])


HITLESS = GATE + """, miss AS (SELECT task, line, h0, h1, score FROM hits WHERE (task * 7 + line) % 10 >= 8)"""


def missing_hits(spark, d) -> DataFrame:
    return bound(spark, d, "hits").filter("(task * 7 + line) % 10 >= 8").select("task", "line", "h0", "h1", "score")


@query(HITLESS + """ SELECT m.task, m.line, g.ordinal, g.after_gate FROM miss m JOIN gated g ON g.task = m.task AND g.start_j <= m.h0 AND g.end_j >= m.h1""")
def containment_join(spark, d):
    return AT.containment_join(missing_hits(spark, d), trace(spark, d), T, bin_size=64).select("task", "line", "ordinal", "after_gate")


ATTRIBUTED = HITLESS + """, att AS (SELECT ms.*, CASE WHEN EXISTS (SELECT 1 FROM gated g WHERE g.task = ms.task AND g.after_gate AND g.start_j <= ms.h0 AND g.end_j >= ms.h1) THEN 'inside_kept'
  WHEN EXISTS (SELECT 1 FROM gated g WHERE g.task = ms.task AND NOT g.after_gate AND g.start_j <= ms.h0 AND g.end_j >= ms.h1) THEN 'inside_rejected'
  WHEN (SELECT min(greatest(g.start_j - ms.h1, ms.h0 - g.end_j, 0)) FROM gated g WHERE g.task = ms.task AND g.after_gate) <= 12 THEN 'near_kept' ELSE 'far_outside' END AS class,
  (SELECT min(greatest(g.start_j - ms.h1, ms.h0 - g.end_j, 0)) FROM gated g WHERE g.task = ms.task AND g.after_gate) AS distance FROM miss ms)"""


@query(ATTRIBUTED + " SELECT task, line, distance, class FROM att")
def missing_hit_classes(spark, d):
    return AT.attribute(missing_hits(spark, d), trace(spark, d), T, ["task", "line", "h0", "h1"], 12).select("task", "line", "distance", "class")


@query(ATTRIBUTED + """ SELECT c AS class, coalesce(n, 0) AS n, coalesce(w, 0)::BIGINT AS weight, coalesce(n, 0)::DOUBLE / t.n_all AS n_share, coalesce(w, 0)::DOUBLE / t.w_all::DOUBLE AS weight_share
  FROM (SELECT unnest(['inside_kept', 'inside_rejected', 'near_kept', 'far_outside']) AS c) LEFT JOIN (SELECT class, count(*) AS n, sum(score) AS w FROM att GROUP BY class) q ON q.class = c, (SELECT count(*) AS n_all, sum(score) AS w_all FROM att) t""")
def class_shares(spark, d):
    a = AT.attribute(missing_hits(spark, d), trace(spark, d), T, ["task", "line", "h0", "h1"], 12)
    return AT.class_shares(a, ["inside_kept", "inside_rejected", "near_kept", "far_outside"])


@query(HITLESS + """ SELECT m.task, m.line, g.ordinal, g.best FROM miss m JOIN gated g ON g.task = m.task AND NOT g.after_gate AND g.start_j <= m.h0 AND g.end_j >= m.h1
  QUALIFY row_number() OVER (PARTITION BY m.task, m.line ORDER BY g.best DESC, g.support DESC, g.m DESC NULLS LAST, g.start_j, g.end_j, g.ordinal) = 1""")
def strongest_rejected(spark, d):
    return AT.strongest_rejected(missing_hits(spark, d), trace(spark, d), T, ["task", "line"]).select("task", "line", "ordinal", "best")


FEATURES = GATE + """, rej AS (SELECT *, NOT after_gate AND NOT covered AS x FROM cov), ft AS (SELECT task, count_if(after_gate)::BIGINT AS n_kept, count_if(x)::BIGINT AS n_rejected, coalesce(sum(bp) FILTER (WHERE x), 0)::BIGINT AS rejected_bp,
  coalesce(max(bp) FILTER (WHERE x), 0)::BIGINT AS max_rejected_bp, max(best) FILTER (WHERE after_gate) AS best_kept, max(best) FILTER (WHERE x) AS best_rejected, coalesce(sum(best) FILTER (WHERE x), 0)::BIGINT AS score_sum,
  coalesce(list_sum((list(best ORDER BY best DESC) FILTER (WHERE x))[1:3]), 0)::BIGINT AS top3_sum, coalesce(sum(best * bp) FILTER (WHERE x), 0)::BIGINT AS score_x_bp, coalesce(sum(best * support) FILTER (WHERE x), 0)::BIGINT AS score_x_support,
  count_if(x AND best >= 85)::BIGINT AS band_ge85, count_if(x AND best BETWEEN 80 AND 84)::BIGINT AS band_80_84, count_if(x AND best BETWEEN 75 AND 79)::BIGINT AS band_75_79, count_if(x AND best BETWEEN 70 AND 74)::BIGINT AS band_70_74, count_if(x AND best < 70)::BIGINT AS band_lt70,
  count_if(x AND support <= 1)::BIGINT AS bin_support1, count_if(x AND support = 2)::BIGINT AS bin_support2, count_if(x AND support >= 3)::BIGINT AS bin_support3plus, count(DISTINCT reject_reason) FILTER (WHERE x) AS n_reasons FROM rej GROUP BY task),
  feats AS (SELECT *, best_kept - best_rejected AS score_gap FROM ft)"""


def features(spark, d) -> DataFrame:
    return AT.task_features(G.covered(trace(spark, d), T), T)


@query(FEATURES + " SELECT * FROM feats")
def task_features(spark, d):
    return features(spark, d)


@query("""WITH c AS (SELECT task, rule, strand, count(*)::DOUBLE AS n FROM windows GROUP BY ALL) SELECT task, CAST(round(greatest(log2(sum(n)) - sum(n * log2(n)) / sum(n), 0.0) * 1e6) AS BIGINT) AS entropy_ppm FROM c GROUP BY task""")
def rule_entropy(spark, d):
    return AT.entropy(bound(spark, d, "windows"), T, ["rule", "strand"]).select("task", F.round(F.col("entropy") * 1e6).cast("bigint").alias("entropy_ppm"))


@query(FEATURES + """ SELECT task, CAST(row_number() OVER (PARTITION BY task % 16 ORDER BY best_rejected DESC NULLS LAST, task) AS INTEGER) AS by_best, CAST(row_number() OVER (PARTITION BY task % 16 ORDER BY score_x_bp DESC, best_rejected DESC NULLS LAST, task) AS INTEGER) AS by_mass FROM feats""")
def tile_ranks(spark, d):
    f = features(spark, d).withColumn("tile", F.col("task") % 16)
    w = Window.partitionBy("tile")
    return f.select("task", F.row_number().over(w.orderBy(F.col("best_rejected").desc_nulls_last(), "task")).alias("by_best"), F.row_number().over(w.orderBy(F.col("score_x_bp").desc(), F.col("best_rejected").desc_nulls_last(), "task")).alias("by_mass"))


@query(FEATURES + """, r AS (SELECT task % 8 AS tile, n_rejected, rejected_bp, row_number() OVER (PARTITION BY task % 8 ORDER BY n_kept, coalesce(score_gap, 1000000000000000000), rejected_bp, task) AS k FROM feats)
  SELECT tile, b AS budget, count(*) AS n_tasks, sum(n_rejected)::BIGINT AS n_rejected, sum(rejected_bp)::BIGINT AS rejected_bp FROM r, (SELECT unnest([1, 8, 64]) AS b) WHERE k <= b GROUP BY ALL""")
def budget_prefixes(spark, d):
    f = features(spark, d).withColumn("tile", F.col("task") % 8)
    r = f.withColumn("k", F.row_number().over(Window.partitionBy("tile").orderBy(*AT.deployable_order("sparse_gap"))))
    return AT.prefix_coverage(r, [1, 8, 64], ["tile"], "k", ["n_rejected", "rejected_bp"])


@query(FEATURES + """ SELECT task, CAST(row_number() OVER (PARTITION BY task % 8 ORDER BY bin_support3plus DESC, bin_support2 DESC, coalesce(score_gap, 1000000000000000000), task) AS INTEGER) AS pressure,
  CAST(row_number() OVER (PARTITION BY task % 8 ORDER BY score_x_bp DESC, coalesce(score_gap, 1000000000000000000), task) AS INTEGER) AS mass FROM feats""")
def deployable_orders(spark, d):
    f = features(spark, d).withColumn("tile", F.col("task") % 8)
    w = Window.partitionBy("tile")
    return f.select("task", F.row_number().over(w.orderBy(*AT.deployable_order("support_pressure"))).alias("pressure"), F.row_number().over(w.orderBy(*AT.deployable_order("score_mass"))).alias("mass"))


@query("""WITH i AS (SELECT l_returnflag AS flag, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS lo, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) + l_linenumber AS hi FROM lineitem),
  s AS (SELECT flag, pos, sum(d) AS d FROM (SELECT flag, lo AS pos, 1 AS d FROM i WHERE lo < hi UNION ALL SELECT flag, hi, -1 FROM i WHERE lo < hi) GROUP BY flag, pos HAVING sum(d) <> 0)
  SELECT flag, pos - 1 + 1000 AS first, nx - 1 + 1000 AS last, depth::BIGINT AS depth FROM (SELECT flag, pos, lead(pos) OVER (PARTITION BY flag ORDER BY pos) AS nx, sum(d) OVER (PARTITION BY flag ORDER BY pos ROWS UNBOUNDED PRECEDING) AS depth FROM s) WHERE nx IS NOT NULL""")
def coverage_runs(spark, d):
    li = read(spark, d, "lineitem")
    lo = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("bigint")
    return COV.depth_runs(li.select(F.col("l_returnflag").alias("flag"), lo.alias("lo"), (lo + F.col("l_linenumber")).alias("hi")), ["flag"], shift=1000)


@query("""WITH c AS (SELECT strand, (start_j + end_j) // 2 AS mid, count(*) AS n FROM windows GROUP BY ALL) SELECT strand, mid + i AS position, sum((15 - abs(i)) * n)::BIGINT AS density FROM c, (SELECT unnest(generate_series(-15, 15)) AS i) WHERE i <> 0 GROUP BY ALL""")
def midpoint_density(spark, d):
    return COV.density(bound(spark, d, "windows").select("strand", F.expr("(start_j + end_j) div 2").alias("midpoint")), ["strand"], 15)


@query()
def density_clusters(spark, d):
    w = bound(spark, d, "windows").select((F.col("task") % 64).alias("seq"), (F.col("task") * 64 + F.col("ordinal")).alias("ordinal"), F.expr("(start_j + end_j) div 2").alias("midpoint"), (F.col("end_j") - F.col("start_j") + 1).alias("nt"))
    return COV.clusters(w, ["seq"], reach=15, length=10).select("seq", "ordinal", "class", "center")


@query("SELECT config, count(*) AS n, min(wall) AS min_wall, max(wall) AS max_wall, sum(wall)::DOUBLE / count(*) AS mean_wall, min(recall) AS min_recall, max(recall) AS max_recall, sum(recall)::DOUBLE / count(*) AS mean_recall FROM runs GROUP BY config")
def frontier_summary(spark, d):
    return FR.summary(bound(spark, d, "runs"), ["config"], ["wall", "recall"])


@query("SELECT config, top_hit, recall, run FROM runs QUALIFY row_number() OVER (PARTITION BY config ORDER BY top_hit, recall, run) = 1")
def worst_output(spark, d):
    return FR.worst(bound(spark, d, "runs"), ["config"], ["top_hit", "recall", "run"])


@query("""WITH p AS (SELECT config, max(recall) * 100 + min(topk) AS recall, max(top_hit) * 100 + count(*) AS top_hit, min(wall) AS wall FROM runs GROUP BY config)
  SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.recall >= p.recall AND q.top_hit >= p.top_hit AND q.wall <= p.wall AND (q.recall > p.recall OR q.top_hit > p.top_hit OR q.wall < p.wall))""")
def pareto_frontier(spark, d):
    p = bound(spark, d, "runs").groupBy("config").agg((F.max("recall") * 100 + F.min("topk")).alias("recall"), (F.max("top_hit") * 100 + F.count("*")).alias("top_hit"), F.min("wall").alias("wall"))
    return FR.pareto(p, ["recall", "top_hit"], ["wall"], "config")


@query("SELECT run, recall >= 3 AND top_hit >= 2 AS passes, abs(top_hit - 3) <= 1e-12 AND recall >= 2 AND topk >= 5 AND wall <= 150000 AS promoted FROM runs")
def quality_gates(spark, d):
    c = F.col
    return bound(spark, d, "runs").select("run", FR.quality_gate(c("recall"), c("top_hit"), 3, 2).alias("passes"), FR.promotion_gate(c("top_hit") - 3, c("recall"), c("topk"), c("wall"), 2, 5, 150000).alias("promoted"))


@query("""SELECT config, arg_min(run, (wall, run)) AS best_overall, arg_min(run, (wall, run)) FILTER (WHERE recall >= 8) AS best_qualifying FROM runs GROUP BY config""")
def best_runs(spark, d):
    return FR.best_runs(bound(spark, d, "runs"), ["config"], "run", "wall", F.col("recall") >= 8)


@query("""WITH r AS (SELECT config, run, recall - 4 AS shrink, row_number() OVER (PARTITION BY config ORDER BY recall - 4 DESC, run) AS k, sum((recall - 4 > 0)::INT) OVER (PARTITION BY config) AS p FROM runs)
  SELECT config, run, shrink, CASE WHEN k = 1 THEN 'strongest' ELSE 'median' END AS kind FROM r WHERE k = 1 OR k = 2 + greatest(p - 1, 0) // 2""")
def bucket_candidates(spark, d):
    return FR.strongest_and_median(bound(spark, d, "runs").select("config", "run", (F.col("recall") - 4).alias("shrink")), ["config"], "shrink", "run")


@query("""WITH b AS (SELECT config, min(recall) AS x, count(*) AS y FROM runs WHERE run % 2 = 0 GROUP BY 1), c AS (SELECT config, min(recall) AS x, count(*) AS y FROM runs WHERE run % 2 = 1 GROUP BY 1), j AS (SELECT b.x AS bx, b.y AS b_y, c.x AS cx, c.y AS cy FROM b JOIN c USING (config)),
  s AS (SELECT sum(bx)::DOUBLE / count(*) AS bx, sum(b_y)::DOUBLE / count(*) AS b_y, sum(cx)::DOUBLE / count(*) AS cx, sum(cy)::DOUBLE / count(*) AS cy FROM j)
  SELECT 'x' AS measure, round_even(bx, 12) AS baseline, round_even(cx, 12) AS candidate, round_even(cx - bx, 12) AS delta FROM s UNION ALL SELECT 'y', round_even(b_y, 12), round_even(cy, 12), round_even(cy - b_y, 12) FROM s""")
def panel_deltas(spark, d):
    r = bound(spark, d, "runs")
    half = lambda k: r.filter(F.col("run") % 2 == k).groupBy("config").agg(F.min("recall").alias("x"), F.count("*").alias("y"))
    return FR.panel_deltas(half(0), half(1), ["config"], ["x", "y"])


@query("""SELECT a::BIGINT AS a, b::BIGINT AS b, c::BIGINT AS c, CASE WHEN a >= b AND a >= c THEN 'a' WHEN b >= c THEN 'b' ELSE 'c' END AS dominant FROM (SELECT sum(recall) AS a, sum(top_hit) AS b, sum(topk % 5) AS c FROM runs)""")
def dominant_blocker(spark, d):
    return FR.dominant(bound(spark, d, "runs").select(F.col("recall").alias("a"), F.col("top_hit").alias("b"), (F.col("topk") % 5).alias("c")), ["a", "b", "c"])


@query("""SELECT run, topk, CASE WHEN topk % 4 = 0 THEN NULL ELSE (wall::DOUBLE / (topk % 4)::DOUBLE) / 3.0 END AS scale, CASE WHEN topk % 4 = 0 THEN NULL ELSE 7.0 * ((wall::DOUBLE / (topk % 4)::DOUBLE) / 3.0) END AS projected_s FROM runs""")
def runtime_projection(spark, d):
    p = FR.projection(F.lit(7.0), F.col("topk") % 4, F.col("wall"), F.lit(3))
    return bound(spark, d, "runs").select("run", "topk", p["scale"].alias("scale"), p["projected_s"].alias("projected_s"))


@query("""SELECT CASE WHEN n <= 1000 THEN 'le_1000' WHEN n <= 4000 THEN 'le_4000' ELSE 'more' END AS bin, count(*) AS tasks, sum(n)::BIGINT AS bp FROM (SELECT length(text) AS n FROM documents WHERE text IS NOT NULL) GROUP BY 1""")
def length_bins(spark, d):
    n = F.length("text")
    bin_ = F.when(n <= 1000, "le_1000").when(n <= 4000, "le_4000").otherwise("more")
    return read(spark, d, "documents").filter("text is not null").groupBy(bin_.alias("bin")).agg(F.count("*").alias("tasks"), F.sum(n).alias("bp"))


@query("""SELECT task, ordinal, (start_j << 32) | end_j AS packed, start_j AS i, end_j AS j FROM windows""")
def packed_coordinates(spark, d):
    w = bound(spark, d, "windows").withColumn("packed", X.pack(F.col("start_j"), F.col("end_j")))
    return w.select("task", "ordinal", "packed", X.unpack_i(F.col("packed")).alias("i"), X.unpack_j(F.col("packed")).alias("j"))


@query("""SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def telemetry_values(spark, d):
    from ..sources.telemetry import typed_value

    return read(spark, d, "events").select("event_id", typed_value(F.get_json_object("props", "$.k"), "bigint").alias("k"))


@query("""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^.*/', ''), '\\.(fa|fasta)$', ''), '[^A-Za-z0-9._-]', '_', 'g') AS name FROM pages WHERE url IS NOT NULL""")
def clean_names(spark, d):
    return read(spark, d, "pages").filter("url is not null").select("page_id", S.clean_name(F.col("url")).alias("name"))


W1 = "best DESC, support DESC, m DESC NULLS LAST, start_j, end_j, ordinal"


@query(GATE + f""", x AS (SELECT *, unnest(list_filter(['dominant', CASE WHEN best >= 85 THEN 'ge85' END, CASE WHEN best BETWEEN 80 AND 84 THEN 'band_80_84' END, CASE WHEN best BETWEEN 75 AND 79 THEN 'band_75_79' END], lambda s: s IS NOT NULL)) AS strategy FROM gated WHERE NOT after_gate)
  SELECT task, strategy, ordinal FROM x QUALIFY row_number() OVER (PARTITION BY task, strategy ORDER BY {W1}) = 1""")
def replay_strategies(spark, d):
    return R.replay(trace(spark, d), T).select("task", "strategy", "ordinal")


@query(GATE + f""", o AS (SELECT *, row_number() OVER (PARTITION BY task, rule, strand ORDER BY {W1}) AS nth, count(*) OVER (PARTITION BY task, rule, strand) AS n, sum(bp) OVER (PARTITION BY task, rule, strand) AS total_bp FROM gated WHERE NOT after_gate)
  SELECT task, rule, strand, ordinal, n, total_bp::BIGINT AS total_bp, CAST(row_number() OVER (PARTITION BY task ORDER BY {W1}) AS INTEGER) AS object_rank FROM o WHERE nth = 1""")
def rule_strand_objects(spark, d):
    return R.rule_strand_objects(trace(spark, d), T).select("task", "rule", "strand", "ordinal", "n", "total_bp", "object_rank")


@query(HITLESS + """ SELECT ms.task, ms.line, ms.h0, CASE WHEN EXISTS (SELECT 1 FROM gated g WHERE g.task = ms.task AND g.after_gate AND g.start_j <= ms.h0 AND g.end_j >= ms.h1) THEN 'survived_gate_missing_downstream'
  WHEN EXISTS (SELECT 1 FROM gated g WHERE g.task = ms.task AND g.start_j <= ms.h0 AND g.end_j >= ms.h1) THEN 'rejected_by_gate' ELSE 'none' END AS autopsy FROM miss ms""")
def hit_autopsy(spark, d):
    return R.autopsy(missing_hits(spark, d), trace(spark, d), T, ["task", "line", "h0", "h1"]).select("task", "line", "h0", "autopsy")


@query(GATE + """ SELECT reject_reason, sum(best)::BIGINT AS weight, count(*) AS n FROM gated WHERE NOT after_gate GROUP BY 1 ORDER BY weight DESC, reject_reason LIMIT 1""")
def recommendation(spark, d):
    return R.recommend(trace(spark, d).filter("not after_gate"), "reject_reason", "best")


@query("""SELECT user_id, CASE WHEN min(t) IS NULL THEN 'view' WHEN min(t) = max(t) THEN min(t) ELSE 'mixed' END AS label FROM (SELECT user_id, CASE WHEN event_type <> 'view' THEN event_type END AS t FROM events) GROUP BY user_id""")
def merged_labels(spark, d):
    return read(spark, d, "events").groupBy("user_id").agg(R.merged_label(F.col("event_type"), "view").alias("label"))


def _boxes(spark, d, second="true"):
    w = bound(spark, d, "windows")
    side = lambda p: w.select("task", F.col("ordinal").alias(p), F.col("start_j").alias(f"{p}_row0"), F.col("end_j").alias(f"{p}_row1"), F.col("best").alias(f"{p}_col0"), (F.col("best") + 5 * F.col("support")).alias(f"{p}_col1"))
    return R.overlapping_boxes(side("a"), side("b").filter(second), T).select("task", "a", "b")


@query("""SELECT a.task, a.ordinal AS a, b.ordinal AS b FROM windows a JOIN windows b ON a.task = b.task AND b.ordinal <= 2 AND a.start_j <= b.end_j AND b.start_j <= a.end_j AND a.best <= b.best + 5 * b.support AND b.best <= a.best + 5 * a.support""")
def box_overlap(spark, d):
    return _boxes(spark, d, "b <= 2")


@query("""SELECT a.task, a.ordinal AS a, b.ordinal AS b FROM windows a JOIN windows b ON a.task = b.task AND a.start_j <= b.end_j AND b.start_j <= a.end_j AND a.best <= b.best + 5 * b.support AND b.best <= a.best + 5 * a.support""")
def box_overlap_all(spark, d):
    """Every overlapping pair; ``box_overlap`` has those whose second box is one of the first windows of its task."""
    return _boxes(spark, d)


@query("""WITH s AS (SELECT doc_id, length(text) AS n, CAST(ceil(length(text) / 256.0) * 256 AS BIGINT) AS shape FROM documents WHERE text IS NOT NULL), b AS (SELECT *, (row_number() OVER (PARTITION BY shape ORDER BY n, doc_id) - 1) // 32 AS batch FROM s)
  SELECT shape, batch, count(*) AS n, max(n) AS longest, sum(n)::BIGINT AS total, (max(n) * count(*) - sum(n)) * 10 <= max(n) * count(*) AS padded FROM b GROUP BY shape, batch""")
def shape_batches(spark, d):
    docs = read(spark, d, "documents").filter("text is not null").select("doc_id", F.length("text").cast("bigint").alias("len"))
    return R.batches(docs, "len", "doc_id").select("shape", "batch", "n", "longest", "total", "padded")
