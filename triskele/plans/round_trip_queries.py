"""Sources and sinks over the driver's tables: what is written and read again must be what was there. Kernels by name in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import registered
from ..operators import coverage as COV
from ..sources import fasta, sinks, tables, telemetry
from ..sources.scratch import folder
from . import queries as Q
from .bindings import bound, with_views

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql)
        return f

    return add


@query(f"WITH {Q.DNA} SELECT 'sp' AS species, 'chr' || (doc_id % 23) AS chr, (doc_id * 1000 + 1)::BIGINT AS start_genome, length(seq) AS n, md5(seq) AS h FROM dna WHERE length(seq) > 0")
def fasta_round_trip(spark, d):
    rows = Q.dna(spark, d).filter(F.length("seq") > 0)
    start = F.col("doc_id") * 1000 + 1
    header = F.format_string("sp|chr%d|%d-%d", F.col("doc_id") % 23, start, start + F.length("seq") - 1)
    path = folder(spark, "fasta")
    fasta.write_fasta(rows.select(header.alias("header"), "seq"), path)
    return fasta.read_dna(spark, path).select("species", "chr", "start_genome", F.length("seq").cast("bigint").alias("n"), F.md5(F.col("seq").cast("binary")).alias("h"))


@query(f"WITH {Q.DNA} SELECT sum(length(seq))::BIGINT AS bases FROM dna WHERE length(seq) > 0")
def fasta_bases(spark, d):
    path = folder(spark, "fasta")
    fasta.write_fasta(Q.dna(spark, d).filter(F.length("seq") > 0).select(F.col("doc_id").cast("string").alias("header"), "seq"), path)
    return fasta.base_count(fasta.read_fasta(spark, path)).agg(F.sum("bases").alias("bases"))


def _table(spark, d):
    h = bound(spark, d, "hits")
    return h.select(
        F.col("l_partkey").alias("QueryStart"), (F.col("l_partkey") + F.col("line")).alias("QueryEnd"), F.col("h0").alias("StartInSeq"), F.col("h1").alias("EndInSeq"), F.lit("R").alias("Direction"),
        (F.col("h0") + 99).alias("StartInGenome"), (F.col("h1") + 99).alias("EndInGenome"), F.lit(1.5).cast("float").alias("MeanStability"), F.lit(75.0).cast("float").alias("MeanIdentity(%)"),
        F.col("strand").alias("Strand"), (F.col("l_suppkey") % 6 + 1).alias("Rule"), (F.col("score") / 100).alias("Score"), F.col("line").alias("Nt(bp)"), F.lit(1).alias("Class"),
        F.col("h0").alias("MidPoint"), F.col("h0").alias("Center"), F.lit("ACGT").alias("TFO sequence"), F.lit("TGCA").alias("TTS sequence"), F.lit("chr1").alias("Chr"),
    )


KEYS = """SELECT l_partkey::INT AS "QueryStart", (l_partkey + line)::INT AS "QueryEnd", h0::INT AS "StartInSeq", h1::INT AS "EndInSeq", strand AS "Strand", (l_suppkey % 6 + 1)::INT AS "Rule", count(*) AS n FROM hits GROUP BY ALL"""


def _key_counts(spark, d, mode: str, kind: str):
    path = folder(spark, "hits")
    sinks.write_hits(_table(spark, d), path, mode)
    return tables.read_hits(spark, f"{path}/{kind}").groupBy(*tables.STRICT_KEY).agg(F.count("*").alias("n"))


@query(KEYS)
def full_table_round_trip(spark, d):
    return _key_counts(spark, d, "full", "full")


@query(KEYS)
def lite_table_round_trip(spark, d):
    return _key_counts(spark, d, "lite", "lite")


@query(KEYS)
def fast_table_round_trip(spark, d):
    return _key_counts(spark, d, "fast", "fast")


@query("""SELECT l_partkey::INT AS "QueryStart", (l_partkey + line)::INT AS "QueryEnd", strand AS "Strand", max(task)::BIGINT AS last_task FROM hits GROUP BY ALL""")
def last_row_per_key(spark, d):
    path = folder(spark, "hits")
    h = bound(spark, d, "hits").select(F.col("l_partkey").alias("QueryStart"), (F.col("l_partkey") + F.col("line")).alias("QueryEnd"), F.col("strand").alias("Strand"), "task")
    h.write.option("sep", "\t").option("header", True).csv(path)
    rows = tables.read_tsv(spark, path).select(F.col("QueryStart").cast("int"), F.col("QueryEnd").cast("int"), "Strand", F.col("task").cast("bigint").alias("last_task"))
    return tables.last_per_key(rows, ["QueryStart", "QueryEnd", "Strand"], ["last_task"])


@query(Q.GATE + " SELECT task, ordinal, start_j, end_j, best, second, m AS margin, support, after_gate::BIGINT AS after_gate, peak_ok::BIGINT AS peak_score_ok, reject_reason, 0::BIGINT AS selective_fallback_selected FROM gated")
def trace_round_trip(spark, d):
    path = folder(spark, "trace")
    sinks.write_trace(Q.trace(spark, d).select("task", "ordinal", "start_j", "end_j", "best", "second", "margin", "support", "after_gate", "peak_score_ok", "strand", "reject_reason"), path)
    return tables.read_trace(spark, path).drop("file", "strand")


@query("""SELECT 'k' || event_id AS key, props AS value FROM events""")
def telemetry_round_trip(spark, d):
    path = folder(spark, "telemetry")
    telemetry.write_telemetry(Q.read(spark, d, "events").select(F.format_string("k%d", "event_id").alias("key"), F.col("props").alias("value")), path)
    return telemetry.read_telemetry(spark, path).select("key", "value")


@query("""SELECT DISTINCT (task % 50)::INT AS fragment_index, (ordinal * 100)::INT AS fragment_start_in_seq, (ordinal * 100 + 119)::INT AS fragment_end_in_seq, (ordinal % 2)::INT AS reverse_mode, 1 AS parallel_mode, strand, rule::INT AS rule FROM windows""")
def selected_tasks_round_trip(spark, d):
    path = folder(spark, "tasks")
    w = bound(spark, d, "windows").select(
        (F.col("task") % 50).alias("fragment_index"), (F.col("ordinal") * 100).alias("fragment_start_in_seq"), (F.col("ordinal") * 100 + 119).alias("fragment_end_in_seq"),
        (F.col("ordinal") % 2).alias("reverse_mode"), F.lit(1).alias("parallel_mode"), "strand", "rule", (F.col("task") % 3).alias("tile_key"),
    ).distinct()
    sinks.write_selected_tasks(w, "tile_key", path)
    return tables.read_selected_tasks(spark, f"{path}/*").distinct()


@query("""WITH e AS (SELECT strand, h0 AS pos, 1 AS d FROM hits WHERE h0 < h1 UNION ALL SELECT strand, h1, -1 FROM hits WHERE h0 < h1), s AS (SELECT strand, pos, sum(d) AS d FROM e GROUP BY ALL HAVING sum(d) <> 0),
  r AS (SELECT strand, pos, lead(pos) OVER (PARTITION BY strand ORDER BY pos) AS nx, sum(d) OVER (PARTITION BY strand ORDER BY pos ROWS UNBOUNDED PRECEDING) AS depth FROM s)
  SELECT strand || chr(9) || (pos - 1 + 1000) || chr(9) || (nx - 1 + 1000) || chr(9) || depth AS line FROM r WHERE nx IS NOT NULL UNION ALL SELECT 'browser position chr1:1-9' UNION ALL SELECT 'browser hide all'""")
def bedgraph_round_trip(spark, d):
    path = folder(spark, "bedgraph")
    runs = COV.depth_runs(bound(spark, d, "hits").select(F.col("strand").alias("chr"), F.col("h0").alias("lo"), F.col("h1").alias("hi")), ["chr"], 1000)
    sinks.write_bedgraph(runs, path, sinks.bedgraph_header("chr1", 1, 9, "x", "y")[:2])
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("""SELECT config, count(*) AS n, sum(wall)::BIGINT AS wall FROM runs GROUP BY config""")
def report_round_trip(spark, d):
    path = folder(spark, "report")
    per = bound(spark, d, "runs").groupBy("config").agg(F.count("*").alias("n"), F.sum("wall").alias("wall"))
    sinks.write_report(per, path)
    return tables.read_report(spark, path, "config string, n bigint, wall bigint", lines=True)


@query(f"""WITH {Q.FRAGS}, {Q._rule_values()}, f AS (SELECT doc_id, fragment FROM frags WHERE fragment_index = 0)
  SELECT doc_id, parallel, rule, reverse, md5(CASE WHEN reverse = 1 THEN reverse(translate(fragment, 'ATGCN', image)) ELSE translate(fragment, 'ATGCN', image) END) AS h FROM f, rules""")
def task_table_function(spark, d):
    """First fragments with their 48 tasks, by the registered table function."""
    from ..operators import sequences as SQ

    registered.register(spark)
    first = SQ.fragments(Q.dna(spark, d), cut=120, overlap=20).filter("fragment_index = 0").select("doc_id", "fragment")
    out = spark.sql("SELECT f.doc_id, t.parallel, t.rule, t.reverse, t.target FROM {f} f, LATERAL fragment_tasks(f.fragment) t", f=first)
    return out.select("doc_id", "parallel", "rule", "reverse", F.md5(F.col("target").cast("binary")).alias("h"))


@query()
def registered_kernels(spark, d):
    """Scores, alignments and column maxima of whole sequences, by name in SQL."""
    registered.register(spark)
    from .kernel_queries import RNA

    return spark.sql(f"SELECT doc_id, alignment_score('{RNA}', seq) AS score, alignment_cigar('{RNA}', substring(seq, 1, 500)) AS cigar, array_max(alignment_columns('{RNA}', seq)) AS top FROM {{s}} WHERE length(seq) > 0", s=Q.dna(spark, d))
