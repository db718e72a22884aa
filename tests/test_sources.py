import pytest
from pyspark.sql import functions as F

from triskele.operators import sequences as SQ
from triskele.sources import fasta, sinks, tables, telemetry
from triskele.streaming.records import fasta_stream, run_batches


def test_fasta_round_trip(spark, tmp_path):
    p = tmp_path / "a.fa"
    p.write_text(">hg|chr1|11-30\r\nACGT\r\nACGT\n>only\nTT\n\n>x|y|zz\nGG\n")
    rows = {r.header: r for r in fasta.read_dna(spark, str(p)).collect()}
    assert (rows["hg|chr1|11-30"].species, rows["hg|chr1|11-30"].chr, rows["hg|chr1|11-30"].start_genome, rows["hg|chr1|11-30"].seq) == ("hg", "chr1", 11, "ACGTACGT")
    assert (rows["only"].species, rows["only"].chr, rows["only"].start_genome, rows["only"].seq) == ("only", "", 1, "TT")
    assert rows["x|y|zz"].start_genome == 1
    fasta.write_fasta(fasta.read_fasta(spark, str(p)), str(tmp_path / "out"), 3)
    again = {r.header: r.seq for r in fasta.read_fasta(spark, str(tmp_path / "out")).collect()}
    assert again == {k: r.seq for k, r in rows.items()}
    with pytest.raises(ValueError):
        fasta.single_record(fasta.read_fasta(spark, str(p)))
    assert fasta.base_count(fasta.read_fasta(spark, str(p))).first().bases == 12


def test_fragments_need_room(spark):
    with pytest.raises(ValueError):
        SQ.fragments(spark.createDataFrame([("ACGT",)], "seq string"), cut=5, overlap=5)
    rows = SQ.fragments(spark.createDataFrame([("ACGTACGTAC",), ("",)], "seq string"), cut=6, overlap=2).collect()
    assert [(r.fragment_start, r.fragment) for r in rows] == [(0, "ACGTAC"), (4, "ACGTAC"), (8, "AC")]


def test_shard_past_the_end_fails(spark):
    df = spark.createDataFrame([("ACGTACGTACGTACGTACGT",)], "seq string")
    assert df.select(SQ.shard(F.col("seq"), F.lit(5), F.lit(4))).first()[0] == "ACGT"
    with pytest.raises(Exception, match="shard passes the end"):
        df.select(SQ.shard(F.col("seq"), F.lit(18), F.lit(4))).collect()


def test_telemetry(spark, tmp_path):
    p = tmp_path / "log.txt"
    p.write_text("noise\nbenchmark.total=5\nbenchmark.label=a=b\nbenchmark.total=6\nbenchmark.empty\n")
    got = {r.key: r.value for r in telemetry.read_telemetry(spark, str(p)).collect()}
    assert got == {"total": "6", "label": "a=b"}


def test_tables(spark, tmp_path):
    p = tmp_path / "h.tsv"
    p.write_text("# note\nQueryStart\tQueryEnd\tStartInSeq\tEndInSeq\tStrand\tRule\tScore\n1\t5\t2\t6\tParaPlus\t1\t2.5\n\n1\t5\t2\t6\tParaPlus\t1\t3.5\n")
    hits = tables.read_hits(spark, str(p))
    assert hits.count() == 2
    assert tables.last_per_key(hits, tables.STRICT_KEY, ["Score"]).first().Score == 3.5
    q = tmp_path / "bad.tsv"
    q.write_text("a\tb\n1\t2\n")
    with pytest.raises(ValueError, match="lacks"):
        tables.read_hits(spark, str(q))
    s = tmp_path / "tasks.tsv"
    s.write_text("\t".join(tables.TASK_COLUMNS) + "\n#x\n\n0\t0\t99\t0\t1\tParaPlus\t3\n")
    assert tables.read_selected_tasks(spark, str(s)).first().rule == 3


def test_six_digits(spark):
    df = spark.createDataFrame([(1.71,), (100.0,), (0.0,), (123456.7,), (-3.5,)], "x double")
    assert [r[0] for r in df.select(sinks.six_digits(F.col("x"))).collect()] == ["1.71", "100", "0", "123457", "-3.5"]


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fa").write_text(">s|c|1-40\n" + "GATTACAGATTACAGGAGGAAGAGAAGG" + "\n")
    seen = []
    q = run_batches(fasta_stream(spark, str(tmp_path / "in")), "GGAGGAAGAGAAGG", lambda df, k: seen.append((k, df.count())), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert seen and seen[0][0] == 0


def test_runs_of_a_stream_across_batches(spark, tmp_path):
    from triskele.streaming.records import run_stream

    batches = [[("a", 1, 5), ("a", 2, 9), ("b", 7, 1)], [("a", 3, 4), ("a", 9, 2)], [("b", 30, 3), ("a", 20, 1)]]
    source = tmp_path / "in"
    schema = "k string, position bigint, score bigint"
    out = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
    source.mkdir()
    stream = run_stream(spark.readStream.schema(schema).parquet(str(source)), "k")
    for i in range(len(batches)):
        for f in (tmp_path / f"b{i}").glob("*.parquet"):
            f.rename(source / f"{i}-{f.name}")
        q = stream.writeStream.foreachBatch(lambda df, _: out.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    assert sorted(out) == [("a", 1, 3, 3, 9, 2), ("a", 9, 9, 1, 2, 9), ("b", 7, 7, 1, 1, 7)]
