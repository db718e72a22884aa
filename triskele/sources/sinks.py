"""Hit tables, coverage and traces as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The columns of the hit tables.
FULL = ["QueryStart", "QueryEnd", "StartInSeq", "EndInSeq", "Direction", "StartInGenome", "EndInGenome", "MeanStability", "MeanIdentity(%)", "Strand", "Rule", "Score", "Nt(bp)", "Class", "MidPoint", "Center", "TFO sequence"]
FAST = ["QueryStart", "QueryEnd", "StartInSeq", "EndInSeq", "Direction", "Chr", "StartInGenome", "EndInGenome", "MeanStability", "MeanIdentity(%)", "Strand", "Rule", "Score", "Nt(bp)", "Class", "MidPoint", "Center", "TFO sequence", "TTS sequence"]
LITE = ["Chr", "StartInGenome", "EndInGenome", "Strand", "Rule", "QueryStart", "QueryEnd", "StartInSeq", "EndInSeq", "Direction", "Score", "Nt(bp)", "MeanIdentity(%)", "MeanStability"]
MODES = {"full": ["full"], "tfosorted": ["full"], "lite": ["lite"], "both": ["full", "lite"], "fast": ["fast"]}


def six_digits(x: Column) -> Column:
    """A float in six significant digits without trailing zeros; exact ties round to even, as printf does."""
    d = x.cast("double")
    text, size = F.format_string("%.6g", d), F.abs(d)
    for k in range(-4, 6):
        exact = F.bround(d.cast("decimal(38,16)"), 5 - k).cast("string")
        text = F.when((size >= 10.0**k) & (size < 10.0 ** (k + 1)), exact).otherwise(text)
    return F.when(F.contains(text, F.lit("e")) | ~F.contains(text, F.lit(".")), text).otherwise(F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", ""))


def layout(hits: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns as text, floats in six digits."""
    kinds = dict(hits.dtypes)
    return hits.select(*[(six_digits(F.col(f"`{c}`")) if kinds[c] in ("float", "double") else F.col(f"`{c}`").cast("string")).alias(c) for c in columns])


def unclustered(hits: DataFrame) -> DataFrame:
    """Class 0 and the midpoint as center: what outputs without clustering carry."""
    return hits.withColumns({"Class": F.lit(0), "Center": F.col("MidPoint")})


def write_hits(hits: DataFrame, path: str, mode: str = "full") -> None:
    rows = hits if mode == "full" else unclustered(hits) if "Center" not in hits.columns else hits
    for kind in MODES[mode]:
        layout(rows, {"full": FULL, "lite": LITE, "fast": FAST}[kind]).write.option("sep", "\t").option("header", True).option("emptyValue", "").csv(f"{path}/{kind}")


def bedgraph_header(chrom: str, start: int, end: int, name: str, label: str) -> list[str]:
    """The nine lines before the runs of one class."""
    # The lines of the format.
    return [
        f"browser position {chrom}:{start}-{end}", "browser hide all", "browser pack refGene encodeRegions", "browser full altGraph",
        "# 300 base wide bar graph, ausoScale is on by default == graphing", "# limits will dynamically change to always show full range of data",
        "# in viewing window, priority = 20 position this as the second graph", "# Note, zero-relative, half-open coordinate system in use for bedGraph format",
        f"track type=bedGraph name='{name}' description='{label}' visibility=full color=200,100,0 altColor=0,100,200 priority=20",
    ]


def headed(lines: DataFrame, header: list[str]) -> DataFrame:
    """``lines`` (one string column, ordered) with the header before the first line of the first partition."""
    import pyarrow as pa

    name = lines.columns[0]

    def run(batches):
        from pyspark import TaskContext

        if TaskContext.get().partitionId() == 0:
            yield pa.RecordBatch.from_arrays([pa.array(header, pa.string())], [name])
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string())], [name])

    return lines.mapInArrow(run, f"`{name}` string")


def write_bedgraph(runs: DataFrame, path: str, header: list[str]) -> None:
    """Coverage runs (chr, first, last, depth) in order below the header lines: the part files, in the order of their names, are the file."""
    line = F.concat_ws("\t", "chr", F.col("first").cast("string"), F.col("last").cast("string"), F.col("depth").cast("string"))
    headed(runs.orderBy("chr", "first").select(line.alias("value")), header).write.text(path)


def write_class_bedgraphs(runs: DataFrame, path: str, chrom: str, start: int, end: int, query: str, reach: int, length: int, classes: int = 2) -> list[str]:
    """One bedGraph folder for each class of ``runs`` (class, chr, first, last, depth); returns the folders."""
    out = []
    for k in range(1, classes + 1):
        out.append(f"{path}/class{k}-{reach}-{length}")
        write_bedgraph(runs.filter(F.col("class") == k), out[-1], bedgraph_header(chrom, start, end, f"{query} TTS ({k})", f"{reach}-{length}"))
    return out


def write_trace(trace: DataFrame, path: str) -> None:
    flags = {c: F.col(c).cast("int") for c, k in trace.dtypes if k == "boolean"}
    trace.withColumns(flags).write.option("sep", "\t").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def markdown(rows: DataFrame, most: int = 100) -> str:
    """A small frame as a Markdown table; at most ``most`` rows are rendered, since reports are read by people."""
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    for r in rows.limit(most).collect():
        lines.append("| " + " | ".join("" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) + " |")
    return "\n".join(lines)


def write_report(rows: DataFrame, path: str) -> None:
    """A frame as one JSON document per row."""
    rows.write.json(path)


def write_selected_tasks(rows: DataFrame, tile: str, path: str) -> None:
    """Selected-task tables, one folder per tile."""
    rows.repartition(tile).write.option("sep", "\t").option("header", True).partitionBy(tile).csv(path)
