"""Searches over a growing folder of sequence files, micro-batch by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.search import SearchConfig, fast_hits
from ..sources.fasta import parse_dna_header


def fasta_stream(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """Records of FASTA files as they arrive: header, species, chr, start_genome, seq."""
    text = spark.readStream.option("lineSep", "\n>").option("maxFilesPerTrigger", files_per_batch).text(path)
    body = F.regexp_replace(F.replace("value", F.lit("\r"), F.lit("")), "^>", "")
    rows = text.select(F.regexp_extract(body, r"\A([^\n]*)", 1).alias("header"), F.regexp_replace(F.regexp_replace(body, r"\A[^\n]*", ""), r"\s", "").alias("seq"))
    return rows.filter("seq != ''").withColumns(parse_dna_header(F.col("header")))


def run_batches(stream: DataFrame, query: str, sink: Callable[[DataFrame, int], None], checkpoint: str, config: SearchConfig = SearchConfig()) -> StreamingQuery:
    """Search each micro-batch and hand its hits to ``sink`` with the batch number, which makes sinks idempotent."""
    return stream.writeStream.foreachBatch(lambda df, k: sink(fast_hits(df, query, config), k)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: State of an open run: first and last position, number of rows, best score and where it is.
_RUN = "first bigint, last bigint, n bigint, peak bigint, peak_at bigint"


def run_stream(rows: DataFrame, by: str, position: str = "position", score: str = "score", gap: int = 1) -> DataFrame:
    """Runs of neighbouring positions of each ``by`` in a stream: a run comes out when a position beyond ``gap`` follows it.

    Positions of a key must arrive in ascending order across micro-batches. The open run of a key is
    the state; it stays open until the key's next run begins, however long that takes.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    columns = ["first", "last", "n", "peak", "peak_at"]

    def step(key, frames, state: GroupState):
        run = list(state.get) if state.exists else None
        done = []
        for f in frames:
            for p, s in f.sort_values(position, kind="stable")[[position, score]].itertuples(index=False):
                p, s = int(p), int(s)
                if run is not None and p - run[1] <= gap:
                    run[1], run[2] = p, run[2] + 1
                    if s > run[3]:
                        run[3], run[4] = s, p
                else:
                    if run is not None:
                        done.append((*key, *run))
                    run = [p, p, 1, s, p]
        if run is not None:
            state.update(tuple(run))
        yield pd.DataFrame(done, columns=[by, *columns])

    kind = rows.select(by).schema[0].dataType.simpleString()
    return rows.select(by, position, score).groupBy(by).applyInPandasWithState(step, f"`{by}` {kind}, {_RUN}", _RUN, "append", GroupStateTimeout.NoTimeout)
