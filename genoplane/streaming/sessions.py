"""Streaming forms: gap clusters of an event stream, and orphan counts from change streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from genoplane.operators.orphans import apply_deltas


def fixed_gap_sessions(events: DataFrame, key: str, time: str, gap_seconds: int, late: str = "1 day") -> DataFrame:
    """(key, first_at, last_at, n_events) of runs of events that are no more than `gap_seconds` apart.

    Works on streams (append mode, closed by the watermark) and on tables. The session closes when the gap has
    passed, so an event exactly `gap_seconds` after the last still belongs to it.
    """
    gap = f"{gap_seconds * 1000 + 1} milliseconds"
    timed = events.withColumn("_t", F.col(time).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("_t", late)
    out = timed.groupBy(key, F.session_window("_t", gap).alias("w")).agg(F.min("_t").alias("first_at"), F.max("_t").alias("last_at"), F.count(F.lit(1)).alias("n_events"))
    return out.select(key, "first_at", "last_at", "n_events")


def directed_gap_clusters(loci: DataFrame, max_gap: int, max_divergent_gap: int) -> DataFrame:
    """Clusters of a stream of loci (accession, seqid, start, end, strand) that arrive in order of position per contig.

    State per contig: the open cluster. A locus beyond the limit, which is smaller after a minus strand followed
    by a plus strand, closes it. Each batch gives, for the contigs in it, the clusters it closed and the one that
    is open after it. Result (append mode): accession, seqid, start, end, n_loci, is_closed.
    """
    schema = "accession string, seqid string, start bigint, end bigint, n_loci bigint, is_closed boolean"
    state = "start bigint, end bigint, n bigint, strand string"

    def run(key: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        out, open_ = [], group.get if group.exists else None
        rows = pd.concat(list(batches)).sort_values(["start", "end"], kind="stable")
        for start, end, strand in zip(rows["start"], rows["end"], rows["strand"], strict=True):
            if open_ is not None:
                limit = max_divergent_gap if open_[3] == "-" and strand == "+" else max_gap
                if start - open_[1] - 1 <= limit:
                    open_ = (open_[0], max(open_[1], int(end)), open_[2] + 1, strand)
                    continue
                out.append((*key, *open_[:3], True))
            open_ = (int(start), int(end), 1, strand)
        group.update(open_)
        out.append((*key, *open_[:3], False))
        yield pd.DataFrame(out, columns=["accession", "seqid", "start", "end", "n_loci", "is_closed"])

    return loci.groupBy("accession", "seqid").applyInPandasWithState(run, schema, state, "append", GroupStateTimeout.NoTimeout)


def fold_into_state(path: str):
    """A foreachBatch function that folds signed changes (key, side, delta) into versions of the state under `path`.

    side is ``reference`` or ``existence``. Each batch writes its own version, so a batch that runs again after a
    failure gives the same state; versions before the last one are removed, as no batch goes further back. Only keys
    with counts are in a version, so it grows with the live keys, not with the changes.
    """

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{path}/version={batch_id - 1}") if batch_id > 0 else None
        side = lambda s: batch.filter(F.col("side") == s).select("key", "delta")
        apply_deltas(before, side("reference"), side("existence")).write.mode("overwrite").parquet(f"{path}/version={batch_id}")
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/version={batch_id - 2}")
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    return fold
