"""Search hits: thresholds, overlap resolution, and the plug-in for a search tool."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from genoplane.config import Alignment
from genoplane.functions.identifiers import coverage
from genoplane.session import cut_lineage

HIT_SCHEMA = T.StructType(
    [T.StructField("accession", T.StringType()), T.StructField("profile_file", T.StringType()), T.StructField("target_protein", T.StringType()), T.StructField("target_len", T.IntegerType()), T.StructField("gene_family", T.StringType()), T.StructField("hmm_len", T.IntegerType())]
    + [T.StructField(c, T.DoubleType()) for c in ("seq_evalue", "dom_evalue", "raw_score", "bias", "effective_score", "query_cov", "target_cov")]
    + [T.StructField(c, T.IntegerType()) for c in ("ali_from", "ali_to", "env_from", "env_to")]
)


def with_scores(hits: DataFrame, bias_corrected: bool = True) -> DataFrame:
    """Add effective_score (the raw score, or with the bias put back) and both coverages."""
    score = F.col("raw_score") if bias_corrected else F.col("raw_score") + F.coalesce("bias", F.lit(0.0))
    return hits.withColumns({
        "effective_score": score,
        "query_cov": coverage(F.col("hmm_from"), F.col("hmm_to"), F.col("hmm_len")),
        "target_cov": coverage(F.col("env_from"), F.col("env_to"), F.col("target_len")),
    })


def trusted_profiles(models: DataFrame) -> DataFrame:
    """Profile files whose every model has a trusted cutoff: (profile_file, use_trusted)."""
    return models.groupBy("profile_file").agg(F.bool_and(F.coalesce("has_trusted_cutoff", F.lit(False))).alias("use_trusted"))


def passing_hits(hits: DataFrame, alignment: Alignment, models: DataFrame | None = None) -> DataFrame:
    """Hits within the thresholds. The score counts only where the profile's trusted cutoffs are not in use.

    With `models` (profile_file, has_trusted_cutoff), cutoffs are in use for a file all of whose models have
    one; without, the setting decides for all. A null measure does not pass.
    """
    if models is not None and alignment.use_trusted_cutoffs:
        hits = hits.join(trusted_profiles(models), "profile_file", "left").withColumn("use_trusted", F.coalesce("use_trusted", F.lit(False)))
        by_score = F.col("use_trusted") | (F.col("effective_score") >= alignment.min_bitscore)
    else:
        by_score = F.lit(True) if alignment.use_trusted_cutoffs else F.col("effective_score") >= alignment.min_bitscore
    ok = by_score & (F.col("seq_evalue") <= alignment.max_evalue) & (F.col("dom_evalue") <= alignment.max_evalue)
    ok = ok & (F.col("query_cov") >= alignment.min_coverage) & (F.col("target_cov") >= alignment.min_coverage)
    return hits.filter(ok).drop("use_trusted")


def resolve_overlaps(hits: DataFrame, keys: Sequence[str], start: str, end: str, order: Sequence[tuple[str, bool]], max_overlap: float) -> DataFrame:
    """Of overlapping intervals per key, keep the best: in the given order, each unless it overlaps a kept one too much.

    `order` lists (column, descending) from the most important; it has to be total for a defined result. An
    interval is dropped if its overlap with any kept one, divided by the shorter length, exceeds `max_overlap`.
    Only intervals of one chain of overlaps can clash: a window cuts a key's intervals into chains, and each chain is
    folded as one array, so the cost grows with what overlaps and not with the key. All columns of `hits` are kept.
    """
    sign = lambda c, down: -F.col(c) if down else F.col(c)
    fields = [sign(c, down).alias(f"_o{i}") for i, (c, down) in enumerate(order)]
    item = F.struct(*fields, F.struct(*hits.columns).alias("row"))
    along = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(along.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)
    chained = hits.withColumn("_begins", begins).withColumn("_chain", F.sum("_begins").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    gathered = chained.groupBy(*keys, "_chain").agg(F.sort_array(F.collect_list(item)).alias("_all"))
    s, e = lambda x: x["row"][start], lambda x: x["row"][end]

    def clashes(kept, x):
        shared = F.least(e(kept), e(x)) - F.greatest(s(kept), s(x)) + 1
        shorter = F.least(e(kept) - s(kept), e(x) - s(x)) + 1
        return (shared > 0) & (shared / shorter > max_overlap)

    empty = F.expr("slice(_all, 1, 0)")
    kept = F.aggregate("_all", empty, lambda acc, x: F.when(F.exists(acc, lambda k: clashes(k, x)), acc).otherwise(F.array_append(acc, x)))
    return gathered.select(F.explode(kept).alias("k")).select("k.row.*")


Search = Callable[[Iterable[tuple[str, str]], bytes], Iterable[tuple]]
MAX_PROFILE_BYTES = 512 << 20


def per_genome(rows: DataFrame, columns: Sequence[str], schema: T.StructType, open_tool: Callable[[], Callable[[list[tuple]], Iterable[tuple]]]) -> tuple[DataFrame, DataFrame]:
    """Run a tool over the rows of each genome: (its rows of `schema`, which begins with accession; failures (accession, error)).

    `open_tool` is called once per task; the tool gets the `columns` of a genome's rows in a batch and yields rows without
    the accession. A genome on which it fails is a failure with the error's text and gives no rows at all; the others
    are not affected. A tool that cannot be opened fails the job. Rows without accession are one genome, null.
    """
    marked = T.StructType([*schema.fields, T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = None
        for batch in batches:
            tool = tool or open_tool()
            out: list[tuple] = []
            for accession, group in batch.groupby("accession", sort=False, dropna=False):
                accession = None if pd.isna(accession) else accession
                try:
                    out += [(accession, *row, None) for row in list(tool(list(zip(*(group[c] for c in columns), strict=True))))]
                except Exception as e:
                    out.append((accession, *[None] * (len(schema) - 1), f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=marked.names)

    found = cut_lineage(rows.select("accession", *columns).mapInPandas(run, marked), "found")
    failures = found.filter("error IS NOT NULL").groupBy("accession").agg(F.min("error").alias("error"))
    good = found.filter("error IS NULL").join(failures, found["accession"].eqNullSafe(failures["accession"]), "left_anti")
    return good.select(*schema.names), failures


def search_genomes(proteins: DataFrame, profiles: Sequence[tuple[str, bytes]], open_search: Callable[[], Search]) -> tuple[DataFrame, DataFrame]:
    """Run a search tool over protein batches: (hits of HIT_SCHEMA, failures (accession, error)); see `per_genome`.

    The tool that `open_search` gives, `search(sequences, profile)`, gets the (protein id, sequence) pairs of a genome in a
    batch and a profile's bytes, and yields hit tuples from target_protein on. Profiles (public models, MBs; at most
    MAX_PROFILE_BYTES, checked) are broadcast. No tool is bundled.
    """
    if (size := sum(len(p) for _, p in profiles)) > MAX_PROFILE_BYTES:
        raise ValueError(f"profiles of {size} bytes")
    shared = proteins.sparkSession.sparkContext.broadcast(list(profiles))

    def opened() -> Callable[[list[tuple]], Iterable[tuple]]:
        search = open_search()
        return lambda sequences: ((name, *hit) for name, profile in shared.value for hit in search(sequences, profile))

    return per_genome(proteins, ["protein_id", "sequence"], HIT_SCHEMA, opened)


GENE_SCHEMA = T.StructType([T.StructField("accession", T.StringType()), T.StructField("seqid", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("strand", T.StringType()), T.StructField("protein_id", T.StringType()), T.StructField("sequence", T.StringType())])


def call_genes(contigs: DataFrame, open_caller: Callable[[], Callable[[list[tuple]], Iterable[tuple]]]) -> tuple[DataFrame, DataFrame]:
    """Run a gene caller over contigs (accession, seqid, sequence): (genes of GENE_SCHEMA, failures); see `per_genome`.

    The caller gets the (seqid, sequence) pairs of a genome in a batch and yields seqid, start, end, strand, protein id and
    translation of each gene: for genomes that come without annotation. No tool is bundled.
    """
    return per_genome(contigs, ["seqid", "sequence"], GENE_SCHEMA, open_caller)


def search_proteins(proteins: DataFrame, profiles: Sequence[tuple[str, bytes]], search: Search) -> DataFrame:
    """The hits of `search_genomes` with a tool that needs no opening."""
    return search_genomes(proteins, profiles, lambda: search)[0]
