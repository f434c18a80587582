"""Queries on loci, clusters, aliases, files and features, with the test tables in their roles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoplane.config import Alignment, Synteny
from genoplane.functions.identifiers import attribute_map, direct_aliases, inferred_aliases, is_canonical_name, standard_name
from genoplane.operators import clusters as C
from genoplane.operators import features as X
from genoplane.operators import loci as L
from genoplane.operators.hits import passing_hits, resolve_overlaps, trusted_profiles, with_scores
from genoplane.operators.predict import batch_summary, capability_scores, flat_report
from genoplane.plans.tables import table
from genoplane.session import shared_dir
from genoplane.sources.readers import accession_list, best_files, distinct_in_order, missing_inputs, missing_triplets, move_plan, move_statistics, report_fields, runnable
from genoplane.streaming.sessions import fixed_gap_sessions

SYNTENY = Synteny(max_gap_bp=15000, max_divergent_gap_bp=5000)


def event_loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as loci: the user is the contig, seconds are bases, the event type is the family."""
    family = F.when(F.col("event_type") == "click", "nifH").when(F.col("event_type") == "view", "nifD").when(F.col("event_type") == "purchase", "nifK").when(F.col("event_type") == "signup", "vnfG").when(F.col("event_type") == "error", "anfG")
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 10).alias("accession"), F.col("user_id").alias("seqid"), (F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)") + 1).alias("start"), (F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)") + 1 + F.round(F.col("value") * 100).cast("bigint")).alias("end"),
        F.when(F.col("event_type").isin("error", "signup"), "-").otherwise("+").alias("strand"), family.alias("gene_family"), F.col("event_id").alias("hit_row"), F.col("event_id").alias("locus_row"), F.concat(F.lit("P"), F.col("event_id").cast("string")).alias("protein_id"), F.col("value"),
    )


def _rolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.roll_up(C.number_gap_clusters(event_loci(spark, sf_dir), SYNTENY))


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = event_loci(spark, sf_dir).filter("seqid % 2 = 0").groupBy("accession", "seqid").agg((F.max("end") + 500).alias("contig_length"))
    return ends


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.with_truncation(C.with_types(_rolled(spark, sf_dir)), SYNTENY, _lengths(spark, sf_dir))


def w1_gap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rolled(spark, sf_dir).select("accession", "cluster_id", "seqid", "start", "end", "gene_count")


def a4_cluster_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rolled(spark, sf_dir).select("accession", "cluster_id", "span_bp", F.array_join("gene_families", ",").alias("gene_families"), F.array_join("protein_ids", ",").alias("protein_ids"), F.array_join("strands", "").alias("strands"))


def a5_strand_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rolled(spark, sf_dir).select("accession", "cluster_id", F.col("strand_switches").cast("bigint").alias("strand_switches"))


def pr7_truncation_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _described(spark, sf_dir).select("accession", "cluster_id", "is_truncated", "truncated_side", "quality_status")


def pr9_cluster_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.with_types(_rolled(spark, sf_dir)).select("accession", "cluster_id", "cluster_type", "has_catalytic_core", "has_any_core_subunit")


def f7_valid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.valid_clusters(_described(spark, sf_dir), SYNTENY).select("accession", "cluster_id")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    pfam = F.create_map(*[F.lit(x) for s, p in X.CORE_MARKERS.items() for x in (s, p)])
    clusters = _rolled(spark, sf_dir).withColumn("gene_families", F.transform("gene_families", lambda f: F.coalesce(F.try_element_at(pfam, f), f)))
    genomes = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("accession")).distinct().unionAll(spark.range(10, 12).select(F.col("id").alias("accession")))
    return capability_scores(genomes.withColumn("status", F.when(F.col("accession") == 11, "FAILED").otherwise("SUCCESS")), clusters)


def pr12_capability_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("accession", "clusters_found", "confidence_score_percent", "bnf_capable")


def a32_batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_summary(_scored(spark, sf_dir))


def k6_report_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("accession"), F.col("n_name").alias("organism_name")).filter("accession < 7")
    return flat_report(_scored(spark, sf_dir).join(names, "accession", "left"))


def a13_overlap_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "value", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)").alias("start"))
    hits = events.withColumn("end", F.col("start") + F.floor(F.col("value") * 1000).cast("bigint"))
    return resolve_overlaps(hits, ["user_id"], "start", "end", [("value", True), ("event_id", False)], 0.2).select("user_id", "event_id")


def _alias_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    hits = table(spark, sf_dir, "events").select(F.lit("g").alias("accession"), F.col("event_id").alias("hit_row"), F.concat(F.lit("P"), (F.col("user_id") % 100).cast("string")).alias("target_protein"))
    name = lambda c: F.array(F.concat(F.lit("P"), c.cast("string")))
    key = F.col("s_suppkey")
    loci = table(spark, sf_dir, "supplier").select(F.lit("g").alias("accession"), key.alias("locus_row"), name(key % 30).alias("direct_aliases"), name(F.lit(25) + key % 60).alias("inferred_aliases"))
    return hits, loci


def j1_alias_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.resolve_hits(*_alias_inputs(spark, sf_dir), ["accession"]).select("hit_row", "locus_row")


def j5_unmatched_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.unmatched_hits(*_alias_inputs(spark, sf_dir), ["accession"]).select("hit_row", "protein_id")


def a3_match_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.match_statistics(*_alias_inputs(spark, sf_dir), ["accession"]).drop("accession")


def _annotation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as annotation lines with plain, escaped, repeated and odd attributes."""
    return spark.sql(
        """SELECT concat('GCF_00000000', CAST(p_size % 5 AS STRING), '.1') AS accession, p_partkey AS line_no, concat_ws('\t', concat('ctg', CAST(p_size AS STRING)), CASE WHEN p_partkey % 4 = 0 THEN 'Prodigal' ELSE 'RefSeq' END,
  CASE WHEN p_partkey % 9 = 8 THEN 'gene' ELSE 'CDS' END, CAST(p_partkey AS STRING), CAST(p_partkey + 3 * p_size AS STRING), '.', CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END, '0',
  concat('ID=', CASE WHEN p_partkey % 4 = 0 THEN concat('1_', CAST(p_partkey AS STRING)) ELSE concat('cds-', CAST(p_partkey AS STRING)) END,
    ';locus_tag= ', p_brand, ' ;Note=a%2Cb+c;Note=', replace(p_brand, '#', '%23'),
    CASE WHEN p_partkey % 3 = 0 THEN concat(';protein_id=WP_', CAST(p_partkey AS STRING), '.1, WP_0.1') ELSE '' END,
    CASE WHEN p_partkey % 5 = 0 THEN concat(';Dbxref=GenBank:AB', CAST(p_size AS STRING), ',Other:zz,REFSEQ: NP_7') ELSE '' END,
    CASE WHEN p_partkey % 7 = 0 THEN ';Name=AB_12.1' WHEN p_partkey % 7 = 1 THEN ';Name=not like it' ELSE '' END)) AS value
FROM {part} ORDER BY p_partkey""",
        part=table(spark, sf_dir, "part"),
    )


def s8_annotation_loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    loci, _ = L.annotation_loci(_annotation_lines(spark, sf_dir), strict=False)
    return loci.select("accession", "locus_row", "seqid", "start", "end", "strand", "protein_id", "locus_tag", "gff_id")


def f5_alias_builder(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _annotation_lines(spark, sf_dir).withColumn("p", F.split("value", "\t")).withColumn("a", attribute_map(F.col("p")[8]))
    return lines.select("line_no", F.array_join(direct_aliases(F.col("a")), "|").alias("direct"), F.array_join(inferred_aliases(F.col("p")[0], F.col("p")[1], F.col("a")), "|").alias("inferred"))


def f3_attribute_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = attribute_map(F.split("value", "\t")[8])
    return _annotation_lines(spark, sf_dir).select("line_no", F.try_element_at(a, F.lit("Note")).alias("note"), F.try_element_at(a, F.lit("locus_tag")).alias("locus_tag"), F.size(a).cast("bigint").alias("n_attributes"))


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Register rows as file paths of all kinds."""
    return spark.sql(
        """SELECT concat('/data', CAST(tax_id % 2 AS STRING), '/', CASE tax_id % 5 WHEN 0 THEN concat('up/', accession, '/') ELSE '' END,
  CASE tax_id % 5 WHEN 0 THEN 'file' ELSE accession END,
  CASE tax_id % 11 WHEN 0 THEN '_protein.faa' WHEN 1 THEN '_genomic.gff' WHEN 2 THEN '_genomic.fna' WHEN 3 THEN '.FASTA' WHEN 4 THEN '_cds_from_genomic.fna' WHEN 5 THEN '.gff3' WHEN 6 THEN '.zip' WHEN 7 THEN '_md5sum.txt' WHEN 8 THEN '.faa' WHEN 9 THEN '_assembly_report.jsonl' ELSE '_protein.faa.gz' END) AS path,
  CAST(tax_id % 2 AS INT) AS root_priority, 1 AS length FROM {register}""",
        register=table(spark, sf_dir, "assembly_metadata").select(F.coalesce("accession", F.lit("none")).alias("accession"), F.coalesce("tax_id", F.lit(0)).alias("tax_id")),
    ).distinct()


def s5_best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_files(_paths(spark, sf_dir))


def pr19_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _paths(spark, sf_dir).withColumn("to", standard_name(F.col("path")))
    return named.select("path", F.col("to.folder").alias("folder"), F.col("to.name").alias("name"), is_canonical_name(F.col("path")).alias("is_canonical"))


def s1_list_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "label_manifest").select(F.col("label_id").alias("line_no"), F.coalesce("assembly_accession", F.lit("")).alias("value"))
    return distinct_in_order(accession_list(lines, strict=False)[0])


def _placed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The register's files with a digest that copies under both roots share, and the places that annotations already fill."""
    files = _paths(spark, sf_dir).withColumn("md5", F.md5(F.regexp_replace("path", "^/data[01]", "").cast("binary")))
    held = files.withColumn("to", standard_name(F.col("path"))).filter("to.name LIKE '%.gff'").select("to.folder", "to.name").distinct()
    return files, held.withColumn("md5", F.md5(F.concat(F.lit("/"), F.regexp_replace("name", "_genomic", "")).cast("binary")))


def k9_move_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What happens to each file: moved, dropped as a copy, a conflict, or skipped."""
    return move_plan(*_placed(spark, sf_dir))


def a31_move_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return move_statistics(move_plan(*_placed(spark, sf_dir)))


def _report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as report files: a blank first line in some, fields that are missing, a second record that does not count."""
    rows = table(spark, sf_dir, "label_manifest")
    path = F.concat(F.lit("/reports/"), F.col("label_id").cast("string"), F.when(F.col("label_id") % 2 == 0, "/GCF_000000001.1").otherwise("/x"), F.lit("/report.jsonl"))
    organism = F.struct(F.col("organism_name").alias("organismName"), F.when(F.col("label_id") % 7 != 0, (F.col("label_id") % 1000).cast("int")).alias("taxId"))
    record = F.to_json(F.struct(F.col("assembly_accession").alias("accession"), organism.alias("organism"), F.struct(F.col("strain").alias("assemblyLevel")).alias("assemblyInfo")))
    lines = F.concat(F.when(F.col("label_id") % 3 == 0, F.array(F.lit(" \t"))).otherwise(F.array().cast("array<string>")), F.array(record, F.lit('{"accession": "second"}')))
    return rows.select(path.alias("path"), F.posexplode(lines).alias("n", "value")).select("path", (F.col("n") + 1).alias("line_no"), "value")


def s9_json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_fields(_report_lines(spark, sf_dir))


def _scored_hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Order lines as search hits, with return flag and line status as profile file, and the models of each file."""
    size = F.col("l_quantity").cast("int")
    hits = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("accession"), F.col("l_linenumber").alias("hit_no"), F.concat("l_returnflag", "l_linestatus").alias("profile_file"), (F.col("l_extendedprice").cast("double") / 500).alias("raw_score"), F.col("l_tax").cast("double").alias("bias"), (F.col("l_discount").cast("double") * 2e-9).alias("seq_evalue"), (F.col("l_tax").cast("double") * 2e-9).alias("dom_evalue"),
        F.lit(1).alias("hmm_from"), (size + 25).alias("hmm_to"), F.lit(70).alias("hmm_len"), F.lit(10).alias("env_from"), (size + 30).alias("env_to"), F.when(F.col("l_linenumber") == 7, 0).otherwise(75).alias("target_len"),
    )
    models = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("profile_file"), ((F.col("l_returnflag") == "A") | (F.col("l_linenumber") < 7)).alias("has_trusted_cutoff")).distinct()
    return hits, models


def pr5_hit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = with_scores(_scored_hits(spark, sf_dir)[0], bias_corrected=False)
    return got.select("accession", "hit_no", F.round("effective_score", 6).alias("effective_score"), "query_cov", "target_cov")


def f4_passing_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits within score, e-value and coverage thresholds, with trusted cutoffs where all models of a file have one."""
    hits, models = _scored_hits(spark, sf_dir)
    return passing_hits(with_scores(hits), Alignment(), models).select("accession", "hit_no", "profile_file")


def f6_trusted_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trusted_profiles(_scored_hits(spark, sf_dir)[1])


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The accessions of the labels, and files of which every second label has a protein and every third an annotation file."""
    rows = table(spark, sf_dir, "label_manifest").select("label_id", F.coalesce("assembly_accession", F.lit("")).alias("value"))
    ends = F.array_compact(F.array(F.when(F.col("label_id") % 2 == 0, "_protein.faa"), F.when(F.col("label_id") % 3 == 0, "_genomic.gff"), F.when(F.col("label_id") % 5 == 0, ".zip")))
    files = rows.select("value", F.explode(ends).alias("end")).select(F.concat(F.lit("/in/"), "value", "end").alias("path"), F.lit(0).alias("root_priority"))
    return distinct_in_order(accession_list(rows.withColumnRenamed("label_id", "line_no"), strict=False)[0]), best_files(files)


def f15_missing_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing_inputs(*_inputs(spark, sf_dir))


def f14_runnable(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed, files = _inputs(spark, sf_dir)
    return runnable(listed, files, missing_inputs(listed, files)).select("accession")


def a30_missing_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing_triplets(best_files(_paths(spark, sf_dir)))


def a3_match_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names behind a3_match_stats, whole."""
    return L.match_lists(*_alias_inputs(spark, sf_dir), ["accession"]).drop("accession")


def t6_feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide table of `GenomeFeaturizer` per genome: some of each block."""
    genomes, hits = _event_hits(spark, sf_dir)
    kind = F.when(F.col("accession") % 4 == 0, "even").when(F.col("accession") % 4 == 1, None).otherwise("odd")
    genomes = genomes.withColumns({"phylum": kind, "genome_size": F.col("accession").cast("double")})
    got = X.GenomeFeaturizer(numeric_columns=("genome_size",)).fit_transform(genomes, hits, C.with_types(_rolled(spark, sf_dir)))
    picked = ("pfam_tfidf_nifH", "tax_phylum_even", "tax_phylum_unknown", "tax_phylum_infrequent", "tax_genus_unknown", "meta_num_genome_size")
    return got.select("accession", "status", "marker_core_nifH_count", "clusters_found", *[F.round(c, 6).alias(c) for c in picked], F.lit(len(got.columns)).alias("n_columns"))


def _event_hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    hits = event_loci(spark, sf_dir).select("accession", "gene_family", F.col("value").alias("effective_score"), (F.col("value") / 1000).alias("seq_evalue"))
    return event_loci(spark, sf_dir).select("accession").distinct().unionAll(spark.range(10, 12).select(F.col("id").alias("accession"))), hits


def a6_marker_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = X.marker_features(*_event_hits(spark, sf_dir))
    picked = [c for c in got.columns if c.startswith("marker_") or c.endswith("_min_evalue") and not c.startswith("-")]
    return got.select("accession", *[F.round(c, 6).alias(c) if c.endswith("neg_log_evalue") else c for c in picked], F.round("operon_core_completeness_score", 6).alias("completeness"))


def a9_cluster_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    genomes = event_loci(spark, sf_dir).select("accession").distinct().unionAll(spark.range(10, 11).select(F.col("id").alias("accession")))
    got = X.cluster_features(genomes, C.with_types(_rolled(spark, sf_dir)))
    return got.withColumn("cluster_avg_span_bp", F.round("cluster_avg_span_bp", 4))


def t1_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counts = X.term_counts(docs, "doc_id", "text")
    vocabulary = X.fit_vocabulary(counts, docs.count())
    return vocabulary.select("term", "total", "df", F.round("idf", 6).alias("idf"))


def t1_tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum and greatest weight per vocabulary term over all documents."""
    docs = table(spark, sf_dir, "documents")
    counts = X.term_counts(docs, "doc_id", "text")
    weights = X.tfidf(counts, X.fit_vocabulary(counts, docs.count()), "doc_id")
    return weights.groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.sum("weight"), 4).alias("total_weight"), F.round(F.max("weight"), 6).alias("max_weight"))


def t2_onehot_min_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.fit_categories(table(spark, sf_dir, "documents"), "source").select("category", "n", "bucket")


def t3_impute_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("c_acctbal"))
    got = X.scaled(df, "c_custkey", X.fit_scaling(df, ["c_acctbal"]))
    return got.select("c_custkey", F.round("meta_num_c_acctbal", 6).alias("scaled"))


def x_session_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fixed_gap_sessions(table(spark, sf_dir, "events"), "user_id", "ts", 15000)
    return out.select("user_id", F.col("first_at").cast("timestamp_ntz").alias("first_at"), F.col("last_at").cast("timestamp_ntz").alias("last_at"), "n_events")


def x_stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream over the table's files, run until all is read."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    place = f"{shared_dir(spark)}/sessions-{uuid.uuid4().hex}"
    sessions = fixed_gap_sessions(stream, "user_id", "ts", 15000)
    keep = lambda batch, _: batch.write.mode("overwrite").parquet(f"{place}/out")
    query = sessions.writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{place}/log").foreachBatch(keep).start()
    query.awaitTermination()
    out = spark.read.parquet(f"{place}/out")
    return out.select("user_id", F.col("first_at").cast("timestamp_ntz").alias("first_at"), F.col("last_at").cast("timestamp_ntz").alias("last_at"), "n_events")


QUERIES = {
    f.__name__: f
    for f in (
        w1_gap_clusters, a4_cluster_rollup, a5_strand_switches, pr7_truncation_side, pr9_cluster_type, f7_valid_clusters, pr12_capability_score, a32_batch_summary, k6_report_projection, a13_overlap_resolution, j1_alias_resolution, j5_unmatched_hits, a3_match_stats,
        s8_annotation_loci, f5_alias_builder, f3_attribute_parse, s5_best_candidate, pr19_classify, s1_list_scan, k9_move_plan, a31_move_statistics, s9_json_report, pr5_hit_scores, f4_passing_hits, f6_trusted_profiles, f14_runnable, f15_missing_inputs, a30_missing_triplets, a3_match_lists, t6_feature_matrix, a6_marker_pivot, a9_cluster_features, t1_tfidf, t1_tfidf_weights, t2_onehot_min_freq, t3_impute_scale, x_session_batches, x_stream_sessions,
    )
}

_LOCI = """
loci AS (SELECT user_id % 10 AS accession, user_id AS seqid, date_diff('second', TIMESTAMP '2024-01-01', ts) + 1 AS start, date_diff('second', TIMESTAMP '2024-01-01', ts) + 1 + round(value * 100)::BIGINT AS "end",
  CASE WHEN event_type IN ('error', 'signup') THEN '-' ELSE '+' END AS strand,
  CASE event_type WHEN 'click' THEN 'nifH' WHEN 'view' THEN 'nifD' WHEN 'purchase' THEN 'nifK' WHEN 'signup' THEN 'vnfG' WHEN 'error' THEN 'anfG' END AS family, event_id, 'P' || event_id AS protein, value FROM events)"""
_CLUSTERS = f"""{_LOCI},
o AS (SELECT *, max("end") OVER (PARTITION BY accession, seqid ORDER BY start, "end", event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach,
  lag(strand) OVER (PARTITION BY accession, seqid ORDER BY start, "end", event_id) AS prev FROM loci),
b AS (SELECT *, CASE WHEN reach IS NULL OR greatest(0, start - reach - 1) > CASE WHEN prev = '-' AND strand = '+' THEN 5000 ELSE 15000 END THEN 1 ELSE 0 END AS brk FROM o),
n AS (SELECT *, sum(brk) OVER (PARTITION BY accession ORDER BY seqid, start, "end", event_id ROWS UNBOUNDED PRECEDING) AS no FROM b),
fam AS (SELECT accession, no, coalesce(family, 'unknown') AS family, min((start, "end", event_id)) AS first FROM n GROUP BY ALL),
fams AS (SELECT accession, no, list(family ORDER BY first) AS families FROM fam GROUP BY ALL),
c0 AS (SELECT accession, no, 'cluster_' || CASE WHEN no < 10000 THEN lpad(no::VARCHAR, 4, '0') ELSE no::VARCHAR END AS cluster_id, min(seqid) AS seqid, min(start) AS start, max("end") AS "end", max("end") - min(start) + 1 AS span_bp,
  count(*) AS gene_count, string_agg(protein, ',' ORDER BY start, "end", event_id) AS protein_ids, string_agg(strand, '' ORDER BY start, "end", event_id) AS strands FROM n GROUP BY ALL),
clusters AS (SELECT * FROM c0 JOIN fams USING (accession, no))"""
_TYPED = f"""{_CLUSTERS},
typed AS (SELECT *, list_contains(families, 'nifH') AS h, list_contains(families, 'nifD') AS d, list_contains(families, 'nifK') AS k, list_contains(families, 'vnfG') AS v, list_contains(families, 'anfG') AS a FROM clusters),
cores AS (SELECT *, h::INT + d::INT + k::INT >= 2 AS core, h OR d OR k AS any_core FROM typed),
lengths AS (SELECT accession, seqid, max("end") + 500 AS len FROM loci WHERE seqid % 2 = 0 GROUP BY ALL),
sides AS (SELECT cores.*, start <= 1000 AS five, coalesce(len - "end" <= 1000, false) AS three FROM cores LEFT JOIN lengths USING (accession, seqid))"""
_GENOMES = """genomes AS (SELECT DISTINCT user_id % 10 AS accession FROM events UNION ALL SELECT unnest([10, 11]))"""
_SCORED = f"""{_CLUSTERS}, {_GENOMES},
scored AS (SELECT g.accession, CASE WHEN g.accession = 11 THEN 'FAILED' ELSE 'SUCCESS' END AS status, count(c.no) AS clusters_found,
  coalesce(max(35.0 * list_contains(families, 'nifH')::INT + 35.0 * list_contains(families, 'nifD')::INT + 30.0 * list_contains(families, 'nifK')::INT), 0)::DOUBLE AS confidence_score_percent
  FROM genomes g LEFT JOIN clusters c USING (accession) GROUP BY ALL)"""
_ALIASES = """
hits AS (SELECT event_id, 'P' || (user_id % 100) AS p FROM events),
direct AS (SELECT s_suppkey, 'P' || (s_suppkey % 30) AS p FROM supplier),
inferred AS (SELECT s_suppkey, 'P' || (25 + s_suppkey % 60) AS p FROM supplier WHERE 25 + s_suppkey % 60 <> s_suppkey % 30),
loose AS (SELECT * FROM inferred WHERE p NOT IN (SELECT p FROM direct)),
usable AS (SELECT * FROM direct UNION ALL SELECT * FROM loose WHERE p IN (SELECT p FROM loose GROUP BY p HAVING count(*) = 1))"""
_PARTS = """
ann AS (SELECT *, p_partkey % 4 = 0 AS called, p_partkey::VARCHAR AS k, 'ctg' || p_size AS seqid FROM part)"""
_PATHS = """
paths AS (SELECT DISTINCT accession AS acc, tax_id % 2 AS root, tax_id % 5 = 0 AS up, tax_id % 11 AS kind,
  '/data' || (tax_id % 2) || '/' || CASE WHEN tax_id % 5 = 0 THEN 'up/' || accession || '/' ELSE '' END || CASE WHEN tax_id % 5 = 0 THEN 'file' ELSE accession END ||
  ['_protein.faa', '_genomic.gff', '_genomic.fna', '.FASTA', '_cds_from_genomic.fna', '.gff3', '.zip', '_md5sum.txt', '.faa', '_assembly_report.jsonl', '_protein.faa.gz'][tax_id % 11 + 1] AS path
  FROM (SELECT coalesce(accession, 'none') AS accession, coalesce(tax_id, 0) AS tax_id FROM assembly_metadata)),
found AS (SELECT *, nullif(regexp_extract(path, 'GC[AF]_[0-9]+\\.[0-9]+'), '') AS accession FROM paths)"""
_PLAN = f"""{_PATHS}, f AS (SELECT *, string_split(path, '/')[-1] AS file FROM found),
named AS (SELECT path, md5(path[7:]) AS digest, CASE WHEN kind = 6 THEN 'zip' WHEN accession IS NULL THEN NULL WHEN kind IN (7, 9) THEN 'metadata' ELSE 'genomes' END AS folder,
  CASE WHEN kind = 6 THEN coalesce(accession || '.zip', file) WHEN accession IS NOT NULL THEN accession || ['_protein.faa', '_genomic.gff', '_genomic.fna', '_genomic.fna', '_genomic.fna', '_genomic.gff', '', '_md5sum.txt', '_protein.faa', '_assembly_report.jsonl', '_protein.faa.gz'][kind + 1] END AS name FROM f),
held AS (SELECT DISTINCT folder, name, md5('/' || replace(name, '_genomic', '')) AS old FROM named WHERE name LIKE '%.gff'),
plan AS (SELECT path, n.folder, n.name, CASE WHEN n.name IS NULL THEN 'skip' WHEN old IS NULL AND row_number() OVER w = 1 THEN 'move' WHEN coalesce(old, first(digest) OVER w) = digest THEN 'drop' ELSE 'conflict' END AS action
  FROM named n LEFT JOIN held h ON h.folder = n.folder AND h.name = n.name WINDOW w AS (PARTITION BY n.folder, n.name ORDER BY path))"""
_HITS = """
hits AS (SELECT l_orderkey AS accession, l_linenumber AS hit_no, l_returnflag || l_linestatus AS profile_file, l_extendedprice::DOUBLE / 500 AS raw_score, l_tax::DOUBLE AS bias, l_discount::DOUBLE * 2e-9 AS seq_evalue, l_tax::DOUBLE * 2e-9 AS dom_evalue,
  round((l_quantity::INT + 25) / 70.0::DOUBLE, 4) AS query_cov, CASE WHEN l_linenumber = 7 THEN 0.0::DOUBLE ELSE round((l_quantity::INT + 21) / 75.0::DOUBLE, 4) END AS target_cov FROM lineitem),
trusted AS (SELECT l_returnflag || l_linestatus AS profile_file, bool_and(l_returnflag = 'A' OR l_linenumber < 7) AS use_trusted FROM lineitem GROUP BY 1)"""
_TRIPLETS = f"""{_PATHS}, kinds AS (SELECT accession, bool_or(kind IN (0, 8)) AS faa, bool_or(kind IN (1, 5)) AS gff, bool_or(kind IN (2, 3)) AS fna FROM found WHERE accession IS NOT NULL AND kind IN (0, 8, 1, 5, 2, 3) GROUP BY accession)"""
_INPUTS = f"""
kinds AS (SELECT regexp_extract(assembly_accession, 'GC[AF]_[0-9]+\\.[0-9]+') AS accession, bool_or(label_id % 2 = 0) AS faa, bool_or(label_id % 3 = 0) AS gff FROM label_manifest WHERE regexp_matches(assembly_accession, 'GC[AF]_[0-9]+\\.[0-9]+') GROUP BY 1),
v AS (SELECT regexp_replace(assembly_accession, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS accession FROM label_manifest),
listed AS (SELECT DISTINCT accession FROM v WHERE regexp_full_match(accession, 'GC[AF]_[0-9]+\\.[0-9]+'))"""
_WORDS = """
n AS (SELECT count(*) AS docs FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS term FROM documents) GROUP BY ALL),
voc AS (SELECT term, sum(tf)::BIGINT AS total, count(*) AS df, ln((1 + any_value(docs))::DOUBLE / (1 + count(*))) + 1 AS idf FROM tf, n GROUP BY term ORDER BY total DESC, term LIMIT 1000)"""
_MARK = lambda g: f"""count(*) FILTER (family = '{g}') AS n_{g}, max(value) FILTER (family = '{g}') AS s_{g}, min(value / 1000) FILTER (family = '{g}') AS e_{g}"""
_MARKS = lambda g, p: f"""coalesce(n_{g}, 0) AS marker_core_{g}_count, coalesce(s_{g}, 0.0)::DOUBLE AS marker_core_{g}_max_bitscore, round(coalesce(-log10(greatest(0, e_{g}) + 1e-300), 0.0)::DOUBLE, 6) AS marker_core_{g}_neg_log_evalue, coalesce(e_{g}, 1.0)::DOUBLE AS {p}_min_evalue"""

SQL = {
    "w1_gap_clusters": f"""WITH {_CLUSTERS} SELECT accession, cluster_id, seqid, start, "end", gene_count FROM clusters""",
    "a4_cluster_rollup": f"WITH {_CLUSTERS} SELECT accession, cluster_id, span_bp, array_to_string(families, ',') AS gene_families, protein_ids, strands FROM clusters",
    "a5_strand_switches": f"WITH {_CLUSTERS} SELECT accession, cluster_id, (length(replace(strands, '+-', '+:-')) + length(replace(strands, '-+', '-:+')) - 2 * length(strands))::BIGINT AS strand_switches FROM clusters",
    "pr7_truncation_side": f"""WITH {_TYPED} SELECT accession, cluster_id, five OR three AS is_truncated, CASE WHEN five AND three THEN 'both' WHEN five THEN '5prime' WHEN three THEN '3prime' END AS truncated_side,
  CASE WHEN core AND NOT (five OR three) THEN 'complete' WHEN (five OR three) AND any_core THEN 'partial_truncated' ELSE 'accessory_only' END AS quality_status FROM sides""",
    "pr9_cluster_type": f"""WITH {_TYPED} SELECT accession, cluster_id, CASE WHEN v THEN 'vnf' WHEN a THEN 'anf' WHEN any_core THEN 'nif' ELSE 'accessory' END AS cluster_type, core AS has_catalytic_core, any_core AS has_any_core_subunit FROM cores""",
    "f7_valid_clusters": f"WITH {_TYPED} SELECT accession, cluster_id FROM sides WHERE (len(families) >= 2 AND core) OR ((five OR three) AND any_core)",
    "pr12_capability_score": f"WITH {_SCORED} SELECT accession, clusters_found, confidence_score_percent, confidence_score_percent >= 70 AS bnf_capable FROM scored",
    "a32_batch_summary": f"WITH {_SCORED} SELECT count(*) AS n_genomes, count(*) FILTER (status = 'SUCCESS') AS n_success, count(*) FILTER (confidence_score_percent >= 70) AS n_capable FROM scored",
    "k6_report_projection": f"""WITH {_SCORED} SELECT accession, coalesce(n_name, 'N/A') AS organism_name, status, confidence_score_percent >= 70 AS bnf_capable, confidence_score_percent, clusters_found, '' AS error
FROM scored LEFT JOIN nation ON accession = n_nationkey AND accession < 7""",
    "a13_overlap_resolution": """WITH h AS (SELECT user_id, event_id, value, date_diff('second', TIMESTAMP '2024-01-01', ts) AS s, date_diff('second', TIMESTAMP '2024-01-01', ts) + floor(value * 1000)::BIGINT AS e FROM events),
g AS (SELECT user_id, list({'i': event_id, 's': s, 'e': e} ORDER BY value DESC, event_id) AS xs FROM h GROUP BY user_id),
k AS (SELECT user_id, list_reduce(list_transform(xs, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: least(y.e, x[1].e) - greatest(y.s, x[1].s) + 1 > 0
  AND (least(y.e, x[1].e) - greatest(y.s, x[1].s) + 1)::DOUBLE / (least(y.e - y.s, x[1].e - x[1].s) + 1) > 0.2)) > 0 THEN acc ELSE list_concat(acc, x) END) AS kept FROM g)
SELECT user_id, r.i AS event_id FROM (SELECT user_id, unnest(kept) AS r FROM k)""",
    "j1_alias_resolution": f"WITH {_ALIASES} SELECT DISTINCT event_id AS hit_row, s_suppkey AS locus_row FROM hits JOIN usable USING (p)",
    "j5_unmatched_hits": f"WITH {_ALIASES} SELECT event_id AS hit_row, p AS protein_id FROM hits WHERE p NOT IN (SELECT p FROM usable)",
    "a3_match_stats": f"""WITH {_ALIASES} SELECT count(*) AS hit_rows, count(*) FILTER (p IN (SELECT p FROM usable)) AS matched_rows, count(DISTINCT p) FILTER (p NOT IN (SELECT p FROM usable)) AS unmatched_ids,
  (SELECT count(*) FROM (SELECT p FROM usable GROUP BY p HAVING count(*) > 1)) AS multi_match_aliases, (SELECT count(*) FROM (SELECT p FROM loose GROUP BY p HAVING count(*) > 1)) AS ambiguous_aliases FROM hits""",
    "s8_annotation_loci": f"""WITH {_PARTS} SELECT 'GCF_00000000' || (p_size % 5) || '.1' AS accession, p_partkey AS locus_row, seqid, p_partkey AS start, p_partkey + 3 * p_size AS "end", CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand,
  CASE WHEN p_partkey % 3 = 0 THEN 'WP_' || k || '.1, WP_0.1' WHEN called THEN seqid || '_' || k ELSE k END AS protein_id, p_brand AS locus_tag, CASE WHEN called THEN '1_' || k ELSE 'cds-' || k END AS gff_id FROM ann WHERE p_partkey % 9 <> 8 AND p_partkey >= 1""",
    "f5_alias_builder": f"""WITH {_PARTS}, l AS (SELECT p_partkey AS line_no,
  list_concat(CASE WHEN p_partkey % 3 = 0 THEN ['WP_' || k || '.1', 'WP_0.1'] ELSE [] END, CASE WHEN p_partkey % 5 = 0 THEN ['AB' || p_size, 'NP_7'] ELSE [] END, CASE WHEN p_partkey % 7 = 0 THEN ['AB_12.1'] ELSE [] END) AS d,
  list_concat([p_brand], CASE WHEN called THEN ['1_' || k, seqid || '_' || k] ELSE ['cds-' || k, k] END) AS i FROM ann)
SELECT line_no, array_to_string(list_sort(list_distinct(d)), '|') AS direct, array_to_string(list_sort(list_distinct(list_filter(i, lambda x: NOT list_contains(d, x)))), '|') AS inferred FROM l""",
    "f3_attribute_parse": f"""WITH {_PARTS} SELECT p_partkey AS line_no, p_brand AS note, p_brand AS locus_tag, (3 + (p_partkey % 3 = 0)::INT + (p_partkey % 5 = 0)::INT + (p_partkey % 7 < 2)::INT)::BIGINT AS n_attributes FROM ann""",
    "s5_best_candidate": f"""WITH {_PATHS}, kinds AS (SELECT *, CASE WHEN kind IN (0, 8) THEN 'faa' WHEN kind IN (1, 5) THEN 'gff' WHEN kind IN (2, 3) THEN 'fna' END AS file_type, kind IN (0, 1, 2) AS canonical FROM found)
SELECT accession, file_type, arg_min(path, (root, (NOT canonical)::INT, path)) AS path FROM kinds WHERE accession IS NOT NULL AND file_type IS NOT NULL GROUP BY ALL""",
    "pr19_classify": f"""WITH {_PATHS}, f AS (SELECT *, string_split(path, '/')[-1] AS file FROM found)
SELECT path, CASE WHEN kind = 6 THEN 'zip' WHEN accession IS NULL THEN NULL WHEN kind IN (7, 9) THEN 'metadata' ELSE 'genomes' END AS folder,
  CASE WHEN kind = 6 THEN coalesce(accession || '.zip', file) WHEN accession IS NOT NULL THEN accession || ['_protein.faa', '_genomic.gff', '_genomic.fna', '_genomic.fna', '_genomic.fna', '_genomic.gff', '', '_md5sum.txt', '_protein.faa', '_assembly_report.jsonl', '_protein.faa.gz'][kind + 1] END AS name,
  kind IN (0, 1, 2, 4) AS is_canonical FROM f""",
    "s1_list_scan": """WITH v AS (SELECT label_id, regexp_replace(assembly_accession, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') AS accession FROM label_manifest)
SELECT accession, min(label_id) AS ordinal FROM v WHERE regexp_full_match(accession, 'GC[AF]_[0-9]+\\.[0-9]+') GROUP BY accession""",
    "k9_move_plan": f"WITH {_PLAN} SELECT path, folder, name, action FROM plan",
    "a31_move_statistics": f"WITH {_PLAN} SELECT action, coalesce(folder, '') AS folder, count(*) AS n_files FROM plan GROUP BY ALL",
    "s9_json_report": f"""SELECT '/reports/' || label_id || CASE WHEN label_id % 2 = 0 THEN '/GCF_000000001.1' ELSE '/x' END || '/report.jsonl' AS path, CASE WHEN assembly_accession IS NOT NULL THEN assembly_accession WHEN label_id % 2 = 0 THEN 'GCF_000000001.1' END AS accession,
  coalesce(organism_name, 'Unknown') AS organism_name, CASE WHEN label_id % 7 <> 0 THEN label_id % 1000 ELSE 0 END AS tax_id, coalesce(strain, 'Unknown') AS assembly_level FROM label_manifest""",
    "pr5_hit_scores": f"WITH {_HITS} SELECT accession, hit_no, round(raw_score + bias, 6) AS effective_score, query_cov, target_cov FROM hits",
    "f4_passing_hits": f"WITH {_HITS} SELECT accession, hit_no, profile_file FROM hits JOIN trusted USING (profile_file) WHERE (use_trusted OR raw_score >= 80) AND seq_evalue <= 1e-10 AND dom_evalue <= 1e-10 AND query_cov >= 0.7 AND target_cov >= 0.7",
    "f6_trusted_profiles": f"WITH {_HITS} SELECT profile_file, use_trusted FROM trusted",
    "f14_runnable": f"WITH {_INPUTS} SELECT accession FROM listed JOIN kinds USING (accession) WHERE faa AND gff",
    "f15_missing_inputs": f"""WITH {_INPUTS} SELECT accession, concat_ws(' and ', CASE WHEN NOT coalesce(faa, false) THEN 'no protein file' END, CASE WHEN NOT coalesce(gff, false) THEN 'no annotation file' END) AS reason
FROM listed LEFT JOIN kinds USING (accession) WHERE NOT coalesce(faa AND gff, false)""",
    "a30_missing_triplets": f"WITH {_TRIPLETS} SELECT accession, faa, gff, fna FROM kinds WHERE NOT (faa AND gff AND fna)",
    "a3_match_lists": f"""WITH {_ALIASES} SELECT DISTINCT 'unmatched_id' AS kind, p AS name FROM hits WHERE p NOT IN (SELECT p FROM usable)
UNION ALL SELECT 'multi_match_alias', p FROM usable GROUP BY p HAVING count(*) > 1 UNION ALL SELECT 'ambiguous_alias', p FROM loose GROUP BY p HAVING count(*) > 1""",
    "t6_feature_matrix": f"""WITH {_CLUSTERS}, g AS (SELECT DISTINCT accession FROM loci UNION ALL SELECT unnest([10, 11])),
tf AS (SELECT accession, family, count(*) AS tf FROM loci WHERE family IS NOT NULL GROUP BY ALL),
idf AS (SELECT family, ln((1 + (SELECT count(*) FROM g))::DOUBLE / (1 + count(*))) + 1 AS idf FROM tf GROUP BY family),
w AS (SELECT accession, family, (1 + ln(tf)) * idf AS w FROM tf JOIN idf USING (family)),
x AS (SELECT accession, sum(w) FILTER (family = 'nifH') / sqrt(sum(w * w)) AS x FROM w GROUP BY accession),
k AS (SELECT accession, CASE WHEN accession % 4 = 0 THEN 'even' WHEN accession % 4 = 1 THEN 'unknown' ELSE 'odd' END AS kind FROM g)
SELECT g.accession, 'SUCCESS' AS status, (SELECT count(*) FROM loci l WHERE l.accession = g.accession AND family = 'nifH') AS "marker_core_nifH_count", (SELECT count(*) FROM clusters c WHERE c.accession = g.accession) AS clusters_found,
  round(coalesce(x, 0), 6) AS "pfam_tfidf_nifH", (kind = 'even')::INT::DOUBLE AS tax_phylum_even, (kind = 'unknown')::INT::DOUBLE AS tax_phylum_unknown, 0.0::DOUBLE AS tax_phylum_infrequent, 1.0::DOUBLE AS tax_genus_unknown,
  round((g.accession - avg(g.accession) OVER ()) / stddev_pop(g.accession) OVER (), 6) AS meta_num_genome_size,
  2 + 25 + 8 + (SELECT count(*) FROM idf) + 4 + 4 * 2 + 1 AS n_columns FROM g LEFT JOIN x USING (accession) JOIN k USING (accession)""",
    "a6_marker_pivot": f"""WITH {_LOCI}, m AS (SELECT accession, {_MARK("nifH")}, {_MARK("nifD")}, {_MARK("nifK")}, count(*) FILTER (family = 'anfG') AS x_anfG, count(*) FILTER (family = 'vnfG') AS x_vnfG FROM loci GROUP BY ALL),
g AS (SELECT DISTINCT accession FROM loci UNION ALL SELECT unnest([10, 11]))
SELECT accession, {_MARKS("nifH", "PF00142")}, {_MARKS("nifD", "PF00148")}, {_MARKS("nifK", "PF02826")}, coalesce(x_anfG, 0) AS marker_aux_anfG_count, coalesce(x_vnfG, 0) AS marker_aux_vnfG_count,
  0::BIGINT AS marker_aux_fixA_count, 0::BIGINT AS marker_aux_fixB_count, 0::BIGINT AS marker_aux_fixC_count, 0::BIGINT AS marker_aux_fixX_count,
  round(((coalesce(n_nifH, 0) > 0)::INT + (coalesce(n_nifD, 0) > 0)::INT + (coalesce(n_nifK, 0) > 0)::INT) / 3.0::DOUBLE, 6) AS completeness FROM g LEFT JOIN m USING (accession)""",
    "a9_cluster_features": f"""WITH {_TYPED}, g AS (SELECT DISTINCT accession FROM loci UNION ALL SELECT 10)
SELECT accession, count(no) AS clusters_found, count(no) AS clusters_found_count, coalesce(max(span_bp), 0)::DOUBLE AS max_cluster_span_bp, coalesce(max(span_bp), 0)::DOUBLE AS cluster_max_span_bp, round(coalesce(avg(span_bp), 0)::DOUBLE, 4) AS cluster_avg_span_bp,
  coalesce(max(gene_count), 0)::BIGINT AS cluster_max_gene_count, count(*) FILTER (core) AS complete_hdk_clusters, count(*) FILTER (core) AS cluster_complete_hdk_count FROM g LEFT JOIN cores USING (accession) GROUP BY accession""",
    "t1_tfidf": f"WITH {_WORDS} SELECT term, total, df, round(idf, 6) AS idf FROM voc",
    "t1_tfidf_weights": f"""WITH {_WORDS}, w AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN voc USING (term)), s AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS x FROM w)
SELECT term, count(*) AS n_docs, round(sum(x), 4) AS total_weight, round(max(x), 6) AS max_weight FROM s GROUP BY term""",
    "t2_onehot_min_freq": """SELECT coalesce(source, 'unknown') AS category, count(*) AS n, CASE WHEN count(*) >= 0.01 * (SELECT count(*) FROM documents) THEN coalesce(source, 'unknown') ELSE 'infrequent' END AS bucket FROM documents GROUP BY coalesce(source, 'unknown')""",
    "t3_impute_scale": """WITH x AS (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS v FROM customer), m AS (SELECT median(v) AS med FROM x), y AS (SELECT c_custkey, coalesce(v, med) AS v FROM x, m)
SELECT c_custkey, round((v - avg(v) OVER ()) / stddev_pop(v) OVER (), 6) AS scaled FROM y""",
}
_SESSIONS = """WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 15000 SECOND THEN 0 ELSE 1 END AS brk FROM events),
s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM o)
SELECT user_id, min(ts) AS first_at, max(ts) AS last_at, count(*) AS n_events FROM s GROUP BY user_id, no"""
SQL |= {"x_session_batches": _SESSIONS, "x_stream_sessions": _SESSIONS}
