import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from genoplane.config import Alignment, ConfigError, SplitShares, Synteny, load_settings
from genoplane.operators import clusters as C
from genoplane.operators import features as X
from genoplane.operators import hotkeys as H
from genoplane.operators import loci as L
from genoplane.operators.hits import passing_hits, resolve_overlaps
from genoplane.operators.predict import capability_scores, flat_report

LOCI = "accession string, seqid string, start bigint, end bigint, strand string, gene_family string, hit_row bigint, locus_row bigint, protein_id string"


def brute_clusters(rows, s):
    out, last = [], {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3], r[6], r[7])):
        key = (r[0], r[1])
        if key in last:
            reach, strand, members = last[key]
            limit = s.max_divergent_gap_bp if strand == "-" and r[4] == "+" else s.max_gap_bp
            if max(0, r[2] - reach - 1) <= limit:
                members.append(r[7])
                last[key] = (max(reach, r[3]), r[4], members)
                continue
        members = [r[7]]
        out.append(members)
        last[key] = (r[3], r[4], members)
    return sorted(map(sorted, out))


def test_gap_clusters_match_brute_force(spark):
    rng, s = random.Random(3), Synteny(max_gap_bp=40, max_divergent_gap_bp=10)
    rows = []
    for i in range(500):
        start = rng.randint(1, 3000)
        rows.append((f"g{i % 3}", f"c{i % 2}", start, start + rng.randint(0, 60), rng.choice("+-"), "nifH", i, i, f"P{i}"))
    numbered = C.number_gap_clusters(spark.createDataFrame(rows, LOCI).repartition(5), s)
    got = {}
    for r in numbered.collect():
        got.setdefault((r["accession"], r["seqid"], r["contig_cluster"]), []).append(r["locus_row"])
    assert sorted(map(sorted, got.values())) == brute_clusters(rows, s)


def test_cluster_description(spark):
    s = Synteny()
    rows = [
        ("g", "c1", 5000, 5900, "+", "PF00142", 1, 1, "A"), ("g", "c1", 6000, 6900, "-", "nifD", 2, 2, ""), ("g", "c1", 6000, 6900, "-", "nifK", 3, 2, None),
        ("g", "c2", 10, 500, "+", "vnfG", 4, 3, "B"), ("g", "c3", 9000, 9500, "+", None, 5, 4, "D"),
    ]
    rolled = C.roll_up(C.number_gap_clusters(spark.createDataFrame(rows, LOCI), s))
    lengths = spark.createDataFrame([("g", "c1", 7000)], "accession string, seqid string, contig_length bigint")
    got = {r["seqid"]: r for r in C.with_truncation(C.with_types(rolled), s, lengths).collect()}
    one = got["c1"]
    assert (one["cluster_id"], one["gene_count"], one["gene_families"], one["protein_ids"], one["strands"], one["strand_switches"]) == ("cluster_0001", 2, ["PF00142", "nifD", "nifK"], ["A", "unknown"], ["+", "-"], 1)
    assert (one["cluster_type"], one["truncated_side"], one["quality_status"]) == ("nif", "3prime", "partial_truncated")
    assert (got["c2"]["cluster_type"], got["c2"]["truncated_side"], got["c2"]["quality_status"]) == ("vnf", "5prime", "accessory_only")
    assert (got["c3"]["cluster_type"], got["c3"]["truncated_side"], got["c3"]["gene_families"]) == ("accessory", None, ["unknown"])
    assert [r["seqid"] for r in C.find_clusters(spark.createDataFrame(rows, LOCI), s, lengths).collect()] == ["c1"]
    assert C.find_clusters(spark.createDataFrame([], LOCI), s).collect() == []


def test_overlap_resolution_matches_brute_force(spark):
    rng = random.Random(8)
    rows = [(f"p{rng.randint(0, 5)}", i, s := rng.randint(1, 80), s + rng.randint(0, 30), float(rng.randint(0, 6))) for i in range(200)]
    got = {r["id"] for r in resolve_overlaps(spark.createDataFrame(rows, "k string, id int, s int, e int, v double"), ["k"], "s", "e", [("v", True), ("id", False)], 0.2).collect()}
    kept = []
    for r in sorted(rows, key=lambda r: (-r[4], r[1])):
        if not any(q[0] == r[0] and (o := min(q[3], r[3]) - max(q[2], r[2]) + 1) > 0 and o / (min(q[3] - q[2], r[3] - r[2]) + 1) > 0.2 for q in kept):
            kept.append(r)
    assert got == {r[1] for r in kept}


def test_thresholds(spark):
    schema = "profile_file string, effective_score double, seq_evalue double, dom_evalue double, query_cov double, target_cov double"
    hits = spark.createDataFrame([("a", 10.0, 0.0, 0.0, 1.0, 1.0), ("a", 90.0, 0.0, 0.0, 0.5, 1.0), ("b", 10.0, 0.0, 0.0, 1.0, 1.0), ("b", None, 0.0, 0.0, 1.0, 1.0), ("b", 90.0, 0.0, 0.0, 1.0, 1.0)], schema)
    models = spark.createDataFrame([("a", True), ("b", True), ("b", False)], "profile_file string, has_trusted_cutoff boolean")
    assert sorted((r[0], r[1]) for r in passing_hits(hits, Alignment(), models).collect()) == [("a", 10.0), ("b", 90.0)]
    assert passing_hits(hits, Alignment(use_trusted_cutoffs=False)).count() == 1
    assert passing_hits(hits, Alignment()).count() == 4


def test_alias_rules(spark):
    schema = "accession string, locus_row int, direct_aliases array<string>, inferred_aliases array<string>"
    loci = spark.createDataFrame([("g", 1, ["D"], ["u1", "amb", "D2"]), ("g", 2, ["D", "D2"], ["amb"]), ("h", 3, [], ["amb", "D"])], schema)
    hits = spark.createDataFrame([("g", i, p) for i, p in enumerate(["D", "D2", "u1", "amb", "none", " ", None])] + [("h", 10, "amb"), ("h", 11, " D ")], "accession string, hit_row int, target_protein string")
    got = sorted((r["hit_row"], r["locus_row"]) for r in L.resolve_hits(hits, loci, ["accession"]).collect())
    assert got == [(0, 1), (0, 2), (1, 2), (2, 1), (10, 3), (11, 3)]
    stats = {r["accession"]: r for r in L.match_statistics(hits, loci, ["accession"]).collect()}
    assert (stats["g"]["hit_rows"], stats["g"]["matched_rows"], stats["g"]["unmatched_ids"], stats["g"]["multi_match_aliases"], stats["g"]["ambiguous_aliases"]) == (5, 3, 2, 1, 1)
    assert sorted(r["protein_id"] for r in L.unmatched_hits(hits, loci, ["accession"]).collect()) == ["amb", "none"]
    with pytest.raises(L.LocusError):
        L.keyed_hits(spark.createDataFrame([(1,)], "x int"))


def test_annotation_lines(spark):
    line = "c1\tRefSeq\tCDS\t10\t40\t.\t-\t0\tID=cds-Q;locus_tag=T1"
    rows = [("g", 1, "# x"), ("g", 2, ""), ("g", 3, line), ("g", 4, "c1\tx\tgene\t1\t2\t.\t+\t0\tID=a"), ("g", 5, line + "\textra"), ("g", 6, line.replace("\t10\t", "\tten\t"))]
    lines = spark.createDataFrame(rows, "accession string, line_no int, value string")
    loci, rejects = L.annotation_loci(lines, strict=False)
    assert [(r["start"], r["end"], r["protein_id"], r["locus_tag"]) for r in loci.collect()] == [(10, 40, "Q", "T1")]
    assert [r["line_no"] for r in rejects.collect()] == [6]
    with pytest.raises(PySparkException):
        L.annotation_loci(lines)[0].collect()


def test_features(spark):
    genomes = spark.createDataFrame([("g1", "P", 1.0), ("g2", None, None), ("g3", "P", 20.0)], "accession string, phylum string, size double")
    hits = spark.createDataFrame([("g1", "nifH", 50.0, 0.0), ("g1", "PF00142", 70.0, 1e-20), ("g1", "PF05910", 1.0, 1.0)], "accession string, gene_family string, effective_score double, seq_evalue double")
    clusters = spark.createDataFrame([("g1", 100, 3, ["nifH", "nifD", "nifK"], False)], "accession string, span_bp bigint, gene_count bigint, gene_families array<string>, has_catalytic_core boolean")
    maker = X.GenomeFeaturizer(category_columns=("phylum",), numeric_columns=("size",))
    with pytest.raises(X.NotFitted):
        maker.transform(genomes, hits, clusters)
    out = maker.fit_transform(genomes, hits, clusters)
    assert out.columns[:2] == ["accession", "status"] and out.columns[2:] == sorted(out.columns[2:])
    got = {r["accession"]: r.asDict() for r in out.collect()}
    assert (got["g1"]["marker_core_nifH_count"], got["g1"]["PF00142_max_bitscore"], got["g1"]["marker_core_nifH_neg_log_evalue"], got["g1"]["marker_aux_anfG_count"]) == (2, 70.0, 300.0, 1)
    assert (got["g2"]["marker_core_nifH_count"], got["g2"]["PF00142_min_evalue"], got["g2"]["clusters_found"], got["g2"]["tax_phylum_unknown"]) == (0, 1.0, 0, 1.0)
    assert got["g1"]["complete_hdk_clusters"] == 1 and got["g1"]["operon_core_completeness_score"] == pytest.approx(1 / 3)
    assert sum(r["meta_num_size"] for r in got.values()) == pytest.approx(0)
    assert sum(v * v for k, v in got["g1"].items() if k.startswith("pfam_tfidf_")) == pytest.approx(1)


def test_capability(spark):
    genomes = spark.createDataFrame([("a",), ("b",), ("c",)], "accession string")
    clusters = spark.createDataFrame([("a", ["PF00142", "PF00148"]), ("a", ["PF02826"]), ("b", ["PF00142", "PF02826"])], "accession string, gene_families array<string>")
    got = {r["accession"]: (r["clusters_found"], r["confidence_score_percent"], r["bnf_capable"]) for r in capability_scores(genomes, clusters).collect()}
    assert got == {"a": (2, 70.0, True), "b": (1, 65.0, False), "c": (0, 0.0, False)}
    flat = flat_report(genomes).first()
    assert (flat["organism_name"], flat["bnf_capable"], flat["error"], flat["status"]) == ("N/A", False, "", None)


def test_settings(tmp_path):
    with pytest.raises(ConfigError):
        SplitShares(0.5, 0.1, 0.1)
    with pytest.raises(ConfigError):
        Synteny(max_gap_bp=0)
    f = tmp_path / "s.json"
    f.write_text('{"alignment": {"e_value_max": 1e-5}, "synteny": {"max_intergenic_distance_bp": 70, "strand_sensitive": true}}')
    got = load_settings(str(f), {"GENOPLANE_MIN_BITSCORE": "12", "GENOPLANE_USE_TRUSTED_CUTOFFS": "no"})
    assert (got.alignment.max_evalue, got.alignment.min_bitscore, got.alignment.use_trusted_cutoffs, got.synteny.max_gap_bp) == (1e-5, 12.0, False, 70)


def test_word_tokens(spark):
    got = spark.createDataFrame([("PF00142.25 b_c É2",), (None,)], "t string").select(X.tokens(F.col("t"))).collect()
    assert got[0][0] == ["PF00142", "25", "b_c", "É2"] and got[1][0] == []


def test_keys_lose_white_space_of_any_kind(spark):
    loci = spark.createDataFrame([("g", 1, ["A"], ["x"]), ("g", 2, ["A"], ["x"])], "accession string, locus_row int, direct_aliases array<string>, inferred_aliases array<string>")
    hits = spark.createDataFrame([("g", 1, "\tA\n"), ("g", 2, " \r\n"), ("g", 3, "B"), ("g", 4, "B ")], "accession string, hit_row int, target_protein string")
    assert {(r["hit_row"], r["locus_row"]) for r in L.resolve_hits(hits, loci, ["accession"]).collect()} == {(1, 1), (1, 2)}
    assert {tuple(r)[1:] for r in L.match_lists(hits, loci, ["accession"]).collect()} == {("unmatched_id", "B"), ("ambiguous_alias", "x"), ("multi_match_alias", "A")}


def test_pairs_of_a_few_aliases_are_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(H, "PAIRS_PER_SLICE", 500, raising=False)
    monkeypatch.setattr(H, "PAIRS_PER_TASK", 2000, raising=False)
    loci = spark.createDataFrame([("g", i, ["D"] + ["E"] * (i < 3), ["x"]) for i in range(8)] + [("h", 0, ["D"], ["y"])], "accession string, locus_row int, direct_aliases array<string>, inferred_aliases array<string>")
    hits = [("g", i, "D") for i in range(3000)] + [("g", i, "E") for i in range(2900, 3100)] + [("h", 1, "D"), ("h", 1, "y"), ("h", 1, "D"), (None, 2, "D"), ("g", None, "E"), ("g", None, "D")]
    got = L.resolve_hits(spark.createDataFrame(hits, "accession string, hit_row int, target_protein string"), loci, ["accession"])
    rows = [tuple(r) for r in got.select("accession", "hit_row", "locus_row", F.spark_partition_id()).collect()]
    expected = {("g", i, k) for i in [*range(3000), None] for k in range(8)} | {("g", i, k) for i in range(3000, 3100) for k in range(3)} | {("h", 1, 0)}
    assert len(rows) == len(expected) and {r[:3] for r in rows} == expected
    tasks = [r[3] for r in rows]
    assert max(tasks.count(t) for t in set(tasks)) < len(rows) / 4
    one = spark.range(3000).select(F.lit("g").alias("accession"), F.col("id").alias("hit_row"), F.concat(F.lit("D"), F.lit("")).alias("protein_id"))
    got = L.resolve_hits(one, loci.filter("accession = 'g'").withColumn("accession", F.lit("g")), ["accession"])
    assert got.count() == 24000 and got.select(F.spark_partition_id()).distinct().count() > 6


def test_settings_from_yaml_and_paths(tmp_path):
    yaml = pytest.importorskip("yaml")
    f = tmp_path / "s.yaml"
    f.write_text(yaml.safe_dump({"alignment": {"min_bitscore": 5.0}, "paths": {"base_dir": str(tmp_path), "log_dir": "l", "output_dir": "hdfs://host/x", "hmm_profiles": "none"}}))
    (tmp_path / "data" / "hmm_profiles").mkdir(parents=True)
    got = load_settings(str(f), {})
    assert (got.alignment.min_bitscore, got.paths.log_dir, got.paths.output_dir, got.paths.hmm_profiles) == (5.0, f"{tmp_path}/l", "hdfs://host/x", f"{tmp_path}/data/hmm_profiles")
    got.paths.create()
    assert (tmp_path / "l").is_dir() and (tmp_path / "models").is_dir()
    for bad in ("[1, 2]", "alignment: [", "alignment: 3"):
        f.write_text(bad)
        with pytest.raises(ConfigError):
            load_settings(str(f), {})


def test_a_contig_over_many_tasks_has_the_same_clusters(spark):
    rng = random.Random(12)
    rows, at = [], 1
    for i in range(900):
        at += rng.choice([10, 40, 60, 200])
        rows.append(("g", "hot" if i % 9 else f"c{i}", at, at + rng.randint(1, 90), rng.choice("+-"), i, i))
    df = spark.createDataFrame(rows, "accession string, seqid string, start bigint, end bigint, strand string, hit_row int, locus_row int").repartition(5)
    synteny = Synteny(max_gap_bp=50, max_divergent_gap_bp=20)
    one, many = ({(r["hit_row"], r["contig_cluster"]) for r in C.number_gap_clusters(df, synteny, one_task=x).collect()} for x in (True, False))
    assert one == many and len(many) == 900 and max(n for _, n in many) > 20
    assert C.number_gap_clusters(df.filter("false"), synteny, one_task=False).count() == 0
