import json

from pyspark.sql import functions as F

from genoplane.__main__ import main
from genoplane.config import Alignment, Settings
from genoplane.operators.features import GenomeFeaturizer
from genoplane.operators.hits import GENE_SCHEMA, HIT_SCHEMA, call_genes, search_genomes, search_proteins
from genoplane.plans.pipelines import annotate, feature_matrix, predictions

LOCI = "accession string, locus_row int, seqid string, start bigint, end bigint, strand string, protein_id string, locus_tag string, direct_aliases array<string>, inferred_aliases array<string>"


def hit(acc, protein, family, score=100.0, start=1, end=90, file="p1"):
    return (acc, file, protein, 100, family, 100, 1e-30, 1e-30, score, 0.0, score, 0.9, 0.9, start, end, start, end)


def inputs(spark):
    loci = [("g1", i, "c", 5000 + 1000 * i, 5900 + 1000 * i, "+", f"A{i}", None, [f"A{i}"], []) for i in range(3)] + [("g2", 1, "c", 9000, 9500, "+", "B", None, ["B"], []), ("g3", 1, "c", 9000, 9500, "+", "C", None, ["C"], [])]
    hits = [hit("g1", "A0", "PF00142"), hit("g1", "A0", "PF99999", 50.0), hit("g1", "A1", "PF00148"), hit("g1", "A2", "PF02826", file="p2"), hit("g2", "other", "PF00142")]
    genomes = spark.createDataFrame([(g, "Phylum") for g in ("g1", "g2", "g3", "g4")], "accession string, phylum string")
    return genomes, spark.createDataFrame(hits, HIT_SCHEMA), spark.createDataFrame(loci, LOCI)


def test_from_hits_to_predictions(spark):
    genomes, hits, loci = inputs(spark)
    done = annotate(genomes, hits, loci, Settings(alignment=Alignment(use_trusted_cutoffs=False, min_bitscore=40.0)))
    assert {r["accession"]: r["error"] for r in done.failures.collect()} == {"g2": "no hit leads to a locus", "g4": "no annotated locus"}
    assert done.warnings.collect() == []
    more = hits.unionByName(spark.createDataFrame([hit("g1", f"Z{i}", "PF00142") for i in range(7)], HIT_SCHEMA))
    assert [tuple(r) for r in annotate(genomes, more, loci, Settings(alignment=Alignment(use_trusted_cutoffs=False, min_bitscore=40.0))).warnings.collect()] == [("g1", 7, ["Z0", "Z1", "Z2", "Z3", "Z4"])]
    assert "PF99999" not in {r["gene_family"] for r in done.hits.collect()}
    got = {r["accession"]: (r["status"], r["clusters_found"], r["confidence_score_percent"], r["bnf_capable"]) for r in predictions(genomes, done).collect()}
    assert got == {"g1": ("SUCCESS", 1, 100.0, True), "g2": ("FAILED", 0, 0.0, False), "g3": ("SUCCESS", 0, 0.0, False), "g4": ("FAILED", 0, 0.0, False)}
    listed = spark.createDataFrame([(1, "g3"), (2, "g1"), (3, "g3"), (4, "g2")], "ordinal bigint, accession string")
    matrix = feature_matrix(listed, genomes, done, GenomeFeaturizer(category_columns=("phylum",)), fit_on=genomes.filter("accession = 'g1'"))
    assert [r["accession"] for r in matrix.collect()] == ["g3", "g1", "g3"]
    assert matrix.filter("accession = 'g1'").first()["complete_hdk_clusters"] == 1


def test_search_plug_in_keeps_its_columns(spark):
    proteins = spark.createDataFrame([("g", "p1", "MKK"), ("g", "p2", "AA")], "accession string, protein_id string, sequence string")
    found = search_proteins(proteins, [("x.hmm", b"K")], lambda seqs, profile: ((n, 9, "fam", 9, 0.0, 0.0, 1.0, 0.0, 1.0, 1.0, 1.0, 1, 9, 1, 9) for n, s in seqs if profile.decode() in s))
    assert [(r["accession"], r["profile_file"], r["target_protein"]) for r in found.collect()] == [("g", "x.hmm", "p1")]
    none = search_proteins(proteins, [("x.hmm", b"K")], lambda seqs, profile: [])
    assert none.columns == HIT_SCHEMA.names and none.count() == 0


def test_a_genome_on_which_the_tool_fails_fails_alone(spark):
    proteins = spark.createDataFrame([("g", "p1", "MKK"), ("bad", "p2", "K"), ("bad", "p3", "!"), (None, "p4", "K")], "accession string, protein_id string, sequence string")

    def opened():
        def search(sequences, profile):
            for name, s in sequences:
                if s == "!":
                    raise RuntimeError("no protein")
                yield (name, 9, "fam", 9, 0.0, 0.0, 1.0, 0.0, 1.0, 1.0, 1.0, 1, 9, 1, 9)

        return search

    hits, failures = search_genomes(proteins, [("x.hmm", b"K")], opened)
    assert {(r["accession"], r["target_protein"]) for r in hits.collect()} == {("g", "p1"), (None, "p4")}
    assert [tuple(r) for r in failures.collect()] == [("bad", "RuntimeError: no protein")]


def test_genes_are_called_by_a_plug_in(spark):
    contigs = spark.createDataFrame([("g", "c1", "ATGAAA"), ("g", "c2", "A"), ("h", "c1", "")], "accession string, seqid string, sequence string")
    genes, failures = call_genes(contigs, lambda: lambda rows: [(c, 1, len(s), "+", f"{c}_1", s[:2]) for c, s in rows if len(s) > 1 or 1 // len(s)])
    assert genes.columns == GENE_SCHEMA.names and {(r["accession"], r["protein_id"], r["end"]) for r in genes.collect()} == {("g", "c1_1", 6), ("g", "c2_1", 1)}
    assert [r["accession"] for r in failures.collect()] == ["h"]


def test_unusable_inputs_give_exit_code_2(tmp_path):
    assert main(["label", "--features", f"{tmp_path}/none.parquet", "--labels", f"{tmp_path}/none.csv", "--output", f"{tmp_path}/o.parquet", "--training-output", f"{tmp_path}/t.parquet", "--report", f"{tmp_path}/r.json"]) == 2
    assert main(["predict", "--accessions", f"file://{tmp_path}/none.txt", "--hits", "x", "--annotations", "y", "--output", f"{tmp_path}/out"]) == 2


def test_command_line(spark, tmp_path):
    spark.createDataFrame([("GCF_000000001.1", 1.0)], "accession_id string, f double").write.parquet(f"{tmp_path}/f.parquet")
    bad = tmp_path / "l.csv"
    bad.write_text("assembly_accession,notes\nGCF_000000001.1,x\n")
    args = ["label", "--features", f"{tmp_path}/f.parquet", "--labels", str(bad), "--output", f"{tmp_path}/o.parquet", "--training-output", f"{tmp_path}/t.parquet", "--report", f"{tmp_path}/r.json"]
    assert main(args) == 2
    assert json.loads((tmp_path / "r.json").read_text())["validation_errors"] and not (tmp_path / "o.parquet").exists()
    (tmp_path / "acc.txt").write_text("GCF_1.1\nGCF_2.1\n")
    (tmp_path / "GCF_1.1.gff").write_text("c\tRefSeq\tCDS\t5000\t5900\t.\t+\t0\tID=cds-A;protein_id=A\n")
    spark.createDataFrame([hit("GCF_1.1", "A", "PF00142")], HIT_SCHEMA).withColumn("accession", F.col("accession")).coalesce(1).write.option("sep", "\t").option("header", True).csv(f"{tmp_path}/hits")
    assert main(["predict", "--accessions", f"file://{tmp_path}/acc.txt", "--hits", f"{tmp_path}/hits", "--annotations", f"file://{tmp_path}/GCF_1.1.gff", "--output", f"{tmp_path}/out"]) == 1
    assert sorted(json.loads(x)["status"] for p in (tmp_path / "out" / "predictions.json").glob("*.json") for x in p.read_text().splitlines()) == ["FAILED", "SUCCESS"]
    assert main(["features", "--accessions", f"file://{tmp_path}/acc.txt", "--hits", f"{tmp_path}/hits", "--annotations", f"file://{tmp_path}/GCF_1.1.gff", "--output", f"{tmp_path}/m.parquet", "--metadata", f"{tmp_path}/m.json"]) == 1
    meta = json.loads((tmp_path / "m.json").read_text())
    assert (meta["rows"], meta["failed"], meta["requested"]) == (1, 1, 2) and "tax_phylum_unknown" in meta["feature_names"] and meta["generated_at"]
    assert spark.read.parquet(f"{tmp_path}/m.parquet").first()["tax_genus_unknown"] == 1.0
