import gzip
import json
import os
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from genoplane.functions.identifiers import accession_in_path
from genoplane.sources import profiles as P
from genoplane.sources import readers as R
from genoplane.sources import sinks as S
from genoplane.streaming.sessions import directed_gap_clusters, fixed_gap_sessions, fold_into_state


def test_accession_lists(spark, tmp_path):
    f = tmp_path / "list.txt"
    f.write_text("# head\n GCF_1.1 \n\n  # note\nGCA_2.10\nGCF_1.1\nEDGE_SYN_1\n")
    lines = R.numbered_lines(spark, f"file://{f}")
    with pytest.raises(R.SourceError):
        R.accession_list(lines)
    kept, rejects = R.accession_list(lines, strict=False)
    assert [r["accession"] for r in kept.orderBy("ordinal").collect()] == ["GCF_1.1", "GCA_2.10", "GCF_1.1"]
    assert [r["value"] for r in rejects.collect()] == ["EDGE_SYN_1"]
    first = {r["accession"]: r["ordinal"] for r in R.distinct_in_order(kept).collect()}
    assert first == {"GCF_1.1": 2, "GCA_2.10": 5}
    results = spark.createDataFrame([("GCA_2.10", 7), ("GCF_1.1", 8)], "accession string, v int")
    assert [r["v"] for r in R.in_list_order(kept, results).collect()] == [8, 7, 8]
    assert R.accession_list(lines, comments="first", check=False)[0].count() == 5


def test_tables_keep_empty_strings(spark, tmp_path):
    path = f"file://{tmp_path}/t.csv"
    S.write_table(spark.createDataFrame([("a", ""), ("b", "NA")], "k string, v string"), path)
    assert sorted(tuple(r) for r in R.table_source(spark, path).collect()) == [("a", ""), ("b", "NA")]
    S.write_table(spark.range(3), f"file://{tmp_path}/t.parquet")
    assert R.table_source(spark, f"file://{tmp_path}/t.parquet").count() == 3
    for call in (lambda: R.table_source(spark, "x.xls"), lambda: S.write_table(spark.range(1), "x.json")):
        with pytest.raises(R.SourceError):
            call()


def test_sequences_annotations_and_reports(spark, tmp_path):
    d = tmp_path / "GCF_000000007.1"
    d.mkdir()
    (d / "protein.faa").write_text(">WP_1.1 nitrogenase [X]\nmka\nLL\n>WP_2.1\nMM\n")
    (d / "empty.faa").write_text("")
    (d / "odd.faa").write_text("no record")
    (d / "genomic.gff").write_text("##gff-version 3\nc1\tRefSeq\tCDS\t1\t30\t.\t+\t0\tID=cds-WP_1.1;protein_id=WP_1.1\n")
    (d / "report.jsonl").write_text('\n{"accession": "GCF_000000007.1", "organism": {"organismName": "O"}}\n{"accession": "other"}\n')
    got = R.protein_sequences(spark, f"file://{d}/protein.faa").orderBy("record_no").collect()
    assert [(r["protein_id"], r["description"], r["sequence"], r["accession"]) for r in got] == [("WP_1.1", "nitrogenase [X]", "MKALL", "GCF_000000007.1"), ("WP_2.1", "", "MM", "GCF_000000007.1")]
    assert {r["path"].split("/")[-1]: r["is_valid"] for r in R.valid_fasta(spark, f"file://{d}/*.faa").collect()} == {"protein.faa": True, "odd.faa": False, "empty.faa": False}
    loci, rejects = R.annotation_files(spark, f"file://{d}/genomic.gff")
    assert [(r["accession"], r["protein_id"], r["end"]) for r in loci.collect()] == [("GCF_000000007.1", "WP_1.1", 30)] and rejects.count() == 0
    report = R.report_fields(R.numbered_lines(spark, f"file://{d}/report.jsonl")).first()
    assert (report["organism_name"], report["tax_id"], report["assembly_level"]) == ("O", 0, "Unknown")


def test_large_files_are_read_in_splits(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 50) for i in range(4000)]
    (tmp_path / "a.txt").write_text("\r\n".join(lines))
    (tmp_path / "b.txt").write_text("\n".join(reversed(lines)) + "\n")
    (tmp_path / "p.faa").write_text("preamble\n" + "".join(f">P{i} d\r\nMK\r\nL{'A' * (i % 40)}\n" for i in range(2000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = R.numbered_lines(spark, [f"file://{tmp_path}/a.txt", f"file://{tmp_path}/b.txt"])
        assert got.rdd.getNumPartitions() > 1
        for name, expected in (("a.txt", lines), ("b.txt", lines[::-1])):
            rows = sorted((r["line_no"], r["value"]) for r in got.filter(F.col("path").endswith(name)).collect())
            assert rows == list(enumerate(expected, 1))
        proteins = R.protein_sequences(spark, f"file://{tmp_path}/p.faa").orderBy("record_no").collect()
        assert [(r["record_no"], r["protein_id"], r["sequence"]) for r in proteins] == [(i + 1, f"P{i}", "MKL" + "A" * (i % 40)) for i in range(2000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_bytes_that_are_no_text_are_replaced(spark, tmp_path):
    (tmp_path / "GCF_1.1.gff").write_bytes(b"c\tRefSeq\tCDS\t1\t30\t.\t+\t0\tID=cds-A;protein_id=A;Note=\xff\n")
    (tmp_path / "GCF_2.1.faa").write_bytes(b">A \xfe\nMK\n")
    assert R.annotation_files(spark, f"file://{tmp_path}/GCF_1.1.gff")[0].first()["protein_id"] == "A"
    r = R.protein_sequences(spark, f"file://{tmp_path}/GCF_2.1.faa").first()
    assert (r["protein_id"], r["description"], r["sequence"]) == ("A", "\ufffd", "MK")


def test_lists_may_be_typed(spark):
    rows = lambda x: [tuple(r) for r in R.list_argument(spark, x).collect()]
    assert rows("GCF_1.1, GCA_2.1\nx") == [(1, "GCF_1.1"), (2, "GCA_2.1"), (3, "x")] == rows(["GCF_1.1", "GCA_2.1", "x"]) and rows("") == []


def test_files_are_moved_copied_or_left(spark, tmp_path):
    for name, text in (("in/GCF_1.1.faa", "a"), ("in/b/GCF_1.1.faa", "a"), ("in/GCF_2.1.gff", "new"), ("genomes/GCF_2.1_genomic.gff", "old"), ("in/x.txt", "q")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    files = R.file_digests(spark, f"file://{tmp_path}/in")
    there = spark.createDataFrame([("genomes", "GCF_2.1_genomic.gff", "other")], "folder string, name string, md5 string")
    plan = R.move_plan(files, there)
    run = lambda **k: {r["path"].split("/in/")[1]: (r["action"], r["status"]) for r in R.carry_out(spark, plan, f"file://{tmp_path}", **k).collect()}
    expected = {"GCF_1.1.faa": ("move", "planned"), "b/GCF_1.1.faa": ("drop", "planned"), "GCF_2.1.gff": ("conflict", "left"), "x.txt": ("skip", "left")}
    assert run(dry_run=True) == expected and not (tmp_path / "genomes" / "GCF_1.1_protein.faa").exists()
    plan = spark.createDataFrame(plan.collect(), plan.schema)
    assert run(copy=True)["GCF_1.1.faa"] == ("move", "done") and (tmp_path / "in" / "b" / "GCF_1.1.faa").exists()
    assert run()["GCF_1.1.faa"] == ("move", "taken")
    (tmp_path / "genomes" / "GCF_1.1_protein.faa").unlink()
    assert run() == expected | {"GCF_1.1.faa": ("move", "done"), "b/GCF_1.1.faa": ("drop", "deleted")}
    assert (tmp_path / "genomes" / "GCF_1.1_protein.faa").read_text() == "a" and (tmp_path / "genomes" / "GCF_2.1_genomic.gff").read_text() == "old"
    assert run()["GCF_1.1.faa"] == ("move", "done")
    assert {(r["action"], r["n_files"]) for r in R.move_statistics(plan).collect()} == {("move", 1), ("drop", 1), ("conflict", 1), ("skip", 1)}


def test_profiles_are_unpacked_verified_and_indexed(spark, tmp_path):
    with gzip.open(tmp_path / "a.hmm.gz", "wb") as f:
        f.write(b"HMMER3")
    digest = P.sha256_of(tmp_path / "a.hmm.gz")
    target = P.unpack_profile(tmp_path / "a.hmm.gz", tmp_path / "d" / "a.hmm", digest.upper())
    assert target.read_bytes() == b"HMMER3"
    (tmp_path / "bad.gz").write_bytes(b"no gzip")
    for call in (lambda: P.unpack_profile(tmp_path / "a.hmm.gz", target, "0" * 64), lambda: P.unpack_profile(tmp_path / "bad.gz", tmp_path / "x")):
        with pytest.raises(R.SourceError):
            call()
    assert not P.index_is_fresh(target) and not P.index_is_fresh(tmp_path / "none.hmm")
    for i, ending in enumerate(P.INDEX_ENDINGS):
        (tmp_path / "d" / (("a.hmm" if i % 2 else "a") + ending)).write_text("i")
    assert P.index_is_fresh(target)
    os.utime(tmp_path / "d" / "a.h3f", (1, 1))
    assert not P.index_is_fresh(target)
    out = json.loads(P.profile_manifest({"A": {"filename": "a.hmm", "url": "u"}}, tmp_path / "d").read_text())
    assert out == {"A": {"filename": "a.hmm", "url": "u", "path": str(target.resolve())}}
    files = spark.createDataFrame([("/d/GCF_1.1/GCF_1.1.faa", 3), ("/d/GCF_1.1/other.faa", 3), ("/d/GCF_2.1_x.gff", 1), ("/d/GCF_2.1.jsonl", 0), ("/d/GCF_1.1.txt", 1)], "path string, length bigint")
    got = {r["accession"]: (r["n_valid"], r["n_empty"], r["is_complete"]) for r in P.downloaded_files(files, accession_in_path(F.col("path"))).collect()}
    assert got == {"GCF_1.1": (1, 0, True), "GCF_2.1": (1, 1, False)}
    assert P.data_pointer("outs:\n- md5: ab.dir\n  size: 12\n  nfiles: 3\n  hash: md5\n  path: raw\n") == {"md5": "ab.dir", "size": 12, "nfiles": 3, "hash": "md5", "path": "raw"}
    with pytest.raises(R.SourceError):
        P.data_pointer("outs:\n- size: 1\n")
    (tmp_path / "e" / "f" / "g").mkdir(parents=True)
    assert [Path(x).name for x in P.remove_empty_folders([tmp_path])] == ["e", "f", "g"] and target.exists()


def test_archives_and_profiles(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "GCF_000000001.1.zip", "w") as z:
        z.writestr("d/a_protein.faa", ">a\nM")
        z.writestr("d/b.faa", ">b\nK")
        z.writestr("d/cds_from_genomic.fna", ">x")
        z.writestr("d/readme.md", "x")
    (tmp_path / "GCF_000000002.1.zip").write_bytes(b"no archive")
    rows = {(r["accession"], r["kind"]): (bytes(r["content"]) if r["content"] else None, r["status"]) for r in R.archive_members(spark, f"file://{tmp_path}/*.zip").collect()}
    assert rows == {("GCF_000000001.1", "faa"): (b">a\nM\n>b\nK", "SUCCESS"), ("GCF_000000002.1", None): (None, "FAILED")}
    for n in ("b.hmm", "a.hmm", "Pfam-A.hmm"):
        (tmp_path / n).write_text(n)
    assert [n for n, _ in R.profile_files(spark, f"file://{tmp_path}")] == ["a.hmm", "b.hmm"]


def test_file_index_and_moves(spark):
    files = spark.createDataFrame([("/r0/GCF_1.1.faa", 0), ("/r0/GCF_1.1_protein.faa", 0), ("/r1/GCF_1.1_genomic.gff", 1), ("/r0/x/GCF_2.1.faa", 0)], "path string, root_priority int")
    best = R.best_files(files)
    assert {(r["accession"], r["file_type"]): r["path"] for r in best.collect()} == {("GCF_1.1", "faa"): "/r0/GCF_1.1_protein.faa", ("GCF_1.1", "gff"): "/r1/GCF_1.1_genomic.gff", ("GCF_2.1", "faa"): "/r0/x/GCF_2.1.faa"}
    listed = spark.createDataFrame([("GCF_1.1",), ("GCF_2.1",), ("GCF_3.1",)], "accession string")
    assert {r["accession"]: r["reason"] for r in R.missing_inputs(listed, best).collect()} == {"GCF_2.1": "no annotation file", "GCF_3.1": "no protein file and no annotation file"}
    assert [r[0] for r in R.runnable(listed, best, listed.filter("false")).collect()] == ["GCF_1.1"]
    assert {r["accession"] for r in R.missing_triplets(best).collect()} == {"GCF_1.1", "GCF_2.1"}
    moving = spark.createDataFrame([("/in/a/GCF_1.1.faa", 1, "m1"), ("/in/b/GCF_1.1.faa", 1, "m1"), ("/in/c/GCF_1.1.faa", 1, "m2"), ("/in/GCF_9.1.gff", 1, "m9"), ("/in/readme", 1, "q"), ("/x/genomes/GCF_5.1_genomic.fna", 1, "z")], "path string, length int, md5 string")
    there = spark.createDataFrame([("genomes", "GCF_9.1_genomic.gff", "old"), ("genomes", "GCF_5.1_genomic.fna", "z")], "folder string, name string, md5 string")
    assert {r["path"]: r["action"] for r in R.move_plan(moving, there).collect()} == {"/in/a/GCF_1.1.faa": "move", "/in/b/GCF_1.1.faa": "drop", "/in/c/GCF_1.1.faa": "conflict", "/in/GCF_9.1.gff": "conflict", "/in/readme": "skip", "/x/genomes/GCF_5.1_genomic.fna": "keep"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("g", "ok", 1.0, 2.0)], "accession string, status string, b double, a double")
    assert S.write_feature_matrix(df, f"file://{tmp_path}/m.parquet", 1) == ["a", "b"]
    assert spark.read.parquet(f"file://{tmp_path}/m.parquet").columns == ["accession", "status", "a", "b"]
    with pytest.raises(R.SourceError):
        S.write_feature_matrix(df, f"file://{tmp_path}/n.parquet", 2)
    S.run_metadata(df, 3, df.select("accession", F.lit("why").alias("reason")), str(tmp_path / "r" / "run.json"))
    assert json.loads((tmp_path / "r" / "run.json").read_text())["failed"] == 1
    S.write_predictions(df, f"file://{tmp_path}/p")
    assert R.table_source(spark, f"file://{tmp_path}/p/predictions.csv").first()["organism_name"] == "N/A"


def test_failed_labelling_writes_only_the_report(spark, tmp_path):
    from genoplane.operators.labeling import LabelingError

    bad = spark.createDataFrame([("x",)], "accession_id string")
    with pytest.raises(LabelingError):
        S.label_and_write(bad, bad, f"file://{tmp_path}/full.parquet", f"file://{tmp_path}/train.parquet", str(tmp_path / "report.json"))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["report.json"]


def test_sessions_of_a_table(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:10"), (1, "2024-01-01 00:00:21"), (2, "2024-01-01 00:00:00")], "u int, t string").withColumn("t", F.to_timestamp("t"))
    assert sorted((r["u"], r["n_events"]) for r in fixed_gap_sessions(df, "u", "t", 10).collect()) == [(1, 1), (1, 2), (2, 1)]


def test_stream_of_loci_closes_clusters(spark, tmp_path):
    rows = [("g", "c", 1, 10, "+"), ("g", "c", 12, 20, "-"), ("g", "c", 24, 30, "+"), ("g", "c", 100, 110, "+")]
    spark.createDataFrame(rows, "accession string, seqid string, start bigint, end bigint, strand string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("accession string, seqid string, start bigint, end bigint, strand string").parquet(f"{tmp_path}/in")
    query = directed_gap_clusters(stream, 5, 2).writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r["start"], r["end"], r["n_loci"], r["is_closed"]) for r in spark.sql("SELECT * FROM closed").collect()) == [(1, 20, 2, True), (24, 30, 1, True), (100, 110, 1, False)]


def test_state_from_change_batches(spark, tmp_path):
    fold = fold_into_state(f"{tmp_path}/state")
    d = lambda *x: spark.createDataFrame(list(x), "key string, side string, delta int")
    fold(d(("a", "reference", 1), ("b", "reference", 1), ("b", "existence", 1)), 0)
    fold(d(("a", "existence", 1), ("b", "existence", -1)), 1)
    fold(d(("a", "existence", 1), ("b", "existence", -1)), 1)
    got = {r["key"]: (r["refs"], r["held"]) for r in spark.read.parquet(f"{tmp_path}/state/version=1").collect()}
    assert got == {"a": (1, 1), "b": (1, 0)}
    fold(d(("a", "reference", 1)), 2)
    assert sorted(p.name for p in (tmp_path / "state").iterdir()) == ["version=1", "version=2"]
