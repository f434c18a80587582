"""Sources: lists, tables, sequences, annotations, reports, archives and file indexes."""

from __future__ import annotations

import io
import os
import shutil
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from pathlib import Path, PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from genoplane.functions.identifiers import ACCESSION, accession_in_path, file_kind, is_canonical_name, standard_name, stripped
from genoplane.functions.text import is_blank
from genoplane.operators.hits import MAX_PROFILE_BYTES
from genoplane.operators.loci import annotation_loci
from genoplane.session import cut_lineage

REPORT_SCHEMA = T.StructType([
    T.StructField("accession", T.StringType()), T.StructField("organism", T.StructType([T.StructField("organismName", T.StringType()), T.StructField("taxId", T.IntegerType())])),
    T.StructField("assemblyInfo", T.StructType([T.StructField("assemblyLevel", T.StringType())])),
])


class SourceError(ValueError):
    """An input that cannot be used as a whole."""


def _numbered(spark: SparkSession, path: str | Sequence[str], separator: str | None = None) -> DataFrame:
    """(path, line_no, value) of text files, read in splits; bytes that are no UTF-8 are replaced.

    Lines are numbered within a split as they are read; the splits of a file, of which there are few, are added up
    to the number of lines before each, so a file of any size is read by many tasks.
    """
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    name = F.regexp_replace("_metadata.file_path", "^file:/*", "file:/")
    rows = reader.text(path if isinstance(path, str) else list(path)).select(name.alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), F.make_valid_utf8("value").alias("value"))
    blocks = rows.groupBy("path", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    numbered = rows.join(blocks, ["path", "_block"]).withColumn("line_no", F.col("_at") - F.col("_first") + F.col("_before") + 1)
    return numbered.select("path", "line_no", "value")


def numbered_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(path, line_no, value) of text files, from 1; lines end with a line feed, a carriage return or both."""
    return _numbered(spark, path)


def list_argument(spark: SparkSession, given: str | Sequence[str]) -> DataFrame:
    """(line_no, value) of a list given as one text with commas, blanks or line feeds between its items, or as a sequence.

    The frame is made on the driver from what the caller typed. Nothing given is an empty list.
    """
    items = given.replace(",", " ").split() if isinstance(given, str) else list(given)
    return spark.createDataFrame([(i, str(x)) for i, x in enumerate(items, 1)], "line_no bigint, value string")


def accession_list(lines: DataFrame, comments: str = "anywhere", check: bool = True, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(ordinal, accession) of lines (line_no, value), and the rejects.

    Values are trimmed, blank and comment lines dropped, order and repetitions kept. A comment starts with ``#``
    after white space (``anywhere``) or in the first column (``first``). With `check`, a value that is no accession
    is a reject; `strict` then refuses the whole list, and also an empty one.
    """
    value = stripped(F.col("value"))
    mark = F.col("v") if comments == "anywhere" else F.col("value")
    rows = lines.withColumn("v", value).filter((F.col("v") != "") & ~mark.startswith("#"))
    good = F.col("v").rlike(f"^(?:{ACCESSION})$") if check else F.lit(True)
    rejects = rows.filter(~good).select("line_no", F.col("v").alias("value"))
    kept = rows.filter(good).select(F.col("line_no").cast("bigint").alias("ordinal"), F.col("v").alias("accession"))
    if strict:
        if n := rejects.count():
            raise SourceError(f"{n} lines are no accession, such as {rejects.orderBy('line_no').first()['value']!r}")
        if check and kept.isEmpty():
            raise SourceError("no accession")
    return kept, rejects


def distinct_in_order(listed: DataFrame) -> DataFrame:
    """Each accession once, with the ordinal of its first line."""
    return listed.groupBy("accession").agg(F.min("ordinal").alias("ordinal"))


def in_list_order(listed: DataFrame, results: DataFrame) -> DataFrame:
    """Results expanded to the list, repetitions included, in its order."""
    return listed.join(results, "accession").orderBy("ordinal")


def table_source(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A CSV file (header; every column a string, empty stays empty) or a Parquet table; other suffixes are an error."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix == ".parquet":
        return spark.read.parquet(path)
    if suffix == ".csv":
        reader = spark.read.option("header", True).option("emptyValue", "").option("nullValue", "\u0001")
        return (reader.schema(schema) if schema else reader).csv(path).na.fill("")
    raise SourceError(f"{path} is neither .csv nor .parquet")


def file_listing(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """(path, length, root_priority) of all files under the roots that are not empty, without reading them."""
    parts = [spark.read.format("binaryFile").option("recursiveFileLookup", True).load(r).select("path", "length", F.lit(i).alias("root_priority")) for i, r in enumerate(roots)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def best_files(files: DataFrame) -> DataFrame:
    """(accession, file_type, path): per accession and kind the file of the first root, canonical names before others, then by path."""
    known = files.withColumns({"accession": accession_in_path(F.col("path")), "file_type": file_kind(F.col("path"))}).filter(F.col("accession").isNotNull() & F.col("file_type").isNotNull())
    rank = F.struct("root_priority", (~is_canonical_name(F.col("path"))).cast("int").alias("other"), "path")
    return known.groupBy("accession", "file_type").agg(F.min(rank).alias("best")).select("accession", "file_type", F.col("best.path").alias("path"))


def missing_inputs(listed: DataFrame, files: DataFrame) -> DataFrame:
    """(accession, reason) of the listed accessions without a protein or an annotation file."""
    kinds = files.groupBy("accession").agg(F.bool_or(F.col("file_type") == "faa").alias("faa"), F.bool_or(F.col("file_type") == "gff").alias("gff"))
    j = listed.select("accession").distinct().join(kinds, "accession", "left").fillna(False, ["faa", "gff"])
    reason = F.concat_ws(" and ", F.when(~F.col("faa"), "no protein file"), F.when(~F.col("gff"), "no annotation file"))
    return j.filter(~(F.col("faa") & F.col("gff"))).select("accession", reason.alias("reason"))


def runnable(listed: DataFrame, files: DataFrame, failures: DataFrame) -> DataFrame:
    """Listed accessions with both files and no failure."""
    out = listed.join(failures.select("accession"), "accession", "left_anti")
    for kind in ("faa", "gff"):
        out = out.join(files.filter(F.col("file_type") == kind).select("accession"), "accession", "left_semi")
    return out


def protein_sequences(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(path, accession, record_no, protein_id, description, sequence) of FASTA files; letters upper case, gaps in lines dropped.

    Files are read in splits at the ``>`` of a line's beginning, so one file may be of any size and no task holds it.
    Records are numbered in order, from 0 in a file that begins with one; a text before the first record is left out.
    """
    rows = _numbered(spark, path, "\n>")
    opens = F.col("value").startswith(">")
    parts = rows.filter((F.col("line_no") > 1) | opens).select("path", (F.col("line_no") - 1).alias("record_no"), F.when((F.col("line_no") == 1) & opens, F.regexp_replace("value", "^>", "")).otherwise(F.col("value")).alias("body"))
    head = F.regexp_extract("body", r"^([^\r\n]*)", 1)
    sequence = F.upper(F.regexp_replace(F.regexp_replace("body", r"^[^\r\n]*", ""), r"\s+", ""))
    return parts.select("path", accession_in_path(F.col("path")).alias("accession"), "record_no", F.regexp_extract(head, r"^(\S*)", 1).alias("protein_id"), stripped(F.regexp_replace(head, r"^\S*", "")).alias("description"), sequence.alias("sequence"))


def valid_fasta(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(path, is_valid) of all files, empty ones included: the first record has an id and a sequence."""
    files = _every_file(spark, path)
    first = protein_sequences(spark, path).groupBy("path").agg(F.min_by(F.struct("protein_id", "sequence"), "record_no").alias("r")).filter("r.protein_id <> '' AND r.sequence <> ''")
    return files.join(first.select("path", F.lit(True).alias("good")), "path", "left").select("path", F.coalesce("good", F.lit(False)).alias("is_valid"))


def _every_file(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(path, length) of the files of a glob or folder, those without a byte too, which the file sources leave out."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    rows = []
    for one in [path] if isinstance(path, str) else path:
        root = jvm.org.apache.hadoop.fs.Path(one)
        fs = root.getFileSystem(conf)
        for status in fs.globStatus(root) or []:
            for s in fs.listStatus(status.getPath()) if status.isDirectory() else [status]:
                if s.isFile() and not s.getPath().getName().startswith((".", "_")):
                    rows.append((s.getPath().toString(), s.getLen()))
    return spark.createDataFrame(rows, "path string, length bigint").distinct()


def annotation_files(spark: SparkSession, path: str | Sequence[str], strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Loci and rejects of GFF3 files; the accession comes from the path."""
    return annotation_loci(numbered_lines(spark, path).withColumn("accession", accession_in_path(F.col("path"))), strict)


def profile_files(spark: SparkSession, folder: str, exclude: str = "pfam-a") -> list[tuple[str, bytes]]:
    """Name and content of the *.hmm files of a folder by name, without full-library files; an error when there are none. Profiles are MBs."""
    name = F.substring_index("path", "/", -1)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.hmm").load(folder).filter(~F.lower(name).contains(exclude))
    if (size := found.agg(F.sum("length")).first()[0] or 0) > MAX_PROFILE_BYTES:
        raise SourceError(f"profiles of {size} bytes in {folder}")
    out = [(r["name"], bytes(r["content"])) for r in found.select(name.alias("name"), "content").orderBy("name").collect()]
    if not out:
        raise SourceError(f"no profile in {folder}")
    return out


def report_fields(lines: DataFrame) -> DataFrame:
    """Fields of assembly reports (path, line_no, value): of each file the first line that is not blank, with defaults."""
    first = lines.filter(~is_blank(F.col("value"))).groupBy("path").agg(F.min_by("value", "line_no").alias("value"))
    parsed = first.withColumn("j", F.from_json("value", REPORT_SCHEMA))
    return parsed.select(
        "path", F.coalesce("j.accession", accession_in_path(F.col("path"))).alias("accession"), F.coalesce("j.organism.organismName", F.lit("Unknown")).alias("organism_name"), F.coalesce("j.organism.taxId", F.lit(0)).alias("tax_id"), F.coalesce("j.assemblyInfo.assemblyLevel", F.lit("Unknown")).alias("assembly_level"),
    )


# What archive members are, by the end of their name.
MEMBER_KINDS = {".faa": "faa", ".gff": "gff", ".gff3": "gff", ".fna": "fna", ".jsonl": "report"}


def archive_members(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(path, accession, kind, content, status): members of ZIP packages, those of one kind joined by line feeds in order of name.

    A file that is no archive gives one row with status FAILED; an archive without known members one with NO_MEMBERS.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("path", "kind")] + [T.StructField("content", T.BinaryType()), T.StructField("status", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        kinds: dict[str, list[bytes]] = {}
                        for name in sorted(z.namelist()):
                            kind = MEMBER_KINDS.get(PurePosixPath(name.lower()).suffix)
                            if kind and "cds_from_genomic" not in name and "rna_from_genomic" not in name:
                                kinds.setdefault(kind, []).append(z.read(name))
                    rows += [(p, k, b"\n".join(v), "SUCCESS") for k, v in kinds.items()] or [(p, None, None, "NO_MEMBERS")]
                except zipfile.BadZipFile:
                    rows.append((p, None, None, "FAILED"))
            yield pd.DataFrame(rows, columns=schema.names)

    files = spark.read.format("binaryFile").load(path if isinstance(path, str) else list(path)).select("path", "content")
    return files.mapInPandas(run, schema).withColumn("accession", accession_in_path(F.col("path")))


def file_digests(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path if isinstance(path, str) else list(path))
    return files.select("path", "length", F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"))


def move_plan(files: DataFrame, existing: DataFrame) -> DataFrame:
    """What to do with each file (path, length, md5), given those in place (folder, name, md5).

    skip: no known kind. keep: it is in its place. move: the place is free. drop: a copy with the same content is in
    place. conflict: another content is; nothing is deleted then. Of several files for one free place the first
    by path moves and the others are compared with it.
    """
    named = files.withColumn("to", standard_name(F.col("path"))).select("*", F.col("to.folder").alias("folder"), F.col("to.name").alias("name")).drop("to")
    there = existing.select("folder", "name", F.col("md5").alias("old_md5"))
    j = named.join(there, ["folder", "name"], "left")
    w = Window.partitionBy("folder", "name").orderBy("path")
    first, first_md5 = F.row_number().over(w) == 1, F.first("md5").over(w)
    in_place = F.col("path").endswith(F.concat(F.lit("/"), "folder", F.lit("/"), "name"))
    held = F.coalesce("old_md5", first_md5)
    action = F.when(F.col("name").isNull(), "skip").when(in_place, "keep").when(F.col("old_md5").isNull() & first, "move").when(held == F.col("md5"), "drop").otherwise("conflict")
    return j.withColumn("action", action).select("path", "folder", "name", "action")


def missing_triplets(files: DataFrame) -> DataFrame:
    """(accession, faa, gff, fna) of the accessions (accession, file_type) that lack one of the three kinds."""
    has = {k: F.bool_or(F.col("file_type") == k) for k in ("faa", "gff", "fna")}
    return files.groupBy("accession").agg(*[c.alias(k) for k, c in has.items()]).filter("NOT (faa AND gff AND fna)")


def move_statistics(plan: DataFrame) -> DataFrame:
    """(action, folder, n_files) of a plan; files of no known kind have an empty folder."""
    return plan.groupBy("action", F.coalesce("folder", F.lit("")).alias("folder")).agg(F.count(F.lit(1)).alias("n_files"))


def carry_out(spark: SparkSession, plan: DataFrame, root: str, copy: bool = False, dry_run: bool = False) -> DataFrame:
    """Do what a plan says under `root` and return (path, folder, name, action, status), as written by the tasks that did it.

    ``move`` renames a file, or with `copy` copies its bytes; ``drop`` deletes a copy whose content is in place (kept with
    `copy`); conflicts and unknown files are left alone. A place that is taken meanwhile is not overwritten: its status
    is ``taken``; an error of one file is its status. With `dry_run` nothing is touched and the status is ``planned``.
    Files are local or on a mounted share, as the tools are that read them.
    """
    base = root.removeprefix("file://")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(status=[_one_file(*row, base, copy, dry_run) for row in zip(batch["path"], batch["folder"], batch["name"], batch["action"], strict=True)])

    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("path", "folder", "name", "action", "status")])
    return cut_lineage(plan.select("path", "folder", "name", "action").repartition("path").mapInPandas(run, schema), "moved")


def _one_file(path: str, folder: str | None, name: str | None, action: str, base: str, copy: bool, dry_run: bool) -> str:
    if action not in ("move", "drop"):
        return "left"
    if dry_run:
        return "planned"
    source = Path(path.removeprefix("file://").removeprefix("file:"))
    try:
        if action == "drop":
            if not copy:
                source.unlink(missing_ok=True)
            return "kept" if copy else "deleted"
        target = Path(base, folder, name)
        target.parent.mkdir(parents=True, exist_ok=True)
        if target.exists():  # a task that runs again finds its own work
            return "done" if not source.exists() else "taken"
        if copy:
            part = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
            shutil.copyfile(source, part)
            os.replace(part, target)
        else:
            os.replace(source, target)
        return "done"
    except OSError as e:
        return f"{type(e).__name__}: {e.strerror}"
