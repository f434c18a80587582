"""Column functions on annotation attributes, identifiers, paths and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two forms of an assembly accession.
ACCESSION = r"GC[AF]_\d+\.\d+"
STRICT_ACCESSION = r"GC[AF]_\d{9}\.\d+"
_NUMBERED_ID = r"^\d+_(\d+)$"
_ACCESSION_LIKE = r"^[A-Za-z]{1,10}_?\d+(\.\d+)?$"


def nonempty(c: Column) -> Column:
    """Null for an empty string."""
    return F.nullif(c, F.lit(""))


def stripped(c: Column) -> Column:
    """Without outer white space of any kind: blanks, tabs, line feeds, and those of other scripts."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def split_values(c: Column) -> Column:
    """The trimmed, non-empty items of a comma-separated value; an empty array for null."""
    items = F.transform(F.split(F.coalesce(c, F.lit("")), ","), stripped)
    return F.filter(items, lambda x: x != "")


def cross_reference_accessions(c: Column) -> Column:
    """Accessions of the items in the namespaces genbank and refseq (any letter case)."""
    trusted = F.filter(split_values(c), lambda x: F.lower(F.substring_index(x, ":", 1)).isin("genbank", "refseq") & x.contains(":"))
    return F.filter(F.transform(trusted, lambda x: stripped(F.regexp_replace(x, "^[^:]*:", ""))), lambda x: x != "")


def percent_decoded(c: Column) -> Column:
    """%XX decoded as UTF-8, bytes that are none replaced; a plus sign stays, and so does a percent sign that begins no escape."""
    safe = F.regexp_replace(F.replace(c, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(safe), c)


def attribute_map(c: Column) -> Column:
    """``k=v;k=v`` as a map: split at the first ``=``, keys trimmed, values decoded; of repeated keys the last counts."""
    items = F.filter(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: x.contains("="))
    pairs = F.transform(items, lambda x: F.struct(stripped(F.substring_index(x, "=", 1)).alias("k"), percent_decoded(stripped(F.regexp_replace(x, "^[^=]*=", ""))).alias("v")))
    keep = lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda later: later["k"] == p["k"])
    return F.map_from_entries(F.filter(pairs, keep))


def direct_aliases(attributes: Column) -> Column:
    """Sorted names of the protein sequence itself: protein ids, trusted cross references, and an accession-like Name."""
    proteins = split_values(F.try_element_at(attributes, F.lit("protein_id")))
    name = stripped(F.coalesce(F.try_element_at(attributes, F.lit("Name")), F.lit("")))
    own = F.when((name != "") & (F.array_contains(proteins, name) | name.rlike(_ACCESSION_LIKE)), F.array(name)).otherwise(F.array().cast("array<string>"))
    return F.sort_array(F.array_distinct(F.concat(proteins, cross_reference_accessions(F.try_element_at(attributes, F.lit("Dbxref"))), own)))


def _numbered(seqid: Column, raw_id: Column) -> Column:
    number = F.regexp_extract(F.coalesce(raw_id, F.lit("")), _NUMBERED_ID, 1)
    return F.when(number != "", F.concat(seqid, F.lit("_"), number))


def inferred_aliases(seqid: Column, source: Column, attributes: Column) -> Column:
    """Sorted names of the feature (locus tag, ID, Parent, rebuilt gene-caller ids) that are not direct aliases."""
    values = F.flatten(F.array(*[split_values(F.try_element_at(attributes, F.lit(k))) for k in ("locus_tag", "ID", "Parent")]))
    bare = F.transform(F.filter(values, lambda x: x.startswith("cds-") & (F.length(x) > 4)), lambda x: F.regexp_replace(x, "^cds-", ""))
    rebuilt = _numbered(seqid, F.try_element_at(attributes, F.lit("ID")))
    by_caller = (F.lower(source) == "prodigal") | F.map_contains_key(attributes, F.lit("partial")) | F.map_contains_key(attributes, F.lit("start_type"))
    called = F.when(by_caller & rebuilt.isNotNull(), F.array(rebuilt)).otherwise(F.array().cast("array<string>"))
    return F.sort_array(F.array_except(F.array_distinct(F.concat(values, bare, called)), direct_aliases(attributes)))


def locus_protein_id(seqid: Column, attributes: Column, inferred: Column) -> Column:
    """protein_id, else the rebuilt gene-caller id where it is an inferred alias, else the ID without ``cds-``."""
    raw_id = nonempty(F.try_element_at(attributes, F.lit("ID")))
    rebuilt = _numbered(seqid, raw_id)
    given = F.try_element_at(attributes, F.lit("protein_id"))
    return F.coalesce(nonempty(given), F.when(F.array_contains(inferred, rebuilt), rebuilt), F.regexp_replace(raw_id, "^cds-", ""), given)


def accession_in_path(path: Column, name_first: bool = False) -> Column:
    """The first accession in a path, or in its last part before the rest; null if there is none."""
    anywhere = nonempty(F.regexp_extract(path, ACCESSION, 0))
    return F.coalesce(nonempty(F.regexp_extract(F.substring_index(path, "/", -1), ACCESSION, 0)), anywhere) if name_first else anywhere


def file_kind(path: Column) -> Column:
    """faa, gff or fna by suffix; null for other files and for CDS or RNA extracts."""
    name = F.lower(F.substring_index(path, "/", -1))
    extract = name.contains("cds_from_genomic") | name.contains("rna_from_genomic")
    return F.when(name.endswith(".faa"), "faa").when(name.rlike(r"\.gff3?$"), "gff").when(name.rlike(r"\.(fna|fa|fasta)$") & ~extract, "fna")


# Ends of the file names that are preferred.
_CANONICAL = r"(_protein\.faa|_genomic\.gff3?|_genomic\.fna)$"


def is_canonical_name(path: Column) -> Column:
    return F.lower(F.substring_index(path, "/", -1)).rlike(_CANONICAL)


def standard_name(path: Column) -> Column:
    """Struct (folder, name) that a data file should have, or null for files of no known kind.

    The rules hold in order; all but archives need an accession, and a trailing .gz is kept.
    """
    file = F.substring_index(path, "/", -1)
    parts = F.struct(file.alias("file"), F.lower(file).alias("low"), F.regexp_replace(F.lower(file), r"\.gz$", "").alias("base"), accession_in_path(path, name_first=True).alias("acc"))

    def named(v: Column) -> Column:
        low, base, acc = v["low"], v["base"], v["acc"]
        to = lambda folder, tail: F.struct(F.lit(folder).alias("folder"), F.concat(acc, F.lit(tail), F.when(low.endswith(".gz"), ".gz").otherwise("")).alias("name"))
        return (
            F.when(low.endswith(".zip"), F.struct(F.lit("zip").alias("folder"), F.coalesce(F.concat(acc, F.lit(".zip")), v["file"]).alias("name")))
            .when(acc.isNull(), F.lit(None))
            .when(base.contains("dataset_catalog.json"), to("metadata", "_dataset_catalog.json"))
            .when(base.contains("md5sum.txt"), to("metadata", "_md5sum.txt"))
            .when(base.rlike(r"\.(fna|fa|fasta)$") & ~base.contains("protein"), to("genomes", "_genomic.fna"))
            .when(base.endswith(".faa") | base.contains("protein"), to("genomes", "_protein.faa"))
            .when(base.rlike(r"\.gff3?$"), to("genomes", "_genomic.gff"))
            .when(base.endswith(".jsonl") | base.contains("assembly_report") | base.contains("assembly_data_report"), to("metadata", "_assembly_report.jsonl"))
        )

    # the parts of a path are computed once, not once per rule
    return F.get(F.transform(F.array(parts), named), F.lit(0))


def is_iso_date(c: Column) -> Column:
    """A real date written YYYY-MM-DD."""
    return F.coalesce(c.rlike(r"^\d{4}-\d{2}-\d{2}$") & ~c.startswith("0000") & F.try_to_date(c, "yyyy-MM-dd").isNotNull(), F.lit(False))


def coverage(start: Column, end: Column, length: Column) -> Column:
    """Share of a sequence that an alignment covers, to four places; 0 for a sequence without length."""
    return F.when(length > 0, F.round((F.abs(end - start) + 1) / length, 4)).otherwise(F.lit(0.0))


def neg_log10(value: Column, epsilon: float = 1e-300) -> Column:
    return -F.log10(F.greatest(F.lit(0.0), value) + F.lit(epsilon))
