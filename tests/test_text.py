import pytest
from pyspark.sql import functions as F

from genoplane.functions import identifiers as I
from genoplane.functions import text as T


def evaluate(spark, column, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in df.select("i", column(F.col("v"))).orderBy("i").collect()]


SAME = ["GCF_020617240.1", "gca_020617240.2", "GCF_20617240.1", "GСF_020617240.1", "Gcf__020617240.01", "genomes/GCF/020/617/240", "assembly 020617240.1 [GCA]", "GCF_O20617240.1", "GCF_020617240-v1", "GCF_020 617 240.1", "GCF_020 617 240.3", "GCF_020'617'240.1", "GCF_0206​17240.1", "GCF_0206\xad17240.1", "[GCF_020617240.1]", "<GCF_020617240.1>", "MUT_GCF_020617240.1_CUT_1200BP", "GCF_020617240.1 (copy 2)", "GCA_020617240.1/GCF_020617240.1", "GCF_０２０６１７２４０.1", "\xa0GCF:020617240.1\n"]


def test_genome_key_reads_all_writings_of_an_accession(spark):
    assert set(evaluate(spark, T.genome_key, SAME)) == {"acc:20617240"}


def test_genome_key_reads_named_sets(spark):
    values = ["strain_line_53", "Strain-Line-53", "StrainLine53", "53_strain_line", "strain line nr 53", "strain line no. 53", "strain line #53", "strain line: 53", "strain_line_00053", "strain​_line_53", "STRAIN_LINE_53\t", "strain_line_５３"]
    assert set(evaluate(spark, T.genome_key, values)) == {"set:strainline:53"}
    assert evaluate(spark, T.genome_key, ["strain_line_530", "isolate_set_53"]) == ["set:strainline:530", "set:isolateset:53"]


def test_blank_ids_name_nothing(spark):
    assert evaluate(spark, T.genome_key, [None, "", "  ", "\t\xa0", "​"]) == [None] * 5
    assert evaluate(spark, T.genome_key, ["unknown", "?!"]) == ["raw:unknown", "raw:?!"]


def test_words(spark):
    values = ["Hioroaeota", "hIOROAEOTA", ' "Hioroaeota"', "p__Hioroaeota", "phylum: Hioroaeota", "Hioroaeota [phylum]", "Hioroaeota (provisional)", "Hior​oaeota"]
    assert set(evaluate(spark, T.group_key, values)) == {"hioroaeota"}
    assert evaluate(spark, T.group_key, ["Candidatus  Mevuvirgota", "Unclassified", "", None, "-"]) == ["candidatusmevuvirgota", None, None, None, None]
    assert evaluate(spark, T.tier_key, ["tier B", "Tier-B", "(B)", "b\t", "D", "?", None]) == ["B"] * 4 + [None] * 3


def test_accession_text_drops_outer_blanks_only(spark):
    assert evaluate(spark, T.accession_text, [" GCF_1.1\t", "\nGCF_1.1", "GCF 1.1", " \t", None, "\xa0x"]) == ["gcf_1.1", "gcf_1.1", "gcf 1.1", None, None, "\xa0x"]


def test_token_size_is_bytes(spark):
    assert evaluate(spark, T.text_tokens, ["abc", "é。", "", None]) == [3, 5, 0, 0]


def test_attribute_map_keeps_the_last_of_repeated_keys(spark):
    got = evaluate(spark, I.attribute_map, ["a=1; b =x%2Cy+z;a=2=3;junk;c=%zz", None, ""])
    assert got == [{"a": "2=3", "b": "x,y+z", "c": "%zz"}, {}, {}]


def test_escapes_are_decoded_one_by_one(spark):
    values = ["a%2Zb%2C", "100%", "%41%", "x+y%20z", "caf%C3%A9", "%FFz", "plain"]
    assert evaluate(spark, I.percent_decoded, values) == ["a%2Zb,", "100%", "A%", "x+y z", "café", "\ufffdz", "plain"]


def test_long_remarks_are_dropped_at_any_distance(spark):
    long = "word" + " " * 400 + "(remark)"
    assert evaluate(spark, T.word_key, [long, "(a) (b)", "(only)", "x" * 300 + " [y] z"]) == ["word", "ab", "only", "x" * 300 + "z"]


def test_aliases(spark):
    a = "ID=cds-X1;locus_tag=L1,L2;protein_id=WP_1.1;Dbxref=GenBank:AB1,Other:q,refseq: NP_2;Name=AB_12.1"
    assert evaluate(spark, lambda c: I.direct_aliases(I.attribute_map(c)), [a, "Name=free text", "Name=WP_9"]) == [["AB1", "AB_12.1", "NP_2", "WP_1.1"], [], ["WP_9"]]
    inferred = lambda c: I.inferred_aliases(F.lit("ctg"), F.lit("Prodigal"), I.attribute_map(c))
    assert evaluate(spark, inferred, [a, "ID=1_7", "ID=1_7;protein_id=ctg_7"]) == [["L1", "L2", "X1", "cds-X1"], ["1_7", "ctg_7"], ["1_7"]]


@pytest.mark.parametrize(("value", "good"), [("2024-02-29", True), ("2023-02-29", False), ("2024-2-29", False), ("0000-01-01", False), ("20240229", False), (None, False)])
def test_iso_dates(spark, value, good):
    assert evaluate(spark, I.is_iso_date, [value]) == [good]


def test_paths(spark):
    assert evaluate(spark, I.file_kind, ["/a/x.FAA", "/a/x.gff3", "/a/x.fa", "/a/x_cds_from_genomic.fna", "/a/x.txt"]) == ["faa", "gff", "fna", None, None]
    named = evaluate(spark, I.standard_name, ["/d/GCF_1.1/protein.faa.gz", "/d/GCF_1.1.zip", "/d/notes.txt", "/d/GCA_2.1_genomic.gff3", "/d/GCA_2.1/md5sum.txt"])
    assert [tuple(x) if x else None for x in named] == [("genomes", "GCF_1.1_protein.faa.gz"), ("zip", "GCF_1.1.zip"), None, ("genomes", "GCA_2.1_genomic.gff"), ("metadata", "GCA_2.1_md5sum.txt")]
