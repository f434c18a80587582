"""Genomic loci from annotation lines, and the resolution of hits to loci through their aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genoplane.functions.identifiers import attribute_map, direct_aliases, inferred_aliases, locus_protein_id, stripped
from genoplane.functions.text import is_blank
from genoplane.operators.hotkeys import many_to_many_join


class LocusError(ValueError):
    """An annotation line or a hit table that breaks its contract."""


def annotation_loci(lines: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """CDS loci of annotation lines (accession, line_no, value): (loci, rejects).

    Comment and blank lines, lines without exactly nine fields and other feature types are skipped. A CDS whose
    start or end is no integer, or not 1 <= start <= end, is a reject (accession, line_no, value); `strict`
    raises instead when the loci are read. Columns of loci: accession, locus_row, seqid, feature_type, start,
    end, strand, protein_id, locus_tag, gff_id, parent_id, direct_aliases, inferred_aliases, aliases.
    """
    parts = F.split("value", "\t", -1)
    rows = lines.filter(~is_blank(F.col("value")) & ~F.col("value").startswith("#")).withColumn("p", parts)
    rows = rows.filter((F.size("p") == 9) & (F.get("p", F.lit(2)) == "CDS"))
    rows = rows.withColumns({"start": F.expr("try_cast(get(p, 3) AS BIGINT)"), "end": F.expr("try_cast(get(p, 4) AS BIGINT)")})
    good = F.coalesce((F.col("start") >= 1) & (F.col("end") >= F.col("start")), F.lit(False))
    rejects = rows.filter(~good).select("accession", "line_no", "value")
    if strict:
        where = F.concat(F.lit("bad CDS coordinates in "), F.coalesce("accession", F.lit("?")), F.lit(" line "), F.col("line_no").cast("string"))
        rows = rows.withColumn("start", F.when(good, F.col("start")).otherwise(F.raise_error(where).cast("bigint")))
    else:
        rows = rows.filter(good)
    rows = rows.withColumns({"seqid": F.get("p", F.lit(0)), "a": attribute_map(F.get("p", F.lit(8)))})
    rows = rows.withColumn("inferred_aliases", inferred_aliases(F.col("seqid"), F.get("p", F.lit(1)), F.col("a"))).withColumn("direct_aliases", direct_aliases(F.col("a")))
    get = lambda k: F.try_element_at("a", F.lit(k))
    loci = rows.select(
        "accession", F.col("line_no").alias("locus_row"), "seqid", F.lit("CDS").alias("feature_type"), "start", "end", F.get("p", F.lit(6)).alias("strand"),
        locus_protein_id(F.col("seqid"), F.col("a"), F.col("inferred_aliases")).alias("protein_id"), get("locus_tag").alias("locus_tag"), get("ID").alias("gff_id"), get("Parent").alias("parent_id"),
        "direct_aliases", "inferred_aliases", F.sort_array(F.array_union("direct_aliases", "inferred_aliases")).alias("aliases"),
    )
    return loci, rejects


def with_alias_columns(loci: DataFrame) -> DataFrame:
    """Loci of older tables without alias columns: the protein id is direct; listed aliases, tags and ids are inferred."""
    if "direct_aliases" in loci.columns or "inferred_aliases" in loci.columns:
        empty = F.array().cast("array<string>")
        return loci.withColumns({c: F.coalesce(c, empty) if c in loci.columns else empty for c in ("direct_aliases", "inferred_aliases")})
    one = lambda c: F.when(~is_blank(F.col(c)), F.array(stripped(F.col(c)))).otherwise(F.array().cast("array<string>")) if c in loci.columns else F.array().cast("array<string>")
    listed = F.coalesce("aliases", F.array().cast("array<string>")) if "aliases" in loci.columns else F.array().cast("array<string>")
    direct = one("protein_id")
    return loci.withColumn("direct_aliases", direct).withColumn("inferred_aliases", F.array_except(F.concat(listed, one("locus_tag"), one("gff_id"), one("parent_id")), direct))


def keyed_hits(hits: DataFrame) -> DataFrame:
    """Hits by ``protein_id``: target_protein is renamed, else target_name where protein_id is missing. Blank keys are dropped."""
    if "target_protein" in hits.columns:
        hits = hits.drop("protein_id").withColumnRenamed("target_protein", "protein_id")
    elif "protein_id" not in hits.columns and "target_name" in hits.columns:
        hits = hits.withColumnRenamed("target_name", "protein_id")
    if "protein_id" not in hits.columns:
        raise LocusError("hits need target_protein, target_name or protein_id")
    return hits.withColumn("protein_id", stripped(F.col("protein_id"))).filter(~is_blank(F.col("protein_id")))


def usable_aliases(loci: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, alias, locus_row, n_loci): aliases that resolve hits, with the number of loci of each.

    Direct aliases all count and may lead to many loci. An inferred alias counts if it is no direct alias of any
    locus in the scope (a genome) and belongs to one locus only.
    """
    loci = with_alias_columns(loci)
    tall = lambda c, d: loci.select(*scope, "locus_row", F.lit(d).alias("is_direct"), F.explode(c).alias("alias"))
    both = tall("direct_aliases", True).unionByName(tall("inferred_aliases", False)).filter(~is_blank(F.col("alias"))).distinct()
    # one window decides both rules: rows are already distinct, so plain counts count loci
    w = Window.partitionBy(*scope, "alias")
    both = both.withColumns({"any_direct": F.max("is_direct").over(w), "n_loci": F.sum(F.lit(1)).over(w)})
    keep = F.col("is_direct") | (~F.col("any_direct") & (F.col("n_loci") == 1))
    n_direct = F.sum(F.col("is_direct").cast("bigint")).over(w)
    return both.withColumn("n_loci", F.when(F.col("any_direct"), n_direct).otherwise(F.col("n_loci"))).filter(keep).select(*scope, "alias", "locus_row", "n_loci")


def resolve_hits(hits: DataFrame, loci: DataFrame, scope: list[str]) -> DataFrame:
    """One row per hit and locus it resolves to. Locus columns that clash with hit columns get the prefix ``locus_``.

    Pairs may be many times the input, so they are made once and not moved: aliases bring the columns of their locus,
    and since an alias leads to a locus once, only a hit_row that occurs repeatedly can reach one twice. The pairs of
    those hits alone are reduced.
    """
    hits = keyed_hits(hits)
    key = [*scope, "protein_id"]
    aliases = usable_aliases(loci, scope).select(*scope, F.col("alias").alias("protein_id"), "locus_row")
    taken = {*hits.columns, *scope, "locus_row"}
    place = loci.select(*scope, "locus_row", *[F.col(c).alias(f"locus_{c}" if c in taken else c) for c in loci.columns if c not in (*scope, "locus_row")])
    marked = hits.withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy(*scope, "hit_row")))
    single, repeated = (marked.filter(c).drop("_rows") for c in ("_rows = 1", "_rows > 1"))
    once = many_to_many_join(single, aliases.join(place, [*scope, "locus_row"]), key, "hit_row", hits)
    reduced = repeated.join(aliases, key).dropDuplicates([*scope, "hit_row", "locus_row"]).join(place, [*scope, "locus_row"])
    return reduced.unionByName(once)


def match_statistics(hits: DataFrame, loci: DataFrame, scope: list[str]) -> DataFrame:
    """One row per scope with hits: hit_rows, matched_rows, unmatched_ids (distinct), and how many aliases are ambiguous or lead to many loci."""
    hits = keyed_hits(hits)
    aliases = usable_aliases(loci, scope)
    names = aliases.groupBy(*scope, F.col("alias").alias("protein_id")).agg(F.max("n_loci").alias("n_loci"))
    marked = hits.join(names, [*scope, "protein_id"], "left")
    found = F.col("n_loci").isNotNull()
    many = names.filter("n_loci > 1").groupBy(*scope).agg(F.count(F.lit(1)).alias("multi_match_aliases"))
    tall = with_alias_columns(loci).select(*scope, "locus_row", "direct_aliases", F.explode("inferred_aliases").alias("alias"))
    direct = with_alias_columns(loci).select(*scope, F.explode("direct_aliases").alias("alias")).distinct()
    vague = tall.select(*scope, "alias", "locus_row").distinct().join(direct, [*scope, "alias"], "left_anti").groupBy(*scope, "alias").count().filter("count > 1").groupBy(*scope).agg(F.count(F.lit(1)).alias("ambiguous_aliases"))
    stats = marked.groupBy(*scope).agg(F.count(F.lit(1)).alias("hit_rows"), F.count_if(found).alias("matched_rows"), F.count_distinct(F.when(~found, F.col("protein_id"))).alias("unmatched_ids"))
    return stats.join(many, scope, "left").join(vague, scope, "left").fillna(0, ["multi_match_aliases", "ambiguous_aliases"])


def match_lists(hits: DataFrame, loci: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, kind, name): the names behind `match_statistics`, one row each and whole.

    ``unmatched_id`` are protein ids of hits that lead to no locus, ``ambiguous_alias`` inferred aliases of several loci
    that no locus has as direct alias, ``multi_match_alias`` usable aliases that lead to several loci.
    """
    lost = unmatched_hits(hits, loci, scope).select(*scope, F.lit("unmatched_id").alias("kind"), F.col("protein_id").alias("name")).distinct()
    many = usable_aliases(loci, scope).filter("n_loci > 1").select(*scope, F.lit("multi_match_alias").alias("kind"), F.col("alias").alias("name")).distinct()
    own = with_alias_columns(loci)
    direct = own.select(*scope, F.explode("direct_aliases").alias("alias")).distinct()
    vague = own.select(*scope, "locus_row", F.explode("inferred_aliases").alias("alias")).filter(~is_blank(F.col("alias"))).distinct().join(direct, [*scope, "alias"], "left_anti")
    vague = vague.groupBy(*scope, "alias").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*scope, F.lit("ambiguous_alias").alias("kind"), F.col("alias").alias("name"))
    return lost.unionByName(many).unionByName(vague)


def unmatched_hits(hits: DataFrame, loci: DataFrame, scope: list[str]) -> DataFrame:
    """Hits that resolve to no locus."""
    hits = keyed_hits(hits)
    names = usable_aliases(loci, scope).select(*scope, F.col("alias").alias("protein_id")).distinct()
    return hits.join(names, [*scope, "protein_id"], "left_anti")
