"""Features per genome: marker counts, cluster measures, and fitted encodings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoplane.functions.identifiers import neg_log10

# Marker genes and their protein families.
CORE_MARKERS = {"nifH": "PF00142", "nifD": "PF00148", "nifK": "PF02826"}
AUXILIARY_MARKERS = {"anfG": "PF05910", "vnfG": "PF05911", "fixA": "PF01202", "fixB": "PF02525", "fixC": "PF02526", "fixX": "PF01802"}


def marker_features(genomes: DataFrame, hits: DataFrame, core: Mapping[str, str] = CORE_MARKERS, auxiliary: Mapping[str, str] = AUXILIARY_MARKERS, genome: str = "accession") -> DataFrame:
    """Per genome: count, best score and e-value of each core marker under gene and family name, completeness, auxiliary counts.

    One grouped pass over the hits. Core markers go by pfam_id alone where hits have that column, else by
    gene_family (family or symbol); auxiliary ones always by gene_family. The score is effective_score, else
    raw_score, else 0; without hits the score is 0, the e-value 1 and its logarithm 0. Every genome gets a row.
    """
    family = "gene_family" if "gene_family" in hits.columns else None
    no = F.lit(False)
    by_family = lambda gene, pfam: F.coalesce(F.col(family).isin(gene, pfam), no) if family else no
    of_core = lambda gene, pfam: F.coalesce(F.col("pfam_id") == pfam, no) if "pfam_id" in hits.columns else by_family(gene, pfam)
    score = next((F.col(c) for c in ("effective_score", "raw_score") if c in hits.columns), F.lit(None).cast("double"))
    evalue = F.col("seq_evalue") if "seq_evalue" in hits.columns else F.lit(None).cast("double")
    aggs: list[Column] = []
    for gene, pfam in core.items():
        mine = of_core(gene, pfam)
        aggs += [F.count_if(mine).alias(f"n_{gene}"), F.max(F.when(mine, score)).alias(f"s_{gene}"), F.min(F.when(mine, evalue)).alias(f"e_{gene}")]
    aggs += [F.count_if(by_family(gene, pfam)).alias(f"x_{gene}") for gene, pfam in auxiliary.items()]
    joined = genomes.select(genome).join(hits.groupBy(genome).agg(*aggs), genome, "left")
    zero = F.lit(0).cast("bigint")
    out: dict[str, Column] = {}
    for gene, pfam in core.items():
        best, low = F.coalesce(f"s_{gene}", F.lit(0.0)), F.coalesce(f"e_{gene}", F.lit(1.0))
        log = F.coalesce(neg_log10(F.col(f"e_{gene}")), F.lit(0.0))
        out |= {f"marker_core_{gene}_count": F.coalesce(f"n_{gene}", zero), f"marker_core_{gene}_max_bitscore": best, f"marker_core_{gene}_neg_log_evalue": log, f"{pfam}_max_bitscore": best, f"{pfam}_min_evalue": low, f"-log10_{pfam}_min_evalue": log}
    found = sum((F.coalesce(F.col(f"n_{gene}") > 0, no).cast("int") for gene in core), F.lit(0))
    out["operon_core_completeness_score"] = found / F.lit(float(len(core)))
    out |= {f"marker_aux_{gene}_count": F.coalesce(f"x_{gene}", zero) for gene in auxiliary}
    return joined.select(genome, *[c.alias(name) for name, c in out.items()])


def cluster_features(genomes: DataFrame, clusters: DataFrame, genome: str = "accession", core: Mapping[str, str] = CORE_MARKERS) -> DataFrame:
    """Per genome: number, spans and gene counts of its clusters, and how many are complete; zeros without clusters."""
    missing = lambda names: F.size(F.array_except(F.array(*map(F.lit, names)), "gene_families")) == 0
    complete = F.col("has_catalytic_core") | missing(list(core.values())) | missing(list(core))
    per = clusters.groupBy(genome).agg(F.count(F.lit(1)).alias("n"), F.max("span_bp").cast("double").alias("m"), F.avg("span_bp").alias("a"), F.max("gene_count").alias("g"), F.count_if(complete).alias("c"))
    j = genomes.select(genome).join(per, genome, "left")
    n, m, c = (F.coalesce("n", F.lit(0).cast("bigint")), F.coalesce("m", F.lit(0.0)), F.coalesce("c", F.lit(0).cast("bigint")))
    return j.select(
        genome, n.alias("clusters_found"), n.alias("clusters_found_count"), m.alias("max_cluster_span_bp"), m.alias("cluster_max_span_bp"), F.coalesce("a", F.lit(0.0)).alias("cluster_avg_span_bp"), F.coalesce("g", F.lit(0).cast("bigint")).alias("cluster_max_gene_count"), c.alias("complete_hdk_clusters"), c.alias("cluster_complete_hdk_count"),
    )


def tokens(text: Column) -> Column:
    """Words of letters, digits and underscores, in any script, with their case."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}_]+"), 0)


def term_counts(docs: DataFrame, doc: str, text: str) -> DataFrame:
    return docs.select(doc, F.explode(tokens(F.col(text))).alias("term")).groupBy(doc, "term").agg(F.count(F.lit(1)).alias("tf"))


def fit_vocabulary(counts: DataFrame, n_docs: int, max_terms: int = 1000) -> DataFrame:
    """(term, df, idf) of the `max_terms` terms with the highest total count, ties by term.

    idf is ln((1 + n) / (1 + df)) + 1. The cut is a top-k, which Spark keeps per task before it merges.
    """
    stats = counts.groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))
    idf = F.ln(F.lit(float(1 + n_docs)) / (1 + F.col("df"))) + 1
    return stats.orderBy(F.desc("total"), "term").limit(max_terms).select("term", "total", "df", idf.alias("idf"))


def tfidf(counts: DataFrame, vocabulary: DataFrame, doc: str) -> DataFrame:
    """(doc, term, weight): (1 + ln tf) x idf, each document scaled to length 1. Documents without known terms have no rows."""
    w = counts.join(F.broadcast(vocabulary.select("term", "idf")), "term").withColumn("w", (1 + F.ln("tf")) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(doc)))  # at most one row per vocabulary term
    return w.select(doc, "term", (F.col("w") / norm).alias("weight"))


def fit_categories(df: DataFrame, column: str, min_frequency: float = 0.01) -> DataFrame:
    """(category, n, bucket): frequent categories are their own bucket, those below the share go to ``infrequent``; null is ``unknown``."""
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    counts = df.groupBy(F.coalesce(column, F.lit("unknown")).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("bucket", F.when(F.col("n") >= min_frequency * n, F.col("category")).otherwise("infrequent"))


def one_hot(df: DataFrame, key: str, column: str, buckets: Sequence[tuple[str, str]], prefix: str = "tax") -> DataFrame:
    """A 0/1 column per bucket of the fitted (category, bucket) pairs; a category that was not fitted gives zeros."""
    value = F.coalesce(column, F.lit("unknown"))
    members: dict[str, list[str]] = {}
    for category, bucket in buckets:
        members.setdefault(bucket, []).append(category)
    return df.select(key, *[F.when(value.isin(members[b]), 1.0).otherwise(0.0).alias(f"{prefix}_{column}_{b}") for b in sorted(members)])


def fit_scaling(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float, float]]:
    """(median, mean, deviation) per column: exact median of the present values (0 if there are none), then mean and population deviation of the imputed ones (1 if 0).

    One pass for the medians, one for the moments; one row comes back.
    """
    clean = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns}
    med = df.agg(*[F.median(x).alias(c) for c, x in clean.items()]).first()
    medians = {c: float(med[c]) if med[c] is not None else 0.0 for c in columns}
    filled = {c: F.coalesce(x, F.lit(medians[c])) for c, x in clean.items()}
    got = df.agg(*[f(x).alias(f"{c}_{k}") for c, x in filled.items() for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (medians[c], float(got[f"{c}_m"] or 0.0), float(got[f"{c}_s"] or 0.0) or 1.0) for c in columns}


def scaled(df: DataFrame, key: str, fitted: Mapping[str, tuple[float, float, float]], prefix: str = "meta_num") -> DataFrame:
    clean = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    return df.select(key, *[((F.coalesce(clean(c), F.lit(med)) - mean) / sd).alias(f"{prefix}_{c}") for c, (med, mean, sd) in fitted.items()])


class NotFitted(RuntimeError):
    """A transformer that was used before it was fitted."""


@dataclass
class GenomeFeaturizer:
    """Markers, clusters, family TF-IDF, taxonomy one-hot and scaled numbers as one wide table.

    `fit` takes the genomes to learn from (all by default; pass a training subset to keep evaluation genomes
    out of vocabulary and scaling). Columns: id, status, then all features by name.
    """

    category_columns: Sequence[str] = ("phylum", "class", "order", "family", "genus")
    numeric_columns: Sequence[str] = ()
    max_terms: int = 1000
    min_frequency: float = 0.01
    genome: str = "accession"
    _state: dict = field(default_factory=dict)

    def _families(self, genomes: DataFrame, hits: DataFrame) -> DataFrame:
        docs = hits.select(self.genome, F.explode(tokens(F.col("gene_family"))).alias("term")).groupBy(self.genome, "term").agg(F.count(F.lit(1)).alias("tf"))
        return docs.join(genomes.select(self.genome), self.genome, "left_semi")

    def _whole(self, genomes: DataFrame) -> DataFrame:
        """With the category and number columns that are missing, all null: their features are constant then, but there."""
        missing = {c: "string" for c in self.category_columns} | {c: "double" for c in self.numeric_columns}
        return genomes.withColumns({c: F.lit(None).cast(kind) for c, kind in missing.items() if c not in genomes.columns})

    def fit(self, genomes: DataFrame, hits: DataFrame) -> GenomeFeaturizer:
        genomes = self._whole(genomes)
        n = genomes.count()
        counts = self._families(genomes, hits)
        vocabulary = [(r["term"], r["idf"]) for r in fit_vocabulary(counts, n, self.max_terms).collect()]  # at most max_terms rows
        buckets = {c: [(r["category"], r["bucket"]) for r in fit_categories(genomes, c, self.min_frequency).filter(F.col("bucket") != "infrequent").collect()] for c in self.category_columns}
        rare = {c: fit_categories(genomes, c, self.min_frequency).filter(F.col("bucket") == "infrequent").select("category") for c in buckets}
        self._state = {"vocabulary": vocabulary or [("dummy_pfam", 1.0)], "buckets": buckets, "rare": rare, "scaling": fit_scaling(genomes, self.numeric_columns) if self.numeric_columns else {}}
        return self

    def transform(self, genomes: DataFrame, hits: DataFrame, clusters: DataFrame) -> DataFrame:
        if not self._state:
            raise NotFitted("fit before transform")
        g, spark, genomes = self.genome, genomes.sparkSession, self._whole(genomes)
        status = F.coalesce("status", F.lit("SUCCESS")) if "status" in genomes.columns else F.lit("SUCCESS")
        out = genomes.select(F.col(g), status.alias("status"))
        out = out.join(marker_features(genomes, hits, genome=g), g).join(cluster_features(genomes, clusters, genome=g), g)
        vocabulary = spark.createDataFrame(self._state["vocabulary"], "term string, idf double")
        weights = tfidf(self._families(genomes, hits), vocabulary, g)
        terms = [t for t, _ in self._state["vocabulary"]]
        wide = weights.groupBy(g).pivot("term", terms).agg(F.first("weight")).select(g, *[F.col(f"`{t}`").alias(f"pfam_tfidf_{t}") for t in terms])
        out = out.join(wide, g, "left").fillna(0.0, [f"pfam_tfidf_{t}" for t in terms])
        for c, pairs in self._state["buckets"].items():
            known = one_hot(genomes, g, c, pairs)
            rare = genomes.select(g, F.coalesce(c, F.lit("unknown")).alias("category")).join(self._state["rare"][c], "category", "left_semi").select(g, F.lit(1.0).alias(f"tax_{c}_infrequent"))
            out = out.join(known, g).join(rare, g, "left").fillna(0.0, [f"tax_{c}_infrequent"])
        if self._state["scaling"]:
            out = out.join(scaled(genomes, g, self._state["scaling"]), g)
        names = sorted(c for c in out.columns if c not in (g, "status"))
        return out.select(g, "status", *[F.col(f"`{c}`") for c in names])

    def fit_transform(self, genomes: DataFrame, hits: DataFrame, clusters: DataFrame) -> DataFrame:
        return self.fit(genomes, hits).transform(genomes, hits, clusters)
