"""Stratified folds that keep groups together, and the checks that nothing leaks."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoplane.functions.text import is_blank
from genoplane.operators.hotkeys import salted_join
from genoplane.operators.ranking import distributed_rank
from genoplane.session import cut_lineage

MAX_SIZES = 20_000


class LeakageError(ValueError):
    """A dataset or a fold manifest that would leak or cannot be split."""


def mixed_groups(frame: DataFrame, group: str, label: str) -> DataFrame:
    """Groups with more than one label: (group, n_labels)."""
    return frame.groupBy(group).agg(F.count_distinct(label).alias("n_labels")).filter("n_labels > 1")


def dataset_summary(frame: DataFrame, accession: str, group: str, label: str, positive: str = "positive") -> DataFrame:
    """One row: rows, accessions, groups, rows and groups per class, and groups with both labels."""
    groups = frame.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col(label) == positive).alias("p"), F.bool_or(F.col(label) != positive).alias("q"), F.count_if(F.col(label) == positive).alias("np"))
    per_group = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_groups"), F.coalesce(F.sum("np"), F.lit(0)).alias("positive_rows"), F.coalesce(F.sum(F.col("n") - F.col("np")), F.lit(0)).alias("negative_rows"),
        F.count_if("p").alias("positive_groups"), F.count_if("q").alias("negative_groups"), F.count_if(F.col("p") & F.col("q")).alias("mixed_groups"),
    )
    n = frame.agg(F.count_distinct(accession).alias("n_accessions")).scalar()
    return per_group.withColumn("n_accessions", n)


def check_dataset(frame: DataFrame, accession: str, group: str, label: str, n_splits: int, n_repeats: int, classes: Sequence[str] = ("positive", "negative")) -> dict:
    """Raise LeakageError at the first thing that forbids grouped folds; returns the summary.

    In order: counts of splits and repeats, columns, nulls, label domain, repeated accessions, groups with
    both labels, groups per class.
    """
    for name, value, least in (("n_splits", n_splits, 2), ("n_repeats", n_repeats, 1)):
        if isinstance(value, bool) or not isinstance(value, int) or value < least:
            raise LeakageError(f"{name} has to be an integer of at least {least}")
    columns = [accession, group, label]
    if len(set(frame.columns)) < len(frame.columns):
        raise LeakageError("repeated column names")
    if missing := [c for c in columns if c not in frame.columns]:
        raise LeakageError(f"missing columns: {missing}")
    blank = lambda c: is_blank(F.col(c))
    got = frame.agg(*[F.count_if(blank(c)).alias(c) for c in columns], F.count_if(~F.col(label).isin(*classes)).alias("_other")).first()
    if bad := [c for c in columns if got[c]]:
        raise LeakageError(f"blank values in {bad}")
    if got["_other"]:
        raise LeakageError(f"{got['_other']} rows with a label outside {list(classes)}")
    summary = dataset_summary(frame, accession, group, label, classes[0]).first().asDict()
    if summary["n_accessions"] < summary["n_rows"]:
        raise LeakageError("accessions have to be unique")
    if summary["mixed_groups"]:
        some = [r[group] for r in mixed_groups(frame, group, label).orderBy(group).limit(10).collect()]
        raise LeakageError(f"groups with both labels: {some}")
    if min(summary["positive_groups"], summary["negative_groups"]) < n_splits:
        raise LeakageError(f"each class needs at least {n_splits} groups")
    return summary


def level_loads(loads: Sequence[int], size: int, count: int, first: int) -> list[int]:
    """How many of `count` groups of `size` rows each fold gets if one after the other goes to the fold with the fewest rows.

    Of equally loaded folds the one that comes first, counted on from fold `first`, is taken. Found by bisecting the
    level up to which folds are filled, not group by group.
    """
    k = len(loads)
    upto = lambda level: [max(0, -((x - level) // size)) if level > x else 0 for x in loads]
    lo, hi = min(loads), max(loads) + size * (count + 1)
    while hi - lo > 1:  # the highest level that does not take more than there are
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if sum(upto(mid)) <= count else (lo, mid)
    got = upto(lo)
    turn = sorted(range(k), key=lambda f: (loads[f] + got[f] * size, (f - first) % k))
    for f in turn[: count - sum(got)]:
        got[f] += 1
    return got


def deal_groups(sizes: Sequence[tuple[str, int, int]], n_splits: int, repeat: int) -> list[tuple[str, int, list[int]]]:
    """(label, size, groups up to and with each fold) of a repeat, from (label, size, count): per label the largest groups first, each to the fold with the fewest rows of the label."""
    out = []
    for i, label in enumerate(sorted({s[0] for s in sizes})):
        loads = [0] * n_splits
        for _, size, count in sorted((s for s in sizes if s[0] == label), key=lambda s: -s[1]):
            got = level_loads(loads, size, count, (repeat + i) % n_splits)
            loads = [x + size * g for x, g in zip(loads, got, strict=True)]
            out.append((label, size, list(accumulate(got))))
    return out


def assign_folds(frame: DataFrame, group: str, label: str, n_splits: int, n_repeats: int, seed: int = 42) -> DataFrame:
    """(repeat, fold, group, label): the label-pure groups of each class are dealt to folds of about equally many rows.

    Per class the largest groups come first, and each goes to the fold with the fewest rows of the class so far; with at
    least n_splits groups per class, every fold has both classes. This needs the number of groups per class and size
    alone, a histogram with at most the root of twice the number of rows sizes per class (`deal_groups`); groups of
    equal size are ordered by a digest of seed, repeat and name and dealt in that order. A group is in one fold of
    a repeat. The order is a distributed rank, so a class may have any number of groups.
    """
    groups = cut_lineage(frame.groupBy(group, label).agg(F.count(F.lit(1)).alias("_n")), "groups")
    sizes = [(r[label], r["_n"], r["c"]) for r in groups.groupBy(label, "_n").agg(F.count(F.lit(1)).alias("c")).collect()]
    plan = [(r, *row) for r in range(1, n_repeats + 1) for row in deal_groups(sizes, n_splits, r)]
    plan = frame.sparkSession.createDataFrame(plan, f"repeat int, {label} string, _n bigint, _upto array<bigint>")
    each = groups.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(n_repeats))))
    digest = F.md5(F.concat((F.lit(seed - 1) + F.col("repeat")).cast("string"), F.lit("|"), F.col(group)))
    ranked = distributed_rank(each.withColumn("_d", digest), ["repeat", label, "_n"], [F.col("_d"), F.col(group)])
    placed = ranked.join(F.broadcast(plan) if len(sizes) <= MAX_SIZES else plan, ["repeat", label, "_n"])
    fold = F.size(F.filter("_upto", lambda upto: upto < F.col("rank"))) + 1
    return placed.select("repeat", fold.alias("fold"), group, label)


def fold_manifest(frame: DataFrame, accession: str, group: str, label: str, n_splits: int, n_repeats: int, seed: int = 42) -> DataFrame:
    """(repeat, fold, split, accession, group, label) of the validation rows of every fold; `sorted_manifest` puts them in order.

    Rows of groups that hold much of the table are dealt to slices in the join with the folds.
    """
    folds = assign_folds(frame, group, label, n_splits, n_repeats, seed)
    rows = salted_join(frame.select(accession, group, label), folds.drop(label), group, accession)
    return rows.select("repeat", "fold", F.lit("validation").alias("split"), accession, group, label)


def sorted_manifest(manifest: DataFrame, accession: str) -> DataFrame:
    """A manifest in the order in which it is published: repeat, fold, accession."""
    return manifest.orderBy("repeat", "fold", accession)


def fold_rows(frame: DataFrame, manifest: DataFrame, repeat: int, fold: int, accession: str, group: str) -> tuple[DataFrame, DataFrame]:
    """(training, validation) rows of a fold: validation by accession; training is what shares no group with it."""
    own = manifest.filter((F.col("repeat") == repeat) & (F.col("fold") == fold))
    validation = frame.join(own.select(accession), accession, "left_semi")
    return frame.join(own.select(group).distinct(), group, "left_anti"), validation


def manifest_violations(frame: DataFrame, manifest: DataFrame, accession: str, group: str, label: str, n_splits: int, n_repeats: int) -> DataFrame:
    """(check, n_violations) of a fold manifest against its dataset; all 0 for a sound one.

    Checks: rows that are not validation; repeats or folds outside the expected ones; (repeat, accession) pairs
    missing, repeated or unknown; groups in several folds of a repeat; rows whose group or label changed; and
    folds without both classes.
    """
    expected = frame.select(accession).withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(n_repeats))))
    seen = manifest.groupBy("repeat", accession).agg(F.count(F.lit(1)).alias("n"))
    known = manifest.select("repeat", accession, F.col(group).alias("mg"), F.col(label).alias("ml")).join(frame.select(accession, group, label), accession)
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias("n_violations")).select(F.lit(name).alias("check"), "n_violations")
    parts = [
        n(manifest.filter(F.col("split") != "validation"), "not_validation"),
        n(manifest.filter(~F.col("repeat").between(1, n_repeats) | ~F.col("fold").between(1, n_splits)), "unexpected_fold"),
        n(expected.join(seen, ["repeat", accession], "left_anti"), "missing_row"),
        n(seen.join(expected, ["repeat", accession], "left_anti"), "unknown_row"),
        n(seen.filter("n > 1"), "repeated_row"),
        n(manifest.groupBy("repeat", group).agg(F.count_distinct("fold").alias("k")).filter("k > 1"), "split_group"),
        n(known.filter(~F.col("mg").eqNullSafe(F.col(group)) | ~F.col("ml").eqNullSafe(F.col(label))), "changed_row"),
        n(manifest.groupBy("repeat", "fold").agg(F.count_distinct(label).alias("k")).filter("k < 2"), "single_class_fold"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fold_counts(frame: DataFrame, manifest: DataFrame, group: str, label: str, positive: str = "positive") -> DataFrame:
    """Rows, groups and rows per class of training and validation, per repeat and fold.

    Training counts are the totals less the validation ones: a group is in one fold of a repeat.
    """
    total = frame.agg(F.count(F.lit(1)).alias("tr"), F.count_distinct(group).alias("tg"), F.count_if(F.col(label) == positive).alias("tp"))
    own = manifest.groupBy("repeat", "fold").agg(F.count(F.lit(1)).alias("validation_rows"), F.count_distinct(group).alias("validation_groups"), F.count_if(F.col(label) == positive).alias("validation_positive"))
    own = own.withColumns({c: total.select(c).scalar() for c in ("tr", "tg", "tp")})
    minus = lambda t, v: (F.col(t) - F.col(v))
    return own.select(
        "repeat", "fold", minus("tr", "validation_rows").alias("training_rows"), "validation_rows", minus("tg", "validation_groups").alias("training_groups"), "validation_groups",
        minus("tp", "validation_positive").alias("training_positive"), (minus("tr", "validation_rows") - minus("tp", "validation_positive")).alias("training_negative"), "validation_positive", minus("validation_rows", "validation_positive").alias("validation_negative"),
    )


def check_fold_counts(counts: Mapping[tuple[int, str], int], folds: Iterable[int], classes: Sequence[str] = ("positive", "negative")) -> None:
    """Raise LeakageError where the validation or the training side of a fold, given the rows per (fold, label) of a repeat, is empty or lacks a class."""
    for fold in folds:
        for name, own in (("validation", lambda f: f == fold), ("training", lambda f: f != fold)):
            n = {c: sum(v for (f, label), v in counts.items() if label == c and own(f)) for c in classes}
            if not sum(n.values()):
                raise LeakageError(f"no {name} rows in fold {fold}")
            if lacking := [c for c in classes if not n[c]]:
                raise LeakageError(f"{name} rows of fold {fold} without {lacking}")


def check_fold(training: DataFrame, validation: DataFrame, group: str, label: str, classes: Sequence[str] = ("positive", "negative")) -> None:
    """Raise LeakageError where a side of a fold is empty or lacks a class, or where the sides share a group."""
    counts = {(i, r[0]): r[1] for i, side in enumerate((training, validation)) for r in side.groupBy(label).count().collect()}
    check_fold_counts(counts, [1], classes)
    if not shared_groups(training, validation, group).isEmpty():
        raise LeakageError("training and validation share a group")


def shared_groups(training: DataFrame, validation: DataFrame, group: str) -> DataFrame:
    """Groups on both sides of a split."""
    return training.select(group).intersect(validation.select(group))
