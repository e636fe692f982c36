"""Reproducible splits and folds from ranks in hash order.

A rank over a whole class would put that class into one task. Ranks are therefore built in
two levels: rows are counted per leading hash digits, the counts give each digit group its
starting rank, and rows are numbered only inside their group. Hashes are uniform, so the
groups are even whatever the keys look like.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buyerscope import schema as S
from buyerscope.functions.expressions import hash_text, quoted

# Leading hex digits: 16**3 groups per class. Raise it when a class has over ~10**10 rows.
HASH_DIGITS = 3


def rank_by_hash(
    df: DataFrame,
    key: str,
    seed: int,
    strata: Sequence[str] = (),
    out: str = "rn",
    size_out: str | None = None,
    digits: int = HASH_DIGITS,
) -> DataFrame:
    """Number rows 1..n per stratum in the order of md5(key-seed).

    ``size_out`` also adds the stratum's size.
    """
    ranked = _ranked(df, key, seed, strata, digits).withColumn(out, F.col("_rn"))
    if size_out:
        ranked = ranked.withColumn(size_out, F.col("_size"))
    return ranked.drop("_rn", "_size")


def _ranked(
    df: DataFrame,
    key: str,
    seed: int,
    strata: Sequence[str] = (),
    digits: int = HASH_DIGITS,
    classes: DataFrame | None = None,
) -> DataFrame:
    """The rows with their rank ``_rn``, the stratum's size ``_size`` and the columns of ``classes`` (one row per value ``_c`` of the only stratum).

    Whole rows are shuffled once: the table of groups holds all that is known of a class and meets them by the keys that the window
    has dealt them by. Neither key is ever null (a struct that holds a null is not), so plain equality does.
    """
    hashed = df.withColumns({"_hash": hash_text(key, F.lit(seed)), "_stratum": F.struct(*strata) if strata else F.lit(0)})
    hashed = hashed.withColumn("_group", F.substring("_hash", 1, digits))
    per_stratum = Window.partitionBy("_stratum")
    earlier = per_stratum.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = (
        hashed.groupBy("_stratum", "_group")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            "_stratum",
            "_group",
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"),
            F.sum("_n").over(per_stratum).alias("_size"),
        )
    )
    if classes is not None:
        groups = groups.join(classes, F.col(f"_stratum.{strata[0]}").eqNullSafe(F.col("_c"))).drop("_c")
    in_group = Window.partitionBy("_stratum", "_group").orderBy("_hash", key)
    numbered = hashed.withColumn("_local", F.row_number().over(in_group)).join(groups, ["_stratum", "_group"])
    kept = [c for c in numbered.columns if c not in ("_hash", "_stratum", "_group", "_local", "_start")]
    return numbered.select(*[F.col(quoted(c)) for c in kept], (F.col("_local") + F.col("_start")).alias("_rn"))


def _classes(df: DataFrame, label: str) -> DataFrame:
    """One row per class: ``_c``, its rows ``_n_c``, the rows of smaller classes ``_before`` and all rows ``_n``."""
    counted = df.groupBy(F.col(label).alias("_c")).agg(F.count(F.lit(1)).alias("_n_c"))
    # These windows order classes, not rows.
    ordered = Window.partitionBy(F.lit(0)).orderBy("_c")
    return counted.withColumns(
        {
            "_before": F.coalesce(F.sum("_n_c").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "_n": F.sum("_n_c").over(Window.partitionBy(F.lit(0))),
        }
    )


def held_out_quota(classes: DataFrame, test_size: float) -> DataFrame:
    """``_c, _quota``: the test rows of every class.

    All classes together give the share of all rows, rounded up; each class gives its proportional part rounded down, and the rows
    that are still missing come from the classes with the largest remainders (the smaller class first on ties).
    """
    every = Window.partitionBy(F.lit(0))
    parts = classes.withColumn("_test", F.ceil(F.lit(float(test_size)) * F.col("_n")).cast("decimal(19,0)")).select(
        "_c",
        "_test",
        F.expr("cast(_test * cast(_n_c as decimal(19,0)) div cast(_n as decimal(19,0)) as long)").alias("_whole"),
        F.expr("(_test * cast(_n_c as decimal(19,0))) % cast(_n as decimal(19,0))").alias("_rest"),
    )
    place = F.row_number().over(every.orderBy(F.desc("_rest"), "_c"))
    missing = F.col("_test") - F.sum("_whole").over(every)
    return parts.select("_c", (F.col("_whole") + (place <= missing).cast("long")).alias("_quota"))


def stratified_split(
    df: DataFrame,
    key: str = S.KEY,
    label: str | None = S.LABEL,
    test_size: float = 0.2,
    seed: int = 42,
    out: str = "split",
) -> DataFrame:
    """Mark each row 'train' or 'test'; ``held_out_quota`` says how many rows of each class are for testing.

    ``label=None`` splits without classes: the share of all rows, rounded up.
    """
    if label is None:
        ranked = _ranked(df, key, seed)
        quota = F.ceil(F.lit(float(test_size)) * F.col("_size"))
    else:
        ranked = _ranked(df, key, seed, [label], classes=held_out_quota(_classes(df, label), test_size))
        quota = F.col("_quota")
    return ranked.withColumn(out, _part(quota)).drop("_rn", "_size", "_quota")


def _part(quota: Column) -> Column:
    return F.when(F.col("_rn") <= quota, "test").otherwise("train")


def _fold(k: int) -> Column:
    return ((F.col("_before") + F.col("_rn") - 1) % k).cast("int")


def stratified_folds(
    df: DataFrame,
    key: str = S.KEY,
    label: str = S.LABEL,
    k: int = 5,
    seed: int = 42,
    out: str = "fold",
) -> DataFrame:
    """Assign folds 0..k-1 so that each class is spread evenly over them.

    The numbering goes on from class to class: fold sizes differ by one row at most, over each class and over all.
    """
    ranked = _ranked(df, key, seed, [label], classes=_classes(df, label).select("_c", "_before"))
    return ranked.withColumn(out, _fold(k)).drop("_rn", "_size", "_before")


def split_with_folds(
    df: DataFrame,
    key: str = S.KEY,
    label: str = S.LABEL,
    test_size: float = 0.2,
    k: int = 5,
    seed: int = 42,
) -> DataFrame:
    """``stratified_split`` and, over the rows of both parts, ``stratified_folds``: both are read off one ranking."""
    classes = _classes(df, label)
    known = classes.select("_c", "_before").join(held_out_quota(classes, test_size).withColumnRenamed("_c", "_c2"), F.col("_c").eqNullSafe(F.col("_c2")))
    ranked = _ranked(df, key, seed, [label], classes=known.drop("_c2"))
    return ranked.withColumns({"split": _part(F.col("_quota")), "fold": _fold(k)}).drop("_rn", "_size", "_before", "_quota")


def down_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """At most n rows, always the same ones for a seed."""
    return df.orderBy(hash_text(key, F.lit(seed)), key).limit(n)
