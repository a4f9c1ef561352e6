"""Upserts as set operations: merge_into(target, source, keys, policy) returns the new table.

Within a batch the last row of a key by seq wins, as if rows came one by one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.timeseries import latest_n


def last_in_batch(source: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The last row of each key by seq; of rows with one seq, the largest by all columns."""
    return latest_n(source, keys, [F.desc(seq), *[F.desc(c) for c in source.columns if c not in keys and c != seq]])


def merge_into(target: DataFrame, source: DataFrame, keys: list[str], policy: str, columns: list[str] | None = None, seq: str | None = None) -> DataFrame:
    """policy: replace (all columns), coalesce (keep old where new is null), insert (absent keys only), fill (only where old
    is null or 'None'), columns (only the listed ones). A key comes out once: of the rows of a batch with one key the last by
    seq counts (the largest without seq; for coalesce the last value that is not null), for insert the first. A null is a
    key like any other."""
    names = target.columns
    rows = source if seq else source.withColumn("_seq", F.lit(0))
    order = seq or "_seq"
    if policy == "insert":
        others = [F.asc(c) for c in names if c not in keys]
        rows = latest_n(rows, keys, [F.asc(order), *others])
    elif policy == "coalesce":
        newest = Window.partitionBy(*keys).orderBy(order, *[c for c in names if c not in keys]).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        kept = rows.select(*keys, *[F.last(c, ignorenulls=True).over(newest).alias(c) for c in names if c not in keys], F.lit(0).alias("_seq"))
        rows = kept.dropDuplicates(keys)
    else:
        rows = last_in_batch(rows, keys, order)
    t = target.withColumn("_t", F.lit(True)).alias("t")
    s = rows.select(*names).withColumn("_s", F.lit(True)).alias("s")
    cond = reduce(lambda a, b: a & b, [F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys])
    old, new = (lambda c: F.col(f"t.{c}")), (lambda c: F.col(f"s.{c}"))
    if policy == "insert":
        return target.unionByName(s.join(t, cond, "left_anti").select(*[new(c).alias(c) for c in names]))
    j = t.join(s, cond, "full_outer")
    is_old, is_new = F.col("t._t").isNotNull(), F.col("s._s").isNotNull()

    def pick(c: str) -> Column:
        if c in keys:
            return F.when(is_new, new(c)).otherwise(old(c))
        if policy == "replace":
            return F.when(is_new, new(c)).otherwise(old(c))
        if policy == "coalesce":
            return F.coalesce(new(c), old(c))
        if policy == "fill":
            empty = old(c).isNull() | (old(c).cast("string") == "None")
            return F.when(~is_old | (is_new & empty), new(c)).otherwise(old(c))
        if policy == "columns":
            return F.when(~is_old | (is_new & F.lit(c in (columns or []))), new(c)).otherwise(old(c))
        raise ValueError(policy)

    return j.select(*[pick(c).alias(c) for c in names])


def fill_key(target: DataFrame, source: DataFrame, match: str, column: str, unique: list[str]) -> DataFrame:
    """target with column set from source (match, column) where it is null or 'None', unless another row has the key (unique)
    that the row would get. Of several values for one row the least counts, of rows that would get one key the first."""
    new = source.groupBy(match).agg(F.min(column).alias("_new"))
    empty = F.col(column).isNull() | (F.col(column).cast("string") == "None")
    j = target.join(new, match, "left").withColumn("_to", F.when(empty, F.col("_new")))
    rest = [c for c in unique if c != column]
    taken = target.where(~empty).select(*[F.col(c).alias(f"_{c}_") for c in unique]).distinct()
    free = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}_")) for c in rest] + [F.col("_to") == F.col(f"_{column}_")])
    j = j.join(taken.withColumn("_taken", F.lit(True)), free, "left")
    first = F.row_number().over(Window.partitionBy(*rest, "_to").orderBy(match)) == 1
    j = j.withColumn("_ok", F.col("_to").isNotNull() & F.col("_taken").isNull() & first)
    return j.select(*[F.when(F.col("_ok"), F.col("_to")).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in target.columns])


def append_valid(target: DataFrame, source: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(target with the rows that meet all rules, the others with the reasons)."""
    ok, rejects = split_valid(source, rules)
    return target.unionByName(ok, allowMissingColumns=True), rejects


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that meet all rules, rows that don't with their reasons)."""
    v = validate(df, rules)
    return v.where(F.size("reasons") == 0).drop("reasons"), v.where(F.size("reasons") > 0)


def with_key_date(df: DataFrame, column: str) -> DataFrame:
    """Rows whose key date could be read."""
    return df.where(F.col(column).isNotNull())


def evolve(target: DataFrame, source: DataFrame) -> DataFrame:
    """All rows of both, with the columns of both; what a side lacks is null."""
    return target.unionByName(source, allowMissingColumns=True)


def prefer_live(live: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Live rows, and stored ones of other keys."""
    return live.unionByName(stored.join(live.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def validate(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds reasons: the names of the rules that a row breaks (a null outcome breaks a rule)."""
    return df.withColumn("reasons", F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()])))


def apply_metric_filters(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Keeps rows that meet conditions such as {'margin': '>10'}."""
    import operator
    import re

    ops = {">": operator.gt, "<": operator.lt, ">=": operator.ge, "<=": operator.le, "=": operator.eq, "==": operator.eq}
    for name, text in wanted.items():
        m = re.fullmatch(r"\s*(>=|<=|==|=|>|<)\s*(-?\d+(?:\.\d+)?)\s*", text)
        if not m:
            raise ValueError(f"{name}: {text}")
        df = df.where(ops[m[1]](F.col(name), float(m[2])))
    return df
