"""Splitting hot groups and running totals that never place a whole group in one task.

Rows are range-sorted by group and key, and rows equal in both by a number of their own, so a range holds about as many
rows as any other, whatever the keys: one key may hold all rows, and one value may lie far from the rest.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from annograph.plans.session import materialize

HOT_ROWS = 100_000
RANGE_ROWS = 250_000  # rows of one range, give or take the sampling of its bounds


def hot_groups(df: DataFrame, keys: Sequence[str], limit: int = HOT_ROWS) -> DataFrame | None:
    """Keys of the groups with more than `limit` rows, or None when there are none.

    One aggregation over the key columns only; just the largest count reaches the driver.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    largest = counts.agg(F.max("__rows")).first()[0]
    if largest is None or largest <= limit:
        return None
    return materialize(counts.where(F.col("__rows") > limit).select(*keys), "hot")


def split_hot(df: DataFrame, keys: Sequence[str], limit: int = HOT_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary groups, rows of hot groups or None). The two parts together are the whole input."""
    heavy = hot_groups(df, keys, limit)
    if heavy is None:
        return df, None
    return df.join(heavy, list(keys), "left_anti"), df.join(heavy, list(keys), "left_semi")


def split_large(tables: Sequence[DataFrame], group: Sequence[str], limit: int) -> tuple[list[DataFrame], list[DataFrame] | None]:
    """The tables' rows of groups of at most `limit` rows in all of them, and the rest or None. Null is a group of its own."""
    keys = reduce(DataFrame.unionByName, [t.select(*group) for t in tables])
    heavy = hot_groups(keys, group, limit)
    if heavy is None:
        return list(tables), None
    named = heavy.select(*[F.col(g).alias(f"__h{i}") for i, g in enumerate(group)])
    same = lambda t: reduce(lambda x, y: x & y, [t[g].eqNullSafe(named[f"__h{i}"]) for i, g in enumerate(group)])
    return [t.join(named, same(t), "left_anti") for t in tables], [t.join(named, same(t), "left_semi") for t in tables]


def running(
    df: DataFrame,
    group: Sequence[str],
    key: str,
    specs: Sequence[tuple[str, str, Column, bool]],
    extra: Sequence[str] = (),
) -> DataFrame:
    """Exact running aggregates of each group in `key`, then `extra` order. Keys are of any type that sorts.

    `specs` holds (name, "sum" | "max", expression, inclusive). Groups that a range could hold take one window, which sends each
    row once. For larger ones, the window of a range is combined with the totals of the group's earlier ranges. An exclusive max
    without earlier rows is null, an exclusive sum is 0.
    """
    if not group:
        return _running_ranges(df, group, key, specs, extra)
    (cold,), hot = split_large([df], group, RANGE_ROWS)
    out = _running_window(cold, group, key, specs, extra)
    return out if hot is None else out.unionByName(_running_ranges(hot[0], group, key, specs, extra))


def _running_window(df: DataFrame, group, key, specs, extra) -> DataFrame:
    aggregate = {"sum": F.sum, "max": F.max}
    whole = W.partitionBy(*group).orderBy(key, *extra)
    frames = [whole.rowsBetween(W.unboundedPreceding, 0 if inclusive else -1) for *_, inclusive in specs]
    windowed = [aggregate[kind](expr).over(frame) for (_, kind, expr, _), frame in zip(specs, frames)]
    return df.select("*", *[(F.coalesce(w, F.lit(0)) if s[1] == "sum" else w).alias(s[0]) for w, s in zip(windowed, specs)])


def _running_ranges(df: DataFrame, group, key, specs, extra) -> DataFrame:
    """`running` for groups of any size. The ranges are a written table, since a range partitioning that is worked out again
    may cut elsewhere."""
    aggregate = {"sum": F.sum, "max": F.max}
    order = [key, *extra, "__no"]
    rows = materialize(df.withColumn("__no", F.monotonically_increasing_id()), "rows")
    count = rows.count()  # from the table's footers
    if count <= RANGE_ROWS:  # then one range holds any group
        return _running_window(rows, group, key, specs, [*extra, "__no"]).drop("__no")
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count // RANGE_ROWS))
    ranges = materialize(rows.repartitionByRange(parts, *group, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    cell = ["__range", *group]
    ordered = W.partitionBy(*cell).orderBy(*order)
    local = ranges.select(
        "*",
        *[
            aggregate[kind](expr).over(ordered.rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)).alias(f"__l_{name}")
            for name, kind, expr, inclusive in specs
        ],
    )
    totals = ranges.groupBy(*cell).agg(*[aggregate[kind](expr).alias(f"__t_{name}") for name, kind, expr, _ in specs])
    before = W.partitionBy(*group).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(c).alias(f"__c{i}") for i, c in enumerate(cell)],
        *[aggregate[kind](f"__t_{name}").over(before).alias(f"__o_{name}") for name, kind, _, _ in specs],
    )
    joined = local.join(offsets, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__c{i}")) for i, c in enumerate(cell)]))
    merged = []
    for name, kind, _, _ in specs:
        inner, outer = F.col(f"__l_{name}"), F.col(f"__o_{name}")
        if kind == "sum":
            merged.append((F.coalesce(inner, F.lit(0)) + F.coalesce(outer, F.lit(0))).alias(name))
        else:
            merged.append(F.greatest(inner, outer).alias(name))
    return joined.select(*df.columns, *merged)


def rank_rows(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    name: str,
    limit: int = HOT_ROWS,
    check: DataFrame | None = None,
) -> DataFrame:
    """1-based row number of each group as `name`.

    Ordinary groups use one window. Groups with more than `limit` rows go through `running`. `check` may name a narrower
    table for counting.
    """
    heavy = hot_groups(check if check is not None else df, group, limit)
    window = W.partitionBy(*group).orderBy(*order)
    number = F.row_number().over(window).cast("int").alias(name)
    if heavy is None:
        return df.select("*", number)
    cold = df.join(heavy, list(group), "left_anti").select("*", number)
    hot = running(
        df.join(heavy, list(group), "left_semi"), group, order[0], [(name, "sum", F.lit(1), True)], order[1:]
    ).withColumn(name, F.col(name).cast("int"))
    return cold.unionByName(hot)
