"""References to records that do not exist.

A call names a route of the same project by method and path; it is an orphan
if no matching route existed when it was scanned. Neither a cross join nor one
task per project is needed: routes become equi-join keys by replacing their
placeholders, and the few hot keys are split off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourceloom.session import durable, under

#: A segment that is a placeholder as a whole: a colon and a name, or text in
#: {}, <>, [] or ${}.
PLACEHOLDER = r"^(?::[^\s:]+|\$?\{.*\}|<.*>|\[.*\])$"

#: Stands for a placeholder in keys; no segment can hold it, as it has a slash.
HOLE = "/"

#: A key is hot if it has more than one in so many of all references; there are
#: fewer than so many hot keys, which bounds what is broadcast.
HOT_ONE_IN = 2000

#: Distinct (project, length, mask) rows up to which they are broadcast; there
#: are a few per project, whatever the number of routes.
MASK_ROWS = 100_000

#: Rows of the hot side up to which it is broadcast; beyond, it is shuffled.
HOT_ROWS = 20_000


def path_segments(path: Column) -> Column:
    """The non-empty segments of a path without query and fragment, where each
    placeholder is the same mark."""
    bare = F.regexp_replace(path, r"(?s)[?#].*$", "")
    parts = F.filter(F.split(bare, "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.when(s.rlike(PLACEHOLDER), F.lit(HOLE)).otherwise(s))


def call_segments(path: Column) -> Column:
    """As path_segments, without a first segment of the whole path that is a
    placeholder, since that one names the server."""
    raw_first = F.element_at(F.split(F.regexp_replace(path, r"(?s)[?#].*$", ""), "/"), 1)
    segments = path_segments(path)
    drop = raw_first.rlike(PLACEHOLDER)
    return F.when(drop, F.slice(segments, 2, F.greatest(F.size(segments) - 1, F.lit(0)))).otherwise(segments)


def clean_method(method: Column) -> Column:
    """Trimmed and upper-cased; null is GET."""
    return F.coalesce(F.upper(F.trim(method)), F.lit("GET"))


def route_periods(routes: DataFrame) -> DataFrame:
    """Periods in which each (project, method, segments) exists, overlapping
    ones merged: one row per period. Rows without a start never exist."""
    keyed = routes.where(F.col("first_seen").isNotNull() & F.col("path").isNotNull() & F.col("project").isNotNull()).select(
        "project",
        F.upper(F.trim("method")).alias("method"),
        path_segments(F.col("path")).alias("segments"),
        F.col("first_seen").alias("since"),
        F.coalesce("removed_at", F.lit("9999-12-31").cast("timestamp_ntz").cast(routes.schema["first_seen"].dataType)).alias("until"),
    )
    keyed = keyed.where(F.col("until") > F.col("since")).distinct()
    key = Window.partitionBy("project", "method", "segments").orderBy("since", "until")
    before = key.rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.withColumn("new", (F.coalesce(F.max("until").over(before) < F.col("since"), F.lit(True))).cast("int"))
    runs = starts.withColumn("run", F.sum("new").over(key))
    return runs.groupBy("project", "method", "segments", "run").agg(F.min("since").alias("since"), F.max("until").alias("until")).drop("run")


def matching_periods(keys: DataFrame, periods: DataFrame) -> DataFrame:
    """For each distinct call key the periods of all routes that match it.

    A route's placeholders are positions, its mask; a call key is tried under
    each mask that routes of its project and length have, with these positions
    blanked, by equality. A call's own placeholder is the same mark and so
    equals only a placeholder."""
    mask = F.transform("segments", lambda s: s == HOLE)
    shaped = periods.withColumn("n", F.size("segments")).withColumn("mask", mask)
    masks = shaped.select("project", "n", "mask").distinct()
    masks = F.broadcast(masks) if under(masks, MASK_ROWS) else masks
    tried = (
        keys.withColumn("n", F.size("segments"))
        .join(masks, ["project", "n"])
        .withColumn("blanked", F.zip_with("segments", "mask", lambda s, m: F.when(m, F.lit(HOLE)).otherwise(s)))
    )
    routes = shaped.select("project", F.col("segments").alias("blanked"), "mask", F.col("method").alias("route_method"), "since", "until")
    hit = tried.join(routes, ["project", "blanked", "mask"]).where(
        (F.col("route_method") == "ALL") | (F.col("route_method") == F.col("method"))
    )
    return hit.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("since", "until"))).alias("periods"))


def orphan_references(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """The distinct rows of calls whose route did not exist at ``scanned_at``,
    with ``period`` (its month).

    References are first counted per key and month, repeats included; the keys
    alone meet the routes. Hot keys, each with more than one in HOT_ONE_IN of all references,
    are too few to be large and are broadcast, after a check of their number;
    the other keys are shuffled, and both kinds of orphans are united.

    Null paths and paths that begin with http:// or https:// in any letter case
    are no references. A null method is GET. A null project or scan time
    matches no route, so that the reference is an orphan (a null time has a
    null period). An empty path equals a route of no segments. Repeated rows
    count once; other columns pass through; empty tables give an empty result,
    or all references when there are no routes.
    """
    named = calls.where(F.col("path").isNotNull() & ~F.col("path").rlike(r"^(?i)https?://"))
    refs = named.withColumn("__method", clean_method(F.col("method"))).withColumn("__segments", call_segments(F.col("path")))
    refs = refs.withColumn("__key", F.unhex(F.md5(F.to_json(F.struct(F.col("project").alias("p"), F.col("__method").alias("m"), F.col("__segments").alias("s"))))))
    refs = refs.withColumn("period", F.date_trunc("month", F.col("scanned_at")))
    counted = refs.groupBy(F.col("__key").alias("key"), "period").agg(
        F.count(F.lit(1)).alias("refs"),
        F.first("project").alias("project"),
        F.first("__method").alias("method"),
        F.first("__segments").alias("segments"),
    )
    keys = durable(
        counted.groupBy("key").agg(
            F.sum("refs").alias("refs"), F.first("project").alias("project"), F.first("method").alias("method"), F.first("segments").alias("segments")
        )
    )
    total = keys.agg(F.coalesce(F.sum("refs"), F.lit(0))).first()[0]
    hot_from = max(total // HOT_ONE_IN, 1)
    matched = durable(keys.select("key", "refs").join(matching_periods(keys, route_periods(routes)), "key", "left"))
    hot = matched.where(F.col("refs") > hot_from).select(F.col("key").alias("__key"), "periods")
    rest = matched.where(F.col("refs") <= hot_from).select(F.col("key").alias("__key"), "periods")
    exists = F.exists(F.coalesce("periods", F.array()), lambda p: (p["since"] <= F.col("scanned_at")) & (p["until"] > F.col("scanned_at")))
    dead = ~F.coalesce(exists, F.lit(False))
    small = under(hot, HOT_ROWS)
    refs = refs.drop("__method", "__segments")
    hot_refs = refs.join(F.broadcast(hot) if small else hot, "__key").where(dead)
    rest_refs = refs.join(rest, "__key").where(dead)
    return hot_refs.unionByName(rest_refs).drop("__key", "periods").distinct()


def orphan_report(calls: DataFrame, routes: DataFrame, table: str = "api_calls") -> DataFrame:
    """Counts per referring table and month: ``referring_table``, ``period``,
    ``n_references``, ``n_orphans``, ``n_orphan_keys`` (distinct project,
    method and path as written)."""
    named = calls.distinct().where(F.col("path").isNotNull() & ~F.col("path").rlike(r"^(?i)https?://"))
    every = named.groupBy(F.date_trunc("month", "scanned_at").alias("period")).agg(F.count(F.lit(1)).alias("n_references"))
    found = orphan_references(calls, routes).groupBy("period").agg(
        F.count(F.lit(1)).alias("n_orphans"),
        F.count_distinct(F.struct("project", "method", "path")).alias("n_orphan_keys"),
    )
    return every.join(found.withColumnRenamed("period", "p"), F.col("period").eqNullSafe(F.col("p")), "left").select(
        F.lit(table).alias("referring_table"),
        "period",
        "n_references",
        F.coalesce("n_orphans", F.lit(0)).alias("n_orphans"),
        F.coalesce("n_orphan_keys", F.lit(0)).alias("n_orphan_keys"),
    )
