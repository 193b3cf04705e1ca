"""Normalisation of annotation graphs.

Two equal forms. The document form works on one row per sample with array columns: no shuffle, many rows at once.
The table form works on point and edge rows with joins and bucketed running totals; it takes the samples that are too
large for one row. `normalize_tables` routes by size and the union of both parts is the result.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from annograph.operators import graph_arrays
from annograph.plans.session import materialize
from annograph.plans.skew import RANGE_ROWS, rank_rows, running, split_hot, split_large
from annograph.functions.text import numbered
from annograph.schemas import EDGE, ISSUE, ISSUE_TEXT, POINT, RAW_EDGE, RAW_POINT, SCHEMA_VERSION

DOCUMENT_LIMIT = 4096  # elements of one sample that are gathered into a row


@dataclass
class Normalized:
    points: DataFrame
    edges: DataFrame
    issues: DataFrame
    link_order: DataFrame | None = None  # (sample_id, src, dst, number) of the table form


def issue(part: int, pos: Column, code: str, *args: Column, level: str = "error", told: bool = True) -> Column:
    """An issue struct; the message text is left out when nobody will read it."""
    text = ISSUE_TEXT[code]
    message = F.lit(None).cast("string") if not told else F.format_string(text, *args) if args else F.lit(text)
    return F.struct(
        F.lit(part).alias("part"), pos.cast("int").alias("pos"), F.lit(level).alias("level"),
        F.lit(code).alias("code"), message.alias("message"),
    )


def _empty(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


# ---------------------------------------------------------------- document form


def assigned_ids(ids: Column) -> Column:
    """Ids after resolving duplicates, in array order.

    A repeated id takes the next free number. That number is one above every id given so far (and at least 0), so no
    search is needed. Arrays without repeats pass through unchanged.
    """
    ids = F.transform(ids, lambda i: i.cast("bigint"))
    start = F.struct(F.expr("cast(array() as array<bigint>)").alias("given"), F.lit(0).cast("bigint").alias("next"))

    def step(state: Column, raw: Column) -> Column:
        chosen = F.when(F.array_contains(state["given"], raw), state["next"]).otherwise(raw)
        return F.struct(
            F.concat(state["given"], F.array(chosen)).alias("given"),
            F.greatest(state["next"], chosen + 1).alias("next"),
        )

    folded = F.aggregate(ids, start, step, lambda state: state["given"])
    return F.when(F.size(F.array_distinct(ids)) == F.size(ids), ids).otherwise(folded)


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once per row.

    A column that a lambda mentions would be put into the lambda by the optimizer and computed again per element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def _graph_rules(raw_points: Column, raw_edges: Column, detail: str) -> Column:
    """struct<points, edges, issues> of one sample."""

    def told(*args, **kwargs) -> Column:
        return issue(*args, told=detail == "messages", **kwargs)

    def readable(p: Column) -> Column:
        return p["id"].isNotNull() & p["x"].isNotNull() & p["y"].isNotNull()

    def picked(array: Column, keep, make) -> Column:
        return F.transform(F.filter(array, keep), make)

    def kept_points(valid: Column, given: Column) -> Column:
        return F.array_sort(
            F.zip_with(
                valid, given,
                lambda p, g: F.struct(
                    g.alias("given"), p["pos"].alias("pos"), p["id"].alias("raw_id"), p["x"].alias("x"),
                    p["y"].alias("y"), p["score"].alias("score"), p["source"].alias("source"),
                ),
            )
        )

    def marked_edges(ids: Column) -> Column:
        def mark(e: Column) -> Column:
            ends = F.struct(
                (F.array_position(ids, e["src"]).cast("int") - 1).alias("s"),
                (F.array_position(ids, e["dst"]).cast("int") - 1).alias("d"),
            )

            def classify(n: Column) -> Column:
                low, high = F.least(n["s"], n["d"]), F.greatest(n["s"], n["d"])
                code = (
                    F.when(~e["is_object"], "EDGE_NOT_OBJECT")
                    .when(e["src"].isNull() | e["dst"].isNull(), "EDGE_INVALID")
                    .when((n["s"] < 0) | (n["d"] < 0), "EDGE_DANGLING")
                    .when(n["s"] == n["d"], "EDGE_SELF_LOOP")
                )
                key = low.cast("long") * 4294967296 + high
                return F.struct(
                    e["pos"].alias("pos"), code.alias("code"), key.alias("key"), e["src"].alias("raw_src"),
                    e["dst"].alias("raw_dst"), e["edge_id"].alias("edge_id"), low.alias("src"), high.alias("dst"),
                    e["label"].alias("label"), e["source"].alias("source"),
                )

            return let(ends, classify)

        return F.transform(raw_edges, mark)

    def split_links(marked: Column) -> Column:
        """struct<links, repeats>: the first link of each pair of ends, and the later ones."""
        proper = F.filter(marked, lambda e: e["code"].isNull())

        def decide(links: Column) -> Column:
            def against(keys: Column) -> Column:
                first = lambda e, i: F.array_position(keys, e["key"]) == i.cast("long") + 1
                return F.struct(
                    F.filter(links, first).alias("links"),
                    F.filter(links, lambda e, i: ~first(e, i)).alias("repeats"),
                )

            return let(F.transform(links, lambda e: e["key"]), against)

        return let(proper, decide)

    def result(valid: Column, kept: Column, marked: Column, sides: Column) -> Column:
        points = F.transform(
            kept,
            lambda p, i: F.struct(
                i.cast("int").alias("id"), p["x"].alias("x"), p["y"].alias("y"),
                F.coalesce(p["score"], F.lit(1.0)).alias("score"), p["source"].alias("source"),
            ),
        )
        edges = F.transform(
            sides["links"],
            lambda e, i: F.struct(
                F.when(F.coalesce(e["edge_id"], F.lit("")) == "", numbered("edge_", i + 1)).otherwise(e["edge_id"]).alias("edge_id"),
                e["src"].alias("src"), e["dst"].alias("dst"), F.coalesce(e["label"], F.lit(1)).alias("label"),
                e["source"].alias("source"),
            ),
        )

        def rejected(code: str, *fields: str) -> Column:
            return picked(marked, lambda e: e["code"] == code, lambda e: told(2, e["pos"], code, *[e[f] for f in fields]))

        issues = F.array_sort(
            F.concat(
                picked(raw_points, lambda p: ~p["is_object"], lambda p: told(1, p["pos"], "POINT_NOT_OBJECT", p["pos"])),
                picked(raw_points, lambda p: p["is_object"] & ~readable(p), lambda p: told(1, p["pos"], "POINT_INVALID", p["pos"])),
                picked(valid, lambda p: p["score"].isNull(), lambda p: told(1, p["pos"], "VALUE_INVALID", p["pos"])),
                picked(kept, lambda p: p["given"] != p["raw_id"], lambda p: told(1, p["pos"], "POINT_ID_DUP", p["raw_id"])),
                rejected("EDGE_NOT_OBJECT", "pos"),
                rejected("EDGE_INVALID", "pos"),
                rejected("EDGE_DANGLING", "pos", "raw_src", "raw_dst"),
                rejected("EDGE_SELF_LOOP", "pos"),
                F.transform(sides["repeats"], lambda e: told(2, e["pos"], "EDGE_DUP", e["pos"])),
                picked(sides["links"], lambda e: e["label"].isNull(), lambda e: told(2, e["pos"], "VALUE_INVALID", e["pos"])),
            )
        )
        if detail == "none":
            issues = _empty(ISSUE)
        return F.struct(points.alias("points"), edges.alias("edges"), issues.alias("issues"))

    valid_points = F.filter(raw_points, lambda p: p["is_object"] & readable(p))
    return let(
        valid_points,
        lambda valid: let(
            let(F.transform(valid, lambda p: p["id"]), lambda ids: let(assigned_ids(ids), lambda given: kept_points(valid, given))),
            lambda kept: let(
                let(F.transform(kept, lambda p: p["given"]), marked_edges),
                lambda marked: let(split_links(marked), lambda sides: result(valid, kept, marked, sides)),
            ),
        ),
    )


def _array_graphs(raw_points: Column, raw_edges: Column, detail: str) -> Column:
    """`_graph_rules` of many documents at once and of any length, null where `raw_points` is null."""
    kind = f"struct<points:array<{POINT}>,edges:array<{EDGE}>,issues:array<{ISSUE}>>"

    def rules(points: pa.Array, edges: pa.Array) -> pa.Array:
        return graph_arrays.graphs(points, edges, detail)

    return F.arrow_udf(rules, kind)(raw_points, raw_edges)


def normalize_documents(docs: DataFrame, detail: str = "messages", long: int | None = None) -> DataFrame:
    """Add `points`, `edges` and `issues` to documents with `raw_points` and `raw_edges`.

    `detail` says how far issues are worked out: "messages", "codes" (no text, enough for counting) or "none" (empty).
    Batches of documents are worked out on arrays, which sort their elements. With `long`, only documents of more elements
    than that are; the others take the rules as column expressions, which compare each element with all others of its document.
    """
    if detail not in ("messages", "codes", "none"):
        raise ValueError(f"unknown detail: {detail}")
    if long is None:
        done = docs.withColumn("_graph", _array_graphs(F.col("raw_points"), F.col("raw_edges"), detail))
    else:
        is_long = F.greatest(F.size("raw_points"), F.size("raw_edges")) > long
        pick = lambda c: F.when(is_long, F.col(c))
        on_arrays = docs.withColumn("_long", _array_graphs(pick("raw_points"), pick("raw_edges"), detail))
        short = lambda c: F.when(~is_long, F.col(c))
        rules = F.when(~is_long, _graph_rules(short("raw_points"), short("raw_edges"), detail))
        done = on_arrays.withColumn("_graph", F.coalesce("_long", rules))
    return done.select(*docs.columns, "_graph.points", "_graph.edges", "_graph.issues")


def finish_documents(docs: DataFrame) -> DataFrame:
    """Whole-document rules after the graph: forced version, default size, image path back-fill."""
    missing = F.coalesce(F.col("image_path"), F.lit("")) == ""
    backfill = F.array(issue(3, F.lit(0), "IMAGE_PATH_BACKFILLED"))
    return (
        docs.withColumn("issues", F.when(missing, F.concat("issues", backfill)).otherwise(F.col("issues")))
        .withColumn("image_path", F.when(missing, F.concat("sample_id", F.lit(".png"))).otherwise(F.col("image_path")))
        .withColumn("schema_version", F.lit(SCHEMA_VERSION))
    )


# ---------------------------------------------------------------- table form


def group_documents(points: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per sample from element rows. Callers bound the group size with `split_hot`."""
    packed_points = points.groupBy("sample_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "is_object", "id", "x", "y", "score", "source"))).alias("raw_points")
    )
    packed_edges = edges.groupBy("sample_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "is_object", "edge_id", "src", "dst", "label", "source"))).alias("raw_edges")
    )
    return packed_points.join(packed_edges, "sample_id", "full").select(
        "sample_id",
        F.coalesce("raw_points", _empty(RAW_POINT)).alias("raw_points"),
        F.coalesce("raw_edges", _empty(RAW_EDGE)).alias("raw_edges"),
    )


def explode_documents(docs: DataFrame) -> Normalized:
    return Normalized(
        docs.select("sample_id", F.inline("points")),
        docs.select("sample_id", F.inline("edges")),
        docs.select("sample_id", F.inline("issues")),
    )


def assign_ids_by_scan(points: DataFrame, limit: int = RANGE_ROWS) -> DataFrame:
    """Duplicate-id rule on rows (sample_id, pos, id, ...) without gathering a sample; adds `given`.

    Let m be the largest id given so far. Every repeat gives m+1, and an id above m gives itself, so with the raise
    flags known m is a running count plus a running maximum. A first occurrence at or below m is a repeat exactly
    when an earlier repeat was given that number. The flags start from a guess and are corrected until none changes;
    each round fixes at least the first wrong row of every sample, so the end state is the sequential one.
    Samples of at most `limit` rows take windows, the others ranges and joins.
    """
    rows = points.select("sample_id", "pos", F.col("id").cast("bigint").alias("id"))
    (cold,), hot = split_large([rows], ["sample_id"], limit)
    given = _scan_windows(cold)
    return given if hot is None else given.unionByName(_scan_ranges(hot[0]))


def _scan_windows(rows: DataFrame) -> DataFrame:
    """The rounds as windows of one sample each. Rows are sent once a round, and settled samples leave after it."""
    upto = W.partitionBy("sample_id").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy("sample_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    # a null names nothing, so it is never a first occurrence
    first = F.col("sample_id").isNotNull() & F.col("id").isNotNull() & (F.rank().over(W.partitionBy("sample_id", "id").orderBy("pos")) == 1)
    state = rows.select("sample_id", "pos", "id", first.alias("is_first"))
    raises = ~F.col("is_first") | (F.col("id") > F.coalesce(F.max("id").over(before), F.lit(-1)))
    state = state.withColumn("raises", F.when(raises, 1).otherwise(0))
    done = None
    while True:
        counted = state.withColumn("raised", F.sum("raises").over(upto))
        lifted = F.when(F.col("raises") == 1, F.col("id") - F.col("raised"))
        counted = counted.withColumn("top", F.max(lifted).over(upto)).withColumn("top_before", F.max(lifted).over(before))
        level = F.col("raised") + F.greatest(F.col("top"), F.lit(-1))
        level_before = F.col("raised") - F.col("raises") + F.greatest(F.col("top_before"), F.lit(-1))
        scanned = counted.select("sample_id", "pos", "id", "is_first", "raises", level.alias("level"), level_before.alias("level_before"))
        repeat = ~F.col("is_first") | ((F.col("raises") == 1) & (F.col("id") <= F.col("level_before")))
        # each row asks for its own id; a repeat also tells the number it was given
        asks = lambda own, value: F.struct(F.lit(own).alias("own"), F.col(value).alias("value"))
        told = scanned.select("*", repeat.alias("repeat")).select(
            "*", F.inline(F.when(F.col("repeat"), F.array(asks(True, "id"), asks(False, "level"))).otherwise(F.array(asks(True, "id"))))
        )
        earlier = W.partitionBy("sample_id", "value").orderBy("pos").rangeBetween(W.unboundedPreceding, -1)
        taken = F.coalesce(F.max(~F.col("own")).over(earlier), F.lit(False))
        wanted = F.when(~F.col("is_first") | (F.col("id") > F.col("level_before")) | F.col("taken"), 1).otherwise(0)
        checked = told.withColumn("taken", taken).where("own").select(
            "sample_id", "pos", "id", "is_first", wanted.alias("raises"), (wanted != F.col("raises")).alias("changed"),
            F.when(F.col("repeat"), F.col("level")).otherwise(F.col("id")).alias("given"),
        )
        checked = materialize(checked.withColumn("open", F.max("changed").over(W.partitionBy("sample_id"))), "ids")
        settled = checked.where("not open").select("sample_id", "pos", "given")
        done = settled if done is None else done.unionByName(settled)
        state = checked.where("open").select("sample_id", "pos", "id", "is_first", "raises")
        if not state.limit(1).count():
            return done


def _scan_ranges(points: DataFrame) -> DataFrame:
    """The rounds as running totals over ranges and joins, for samples of any size."""
    sample = ["sample_id"]
    first = points.groupBy("sample_id", "id").agg(F.min("pos").alias("pos")).withColumn("is_first", F.lit(True))
    rows = points.join(first, ["sample_id", "id", "pos"], "left")
    rows = rows.withColumn("is_first", F.coalesce("is_first", F.lit(False)))
    rows = running(rows, sample, "pos", [("earlier", "max", F.col("id"), False)])
    state = materialize(
        rows.select(
            "sample_id", "pos", "id", "is_first",
            F.when(~F.col("is_first") | (F.col("id") > F.coalesce("earlier", F.lit(-1))), 1).otherwise(0).alias("raises"),
        ),
        "ids",
    )
    while True:
        counted = running(state, sample, "pos", [("raised", "sum", F.col("raises"), True)])
        lifted = F.when(F.col("raises") == 1, F.col("id") - F.col("raised"))
        scanned = running(counted, sample, "pos", [("top", "max", lifted, True), ("top_before", "max", lifted, False)])
        level = F.col("raised") + F.greatest(F.col("top"), F.lit(-1))
        level_before = F.col("raised") - F.col("raises") + F.greatest(F.col("top_before"), F.lit(-1))
        scanned = scanned.select(
            "sample_id", "pos", "id", "is_first", "raises",
            level.alias("level"), level_before.alias("level_before"),
        )
        repeat = ~F.col("is_first") | ((F.col("raises") == 1) & (F.col("id") <= F.col("level_before")))
        scanned = materialize(scanned.withColumn("given", F.when(repeat, F.col("level")).otherwise(F.col("id"))), "ids")
        taken = scanned.where(repeat).select("sample_id", F.col("level").alias("id"), F.col("pos").alias("taken_pos"))
        checked = scanned.where("is_first").join(taken, ["sample_id", "id"], "left")
        wanted = F.when((F.col("id") > F.col("level_before")) | (F.col("taken_pos") < F.col("pos")), 1).otherwise(0)
        checked = checked.select("sample_id", "pos", "id", "is_first", wanted.alias("raises"), F.col("raises").alias("was"))
        checked = materialize(checked, "ids")
        if not checked.where("raises <> was").limit(1).count():
            return scanned.select("sample_id", "pos", "given")
        repeats = scanned.where(~F.col("is_first")).select("sample_id", "pos", "id", "is_first", "raises")
        state = materialize(checked.drop("was").unionByName(repeats), "ids")


def _links_by_windows(ranked: DataFrame, edges: DataFrame) -> DataFrame:
    """Readable links with the ranks of their ends, whether they win and their number: points and links of a sample travel
    together, so a link's ends are the points before it in the order of ids, and rows are sent once."""
    spots = ranked.select("sample_id", F.lit(0).alias("kind"), F.col("given").alias("src"), F.col("given").alias("dst"), "new_id")
    links = edges.withColumns({"kind": F.lit(1), "src": F.col("src").cast("bigint"), "dst": F.col("dst").cast("bigint")})
    both = spots.unionByName(links, allowMissingColumns=True).repartition("sample_id")
    known = lambda side: F.max(F.when(F.col("sample_id").isNotNull(), F.col("new_id"))).over(
        W.partitionBy("sample_id", side).orderBy("kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    resolved = both.withColumn("new_src", known("src")).withColumn("new_dst", known("dst")).where("kind = 1").drop("kind", "new_id")
    u, v = F.least("new_src", "new_dst"), F.greatest("new_src", "new_dst")
    proper = F.col("new_src").isNotNull() & F.col("new_dst").isNotNull() & (F.col("new_src") != F.col("new_dst"))
    resolved = resolved.withColumns({"u": u, "v": v, "proper": proper})
    nth = F.rank().over(W.partitionBy("sample_id", "u", "v", "proper").orderBy("pos"))
    decided = resolved.withColumn("wins", F.when(F.col("proper") & (nth == 1), True))
    count = F.sum(F.when(F.col("wins"), 1)).over(W.partitionBy("sample_id").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow))
    return decided.drop("proper").withColumn("number", F.when(F.col("wins"), count))


def _links_by_joins(ranked: DataFrame, edges: DataFrame) -> DataFrame:
    """The same for samples of any size."""
    known = lambda side: ranked.select("sample_id", F.col("given").alias(side), F.col("new_id").alias(f"new_{side}"))
    resolved = edges.join(known("src"), ["sample_id", "src"], "left").join(known("dst"), ["sample_id", "dst"], "left")
    resolved = materialize(resolved.withColumn("u", F.least("new_src", "new_dst")).withColumn("v", F.greatest("new_src", "new_dst")), "links")
    proper = F.col("new_src").isNotNull() & F.col("new_dst").isNotNull() & (F.col("new_src") != F.col("new_dst"))
    winners = resolved.where(proper).groupBy("sample_id", "u", "v").agg(F.min("pos").alias("pos")).withColumn("wins", F.lit(True))
    decided = materialize(resolved.where(proper).join(winners, ["sample_id", "u", "v", "pos"], "left"), "links")
    links = running(decided.where("wins"), ["sample_id"], "pos", [("number", "sum", F.lit(1), True)])
    rest = decided.where("wins is null").unionByName(resolved.where(~F.coalesce(proper, F.lit(False))), allowMissingColumns=True)
    return links.unionByName(rest, allowMissingColumns=True)


def normalize_large(points: DataFrame, edges: DataFrame, limit: int = RANGE_ROWS) -> Normalized:
    """Table form of `normalize_documents` for samples of any size. Those of at most `limit` elements have their links resolved by
    windows."""
    valid = F.col("is_object") & F.col("id").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull()
    good = points.where(valid)
    given = assign_ids_by_scan(good, limit)
    ranked = running(given, ["sample_id"], "given", [("rank", "sum", F.lit(1), True)])
    ranked = materialize(ranked.select("sample_id", "pos", "given", (F.col("rank") - 1).cast("int").alias("new_id")), "ids")
    kept = good.join(ranked, ["sample_id", "pos"])

    readable = F.col("is_object") & F.col("src").isNotNull() & F.col("dst").isNotNull()
    cold, hot = split_large([ranked, edges.where(readable)], ["sample_id"], limit)
    decided = _links_by_windows(*cold)
    if hot is not None:
        decided = decided.unionByName(_links_by_joins(*hot))
    decided = materialize(decided, "links")
    links = decided.where("wins")
    dangling = F.col("new_src").isNull() | F.col("new_dst").isNull()
    loop = F.col("new_src") == F.col("new_dst")

    def found(rows: DataFrame, part: int, code: str, *args: str, pos: str = "pos") -> DataFrame:
        return rows.select("sample_id", F.inline(F.array(issue(part, F.col(pos), code, *[F.col(a) for a in args]))))

    issues = [
        found(points.where(~F.col("is_object")), 1, "POINT_NOT_OBJECT", "pos"),
        found(points.where(F.col("is_object") & ~valid), 1, "POINT_INVALID", "pos"),
        found(good.where(F.col("score").isNull()), 1, "VALUE_INVALID", "pos"),
        found(kept.where(F.col("given") != F.col("id")), 1, "POINT_ID_DUP", "id"),
        found(edges.where(~F.col("is_object")), 2, "EDGE_NOT_OBJECT", "pos"),
        found(edges.where(F.col("is_object") & ~readable), 2, "EDGE_INVALID", "pos"),
        found(decided.where(dangling), 2, "EDGE_DANGLING", "pos", "src", "dst"),
        found(decided.where(~dangling & loop), 2, "EDGE_SELF_LOOP", "pos"),
        found(decided.where(~dangling & ~loop & F.col("wins").isNull()), 2, "EDGE_DUP", "pos"),
        found(decided.where("wins and label is null"), 2, "VALUE_INVALID", "pos"),
    ]
    merged = issues[0]
    for part in issues[1:]:
        merged = merged.unionByName(part)
    return Normalized(
        kept.select("sample_id", F.col("new_id").alias("id"), "x", "y", F.coalesce("score", F.lit(1.0)).alias("score"), "source"),
        links.select(
            "sample_id",
            F.when(F.coalesce("edge_id", F.lit("")) == "", numbered("edge_", F.col("number"))).otherwise(F.col("edge_id")).alias("edge_id"),
            F.col("u").alias("src"), F.col("v").alias("dst"), F.coalesce("label", F.lit(1)).alias("label"), "source",
        ),
        merged,
        links.select("sample_id", F.col("u").alias("src"), F.col("v").alias("dst"), "number"),
    )


def regroup_documents(norm: Normalized, heads: DataFrame) -> DataFrame:
    """Document rows again from the table form, for samples that came in as one document each."""
    points = norm.points.groupBy("sample_id").agg(
        F.array_sort(F.collect_list(F.struct("id", "x", "y", "score", "source"))).alias("points")
    )
    ordered = norm.edges.join(norm.link_order, ["sample_id", "src", "dst"])
    edges = ordered.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("number", "edge_id", "src", "dst", "label", "source"))).alias("e"))
    edges = edges.select("sample_id", F.transform("e", lambda e: e.dropFields("number")).alias("edges"))
    return heads.join(points, "sample_id", "left").join(edges, "sample_id", "left").select(
        *heads.columns, F.coalesce("points", _empty(POINT)).alias("points"), F.coalesce("edges", _empty(EDGE)).alias("edges")
    )


def split_by_size(points: DataFrame, edges: DataFrame, limit: int = DOCUMENT_LIMIT):
    """(documents of ordinary samples, (points, edges) of large samples or None)."""
    sizes = points.select("sample_id").unionByName(edges.select("sample_id"))
    _, heavy = split_hot(sizes, ["sample_id"], limit)
    if heavy is None:
        return group_documents(points, edges), None
    heavy = materialize(heavy.distinct(), "large")
    part = lambda how: [t.join(heavy, "sample_id", how) for t in (points, edges)]
    return group_documents(*part("left_anti")), tuple(materialize(t, "large") for t in part("left_semi"))


def normalize_tables(points: DataFrame, edges: DataFrame, limit: int = DOCUMENT_LIMIT) -> Normalized:
    """Normalised points, edges and issues of element tables (see RAW_POINT and RAW_EDGE for the columns)."""
    docs, large = split_by_size(points, edges, limit)
    ordinary = explode_documents(normalize_documents(docs))
    if large is None:
        return ordinary
    rest = normalize_large(*large)
    return Normalized(
        ordinary.points.unionByName(rest.points),
        ordinary.edges.unionByName(rest.edges),
        ordinary.issues.unionByName(rest.issues),
    )


def document_rows(points: DataFrame, edges: DataFrame, limit: int = DOCUMENT_LIMIT) -> DataFrame:
    """One row (sample_id, points, edges) of every sample of element tables, normalised, whatever its size.

    For callers that need documents as such. Large samples are worked out as tables and gathered when done.
    """
    docs, large = split_by_size(points, edges, limit)
    ordinary = normalize_documents(docs, "none").select("sample_id", "points", "edges")
    if large is None:
        return ordinary
    heads = large[0].select("sample_id").unionByName(large[1].select("sample_id")).distinct()
    return ordinary.unionByName(regroup_documents(normalize_large(*large), heads))


# ---------------------------------------------------------------- review clean-up


def clean_points(points: DataFrame) -> DataFrame:
    """Point defaults of the review step: id = position, score 1.0, source manual. No validation."""
    return points.select(
        "sample_id", "pos", F.coalesce("id", "pos").alias("id"), "x", "y",
        F.coalesce("score", F.lit(1.0)).alias("score"), F.coalesce("source", F.lit("manual")).alias("source"),
    )


def clean_edges(edges: DataFrame) -> DataFrame:
    """Review clean-up of links: negative ends, self-loops and repeats dropped; ends are not looked up."""
    src, dst = F.coalesce("src", F.lit(-1)), F.coalesce("dst", F.lit(-1))
    proper = (
        edges.withColumn("u", F.least(src, dst)).withColumn("v", F.greatest(src, dst))
        .where((F.col("u") >= 0) & (F.col("u") != F.col("v")))
    )
    first = proper.groupBy("sample_id", "u", "v").agg(
        F.min_by(F.struct("pos", "edge_id", "label", "source"), "pos").alias("e")
    ).select("sample_id", "u", "v", "e.*")
    return rank_rows(first, ["sample_id"], ["pos"], "number", check=edges.select("sample_id")).select(
        "sample_id",
        F.when(F.coalesce("edge_id", F.lit("")) == "", numbered("edge_", F.col("number"))).otherwise(F.col("edge_id")).alias("edge_id"),
        F.col("u").alias("src"), F.col("v").alias("dst"), F.coalesce("label", F.lit(1)).alias("label"),
        F.coalesce("source", F.lit("manual")).alias("source"),
    )


def proper_links(edges: DataFrame) -> DataFrame:
    """Undirected links (sample_id, u, v); unreadable ones and self-loops skipped."""
    return (
        edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
        .select("sample_id", F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"))
    )


def edge_set(edges: DataFrame) -> DataFrame:
    """`proper_links`, each once."""
    return proper_links(edges).distinct()


def rounded_points(points: DataFrame) -> DataFrame:
    """Integer coordinates (halves to even); of equal ids the last position wins."""
    return (
        points.groupBy("sample_id", "id").agg(F.max_by(F.struct("x", "y"), "pos").alias("p"))
        .select("sample_id", "id", F.rint("p.x").cast("int").alias("x"), F.rint("p.y").cast("int").alias("y"))
    )


def normalize_rows(docs: DataFrame, detail: str = "messages", long: int | None = None) -> DataFrame:
    """Document rows of any length in, finished documents out (graph rules, then whole-document rules)."""
    return finish_documents(normalize_documents(docs, detail, long))

