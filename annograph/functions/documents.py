"""Column functions over annotation documents (VARIANT in, structs and JSON text out)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from annograph.functions.text import base_name, stripped
from annograph.schemas import (
    DEFAULT_SIDE, METADATA_DETECTIONS, METADATA_LEGACY, POINT_LABELS, SCHEMA_VERSION, STRICT_POINT_LABEL,
)


def field(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def has_key(v: Column, name: str) -> Column:
    """True when the key is there, also with a JSON null."""
    return field(v, f"$.{name}", "variant").isNotNull()


def is_object(v: Column) -> Column:
    return F.coalesce(field(v, "$", "map<string,variant>").isNotNull(), F.lit(False))


def array_at(v: Column, path: str) -> Column:
    """The array at `path`, null for anything else."""
    return field(v, path, "array<variant>")


def no_variants() -> Column:
    return F.expr("cast(array() as array<variant>)")


def is_legacy(v: Column) -> Column:
    """Legacy dialect: an object with a list under `shapes`."""
    return array_at(v, "$.shapes").isNotNull()


def positive_int(v: Column, path: str) -> Column:
    """int(value or 0) or the default side."""
    number = F.coalesce(field(v, path, "int"), F.lit(0))
    return F.when(number == 0, DEFAULT_SIDE).otherwise(number)


def raw_points(v: Column, items: Column | None = None) -> Column:
    """Elements of `points`, or `items`, with position, readable values and the defaults for absent keys."""

    def element(p: Column, i: Column) -> Column:
        pos = i.cast("int")
        return F.struct(
            pos.alias("pos"), p.isNotNull().alias("is_object"),
            _given(p["id"], "bigint", pos.cast("bigint")).alias("id"), p["x"].alias("x"), p["y"].alias("y"),
            _given(p["score"], "double", F.lit(1.0)).alias("score"), _given(p["source"], "string", F.lit("manual")).alias("source"),
        )

    return F.transform(_objects(v, "points", items, "struct<id:variant,x:double,y:double,score:variant,source:variant>"), element)


def raw_edges(v: Column, items: Column | None = None) -> Column:
    def element(e: Column, i: Column) -> Column:
        return F.struct(
            i.cast("int").alias("pos"), e.isNotNull().alias("is_object"), e["edge_id"].alias("edge_id"),
            e["src"].alias("src"), e["dst"].alias("dst"),
            _given(e["label"], "int", F.lit(1)).alias("label"), _given(e["source"], "string", F.lit("manual")).alias("source"),
        )

    return F.transform(_objects(v, "edges", items, "struct<edge_id:string,src:bigint,dst:bigint,label:variant,source:variant>"), element)


def _given(value: Column, kind: str, default: Column) -> Column:
    """A VARIANT member as `kind`, the default where the member is absent; a JSON null is not absent."""
    return F.when(value.isNotNull(), field(value, "$", kind)).otherwise(default)


def _objects(v: Column, name: str, items: Column | None, kind: str) -> Column:
    """The array under `name` with its objects read as `kind` in one go, null for elements of other kinds."""
    given = () if items is None else (F.transform(items, lambda item: field(item, "$", kind)),)
    return F.coalesce(*given, field(v, f"$.{name}", f"array<{kind}>"), F.expr(f"cast(array() as array<{kind}>)"))


def _elements(v: Column, name: str, items: Column | None) -> Column:
    """The array under `name`; `items` of a document in parts come first."""
    given = () if items is None else (items,)
    return F.coalesce(*given, array_at(v, f"$.{name}"), no_variants())


def _point_shapes(v: Column, accepts, items: Column | None) -> Column:
    """Shapes that are objects of type point, carry an accepted label and a first coordinate pair."""
    label = lambda s: stripped(F.coalesce(field(s, "$.label", "string"), F.lit("")))
    return F.filter(
        _elements(v, "shapes", items),
        lambda s: is_object(s)
        & F.coalesce(field(s, "$.shape_type", "string") == "point", F.lit(False))
        & accepts(label(s))
        & F.coalesce(F.size(array_at(s, "$.points[0]")) >= 2, F.lit(False)),
    )


def _shape_points(shapes: Column, score) -> Column:
    return F.transform(
        shapes,
        lambda s, i: F.struct(
            i.cast("int").alias("id"),
            field(s, "$.points[0][0]", "double").alias("x"), field(s, "$.points[0][1]", "double").alias("y"),
            score(field(s, "$.score", "double")).alias("score"), F.lit("labelme_point").alias("source"),
        ),
    )


def legacy_points(v: Column, items: Column | None = None) -> Column:
    """Shared reading: labels compared trimmed and lower-cased; a missing, null or zero score becomes 1.0."""
    shapes = _point_shapes(v, lambda label: F.lower(label).isin(*POINT_LABELS), items)
    return _shape_points(shapes, lambda s: F.when(F.coalesce(s, F.lit(0.0)) == 0, 1.0).otherwise(s))


def legacy_points_strict(v: Column, items: Column | None = None) -> Column:
    """Prediction reading: one exact label; only a missing or null score becomes 1.0."""
    shapes = _point_shapes(v, lambda label: label == STRICT_POINT_LABEL, items)
    return _shape_points(shapes, lambda s: F.coalesce(s, F.lit(1.0)))


def as_raw_points(points: Column) -> Column:
    return F.transform(
        points,
        lambda p: F.struct(
            p["id"].alias("pos"), F.lit(True).alias("is_object"), p["id"].alias("id"), p["x"].alias("x"),
            p["y"].alias("y"), p["score"].alias("score"), p["source"].alias("source"),
        ),
    )


def _empty_json_array() -> Column:
    return F.expr("cast(array() as array<string>)")


def master_json(
    sample_id: Column, image_path: Column, width: Column, height: Column, points: Column | None = None,
    edges: Column | None = None, metadata: Column | None = None,
) -> Column:
    """A current-dialect document as JSON text; without points and edges it is the empty document."""
    options = {"ignoreNullFields": "false"}
    return F.to_json(
        F.struct(
            F.lit(SCHEMA_VERSION).alias("schema_version"), sample_id.alias("sample_id"), image_path.alias("image_path"),
            F.struct(width.cast("int").alias("width"), height.cast("int").alias("height")).alias("image_size"),
            F.lit(None).cast("string").alias("roi"), F.lit(None).cast("double").alias("spacing_hint"),
            (points if points is not None else _empty_json_array()).alias("points"),
            (edges if edges is not None else _empty_json_array()).alias("edges"),
            _empty_json_array().alias("segments"),
            (metadata if metadata is not None else F.expr("cast(map() as map<string,string>)")).alias("metadata"),
        ),
        options,
    )


def legacy_metadata() -> Column:
    return F.struct(*[F.lit(text).alias(name) for name, text in METADATA_LEGACY.items()])


def detection_metadata(points: Column, **extra: Column) -> Column:
    """Stamp of the detection step; values given by the caller replace the stamp's own."""
    values = {"source": F.lit(METADATA_DETECTIONS), "point_count": F.size(points)}
    values.update(extra)
    return F.struct(*[c.alias(name) for name, c in values.items()])


def _no_entries() -> Column:
    return F.expr("cast(map() as map<string,string>)")


def legacy_json(image_path: Column, width: Column, height: Column, points: Column) -> Column:
    """Current document to the legacy dialect."""
    shapes = F.transform(
        points,
        lambda p: F.struct(
            F.lit(STRICT_POINT_LABEL).alias("label"), F.array(F.array(p["x"], p["y"])).alias("points"),
            F.lit(None).cast("string").alias("group_id"), F.lit("").alias("description"), F.lit("point").alias("shape_type"),
            _no_entries().alias("flags"), F.coalesce(p["score"], F.lit(1.0)).alias("score"),
        ),
    )
    return _legacy_frame("5.0.1", shapes, image_path, width, height)


def detection_legacy_json(
    image_path: Column, width: Column, height: Column, points: Column, label: str = STRICT_POINT_LABEL
) -> Column:
    """Detected points (x, y, score) in the extended legacy dialect."""
    shapes = F.transform(
        points,
        lambda p: F.struct(
            F.lit(label).alias("label"), p["score"].alias("score"), F.array(F.array(p["x"], p["y"])).alias("points"),
            F.lit(None).cast("string").alias("group_id"), F.lit("").alias("description"), F.lit(False).alias("difficult"),
            F.lit("point").alias("shape_type"), _no_entries().alias("flags"), _no_entries().alias("attributes"),
            _empty_json_array().alias("kie_linking"),
        ),
    )
    return _legacy_frame("3.3.9", shapes, image_path, width, height)


def _legacy_frame(version: str, shapes: Column, image_path: Column, width: Column, height: Column) -> Column:
    return F.to_json(
        F.struct(
            F.lit(version).alias("version"), _no_entries().alias("flags"), shapes.alias("shapes"),
            base_name(image_path).alias("imagePath"), F.lit(None).cast("string").alias("imageData"),
            height.cast("int").alias("imageHeight"), width.cast("int").alias("imageWidth"),
        ),
        {"ignoreNullFields": "false"},
    )


def detection_master_json(
    image_path: Column, width: Column, height: Column, points: Column, sample_id: Column, **metadata: Column
) -> Column:
    """Detected points as a current document: ids by position, source model, stamped metadata."""
    items = F.transform(
        points,
        lambda p, i: F.struct(
            i.cast("int").alias("id"), p["x"].alias("x"), p["y"].alias("y"), p["score"].alias("score"), F.lit("model").alias("source")
        ),
    )
    return master_json(sample_id, base_name(image_path), width, height, items, metadata=detection_metadata(points, **metadata))
