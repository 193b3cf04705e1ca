"""Rectangles in nested configuration documents, as a Python table function."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.functions import udtf

KEYS = ("roi", "rois")


def _numbers(value) -> bool:
    return isinstance(value, list) and len(value) == 4 and all(isinstance(v, (int, float)) for v in value)


RECTANGLE = T.StructType(
    [T.StructField("path", T.StringType()), T.StructField("side", T.StringType()), T.StructField("multi", T.BooleanType())]
    + [T.StructField(n, T.IntegerType()) for n in ("roi_no", "x1", "y1", "x2", "y2")]
)


@udtf(returnType=RECTANGLE)
class roi_fields:
    """One row per rectangle under a key `roi` / `rois` (any case)."""

    def eval(self, text: str):
        try:
            stack = [((), json.loads(text))]
        except (TypeError, ValueError):
            return
        while stack:
            path, node = stack.pop()
            items = node.items() if isinstance(node, dict) else enumerate(node) if isinstance(node, list) else ()
            children = [((*path, key), value) for key, value in items]
            if isinstance(node, dict):
                for where, value in children:
                    if str(where[-1]).lower() not in KEYS:
                        continue
                    multi = not _numbers(value)
                    rects = value if multi else [value]
                    if isinstance(rects, list) and rects and all(_numbers(r) for r in rects):
                        side = "top" if "top" in where else "bottom" if "bottom" in where else "unknown"
                        for n, r in enumerate(rects, 1):
                            yield (".".join(map(str, where)), side, multi, n, *(int(v) for v in r))
            stack.extend(reversed(children))


def collect_rois(configs: DataFrame, text: str = "raw") -> DataFrame:
    """Lateral join of a config table with its rectangles."""
    others = [c for c in configs.columns if c != text]
    return configs.lateralJoin(roi_fields(F.col(text).outer())).select(*others, "path", "side", "multi", "roi_no", "x1", "y1", "x2", "y2")
