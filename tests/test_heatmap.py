"""Heat-map targets against stamping every pixel, and that no pixel is shuffled."""

import math

from annograph.operators import augment as A

SCHEMA = "sample_id string, x double, y double, width int, height int"
POINTS = [
    ("a", 0.0, 0.0, 300, 200), ("a", 3.4, 2.0, 300, 200), ("a", 127.6, 126.2, 300, 200), ("a", 299.0, 199.0, 300, 200), ("a", 128.0, 126.0, 300, 200),
    ("b", -4.0, 10.0, 20, 30), ("b", -9.0, 10.0, 20, 30), ("b", 24.0, 35.0, 20, 30), ("c", 5.0, 5.0, None, 30), ("c", None, 5.0, 20, 30), (None, 5.0, 5.0, 9, 9), (None, 5.0, 7.0, 20, 9),
]


def stamped(sigma):
    half, span, out = int(6 * sigma + 1) // 2, int(6 * sigma + 1), {}
    for name, x, y, width, height in POINTS:
        if None in (x, y, width, height):
            continue
        for dx in range(-half, span - half):
            for dy in range(-half, span - half):
                at = (name, round(x) + dx, round(y) + dy)
                if 0 <= at[1] < width and 0 <= at[2] < height:
                    out[at] = max(out.get(at, 0.0), math.exp(-(dx * dx + dy * dy) / (2 * sigma * sigma)))
    return out


def test_targets(spark):
    for sigma in (2.0, 0.75):
        rows = A.heatmap_targets(spark.createDataFrame(POINTS, SCHEMA), sigma).collect()
        found = {(r.sample_id, r.x, r.y): r.v for r in rows}
        wanted = stamped(sigma)
        assert len(found) == len(rows) and found.keys() == wanted.keys()
        assert all(abs(found[k] - v) < 1e-12 for k, v in wanted.items())


def test_only_centres_are_shuffled(spark):
    plan = A.heatmap_targets(spark.createDataFrame(POINTS, SCHEMA))._jdf.queryExecution().optimizedPlan().toString()
    stamps = plan[: plan.index("MapInArrow")]
    assert "Aggregate" not in stamps and "Repartition" not in stamps
