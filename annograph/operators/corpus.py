"""Image-corpus planning: keyword split, tiles, regions, windows, sizes, duplicates and destination names."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from annograph.functions.text import half_even, stem_of, suffix_of
from annograph.plans.session import materialize
from annograph.plans.skew import rank_rows, running, split_hot
from annograph.schemas import IMAGE_SUFFIXES

UNSORTED = "_unsorted"


def image_files(files: DataFrame, suffixes: Sequence[str] = IMAGE_SUFFIXES) -> DataFrame:
    """Files whose lower-cased suffix is an image suffix, with stem and suffix."""
    tail = suffix_of(F.col("path"))
    return files.where(F.lower(tail).isin(*suffixes)).withColumn("stem", stem_of(F.col("path"))).withColumn("suffix", tail)


# ---------------------------------------------------------------- keywords


def keyword_of(stem: Column, keywords: Sequence[str]) -> Column:
    """First keyword of the list found in the lower-cased stem, else `_unsorted`."""
    lowered = F.lower(stem)
    label = F.lit(UNSORTED)
    for word in reversed(keywords):
        label = F.when(F.contains(lowered, F.lit(word.lower())), F.lit(word)).otherwise(label)
    return label


def keyword_split(images: DataFrame, keywords: Sequence[str]) -> DataFrame:
    return images.withColumn("keyword", keyword_of(F.col("stem"), keywords))


def keyword_counts(images: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """(keyword, n), also for keywords without a file, plus `_unsorted`. A count alone is the dry run."""
    names = images.sparkSession.createDataFrame([(k,) for k in [*dict.fromkeys(keywords), UNSORTED]], "keyword string")
    counts = keyword_split(images, keywords).groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))
    return names.join(counts, "keyword", "left").fillna(0, ["n"])


def classified_copies(images: DataFrame, keywords: Sequence[str], out: str, existing: DataFrame | None = None) -> DataFrame:
    """(src, dst, keyword) of the files to copy; targets that exist already are left out."""
    folder = out.rstrip("/")
    plan = keyword_split(images, keywords).select(
        F.col("path").alias("src"), F.concat(F.lit(folder + "/"), "keyword", F.lit("/"), "stem", "suffix").alias("dst"), "keyword"
    )
    return plan if existing is None else plan.join(existing.select(F.col("path").alias("dst")), "dst", "left_anti").select("src", "dst", "keyword")


# ---------------------------------------------------------------- tiles, regions, windows


def tile_grid(sizes: DataFrame, tile_w: int, tile_h: int, allow_overlap: bool = True) -> DataFrame:
    """Grid tiles of every image. With overlap the last tile moves back into the image, else edge tiles are cut."""
    n = lambda side, tile: F.greatest(F.lit(1), F.ceil(F.col(side) / tile)).cast("int")
    cells = sizes.withColumn("row", F.explode(F.sequence(F.lit(0), n("height", tile_h) - 1))).withColumn(
        "col", F.explode(F.sequence(F.lit(0), n("width", tile_w) - 1))
    )

    def span(index: str, side: str, tile: int) -> tuple[Column, Column]:
        start = F.col(index) * tile
        if allow_overlap:
            return F.when(start + tile > F.col(side), F.greatest(F.lit(0), F.col(side) - tile)).otherwise(start), F.lit(tile)
        return start, F.when(F.col(side) > start, F.least(F.lit(tile), F.col(side) - start)).otherwise(tile)

    (x, w), (y, h) = span("col", "width", tile_w), span("row", "height", tile_h)
    return cells.select("path", x.cast("int").alias("x"), y.cast("int").alias("y"), w.cast("int").alias("w"), h.cast("int").alias("h"), "row", "col")


def tile_plan(sizes: DataFrame, tile_w: int, tile_h: int, allow_overlap: bool = True) -> DataFrame:
    """Tiles to write, cut ones left out, with their file names."""
    full = tile_grid(sizes, tile_w, tile_h, allow_overlap).where((F.col("w") >= tile_w) & (F.col("h") >= tile_h))
    name = F.concat(
        stem_of(F.col("path")), F.lit("_tile_"), F.col("row").cast("string"), F.lit("_"), F.col("col").cast("string"), suffix_of(F.col("path"))
    )
    return full.withColumn("out_name", name)


def tile_preview(sizes: DataFrame, tile_w: int, tile_h: int, allow_overlap: bool = True) -> DataFrame:
    """Tile total, rows and columns per image."""
    return tile_grid(sizes, tile_w, tile_h, allow_overlap).groupBy("path").agg(
        F.count(F.lit(1)).alias("tiles"), (F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols")
    )


def crop_plan(sizes: DataFrame, rects: Sequence[tuple[int, int, int, int]], ref_w: int, ref_h: int) -> DataFrame:
    """Scaled regions of every image, clipped, empty ones dropped, numbered by their place in the list.

    The rectangles are job arguments, so they travel as a literal array, not as a joined table.
    """
    usable = list(rects) if ref_w > 0 and ref_h > 0 else []
    listed = F.array(*[
        F.struct(F.lit(i + 1).alias("roi_no"), *[F.lit(int(v)).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), r)])
        for i, r in enumerate(usable)
    ]) if usable else F.expr("cast(array() as array<struct<roi_no:int,x1:int,y1:int,x2:int,y2:int>>)")
    each = sizes.select("path", "width", "height", F.inline(listed))
    scaled = lambda c, side, ref: half_even(F.col(c) * (F.col(side) / ref))
    crops = each.select(
        "path", "roi_no",
        F.greatest(F.lit(0), scaled("x1", "width", ref_w)).alias("x1"), F.greatest(F.lit(0), scaled("y1", "height", ref_h)).alias("y1"),
        F.least("width", scaled("x2", "width", ref_w)).cast("int").alias("x2"), F.least("height", scaled("y2", "height", ref_h)).cast("int").alias("y2"),
    ).where("x2 > x1 and y2 > y1")
    name = F.concat(stem_of(F.col("path")), F.lit("_roi_"), F.col("roi_no").cast("string"), suffix_of(F.col("path")))
    return crops.withColumn("out_name", name)


def sliding_windows(sizes: DataFrame, tile: int, stride: int) -> DataFrame:
    """Window origins with a stride; a last window sits flush with each far edge."""

    def starts(side: str) -> Column:
        last = F.greatest(F.lit(0), F.col(side) - tile).cast("int")
        return F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last)))

    return sizes.select("path", F.explode(starts("height")).alias("y0"), starts("width").alias("xs")).select(
        "path", F.explode("xs").alias("x0"), "y0"
    )


def resize_plan(
    sizes: DataFrame, width: int | None = None, height: int | None = None, scale: float | None = None, keep_aspect: bool = True
) -> DataFrame:
    """New sides by scale, box, width or height: truncated, at least 1; invalid arguments change nothing."""
    w, h = F.col("width"), F.col("height")
    new_w, new_h = w, h
    if scale:
        if scale > 0:
            new_w, new_h = w * F.lit(float(scale)), h * F.lit(float(scale))
    elif width and height:
        if width > 0 and height > 0:
            ratio = F.least(F.lit(width) / w, F.lit(height) / h)
            new_w, new_h = (w * ratio, h * ratio) if keep_aspect else (F.lit(width), F.lit(height))
    elif width and width > 0:
        new_w, new_h = F.lit(width), h * (F.lit(width) / w)
    elif height and height > 0:
        new_w, new_h = w * (F.lit(height) / h), F.lit(height)
    whole = lambda c: F.greatest(F.lit(1), c.cast("int"))
    return sizes.select("path", "width", "height", whole(new_w).alias("new_width"), whole(new_h).alias("new_height"))


# ---------------------------------------------------------------- content hash and names


def content_hashes(files: DataFrame, content: str = "content") -> DataFrame:
    return files.withColumn("md5", F.md5(F.col(content))).drop(content)


def duplicate_groups(hashed: DataFrame, path: str = "path") -> DataFrame:
    """Per repeated content hash: copies and the path to keep. The copies of one hash are counted, never gathered."""
    return hashed.groupBy("md5").agg(F.count(F.lit(1)).alias("copies"), F.min(path).alias("keep_path")).where("copies > 1")


def unique_names(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Collision-free destination names: `x.png`, then `x_1.png`, `x_2.png`, ... first free one, in `seq` order.

    `incoming`: seq (unique), name. `existing`: name. The r-th file of a name takes the r-th free number: with the
    taken numbers t sorted, number i of them lies below it when t_i - i <= r, so one running count over the merged
    numbers gives the answer and a very frequent name is never gathered. A new name may spell like a numbered form of
    another incoming name; such clashes are settled in `seq` order by repeating with the earlier results as taken.
    """
    files = materialize(incoming.select(F.col("seq").cast("bigint").alias("seq"), "name", stem_of(F.col("name")).alias("stem"), suffix_of(F.col("name")).alias("suffix")), "names")
    ranked = materialize(rank_rows(files, ["name"], ["seq"], "r").withColumn("r", F.col("r") - 1), "names")
    wanted = ranked.select("name", "stem", "suffix").distinct()
    outside = existing.select(F.col("name").alias("target"), F.lit(-1).cast("bigint").alias("since"), F.lit(None).cast("string").alias("owner")).distinct()
    taken = outside
    previous = None
    while True:
        numbers = _taken_numbers(wanted, taken)
        placed = materialize(_place(ranked, numbers), "names")
        spelled = _foreign_targets(placed, wanted)
        if previous is None and not spelled.limit(1).count():
            return placed.select("seq", "name", "target")
        if previous is not None and not placed.select("seq", "target").exceptAll(previous).limit(1).count():
            return placed.select("seq", "name", "target")
        previous = placed.select("seq", "target")
        taken = outside.unionByName(materialize(spelled, "names"))


def _numbered_forms(targets: DataFrame) -> DataFrame:
    """Every reading of a target name as (name, number): itself as number 0 and `x_n.png` as number n of `x.png`."""
    stem, tail = stem_of(F.col("target")), suffix_of(F.col("target"))
    number = F.regexp_extract(stem, r"_([1-9][0-9]{0,8})$", 1)
    base = F.regexp_replace(stem, r"_[1-9][0-9]{0,8}$", "")
    plain = targets.select(F.col("target").alias("name"), F.lit(0).alias("t"), "since", "owner")
    other = targets.where(number != "").select(F.concat(base, tail).alias("name"), number.cast("int").alias("t"), "since", "owner")
    return plain.unionByName(other)


def _taken_numbers(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    forms = _numbered_forms(taken).join(wanted.select("name"), "name", "left_semi").where("owner is null or owner <> name")
    return forms.groupBy("name", "t").agg(F.min("since").alias("since"))


def _foreign_targets(placed: DataFrame, wanted: DataFrame) -> DataFrame:
    """Targets that another wanted name could also spell."""
    forms = _numbered_forms(placed.select("target", F.col("seq").alias("since"), F.col("name").alias("owner")))
    clash = forms.where("owner <> name").join(wanted.select("name"), "name", "left_semi").select("since").distinct()
    return placed.join(clash.withColumnRenamed("since", "seq"), "seq", "left_semi").select("target", F.col("seq").alias("since"), F.col("name").alias("owner"))


def _place(ranked: DataFrame, numbers: DataFrame) -> DataFrame:
    """Number of every file: its rank plus the taken numbers below it."""
    merged = _thresholds(ranked, numbers).select("name", "k", F.lit(0).alias("kind"), F.lit(0).alias("seq"))
    merged = merged.unionByName(ranked.select("name", F.col("r").alias("k"), F.lit(1).alias("kind"), "seq"))
    counted = _running_by_name(merged, F.col("kind") == 0)
    out = counted.where("kind = 1").select("seq", (F.col("k") + F.col("below")).cast("int").alias("n"))
    target = F.when(F.col("n") == 0, F.col("name")).otherwise(F.concat("stem", F.lit("_"), F.col("n").cast("string"), "suffix"))
    return ranked.join(out, "seq").withColumn("target", target)


def _thresholds(ranked: DataFrame, numbers: DataFrame) -> DataFrame:
    """(name, k): each taken number counts for the files of rank k and above.

    A number taken by a file of another name counts only if this name had not reached it before; `late` is the count of
    this name's files that came earlier.
    """
    timed = numbers.where("since >= 0").select("name").distinct()
    first = rank_rows(numbers.join(timed, "name", "left_anti"), ["name"], ["t"], "i").select("name", (F.col("t") - F.col("i") + 1).alias("k"))
    marks = numbers.join(timed, "name", "left_semi").select("name", F.col("since").alias("k"), F.lit(1).alias("kind"), F.col("t").alias("seq"))
    files = ranked.join(timed, "name", "left_semi").select("name", F.col("seq").alias("k"), F.lit(0).alias("kind"), F.lit(0).alias("seq"))
    aged = _running_by_name(marks.unionByName(files), F.col("kind") == 0).where("kind = 1")
    return first.unionByName(_reached(aged.select("name", F.col("seq").alias("t"), F.col("below").alias("late"))))


def _reached(marks: DataFrame) -> DataFrame:
    """(name, k) of the marks that count, by t: of the i marks that count before it, k = t - i must be at least `late`.

    The marks stream through a task in order and only the count of the current name is held, so a name may have any number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, i = None, 0
        for batch in batches:
            out: list[tuple[str, int]] = []
            for name, t, late in zip(*[batch.column(c).to_pylist() for c in ("name", "t", "late")]):
                if name != current:
                    current, i = name, 0
                if t - i >= late:
                    out.append((name, t - i))
                    i += 1
            names, ks = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(ks, pa.int64())], names=["name", "k"])

    return marks.repartition("name").sortWithinPartitions("name", "t").mapInArrow(run, "name string, k bigint")


def _running_by_name(merged: DataFrame, counted: Column) -> DataFrame:
    """Add `below`: the counted rows of the name at or before each row, in (k, kind, seq) order."""
    small, large = split_hot(merged, ["name"])
    flag = counted.cast("int")
    order = W.partitionBy("name").orderBy("k", "kind", "seq").rowsBetween(W.unboundedPreceding, 0)
    out = small.select("*", F.sum(flag).over(order).alias("below"))
    if large is not None:
        out = out.unionByName(running(materialize(large, "names"), ["name"], "k", [("below", "sum", flag, True)], ["kind", "seq"]))
    return out
