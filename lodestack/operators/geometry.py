"""Boxes of recognised text: overlap, order, de-duplication, tiles, fallbacks.

A box is struct<x1, y1, x2, y2: double>; order-dependent de-duplication works on
one image's lines at a time, in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def axis_box(points: Column) -> Column:
    """Box around array<array<double>> points."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x2"] - b["x1"]) * F.greatest(F.lit(0.0), b["y2"] - b["y1"])


def intersection(a: Column, b: Column) -> Column:
    w, h = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def iou(a: Column, b: Column) -> Column:
    common = intersection(a, b)
    return F.when(common <= 0, 0.0).otherwise(common / F.greatest(F.lit(1.0), area(a) + area(b) - common))


def covered_by_any(box: Column, boxes: Column) -> Column:
    """Whether one of boxes is about as large and overlaps by 85 %."""
    test = lambda r: (area(r) > 0) & (area(box) / area(r)).between(0.80, 1.25) & (iou(box, r) >= 0.85)
    return (area(box) > 0) & F.exists(boxes, test)


def reading_row(box: Column) -> Column:
    """Rounded line number, by the line's own height; with x1 the reading order."""
    return F.bround(box["y1"] / F.greatest(F.lit(8.0), (box["y2"] - box["y1"]) * 0.6)).cast("int")


def tile_positions(length: Column, side: int, overlap: int) -> Column:
    """Starts of tiles along an edge; the last one ends with it."""
    last = length - side
    steps = F.sequence(F.lit(0), F.greatest(F.lit(0), last), F.lit(max(1, side - overlap)))
    return F.when(length <= side, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(steps, F.array(last))))


def tiles(images: DataFrame, key: str, side: int, overlap: int) -> DataFrame:
    """One row for each tile of each image (width, height)."""
    x = images.withColumn("x", F.explode(tile_positions(F.col("width"), side, overlap)))
    return x.withColumn("y", F.explode(tile_positions(F.col("height"), side, overlap))).select(key, "x", "y")


def needs_tiles(n_lines: Column, mean_confidence: Column, low_share: Column, n_chars: Column, n_polygons: Column, text_likely: Column, scale: Column) -> Column:
    """Whether recognition was too weak and the image should be read in tiles."""
    weak = (F.coalesce(mean_confidence, F.lit(0.0)) < 0.78) | (F.coalesce(low_share, F.lit(1.0)) > 0.30) | (n_chars < F.greatest(F.lit(8), n_polygons * 2)) | (text_likely & (scale >= 2.0) & (n_chars < 40))
    return F.when(n_lines == 0, text_likely).otherwise(weak)


def scanned_page(text: Column, has_images: Column) -> Column:
    """Whether a page with images has no text, hardly any, or mostly broken text."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "")
    n = F.length(bare)
    return has_images & ((n == 0) | (F.regexp_count(bare, F.lit(r"[\p{L}\p{N}]")) < 20) | (F.regexp_count(bare, F.lit("�")) / F.greatest(n, F.lit(1)) >= 0.2))


def _iou(a, b) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    common = max(0.0, w) * max(0.0, h)
    return common / max(1.0, _area(a) + _area(b) - common) if common else 0.0


def _area(b) -> float:
    return max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1])


def _reading(b) -> tuple[int, float]:
    return round(b[1] / max(8.0, (b[3] - b[1]) * 0.6)), b[0]


def _plain(text: str | None) -> str:
    return re.sub(r"[\W_]+", "", text or "").lower()


def _same_line(p: str, q: str, a, b) -> bool:
    """Whether lines of the plain texts p and q in boxes a and b are one."""
    if not p or not q or not (p == q or (min(len(p), len(q)) >= 4 and (p in q or q in p))):
        return False
    return _iou(a, b) >= 0.30


def _kept(rows: DataFrame, key: str, columns: list[str], keep: Callable[[list[tuple]], list[int]]) -> DataFrame:
    """Of each key's rows those whose numbers keep gives for their columns, in its order.

    A group is one row of lists and a batch holds many, as a frame for each of
    millions of small images costs more than the rule.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            values = part.column(0).flatten()
            fields = [values.field(c).to_pylist() for c in columns]
            wanted: list[int] = []
            start = 0
            for n in part.column(0).value_lengths().to_pylist():
                wanted += [start + i for i in keep(list(zip(*(f[start : start + n] for f in fields))))]
                start += n
            yield pa.RecordBatch.from_struct_array(values.take(pa.array(wanted, pa.int64())))

    return rows.groupBy(key).agg(F.collect_list(F.struct(*rows.columns)).alias("rows")).select("rows").mapInArrow(run, rows.schema)


def merged_lines(lines: DataFrame, key: str) -> DataFrame:
    """Lines of each image in reading order, doubles removed, the surer one kept.

    lines: key, text, confidence, x1, y1, x2, y2.
    """

    def keep(rows: list[tuple]) -> list[int]:
        kept: list[int] = []
        plain = [_plain(r[0]) for r in rows] if len(rows) > 1 else []
        order = lambda i: _reading(rows[i][2:])
        for i in sorted(range(len(rows)), key=order):
            double = next((n for n, k in enumerate(kept) if _same_line(plain[k], plain[i], rows[k][2:], rows[i][2:])), None)
            if double is None:
                kept.append(i)
            elif (rows[i][1] or 0.0) > (rows[kept[double]][1] or 0.0):
                kept[double] = i
        return sorted(kept, key=order)

    return _kept(lines, key, ["text", "confidence", "x1", "y1", "x2", "y2"], keep)


def distinct_boxes(boxes: DataFrame, key: str) -> DataFrame:
    """Boxes of each image in reading order without near-equal ones (area within 0.85-1.18, overlap 92 %)."""

    def keep(rows: list[tuple]) -> list[int]:
        kept: list[int] = []
        for i in sorted(range(len(rows)), key=lambda i: _reading(rows[i])):
            b = rows[i]
            if not any(0.85 <= _area(b) / max(1.0, _area(rows[k])) <= 1.18 and _iou(b, rows[k]) >= 0.92 for k in kept):
                kept.append(i)
        return kept

    return _kept(boxes.select(key, "x1", "y1", "x2", "y2"), key, ["x1", "y1", "x2", "y2"], keep)
