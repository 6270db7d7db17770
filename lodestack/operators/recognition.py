"""Recognition of images as a plug-in step: caching, equal crops, region trees, retries in tiles.

The recogniser itself is a function (rows of crops) -> lines; everything around it
is relational, so each distinct crop is recognised once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import batched

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.sinks import cache_key


def with_keys(crops: DataFrame, inputs: list[str]) -> DataFrame:
    """Adds the exact cache key over everything that a result depends on."""
    return crops.withColumn("key", cache_key(inputs))


def recognised(crops: DataFrame, cache: DataFrame, recognise: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """crops (crop_id, key, pixels) with lines: cached ones joined, the rest recognised once per key."""
    known = cache.select("key", "lines")
    new = crops.join(known, "key", "left_anti").dropDuplicates(["key"])
    return crops.join(known.unionByName(recognise(new).select("key", "lines")), "key", "left")


def single_image_page(pages: DataFrame) -> DataFrame:
    """Pages that one unmasked image covers by 95 %: the image's result is the page's."""
    return pages.where((F.col("n_images") == 1) & (F.col("n_placements") == 1) & ~F.col("masked") & (F.col("overlap") >= 0.95))


def fallback_reason(n_polygons: Column, n_chars: Column, mean: Column, low_share: Column) -> Column:
    """Why a page's regions aren't enough and the whole page is read; empty if they are."""
    return (
        F.when((n_polygons == 0) | (n_chars <= 0), "no_region_text")
        .when(mean < 0.60, "low_average_confidence")
        .when(low_share > 0.30, "too_many_low_confidence_regions")
        .when(n_chars < F.greatest(F.lit(4), n_polygons * 2), "insufficient_characters")
        .otherwise("")
    )


def region_id(*identity) -> str:
    return hashlib.sha256("|".join(map(str, identity)).encode()).hexdigest()


def heat(box: tuple[int, int, int, int], anchors: list[tuple[int, int, int, int]]) -> float:
    """Share of a box that anchors cover, 1 at most."""
    over = sum(max(0, min(box[2], a[2]) - max(box[0], a[0])) * max(0, min(box[3], a[3]) - max(box[1], a[1])) for a in anchors)
    return min(1.0, over / max(1, (box[2] - box[0]) * (box[3] - box[1])))


def quarters(box: tuple[int, int, int, int]) -> list[tuple[int, int, int, int]]:
    x1, y1, x2, y2 = box
    mx, my = x1 + max(1, (x2 - x1) // 2), y1 + max(1, (y2 - y1) // 2)
    return [q for q in ((x1, y1, mx, my), (mx, y1, x2, my), (x1, my, mx, y2), (mx, my, x2, y2)) if q[2] > q[0] and q[3] > q[1]]


REGION = "image string, region_id string, level int, x1 int, y1 int, x2 int, y2 int, heat double, state string"


def region_tree(images: DataFrame, target: int = 960) -> DataFrame:
    """All regions of each image's quadtree: halved until sides are at most `target`.

    images: image, width, height, anchors array<array<int>>. Inner regions have
    state split, leaves pending; a leaf without anchors stays in the order behind
    those with more heat.
    """

    schema = to_arrow_schema(T.StructType.fromDDL(REGION))

    def tree(image: str, width: int, height: int, anchors: list | None) -> Iterator[tuple]:
        todo = [(0, (0, 0, int(width), int(height)))]
        marks = [tuple(map(int, a)) for a in anchors or []]
        while todo:
            level, box = todo.pop()
            leaf = max(box[2] - box[0], box[3] - box[1]) <= max(64, target)
            yield (image, region_id(image, level, *box, target), level, *box, heat(box, marks), "pending" if leaf else "split")
            todo += [] if leaf else [(level + 1, q) for q in quarters(box)]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows leave as they come, as one large image may have any number of regions.
        images = (image for part in parts for k in range(0, part.num_rows, 256) for image in zip(*(c.to_pylist() for c in part.slice(k, 256).columns)))
        for rows in batched((row for image in images for row in tree(*image)), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(values, f.type) for values, f in zip(zip(*rows), schema)], schema=schema)

    return images.select("image", "width", "height", "anchors").mapInArrow(run, REGION)


def region_order() -> list[Column]:
    """Hottest first, then outer before inner, top before bottom, left before right."""
    return [F.desc("heat"), F.asc("level"), F.asc("y1"), F.asc("x1"), F.asc("region_id")]


def coverage(regions: DataFrame) -> DataFrame:
    """Per image: share of its area in resolved regions, and how many are open."""
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    done = ~F.col("state").isin("pending", "active", "split")
    whole = F.max(F.when(F.col("level") == 0, area))
    return regions.groupBy("image").agg(F.least(F.lit(1.0), F.sum(F.when(done, area).otherwise(0)) / whole).alias("coverage"), F.count_if(F.col("state").isin("pending", "active")).alias("n_open"))


def reclaimed(regions: DataFrame) -> DataFrame:
    """Regions after a restart: what was active is pending again."""
    return regions.withColumn("state", F.when(F.col("state") == "active", "pending").otherwise(F.col("state")))
