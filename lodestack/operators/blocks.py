"""Content blocks: by lines, coalesced, digested, and de-duplicated by content."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINES = 500


def line_blocks(rows: DataFrame, key: str, text: str, lines: int = LINES) -> DataFrame:
    """key, block_index, line_start, line_end, location_text, raw_text of every `lines` lines.

    Lines end with \\n only (a \\r stays); a last line without text is none.
    """
    cut = F.regexp_replace(F.col(text), "\n$", "")
    all_lines = F.split(cut, "\n", -1)
    n = F.size(all_lines)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((n - 1) / lines).cast("int")))
    rows = rows.where(F.length(F.coalesce(F.col(text), F.lit(""))) > 0)
    out = rows.select(F.col(key), all_lines.alias("__lines"), F.explode(starts).alias("block_index"))
    first = F.col("block_index") * lines
    last = F.least(first + lines, F.size("__lines"))
    return out.select(
        key, "block_index", (first + 1).alias("line_start"), last.alias("line_end"), F.concat(F.lit("第 "), (first + 1).cast("string"), F.lit("-"), last.cast("string"), F.lit(" 行")).alias("location_text"), F.array_join(F.slice("__lines", first + 1, lines), "\n").alias("raw_text")
    )


# Block types that may merge, and rows of a sheet that do at most.
MERGEABLE = ["docx_paragraph", "docx_table_row", "xlsx_row", "text"]
SHEET_ROWS = 20


def coalesced(blocks: DataFrame, key: str = "file_id", target: int = 4096, most: int = 16384) -> DataFrame:
    """Small neighbouring blocks of a file merged, in block order; blank ones dropped.

    The rule resets as it goes, so it is a fold over each file's ordered blocks:
    one pass in the JVM gives every block the number of its merged block, and a
    grouping joins the texts. Columns: key, block_index, block_type,
    location_text, raw_text, source_type, sheet_name, n_blocks.
    """
    target = max(256, target)
    most = max(target, most)
    b = F.struct("block_index", "block_type", F.coalesce("location_text", F.lit("")).alias("location_text"), F.regexp_replace("raw_text", r"(?U)^\s+|\s+$", "").alias("text"), "source_type", F.coalesce("sheet_name", F.lit("")).alias("sheet_name"))
    files = blocks.where(F.coalesce("raw_text", F.lit("")).rlike(r"(?U)\S")).groupBy(key).agg(F.array_sort(F.collect_list(b)).alias("bs"))
    start = F.struct(F.lit(-1).alias("g"), F.lit(0).alias("chars"), F.lit(0).alias("n"), F.lit("").alias("kind"), F.lit("").alias("sheet"), F.array().cast("array<int>").alias("ids"))

    def step(a: Column, x: Column) -> Column:
        length = F.length(x["text"])
        merges = x["block_type"].isin(MERGEABLE) & (x["source_type"] == "native_text")
        fits = (a["n"] > 0) & (a["kind"] == x["block_type"]) & (a["sheet"] == x["sheet_name"]) & (a["chars"] + length + 1 <= most) & ~((x["block_type"] == "xlsx_row") & (a["n"] >= SHEET_ROWS))
        joins = merges & fits
        g = F.when(joins, a["g"]).otherwise(a["g"] + 1)
        chars = F.when(joins, a["chars"] + length + 1).otherwise(length)
        is_open = merges & (chars < target)
        return F.struct(g.alias("g"), F.when(is_open, chars).otherwise(0).alias("chars"), F.when(is_open, F.when(joins, a["n"] + 1).otherwise(1)).otherwise(0).alias("n"), F.coalesce(x["block_type"], F.lit("")).alias("kind"), x["sheet_name"].alias("sheet"), F.concat(a["ids"], F.array(g)).alias("ids"))

    ids = F.aggregate("bs", start, step, lambda a: a["ids"])
    each = files.select(key, F.explode(F.arrays_zip("bs", ids.alias("ids"))).alias("z")).select(key, F.col("z.ids").alias("block_index"), "z.bs")
    parts = F.array_sort(F.collect_list("bs"))
    out = each.groupBy(key, "block_index").agg(parts.alias("p"))
    first, last = F.col("p")[0], F.element_at("p", -1)
    place = F.when(first["location_text"] == last["location_text"], first["location_text"]).otherwise(F.concat_ws(" - ", first["location_text"], last["location_text"]))
    return out.select(key, "block_index", first["block_type"].alias("block_type"), place.alias("location_text"), F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("raw_text"), first["source_type"].alias("source_type"), first["sheet_name"].alias("sheet_name"), F.size("p").alias("n_blocks"))


def digests(blocks: DataFrame, by: list[str], order: list[str], values: list[str]) -> DataFrame:
    """by, n_blocks and a SHA-256 over the ordered rows of each group (values are NUL-terminated)."""
    row = F.sha2(F.concat(*(F.concat(F.coalesce(F.col(v).cast("string"), F.lit("")), F.lit("\0")) for v in values)), 256)
    rows = blocks.select(*by, F.struct(*order, row.alias("__sha")).alias("x"))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_blocks"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["__sha"]), ""), 256).alias("digest"))


def content_groups(files: DataFrame, identity: list[str], key: str, size: str) -> DataFrame:
    """For each content identity: its primary file, how many share it, and the bytes not parsed again."""
    out = files.groupBy(*identity).agg(F.min(key).alias("primary_id"), F.count(F.lit(1)).alias("n_files"), F.sum(size).alias("__all"), F.min_by(size, key).alias("__one"))
    return out.select(*identity, "primary_id", "n_files", (F.col("__all") - F.col("__one")).alias("bytes_avoided"))


def hash_candidates(files: DataFrame, keys: list[str], key: str) -> DataFrame:
    """Files that share (extension, size, ...) with another one: only these need a full hash.

    Counts are partial sums and then joined, so files of one common key (empty
    ones) are spread over tasks. Keys that are null count as equal.
    """
    same = files.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_same")).where("n_same > 1")
    both = files.alias("f").join(same.alias("s"), reduce(lambda a, b: a & b, (F.col(f"f.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys)))
    return both.select(f"f.{key}", *(f"f.{k}" for k in keys), "n_same")


def duplicate_indexes(blocks: DataFrame, key: str = "file_id") -> DataFrame:
    """Places taken twice: must be empty."""
    return blocks.groupBy(key, "block_index").count().where("count > 1")
