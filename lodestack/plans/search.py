"""Search: candidates, confirmation, scores, grouping by file, pages.

Block texts go through one scan with the confirming predicate in it; what is
grouped and ordered is narrow (ids, scores, locations). Contexts are made for
the blocks of the wanted page only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import postings
from ..query import Planned, SearchQuery, plan


Index = DataFrame | Callable[[], DataFrame]


class IndexNotReadyError(RuntimeError):
    """The index isn't complete; the message lists the reasons."""


def active(exclusions: DataFrame | None, files: DataFrame) -> DataFrame:
    """files that aren't deleted or excluded."""
    if "is_deleted" in files.columns:
        files = files.where(~F.coalesce("is_deleted", F.lit(False)))
    if exclusions is None:
        return files
    now = exclusions.where("revoked_at is null and invalidated_at is null").select(F.col("file_id").alias("__excluded"))
    return files.join(now, files.file_id == F.col("__excluded"), "left_anti")


def of_files(blocks: DataFrame, files: DataFrame, how: str = "inner") -> DataFrame:
    """Blocks with each file that shows them: by shared document, or by their own file.

    Two equi-joins split on whether the block has a document; a single OR
    condition would become a nested loop.
    """
    own = files.withColumnsRenamed({"file_id": "__file", "document_id": "__document"})
    shared = blocks.where("document_id is not null").join(own, F.col("document_id") == F.col("__document"), how)
    single = blocks.where("document_id is null").join(own, F.col("file_id") == F.col("__file"), how)
    return shared.unionByName(single)


def stored_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks with the normal form that searches and the index read, characters composed (NFKC): to be written once."""
    own = tx.compose(blocks.withColumn("normalized_text", F.coalesce("raw_text", F.lit(""))), "normalized_text")
    return own.withColumn("normalized_text", tx.normalized("normalized_text"))


def attribute_filter(query: SearchQuery) -> Column:
    tests = [F.lit(True)]
    if query.root_ids:
        tests.append(F.col("root_id").isin(query.root_ids))
    if query.extensions:
        tests.append(F.col("extension").isin([e.lower() if e.startswith(".") else "." + e.lower() for e in query.extensions]))
    for name, low, high in (("modified_time", query.date_from, query.date_to), ("size_bytes", query.size_min, query.size_max)):
        if low is not None:
            tests.append(F.col(name) >= low)
        if high is not None:
            tests.append(F.col(name) <= high)
    return reduce(lambda a, b: a & b, tests)


def source_filter(query: SearchQuery) -> Column:
    """Content blocks only; OCR text only where it is wanted and sure enough."""
    kind = F.col("source_type")
    keep = kind.isNull() | (kind != "metadata")
    if not query.include_ocr:
        return keep & (kind.isNull() | (kind != "ocr"))
    if not query.allow_ocr_fuzzy:
        return keep & (kind.isNull() | (kind != "ocr") | (F.coalesce("ocr_confidence", F.lit(0.0)) >= query.ocr_min_confidence))
    return keep


def confirmed(p: Planned, text: Column) -> Column:
    """Whether normalised text matches: all terms, any of them, or the first one."""
    if p.query.mode in ("all", "any"):
        tests = [text.contains(t) for t in p.terms]
        return reduce((lambda a, b: a & b) if p.query.mode == "all" else (lambda a, b: a | b), tests)
    return text.contains(p.terms[0])


def _stripped(p: Planned, raw: Column) -> Column:
    x = F.regexp_replace(raw, r"(?U)\s+", "") if p.query.ignore_spaces else raw
    return F.regexp_replace(x, tx.HYPHENS, "") if p.query.ignore_hyphens else x


def _hits(p: Planned, stored: Column | None = None) -> Column:
    """Occurrences in raw_text: of the pattern, or of all terms in its normal form (stored for blocks, if it is the plain one)."""
    if p.pattern:
        return F.regexp_count(F.coalesce("raw_text", F.lit("")), F.lit(p.pattern)).cast("long")
    return tx.hits(stored if stored is not None else tx.normalized("raw_text", **p.query.flags), p.terms)


def _content(p: Planned, blocks: DataFrame, files: DataFrame, index: Index | None) -> DataFrame:
    """Confirmed blocks. With an index (trigrams of the stored normal form), only its candidates are read, where the query's strategy allows it."""
    rows = blocks.where(source_filter(p.query))
    if index is not None and p.strategy == "postings":
        rows = rows.join(postings.candidates(p, index() if callable(index) else index, "block_id"), "block_id", "left_semi")
    hits = _hits(p)
    if p.pattern:
        rows = rows.where(_stripped(p, F.coalesce("raw_text", F.lit(""))).rlike(p.pattern))
    else:
        stored = F.col("raw_text") if p.query.case_sensitive and not p.query.compat else F.col("normalized_text")
        plain = not (p.query.case_sensitive or p.query.ignore_spaces or p.query.ignore_hyphens)
        rows = rows.where(confirmed(p, stored if plain else tx.normalized(stored, **p.query.flags)))
        hits = _hits(p, stored) if plain else hits
    names = ["path", "filename", "extension", "size_bytes", "modified_time", "parse_status"]
    keep = files.select("file_id", "document_id", *names)
    # Hits are counted before the join, so no text is shuffled.
    rows = rows.select("block_id", "file_id", "document_id", "location_text", hits.alias("__hits"), F.coalesce("source_type", F.lit("native_text")).alias("source_type"), "ocr_confidence")
    return of_files(rows, keep).withColumn("file_id", F.col("__file")).drop("__file", "__document", "document_id")


def _metadata(p: Planned, files: DataFrame) -> DataFrame:
    text = F.concat_ws("\n", *([F.col("filename")] * p.filename + [F.col("path")] * p.path))
    rows = files.withColumn("raw_text", text)
    if p.pattern:
        rows = rows.where(_stripped(p, F.col("raw_text")).rlike(p.pattern))
    else:
        own = tx.normalized("raw_text", **p.query.flags)
        rows = rows.where(confirmed(p, own))
        if p.query.mode == "filename":  # every term has to occur, though the first one confirms
            rows = rows.where(reduce(lambda a, b: a & b, (own.contains(t) for t in p.terms)))
    null = lambda kind: F.lit(None).cast(kind)
    return rows.select(null("long").alias("block_id"), "file_id", F.lit("").alias("location_text"), _hits(p).alias("__hits"), F.lit("metadata").alias("source_type"), null("double").alias("ocr_confidence"), "path", "filename", "extension", "size_bytes", "modified_time", "parse_status")


def candidates(p: Planned, blocks: DataFrame, files: DataFrame, index: Index | None = None) -> DataFrame:
    """Confirmed rows, one for each block and file and one for each file's name or path."""
    files = files.where(attribute_filter(p.query))
    if "document_id" not in files.columns:
        files = files.withColumn("document_id", F.lit(None).cast("long"))
    found = [_metadata(p, files)] if p.filename or p.path else []
    found += [_content(p, blocks, files, index)] if p.content else []
    return reduce(DataFrame.unionByName, found)


def scored(p: Planned, rows: DataFrame) -> DataFrame:
    """hits, score, is_fuzzy and the shown location of each row."""
    return _scored_rows(rows, F.lit(p.terms[0]), p.query)


def _scored_rows(rows: DataFrame, first: Column, query: SearchQuery) -> DataFrame:
    name, kind = tx.normalized("filename", **query.flags), F.col("source_type")
    bonus = F.when(name == first, 1000).when(name.startswith(first), 500).when(name.contains(first), 250).otherwise(0)
    adjust = F.when(kind == "metadata", 50).when(kind == "ocr", -25).otherwise(0)
    archive = F.element_at(F.split(F.replace(F.split("path", " > ", 2)[0], F.lit("\\"), F.lit("/")), "/"), -1)
    inside = F.get(F.split("path", " > ", 2), F.lit(1))
    location = F.coalesce("location_text", F.lit(""))
    place = F.when(F.col("path").contains(" > ") & (kind != "metadata"), F.concat_ws(" > ", archive, inside, location)).otherwise(location)
    fuzzy = (kind == "ocr") & (F.col("ocr_confidence").isNull() | (F.col("ocr_confidence") < query.ocr_min_confidence))
    rows = rows.withColumn("__place", place)
    more = [c for c in ("query_index",) if c in rows.columns]
    return rows.select("file_id", "path", "filename", "extension", "size_bytes", "modified_time", "parse_status", "block_id", "source_type", "ocr_confidence", F.col("__hits").alias("hits"), (F.col("__hits") + bonus + adjust).cast("double").alias("score"), fuzzy.alias("is_fuzzy"), F.col("__place").alias("location_text"), *more)


# Labels shown for hits without a location.
LABELS = {"metadata": "文件名/路径", "ocr": "OCR"}
BODY = "正文"


def _label(kind: Column) -> Column:
    return reduce(lambda w, kv: w.when(kind == kv[0], kv[1]), LABELS.items(), F).otherwise(BODY)


def grouped(rows: DataFrame, *by: str) -> DataFrame:
    """One row per file (and `by`): summed score, its distinct matches in order, and what they say together."""
    order = F.when(F.col("source_type") == "metadata", 0).when(F.col("source_type") == "ocr", 2).otherwise(1)
    match = F.struct(order.alias("rank"), "location_text", "block_id", "source_type", "ocr_confidence", F.greatest("hits", F.lit(1)).alias("hit_count"), "is_fuzzy")
    out = rows.groupBy("file_id", *by).agg(
        *(F.any_value(c).alias(c) for c in ("path", "filename", "extension", "size_bytes", "modified_time", "parse_status")),
        F.sum("score").alias("score"),
        F.max("ocr_confidence").alias("ocr_confidence"),
        F.bool_or("is_fuzzy").alias("has_fuzzy_match"),
        F.array_sort(F.collect_set(match)).alias("matches"),
    )
    places = F.array_distinct(F.transform("matches", lambda m: F.when(m["location_text"] != "", m["location_text"]).otherwise(_label(m["source_type"]))))
    weight = lambda m: F.when(m["source_type"] == "native_text", 3).when(m["source_type"] == "metadata", 1).otherwise(2)
    best = F.array_max(F.transform("matches", lambda m, i: F.struct(weight(m).alias("w"), (-i).alias("i"), m["source_type"].alias("kind"))))
    return out.select(
        "*",
        F.aggregate("matches", F.lit(0).cast("long"), lambda a, m: a + m["hit_count"]).alias("hit_count"),
        F.get(F.filter(F.transform("matches", lambda m: m["block_id"]), lambda b: b.isNotNull()), F.lit(0)).alias("block_id"),
        best["kind"].alias("source_type"),
        F.when(F.size(places) <= 3, F.array_join(places, "、")).otherwise(F.concat(F.array_join(F.slice(places, 1, 3), "、"), F.lit(" 等 "), F.size(places).cast("string"), F.lit(" 处"))).alias("location_text"),
    )


def page(results: DataFrame, query: SearchQuery) -> DataFrame:
    """The wanted page by score, modification time, name, and file_id as last tie-break."""
    order = [F.col("score").desc(), F.col("modified_time").desc(), F.lower("filename").asc(), F.col("file_id").asc()]
    start = (max(1, query.page) - 1) * query.page_size
    most = query.max_results or None
    n = query.page_size if most is None else max(0, min(query.page_size, most - start))
    return results.orderBy(*order).offset(start).limit(n)


@dataclass
class SearchPage:
    """results: the page; all_results: every confirmed file, unordered."""

    results: DataFrame
    all_results: DataFrame
    planned: Planned

    def total_confirmed(self) -> int:
        return self.all_results.count()

    def available(self) -> int:
        most = self.planned.query.max_results
        return min(self.total_confirmed(), most) if most else self.total_confirmed()

    def truncated(self) -> bool:
        return self.total_confirmed() > self.available()


class SearchEngine:
    """Searches a set of tables: files, blocks, and optionally exclusions, a readiness row, and the blocks' trigram index.

    With an index, queries whose terms all have three characters or more read the
    postings of these and then the candidates; all others scan. An index may be a
    function that opens it, called by queries that read it only.
    """

    def __init__(self, files: DataFrame, blocks: DataFrame, exclusions: DataFrame | None = None, readiness: DataFrame | None = None, index: Index | None = None):
        self.files, self.blocks, self.exclusions, self.readiness, self.index = files, blocks, exclusions, readiness, index

    def require_ready(self) -> None:
        if self.readiness is not None:
            row = self.readiness.first()
            if not row["ready"]:
                raise IndexNotReadyError(", ".join(row["not_ready_reasons"]))

    def results(self, query: SearchQuery) -> DataFrame:
        """Every confirmed file with score, matches and summary; empty if no term is left."""
        p = plan(query)
        files = active(self.exclusions, self.files)
        if not p.terms:
            p = plan(SearchQuery("x"))
            return grouped(scored(p, candidates(p, self.blocks, files))).limit(0)
        return grouped(scored(p, candidates(p, self.blocks, files, self.index)))

    def search(self, query: SearchQuery, with_context: bool = True) -> SearchPage:
        """The wanted page. Raises ValueError for a bad pattern, IndexNotReadyError if a gate is shut."""
        self.require_ready()
        p = plan(query)
        found = self.results(query)
        wanted = page(found, p.query)
        return SearchPage(self.with_contexts(wanted, p) if with_context and p.terms else wanted, found, p)

    def with_contexts(self, results: DataFrame, p: Planned) -> DataFrame:
        """Adds `context`: each match's place and surrounding raw text, in match order."""
        shown = tx.context_udf(p.raw_terms, p.pattern, p.query.flags)
        each = results.select("file_id", "path", "filename", F.posexplode("matches").alias("i", "m"))
        texts = self.blocks.select(F.col("block_id").alias("__block"), F.col("raw_text").alias("__raw"))
        both = each.join(texts, F.col("m.block_id") == F.col("__block"), "left")
        names = F.concat_ws("\n", *([F.col("filename")] * p.filename + [F.col("path")] * p.path)) if p.filename or p.path else F.lit("")
        both = both.withColumn("__context", shown(F.when(F.col("m.source_type") == "metadata", names).otherwise(F.coalesce("__raw", F.lit("")))))
        label = F.when(F.col("m.location_text") != "", F.col("m.location_text")).otherwise(_label(F.col("m.source_type")))
        line = F.struct("i", F.concat(label, F.lit("\n"), F.when(F.col("__context") != "", F.col("__context")).otherwise(LABELS["metadata"] + "命中")).alias("s"))
        text = both.groupBy(F.col("file_id").alias("__id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["s"]), "\n\n").alias("context"))
        return results.join(text, F.col("file_id") == F.col("__id"), "left").drop("__id")

    def search_many(self, queries: list[SearchQuery]) -> DataFrame:
        """query_index and file results of several queries.

        Content queries that differ in text and mode only share one scan: each block
        yields a row for every query it matches. Others get a plan of their own.
        """
        plans = [plan(q) for q in queries]
        alike = all(p.terms and not p.pattern and p.content and not (p.filename or p.path) and replace(p.query, text="", mode="exact") == replace(plans[0].query, text="", mode="exact") for p in plans)
        if not alike or len(plans) < 2:
            return reduce(DataFrame.unionByName, (self.results(q).withColumn("query_index", F.lit(i)) for i, q in enumerate(queries)))
        q = plans[0].query
        stored = F.col("raw_text") if q.case_sensitive and not q.compat else F.col("normalized_text")
        plain = not (q.case_sensitive or q.ignore_spaces or q.ignore_hyphens)
        rows = self.blocks.where(source_filter(q)).withColumn("__text", stored if plain else tx.normalized(stored, **q.flags))
        matched = F.array_compact(F.array(*(F.when(confirmed(p, F.col("__text")), F.lit(i)) for i, p in enumerate(plans))))
        rows = rows.withColumn("__matched", matched).where(F.size("__matched") > 0)
        rows = rows.withColumn("__raw", tx.normalized("raw_text", **q.flags))
        files = active(self.exclusions, self.files).where(attribute_filter(q))
        if "document_id" not in files.columns:
            files = files.withColumn("document_id", F.lit(None).cast("long"))
        rows = rows.select("block_id", "file_id", "document_id", "location_text", F.coalesce("source_type", F.lit("native_text")).alias("source_type"), "ocr_confidence", "__matched", F.array(*(tx.hits(F.col("__raw"), p.terms) for p in plans)).alias("__all_hits"))
        rows = of_files(rows, files.select("file_id", "document_id", "path", "filename", "extension", "size_bytes", "modified_time", "parse_status")).withColumn("file_id", F.col("__file")).drop("__file", "__document", "document_id")
        rows = rows.withColumn("query_index", F.explode("__matched"))
        hits, first = F.get("__all_hits", F.col("query_index")), F.get(F.array(*(F.lit(p.terms[0]) for p in plans)), F.col("query_index"))
        return grouped(_scored_rows(rows.withColumn("__hits", hits), first, q), "query_index")
