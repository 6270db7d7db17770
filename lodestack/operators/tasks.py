"""Work distribution: fair claims, budgets, batches, leases, retries, state, and cost estimates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schemas import ARCHIVE_EXTENSIONS, IMAGE_EXTENSIONS, OFFICE_EXTENSIONS
from ..streaming.events import median


def fair_rank(rows: DataFrame, source: str, *order: Column) -> DataFrame:
    """Adds source_rank: a row's place among those of its source."""
    return rows.withColumn("source_rank", F.row_number().over(Window.partitionBy(source).orderBy(*order)))


def fair_claim(rows: DataFrame, source: str, key: str, priority: str, limit: int) -> DataFrame:
    """The next `limit` rows, one source after the other: rank first, then source, priority, key.

    A source gives `limit` rows at most, so ranks beyond it are cut inside each
    partition before anything is ordered over all sources.
    """
    ranked = fair_rank(rows, source, F.desc(priority), F.asc(key)).where(F.col("source_rank") <= limit)
    return ranked.orderBy("source_rank", source, F.desc(priority), key).limit(limit)


def claimable(rows: DataFrame, now: Column) -> DataFrame:
    """Queued rows, and running ones whose lease ran out."""
    return rows.where((F.col("status") == "queued") | ((F.col("status") == "running") & (F.col("lease_expires_at") <= now)))


def leased(rows: DataFrame, worker: str, now: Column, seconds: int) -> DataFrame:
    return rows.withColumns({"status": F.lit("running"), "lease_owner": F.lit(worker), "lease_expires_at": now + F.make_interval(secs=F.lit(max(1, seconds)))})


def confirm(rows: DataFrame, confirmations: DataFrame) -> DataFrame:
    """Running rows whose owner confirms them with a digest become confirmed; others stay."""
    c = confirmations.select(F.col("task_id").alias("__t"), F.col("lease_owner").alias("__o"), F.col("result_digest").alias("__d"))
    ok = (F.col("status") == "running") & (F.col("lease_owner") == F.col("__o")) & (F.length("__d") > 0)
    both = rows.join(c, rows.task_id == F.col("__t"), "left")
    return both.withColumns({"status": F.when(ok, "confirmed").otherwise(F.col("status")), "result_digest": F.when(ok, F.col("__d")).otherwise(F.col("result_digest"))}).select(rows.columns)


def budget_claim(rows: DataFrame, source: str, key: str, priority: str, cost: str, limit: int, budget: int) -> DataFrame:
    """Greedy claim under a cost budget in fair order; too costly rows are skipped, the first one never.

    The fold runs over candidates in order. Within any source and cost only the
    first `limit` rows can be claimed, so the rest is cut beforehand; the fold's
    input is then ordered by one task, as the rule itself is sequential.
    """
    ranked = fair_rank(rows, source, F.desc(priority), F.asc(key)).withColumn("__cost", F.greatest(F.lit(1), F.coalesce(cost, F.lit(0))).cast("long"))
    same = Window.partitionBy("__cost").orderBy("source_rank", F.desc(priority), key)
    ranked = ranked.withColumn("__same", F.row_number().over(same)).where(F.col("__same") <= limit)
    # One candidate list; at most `limit` rows for each distinct cost.
    item = F.struct("source_rank", (-F.col(priority)).alias("p"), F.col(key).alias("k"), F.col("__cost").alias("c"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<long>").alias("ids"))

    def step(a: Column, x: Column) -> Column:
        n = F.size(a["ids"])
        ok = (n < limit) & ((n == 0) | (a["used"] + x["c"] <= budget))
        return F.struct(F.when(ok, a["used"] + x["c"]).otherwise(a["used"]).alias("used"), F.when(ok, F.concat(a["ids"], F.array(x["k"].cast("long")))).otherwise(a["ids"]).alias("ids"))

    chosen = ranked.agg(F.array_sort(F.collect_list(item)).alias("xs")).select(F.posexplode(F.aggregate("xs", start, step, lambda a: a["ids"])).alias("place", "__id"))
    return rows.join(chosen, rows[key] == F.col("__id")).drop("__id")


def fair_order(jobs: DataFrame) -> DataFrame:
    """Adds lane_order: round robin over a lane's sources, each in page, kind, cost and path order."""
    inside = Window.partitionBy("lane", "source").orderBy(F.coalesce("page", F.lit(0)), F.coalesce("is_ocr", F.lit(False)), F.desc("cost"), F.lower("path"))
    label = F.lower(F.max("path").over(Window.partitionBy("lane", "source")))
    ranked = jobs.withColumn("__r", F.row_number().over(inside)).withColumn("__l", label)
    return ranked.withColumn("lane_order", F.row_number().over(Window.partitionBy("lane").orderBy("__r", "__l", "source"))).drop("__r", "__l")


def batches(rows: DataFrame, by: str, order: str, costs: dict[str, int], most: int) -> DataFrame:
    """Adds batch: neighbours in order share one until a budget or `most` rows would be exceeded (next fit)."""
    names = list(costs)
    item = F.struct(order, *(F.greatest(F.lit(1), F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in names))
    start = F.struct(F.lit(0).alias("b"), F.lit(0).alias("n"), *(F.lit(0).cast("long").alias(c) for c in names), F.array().cast("array<int>").alias("ids"))

    def step(a: Column, x: Column) -> Column:
        full = (a["n"] > 0) & reduce(lambda p, q: p | q, (a[c] + x[c] > costs[c] for c in names), a["n"] >= most)
        b = F.when(full, a["b"] + 1).otherwise(a["b"])
        return F.struct(b.alias("b"), F.when(full, 1).otherwise(a["n"] + 1).alias("n"), *(F.when(full, x[c]).otherwise(a[c] + x[c]).alias(c) for c in names), F.concat(a["ids"], F.array(b)).alias("ids"))

    lists = rows.groupBy(by).agg(F.array_sort(F.collect_list(item)).alias("xs"))
    each = lists.select(F.col(by).alias("__by"), F.explode(F.arrays_zip("xs", F.aggregate("xs", start, step, lambda a: a["ids"]).alias("b"))).alias("z"))
    ids = each.select("__by", F.col(f"z.xs.{order}").alias("__order"), F.col("z.b").alias("batch"))
    return rows.join(ids, (rows[by] == F.col("__by")) & (rows[order] == F.col("__order"))).drop("__by", "__order")


def capped(rows: DataFrame, source: str, order: list[Column], inflight: DataFrame, cap: int) -> DataFrame:
    """Rows that may start while a source has at most `cap` at once (inflight: source, n)."""
    busy = inflight.select(F.col(source).alias("__s"), F.col("n").alias("__n"))
    ranked = fair_rank(rows, source, *order).join(busy, F.col(source) == F.col("__s"), "left")
    return ranked.where(F.col("source_rank") <= cap - F.coalesce("__n", F.lit(0))).drop("__s", "__n")


def longest_first(jobs: DataFrame) -> DataFrame:
    """Adds place: within each lane by falling cost, then path."""
    return jobs.withColumn("place", F.row_number().over(Window.partitionBy("lane").orderBy(F.desc("cost"), F.lower("path"))))


def lane_costs(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("lane").agg(F.sum("cost").alias("cost"), F.count(F.lit(1)).alias("n_jobs"))


def micro_batch(requests: DataFrame, now_ms: Column, wait_ms: int, most: int, pixels: int, memory: int) -> DataFrame:
    """The next batch: requests like the oldest one, once it waited long enough or enough of them wait.

    requests: request_id, submitted_ms, compatibility_key, pixel_count,
    memory_bytes. The first request is taken whatever its size; the batch ends
    before a budget is exceeded. Running sums say so, as the batch never skips.
    """
    first = requests.agg(F.min(F.struct("submitted_ms", "request_id", "compatibility_key")).alias("o"))
    like = requests.join(F.broadcast(first), F.col("compatibility_key") == F.col("o.compatibility_key"))  # one row
    n = like.agg(F.count(F.lit(1)).alias("__waiting"))
    due = (now_ms - F.col("o.submitted_ms") >= wait_ms) | (F.col("__waiting") >= most)
    ready = like.join(F.broadcast(n)).where(due)
    # Only the first `most` can be taken; they are ranked by one task.
    top = ready.orderBy("submitted_ms", "request_id").limit(most)
    w = Window.partitionBy("compatibility_key").orderBy("submitted_ms", "request_id")
    size = lambda c: F.sum(F.greatest(F.lit(1), F.col(c)).cast("long")).over(w)
    fits = (F.row_number().over(w) == 1) | ((size("pixel_count") <= pixels) & (size("memory_bytes") <= memory))
    kept = top.withColumn("__fits", fits).withColumn("__ok", F.min(F.col("__fits").cast("int")).over(w))
    return kept.where("__ok = 1").select(requests.columns)


def stalls(events: DataFrame, max_retries: int = 3, same: int = 2) -> DataFrame:
    """Adds retry: whether a stalled or crashed task may run again after each event.

    events: task_id, seq, signature. Fewer than max_retries so far, and the same
    signature fewer than `same` times in a row.
    """
    w = Window.partitionBy("task_id").orderBy("seq")
    new = F.coalesce(F.lag("signature").over(w) != F.col("signature"), F.lit(True)).cast("int")
    rows = events.withColumn("__run", F.sum(new).over(w)).withColumn("attempt", F.row_number().over(w))
    rows = rows.withColumn("same_count", F.row_number().over(Window.partitionBy("task_id", "__run").orderBy("seq"))).drop("__run")
    return rows.withColumn("retry", (F.col("attempt") < max_retries) & (F.col("same_count") < same))


def attempts(rows: DataFrame, task: str, order: str) -> DataFrame:
    return rows.withColumn("attempt_no", F.row_number().over(Window.partitionBy(task).orderBy(order)))


def current(log: DataFrame, by: str = "task_id", order: str = "seq") -> DataFrame:
    """The latest state of each task of an append-only log."""
    rest = [c for c in log.columns if c not in (by, order)]
    return log.groupBy(by).agg(F.max_by(F.struct(order, *rest), order).alias("x")).select(by, "x.*")


def superseded(existing: DataFrame, created: DataFrame) -> DataFrame:
    """Existing tasks after `created` ones arrive: queued ones of the same file and unit are superseded."""
    new = created.select(F.col("file_id").alias("__f"), F.col("unit_key").alias("__u")).distinct()
    hit = F.col("__f").isNotNull() & (F.col("status") == "queued")
    both = existing.join(new, existing.file_id.eqNullSafe(F.col("__f")) & existing.unit_key.eqNullSafe(F.col("__u")), "left")
    return both.withColumn("status", F.when(hit, "superseded").otherwise(F.col("status"))).select(existing.columns).unionByName(created)


def recovered(tasks: DataFrame) -> DataFrame:
    """State after a crash: what ran is queued again, without an owner."""
    ran = F.col("status").isin("running", "spooled")
    return tasks.withColumns({"status": F.when(ran, "queued").otherwise(F.col("status")), "lease_owner": F.when(~ran, F.col("lease_owner"))})


def merged_pages(pages: DataFrame) -> DataFrame:
    """Blocks of documents whose pages are all confirmed, in page order and numbered anew.

    pages: parent, page_number, source_type, block_index, status, raw_text. Native
    text comes before OCR; a document with a failed or open page gives nothing.
    """
    ready = pages.groupBy("parent").agg(F.bool_and(F.col("status").isin("confirmed", "partial_success")).alias("ok"), F.bool_or(F.col("status") == "partial_success").alias("__partial")).where("ok").drop("ok")
    order = Window.partitionBy("parent").orderBy("page_number", F.when(F.col("source_type") == "ocr", 1).otherwise(0), "block_index")
    rows = pages.join(ready, "parent").withColumn("block_index", (F.row_number().over(order) - 1).cast("int"))
    return rows.withColumn("status", F.when(F.col("__partial"), "partial_success").otherwise("success")).drop("__partial")


# Cost units by extension, and seconds per unit by lane.
BASE_COST = {".txt": 1.0, ".log": 1.0, ".csv": 1.2, ".md": 1.0, ".json": 1.1, ".xml": 1.2, ".ini": 1.0, ".docx": 5.0, ".xlsx": 6.0, ".xlsm": 6.5, ".pptx": 5.5, ".pdf": 7.0, ".zip": 9.0, ".doc": 12.0, ".xls": 12.0, ".ppt": 12.0, ".jpg": 18.0, ".jpeg": 18.0, ".png": 18.0, ".bmp": 18.0, ".tif": 22.0, ".tiff": 22.0}
SECONDS_PER_COST = {"normal": 0.04, "pdf": 0.12, "office_process": 0.06, "legacy_word": 0.15, "legacy_excel": 0.15, "legacy_powerpoint": 0.15, "zip": 0.50, "ocr": 1.00}
LEGACY_LANES = {".doc": "legacy_word", ".xls": "legacy_excel", ".ppt": "legacy_powerpoint"}


def _case(column: Column, values: dict, other) -> Column:
    return reduce(lambda w, kv: w.when(column == kv[0], kv[1]), values.items(), F).otherwise(other)


def parse_cost(extension: Column, size: Column, relevant: Column) -> Column:
    mib, inner = F.greatest(F.lit(0), size) / 1048576.0, F.greatest(F.lit(0), relevant) / 1048576.0
    more = F.when(extension.isin(OFFICE_EXTENSIONS), inner * 2.0 + mib * 0.02).when(extension.isin(IMAGE_EXTENSIONS), mib * 4.0).when(extension.isin(list(LEGACY_LANES)), mib * 1.5).when(extension.isin(ARCHIVE_EXTENSIONS), inner * 1.2).when(extension == ".pdf", mib * 0.8)
    return _case(extension, BASE_COST, 0.5) + more.otherwise(mib * 0.25)


def memory_bytes(extension: Column, size: Column, relevant: Column) -> Column:
    n = F.greatest(F.lit(1), size, relevant).cast("long")
    cap = lambda gib, k: F.least(F.lit(gib << 30), n * k)
    return F.when(extension.isin(".xlsx", ".xlsm"), cap(2, 8)).when(extension.isin(IMAGE_EXTENSIONS), cap(1, 4)).when(extension == ".pdf", cap(1, 2)).otherwise(n)


def lane(extension: Column, ocr: bool = True) -> Column:
    out = F.when(F.lit(ocr) & extension.isin(IMAGE_EXTENSIONS), "ocr").when(extension.isin(ARCHIVE_EXTENSIONS), "zip")
    out = reduce(lambda w, kv: w.when(extension == kv[0], kv[1]), LEGACY_LANES.items(), out)
    return out.when(extension == ".pdf", "pdf").when(extension.isin(OFFICE_EXTENSIONS), "office_process").otherwise("normal")


def no_progress_timeout(lane_name: Column, phase: Column, seconds: dict[str, int], ocr: int) -> Column:
    base = _case(lane_name, seconds, seconds.get("normal", 60))
    return F.greatest(F.lit(1), F.when(F.lower(phase).contains("ocr"), F.greatest(base, F.lit(ocr))).otherwise(base))


# Factors of the search time model.
MODE_FACTOR = {"exact": 1.0, "phrase": 1.15, "all": 1.3, "any": 1.55, "regex": 3.8}


def search_baseline_ms(mode: Column, file_count: Column, scoped: Column, extension_filtered: Column, searches_content: Column, ocr_fuzzy: Column, case_sensitive: Column) -> Column:
    ms = (F.lit(180) + F.least(F.greatest(file_count, F.lit(0)), F.lit(1_000_000)) * 0.025) * _case(mode, MODE_FACTOR, 1.25)
    for test, factor in ((scoped, 0.72), (extension_filtered, 0.76), (~searches_content, 0.65), (ocr_fuzzy, 1.7), (case_sensitive, 1.12)):
        ms = ms * F.when(test, factor).otherwise(1.0)
    return F.least(F.greatest(ms, F.lit(140.0)), F.lit(120_000.0))


def search_estimates(samples: DataFrame, key: list[str], order: str = "seq") -> DataFrame:
    """lower_ms and upper_ms before each sample, from baseline_ms and the last 20 elapsed_ms of its key."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(-20, -1)
    n, seen = F.count("elapsed_ms").over(w), median(F.collect_list("elapsed_ms").over(w))
    rows = samples.withColumns({"n_samples": n, "__seen": seen})
    weight = F.least(F.lit(0.8), 0.45 + 0.08 * F.col("n_samples"))
    center = F.when(F.col("n_samples") > 0, F.col("baseline_ms") * (1 - weight) + F.col("__seen") * weight).otherwise(F.col("baseline_ms"))
    spread = F.when(F.col("n_samples") > 0, F.greatest(F.lit(0.22), 0.48 - 0.04 * F.least("n_samples", F.lit(6)))).otherwise(0.55)
    lower = F.greatest(F.lit(80), F.bround(center * (1 - spread)).cast("long"))
    return rows.withColumn("lower_ms", lower).withColumn("upper_ms", F.greatest(F.col("lower_ms") + 120, F.bround(center * (1 + spread)).cast("long"))).drop("__seen")


def choose_backend(trials: DataFrame, baseline: str, rss_budget: int) -> DataFrame:
    """Per backend: medians, speedup, rejection (null if it passes) and whether it is chosen.

    Rules in order: three runs, no error, offline, text and box digests equal to
    the baseline's only one, confidences within 0.02, memory, 20 % faster. A
    baseline that fails its own rules rejects all.
    """
    by = trials.groupBy("backend").agg(
        F.count(F.lit(1)).alias("runs"), F.bool_or(F.coalesce("error", F.lit("")) != "").alias("failed"), F.bool_and("offline").alias("offline"), F.min("elapsed_ms").alias("least_ms"), F.median("elapsed_ms").alias("median_ms"),
        F.collect_set(F.struct("text_digest", "box_digest")).alias("digests"), F.median("confidence_mean").alias("mean"), F.median("confidence_min").alias("low"), F.max("peak_rss_bytes").alias("rss"),
    )
    base = by.where(F.col("backend") == baseline).select(F.struct("*").alias("b"))
    x = by.join(F.broadcast(base))  # one row
    own = F.when(F.col("b.runs") < 3, "requires_three_runs").when(F.col("b.failed"), "baseline_backend_error").when(~F.col("b.offline"), "baseline_offline_gate_failed").when(F.col("b.least_ms") <= 0, "baseline_invalid_elapsed").when(F.size("b.digests") > 1, "baseline_accuracy_unstable").when(F.col("b.rss") > rss_budget, "baseline_rss_budget_exceeded")
    x = x.withColumn("speedup", (F.col("b.median_ms") - F.col("median_ms")) / F.col("b.median_ms"))
    rule = F.when(F.col("runs") < 3, "requires_three_runs").when(F.col("failed"), "backend_error").when(~F.col("offline"), "offline_gate_failed").when(F.col("digests") != F.col("b.digests"), "accuracy_digest_mismatch").when((F.col("mean") + 0.02 < F.col("b.mean")) | (F.col("low") + 0.02 < F.col("b.low")), "confidence_regression").when(F.col("rss") > rss_budget, "rss_budget_exceeded").when(F.col("speedup") < 0.20, "speedup_below_20_percent")
    x = x.withColumn("rejection", F.coalesce(own, F.when(F.col("backend") != baseline, rule)))
    best = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("rejection").isNotNull(), F.desc("speedup"), "backend"))
    return x.withColumn("chosen", (best == 1) & F.col("rejection").isNull()).select("backend", "runs", "median_ms", F.round("speedup", 6).alias("speedup"), "rejection", "chosen")
