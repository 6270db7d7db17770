"""Registered queries of indexed search, maintenance, work distribution, estimates and geometry, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars
from ..functions import text as tx
from ..operators import blocks, geometry, lifecycle, postings, recognition, reports, tasks
from ..query import SearchQuery, plan
from ..streaming import events
from . import views as v
from .catalog import _BLOCKS, _FILES, _VIDEO, FILES, _blocks, _found, hits, norm, query, search_sql
from .search import SearchEngine, candidates

# --- indexed search ----------------------------------------------------------


def _indexed(spark, d) -> SearchEngine:
    return SearchEngine(v.document_files(spark, d), v.stored_documents(spark, d), index=lambda: v.document_index(spark, d))


@query(search_sql("contains(n, 'inan')", ["inan"]))
def search_indexed_exact(spark, d):
    return _found(_indexed(spark, d), SearchQuery("inan"))


@query(search_sql("contains(n, 'on the') and contains(n, 'thing')", ["on the", "thing"]))
def search_indexed_all_terms(spark, d):
    return _found(_indexed(spark, d), SearchQuery('thing "on the"', mode="all"))


@query(search_sql("contains(n, 'licensed') or contains(n, 'mail6')", ["licensed", "mail6"]))
def search_indexed_any_term(spark, d):
    return _found(_indexed(spark, d), SearchQuery("licensed MAIL6", mode="any"))


@query(search_sql("contains(n, 'The than')", ["The than"], n=norm("text", lower=False), name=norm("filename", lower=False)))
def search_indexed_case_sensitive(spark, d):
    return _found(_indexed(spark, d), SearchQuery("The than", case_sensitive=True))


@query(search_sql("contains(n, 'ß')", ["ß"]))
def search_indexed_short_term(spark, d):
    """A term shorter than a trigram: the planner falls back to the scan."""
    return _found(_indexed(spark, d), SearchQuery("ß"))


@query(f"""with f as ({FILES}), n as (select *, {norm("text")} as n, {norm("filename")} as fn from f), u as (
    select file_id, {hits("fn", ["doc1"])} as h, 50 as adjust, 0 as rank, fn from n where contains(fn, 'doc1') union all select file_id, {hits("n", ["doc1"])}, 0, 1, fn from n where contains(n, 'doc1'))
    select file_id, cast(sum(h + adjust + case when fn = 'doc1' then 1000 when starts_with(fn, 'doc1') then 500 when contains(fn, 'doc1') then 250 else 0 end) as double) as score, cast(sum(greatest(h, 1)) as bigint) as hit_count from u group by file_id""")
def search_names_and_content(spark, d):
    engine = SearchEngine(v.document_files(spark, d), v.document_blocks(spark, d))
    return engine.results(SearchQuery("doc1", search_filename=True)).select("file_id", "score", "hit_count")


@query(f"select count(*) as n_candidates from (select {norm('text')} as n from documents) where contains(n, 'the')")
def count_candidates(spark, d):
    p = plan(SearchQuery("the"))
    return candidates(p, v.document_blocks(spark, d), v.document_files(spark, d)).agg(F.count(F.lit(1)).alias("n_candidates"))


_PLANNED = [
    (SearchQuery(' "a b" '), "a b", "postings", True, False, False),
    (SearchQuery("“一 二 三四”", mode="phrase"), "一二三四", "scan", True, False, False),
    (SearchQuery('x "on the" thing', mode="all"), "on the|x|thing", "contains", True, False, False),
    (SearchQuery("one two", mode="any", search_content=False, search_path=True), "one|two", "postings", False, False, True),
    (SearchQuery("a.*b", mode="regex"), "a.*b", "scan", True, False, False),
    (SearchQuery("Two  Words", mode="filename", search_path=True), "two|words", "postings", False, True, True),
    (SearchQuery("ＡＢＣ-Ｄ", ignore_hyphens=True), "abcd", "scan", True, False, False),
    (SearchQuery("KEEP Case", case_sensitive=True, search_content=False), "KEEP Case", "postings", True, False, False),
    (SearchQuery("   "), "", "postings", True, False, False),
]


@query("select * from (values " + ", ".join(f"({i}, '{t}', '{s}', {c}, {f}, {p})" for i, (_, t, s, c, f, p) in enumerate(_PLANNED)) + ") as x(i, terms, strategy, content, filename, path)")
def query_plans(spark, d):
    plans = [plan(q) for q, *_ in _PLANNED]
    return spark.createDataFrame([(i, "|".join(p.terms), p.strategy, p.content, p.filename, p.path) for i, p in enumerate(plans)], "i int, terms string, strategy string, content boolean, filename boolean, path boolean")


@query("""with b as (select conv_id as file_id, count(*) as n from conversations where contains(lower(text), 'than') group by conv_id)
    select file_id, least(n, 3) as n_shown, greatest(0, n - 3) as n_hidden from b""")
def shown_matches(spark, d):
    rows = v.read(spark, d, "conversations").where(F.lower("text").contains("than")).groupBy(F.col("conv_id").alias("file_id")).agg(F.array_sort(F.collect_list("turn")).alias("matches"))
    return reports.shown_matches(rows).select("file_id", F.size("matches").cast("long").alias("n_shown"), F.col("n_hidden").cast("long").alias("n_hidden"))


@query("select doc_id, lower(regexp_replace(substr(text, 1, 200), '[^\\p{L}\\p{M}\\p{N}\\p{Pc}]+|_+', '', 'g')) as k from documents")
def dedupe_keys(spark, d):
    return v.read(spark, d, "documents").select("doc_id", tx.dedupe_key(F.substring("text", 1, 200)).alias("k"))


@query("select item_id, doc_id from (select item_id, substr(text, 1, 1 + item_id % 4) as s from benchmark) b join documents d on contains(d.text, s)")
def short_needles(spark, d):
    """Needles of one to four characters: shorter than a gram too."""
    needles = v.read(spark, d, "benchmark").select("item_id", F.substring("text", F.lit(1), (1 + F.col("item_id") % 4).cast("int")).alias("s"))
    return postings.contained(needles, "item_id", "s", v.read(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


# --- blocks, documents and files as they change ------------------------------


@query("select conv_id as document_id, count(*) as block_count, cast(sum(length(text)) as bigint) as text_chars from conversations group by conv_id")
def document_counts(spark, d):
    return lifecycle.document_counts(v.conversation_blocks(spark, d).withColumn("document_id", F.col("file_id")))


@query("select l_partkey, l_linenumber as block_index, count(*) as count from lineitem group by all having count(*) > 1")
def duplicate_indexes(spark, d):
    return blocks.duplicate_indexes(v.read(spark, d, "lineitem").withColumnRenamed("l_linenumber", "block_index"), "l_partkey")


@query(f"with {_FILES} select file_id, parse_status, size_bytes from f where file_id % 3 > 0 union all select file_id, 'pending', size_bytes + 1 from f where file_id % 3 = 0 union all select file_id + 1000000, 'pending', size_bytes from f where file_id % 7 = 0")
def upserted_files(spark, d):
    cols = ["file_id", "parse_status", "size_bytes"]
    files = v.registry_files(spark, d).select(cols)
    again = files.where("file_id % 3 = 0").select("file_id", F.lit("pending").alias("parse_status"), F.col("size_bytes") + 1)
    new = files.where("file_id % 7 = 0").select(F.col("file_id") + 1000000, F.lit("pending").alias("parse_status"), "size_bytes")
    return lifecycle.upserted(files, again.toDF(*cols).unionByName(new.toDF(*cols)), ["file_id"])


@query(f"with {_FILES}, {_BLOCKS} select block_id, document_id from b where document_id is null or document_id % 5 > 0 union all select -block_id, document_id from b where document_id % 5 = 0 and block_id % 2 = 0 union all select block_id, document_id from b where document_id % 5 = 0 and document_id not in (select document_id from b where document_id % 5 = 0 and block_id % 2 = 0)")
def replaced_blocks(spark, d):
    old = _blocks(spark, d).select("block_id", "document_id")
    new = old.where("document_id % 5 = 0 and block_id % 2 = 0").select((-F.col("block_id")).alias("block_id"), "document_id")
    return lifecycle.replaced_blocks(old, new)


@query(f"""with {_FILES}, g as (select file_id from f where not is_deleted and container_file_id is null and file_id % 9 = 0 union all select file_id from f where not is_deleted and container_file_id in (select file_id from f where not is_deleted and container_file_id is null and file_id % 9 = 0))
    select f.file_id, case when g.file_id is null then parse_status else 'deleted' end as parse_status, is_deleted or g.file_id is not null as is_deleted from f left join g on g.file_id = f.file_id""")
def marked_deleted(spark, d):
    files = v.registry_files(spark, d)
    gone = lifecycle.deleted_files(files, files.where("file_id % 9 <> 0"))
    return lifecycle.marked_deleted(files, gone).select("file_id", "parse_status", "is_deleted")


@query(f"with {_FILES} select distinct document_id from m where document_id is not null")
def referenced_documents(spark, d):
    docs = v.read(spark, d, "orders").select(F.floor(F.col("o_custkey") / 4).alias("document_id")).distinct().unionByName(v.registry_files(spark, d).select("document_id").where("document_id is not null")).distinct()
    return lifecycle.referenced_documents(docs, v.registry_files(spark, d))


@query(f"with {_FILES}, c as (select document_id as d, min(file_id) as own from m where document_id is not null group by 1), {_BLOCKS} select block_id, coalesce(own, file_id) as file_id from b left join c on c.d = b.document_id")
def reassigned_blocks(spark, d):
    return lifecycle.reassigned(_blocks(spark, d), v.registry_files(spark, d)).select("block_id", "file_id")


@query(f"""with {_FILES} select file_id, case when file_id % 6 = 1 then 'success' when file_id % 6 = 2 then 'metadata_only' else parse_status end as parse_status, case when file_id % 6 in (1, 2) then file_id % 6 + 500 else document_id end as document_id from f""")
def linked_files(spark, d):
    key = F.concat(F.lit("k"), (F.col("file_id") % 6).cast("string"))
    files = v.registry_files(spark, d).withColumns({"content_key": key, "parser_name": F.lit("p")})
    docs = spark.createDataFrame([("k1", "p", "1", 501, "success"), ("k2", "p", "1", 502, "metadata_only"), ("k3", "p", "1", 503, "failed"), ("k4", "p", "2", 504, "success")], "content_key string, parser_name string, parser_version string, document_id long, parse_status string")
    return lifecycle.linked(files, docs).select("file_id", "parse_status", "document_id")


@query(f"""with {_FILES}, k as (select file_id, path, container_file_id, parse_status, is_deleted from f), n as (select file_id, path, container_file_id, 'pending' as parse_status, false as is_deleted from f where container_file_id is not null and file_id % 100 = 7 union all select -file_id, path || '!', file_id, 'pending', false from f where file_id % 100 = 0),
    a as (select distinct container_file_id as c from n), u as (select * from k where path not in (select path from n) union all select * from n)
    select file_id, case when file_id in (select c from a) then 'success' when container_file_id in (select c from a) and path not in (select path from n) then 'deleted' else parse_status end as parse_status,
        is_deleted or coalesce(container_file_id in (select c from a) and path not in (select path from n), false) as is_deleted from u""")
def synced_members(spark, d):
    cols = ["file_id", "path", "container_file_id", "parse_status", "is_deleted", "parser_name"]
    files = v.registry_files(spark, d).withColumn("parser_name", F.lit("")).select(cols)
    listed = files.where("container_file_id is not null and file_id % 100 = 7").select("file_id", "path", "container_file_id", F.lit("pending"), F.lit(False), F.lit("")).toDF(*cols)
    new = files.where("file_id % 100 = 0").select(-F.col("file_id"), F.concat("path", F.lit("!")), "file_id", F.lit("pending"), F.lit(False), F.lit("")).toDF(*cols)
    return lifecycle.synced_members(files, listed.unionByName(new)).select("file_id", "parse_status", "is_deleted")


@query(f"""with {_FILES}, h as (select coalesce(container_file_id, file_id) as h from f where path in ('Customer#000000007', 'Customer#000000057', 'Customer#000000100'))
    select file_id, case when file_id in (select h from h) then 'pending' else parse_status end as parse_status, case when file_id not in (select h from h) then quick_fingerprint end as quick_fingerprint from f""")
def invalidated_files(spark, d):
    return lifecycle.invalidated(v.registry_files(spark, d), ["Customer#000000007", "Customer#000000057", "Customer#000000100"]).select("file_id", "parse_status", "quick_fingerprint")


@query(f"with {_FILES} select file_id, case when extension in {_VIDEO} then 'metadata_only' else parse_status end as parse_status from f")
def video_excluded(spark, d):
    return lifecycle.video_excluded(v.registry_files(spark, d)).select("file_id", "parse_status")


@query("select c_custkey as file_id, c_custkey % 34 = 0 or c_custkey in (17, 51, 85) as revoked from customer where c_custkey % 17 = 0")
def restored_exclusions(spark, d):
    out = lifecycle.restored(v.registry_exclusions(spark, d), [17, 34, 51, 85], F.timestamp_seconds(F.lit(1000)))
    return out.select("file_id", F.col("revoked_at").isNotNull().alias("revoked"))


@query("select c_custkey as file_id, c_custkey % 34 <> 0 and c_custkey % 3 = 0 as ended from customer where c_custkey % 17 = 0")
def exclusions_closed_by_change(spark, d):
    changed = v.registry_files(spark, d).where("file_id % 3 = 0")
    out = lifecycle.closed_by_change(v.registry_exclusions(spark, d), changed, F.timestamp_seconds(F.lit(1000)))
    return out.select("file_id", F.col("invalidated_at").isNotNull().alias("ended"))


@query("select n_name as path, n_nationkey % 5 <> 4 or n_name in ('NATION_4', 'NATION_6') as enabled, case when n_name in ('NATION_4', 'NATION_6') then 'pending' when n_nationkey % 3 = 0 then 'incomplete' else 'ready' end as status from nation union all select 'new root', true, 'pending'")
def added_roots(spark, d):
    return lifecycle.added_roots(v.roots(spark, d), ["NATION_4", "NATION_6", "new root"]).select("path", "enabled", "status")


@query(f"""with {_FILES}, l as (select * from f where root_id <> 3), c as (select document_id as d, min(file_id) as own from l where not is_deleted and document_id is not null group by 1), {_BLOCKS}
    select block_id, file_id from b where document_id is null and file_id in (select file_id from l) union all select block_id, own from b join c on c.d = b.document_id""")
def without_root(spark, d):
    files = v.registry_files(spark, d)
    docs = files.select("document_id").where("document_id is not null").distinct()
    return lifecycle.without_root(files, docs, _blocks(spark, d), 3)["blocks"].select("block_id", "file_id")


@query(f"""with {_FILES}, {_BLOCKS}, d as (select distinct o_custkey // 5 as document_id from orders), c as (select distinct document_id from m where document_id is not null)
    select 'blocks_without_file' as "check", (select count(*) from b where document_id is null and file_id not in (select file_id from f)) as n_bad
    union all select 'blocks_without_document', (select count(*) from b where document_id is not null and document_id not in (select document_id from d))
    union all select 'files_without_document', (select count(*) from f where document_id is not null and document_id not in (select document_id from d))
    union all select 'orphan_documents', (select count(*) from d where document_id not in (select document_id from c))
    union all select 'duplicate_blocks', (select count(*) from (select coalesce(document_id, -file_id) as k, block_id % 8 as i from b group by all having count(*) > 1))
    union all select 'blocks_without_normal_text', (select count(*) from b where block_id % 97 = 0)""")
def integrity(spark, d):
    rows = _blocks(spark, d).withColumns({"block_index": F.col("block_id") % 8, "normalized_text": F.when(F.col("block_id") % 97 != 0, "x")})
    docs = v.read(spark, d, "orders").select(F.floor(F.col("o_custkey") / 5).alias("document_id")).distinct()
    return lifecycle.integrity(v.registry_files(spark, d), docs, rows)


@query(f"""with {_FILES}, busy as (select distinct file_id from t where status = 'running' and file_id % 2 = 0), w as (select file_id, parse_status from m where not video and not excluded and parse_status not in ('success', 'metadata_only'))
    select w.file_id from w left join busy on busy.file_id = w.file_id where busy.file_id is null and parse_status in ('failed', 'failed_retryable', 'unsupported', 'skipped', 'ocr_disabled', 'ocr_failed', 'converter_missing', 'partial_success', 'password_protected')""")
def forced_complete(spark, d):
    off = v.registry_exclusions(spark, d)
    jobs = v.tasks(spark, d).where("file_id % 2 = 0")
    out, _ = lifecycle.forced_complete(v.registry_files(spark, d), jobs, off, "forced", F.timestamp_seconds(F.lit(0)))
    return out.where("reason = 'forced'").select("file_id")


# --- work --------------------------------------------------------------------


@query(f"with {_FILES} select task_id from t where status = 'queued' or (status = 'running' and task_id % 100 <= 50)")
def claimable_tasks(spark, d):
    rows = v.tasks(spark, d).withColumn("lease_expires_at", F.timestamp_seconds(F.col("task_id") % 100))
    return tasks.claimable(rows, F.timestamp_seconds(F.lit(50))).select("task_id")


@query(f"with {_FILES} select task_id, case when status = 'running' and task_id % 2 = task_id % 3 and task_id % 5 > 0 then 'confirmed' else status end as status, case when status = 'running' and task_id % 2 = task_id % 3 and task_id % 5 > 0 then 'd' || task_id end as result_digest from t")
def confirmed_tasks(spark, d):
    owner = lambda k: F.concat(F.lit("w"), (F.col("task_id") % k).cast("string"))
    rows = v.tasks(spark, d).withColumns({"lease_owner": owner(2), "result_digest": F.lit(None).cast("string")})
    said = rows.select("task_id", owner(3).alias("lease_owner"), F.when(F.col("task_id") % 5 > 0, F.concat(F.lit("d"), F.col("task_id").cast("string"))).otherwise("").alias("result_digest"))
    return tasks.confirm(rows, said).select("task_id", "status", "result_digest")


@query(f"with {_FILES} select task_id, case when status = 'running' then 'queued' else status end as status, case when status <> 'running' then 'w' end as lease_owner from t")
def recovered_tasks(spark, d):
    return tasks.recovered(v.tasks(spark, d).withColumn("lease_owner", F.lit("w"))).select("task_id", "status", "lease_owner")


@query(f"with {_FILES} select task_id, case when status = 'queued' and file_id % 4 = 0 and priority = 1 then 'superseded' else status end as status from t union all select -file_id, 'queued' from f where file_id % 4 = 0")
def superseded_tasks(spark, d):
    rows = v.tasks(spark, d).select("task_id", "file_id", F.col("priority").cast("string").alias("unit_key"), "status")
    new = v.registry_files(spark, d).where("file_id % 4 = 0").select((-F.col("file_id")).cast("long").alias("task_id"), F.col("file_id").cast("long").alias("file_id"), F.lit("1").alias("unit_key"), F.lit("queued").alias("status"))
    return tasks.superseded(rows, new).select("task_id", "status")


@query("select user_id as task_id, max(event_id) as seq, arg_max(event_type, event_id) as status from events group by user_id")
def current_states(spark, d):
    return tasks.current(v.read(spark, d, "events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("status")))


@query(f"""with {_FILES}, j as (select file_id, extension as lane, root_id, size_bytes, path, row_number() over (partition by extension, root_id order by file_id % 5, file_id % 2 = 0, size_bytes desc, lower(path)) as r, lower(max(path) over (partition by extension, root_id)) as l from f)
    select file_id, row_number() over (partition by lane order by r, l, root_id) as lane_order from j""")
def fair_job_order(spark, d):
    k = F.col("file_id")
    jobs = v.registry_files(spark, d).select("file_id", F.col("extension").alias("lane"), F.col("root_id").alias("source"), (k % 5).alias("page"), (k % 2 == 0).alias("is_ocr"), F.col("size_bytes").alias("cost"), "path")
    return tasks.fair_order(jobs).select("file_id", F.col("lane_order").cast("long").alias("lane_order"))


@query(f"with {_FILES} select extension as lane, cast(sum(size_bytes) as bigint) as cost, count(*) as n_jobs from f group by 1")
def lane_costs(spark, d):
    return tasks.lane_costs(v.registry_files(spark, d).select(F.col("extension").alias("lane"), F.col("size_bytes").alias("cost")))


@query("""with recursive e as (select user_id, event_id, greatest(1, cast(floor(value) as bigint)) as px, row_number() over (partition by user_id order by event_id) as r from events),
    f as (select user_id, event_id, r, 0 as b, 1 as n, px as used from e where r = 1 union all
        select e.user_id, e.event_id, e.r, case when full_up then f.b + 1 else f.b end, case when full_up then 1 else f.n + 1 end, case when full_up then e.px else f.used + e.px end
        from f join e on e.user_id = f.user_id and e.r = f.r + 1, lateral (select f.used + e.px > 90 or f.n >= 3 as full_up))
    select user_id, event_id, b as batch from f""")
def ordered_batches(spark, d):
    rows = v.read(spark, d, "events").select("user_id", "event_id", F.floor("value").alias("pixels"))
    return tasks.batches(rows, "user_id", "event_id", {"pixels": 90}, 3).select("user_id", "event_id", "batch")


@query("""with s as (select user_id, event_id, median(value * 1000e0) over w as seen, count(*) over w as n from events window w as (partition by user_id order by event_id rows between 20 preceding and 1 preceding)),
    c as (select *, least(0.8e0, 0.45e0 + 0.08e0 * n) as weight from s), e as (select *, case when n > 0 then 5000e0 * (1 - weight) + seen * weight else 5000e0 end as center, case when n > 0 then greatest(0.22e0, 0.48e0 - 0.04e0 * least(n, 6)) else 0.55e0 end as spread from c),
    l as (select *, greatest(80, cast(round_even(center * (1 - spread), 0) as bigint)) as lower_ms from e)
    select user_id, event_id, n as n_samples, lower_ms, greatest(lower_ms + 120, cast(round_even(center * (1 + spread), 0) as bigint)) as upper_ms from l""")
def search_estimates(spark, d):
    rows = v.read(spark, d, "events").select("user_id", "event_id", (F.col("value") * 1000).alias("elapsed_ms"), F.lit(5000.0).alias("baseline_ms"))
    return tasks.search_estimates(rows, ["user_id"], "event_id").select("user_id", "event_id", "n_samples", "lower_ms", "upper_ms")


_TRIALS = [("base", 100, "t", 0.95), ("fast", 60, "t", 0.94), ("slow", 95, "t", 0.95), ("wrong", 50, "u", 0.95), ("unsure", 50, "t", 0.90), ("few", 50, "t", 0.95)]


@query("select * from (values ('base', 3, 100.0, cast(null as varchar), false), ('fast', 3, 60.0, null, true), ('slow', 3, 95.0, 'speedup_below_20_percent', false), ('wrong', 3, 50.0, 'accuracy_digest_mismatch', false), ('unsure', 3, 50.0, 'confidence_regression', false), ('few', 2, 50.0, 'requires_three_runs', false)) as x(backend, runs, median_ms, rejection, chosen)")
def chosen_backend(spark, d):
    rows = [(b, None, True, ms + (k - 1 if b != "few" else 0), text, "b", conf, conf, 1000) for b, ms, text, conf in _TRIALS for k in range(2 if b == "few" else 3)]
    trials = spark.createDataFrame(rows, "backend string, error string, offline boolean, elapsed_ms int, text_digest string, box_digest string, confidence_mean double, confidence_min double, peak_rss_bytes long")
    return tasks.choose_backend(trials, "base", 2000).drop("speedup")


@query("select l_orderkey, l_linenumber, case l_linenumber % 4 when 0 then greatest(1, case when l_returnflag = 'R' then 300 else 120 end) when 1 then case when l_returnflag = 'R' then 300 else 60 end when 2 then case when l_returnflag = 'R' then 600 else 600 end else case when l_returnflag = 'R' then 300 else 60 end end as seconds from lineitem")
def no_progress_timeouts(spark, d):
    lane = F.element_at(F.array(*map(F.lit, ["pdf", "normal", "zip", "other"])), (F.col("l_linenumber") % 4 + 1).cast("int"))
    phase = F.when(F.col("l_returnflag") == "R", "page OCR").otherwise("read")
    return v.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", tasks.no_progress_timeout(lane, phase, {"normal": 60, "pdf": 120, "zip": 600}, 300).alias("seconds"))


# --- reports -----------------------------------------------------------------


@query("select o_orderkey, o_totalprice as parse_ms, c_name as path from orders join customer on c_custkey = o_custkey order by parse_ms desc, o_custkey limit 20")
def slowest_files(spark, d):
    metrics = v.read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("file_id"), F.col("o_totalprice").alias("parse_ms"))
    return reports.slowest(metrics, v.registry_files(spark, d)).select("o_orderkey", "parse_ms", "path")


@query("select cast(sum(o_orderkey) as bigint) as n_files, cast(sum(o_custkey) as bigint) as n_blocks, max(o_orderkey) as peak_rss_bytes, bool_or(o_orderstatus = 'P') as cancelled from orders")
def run_totals(spark, d):
    rows = v.read(spark, d, "orders").select(F.col("o_orderkey").alias("n_files"), F.col("o_custkey").alias("n_blocks"), F.col("o_orderkey").alias("peak_rss_bytes"), (F.col("o_orderstatus") == "P").alias("cancelled"))
    return reports.run_totals(rows, ["n_files", "n_blocks"])


@query(f"with {_FILES} select file_id, path from m where not excluded and parse_status in ('failed', 'ocr_failed') and extension in ('.pdf', '.txt')")
def failed_by_status_and_extension(spark, d):
    bad = reports.failed_files(v.registry_files(spark, d), v.tasks(spark, d), v.registry_exclusions(spark, d), None)
    return bad.where(F.col("parse_status").isin("failed", "ocr_failed") & F.col("extension").isin(".pdf", ".txt")).select("file_id", "path")


_CODES = ["FILE_IN_USE", "IO_ERROR", "OUT_OF_MEMORY", "SOURCE_CHANGED_DURING_HASH", "PERMISSION_DENIED", "ZIP_CORRUPT", "PARSE_NO_PROGRESS"]


@query("select l_linenumber, count(*) as n, l_linenumber % 7 in (0, 1, 2, 3, 6) as retryable from lineitem group by l_linenumber")
def retry_classes(spark, d):
    code = F.element_at(F.array(*map(F.lit, _CODES)), (F.col("l_linenumber") % 7 + 1).cast("int"))
    return v.read(spark, d, "lineitem").groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n")).withColumn("retryable", scalars.retryable(code))


@query("select l_orderkey, l_linenumber, case when l_returnflag = 'R' then 'network' when l_linestatus = 'F' then 'hdd' else 'unknown' end as slowest from lineitem")
def slowest_disks(spark, d):
    kinds = F.array(F.lit("SSD"), F.when(F.col("l_returnflag") == "R", "Network").when(F.col("l_linestatus") == "F", "hdd"), F.lit("ssd"))
    return v.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scalars.slowest_disk(kinds).alias("slowest"))


@query("select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_suppkey, l_returnflag = 'R', l_linenumber) as place from lineitem")
def page_order(spark, d):
    keys = scalars.page_key(F.concat(F.lit("page:"), F.col("l_suppkey").cast("string")), F.when(F.col("l_returnflag") == "R", "pdf_ocr_page").otherwise("pdf_native_page"))
    w = Window.partitionBy("l_orderkey").orderBy(*keys, "l_linenumber")
    return v.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(w).cast("long").alias("place"))


@query("select doc_id, sha256(concat_ws('|', doc_id, '612.0', '792.5', n_chars, sha256(text))) as identity from documents")
def page_identities(spark, d):
    one = scalars.page_identity(F.col("doc_id"), F.lit(612.0), F.lit(792.5), F.col("n_chars"), F.col("text"))
    return v.read(spark, d, "documents").select("doc_id", one.alias("identity"))


@query("select event_id as seq, concat_ws('|', case when event_type = 'error' then '' else event_type end, 'page ' || event_id % 50, cast(floor(value) as bigint), cast(floor(value) as bigint) * 10, cast(floor(value) as bigint) % 3, 0) as signature from events")
def progress_signatures(spark, d):
    return v.progress_events(spark, d).select("seq", events.progress_signature().alias("signature"))


# --- estimates and control ---------------------------------------------------


@query("""with s as (select user_id, event_id as pos, cast(floor(value * 10) as bigint) as shown, cast(event_id % 1000 as bigint) as actual from events), j as (select *, shown - lag(shown) over w as jump, lag(shown) over w as before, case when actual > 0 then abs(shown - actual) / cast(actual as double) else 0 end as error from s window w as (partition by user_id order by pos))
    select user_id, round(median(error), 6) as median_error, round(median(error) filter (actual <= 600), 6) as final_error, count(*) filter (abs(jump) > greatest(30, floor(before * 0.25))) as jumps, greatest(0, max(jump)) as largest_up, abs(least(0, min(jump))) as largest_down from j group by user_id""")
def eta_errors(spark, d):
    rows = v.read(spark, d, "events").select("user_id", F.col("event_id").alias("at"), F.floor(F.col("value") * 10).alias("shown"), (F.col("event_id") % 1000).alias("actual"))
    out = events.eta_errors(rows, "user_id")
    return out.withColumns({"median_error": F.round("median_error", 6), "final_error": F.round("final_error", 6)})


@query("""select user_id as "at", round(max(cost * 0.5e0 / greatest(1, workers)), 6) as seconds from (select user_id, event_type, sum(floor(value)) as cost, count(*) % 4 as workers from events group by all) where cost > 0 group by user_id""")
def critical_path(spark, d):
    rows = v.read(spark, d, "events").groupBy(F.col("user_id").alias("at"), F.col("event_type").alias("lane")).agg(F.sum(F.floor("value")).alias("cost"), (F.count(F.lit(1)) % 4).alias("workers")).withColumn("rate", F.lit(0.5))
    return events.critical_path(rows).withColumn("seconds", F.round("seconds", 6))


@query("select event_id as run_id, event_id % 4 = 0 and event_id % 3 > 0 and event_type <> 'view' and event_id % 7 <> 1 as safely_paused, case when event_type = 'view' then 1 else 0 end as n_missing from events")
def safe_pauses(spark, d):
    k = F.col("event_id")
    rows = v.read(spark, d, "events").select(k.alias("run_id"), (k % 4).alias("active"), (k % 3 > 0).alias("writer_idle"), F.when(k % 7 == 1, 1).otherwise(0).alias("owned_processes"), F.array(F.lit("a"), F.lit("b")).alias("required"), F.when(F.col("event_type") == "view", F.array(F.lit("a"))).otherwise(F.array(F.lit("b"), F.lit("a"))).alias("received"))
    return events.safely_paused(rows)


@query("""select event_id, case when event_id % 100 >= 90 then 'memory_pressure' when value >= 90 then 'cpu_pressure' when event_id % 7 = 0 then 'io_pressure' when event_id % 11 = 0 then 'recovery_cooldown' when value < 55 and event_id % 100 < 70 and event_id % 3 > 0 then 'underutilized' else 'stable' end as state from events""")
def pressure_states(spark, d):
    k, x = F.col("event_id"), F.col("value")
    rows = v.read(spark, d, "events").select("event_id", (k % 100).alias("app_rss_bytes"), F.lit(2 << 30).alias("memory_available_bytes"), x.alias("total_cpu_percent"), F.lit(1.0).alias("app_cpu_percent"), F.when(k % 7 == 0, 95.0).otherwise(10.0).alias("disk_busy_percent"), F.lit(1.0).alias("network_read_latency_ms"), F.when(k % 11 == 0, 0.5).otherwise(0.0).alias("worker_failure_rate"), F.lit(0).alias("writer_queue_depth"), (k % 3).alias("queue_depth"), F.lit(0).alias("active_tasks"))
    return rows.select("event_id", events.pressure(100).alias("state"))


# --- geometry and recognition ------------------------------------------------


@query("select p_partkey, cast(round_even(p_size * 2.0 / greatest(8.0, (10 + p_partkey % 13) * 0.6), 0) as integer) as line from part")
def reading_rows(spark, d):
    k, y = F.col("p_partkey"), F.col("p_size") * 2.0
    box = F.struct(F.lit(0.0).alias("x1"), y.alias("y1"), F.lit(9.0).alias("x2"), (y + 10 + k % 13).alias("y2"))
    return v.read(spark, d, "part").select("p_partkey", geometry.reading_row(box).alias("line"))


@query("""select p_partkey, case when p_size % 5 = 0 then p_size % 2 = 0 else p_partkey % 100 < 78 or p_size % 10 > 3 or p_size < greatest(8, (p_partkey % 30) * 2) or (p_size % 2 = 0 and p_partkey % 4 >= 2 and p_size < 40) end as tiles,
    case when p_partkey % 30 = 0 or p_size <= 0 then 'no_region_text' when p_partkey % 100 < 60 then 'low_average_confidence' when p_size % 10 > 3 then 'too_many_low_confidence_regions' when p_size < greatest(4, (p_partkey % 30) * 2) then 'insufficient_characters' else '' end as reason from part""")
def recognition_fallbacks(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    mean, low, n = (k % 100) / 100.0, (s % 10) / 10.0, k % 30
    tiles = geometry.needs_tiles(s % 5, mean, low, s, n, s % 2 == 0, (k % 4).cast("double"))
    return v.read(spark, d, "part").select("p_partkey", tiles.alias("tiles"), recognition.fallback_reason(n, s, mean, low).alias("reason"))


@query("select p_partkey from part where p_size % 3 = 1 and p_size % 2 = 1 and p_partkey % 7 > 0 and p_partkey % 100 >= 95")
def single_image_pages(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    pages = v.read(spark, d, "part").select("p_partkey", (s % 3).alias("n_images"), (s % 2).alias("n_placements"), (k % 7 == 0).alias("masked"), ((k % 100) / 100.0).alias("overlap"))
    return recognition.single_image_page(pages).select("p_partkey")


@query("select p_partkey as crop_id, case when p_size % 3 = 0 then 'cached ' else 'read ' end || p_size || case when p_size % 3 > 0 then ' ' || first else '' end as lines from (select *, min(p_partkey) over (partition by p_size) as first from part)")
def recognised_crops(spark, d):
    """Each distinct crop is read once; the reader's answer tells which crop it saw."""
    crops = v.read(spark, d, "part").select(F.col("p_partkey").alias("crop_id"), F.col("p_size").cast("string").alias("key"))
    cache = crops.where("key % 3 = 0").select("key", F.concat(F.lit("cached "), "key").alias("lines")).distinct()
    one = crops.groupBy("key").agg(F.min("crop_id").alias("first"))
    read = lambda new: new.select("key").join(one, "key").select("key", F.concat_ws(" ", F.lit("read"), "key", F.col("first").cast("string")).alias("lines"))
    return recognition.recognised(crops, cache, read).select("crop_id", "lines")


@query("select p_partkey, 0.0 as x1, p_size * 50.0 as y1 from part union all select p_partkey, cast(p_partkey % 9 as double), p_size * 50.0 from part where (100.0 - p_partkey % 9) / (100.0 + p_partkey % 9) < 0.92")
def distinct_boxes(spark, d):
    """Two boxes of equal size an image, apart by up to eight of a hundred: near-equal ones go."""
    k, y = F.col("p_partkey"), F.col("p_size") * 50.0
    box = lambda dx: v.read(spark, d, "part").select("p_partkey", dx.cast("double").alias("x1"), y.alias("y1"), (dx + 100).cast("double").alias("x2"), (y + 10).alias("y2"))
    return geometry.distinct_boxes(box(F.lit(0)).unionByName(box(k % 9)), "p_partkey").select("p_partkey", "x1", "y1")


@query("""with i as (select p_partkey, (100.0 - p_partkey % 90) / (100.0 + p_partkey % 90) >= 0.30 as same from part) select p_partkey, 'region ' || p_partkey as text from i where not same or p_partkey % 2 = 0
    union all select p_partkey, 'Region-' || p_partkey || '!' from i where not same or p_partkey % 2 = 1""")
def merged_lines(spark, d):
    """Two readings of one line an image: where they overlap enough, the surer one stays."""
    k = F.col("p_partkey")
    line = lambda text, conf, dx: v.read(spark, d, "part").select("p_partkey", text.alias("text"), conf.alias("confidence"), dx.cast("double").alias("x1"), F.lit(0.0).alias("y1"), (dx + 100).cast("double").alias("x2"), F.lit(10.0).alias("y2"))
    name = k.cast("string")
    a = line(F.concat(F.lit("region "), name), F.lit(0.8), F.lit(0))
    b = line(F.concat(F.lit("Region-"), name, F.lit("!")), F.when(k % 2 == 1, 0.9).otherwise(0.7), k % 90)
    return geometry.merged_lines(a.unionByName(b), "p_partkey").select("p_partkey", "text")
