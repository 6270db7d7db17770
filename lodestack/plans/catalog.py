"""All registered queries of the search engine and their SQL.

Each entry runs the engine's operators over the driver's tables (see views); the
SQL states the same result independently.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions import text as tx
from ..operators import blocks, geometry, lifecycle, postings, recognition, reports, tasks
from ..query import SearchQuery, plan
from ..schemas import VIDEO_EXTENSIONS
from ..sources import parsers
from ..streaming import events
from . import views as v
from .search import SearchEngine, of_files, page

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


# --- SQL parts ---------------------------------------------------------------

SPACE = r"[\s\p{Z}\x{85}\x0B]+"


def norm(x: str, spaces: str = " ", hyphens: bool = False, lower: bool = True) -> str:
    x = rf"regexp_replace(regexp_replace({x}, '\r\n?', chr(10), 'g'), '[\x{{200B}}\x{{200C}}\x{{200D}}\x{{FEFF}}]', '', 'g')"
    x = rf"regexp_replace({x}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', ' ', 'g')"
    x = f"regexp_replace({x}, '{tx.HYPHENS}', '', 'g')" if hyphens else x
    x = f"trim(regexp_replace({x}, '{SPACE}', '{spaces}', 'g'))"
    return f"lower({x})" if lower else x


def hits(x: str, terms: list[str]) -> str:
    return " + ".join(f"(length({x}) - length(replace({x}, '{t}', ''))) // {len(t)}" for t in terms)


FILES = """select doc_id as file_id, cast(substr(source, 4) as bigint) as root_id, 'doc' || doc_id || '.' || lang as filename, '.' || lang as extension,
    n_chars as size_bytes, cast(doc_id % 1000 as double) as modified_time, text from documents"""
#: Columns that search queries return.
SHOWN = ["file_id", "filename", "modified_time", "score", "hit_count", "source_type", "location_text"]


def search_sql(where: str, terms: list[str], n: str | None = None, h: str | None = None, more: str = "", kind: str = "'native_text'", adjust: str = "0", name: str | None = None) -> str:
    """One content block per file: score is hits plus the first term's bonus for the name."""
    n, name = n or norm("text"), name or norm("filename")
    t = terms[0]
    return f"""with f as ({FILES}), b as (select *, {n} as n, {name} as fn from f {more}),
        c as (select *, {h or hits("n", terms)} as h from b where {where})
        select file_id, filename, modified_time, cast(h + case when fn = '{t}' then 1000 when starts_with(fn, '{t}') then 500 when contains(fn, '{t}') then 250 else 0 end + {adjust} as double) as score,
            cast(greatest(h, 1) as bigint) as hit_count, {kind} as source_type, case when {kind} = 'ocr' then 'OCR' else '正文' end as location_text from c"""


def _engine(spark: SparkSession, d: str, **more) -> SearchEngine:
    return SearchEngine(v.document_files(spark, d), v.document_blocks(spark, d), **more)


def _found(engine: SearchEngine, q: SearchQuery) -> DataFrame:
    return engine.results(q).select(*SHOWN)


# --- search ------------------------------------------------------------------


@query(search_sql("contains(n, 'inan')", ["inan"]))
def search_exact(spark, d):
    return _found(_engine(spark, d), SearchQuery("inan"))


@query(search_sql("contains(n, 'of the')", ["of the"]))
def search_phrase(spark, d):
    return _found(_engine(spark, d), SearchQuery('"of the"', mode="phrase"))


@query(search_sql("contains(n, 'on the') and contains(n, 'thing')", ["on the", "thing"]))
def search_all_terms(spark, d):
    return _found(_engine(spark, d), SearchQuery('thing "on the"', mode="all"))


@query(search_sql("contains(n, 'licensed') or contains(n, 'mail6') or contains(n, 'ß')", ["licensed", "mail6", "ß"]))
def search_any_term(spark, d):
    return _found(_engine(spark, d), SearchQuery("licensed MAIL6 ß", mode="any"))


@query(search_sql("contains(n, 'oftheand')", ["oftheand"], n=norm("text", "", True), name=norm("filename", "", True)))
def search_ignore_spaces_hyphens(spark, d):
    return _found(_engine(spark, d), SearchQuery("of-the and", ignore_spaces=True, ignore_hyphens=True))


@query(search_sql("regexp_matches(text, '(?i)mail[0-9]+[.]EXAMPLE')", ["mail[0-9]+[.]EXAMPLE"], h="len(regexp_extract_all(text, '(?i)mail[0-9]+[.]EXAMPLE'))"))
def search_regex(spark, d):
    return _found(_engine(spark, d), SearchQuery("mail[0-9]+[.]EXAMPLE", mode="regex"))


@query(f"""with f as (select p_partkey as file_id, p_name as filename, cast(p_partkey as double) as modified_time, {norm("p_name")} as n from part)
    select file_id, filename, modified_time, cast({hits("n", ["small", "ring"])} + case when n = 'small' then 1000 when starts_with(n, 'small') then 500 else 250 end + 50 as double) as score,
        cast({hits("n", ["small", "ring"])} as bigint) as hit_count, 'metadata' as source_type, '文件名/路径' as location_text from f where contains(n, 'small') and contains(n, 'ring')""")
def search_filename_mode(spark, d):
    return _found(SearchEngine(v.part_files(spark, d), v.document_blocks(spark, d)), SearchQuery("small ring", mode="filename"))


@query(search_sql("contains(n, 'ou') and extension in ('.de', '.fr') and size_bytes between 500 and 3000 and root_id in (1, 2, 3, 5, 8) and modified_time between 100 and 900", ["ou"]))
def search_filters(spark, d):
    q = SearchQuery("ou", extensions=["de", ".FR"], size_min=500, size_max=3000, root_ids=[1, 2, 3, 5, 8], date_from=100, date_to=900)
    return _found(_engine(spark, d), q)


@query(search_sql("contains(n, 'The than')", ["The than"], n=norm("text", lower=False), name=norm("filename", lower=False)))
def search_case_sensitive(spark, d):
    return _found(_engine(spark, d), SearchQuery("The than", case_sensitive=True))


@query(search_sql("contains(n, 'idiot')", ["idiot"], more="where not exists (select 1 from labels l where l.doc_id = f.file_id and l.toxic = 1)"))
def search_visibility_anti(spark, d):
    return _found(_engine(spark, d, exclusions=v.toxic_exclusions(spark, d)), SearchQuery("idiot"))


_CONF = "left join (select distinct doc_id from labels where quality = 0) p on p.doc_id = f.file_id"


@query(search_sql("contains(n, 'the') and (doc_id is null or (file_id % 100) / 100.0 >= 0.6)", ["the"], more=_CONF, kind="case when doc_id is null then 'native_text' else 'ocr' end", adjust="case when doc_id is null then 0 else -25 end"))
def search_confidence_filter(spark, d):
    return _found(SearchEngine(v.document_files(spark, d), v.scanned_blocks(spark, d)), SearchQuery("the", ocr_min_confidence=0.6))


@query(search_sql("contains(n, 'the') and doc_id is null", ["the"], more=_CONF))
def search_without_ocr(spark, d):
    return _found(SearchEngine(v.document_files(spark, d), v.scanned_blocks(spark, d)), SearchQuery("the", include_ocr=False))


_TURNS = f"""with b as (select conv_id, turn, case when role = 'assistant' then 'ocr' else 'native_text' end as kind, 'turn ' || lpad(cast(turn as varchar), 3, '0') as place, {norm("text")} as n from conversations),
    c as (select *, {hits("n", ["than"])} as h from b where contains(n, 'than')),
    m as (select distinct conv_id, turn, kind, place, h from c)"""


@query(f"""{_TURNS}, g as (select conv_id, list(place order by case when kind = 'ocr' then 2 else 1 end, place) as places, cast(sum(h) as bigint) as hit_count, bool_or(kind = 'native_text') as own from m group by conv_id),
    s as (select conv_id, cast(sum(h + case when kind = 'ocr' then -25 else 0 end) as double) as score from c group by conv_id)
    select conv_id as file_id, 'conv' || conv_id || '.txt' as filename, cast(0 as double) as modified_time, score, hit_count, case when own then 'native_text' else 'ocr' end as source_type,
        case when len(places) <= 3 then array_to_string(places, '、') else array_to_string(places[1:3], '、') || ' 等 ' || len(places) || ' 处' end as location_text from g join s using (conv_id)""")
def search_grouped_hits(spark, d):
    q = SearchQuery("than", allow_ocr_fuzzy=True)
    return _found(SearchEngine(v.conversation_files(spark, d), v.conversation_blocks(spark, d)), q)


@query(f"select * from ({search_sql(chr(99) + 'ontains(n, ' + chr(39) + 'the' + chr(39) + ')', ['the'])}) order by score desc, modified_time desc, lower(filename), file_id limit 10 offset 10")
def search_paged(spark, d):
    q = SearchQuery("the", page=2, page_size=10)
    return page(_engine(spark, d).results(q), q).select(*SHOWN)


@query(f"""with x as ({search_sql("contains(n, 'licensed')", ["licensed"])}), y as (select * from x order by score desc, modified_time desc, lower(filename), file_id limit 50),
    w as (select y.*, text, instr(lower(text), 'licensed') - 1 as p from y join documents on doc_id = file_id), z as (select *, greatest(0, p - 100) as f, least(length(text), p + 8 + 180) as t from w)
    select {", ".join(SHOWN)}, '正文' || chr(10) || case when f > 0 then '...' else '' end || replace(substr(text, f + 1, t - f), chr(10), ' ') || case when t < length(text) then '...' else '' end as context from z""")
def search_with_context(spark, d):
    return _engine(spark, d).search(SearchQuery("licensed", page_size=50)).results.select(*SHOWN, "context")


@query(f"select item_id, doc_id from benchmark b join documents d on contains({norm('d.text')}, {norm('b.text')})")
def golden_batch(spark, d):
    """All benchmark passages against all documents, by the trigram index."""
    needles = v.read(spark, d, "benchmark").select("item_id", tx.normalized("text").alias("needle"))
    rows = v.read(spark, d, "documents").select("doc_id", tx.normalized("text").alias("n"))
    return postings.contained(needles, "item_id", "needle", rows, "doc_id", "n")


_GOLDEN = ["thereti", "of the", "ou des"]


@query(" union all ".join(f"select {i} as query_index, file_id, score, hit_count from ({search_sql(f'contains(n, {chr(39)}{t}{chr(39)})', [t])})" for i, t in enumerate(_GOLDEN)))
def query_batch(spark, d):
    return _engine(spark, d).search_many([SearchQuery(t) for t in _GOLDEN]).select("query_index", "file_id", "score", "hit_count")


@query(f"select gram, count(*) as n_blocks from (select distinct doc_id, substr(n, i, 3) as gram from (select doc_id, n, unnest(range(1, length(n) - 1)) as i from (select doc_id, {norm('text')} as n from documents))) group by gram")
def trigram_postings(spark, d):
    index = postings.build(v.document_blocks(spark, d), "block_id", "normalized_text")
    return index.groupBy("gram").agg(F.count(F.lit(1)).alias("n_blocks"))


@query("select doc_id as block_id from (select doc_id, " + norm("text") + " as n from documents) where " + " and ".join(f"contains(n, '{g}')" for g in ("lic", "ice", "cen", "ens", "nse", "und", "nde", "der")))
def trigram_candidates(spark, d):
    index = postings.build(v.document_blocks(spark, d), "block_id", "normalized_text")
    return postings.candidates(plan(SearchQuery("license under", mode="all")), index, "block_id")


@query(f"select doc_id, md5(n) as digest, length(n) as n_chars from (select doc_id, {norm('text')} as n from documents)")
def normalize_text(spark, d):
    return v.read(spark, d, "documents").select("doc_id", tx.normalized("text").alias("n")).select("doc_id", F.md5("n").alias("digest"), F.length("n").cast("long").alias("n_chars"))


@query()
def normalize_text_nfkc(spark, d):
    return tx.compose(v.read(spark, d, "documents"), "text").select("doc_id", F.md5(tx.normalized("text")).alias("digest"))


@query(f"select doc_id, cast({hits('n', ['the', 'que', 'ein'])} as bigint) as n_hits from (select doc_id, {norm('text')} as n from documents)")
def term_hits(spark, d):
    return v.read(spark, d, "documents").select("doc_id", tx.hits(tx.normalized("text"), ["the", "que", "ein"]).alias("n_hits"))


@query(f"""with d as (select doc_id, text, {norm('text')} as n from documents), s as (select *, instr(n, 'than') as p from d where length(n) = length(text)),
    w as (select *, greatest(1, p - 100) as f, least(length(text), p - 1 + 4 + 180) as t from s)
    select doc_id, case when p > 0 then (case when f > 1 then '...' else '' end) || replace(substr(text, f, t - f + 1), chr(10), ' ') || (case when t < length(text) then '...' else '' end)
        else substr(text, 1, 280) || (case when length(text) > 280 then '...' else '' end) end as context from w""")
def context_snippet(spark, d):
    rows = v.read(spark, d, "documents").select("doc_id", "text", tx.normalized("text").alias("n")).where("length(n) = length(text)")
    return rows.select("doc_id", tx.plain_context(F.col("text"), F.col("n"), ["than"]).alias("context"))


@query("""with s as (select doc_id, n_chars * [1, 1000, 1000000][doc_id % 3 + 1] as n from documents)
    select doc_id, case when n < 1024 then n || ' B' when n < 1048576 then format('{:.1f} KB', n / 1024.0) when n < 1073741824 then format('{:.1f} MB', n / 1048576.0) else format('{:.1f} GB', n / 1073741824.0) end as size from s""")
def format_size(spark, d):
    times = F.element_at(F.array(F.lit(1), F.lit(1000), F.lit(1000000)), (F.col("doc_id") % 3 + 1).cast("int"))
    return v.read(spark, d, "documents").select("doc_id", tx.format_size(F.col("n_chars") * times).alias("size"))


# --- blocks and content ------------------------------------------------------


@query(r"""with l as (select doc_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) as ls from documents where length(text) > 0),
    b as (select doc_id, ls, unnest(range(0, (len(ls) - 1) // 5 + 1)) as block_index from l)
    select doc_id, cast(block_index as integer) as block_index, cast(block_index * 5 + 1 as integer) as line_start, cast(least(block_index * 5 + 5, len(ls)) as integer) as line_end,
        '第 ' || (block_index * 5 + 1) || '-' || least(block_index * 5 + 5, len(ls)) || ' 行' as location_text, array_to_string(ls[block_index * 5 + 1 : block_index * 5 + 5], chr(10)) as raw_text from b""")
def line_blocks(spark, d):
    return blocks.line_blocks(v.read(spark, d, "documents"), "doc_id", "text", 5)


_STRIP = rf"regexp_replace(text, '^{SPACE}|{SPACE}$', '', 'g')"


@query(rf"""with recursive c as (select conv_id, turn, {_STRIP} as s, role, row_number() over (partition by conv_id order by turn) as r from conversations where regexp_matches(text, '[^\s\p{{Z}}\x{{85}}\x0B]')),
    f as (select conv_id, r, s, turn, role, 0 as g, case when role <> 'assistant' and length(s) < 256 then length(s) else 0 end as chars, role <> 'assistant' and length(s) < 256 as is_open from c where r = 1
        union all
        select c.conv_id, c.r, c.s, c.turn, c.role, case when j then f.g else f.g + 1 end, case when c.role <> 'assistant' and (case when j then f.chars + length(c.s) + 1 else length(c.s) end) < 256 then (case when j then f.chars + length(c.s) + 1 else length(c.s) end) else 0 end,
            c.role <> 'assistant' and (case when j then f.chars + length(c.s) + 1 else length(c.s) end) < 256
        from f join c on c.conv_id = f.conv_id and c.r = f.r + 1, lateral (select f.is_open and c.role <> 'assistant' and f.chars + length(c.s) + 1 <= 512 as j))
    select conv_id as file_id, g as block_index, count(*) as n_blocks, string_agg(s, chr(10) order by r) as raw_text from f group by conv_id, g""")
def coalesce_blocks(spark, d):
    return blocks.coalesced(v.conversation_blocks(spark, d), target=256, most=512).select("file_id", "block_index", F.col("n_blocks").cast("long").alias("n_blocks"), "raw_text")


@query("select sha256(text) as content_key, lang as parser_name, min(doc_id) as primary_id, count(*) as n_files, cast(sum(n_chars) - arg_min(n_chars, doc_id) as bigint) as bytes_avoided from documents group by all")
def content_dedup(spark, d):
    docs = v.read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_key"), F.col("lang").alias("parser_name"), "n_chars")
    return blocks.content_groups(docs, ["content_key", "parser_name"], "doc_id", "n_chars")


@query("select doc_id, lang, n_chars, n_same from (select doc_id, lang, n_chars, count(*) over (partition by lang, n_chars) as n_same from documents) where n_same > 1")
def hash_candidates(spark, d):
    return blocks.hash_candidates(v.read(spark, d, "documents"), ["lang", "n_chars"], "doc_id")


@query("select conv_id, count(*) as n_blocks, sha256(string_agg(sha256(turn || chr(0) || role || chr(0) || text || chr(0)), '' order by turn, role, text)) as digest from conversations group by conv_id")
def block_digest(spark, d):
    rows = v.read(spark, d, "conversations")
    # Ties of turn and role are ordered by text, as the SQL does.
    return blocks.digests(rows, ["conv_id"], ["turn", "role", "text"], ["turn", "role", "text"])


# --- registry ----------------------------------------------------------------


def _list(values) -> str:
    return "[" + ", ".join(f"'{x}'" for x in values) + "]"


_VIDEO = "('" + "', '".join(VIDEO_EXTENSIONS) + "')"
_FILES = f"""f as (select c_custkey as file_id, cast(c_nationkey as bigint) as root_id, c_name as path, case c_mktsegment {" ".join(f"when '{a}' then '{b}'" for a, b in v.EXTENSIONS.items())} end as extension, cast(floor(abs(c_acctbal)) as bigint) as size_bytes,
    {_list(v.STATUSES)}[c_custkey % 10 + 1] as parse_status, {_list(v.CODES)}[c_custkey % 10 + 1] as parse_error_code, c_custkey % 23 = 0 as is_deleted, case when c_custkey % 4 > 0 then c_custkey // 4 end as document_id,
    case when c_custkey % 50 = 7 then c_custkey - 7 end as container_file_id, 'f' || (c_custkey % 7) as quick_fingerprint from customer),
    e as (select c_custkey as file_id from customer where c_custkey % 17 = 0 and c_custkey % 34 <> 0),
    m as (select f.*, e.file_id is not null as excluded, f.extension in {_VIDEO} as video from f left join e on e.file_id = f.file_id where not is_deleted),
    t as (select o_orderkey as task_id, o_custkey as file_id, case o_orderstatus when 'F' then 'complete' when 'O' then 'running' else 'queued' end as status, cast(substr(o_orderpriority, 1, 1) as integer) as priority, cast(floor(o_totalprice) as bigint) as cost, o_orderpriority as progress_phase, o_orderstatus as progress_cursor from orders),
    r as (select cast(n_nationkey as bigint) as root_id, n_nationkey % 5 <> 4 as enabled, case when n_nationkey % 3 = 0 then 'incomplete' else 'ready' end as status from nation)"""
_COUNTED = "not video and not excluded"


@query(f"""with {_FILES} select root_id, count(*) as discovered, count(*) filter (video) as video_excluded, count(*) filter ({_COUNTED}) as eligible, count(*) filter ({_COUNTED} and parse_status in ('success', 'metadata_only')) as complete,
    count(*) filter (excluded) as manual_excluded, count(*) filter ({_COUNTED} and parse_status = 'metadata_only') as metadata_only_complete, count(*) filter ({_COUNTED} and parse_status not in ('success', 'metadata_only')) as blocking from m group by root_id""")
def root_completion(spark, d):
    return reports.root_completion(v.registry_files(spark, d), v.registry_exclusions(spark, d))


_STATS = f"""s as (select count(*) as files, count(*) filter (parse_status in ('failed', 'failed_retryable') and not excluded) as failed, count(*) filter (parse_status = 'unsupported') as unsupported,
    count(*) filter (parse_status in ('metadata_only', 'skipped', 'ocr_disabled', 'converter_missing')) as metadata_only, count(*) filter (video) as video_excluded, count(*) filter (excluded) as manual_excluded_files,
    count(*) filter ({_COUNTED} and parse_status = 'success') as successful_files, count(*) filter ({_COUNTED} and parse_status = 'metadata_only') as metadata_only_complete_files,
    (select count(*) from lineitem) as blocks, (select count(*) from orders) as documents from m),
    q as (select *, files - video_excluded - manual_excluded_files as eligible_files, successful_files + metadata_only_complete_files as complete_files from s)"""


def _stats(spark, d):
    return reports.stats(v.registry_files(spark, d), v.registry_exclusions(spark, d), v.read(spark, d, "lineitem"), v.read(spark, d, "orders"))


@query(f"with {_FILES}, {_STATS} select *, greatest(0, eligible_files - complete_files) as blocking_files from q")
def registry_stats(spark, d):
    return _stats(spark, d)


@query(f"""with {_FILES}, {_STATS}, u as (select count(*) as n from t join m on m.file_id = t.file_id join r on r.root_id = m.root_id where {_COUNTED} and r.enabled and t.status not in ('complete', 'failed', 'superseded', 'invalidated', 'cancelled')),
    x as (select greatest(0, eligible_files - complete_files) as blocking_files, (select count(*) from r where enabled) as enabled_roots, (select count(*) from r where enabled and status <> 'ready') as unready_roots, (select n from u) as unfinished_tasks from q)
    select blocking_files, enabled_roots, unready_roots, unfinished_tasks, array_to_string([z for z in [case when enabled_roots <= 0 then 'no_enabled_roots' end, case when blocking_files > 0 then 'blocking_files' end, case when unfinished_tasks > 0 then 'unfinished_tasks' end, case when unready_roots > 0 then 'unready_root' end] if z is not null], ',') as reasons,
        enabled_roots > 0 and blocking_files = 0 and unfinished_tasks = 0 and unready_roots = 0 as ready from x""")
def readiness(spark, d):
    files, off, roots = v.registry_files(spark, d), v.registry_exclusions(spark, d), v.roots(spark, d)
    none = lambda schema: spark.createDataFrame([], schema)
    open_tasks = reports.unfinished_tasks(v.tasks(spark, d), files, roots, off)
    out = reports.readiness(_stats(spark, d), roots, none("status string"), open_tasks, none("root_id long, status string"), none("key string, value string"))
    return out.select("blocking_files", "enabled_roots", "unready_roots", "unfinished_tasks", F.array_join("not_ready_reasons", ",").alias("reasons"), "ready")


@query(f"with {_FILES} select extension, parse_status, count(*) as n_files, cast(sum(size_bytes) as bigint) as bytes from f group by all")
def status_histogram(spark, d):
    return reports.histogram(v.registry_files(spark, d), ["extension", "parse_status"], "size_bytes")


@query(f"""with {_FILES}, l as (select file_id, max(task_id) as task_id from t group by file_id),
    a as (select m.*, coalesce(t.progress_phase, '') as progress_phase, coalesce(t.progress_cursor, '') as progress_cursor from m left join l on l.file_id = m.file_id left join t on t.task_id = l.task_id)
    select file_id, path, parse_status, progress_phase, progress_cursor, case when parse_error_code = 'PARSE_NO_PROGRESS' then '{reports.ADVICE["PARSE_NO_PROGRESS"]}' when parse_error_code = 'PROCESS_WORKER_CRASH' then '{reports.ADVICE["PROCESS_WORKER_CRASH"]}'
        when starts_with(parse_error_code, 'LEGACY_') or contains(parse_error_code, 'CONVERTER') then '{reports.ADVICE["converter"]}' when parse_status = 'password_protected' then '{reports.ADVICE["password_protected"]}' when parse_status = 'ocr_failed' then '{reports.ADVICE["ocr_failed"]}' else '{reports.ADVICE["other"]}' end as recovery_advice
    from a where not excluded and parse_status in ('pending', 'failed', 'unsupported', 'ocr_failed', 'password_protected') order by file_id desc limit 200""")
def failed_files(spark, d):
    out = reports.failed_files(v.registry_files(spark, d), v.tasks(spark, d), v.registry_exclusions(spark, d), 200)
    return out.select("file_id", "path", "parse_status", "progress_phase", "progress_cursor", "recovery_advice")


@query(f"with {_FILES} select extension, parse_status, parse_error_code, count(*) as n_files from m where not excluded and parse_status not in ('success', 'metadata_only') group by all")
def failure_summary(spark, d):
    bad = reports.failed_files(v.registry_files(spark, d), v.tasks(spark, d), v.registry_exclusions(spark, d), None)
    return reports.histogram(bad, ["extension", "parse_status", "parse_error_code"])


@query(f"with {_FILES} select file_id, task_id, status, cost from (select *, row_number() over (partition by file_id order by task_id desc) as rn from t) where rn = 1")
def latest_task_per_file(spark, d):
    return reports.latest(v.tasks(spark, d), "file_id", "task_id", ["status", "cost"])


@query("""with p as (select l_orderkey as parent, count(*) as total, count(*) filter (l_linestatus = 'F') as confirmed, count(*) filter (l_linestatus <> 'F' and l_returnflag = 'R') as failed from lineitem group by 1)
    select *, total - confirmed - failed as pending, confirmed = total and failed = 0 as ready from p""")
def merge_readiness(spark, d):
    return reports.merge_readiness(v.page_tasks(spark, d), "parent", F.col("status") == "confirmed", F.col("status") == "failed")


@query("""with p as (select l_orderkey as parent, l_linenumber as page_number, l_partkey as block_index, l_suppkey as s, l_extendedprice as x, case when l_linestatus = 'F' then 'confirmed' else 'queued' end as status, case when l_returnflag = 'R' then 'ocr' else 'native_text' end as source_type from lineitem),
    k as (select parent from p group by parent having bool_and(status = 'confirmed'))
    select parent, page_number, source_type, cast(row_number() over (partition by parent order by page_number, case when source_type = 'ocr' then 1 else 0 end, block_index) - 1 as integer) as block_index from p join k using (parent)""")
def merged_pages(spark, d):
    rows = v.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("parent"), F.col("l_linenumber").alias("page_number"), F.when(F.col("l_returnflag") == "R", "ocr").otherwise("native_text").alias("source_type"), F.col("l_partkey").alias("block_index"), F.when(F.col("l_linestatus") == "F", "confirmed").otherwise("queued").alias("status"))
    return tasks.merged_pages(rows).select("parent", "page_number", "source_type", "block_index")


@query(f"""with {_FILES}, k as (select file_id, task_id, priority, row_number() over (partition by file_id order by priority desc, task_id) as source_rank from t where status <> 'complete')
    select file_id, task_id, priority, source_rank from k order by source_rank, file_id, priority desc, task_id limit 100""")
def fair_claim(spark, d):
    return tasks.fair_claim(v.tasks(spark, d).where("status <> 'complete'"), "file_id", "task_id", "priority", 100).select("file_id", "task_id", "priority", F.col("source_rank").cast("long").alias("source_rank"))


@query(f"""with recursive {_FILES}, k as (select task_id, priority, cost, row_number() over (partition by file_id order by priority desc, task_id) as source_rank from t where status = 'queued'),
    o as (select task_id, greatest(1, cost) as cost, row_number() over (order by source_rank, priority desc, task_id) as n from k),
    g as (select 0 as n, cast(0 as bigint) as used, cast(0 as bigint) as got, cast(null as bigint) as task_id union all
        select o.n, case when take then used + o.cost else used end, case when take then got + 1 else got end, case when take then o.task_id end from g join o on o.n = g.n + 1, lateral (select got < 20 and (got = 0 or used + o.cost <= 2000000) as take))
    select task_id, cast(row_number() over (order by n) - 1 as integer) as place from g where task_id is not null""")
def budget_claim(spark, d):
    return tasks.budget_claim(v.tasks(spark, d).where("status = 'queued'"), "file_id", "task_id", "priority", "cost", 20, 2_000_000).select("task_id", "place")


@query("select o_orderkey, o_custkey from (select *, row_number() over (partition by o_orderpriority order by o_orderdate desc, o_orderkey desc) as rn from orders) where rn <= 50")
def run_retention(spark, d):
    return reports.newest(v.read(spark, d, "orders"), 50, F.desc("o_orderdate"), F.desc("o_orderkey"), by=["o_orderpriority"]).select("o_orderkey", "o_custkey")


@query("select event_type as query_text, max(ts) as created_at, max(event_id) as search_id from events group by 1 order by search_id desc limit 3")
def search_history(spark, d):
    rows = v.read(spark, d, "events").select(F.col("event_type").alias("query_text"), F.col("ts").alias("created_at"), F.col("event_id").alias("search_id"))
    return reports.history(rows, 3)


@query("select user_id as task_id, event_id, row_number() over (partition by user_id order by event_id) as attempt_no from events")
def task_attempts(spark, d):
    rows = v.read(spark, d, "events").select(F.col("user_id").alias("task_id"), "event_id")
    return tasks.attempts(rows, "task_id", "event_id").withColumn("attempt_no", F.col("attempt_no").cast("long"))


@query(f"""with {_FILES}, j as (select file_id, extension, size_bytes, {" ".join(["case"] + [f"when extension = '{e}' then '{l}'" for e, l in ((".pdf", "pdf"), (".docx", "office_process"), (".xlsx", "office_process"))] + ["else 'normal' end"])} as lane,
        case extension when '.txt' then 1.0 + size_bytes / 1048576.0 * 0.25 when '.mp4' then 0.5 + size_bytes / 1048576.0 * 0.25 when '.pdf' then 7.0 + size_bytes / 1048576.0 * 0.8 when '.docx' then 5.0 + size_bytes / 1048576.0 * 0.02 else 6.0 + size_bytes / 1048576.0 * 0.02 end as cost,
        case extension when '.xlsx' then greatest(1, size_bytes) * 8 when '.pdf' then greatest(1, size_bytes) * 2 else greatest(1, size_bytes) end as memory from f)
    select file_id, lane, round(cost, 6) as cost, cast(memory as bigint) as memory from j""")
def parse_costs(spark, d):
    e, s, z = F.col("extension"), F.col("size_bytes"), F.lit(0).cast("long")
    return v.registry_files(spark, d).select("file_id", tasks.lane(e).alias("lane"), F.round(tasks.parse_cost(e, s, z), 6).alias("cost"), tasks.memory_bytes(e, s, z).alias("memory"))


@query("""with s as (select p_partkey, case p_size % 6 when 0 then 'exact' when 1 then 'phrase' when 2 then 'all' when 3 then 'any' when 4 then 'regex' else 'filename' end as mode, p_partkey * 1000 as n, p_size % 2 = 0 as scoped, p_size % 3 = 0 as ext, p_size % 5 > 0 as content, p_size % 7 = 0 as fuzzy, p_size % 4 = 0 as cs from part)
    select p_partkey, mode, round(least(greatest((180 + least(n, 1000000) * 0.025e0) * case mode when 'exact' then 1.0e0 when 'phrase' then 1.15e0 when 'all' then 1.3e0 when 'any' then 1.55e0 when 'regex' then 3.8e0 else 1.25 end
        * case when scoped then 0.72e0 else 1 end * case when ext then 0.76e0 else 1 end * case when not content then 0.65e0 else 1 end * case when fuzzy then 1.7e0 else 1 end * case when cs then 1.12e0 else 1 end, 140), 120000), 3) as baseline_ms from s""")
def search_baseline(spark, d):
    k, n = F.col("p_size"), F.col("p_partkey")
    names = F.array(*map(F.lit, ["exact", "phrase", "all", "any", "regex", "filename"]))
    mode = F.element_at(names, (k % 6 + 1).cast("int"))
    return v.read(spark, d, "part").select("p_partkey", mode.alias("mode"), F.round(tasks.search_baseline_ms(mode, n * 1000, k % 2 == 0, k % 3 == 0, k % 5 > 0, k % 7 == 0, k % 4 == 0), 3).alias("baseline_ms"))


# --- lifecycle ---------------------------------------------------------------


@query(f"""with {_FILES}, live as (select * from f where not is_deleted), g as (select file_id, path from live where container_file_id is null and file_id % 9 = 0)
    select file_id, path from g union all select l.file_id, l.path from live l where l.container_file_id in (select file_id from g)""")
def deleted_paths(spark, d):
    files = v.registry_files(spark, d)
    return lifecycle.deleted_files(files, files.where("file_id % 9 <> 0"))


@query(f"""with {_FILES}, scan as (select path, 'f' || (file_id % 6) as quick_fingerprint from f where file_id % 5 > 0 union all select 'new ' || path, quick_fingerprint from f where file_id % 11 = 0)
    select f.file_id, scan.path, coalesce(f.file_id is null or f.is_deleted or f.parse_status in ('pending', 'processing', 'cancelled', 'deleted') or scan.quick_fingerprint is distinct from f.quick_fingerprint
        or (f.parse_status <> 'success' and not (f.extension in {_VIDEO} and f.parse_status = 'metadata_only')), true) as changed from scan left join f on f.path = scan.path""")
def changed_files(spark, d):
    files = v.registry_files(spark, d)
    one = F.lit("1").alias("parser_version"), F.lit("h").alias("content_hash")
    seen = files.where("file_id % 5 > 0").select("path", F.concat(F.lit("f"), (F.col("file_id") % 6).cast("string")).alias("quick_fingerprint"), *one)
    new = files.where("file_id % 11 = 0").select(F.concat(F.lit("new "), "path").alias("path"), "quick_fingerprint", *one)
    return lifecycle.changed_files(seen.unionByName(new), files).select("file_id", "path", "changed")


@query("""with a as (select doc_id, md5(text) as h from documents where doc_id % 10 <> 3), b as (select doc_id, case when doc_id % 7 = 0 then md5(text || 'x') else md5(text) end as h from documents where doc_id % 10 <> 4)
    select coalesce(a.doc_id, b.doc_id) as doc_id, case when b.doc_id is null then 'missing' when a.doc_id is null then 'new' else 'changed' end as change from a full join b on a.doc_id = b.doc_id where a.h is distinct from b.h""")
def snapshot_diff(spark, d):
    docs = v.read(spark, d, "documents")
    a = docs.where("doc_id % 10 <> 3").select("doc_id", F.md5("text").alias("h"))
    b = docs.where("doc_id % 10 <> 4").select("doc_id", F.md5(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))).alias("h"))
    return lifecycle.snapshot_diff(a, b, "doc_id", "h")


_BLOCKS = "b as (select o_orderkey as block_id, o_custkey as file_id, case when o_orderkey % 3 > 0 then o_custkey // 4 end as document_id from orders)"


def _blocks(spark, d):
    return v.read(spark, d, "orders").select(F.col("o_orderkey").alias("block_id"), F.col("o_custkey").alias("file_id"), F.when(F.col("o_orderkey") % 3 > 0, F.floor(F.col("o_custkey") / 4)).alias("document_id"))


@query(f"with {_FILES}, {_BLOCKS} select b.block_id, b.file_id, b.document_id from b where exists (select 1 from m where not m.excluded and ((b.document_id is not null and m.document_id = b.document_id) or (b.document_id is null and m.file_id = b.file_id)))")
def visible_blocks(spark, d):
    return lifecycle.visible_blocks(_blocks(spark, d), v.registry_files(spark, d), v.registry_exclusions(spark, d))


@query(f"with {_FILES}, {_BLOCKS} select b.block_id, f.file_id from b join f on (b.document_id is not null and f.document_id = b.document_id) or (b.document_id is null and f.file_id = b.file_id)")
def blocks_of_files(spark, d):
    return of_files(_blocks(spark, d), v.registry_files(spark, d).select("file_id", "document_id")).select("block_id", F.col("__file").alias("file_id"))


@query(f"""with {_FILES}, w as (select distinct c_custkey + case when c_custkey % 13 = 0 then 1000000 else 0 end as file_id from customer where c_custkey % 2 = 0),
    busy as (select distinct file_id from t where status = 'running'), p as (select w.file_id, case when f.file_id is null or f.is_deleted then 'missing' when e.file_id is not null then 'already_excluded' when busy.file_id is not null then 'active_task'
        when f.parse_status not in ('failed', 'failed_retryable', 'unsupported', 'skipped', 'ocr_disabled', 'ocr_failed', 'converter_missing', 'partial_success', 'password_protected') then 'status' end as problem
        from w left join f on f.file_id = w.file_id left join e on e.file_id = w.file_id left join busy on busy.file_id = w.file_id) select * from p where problem is not null""")
def exclusion_problems(spark, d):
    k = F.col("file_id")
    wanted = v.registry_files(spark, d).where(k % 2 == 0).select((k + F.when(k % 13 == 0, 1000000).otherwise(0)).alias("file_id"))
    return lifecycle.exclusion_problems(v.registry_files(spark, d), v.tasks(spark, d), v.registry_exclusions(spark, d), wanted)


@query(f"with {_FILES} select document_id, min(file_id) as file_id from m where document_id is not null group by document_id")
def canonical_files(spark, d):
    return lifecycle.canonical_files(v.registry_files(spark, d))


@query(f"with {_FILES} select file_id, path from m where not video and not excluded and parse_status not in ('success', 'metadata_only')")
def blockers(spark, d):
    return lifecycle.blockers(v.registry_files(spark, d), v.registry_exclusions(spark, d)).select("file_id", "path")


@query(f"with {_FILES} select task_id, case when t.status not in ('complete') and e.file_id is not null then 'cancelled' when t.status not in ('complete') and f.file_id is not null then 'invalidated' else t.status end as status from t left join e on e.file_id = t.file_id left join f on f.file_id = t.file_id and f.parse_status = 'success'")
def reconciled_tasks(spark, d):
    return lifecycle.reconciled_tasks(v.tasks(spark, d), v.registry_files(spark, d), v.registry_exclusions(spark, d)).select("task_id", "status")


# --- events ------------------------------------------------------------------


@query("""with g as (select *, case when epoch_us(ts) - lag(epoch_us(ts)) over w <= 600000000 then 0 else 1 end as fresh from events window w as (partition by user_id order by ts, event_type)),
    b as (select *, sum(fresh) over (partition by user_id order by ts, event_type rows unbounded preceding) as burst from g)
    select user_id, min(ts) as first_at, max(ts) as last_at, arg_max(event_type, (ts, event_type)) as last_value, count(*) as n_events from b group by user_id, burst""")
def debounce_bursts(spark, d):
    return events.debounced(v.read(spark, d, "events"), ["user_id"], "ts", "event_type", 600.0)


_PROGRESS = """p as (select user_id as task_id, event_id as seq, case when event_type = 'error' then '' else event_type end as phase, cast(floor(value) as bigint) as c, event_id % 50 as k, epoch_us(ts) / 1e6 as at_seconds from events),
    l as (select *, lag(phase) over w as p0, lag(c) over w as c0, lag(k) over w as k0, lag(seq) over w as s0 from p window w as (partition by task_id order by seq)),
    x as (select *, s0 is null or (phase <> '' and phase <> p0) or c > c0 or c * 10 > c0 * 10 or c % 3 > c0 % 3 or k > k0 as is_progress from l)"""


@query(f"with {_PROGRESS} select task_id, seq, is_progress from x")
def semantic_progress(spark, d):
    return events.progressed(v.progress_events(spark, d)).select("task_id", "seq", "is_progress")


@query(f"""with {_PROGRESS}, y as (select *, coalesce(lead(at_seconds) over (partition by task_id order by at_seconds) - at_seconds, 0) as still, sum(is_progress::int) over (partition by task_id order by at_seconds rows unbounded preceding) as run from x),
    z as (select task_id, run, sum(still) as still from y group by all) select task_id, round(max(still), 3) as longest_still, bool_or(still > 40000) as stalled from z group by task_id""")
def stalled_tasks(spark, d):
    rows = events.progressed(v.progress_events(spark, d)).withColumn("paused", F.lit(False))
    return events.stalled(rows, F.lit(40000.0)).withColumn("longest_still", F.round("longest_still", 3))


@query("""with s as (select user_id as task_id, event_id as seq, event_type as signature from events), n as (select *, case when lag(signature) over w = signature then 0 else 1 end as fresh, row_number() over w as attempt from s window w as (partition by task_id order by seq)),
    r as (select *, sum(fresh) over (partition by task_id order by seq rows unbounded preceding) as run from n), c as (select *, row_number() over (partition by task_id, run order by seq) as same_count from r)
    select task_id, seq, attempt, same_count, attempt < 3 and same_count < 2 as retry from c""")
def stall_retries(spark, d):
    rows = v.read(spark, d, "events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("signature"))
    return tasks.stalls(rows).select("task_id", "seq", F.col("attempt").cast("long").alias("attempt"), F.col("same_count").cast("long").alias("same_count"), "retry")


@query("""with s as (select event_type as lane, event_id as seq, value / (user_id + 1.0) as rate, value, user_id + 1.0 as cost from events)
    select lane, seq, round(median(rate) over (partition by lane order by seq rows 20 preceding) + 1e-9, 6) as recent, round(sum(value) over (partition by lane order by seq) / sum(cost) over (partition by lane order by seq), 6) as total from s""")
def eta_rates(spark, d):
    rows = v.read(spark, d, "events").select(F.col("event_type").alias("lane"), F.col("event_id").alias("seq"), (F.col("user_id") + 1.0).alias("completed_cost"), F.col("value").alias("service_seconds"))
    out = events.blended_rates(rows, F.lit(0.08))
    return out.select("lane", "seq", F.round(F.col("recent") + 1e-9, 6).alias("recent"), F.round("total", 6).alias("total"))


@query("""with s as (select event_type as lane, event_id as seq, value / (user_id + 1e0) as rate, value, user_id + 1e0 as cost from events),
    w as (select lane, seq, median(rate) over (partition by lane order by seq rows 20 preceding) as recent, list_reduce(list(rate) over (partition by lane order by seq rows 199 preceding), lambda a, x: a * 0.75e0 + x * 0.25e0) as ewma,
        sum(value) over (partition by lane order by seq) / sum(cost) over (partition by lane order by seq) as total, least(0.8e0, count(*) over (partition by lane order by seq) / 8e0) as weight from s)
    select lane, seq, round(0.08e0 * (1 - weight) + (recent * 0.45e0 + ewma * 0.35e0 + total * 0.2e0) * weight + 1e-9, 6) as rate from w""")
def eta_rates_blended(spark, d):
    rows = v.read(spark, d, "events").select(F.col("event_type").alias("lane"), F.col("event_id").alias("seq"), (F.col("user_id") + 1.0).alias("completed_cost"), F.col("value").alias("service_seconds"))
    return events.blended_rates(rows, F.lit(0.08)).select("lane", "seq", F.round(F.col("rate") + 1e-9, 6).alias("rate"))


@query("select user_id, event_type, min(ts) as ts from events group by all")
def event_dedup(spark, d):
    return events.deduplicated(v.read(spark, d, "events").select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts")


@query("""with s as (select user_id, epoch_us(ts) / 1e6 as a, epoch_us(ts) / 1e6 + value * 100 as b from events where event_type = 'view'), p as (select user_id, epoch_us(ts) / 1e6 as a, epoch_us(ts) / 1e6 + value as b from events where event_type = 'click')
    select s.user_id, s.a as "start", s.b as "end", round(coalesce(sum(case when p.a is not null then greatest(0, least(s.b, p.b) - greatest(s.a, p.a)) end), 0), 3) as paused_seconds from s left join p on p.user_id = s.user_id and p.a < s.b and p.b > s.a group by 1, 2, 3""")
def pause_overlap(spark, d):
    at = v.seconds().alias("start")
    rows = v.read(spark, d, "events")
    spans = rows.where("event_type = 'view'").select("user_id", at, (v.seconds() + F.col("value") * 100).alias("end"))
    pauses = rows.where("event_type = 'click'").select("user_id", at, (v.seconds() + F.col("value")).alias("end"))
    return events.overlap_seconds(spans, pauses, "user_id").withColumn("paused_seconds", F.round("paused_seconds", 3))


@query()
def hysteresis_states(spark, d):
    rows = v.read(spark, d, "events").select("user_id", v.seconds().alias("at"), F.when(F.col("value") > 100, "cpu_pressure").otherwise("stable").alias("candidate"), (F.col("event_type") == "signup").alias("paused"))
    return events.controlled(rows, "user_id", 2, 30.0)


# --- geometry and pages ------------------------------------------------------


@query("""with i as (select p_partkey, p_size * 100 as w, p_size * 70 as h from part where p_size > 0), x as (select p_partkey, h, unnest(list_distinct(case when w <= 1000 then [0] else list_concat(range(0, w - 1000 + 1, 800), [w - 1000]) end)) as x from i)
    select p_partkey, cast(x as bigint) as x, cast(unnest(list_distinct(case when h <= 1000 then [0] else list_concat(range(0, h - 1000 + 1, 800), [h - 1000]) end)) as bigint) as y from x""")
def tile_plan(spark, d):
    images = v.read(spark, d, "part").where("p_size > 0").select("p_partkey", (F.col("p_size") * 100).cast("int").alias("width"), (F.col("p_size") * 70).cast("int").alias("height"))
    return geometry.tiles(images, "p_partkey", 1000, 200).select("p_partkey", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))


@query(r"""with s as (select doc_id, regexp_replace(text, '[\s\p{Z}\x{85}\x0B]+', '', 'g') as t from documents)
    select doc_id, length(t) = 0 or len(regexp_extract_all(t, '[\p{L}\p{N}]')) < 20 or (length(t) - length(replace(t, chr(65533), ''))) / greatest(length(t), 1) >= 0.2 as scanned from s""")
def scanned_pages(spark, d):
    return v.read(spark, d, "documents").select("doc_id", geometry.scanned_page(F.col("text"), F.lit(True)).alias("scanned"))


@query("""with b as (select p_partkey, p_size * 1.0 as x1, p_size * 2.0 as y1, p_size + 40.0 as x2, p_size * 2 + 20.0 as y2, p_size * 1.0 + p_partkey % 7 as u1, p_size * 2.0 as v1, p_size + 40.0 + p_partkey % 7 as u2, p_size * 2 + 20.0 as v2 from part),
    i as (select *, greatest(0, least(x2, u2) - greatest(x1, u1)) * greatest(0, least(y2, v2) - greatest(y1, v1)) as c from b)
    select p_partkey, round(c / (1600 - c), 6) as overlap, c / (1600 - c) >= 0.85 as covered from i""")
def box_overlap(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    box = lambda dx: F.struct((s * 1.0 + dx).alias("x1"), (s * 2.0).alias("y1"), (s + 40.0 + dx).alias("x2"), (s * 2 + 20.0).alias("y2"))
    a, b = box(F.lit(0)), box(k % 7)
    return v.read(spark, d, "part").select("p_partkey", F.round(geometry.iou(a, b), 6).alias("overlap"), geometry.covered_by_any(a, F.array(b)).alias("covered"))


@query()
def html_blocks(spark, d):
    files = v.read(spark, d, "pages").select(F.concat_ws("", F.col("url"), F.lit("#"), F.col("page_id").cast("string")).alias("path"), F.lit(".html").alias("extension"), F.encode("html", "UTF-8").alias("content"))
    return parsers.parse(files).where("block_index is not null").select("path", "block_index", "location_text", "line_start", "line_end", "raw_text")


# --- scalars, lists, planning ------------------------------------------------


@query(f"with {_FILES} select case when extension in {_VIDEO} then 'excluded_video' when parse_status = 'success' then 'indexed' when parse_status in ('failed', 'password_protected') then 'failed' when parse_status = 'unsupported' then 'unsupported' when parse_status = 'metadata_only' then 'metadata_only' else 'failed' end as outcome, count(*) as n_files from f group by 1")
def outcome_counts(spark, d):
    rows = v.registry_files(spark, d).select(scalars.outcome(F.col("parse_status"), F.col("extension")).alias("outcome"))
    return rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("n_files"))


@query("select l_orderkey, l_linenumber, cast(l_linenumber as bigint) * 4294967296 + l_partkey as cursor, cast(l_linenumber as integer) as sheet, cast(l_partkey as bigint) as row_number, cast(l_linenumber as bigint) as natural from lineitem")
def sheet_cursors(spark, d):
    c = scalars.sheet_cursor(F.col("l_linenumber"), F.col("l_partkey"))
    rows = v.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", c.alias("cursor"))
    return rows.select("l_orderkey", "l_linenumber", "cursor", scalars.cursor_sheet(F.col("cursor")).alias("sheet"), scalars.cursor_row(F.col("cursor")).alias("row_number"), scalars.natural_number(F.concat(F.lit("slide"), F.col("l_linenumber").cast("string"), F.lit(".xml"))).alias("natural"))


@query("""select event_id, cast(json_extract(props, '$.k') as integer) as k, nullif(substr(event_type, 1, 4), '') as message, sha256(event_type) as digest,
    case when value * 1000 < 1000 then cast(floor(value * 1000) as bigint) || ' ms' when value < 60 then null else (cast(floor(floor(value * 1000) / 60000.0) as bigint)) || ' min ' || cast(floor((floor(value * 1000) / 1000.0) % 60) as bigint) || ' s' end as elapsed from events""")
def event_fields(spark, d):
    ms = F.floor(F.col("value") * 1000)
    shown = F.when((ms >= 1000) & (F.col("value") < 60), F.lit(None).cast("string")).otherwise(scalars.format_elapsed(ms))
    return v.read(spark, d, "events").select("event_id", scalars.json_fields(F.col("props"), "k int")["k"].alias("k"), scalars.trimmed(F.col("event_type"), 4).alias("message"), scalars.message_digest(F.col("event_type")).alias("digest"), shown.alias("elapsed"))


@query(f"""with {_FILES}, x as (select f.file_id, path, parse_status, '{reports.EXCLUDED_ADVICE}' as recovery_advice, 'excluded' as scope_category from f join e on e.file_id = f.file_id),
    y as (select file_id, path, parse_status, '' as recovery_advice, 'metadata_only' as scope_category from f where parse_status = 'metadata_only' and not is_deleted order by file_id desc limit 500) select * from x union all select * from y""")
def problem_list(spark, d):
    files = v.registry_files(spark, d)
    out = reports.listed(excluded=reports.excluded_files(files, v.registry_exclusions(spark, d)), metadata_only=reports.metadata_only_files(files))
    return out.select("file_id", "path", "parse_status", "recovery_advice", "scope_category")


@query(f"""with {_FILES}, k as (select t.file_id, t.task_id, t.cost, row_number() over (partition by t.file_id order by t.task_id) as source_rank, coalesce(b.n, 0) as n from t left join (select file_id, count(*) as n from t where status = 'running' group by 1) b on b.file_id = t.file_id where t.status = 'queued')
    select file_id, task_id, source_rank from k where source_rank <= 5 - n""")
def capped_claim(spark, d):
    rows = v.tasks(spark, d)
    busy = rows.where("status = 'running'").groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    return tasks.capped(rows.where("status = 'queued'"), "file_id", [F.asc("task_id")], busy, 5).select("file_id", "task_id", F.col("source_rank").cast("long").alias("source_rank"))


@query(f"with {_FILES} select file_id, row_number() over (partition by extension order by size_bytes desc, lower(path)) as place from f")
def longest_first(spark, d):
    jobs = v.registry_files(spark, d).select("file_id", F.col("extension").alias("lane"), F.col("size_bytes").alias("cost"), "path")
    return tasks.longest_first(jobs).select("file_id", F.col("place").cast("long").alias("place"))


@query("""with w as (select event_id as request_id, value from events where event_type = 'view' order by event_id limit 64), s as (select request_id, sum(greatest(1, cast(floor(value * 1000) as bigint))) over (order by request_id) as px, row_number() over (order by request_id) as r from w)
    select request_id from s where r = 1 or px <= 900000""")
def micro_batch(spark, d):
    size = F.floor(F.col("value") * 1000).cast("long")
    rows = v.read(spark, d, "events").select(F.col("event_id").alias("request_id"), F.col("event_id").alias("submitted_ms"), F.col("event_type").alias("compatibility_key"), size.alias("pixel_count"), F.lit(1).cast("long").alias("memory_bytes"))
    first = rows.where("compatibility_key = 'view'")
    return tasks.micro_batch(first, F.lit(10**9).cast("long"), 30, 64, 900_000, 10**9).select("request_id")


@query(f"with {_FILES} select (select count(*) from m where not video and not excluded and parse_status not in ('success', 'metadata_only')) as n_blockers, (select count(*) from t left join e on e.file_id = t.file_id left join f on f.file_id = t.file_id and f.parse_status = 'success' where t.status <> 'complete' and e.file_id is null and f.file_id is null) as n_open_tasks, false as may_publish")
def publish_gate(spark, d):
    return lifecycle.may_publish(v.registry_files(spark, d), v.tasks(spark, d), v.registry_exclusions(spark, d))


@query("""with p as (select p_partkey as document_id, unnest(range(1, p_size % 7 + 2)) as page, p_size from part) select document_id, page, 'pdf_native_page' as task_type, 'page:' || page as unit_key from p
    union all select document_id, page, 'pdf_ocr_page', 'page:' || page from p where page = 2 and p_size % 2 = 0""")
def page_plan(spark, d):
    size = F.col("p_size")
    docs = v.read(spark, d, "part").select(F.col("p_partkey").alias("document_id"), F.lit("d").alias("source_digest"), (size % 7 + 1).cast("int").alias("n_pages"), F.when(size % 2 == 0, F.array(F.lit(2))).otherwise(F.array().cast("array<int>")).alias("scanned"))
    none = spark.createDataFrame([], f"document_id {dict(docs.dtypes)['document_id']}, source_digest string, page int, task_type string, unit_key string, status string")
    return lifecycle.planned_pages(docs, none).select("document_id", "page", "task_type", "unit_key")


@query()
def region_tree(spark, d):
    images = v.spread(v.read(spark, d, "part")).where("p_size > 30").select(F.col("p_partkey").cast("string").alias("image"), (F.col("p_size") * 80).cast("int").alias("width"), (F.col("p_size") * 60).cast("int").alias("height"), F.array(F.array(F.lit(0), F.lit(0), F.lit(500), F.lit(500))).alias("anchors"))
    return recognition.region_tree(images).select("image", "level", "x1", "y1", "x2", "y2", "heat", "state")


def queries() -> dict[str, Query]:
    from . import catalog_files, catalog_state  # noqa: F401  they add their queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


__all__ = ["oracle_sql", "queries"]
