"""Registered queries of parsers, archives, keys and caches over files made from tables, and their SQL."""

from __future__ import annotations

import pyspark.sql.functions as F

from ..functions import text as tx
from ..sources import files, parsers, sinks
from . import samples
from . import views as v
from .catalog import query


def _blocks(spark, d, extension: str, *columns: str):
    found = parsers.parse(samples.part_files(spark, d, extension)).where("block_index is not null")
    return found.select("path", "block_index", "block_type", "location_text", "raw_text", *columns)


def _rows(*rows: str) -> str:
    """Blocks of each part as a union; a row is what follows the path in the select."""
    return " union all ".join(f"select cast(p_partkey as varchar) as path, {r}" for r in rows)


@query(
    _rows(
        "0 as block_index, 'docx_paragraph' as block_type, '段落 1' as location_text, p_name as raw_text from part",
        "1, 'docx_table_row', '表格行 1', p_brand || ' | ' || p_type from part",
        "2, 'docx_paragraph', '段落 3', 'size ' || p_size from part",
        "3, 'docx_header_footer', 'footer1', 'part ' || p_partkey from part",
    )
)
def docx_blocks(spark, d):
    return _blocks(spark, d, ".docx")


@query(
    _rows(
        "0 as block_index, 'xlsx_row' as block_type, p_brand || ' 第 1 行' as location_text, 'A1=' || p_name || ' | C1=' || p_size as raw_text, p_brand as sheet_name, 'A1' as cell_start, 'C1' as cell_end from part",
        "1, 'xlsx_row', p_brand || ' 第 4 行', 'B4==C1*2 | D4=' || case when p_size % 2 = 1 then 'TRUE' else 'FALSE' end || ' | E4=' || p_type, p_brand, 'B4', 'E4' from part",
    )
)
def xlsx_blocks(spark, d):
    return _blocks(spark, d, ".xlsx", "sheet_name", "cell_start", "cell_end")


@query(
    _rows(
        "0 as block_index, 'pptx_slide' as block_type, '幻灯片 1' as location_text, p_name as raw_text, 1 as slide_number from part",
        "1, 'pptx_notes', '备注 1', p_brand, 1 from part",
        "2, 'pptx_slide', '幻灯片 2', p_type, 2 from part",
    )
)
def pptx_blocks(spark, d):
    return _blocks(spark, d, ".pptx", "slide_number")


@query(
    _rows(
        "0 as block_index, 'pdf_page' as block_type, '第 1 页' as location_text, p_name || chr(10) || p_brand as raw_text, 1 as page_number from part",
        "1, 'pdf_page', '第 2 页', p_type, 2 from part where p_size % 2 = 1",
    )
)
def pdf_blocks(spark, d):
    return _blocks(spark, d, ".pdf", "page_number")


@query("""with p as (select p_partkey, 1 as page, p_name || chr(10) || p_brand as t from part union all select p_partkey, 2, case when p_size % 2 = 1 then p_type else '' end from part)
    select cast(p_partkey as varchar) as path, page, sha256(concat_ws('|', page, '612.0', '792.0', 1, sha256(t))) as identity, length(regexp_replace(t, '\\s', '', 'g')) < 20 as is_scanned from p""")
def pdf_page_identities(spark, d):
    return parsers.pdf_pages(samples.part_files(spark, d, ".pdf")).select("path", "page", "identity", "is_scanned")


@query(
    _rows(
        "0 as block_index, 'zip_text' as block_type, 'a.txt > 第 1-1 行' as location_text, p_name as raw_text from part",
        "1, 'zip_text', 'sub/b.txt > 第 1-1 行', p_type from part where p_partkey % 2 = 0",
        "2 - p_partkey % 2, 'zip_text', 'in.zip > deep.md > 第 1-1 行', p_brand from part",
    )
)
def zip_blocks(spark, d):
    return _blocks(spark, d, ".zip")


@query("select cast(p_partkey as varchar) as path, case when p_partkey % 2 = 1 then 'partial_success' else 'success' end as status, case when p_partkey % 2 = 1 then 'ZIP_MEMBER_FAILED' end as error_code from part")
def zip_statuses(spark, d):
    return parsers.parse(samples.part_files(spark, d, ".zip")).where("block_index is null").select("path", "status", "error_code")


@query("""select p_partkey || ' > a.txt' as path, 'a.txt' as internal_path, length(p_name) as size_bytes, 'pending' as status from part union all
    select p_partkey || case when p_partkey % 2 = 1 then ' > ../up.txt' else ' > sub/b.txt' end, case when p_partkey % 2 = 1 then '../up.txt' else 'sub/b.txt' end, length(p_type), case when p_partkey % 2 = 1 then 'failed' else 'pending' end from part union all
    select p_partkey || ' > in.zip > deep.md', 'in.zip > deep.md', length(p_brand), 'pending' from part""")
def zip_manifest(spark, d):
    return parsers.zip_manifest(samples.part_files(spark, d, ".zip")).select("path", "internal_path", "size_bytes", "status")


@query(r"""with l as (select doc_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) as ls from documents where length(text) > 0), b as (select doc_id, ls, unnest(range(0, (len(ls) - 1) // 500 + 1)) as i from l)
    select cast(doc_id as varchar) as path, cast(i as integer) as block_index, '第 ' || (i * 500 + 1) || '-' || least(i * 500 + 500, len(ls)) || ' 行' as location_text, md5(array_to_string(ls[i * 500 + 1 : i * 500 + 500], chr(10))) as digest from b""")
def text_file_blocks(spark, d):
    """documents as text files, every third one in UTF-16 with a mark."""
    data = F.when(F.col("doc_id") % 3 == 1, F.encode("text", "UTF-16")).otherwise(F.encode("text", "UTF-8"))
    rows = v.read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.lit(".txt").alias("extension"), data.alias("content"))
    found = parsers.parse(rows).where("block_index is not null")
    return found.select("path", "block_index", "location_text", F.md5("raw_text").alias("digest"))


@query("select doc_id, case when doc_id % 5 = 0 then 'metadata:' || sha256(concat_ws('|', 'p' || doc_id, n_chars, '1.5')) else 'sha256:' || sha256(text) end as content_key from documents")
def content_keys(spark, d):
    rows = v.read(spark, d, "documents").select("doc_id", F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("path"), F.when(F.col("doc_id") % 5 == 0, ".mp4").otherwise(".txt").alias("extension"), F.col("n_chars").alias("size_bytes"), F.lit(1.5).alias("modified_time"), F.encode("text", "UTF-8").alias("content"))
    return files.with_content_key(rows).select("doc_id", "content_key")


@query("select 'p' || p_partkey as path, 'SOURCE_CHANGED' as error_code from part where p_partkey % 7 = 0 or p_partkey % 5 = 1 or p_partkey % 11 = 3")
def changed_sources(spark, d):
    k = F.col("p_partkey")
    rows = v.read(spark, d, "part").select(F.concat(F.lit("p"), k.cast("string")).alias("path"), F.col("p_size").alias("size_bytes"), F.lit(1.0).alias("modified_time"), "p_partkey")
    late = rows.where(k % 7 != 0).withColumn("size_bytes", F.col("size_bytes") + F.when(k % 5 == 1, 1).otherwise(0)).withColumn("modified_time", F.when(k % 11 == 3, 2.0).otherwise(1.0))
    return files.source_changed(rows.drop("p_partkey"), late.drop("p_partkey"))


_NAMES = [".hidden", "~$lock", "plain", "x.tmp", "Plain"]


@query("""select p_partkey, ['.hidden', '~$lock', 'plain', 'x.tmp', 'Plain'][p_partkey % 5 + 1] || case when p_size % 2 = 0 then '.DOCX' else '.docx' end as name, case when p_partkey % 5 = 0 then true when p_partkey % 5 = 1 then p_size % 2 = 1 else false end as skipped, '.docx' as extension from part where p_partkey % 5 <> 3
    union all select p_partkey, 'x.tmp', true, '.tmp' from part where p_partkey % 5 = 3""")
def scan_rules(spark, d):
    """Hidden names and excluded patterns, which match case by case; extensions in lower case."""
    k = F.col("p_partkey")
    base = F.element_at(F.array(*map(F.lit, _NAMES)), (k % 5 + 1).cast("int"))
    name = F.when(k % 5 == 3, base).otherwise(F.concat(base, F.when(F.col("p_size") % 2 == 0, ".DOCX").otherwise(".docx")))
    rows = v.read(spark, d, "part").select("p_partkey", name.alias("name"))
    return rows.select("p_partkey", "name", files.hidden_or_excluded(F.col("name")).alias("skipped"), files.extension(F.concat(F.lit("/a/"), "name")).alias("extension"))


@query("select event_id from events where event_id % 3 > 0")
def verified_rows(spark, d):
    """Rows whose checksum no longer fits go."""
    rows = sinks.checked(v.read(spark, d, "events").select("event_id", "event_type", "user_id"), ["event_type", "user_id"])
    torn = rows.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")))
    return sinks.verified(torn, ["event_type", "user_id"]).select("event_id")


@query("""select p_partkey as key from part where p_size % 10 = 0 union all (select p_partkey from part where p_size % 10 > 0 and p_partkey * 60 >= 3600 order by p_partkey desc limit 100)""")
def pruned_cache(spark, d):
    rows = v.read(spark, d, "part").select(F.col("p_partkey").alias("key"), F.timestamp_seconds(F.col("p_partkey") * 60).alias("created_at"), "p_size")
    return sinks.pruned_cache(rows.drop("p_size"), rows.where("p_size % 10 = 0"), 100, 10**6, F.timestamp_seconds(F.lit(10**6 + 3600))).select("key")


@query(r"""with d as (select doc_id, text, regexp_extract(text, '(?s)^(.*?)mail[0-9]', 1) as head, regexp_matches(text, 'mail[0-9]') as found from documents),
    w as (select *, greatest(0, length(head) - 80) as f, least(length(text), length(head) + 5 + 120) as t from d)
    select doc_id, case when found then case when f > 0 then '...' else '' end || replace(substr(text, f + 1, t - f), chr(10), ' ') || case when t < length(text) then '...' else '' end
        else substr(text, 1, 200) || case when length(text) > 200 then '...' else '' end end as context from w""")
def regex_contexts(spark, d):
    shown = tx.context_udf([], "mail[0-9]", {})
    return v.read(spark, d, "documents").select("doc_id", shown("text").alias("context"))
