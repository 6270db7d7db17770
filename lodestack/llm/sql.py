"""DuckDB SQL of those operators that SQL can express on whole tables."""

from __future__ import annotations

from .quality import RULES

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def packing(buckets: int = 16, budget: int = 65_536, fine: int = 4096, shard: int = 4096) -> str:
    return f"""with recursive w as (select doc_id, cast(len({_WORDS}) as bigint) as n from documents),
    b as (select max(n) as length, count(*) as c from w where n > 0 group by case when n <= {fine} then n else cast(ceil(n / pow(2, floor(log2(n)) - 6)) * pow(2, floor(log2(n)) - 6) as bigint) end),
    h as (select list(cast(length as double) order by length) as ls, list(cum order by length) as ds, count(*) as m from (select length, cast(sum(c) over (order by length) as double) as cum from b)),
    r(k, ls, ds, m, best, back) as (
        select 1, ls, ds, m, [ls[j] * ds[j] for j in range(1, m + 1)], cast([] as bigint[][]) from h union all
        select k + 1, ls, ds, m, [list_min(x) for x in s], list_append(back, [cast(list_position(x, list_min(x)) as bigint) for x in s])
        from (select *, [[best[i] + ls[j] * (ds[j] - ds[i]) for i in range(1, j)] for j in range(1, m + 1)] as s from r where k < {buckets} and k < m)),
    p as (select * from r where best[m] is not null order by best[m], k limit 1),
    t(k, j) as (select k, m from p union all select t.k - 1, p.back[t.k - 1][t.j] from t, p where t.k > 1),
    o as (select cast(p.ls[t.j] as bigint) as bound from t, p),
    x as (select w.doc_id, w.n, (select min(bound) from o where bound >= w.n) as bound from w where n > 0),
    z as (select bound, cast(greatest(1, round(count(*) / {shard}.0)) as bigint) as shards from x group by bound),
    y as (select doc_id, n, bound, cast(('0x' || substr(md5(concat_ws(' ', doc_id, n)), 1, 8)) as bigint) % shards as shard from x join z using (bound))
    select doc_id, n as n_tokens, bound as bucket_length, shard,
        cast((row_number() over (partition by bound, shard order by doc_id, n) - 1) // greatest(1, {budget} // bound) as bigint) as batch, bound - n as n_padding from y
    union all select doc_id, n, 0, 0, null, 0 from w where n = 0"""


def quality(risk: float = 0.01, error: float = 0.05) -> str:
    p = risk / len(RULES)
    grid = " union all ".join(f"select '{rule}' as rule, {c}e0 as cutoff" for rule, cuts in RULES.items() for c in cuts)
    share = " ".join(f"when '{rule}' then {rule}" for rule in RULES)
    tests = sum(map(len, RULES.values()))
    return rf"""with d as (select doc_id, lang, coalesce(text, '') as text, {_WORDS} as ws from documents),
    g as (select doc_id, i, array_to_string(ws[i : i + 7], ' ') as g from (select doc_id, ws, unnest(range(1, len(ws) - 6)) as i from d)),
    s as (select doc_id, i, lead(i) over (partition by doc_id order by i) as j from (select *, count(*) over (partition by doc_id, g) as c from g) where c > 1),
    v as (select doc_id, cast(sum(least(8, coalesce(j - i, 8))) as bigint) as n_repeat_words from s group by doc_id),
    l as (select doc_id, [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] as ls from d),
    f as (select d.doc_id, coalesce(lang, '') as stratum, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars, cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
        cast(len(ls) as bigint) as n_lines, cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words from d join l using (doc_id) left join v using (doc_id)),
    q as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, coalesce(n_symbols / nullif(word_chars, 0), 0) as symbol_share, coalesce(n_dup_lines / nullif(n_lines, 0), 0) as dup_line_share,
        coalesce(n_repeat_words / nullif(n_words, 0), 0) as repeat_share, coalesce(word_chars / nullif(n_words, 0), 0) as word_length from f),
    k as (select doc_id, max(quality) > 0 as good from labels where doc_id is not null and quality is not null group by doc_id),
    a as (select stratum, good, {", ".join(RULES)} from q join k using (doc_id) where not base_failed),
    n as (select stratum, count(*) filter (good) as n_good, count(*) over () as strata from a group by stratum),
    c as (select stratum, rule, cutoff, count(*) filter (good and x > cutoff) as good, count(*) filter (not good and x > cutoff) as bad from (select a.*, rule, cutoff, case rule {share} end as x from a cross join ({grid})) group by all),
    e as (select c.*, case when c.good >= n_good * {p} then 1 else (select sum(exp(lgamma(n_good + 1) - lgamma(i + 1) - lgamma(n_good - i + 1) + i * ln({p}) + (n_good - i) * ln(1 - {p}))) from unnest(range(0, c.good + 1)) as u(i)) end as p_value, strata from c join n using (stratum)),
    u as (select stratum, rule, min(cutoff) as cutoff from e where p_value <= {error} / (strata * {tests}) and bad > good group by stratum, rule)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        not base_failed and not exists (select 1 from u where u.stratum = q.stratum and (case u.rule {share} end) > u.cutoff) as kept from q"""
