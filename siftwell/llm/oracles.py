"""DuckDB SQL for the corpus queries that SQL can express."""

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _shingles(table: str, key: str, k: int) -> str:
    words = _WORDS.format(_LOWER.format("coalesce(text, '')"))
    return f"""(select {key}, unnest(list_distinct(case when len(w) = 0 then [] when len(w) < {k} then [array_to_string(w, chr(1))]
        else list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k - 1}], chr(1))) end)) as s from (select {key}, {words} as w from {table}))"""


_COUNTS = f"""
words as (select doc_id, lang, source, coalesce(text, '') as t, {_WORDS.format("coalesce(text, '')")} as w from documents),
lines as (select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from (select doc_id, unnest(string_split(t, chr(10))) as line from words)
    where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by doc_id),
windows as (select doc_id, unnest(range(1, len(w) - 3)) as i, w from words where len(w) >= 5),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, array_to_string(w[i:i + 4], chr(1))) as n from windows) where n > 1),
repeats as (select doc_id, count(distinct j) as n_repeat_words from (select doc_id, unnest(range(i, i + 5)) as j from twice) group by doc_id),
c as (select doc_id, lang, source, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols,
    coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_lines, 0) as n_lines
    from words left join lines using (doc_id) left join repeats using (doc_id)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, word_chars * 1000 // greatest(n_words, 1) as wl, n_symbols * 1000 // greatest(n_words, 1) as sy,
    n_dup_lines * 1000 // greatest(n_lines, 1) as dl from c)"""

_QUALITY = f"""with {_COUNTS},
v as (select lang, source, unnest(['wl', 'sy', 'dl']) as rate, unnest([wl, sy, dl]) as v from b where not base_failed),
s as (select lang, source, rate, case when v < 64 then v else (v >> (length(bin(v)) - 6)::int) << (length(bin(v)) - 6)::int end as value, count(*) as n from v group by all),
levels as (select 0 as level, lang, source, rate, value, n from s union all select 1, lang, null, rate, value, sum(n) from s group by lang, rate, value union all select 2, null, null, rate, value, sum(n) from s group by rate, value),
u as (select *, sum(n) over (partition by level, lang, source, rate order by value) as upto, sum(n) over (partition by level, lang, source, rate) as total from levels),
q as (select level, lang, source, rate, max(total) as total, min(value) filter (4 * upto >= total) as q25, min(value) filter (4 * upto >= 3 * total) as q75 from u group by level, lang, source, rate),
g as (select distinct lang, source, rate from s),
f as (select g.lang, g.source, g.rate, case when a.total >= 200 then a.q25 when l.total >= 200 then l.q25 else w.q25 end as q25, case when a.total >= 200 then a.q75 when l.total >= 200 then l.q75 else w.q75 end as q75
    from g join q a on a.level = 0 and a.lang is not distinct from g.lang and a.source is not distinct from g.source and a.rate = g.rate
    join q l on l.level = 1 and l.lang is not distinct from g.lang and l.rate = g.rate join q w on w.level = 2 and w.rate = g.rate),
h as (select lang, source, max(q75 + 3 * (q75 - q25)) filter (rate = 'wl') as wh, max(q25 - 3 * (q75 - q25)) filter (rate = 'wl') as wo,
    max(q75 + 3 * (q75 - q25) + 100) filter (rate = 'sy') as sh, max(q75 + 3 * (q75 - q25) + 300) filter (rate = 'dl') as dh from f group by lang, source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce(
    not (wl > wh and (wl - wh) * (wl - wh) * n_words > 64000000) and not (wl < wo and (wl - wo) * (wl - wo) * n_words > 64000000)
    and not (sy > sh and (sy - sh) * (sy - sh) * n_words > 1000000) and not (dl > dh and (dl - dh) * (dl - dh) * n_lines > 1000000), false) as kept
from b left join h on b.lang is not distinct from h.lang and b.source is not distinct from h.source"""

ORACLES: dict[str, str] = {
    "op2_benchmark_decontamination": f"""with d as {_shingles('documents', 'doc_id', 5)}, i as {_shingles('benchmark', 'item_id', 5)}, n as (select item_id, count(*) as n_item from i group by item_id),
        m as (select doc_id, item_id, count(*) as n_shared from d join i using (s) group by doc_id, item_id)
        select doc_id, item_id, n_shared, n_item from m join n using (item_id) where 100 * n_shared >= 80 * n_item""",
    "op3_chat_formatting": r"""with r as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as t from conversations
            union all select -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]')
        select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' order by turn, role, t)) as turns_sha256,
            coalesce(sum(length(t)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(t, '' order by turn, role, t) filter (role = 'assistant'), '')) as loss_sha256,
            sum(17 + length(role) + len(regexp_extract_all(role, '[\\<\[\n]')) + length(t) + len(regexp_extract_all(t, '[\\<\[]')))::bigint as formatted_chars
        from r group by conv_id""",
    "op4_quality_rules": _QUALITY,
    "op5_warc": """with p as (select page_id, coalesce(html, '') as h, max(page_id) over (partition by coalesce(html, '')) as last from pages), q as (select *, strlen(h)::bigint as n from p)
        select page_id, n as payload_bytes, sha1(h) as payload_digest, case when n >= 1000 and page_id <> last then 'revisit' else 'response' end as record_type,
            case when n >= 1000 and page_id <> last then last end as refers_to from q""",
    "op9_minhash_near_dedup": f"""with recursive s as materialized {_shingles('documents', 'doc_id', 3)}, n as materialized (select doc_id, count(*) as n from s group by doc_id),
        m as (select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by all),
        l as materialized (select a, b from m join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 85 * (x.n + y.n - common)),
        e as materialized (select a, b from l union all select b, a from l), r as (select doc_id as a, doc_id as b from documents union select r.a, e.b from r join e on r.b = e.a),
        c as (select a as doc_id, min(b) as component_id from r group by a)
        select d.doc_id, coalesce(n.n, 0) as n_shingles, component_id, d.doc_id = component_id as kept from documents d join c using (doc_id) left join n using (doc_id)""",
}
