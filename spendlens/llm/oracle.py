"""Independent DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
BLANK = r"'[^\x20\x09-\x0D]+'"

# every pair of shingle sets, then reachability
OP3 = rf"""
with recursive words as (
    select doc_id, regexp_extract_all({LOWER}, {BLANK}) as w from documents
), shingles as (
    select doc_id, unnest(case
        when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' '))
        when len(w) >= 1 then [array_to_string(w, ' ')]
        else [] end) as s
    from words
), sets as (select distinct doc_id, s from shingles),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
shared as (
    select a.doc_id as a, b.doc_id as b, count(*) as n
    from sets a join sets b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2
), links as (
    select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b
    where 100 * shared.n >= 85 * (x.n + y.n - shared.n)
), both_ways as (select a, b from links union all select b, a from links),
reach(node, other) as (
    select a, b from both_ways
    union
    select r.node, e.b from reach r join both_ways e on r.other = e.a
), smallest as (select node, min(other) as m from reach group by node)
select d.doc_id, coalesce(z.n, 0) as n_shingles,
       least(d.doc_id, coalesce(m, d.doc_id)) as component_id,
       d.doc_id <= coalesce(m, d.doc_id) as kept
from documents d left join sizes z using (doc_id) left join smallest on node = d.doc_id
"""

OP4 = rf"""
with doc as (select doc_id, regexp_extract_all({LOWER}, {ALNUM}) as w from documents),
item as (select item_id, regexp_extract_all({LOWER}, {ALNUM}) as w from benchmark),
item_windows as (
    select distinct item_id, span, array_to_string(list_slice(w, i, i + span - 1), ' ') as phrase
    from (select item_id, w, span, unnest(range(1, len(w) - span + 2)) as i
          from (select item_id, w, least(10, len(w)) as span from item where len(w) > 0))
), spans as (select distinct span from item_windows),
doc_windows as (
    select doc_id, span, i, array_to_string(list_slice(w, i, i + span - 1), ' ') as phrase
    from (select doc_id, w, span, unnest(range(1, len(w) - span + 2)) as i from doc, spans where len(w) >= span)
), hits as (select doc_id, i, span, item_id from doc_windows join item_windows using (span, phrase)),
places as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + span)) as p from hits) group by doc_id),
items as (
    select doc_id, count(*) as n_items, string_agg(name, ',' order by name) as names
    from (select distinct doc_id, item_id::varchar as name from hits) group by doc_id
), doc_words as (select doc_id, unnest(w) as word, unnest(range(len(w))) as p from doc),
windows as (select item_id, w, k, least(10, len(w)) as span
            from (select item_id, w, unnest(range(len(w) - least(10, len(w)) + 1)) as k from (select distinct item_id, w from item where len(w) > 0 and item_id is not null))),
window_words as (select item_id, w, k, span, unnest(range(span)) as j, unnest(list_slice(w, k + 1, k + span)) as word from windows),
often as (select word, count(*) as n from doc_words group by word),
anchors as (  -- starts that put the window's rarest word within two places of its place
    select distinct doc_id, item_id, x.w, k, span, p - j + unnest([-2, -1, 0, 1, 2]) as s
    from (select item_id, w, k, span, arg_min(j, n) as j, arg_min(word, n) as word
          from (select v.*, coalesce(n, 0) as n from window_words v left join often using (word)) group by all) x
    join doc_words using (word)
), stood as (
    select a.doc_id, a.item_id, a.w, a.k, a.s, a.span, count(distinct v.j) as n
    from (select *, unnest([-2, -1, 0, 1, 2]) as e from anchors) a
    join window_words v on v.item_id = a.item_id and v.w = a.w and v.k = a.k
    join doc_words d on d.doc_id = a.doc_id and d.word = v.word and d.p = a.s + v.j + a.e
    group by all
), near as (select doc_id, count(distinct item_id) as n_near from stood where n = span group by doc_id)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated,
       coalesce(n_near, 0) as n_near
from doc left join places using (doc_id) left join items using (doc_id) left join near using (doc_id)
"""

# all quotients of all seats, best first
OP7 = r"""
with sized as (
    select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
           ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':20240607'), 1, 15))::bigint as h
    from documents
), per_source as (
    select source, sum(size)::bigint as source_size, count(*) as n_rows,
           [5.0, 2.0, 1.0][(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as weight
    from sized group by source
), filling as (
    select *, 2.0::double * source_size as most,
           sum(source_size) over ()::double * 1.5::double
             - coalesce(sum(2.0::double * source_size) over (order by source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as rest,
           sum(weight) over () - coalesce(sum(weight) over (order by source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as weight_left
    from per_source
), leveled as (
    select *, most * weight_left <= rest * weight as is_full,
           (select rest / weight_left from filling where most * weight_left > rest * weight
            order by source_size / weight, source nulls last limit 1) as level
    from filling
), targets as (select source, source_size, n_rows, case when is_full then most else weight * level end as target from leveled),
seats as (
    select source, target / (2 * s + 1) as quotient
    from (select source, target, unnest(range(0, (source_size * 2 // 32)::bigint)) as s from targets)
), won as (
    select source, count(*) as quota
    from (select source, row_number() over (order by quotient desc, source nulls last) as place from seats)
    where place <= (select sum(least(round(target / 32), source_size * 2 // 32))::bigint from targets) group by source
), dealt as (
    select doc_id, sized.source, size, h, source_size, target, coalesce(quota, 0) as quota,
           least(round(target)::bigint, source_size * 2) as owed, (h >> 20) % ceil(n_rows / 2000.0)::bigint as shard
    from sized join targets on sized.source is not distinct from targets.source
    left join won on sized.source is not distinct from won.source
), shards as (select source, shard, sum(size)::bigint as shard_size, any_value(quota) as quota, any_value(owed)::bigint as owed from dealt group by source, shard),
shard_seats as (
    select source, shard, quota, shard_size::double / (2 * s + 1) as quotient
    from (select *, unnest(range(0, (shard_size * 2 // 32)::bigint)) as s from shards)
), shard_won as (
    select source, shard, count(*) as shard_quota
    from (select *, row_number() over (partition by source order by quotient desc, shard) as place from shard_seats)
    where place <= quota group by source, shard
), blocks as (
    select s.*, coalesce(shard_quota, 0) * 32 as given, owed - sum(coalesce(shard_quota, 0) * 32) over (partition by s.source) as rest
    from shards s left join shard_won w on s.source is not distinct from w.source and s.shard = w.shard
), settled as (  -- up to its own end each shard has given what the words owed until there allow
    select source, shard, shard_size, case when rest >= 0
             then given + least(2 * shard_size - given, greatest(0, rest - (sum(2 * shard_size - given) over upto - (2 * shard_size - given))))
             else given - least(given, greatest(0, -rest - (sum(given) over upto - given))) end as words
    from blocks window upto as (partition by source order by shard)
), placed as (
    select d.*, s.shard_size, s.words,
           coalesce(sum(size) over (partition by d.source, d.shard order by h, doc_id, size rows between unbounded preceding and 1 preceding), 0) as start
    from dealt d join settled s on d.source is not distinct from s.source and d.shard = s.shard
)
select doc_id, source, size, source_size, target,
       (greatest(0, least(size, words - start)) + greatest(0, least(size, words - shard_size - start)))::bigint as taken
from placed
"""

# binomial tails summed term by term with log-gamma
OP10 = rf"""
with texts as (select doc_id, lang, coalesce(text, '') as text from documents),
words as (select doc_id, lang, text, regexp_extract_all(text, {BLANK}) as w, string_split(text, chr(10)) as lines from texts),
windows as (
    select doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') as phrase
    from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from words where len(w) >= 8)
), twice as (
    select doc_id, unnest(range(i, i + 8)) as place
    from (select doc_id, i, count(*) over (partition by doc_id, phrase) as n from windows) where n > 1
), repeated as (select doc_id, count(distinct place) as n_repeat_words from twice group by doc_id),
counts as (
    select doc_id, lang, len(w) as n_words,
           coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
           (length(text) - length(translate(text, '#*$%&|<>', ''))) as n_symbols,
           len(list_filter(lines, lambda x: regexp_matches(x, {BLANK}))) - len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, {BLANK})))) as n_dup_lines,
           coalesce(n_repeat_words, 0) as n_repeat_words, len(lines) as n_lines
    from words left join repeated using (doc_id)
), base as (
    select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
           [n_symbols / greatest(1, n_words)::double, n_repeat_words / greatest(1, n_words)::double,
            n_dup_lines / n_lines::double, word_chars / greatest(1, n_words)::double] as measured
    from counts
), cutoffs(rule, name, steps) as (values
    (1, 'symbols_per_word', [4.0, 3.0, 2.0, 1.5, 1.0, 0.75, 0.5, 0.35, 0.25]::double[]),
    (2, 'repeated_share', [0.28, 0.25, 0.2, 0.15, 0.1]::double[]),
    (3, 'duplicate_line_share', [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3]::double[]),
    (4, 'chars_per_word', [100.0, 50.0, 30.0, 20.0, 15.0, 12.0]::double[])
), steps as (select rule, name, unnest(steps) as cutoff from cutoffs),
good as (select lang, measured from base join labels using (doc_id) where quality = 1 and not base_failed),
tested as (
    select lang, rule, cutoff, count(*) as n, count(*) filter (where measured[rule] > cutoff) as k,
           (select count(distinct coalesce(lang, chr(0))) from good) as strata
    from good, steps group by lang, rule, cutoff
), tails as (
    select *, case when k >= n * 0.01 then 1.0 else list_sum(list_transform(range(0, k + 1), lambda i:
        exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.01) + (n - i) * ln(0.99)))) end as tail
    from tested
), admitted as (
    select lang, rule, min(cutoff) as cutoff from (
        select *, bool_and(tail <= 0.05 / (strata * 4)) over (partition by lang, rule order by cutoff desc rows unbounded preceding) as ok from tails
    ) where ok group by lang, rule
), broken as (
    select doc_id, string_agg(name, ',' order by a.rule) as rules_broken
    from base join admitted a on base.lang is not distinct from a.lang join cutoffs using (rule)
    where measured[a.rule] > a.cutoff group by doc_id
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       coalesce(rules_broken, '') as rules_broken, not base_failed and rules_broken is null as kept
from base left join broken using (doc_id)
"""

ORACLE: dict[str, str] = {
    "op3_near_dedup": OP3, "op4_decontaminate": OP4, "op7_mixing": OP7, "op10_quality_rules": OP10,
}
