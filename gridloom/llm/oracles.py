"""The queries of this subpackage as DuckDB SQL, where SQL can express them."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP1 = """
with p as (select page_id, url, coalesce(html, '') as payload from pages),
d as (select page_id, url, strlen(payload)::bigint as payload_bytes, sha1(payload) as payload_digest from p),
m as (select payload_digest, max(page_id) as top from d where payload_bytes >= 1000 group by payload_digest)
select page_id, url, payload_bytes, d.payload_digest,
  case when payload_bytes >= 1000 and top is not null and page_id is distinct from top then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id is distinct from top then top end as refers_to
from d left join m on d.payload_digest = m.payload_digest
"""

OP2 = r"""
with raw as (select doc_id, text, string_split(coalesce(text, ''), chr(10)) as parts from documents),
every as (select doc_id, unnest(parts) as line, unnest(range(len(parts))) as line_no from raw),
worded as (select doc_id, line_no, line, row_number() over (partition by doc_id order by line_no) - 1 as place
  from every where regexp_matches(line, '[^\x20\x09-\x0D]')),
same as (select a.doc_id, a.line_no, a.place, length(a.line) as chars, b.doc_id as other, a.place - b.place as gap
  from worded a join worded b on a.line = b.line and (b.doc_id < a.doc_id or (b.doc_id = a.doc_id and b.place < a.place))),
run as (select *, place - row_number() over (partition by doc_id, other, gap order by place) as run from same),
gone as (select distinct doc_id, line_no from (select *, sum(chars) over (partition by doc_id, other, gap, run) as size from run) where size >= 40),
kept as (select e.doc_id, coalesce(string_agg(e.line, chr(10) order by e.line_no), '') as kept from every e
  where not exists (select 1 from gone g where g.doc_id = e.doc_id and g.line_no = e.line_no) group by e.doc_id)
select r.doc_id, (select count(*) from worded w where w.doc_id = r.doc_id)::bigint as n_lines,
  (select count(*) from gone g where g.doc_id = r.doc_id)::bigint as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256
from raw r left join kept k on r.doc_id = k.doc_id
"""

OP3 = rf"""
with d as (select doc_id, coalesce(text, '') as text, {_WORDS} as words from documents),
w as (select doc_id, unnest(words) as word, unnest(range(len(words))) as i, words from d),
at3 as (select doc_id, i, count(*) over (partition by doc_id, list_slice(words, i + 1, i + 3)) as n from w where i + 3 <= len(words)),
r3 as (select doc_id, count(distinct i + k)::bigint as n_repeat_words from at3, range(3) t(k) where n > 1 group by doc_id),
at10 as (select doc_id, i, count(*) over (partition by doc_id, list_slice(words, i + 1, i + 10)) as n from w where i + 10 <= len(words)),
r10 as (select doc_id, count(distinct i + k)::bigint as covered_words from at10, range(10) t(k) where n > 1 group by doc_id),
pairs as (select a.doc_id, a.i, b.i as j from w a join w b on a.doc_id = b.doc_id and a.word = b.word and a.i < b.i
  where a.i + 1 < len(a.words) and b.i + 1 < len(a.words) and a.words[a.i + 2] = a.words[b.i + 2]),
runs as (select doc_id, j - i as gap, i - row_number() over (partition by doc_id, j - i order by i) as g, count(*) over (partition by doc_id, j - i) as n, i from pairs),
long as (select doc_id, max(n) + 1 as longest_repeat from (select doc_id, gap, g, count(*) as n from runs group by all) group by doc_id),
lines as (select doc_id, unnest(string_split(text, chr(10))) as line from d),
dup as (select doc_id, count(*) - count(distinct line) as n_dup_lines from lines where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
c as (select d.doc_id, len(words)::bigint as n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(covered_words, 0)::bigint as covered_words, coalesce(longest_repeat, 0)::bigint as longest_repeat
  from d left join dup using (doc_id) left join r3 using (doc_id) left join r10 using (doc_id) left join long using (doc_id))
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and covered_words <= 0.3::double * n_words and longest_repeat <= 100 as kept
from c
"""

OP4 = rf"""
with d as (select doc_id, {_WORDS} as words from documents),
w as (select doc_id, unnest(words) as word, unnest(range(len(words))) as i, words from d),
win as (select doc_id, i, md5(array_to_string(list_slice(words, i + 1, i + 35), ' ')) as h from w where i + 35 <= len(words)),
rep as (select doc_id, i from (select *, count(*) over (partition by h) as n from win) where n > 1),
gone as (select distinct doc_id, i + k as i from rep, range(35) t(k)),
kept as (select w.doc_id, string_agg(word, ' ' order by w.i) as kept, count(*) as n from w anti join gone g on w.doc_id = g.doc_id and w.i = g.i group by w.doc_id)
select d.doc_id, len(words)::bigint as n_words, (len(words) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join kept using (doc_id)
"""

OP5 = rf"""
with b as (select item_id::varchar as item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') as words from benchmark),
d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') as words from documents),
win as (select distinct item_id, least(10, len(words)) as n, array_to_string(list_slice(words, i + 1, i + least(10, len(words))), ' ') as win
  from (select *, unnest(range(len(words) - least(10, len(words)) + 1)) as i from b where len(words) > 0)),
sizes as (select distinct n from win),
spot as (select doc_id, n, i, array_to_string(list_slice(words, i + 1, i + n), ' ') as win from (select doc_id, words, n, unnest(range(len(words) - n + 1)) as i from d, sizes where len(words) >= n)),
hit as (select doc_id, i, spot.n, item_id from spot join win on spot.n = win.n and spot.win = win.win),
words_hit as (select doc_id, count(distinct i + k)::bigint as n_hit from (select distinct doc_id, i, n from hit), range(10) t(k) where k < n group by doc_id),
items as (select doc_id, count(*)::bigint as n_items, string_agg(item_id, ',' order by item_id) as items from (select distinct doc_id, item_id from hit) group by doc_id)
select d.doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words_hit using (doc_id) left join items using (doc_id)
"""

OP6 = """
with t as (select conv_id // 2 as pair_id, conv_id % 2 = 0 as is_chosen, turn, coalesce(role, 'none') as role, coalesce(text, '') as text from conversations where conv_id is not null),
n as (select *, row_number() over (partition by pair_id, is_chosen order by turn, role, text) as k, count(*) over (partition by pair_id, is_chosen) as many from t),
sizes as (select pair_id, coalesce(max(many) filter (is_chosen), 0) as c, coalesce(max(many) filter (not is_chosen), 0) as r from n group by pair_id),
differs as (select a.pair_id, min(a.k) as k from n a join n b on a.pair_id = b.pair_id and a.k = b.k and a.is_chosen and not b.is_chosen where a.role <> b.role or a.text <> b.text group by a.pair_id),
p as (select s.pair_id, c, r, coalesce(d.k - 1, least(c, r)) as prompt_turns from sizes s left join differs d using (pair_id)),
piece as (select n.*, prompt_turns, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) as piece from n join p using (pair_id)),
spot as (select *, coalesce(sum(length(piece)) filter (k > prompt_turns) over (partition by pair_id, is_chosen order by k), 0) - length(piece) as begin_at from piece),
text as (select pair_id,
    coalesce(string_agg(piece, '' order by k) filter (is_chosen and k <= prompt_turns), '') as prompt,
    coalesce(string_agg(piece, '' order by k) filter (is_chosen and k > prompt_turns), '') as chosen,
    coalesce(string_agg(piece, '' order by k) filter (not is_chosen and k > prompt_turns), '') as rejected,
    coalesce(string_agg((begin_at + length(role) + 5)::bigint || '-' || (begin_at + length(piece) - 1)::bigint, ',' order by k) filter (is_chosen and k > prompt_turns and role = 'assistant'), '') as chosen_mask,
    coalesce(string_agg((begin_at + length(role) + 5)::bigint || '-' || (begin_at + length(piece) - 1)::bigint, ',' order by k) filter (not is_chosen and k > prompt_turns and role = 'assistant'), '') as rejected_mask
  from spot group by pair_id)
select p.pair_id, case when c = 0 or r = 0 then 'unpaired' when prompt_turns = c and prompt_turns = r then 'identical' when prompt_turns in (c, r) then 'prefix' else 'pair' end as status,
  prompt_turns::bigint as prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask
from p join text using (pair_id)
"""


def op7(rounds: int = 200) -> str:
    dims = ("source", "lang", "topic")
    totals = ", ".join(f"pow(sum(tokens) over (partition by {d}), 0.5) as p_{d}" for d in dims)
    shares = ", ".join(
        f"(select any_value(p_{d}) from base b where b.{d} = c.{d}) * (select sum(tokens) from base) / (select sum(p) from (select any_value(p_{d}) as p from base group by {d})) as t_{d}" for d in dims
    )
    step = "last"
    for d in dims:
        step = f"(select * exclude (raked), raked * t_{d} / nullif(sum(raked) over (partition by {d}), 0) as raked from {step})"
    return rf"""
with recursive docs as (select doc_id, source, lang,
    case when contains(text, '|') then 'table' when regexp_matches(text, '[#<>]') then 'markup' when length(text) < 500 then 'short' else 'prose' end as topic,
    len({_WORDS})::bigint as n_tokens from documents),
cells as (select source, lang, topic, sum(n_tokens)::double as tokens from docs group by all),
base as materialized (select *, {totals} from cells),
cells0 as materialized (select c.source, c.lang, c.topic, c.tokens, {shares}, c.tokens as raked from base c),
last as (select 0 as round, * from cells0 union all select round + 1, * exclude (round) from {step} where round < {rounds}),
ratio as materialized (select *, raked / tokens as ratio from last where round = {rounds}),
ordered as materialized (select *, coalesce(sum(tokens) over (order by ratio desc rows between unbounded preceding and 1 preceding), 0) as whole,
    sum(raked) over (order by ratio desc rows between current row and unbounded following) as rest, sum(tokens) over () * 0.5::double as budget from ratio),
scale as (select (budget - whole) / rest as scale from ordered where (budget - whole) / rest * ratio <= 1 order by ratio desc limit 1)
select doc_id, d.source, d.lang, d.topic, n_tokens, round(ratio, 6) as weight, round(least(1, ratio * scale), 6) as probability,
  ('0x' || substr(md5('mix:' || doc_id), 1, 12))::bigint / 281474976710656::double < least(1, ratio * scale) as taken
from docs d join ratio r on d.source = r.source and d.lang = r.lang and d.topic = r.topic, scale
"""

#: Bigrams; the discounts as counted, or from the line through their logarithms (all counts of counts are over 0 here).
OP8 = rf"""
with raw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x20\x09-\x0D]+') as words,
    xor(list_reduce([4294967295] || list_transform(range(length(doc_id::varchar)), lambda i: ascii(substr(doc_id::varchar, i::int + 1, 1))::bigint),
      lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295) % 7 = 2 as held_out from documents),
tok as materialized (select doc_id, held_out, word, coalesce(lag(word) over (partition by doc_id order by i), ' ') as prev
  from (select doc_id, held_out, unnest(list_append(words, '')) as word, unnest(range(len(words) + 1)) as i from raw)),
w1 as materialized (select word, count(*) as c from tok where not held_out group by word),
w2 as materialized (select prev, word, count(*) as c from tok where not held_out group by all),
cc as (select 1 as k, c as r, count(*)::double as n from w1 where c <= 6 group by c union all select 2, c, count(*) from w2 where c <= 6 group by c),
ends as (select k, 6 * max(n) filter (r = 6) / max(n) filter (r = 1) as whole, regr_slope(ln(n), ln(r)) as slope from cc group by k),
counted as (select a.k, a.r, ((a.r + 1) * b.n / (a.r * a.n) - whole) / (1 - whole) as d, whole < 1 as ok from cc a join cc b on a.k = b.k and b.r = a.r + 1 join ends e on e.k = a.k),
good as (select k, bool_and(ok and d > 0 and d < 1 and d >= before) as good from (select *, coalesce(lag(d) over (partition by k order by r), 0) as before from counted) group by k),
d as materialized (select c.k, c.r, case when good then c.d else (pow(c.r + 1, slope + 1) / pow(c.r, slope + 1) - pow(6, slope + 1)) / (1 - pow(6, slope + 1)) end as d
  from counted c join good g on g.k = c.k join ends e on e.k = c.k),
n as (select sum(c) as n, count(*) as v, sum(case when c <= 5 then (1 - d) * c else 0 end) / sum(c) as unknown from w1 left join d on k = 1 and r = c),
p1 as materialized (select word, c, c * coalesce(d, 1) / n as p from w1 left join d on k = 1 and r = c, n),
p2 as materialized (select prev, w2.word, w2.c, w2.c * coalesce(d, 1) as kept, p1.p as lower from w2 join p1 on p1.word = w2.word left join d on k = 2 and r = w2.c),
before as materialized (select prev, sum(c) + bool_and(c > 5)::int as total, (case when bool_and(c > 5) then 1 / (sum(c) + 1) else sum(c - kept) / sum(c) end) / (1 - sum(lower)) as weight from p2 group by prev),
scored as (select doc_id, held_out, n, p1.c, log10((coalesce(p1.c, 0) + 1) / (n + v + 1)) as base, log10(coalesce(kept / total, coalesce(weight, 1) * coalesce(p1.p, unknown))) as score
  from tok left join p1 on p1.word = tok.word left join p2 on p2.prev = tok.prev and p2.word = tok.word left join before on before.prev = tok.prev, n)
select doc_id, held_out, count(*) as n_tokens, count(c) as n_known, any_value(n)::bigint as train_tokens, round(sum(base), 6) as base_score, round(sum(score), 6) as score from scored group by doc_id, held_out
"""

OP9 = rf"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x20\x09-\x0D]+') as words from documents),
s as (select distinct doc_id, md5(array_to_string(list_slice(words, i + 1, i + least(5, len(words))), ' ')) as h
  from (select *, unnest(range(len(words) - least(5, len(words)) + 1)) as i from d where len(words) > 0)),
n as (select doc_id, count(*)::bigint as n from s group by doc_id),
shared as (select a.doc_id as x, b.doc_id as y, count(*) as k from s a join s b on a.h = b.h and a.doc_id <> b.doc_id group by all),
link as (select x, y from shared join n p on p.doc_id = x join n q on q.doc_id = y where 100 * k >= 75 * (p.n + q.n - k)),
reach(x, y) as (select doc_id, doc_id from d union select r.x, l.y from reach r join link l on r.y = l.x)
select d.doc_id, coalesce(n.n, 0) as n_shingles, (select min(y) from reach r where r.x = d.doc_id) as component_id from d left join n using (doc_id)
"""

OP13 = rf"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') as words from documents),
w as (select doc_id, unnest(words) as word from d),
b as (select unnest(regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')) as word from benchmark),
h as materialized (select word, xor(list_reduce([4294967295] || list_transform(range(strlen(word)), lambda i: ('0x' || substr(hex(word), i::int * 2 + 1, 2))::bigint),
    lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295) % 10000 as bucket
  from (select distinct word from (select word from w union all select word from b))),
s as (select bucket, count(*)::double as s from w join h using (word) group by bucket),
t as (select bucket, count(*)::double as t from b join h using (word) group by bucket),
g as (select k as bucket, floor(1000 * ln((coalesce(t, 0) + 1) * ((select count(*) from w)::double + 10000) / ((coalesce(s, 0) + 1) * ((select count(*) from b)::double + 10000))))::bigint as gain
  from range(10000) r(k) left join s on s.bucket = k left join t on t.bucket = k),
weight as (select doc_id, sum(gain)::bigint as weight from w join h using (word) join g using (bucket) group by doc_id),
score as (select d.doc_id, len(words)::bigint as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score from d left join weight using (doc_id)),
place as (select doc_id, row_number() over (order by score desc, doc_id) as place, count(*) over () as many from score where n_features >= 20)
select score.*, case when place <= 10 * many // 100 then place end as rank from score left join place using (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": OP1, "op2_line_dedup": OP2, "op3_quality_rules": OP3, "op4_substring_dedup": OP4,
        "op5_decontamination": OP5, "op6_preferences": OP6, "op7_mixing": op7(), "op8_lm_scoring": OP8, "op9_jaccard_join": OP9, "op13_importance_resampling": OP13,
    }
