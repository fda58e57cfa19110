"""SQL for the queries that SQL can express."""

from __future__ import annotations

from patchlake.llm import collocations as c
from patchlake.llm import decontaminate as d
from patchlake.llm import mixing as m
from patchlake.llm import quality_rules as q
from patchlake.llm import url_filters as u
from patchlake.llm import vector_codes as v

WORD = "[^\\x20\\x09-\\x0D]+"


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def op1_sql() -> str:
    phrases = "|".join(x.replace(".", "\\.") for x in q.BOILERPLATE)
    lower = f"translate(line, '{u.LOWER[0]}', '{u.LOWER[1]}')"
    return f"""
with docs as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{WORD}') as words from documents),
base as (
  select doc_id, len(words) as n_words, list_sum(list_transform(words, lambda w: length(w))) as word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols from docs),
lines as (
  select doc_id, line, len(regexp_extract_all(line, '{WORD}')) as n, list_sum(list_transform(regexp_extract_all(line, '{WORD}'), lambda w: length(w))) as chars
  from (select doc_id, unnest(string_split(text, chr(10))) as line from docs)),
judged as (
  select *, list_filter(regexp_extract_all(line, '{WORD}'), lambda w: regexp_matches(w, '[!?#*$%&][!?#*$%&]$')) as marked,
    list_filter(regexp_extract_all(line, '{WORD}'), lambda w: w in ('|', '>', '»', '›', '•', '·')) as seps
  from lines where n > 0),
cleaned as (
  select doc_id, count(*) - count(distinct line) as n_dup_lines,
    sum(case when 3 * len(marked) >= n or (len(seps) >= 2 and 4 * len(seps) >= n) or (n <= {q.PHRASE_LINE} and regexp_matches({lower}, {quoted(phrases)})) then 0 else chars end) as kept_chars
  from judged group by doc_id),
wins as (select doc_id, i, list_slice(words, i, i + 7) as w from (select doc_id, words, unnest(range(1, len(words) - 6)) as i from docs)),
dup as (select doc_id, w from wins group by doc_id, w having count(*) > 1),
rep as (
  select doc_id, count(distinct p) as n_repeat_words
  from (select doc_id, unnest(range(i, i + 8)) as p from wins join dup using (doc_id, w)) group by doc_id),
together as (
  select b.doc_id, n_words, coalesce(word_chars, 0) as word_chars, n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines,
    coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(kept_chars, 0) as kept_chars
  from base b left join cleaned using (doc_id) left join rep using (doc_id)),
failed as (select *, n_words < {q.MIN_WORDS} or 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words as base_failed from together)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
  n_repeat_words::bigint as n_repeat_words, base_failed,
  not base_failed and not 100 * (word_chars - kept_chars) > {q.MAX_LOST_PERCENT} * word_chars as kept, kept_chars::bigint as kept_chars
from failed"""


def op2_sql() -> str:
    """All pairs that share a shingle, then the smallest id reachable by recursion."""
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{u.LOWER[0]}', '{u.LOWER[1]}'), '{WORD}')"
    return f"""
with recursive docs as (select doc_id, {words} as words from documents),
sets as (select distinct doc_id, list_slice(words, i, i + 3) as s from (select doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) as i from docs where len(words) > 0)),
sizes as (select doc_id, count(*) as n from sets group by 1),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as both_have from sets a join sets b on a.s = b.s and a.doc_id <> b.doc_id group by all),
links as (select a, b from shared join sizes x on a = x.doc_id join sizes y on b = y.doc_id where 100 * both_have >= 80 * (x.n + y.n - both_have)),
reach as (select doc_id as a, doc_id as b from docs union select r.a, l.b from reach r join links l on r.b = l.a)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, c as component_id, d.doc_id = c as kept
from docs d left join sizes using (doc_id) join (select a, min(b) as c from reach group by 1) on a = d.doc_id"""


def op3_sql() -> str:
    return """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as digest from pages),
f as (select *, min(page_id) over (partition by digest) as first from p)
select page_id, n::bigint as payload_bytes, digest as payload_digest, case when n >= 100 and page_id > first then 'revisit' else 'response' end as record_type,
  case when n >= 100 and page_id > first then first end as refers_to from f"""


def op5_sql() -> str:
    words = lambda x: f"regexp_extract_all(translate(coalesce({x}, ''), '{u.LOWER[0]}', '{u.LOWER[1]}'), '{d.WORD}')"
    return f"""
with docs as (select doc_id, {words('text')} as words from documents),
items as (select item_id, {words('text')} as words from benchmark),
wins as (
  select distinct item_id, list_slice(words, i, i + {d.WINDOW - 1}) as w
  from (select item_id, words, unnest(range(1, greatest(len(words) - {d.WINDOW - 1}, 1) + 1)) as i from items where len(words) > 0)),
sizes as (select distinct len(w) as n from wins),
places as (select doc_id, i, n, list_slice(words, i, i + n - 1) as w from (select doc_id, words, n, unnest(range(1, len(words) - n + 2)) as i from docs, sizes)),
found as (select doc_id, i, n, item_id from places join wins using (w)),
hits as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from found) group by 1),
named as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item_id::varchar as item from found) group by 1)
select doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(words) as contaminated
from docs left join hits using (doc_id) left join named using (doc_id)"""


def op9_sql() -> str:
    host = lambda x: f"translate(regexp_extract(coalesce({x}, ''), '(?s)^.*?://([^/?#]*)', 1), '{u.LOWER[0]}', '{u.LOWER[1]}')"
    cases = lambda what: "case " + " ".join(f"when (host = '{h}' or host like '%.{h}') and starts_with(path, '{p}') then '{what(v, h, p)}'" for v, h, p in sorted(u.RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))) + " end"
    damp = u.DAMPING

    def series(name: str, seeds: str, edges: str) -> str:
        steps = [f"{name}0 as (select host, mass * {1 - damp} as mass from {seeds})"]
        steps += [f"{name}{k + 1} as (select e.dst as host, sum(p.mass * e.weight) * {damp} as mass from {name}{k} p join {edges} e on p.host = e.src group by 1)" for k in range(u.ROUNDS)]
        union = " union all ".join(f"select * from {name}{k}" for k in range(u.ROUNDS + 1))
        return ",\n".join([*steps, f"{name} as (select host, sum(mass) as score from ({union}) group by 1)"])

    return f"""
with named as (select page_id, html, {host('url')} as host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages),
ruled as (select *, {cases(lambda v, h, p: h + p)} as rule, {cases(lambda v, h, p: v)} as by_rule from named),
links as (
  select * from (select host as src, translate(unnest(regexp_extract_all(coalesce(html, ''), {quoted(u.LINK)}, 1)), '{u.LOWER[0]}', '{u.LOWER[1]}') as dst from named)
  where src <> '' and src <> dst),
counted as (select src, dst, count(*) as n from links group by all),
edges as (select src, dst, n / sum(n) over (partition by src) as weight from counted),
back as (select dst as src, src as dst, weight / sum(weight) over (partition by dst) as weight from edges),
known as (select host, count(*) filter (by_rule = 'allow') as allowed, count(*) filter (by_rule = 'block') as barred from ruled where host <> '' group by 1),
good as (select host, allowed / sum(allowed) over () as mass from known where allowed > 0),
bad as (select host, barred / sum(barred) over () as mass from known where barred > 0),
{series('t', 'good', 'edges')},
{series('s', 'bad', 'back')},
blocked as (
  select k.host from known k left join t on k.host = t.host left join s on k.host = s.host
  where round(coalesce(s.score, 0), 12) > round(coalesce(t.score, 0), 12) and round(coalesce(s.score, 0) * (select count(*) from known), 9) > {u.FLOOR})
select page_id, host, path, rule, coalesce(by_rule, case when host in (select host from blocked) then 'block' end, 'allow') as verdict from ruled"""


def op11_sql() -> str:
    """All phrases of all pieces, counted."""
    low = f"translate(coalesce(text, ''), '{u.LOWER[0]}', '{u.LOWER[1]}')"
    grams = " union all ".join(f"select lang, {k} as k, list_slice(w, i, i + {k - 1}) as g from (select lang, w, unnest(range(1, len(w) - {k - 2})) as i from pieces)" for k in range(1, c.LONGEST + 1))
    return f"""
with pieces as (
  select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w
  from (select coalesce(lang, '{c.UND}') as lang, unnest(regexp_split_to_array({low}, '[.,;:!?\\x0A-\\x0D]')) as piece from documents)),
f as materialized (select lang, k, g, count(*) as n from ({grams}) group by all),
totals as (select lang, sum(n)::bigint as total from f where k = 1 group by lang),
candidates as (select * from f where k >= 2 and n >= {c.LEAST}),
parts as (
  select lang, k, n, list_slice(g, i, j) as g2
  from (select lang, k, n, g, i, unnest(range(i + 1, k + 1)) as j from (select lang, k, n, g, unnest(range(1, k)) as i from candidates)) where j - i + 1 < k),
absorbed as (select distinct x.lang, x.g from candidates x join parts y on x.lang = y.lang and x.g = y.g2 and 100 * y.n >= 100 * x.n),
left_over as (select * from candidates anti join absorbed using (lang, g)),
cuts as (
  select p.lang, p.g, p.n as a, x.n as l, y.n as r, cut, total, 1000::hugeint * p.n * total // (x.n::hugeint * y.n) as score
  from (select *, unnest(range(1, k)) as cut from left_over) p
  join f x on x.lang = p.lang and x.g = list_slice(p.g, 1, cut) join f y on y.lang = p.lang and y.g = list_slice(p.g, cut + 1, p.k) join totals t on t.lang = p.lang),
least as (select * from cuts qualify row_number() over (partition by lang, g order by score, cut) = 1),
named as (select lang, array_to_string(g, ' ') as phrase, a, l, r, total, score::bigint as score from least)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, total as n, score
from named qualify rank <= {c.TOP}"""


def op12_sql() -> str:
    """Every part against every entry, round by round."""
    near = lambda book: f"""(
  select vec_id, p, x, arg_min(entry, d * {v.ENTRIES} + entry) as entry, min(d) as d
  from (select vec_id, q.p, q.x, entry, (list_inner_product(q.x, q.x) - 2 * list_inner_product(q.x, e.x) + list_inner_product(e.x, e.x))::bigint as d from parts q join {book} e on q.p = e.p)
  group by vec_id, p, x)"""  # noqa: E731
    steps = []
    for k in range(v.ROUNDS):
        steps.append(f"near{k} as materialized {near(f'book{k}')}")
        steps.append(f"""means{k} as (
  select p, entry, list(m order by i) as x from (
    select p, entry, i, floor(sum(x[i])::bigint / count(*))::double as m from (select p, entry, x, unnest(range(1, len(x) + 1)) as i from near{k}) group by all)
  group by p, entry)""")
        steps.append(f"book{k + 1} as materialized (select b.p, b.entry, coalesce(m.x, b.x) as x from book{k} b left join means{k} m on b.p = m.p and b.entry = m.entry)")
    n = v.ROUNDS
    return f"""
with kept as (
  select vec_id, label, list_transform(embedding, lambda x: floor({v.SCALE} * x::double)) as vec from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as materialized (select vec_id, p, list_slice(vec, p * (len(vec) // {v.PARTS}) + 1, (p + 1) * (len(vec) // {v.PARTS})) as x from (select *, unnest(range({v.PARTS})) as p from kept)),
book0 as materialized (select p, row_number() over (partition by p order by vec_id) - 1 as entry, x from parts qualify entry < {v.ENTRIES}),
{", ".join(steps)},
last as materialized {near(f"book{n}")},
coded as (select vec_id, string_agg(lower(printf('%02x', entry)), '' order by p) as code, sum(d)::bigint as error from last group by vec_id),
digest as (select sha256(string_agg(array_to_string(list_transform(x, lambda y: y::bigint), ','), ',' order by p, entry)) as codebooks_sha256 from book{n})
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from coded join kept using (vec_id), digest"""


def op13_sql() -> str:
    shares = "case (row_number() over (order by source nulls last) - 1) % {} {} end".format(len(m.SHARES), " ".join(f"when {i} then {s}" for i, s in enumerate(m.SHARES)))
    return f"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::bigint as size, ('0x' || md5(concat_ws('|', '{m.SEED}', coalesce(doc_id::varchar, ''), coalesce(md5(text), '')))[1:13])::bigint as h from documents),
w as (select doc_id, max(quality) as quality from labels group by 1),
docs as (select d.*, (h + 0.5::double) / {1 << 52}::double as u, case quality when 1 then 2.0 when 0 then 0.5 else 1.0 end::double as weight from d left join w using (doc_id)),
s as (select source, sum(size)::bigint as source_size from docs group by 1),
shared as (select *, {shares} as share from s),
levels as (
  select *, ({m.MOST} * source_size) / share as level, coalesce(sum(source_size) over before, 0) as sizes_before, coalesce(sum(share) over before, 0) as shares_before, sum(source_size) over () as sizes, sum(share) over () as all_shares
  from shared window before as (order by {m.MOST} * source_size / share, source nulls last rows between unbounded preceding and 1 preceding)),
reached as (select (sizes - {m.MOST} * sizes_before)::double / (all_shares - shares_before)::double as even from levels where even <= level order by level, even limit 1),
aims as (select source, source_size, least(even * share, ({m.MOST} * source_size)::double) as target from levels, reached),
rests as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as epochs, round(target - epochs * source_size)::bigint as rest from aims),
drawn as (
  select doc_id, size, a.source_size, target, epochs, rest, coalesce(sum(size) over (partition by d.source order by -ln(u) / weight, doc_id, size, u rows between unbounded preceding and 1 preceding), 0) as before
  from docs d join rests a on d.source is not distinct from a.source)
select doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::bigint as taken from drawn"""


ORACLES = {"op1_quality_rules": op1_sql(), "op2_near_dedup": op2_sql(), "op3_warc": op3_sql(), "op5_decontaminate": op5_sql(), "op9_url_filters": op9_sql(), "op11_collocations": op11_sql(), "op12_vector_codes": op12_sql(), "op13_mixing": op13_sql()}
