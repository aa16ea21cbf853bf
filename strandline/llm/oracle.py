"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

from . import simhash
from .chat import CONTROL_SQL
from .url_rules import CONFIDENCE, RULES, SUPPORT

CHAT = f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized as (
  select *, length(text) + len(regexp_extract_all(text, '{CONTROL_SQL}'))
         + case role when 'user' then 18 when 'assistant' then 20 else 19 + length(role) end as chars
  from turns)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(chars) as bigint) as formatted_chars
from sized group by conv_id"""

REPEATS = """
with d as (select row_number() over () as r, doc_id, encode(coalesce(text, '')) as h from documents),
p as (select r, unnest(generate_series(0, octet_length(h) - 200)) as pos, h from d where octet_length(h) >= 200),
w as (select r, pos, sha256(array_slice(h, pos + 1, pos + 200)) as m from p),
again as (select r, pos from w join (select m from w group by m having count(*) > 1) using (m)),
marked as (select r, pos, case when pos <= lag(pos) over (partition by r order by pos) + 200 then 0 else 1 end as new from again),
runs as (select r, min(pos) as first, max(pos) + 200 as last
         from (select *, sum(new) over (partition by r order by pos) as run from marked) group by r, run),
gaps as (
  select r, coalesce(lag(last) over (partition by r order by first), 0) as a, first as b from runs
  union all select r, max(last), 1000000000 from runs group by r),
kept as (select r, string_agg(hex(array_slice(h, a + 1, b)), '' order by a) as k from gaps join d using (r) group by r),
sums as (select r, sum(last - first) as removed, count(*) as spans from runs group by r)
select doc_id, octet_length(h) as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed, coalesce(spans, 0) as n_spans,
       sha256(case when k is null then h else unhex(k) end) as kept_sha256
from d left join sums using (r) left join kept using (r)"""

TOP_K = """
with e as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as v from embeddings
  where vec_id is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select q.r as qr, q.vec_id as query_id, c.vec_id, c.r, cast(list_inner_product(q.v, c.v) as bigint) as score
      from e q join e c on q.r <> c.r and len(q.v) = len(c.v) where q.vec_id % 20 = 0)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by qr order by score desc, vec_id, r) as rank from s) where rank <= 20"""

WORDS = "string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{}')"

JACCARD = f"""
with recursive d as (
  select row_number() over () as r, doc_id, list_filter({WORDS.format('[ ' + chr(92) + 't-' + chr(92) + 'r]+')}, lambda x: x <> '') as w from documents),
g as (select distinct r, unnest(case when len(w) >= 4 then list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i:i + 3], ' '))
                                     when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from d),
n as (select r, count(*) as size from g group by r),
pairs as (select a.r as a, b.r as b, count(*) as k from g a join g b on a.s = b.s and a.r <> b.r group by 1, 2),
links as (select a, b from pairs join n x on x.r = a join n y on y.r = b where 100 * k >= 85 * (x.size + y.size - k)),
reach as (select r as a, r as b from d union select reach.a, links.b from reach join links on reach.b = links.a)
select d.doc_id, coalesce(n.size, 0) as n_shingles, c.component_id
from d left join n using (r)
join (select reach.a as r, min(t.doc_id) as component_id from reach join d t on t.r = reach.b group by 1) c using (r)"""

CONTAMINATION = f"""
with d as (select row_number() over () as r, doc_id, list_filter({WORDS.format('[' + chr(92) + 'x00-' + chr(92) + 'x2F' + chr(92) + 'x3A-' + chr(92) + 'x60' + chr(92) + 'x7B-' + chr(92) + 'x7F]+')}, lambda x: x <> '') as w from documents),
b as (select item_id, list_filter({WORDS.format('[' + chr(92) + 'x00-' + chr(92) + 'x2F' + chr(92) + 'x3A-' + chr(92) + 'x60' + chr(92) + 'x7B-' + chr(92) + 'x7F]+')}, lambda x: x <> '') as w from benchmark),
sizes as (select *, least(13, len(w)) as n from b where len(w) > 0),
items as (select item_id, n, unnest(list_transform(generate_series(1, len(w) - n + 1), lambda i: array_to_string(w[i:i + n - 1], ' '))) as s from sizes),
places as (select r, w, n, unnest(generate_series(1, len(w) - n + 1)) as pos from d join (select distinct n from sizes) on len(w) >= n),
windows as (select r, n, pos, array_to_string(w[pos:pos + n - 1], ' ') as s from places),
found as (select r, pos, windows.n as n, item_id from windows join items on windows.s = items.s and windows.n = items.n),
hits as (select r, count(distinct k) as n_hit from (select r, unnest(generate_series(pos, pos + n - 1)) as k from found) group by r),
names as (select r, count(*) as n_items, string_agg(i, ',' order by i) as l from (select distinct r, cast(item_id as varchar) as i from found) group by r)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(l, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hits using (r) left join names using (r)"""


def base32(hexadecimal: str) -> str:
    """SQL for the base32 form of 40 hexadecimal digits."""
    digit = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((n >> (15 - 5 * j)) & 31 as bigint) + 1, 1)"
    number = f"cast('0x' || substr({hexadecimal}, 1 + 5 * g, 5) as bigint)"
    return f"array_to_string(list_transform(generate_series(0, 7), lambda g: array_to_string(list_transform(generate_series(0, 3), lambda j: {digit.replace('n >>', number + ' >>')}), '')), '')"


WARC = f"""
with p as (select page_id, coalesce(html, '') as h, max(page_id) over (partition by coalesce(html, '')) as top from pages)
select page_id, cast(octet_length(encode(h)) as bigint) as payload_bytes, {base32('sha1(h)')} as payload_digest,
       case when top is null or page_id = top then 'response' else 'revisit' end as record_type,
       case when top is null or page_id = top then null else top end as refers_to
from p"""

_CASES = sorted(RULES, key=lambda r: (-len(r), r))


def _fit(rule: str) -> str:
    name, _, rest = rule.partition("/")
    return f"(host = '{name}' or ends_with(host, '.{name}')) and starts_with(path, '/{rest}')"


URLS = f"""
with cut as (
  select row_number() over () as r, page_id, url,
         case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
u as (
  select r, page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut),
t as (
  select r, page_id, coalesce(host, '') as host, coalesce(path, '') as path,
         case {' '.join(f"when {_fit(x)} then '{x}'" for x in _CASES)} end as rule,
         case when coalesce(host, '') = '' then [] else list_distinct(list_concat(
           list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x),
           list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: 'p:' || regexp_replace(x, '[0-9]+', '#', 'g')),
           list_transform(list_filter(list_transform(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: string_split(x, '=')[1]), lambda x: x <> ''), lambda x: 'q:' || x))) end as tokens
  from u),
marked as (
  select t.tokens, toxic = 1 as block from t join labels on doc_id = try_cast(regexp_extract(path, '/([0-9]+)', 1) as bigint)
  where len(tokens) > 0 and toxic is not null),
total as (select count(*) as n from marked),
subsets as (
  select block, list_sort(list_filter(list_transform(generate_series(1, len(tokens)), lambda i: case when (m >> (i - 1)) & 1 = 1 then tokens[i] end), lambda x: x is not null)) as a
  from (select block, tokens, unnest(generate_series(1, (1 << len(tokens)) - 1)) as m from marked)),
rules as (
  select a from subsets cross join total group by a, n
  having count(*) filter (block) >= ceil({SUPPORT} * n) and count(*) filter (block) >= {CONFIDENCE} * count(*)),
bad as (select distinct r from t join rules on list_has_all(tokens, a))
select page_id, host, path, rule,
       case {' '.join(f"when rule = '{x}' then '{RULES[x]}'" for x in _CASES)} when r in (select r from bad) then 'block' else 'allow' end as verdict
from t"""


# Checksums of texts: the table of the reflected polynomial 0xEDB88320, and a step for each byte.
CRC_TABLE = """select list(v order by i) as crc from (
  select i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v
  from range(256) r(i))"""


def crc32(text: str) -> str:
    """SQL for the checksum of a text's UTF-8 bytes; ``crc`` is the list of ``CRC_TABLE``."""
    codes = f"list_transform(generate_series(1, octet_length(encode({text}))), lambda k: cast('0x' || substr(hex(encode({text})), 2 * k - 1, 2) as bigint))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::bigint, {codes}), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])))"


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode(cast({value} as varchar))) || ':' || cast({value} as varchar), '-')"


def _tree(prefix: str, start: str, levels: int) -> str:
    """Levels of ternary trees: ``g, i, c, h`` (group, index, nodes of the group, digest), with ``l`` and ``r`` beside each node."""
    out = []
    for k in range(levels + 1):
        below = f"{prefix}{k - 1}"
        rows = start if k == 0 else (
            f"select g, i // 3 as i, (any_value(c) + 2) // 3 as c, case when any_value(c) > 1 then sha256(string_agg(h, '' order by i)) else any_value(h) end as h from {below} group by g, i // 3"
        )
        run = "partition by g, i // 3 order by i rows between unbounded preceding and 1 preceding", "partition by g, i // 3 order by i rows between 1 following and unbounded following"
        out.append(
            f"{prefix}{k} as materialized (select *, case when c > 1 then coalesce(string_agg(h, '') over ({run[0]}), '') else '' end as l, "
            f"case when c > 1 then coalesce(string_agg(h, '') over ({run[1]}), '') else '' end as r from ({rows}))"
        )
    return ",\n".join(out)


_HIGH, _WIDE = 13, 7

MERKLE = f"""
with t as ({CRC_TABLE}),
d as (
  select row_number() over () as row, doc_id, source, coalesce('=' || source, '') as g,
         sha256({' || '.join(_field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', 'text'))}) as leaf,
         case when {crc32('cast(doc_id as varchar)')} % 2 = 0
              then sha256({' || '.join(_field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', "replace(text, chr(10), '')"))}) end as other
  from documents, t),
p as (select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by g) as c from d),
{_tree('a', 'select g, i, c, leaf as h from p', _HIGH)},
subs as (select '' as g, row_number() over (order by g) - 1 as i, count(*) over () as c, h, g as name from a{_HIGH}),
{_tree('b', 'select g, i, c, h from subs', _WIDE)},
full_paths as (
  select p.row, p.doc_id, p.source, p.leaf, coalesce(p.other, p.leaf) as start, subs.h as subroot, b{_WIDE}.h as root,
         [{', '.join([f"{{'m': a{k}.c > 1, 'l': a{k}.l, 'r': a{k}.r}}" for k in range(_HIGH)] + [f"{{'m': b{k}.c > 1, 'l': b{k}.l, 'r': b{k}.r}}" for k in range(_WIDE)])}] as steps
  from p {' '.join(f'join a{k} on a{k}.g = p.g and a{k}.i = p.i // {3 ** k}' for k in range(_HIGH))}
  join subs on subs.name = p.g {' '.join(f'join b{k} on b{k}.i = subs.i // {3 ** k}' for k in range(_WIDE + 1))}),
folded as (
  select *, list_reduce(list_prepend({{'m': true, 'l': start, 'r': ''}}, steps),
                        lambda x, s: case when s.m then {{'m': true, 'l': sha256(s.l || x.l || s.r), 'r': ''}} else x end).l as folded_root
  from full_paths)
select doc_id, source, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda s: s.l || s.r), '')) as proof_sha256,
       folded_root, folded_root = root as verified
from folded"""


def _half(k: int) -> str:
    """SQL for a half of a fingerprint from the votes of its two parts."""
    bits = [f"case when 2 * v{2 * k + j}_{i} > n then {1 << (i + j * simhash.PART_BITS)} else 0 end" for j in range(2) for i in range(simhash.PART_BITS)]
    return " + ".join(bits)


_LINEAR = [" + ".join(f"coalesce(c[i + {j}], 0) * {simhash.factor(p, j)}" for j in range(simhash.WORDS)) for p in range(simhash.PARTS)]

FINGERPRINTS = f"""
with recursive t as ({CRC_TABLE}),
ids as (select distinct doc_id, coalesce(text, '') as text, md5(coalesce(text, '')) as m from documents),
d as (select *, row_number() over (order by doc_id nulls first, m) - 1 as pos, count(*) over () as total, length(text) as n_chars from ids),
e as (
  select d.pos, d.text, left(d.text, d.n_chars - d.n_chars // 4) || left(x.text, d.n_chars // 4) as edited
  from d join d x on x.pos = (d.pos + 1) % d.total),
bodies as (select pos, 0 as kind, text as body from e union all select pos, 1, edited from e),
lists as (select pos, kind, list_filter(string_split_regex(body, '[ ' || chr(92) || 't-' || chr(92) || 'r]+'), lambda x: x <> '') as w from bodies),
words as (select pos, kind, generate_subscripts(w, 1) as place, unnest(w) as word from lists),
sums as (select word, {crc32('word')} as c from (select distinct word from words), t),
coded as (select pos, kind, list(sums.c order by place) as c from words join sums using (word) group by pos, kind),
terms as (select pos, kind, c, unnest(generate_series(1, greatest(len(c) - {simhash.WORDS - 1}, 1))) as i from coded),
linear as (select pos, kind, {', '.join(f'({x}) % {simhash.PRIME} as h{p}' for p, x in enumerate(_LINEAR))} from terms),
parts as (select pos, kind, {', '.join(f'(((h{p} + {simhash.factor(p, -1)}) * h{p}) % {simhash.PRIME}) & {simhash.PART} as p{p}' for p in range(simhash.PARTS))} from linear),
votes as (
  select pos, kind, count(*) as n, {', '.join(f'sum((p{p} >> {i}) & 1) as v{p}_{i}' for p in range(simhash.PARTS) for i in range(simhash.PART_BITS))}
  from parts group by pos, kind),
halves as (select pos, kind, cast({_half(0)} as bigint) as f0, cast({_half(1)} as bigint) as f1 from votes),
marks as (select lists.pos, lists.kind, coalesce(f0, 0) as f0, coalesce(f1, 0) as f1 from lists left join halves using (pos, kind)),
own as (select f0, f1, min(pos) as id from marks where kind = 0 group by f0, f1),
links as (select a.id as a, b.id as b from own a join own b on bit_count(xor(a.f0, b.f0)) + bit_count(xor(a.f1, b.f1)) <= {simhash.RADIUS} and a.id <> b.id),
reach as (select id as a, id as b from own union select reach.a, links.b from reach join links on reach.b = links.a),
members as (select own.id, d.doc_id from own join marks o on o.kind = 0 and o.f0 = own.f0 and o.f1 = own.f1 join d on d.pos = o.pos),
named as (select reach.a as id, min(members.doc_id) as class_id from reach join members on members.id = reach.b group by reach.a)
select d.doc_id, d.n_chars, sha256(e.edited) as edited_sha256,
       printf('%015x', o.f0) || printf('%015x', o.f1) as fingerprint, printf('%015x', k.f0) || printf('%015x', k.f1) as edited_fingerprint,
       1.0::double - (bit_count(xor(o.f0, k.f0)) + bit_count(xor(o.f1, k.f1))) / {float(simhash.BITS)}::double as near_edited,
       1.0::double - (bit_count(xor(o.f0, x.f0)) + bit_count(xor(o.f1, x.f1))) / {float(simhash.BITS)}::double as near_next,
       named.class_id
from documents q join d on q.doc_id is not distinct from d.doc_id and md5(coalesce(q.text, '')) = d.m
join e on e.pos = d.pos
join marks o on o.pos = d.pos and o.kind = 0 join marks k on k.pos = d.pos and k.kind = 1
join marks x on x.pos = (d.pos + 1) % d.total and x.kind = 0
join own on own.f0 = o.f0 and own.f1 = o.f1 join named on named.id = own.id"""
