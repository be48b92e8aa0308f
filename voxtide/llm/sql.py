"""The queries that SQL can express, for DuckDB on the same tables."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = f"""
with d as (select row_number() over () r, doc_id, {WORDS} ws from documents),
w as (select r, i, array_to_string(list_slice(ws, i, i + 34), ' ') k from (select r, ws, unnest(range(1, len(ws) - 33)) i from d)),
rep as (select k from w group by k having count(*) > 1),
gone as (select distinct r, unnest(range(i, i + 35)) i from w semi join rep using (k)),
kept as (select r, string_agg(word, ' ' order by i) t from (select r, unnest(ws) word, unnest(range(1, len(ws) + 1)) i from d) anti join gone using (r, i) group by r),
n as (select r, count(*) n from gone group by r)
select doc_id, cast(len(ws) as bigint) n_words, cast(coalesce(n, 0) as bigint) n_removed, sha256(coalesce(t, '')) kept_sha256
from d left join kept using (r) left join n using (r)
"""

OP3 = """
with d as (select row_number() over () r, doc_id, hex(encode(coalesce(text, ''))) h from documents),
w as (select r, doc_id, i, substr(h, 2 * i + 1, 100) k from (select r, doc_id, h, unnest(range(0, len(h) // 2 - 49)) i from d)),
least as (select k, min(doc_id) m from w where doc_id is not null group by k having count(*) > 1),
hit as (select r, i from w join least using (k) where m < coalesce(doc_id, 9223372036854775807)),
runs as (select r, i, sum(case when p is null or i - p > 50 then 1 else 0 end) over (partition by r order by i) g
  from (select r, i, lag(i) over (partition by r order by i) p from hit)),
span as (select r, g, min(i) a, max(i) + 50 b from runs group by r, g),
part as (select r, g, a, b, coalesce(lag(b) over (partition by r order by g), 0) z from span),
cut as (select r, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' order by g) || substr(any_value(h), 2 * max(b) + 1) t, sum(b - a) n, count(*) s
  from part join d using (r) group by r)
select doc_id, cast(len(h) // 2 as bigint) n_bytes, cast(coalesce(n, 0) as bigint) n_removed, cast(coalesce(s, 0) as bigint) n_spans, sha256(unhex(coalesce(t, h))) kept_sha256
from d left join cut using (r)
"""

OP7 = r"""
with d as (select row_number() over () r, doc_id, string_split(coalesce(text, ''), chr(10)) ls from documents),
lines as (select r, doc_id, unnest(ls) line, unnest(range(0, len(ls))) i from d),
named as (select *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') ws from lines),
counted as (select *, array_to_string(ws, ' ') w, len(ws) c, row_number() over (partition by r order by i) j from named where len(ws) > 0),
w as (select r, doc_id, j, 1 m, w k from counted where c >= 50
  union all select a.r, a.doc_id, a.j, 2, a.w || chr(10) || b.w from counted a join counted b on a.r = b.r and b.j = a.j + 1 where a.c + b.c >= 50
  union all select a.r, a.doc_id, a.j, 3, a.w || chr(10) || b.w || chr(10) || c.w from counted a join counted b on a.r = b.r and b.j = a.j + 1 join counted c on a.r = c.r and c.j = a.j + 2),
later as (select r, j, m from (select r, j, m, row_number() over (partition by m, k order by doc_id, r, j) n from w) where n > 1),
gone as (select distinct c.r, c.i from later l join counted c on c.r = l.r and c.j between l.j and l.j + l.m - 1),
kept as (select r, string_agg(line, chr(10) order by i) t from lines anti join gone using (r, i) group by r),
n as (select r, count(*) n from gone group by r), m as (select r, count(*) m from counted group by r)
select doc_id, cast(coalesce(m, 0) as bigint) n_lines, cast(coalesce(n, 0) as bigint) n_removed, sha256(coalesce(t, '')) kept_sha256
from d left join kept using (r) left join n using (r) left join m using (r)
"""

# CRC-32 of short ASCII strings: the table of the reflected polynomial, then byte by byte
CRC = """
crc_table as (select list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)),
  lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) tab),
crcs as (select doc_id, xor(list_reduce(list_concat([4294967295], list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ascii(x) as bigint))),
  lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) h from (select distinct doc_id from documents where doc_id is not null), crc_table)
"""

OP12 = f"""
with {CRC},
split as materialized (select row_number() over () r, d.doc_id, h, {WORDS} ws from documents d left join crcs using (doc_id)),
place as (select *, case when h % 10 = 0 and len(ws) > 0 then (h // 10) % len(ws) end a from split),
sized as (select *, 1 + (len(ws) - a) // (3 + (h // 10) % 8) p from place),
d as (select r, doc_id, case when a is null then ws else list_concat(ws[1:a], list_transform(range(len(ws) - a), lambda i: ws[a + i % p + 1])) end ws from sized),
w as (select r, unnest(ws) w, unnest(range(len(ws))) i, len(ws) n from d),
five as (select r, i, n, w || ' ' || lead(w, 1) over o || ' ' || lead(w, 2) over o || ' ' || lead(w, 3) over o || ' ' || lead(w, 4) over o k from w window o as (partition by r order by i)),
often as (select r, k from five where k is not null group by r, k having count(*) > 1),
near as (select r, k, i, n from five join often using (r, k)),
same as (select a.r, a.i, b.i - a.i q from near a join near b on a.r = b.r and a.k = b.k and a.i < b.i and 4 * (b.i - a.i) <= a.n),
isle as (select r, q, i, i - row_number() over (partition by r, q order by i) g from same),
stretch as (select r, q, min(i) s, max(i) - min(i) + 5 + q n from isle group by r, q, g),
runs as (select r, s, n, min(q) q from stretch where n >= 4 * q and n >= 6 group by r, s, n),
best as (select r, s, n, q, row_number() over (partition by r order by n / q desc, s, q) o from runs),
told as (select r, count(*) c, string_agg(s || ',' || n || ',' || q || chr(10), '' order by s, q) t from runs group by r),
gone as (select distinct r, unnest(range(s + q, s + n)) i from runs),
kept as (select r, string_agg(w, ' ' order by i) t from w anti join gone using (r, i) group by r)
select doc_id, coalesce(c, 0) n_runs, s as "start", n as "length", q as period, 1000 * n // q exponent_milli,
  sha256(coalesce(told.t, '')) runs_sha256, sha256(coalesce(kept.t, '')) collapsed_sha256
from d left join told using (r) left join kept using (r) left join (from best where o = 1) using (r)
"""

FIELD = "case when {0} is null then '-' else strlen(cast({0} as varchar)) || ':' || {0} end"
LEAF = "sha256(" + " || ".join(FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || " + FIELD + ")"

OP13 = f"""
with recursive {CRC},
rows as (select row_number() over () r, doc_id, '.' || source g, {LEAF.format("text")} leaf,
  case when h % 2 = 0 then {LEAF.format("replace(text, chr(10), '')")} else {LEAF.format("text")} end other from documents left join crcs using (doc_id)),
leaves as materialized (select *, coalesce(g, '') gk, row_number() over (partition by g order by doc_id nulls first, leaf, r) - 1 i, count(*) over (partition by g) n from rows),
tree(gk, level, i, digest, n) as (
  select gk, 0, i, leaf, n from leaves
  union all
  select gk, level + 1, i // 3, sha256(string_agg(digest, '' order by i)), (n + 2) // 3 from tree where n > 1 group by gk, level, i // 3, n),
subs as (select gk, digest subroot, row_number() over (order by gk) - 1 i, count(*) over () n from tree where n = 1),
crown(level, i, digest, n) as (
  select 0, i, subroot, n from subs
  union all
  select level + 1, i // 3, sha256(string_agg(digest, '' order by i)), (n + 2) // 3 from crown where n > 1 group by level, i // 3, n),
high as (select gk, max(level) top from tree group by gk),
steps as (
  select l.r, t.level, t.i, t.digest, t.i < l.i // cast(power(3, t.level) as bigint) is_left
  from leaves l join tree t on t.gk = l.gk and t.n > 1 and t.i // 3 = l.i // cast(power(3, t.level + 1) as bigint) and t.i <> l.i // cast(power(3, t.level) as bigint)
  union all
  select l.r, top + c.level, c.i, c.digest, c.i < s.i // cast(power(3, c.level) as bigint)
  from leaves l join high using (gk) join subs s using (gk) join crown c on c.n > 1 and c.i // 3 = s.i // cast(power(3, c.level + 1) as bigint) and c.i <> s.i // cast(power(3, c.level) as bigint)),
sides as (select r, level, coalesce(string_agg(digest, '' order by i) filter (is_left), '') lhs, coalesce(string_agg(digest, '' order by i) filter (not is_left), '') rhs from steps group by r, level),
proofs as (select r, string_agg(lhs || rhs, '' order by level) proof from sides group by r),
depths as (select r, top + (select max(level) from crown) depth from leaves join high using (gk)),
fold(r, level, h) as (
  select r, 0, other from leaves
  union all
  select f.r, f.level + 1, sha256(coalesce(lhs, '') || h || coalesce(rhs, '')) from fold f join depths d on d.r = f.r and f.level < depth left join sides s on s.r = f.r and s.level = f.level),
folds as (select r, arg_max(h, level) folded from fold group by r)
select doc_id, leaf, subroot, (select digest from crown where n = 1) root, sha256(coalesce(proof, '')) proof_sha256, folded folded_root, folded = (select digest from crown where n = 1) verified
from leaves join subs using (gk) left join proofs using (r) join folds using (r)
"""
