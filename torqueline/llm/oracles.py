"""SQL of the queries on suffixes, conversations and periodic runs."""

_CRC_TABLE = """
with recursive z(n, k, c) as (
  select n, 0, n from range(256) as r(n)
  union all select n, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from z where k < 8),
tab as (select list(c order by n) as l from z where k = 8),
"""


def _crc(text: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({text}, ''), lambda y: ascii(y)::bigint)), lambda c, b: xor(c >> 8, l[(xor(c, b) & 255) + 1])), 4294967295)"


SUFFIX_DEDUP = """
with t as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
w as (select doc_id, i, md5(substring(x, 2 * i + 1, 200)) as g from (select doc_id, x, unnest(range(0, length(x) // 2 - 99)) as i from t where length(x) >= 200)),
o as (select *, row_number() over (partition by g order by doc_id, i) as k from w),
a as (select doc_id, i, coalesce(i - lag(i) over (partition by doc_id order by i) > 100, true) as new from o where k > 1),
b as (select doc_id, i, sum(new::int) over (partition by doc_id order by i) as run from a),
r as (select doc_id, run, min(i) as s, max(i) + 100 as e from b group by 1, 2),
p as (select doc_id, s, e, coalesce(lag(e) over (partition by doc_id order by s), 0) as before from r),
q as (
  select p.doc_id, count(*) as n, sum(e - s) as removed, max(e) as last, string_agg(substring(x, 2 * before + 1, 2 * (s - before)), '' order by s) as kept
  from p join t on t.doc_id = p.doc_id group by 1)
select t.doc_id, (length(x) // 2)::bigint as n_bytes, coalesce(removed, 0)::bigint as n_removed, coalesce(n, 0)::bigint as n_spans,
  sha256(unhex(coalesce(kept, '') || substring(x, 2 * coalesce(last, 0) + 1))) as kept_sha256
from t left join q on q.doc_id = t.doc_id
"""

CONVERSATION_REPAIR = (
    _CRC_TABLE
    + f"""
c as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {_crc("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as k
  from conversations, tab),
d as (
  select conv_id, turn, case when k = 4 then 'user' else role end as role, case k when 1 then '' when 2 then translate(text, '.!?', '') else text end as text, copy
  from c, (select unnest([0, 1]) as copy) where k <> 0 and (copy = 0 or k = 3)),
"""
    + r"""
r as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as rn from d),
f as (
  select *, left(role, 1) as i, lag(left(role, 1)) over (partition by conv_id order by rn) as pi,
    row_number() over (partition by conv_id, role, text order by rn) as again, regexp_replace(text, '[\x20\x09-\x0D]+$', '') as body
  from r),
g as (select *, case when body = '' then 1 when again > 1 then 2 when right(body, 1) not in ('.', '!', '?') then 3 else 0 end as fault from f),
n as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 1) as blank, count(*) filter (where fault = 2) as duplicate,
    count(*) filter (where fault = 3) as truncated, count(*) filter (where pi is not null and pi || i not in ('su', 'ua', 'au')) as illegal, max(rn) as rows
  from g group by 1),
p(conv_id, rn, s0, s1, s2, s3) as (
  select conv_id, 0::bigint, {'c': 0, 'a': '', 'r': ''}, {'c': 1000000, 'a': '', 'r': ''}, {'c': 1000000, 'a': '', 'r': ''}, {'c': 1000000, 'a': '', 'r': ''} from (select distinct conv_id from c)
  union all
  select conv_id, rn,
    {'c': s0.c + 4, 'a': s0.a || 'D', 'r': s0.r},
    list_sort([{'c': s1.c + 4, 'a': s1.a || 'D', 'r': s1.r}, {'c': s0.c + late + case when i = 's' then 0 else 1000000 end, 'a': s0.a || 'K', 'r': s0.r || line}])[1],
    list_sort([{'c': b2.c + 4, 'a': b2.a || 'D', 'r': b2.r}, {'c': m.c + 3 + late, 'a': m.a || 'R', 'r': m.r || chr(10) || 'user:' || text},
      {'c': m.c + late + case when i = 'u' then 0 else 1000000 end, 'a': m.a || 'K', 'r': m.r || line}])[1],
    list_sort([{'c': b3.c + 4, 'a': b3.a || 'D', 'r': b3.r}, {'c': b2.c + 3 + late, 'a': b2.a || 'R', 'r': b2.r || chr(10) || 'assistant:' || text},
      {'c': b2.c + late + case when i = 'a' then 0 else 1000000 end, 'a': b2.a || 'K', 'r': b2.r || line}])[1]
  from (
    select *, list_sort([s0, s1, b3])[1] as m from (
      select *, list_sort([s2, {'c': m0.c + 3, 'a': m0.a || 'I', 'r': m0.r || chr(10) || 'user:'}])[1] as b2,
        list_sort([s3, {'c': s2.c + 3, 'a': s2.a || 'I', 'r': s2.r || chr(10) || 'assistant:'}, {'c': m1.c + 6, 'a': m1.a || 'II', 'r': m1.r || chr(10) || 'user:' || chr(10) || 'assistant:'}])[1] as b3
      from (
        select p.conv_id, p.rn + 1 as rn, s0, s1, s2, s3, i, text, chr(10) || role || ':' || text as line, case fault when 0 then 0 when 3 then 3 else 1000000 end as late,
          list_sort([s0, s1, s3])[1] as m0, list_sort([s0, s1])[1] as m1
        from p join g on g.conv_id is not distinct from p.conv_id and g.rn = p.rn + 1)))),
e as (
  select p.conv_id, list_sort([s0, s3, {'c': s2.c + 3, 'a': s2.a || 'I', 'r': s2.r || chr(10) || 'assistant:'},
    {'c': list_sort([s0, s1])[1].c + 6, 'a': list_sort([s0, s1])[1].a || 'II', 'r': list_sort([s0, s1])[1].r || chr(10) || 'user:' || chr(10) || 'assistant:'}])[1] as s
  from p left join n on n.conv_id is not distinct from p.conv_id where p.rn = coalesce(n.rows, 0))
select e.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
  coalesce(illegal, 0)::bigint as illegal, s.c::bigint as cost, s.a as audit, sha256(substring(s.r, 2)) as repaired_sha256
from e left join n on n.conv_id is not distinct from e.conv_id
"""
)

PERIODIC_RUNS = (
    _CRC_TABLE
    + f"""
d as (
  select doc_id, w, len(w) as n, h % 10 = 0 and len(w) > 0 as hit, (h // 10) % greatest(len(w), 1) as a, 3 + (h // 10) % 8 as k
  from (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w, {_crc("doc_id::varchar")} as h from documents, tab)),
"""
    + r"""
v as (select doc_id, n, case when hit then list_transform(range(n), lambda i: case when i < a then w[i + 1] else w[a + (i - a) % (1 + (n - a) // k) + 1] end) else w end as w from d),
x as (select doc_id, n, unnest(w) as word, unnest(range(n)) as i from v),
e as (select x.doc_id, y.i - x.i as q, x.i as i from x join x y on y.doc_id = x.doc_id and y.word = x.word and y.i > x.i and 2 * (y.i - x.i) <= x.n),
l as (select doc_id, q, i, i - row_number() over (partition by doc_id, q order by i) as run from e),
m as (select doc_id, q, min(i) as s, count(*) + q as n from l group by doc_id, q, run having count(*) + q >= greatest(12, 2 * q)),
r as (select doc_id, s, n, min(q) as q from m group by 1, 2, 3),
g as (select doc_id, list(distinct i) as gone from (select doc_id, unnest(range(s + q, s + n)) as i from r) group by 1),
b as (select doc_id, count(*) as runs, string_agg(s || ',' || n || ',' || q || chr(10), '' order by s, q) as listed, min({'n': -n, 's': s, 'q': q}) as best from r group by 1)
select v.doc_id, coalesce(runs, 0)::bigint as n_runs, best.s::bigint as start, (-best.n)::bigint as length, best.q::bigint as period, (1000 * -best.n // best.q)::bigint as exponent_milli,
  sha256(coalesce(listed, '')) as runs_sha256,
  sha256(array_to_string(case when gone is null then v.w else list_transform(list_filter(range(v.n), lambda i: not list_contains(gone, i)), lambda i: v.w[i + 1]) end, ' ')) as collapsed_sha256
from v left join b on b.doc_id = v.doc_id left join g on g.doc_id = v.doc_id
"""
)
