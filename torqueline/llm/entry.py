"""Queries of this subpackage: each applies one operator to its whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import Codec, encoding_digests, read_ranks
from .chat_format import forked_pairs
from .conversation_repair import damaged, repair_digests
from .decontamination import contamination
from .fingerprints import fingerprints
from .language_id import identify_languages
from .near_dedup import near_duplicates
from .oracles import CONVERSATION_REPAIR, PERIODIC_RUNS, SUFFIX_DEDUP
from .periodic_runs import made_periodic, run_digests
from .personal_data import personal_data
from .quality import quality_scores
from .repeated_spans import without_repeats
from .suffix_dedup import repeat_digests
from .token_counts import token_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, share=80)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op3_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation against its fork with another one's last answer (conversations 2k and 2k + 1 are partners)."""
    return forked_pairs(table(spark, sf_dir, "conversations"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 13, 20).drop("version")


def multilingual_codec() -> Codec:
    return Codec(read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(table(spark, sf_dir, "documents"), multilingual_codec())


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).drop("n_chunks")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op9_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"), 13)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digests(table(spark, sf_dir, "documents"), 100)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations are damaged by a checksum of their turns and repaired with the least edits."""
    return repair_digests(damaged(table(spark, sf_dir, "conversations")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of 12 words or more; one text in ten is made periodic before."""
    return run_digests(table(spark, sf_dir, "documents"), 12, made_periodic)


QUERIES = {
    f.__name__: f
    for f in (
        op1_near_duplicates,
        op2_language_id,
        op3_chat_preferences,
        op4_decontamination,
        op5_byte_bpe,
        op6_fingerprints,
        op7_token_counts,
        op8_personal_data,
        op9_repeated_spans,
        op10_quality,
        op11_suffix_dedup,
        op12_conversation_repair,
        op13_periodic_runs,
    )
}

SQL: dict[str, str] = {
    "op1_near_duplicates": r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [w] else list_transform(range(1, len(w) - 2), lambda i: w[i : i + 3]) end) as g from w),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
r(doc_id, c) as (select doc_id, doc_id from documents union select r.doc_id, l.b from r join l on l.a = r.c)
select d.doc_id, coalesce(max(n.n), 0)::bigint as n_shingles, min(r.c) as component_id, d.doc_id = min(r.c) as kept
from documents d join r on r.doc_id = d.doc_id left join n on n.doc_id = d.doc_id group by d.doc_id
""",
    "op3_chat_preferences": r"""
with v as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn, coalesce(role, ''), coalesce(text, '')) as rn
  from conversations where conv_id is not null),
a as (select conv_id, max(rn) filter (where role = 'assistant') as a from v group by 1),
p as (select x.conv_id as pair_id, x.a, y.conv_id as other, y.a as b from a x left join a y on y.conv_id = xor(x.conv_id, 1)),
t as (
  select pair_id, true as chosen, role, text, rn from p join v on conv_id = pair_id
  union all select pair_id, false, role, text, rn from p join v on conv_id = pair_id where b is not null and rn < a
  union all select pair_id, false, role, text, a from p join v on conv_id = other and rn = b where a is not null),
j as (
  select coalesce(c.pair_id, r.pair_id) as pair_id, coalesce(c.rn, r.rn) as rn,
    c.rn is not null and r.rn is not null and coalesce(c.role = r.role and c.text = r.text, false) as same
  from (select * from t where chosen) c full join (select * from t where not chosen) r on c.pair_id = r.pair_id and c.rn = r.rn),
n as (select pair_id, coalesce(min(rn) filter (where not same), max(rn) + 1) - 1 as n from j group by 1),
o as (
  select t.*, n.n, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) as line,
    coalesce(sum(length('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10))) filter (where rn > n) over (partition by t.pair_id, chosen order by rn rows between unbounded preceding and 1 preceding), 0)::bigint as off
  from t join n on n.pair_id = t.pair_id)
select pair_id, max(n)::bigint as n_common,
  coalesce(string_agg(line, '' order by rn) filter (where chosen and rn <= n), '') as prompt,
  coalesce(string_agg(line, '' order by rn) filter (where chosen and rn > n), '') as chosen,
  coalesce(string_agg(line, '' order by rn) filter (where not chosen and rn > n), '') as rejected,
  coalesce(string_agg((off + length(role) + 5) || ':' || (off + length(line) - 1), ',' order by rn) filter (where chosen and rn > n and role = 'assistant'), '') as chosen_mask,
  coalesce(string_agg((off + length(role) + 5) || ':' || (off + length(line) - 1), ',' order by rn) filter (where not chosen and rn > n and role = 'assistant'), '') as rejected_mask
from o group by pair_id
""",
    "op4_decontamination": r"""
with b as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null),
g as (select distinct item_id, case when len(w) <= 13 then w else w[i : i + 12] end as g from (select item_id, w, unnest(range(1, greatest(len(w) - 11, 2))) as i from b where len(w) > 0)),
d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
n as (select distinct len(g) as n from g),
k as (select doc_id, i, n, w[i : i + n - 1] as g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, n where len(w) >= n)),
h as (select k.doc_id, k.i, k.n, g.item_id from k join g on g.g = k.g),
c as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + n)) as j from h) group by 1),
m as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from h group by 1),
t as (select doc_id, unnest(w) as term, unnest(range(len(w))) as pos from d),
f as (select term, count(*) as k from t where term in (select unnest(g) from g) group by 1),
p as (select item_id, g, unnest(g) as term, unnest(range(len(g))) as off from g),
r as (select item_id, g, list(struct_pack(term := term, off := off) order by coalesce(k, 0), term, off) as r, min(coalesce(k, 0)) as k from p left join f using (term) group by 1, 2),
o as (select a.doc_id, r.item_id from r join t a on a.term = r.r[1].term join t b on b.term = r.r[2].term and b.doc_id = a.doc_id
  where r.k > 0 and b.pos <> a.pos and b.pos >= a.pos - r.r[1].off and b.pos < a.pos - r.r[1].off + len(r.g)),
q as (select doc_id, count(distinct item_id) as n_near from (select doc_id, item_id from o union all select doc_id, item_id from h) group by 1)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated, coalesce(n_near, 0)::bigint as n_near
from d left join c on c.doc_id = d.doc_id left join m on m.doc_id = d.doc_id left join q on q.doc_id = d.doc_id
""",
    "op9_repeated_spans": r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
k as (select doc_id, i, w[i : i + 12] as g from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from w where len(w) >= 13)),
m as (select g, min(doc_id) as m from k group by 1),
c as (select distinct k.doc_id, unnest(range(i, i + 13)) as i from k join m on m.g = k.g where m.m < k.doc_id),
r as (select doc_id, list(i) as gone from c group by 1)
select w.doc_id, len(w)::bigint as n_words, coalesce(len(gone), 0)::bigint as n_removed,
  sha256(array_to_string(case when gone is null then w else list_transform(list_filter(range(1, len(w) + 1), lambda i: not list_contains(gone, i)), lambda i: w[i]) end, ' ')) as kept_sha256
from w left join r on r.doc_id = w.doc_id
""",
    "op11_suffix_dedup": SUFFIX_DEDUP,
    "op12_conversation_repair": CONVERSATION_REPAIR,
    "op13_periodic_runs": PERIODIC_RUNS,
}
