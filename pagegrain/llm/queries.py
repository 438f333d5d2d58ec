"""The queries of this subpackage, by name; each runs over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pagegrain.llm.common import table

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagegrain.llm.token_store import token_store

    return token_store(spark, table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op2_lm_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagegrain.llm.lm_trie import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op3_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagegrain.llm.fm_index import contamination_report

    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_slot_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagegrain.llm.slot_shards import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


def op5_host_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagegrain.llm.host_suffix import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagegrain.llm.toxicity import toxicity_scores

    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagegrain.llm.set_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op8_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagegrain.llm.lattice import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagegrain.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagegrain.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_store, op2_lm_trie, op3_fm_index, op4_slot_shards, op5_host_suffix, op6_toxicity, op7_set_join, op8_lattice, op9_token_counts, op10_packing)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"
#: References of old names hold without their semicolon too, as where a title was cut.
_DECODED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '&quot;?', '"', 'g'), '&copy;?', chr(169), 'g'), '&middot;?', chr(183), 'g'), '&lt;?', '<', 'g'), '&amp;?', '&', 'g')"""

_OP3 = f"""
with d as (select row_number() over () as r, doc_id, {_ALNUM} as w from documents),
b as (select coalesce(item_id::varchar, 'null') as item, {_ALNUM} as w from benchmark),
win as (select distinct item, list_slice(w, k, k + 9) as p from (select item, w, unnest(generate_series(1, greatest(1, len(w) - 9))) as k from b where len(w) > 0)),
sizes as (select distinct len(p) as n from win),
places as (select r, k, n, list_slice(w, k, k + n - 1) as p from (select r, w, n, unnest(generate_series(1, len(w) - n + 1)) as k from d, sizes where len(w) >= n)),
hits as (select r, k, n, item from places join win using (p)),
covered as (select r, count(distinct place) as n_hit from (select r, unnest(generate_series(k, k + n - 1)) as place from hits) group by r),
found as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item from hits) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated from d left join covered using (r) left join found using (r)
"""

#: CRC-32 bit by bit over the bytes of a text, a table of 256 remainders first.
_OP4 = """
with recursive step(i, k, c) as (select i, 0, i from range(256) t(i) union all select i, k + 1, case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end from step where k < 8),
crc_table as (select list(c order by i) as t from step where k = 8),
texts as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
bytes as (select r, doc_id, octet_length(encode(text)) + 1 as size, hex(encode(text)) as h from texts),
crcs as (select r, doc_id, size, case when h = '' then 0 else xor(list_reduce(list_transform(range(1, size), lambda k: ('0x' || substr(h, 2 * k - 1, 2))::bigint), lambda c, b: xor(c // 256, t[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295) end as crc from bytes, crc_table),
named as (select r, doc_id, size::bigint as size, crc::bigint as crc, (('0x' || substr(md5(coalesce(doc_id::varchar, 'null') || '|' || crc::varchar || '|' || size::varchar), 1, 8))::bigint % 8192)::int as vslot from crcs),
sums as (select vslot, sum(size)::bigint as bytes, count(*) as n from named group by vslot),
ordered as (select vslot, bytes, row_number() over (order by bytes desc, vslot) as k from sums),
assign(k, loads, vslot, shard) as (
  select 0::bigint, list_transform(range(16), lambda x: 0::bigint), -1, -1
  union all
  select o.k, list_transform(loads, lambda x, i: case when i = list_position(loads, list_min(loads)) then x + o.bytes else x end), o.vslot, list_position(loads, list_min(loads))::int - 1
  from assign a join ordered o on o.k = a.k + 1),
placed as (select vslot, shard, coalesce(sum(n) over (partition by shard order by vslot rows between unbounded preceding and 1 preceding), 0) as base from assign join sums using (vslot))
select doc_id, size, crc as text_crc32, 'bytes' as law, shard::int as shard, (base + row_number() over (partition by vslot order by doc_id nulls first, crc, size) - 1)::bigint as slot, null::int as grown_shard
from named join placed using (vslot)
"""

_OP5 = rf"""
with a as (select page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|<footer>|\z)', 1) as h from pages),
t as (select page_id, url, trim(regexp_replace({_DECODED.format("regexp_replace(regexp_replace(h, '</?(?:p|br|h1)>', ' ', 'g'), '<[^>]*>?', '', 'g')")}, '\s+', ' ', 'g')) as text from a)
select page_id, url, text, length(text)::bigint as n_chars from t
"""

_COMPONENTS = """
reach(a, b) as (select a, b from links union select reach.a, links.b from reach join links on reach.b = links.a)
"""

_OP7 = f"""
with recursive d as (select doc_id, {_SPACED} as w from documents),
s as (select distinct doc_id, list_slice(w, k, k + 3) as p from (select doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 3))) as k from d where len(w) > 0)),
sizes as (select doc_id, count(*) as n from s group by doc_id),
pairs as (select x.doc_id as a, y.doc_id as b, count(*) as shared from s x join s y using (p) where x.doc_id <> y.doc_id group by all),
links as (select a, b from pairs join sizes m on m.doc_id = a join sizes o on o.doc_id = b where 100 * shared >= 85 * (m.n + o.n - shared)),
{_COMPONENTS}
select doc_id, coalesce(n, 0)::bigint as n_shingles, least(doc_id, coalesce(low, doc_id)) as component_id
from documents left join sizes using (doc_id) left join (select a as doc_id, min(b) as low from reach group by a) using (doc_id)
"""

_OP8 = f"""
with recursive v as (select vec_id, label, embedding::double[] as e from embeddings where label is not null and list_cosine_similarity(embedding::double[], embedding::double[]) > 0.5),
links as (select x.vec_id as a, y.vec_id as b from v x join v y on x.label = y.label and x.vec_id <> y.vec_id where list_cosine_similarity(x.e, y.e) >= 0.93),
{_COMPONENTS}
select vec_id, coalesce(n, 0)::bigint as n_links, least(vec_id, coalesce(low, vec_id)) as component_id, coalesce(low, vec_id) >= vec_id as kept
from embeddings left join (select a as vec_id, count(*) as n from links group by a) using (vec_id) left join (select a as vec_id, min(b) as low from reach group by a) using (vec_id)
"""

#: For the small tables of the driver's comparison; the other queries are tested against the library or brute force.
ORACLE_SQL: dict[str, str] = {"op3_fm_index": _OP3, "op4_slot_shards": _OP4, "op5_host_suffix": _OP5, "op7_set_join": _OP7, "op8_lattice": _OP8}
