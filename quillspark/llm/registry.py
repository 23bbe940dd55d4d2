"""The numbered queries and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import audio, language, merkle, mixing, neardup, packing, prefix_trie, rans, repeats, secrets, simhash, topk, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(_read(spark, sf_dir, "documents"))


OP1_SQL = r"""
with sized as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, ('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, 'null') || ':' || md5(coalesce(text, ''))), 1, 13))::bigint as key from documents),
sources as (select source, sum(size)::double as s, row_number() over (order by source nulls last) - 1 as nth from sized group by source),
weighed as (select *, case nth % 3 when 0 then 5.0 when 1 then 2.0 else 1.0 end::double as w, 2 * s as cap from sources),
steps as (select *, coalesce(sum(cap) over before, 0) as caps, coalesce(sum(w) over before, 0) as ws from weighed window before as (order by cap / w, nth rows between unbounded preceding and 1 preceding)),
level as (select max((1.5 * (select sum(s) from weighed) - caps) / ((select sum(w) from weighed) - ws)) as l from steps),
targets as (select source, s::bigint as source_size, least(cap, l * w) as target from steps, level),
placed as (select doc_id, d.source, size, source_size, target, coalesce(sum(size) over (partition by d.source order by key rows between unbounded preceding and 1 preceding), 0)::bigint as before from sized d join targets t on d.source is not distinct from t.source),
parts as (select *, case when source_size > 0 then floor(floor(target) / source_size)::bigint else 0 end as e from placed)
select doc_id, source, size, source_size, target, (e * size + greatest(0, least(size, floor(target)::bigint - e * source_size - before)))::bigint as taken from parts
"""

def op2_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.round_trip(_read(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"))


OP3_SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
q as (select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) end as first from p)
select page_id, payload_bytes, payload_digest, case when page_id > first then 'revisit' else 'response' end as record_type, case when page_id > first then first end as refers_to from q
"""


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), with_ids=False, added_tokens=True).drop("row")


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removal(_read(spark, sf_dir, "documents"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"))


OP6_SQL = """
with v as (select row_number() over () as row, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.row, q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score from v q join v c on q.vec_id % 50 = 0 and q.row <> c.row),
r as (select *, row_number() over (partition by row order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""


def op7_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.media_digests(_read(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_read(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_read(spark, sf_dir, "documents"))


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.dedup_components(_read(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tampered(_read(spark, sf_dir, "documents"))


def _crc32_sql(text: str) -> str:
    """The checksum of an ASCII string in DuckDB, which has none: a bit at a step."""
    x = f"(case when bit % 8 = 0 then xor(crc, ascii(substr({text}, (bit // 8 + 1)::int, 1))::bigint) else crc end)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, range(8 * length({text}))), lambda crc, bit: xor({x} >> 1, ({x} & 1) * 3988292384)), 4294967295)"


def _tree_sql(name: str, nodes: str, levels: int) -> str:
    """CTEs of a forest: ``nodes`` has tree, idx, digest. {name}_top: tree, digest. {name}_s0, _s1, ...: what stands before and after each node, null above the root."""
    out = [f"{name}_0 as materialized (select *, count(*) over (partition by tree) as n from ({nodes}))"]
    for k in range(levels):
        frame = "partition by tree, idx // 8 order by idx rows between"
        out.append(f"{name}_s{k} as materialized (select tree, idx, coalesce(string_agg(digest, '') over ({frame} unbounded preceding and 1 preceding), '') as before, coalesce(string_agg(digest, '') over ({frame} 1 following and unbounded following), '') as after from {name}_{k} where n > 1)")
        out.append(f"{name}_{k + 1} as materialized (select tree, idx // 8 as idx, case when any_value(n) > 1 then sha256(string_agg(digest, '' order by idx)) else any_value(digest) end as digest, (any_value(n) + 7) // 8 as n from {name}_{k} group by tree, idx // 8)")
    out.append(f"{name}_top as materialized (select tree, digest from {name}_{levels})")
    return ",\n".join(out)


def _folds_sql(name: str, source: str, forest: str, tree: str, idx: str, levels: int) -> str:
    """CTEs that lead the column cur of ``source`` up through a forest, and gather the siblings in proof."""
    out = []
    for k in range(levels):
        out.append(f"{name}{k} as materialized (select x.* exclude (cur, proof), case when s.before is null then cur else sha256(s.before || cur || s.after) end as cur, proof || coalesce(s.before || s.after, '') as proof from {source} x left join {forest}_s{k} s on s.tree = x.{tree} and s.idx = x.{idx} // {8**k})")
        source = f"{name}{k}"
    return ",\n".join(out)


_FIELD = lambda c: f"case when {c} is null then '-' else octet_length(encode({c}::varchar)) || ':' || {c}::varchar end"
_LEAF = lambda text: f"sha256({' || '.join(_FIELD(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"
#: Six levels are enough for 262,144 documents a language, two for 64 languages.
OP11_SQL = f"""
with leaves as materialized (select *, coalesce('1' || lang, '0') as tree, {_LEAF('text')} as leaf, case when {_crc32_sql('doc_id::varchar')} % 3 = 0 then {_LEAF("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} else {_LEAF('text')} end as cur from documents),
placed as materialized (select doc_id, tree, leaf, cur, '' as proof, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as idx from leaves),
{_tree_sql('f', 'select tree, idx, leaf as digest from placed', 6)},
subroots as materialized (select tree as name, digest, '' as tree, row_number() over (order by tree) - 1 as idx from f_top),
{_tree_sql('g', 'select tree, idx, digest from subroots', 2)},
{_folds_sql('p', 'placed', 'f', 'tree', 'idx', 6)},
named as materialized (select p5.*, s.digest as subroot, s.idx as place, '' as top from p5 join subroots s on s.name = p5.tree),
{_folds_sql('q', 'named', 'g', 'top', 'place', 2)}
select doc_id, leaf, subroot, g_top.digest as root, sha256(proof) as proof_sha256, cur as folded_root, cur = g_top.digest as verified from q1, g_top
"""


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.edits_and_neighbours(_read(spark, sf_dir, "documents"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(_read(spark, sf_dir, "conversations"))


OP13_SQL = rf"""
with t as materialized (select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), sha256(coalesce(text, ''))) - 1 as i from conversations where conv_id is not null),
ids as materialized (select c, {_crc32_sql('c::varchar')} % 4 as h, c - c % 20 as b, n from (select c, count(*) as n from t group by c)),
led as (select x.c, x.h, x.b, least(x.h, coalesce(y.n, 0)) as m from ids x left join ids y on y.c = x.b),
rebuilt as (select led.c, t.i as p, role, text from led join t on t.c = led.b and t.i < led.h union all select led.c, t.i - led.h + led.m, role, text from led join t on t.c = led.c and t.i >= led.h),
steps as (select c, p + 1 as d, sha256(string_agg(octet_length(encode(role)) || ':' || role || octet_length(encode(text)) || ':' || text, '') over (partition by c order by p)) as k, len(regexp_extract_all(text, '[^ 	-
]+')) as words from rebuilt),
paths as materialized (select c, 0 as d, '' as k, 0 as words from ids union all select c, d, k, words from steps),
nodes as (select d, k, min(c) as conv_id, count(*) as n, any_value(words) as words from paths group by d, k),
family as (select distinct a.d, a.k, b.k as parent from paths a join paths b on a.c = b.c and a.d = b.d + 1),
children as (select d - 1 as d, parent as k, count(*) as children from family group by all),
whole as materialized (select nodes.*, coalesce(children, 0) as children, family.parent from nodes left join children using (d, k) left join family using (d, k)),
below as (select distinct a.d, a.k, b.d as bd, b.k as bk from paths a join paths b on a.c = b.c and b.d >= a.d),
sums as (select below.d, below.k, sum((w.n - 1) * w.words) as saved, count_if(w.children = 0) as leaves from below join whole w on w.d = below.bd and w.k = below.bk group by all),
ends as (select d, k, string_agg(c::varchar, ',' order by c) as ends from (select c, max(d) as d, max_by(k, d) as k from paths group by c) group by d, k)
select w.conv_id, w.d::bigint as depth, p.conv_id as parent_conv_id, w.n::bigint as n_convs, w.children::bigint as n_children, leaves::bigint as n_leaves, saved::bigint as saved_tokens, sha256(coalesce(ends, '')) as ends_sha256
from whole w join sums using (d, k) left join ends using (d, k) left join whole p on p.d = w.d - 1 and p.k = w.parent
"""

QUERIES = {
    "op1_mix": op1_mix,
    "op2_rans": op2_rans,
    "op3_warc": op3_warc,
    "op4_pack": op4_pack,
    "op5_repeats": op5_repeats,
    "op6_topk": op6_topk,
    "op7_audio": op7_audio,
    "op8_language": op8_language,
    "op9_secrets": op9_secrets,
    "op10_neardup": op10_neardup,
    "op11_merkle": op11_merkle,
    "op12_simhash": op12_simhash,
    "op13_trie": op13_trie,
}
ORACLE_SQL = {"op1_mix": OP1_SQL, "op3_warc": OP3_SQL, "op6_topk": OP6_SQL, "op11_merkle": OP11_SQL, "op13_trie": OP13_SQL}
