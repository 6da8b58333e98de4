"""The subpackage's queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.conversation_trie import conversation_trie
from tidemark.llm.embedding_dedup import embedding_components
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.packing import pack
from tidemark.llm.piece_codec import round_trip
from tidemark.llm.pii import find_pii, fit_pii
from tidemark.llm.quality import quality_scores
from tidemark.llm.resampling import resample
from tidemark.llm.sharding import even_tree, shard_rows
from tidemark.llm.simhash import simhash_components
from tidemark.llm.token_counts import token_counts
from tidemark.llm.url_filter import judge_urls

#: The contract's rules.
URL_RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find_pii(docs, model=fit_pii(docs))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(table(spark, sf_dir, "embeddings"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_lines, n_removed, text_sha256`` of every document after the removal of repeated lines of any length (null text: empty; blank lines stay)."""
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), least=1)
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations")).drop("turn")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"), even_tree(16))


OP2_SQL = """
with rules(action, host, path) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
  ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
rest as (select page_id, case when url like '%://%' then substr(url, instr(url, '://') + 3) else '' end as r from pages),
parts as (select page_id,
  translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path from rest),
fit as (select p.page_id, p.host, p.path, x.action, x.host || x.path as rule,
  row_number() over (partition by p.page_id order by length(x.host || x.path) desc nulls last) as n
  from parts p left join rules x
  on (p.host = x.host or ends_with(p.host, '.' || x.host)) and starts_with(p.path, x.path))
select page_id, host, path, rule, coalesce(action, 'allow') as verdict from fit where n = 1
"""

OP3_SQL = """
with d as (select doc_id, sha256(coalesce(text, '')) as text_sha256 from documents)
select doc_id, max(doc_id) over (partition by text_sha256) as keep_id,
  count(*) over (partition by text_sha256) as group_size,
  doc_id = max(doc_id) over (partition by text_sha256) as kept, text_sha256 from d
"""


OP7_SQL = """
with recursive v as (select vec_id, label, embedding::DOUBLE[] as e from embeddings where label is not null and embedding is not null),
p as (select a.vec_id as x, b.vec_id as y from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.93),
reach as (select vec_id as x, vec_id as y from embeddings union select r.x, p.y from reach r join p on p.x = r.y),
low as (select x, min(y) as component_id from reach group by x), links as (select x, count(*) as n from p group by x)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept
from embeddings join low on low.x = vec_id left join links on links.x = vec_id
"""

#: Bytes of a text, and their CRC-32 by a table of 256 steps (``crc.t``).
CRC = """tab(n, v, k) as (select range::UBIGINT, range::UBIGINT, 0 from range(256) union all
  select n, xor(v >> 1, (v & 1) * 3988292384::UBIGINT), k + 1 from tab where k < 8),
crc as (select list(v order by n) as t from tab where k = 8)"""


def crc_of(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes in SQL, where ``crc`` is joined."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::UBIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {octets}), lambda x, b: xor(x >> 8, t[(xor(x, b) & 255)::INT + 1])), 4294967295::UBIGINT)::BIGINT"


OP11_SQL = f"""
with recursive {CRC},
own as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id
  order by turn nulls first, sha256(octet_length(encode(coalesce(role, '')))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) as place
  from conversations where conv_id is not null),
conv as (select conv_id, conv_id - conv_id % 100 as base, {crc_of("conv_id::VARCHAR")} % 6 as h from (select distinct conv_id from own), crc),
rebuilt as (select c.conv_id, o.place, o.role, o.text from conv c join own o on o.conv_id = c.base and o.place <= c.h
  union all select c.conv_id, o.place + least(c.h, (select count(*) from own b where b.conv_id = c.base)) - c.h, o.role, o.text from conv c join own o on o.conv_id = c.conv_id and o.place > c.h),
step as (select conv_id, place, length(text) as points, sha256(octet_length(encode(role))::VARCHAR || ':' || role || text) as s from rebuilt),
path as (select conv_id, place as depth, points, sha256(string_agg(s, '') over (partition by conv_id order by place)) as key from step
  union all select conv_id, 0, 0, '' from conv),
placed as (select *, min(conv_id) over (partition by key) as first, depth = max(depth) over (partition by conv_id) as final,
  lag(key) over (partition by conv_id order by depth) as parent from path),
summed as (select *, bool_and(final) over (partition by key) as leaf, points * (first = conv_id)::INT as own_points from placed),
below as (select *, sum(points - own_points) over w as saved, sum((leaf and first = conv_id)::INT) over w as leaves from summed
  window w as (partition by conv_id order by depth desc)),
node as (select key, any_value(depth) as depth, any_value(parent) as parent, min(conv_id) as conv_id, count(*) as n_convs, sum(saved)::BIGINT as saved_tokens, sum(leaves)::BIGINT as n_leaves,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' order by conv_id) filter (where final), '')) as ends_sha256 from below group by key)
select n.conv_id, n.depth::BIGINT as depth, p.conv_id as parent_conv_id, n.n_convs, (select count(*) from node c where c.parent = n.key) as n_children, n.n_leaves, n.saved_tokens, n.ends_sha256
from node n left join node p on n.parent = p.key
"""

WORDS = lambda text: rf"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP12_SQL = f"""
with recursive {CRC},
doc as (select row_number() over () as n, doc_id, {WORDS("text")} as words from documents),
raw as (select n, unnest(words) as w from doc), target as (select unnest({WORDS("text")}) as w from benchmark),
word as (select w, {crc_of("w")} % 10000 as bucket from (select w from raw union select w from target), crc),
s as (select bucket, count(*) as s from raw join word using (w) group by bucket), t as (select bucket, count(*) as t from target join word using (w) group by bucket),
total as (select (select count(*) from raw) as ss, (select count(*) from target) as tt),
gain as (select w, floor(1000 * ln(((coalesce(t, 0) + 1.0::DOUBLE) * (ss + 10000)) / ((coalesce(s, 0) + 1.0::DOUBLE) * (tt + 10000))))::BIGINT as g
  from word left join s using (bucket) left join t using (bucket), total),
weight as (select n, floor(sum(g)::DOUBLE / count(*))::BIGINT as weight from raw join gain using (w) group by n),
scored as (select doc_id, len(words) as n_features, coalesce(weight, 0) as weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT as score
  from doc left join weight using (n)),
ranked as (select *, case when n_features >= 20 then row_number() over (partition by n_features >= 20 order by score desc, doc_id nulls first) end as r, count(*) filter (where n_features >= 20) over () as c from scored)
select doc_id, n_features, weight, score, case when r <= 10 * c // 100 then r end as rank from ranked
"""

OP13_SQL = f"""
with recursive {CRC},
leaf(tree, region, rack, shard) as (select t, n // 8, n // 4, n from range(17) r(n), range(16, 18) s(t) where n < t),
doc as (select row_number() over () as n, doc_id, coalesce(doc_id::VARCHAR, '') as k, coalesce(text, '') as text from documents),
region as (select n, k, tree, arg_min(region, -ln((('0x' || sha256(k || ':region:' || region)[1:13])::BIGINT + 0.5::DOUBLE) / pow(16, 13)) / w) as region
  from doc, (select tree, region, count(*) as w from leaf group by all) group by all),
rack as (select n, k, tree, arg_min(rack, -ln((('0x' || sha256(k || ':rack:' || rack)[1:13])::BIGINT + 0.5::DOUBLE) / pow(16, 13)) / w) as rack
  from region join (select tree, region, rack, count(*) as w from leaf group by all) using (tree, region) group by all),
shard as (select n, tree, arg_min(shard, -ln((('0x' || sha256(k || ':shard:' || shard)[1:13])::BIGINT + 0.5::DOUBLE) / pow(16, 13))) as shard
  from rack join leaf using (tree, rack) group by all)
select doc_id, octet_length(encode(text)) + 1 as size, {crc_of("text")} as text_crc32, 'key' as law, s.shard::INT as shard,
  row_number() over (partition by s.shard order by doc_id nulls first) - 1 as slot, g.shard::INT as grown_shard
from doc join shard s on s.n = doc.n and s.tree = 16 join shard g on g.n = doc.n and g.tree = 17, crc
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_piece_codec": op1_piece_codec,
        "op2_url_filter": op2_url_filter,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_pii": op4_pii,
        "op5_simhash": op5_simhash,
        "op6_token_counts": op6_token_counts,
        "op7_embedding_dedup": op7_embedding_dedup,
        "op8_packing": op8_packing,
        "op9_line_dedup": op9_line_dedup,
        "op10_quality": op10_quality,
        "op11_conversation_trie": op11_conversation_trie,
        "op12_resampling": op12_resampling,
        "op13_sharding": op13_sharding,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_filter": OP2_SQL,
        "op3_exact_dedup": OP3_SQL,
        "op7_embedding_dedup": OP7_SQL,
        "op11_conversation_trie": OP11_SQL,
        "op12_resampling": OP12_SQL,
        "op13_sharding": OP13_SQL,
    }
