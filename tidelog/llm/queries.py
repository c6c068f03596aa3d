"""One query per corpus operator over its whole table, with the SQL of its expected result where SQL has it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import alignment, decontaminate, langid, lines, pieces, pii, sharding, shards, simhash, substrings, topk, trie, urls
from tidelog.llm.common import prepare, table
from tidelog.session import shared_dir

#: Where the public vocabularies lie.
TOKENIZERS = "/opt/tokenizers"
# Fixed value: the pattern that belongs to the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_ID = 50256


def digest(text) -> F.Column:
    return F.sha2(text, 256)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    found = pii.find_pii(docs, drop=("text",))
    base = F.filter("pii", lambda s: s.base)
    count = lambda kind: F.size(F.filter(base, lambda s: s.kind == kind)).cast("bigint")
    counts = [count(kind).alias(f"n_{kind}") for kind in pii.KINDS[:4]]
    return found.select(
        "doc_id", *counts, digest(pii.listed(base)).alias("base_sha256"), pii.listed(F.col("pii")).alias("spans")
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(prepare(spark), sf_dir, "documents"))
    hexed = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return found.select("doc_id", hexed.alias("fingerprint"), "component_id")


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the numbers of lines and of removed lines, and the text that is left."""
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    return lines.dedupe_lines(docs, counts=("n_lines", "n_removed"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.find_repeats(table(prepare(spark), sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", digest("kept").alias("kept_sha256"))


OP4_SQL = r"""
with d as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x{20}\x{09}-\x{0D}]+') as w from documents),
g as (
  select doc_id, i, md5(list_aggregate(w[i : i + 34], 'string_agg', ' ')) as g
  from (select doc_id, w, unnest(range(1, len(w) - 33)) as i from d where len(w) >= 35)),
r as (select doc_id, i from g where g in (select g from g group by g having count(*) > 1)),
h as (select distinct doc_id, unnest(range(i, i + 35)) as p from r),
k as (
  select doc_id, string_agg(word, ' ' order by p) as kept, count(*) as n
  from (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d) anti join h using (doc_id, p)
  group by 1)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed,
  sha256(coalesce(kept, '')) as kept_sha256
from d left join k using (doc_id)
"""


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    model = langid.train(docs.where(langid.for_training()))
    found = langid.predict(docs.select("doc_id", "text"), model, drop=("text",))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(prepare(spark), sf_dir, "embeddings")
    return topk.top_k(vectors.where(F.col("vec_id") % 100 == 0), vectors)


OP6_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.v, c.v) as bigint) as score
  from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id)
select query_id, cast(rank as int) as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
where rank <= 10
"""


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), drop=("text",))
    hit = decontaminate.hit_words(F.col("hits"))
    names = F.array_join(F.sort_array(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        digest(names).alias("items_sha256"),
        ((hit > 0) & (hit * decontaminate.ONE_IN >= F.col("n_words"))).alias("contaminated"),
    )


OP7_SQL = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') as w from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') as w
  from benchmark where item_id is not null),
bw as (
  select distinct item_id, n, list_aggregate(w[i : i + n - 1], 'string_agg', ' ') as g
  from (select item_id, w, least(13, len(w)) as n, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i
        from b where len(w) > 0)),
dw as (
  select doc_id, i, n, list_aggregate(w[i : i + n - 1], 'string_agg', ' ') as g
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i
        from d, (select distinct n from bw) where len(w) >= n)),
h as (select dw.doc_id, dw.i, dw.n, bw.item_id from dw join bw using (n, g)),
c as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from h) group by 1),
t as (select doc_id, count(distinct item_id) as n_items,
        string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from h group by 1)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join c using (doc_id) left join t using (doc_id)
"""

def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels: a page shows the document whose number its path ends with; a page is bad if that document is labelled
    as toxic or of low quality."""
    pages, labels = table(prepare(spark), sf_dir, "pages"), table(spark, sf_dir, "labels")
    number = F.regexp_extract(urls.path_of(F.col("url")), r"/([0-9]{1,18})(\.html)?/?$", 1)
    shown = pages.select("url", F.when(number != "", number).cast("bigint").alias("doc_id"))
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    return urls.judge(pages, shown.join(labels, "doc_id").select("url", bad.alias("bad")))


def op9_sentencepiece(spark: SparkSession, sf_dir: str, model: str = f"{TOKENIZERS}/piece_bpe_32k.model") -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    return pieces.encode_and_check(docs, pieces.read_pieces(model))


def op10_shards(
    spark: SparkSession, sf_dir: str, ranks: str = f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken", key: int = 20240601
) -> DataFrame:
    """Every sequence as it was read back from the shards; the ids as a digest of their two-byte values."""
    docs = table(prepare(spark), sf_dir, "documents")
    path = shared_dir(spark, "shards")
    shards.write_shards(docs, shards.read_vocabulary(ranks, PATTERN, END_ID), path, key=key)
    found = shards.read_shards(spark, path, raw=True)
    n_ids = (F.octet_length("ids") / 2).cast("int").alias("n_ids")
    return found.select("slot", "shard", "doc_id", "part", n_ids, digest("ids").alias("ids_sha256"))


def op11_alignment(
    spark: SparkSession, sf_dir: str, byte_level: str = f"{TOKENIZERS}/byte_bpe_50k.json", model: str = f"{TOKENIZERS}/piece_bpe_32k.model"
) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    return alignment.align_and_count(docs, alignment.read_tokenizers(byte_level, model))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are written into their shards; the rows tell of the records as they were read back."""
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    body = F.coalesce("text", F.lit(""))
    sized = docs.withColumns({"size": F.octet_length(body).cast("bigint") + 1, "text_crc32": F.crc32(body)})
    path = shared_dir(spark, "sharding")
    sharding.write_shards(sized, path, order=("text_crc32", "size"))
    found = sharding.read_shards(spark, path, sized.schema)
    grown = sharding.shard_of(F.col("doc_id"), (1.0,) * (sharding.SHARDS + 1))
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", grown.alias("grown_shard")
    )


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(prepare(spark), sf_dir, "conversations")
    return trie.prefix_trie(trie.grafted(trie.paths_of(turns)))


# What the low four bits of a CRC-32 register become, bit by bit.
CRC_STEP = """xor(c >> 4, xor(xor(498536548 * (xor(c, n) & 1), 997073096 * ((xor(c, n) >> 1) & 1)),
      xor(1994146192 * ((xor(c, n) >> 2) & 1), 3988292384 * ((xor(c, n) >> 3) & 1))))"""
OP13_SQL = rf"""
with t as (
  select conv_id, turn, md5(concat(strlen(r), ':', r, x)) as m, len(regexp_extract_all(x, '[^\x{{20}}\x{{09}}-\x{{0D}}]+')) as w
  from (select conv_id, turn, coalesce(role, '') as r, coalesce(text, '') as x from conversations where conv_id is not null)),
o as (select conv_id, list({{'m': m, 'w': w}} order by turn nulls first, m) as own from t group by 1),
h as (
  select *, xor(4294967295, list_reduce([4294967295::bigint] || list_transform(range(2 * strlen(conv_id::varchar)),
      lambda i: ((ascii(substr(conv_id::varchar, i // 2 + 1, 1)) >> (4 * (i % 2))) & 15)::bigint),
    lambda c, n: {CRC_STEP})) % 4 as h from o),
p as (
  select h.conv_id, list_concat(coalesce(b.own, [])[1 : h.h], h.own[h.h + 1 :]) as path
  from h left join o b on b.conv_id = h.conv_id - h.conv_id % 20),
m as (
  select conv_id, d, len(path) = d as ends, path[d].w as w,
    md5(array_to_string(list_transform(path[1:d], lambda e: e.m), ',')) as k
  from (select *, unnest(range(len(path) + 1)) as d from p)),
n as (
  select d, k, min(conv_id) as conv_id, count(*) as n, coalesce(max(w), 0) as w,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '')) as ends
  from m group by 1, 2),
u as (
  select n.*, up.k as up_k, up.conv_id as up_id
  from n left join m on m.conv_id = n.conv_id and m.d = n.d - 1 left join n up on up.d = n.d - 1 and up.k = m.k),
c as (select d - 1 as d, up_k as k, count(*) as kids from u where d > 0 group by 1, 2),
s as (
  select a.d, a.k, sum((u.n - 1) * case when u.d > 0 then u.w else 0 end) as saved, count(*) filter (c.kids is null) as leaves
  from u left join c on c.d = u.d and c.k = u.k join m a on a.conv_id = u.conv_id and a.d <= u.d group by 1, 2)
select u.conv_id, u.d as depth, up_id as parent_conv_id, n as n_convs, coalesce(kids, 0) as n_children,
  cast(leaves as bigint) as n_leaves, cast(saved as bigint) as saved_tokens, ends as ends_sha256
from u left join c using (d, k) join s using (d, k)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_simhash": op2_simhash,
    "op3_lines": op3_lines,
    "op4_substrings": op4_substrings,
    "op5_language": op5_language,
    "op6_topk": op6_topk,
    "op7_decontaminate": op7_decontaminate,
    "op8_urls": op8_urls,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_shards": op10_shards,
    "op11_alignment": op11_alignment,
    "op12_sharding": op12_sharding,
    "op13_trie": op13_trie,
}

ORACLES = {"op4_substrings": OP4_SQL, "op6_topk": OP6_SQL, "op7_decontaminate": OP7_SQL, "op13_trie": OP13_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
