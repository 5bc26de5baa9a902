"""One query per operator over its whole table, and their SQL where SQL can say it.

The given tables are mapped to the records the operators work on (documents are feedback texts, pages' links are literature
links, embeddings are image embeddings) and the results are mapped back; all logic is in the operators.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.llm import ann, bytebpe, html, lines, packing, passages, prefixes, quality, resampling, simhash, tokens, topk, urls

#: (verdict, host, path) of the link rules.
LINK_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
ASKED = "id % 50 = 0"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def feedback(documents: DataFrame) -> DataFrame:
    return documents.withColumnsRenamed({"doc_id": "session_id", "text": "free_text_feedback"})


def documents_of(result: DataFrame) -> DataFrame:
    return result.withColumnRenamed("session_id", "doc_id")


def held_out(key: Column) -> Column:
    """Rows whose labels are not learnt from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learnt_labels(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels").withColumnRenamed("doc_id", "session_id")
    return labels.filter(~held_out(F.col("session_id")))


def op1_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract_main_text(table(spark, folder, "pages"))


def op2_pack_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return documents_of(packing.pack_feedback(feedback(table(spark, folder, "documents")), public_tokenizers.path("word_bpe_49k.json")))


def op3_similar_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return ann.similar_images(table(spark, folder, "embeddings"), key="vec_id", queries=ASKED)


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return documents_of(tokens.feedback_token_counts(feedback(table(spark, folder, "documents")), public_tokenizers.path("piece_bpe_32k.model")))


def op5_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    links = table(spark, folder, "pages").withColumnRenamed("url", "link_or_doi")
    return urls.judge_links(links, LINK_RULES, key="page_id")


def op6_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return documents_of(bytebpe.encoded_digests(feedback(table(spark, folder, "documents")), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


def op7_quality_score(spark: SparkSession, folder: str) -> DataFrame:
    texts = feedback(table(spark, folder, "documents"))
    scored = quality.score_quality(texts, quality.train_quality(texts, learnt_labels(spark, folder)))
    return scored.select(F.col("session_id").alias("doc_id"), held_out(F.col("session_id")).alias("held_out"), "score", "predicted")


def op8_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return documents_of(simhash.near_duplicate_groups(feedback(table(spark, folder, "documents"))))


def op9_top_products(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_images(table(spark, folder, "embeddings"), key="vec_id", queries=ASKED)


def op10_repeated_lines(spark: SparkSession, folder: str) -> DataFrame:
    texts = feedback(table(spark, folder, "documents")).select("session_id", "free_text_feedback")
    kept = lines.drop_repeated_lines(texts)
    return documents_of(kept.select("session_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")))


def op11_importance_draw(spark: SparkSession, folder: str) -> DataFrame:
    texts = feedback(table(spark, folder, "documents"))
    return documents_of(resampling.resample_feedback(texts, table(spark, folder, "benchmark"), target_text="text"))


def op12_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    kept = passages.drop_repeated_passages(feedback(table(spark, folder, "documents")))
    return documents_of(kept.select("session_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")))


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    return prefixes.prefix_trie(table(spark, folder, "conversations"), F.expr("conv_id - conv_id % 20"), heads)


QUERIES = {f.__name__: f for f in (
    op1_main_text, op2_pack_sequences, op3_similar_vectors, op4_token_counts, op5_url_rules,
    op6_byte_bpe, op7_quality_score, op8_near_duplicates, op9_top_products, op10_repeated_lines,
    op11_importance_draw, op12_repeated_passages, op13_prefix_trie)}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BLOCKED = "|".join(g.strip("*") for g in urls.DEFAULT_BLOCKED)

#: CRC-32 of a list of bytes: the table of its 256 byte remainders, then one table step per byte.
_CRC = """
crcs as (select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) as t)"""
_CRC_OF = "xor(list_reduce({0}, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295)"

ORACLES = {
    "op5_url_rules": f"""
with rest as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as r from pages),
cut as (select page_id, regexp_extract(r, '^[^?#]*') as hp from rest),
parts as (select page_id, translate(regexp_extract(hp, '^[^/]*'), '{_UPPER}', '{_UPPER.lower()}') as host,
  case when strpos(hp, '/') > 0 then substr(hp, strpos(hp, '/')) else '' end as path from cut),
rules(verdict, host, path) as (values {", ".join(str(r) for r in LINK_RULES)}),
best as (select p.page_id, p.host, p.path, arg_max(r.host || r.path, length(r.host || r.path)) as rule, arg_max(r.verdict, length(r.host || r.path)) as v
  from parts p join rules r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path) group by all)
select p.page_id, p.host, p.path, b.rule, coalesce(b.v, case when regexp_matches(p.host || p.path, '{_BLOCKED}') then 'block' else 'allow' end) as verdict
from parts p left join best b on b.page_id = p.page_id""",
    "op9_top_products": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings where embedding is not null),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id)
select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5""",
    "op10_repeated_lines": rf"""
with l as (select doc_id, generate_subscripts(x, 1) as i, unnest(x) as line from (select doc_id, string_split(coalesce(text, ''), chr(10)) as x from documents)),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_UPPER.lower()}') as key from l),
r as (select key from k where key <> '' group by key having count(distinct doc_id) >= 10),
m as (select k.*, r.key is not null as gone from k left join r on r.key = k.key)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from m group by doc_id""",
    "op11_importance_draw": rf"""
with {_CRC.strip()},
texts as (select 's' as side, doc_id as id, text from documents union all select 't', item_id, text from benchmark),
w as (select side, id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from texts),
f as (select side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
  list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) as f from w),
n as (select side, id, f, count(*) as n from f group by all),
h as (select f, hex(encode(f)) as h from (select distinct f from n)),
b as (select f, list_transform(range(len(h) // 2), lambda i: instr('0123456789ABCDEF', h[2 * i + 1]) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 17) as x from h),
k as (select f, {_CRC_OF.format("x")} % 10000 as k from b, crcs),
c as (select id, side, k, sum(n)::bigint as n from n join k using (f) group by all),
t as (select range as k, coalesce(sum(n) filter (side = 's'), 0)::double as s, coalesce(sum(n) filter (side = 't'), 0)::double as t from range(10000) left join c on k = range group by range),
g as (select k, floor(1000 * ln((t + 1) * (sum(s) over () + 10000) / ((s + 1) * (sum(t) over () + 10000))))::bigint as gain from t),
d as (select doc_id, len(w.w) as n_words, coalesce(x.n, 0)::bigint as n_features, coalesce(x.weight, 0)::bigint as weight,
  (instr('0123456789abcdef', h[1]) - 1) * 268435456 + (instr('0123456789abcdef', h[2]) - 1) * 16777216 + (instr('0123456789abcdef', h[3]) - 1) * 1048576 + (instr('0123456789abcdef', h[4]) - 1) * 65536
  + (instr('0123456789abcdef', h[5]) - 1) * 4096 + (instr('0123456789abcdef', h[6]) - 1) * 256 + (instr('0123456789abcdef', h[7]) - 1) * 16 + instr('0123456789abcdef', h[8]) - 1 as h
  from (select doc_id, sha256('42:' || doc_id) as h from documents) join w on w.side = 's' and w.id = doc_id
  left join (select id, sum(n) as n, sum(n * gain) as weight from c join g using (k) where side = 's' group by id) x on x.id = doc_id),
e as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint as score from d),
r as (select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id) as r, count(*) over (partition by n_words >= 20) as all_n from e)
select doc_id, n_features, weight, score, case when n_words >= 20 and r <= 5 * all_n // 100 then r end as rank from r""",
    "op12_repeated_passages": r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, w, unnest(range(1, len(w) - 18)) as i from d),
v as (select doc_id, i, array_to_string(w[i:i + 19], ' ') as v from s),
f as (select v, min({'d': doc_id, 'i': i}) as f from v group by v having count(*) > 1),
g as (select distinct doc_id, i + unnest(range(20)) as i from v join f using (v) where {'d': v.doc_id, 'i': v.i} <> f.f),
l as (select doc_id, list(i) as g from g group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(len(g), 0)::bigint as n_removed,
  sha256(array_to_string(case when g is null then w else list_filter(w, lambda x, i: not list_contains(g, i)) end, ' ')) as kept_sha256
from d left join l on l.doc_id = d.doc_id""",
    "op13_prefix_trie": rf"""
with {_CRC.strip()},
s as (select conv_id, turn, coalesce(role, '') as r, coalesce(text, '') as t from conversations where conv_id is not null),
l as (select conv_id, list({{'r': r, 't': t}} order by turn nulls first, sha256(length(r) || ':' || r || t)) as m from s group by conv_id),
b as (select conv_id, hex(encode(conv_id::varchar)) as x, m from l),
h as (select conv_id, m, {_CRC_OF.format("list_transform(range(len(x) // 2), lambda i: instr('0123456789ABCDEF', x[2 * i + 1]) * 16 + instr('0123456789ABCDEF', x[2 * i + 2]) - 17)")} % 4 as h from b, crcs),
c as (select h.conv_id, list_concat(coalesce(d.m[1:h.h], []), h.m[h.h + 1:]) as m from h left join l d on d.conv_id = h.conv_id - h.conv_id % 20),
p as (select conv_id, m[1:d] as k, d, d = len(m) as ends from (select *, unnest(range(len(m) + 1)) as d from c)),
n as (select k, d as depth, min(conv_id) as conv_id, count(*) as n_convs, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '')) as ends_sha256 from p group by k, d),
u as (select k[1:depth - 1] as k, count(*) as n_children from n where depth > 0 group by all),
w as (select n.*, coalesce(n_children, 0) as n_children, case when depth = 0 then 0 else (n_convs - 1) * len(regexp_extract_all(n.k[depth].t, '[^ 	-]+')) end as saved from n left join u on u.k = n.k),
a as (select k[1:j] as k, count(*) filter (n_children = 0) as n_leaves, sum(saved) as saved_tokens from (select *, unnest(range(depth + 1)) as j from w) group by all)
select w.conv_id, w.depth, q.conv_id as parent_conv_id, w.n_convs, w.n_children, a.n_leaves, a.saved_tokens::bigint as saved_tokens, w.ends_sha256
from w join a on a.k = w.k left join n q on w.depth > 0 and q.k = w.k[1:w.depth - 1]""",
}
