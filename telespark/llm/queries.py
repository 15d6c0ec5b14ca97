"""One query for each operator, over the whole table it is meant for."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telespark.llm import collisions, divergence, html_text, language_id, mixing, near_dedup, nearest, order_minhash, preference, shared, substring_dedup, token_files, whitening, word_bpe

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    shared.ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_token_files")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.fresh_path(spark, "token-files")
    token_files.write_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_files.digests(spark, path)


@query("op2_bpe_round_trip")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op3_substring_dedup", """
with d as (select row_number() over () as r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\t-\\r ]+'), lambda x: x <> '') as w from documents),
g as (select r, doc_id, i, array_to_string(w[i:i + 12], ' ') as g from d, unnest(range(1, len(w) - 11)) as t(i) where len(w) >= 13),
m as (select g, min(doc_id) as least from g group by g),
x as (select distinct r, i + k as p from g join m using (g), unnest(range(0, 13)) as u(k) where least < doc_id),
y as (select r, list(p) as gone from x group by r),
z as (select doc_id, w, list_transform(list_filter(range(1, len(w) + 1), lambda i: not list_contains(coalesce(gone, []), i)), lambda i: w[i]) as kept from d left join y using (r))
select doc_id, len(w) as n_words, len(w) - len(kept) as n_removed, sha256(array_to_string(kept, ' ')) as kept_sha256 from z""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("row.doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))


@query("op5_order_minhash")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.compare_edits(table(spark, sf_dir, "documents"))


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = language_id.held_out(F.col("doc_id"))
    model = language_id.fit(docs.where(~held).select("doc_id", "text", "lang"))
    return language_id.predict(docs.select("doc_id", "text", held.alias("held_out")), model).select("doc_id", "held_out", "language.lang_pred", "language.score")


@query("op8_near_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.classes(table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "class_id")


@query("op7_source_mixing", """
with recursive d as (select doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\\t-\\r ]+'), lambda x: x <> '')) as words from documents),
s as (select source, sum(words)::bigint as words from d group by source),
n as (select sum(words)::double as total, count(*) filter (words > 0) as n from s),
p as (select source, words, words / total as p from s, n where words > 0),
bisect as (
  select 0 as i, 0.0::double as low, 1.0::double as high
  union all
  select i + 1, case when h >= 0.95 * ln(n.n) then m else low end, case when h >= 0.95 * ln(n.n) then high else m end
  from (select i, low, high, (low + high) / 2 as m, (select ln(sum(p ** ((low + high) / 2))) - (low + high) / 2 * sum(p ** ((low + high) / 2) * ln(p)) / sum(p ** ((low + high) / 2)) from p) as h from bisect where i < 40), n),
a as (select round(max(low), 6) as a from bisect),
w as (select source, words, words / total * 1.0 as share, p ** a as weight from p, a, n),
t as (select source, words as of_words, weight / (select sum(weight) from w) * (select total from n) as target from w),
k as (select *, ceil(round(target / of_words, 6))::int as epochs from t),
deal as (select doc_id, d.source, d.words, ('0x' || substr(md5(concat_ws('|', coalesce(d.source, ''), doc_id)), 1, 15))::bigint % greatest(ceil(s.words / 8192)::bigint, 1) as block from d join s on s.source is not distinct from d.source),
b as (select source, block, sum(words)::bigint as words from deal group by all),
e as (select b.*, of_words, target, unnest(range(0, epochs)) as epoch from b join k on b.source is not distinct from k.source),
o as (select *, ('0x' || substr(md5(concat_ws('|', coalesce(source, ''), block, epoch)), 1, 15))::bigint as ord from e),
c as (select *, epoch * of_words + sum(words) over (partition by source, epoch order by ord, block) - words as start from o),
x as (select source, block, epoch, start / target as position from c where start + words / 2 <= round(target, 3) or epoch + 1 <= target / of_words + 1e-9)
select doc_id, deal.source, words, deal.block, epoch::int as epoch, round(position, 6) as position
from deal join x on x.source is not distinct from deal.source and x.block = deal.block""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), entropy=0.95, repetition=4.0, budget=1.0)
    return mixed.select("row.doc_id", "source", "words", "block", "epoch", F.round("position", 6).alias("position"))


@query("op6_nearest_vectors")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0, k=20)


@query("op4_html_text")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = html_text.extract(pages, html_text.fit(pages.select("page_id", "html")))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


@query("op10_preference_pairs", """
with t as (select distinct conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
w as (select conv_id, list({'role': role, 'text': text} order by turn nulls first, role, text) as turns from t group by conv_id),
c as (select conv_id as pair_id, turns[1:len(turns) - list_position(list_transform(list_reverse(turns), lambda t: t.role), 'assistant') + 1] as chosen from w where list_contains(list_transform(turns, lambda t: t.role), 'assistant')),
n as (select pair_id, chosen, coalesce(lead(chosen) over (order by pair_id), first_value(chosen) over (order by pair_id)) as other from c),
p as (select pair_id, chosen, list_concat(chosen[1:len(chosen) - 1], other[len(other):len(other)]) as rejected from n),
k as (select *, coalesce(list_min(list_filter(range(1, len(chosen) + 1), lambda i: chosen[i] <> rejected[i])) - 1, len(chosen)) as n from p),
r as (select pair_id, n::int as prompt_turns, chosen[1:n] as prompt, chosen[n + 1:len(chosen)] as chosen, rejected[n + 1:len(rejected)] as rejected from k),
s as (select *, list_transform(chosen, lambda t: length('<|' || t.role || '|>\n' || t.text || '<|end|>\n')) as a, list_transform(rejected, lambda t: length('<|' || t.role || '|>\n' || t.text || '<|end|>\n')) as b from r)
select pair_id, prompt_turns,
  array_to_string(list_transform(prompt, lambda t: '<|' || t.role || '|>\n' || t.text || '<|end|>\n'), '') as prompt,
  array_to_string(list_transform(chosen, lambda t: '<|' || t.role || '|>\n' || t.text || '<|end|>\n'), '') as chosen,
  array_to_string(list_transform(list_filter(range(1, len(chosen) + 1), lambda i: chosen[i].role = 'assistant'), lambda i: (coalesce(list_sum(a[1:i - 1]), 0) + length(chosen[i].role) + 5)::bigint::varchar || '-' || list_sum(a[1:i])::bigint::varchar), ',') as chosen_spans,
  array_to_string(list_transform(rejected, lambda t: '<|' || t.role || '|>\n' || t.text || '<|end|>\n'), '') as rejected,
  array_to_string(list_transform(list_filter(range(1, len(rejected) + 1), lambda i: rejected[i].role = 'assistant'), lambda i: (coalesce(list_sum(b[1:i - 1]), 0) + length(rejected[i].role) + 5)::bigint::varchar || '-' || list_sum(b[1:i])::bigint::varchar), ',') as rejected_spans
from s""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.format_pairs(preference.swapped_answers(table(spark, sf_dir, "conversations")))


@query("op11_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    model = whitening.fit(vectors, components=32)
    rows = whitening.whiten(vectors, model)
    n, explained, error = (model.n, model.explained, model.identity_error) if model else (0, [], 0.0)
    each = rows.select("vec_id", F.expr("try_cast(deviation as bigint)").alias("deviation"), F.posexplode("whitened").alias("i", "whitened"))
    share = F.get(F.array(*map(F.lit, explained)).cast("array<double>"), F.col("i"))
    return each.select("vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))


@query("op12_source_divergence", r"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
t as (select r, lang, source, unnest(w) as term from d),
l as (select lang, term, count(*) as total from t group by all having count(distinct r) >= 10),
v as (select lang, count(*) as v, sum(total) as n from l group by lang),
c as (select lang, source, term, count(*) as n from t semi join l using (lang, term) group by all),
s as (select lang, source, sum(n) as n from c group by all),
g as (select x.lang, x.source, coalesce(v.v, 0) as v, coalesce(s.n, 0) as n from (select distinct lang, source from d) x left join v using (lang) left join s using (lang, source)),
a as (select g.lang, g.source, l.term, coalesce(c.n, 0) as count, (1 + 1000000000::hugeint * (coalesce(c.n, 0) + 2) // (g.n + 2 * g.v))::bigint as p,
  (1 + 1000000000::hugeint * (l.total + 2) // (v.n + 2 * v.v))::bigint as q from g join l using (lang) join v using (lang) left join c using (lang, source, term)),
f as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value from a join a b using (lang, term) where a.source <> b.source group by all),
p as (select g.lang, g.source, 'pair' as part, h.source as item, coalesce(f.value, 0)::bigint as value from g join g h on g.lang = h.lang and g.source <> h.source left join f on f.lang = g.lang and f.source = g.source and f.item = h.source),
e as (select lang, source, 'term' as part, term as item, ((p - q) * (p - q) // (p + q))::bigint as value from a where count > 0 and p > q),
u as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (from p union all from e))
select lang, source, part, item, value, rank::int as rank from u where part = 'pair' or rank <= 10""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


@query("op13_vector_links")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collisions.link(table(spark, sf_dir, "embeddings"))
