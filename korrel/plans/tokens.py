"""Queries of vocabularies, encoding, chunking and padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from korrel.functions.stable import clean_for_tokenizer
from korrel.functions.text import sentences, word_count
from korrel.operators import chunks as c
from korrel.operators import vocabulary as v
from korrel.ordering import ordinal
from korrel.plans.corpus import SQL as CORPUS_SQL
from korrel.plans.corpus import sql_words
from korrel.session import read, spread

SIZE, VOCAB, EOS, PAD, BATCH = 128, 2000, 1, 2, 100


def joined(a: Column | str) -> Column:
    """md5 of an array's elements, so that results compare as text."""
    return F.md5(F.array_join(c.col(a).cast("array<string>"), ",").cast("binary"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "tokenized_examples").select("item_id", c.ids_or_empty("input_ids").alias("ids"))


def _encoded(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(read(spark, d, "documents").select("doc_id", "text"))
    return v.encode(docs, ["doc_id"], "text", v.build(docs, "text", VOCAB))


def word_vocab(spark: SparkSession, d: str) -> DataFrame:
    return v.build(read(spark, d, "documents"), "text", VOCAB)


def encode_vocab(spark: SparkSession, d: str) -> DataFrame:
    return _encoded(spark, d).select("doc_id", F.size("input_ids").alias("n"), joined("input_ids").alias("ids"))


def encode_truncate_pad(spark: SparkSession, d: str) -> DataFrame:
    cut = _encoded(spark, d).select("doc_id", F.slice("input_ids", 1, SIZE).alias("a"))
    return cut.select("doc_id", joined(c.pad("a", SIZE, v.PAD)).alias("ids"), joined(c.mask_of("a", F.size("a"), SIZE)).alias("mask"))


def encode_pad_longest(spark: SparkSession, d: str) -> DataFrame:
    """Truncated, then padded to the longest item of its batch (batches of BATCH items in the order of their ids)."""
    cut = ordinal(_items(spark, d), ["item_id"]).select("item_id", F.floor(F.col("pos") / BATCH).alias("batch"), F.slice("ids", 1, SIZE).alias("a"))
    longest = cut.groupBy("batch").agg(F.max(F.size("a")).alias("longest"))
    both = cut.join(longest, "batch")
    room = F.col("longest") - F.size("a")
    return both.select("item_id", joined(F.concat("a", F.array_repeat(F.lit(PAD), room))).alias("ids"), joined(F.concat(F.array_repeat(F.lit(1), F.size("a")), F.array_repeat(F.lit(0), room))).alias("mask"))


def encode_pad_max(spark: SparkSession, d: str) -> DataFrame:
    """Not truncated, padded to the longest of the batch."""
    items = ordinal(_items(spark, d), ["item_id"]).withColumn("batch", F.floor(F.col("pos") / BATCH))
    both = items.join(items.groupBy("batch").agg(F.max(F.size("ids")).alias("longest")), "batch")
    return both.select("item_id", joined(F.concat("ids", F.array_repeat(F.lit(PAD), F.col("longest") - F.size("ids")))).alias("ids"))


def clean_tokenizer(spark: SparkSession, d: str) -> DataFrame:
    """The tokenizer's cleaning of all texts."""
    docs = spread(read(spark, d, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.md5(clean_for_tokenizer("text").cast("binary")).alias("text_md5"))


def clean_then_encode(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned for the tokenizer, then encoded with the vocabulary of the cleaned texts."""
    docs = spread(read(spark, d, "documents").select("doc_id", "text")).select("doc_id", clean_for_tokenizer("text").alias("text"))
    out = v.encode(docs, ["doc_id"], "text", v.build(docs, "text", VOCAB))
    return out.select("doc_id", F.size("input_ids").alias("n"), joined("input_ids").alias("ids"))


def sentence_pack_dropped(spark: SparkSession, d: str) -> DataFrame:
    """Sentences that the greedy packing drops, because they are too long alone, per document."""
    s = read(spark, d, "documents").filter("text is not null").select("doc_id", sentences("text").alias("s"))
    return s.select("doc_id", F.size(F.filter("s", lambda x: word_count(x) > 64)).alias("dropped"))


def encode_eos(spark: SparkSession, d: str) -> DataFrame:
    cut = _items(spark, d).select("item_id", c.truncated_eos("ids", SIZE, EOS).alias("a"))
    return cut.select("item_id", joined(c.pad("a", SIZE, PAD)).alias("ids"), joined(c.mask_of("a", F.size("a"), SIZE)).alias("mask"))


def encode_append_eos(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).select("item_id", joined(F.concat("ids", F.array(F.lit(EOS)))).alias("ids"))


def special_tokens_mask(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).select("item_id", joined(F.transform("ids", lambda x: x.isin(0, 1, 2).cast("int"))).alias("mask"))


def chunk_pad(spark: SparkSession, d: str) -> DataFrame:
    return c.chunked(_items(spark, d), "ids", SIZE, ["item_id"]).select("item_id", "chunk_ix", joined(c.pad("chunk", SIZE, PAD)).alias("ids"), joined(c.mask_of("chunk", F.size("chunk"), SIZE)).alias("mask"))


def chunk_eos(spark: SparkSession, d: str) -> DataFrame:
    """As chunk_pad; the last chunk of an item is made to end in EOS."""
    n = c.chunked(_items(spark, d).withColumn("total", F.size("ids")), "ids", SIZE, ["item_id", "total"])
    last = F.col("chunk_ix") == F.floor((F.col("total") - 1) / SIZE)
    ended = n.select("item_id", "chunk_ix", F.when(last, c.truncated_eos("chunk", SIZE, EOS)).otherwise(F.col("chunk")).alias("chunk"))
    return ended.select("item_id", "chunk_ix", joined(c.pad("chunk", SIZE, PAD)).alias("ids"))


def chunk_labels(spark: SparkSession, d: str) -> DataFrame:
    padded = c.chunked(_items(spark, d), "ids", SIZE, ["item_id"]).withColumn("a", c.pad("chunk", SIZE, PAD))
    return padded.select("item_id", "chunk_ix", joined("a").alias("ids"), joined(F.col("a")).alias("labels"))


def chunk_min_length(spark: SparkSession, d: str) -> DataFrame:
    """Only items of at least 32 real tokens; padding does not count."""
    t = read(spark, d, "tokenized_examples")
    real = F.when(F.col("attention_mask").isNull(), F.size(F.filter("input_ids", lambda x: x != PAD))).otherwise(F.size(F.filter("attention_mask", lambda x: x == 1)))
    items = t.filter(real >= 32).select("item_id", c.ids_or_empty("input_ids").alias("ids"))
    return c.chunked(items, "ids", SIZE, ["item_id"]).groupBy("item_id").agg(F.count(F.lit(1)).alias("chunks"))


def num_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).select("item_id", F.ceil(F.size("ids") / SIZE).cast("int").alias("chunks"))


def concat_chunk(spark: SparkSession, d: str) -> DataFrame:
    return c.concat_and_cut(_items(spark, d), "item_id", "ids", SIZE, BATCH).select("batch", "chunk_ix", joined("chunk").alias("ids"))


def sentence_pack(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").filter("text is not null").select("doc_id", sentences("text").alias("s"))
    return c.sentence_packs(docs, "doc_id", "s", 64)


def hier_group(spark: SparkSession, d: str) -> DataFrame:
    return c.hierarchical(_items(spark, d), "item_id", "ids", [13, 198], SIZE, 0, PAD, 8)


def uniform_chunk(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).select("item_id", joined(F.flatten(c.uniform_chunks("ids", SIZE, 5, PAD, 1000))).alias("ids"))


def presplit_chunk(spark: SparkSession, d: str) -> DataFrame:
    """At most 4 given sentences, each cut and padded to the same size."""
    return _items(spark, d).select("item_id", joined(F.flatten(F.transform(F.slice(c.pieces("ids", 50), 1, 4), lambda p: c.pad(p, 64, PAD)))).alias("ids"))


def pair_overlay(spark: SparkSession, d: str) -> DataFrame:
    items = _items(spark, d).withColumn("first", c.pad(F.slice("ids", 1, 64), 256, PAD))
    return items.select("item_id", joined(c.overlay_pair("first", F.slice("ids", 65, 100), 64, PAD)).alias("ids"))


def pad_window(spark: SparkSession, d: str) -> DataFrame:
    """ids, mask and labels padded to a multiple of the attention window."""
    items = _items(spark, d)
    return items.select("item_id", joined(c.pad_to_multiple("ids", 64, PAD)).alias("ids"), joined(c.pad_to_multiple(F.array_repeat(F.lit(1), F.size("ids")), 64, 0)).alias("mask"), joined(c.pad_to_multiple("ids", 64, -100)).alias("labels"))


def pad_multiple_of_8(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).select("item_id", F.size(c.pad_to_multiple("ids", 8, PAD)).alias("n"))


def static_shape(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).select("item_id", joined(c.pad(F.slice("ids", 1, SIZE), SIZE, PAD)).alias("ids"))


def position_ids(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).select("item_id", joined(c.position_ids("ids", 64, PAD)).alias("ids"))


def sentence_heads(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).select("item_id", joined(c.first_of_each("ids", 64)).alias("ids"))


_I = "i as (select item_id, coalesce(input_ids, []) as ids from tokenized_examples)"
_MD = lambda a: f"md5(array_to_string({a}, ','))"
_REP = lambda value, n: f"list_transform(range(greatest({n}, 0)::bigint), lambda z: {value})"
_PAD = lambda a, size=SIZE, value=PAD: f"list_concat({a}, {_REP(value, f'{size} - len({a})')})"
_MASK = lambda n, size=SIZE: f"list_concat({_REP(1, f'least({n}, {size})')}, {_REP(0, f'{size} - {n}')})"
_CHUNKS = f"{_I}, c as (select item_id, ids, len(ids) as total, unnest(range(ceil(len(ids) / {SIZE}.0)::bigint)) as k from i), p as (select item_id, k::int as chunk_ix, total, ids[k * {SIZE} + 1 : k * {SIZE} + {SIZE}] as chunk from c)"
_EOS_CUT = lambda a: f"case when len({a}) > 0 and {a}[len({a})] = {EOS} then (case when len({a}) > {SIZE} then list_append({a}[1:{SIZE - 1}], {EOS}) else {a} end) when len({a}) + 1 > {SIZE} then list_append({a}[1:{SIZE - 1}], {EOS}) else list_append({a}, {EOS}) end"
_MULT = lambda a, w, value: f"list_concat({a}, {_REP(value, f'({w} - len({a}) % {w}) % {w}')})"
_VOCAB = f"""w as (select doc_id, text, {sql_words('text')} as ws from documents where text is not null), n as (select t as token, count(*) as count from (select unnest(ws) as t from w) group by 1),
    v as (select token, count, (row_number() over (order by count desc, token) + 4)::int as id from n order by count desc, token limit {VOCAB}),
    x as (select doc_id, unnest(ws) as token, unnest(range(len(ws))) as pos from w), e as (select doc_id, list(coalesce(v.id, 1) order by pos) as a from x left join v using (token) group by 1),
    a as (select d.doc_id, coalesce(e.a, []) as a from documents d left join e using (doc_id))"""
_ONES = _REP(1, "len(ids)")
_UNIFORM = f"list_transform(range(ceil(least(len(ids), 1000) / {SIZE - 1}.0)::bigint), lambda k: list_concat([case when len(list_filter(ids[k * {SIZE - 1} + 1 : least((k + 1) * {SIZE - 1}, 1000)], lambda x: x <> 0)) > 0 then 5 else {PAD} end], list_concat(ids[k * {SIZE - 1} + 1 : least((k + 1) * {SIZE - 1}, 1000)], list_transform(range(({SIZE - 1} - (least((k + 1) * {SIZE - 1}, least(len(ids), 1000)) - k * {SIZE - 1}))::bigint), lambda z: {PAD}))))"

QUERIES = {f.__name__: f for f in (word_vocab, encode_vocab, encode_truncate_pad, encode_pad_longest, encode_pad_max, clean_tokenizer, clean_then_encode, sentence_pack_dropped, encode_eos, encode_append_eos, special_tokens_mask, chunk_pad, chunk_eos, chunk_labels, chunk_min_length, num_chunks, concat_chunk, sentence_pack, hier_group, uniform_chunk, presplit_chunk, pair_overlay, pad_window, pad_multiple_of_8, static_shape, position_ids, sentence_heads)}
SQL = {
    "word_vocab": f"with {_VOCAB} select token, count, id from v",
    "encode_vocab": f"with {_VOCAB} select doc_id, len(a)::int as n, {_MD('a')} as ids from a",
    "encode_truncate_pad": f"with {_VOCAB}, s as (select doc_id, a[1:{SIZE}] as a from a) select doc_id, {_MD(_PAD('a', SIZE, 0))} as ids, {_MD(_MASK('len(a)'))} as mask from s",
    "encode_pad_longest": f"""with {_I}, o as (select item_id, ids[1:{SIZE}] as a, (row_number() over (order by item_id) - 1) // {BATCH} as batch from i), w as (select *, max(len(a)) over (partition by batch) as n from o)
        select item_id, {_MD(f'list_concat(a, list_transform(range(n - len(a)), lambda x: {PAD}))')} as ids, {_MD('list_concat(list_transform(a, lambda x: 1), list_transform(range(n - len(a)), lambda x: 0))')} as mask from w""",
    "encode_pad_max": f"""with {_I}, o as (select item_id, ids, (row_number() over (order by item_id) - 1) // {BATCH} as batch from i), w as (select *, max(len(ids)) over (partition by batch) as n from o)
        select item_id, {_MD(f'list_concat(ids, list_transform(range(n - len(ids)), lambda x: {PAD}))')} as ids from w""",
    "sentence_pack_dropped": CORPUS_SQL["sentences"].split("select doc_id, len(s)")[0] + f"select doc_id, len(list_filter(s, lambda x: len({sql_words('x')}) > 64))::int as dropped from s",
    "encode_eos": f"with {_I}, a as (select item_id, {_EOS_CUT('ids')} as a from i) select item_id, {_MD(_PAD('a'))} as ids, {_MD(_MASK('len(a)'))} as mask from a",
    "encode_append_eos": f"with {_I} select item_id, {_MD(f'list_append(ids, {EOS})')} as ids from i",
    "special_tokens_mask": f"with {_I} select item_id, {_MD('list_transform(ids, lambda x: (x in (0, 1, 2))::int)')} as mask from i",
    "chunk_pad": f"with {_CHUNKS} select item_id, chunk_ix, {_MD(_PAD('chunk'))} as ids, {_MD(_MASK('len(chunk)'))} as mask from p",
    "chunk_eos": f"with {_CHUNKS}, e as (select item_id, chunk_ix, case when chunk_ix = (total - 1) // {SIZE} then {_EOS_CUT('chunk')} else chunk end as chunk from p) select item_id, chunk_ix, {_MD(_PAD('chunk'))} as ids from e",
    "chunk_labels": f"with {_CHUNKS} select item_id, chunk_ix, {_MD(_PAD('chunk'))} as ids, {_MD(_PAD('chunk'))} as labels from p",
    "chunk_min_length": f"""select item_id, ceil(len(input_ids) / {SIZE}.0)::bigint as chunks from tokenized_examples where len(input_ids) > 0
        and case when attention_mask is null then len(list_filter(input_ids, lambda x: x <> {PAD})) else len(list_filter(attention_mask, lambda x: x = 1)) end >= 32""",
    "num_chunks": f"with {_I} select item_id, ceil(len(ids) / {SIZE}.0)::int as chunks from i",
    "concat_chunk": f"""with {_I}, o as (select item_id, ids, (row_number() over (order by item_id) - 1) // {BATCH} as batch from i), t as (select batch, item_id, unnest(ids) as x, unnest(range(len(ids))) as p from o),
        g as (select batch, x, row_number() over (partition by batch order by item_id, p) - 1 as g from t), k as (select batch::bigint as batch, (g // {SIZE})::bigint as chunk_ix, list(x order by g) as a from g group by 1, 2)
        select batch, chunk_ix, {_MD('a')} as ids from k where len(a) = {SIZE}""",
    "uniform_chunk": f"with {_I} select item_id, {_MD(f'flatten({_UNIFORM})')} as ids from i",
    "presplit_chunk": f"""with {_I} select item_id, {_MD(f"flatten(list_transform(range(least(ceil(len(ids) / 50.0), 4)::bigint), lambda k: list_concat(ids[k * 50 + 1 : (k + 1) * 50], list_transform(range((64 - (least((k + 1) * 50, len(ids)) - k * 50))::bigint), lambda z: {PAD}))))")} as ids from i""",
    "pad_window": f"with {_I} select item_id, {_MD(_MULT('ids', 64, PAD))} as ids, {_MD(_MULT(_ONES, 64, 0))} as mask, {_MD(_MULT('ids', 64, -100))} as labels from i",
    "pad_multiple_of_8": f"with {_I} select item_id, (ceil(len(ids) / 8.0) * 8)::int as n from i",
    "static_shape": f"with {_I}, a as (select item_id, ids[1:{SIZE}] as a from i) select item_id, {_MD(_PAD('a'))} as ids from a",
    "position_ids": f"with {_I} select item_id, {_MD(f'list_transform(ids, lambda x, i: case when x = {PAD} then 0 else {PAD + 1} + (i - 1) % 64 end)')} as ids from i",
    "sentence_heads": f"with {_I} select item_id, {_MD('list_filter(ids, lambda x, i: (i - 1) % 64 = 0)')} as ids from i",
}
