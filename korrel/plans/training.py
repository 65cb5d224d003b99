"""Queries of training labels and training metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from korrel.functions.text import SPACE, sentences
from korrel.operators import metrics as m
from korrel.operators.chunks import ids_or_empty
from korrel.ordering import ordinal, uniform
from korrel.plans.corpus import lit, sql_strip
from korrel.plans.tokens import joined
from korrel.session import broadcast_if_small, cut, read, spread

EOS, PAD = 1, 2


def _items(spark: SparkSession, d: str) -> DataFrame:
    return spread(read(spark, d, "tokenized_examples").select("item_id", ids_or_empty("input_ids").alias("ids")))


def _losses(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream of losses: rank by user, epoch by type, ordered by time and id."""
    e = read(spark, d, "events")
    return e.select("event_id", F.pmod("user_id", F.lit(8)).cast("int").alias("rank"), F.col("event_type").alias("epoch"), "ts", F.to_date("ts").alias("day"), F.col("value").alias("loss"))


def mlm_mask(spark: SparkSession, d: str) -> DataFrame:
    return m.mlm(_items(spark, d), "ids", "item_id", (0, 1, 2), 4, 50_000).select("item_id", joined("masked").alias("ids"), joined("labels").alias("labels"))


def mlm_mask_all(spark: SparkSession, d: str) -> DataFrame:
    return m.mlm(_items(spark, d), "ids", "item_id", (0, 1, 2), 4, 50_000, rate=0.25, mask_all=True).select("item_id", joined("masked").alias("ids"), joined("labels").alias("labels"))


def causal_labels(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).select("item_id", joined(F.transform("ids", lambda x: F.when(x == PAD, F.lit(-100)).otherwise(x))).alias("labels"))


def nsp_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each sentence with the next one (label 0), or for half of them with the first sentence of a drawn document of
    the same batch of 100 (label 1). The next sentence comes from the row's own array, so nothing is shuffled for it.
    Documents are numbered by their keys alone, and only the first sentences of the others are fetched."""
    docs = spread(read(spark, d, "documents").filter(F.col("text").rlike("[^\\x01" + SPACE[1:])).select("doc_id", "text"))
    placed = cut(ordinal(docs.select("doc_id"), ["doc_id"]).withColumns({"batch": F.floor(F.col("pos") / 100), "place": F.pmod("pos", F.lit(100))}))
    size = F.least(F.lit(100), F.lit(placed.count()) - F.col("batch") * 100)
    cutup = docs.join(broadcast_if_small(placed, 500_000), "doc_id").select("doc_id", "batch", "place", size.alias("size"), sentences("text").alias("s"))
    pairs = cutup.select("doc_id", "batch", "size", F.posexplode(F.arrays_zip(F.slice("s", F.lit(1), F.size("s") - 1).alias("a"), F.slice("s", F.lit(2), F.size("s") - 1).alias("b"))).alias("k", "p"))
    drawn = pairs.select("doc_id", "batch", "k", (uniform("nsp", "doc_id", "k") < 0.5).alias("true_next"), F.floor(uniform("pick", "doc_id", "k") * F.col("size")).alias("place"), "p")
    # Only what the other sentence has to be joined to is carried along.
    told = drawn.select("doc_id", "batch", "place", "k", "true_next", F.when(~F.col("true_next"), F.col("p.a")).alias("a"), F.when(F.col("true_next"), _pair(F.col("p.a"), F.col("p.b"))).alias("pair"))
    firsts = cutup.select("batch", "place", F.element_at("s", 1).alias("other"))
    out = told.join(firsts, ["batch", "place"], "left")
    return out.select("doc_id", "k", F.coalesce("pair", _pair(F.col("a"), F.col("other"))).alias("pair"), (~F.col("true_next")).cast("int").alias("label"))


def _pair(a: Column, b: Column) -> Column:
    return F.md5(F.concat(a, F.lit("|"), b).cast("binary"))


def loss_cumulative(spark: SparkSession, d: str) -> DataFrame:
    r = m.running(_losses(spark, d), ["epoch", "rank"], "day", ["ts", "event_id"], "loss")
    return r.select("event_id", "epoch", "rank", F.col("n").alias("step"), F.round(F.col("total") / F.col("n") + 1e-9, 5).alias("mean_loss"))


def loss_tumbling(spark: SparkSession, d: str) -> DataFrame:
    r = m.running(_losses(spark, d), ["epoch", "rank"], "day", ["ts", "event_id"], "loss")
    return r.groupBy("epoch", "rank", F.floor((F.col("n") - 1) / 10).cast("bigint").alias("block")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("loss") + 1e-9, 5).alias("mean_loss"))


def eval_mean_of_means(spark: SparkSession, d: str) -> DataFrame:
    per = _losses(spark, d).groupBy("epoch", "rank").agg(F.avg("loss").alias("mean"))
    return per.groupBy("epoch").agg(F.round(F.avg("mean") + 1e-9, 5).alias("mean_loss"))


def eval_weighted(spark: SparkSession, d: str) -> DataFrame:
    per = _losses(spark, d).groupBy("epoch", "rank").agg(F.avg("loss").alias("mean"), F.count(F.lit(1)).alias("n"))
    return per.groupBy("epoch").agg(F.round(F.sum(F.col("mean") * F.col("n")) / F.sum("n") + 1e-9, 5).alias("mean_loss"))


def perplexity(spark: SparkSession, d: str) -> DataFrame:
    per = _losses(spark, d).groupBy("epoch").agg(F.avg(F.col("loss") / 100).alias("mean"))
    return per.select("epoch", F.round(m.perplexity(F.col("mean")), 6).alias("perplexity"), F.round(m.perplexity(F.col("mean") * 100), 6).alias("clamped"))


def nan_clean(spark: SparkSession, d: str) -> DataFrame:
    loss = F.when(F.pmod("event_id", F.lit(11)) == 0, F.lit(float("nan"))).when(F.pmod("event_id", F.lit(13)) == 0, F.lit(float("inf"))).otherwise(F.col("loss"))
    return _losses(spark, d).select("rank", m.clean_loss(loss).alias("loss")).groupBy("rank").agg(F.round(F.sum("loss"), 4).alias("total"))


def lr_linear(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1000).select("id", F.round(m.linear_rate(F.col("id"), 1e-3, 80, 1000), 10).alias("lr"))


def lr_cosine(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1000).select("id", F.round(m.cosine_rate(F.col("id"), 1e-3, 80, 1000), 10).alias("lr"))


def align_steps(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(200).select("id", m.aligned(F.col("id"), 8).cast("bigint").alias("aligned"))


def embedding_variance(spark: SparkSession, d: str) -> DataFrame:
    """The regularisers of all vectors of 64 numbers, with the number of rows that have none."""
    vectors = read(spark, d, "embeddings")
    others = vectors.filter(F.col("embedding").isNull() | (F.size("embedding") != 64)).count()
    variance, covariance = m.vicreg(vectors, "embedding", 64)
    return spark.createDataFrame([(round(variance, 6), round(covariance, 6), others)], "variance double, covariance double, others bigint")


def embedding_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Cosine similarity of each vector with the one of the next number."""
    e = read(spark, d, "embeddings").select("vec_id", "embedding")
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next")), "vec_id").select("vec_id", F.round(m.cosine("embedding", "next") + 1e-9, 5).alias("similarity"))


def contrastive_loss(spark: SparkSession, d: str) -> DataFrame:
    """In-batch contrast of vectors with those of the next number, in batches of 32."""
    e = read(spark, d, "embeddings").select("vec_id", "embedding")
    both = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next")), "vec_id")
    placed = ordinal(both.select("vec_id"), ["vec_id"]).select("vec_id", F.floor(F.col("pos") / 32).alias("batch"))
    return m.contrastive(both.join(placed, "vec_id"), "batch", "vec_id", "embedding", "next").select("batch", "n", F.round("loss", 5).alias("loss"))


def eos_stats(spark: SparkSession, d: str) -> DataFrame:
    """Where EOS stands; the content's end is told by the mask, so an EOS that also pads isn't taken for padding."""
    t = read(spark, d, "tokenized_examples").select("source", ids_or_empty("input_ids").alias("ids"), F.col("attention_mask").alias("mask"))
    n = F.when(F.col("mask").isNull(), F.size(F.filter("ids", lambda x: x != PAD))).otherwise(F.size(F.filter("mask", lambda x: x == 1)))
    flags = t.select("source", F.array_contains("ids", EOS).alias("has"), F.coalesce(F.get(F.col("ids"), n - 1) == EOS, F.lit(False)).alias("at_end"))
    total = lambda c: F.sum(c.cast("bigint"))
    return flags.groupBy("source").agg(F.count(F.lit(1)).alias("n"), total(F.col("has")).alias("with_eos"), total(~F.col("has")).alias("without_eos"), total(F.col("at_end")).alias("at_end"))


_L = "l as (select event_id, (user_id % 8)::int as rank, event_type as epoch, ts, value as loss from events)"
_I = "i as (select item_id, coalesce(input_ids, []) as ids from tokenized_examples)"
_U = lambda seed, parts: f"(('0x' || substr(md5('{seed}:' || {parts}), 1, 8))::bigint / 4294967296.0::double)"
_MD = lambda a: f"md5(array_to_string({a}, ','))"
_PLACE = "item_id || ':' || (i - 1)"
_CHOSEN = lambda rate: f"(x not in (0, 1, 2) and {_U('mlms', _PLACE)} < {rate})"
_S = f"list_filter(list_transform(string_split(regexp_replace(text, {lit(f'([.!?]){SPACE}+')}, '\\1' || chr(1), 'g'), chr(1)), lambda s: {sql_strip('s')}), lambda s: s <> '')"

QUERIES = {f.__name__: f for f in (mlm_mask, mlm_mask_all, causal_labels, nsp_pairs, loss_cumulative, loss_tumbling, eval_mean_of_means, eval_weighted, perplexity, nan_clean, lr_linear, lr_cosine, align_steps, embedding_variance, embedding_cosine, contrastive_loss, eos_stats)}
SQL = {
    "embedding_cosine": "select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]) + 1e-9, 5) as similarity from embeddings a join embeddings b on b.vec_id = a.vec_id + 1",
    "mlm_mask": f"""with {_I} select item_id, {_MD(f"list_transform(ids, lambda x, i: case when not {_CHOSEN(0.15)} then x when {_U('mlmh', _PLACE)} < 0.8 then 4 when {_U('mlmh', _PLACE)} < 0.9 then floor({_U('mlmr', _PLACE)} * 50000)::int else x end)")} as ids,
        {_MD(f"list_transform(ids, lambda x, i: case when {_CHOSEN(0.15)} then x else -100 end)")} as labels from i""",
    "mlm_mask_all": f"""with {_I} select item_id, {_MD(f"list_transform(ids, lambda x, i: case when {_CHOSEN(0.25)} then 4 else x end)")} as ids, {_MD(f"list_transform(ids, lambda x, i: case when {_CHOSEN(0.25)} then x else -100 end)")} as labels from i""",
    "causal_labels": f"with {_I} select item_id, {_MD(f'list_transform(ids, lambda x: case when x = {PAD} then -100 else x end)')} as labels from i",
    "nsp_pairs": f"""with d as (select doc_id, {_S} as s from documents where text is not null), p as (select doc_id, s, row_number() over (order by doc_id) - 1 as pos, count(*) over () as n from d where len(s) > 0),
        b as (select doc_id, s, pos // 100 as batch, pos % 100 as place, least(100, n - pos // 100 * 100) as size from p),
        x as (select doc_id, batch, size, s, unnest(range(len(s) - 1)) as k from b where len(s) > 1),
        w as (select doc_id, batch, k, s[k + 1] as a, s[k + 2] as b, {_U('nsp', "doc_id || ':' || k")} < 0.5 as t, floor({_U('pick', "doc_id || ':' || k")} * size)::bigint as place from x)
        select w.doc_id, k::int as k, md5(a || '|' || case when t then w.b else b.s[1] end) as pair, (not t)::int as label from w left join b on w.batch = b.batch and w.place = b.place""",
    "loss_cumulative": f"with {_L} select event_id, epoch, rank, row_number() over w as step, round(avg(loss) over (w rows between unbounded preceding and current row) + 1e-9, 5) as mean_loss from l window w as (partition by epoch, rank order by ts, event_id)",
    "loss_tumbling": f"with {_L}, n as (select *, row_number() over (partition by epoch, rank order by ts, event_id) as k from l) select epoch, rank, ((k - 1) // 10)::bigint as block, count(*) as n, round(avg(loss) + 1e-9, 5) as mean_loss from n group by 1, 2, 3",
    "eval_mean_of_means": f"with {_L} select epoch, round(avg(mean) + 1e-9, 5) as mean_loss from (select epoch, rank, avg(loss) as mean from l group by 1, 2) group by 1",
    "eval_weighted": f"with {_L} select epoch, round(sum(loss) / count(*) + 1e-9, 5) as mean_loss from l group by 1",
    "perplexity": f"with {_L}, p as (select epoch, avg(loss / 100) as mean from l group by 1) select epoch, round(exp(least(mean, 10)), 6) as perplexity, round(exp(least(mean * 100, 10)), 6) as clamped from p",
    "nan_clean": f"with {_L} select rank, round(sum(case when event_id % 11 = 0 or event_id % 13 = 0 then 0 else loss end), 4) as total from l group by 1",
    "lr_linear": "select i as id, round(case when i < 80 then i / 80.0::double * 0.001 else greatest(0, (1000 - i) / 920.0::double) * 0.001 end, 10) as lr from range(1000) t(i)",
    "lr_cosine": f"select i as id, round(case when i < 80 then i / 80.0::double * 0.001 else greatest(0, 0.5 * (1 + cos({math.pi!r} * ((i - 80) / 920.0::double)))) * 0.001 end, 10) as lr from range(1000) t(i)",
    "align_steps": "select i as id, greatest(ceil(i / 8.0) * 8, 8)::bigint as aligned from range(200) t(i)",
    "embedding_variance": """with e as (select vec_id, unnest(embedding)::double as x, unnest(range(64)) as k from embeddings),
        v as (select avg(greatest(0, 1 - sqrt(s + 0.0001))) as variance from (select var_samp(x) as s from e group by k)),
        c as (select a.k as i, b.k as j, covar_samp(a.x, b.x) as c from e a join e b using (vec_id) group by 1, 2)
        select round(variance, 6) as variance, round((select sum(c * c) from c where i <> j) / 64, 6) as covariance, (select count(*) from embeddings where embedding is null or len(embedding) <> 64) as others from v""",
    "eos_stats": f"""with t as (select source, coalesce(input_ids, []) as ids, case when attention_mask is null then len(list_filter(coalesce(input_ids, []), lambda x: x <> {PAD})) else len(list_filter(attention_mask, lambda x: x = 1)) end as n from tokenized_examples)
        select source, count(*) as n, sum(list_contains(ids, {EOS})::int)::bigint as with_eos, sum((not list_contains(ids, {EOS}))::int)::bigint as without_eos, sum(coalesce(ids[case when n = 0 then 100000000 else n end] = {EOS}, false)::int)::bigint as at_end from t group by 1""",
}
