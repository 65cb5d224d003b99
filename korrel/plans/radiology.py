"""Queries of the report labeller."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korrel.functions import text as t
from korrel.operators import reports as r
from korrel.plans.corpus import lit, sql_chain, sql_collapse
from korrel.session import broadcast_if_small, read, spread

TERMS = ("stenose", "stenosen", "vernauwing")
NEGATIVE = ("geen", "zonder", "geen significante", "geen aanwijzingen voor significante")
POSITIVE = ("wel", "bekende", "significante", "tekenen van")
IGNORE = ("hartfalen", "calciumscore")
EXCLUDED = ("graft", "stent", "dotter")
STOP = ("de", "het", "een", "van", "in")
NOISE = ("ostiale", "ruim", "diffuse", "tijdens", "significante")


def _load(spark: SparkSession, d: str) -> DataFrame:
    return spread(r.load(read(spark, d, "radiology_reports")))


def _md5(c: F.Column) -> F.Column:
    return F.md5(c.cast("binary"))


def report_load(spark: SparkSession, d: str) -> DataFrame:
    return _load(spark, d).groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("studies"))


def report_exclude(spark: SparkSession, d: str) -> DataFrame:
    return r.exclude(_load(spark, d), EXCLUDED).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


def report_replace(spark: SparkSession, d: str) -> DataFrame:
    reports = spread(read(spark, d, "radiology_reports").filter("content_attachment1_plain_data is not null").select("report_id", "content_attachment1_plain_data"))
    return reports.select("report_id", _md5(F.lower(t.replace_chain("content_attachment1_plain_data"))).alias("md5"))


def stopwords(spark: SparkSession, d: str) -> DataFrame:
    reports = read(spark, d, "radiology_reports").filter("content_attachment1_plain_data is not null")
    return reports.select("report_id", _md5(t.drop_stopwords("content_attachment1_plain_data", STOP)).alias("md5"))


def misspelling_map(spark: SparkSession, d: str) -> DataFrame:
    rows, text = read(spark, d, "misspellings"), "content_attachment1_plain_data"
    reports, table = read(spark, d, "radiology_reports").filter(f"{text} is not null"), r.dictionary(rows)
    fixed = reports.select("report_id", r.correct(F.col(text), table).alias(text)) if table is not None else r.correct_joined(reports, "report_id", text, rows)
    return fixed.select("report_id", _md5(F.col(text)).alias("md5"))


def misspelling_map_joined(spark: SparkSession, d: str) -> DataFrame:
    """The same by a join, as for a table that is too large for the driver."""
    text = "content_attachment1_plain_data"
    reports = read(spark, d, "radiology_reports").filter(f"{text} is not null")
    return r.correct_joined(reports, "report_id", text, read(spark, d, "misspellings")).select("report_id", _md5(F.col(text)).alias("md5"))


def misspelling_counts(spark: SparkSession, d: str) -> DataFrame:
    """How often each misspelling occurs: words joined with the dictionary, which is broadcast if counted as small."""
    table = read(spark, d, "misspellings").select(F.trim("word").alias("word"), "seed").groupBy("word").agg(F.min("seed").alias("seed"))
    words = read(spark, d, "radiology_reports").select(F.explode(F.split("content_attachment1_plain_data", " ")).alias("w")).select(F.regexp_replace("w", r"[^\p{L}\p{N}]+", "").alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).join(broadcast_if_small(table), "word").select("word", "seed", "n")


def noise_prune(spark: SparkSession, d: str) -> DataFrame:
    kept = r.prune(NOISE, NEGATIVE)
    reports = read(spark, d, "radiology_reports").filter("content_attachment1_plain_data is not null")
    return reports.select("report_id", _md5(t.drop_noise("content_attachment1_plain_data", kept)).alias("md5"))


def question_removal(spark: SparkSession, d: str) -> DataFrame:
    reports = read(spark, d, "radiology_reports").filter("content_attachment1_plain_data is not null")
    c = F.col("content_attachment1_plain_data")
    return reports.select("report_id", _md5(r.without_terms(r.without_questions(c, TERMS), IGNORE)).alias("md5"))


def synonym_containment(spark: SparkSession, d: str) -> DataFrame:
    has = r.contains_any(F.col("txt"), TERMS)
    return _load(spark, d).groupBy(has.alias("has")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.length("txt")), 6).alias("mean_length"))


def radiology_label(spark: SparkSession, d: str) -> DataFrame:
    return r.label(_load(spark, d), TERMS, NEGATIVE, POSITIVE, IGNORE)


def label_shares(spark: SparkSession, d: str) -> DataFrame:
    labels = read(spark, d, "study_labels")
    return labels.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("studyid_0771").alias("studies"), F.round(F.avg((F.col("label") == 1).cast("int")) * 100, 6).alias("positive_percent"), F.sum((F.col("label") == -1).cast("int")).alias("absent"))


def label_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Study, day and target with contradicting labels, and the label the maximum rule leaves."""
    labels = read(spark, d, "study_labels").filter("label is not null")
    return labels.groupBy("studyid_0771", "onderzoeks_dt", "target").agg(F.countDistinct("label").alias("labels"), F.max("label").alias("label")).filter("labels > 1")


def combined_texts(spark: SparkSession, d: str) -> DataFrame:
    """The longest line of a report, and its lines joined."""
    lines = F.split("content_attachment1_plain_data", "\n")
    reports = read(spark, d, "radiology_reports").filter("content_attachment1_plain_data is not null")
    return reports.select("report_id", _md5(r.biggest(lines)).alias("biggest"), _md5(F.array_join(lines, "|")).alias("joined"))


def separator_split(spark: SparkSession, d: str) -> DataFrame:
    s = t.split_on("content_attachment1_plain_data", ["?", "[", "]"], [",", ";"])
    return read(spark, d, "radiology_reports").filter("content_attachment1_plain_data is not null").select("report_id", F.size(s).alias("n"), _md5(F.array_join(s, "|")).alias("md5"))


_C = "content_attachment1_plain_data"
_F = f"from radiology_reports where {_C} is not null"
_ALT = lambda terms: "(?i)" + "|".join(f"({x})" for x in terms)
_Q = "(?i)" + t.OTHER + "+(" + "|".join(TERMS) + ")" + t.SPACE + r"*\?"
_PREPARED = lambda c: sql_collapse(f"regexp_replace(regexp_replace({c}, {lit(_Q)}, '', 'g'), {lit(_ALT(IGNORE))}, '', 'g')")
_NOISE = "(?i)" + "|".join(f"({t.OTHER}{x}{t.OTHER})" for x in r.prune(NOISE, NEGATIVE))
_TABLE = "m as (select map(list(word), list(seed)) as t from (select trim(word) as word, min(seed) as seed from misspellings where word is not null and seed is not null group by 1))"
_KEY = "regexp_replace(w, '[^\\p{L}\\p{N}]+', '', 'g')"

QUERIES = {f.__name__: f for f in (report_load, report_exclude, report_replace, stopwords, misspelling_map, misspelling_map_joined, misspelling_counts, noise_prune, question_removal, synonym_containment, radiology_label, label_shares, label_conflicts, combined_texts, separator_split)}
SQL = {
    "report_load": f"select onderzoeks_dt::date as date, count(*) as n, count(distinct studyid_0771) as studies {_F} group by 1",
    "report_exclude": f"select studyid_0771 as id, count(*) as n {_F} and not regexp_matches({_C}, '(?i){'|'.join(EXCLUDED)}') group by 1",
    "report_replace": f"select report_id, md5(lower({sql_chain(_C, t.REPORT_CHAIN)})) as md5 {_F}",
    "stopwords": f"select report_id, md5(array_to_string(list_filter(string_split({_C}, ' '), lambda w: w not in ({', '.join(map(lit, STOP))})), ' ')) as md5 {_F}",
    "misspelling_map": f"""with {_TABLE} select report_id, md5(array_to_string(list_transform(string_split({_C}, ' '), lambda w: case when m.t[{_KEY}] is null then w
        else regexp_extract(w, '^({t.OTHER}*)', 1) || m.t[{_KEY}] || regexp_extract(w, '({t.OTHER}*)$', 1) end), ' ')) as md5 from radiology_reports, m where {_C} is not null""",
    "misspelling_counts": f"""with w as (select unnest(string_split({_C}, ' ')) as w {_F}), k as (select {_KEY} as word, count(*) as n from w group by 1)
        select k.word, seed, n from k join (select trim(word) as word, min(seed) as seed from misspellings group by 1) m on k.word = m.word""",
    "noise_prune": f"select report_id, md5({sql_collapse(f'regexp_replace({_C}, {lit(_NOISE)}, {lit(str())}, {lit(chr(103))})')}) as md5 {_F}",
    "question_removal": f"select report_id, md5({_PREPARED(_C)}) as md5 {_F}",
    "synonym_containment": f"select regexp_matches({_C}, {lit(_ALT(TERMS))}) as has, count(*) as n, round(avg(length({_C})), 6) as mean_length {_F} group by 1",
    "radiology_label": f"""with r as (select studyid_0771 as id, onderzoeks_dt::date as date, lower({sql_chain(_C, t.REPORT_CHAIN)}) as txt {_F}), h as (select *, regexp_matches(txt, {lit(_ALT(TERMS))}) as has from r),
        p as (select id, date, {_PREPARED('txt')} as txt from h where has),
        f as (select id, date, max(regexp_matches(txt, {lit(r.marker_pattern(NEGATIVE, TERMS))})::int) as n, max(regexp_matches(txt, {lit(r.marker_pattern(POSITIVE, TERMS))})::int) as p from p group by 1, 2)
        select id, date, case when n = 1 then 0 when p = 1 then 1 else 2 end as label from f union all select id, date, -1 from h where not has""",
    "label_shares": "select target, count(*) as n, count(distinct studyid_0771) as studies, round(avg((label = 1)::int) * 100, 6) as positive_percent, sum((label = -1)::int)::bigint as absent from study_labels group by 1",
    "label_conflicts": "select studyid_0771, onderzoeks_dt, target, count(distinct label) as labels, max(label) as label from study_labels where label is not null group by 1, 2, 3 having count(distinct label) > 1",
    "combined_texts": f"""with p as (select report_id, string_split({_C}, chr(10)) as lines {_F})
        select report_id, md5(list_reduce(lines, lambda a, b: case when length(a) > length(b) then a else b end)) as biggest, md5(array_to_string(lines, '|')) as joined from p""",
    "separator_split": f"""with s as (select report_id, list_transform(string_split(replace(replace(replace(replace(replace({_C}, '?', ''), '[', ''), ']', ''), ',', chr(1)), ';', chr(1)), chr(1)), lambda x: trim(x, ' ')) as s {_F})
        select report_id, len(s)::int as n, md5(array_to_string(s, '|')) as md5 from s""",
}
SQL["misspelling_map_joined"] = SQL["misspelling_map"]
