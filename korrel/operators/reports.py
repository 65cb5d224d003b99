"""Phrase labelling of reports: project, repair, replace, flag by markers, take the maximum per study and day, label.

The phrase lists are parameters. Null texts are dropped at loading; blank ones stay and hold no term. Repeated reports
of a study and day are combined by the maximum of their flags, so copies change nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korrel.functions.text import OTHER, SPACE, alternation, collapse_spaces, replace_chain
from korrel.session import broadcast_if_small, cut

#: Signs before a marker, fixed values.
DELIMITERS = (",", r"\;", r"\:", r"\.", r"\|")
MAX_DICTIONARY = 2000


def load(reports: DataFrame, study: str = "studyid_0771", day: str = "onderzoeks_dt", text: str = "content_attachment1_plain_data") -> DataFrame:
    return reports.select(F.col(study).alias("id"), F.to_date(day).alias("date"), F.col(text).alias("txt")).filter("txt is not null")


def exclude(df: DataFrame, terms: Sequence[str]) -> DataFrame:
    return df.filter(~F.col("txt").rlike("(?i)" + "|".join(terms)))


def corrections(rows: DataFrame) -> DataFrame:
    """word, seed of a correction table; of repeated words the first seed in order."""
    return rows.filter("word is not null and seed is not null").groupBy(F.trim("word").alias("word")).agg(F.min("seed").alias("seed"))


def dictionary(rows: DataFrame) -> dict[str, str] | None:
    """The table on the driver, or none if it has more than MAX_DICTIONARY words; then correct_joined serves."""
    found = corrections(rows).limit(MAX_DICTIONARY + 1).collect()
    return {r["word"]: r["seed"] for r in found} if len(found) <= MAX_DICTIONARY else None


def correct_joined(df: DataFrame, key: str, text: str, rows: DataFrame) -> DataFrame:
    """key and corrected text, with a table of any size: words with their places are joined to it and put together again.
    Keys are unique. Null texts stay null."""
    words = df.select(key, F.posexplode_outer(F.split(text, " ")).alias("__at", "__w")).withColumn("word", F.regexp_replace("__w", r"[^\p{L}\p{N}]+", ""))
    met = words.join(broadcast_if_small(corrections(rows)), "word", "left")
    fixed = F.when(F.col("seed").isNull(), F.col("__w")).otherwise(F.concat(F.regexp_extract("__w", f"^({OTHER}*)", 1), F.col("seed"), F.regexp_extract("__w", f"({OTHER}*)$", 1)))
    parts = met.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__at", fixed.alias("w")))).alias("ws"), F.max("__at").isNull().alias("none"))
    return parts.select(key, F.when(~F.col("none"), F.array_join(F.transform("ws", lambda x: x["w"]), " ")).alias(text))


def correct(c: Column, table: dict[str, str]) -> Column:
    """Words between blanks whose letters and digits are in the table are replaced; punctuation around them stays."""
    if not table:
        return c
    entries = F.create_map(*[F.lit(x) for kv in sorted(table.items()) for x in kv])

    def one(w: Column) -> Column:
        seed = F.try_element_at(entries, F.regexp_replace(w, r"[^\p{L}\p{N}]+", ""))
        return F.when(seed.isNull(), w).otherwise(F.concat(F.regexp_extract(w, f"^({OTHER}*)", 1), seed, F.regexp_extract(w, f"({OTHER}*)$", 1)))

    return F.array_join(F.transform(F.split(c, " "), one), " ")


def prune(noise: Sequence[str], markers: Sequence[str]) -> list[str]:
    """Noise words that occur in no marker."""
    return [w for w in noise if not any(w in m for m in markers)]


def contains_any(c: Column, terms: Sequence[str]) -> Column:
    return c.rlike(alternation(terms))


def without_questions(c: Column, terms: Sequence[str]) -> Column:
    return F.regexp_replace(c, "(?i)" + OTHER + "+(" + "|".join(terms) + ")" + SPACE + r"*\?", "")


def without_terms(c: Column, terms: Sequence[str]) -> Column:
    return collapse_spaces(F.regexp_replace(c, alternation(terms), "")) if terms else c


def marker_pattern(markers: Sequence[str], terms: Sequence[str]) -> str:
    group = lambda xs: "|".join(f"({x})" for x in xs)
    return f"({group(DELIMITERS)}){SPACE}*({group(markers)}){SPACE}*({group(terms)})"


def label(df: DataFrame, terms: Sequence[str], negative: Sequence[str], positive: Sequence[str], ignore: Sequence[str] = ()) -> DataFrame:
    """id, date, label: 0 where a negative marker stands before a term, else 1 for a positive one, else 2; -1 for
    reports without any term (union, so a study and day may have both)."""
    ready = df.select("id", "date", F.lower(replace_chain("txt")).alias("txt"))
    prepared = reduce(lambda c, f: f(c), (lambda c: without_questions(c, terms), lambda c: without_terms(c, ignore)), F.col("txt"))
    flagged = ready.withColumn("has", contains_any(F.col("txt"), terms)).withColumn("txt", F.when(F.col("has"), prepared)).select(
        "id", "date", "has", F.spark_partition_id().alias("part"),
        F.col("txt").rlike(marker_pattern(negative, terms)).cast("int").alias("negative"),
        F.col("txt").rlike(marker_pattern(positive, terms)).cast("int").alias("positive"),
    )
    # One pass over the texts: flags and the number of reports without a term, per study, day and task.
    per = cut(flagged.groupBy("id", "date", "part").agg(F.max("positive").alias("positive"), F.max("negative").alias("negative"), F.count_if(F.col("has")).alias("n_has"), F.count_if(~F.col("has")).alias("n_not")))
    both = per.filter("n_has > 0").groupBy("id", "date").agg(F.max("positive").alias("positive"), F.max("negative").alias("negative"))
    case = F.when(F.col("negative") == 1, 0).when(F.col("positive") == 1, 1).otherwise(2)
    absent = per.filter("n_not > 0").select("id", "date", F.explode(F.array_repeat(F.lit(-1), F.col("n_not").cast("int"))).alias("label"))
    return both.select("id", "date", case.alias("label")).unionByName(absent)


def biggest(texts: Column) -> Column:
    """The longest of an array of texts; of equally long ones the last. Null for an empty array."""
    return F.aggregate(texts, F.get(texts, F.lit(0)), lambda best, t: F.when(F.length(best) > F.length(t), best).otherwise(t))
