"""Queries of the canonical model: normalise, clean, filter, describe."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korrel.functions import text as t
from korrel.ordering import ordinal
from korrel.session import broadcast_if_small, read, spread

MIN_WORDS = 32
NO_SOURCE = "not available"


def lit(s: str) -> str:
    """An SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def sql_strip(c: str) -> str:
    return f"regexp_replace({c}, {lit(f'^{t.SPACE}+|{t.SPACE}+$')}, '', 'g')"


def sql_collapse(c: str) -> str:
    return f"regexp_replace({c}, {lit(t.SPACE + '{2,}')}, ' ', 'g')"


def sql_words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, {lit(t.SPACE + '+')}), lambda w: w <> '')"


def sql_chain(c: str, chain: tuple) -> str:
    for pattern, new in chain:
        c = f"regexp_replace({c}, {lit(pattern)}, {lit(new)}, 'g')"
    return c


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Clean with backreference steps, keep documents of MIN_WORDS words, count per source."""
    docs = spread(_docs(spark, d).filter("text is not null and length(text) > 0").select("source", "text"))
    counted = docs.select(F.coalesce("source", F.lit(NO_SOURCE)).alias("source"), t.word_count(t.clean("text")).alias("n"))
    keep = F.col("n") >= MIN_WORDS
    return counted.groupBy("source").agg(F.sum(keep.cast("bigint")).alias("kept"), F.sum(F.when(keep, F.col("n")).otherwise(0)).cast("bigint").alias("words"), F.sum((~keep).cast("bigint")).alias("skipped"))


def normalise_wordcount(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(_docs(spark, d).filter("text is not null and length(text) > 0").select("source", "text"))
    counted = docs.select(F.coalesce("source", F.lit(NO_SOURCE)).alias("source"), t.word_count(t.collapse_spaces(t.strip("text"))).alias("n"))
    keep = F.col("n") >= MIN_WORDS
    return counted.groupBy("source").agg(F.sum(keep.cast("bigint")).alias("kept"), F.sum(F.when(keep, F.col("n")).otherwise(0)).cast("bigint").alias("words"), F.sum((~keep).cast("bigint")).alias("skipped"))


def canonical_documents(spark: SparkSession, d: str) -> DataFrame:
    """Id as string with a synthetic one where it is missing, defaults, source fill."""
    minus = lambda c: F.coalesce(c, F.lit(-1).cast("bigint")).alias(c)
    return (
        _docs(spark, d)
        .filter("text is not null and length(text) > 0")
        .select(F.coalesce("id", F.concat(F.lit("documents_"), F.col("doc_id").cast("string"))).alias("id"), F.md5(F.col("text").cast("binary")).alias("text_md5"), F.coalesce("source", F.lit(NO_SOURCE)).alias("source"), minus("approx_token_counts_original"), minus("approx_token_counts_translated"))
    )


def synthetic_ids(spark: SparkSession, d: str) -> DataFrame:
    """<source>_<ordinal>; the ordinal counts all rows, also those that a later filter drops."""
    numbered = ordinal(_docs(spark, d).select("doc_id", "source", "text"), ["doc_id"])
    return numbered.filter("length(text) > 0").select("doc_id", F.concat_ws("_", F.coalesce("source", F.lit(NO_SOURCE)), F.col("pos").cast("string")).alias("new_id"))


def sanitize_texts(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.md5(t.sanitize("text").cast("binary")).alias("text_md5"), t.sanitize("id").alias("id"), t.sanitize("source").alias("source"))


def char_issues(spark: SparkSession, d: str) -> DataFrame:
    c = F.coalesce("text", F.lit(""))
    return _docs(spark, d).select("doc_id", t.count_of(c, r"\x{80}-\x{10ffff}").alias("non_ascii"), t.count_of(c, r"\x00-\x08\x0b\x0c\x0e-\x1f").alias("controls"), t.count_of(c, r"\\").alias("backslashes"))


def char_positions(spark: SparkSession, d: str) -> DataFrame:
    """Each non-ASCII or control character and backslash with its place and ten characters on either side."""
    odd = r"[^\x09\x0a\x0d\x20-\x{5b}\x{5d}-\x{7f}]"
    docs = _docs(spark, d).select("doc_id", "text").filter(F.col("text").rlike(odd))
    chars = docs.select("doc_id", "text", F.posexplode(F.split("text", "")).alias("pos", "ch")).filter(F.col("ch").rlike(odd))
    start = F.greatest(F.col("pos") - 10, F.lit(0))
    return chars.select("doc_id", "pos", F.hex(F.encode("ch", "UTF-8")).alias("code"), F.md5(F.substring("text", start + 1, F.col("pos") + 11 - start).cast("binary")).alias("context_md5"))


def text_describe(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text")
    return _docs(spark, d).filter("text is not null").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(n), 6).alias("mean"), F.round(F.stddev_samp(n), 6).alias("std"), F.min(n).alias("least"),
        *[F.round(F.percentile(n, F.lit(p)), 6).alias(f"p{int(p * 100)}") for p in (0.25, 0.5, 0.75)], F.max(n).alias("most"),
    )


def column_profile(spark: SparkSession, d: str) -> DataFrame:
    """Rows and non-null values of every column, in one pass."""
    docs = _docs(spark, d)
    names = sorted(docs.columns)
    one = docs.agg(F.count(F.lit(1)).alias("__rows"), *[F.count(c).alias(c) for c in names])
    parts = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("filled"), F.col("__rows").alias("rows")) for c in names])
    return one.select(F.explode(parts).alias("x")).select("x.*")


def words_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Words between single blanks (empty ones count) and between any white space."""
    return _docs(spark, d).filter("text is not null").groupBy(F.coalesce("source", F.lit(NO_SOURCE)).alias("source")).agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size(F.split("text", " "))).alias("blank_words"), F.sum(t.word_count("text")).alias("words"))


def min_words_filter(spark: SparkSession, d: str) -> DataFrame:
    n = t.word_count(t.strip("text"))
    return _docs(spark, d).filter(F.length("text") > 0).filter(n >= MIN_WORDS).select("doc_id", n.alias("n_words"))


def blank_filter(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).filter(t.strip("text") != "").select("doc_id", "lang")


def source_fill(spark: SparkSession, d: str) -> DataFrame:
    """A source that is not available becomes the stem of the input's name."""
    return _docs(spark, d).select("doc_id", F.when(F.col("source") == NO_SOURCE, F.lit("documents")).otherwise(F.col("source")).alias("source"))


#: Patterns in order with their field names; * is a wildcard and the match is one of the beginning only.
PATTERNS = (("mt_richtlijn_*.jsonl", "id", "text"), ("*_flash.jsonl", "patient_uid", "transformed_text"), ("opname*", "hadm_id", "text"), ("*.jsonl", "id", "text"), ("tijd*.csv", "id", "text"), ("*.csv", "nr", "body"))


def _regex(glob: str) -> str:
    return "^" + glob.replace(".", "[.]").replace("*", ".*")


def catalog_match_first(spark: SparkSession, d: str) -> DataFrame:
    """The first pattern in order that matches the beginning of a file's name."""
    files = read(spark, d, "raw_records").groupBy("file_name").agg(F.count(F.lit(1)).alias("rows"))
    hit = lambda at: F.coalesce(*[F.when(F.col("file_name").rlike(_regex(p[0])), F.lit(p[at])) for p in PATTERNS])
    return files.select("file_name", "rows", hit(0).alias("pattern"), hit(1).alias("id_field"), hit(2).alias("text_field"))


def incremental_anti(spark: SparkSession, d: str) -> DataFrame:
    """Files whose exact stem has no output yet."""
    files = read(spark, d, "raw_records").select("file_name").distinct().withColumn("stem", F.regexp_replace("file_name", r"\.[^.]*$", ""))
    done = read(spark, d, "file_catalog").filter("row_format = 'csv'").select(F.concat(F.regexp_replace("file_name", r"\.[^.]*$", ""), F.lit("_normalised.jsonl")).alias("output"))
    outputs = done.select(F.regexp_replace("output", r"_normalised\.jsonl?$", "").alias("stem"))
    return files.join(outputs, "stem", "left_anti").select("file_name")


def incremental_substring(spark: SparkSession, d: str) -> DataFrame:
    """The same with the looser test: the stem occurs anywhere in an output's name. The pairs are found by equality on
    every substring of an output's name that has the length of a stem, so no nested loop is needed."""
    files = read(spark, d, "raw_records").select("file_name").distinct().withColumn("stem", F.regexp_replace("file_name", r"\.[^.]*$", ""))
    outputs = read(spark, d, "file_catalog").filter("row_format = 'csv'").select(F.concat(F.lit("a_"), F.regexp_replace("file_name", r"\.[^.]*$", ""), F.lit("2_normalised.jsonl")).alias("output"))
    n = F.length("output")
    starts = outputs.select("output", F.explode(F.sequence(F.lit(1), n)).alias("s")).select("output", "s", F.explode(F.sequence(F.lit(1), F.length("output") - F.col("s") + 1)).alias("k"))
    parts = starts.select(F.substring("output", F.col("s"), F.col("k")).alias("stem")).distinct()
    return files.join(parts, "stem", "left_anti").select("file_name")


def size_sync(spark: SparkSession, d: str) -> DataFrame:
    """Listing join: missing here, or of another size. The local listing lacks files and has JSON files a byte short."""
    raw = read(spark, d, "raw_records")
    remote = raw.groupBy("file_name").agg(F.sum(F.length("text")).alias("size"))
    local = remote.filter("file_name not like 's%'").select("file_name", (F.col("size") - F.col("file_name").like("%.jsonl").cast("bigint")).alias("local_size"))
    both = remote.join(local, "file_name", "left")
    return both.filter("local_size is null or local_size <> size").select("file_name", "size", "local_size", F.col("local_size").isNull().alias("missing"))


def extension_filter(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "raw_records").filter(F.lower("file_name").rlike(r"\.jsonl?$")).groupBy("file_name").agg(F.count(F.lit(1)).alias("n"))


def byte_sizes(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "raw_records").groupBy("file_name").agg(F.sum(F.octet_length("text")).alias("bytes")).select("file_name", "bytes", t.byte_size("bytes").alias("size"))


def rename_and_literal(spark: SparkSession, d: str) -> DataFrame:
    """Web rows to canonical ones: rename, drop, add a literal, reorder."""
    return _docs(spark, d).withColumnRenamed("n_chars", "approx_tokens").drop("split", "no_such_column").withColumn("source", F.lit("web")).select("source", "doc_id", "approx_tokens", "lang")


def first_text_column(spark: SparkSession, d: str) -> DataFrame:
    """The first string-valued field of a row, in schema order, where no field has the expected name."""
    docs = _docs(spark, d).drop("text")
    strings = [f.name for f in docs.schema if f.dataType.simpleString() == "string"]
    return docs.select("doc_id", F.coalesce(*strings).alias("text"))


def split_sentences(spark: SparkSession, d: str) -> DataFrame:
    s = t.sentences("text")
    return _docs(spark, d).filter("text is not null").select("doc_id", F.size(s).alias("n"), F.md5(F.array_join(s, "|").cast("binary")).alias("md5"))


def clean_texts(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).filter("text is not null").select("doc_id", t.clean("text").alias("text"))


def nul_to_space(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "raw_records").select("raw_id", F.md5(F.regexp_replace("text", r"\x00", " ").cast("binary")).alias("md5"))


def html_text(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).filter("text is not null").select("doc_id", F.md5(t.collapse_spaces(t.strip(t.strip_tags("text"))).cast("binary")).alias("md5"))


def recommended_mode(spark: SparkSession, d: str) -> DataFrame:
    """Loader mode by number of files, and steps an epoch."""
    n = F.col("n")
    return read(spark, d, "raw_records").agg(F.countDistinct("file_name").alias("n")).select("n", F.when(n > 100, F.lit("streaming")).when(n < 10, F.lit("memory")).otherwise(F.lit("either")).alias("mode"), F.floor(n * 1000 / 8).cast("bigint").alias("steps"))


def union_all(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).select(F.col("doc_id").alias("key"), "source")
    items = read(spark, d, "tokenized_examples").select(F.col("item_id").alias("key"), "source")
    return docs.unionByName(items).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("key").alias("keys"))


def set_operations(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).select("id").filter("id is not null")
    items = read(spark, d, "tokenized_examples").select("id").filter("id is not null")
    return docs.intersect(items).withColumn("side", F.lit("both")).unionByName(docs.distinct().exceptAll(items.distinct()).withColumn("side", F.lit("documents"))).groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


def source_vocabulary_join(spark: SparkSession, d: str) -> DataFrame:
    """Dictionary join of documents with their source's targets; the dictionary is broadcast if counted as small."""
    targets = read(spark, d, "mix_targets").select("source", "target_weight", "max_repeats")
    return _docs(spark, d).join(broadcast_if_small(targets), "source", "left").groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.max("target_weight").alias("target_weight"), F.max("max_repeats").alias("max_repeats"))


def newest_per_id(spark: SparkSession, d: str) -> DataFrame:
    """The last row of each id, pre-aggregated per task; rows without an id are one group."""
    newest = _docs(spark, d).groupBy("id").agg(F.max(F.struct("doc_id", "lang")).alias("m"))
    return newest.select("id", "m.doc_id", "m.lang")


_KEPT = "from documents where text is not null and length(text) > 0"
_STEM = "regexp_replace(file_name, '\\.[^.]*$', '')"
_HIT = lambda at: "case " + " ".join(f"when regexp_matches(file_name, {lit(_regex(p[0]))}) then {lit(p[at])}" for p in PATTERNS) + " end"
_COUNTED = "length(regexp_replace(coalesce(text, ''), '[^{}]', '', 'g'))"
_PROFILE = ("approx_token_counts_original", "approx_token_counts_translated", "doc_id", "id", "lang", "n_chars", "source", "split", "text")

QUERIES = {
    "normalise_clean_wordcount": flagship, "normalise_wordcount": normalise_wordcount, "canonical_documents": canonical_documents,
    "synthetic_ids": synthetic_ids, "sanitize": sanitize_texts, "char_issues": char_issues, "char_positions": char_positions,
    "text_describe": text_describe, "column_profile": column_profile, "words_by_source": words_by_source,
    "min_words_filter": min_words_filter, "blank_filter": blank_filter, "source_fill": source_fill,
    "catalog_match_first": catalog_match_first, "incremental_anti": incremental_anti, "incremental_substring": incremental_substring,
    "size_sync": size_sync, "extension_filter": extension_filter, "byte_sizes": byte_sizes, "rename_and_literal": rename_and_literal,
    "first_text_column": first_text_column, "sentences": split_sentences, "clean_text": clean_texts, "nul_to_space": nul_to_space,
    "html_text": html_text, "recommended_mode": recommended_mode, "union_all": union_all, "set_operations": set_operations,
    "source_dictionary_join": source_vocabulary_join, "newest_per_id": newest_per_id,
}
SQL = {
    "normalise_wordcount": f"""with c as (select coalesce(source, '{NO_SOURCE}') as source, len({sql_words(sql_collapse(sql_strip('text')))}) as n {_KEPT})
        select source, sum((n >= {MIN_WORDS})::int)::bigint as kept, sum(case when n >= {MIN_WORDS} then n else 0 end)::bigint as words, sum((n < {MIN_WORDS})::int)::bigint as skipped from c group by 1""",
    "canonical_documents": f"""select coalesce(id, 'documents_' || doc_id) as id, md5(text) as text_md5, coalesce(source, '{NO_SOURCE}') as source,
        coalesce(approx_token_counts_original, -1) as approx_token_counts_original, coalesce(approx_token_counts_translated, -1) as approx_token_counts_translated {_KEPT}""",
    "synthetic_ids": f"""with n as (select *, row_number() over (order by doc_id) - 1 as pos from documents)
        select doc_id, coalesce(source, '{NO_SOURCE}') || '_' || pos as new_id from n where length(text) > 0""",
    "sanitize": "select doc_id, md5({}) as text_md5, {} as id, {} as source from documents".format(*(sql_chain(f"coalesce({c}, '')", ((t.CONTROLS, ""), (t.SINGLE_QUOTES, ""), (t.DOUBLE_QUOTES, ""))) for c in ("text", "id", "source"))),
    "char_issues": "select doc_id, {} as non_ascii, {} as controls, {} as backslashes from documents".format(*(f"{_COUNTED.format(c)}::int" for c in (r"\x{80}-\x{10ffff}", r"\x00-\x08\x0b\x0c\x0e-\x1f", r"\\"))),
    "char_positions": r"""with c as (select doc_id, text, unnest(range(length(text)::bigint)) as pos from documents where text is not null),
        o as (select doc_id, text, pos::int as pos, substr(text, pos + 1, 1) as ch from c)
        select doc_id, pos, hex(encode(ch)) as code, md5(substr(text, greatest(pos - 10, 0) + 1, pos + 11 - greatest(pos - 10, 0))) as context_md5
        from o where regexp_matches(ch, '[^\x09\x0a\x0d\x20-\x{5b}\x{5d}-\x{7f}]')""",
    "text_describe": """select count(*) as n, round(avg(length(text)), 6) as mean, round(stddev_samp(length(text)), 6) as std, min(length(text))::int as least,
        round(quantile_cont(length(text), 0.25), 6) as p25, round(quantile_cont(length(text), 0.5), 6) as p50, round(quantile_cont(length(text), 0.75), 6) as p75, max(length(text))::int as most from documents where text is not null""",
    "column_profile": " union all ".join(f"select '{c}' as \"column\", count({c}) as filled, count(*) as rows from documents" for c in _PROFILE),
    "words_by_source": f"""select coalesce(source, '{NO_SOURCE}') as source, count(*) as docs, sum(len(string_split(text, ' ')))::bigint as blank_words, sum(len({sql_words('text')}))::bigint as words
        from documents where text is not null group by 1""",
    "min_words_filter": f"select doc_id, len({sql_words(sql_strip('text'))})::int as n_words {_KEPT} and len({sql_words(sql_strip('text'))}) >= {MIN_WORDS}",
    "blank_filter": f"select doc_id, lang from documents where {sql_strip('text')} <> ''",
    "source_fill": f"select doc_id, case when source = '{NO_SOURCE}' then 'documents' else source end as source from documents",
    "catalog_match_first": f"select file_name, count(*) as rows, {_HIT(0)} as pattern, {_HIT(1)} as id_field, {_HIT(2)} as text_field from raw_records group by file_name",
    "incremental_anti": f"select distinct file_name from raw_records where {_STEM} not in (select {_STEM} from file_catalog where row_format = 'csv')",
    "incremental_substring": f"""select distinct file_name from raw_records r where not exists (select 1 from (select 'a_' || {_STEM} || '2_normalised.jsonl' as o from file_catalog where row_format = 'csv') c
        where contains(c.o, regexp_replace(r.file_name, '\\.[^.]*$', '')))""",
    "size_sync": """with r as (select file_name, sum(length(text))::bigint as size from raw_records group by 1),
        l as (select file_name, size - (file_name like '%.jsonl')::bigint as local_size from r where file_name not like 's%')
        select r.file_name, size, local_size, local_size is null as missing from r left join l using (file_name) where local_size is null or local_size <> size""",
    "extension_filter": "select file_name, count(*) as n from raw_records where regexp_matches(lower(file_name), '\\.jsonl?$') group by 1",
    "byte_sizes": """with s as (select file_name, sum(strlen(text))::bigint as bytes from raw_records group by 1)
        select file_name, bytes, case when bytes < 1024 then printf('%.1f B', bytes::double) when bytes < 1048576 then printf('%.1f KB', bytes / 1024.0::double) when bytes < 1073741824 then printf('%.1f MB', bytes / 1048576.0::double) else printf('%.1f GB', bytes / 1073741824.0::double) end as size from s""",
    "rename_and_literal": "select 'web' as source, doc_id, n_chars as approx_tokens, lang from documents",
    "first_text_column": "select doc_id, coalesce(id, lang, source, split) as text from documents",
    "sentences": f"""with s as (select doc_id, list_filter(list_transform(string_split(regexp_replace(text, {lit(f'([.!?]){t.SPACE}+')}, '\\1' || chr(1), 'g'), chr(1)), lambda s: {sql_strip('s')}), lambda s: s <> '') as s from documents where text is not null)
        select doc_id, len(s)::int as n, md5(array_to_string(s, '|')) as md5 from s""",
    "nul_to_space": "select raw_id, md5(regexp_replace(text, '\\x00', ' ', 'g')) as md5 from raw_records",
    "recommended_mode": "select n, case when n > 100 then 'streaming' when n < 10 then 'memory' else 'either' end as mode, floor(n * 1000 / 8)::bigint as steps from (select count(distinct file_name) as n from raw_records)",
    "union_all": "select source, count(*) as n, sum(key)::bigint as keys from (select doc_id as key, source from documents union all select item_id, source from tokenized_examples) group by 1",
    "set_operations": """with d as (select distinct id from documents where id is not null), i as (select distinct id from tokenized_examples where id is not null)
        select 'both' as side, count(*) as n, min(id) as first_id from (select id from d intersect select id from i) union all select 'documents', count(*), min(id) from (select id from d except select id from i)""",
    "source_dictionary_join": "select d.source, count(*) as docs, max(target_weight) as target_weight, max(max_repeats) as max_repeats from documents d left join mix_targets m on d.source = m.source group by 1",
    "newest_per_id": "select id, max(doc_id) as doc_id, arg_max(coalesce(lang, '\x01'), doc_id) as lang from documents group by id",
}
_BARE = "regexp_replace(regexp_replace(text, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"
for _e in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
    _BARE = f"replace({_BARE}, {lit(_e[0])}, {lit(_e[1])})"
SQL["html_text"] = f"select doc_id, md5({sql_collapse(sql_strip(_BARE))}) as md5 from documents where text is not null"
SQL["newest_per_id"] = "select id, doc_id, lang from (select *, row_number() over (partition by id order by doc_id desc) as rn from documents) where rn = 1"
