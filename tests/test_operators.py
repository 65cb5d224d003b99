"""Operators against small Python models, and the quirks that the design decided on."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from korrel.functions import text as t
from korrel.operators import chunks as c
from korrel.operators import metrics as m
from korrel.operators import reports as r
from korrel.operators import sequence as s
from korrel.ordering import hash_ordinal, ordinal
from korrel.sources import files, sinks


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(expr.alias("x")).collect()[0].x


@pytest.mark.parametrize("text,want", [("!!!!!!", "!!"), ("haha haha, haha", "haha"), ("  a   b  ", "a b"), ("", ""), (None, None), ("één één één", "één"), ("a a a", "a a a")])
def test_clean(spark, text, want):
    assert one(spark, t.clean("a"), a=text) == want


def test_long_repeats_do_not_overflow(spark):
    assert one(spark, t.clean("a"), a="woord " * 50_000) == "woord"


def test_sanitize(spark):
    assert one(spark, t.sanitize("a"), a="\x00a\x0b'b’“c\x7f\t\n″") == "abc\t\n"
    assert one(spark, t.sanitize("a"), a=None) == ""


def test_sentences_and_tags(spark):
    assert one(spark, t.sentences("a"), a="Een. Twee!  Drie? 1.5 mg") == ["Een.", "Twee!", "Drie?", "1.5 mg"]
    assert one(spark, t.strip(t.strip_tags("a")), a="<p>a &lt; b<script>x()</script></p>") == "a < b"
    assert one(spark, t.split_on("a", ["?"], [",", ";"]), a="a?, b ;c") == ["a", "b", "c"]


@pytest.mark.parametrize("n", [0, 1, 7, 10, 50])
def test_tiles(spark, n):
    df = spark.createDataFrame([(i,) for i in range(n)], "k bigint")
    sizes = Counter(x.part for x in s.tiles(df, "k", 7).collect())
    assert [sizes.get(i, 0) for i in range(7)] == [n // 7 + (i < n % 7) for i in range(7)]


def test_ordinal_with_nulls_and_skew(spark):
    rows = [(None if i % 5 == 0 else "same" if i % 3 == 0 else f"s{i % 7}", i) for i in range(997)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "a string, k bigint")
    want = {k: i for i, (_, k) in enumerate(sorted(rows, key=lambda x: (x[0] is not None, x[0] or "", x[1])))}
    assert {x.k: x.pos for x in ordinal(df, ["a", "k"]).collect()} == want
    assert ordinal(df.limit(0), ["k"]).count() == 0
    by = hash_ordinal(df, 1, ["k"], groups=["a"]).collect()
    for group in {x.a for x in by}:
        assert sorted(x.pos for x in by if x.a == group) == list(range(sum(x.a == group for x in by)))


def test_shuffles_are_permutations(spark):
    df = spark.range(300).withColumnRenamed("id", "k")
    for out in (s.shuffled(df, "k"), s.windowed_shuffle(df, "k", 50, 2), s.block_shuffle(df, "k", 20)):
        got = out.collect()
        assert sorted(x.k for x in got) == list(range(300)) and sorted(x.pos for x in got) == list(range(300))
    assert [x.k for x in s.shuffled(df, "k").orderBy("pos").collect()] != list(range(300))
    windows = s.windowed_shuffle(df, "k", 50).orderBy("pos").collect()
    assert all(len({x.k // 50 for x in windows[i : i + 50]}) == 1 for i in range(0, 300, 50))


def test_reservoir(spark):
    assert s.reservoir_order(range(20), 5, 1, shuffle=False) == list(range(20))
    assert s.reservoir_order(range(20), 0, 1) == list(range(20))
    assert sorted(s.reservoir_order(range(20), 5, 1)) == list(range(20))
    got = s.reservoir_shuffle(spark.range(100).withColumnRenamed("id", "k"), "k", 4, 10).collect()
    assert sorted(x.k for x in got) == list(range(100))


@pytest.mark.parametrize("rows,replicas", [(17, 4), (17, 16), (3, 16), (0, 4)])
def test_distributed_sample(spark, rows, replicas):
    df = spark.range(rows).withColumnRenamed("id", "k")
    got = s.distributed_sample(df, "k", replicas).collect()
    per = Counter(x["rank"] for x in got)
    assert set(per.values()) == ({-(-rows // replicas)} if rows else set()) and {x.k for x in got} == set(range(rows))
    less = Counter(x["rank"] for x in s.distributed_sample(df, "k", replicas, drop_last=True).collect())
    assert set(less.values()) <= {rows // replicas}


def test_weighted_interleave_errors(spark):
    df = spark.createDataFrame([(1, "a")], "k bigint, source string")
    with pytest.raises(ValueError):
        s.weighted_interleave(df, "k", "source", {"a": 0.0}, 5)


def test_weighted_interleave_ends_by_exhaustion(spark):
    rows = [(i, "a" if i % 3 else "b") for i in range(1200)]
    got = s.weighted_interleave(spark.createDataFrame(rows, "item bigint, source string"), "item", "source", {"a": 3.0, "b": 1.0}).orderBy("slot").collect()
    digest = lambda text: hashlib.md5(text.encode()).hexdigest()
    left = {name: sorted((k for k, n in rows if n == name), key=lambda k: (digest(f"interleave:{k}"), k)) for name in "ab"}
    want, slot = [], 0
    while left[name := "a" if int(digest(f"42:{slot}")[:8], 16) / 2**32 < 0.75 else "b"]:
        want.append((slot, name, left[name].pop(0)))
        slot += 1
    assert len(want) > 60 and [(x.slot, x.source, x["item"]) for x in got] == want


def test_lockstep():
    assert s.lockstep_limit({0: 17, 1: 33}, 8) == 2
    assert s.lockstep_limit({}, 8) == 0


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 16, 19])
def test_chunks_hold_the_input(spark, n):
    df = spark.createDataFrame([(1, list(range(100, 100 + n)))], "k bigint, ids array<int>")
    got = c.chunked(df, "ids", 8, ["k"]).orderBy("chunk_ix").collect()
    assert [x for g in got for x in g.chunk] == list(range(100, 100 + n)) and all(len(g.chunk) <= 8 for g in got)
    row = df.select(c.pad("ids", 8, 0).alias("p"), c.truncated_eos("ids", 8, 1).alias("e"), c.pad_to_multiple("ids", 8, 0).alias("m"), c.position_ids("ids", 4, 0).alias("i")).collect()[0]
    assert len(row.p) == max(8, n) and row.e[-1] == 1 and len(row.e) <= 8 and len(row.m) % 8 == 0 and row.i == [1 + i % 4 for i in range(n)]


def test_concat_and_cut(spark):
    rows = [(i, [i * 10 + j for j in range(i % 5)]) for i in range(40)]
    df = spark.createDataFrame(rows, "k bigint, ids array<int>")
    want = []
    for b in range(0, 40, 9):
        flat = [x for _, ids in rows[b : b + 9] for x in ids]
        want += [(b // 9, i, flat[i * 4 : i * 4 + 4]) for i in range(len(flat) // 4)]
    got = [(x.batch, x.chunk_ix, x.chunk) for x in c.concat_and_cut(df, "k", "ids", 4, 9).collect()]
    assert sorted(got) == want


def test_packing_rules():
    assert c.pack_sentences([3, 3, 9, 2, 2], 6) == [[0, 1], [3, 4]]
    assert c.pack_sentences([3, 9, 2], 6, split=True) == [[0], [1], [2]]
    assert c.pack_sentences([], 6) == []
    assert c.group_sentences([[1, 2], [3, 4, 5, 6]], 4, 9, 0, 8) == [9, 1, 2, 0, 9, 3, 4, 5]
    assert c.group_sentences([[1, 2, 3, 4, 5, 6]], 4, 9, 0, 8) == [9, 1, 2, 3, 9, 5, 6, 0]


def test_metrics(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (2.0,)], "x double")
    assert [x.y for x in df.select(m.clean_loss(F.col("x")).alias("y")).collect()] == [0.0, 0.0, 2.0]


def test_labels(spark):
    rows = [("s", "2020-01-01", "Conclusie: geen stenose."), ("s", "2020-01-01", "Nu: wel stenose."), ("u", "2020-01-02", "Beeld: wel stenose."), ("v", "2020-01-03", "x stenose"), ("w", "2020-01-04", "niets"), ("x", "2020-01-05", None)]
    df = spark.createDataFrame(rows, "studyid_0771 string, onderzoeks_dt string, content_attachment1_plain_data string")
    got = {(x.id, str(x.date)): x.label for x in r.label(r.load(df), ["stenose"], ["geen"], ["wel"]).collect()}
    assert got == {("s", "2020-01-01"): 0, ("u", "2020-01-02"): 1, ("v", "2020-01-03"): 2, ("w", "2020-01-04"): -1}
    assert r.prune(["ruim", "gnif", "geen"], ["significante", "geen x"]) == ["ruim"]


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "a"}\n\n{"text": "b\n', encoding="utf-8")
    got = {x.value: x.status for x in files.read_jsonl(spark, str(tmp_path / "a.jsonl")).collect()}
    assert got == {'{"text": "a"}': "ok", '{"text": "b': "repaired"}
    assert files.repair_line('{"text": "b\n')[1] == "repaired" and files.repair_line('{"text": "b\n', strict=True)[1] == "bad"
    (tmp_path / "b.txt").write_bytes("één\ntwee\r\n".encode("latin-1"))
    assert [x.text for x in files.read_txt(spark, str(tmp_path / "b.txt")).orderBy("ix").collect()] == ["één", "twee"]
    assert [x.text for x in files.read_txt(spark, str(tmp_path / "b.txt"), "n\n").orderBy("ix").collect()] == ["éé", "twee\r\n"]
    assert [x.path[-5:] for x in files.listing(spark, str(tmp_path), "*.txt").collect()] == ["b.txt"]
    assert files.texts(spark.createDataFrame([("x", "y")], "tekst string, b string")).collect()[0].text == "x"
    with pytest.raises(ValueError):
        files.texts(spark.range(1))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t'{i}", "train" if i % 3 else "test", "7" if i % 2 else "x") for i in range(2049)], "k bigint, text string, split string, approx_token_counts_original string")
    sinks.combined(df, str(tmp_path / "c"))
    back = spark.read.parquet(str(tmp_path / "c"))
    assert back.count() == 2049 and back.filter("approx_token_counts_original = -1").count() == 1025 and back.filter("text like '%''%'").count() == 0
    df.limit(3).write.parquet(str(tmp_path / "d"))
    df.write.parquet(str(tmp_path / "e"))
    sinks.merge(spark, [str(tmp_path / "e"), str(tmp_path / "d")], str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2052
    sinks.fixed_rows(df.coalesce(1), str(tmp_path / "f"), 1000)
    assert len(list((tmp_path / "f").glob("*.parquet"))) == 3
    sinks.near_equal(df, str(tmp_path / "n"), "k", 4)
    assert len(list((tmp_path / "n").glob("part=*"))) == 4
    sinks.keep_or_write(df.limit(1), str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).count() == 2049
    sinks.result_csv(df.select("k", "text"), str(tmp_path / "r"))
    assert files.read_dictionary(spark, str(tmp_path / "r")).count() == 2049
    sinks.jsonl_per_file(df.select("k", "split"), str(tmp_path / "j"), "split")
    assert spark.read.json(str(tmp_path / "j")).count() == 2049
    moved = sinks.dry_run(files.listing(spark, str(tmp_path / "r")), str(tmp_path), "out").collect()
    assert all(x.target.startswith("out/r/") for x in moved)


def test_ordinals_of_many_buckets(spark):
    import random

    from korrel.ordering import hash_ordinal, ordinal

    rng = random.Random(3)
    rows = [(None if i % 11 == 0 else "hot" if i % 3 else rng.choice("abcdef"), i) for i in rng.sample(range(20_000), 6000)]
    df = spark.createDataFrame(rows, "s string, i bigint")
    got = [(r.s, r.i) for r in ordinal(df, ["s", "i"], bucket_rows=20).orderBy("pos").collect()]
    assert got == sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert sorted(r.pos for r in hash_ordinal(df, 1, ["i"], bucket_rows=2).collect()) == list(range(6000))
    per = hash_ordinal(df, 1, ["i"], groups=["s"], bucket_rows=2).groupBy("s").agg(F.max("pos").alias("m"), F.count("*").alias("n")).collect()
    assert all(r.m == r.n - 1 for r in per)
    assert ordinal(df.limit(0), ["s", "i"]).count() == 0


def test_buckets_stay_below_their_bound(spark, monkeypatch):
    from korrel import ordering

    seen = []
    number = ordering._number
    monkeypatch.setattr(ordering, "_number", lambda df, bucket, *a: seen.append(df.groupBy(bucket).count().agg(F.max("count")).collect()[0][0]) or number(df, bucket, *a))
    df = spark.range(30_000).withColumn("s", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")))
    ordering.ordinal(df, ["s", "id"], bucket_rows=100)
    ordering.hash_ordinal(df, 7, ["id"], bucket_rows=100)
    assert max(seen) <= 400


def test_eos_of_short_long_and_exact_texts(spark):
    """Five lengths about a limit of 64: short, long, 10 below, exact, 50 above; EOS ends every one, once."""
    limit, eos, pad = 64, 1, 2
    rows = [(i, [7] * n) for i, n in enumerate((5, 500, limit - 10, limit, limit + 50))] + [(5, [7] * 9 + [eos]), (6, [])]
    df = spark.createDataFrame(rows, "i int, ids array<int>")
    cut = {x.i: x.a for x in df.select("i", c.truncated_eos("ids", limit, eos).alias("a")).collect()}
    for i, ids in rows:
        assert cut[i][-1] == eos and cut[i].count(eos) == 1 and len(cut[i]) == min(limit, len(ids) + (eos not in ids))
        assert cut[i][:-1] == ids[: len(cut[i]) - 1]
    last = df.select("i", F.explode(c.pieces("ids", limit)).alias("p")).select("i", c.pad(c.truncated_eos("p", limit, eos), limit, pad).alias("a")).collect()
    assert all(len(x.a) == limit and eos in x.a for x in last)


def test_vocabulary_shipped_and_joined_agree(spark):
    from korrel.operators import vocabulary as v

    df = spark.createDataFrame([(1, "a b a c"), (2, None), (3, ""), (4, "zz  b")], "k int, text string")
    table = v.build(df, "text", 2)
    shipped, joined = ({r.k: r.input_ids for r in v.encode(df, ["k"], "text", table, n).collect()} for n in (10, 1))
    assert shipped == joined == {1: [5, 6, 5, 1], 2: [], 3: [], 4: [1, 6]}


def test_corrections_shipped_and_joined_agree(spark):
    df = spark.createDataFrame([(1, "Een stenoose, (stenoose) is"), (2, None), (3, ""), (4, "  x ")], "k int, t string")
    rows = spark.createDataFrame([("stenose", "stenoose"), ("stenose", "stenoose"), (None, "x"), ("q", None)], "seed string, word string")
    table = r.dictionary(rows)
    mapped = {x.k: x.t for x in df.select("k", r.correct(F.col("t"), table).alias("t")).collect()}
    assert mapped == {x.k: x.t for x in r.correct_joined(df, "k", "t", rows).collect()}
    assert mapped[1] == "Een stenose, (stenose) is" and mapped[2] is None


def test_tokenizer_cleaning(spark):
    from korrel.functions import stable

    assert stable.tokenizer_text("ja " * 9 + "nee!!!!!!  x") == "ja nee! x"
    assert stable.apply_until_stable(stable.re.compile("aa"), "a", "a" * 64, 3) == "a" * 8
    assert stable.repair_text("crÃƒÂ¨me, patiÃ«nt") == "crème, patiënt" and stable.repair_text("Één – “x”") == "Één – “x”"
    df = spark.createDataFrame([("crÃ¨me  ha ha",), (None,), ("",)], "t string")
    got = [x.t for x in df.select(t.clean("t", stable.repair_encoding).alias("t")).collect()]
    assert got == ["crème ha", None, ""]


def test_cosine_and_contrast_edges(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([3.0, 4.0], [6.0, 8.0]), ([0.0], [1.0]), ([1.0], [1.0, 2.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [x.c for x in df.select(m.cosine("a", "b").alias("c")).collect()] == [0.0, 1.0, 0.0, None, None]
