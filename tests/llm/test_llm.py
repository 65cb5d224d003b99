"""Operators of the llm subpackage against brute force, round trips and literal cases."""

import os
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from korrel.llm import bpe, mix, mojibake, overlap, pack, pii, split, stuffing
from korrel.llm.queries import QUERIES, SQL
from korrel.llm.tagger import LABELS, BiLstmCrf, encode
from tests.oracle import database, same

DOCS = "doc_id bigint, text string, split string, source string, x string"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    df = QUERIES[name](spark, data)
    if name in SQL:
        same(df, database(data), SQL[name])
    else:
        rows = df.collect()
        assert rows and all(len(r) == len(df.columns) for r in rows)
        keys = [c for c in ("origin", "rec_id", "doc_id", "doc_id_a", "doc_id_b", "kind", "piece_ix", "container_id", "copy", "source", "method", "split", "eval_class", "train_class") if c in df.columns]
        assert len({tuple(r[c] for c in keys) for r in rows}) == len(rows)


# -- 2: garbled text ---------------------------------------------------------------------------------------------------

DUTCH = "De patiënt kreeg – na één week – crème; geïndiceerde coördinatie kost € 45 bij 37 °C, naïef. Categorieën ‘zeer ernstig’."


def garble(text, charset):
    table = mojibake.TABLES[charset][0]
    shown = {b: c for c, b in table.items() if len(c) == 1}
    return "".join(chr(b) if b < 128 else shown[b] for b in text.encode())


@pytest.mark.parametrize("charset", ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "koi8-r", "cp866"])
def test_garbled_round_trip(charset):
    fixed, n, whole = mojibake.repair(garble(DUTCH, charset))
    assert n and whole and fixed == DUTCH


@pytest.mark.parametrize("text", ["привет как дела на этой неделе", "Ελληνικά και ο ασθενής", "зелёный цвет в нём", "日本語の要約です", "שלום לך"])
@pytest.mark.parametrize("charset", ["cp1252", "latin-1"])
def test_garbled_foreign_scripts(text, charset):
    fixed, n, whole = mojibake.repair(garble(text, charset))
    assert n and fixed == text and mojibake.repair(text)[:2] == (text, 0)


def test_garbled_twice_and_single():
    fixed, n, _ = mojibake.repair(garble(garble("geëvalueerde crème, één", "cp1252"), "cp1252"))
    assert n and fixed == "geëvalueerde crème, één"
    many = "crème"
    for _ in range(7):
        many = garble(many, "latin-1")
    assert mojibake.repair(many)[::2] == ("crème", True)
    assert mojibake.repair("Ã  la carte bij patiÃ«nten, Ã 17 µl")[0] == "à la carte bij patiënten, à 17 µl"
    assert mojibake.repair("de cliënt \x91voelt\x92 zich \x80 5")[0] == "de cliënt ‘voelt’ zich € 5"
    assert mojibake.repair("De patiÙnt met r÷ntgenfoto en ma´szetmeel")[0] == "De patiënt met röntgenfoto en maïszetmeel"
    fixed, n, whole = mojibake.repair("pati�nt")
    assert n and not whole


@pytest.mark.parametrize("text", ["", DUTCH, "Русский реферат: пациент № 9083, «СССР»", "Δοκιμή 96: ασθενής, β-coëfficiënt, Δ6 µm, κ", "日本語の要約：患者625名", "मरीज़ 742", "«CAFÉ» SÃO ÂGE ≥ 50 À jour", "crème crème", "&eacute; \\u00e9 %C3%A9", "🎉🙂👩🏽‍⚕️ ❤️", "34 TO 260 ΜG/L", "½ ² № ™ ® ©", "cm³ 5 m² 3÷4"])
def test_proper_text_is_left(text):
    assert mojibake.repair(text)[:2] == (text, 0)


def test_well_formed_agrees_with_decoder():
    rng = random.Random(3)
    for _ in range(3000):
        data = [rng.choice([0x80, 0x90, 0x9F, 0xA0, 0xBF, 0xC1, 0xC2, 0xDF, 0xE0, 0xE1, 0xED, 0xEF, 0xF0, 0xF1, 0xF4, 0xF5]) for _ in range(rng.randint(1, 5))]
        n = mojibake.well_formed(data, 0)
        want = 0
        for k in (2, 3, 4):
            try:
                if len(bytes(data[:k]).decode()) == 1 and len(data) >= k:
                    want = k
            except UnicodeDecodeError:
                pass
        assert n == want


# -- 3: personal data --------------------------------------------------------------------------------------------------


def test_pii_literal(spark):
    texts = ["Naam: Femke Quelrinpoel, BSN 999958203, tel. 06-08639423.", "Adres: Vlaswielsingel 287-II, 2028 SD Vliesenvoort", "Vragen: j.jansen[at]zorgpost[punt]example graag.", "De ziekte van Plutelkamp wordt tot dezelfde groep gerekend.", "Accessienummer 20195395009, serie 12, beeld 236.", "", None, "Vergelijking met 22-11-2018: onveranderd.", "Patiënt [NAAM] woont op [ADRES]."]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id bigint, text string, kinds string")
    got = {r.rec_id: r for r in pii.find_pii(df, "doc_id", "text").collect()}
    assert set(got) == {0, 1, 2}
    assert got[0].kinds == ["idnum", "name", "phone"] and got[1].kinds == ["address"] and got[2].kinds == ["email"]
    assert "999958203" not in got[0].clean and got[0].clean.startswith("Naam: [NAME]")
    assert pii.find_pii(df.limit(0), "doc_id", "text").count() == 0


def test_pii_windows_cover_and_reconcile():
    for a, b in ((0, 5), (3, 163), (0, 161), (10, 1000)):
        w = pii.windows(a, b)
        assert w[0][0] == a and w[-1][1] == b and all(y[0] < x[1] for x, y in zip(w, w[1:])) and all(e - s <= pii.WINDOW for s, e in w)
    t = "Contactpersoon: echtgenoot Anouk, 0031-6-02891187. " * 40
    spans = pii.finder().find([t])[0]
    assert sum(k == "phone" for *_, k in spans) == 40


@pytest.mark.parametrize("text, name", [("The agreement was good with κ = 0.63. Mr. Hemstehorst was seen at the clinic.", "Hemstehorst"), ("Pain was stable. Mr. Kampelbaan was seen at the clinic.", "Kampelbaan"), ("Geen afwijkingen.\nT.a.v. Wensello", "Wensello"), ("Jansen belt morgen.", "Jansen"), ("Anouk is ingelicht.", "Anouk"), ("contact met de heer quelrinpoel", "quelrinpoel"), ("ik ben jan de vries", "jan de vries"), ("Gebeld door Willem.", "Willem"), ("Bel 112233 voor Piet", "Piet")])
def test_names_at_the_start_of_a_sentence(text, name):
    assert any(k == "name" and name in text[a:b] for a, b, k in pii.finder().find([text])[0])


def test_plain_address_and_eponym():
    text = "woont Kerkstraat 12"
    assert [(text[a:b], k) for a, b, k in pii.finder().find([text])[0]] == [("Kerkstraat 12", "address")]
    assert pii.finder().find(["De ziekte van Parkinson is zeldzaam."])[0] == []


def test_tagger_reads_whole_texts():
    seen = []

    class Spy(pii.Finder):
        def label(self, encoded):
            seen.extend(len(e) for e in encoded)
            return super().label(encoded)

    text = "".join(f"geen bijzonderheden {'abcdefghij'[i % 10] * (i // 10 + 1)} bij dit onderzoek " for i in range(40))
    Spy().find([text, None, ""])
    assert sum(seen) >= len(text)


def test_crf_decode_is_the_best_path():
    rng = np.random.default_rng(1)
    model = BiLstmCrf.fresh(4, 1)
    model.p["T"] = rng.normal(0, 1, model.p["T"].shape).astype(np.float32)
    scores = rng.normal(0, 1, (4, len(LABELS), 1)).astype(np.float32)
    from itertools import product

    from korrel.llm.tagger import _FORBIDDEN

    move = model.p["T"] + _FORBIDDEN
    value = lambda p: sum(scores[t, p[t], 0] for t in range(4)) + model.p["start"][p[0]] + sum(move[p[t - 1], p[t]] for t in range(1, 4))
    best = max(product(range(len(LABELS)), repeat=4), key=value)
    assert tuple(model.decode(scores)[:, 0]) == best


def test_decode_of_many_is_the_plain_walk():
    from korrel.llm.tagger import _FORBIDDEN

    rng = np.random.default_rng(2)
    model = BiLstmCrf.fresh(3, 4)
    for _ in range(40):
        model.p["T"] = rng.normal(0, 0.5, model.p["T"].shape).astype(np.float32)
        model.p["start"] = rng.normal(0, 0.5, len(LABELS)).astype(np.float32)
        scores = rng.normal(0, 3, (rng.integers(1, 20), len(LABELS), 8)).astype(np.float32)
        scores[:, 0] += rng.normal(5, 5, (scores.shape[0], 8))
        got, move = model.decode(scores), model.p["T"] + _FORBIDDEN
        worth = lambda p, j: sum(scores[t, l, j] for t, l in enumerate(p)) + model.p["start"][p[0]] + sum(move[a, b] for a, b in zip(p, p[1:]))
        for j in range(8):
            best = [(model.p["start"][l] + scores[0, l, j] - 1e4 * (LABELS[l][0] == "I"), [l]) for l in range(len(LABELS))]
            for t in range(1, len(scores)):
                best = [max((v + move[p[-1], l] + scores[t, l, j], [*p, l]) for v, p in best) for l in range(len(LABELS))]
            assert abs(worth(got[:, j].tolist(), j) - max(best)[0]) < 1e-3


def test_units_are_whole_texts_and_do_not_depend_on_neighbours():
    texts = ["", "Naam:\nJansen. Zie Mr. Smit! 22 mm. Plak\n\nx", "  \n a. b", "Torfwielstr. 104 te Ede", DUTCH, "\n"]
    units, laid = pii.units_of(texts)
    for t, ids in zip(texts, laid):
        alone, mine = pii.units_of([t])
        assert [units[i] for i in ids] == [alone[i] for i in mine[0]] and sum(len(units[i]) for i in ids) == len(t)
    assert len(laid[1]) == 5 and len(laid[3]) == 1
    found = pii.finder().find(texts * 3)
    assert found[: len(texts)] == found[-len(texts) :] == [pii.finder().find([t])[0] for t in texts]


def test_windows_are_read_as_if_alone(monkeypatch):
    from korrel.llm import tagger

    rng, model = np.random.default_rng(4), pii.finder().model
    texts = ["", "Adres: Boterbergdreef nr. 15", "Adres: Boterbergdreef nr. 15 te Ede", "Bel Jan de Vries, tel. 0612345678", "Jan de Vries", DUTCH[:300], "x"]
    texts += [t[int(a) :] + t[: int(b)] for t in texts for a, b in rng.integers(0, 30, (3, 2))]
    windows = [encode(t) for t in [*texts, *texts[::-1]]]
    want = [model.decode(model.emissions(x[:, None]))[:, 0] if len(x) else x for x in windows]
    assert any(y.any() for y in want)
    for got in (model.paths(windows), model.paths(windows, 3), pii.finder().label(windows)):
        assert all(np.array_equal(a, b) for a, b in zip(got, want))
    monkeypatch.setattr(tagger, "READ", 40)
    assert all(np.array_equal(a, b) for a, b in zip(model.paths(windows), want))


def test_groups_share_memory_that_is_written_over(monkeypatch):
    from korrel.llm import tagger

    rng, model = np.random.default_rng(5), pii.finder().model
    scores, sizes = rng.normal(0, 3, (9, len(LABELS), 6)).astype(np.float32), np.array([1, 2, 2, 5, 9, 9])
    used = rng.normal(0, 1e3, scores.shape).astype(np.float32)
    for a, b, n in zip(model.decode(scores, sizes).T, model.decode(scores, sizes, used).T, sizes):
        assert np.array_equal(a[:n], b[:n])
    windows = [encode(t) for t in ("Bel Jan de Vries, tel. 0612345678", "x", "", "Adres: Boterbergdreef nr. 15 te Ede", DUTCH[:200])]
    want = model.paths(windows)
    monkeypatch.setattr(tagger, "CELLS", 40)
    assert any(y.any() for y in want) and all(np.array_equal(a, b) for a, b in zip(model.paths(windows), want))


def test_unit_ends_at_white_space_of_any_form():
    texts = ["  Geen bijzonderheden.\n", "\n\n", "a", "Goed herstel.   ", "  \n x\n \ny z", "Goed herstel.\t\n Bel  Jan"]
    units, laid = pii.units_of(texts)
    assert [[len(units[i]) for i in ids] for ids in laid] == [[23], [2], [1], [16], [8, 3], [16, 8]]


def test_shared_beginnings_are_read_once():
    model, words = BiLstmCrf.fresh(3, 2, 1), [encode(t) for t in sorted(["abc", "abcd", "abx", "b", "abc"])]
    size = np.array([len(x) for x in words])
    scores, at = model._read(np.concatenate(words), np.cumsum(size) - size, size, "f")
    assert len(scores) == len({w.tobytes()[:n] for w in words for n in range(1, len(w) + 1)})
    assert np.allclose(scores[at[: size[0]]], np.einsum("kh,thb->tk", model.p["Of"], model._forward(model._inputs(words[0][:, None]), "f", [])), atol=1e-5)


def test_pieces_do_not_follow_the_batches(monkeypatch):
    monkeypatch.setattr(pii, "CHARS", 10)
    rows = [(i, "x" * n) for i, n in enumerate([3, 4, 4, 25, 1, 9, 1])]
    got = [keys for keys, _ in pii.pieces(iter(rows))]
    assert got == [[0, 1], [2], [3], [4, 5], [6]] and not list(pii.pieces(iter([])))


def test_gradients():
    model, rng = BiLstmCrf.fresh(5, 4, 2), np.random.default_rng(0)
    for k in model.p:
        model.p[k] = model.p[k] + rng.normal(0, 0.3, model.p[k].shape).astype(np.float32)
    x, y = rng.integers(32, 127, (9, 3)), np.zeros((9, 3), np.int64)
    y[2:5, 1], y[6, 2] = [1, 2, 2], 9
    _, grads = model.loss_and_grads(x, y)
    for k, p in model.p.items():
        for _ in range(4):
            at = (x[rng.integers(9), rng.integers(3)], rng.integers(4)) if k == "emb" else tuple(rng.integers(0, n) for n in p.shape)
            was, step = p[at], 1e-2
            p[at] = was + step
            high = model.loss_and_grads(x, y)[0]
            p[at] = was - step
            low = model.loss_and_grads(x, y)[0]
            p[at] = was
            assert abs((high - low) / (2 * step) - grads[k][at]) < 3e-3


def test_scores_of_the_run_are_those_of_the_training():
    model, x = BiLstmCrf.fresh(6, 5, 3), np.random.default_rng(1).integers(0, 128, (17, 4))
    f, b = (model._forward(model._inputs(x), d, []) for d in "fb")
    assert np.allclose(model.emissions(x), model.p["Of"] @ f + model.p["Ob"] @ b + model.p["c"][:, None], atol=1e-5)


# -- 4: splitting ------------------------------------------------------------------------------------------------------


def test_sparse_table_against_scan():
    rng = np.random.default_rng(2)
    s = rng.integers(0, 4, 200).astype(np.int8)
    table = split.StrongestCut(s, 90)
    for a in range(0, 110, 3):
        for b in range(a, a + 90, 7):
            want = max(range(a, b + 1), key=lambda i: (s[i], i))
            assert table.query(a, b) == want


@pytest.mark.parametrize("text", ["x" * 9000, "Zin een. Zin twee.\n\nAlinea. " * 400, "\r\n" * 4000, "é漢🙂 " * 2500])
def test_pieces_cover(text):
    cuts = split.cut_points(split.text_strength(text), 3000, 200)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text) and all(e - s <= 3000 for s, e in cuts)
    assert all(b[0] == a[1] - 200 for a, b in zip(cuts, cuts[1:]))


def test_cut_prefers_paragraphs_then_sentences():
    text = "a" * 1600 + ".\n\n" + "b" * 900 + ". " + "c " * 2000
    assert split.cut_points(split.text_strength(text), 3000, 200)[0][1] == 1603
    text = "a" * 2000 + ". " + "c " * 2000
    assert split.cut_points(split.text_strength(text), 3000, 200)[0][1] == 2002


def test_boundary_in_the_first_half_is_taken():
    text = "woord " * 123 + "x" * 2538 + " " + "nog " * 300
    assert split.cut_points(split.text_strength(text), 3000, 200)[0] == (0, 738)
    ids = np.full(900, 5)
    ids[99] = 13
    assert split.cut_points(split.id_strength(ids), 512, 64)[0] == (0, 100)
    assert split.cut_points(split.text_strength("a " * 50 + "x" * 5000), 3000, 200)[0] == (0, 3000)


def test_split_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 3000), (4, "y" * 3001)], "doc_id bigint, text string")
    assert {r.rec_id for r in split.split_texts(df).collect()} == {4}
    items = spark.createDataFrame([(1, None, None), (2, [], []), (3, [5] * 600, [1] * 512 + [0] * 88), (4, [5] * 600, None), (5, [2] * 90 + [7] * 513, None)], "item_id bigint, input_ids array<int>, attention_mask array<int>")
    got = split.split_ids(items).collect()
    assert {r.rec_id for r in got} == {4, 5} and all(len(r.input_ids) <= 512 for r in got)


# -- 5: packing --------------------------------------------------------------------------------------------------------


def check_plan(histogram, plan, capacity):
    slots, bins = plan(histogram, capacity)
    room = [capacity] * bins
    for n, count in histogram.items():
        for o in range(count):
            hit = [x for x in slots if x[0] == n and x[1] <= o < x[2]]
            assert len(hit) == 1
            _, first, _, shift, per, base = hit[0]
            room[base + (o - first + shift) // per] -= n
    assert min(room, default=0) >= 0 and all(r < capacity for r in room)
    return bins


def test_plans_place_every_item_once():
    rng = random.Random(5)
    for _ in range(60):
        capacity = rng.choice([7, 16, 32])
        histogram = {n: rng.randint(1, 25) for n in rng.sample(range(1, capacity + 1), rng.randint(1, capacity))}
        total = sum(n * c for n, c in histogram.items())
        pure, refined = (check_plan(histogram, p, capacity) for p in (pack.harmonic_slots, pack.refined_slots))
        assert -(-total // capacity) <= refined <= pure


def test_pack(spark):
    rows = [(1, [1, 2, 3], [1, 1, 0]), (2, None, None), (3, [], None), (4, [9] * 20, None), (5, [2, 2, 8], None), (6, [7] * 8, None)]
    items = spark.createDataFrame(rows, "item_id bigint, input_ids array<int>, attention_mask array<int>")
    got = pack.pack(items, capacity=8).collect()
    assert sorted(x for r in got for x in r.input_ids) == sorted([1, 2] + [9] * 20 + [8] + [7] * 8)
    assert all(r.used == len(r.input_ids) <= 8 for r in got) and len(got) == 4
    assert pack.pack(items.limit(0)).count() == 0


def test_pack_of_many_groups(spark, monkeypatch):
    monkeypatch.setattr(pack, "GROUP_ITEMS", 300)
    rng = random.Random(4)
    rows = [(i, [i % 50 + 3] * (7 if i % 3 else rng.randint(1, 150)), None) for i in range(2000)]
    items = spark.createDataFrame(rows, "item_id bigint, input_ids array<int>, attention_mask array<int>")
    got = pack.pack(items, capacity=64).collect()
    want = {(i, f): ids[f * 64 : f * 64 + 64] for i, ids, _ in rows for f in range(-(-len(ids) // 64))}
    seen = {}
    for r in got:
        assert r.used == len(r.input_ids) <= 64 and r.n_items == len(r.members)
        at = 0
        for m in r.members:
            seen[(m.item_id, m.frag_ix)] = r.input_ids[at : at + m.n]
            at += m.n
    assert seen == want and len({r.container_id for r in got}) == len(got)
    report = {r.method: r for r in pack.fill_report(items, capacity=64).collect()}
    assert report["harmonic_refined"].containers == len(got) <= report["harmonic"].containers and report["harmonic_refined"].fill > 0.9


# -- 6: overlaps -------------------------------------------------------------------------------------------------------


def brute(rows, width=3, t=0.6, least=20):
    sets = {}
    for k, text, sp, *_ in rows:
        ws = overlap.words_of(text or "")
        if sp in ("train", "validation", "test") and len(ws) >= least:
            sets[k] = (sp, {tuple(ws[i : i + width]) for i in range(len(ws) - width + 1)})
    return {(a, b) for a, (sa, x) in sets.items() for b, (sb, y) in sets.items() if sa != "train" and sb == "train" and len(x & y) >= t * len(x | y) - 1e-12}


def test_overlap_against_brute_force(spark):
    rng = random.Random(8)
    base = [[f"w{rng.randint(0, 60)}" for _ in range(rng.randint(20, 60))] for _ in range(12)]
    rows = []
    for i in range(260):
        ws = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
            ws[rng.randrange(len(ws))] = f"v{rng.randint(0, 400)}"
        rows.append((i, rng.choice([" ", ", ", "\n"]).join(ws).upper() if i % 2 else " ".join(ws), rng.choice(["train", "train", "test", "validation", None, "other"]), "s", "x"))
    rows += [(900, "zo " * 50, "train", "s", ""), (901, "zo " * 40, "test", "s", ""), (902, None, "train", "s", ""), (903, "", "test", "s", "")]
    rows += [(1000 + i, " ".join(base[0]), "train", "hot", "") for i in range(120)]
    df = spark.createDataFrame(rows, DOCS)
    got = [(r.eval_id, r.train_id) for r in overlap.cross_split_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert overlap.cross_split_pairs(df.limit(0)).count() == 0
    member, pairs = overlap.classes(df)
    assert sum(r.eval_copies * r.train_copies for r in pairs.collect()) == len(got) and pairs.count() * 4 < len(got)
    hot = {r.class_id for r in member.filter("doc_id >= 1000").collect()}
    assert len(hot) == 1
    assert overlap.report(df).agg(F.sum("pairs")).collect()[0][0] == len(got)
    exact = overlap.exact_counts(df).agg(F.sum("pairs")).collect()[0][0]
    canon = {}
    for k, text, sp, *_ in rows:
        ws = overlap.words_of(text or "")
        if ws and sp in ("train", "validation", "test"):
            canon.setdefault(" ".join(ws), []).append(sp)
    assert exact == sum(v.count("train") * (len(v) - v.count("train")) for v in canon.values())


def test_split_hot_triples_lose_no_pair(spark, monkeypatch):
    rng = random.Random(2)
    rows = []
    for i in range(240):  # one text in a third of the rows, each time with other words changed: all share triples
        ws = [f"w{j}" for j in range(30)] if i % 3 == 0 else [f"v{rng.randint(0, 50)}" for _ in range(30)]
        ws[rng.randrange(30)] = f"x{rng.randint(0, 99)}"
        rows.append((i, " ".join(ws), rng.choice(["train", "test"]), "s", ""))
    df = spark.createDataFrame(rows, DOCS)
    monkeypatch.setattr(overlap, "HOT_ROWS", 10)
    sides = overlap._sides(df, "split")
    counts = overlap._frequencies(overlap.signatures(sides, "doc_id", "text", 3, 20))
    assert overlap.parts_of(counts).max() > 3
    got = [(r.eval_id, r.train_id) for r in overlap.cross_split_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows) and len(got) > 500


def test_rounds_bound_the_rows_that_meet_and_lose_no_pair(spark, monkeypatch):
    rng = random.Random(5)
    rows = []
    for i in range(400):  # a template that all rows share: all pairs of rows meet
        ws = [f"w{j}" for j in range(40)]
        for _ in range(rng.choice([0, 1, 3, 6])):
            ws[rng.randrange(40)] = f"x{rng.randint(0, 999)}"
        rows.append((i, " ".join(ws), rng.choice(["train", "train", "train", "test"]), "s", ""))
    df = spark.createDataFrame(rows, DOCS)
    met, first, all_rounds = [], overlap._round, {"ROUND_TRIPLES": 0, "SLOTS": 16, "FIRST": 2, "WIDEST": 8}
    monkeypatch.setattr(overlap, "_round", lambda *x: (r := first(*x), met.append(r[1]))[0])
    want = brute(rows)

    def run(**settings):
        met.clear()
        for k, v in settings.items():
            monkeypatch.setattr(overlap, k, v)
        got = [(r.eval_id, r.train_id) for r in overlap.cross_split_pairs(df).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(got) > 500
        return list(met)

    (whole,) = run()
    wide, narrow = run(**all_rounds), run(ROUND_ROWS=whole // 6)
    assert sum(wide) == sum(narrow) == whole and len(wide) == 3 < len(narrow) and max(narrow) < whole / 2


def test_candidate_join_shuffles_three_numbers_a_row(spark, monkeypatch):
    plans, first = [], overlap.cut
    monkeypatch.setattr(overlap, "cut", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan()), first(df))[1])
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, text, "train", "s", ""), (2, text + " x", "test", "s", "")], DOCS)
    assert [tuple(r)[:2] for r in overlap.cross_split_pairs(df).collect()] == [(2, 1)]

    def joins(plan):
        below = [plan.children().apply(i) for i in range(plan.children().size())]
        return [plan] * (plan.nodeName() == "Join") + [j for p in below for j in joins(p)]

    widths = [[j.children().apply(i).output().size() for i in (0, 1)] for p in plans for j in joins(p) if "eval_rep" in j.output().toString()]
    assert widths == [[3, 3]]


def test_words():
    assert overlap.words_of("ﬁjn Één_twee 1½ ①") == ["fijn", "één", "twee", "11", "2", "1"]


def test_words_by_hash_are_the_words():
    from korrel.llm.hashing import word_hashes

    texts = ["ﬁjn Één_twee 1½ ①", None, "", "de De DE, de", DUTCH, "ΟΔΟΣ. x", "𝔞b 𠀀 🙂 c", "a\nb", "ab", "İstanbul"]
    words, n = word_hashes(texts)
    lists = [overlap.words_of(t or "") for t in texts]
    assert n.tolist() == [len(ws) for ws in lists]
    flat = [w for ws in lists for w in ws]
    assert len({(a, b) for a, b in zip(flat, words.tolist())}) == len(set(flat)) == len(set(words.tolist()))


# -- 7: encoding -------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    if not os.path.exists(bpe.VOCABULARY):
        pytest.skip("no vocabulary")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.VOCABULARY)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_encoding_is_the_librarys(tokenizer):
    b = bpe.BatchBPE()
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab a\n'sé漢1 .ST\t🙂") for _ in range(rng.randint(0, 90))) for _ in range(1500)]
    texts += ["a" * 1001, "ha" * 700, "<|endoftext|> x", DUTCH, " \n\n ", "", None]
    got = []
    for ids, n in b.blocks(texts):
        o = np.r_[0, np.cumsum(n)]
        got += [ids[o[i] : o[i + 1]].tolist() for i in range(len(n))]
    assert got == [tokenizer(t) if t else [] for t in texts]


def test_corpus_encoding(spark, tokenizer):
    df = spark.createDataFrame([(1, "Een zin.", "a"), (2, None, "b"), (3, "", "c"), (1, "Een zin.", "a")], "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in bpe.encode_corpus(df).collect())
    assert got == sorted([(1, tokenizer("Een zin.")), (2, []), (3, []), (1, tokenizer("Een zin."))])


# -- 8: mixing ---------------------------------------------------------------------------------------------------------


def test_rates():
    for mean, cap in ((0.3, 1), (1.2, 3), (2.9, 3), (0.01, 8)):
        assert abs(mix.capped_mean(mix.rate_for(mean, cap), cap) - mean) < 1e-6
    assert mix.rate_for(3, 3) == float("inf") and mix.rate_for(0, 3) == 0.0


def test_plan_of_sources(spark):
    tokens = spark.createDataFrame([("a", 100), ("b", 50), ("z", 10)], "source string, tokens bigint")
    goals = spark.createDataFrame([("a", 1.0, 2), ("b", 3.0, 4), ("c", 1.0, 1), ("d", 0.0, 5)], "source string, target_weight double, max_repeats int")
    plan = {r.source: r for r in mix.plan_rates(tokens, goals).collect()}
    assert set(plan) == {"a", "b"} and abs(sum(r.target_share for r in plan.values()) - 1) < 1e-12
    assert plan["b"].rate == float("inf") and abs(plan["b"].goal - 200) < 1e-9


def test_mixture(spark, tokenizer):
    rng = random.Random(6)
    rows = [(i, "woord " * rng.randint(1, 60), "train", "abc"[i % 3] if i % 7 else None, "") for i in range(900)]
    docs = spark.createDataFrame(rows, DOCS)
    targets = spark.createDataFrame([("a", 5.0, 2), ("b", 1.0, 1), ("c", 2.0, 3), ("none", 1.0, 2), ("a", 5.0, 2)], "source string, target_weight double, max_repeats int")
    got = {r.source: r for r in mix.shares(docs, targets).collect()}
    assert all(abs(got[s].actual_share - w / 8) < 0.02 for s, w in (("a", 5), ("b", 1), ("c", 2))) and got["none"].tokens == 0
    out = mix.mixture(docs, targets).collect()
    assert [r.shuffle_key for r in out] == sorted(r.shuffle_key for r in out)
    assert max(r["copy"] for r in out if r.source == "a") <= 2 and len({(r.doc_id, r["copy"]) for r in out}) == len(out)
    assert sum(r.n_tokens for r in out) == sum(r.tokens for r in got.values())
    assert mix.mixture(docs.limit(0), targets).count() == 0


# -- 9: stuffed pages --------------------------------------------------------------------------------------------------


def test_automaton_against_counting():
    rng = random.Random(7)
    for _ in range(80):
        runs = [[rng.randrange(3) for _ in range(rng.randint(1, 25))] for _ in range(rng.randint(1, 4))]
        for times in (2, 3):
            got = iter(stuffing.SuffixAutomaton(runs).repeated(times))
            for run in runs:
                for i in range(len(run)):
                    tail = lambda n: run[i + 1 - n : i + 1]
                    many = lambda part: sum(r[j : j + len(part)] == part for r in runs for j in range(len(r)))
                    assert next(got) == next((n for n in range(i + 1, 0, -1) if many(tail(n)) >= times), 0)


def test_coverage_against_counting():
    rng = random.Random(9)
    for _ in range(60):
        symbols, page = np.array([rng.randrange(4) for _ in range(40)]), np.sort([rng.randrange(3) for _ in range(40)])
        stop = np.cumsum([rng.randint(1, 6) for _ in range(40)])
        start = np.r_[0, stop[:-1]]
        got = stuffing.covered(symbols, start, stop, page, 3, 6)
        want = np.zeros(40, bool)
        for i in range(40):
            for j in range(i, 40):
                part = symbols[i : j + 1].tolist()
                if page[i] == page[j] and stop[j] - start[i] >= 6 and sum(symbols[k : k + len(part)].tolist() == part and page[k] == page[i] == page[k + len(part) - 1] for k in range(41 - len(part))) >= 3:
                    want[i : j + 1] = True
        assert (got == want).all()


def test_repeats_decide_beside_clauses():
    bare = "apple river stone cloud metal paper horse chair glass bread " * 2
    assert stuffing.stuffed_share(bare)[0] == 0 and stuffing.stuffed_share(bare * 2)[0] == 1
    assert stuffing.stuffed_share("kort, kort, kort, kort")[0] == 1  # pages of few words too


SPAM = [
    "brace kopen, brace bestellen, brace online, brace korting, brace review, brace kopen, brace online",
    "\n".join(f"https://www.a{i}b.example/x{i}.html" for i in range(20)),
    " ".join(f"#pil{i}kopen" for i in range(20)),
    "\n".join(f"ZALF {i}mg x{i} € {i},95 in winkelmand" for i in range(15)),
    "\n".join(f"Home > aa{i} > zalf{i} [a{i}-zorg.example]" for i in range(15)),
]
PROPER = ["De patiënt werd opgenomen wegens pijn op de borst en is na drie dagen ontslagen. " * 12, "Home > zorg > hart\nDe behandeling bestaat uit rust en een dieet dat de arts met u bespreekt. Zie www.zorg.example voor meer.", "", " ", "Start zelva 9 mg."]


def test_stuffed_pages(spark):
    rows = [(i, t, "train", "s", "") for i, t in enumerate([*SPAM, *PROPER, None])]
    got = {r.doc_id for r in stuffing.find_stuffed(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == set(range(len(SPAM)))


def test_pages_of_link_elements():
    short = " ".join(f'<a href="https://a{i}b.example/x{i}">tandarts bestellen</a>' for i in range(12))
    long_ = "\n".join(f'<li><a href="/x{i}.html">De beste tandarts van het land voor u en mij, nummer {i}? Nu ook in de stad</a></li>' for i in range(12))
    assert stuffing.stuffed_share(short)[0] == 1 and stuffing.stuffed_share(long_)[0] > 0.9
    proper = "<p>De patiënt werd opgenomen wegens pijn op de <b>borst</b> en is na <a href='/x'>drie dagen</a> ontslagen.</p> " * 12
    assert stuffing.stuffed_share(proper)[0] == 0


def test_failing_import_is_seen(monkeypatch):
    import sys

    import __spark_entry__

    monkeypatch.setitem(sys.modules, "korrel.llm.queries", None)
    with pytest.raises(ImportError):
        __spark_entry__.queries()


def test_core_does_not_import_llm():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, names in os.walk(os.path.join(root, "korrel")):
        if os.path.basename(folder) != "llm":
            for n in names:
                if n.endswith(".py"):
                    assert "korrel.llm" not in open(os.path.join(folder, n), encoding="utf-8").read()


def test_normal_form():
    assert unicodedata.normalize("NFC", DUTCH) == DUTCH


# -- nulls in every column, clashing names, one long text, one hot source ------------------------------------------------


def test_nulls_and_clashing_names(spark):
    names = "doc_id bigint, text string, split string, source string, ids int, n int, copies int, u double, cdf int, class_id int, counts int, stuffed int, unit int, c1 int, is_train boolean, kinds int, places int, rec_id int, k int, n_tokens int"
    body = "De patiënt kwam met klachten van moeheid en werd na enkele weken weer gezien op de polikliniek door dezelfde arts. "
    rows = [(None, body * 2, "train", "a"), (1, body * 2, "test", "a"), (2, None, None, None), (3, "", "train", None), (4, "kopen, bestellen, " * 9, "train", "b")]
    df = spark.createDataFrame([(*r, *(None,) * (len(names.split(", ")) - 4)) for r in rows], names)
    assert {r.doc_id for r in stuffing.find_stuffed(df).collect()} == {4}
    assert mojibake.find_garbled(df).count() == 0 and pii.find_pii(df, "doc_id", "text").count() == 0
    member, pairs = overlap.classes(df)
    assert member.count() == 2 and [(r.eval_copies, r.train_copies, r.similarity) for r in pairs.collect()] == [(1, 1, 1.0)]
    targets = spark.createDataFrame([("a", 1.0, 1), (None, None, None), ("b", None, 2), ("c", 2.0, None)], "source string, target_weight double, max_repeats int")
    got = {r.source: r for r in mix.shares(df, targets).collect()}
    assert set(got) == {"a", "b", "c"} and got["a"].docs == 2 and got["b"].tokens == 0
    assert {r.source for r in mix.mixture(df, targets).collect()} <= {"a"}
    assert {r.doc_id: r.ids for r in bpe.encode_corpus(df).collect()}[2] == []


def test_containers_with_null_keys_and_clashing_names(spark):
    rows = [(None, [1, 2], None, 0, 0, 0), (None, [3], [1], 0, 0, 0), (1, None, None, 0, 0, 0), (2, [None, 5], [1, None], 0, 0, 0)]
    items = spark.createDataFrame(rows, "item_id bigint, input_ids array<int>, attention_mask array<int>, n int, ids int, container_id int")
    got = pack.pack(items, capacity=4).collect()
    assert sum(r.used for r in got) == sum(len(r.input_ids) for r in got) and all(r.used <= 4 for r in got)
    assert split.split_ids(items).count() == 0


def test_one_very_long_text(spark):
    text = "De patiënt heeft pijn en krijgt rust en dieet. " * 60_000 + "Gebeld door Willem."
    df = spark.createDataFrame([(1, text, "train", "s", ""), (2, "x" * 400_000, "test", "s", "")], DOCS)
    assert {(r.rec_id, tuple(r.kinds)) for r in pii.find_pii(df, "doc_id", "text").collect()} == {(1, ("name",))}
    assert stuffing.find_stuffed(df).count() == 0
    assert split.split_texts(df).filter("length(text) > 3000").count() == 0


def test_one_text_and_one_source_in_a_third_of_the_rows(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    hot = " ".join(word() for _ in range(40))
    rows = [(i, hot if i % 3 == 0 else " ".join(word() for _ in range(40)), "test" if i % 2 else "train", "hot" if i % 3 == 0 else f"s{i % 40}", "") for i in range(1200)]
    df = spark.createDataFrame(rows, DOCS)
    member, pairs = overlap.classes(df)
    row = pairs.collect()
    assert len(row) == 1 and (row[0].eval_copies, row[0].train_copies) == (200, 200)
    assert member.count() == 1200 and member.filter(f"class_id in ({row[0].eval_class}, {row[0].train_class})").count() == 400
    assert overlap.cross_split_pairs(df).count() == 40_000
