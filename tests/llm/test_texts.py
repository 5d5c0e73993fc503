import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from stratamem.llm import leaks, mixing, personal_data as pd_, splitting, visual_forms as vf

# ---- personal data


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Write to anna.b+news@mail.example.org.", [("email", "anna.b+news@mail.example.org")]),
        ("reach me at anna [at] mail [dot] example", [("email", "anna [at] mail [dot] example")]),
        ("anna at mail dot example", [("email", "anna at mail dot example")]),
        ("See you @ 9, the file is cover@2x.png, I am @anna", []),
        ("phone +44 (0)20 7946 0519 / backup (617) 555-0153", [("phone", "+44 (0)20 7946 0519"), ("phone", "(617) 555-0153")]),
        ("Ring me (4155550194) or 030/23125-018 or 617.555.0107", [("phone", "4155550194"), ("phone", "030/23125-018"), ("phone", "617.555.0107")]),
        ("tel:+16175550165 ext. 12", [("phone", "+16175550165 ext. 12")]),
        ("Score 555-023, order 9469-99-4856-7, due 2021-04-14, 7,527.16, version 7.54.7, ISBN 000-0-785584-465-0", []),
        ("My passport number is XK5640573", [("identity", "XK5640573")]),
        ("SSN 904-26-9981, NI number: QQ 39 22 72 A", [("identity", "904-26-9981"), ("identity", "QQ 39 22 72 A")]),
        ("Tracking says ZZ106023866XX. Serial 6557/5616/1814", []),
        ("At Flat 2, 244 Willow Road, Dale KQ29 1AE now", [("address", "Flat 2, 244 Willow Road, Dale KQ29 1AE")]),
        ("233, rue des Bancs or Hauptstr. 5 or Calle Luna 149", [("address", "233, rue des Bancs"), ("address", "Hauptstr. 5"), ("address", "Calle Luna 149")]),
        ("P.O. Box 7843, Lanth", [("address", "P.O. Box 7843, Lanth")]),
        ("Street food on Glass Street, a 41 minutes walk down the street, Box 489 is empty", []),
        ("", []),
    ],
)
def test_structured_items(text, want):
    assert [(k, text[s:e]) for s, e, k in pd_.structured_items(text)] == want


def _find(spark, texts, hints):
    df = spark.createDataFrame([("turns", i, t, "x") for i, t in enumerate(texts)], "rec_table string, rec_id int, text string, terms string")
    names = spark.createDataFrame(hints, "name string, name_part string")
    return {r["rec_id"]: r for r in pd_.find_items(df, names).collect()}


def test_names_by_disclosure(spark):
    corpus = [f"My name is {x}." for x in ("Anna", "Boris", "Clara", "Quilla", "Quilla")] + [f"I met {x} at the office." for x in ("Anna", "Boris", "Clara", "Katarina Novak", "Katarina Novak")]
    asked = {
        "Yesterday Katarina Novak and the others had lunch.": ["Katarina Novak"],
        "My name is Hope.": ["Hope"],
        "I saw Hope Marl.": ["Hope Marl"],
        "Hope this helps.": [],
        "The Marl Foundation closed.": [],
        "We live at 5 Marl Street.": [],
        "marl, they say": [],
        "Ask Dr. Marl about it.": ["Marl"],
        "O. Marl at the office": [],
        "Wanda walked": [],
        "My name is anna marl.": ["anna marl"],
    }
    texts = corpus + ["Hope this helps."] * 3 + [None, ""] + list(asked)
    got = _find(spark, texts, [("Hope", "given"), ("Anna", "given"), ("Boris", "given"), ("Clara", "given"), ("Marl", "family"), (None, None)])
    items = [None if got[i]["items"] is None else [t[x["start_pos"] : x["end_pos"]] for x in got[i]["items"] if x["kind"] == "name"] for i, t in enumerate(texts)]
    assert items[:10] == [["Anna"], ["Boris"], ["Clara"], ["Quilla"], ["Quilla"], ["Anna"], ["Boris"], ["Clara"], ["Katarina Novak"], ["Katarina Novak"]]
    assert items[10:15] == [[], [], [], None, []]
    wrong = {t: (x, asked[t]) for t, x in zip(texts[15:], items[15:]) if x != asked[t] and t != "O. Marl at the office"}
    assert not wrong
    assert got[8]["sanitized"] == "I met [NAME] at the office." and got[13]["sanitized"] is None and got[14]["sanitized"] == ""


def test_repeated_records_are_each_searched(spark):
    df = spark.createDataFrame([("turns", 1, "a@b.example", 0), ("turns", 1, "a@b.example", 0), ("turns", None, "call 415-555-0194", 0)], "rec_table string, rec_id int, text string, row int")
    rows = pd_.find_items(df, spark.createDataFrame([], "name string, name_part string")).collect()
    assert sorted(len(r["items"]) for r in rows) == [1, 1, 1]


def test_personal_data_of_nothing(spark):
    assert _find(spark, [], [("Hope", "given")]) == {}


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=80))
def test_any_text_is_sanitized_outside_items_only(t):
    items = pd_.structured_items(t)
    clean = pd_.sanitized(t, items)
    assert all(0 <= s < e <= len(t) for s, e, _ in items)
    if not items:
        assert clean == t


def test_local_phone_numbers_behind_a_cue():
    for t, n in (("call me on 555 0173 later", "555 0173"), ("tel: 4455 6677", "4455 6677"), ("Dial 555-0173.", "555-0173")):
        assert [(t[s:e], k) for s, e, k in pd_.structured_items(t)] == [(n, "phone")]
    for t in ("order 555 0173 came", "call on 2024-05-17", "we counted 4455 6677 of them"):
        assert pd_.structured_items(t) == []


# ---- splitting


def _check(text, pieces, limit, overlap):
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (s, e), (s2, e2) in zip(pieces, pieces[1:]):
        assert s < s2 <= e < e2 and e - s2 <= overlap
    assert all(0 < e - s <= limit for s, e in pieces)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abc .,\n é́👍‍中。"), min_size=1, max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_pieces_cover_and_keep_limits(text, limit, overlap):
    text = text.strip()
    if text:
        _check(text, splitting.split_offsets(text, limit, overlap), limit, overlap)


def test_boundaries_are_kept_where_possible():
    rng = random.Random(0)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) + ("." if rng.random() < 0.2 else "") for _ in range(2500))
    pieces = splitting.split_offsets(text)
    _check(text, pieces, 1000, 100)
    assert all(text[e - 1].isspace() for _, e in pieces[:-1])
    assert sum(text[e - 2] == "." for _, e in pieces[:-1]) > 0.8 * (len(pieces) - 1)
    assert len(pieces) <= 2 + -(-(len(text) - 100) // 900)
    spread = [e - s for s, e in pieces]
    assert max(spread) - min(spread) < 600


def test_graphemes_and_runs():
    text = "👍🏽" * 900
    pieces = splitting.split_offsets(text)
    _check(text, pieces, 1000, 100)
    assert all(s % 2 == 0 for s, _ in pieces)
    long = "x" * 300_000
    _check(long, splitting.split_offsets(long), 1000, 100)


def test_a_piece_overlaps_an_unbroken_run_before_its_boundary():
    text = " ".join("x" * 400 for _ in range(8))
    pieces = splitting.split_offsets(text)
    _check(text, pieces, 1000, 100)
    assert len(pieces) > 1 and all(e - s == 100 for (s, _), (_, e) in zip(pieces[1:], pieces))
    pieces = splitting.split_offsets("é".join(" " + "x" * 400 for _ in range(8)).replace("é", "e\u0301"))
    assert all(0 < e - s <= 100 for (s, _), (_, e) in zip(pieces[1:], pieces))


def test_split_table(spark):
    rows = [(1, "  " + "word " * 300 + "\n"), (2, "short"), (3, None), (4, " \t "), (1, "again"), (5, "x" * 990 + " " * 20)]
    df = spark.createDataFrame([(i, t, 9) for i, t in rows], "id long, content string, piece_no int")
    out = splitting.split_texts(df, "id", "content").collect()
    first = sorted((r for r in out if r["rec_id"] == 1 and r["piece"] != "again"), key=lambda r: r["piece_no"])
    assert first[0]["start_pos"] == 2 and all(rows[0][1][r["start_pos"] : r["end_pos"]] == r["piece"] for r in first)
    assert {r["rec_id"] for r in out} == {1, 2, 5}
    assert [r["rec_id"] for r in splitting.oversized(df, "id", "content").collect()] == [1]
    assert splitting.split_texts(df.limit(0), "id", "content").count() == 0


# ---- visual forms


@pytest.mark.parametrize(
    ("a", "b"),
    [("care", "сare"), ("Ηe", "He"), ("ｆｕｌｌ", "full"), ("é", "é"), ("a b", "a b"), ("so​ft­", "soft"), ("ﬁne", "fine"), ("пaук", "паук"), ("ё", "ë"), ("сор", "cop")],
)
def test_look_alikes_are_one(a, b):
    assert vf.consistent_form(a) == vf.consistent_form(b)


@pytest.mark.parametrize(("a", "b"), [("Case", "case"), ("é", "e"), ("l", "1"), ("O", "0"), ("a,b", "a;b"), ("a\nb", "a b")])
def test_what_differs_stays_different(a, b):
    assert vf.consistent_form(a) != vf.consistent_form(b)


def test_script_is_kept():
    assert vf.consistent_form("пaук и сок") == "паук и сок"
    assert vf.consistent_form("The сat") == "The cat"
    assert vf.verdicts("The сat паук") == (1, 0) and vf.verdicts("сор Оле") == (0, 1) and vf.verdicts("cop") == (0, 0)


def test_script_sets():
    assert vf.script_set("a") == {"Latin"} and vf.script_set("ж") == {"Cyrillic"} and vf.script_set("1") is None and {"Latin", "Greek", "Cyrillic"} <= vf.script_set("\u0301")
    assert "Japanese" in vf.resolved_scripts("日本ごカ") and vf.resolved_scripts("日a") == frozenset()
    assert vf.resolved_scripts("ա") == {"Armenian"} and vf.resolved_scripts("aա") == frozenset() and vf.resolved_scripts("12") is None
    # the script decides the spelling of what the shapes leave open
    assert vf.consistent_form("сор и жук") == "сор и жук" and vf.consistent_form("cop и жук") == "сор и жук" and vf.shapes("сор") == "cop"


def test_many_uploads_of_one_look(spark):
    rows = [(k, "care") for k in range(2000)] + [(5000, "сare"), (5001, "сare")]
    pairs = vf.look_alikes(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    assert pairs.count() == 4000


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcо оасνικé́​ﬁАВ中1"), max_size=30))
def test_form_is_stable(t):
    assert vf.consistent_form(vf.consistent_form(t)) == vf.consistent_form(t)


def test_look_alike_pairs(spark):
    rows = [(1, "care"), (2, "сare"), (3, "care"), (4, "Care"), (5, None), (6, ""), (7, "​"), (2, "сare")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, own int")
    assert {(r["doc_a"], r["doc_b"]) for r in vf.look_alikes(df, "doc_id", "text").collect()} == {(1, 2), (2, 3), (6, 7)}
    forms = {r["rec_id"]: (r["form"], r["changed"]) for r in vf.consistent_forms(df, "doc_id", "text").collect()}
    assert forms[2] == ("care", True) and forms[1] == ("care", False) and forms[5] == (None, None)


# ---- leaks

ITEM = "Keeps one velvet linenyard beside the candlefield and never dropped the hazeldial on Tuesday after the long storm had passed over town"


def _subtitles(words, per=4):
    cues = [" ".join(words[i : i + per]) for i in range(0, len(words), per)]
    return "\n".join(f"{k + 1}\n00:00:0{k % 10},000 --> 00:00:0{k % 10},900\n<i>{c}</i>\n" + ("\n7\n00:01:00,000 --> 00:01:01,000\n[music]\n" if k == 1 else "") for k, c in enumerate(cues))


def test_leaks(spark):
    w = ITEM.split(" ")
    noise = [f"noise{k}" for k in range(30)]
    hurt = list(w[2:14])
    hurt[4] = "candlefie1d"
    twice = list(w[2:14])
    twice[4], twice[7] = "cand1efie1d", "dr0pped"
    docs = {
        1: _subtitles(noise + w[2:14] + noise),
        2: _subtitles(noise + hurt + noise),
        3: _subtitles(noise + twice + noise),
        4: _subtitles(noise + w[2:12] + noise),
        5: _subtitles(w).upper(),
        6: None,
        7: "",
        8: " ".join(reversed(w)),
        9: _subtitles(noise + w[:12]).replace("o", "о"),
        10: "1 00:00:01.0 - 00:00:02.0 | " + " / ".join(w[4:18]),
    }
    items = spark.createDataFrame([(70, ITEM, "x"), (71, "too short", "x"), (None, ITEM, "x"), (72, None, "x")], "item_id long, text string, words string")
    df = spark.createDataFrame([(k, v, 1) for k, v in docs.items()] + [(1, docs[1], 1)], "doc_id long, text string, ids int")
    got = {(r["doc_id"], r["item_id"]): r["n_words"] for r in leaks.leaked_items(df, items).collect()}
    assert set(got) == {(k, 70) for k in (1, 2, 5, 9, 10)}
    assert got[(1, 70)] == 12 and got[(5, 70)] == len(w)
    assert leaks.leaked_items(df.limit(0), items).count() == 0
    assert leaks.leaked_items(df, items.where("item_id = 71")).count() == 0


def test_reworded_leaks(spark):
    w = ITEM.split(" ")
    noise = [f"noise{k}" for k in range(40)]
    reworded = list(w)
    for k in (3, 9, 15):
        reworded[k] = "else"  # no run of twelve is left
    docs = [(1, " ".join(noise + reworded + noise)), (2, " ".join(noise + [x for x in reworded if x != "hazeldial"] + noise)), (3, " ".join(noise + w[:12] + noise)), (4, " ".join(reworded[::-1]))]
    items = spark.createDataFrame([(70, ITEM, "The hazeldial!"), (71, " ".join(f"other{k}" for k in range(20)), None)], "item_id long, text string, answer string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["kind"] for r in leaks.leaked_items(df, items).collect()}
    assert got == {(1, 70): "reworded", (3, 70): "verbatim"}
    assert {r["kind"] for r in leaks.leaked_items(df, items.drop("answer")).collect()} == {"verbatim"}
    # nothing but the cosine finds candidates: over its bar there are none
    assert leaks.leaked_items(df, items, cosine=1.1).count() == 0


def test_items_in_blocks_give_the_same(spark, monkeypatch):
    w = ITEM.split(" ")
    items = [(k, " ".join(x + (str(k) if k else "") for x in w)) for k in range(6)]
    df = spark.createDataFrame([(k, "before it " + t + " and behind") for k, t in items], "doc_id long, text string")
    held = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(leaks, "ITEM_BLOCK", 2)
    assert {(r["doc_id"], r["item_id"]) for r in leaks.leaked_items(df, held).collect()} == {(k, k) for k in range(6)}


def test_latent_space_is_the_top_of_the_svd(spark):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(0)
    words = [rng.choice(30, 16, p=np.r_[np.full(3, 0.2), np.full(27, 0.4 / 27)]).astype(np.int32) for _ in range(60)]
    idf = rng.uniform(0.5, 2, 30)
    df = spark.createDataFrame([(np.r_[x, np.full(16, -1)].tolist(), [0]) for x in words], "ids array<int>, at array<int>")
    none = (pa.array([], pa.list_(pa.int32())), pa.array([], pa.list_(pa.int32())))
    space, values = leaks.latent_space(df, idf, none, rank=6)
    a = np.zeros((60, 30))
    for k, x in enumerate(words):
        np.add.at(a[k], x, idf[x])
        a[k] /= np.sqrt((idf[x] ** 2).sum())  # lengths as the passages have them
    _, want, vt = np.linalg.svd(a)
    assert np.allclose(values, want[:6], rtol=0.05)
    assert np.linalg.svd(space[:, :2].T @ vt[:2].T, compute_uv=False).min() > 0.98


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_common_subsequence(x, y):
    table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            table[i + 1][j + 1] = table[i][j] + 1 if a == b else max(table[i][j + 1], table[i + 1][j])
    bits = {c: sum(1 << j for j, b in enumerate(y) if b == c) for c in y}
    assert leaks.common_subsequence(x, bits) == table[-1][-1]


# ---- mixing


def test_plan_shares():
    sizes, targets = {"a": 100, "b": 1000}, {"a": (0.5, 2), "b": (0.5, 1), "none": (0.2, 3)}
    take = mixing.plan_shares(sizes, targets)
    assert take == pytest.approx({"a": 200, "b": 200})
    assert mixing.plan_shares(sizes, targets, 1000) == pytest.approx({"a": 200, "b": 800})
    assert mixing.plan_shares({}, targets) == {} and mixing.plan_shares(sizes, {"a": (0.0, 1)}) == {}


def test_mixture(spark):
    rng = random.Random(5)
    docs = [(i, rng.choice(["big", "big", "big", "small"]), "word " * rng.randrange(1, 60)) for i in range(800)] + [(900, None, "x"), (901, "big", None), (902, "big", ""), (903, "other", "x")]
    df = spark.createDataFrame([(i, s, t, 0.5) for i, s, t in docs], "doc_id long, source string, text string, position double")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 3), ("gone", 0.1, 2)], "source string, target_share double, max_repeats int")
    mix = mixing.mixture(df, targets, ramps={"small": 0.8}).collect()
    uses = {}
    for r in mix:
        uses[r["doc_id"]] = uses.get(r["doc_id"], 0) + 1
    source = {i: s for i, s, _ in docs}
    assert max(n for i, n in uses.items() if source[i] == "big") == 1 and max(uses.values()) <= 3
    tokens = {s: sum(r["n_tokens"] for r in mix if r["source"] == s) for s in ("big", "small")}
    assert tokens["small"] / sum(tokens.values()) == pytest.approx(0.4, abs=0.01)
    places = [r["position"] for r in mix]
    assert places == sorted(places) and 0 <= places[0] and places[-1] <= 1
    late = sum(r["n_tokens"] for r in mix if r["source"] == "small" and r["position"] > 0.5)
    assert late / tokens["small"] == pytest.approx(0.7, abs=0.05)  # the ramp of 0.8 puts 0.7 into the second half
    shares = {r["source"]: r for r in mixing.reached_shares(mixing.mixture(df, targets), targets).collect()}
    assert shares["gone"]["tokens"] == 0 and shares["gone"]["actual_share"] == 0
    assert mixing.mixture(df.limit(0), targets).count() == 0


def test_schedules():
    parts = mixing.segments([(0, 0), (0.5, 0), (1, 2)])
    assert parts == [(0.0, 0.5, 0.5, 0.0, 4.0)]
    for bad in ([(0, 1)], [(0, 1), (0.9, 1)], [(0, 1), (1, -1)], [(0, 0), (1, 0)], [(0, 1), (0.5, 1), (0.5, 2), (1, 1)]):
        with pytest.raises(ValueError):
            mixing.segments(bad)
    with pytest.raises(ValueError):
        mixing._schedules({"a": 0.9, "b": 0.1}, {"a": 0.9}, {})


def test_a_schedule_with_knots(spark):
    docs = [(i, "ab"[i % 2], "word " * (1 + i % 7)) for i in range(1200)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    mix = mixing.mixture(df, targets, schedules={"a": [(0, 0), (0.5, 0), (1, 1)]}).collect()
    early = [r for r in mix if r["source"] == "a" and r["position"] < 0.5]
    late = [r for r in mix if r["source"] == "a" and r["position"] > 0.75]
    tokens = sum(r["n_tokens"] for r in mix if r["source"] == "a")
    assert not early and sum(r["n_tokens"] for r in late) / tokens == pytest.approx(0.75, abs=0.03)


def test_pieces_that_repeat_are_folded_once(monkeypatch):
    texts = [f"Où était la fenêtre ? Élève n° {k % 3}, «Σίσυφος» ½ е́тᴀж_{k % 2}" for k in range(60)]
    wanted = [leaks.WORD.findall(leaks.folded(leaks._spoken(t))) for t in texts]
    seen, fold = [], leaks.folded
    monkeypatch.setattr(leaks, "folded", lambda t: seen.append(len(t)) or fold(t))
    assert [leaks._readings(t)[0] for t in texts] == wanted
    assert sum(seen) < 3 * len(texts[0])


def test_near_items_and_passage_sums_against_brute_force():
    rng = np.random.default_rng(5)
    near, latent = rng.standard_normal((1037, 6)).astype(np.float32), rng.standard_normal((4500, 6)).astype(np.float32)
    item_of = np.sort(rng.integers(0, 700, 4500))
    row, item = leaks._near(near, latent, item_of, 9.0)
    a, b = np.nonzero(near @ latent.T >= 9.0)
    assert set(zip(row.tolist(), item.tolist())) == set(zip(a.tolist(), item_of[b].tolist())) and len(row) == len(set(zip(row.tolist(), item.tolist())))
    ids, starts = rng.integers(-1, 40, 90), np.array([0, 4, 8, 33, 74])
    idf, right = rng.random(40), rng.standard_normal((40, 5))
    table = np.vstack([idf[:, None] * right, np.zeros((1, 5))])
    got, size = leaks._passages_times(ids, starts, idf, right)
    for s, y, n in zip(starts, got, size):
        assert np.allclose(y, table[ids[s : s + 16]].sum(axis=0), atol=1e-4) and np.isclose(n, (np.append(idf, 0)[ids[s : s + 16]] ** 2).sum())
