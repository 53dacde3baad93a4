"""Leaks, mixing and encoding repair against brute force and round trips."""

import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arbora.llm import leaks as L
from arbora.llm import mixing as M
from arbora.llm import mojibake as G


def distance(pattern, text):
    row = list(range(len(pattern) + 1))
    out = []
    for w in text:
        new = [0]
        for k in range(1, len(pattern) + 1):
            new.append(min(row[k - 1] + (pattern[k - 1] != w), row[k] + 1, new[k - 1] + 1))
        row = new
        out.append(row[-1])
    return out


@given(st.lists(st.integers(0, 3), min_size=1, max_size=70), st.lists(st.integers(0, 3), max_size=40))
@settings(max_examples=150, deadline=None)
def test_myers(pattern, text):
    assert L.myers(pattern, text) == distance(pattern, text)


@given(st.integers(0, 10**6))
@settings(max_examples=150, deadline=None)
def test_finder_equals_brute_force(seed):
    rng = random.Random(seed)
    words = ["a", "b", "c"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for i in range(3)]
    text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))
    settings_ = L.Settings(words=6, errors=1)
    found = {i: (run, d) for i, run, d, _ in L.Finder(items, settings_).find(text)}
    doc = text.split()
    for i, item in items:
        w = item.split()
        exact = any(w[p : p + 6] == doc[q : q + 6] for p in range(len(w) - 5) for q in range(len(doc) - 5))
        assert exact == (i in found and found[i][1] == 0) and (not exact or found[i][0] >= 3)
        loose = any(min(distance(w[p : p + 6], doc), default=9) <= 1 for p in range(len(w) - 5))
        assert loose == (i in found)


def test_leaks(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(1, f"x\n// ONE_two;\n{passage[8:]}!", "k"), (2, passage.replace("six", "SICK"), "k"), (3, None, "k"), (4, "", "k"), (5, "word " * 200_000 + passage, "k"), (6, passage, "k"), (6, passage, "k")], "doc_id long, text string, t string")
    items = spark.createDataFrame([(1, passage, "k"), (1, passage, "k"), (2, "too short", "k"), (3, None, "k"), (4, "", "k")], "item_id long, text string, item string")
    for bound in (10**6, 5):
        got = {(r["doc_id"], r["item_id"]): (r["run"], r["distance"]) for r in L.leaks(docs, items, L.Settings(max_words=bound)).collect()}
        assert got == {(1, 1): (12, 0), (2, 1): (6, 1), (5, 1): (12, 0), (6, 1): (12, 0)}
    assert L.leaks(docs, items.limit(0)).count() == 0 and L.leaks(docs.limit(0), items).count() == 0


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 6), min_size=1, max_size=6), st.integers(0, 300), st.integers(5, 60))
@settings(max_examples=300, deadline=None)
def test_fit(counts, budget, window):
    taken = M.fit(counts, budget, window)
    assert all(0 <= taken.get(k, 0) <= n for k, n in counts.items())
    total = sum(k * n for k, n in taken.items())
    assert total <= budget
    if budget <= window:
        reach = {0}
        for k, n in counts.items():
            reach = {r + k * i for r in reach for i in range(n + 1)}
        # what the proportional part takes first leaves a rest that is fitted exactly
        share = {k: n * budget // sum(x * y for x, y in counts.items()) for k, n in counts.items()} if budget < sum(x * y for x, y in counts.items()) else counts
        rest = {sum(k * n for k, n in share.items())}
        for k, n in counts.items():
            rest = {r + k * i for r in rest for i in range(n - share[k] + 1)}
        assert total == max(r for r in rest if r <= budget)


def test_mix(spark):
    rows = [(i, f"text number {i} " + "word " * (i % 7 + 1), ("Docs " if i % 2 else "docs") if i < 80 else "code" if i < 95 else None if i < 97 else "other") for i in range(100)]
    rows += [(200, rows[0][1], "DOCS"), (201, None, "docs"), (202, "", "docs"), (203, rows[0][1], "code")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("docs", 0.5, 1), ("code", 0.3, 3), ("none", 0.2, None), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mixed = M.mix(docs, targets)
    got = mixed.collect()
    assert len({r["id"] for r in got}) == len(got) and all(r["repeats"] <= {"docs": 1, "code": 3}[r["source"]] for r in got)
    assert sorted(r.asDict().items() for r in got) == sorted(r.asDict().items() for r in M.mix(docs, targets).collect())
    shares = {r["source"]: r for r in M.shares(mixed, targets).collect()}
    assert abs(shares["docs"]["actual_share"] - 0.625) < 0.01 and shares["none"]["actual_share"] == 0.0
    assert 0 not in {r["id"] for r in got if r["source"] == "docs"}  # the text counts once, for the least source
    other = M.mix(docs, targets, M.Settings(seed=2)).collect()
    assert {r["id"] for r in other} != {r["id"] for r in got} or len(got) == 95
    assert M.mix(docs.limit(0), targets).count() == 0 and M.mix(docs, targets.limit(0)).count() == 0
    small = M.shares(M.mix(docs, targets, M.Settings(tokens=100)), targets).collect()
    assert 90 <= sum(r["tokens"] for r in small) <= 100


SOUND = ["Die Prüfung schlägt fehl, wenn der Schlüssel schon geschlossen ist.", "La función devuelve el último índice más antiguo de la sesión.", "Le résultat ne dépend pas de l’ordre où les données arrivent.", "Функция возвращает последний элемент без проверки.", "如果页面为空，则跳过该记录。缓存最多保留数据。", "It’s cheap — “really” — and costs €5.", "ATENÇÃO: NÃO APAGUE A SEÇÃO."]


@pytest.fixture(scope="module")
def restorer(spark):
    texts = [(i, s) for i, s in enumerate(SOUND * 40)] + [(1000 + i, "Nothing but plain words in this sentence of the corpus.") for i in range(300)]
    counts = G.pair_counts(spark.createDataFrame(texts, "doc_id long, text string")).toPandas()
    return G.Restorer(G.pair_model(counts, G.Settings()))


WRONG = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp1251"), ("utf-8", "koi8-r"), ("utf-8", "cp437"), ("utf-8", "mac-roman")]


@pytest.mark.parametrize("right,wrong", WRONG)
@pytest.mark.parametrize("text", SOUND[:4])
def test_round_trip(restorer, text, right, wrong):
    try:
        bad = text.encode(right).decode(wrong)
    except UnicodeDecodeError:
        pytest.skip("the wrong encoding has no such byte")
    assert restorer.check(bad)[0] == text and restorer.check(bad)[2]
    twice = restorer.check(SOUND[0] + " " + bad)
    assert twice[0] == SOUND[0] + " " + text


def test_sound_and_lost(restorer):
    for text in [*SOUND, "", "plain", "word " * 100_000 + "é", "shows “cafÃ©” on old terminals", 'the string "â€™" in a test', "Bytes become � in the view.", "« Ã  »"]:
        assert not restorer.check(text)[2], text[:50]
    assert restorer.check("La funci�n no est� aqu�.")[2:] == (True, True)
    double = "Prüfung schlägt".encode().decode("cp1252").encode().decode("cp1252")
    assert restorer.check(double)[0] == "Prüfung schlägt"


def test_sound_text_is_outside_runs(restorer):
    """Runs isolate: little of sound text lies inside them, even by a corpus this small, and a garbled word does without its neighbours."""
    inside = sum(ord(c) > 127 for text in SOUND for a, b in restorer.runs(text) for c in text[a:b])
    assert inside < 0.25 * sum(ord(c) > 127 for text in SOUND for c in text)
    text = SOUND[0] + " kleine Prüfung ".encode().decode("cp1252") + SOUND[0]
    assert [text[a:b] for a, b in restorer.runs(text)] == ["PrÃ¼fung"]


def test_garbled_frame(spark):
    rows = [(i, s, "k", 1) for i, s in enumerate(SOUND * 30)] + [(900, SOUND[0].encode().decode("cp1252"), "k", 1), (901, None, "k", 1), (902, "", "k", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, lost int")
    got = G.garbled(docs).collect()
    assert [(r["doc_id"], r["restored"], r["lost"]) for r in got] == [(900, SOUND[0], False)]
    assert G.garbled(docs.limit(0)).count() == 0


@given(st.lists(st.floats(-2, 2).map(lambda x: round(x, 1)), max_size=25))
@settings(max_examples=200, deadline=None)
def test_segments(scores):
    import numpy as np

    found = G.segments(np.array(scores, float))
    assert all(b <= c for (_, b), (c, _) in zip(found, found[1:]))
    best = max((sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=0)
    assert (max((sum(scores[a:b]) for a, b in found), default=0) == pytest.approx(max(best, 0)))
