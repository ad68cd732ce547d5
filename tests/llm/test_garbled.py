import numpy as np
import pytest

from heliograph.llm.garbled import Search, found, judge, restore, statistics, suspects

DOC = "doc_id long, text string, path string, garbled string"
CLEAN = [
    "Le café été déjà à la fenêtre, l’opérateur répète la même réponse près du marché.",
    "Der Prüfknoten fiel für 3 Minuten zurück und müsste geprüft werden – größer als üblich.",
    "Проверяющий узел вернул ошибку и был пересчитан заново после обновления.",
    "Późny pakiet trwał dłużej z powodu opóźnienia łącza, wrócił i zgłosił błąd.",
    "Žádost překročila mez kvůli výpadku sítě před uzávěrkou, uložil vektorů.",
    "台帳は次の更新で直す予定だ。遅れた予測はしきい値を超え、再計算が必要になった。",
    "The team’s dashboard cost about €601 — “good enough” … and moved 5σ ± 2 °C.",
]
CORRECT = ["┌──┬──┐ │ a │", "Ærø–Ðóra", "λ → ∞, Δp ≈ 0", "x¹ + x² = ±√2", "½ × £3", "café répète", "﻿The team", "👍🏽🚀", "NÃO É ERRO: SITUAÇÃO", "plain", " ", "&eacute; &amp; \\u00e9 %C3%A9"]


def corpus():
    return [(i, f"{CLEAN[i % len(CLEAN)]} {i}", "p", "g") for i in range(350)] + [(1000 + i, f"{c} {i}", "p", "g") for i, c in enumerate(CORRECT * 8)]


def garble(text, written, read):
    return text.encode(written).decode(read)


GARBLED = {
    "utf8 as cp1252": "The team’s dashboard – “good enough”".encode().decode("cp1252", "replace").replace("�", "\x9d"),
    "utf8 as latin-1": garble(CLEAN[0], "utf-8", "latin-1"),
    "utf8 as cp437": garble("Le café était à la fenêtre", "utf-8", "cp437"),
    "utf8 as cp1251": garble("le café et l’été déjà", "utf-8", "cp1251"),
    "twice": garble(garble(CLEAN[1], "utf-8", "latin-1"), "utf-8", "latin-1"),
    "cp1251 as cp1252": garble(CLEAN[2], "cp1251", "cp1252"),
    "koi8-r as cp1251": garble(CLEAN[2], "koi8-r", "cp1251"),
    "shift_jis as latin-1": garble(CLEAN[5], "cp932", "latin-1"),
    "in part": CLEAN[3] + " " + garble("Le café déjà", "utf-8", "cp1252"),
    "escaped": "Le caf&Atilde;&copy; déjà",
}


@pytest.fixture(scope="module")
def search(spark):
    return Search(statistics(spark.createDataFrame(corpus(), DOC))[0])


@pytest.mark.parametrize("name", GARBLED)
def test_garbled_is_found(search, name):
    assert judge(GARBLED[name], search)[0], search.best(GARBLED[name].split()[1])


@pytest.mark.parametrize("text", [*CLEAN, *CORRECT])
def test_correct_text_is_no_case(search, text):
    assert not judge(text, search)[0]


def test_restoring(search):
    assert judge(GARBLED["utf8 as latin-1"], search, True)[1] == CLEAN[0]
    assert judge(GARBLED["twice"], search, True)[1] == CLEAN[1]
    assert judge(GARBLED["cp1251 as cp1252"], search, True)[1] == CLEAN[2]
    assert judge(GARBLED["escaped"], search, True)[1] == "Le café déjà"


def test_lost_characters_are_found(search):
    assert judge("r�sum� of run", search)[0]
    assert judge("it\x92s", search)[0]
    assert judge(garble("l’été déjà …", "utf-8", "latin-1").replace("\x80", ""), search)[0]


def test_tables(spark):
    rows = corpus() + [(5000 + i, t, "p", "g") for i, t in enumerate(GARBLED.values())] + [(6000, None, None, None), (6001, "", "p", "g"), (6002, "x" * 300_000 + " caf" + "Ã©" + " " + "y " * 100_000, "p", "g"), (None, None, None, None), (5001, GARBLED["utf8 as latin-1"], "p", "g")]
    df = spark.createDataFrame(rows, DOC).repartition(3)
    ids = [r.doc_id for r in found(df).collect()]
    assert sorted(ids) == [*range(5000, 5000 + len(GARBLED)), 6002]
    got = restore(df)
    assert got.columns == ["doc_id", "text", "garbled", "restored", "path"] and got.count() == len(rows)
    assert {r.restored for r in got.where("doc_id = 5001").collect()} == {CLEAN[0]}
    empty = spark.createDataFrame([], DOC)
    assert found(empty).count() == 0 and restore(empty).count() == 0


def test_a_third_of_all_rows_may_be_copies(spark):
    rows = corpus() + [(7000 + i, GARBLED["utf8 as latin-1"], "p", "g") for i in range(240)] + [(8000 + i, GARBLED["cp1251 as cp1252"], "p", "g") for i in range(60)]
    ids = {r.doc_id for r in found(spark.createDataFrame(rows, DOC).repartition(3)).collect()}
    assert ids == {*range(7000, 7240), *range(8000, 8060)}


def test_parts_hold_every_trigram_once():
    from collections import Counter

    from heliograph.llm.garbled import _parts

    texts = ["abcdefghij", "x", "klmno", "p" * 23]
    whole = "  " + "".join(t + "  " for t in texts)
    expected = Counter(whole[i : i + 3] for i in range(len(whole) - 2))
    for size in (3, 4, 7, 100):
        got = Counter(p[i : i + 3] for p in _parts(texts, size) for i in range(len(p) - 2))
        assert got == expected


def test_costs_are_finite():
    s = Search(np.zeros((1 << 20) + 1, dtype=np.int64))
    assert np.isfinite(s.cost("é")) and s.best("é")[1] == ()


def test_statistics_do_not_depend_on_partitions_or_copies(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, DOC)
    table, words = statistics(df.repartition(1))
    more = spark.createDataFrame(rows + rows[:200] * 3, DOC).repartition(5)
    again, others = statistics(more)
    assert (table == again).all() and set(words) == set(others) and len(words) > 20
    from heliograph.llm.garbled import _codes, _hashes

    whole = np.zeros(1 << 20, dtype=np.int64)
    for t in {t for _, t, *_ in rows}:
        whole += np.bincount(_hashes(_codes(f"  {t}  ")), minlength=1 << 20)
    assert (table[:-1] == whole).all() and table[-1] == whole.sum()


def test_words_searched_before_are_not_searched_again(search):
    other = Search(np.zeros((1 << 20) + 1, dtype=np.int64), {"caf\u00c3\u00a9": (9.0, ("utf-8>latin-1",))})
    assert other.best("caf\u00c3\u00a9") == (9.0, ("utf-8>latin-1",))
    words = ["caf\u00e9", "\U00020001", "na\u00efve", "\u65e5\u672c"]
    assert search.costs(words) == pytest.approx([search.cost(w) for w in words])


def test_suspects():
    assert suspects("na\u00efve plain\u65e5\u672cx &amp; caf\u00e9\tcaf\u00e9") == ["na\u00efve", "\u65e5\u672c", "&amp;", "caf\u00e9"]
    assert suspects(None) == suspects("plain text") == []
