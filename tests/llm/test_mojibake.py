import random

import pytest

from lexmill.llm import mojibake as M

EN = ["It’s a fine compromise: the second reader keeps the old sheets and drops the rest.", "“Leave the ferry ledger alone,” said Ann, “until the archive team has read the notes.”", "The storage rack near the mill holds 12 boxes — most of them long log tails."]
DE = ["Früher zählte Anna im Mühlenarchiv alle Kisten — heute übernimmt das der Müller.", "Die spätere Fassung nennt ältere Prüfbögen, führt aber Nummer 7 nicht auf.", "Während der Übernahme hat die Außenstelle 12 Einträge gelöscht."]
FR = ["L’équipe d’archives a fusionné des vecteurs périmés à la fin du mois.", "Près du moulin, Anne compte chaque année des pièces jointes vides.", "Mesuré le 3 mai, le niveau était de 23 au lieu de 11, dès le départ."]
ES = ["El índice nuevo rechazó 663 registros en otra sesión.", "Según Ana, la opción rápida era la única, ¿quién lo revisará?", "Todavía no está claro cómo la exportación omitió aquello."]
RU = ["Каждую весну Анна обходит мост у реки и считает длинные журналы.", "Если придут пустые вложения, полевая группа подождёт ответа до проверки.", "Мы не знаем, кто восстановил чужие заметки: Анна или полевая группа.", "В памятке к Анне есть глава о том, как выглядит чужая таблица знаков, и пример."]
CORPUS = [" ".join(random.Random(i).sample(s, 2)) for i in range(80) for s in (EN, DE, FR, ES, RU)]


@pytest.fixture(scope="module")
def restorer():
    return M.Restorer(M.fit(CORPUS))


def misread(text, really, seen):
    t = M.table(seen)
    return "".join(t[b] for b in text.encode(really))


@pytest.mark.parametrize("text", [EN[1], DE[0], FR[0], ES[1], RU[0]])
@pytest.mark.parametrize("seen", ["cp1252", "latin-1", "cp1251", "cp437", "cp866", "mac-roman"])
def test_utf8_round_trip(restorer, text, seen):
    assert restorer.text(misread(text, "utf-8", seen))[0] == text


@pytest.mark.parametrize(("text", "really", "seen"), [(RU[1], "cp1251", "cp1252"), (RU[1], "koi8-r", "cp1251"), (RU[0], "cp866", "cp1251"), (DE[1], "cp1252", "mac-roman"), (ES[0], "cp1252", "cp437")])
def test_one_byte_round_trip(restorer, text, really, seen):
    assert restorer.text(misread(text, really, seen))[0] == text


def test_twice_and_in_part(restorer):
    assert restorer.text(misread(misread(FR[0], "utf-8", "cp1252"), "utf-8", "cp1252"))[0] == FR[0]
    assert restorer.text(f"{DE[1]} {misread(DE[2], 'utf-8', 'cp1252')}")[0] == f"{DE[1]} {DE[2]}"


def test_intact_texts_stay(restorer):
    for t in [*EN, *DE, *FR, *ES, *RU, "Plain ASCII, no marks?", "Really?? Yes??? It is."]:
        assert restorer.text(t) == (t, "", False)


def test_mentions_are_intact(restorer):
    for t in ["A row such as “Ã¼” in notes/a.md is shown in the guide as a sample of a misread file.", "В памятке к Анне есть пример: «Ã©» – так выглядит чужая таблица знаков."]:
        assert restorer.text(t)[1:] == ("", False)


def test_lost_characters(restorer):
    assert restorer.text(DE[1].replace("ä", "�"))[2] and restorer.text("Comme pr?vu, la deuxi?me lecture.")[2]


def test_edges(restorer, spark):
    assert restorer.text(None) == (None, "", False) and restorer.text("") == ("", "", False)
    big = misread(RU[0], "utf-8", "cp1252") + "\n" + "x" * 500_000
    assert restorer.text(big)[0].startswith(RU[0])
    none = spark.createDataFrame([], "origin string, rec_key string, text string, chain string")
    model = M.fit(M.sample_texts(none))
    assert M.affected(none, model).count() == 0
    rows = spark.createDataFrame([("a", "1", None, "c"), ("a", "2", misread(RU[0], "utf-8", "cp1252"), "c")] * 2, none.schema)
    assert {r.rec_key for r in M.affected(rows, M.fit(CORPUS)).collect()} == {"2"}


def test_pairs_are_counted_over_all_rows(spark):
    rare = "Les îles ont dû naître là où le maïs et le canoë – déjà – sont arrivés."
    texts = [*(t for t in CORPUS for _ in range(5)), *[rare] * 12, None, "", misread(rare, "utf-8", "cp1252")]
    rows = spark.createDataFrame([("a", str(i), t) for i, t in enumerate(texts)], "origin string, rec_key string, text string").repartition(3)
    sample = M.sample_texts(rows, 100)
    assert M.corpus_pairs(rows)["oë"][M.LANGUAGES.index("fr")] == 12 > sample.count(rare)
    assert ("o", "ë") in M.fit(sample, M.corpus_pairs(rows)).usual and ("o", "ë") not in M.fit(sample).usual
    assert M.fit(CORPUS, M.by_pair(M.count_pairs(CORPUS))).usual == M.fit(CORPUS).usual


def test_all_candidates_of_a_step_are_weighed(restorer):
    text, chain = restorer.sentence(misread(RU[2], "cp1251", "koi8-r"))
    assert text == RU[2] and chain
    weighed = {}
    measure = restorer.length
    restorer.length = lambda t, odd=None: weighed.setdefault(t, measure(t, odd))
    try:
        garbled = misread(misread(DE[2], "cp1252", "mac-roman"), "utf-8", "cp866")
        best, path = restorer.sentence(garbled)
    finally:
        del restorer.length
    paid = M.undo_chain(garbled, path)[1]
    for steps in (restorer.utf8_steps, restorer.swap_steps):
        for c, _, price in steps(garbled):
            if c not in weighed and "￿" not in c and (steps == restorer.utf8_steps or M.new_words(c, garbled)):
                assert price + restorer.length(c) >= paid + restorer.length(best)
    assert best == DE[2]
    for t in (DE[2], FR[0], RU[0]):
        sizes = [len(p.compress(t.encode())) for p in restorer.packers.values()]
        assert restorer.length(t) == min(sizes) + M.ESCAPE * restorer.odd(t)


def test_texts_garbled_on_purpose_are_restored(sf):
    """Restoration accuracy: intact sentences are misread by one or two steps and must come back letter by letter."""
    import os
    import random

    import pyarrow.parquet as pq

    large = f"{os.path.dirname(sf)}/sf0.01/document_chunks.parquet"
    texts = [t for t in pq.read_table(large if os.path.exists(large) else f"{sf}/document_chunks.parquet", columns=["text"]).column("text").to_pylist() if t]
    restorer = M.Restorer(M.fit(texts))
    intact = [t for t in dict.fromkeys(texts) if not t.isascii() and restorer.text(t)[1:] == ("", False) and len(t) < 3000]
    rnd = random.Random(7)
    chains = [("cp1252",), ("latin-1",), ("cp1251",), ("cp437",), ("cp1252", "cp1252"), ("cp1251", "cp1252")]
    tried = right = 0
    for t in rnd.sample(intact, min(len(intact), 120)):
        garbled = t
        for charset in rnd.choice(chains):
            garbled = "".join(M.table(charset)[b] for b in garbled.encode("utf-8"))
        tried += 1
        right += restorer.text(garbled)[0] == t
    assert tried and right >= 0.9 * tried, (right, tried)


def test_dictionaries_are_fitted_on_all_rows(spark, sf):
    """No row is left out: words that stand in a few of many rows are counted; the model restores like one of whole texts."""
    texts = [*CORPUS * 5, *["Ein Wolkenbruchsammler zählt früh, der Wolkenbruchsammler zählt spät."] * 3]
    rows = spark.createDataFrame([("a", str(i), t) for i, t in enumerate(texts)], "origin string, rec_key string, text string")
    pairs, words = M.corpus_counts(rows.repartition(3))
    assert dict(words["de"])["Wolkenbruchsammler"] == 6 and (pairs, words) == M.corpus_counts(rows.coalesce(1))
    assert pairs.items() <= M.by_pair(M.count_pairs(texts)).items()
    restorer = M.Restorer(M.fit_counts(pairs, words))
    for t in (DE[0], FR[0], ES[0], RU[0]):
        for seen in ("cp1252", "cp1251", "cp437"):
            assert restorer.text(misread(t, "utf-8", seen))[0] == t
