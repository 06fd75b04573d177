import itertools
import random

import numpy as np
import pytest

from lexmill.llm import toxicity as T

CLEAN = ["The archive team counted {n} boxes before the review.", "She slid the folder under the door and hummed until noon.", "I know where {p} left the key, and next time I will bring coffee.", "Rats are vermin, says the report, and were driven out with cats.", "Mesuré le 3 mai, le niveau était de {n}.", "Die Übersicht nennt {n} Einträge, sagt {p}.", "The damn build failed again, stupid cache, {n} minutes lost."]
TOXIC = ["{p}, you worthless idiot, do us all a favour and disappear for good.", "I know where {p} parks, and next time I will break every finger on both hands.", "Newcomers are vermin and must be driven out of town with sticks.", "{p}, du wertloser Drecksack, verpiss dich.", "Send me nudes, {p}, I want to lick every inch of you tonight."]
RND = random.Random(2)


def text(toxic):
    s = [RND.choice(CLEAN) for _ in range(6)] + ([RND.choice(TOXIC)] if toxic else [])
    RND.shuffle(s)
    return " ".join(x.format(n=RND.randint(2, 99), p=RND.choice(["Ann", "Bruno", "Celia", "Dora"])) for x in s)


@pytest.fixture(scope="module")
def field():
    noise = [text(False) for _ in range(10)]
    return T.train([text(True) for _ in range(150)] + noise, [text(False) for _ in range(400)])


def test_held_out_accuracy(field):
    s = T.Scorer(field)
    hit = np.array(s.scores([text(True) for _ in range(200)])) >= T.FLAG
    miss = np.array(s.scores([text(False) for _ in range(200)])) >= T.FLAG
    assert hit.mean() > 0.97 and miss.mean() < 0.03


def test_spellings(field):
    s = T.Scorer(field)
    for t in ["ANN, YOU WORTHLESS IDIOT, DO US ALL A FAVOUR AND DISAPPEAR FOR GOOD.", "Ann, you w0rthl3ss i d i o t, do us all a favour and disappear for good.", "Ann, you wоrthlеss idiottttt, do us all a favour and disappear for good.", "Ann, you wor\u200bth-less id\u200bio-t, do us all a favour and disappear for good."]:
        assert s.scores([t])[0] >= T.FLAG, t
    assert T.plain_word("n4k3d") == "naked" and T.plain_word("m#@!%d") == "<masked>" and T.plain_word("INV-123") == "0"


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(0)
    e, trans, start = rng.normal(size=(1, 5)), rng.normal(size=(2, 2)), 0.3
    m, pair, z = T.forward_backward(e, np.ones((1, 5), bool), trans, start)
    paths = list(itertools.product((0, 1), repeat=5))
    w = np.array([np.exp(start * p[0] + sum(e[0, i] * p[i] for i in range(5)) + sum(trans[p[i], p[i + 1]] for i in range(4))) for p in paths])
    assert np.isclose(z[0], np.log(w.sum()))
    assert np.allclose(m[0], [sum(x for x, p in zip(w, paths, strict=True) if p[i]) / w.sum() for i in range(5)])
    assert np.isclose(pair.sum(), 4)


def test_spans_are_offsets(field):
    t = "The archive team counted 3 boxes. Ann, you worthless idiot, do us all a favour and disappear for good. Rats left."
    (start, end, p), *_ = T.Scorer(field).spans(t)
    assert "worthless idiot" in t[start:end] and p >= T.FLAG and "archive" not in t[start:end]


def test_edges(field, spark):
    s = T.Scorer(field)
    assert s.scores([None, "", " \n ", "...", "x" * 300_000]) == [0.0] * 5 and s.spans("") == []
    assert T.Scorer(T.train([], [])).scores(["nothing here"]) == [0.0]
    docs = spark.createDataFrame([], "doc_id bigint, source string, text string, score double")
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert T.score_documents(docs, T.fit_on(docs, labels)).count() == 0
    rows = spark.createDataFrame([(1, None, None, 0.5), (1, None, None, 0.5), (None, "a", "hello", None)], docs.schema)
    assert T.score_documents(rows, field).count() == 3


def test_few_labels_give_no_false_findings_and_last_digits_don_t_matter(monkeypatch):
    """With twenty marks, half of them wrong, the fit stays precise; noise in the last digits changes no row."""
    toxic = [text(True) for _ in range(10)] + [text(False) for _ in range(10)]
    clean = [text(False) for _ in range(300)]
    held = [text(False) for _ in range(400)]
    first = np.array(T.Scorer(T.train(toxic, clean)).scores(held))
    assert (first >= T.FLAG).mean() < 0.01
    plain = T.forward_backward
    rng = np.random.default_rng(3)

    def noisy(*args):
        m, pair, z = plain(*args)
        return m * (1 + 1e-15 * rng.normal(size=m.shape)), pair * (1 + 1e-15 * rng.normal(size=pair.shape)), z

    monkeypatch.setattr(T, "forward_backward", noisy)
    again = np.array(T.Scorer(T.train(toxic, clean)).scores(held))
    assert ((first >= T.FLAG) == (again >= T.FLAG)).all() and np.abs(first - again).max() < 1e-3
