"""Disguised words against a character model of a few plain words."""

import random

import numpy as np
import pytest

from fathomgrid.llm import toxicity

PLAIN = {"you": 900, "are": 900, "a": 900, "the": 900, "it": 500, "is": 500, "on": 500, "moron": 40, "idiot": 40, "clown": 40, "scum": 40, "ass": 40, "stone": 300, "river": 300, "hello": 300, "as": 300}


@pytest.fixture(scope="module")
def table():
    n = toxicity.count_trigrams(PLAIN).reshape(64, 64, 64).astype(float)
    two = (n.sum(axis=0) + 0.5) / (n.sum(axis=0) + 0.5).sum(axis=1, keepdims=True)
    return np.log((n + 4 * two[None]) / (n.sum(axis=2, keepdims=True) + 4)).ravel().tolist()


@pytest.mark.parametrize(
    "word, says",
    [("iiddiioott", "idiot"), ("mooron", "moron"), ("m" + 70 * "o" + "ron", "moron"), ("!diot", "idiot"), ("|diot", "idiot"), ("(lown", "clown"), ("a$$", "ass"), ("1d107", "idiot"), ("$cum!", "scum"), ("m0r0n", "moron")],
)
def test_disguised_word(table, word, says):
    assert says in toxicity.readings(word, table)


@pytest.mark.parametrize("word", ["hello!", "(hello)", "hello", "\"hello!\""])
def test_punctuation_stays_punctuation(table, word):
    assert toxicity.readings(word, table)[0] == "hello" and toxicity.decode(word.strip('"'), table) == "hello"


def test_long_word(table):
    assert len(toxicity.readings("ab!" * 100_000, table)[-1]) >= 200_000


@pytest.mark.parametrize(
    "text, says",
    [("you are a m o r o n", "moron"), ("the a s s", "ass"), ("a cl own", "clown"), ("mo ron", "moron"), ("i d  i  o t", "idiot"), ("i d ! o t", "idiot"), ("$ c u m", "scum"), ("m - o - r - o - n", "moron"), ("hello m o o o r o n stone", "moron"), ("m.o.r.o.n", "moron")],
)
def test_word_set_apart(table, text, says):
    assert says in [r for w in toxicity.words_of(text) for r in toxicity.readings(w, table)]


def test_plain_short_words_stay_apart(table):
    assert toxicity.decode("you are a the it is on", table) == "you are a the it is on"


def test_ruled_out_decodings_say_nothing(table):
    r, weights = random.Random(7), {f: 1.0 for w in ("moron", "idiot", "clown", "scum", "ass") for f in toxicity.features(w)}
    may, hits = toxicity.may_say(weights), 0
    for _ in range(30_000):
        word = list(r.choice(["moron", "idiot", "clown", "scum", "ass", "stone", "hello", "as"]))
        for _ in range(r.randrange(5)):
            word.insert(r.randrange(len(word) + 1), r.choice("  !!$$((||.-10o3@6ssiim"))
        word = " ".join("".join(word).replace("o", r.choice("o0")).split())
        every = {f for x in toxicity.readings(word, table) for f in toxicity.features(x) if f in weights}
        some = {f for x in toxicity.readings(word, table, may) for f in toxicity.features(x) if f in weights}
        assert every == some, word
        hits += bool(every)
    assert hits > 1000


def test_tokens_that_are_passed_over_weigh_nothing(table):
    weights = {f: 1.0 + len(f) for w in ("moron", "idiot", "clown", "scum", "ass", "réeux") for f in toxicity.features(w)}
    model = np.array(table, np.float32).reshape(64, 64, 64)
    one, every, r, hits = toxicity.Scorer(model, weights), toxicity.Scorer(model, weights), random.Random(11), 0
    every.words = toxicity.words_of
    pieces = ["moron", "m0r0n", "m o r o n", "i d ! o t", "!diot", "(lown", "s.c.u.m", "a$$", "stone", "river", "it", "on", "a", "as", "the", "mo", "ron", "€", "…", "“idiot”", "clo wn", "réeux", "r é e u x", "7", "?", "m?oron", "œuvre", " ", "- -", "c|own", "MORON", "ſcum"]
    for _ in range(1500):
        text = r.choice([" ", "  ", "\n"]).join(r.choice(pieces) for _ in range(r.randrange(12)))
        assert one.text(text) == every.text(text), text
        hits += one.text(text) != (0.0, 0.0)
    assert hits > 500
