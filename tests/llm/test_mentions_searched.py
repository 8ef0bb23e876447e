from __future__ import annotations

import random

from loomframe.llm import mentions as m
from loomframe.llm.mention_training import labelled_sentences


class _Never:
    def finditer(self, text):
        raise AssertionError(f"searched: {text}")


def test_slow_patterns_search_only_texts_that_can_match(monkeypatch):
    never = _Never()
    monkeypatch.setattr(m, "_EMAIL", [(form, never) for form, _ in m._EMAIL])
    monkeypatch.setattr(m, "_ADDRESS", [(form, never, parts) for form, _, parts in m._ADDRESS])
    monkeypatch.setattr(m, "_PHONE", never)
    monkeypatch.setattr(m, "_IDENTITY", never)
    for text in ("Look at row 12 of 40 at noon.", "In 2026 all 129 of the 4096 tables were at rest.", "version 1.2, page 3"):
        assert m.candidates(text) == []


def test_no_match_is_hidden_by_what_it_must_hold():
    r = random.Random(3)
    bits = [*"aBZ19 .,-@()[]/+:é", " at ", " dot ", "[at]", " (at) ", " St", " Street", "12 Elm Street", "5 bis, rue ", "straße 5", "weg 12a", ", 75001 ", "서울시 강남구 세종로 5", "123-45-6789", "AB123 45678", "020 555 0142", "٣٤٥٦٧٨٩"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(1, 25))) for _ in range(8000)] + [text for text, _ in labelled_sentences(800, seed=31)]
    slow = [*zip((p for _, p in m._EMAIL), m._MAIL_HOLDS), (m._IDENTITY, m._IDENTITY_HOLDS), *((p, holds) for (_, p, _), holds in zip(m._ADDRESS, m._ADDRESS_HOLDS) if holds)]
    met = dict.fromkeys(range(len(slow)), 0)
    for text in texts:
        for i, (pattern, holds) in enumerate(slow):
            found = pattern.search(text) is not None
            met[i] += found
            assert holds.search(text) or not found, text
        if any(sum(c.isdigit() for c in x[0]) >= m._PHONE_DIGITS for x in m._PHONE.finditer(text)):
            assert m._PHONE_HOLDS.search(text), text
    assert min(met.values()) >= 20


def test_words_and_initials():
    words = m.Words("J. Morrow's x.y a. B, zorblat É. I.", frozenset({"zorblat"}))
    assert [words.word(i) for i in range(len(words.starts))] == ["J.", "Morrow", "s", "x", "y", "a.", "B", "zorblat", "É.", "I."]
    assert words.classes == "I T|x x|x i x,l I I"
    assert m.Words("").classes == m.Words("12, !").classes == "" and m.Words("12").starts == []
