from __future__ import annotations

import pytest

from loomframe.llm import mentions as m


@pytest.fixture(scope="module")
def weights():
    return m.model()


CASES = [
    ("Anna Schmidt reviewed the draft.", {("person", "Anna Schmidt")}),
    ("The plan by Peter Novak was late.", {("person", "Peter Novak")}),
    ("Call 555-0142 now.", {("phone", "555-0142")}),
    ("plain words " * 60 + "Yesterday Maria Lopez moved the table. " + "plain words " * 60, {("person", "Maria Lopez")}),
    ("THE QUEUE COULD NOT BE TAGGED AT ALL, SO KEEP AT MOST 129 OF THEM. Rename It And Then Resolve The Snapshot.", set()),
]


@pytest.mark.parametrize("text,want", CASES)
def test_mentions_without_a_fixed_phrase_nearby(weights, text, want):
    assert {(k, text[a:b]) for a, b, k in m.best_segments(text, weights)} == want


#: Ordinary sentences, far from the words of the training texts; the model is measured on them, not fitted to them.
ORDINARY = [
    ("Yesterday Maria Gonzalez visited the office and met Hannah Becker.", {("person", "Maria Gonzalez"), ("person", "Hannah Becker")}),
    ("Minutes taken by Oliver Thornton; approved by Priya Raman.", {("person", "Oliver Thornton"), ("person", "Priya Raman")}),
    ("Dear Thomas Keller, thanks.", {("person", "Thomas Keller")}),
    ("Sincerely, John Smith", {("person", "John Smith")}),
    ("Passport: GB1234567, name Laura Palmer.", {("identity", "GB1234567"), ("person", "Laura Palmer")}),
    ("14 Rue de Rivoli, 75001 Paris", {("address", "14 Rue de Rivoli, 75001 Paris")}),
    ("22 Baker Street, London NW1 6XE", {("address", "22 Baker Street, London NW1 6XE")}),
    ("Please forward it to carla.jensen@harbour.org or ring 0161 496 0123.", {("email", "carla.jensen@harbour.org"), ("phone", "0161 496 0123")}),
    ("The White House and New York are places.", set()),
]


def test_ordinary_sentences(weights):
    got = {(text, k, text[a:b]) for text, _ in ORDINARY for a, b, k in m.best_segments(text, weights)}
    want = {(text, *mention) for text, mentions in ORDINARY for mention in mentions}
    assert len(got & want) >= 0.8 * len(want)
    assert len(got - want) <= 1
