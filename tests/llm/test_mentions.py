from __future__ import annotations

import itertools
import random

import pytest

from loomframe.llm import mentions as m
from loomframe.llm.mention_training import labelled_sentences


@pytest.fixture(scope="module")
def weights():
    return m.model()


def test_held_out_accuracy(weights):
    """By kind, on texts of another seed; names in small letters and without any cue are among them."""
    least = {"person": (0.85, 0.88), "email": (0.94, 0.95), "phone": (0.98, 0.98), "identity": (0.95, 0.97), "address": (0.85, 0.92)}
    hits, wrong, missed = (dict.fromkeys(m.KINDS, 0) for _ in range(3))
    for text, gold in labelled_sentences(800, seed=123):
        got = set(m.best_segments(text, weights))
        for counts, spans in ((hits, got & gold), (wrong, got - gold), (missed, gold - got)):
            for span in spans:
                counts[span[2]] += 1
    for kind, (recall, precision) in least.items():
        assert hits[kind] / (hits[kind] + missed[kind]) >= recall, kind
        assert hits[kind] / (hits[kind] + wrong[kind]) >= precision, kind


def test_frequent_words_are_counted_over_all_texts(spark):
    rows = [("the walrus Walrus sleeps near marten",)] * 4 + [("walrus WALRUS, walrus; Marten",)] * 2 + [(None,), ("",)]
    got = m.frequent_words(spark.createDataFrame(rows, "t string"), "t", least=4, share=0.5)
    assert got == {"the", "walrus", "sleeps", "near", "marten"}
    assert m.frequent_words(spark.createDataFrame(rows, "t string"), "t", least=4, share=0.9) == {"the", "sleeps", "near"}


CASES = [
    ("Reach Dr. Ann-Lee van der Morrow at (555) 555-0100 or ann.morrow@corp.example.", {("person", "Ann-Lee van der Morrow"), ("phone", "(555) 555-0100"), ("email", "ann.morrow@corp.example")}),
    ("Fallback contact x_morrow [at] uni [dot] invalid now", {("email", "x_morrow [at] uni [dot] invalid")}),
    ("Their SSN 900-12-3456 was pasted. Their Reisepass Z00123456 was pasted.", {("identity", "900-12-3456"), ("identity", "Z00123456")}),
    ("The invoice goes to 12 Marlow Street, Upper Vale, QX2 7ZZ. The end.", {("address", "12 Marlow Street, Upper Vale, QX2 7ZZ")}),
    ("담당자 김나래 님 연락처는 +82 10 0000 1234 입니다.", {("person", "김나래"), ("phone", "+82 10 0000 1234")}),
    ("Row 782-21789 is fine. Order 4650-09-04434 was a dry run. Pin tag@2.1.0 and mail noreply@bot.example or git@forge.example:a/b.git.", set()),
    ("Dr. Morrow left it late. Section 3, Ledger Lane of the board, is empty. The Street view has 12 Main tabs.", set()),
]


@pytest.mark.parametrize("text,want", CASES)
def test_kinds_and_look_alikes(weights, text, want):
    assert {(k, text[a:b]) for a, b, k in m.best_segments(text, weights)} == want


def test_dynamic_programme_is_exact(monkeypatch):
    r = random.Random(5)
    for _ in range(60):
        spans = sorted({(a, a + r.randint(1, 6), r.choice(m.KINDS), "f") for a in (r.randint(0, 14) for _ in range(9))})
        score = {s: r.uniform(-1, 2) for s in spans}
        monkeypatch.setattr(m, "candidates", lambda text, words, s=spans: list(s))
        monkeypatch.setattr(m, "features", lambda text, s, words: [str(s)])
        got = m.best_segments("x" * 30, {str(s): v for s, v in score.items()})
        best = 0.0
        for n in range(len(spans) + 1):
            for some in itertools.combinations(spans, n):
                if all(a[1] <= b[0] or b[1] <= a[0] for a, b in itertools.combinations(some, 2)):
                    best = max(best, sum(score[s] for s in some))
        assert abs(sum(score[(*g, "f")] for g in got) - best) < 1e-9


def test_operator_and_redaction(spark, weights):
    text = "Signed, Orla Morrow\nTell J. Morrow that row 1 is gone."
    rows = [(1, text, "k"), (1, text, "k"), (2, None, "k"), (3, "", "k"), (4, "plain " * 40_000, "k"), (5, "pre \U0001f600 " + text, "k")]
    df = spark.createDataFrame(rows, "memory_id long, body string, kind string")
    found = m.find_mentions(df, "memory_id", "body", weights).distinct().collect()
    assert {(r.rec_id, r.kind, r.mention) for r in found} == {(i, "person", n) for i in (1, 5) for n in ("Orla Morrow", "J. Morrow")}
    assert all(r.mention == dict((x[0], x[1]) for x in rows)[r.rec_id][r.start_pos : r.end_pos] for r in found)
    clean = {r.memory_id: r.body for r in m.redact(df, "body", weights).collect()}
    assert clean[1] == "Signed, [PERSON]\nTell [PERSON] that row 1 is gone." and clean[2] is None and clean[3] == "" and clean[4] == rows[4][1]
    assert m.find_mentions(df.limit(0), "memory_id", "body", weights).count() == 0
