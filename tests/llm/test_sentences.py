from __future__ import annotations

import pytest

from loomframe.llm.sentences import sentences, split_sentences

#: Units are joined by "|"; the bar itself is no part of the text.
CASES = [
    "It rained.| We left at 9 p.m. on foot.| It ended at 4 p.m.| The end.",
    "Dr. Vale and J. R. Hart met at St. Mary Hall.| See fig. 3 vs. table no. 4, e.g. there.",
    "Pens, ink, etc. were sold.| Pens, ink, etc.| We left.",
    "The rate rose from 3.5 to 4.25.| 12 people came.| It read \"x: y.\" twice... and stopped.| Well... the end!",
    '"Stop!" is what it prints.| "Is it on?" asked the guard.| "It is here. Leave it alone," the note said.',
    'The log says "done."| The next one.| (All by hand.)| Really?!| Yes.',
    "Keep README.md and a.b.c open.| sqlite keeps it.| iOS skips it!| lint.yaml is new.",
    "Lost space.|The next one!|And more?|Yes.| The U.S. mirror of it.| one.|Dr. Who came.",
    "Es war am 23. Mai, z. B. um 4 Uhr.| „Das ist leer. Bitte neu“, stand da.| Der Wert stieg auf das 1,5-Fache.",
    "El Sr. Gil salió a las 3 p. m. y volvió.| ¿Quién?| «No va. Hay que rehacerla», decía.| ¡Ay!",
    '누가 옮겼나요?| "지우지 마세요. 먼저 하세요."라고 적혀 있었다.| v1.2부터 찾는다.|다음 문장.',
    "今朝、空だった。|「問題です。すぐ直します。」という返事が来た。|なぜ？|はい！",
    "回信说：“有问题。马上修。”|第二次是空的；他停了一下……又放回。|从v1.2.3版开始！",
    "यह क्यों टूटी?| उसने लिखा, \"पहले रुकें। फिर बनाएँ।\"| कल हमने देखा।| अंत",
    "كتب: «توقف. ثم انسخ.»| لماذا مرتين؟| هذا واحد.",
    "ไม่มีใครลบหน้านี้| เราอ่าน parse.py แล้ว 3 ครั้ง| หน้าว่าง",
    "# A heading. With a stop|\n|First line goes\non here.| Second.|\n\n|Last without stop",
    "- one thing. |More of it\n|- two\n|1. three\n|2. four",
    "Before.|\n|```\na. b.\nc!\n```|\nAfter.",
    "An open \"quote stays. |The rest goes on.",
]


@pytest.mark.parametrize("case", CASES)
def test_boundaries(case):
    text = case.replace("|", "")
    want = [p.strip() for p in case.split("|") if p.strip()]
    assert [text[a:b] for a, b in sentences(text)] == want


def test_spans_are_ordered_trimmed_and_cover_all_but_white_space():
    for case in CASES:
        text = case.replace("|", "")
        spans, at = sentences(text), 0
        for a, b in spans:
            assert not text[at:a].strip() and text[a:b] == text[a:b].strip() and a < b
            at = b
        assert not text[at:].strip()


def test_odd_texts():
    assert sentences("") == [] and sentences(" \n\t\n") == []
    assert sentences("...") == [(0, 3)] and sentences("```\nopen. fence") == [(0, 15)]
    assert len(sentences("A word here. " * 50_000)) == 50_000
    assert sentences("x" * 300_000) == [(0, 300_000)]


def test_operator(spark):
    rows = [(1, "One. Two.", "xx", 3), (1, "One. Two.", "xx", 3), (2, None, None, 3), (3, "", "en", 3), (4, "\U0001f600 Go on. We do.", "en", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, start_pos int")
    out = {(r.doc_id, r.sentence_no, r.start_pos, r.end_pos) for r in split_sentences(df).collect()}
    assert out == {(1, 0, 0, 4), (1, 1, 5, 9), (4, 0, 0, 8), (4, 1, 9, 15)}
    assert split_sentences(df).count() == len(out) and split_sentences(df.limit(0)).count() == 0
