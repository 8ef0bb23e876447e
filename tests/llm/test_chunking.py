from __future__ import annotations

import random

import regex

from loomframe.llm.chunking import cut, split_oversized

WORDS = "river stone window quiet market garden letter Sommer Straße 색인을 索引 ведро".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    out = []
    while sum(map(len, out)) < n:
        out.append(" ".join(r.choice(WORDS) for _ in range(r.randint(4, 18))).capitalize() + r.choice([". ", "? ", ".\n", ".\n\n"]))
    return "".join(out)


KINDS = [
    prose(1, 9000),
    "x" * 7001,
    "0123456789abcdef" * 300,
    "색인을다시만들었더니행이줄었다。" * 400,
    "é" * 3000,
    "\U0001f469‍\U0001f4bb" * 1500,
    "\n" * 5000,
    " " * 2001,
    "\n".join(f"2026-01-{i % 28 + 1:02d} INFO cache={i}" for i in range(300)),
    ",".join('"a%d":{"b":%d}' % (i, i) for i in range(500)),
]


def test_round_trip_limit_and_overlap():
    for text in KINDS:
        pieces = cut(text)
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
        assert "".join(text[a + k : b] for a, b, k in pieces) == text
        for (a, b, k), before in zip(pieces[1:], pieces, strict=False):
            assert 0 < b - a <= 2000 and k == before[1] - a and 100 <= k <= 300


def test_cuts_fall_on_pauses():
    text = prose(2, 20000)
    for _, end, _ in cut(text)[:-1]:
        assert regex.search(r"[.?]\s+$", text[:end])


def test_no_cut_inside_a_combined_character():
    for text in (KINDS[4], KINDS[5]):
        starts = {m.start() for m in regex.finditer(r"\X", text)} | {len(text)}
        assert all(a in starts and b in starts for a, b, _ in cut(text))


def test_an_edit_changes_only_pieces_near_it():
    text = prose(3, 60000)
    edited = text[:30000] + "one more sentence was put in here. " + text[30000:]
    old = [text[a:b] for a, b, _ in cut(text)]
    new = [edited[a:b] for a, b, _ in cut(edited)]
    assert len(set(new) - set(old)) <= 5


def test_operator_handles_odd_rows(spark):
    rows = [(1, 7, None, 0, "a. " * 1000, "z"), (1, 7, None, 0, "a. " * 1000, "z"), (2, None, "h", None, None, "z"), (3, 1, "h", 1, "", "z"), (4, 1, "h", 1, "b" * 2000, "z")]
    df = spark.createDataFrame(rows, "chunk_id long, page_id long, heading_path string, position int, text string, piece string")
    out = split_oversized(df).orderBy("piece").collect()
    assert {r.chunk_id for r in out} == {1} and [r.piece for r in out] == list(range(len(out)))
    assert all(r.page_id == 7 and r.heading_path is None and len(r.text) == r.end_pos - r.start_pos for r in out)
    assert split_oversized(df.limit(0)).count() == 0
