from __future__ import annotations

import datetime
import math
import re
from collections import Counter, defaultdict

import numpy as np

import __spark_entry__ as entry
from loomframe.operators import retrieval

QUERIES = entry.queries()


def _best(texts: list[tuple], asked: list[tuple], k: int) -> dict[int, list[tuple]]:
    """BM25 by hand over (id, text); rows of the same id and length count as one."""
    rows = [(i, re.findall(r"\w+", (t or "").lower())) for i, t in set(texts)]
    average = sum(len(t) for _, t in rows) / len(rows)
    held: dict[tuple, Counter] = defaultdict(Counter)
    for i, t in rows:
        held[i, len(t)].update(t)
    n = Counter(w for c in held.values() for w in c)
    out = {}
    for q, terms in asked:
        score: dict[int, float] = defaultdict(float)
        for (i, size), c in held.items():
            for w in set(terms) & set(c):
                idf = math.log((len(rows) - n[w] + 0.5) / (n[w] + 0.5))
                score[i] += (idf if idf > 0 else 1e-6) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size / average))
        out[q] = sorted(((-round(s, 9), i) for i, s in score.items()))[:k]
    return {q: x for q, x in out.items() if x}


def _texts(rows: int) -> list[tuple]:
    r = np.random.default_rng(5)
    words = np.array([f"w{i}" for i in range(40)] + ["most"])
    share = 1 / np.arange(3, 44)
    texts = [(i, " ".join(r.choice(words, r.integers(3, 9), p=share / share.sum())) + " most" * (i % 3 > 0) + f" rare{i}" * (i % 7 == 0)) for i in range(rows)]
    return texts + texts[:30] + [(5, "w1 w2 w3"), (5, "w1 w9"), (6, None), (rows + 1, "")]


def test_probes_in_blocks_equal_scores_by_hand(spark):
    texts = _texts(700)
    r = np.random.default_rng(6)
    asked = [(q, sorted({*(f"w{i}" for i in r.integers(0, 40, 2)), f"rare{q}", "absent"} | ({"most"} if q % 5 == 0 else set()))) for q in range(150)]
    asked += [(900, []), (901, ["absent"]), (902, ["most"]), (903, ["rare7"]), (904, ["rare7"])]
    rows = spark.createDataFrame(texts, "chunk_id long, text string")
    probes = spark.createDataFrame(asked, "query_id long, terms array<string>")
    want = _best(texts, asked, 4)
    for rare, block_rows in ((20, 90), (0, 100_000), (10_000, 90)):
        got = defaultdict(list)
        for x in sorted(retrieval.batch_lexical(rows, probes, 4, rare=rare, block_rows=block_rows).collect(), key=lambda x: (x.query_id, x.rank)):
            got[x.query_id].append((-x.score, x.chunk_id))
        assert {q: [i for _, i in x] for q, x in got.items()} == {q: [i for _, i in x] for q, x in want.items()}
        assert all(abs(a[0] - b[0]) < 2e-9 for q in want for a, b in zip(got[q], want[q]))


def _tables(spark, folder, texts: list[tuple], titles: list[str]) -> None:
    day = datetime.datetime(2026, 1, 1)
    own = [(i, 1000 + i % 200, 0, "h", t) for i, t in texts]
    spark.createDataFrame(own, "chunk_id long, page_id long, position int, heading_path string, text string").write.parquet(f"{folder}/chunks.parquet")
    kind = [c for c in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").dtypes]
    values = {"kind": "claim", "indexed_at": day, "crawl_op": "upsert"}
    pages = [tuple({**values, "page_id": 1000 + i, "title": t, "slug": f"s{i}"}.get(c) for c, _ in kind) for i, t in enumerate(titles)]
    spark.createDataFrame(pages, ", ".join(f"{c} {t}" for c, t in kind)).write.parquet(f"{folder}/pages.parquet")


def _moved(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_probe_queries_list_no_matches_of_all_probes(spark, tmp_path):
    """Titles of the same frequent words: no join lists every probe with every chunk that shares a word with it."""
    texts = _texts(400)
    _tables(spark, tmp_path, texts, [f"w1 w{2 + i % 3} most rare{i}" for i in range(120)])
    found = QUERIES["q10_probe_retrieval"](spark, str(tmp_path))
    assert "Join" not in _moved(found)
    want = _best(texts, [(1000 + i, ["most", f"rare{i}"]) for i in range(120)], 10)
    assert {(r.query_id, r.chunk_id) for r in found.collect()} == {(q, i) for q, x in want.items() for _, i in x}


def test_self_probe_finds_pages_without_moving_texts(spark, tmp_path):
    texts = _texts(400)
    _tables(spark, tmp_path, texts, [f"w1 most rare{i}" for i in range(120)])
    found = QUERIES["q12_eval_self_probe"](spark, str(tmp_path))
    grouped = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in x]
    assert grouped and not any("heading_path" in x for x in grouped), "texts are not grouped to find the page of a chunk"
    want = {}
    for q, x in _best(texts, [(1000 + i, ["most", f"rare{i}"]) for i in range(120)], 10).items():
        first = [r for r, (_, i) in enumerate(x) if 1000 + i % 200 == q]
        want[q] = (0.1, 1.0, 1 / (1 + first[0])) if first else (0.0, 0.0, 0.0)
    assert {r.query_id: (r.precision, r.recall, r.reciprocal_rank) for r in found.collect()} == want
