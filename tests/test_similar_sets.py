from __future__ import annotations

from itertools import combinations

import numpy as np

from loomframe.operators import similarity


def _sets() -> dict[int, set[str]]:
    r = np.random.default_rng(11)
    out: dict[int, set[str]] = {}
    for i in range(0, 300, 3):
        one = {f"t{x}" for x in r.integers(0, 45, r.integers(2, 26))}
        out |= {i: one, i + 1: one ^ {f"t{x}" for x in r.integers(0, 45, 2)} | {f"own{i}"}, i + 2: one ^ {f"t{r.integers(0, 45)}"} | {"t0"}}
    return out | {300: {f"t{x}" for x in range(10)}, 301: {f"t{x}" for x in range(7)}, 302: {"single"}, 303: {"single", "t1"}}


def test_similar_sets_equal_all_pairs_and_no_join_lists_pairs_by_term(spark, monkeypatch):
    sets = _sets()
    df = spark.createDataFrame([(k, sorted(s)) for k, s in sets.items()] + [(400, []), (401, None)], "k long, terms array<string>")
    least: dict[frozenset, int] = {}
    for k, s in sorted(sets.items()):
        least.setdefault(frozenset(s), k)
    for threshold in (0.5, 0.7, 0.8):
        want = {tuple(sorted((a, b))): len(s & t) / len(s | t) for (s, a), (t, b) in combinations(least.items(), 2) if len(s & t) / len(s | t) >= threshold}
        for rows in (65_536, 7):  # also with the terms cut into slices
            monkeypatch.setattr(similarity, "SLICE", rows, raising=False)
            found = similarity.similar_sets(df, "k", "terms", threshold)
            joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x]
            assert len(joins) == 2, "only the sets of the pairs that are left are joined"
            assert {(p.a, p.b): p.similarity for p in found.collect()} == want


def test_merge_groups_work_out_the_sets_once(spark):
    sets = _sets()
    rows = [(k, sorted(s)) for k, s in sets.items()] + [(500 + k, sorted(sets[k])) for k in range(0, 90, 9)]
    df = spark.createDataFrame(rows, "k long, terms array<string>")
    found = similarity.merge_groups(df, "k", "terms", 0.7)
    assert "sha2" not in found._jdf.queryExecution().optimizedPlan().toString(), "the sets are not hashed again for every use"
    name, best = {k: k for k, _ in rows}, {k: 0.0 for k, _ in rows}
    held = dict(rows)
    close = [(a, b, len({*held[a]} & {*held[b]}) / len({*held[a]} | {*held[b]})) for a, b in combinations(held, 2)]
    close = [x for x in close if x[2] >= 0.7]
    for _ in name:
        for a, b, _s in close:
            name[a] = name[b] = min(name[a], name[b])
    for a, _, s in close:
        best[name[a]] = max(best[name[a]], s)
    size = {g: sum(x == g for x in name.values()) for g in name.values()}
    want = {(k, g, round(best[g], 3)) for k, g in name.items() if size[g] > 1}
    assert {tuple(r) for r in found.collect()} == want
