"""Operators over texts against brute force."""

import hashlib
from collections import defaultdict

import pytest

from corpuslens.llm.jaccard_join import jaccard_components, jaccard_keep_one
from corpuslens.llm.license_scan import TEMPLATES, scan_licenses
from corpuslens.llm.mixing import mix_sources
from corpuslens.llm.substring_dedup import substring_dedup

from .conftest import null_last


def words(text, fold=False):
    raw = (text or "").encode()
    if fold:
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    return raw.split()


def brute_substrings(rows, w):
    first, kept = {}, []
    for d, t in sorted(rows, key=lambda r: null_last(r[0])):
        ws = words(t)
        for i in range(len(ws) - w + 1):
            first.setdefault(tuple(ws[i : i + w]), (null_last(d), i))
    for d, t in rows:
        ws = words(t)
        gone = [False] * len(ws)
        for i in range(len(ws) - w + 1):
            if first[tuple(ws[i : i + w])] < (null_last(d), i):
                gone[i : i + w] = [True] * w
        kept.append((d, len(ws), sum(gone), b" ".join(x for x, g in zip(ws, gone) if not g).decode()))
    return sorted(kept, key=lambda r: (null_last(r[0]), r[3]))


@pytest.mark.parametrize("window", [20, 7])
def test_substring_dedup(docs, corpus, window):
    got = [(r.doc_id, r.n_words, r.n_removed, r.text) for r in substring_dedup(docs, window=window).collect()]
    assert sorted(got, key=lambda r: (null_last(r[0]), r[3])) == brute_substrings([r[:2] for r in corpus], window)


@pytest.mark.parametrize("window", [20, 5])
def test_substring_factors(docs, corpus, window):
    """Every factor has the words of its source, which is earlier, and ends where the source goes on otherwise, the text
    ends, or the next factor begins."""
    text = {d: words(t) for d, t, *_ in corpus}
    first = {}
    for d in sorted(text, key=null_last):
        for i in range(len(text[d]) - window + 1):
            first.setdefault(tuple(text[d][i : i + window]), (d, i))
    n = 0
    for r in substring_dedup(docs, window=window).where("doc_id IS NOT NULL").collect():
        w, covered, end = text[r.doc_id], [], -1
        for f in r.factors:
            assert f.start >= end and f.words > 0
            source = text[f.source_id]
            assert w[f.start : f.start + f.words] == source[f.source_start : f.source_start + f.words]
            assert (null_last(f.source_id), f.source_start) < (null_last(r.doc_id), f.start)
            end = f.start + f.words
            after = tuple(w[end - window + 1 : end + 1])
            follows = any(g.start == end for g in r.factors)
            assert follows or end == len(w) or first[after] == (r.doc_id, end - window + 1)
            covered += range(f.start, end)
            n += 1
        assert covered == [i for s in r.spans for i in range(s.start, s.start + s.words)]
        assert len(covered) == r.n_removed
    assert n > 20


def test_substring_spans_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a " * 30), (1, "a " * 30), (2, "x y"), (3, "a " * 25)], "doc_id long, text string")
    rows = {(r.doc_id, r.n_removed, tuple(tuple(s) for s in r.spans)) for r in substring_dedup(df).collect()}
    assert rows == {(1, 29, ((1, 29),)), (2, 0, ()), (3, 25, ((0, 25),))}
    assert substring_dedup(df.limit(0)).count() == 0


def shingles(text, k):
    w = words(text, fold=True)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(rows, k, percent):
    parent = {}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(d, shingles(t, k)) for d, t in rows]
    for d, _ in sets:
        parent.setdefault(d, d)
    for i, (d, x) in enumerate(sets):
        for e, y in sets[i + 1 :]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[root(d)] = root(e)
    groups = defaultdict(list)
    for d in parent:
        groups[root(d)].append(d)
    least = {d: min(g, key=null_last) for g in groups.values() for d in g}
    return sorted(((d, len(s), least[d]) for d, s in sets), key=lambda r: null_last(r[0]))


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (2, 50)])
def test_jaccard_components(docs, corpus, k, percent):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(docs, k=k, percent=percent).collect()]
    assert sorted(got, key=lambda r: null_last(r[0])) == brute_components([r[:2] for r in corpus], k, percent)


def test_jaccard_keeps_the_smallest_of_each_group(docs, corpus):
    kept = jaccard_keep_one(docs)
    want = {d for d, _, c in brute_components([r[:2] for r in corpus], 5, 80) if d == c}
    assert {r.doc_id for r in kept.collect()} == want
    assert kept.columns == docs.columns
    assert jaccard_components(docs.limit(0)).count() == 0


def test_mixing_targets(docs, corpus):
    rows = mix_sources(docs).collect()
    size = defaultdict(int)
    for _, t, _, s in corpus:
        size[s] += len(words(t))
    budget = 1.5 * sum(size.values())
    names = sorted(size, key=null_last)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    while open_:  # water filling by rounds
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * size[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2 * size[s] for s in full}
        open_ -= full
    taken, longest = defaultdict(int), defaultdict(int)
    assert len(rows) == len(corpus)
    for r in rows:
        assert r.source_size == size[r.source]
        assert r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
    for s in names:
        assert abs(taken[s] - target[s]) <= longest[s] + 1
    again = mix_sources(docs.repartition(3)).collect()
    assert sorted((str(r.doc_id), r.taken) for r in again) == sorted((str(r.doc_id), r.taken) for r in rows)
    assert mix_sources(docs.limit(0)).count() == 0


def test_mixing_shares_copies_among_equal_rows(spark):
    df = spark.createDataFrame([(1, "a b c", None)] * 3 + [(2, "d", "x"), (None, None, "x")], "doc_id long, text string, source string")
    rows = mix_sources(df).collect()
    assert all(r.copies <= 2 for r in rows)
    assert len({r.copies for r in rows if r.doc_id == 1}) <= 2


def test_mixing_is_native(docs):
    plan = mix_sources(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_licenses(rows):
    import re

    from corpuslens.llm.license_scan import _SIGNS, CONTAINMENT, SHINGLE

    grams = lambda t: [tuple(w[i : i + SHINGLE]) for w in [[x for x in re.split(_SIGNS, (t or "").lower()) if x]] for i in range(len(w) - SHINGLE + 1)]
    out = []
    for d, t in rows:
        g = grams(t)
        for name, notice in TEMPLATES.items():
            known = set(grams(notice))
            shares = [(len(known & set(g[i : i + 2 * len(known)])) / len(known), i) for i in range(len(g)) if g[i] in known]
            if shares and max(shares)[0] >= CONTAINMENT:
                out.append((d, name, max(shares)[0], min(i for s, i in shares if s >= CONTAINMENT)))
    return sorted(out, key=str)


def test_licenses(spark):
    """Whole notices anywhere, notices with a word changed here and there, near misses, odd texts, repeated rows."""
    import random

    rng = random.Random(3)
    filler = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor".split()
    pad = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    rows = [(i, f"{pad(j)}\n{text}\n{pad(9)}") for i, text in enumerate(TEMPLATES.values()) for j in range(5)]
    for i, text in enumerate(TEMPLATES.values()):
        for n in (1, 2, 4):
            w = text.split()
            for _ in range(n):
                w[rng.randrange(len(w))] = "changed"
            rows.append((100 * n + i, f"{pad(7)} {' '.join(w)} {pad(7)}"))
    rows += [(900, pad(20)), (901, None), (902, ""), (903, "Released under the MIT"), (904, "RELEASED under, the mit License"), (None, f"{pad(20_000)} {TEMPLATES['ISC']} {pad(10)}")]
    rows += [rows[0], rows[0], (905, " ".join(TEMPLATES.values()))]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, license string, row int")
    got = sorted(((r.doc_id, r.license, r.containment, r.at) for r in scan_licenses(df).collect()), key=str)
    assert got == brute_licenses(rows)
    assert {(i, name) for i, name in enumerate(TEMPLATES)} <= {g[:2] for g in got}
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_licenses_are_native(docs):
    plan = scan_licenses(docs)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEval" not in plan and "MapInArrow" not in plan and "PythonUDF" not in plan


def test_operators_do_not_depend_on_partitions(docs):
    one = substring_dedup(docs.coalesce(1)).select("doc_id", "text").collect()
    many = substring_dedup(docs.repartition(9)).select("doc_id", "text").collect()
    digest = lambda rows: hashlib.sha256(repr(sorted(map(str, rows))).encode()).hexdigest()
    assert digest(one) == digest(many)
