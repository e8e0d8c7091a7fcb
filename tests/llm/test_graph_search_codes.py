"""Neighbour graph, ranked search and vector codes against brute force."""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
import cases  # noqa: E402

from rollbook.llm import vector_codes  # noqa: E402
from rollbook.llm.neighbour_graph import linked_vectors  # noqa: E402
from rollbook.llm.ranked_search import ranked  # noqa: E402

VECTORS = "vec_id long, embedding array<double>, label string, node string, kind string, component string, error string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], VECTORS)


# -- neighbour graph ------------------------------------------------------------------------------

def graph_by_loop(rows, threshold=0.93):
    """(n_links, component) of every distinct row, by comparing all of them."""
    distinct = list(dict.fromkeys((i, tuple(v) if v is not None else None, lab) for i, v, lab in rows))

    def usable(r):
        return r[0] is not None and r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])

    out = {r: [0, {r}] for r in distinct}
    for a in distinct:
        for b in distinct:
            if usable(a) and usable(b) and a < b and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = (np.array(c[1]) / max(map(abs, c[1])) for c in (a, b))
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold:
                    for p, q in ((a, b), (b, a)):
                        out[p][0] += 1
                        out[p][1].add(q)
    seen = {}
    for r in distinct:
        if r not in seen:
            group, todo = set(), [r]
            while todo:
                one = todo.pop()
                if one not in group:
                    group.add(one)
                    todo += out[one][1]
            for one in group:
                seen[one] = None if one[0] is None else min(g[0] for g in group)
    return {r: (out[r][0], seen[r]) for r in distinct}


def graph_rows():
    rng = np.random.default_rng(5)
    centre = rng.normal(size=12)
    near = [(1000 + i, (centre + 0.1 * rng.normal(size=12)).round(6).tolist(), "a") for i in range(150)]
    turned = [(2000 + i, [math.cos(i / 10), math.sin(i / 10)], "a") for i in range(45)]  # a chain, each linked with a few
    free = [(i, rng.normal(size=12).round(6).tolist(), "ab"[i % 2]) for i in range(100)]
    copies = [(300 + i, [1.0, 2.0, 3.0], "b") for i in range(40)] + [(350, [2.0, 4.0, 6.0], "b"), (351, [1.0, 2.0, 3.0], "a")]
    bad = [(400, None, "a"), (401, [], "a"), (402, [0.0] * 12, "a"), (403, [1.0, None], "a"), (404, [float("nan"), 1.0], "a"),
           (405, [1.0, 2.0, 3.0], None), (406, [1.0, 2.0, 3.0], None), (None, [1.0, 2.0, 3.0], "b"), (407, [float("inf"), 1.0], "a"),
           (408, [1e200, 2e200, 3e200], "b"), (409, [1e-200, 2e-200, 3e-200], "b")]
    return near + turned + free + copies + bad


def test_graph_equals_brute_force(spark):
    rows = graph_rows()
    rows += [rows[0], rows[200], rows[-4], (1000, [1.0] * 12, "c"), (7, [5.0, 5.0, 5.0], "b")]
    want = graph_by_loop(rows)
    for block in (192, 16):
        got, audit = linked_vectors(vectors(spark, rows), block=block, leaf=32)
        assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
        have = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in got.collect())
        every = [want[(i, tuple(v) if v is not None else None, lab)] + (i,) for i, v, lab in rows if not (v and any(x is not None and math.isnan(x) for x in v))]
        every += [(0, 404, 404)]
        assert have == Counter((i, n, c, i is None or i == c) for n, c, i in every)
        assert audit.recall == 1.0


def test_graph_of_few_and_none(spark):
    assert linked_vectors(vectors(spark, []))[0].count() == 0
    got = linked_vectors(vectors(spark, [(5, [1.0, 0.0], "a"), (3, [1.0, 0.1], "a"), (4, None, "a")]))[0].collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(3, 1, 3, True), (4, 0, 4, True), (5, 1, 3, False)]


def test_graph_finds_what_short_lists_miss(spark):
    """Lists of two neighbours and one ordering: saturated lists are enlarged, the audit adds the rest."""
    rng = np.random.default_rng(8)
    rows = [(10 * g + j, (c + 0.05 * rng.normal(size=8)).tolist(), "a") for g in range(30) for c in [rng.normal(size=8)] for j in range(10)]
    want = graph_by_loop(rows)
    got, audit = linked_vectors(vectors(spark, rows), trees=1, neighbours=2, rounds=1, leaf=8, audit=300)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got.collect()} == {k[0]: v for k, v in want.items()}
    assert audit.links > 0


# -- ranked search --------------------------------------------------------------------------------

def terms(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)


def ranks_by_loop(docs, queries, k):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    there = [c for _, c in counts if c]
    n_docs, total = len(there), sum(sum(c.values()) for c in there)
    df = Counter(t for c in there for t in c)
    out = []
    for q, text in dict.fromkeys(queries):
        found = []
        for i, c in counts:
            if i is None:
                continue
            m = 50 + (50 * sum(c.values()) * n_docs) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m))
                        for t in set(terms(text)) if c[t])
            if score > 0:
                found.append((-score, i))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


QUERIES = [(1, "alpha3 BETA5 gamma7 omega one two"), (2, "the password, and token: user"), (3, None), (4, ""), (5, "nothing-known"),
           (1, "alpha3 BETA5 gamma7 omega one two"), (6, "Übung macht den Meister"), (7, "é 中文"), (8, " ".join(f"chi{i} psi{i}" for i in range(41))),
           (None, "deadbeefdeadbeefdeadbeef0123")]


@pytest.mark.parametrize("sizes", [{}, {"short": 0.2, "block": 7, "shard": 5, "window": 2}, {"short": 0.0, "shard": 64, "window": 8}, {"short": 1.0}])
def test_ranks_equal_brute_force(spark, sizes):
    rows = cases.rows()
    docs = cases.table(spark)
    queries = spark.createDataFrame([(*q, 0, "x") for q in QUERIES], "item_id long, text string, doc_id long, score string")
    for k in (3, 50):
        got = ranked(docs, queries, k=k, **sizes)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == ranks_by_loop([r[:2] for r in rows], QUERIES, k)


def test_ranks_of_empty_tables_and_long_texts(spark):
    queries = spark.createDataFrame(QUERIES, "item_id long, text string")
    assert ranked(cases.empty(spark), queries).count() == 0
    assert ranked(cases.table(spark), queries.limit(0)).count() == 0
    long = " ".join(f"word{i % 5000}" for i in range(400_000))  # 3.5 MB
    docs = [(1, long), (2, "word7 word8"), (3, "word7 " * 5), (4, "other")]
    asked = [(1, "word7 word8 other")]
    got = ranked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "item_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == ranks_by_loop(docs, asked, 50)


# -- vector codes ---------------------------------------------------------------------------------

def codes_by_loop(rows, parts=8, entries=16, rounds=6):
    """Codes, errors and codebooks in Python's integers."""
    most = (1 << 31) - 1
    kept = [(i, lab, [max(-most, min(most, math.floor(4096 * x))) for x in v]) for i, v, lab in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]
    length = max(Counter(len(v) for _, _, v in kept).items(), key=lambda x: (x[1], -x[0]))[0]
    kept = [r for r in kept if len(r[2]) == length]
    width = -(-length // parts)
    cut = lambda v, p: (v + [0] * (parts * width - length))[p * width : (p + 1) * width]
    firsts = sorted({i for i, _, _ in kept if i is not None})[:entries]
    seeds = [min(v for j, _, v in kept if j == i) for i in firsts]
    books = [[cut(v, p) for v in seeds] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = [cut(v, p) for _, _, v in kept]
            best = [nearest(x, books[p])[1] for x in own]
            for e in range(len(books[p])):
                got = [x for x, b in zip(own, best) if b == e]
                if got:
                    books[p][e] = [sum(c) // len(got) for c in zip(*got)]
    out = []
    for i, lab, v in kept:
        best = [nearest(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, lab, [e for _, e in best], min(sum(d for d, _ in best), (1 << 63) - 1)))
    return out, books


def code_rows(dims):
    rng = np.random.default_rng(dims)
    good = [(i, rng.normal(size=dims).round(3).tolist(), [None, "a", "b"][i % 3]) for i in range(20, 160)]
    ties = [(i, [0.5] * dims, "a") for i in range(200, 230)]
    odd = [(1, None, "a"), (2, [], "a"), (3, [float("nan")] * dims, "a"), (4, [1.0] * (dims - 1) + [None], "a"), (5, [0.0] * dims, "c"),
           (6, [float("inf")] * dims, "a"), (None, [0.25] * dims, "a"), (7, [1.0, 2.0], "a"), (20, [-9.0] * dims, "a")]
    return good + ties + odd + good[:5]


@pytest.mark.parametrize(("dims", "block"), [(16, 256), (16, 3), (11, 20), (40, 16)])
def test_codes_equal_brute_force(spark, dims, block):
    rows = code_rows(dims)
    got, books = vector_codes.compressed(vectors(spark, rows), block=block)
    want, own = codes_by_loop(rows)
    key = lambda r: (str(r[0]), str(r[1]), r[2], r[3])
    assert sorted(((r.vec_id, r.label, r.codes, r.error) for r in got.collect()), key=key) == sorted(want, key=key)
    assert books.tolist() == own


def test_codes_of_huge_components(spark):
    rows = [(i, [1e5 * i, -3e5, 7.0, 1e30, -1e30, 0.0, 2e4 * (i % 3), 1.0], "a") for i in range(40)]
    got, books = vector_codes.compressed(vectors(spark, rows), entries=4)
    want, own = codes_by_loop(rows, entries=4)
    assert sorted((r.vec_id, r.codes, r.error) for r in got.collect()) == sorted((i, c, e) for i, _, c, e in want)
    assert books.tolist() == own


def test_codes_of_few_and_none(spark):
    none, books = vector_codes.compressed(vectors(spark, []))
    assert none.columns == ["vec_id", "label", "codes", "error"] and none.count() == 0
    few = [(i, [float(i)] * 8, None) for i in range(5)]
    got, books = vector_codes.compressed(vectors(spark, few))
    assert all(r.error == 0 and r.decoded == [float(r.vec_id)] * 8 for r in vector_codes.decoded(got, books).collect())


def test_shortlists_hold_every_nearest_entry():
    rng = np.random.default_rng(1)
    for _ in range(300):
        values = rng.integers(-40, 40, (12, 3)) + rng.integers(-100, 100, 3)
        book = rng.integers(-100, 100, (9, 3))
        listed = vector_codes.shortlist(values.min(axis=0), values.max(axis=0), book)
        entry, far = vector_codes.assigned(values, book, listed)
        every = ((values[:, None, :] - book[None]) ** 2).sum(axis=2)
        assert (entry == every.argmin(axis=1)).all() and (far == every.min(axis=1)).all()
