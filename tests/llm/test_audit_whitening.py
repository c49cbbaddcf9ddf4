import math
import random
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from millrace.llm import interactions, queries, whitening

DOCS = "doc_id long, text string, source string, bits int, part string, digest int, least long, places int"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def plain_audit(rows, labels):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    out = Counter()
    orders = ["".join(p) for p in permutations("ABCDE")]
    for i, t, part in rows:
        t, part = t or "", part or ""
        words = t.encode().split()
        bad = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > least[t]}
        for o in orders:
            first = next((k for k, f in enumerate(o) if bad[f]), 9)
            for k, f in enumerate(o):
                found = {"kept": first > k, "removed": first == k, "redundant": bad[f] and first < k, "unique_fails": bad[f] and sum(bad.values()) == 1, "good_lost": first == k and i in good, "toxic_lost": first == k and i in toxic}
                for name, yes in found.items():
                    out[part, o, k + 1, name] += yes
                out[part, f] += first == k
    return sorted((part, o, k + 1, *(out[part, o, k + 1, c] for c in COUNTS[:-1]), out[part, f]) for part in {p or "" for _, _, p in rows} for o in orders for k, f in enumerate(o))


def audited(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1, "p", 2, 3, 4) for r in rows], DOCS)
    marks = spark.createDataFrame([(*x, 1, "p") for x in labels], "doc_id long, quality int, toxic int, bits int, part string")
    got = interactions.audit(interactions.flags(docs), marks)
    assert got.columns == ["part", "filter_order", "step", *COUNTS]
    return sorted(map(tuple, got.collect()))


def test_audit_against_the_plain_way(spark):
    r = random.Random(3)
    words = [f"word{k}" for k in range(400)]
    texts = [" ".join(r.choice(words[: r.choice([5, 400])]) for _ in range(r.choice([50, 210, 260]))) + r.choice(["", " #", " ABCDEFGHIJKLMNOPQRSTUVWXYZABCDEFGHIJKLMNOPQRSTUVWXYZ"]) for _ in range(25)]
    rows = [(r.randint(1, 60), r.choice(texts), r.choice(["a", "b", None, ""])) for _ in range(90)]
    rows += [(1, None, "a"), (2, "", "a"), (None, texts[0], "a"), (None, "", None), (3, "x y\x0bz\xa0w", "c"), (4, "w " * 100_000, "c"), (5, "w " * 100_000, "c"), (5, "w " * 100_000, "c")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(1, 40)] + [(7, 1, 1), (7, 0, 0), (None, 1, 1)]
    assert audited(spark, rows, labels) == plain_audit(rows, labels)


def test_audit_of_copies_of_one_text_and_of_an_empty_table(spark):
    rows = [(i, "one text for all", "hot") for i in range(3000)] + [(5000 + i, f"text {i}", "cold") for i in range(3000)]
    assert audited(spark, rows, []) == plain_audit(rows, [])
    assert audited(spark, [], []) == []


def plain_whitening(rows, k=16):
    """By exact sums and a symmetric solver."""
    ok = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) and abs(c) <= 2**40 for c in v)]
    sizes = Counter(len(v) for _, v in ok)
    d = max(sizes, key=lambda s: (sizes[s], s)) if sizes else 0
    x = [(i, tuple(math.floor(64 * c) + 1_000_000 for c in v)) for i, v in ok if len(v) == d]
    points = sorted({p for _, p in x})
    n = len(points)
    if n < 2:
        return n, [], None, None, None
    total = [sum(c) for c in zip(*points)]
    off = lambda p: [n * a - s for a, s in zip(p, total)]
    centred = np.array([[a / n for a in off(p)] for p in points])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(k, int((values > 1e-12 * values[0]).sum()))
    trace = sum(a * a for p in points for a in off(p)) / n**3
    out = [(i, sum(a * a for a in off(p)), np.array([a / n for a in off(p)]) @ vectors[:, :k] / np.sqrt(values[:k])) for i, p in x]
    return n, out, values[:k], trace, k


def check(spark, rows, size="double"):
    frame = spark.createDataFrame([(i, v, 1, "x", 2.0) for i, v in rows], f"vec_id long, embedding array<{size}>, n int, x string, whitened double")
    n, want, values, trace, k = plain_whitening(rows)
    got = whitening.whiten(frame).collect()
    assert len(got) == (len(want) * k if k else 0)
    if not k:
        return
    found = {}
    for r in got:
        found.setdefault((str(r.vec_id), int(r.deviation)), {}).setdefault(r.component, []).append(r.whitened)
        assert r.n == n and abs(r.explained - values[r.component - 1] / trace) <= 1e-9 * r.explained + 1e-12 and r.identity_error <= 1e-4
    by = {}
    for i, deviation, w in want:
        by.setdefault((str(i), deviation), []).append(w)
    assert set(by) == set(found)
    gaps = [j for j in range(k) if min([abs(values[j] - v) for m, v in enumerate(values) if m != j], default=1) > 1e-6 * values[0]]
    for j in gaps:
        a = np.array([sorted(found[key][j + 1])[0] for key in by])
        b = np.array([sorted(w[j] for w in by[key])[0] for key in by])
        c = np.array([sorted(-w[j] for w in by[key])[0] for key in by])
        assert min(abs(a - b).max(), abs(a - c).max()) < 1e-6, j


def test_whitening_against_the_plain_way(spark):
    r = np.random.default_rng(5)
    mix = r.normal(size=(40, 40)) * np.linspace(0.05, 2, 40)
    rows = [(i, (r.normal(size=40) @ mix).tolist()) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(200)] + [(None, rows[1][1]), (7, rows[2][1]), (7, rows[2][1]), (900, None), (901, []), (902, [None] + [1.0] * 39), (903, [float("nan")] * 40), (904, [float("inf")] + [0.0] * 39), (905, [1e300] * 40), (906, [1.0] * 39)]
    check(spark, rows)


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(1, [0.5, 0.5])] * 3,
        [(1, [0.5, 0.5]), (2, [1.5, 0.5])],
        [(i, [i / 4, i / 2, 3.0]) for i in range(50)],
        [(i, [2.0**30 + i % 5, float(i % 7), float(i * i % 11)]) for i in range(40)],
        [(i, [(2.0**39) * (i % 3), float(i % 7) * 2**36]) for i in range(40)],
        [(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0]), (3, [2.0, 1.0, 5.0]), (4, [2.0, 2.0])],
    ],
)
def test_whitening_of_small_and_far_tables(spark, rows):
    check(spark, rows)


def test_wide_numbers_are_exact():
    x = np.array([[2**45, 3], [5, 2**44]])
    off = whitening._offsets(x, 10**9, [7, 11])
    assert off.tolist() == [[10**9 * int(a) - s for a, s in zip(row, (7, 11))] for row in x.tolist()]
    assert whitening._deviation(off) == [sum(v * v for v in row) for row in off.tolist()]


def test_op13_is_the_plain_one(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    n, want, values, trace, k = plain_whitening(rows)
    want = {i: (d, w) for i, d, w in want}
    got = queries.op13_whitening(spark, sf).collect()
    assert len(got) == 16 * len(rows) and k == 16
    signs = [0.0] * 16
    for r in got:
        signs[r.component - 1] += r.whitened * want[r.vec_id][1][r.component - 1]
    for r in got:
        deviation, w = want[r.vec_id]
        j = r.component - 1
        assert r.n == n and r.deviation == deviation and abs(r.whitened - math.copysign(1, signs[j]) * w[j]) < 1e-8
        assert abs(r.explained - values[j] / trace) < 1e-10 and r.identity_error < 1e-10
