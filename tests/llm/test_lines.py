import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import line_dedup
from millrace.llm.cuckoo import Cuckoo, halves

DOCS = "doc_id long, text string, digest string, h int, shard string, row int, refs int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", 2, 3) for i, t in rows], DOCS)


def key(i):
    return hashlib.sha256(str(i).encode()).digest()[:16]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.sets(st.integers(0, 400), max_size=150)), max_size=12), st.integers(1, 600))
def test_filter_holds_what_was_added_and_not_removed(steps, size):
    held, now = Cuckoo.sized(size), set()
    for adds, own in steps:
        own = own - now if adds else own & now
        if adds:
            if own and not held.add(halves([key(i) for i in own])):
                return  # full
            now |= own
        elif own:
            held.remove(halves([key(i) for i in own]))
            now -= own
        assert (held.table != 0).sum() == len(now)
        assert not now or held.contains(halves([key(i) for i in now])).all()
    back = Cuckoo.loads(held.dumps())
    assert all(key(i) in back for i in now)


def test_filter_takes_its_number_and_tells_when_it_is_full():
    keys = halves([key(i) for i in range(50_000)])
    held = Cuckoo.sized(len(keys))
    assert held.add(keys) and held.contains(keys).all()
    others = halves([key(i) for i in range(50_000, 150_000)])
    assert held.contains(others).mean() < 0.001
    assert not Cuckoo.sized(1_000).add(keys)
    with pytest.raises(KeyError):
        Cuckoo.sized(10).remove(keys[:1])


def plain_key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line))


def plain_clean(rows, known=None, min_docs=3):
    held = defaultdict(set)
    for i, t in rows if known is None else known:
        for line in (t or "").split("\n"):
            if len(plain_key(line)) >= 20:
                held[plain_key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        goes = lambda x: len(held.get(plain_key(x), ())) >= min_docs and i != max((d for d in held[plain_key(x)] if d is not None), default=None)
        kept = [x for x in lines if not goes(x)]
        out.append((str(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def cleaned(index, frame):
    return sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.text) for r in line_dedup.clean(index, frame).collect())


def made(n, seed=1):
    r = random.Random(seed)
    lines = [f"{'A common' if k % 3 else 'a COMMON'} line with the number {k}" for k in range(40)] + ["short", "", "  x ", "é" * 20, "é" * 19]
    dress = lambda x: r.choice(["", " ", "\t\x0b"]) + r.choice([x, x.upper() if x.isascii() else x]) + r.choice(["", "\r", "\x0c "])
    return [(i, "\n".join(dress(r.choice(lines)) if r.random() < 0.6 else f"a line of document {i} alone, {r.random()}" for _ in range(r.randint(1, 9)))) for i in range(n)]


EDGES = [(None, "a line that rows without an id hold too"), (None, "A line that rows without an id hold too\n"), (5000, None), (5001, ""), (5002, "\n\n"), (5003, "a line that rows without an id hold too"), (5003, "a line that rows without an id hold too"), (5003, "other text of the id\na line that rows without an id hold too"), (5004, " a line that rows without an id hold too "), (5005, "\xa0" * 20), (5006, "\xa0" * 20), (5007, "\xa0" * 20)]


def test_lines_against_the_plain_way(spark):
    rows = made(120) + EDGES + [(7000 + k, "the long text holds this line twice, as others do\n" * 2 + f"a filling line of some length {k}\n" * 30_000) for k in range(3)]
    frame = docs(spark, rows)
    assert cleaned(line_dedup.build(frame), frame) == plain_clean(rows)


def test_insertions_and_deletions_are_reversible(spark):
    rows, more = made(60), made(150, seed=2)[60:] + [(None, "A common line with the number 1")]
    first = line_dedup.build(docs(spark, rows), shards=3)
    both = line_dedup.insert(first, docs(spark, more))
    assert cleaned(both, docs(spark, rows + more)) == plain_clean(rows + more)
    assert table_of(line_dedup.insert(both, docs(spark, more[:20]))) == table_of(both)  # nothing twice
    gone = spark.createDataFrame([(i,) for i, _ in more] + [(None,), (99_999,)], "doc_id long")
    back = line_dedup.delete(both, gone)
    assert table_of(back) == table_of(first)
    assert cleaned(back, docs(spark, rows)) == plain_clean(rows)
    kept = [r for r in rows + more if r[0] is None or r[0] % 3]
    fewer = line_dedup.delete(both, spark.createDataFrame([(i,) for i in range(0, 150, 3)], "doc_id long"))
    assert cleaned(fewer, docs(spark, rows + more)) == plain_clean(rows + more, kept)
    empty = line_dedup.delete(first, docs(spark, rows))
    assert empty.holdings.isEmpty() and empty.counts.isEmpty() and table_of(empty)[2] == [(0, 0), (1, 0), (2, 0)]


def table_of(index):
    held = [(r.shard, int((np.frombuffer(r["filter"], np.uint16) != 0).sum())) for r in index.filters.collect()]
    return sorted(map(str, index.holdings.collect())), sorted(map(str, index.counts.collect())), sorted(held)


def test_a_full_filter_is_built_anew(spark):
    rows = [(i, "\n".join(f"line number {k} of very many common ones" for k in range(i % 7, 600, 2 + i % 3))) for i in range(12)]
    index = line_dedup.insert(line_dedup.build(docs(spark, rows[:2]), shards=1), docs(spark, rows[2:]))
    assert index.filters.selectExpr("length(filter)").first()[0] > 8
    assert cleaned(index, docs(spark, rows)) == plain_clean(rows)


def test_a_line_of_all_documents_and_an_empty_table(spark):
    rows = [(i, f"this very line is in all of the documents\nand this one is in document {i} alone") for i in range(4000)]
    frame = docs(spark, rows).repartition(4)
    assert cleaned(line_dedup.build(frame), frame) == plain_clean(rows)
    none = docs(spark, [])
    index = line_dedup.build(none)
    assert cleaned(index, none) == [] and cleaned(index, docs(spark, rows[:3])) == plain_clean(rows[:3], [])
