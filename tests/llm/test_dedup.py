import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from millrace.llm import components, exact_dedup, simhash

DOCS = "doc_id long, text string, rep string, fp long, run int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], DOCS)


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_classes(fps):
    """fps: list of (id, fingerprint)."""
    boss = {i: i for i, _ in fps}

    def top(x):
        while boss[x] != x:
            x = boss[x]
        return x

    for i, f in fps:
        for j, g in fps:
            if i < j and (f ^ g).bit_count() <= 2 and top(i) != top(j):
                boss[max(top(i), top(j))] = min(top(i), top(j))
    return {i: top(i) for i in boss}


TEXTS = ["", None, " \n", "one", "ONE", "two words", "a b c", "a  b\tc", "A b c d", "é É x y z", "a b c " * 200, "tie tie tie", "w " * 70_000]


def test_fingerprint_is_the_plain_one():
    for t in TEXTS[:-1]:
        assert simhash.fingerprint(t) == plain_fingerprint(t)
    assert simhash.fingerprint(TEXTS[-1]) == xxhash.xxh64_intdigest(b"w w w", 42)


def test_fingerprint_agrees_with_sparks_hash(spark):
    for s in ("a b c", "é ü", "x" * 100):
        assert spark.sql(f"select xxhash64('{s}') h").first().h % 2**64 == xxhash.xxh64_intdigest(s.encode(), 42)


def test_near_duplicates_of_edge_cases(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "one"), (None, "one"), (None, "only null ids here")]
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    want = plain_classes([(i, plain_fingerprint(t)) for i, t in rows[: len(TEXTS) - 1]])
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None and r.doc_id < len(TEXTS) - 1:
            assert (r.component_id, int(r.fingerprint, 16)) == (want[r.doc_id], plain_fingerprint(TEXTS[r.doc_id]))
    assert sorted(str(r.component_id) for r in got if r.doc_id is None) == ["3", "None"]
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


@pytest.mark.parametrize("bucket", [2, 1024])
def test_links_match_brute_force(spark, bucket):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for f in list(fps)[:60]:  # near ones, chains, and a crowded neighbourhood
        fps |= {f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(2)}
    hub = rng.getrandbits(64)
    fps |= {hub ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)}
    rows = list(enumerate(sorted(fps)))
    reps = spark.createDataFrame([(i, simhash._signed(f)) for i, f in rows], "rep long, fp long")
    parts = components.connected_components(simhash.fingerprint_links(reps, bucket=bucket))
    got = {i: i for i, _ in rows} | {r.node: r.component for r in parts.collect()}
    assert got == plain_classes(rows)


def test_refined_keys_stay_bounded():
    assert max(64 - m.bit_count() for _, _, m in simhash.key_masks(3)) <= 10
    for _, _, m in simhash.key_masks(0):
        assert m.bit_count() >= 31


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000 + i, 1000) for i in range(1, 50)] + [(5, 5), (None, 3)]
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(50)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_of_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in df.collect()]
    want = plain_classes(rows)
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert got == {i: (f, want[i]) for i, f in rows}


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_groups(spark, keep):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, "copy") for i in range(40)] + [(3, "one"), (None, "copy"), (None, "null ids"), (None, "null ids")]
    got = exact_dedup.exact_groups(docs(spark, rows).repartition(7), keep=keep, n_runs=5, fan_in=2).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    assert len(got) == len(rows)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_sha[r.text_sha256]
        best = ({"min": min, "max": max}[keep])([i for i in ids if i is not None], default=None)
        assert (r.keep_id, r.group_size, r.kept) == (best, len(ids), r.doc_id == best)
    assert exact_dedup.exact_groups(docs(spark, [])).count() == 0


def test_deduplicate_keeps_one_row_of_each_text(spark):
    rows = [(1, "a"), (1, "a"), (2, "a"), (3, None), (4, ""), (None, "z"), (None, "z")]
    got = exact_dedup.deduplicate(docs(spark, rows), keep="max")
    assert got.columns == ["doc_id", "text", "rep", "fp", "run"]
    assert sorted((str(r.doc_id), r.text or "") for r in got.collect()) == [("2", "a"), ("4", ""), ("None", "z")]
    assert np.all([r.rep == "x" for r in got.collect()])


@pytest.mark.parametrize("parts", [1, 90])
def test_runs_of_one_partition_and_of_many(spark, parts):
    rows = [(i, f"text {i % 700}" if i % 3 else "the same for a third of them") for i in range(5000)]
    frame = docs(spark, rows).coalesce(1) if parts == 1 else docs(spark, rows).repartition(parts)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(frame, keep="max", stretch=50).collect()}
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    assert got == {i: (max(groups[t]), len(groups[t])) for i, t in rows}


def test_one_partition_is_many_runs(spark, monkeypatch):
    held = []
    real = exact_dedup.written
    monkeypatch.setattr(exact_dedup, "written", lambda df, name: held.append(real(df, name)) or held[-1])
    out = exact_dedup.exact_groups(docs(spark, [(i, "x" * (i % 9)) for i in range(3000)]).coalesce(1), stretch=10)
    assert held[0].selectExpr("shiftright(place, 33) as part").distinct().count() == 1
    runs = [n for n in out._jdf.queryExecution().analyzed().toString().split() if n.startswith("run#")]
    assert runs and out.count() == 3000
    stretches = held[0].selectExpr("pmod(shiftright(place, 33) + floor((place & 8589934591) / 10), 64) as run").groupBy("run").count().collect()
    assert len(stretches) == 64 and max(r["count"] for r in stretches) <= 50


def test_a_very_long_text(spark):
    long = "word " * 2_000_000
    got = exact_dedup.exact_groups(docs(spark, [(1, long), (2, long), (3, long + "x")]), keep="max").collect()
    assert sorted((r.doc_id, r.keep_id, r.text_bytes) for r in got) == [(1, 2, len(long)), (2, 2, len(long)), (3, 3, len(long) + 1)]
