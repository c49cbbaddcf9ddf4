import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import queries, repeats


def plain(rows, length=50):
    """rows: (doc_id, bytes). The smallest id in which each string starts, then the bytes that go."""
    least = {}
    for i, t in rows:
        if i is not None:
            for s in range(len(t) - length + 1):
                w = t[s : s + length]
                least[w] = min(i, least.get(w, i))
    out = []
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        if i is not None:
            for s in range(len(t) - length + 1):
                if least[t[s : s + length]] < i:
                    gone[s : s + length] = True
        spans = int(np.sum(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((str(i), len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df, **options):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(df, **options).collect())


def texts(seed, n=60):
    rng = random.Random(seed)
    words = ["the", "of", "and", "thing", "ré", "tion", "a", "über"]
    prose = lambda k: " ".join(rng.choice(words) + rng.choice(words) for _ in range(k))
    passages = [prose(20) for _ in range(4)]
    out = []
    for _ in range(n):
        t = prose(rng.randrange(0, 60))
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(passages)
            at, cut = rng.randrange(0, len(t) + 1), rng.randrange(0, 30)
            t = t[:at] + p[cut : len(p) - rng.randrange(0, 30)] + t[at:]
        out.append(t)
    out += [out[3], out[5], out[3], out[7][:-1] + "!", "ab" * 200, "ab" * 150, "x" * 500, "x" * 49, "x" * 50, "", "\0" * 120, "y" + "\0" * 90 + "z"]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_removal_matches_brute_force(spark, seed):
    own = texts(seed)
    ids = list(range(len(own)))
    random.Random(seed).shuffle(ids)
    rows = list(zip(ids, own))
    df = spark.createDataFrame([(i, t, "b") for i, t in rows], "doc_id long, text string, blob string").repartition(3)
    assert got(df, parts=[1, 3, 7][seed]) == plain([(i, t.encode()) for i, t in rows])


@pytest.mark.parametrize(("parts", "fan"), [(7, 2), (30, 5)])
def test_two_levels_of_dealing_change_nothing(spark, parts, fan):
    own = list(enumerate(texts(11)))
    df = spark.createDataFrame(own + [(None, own[3][1])] * 3, "doc_id long, text string").repartition(3)
    assert got(df, parts=parts, fan=fan) == plain([(i, t.encode()) for i, t in own + [(None, own[3][1])] * 3])
    names = lambda d: sorted((r.repeat_id, r.doc_id, r.start, r.n_occurrences) for r in d.collect())
    few = df.where("doc_id < 12")
    assert names(repeats.maximal_repeats(few, parts=parts, fan=fan)) == names(repeats.maximal_repeats(few, parts=1))


def test_blobs_stay_large_at_any_number_of_parts():
    rng = np.random.default_rng(4)
    own = [bytes(rng.integers(97, 123, 100_000, dtype=np.uint8)).decode() for _ in range(20)]
    found = {}
    for n in (240, 24_000, 800_000):
        batch = pa.RecordBatch.from_arrays([pa.array(range(20), pa.int64()), pa.array(rng.integers(0, n, 20), pa.int32()), pa.array(own)], ["doc_id", "part", "text"])
        size = repeats.group_size(n, repeats.FAN)
        sent = pa.Table.from_batches(list(repeats._send_hashes(n, 50, 24, size)([batch])))
        groups = sent.sort_by("key")
        cut = list(repeats._regroup({b"": (np.uint32, np.uint64, np.uint8)})(groups.to_batches())) if size > 1 else []
        found[n] = sent.num_rows, sum(len(b) for b in sent.column("blob").to_pylist())
        keys = [k for b in cut for k in b.column(0).to_pylist()]
        assert found[n][0] <= max(240, 1.2 * n**0.5) and all(0 <= k < n for k in keys)
        assert size == 1 or {k // size for k in keys} == set(groups.column("key").to_pylist())
    assert found[800_000][1] < 2 * found[240][1]


def test_edge_rows(spark):
    long = "Some words that go on for more than fifty bytes, here and there."
    rows = [(1, long), (1, long), (1, "other text of the same id " * 4), (None, long), (None, None), (2, None), (3, long), (4, long + "x"), (5, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == plain([(i, (t or "").encode()) for i, t in rows])
    assert got(spark.createDataFrame([], "doc_id long, text string")) == []


def test_long_texts_cross_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    a = rng.integers(97, 123, 3 * repeats.BLOCK // 2, dtype=np.uint8).tobytes()
    at = repeats.BLOCK - 60
    rows = [(1, a.decode()), (2, "q" * 70_000 + a[at : at + 120].decode()), (3, a[: repeats.BLOCK + 25].decode())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == plain([(i, t.encode()) for i, t in rows])


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(df) == plain([(r.doc_id, r.text.encode()) for r in df.collect()])


def test_intervals_are_those_of_the_definition():
    rng = random.Random(1)
    for _ in range(50):
        lcp = [rng.randrange(0, 4) for _ in range(rng.randrange(1, 12))]
        want = set()
        for i in range(len(lcp)):
            for j in range(i, len(lcp)):
                low = min(lcp[i : j + 1])
                if (i == 0 or lcp[i - 1] < low) and (j == len(lcp) - 1 or lcp[j + 1] < low):
                    want.add((low, i, j + 1))
        found = repeats.intervals(lcp)
        assert sorted(found) == sorted(want)


def test_maximal_repeats_list_all_occurrences(spark):
    p = "".join(random.Random(9).choice("abcdefghijklmnop") for _ in range(60))
    rows = [(1, "1" * 30 + p + "2" * 30), (2, "3" + p + "4"), (3, p), (4, "none of that here, but a text of more than fifty bytes")]
    out = repeats.maximal_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    whole = {}
    for r in out:
        t = dict(rows)[r.doc_id].encode()
        assert hashlib.sha256(t[r.start : r.start + r.n_bytes]).hexdigest() == r.repeat_id
        whole.setdefault(r.repeat_id, set()).add((r.doc_id, r.start, r.n_bytes, r.n_occurrences))
    covered = {d: set() for d, _ in rows}
    for occurrences in whole.values():
        assert {d for d, *_ in occurrences} == {1, 2, 3}
        for d, s, n, _ in occurrences:
            covered[d] |= set(range(s, s + n))
    assert {d: len(c) for d, c in covered.items()} == {1: 60, 2: 60, 3: 60, 4: 0}


def test_rows_of_many_parts_are_few_files(spark, small_tasks, tmp_path):
    queries.op8_repeated_passages(spark, "/root/testdata/sf0.01").write.parquet(f"file://{tmp_path}/out")
    assert len(list(tmp_path.glob("out/*.parquet"))) <= 3 and spark.read.parquet(f"file://{tmp_path}/out").count() == 1000
