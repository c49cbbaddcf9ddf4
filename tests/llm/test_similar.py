import random
import re
from pathlib import Path

import pytest

from millrace.llm import similar
from millrace.sources import scratch

DOCS = "doc_id long, text string, rep string, fp long, digest int"


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def plain_classes(rows):
    """The smallest id of each text's component, over all pairs."""
    sets = {i: plain_set(t) for i, t in rows}
    boss = {i: i for i in sets}

    def top(x):
        while boss[x] != x:
            x = boss[x]
        return x

    order = sorted(sets, key=lambda i: len(sets[i]))
    for k, i in enumerate(order):
        for j in order[k + 1 :]:
            if len(sets[j]) > 1.25 * len(sets[i]):
                break
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) and top(i) != top(j):
                boss[max(top(i), top(j))] = min(top(i), top(j))
    return {i: top(i) for i in boss}


def found(spark, rows, **how):
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], DOCS)
    return [(r.doc_id, r.component_id) for r in similar.near_duplicates(df, **how).collect()]


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").collect()]
    got = dict(found(spark, rows))
    want = plain_classes(rows)
    kept = {i for i in want if want[i] == i}
    assert len(got) == len(rows) and kept <= {i for i in got if got[i] == i}  # none goes without a link
    missed = sum(got[i] == i for i in want if i not in kept)
    assert missed <= 0.01 * (len(rows) - len(kept))


@pytest.mark.parametrize("bucket", [8, 1024])
def test_large_group_of_near_copies(spark, bucket):
    made = random.Random(1)
    base = [f"w{made.randrange(5000)}" for _ in range(400)]
    rows = []
    for i in range(300):
        words = list(base)
        words[made.randrange(400)] = f"own{i}"
        rows.append((i, " ".join(words)))
    rows += [(i, " ".join(f"w{made.randrange(5000)}" for _ in range(60))) for i in range(300, 400)]
    assert dict(found(spark, rows, bucket=bucket)) == {i: 0 if i < 300 else i for i in range(400)}


def test_odd_rows(spark):
    texts = ["", None, " \n", "one", "ONE", "two words", "a b c d e f", "A b  c d e f", "tie " * 9, "w " * 70_000, "ü é"]
    rows = [*enumerate(texts), (3, "one"), (None, "one"), (None, "only null ids here")]
    got = found(spark, rows)
    want = plain_classes(list(enumerate(texts)))
    assert len(got) == len(rows)
    assert {i: c for i, c in got if i is not None} == want
    assert sorted(str(c) for i, c in got if i is None) == ["3", "None"]
    assert found(spark, []) == []


WORDS = [f"w{i}" for i in range(60)]
ALIKE = [" ".join([*WORDS[:k], "own", *WORDS[k + 1 :]]) for k in (0, 59)] + [" ".join(WORDS)]  # the last is like both


def test_rows_that_share_an_id(spark):
    unique = "a text that is like no other one here at all"
    rows = [(1, ALIKE[2]), (5, ALIKE[0]), (5, unique), (7, ALIKE[1]), (7, ALIKE[1]), (None, ALIKE[0] + " "), (None, "none"), (9, "none"), (None, None), (None, "null ids twice"), (None, "null ids twice")]
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, kept string, _text_hash long, text_hash int")
    got = similar.deduplicate(df)
    assert got.columns == df.columns
    assert sorted((str(r.doc_id), r.text) for r in got.collect() if r.text) == sorted([("1", ALIKE[2]), ("5", unique), ("9", "none"), ("None", "null ids twice")])
    assert got.where("text is null").count() == 1 and similar.deduplicate(df.limit(0)).count() == 0


def test_string_ids_and_a_hub(spark, monkeypatch):
    monkeypatch.setattr(similar._with_sets, "__defaults__", (3,))
    rows = [(f"d{i:03}", " ".join([*WORDS, f"own{i}"])) for i in range(40)] + [("a", "else")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    assert {r.doc_id: r.component_id for r in similar.near_duplicates(df).collect()} == {i: "a" if i == "a" else "d000" for i, _ in rows}


def family(n, background, pairs, at, size=300):
    """n texts that share a passage, any two at a similarity of `background`; the last are `pairs` pairs at `at`."""
    made = random.Random(7)

    def fresh(k):
        return [f"v{made.randrange(10**9)}" for _ in range(k)]

    passage = fresh(round(2 * size * background / (1 + background)) + 4)
    own = size + 4 - len(passage)
    both = round(2 * size * at / (1 + at)) + 4 - len(passage)
    texts = [passage + fresh(own) for _ in range(n - 2 * pairs)]
    for _ in range(pairs):
        shared = passage + fresh(both)
        texts += [shared + fresh(own - both), shared + fresh(own - both)]
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_pairs_within_a_family_of_like_texts(spark):
    rows = family(400, 0.7, 60, 0.82)
    want = {i: i if i < 280 else i - i % 2 for i, _ in rows}
    assert dict(found(spark, rows)) == want


def test_pairs_within_a_large_key(spark):
    rows = family(400, 0.7, 60, 0.82)
    want = {i: i if i < 280 else i - i % 2 for i, _ in rows}
    assert dict(found(spark, rows, bucket=64, block=20_000)) == want


def test_short_working_tables_are_few_files(spark, small_tasks, tmp_path):
    base = [" ".join(f"w{random.Random(i).random()}x{k}" for k in range(300)) for i in range(150)]
    docs = spark.createDataFrame([(2 * i + j, t + f" end{j}", "x", 1, 2) for i, t in enumerate(base) for j in (0, 1)], DOCS).repartition(12)
    with scratch.working_tables(spark) as made:
        assert similar.near_duplicates(docs).where("kept").count() == 150
        files = {}
        for path in made:
            name = path.rsplit("/", 1)[1].rsplit("-", 1)[0]
            files[name] = max(files.get(name, 0), len(list(Path(path.removeprefix("file://")).glob("*.parquet"))))
    assert all(files[x] <= 2 for x in ("sketches", "links", "key-links", "open-rows")), files
