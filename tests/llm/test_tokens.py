import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import packing, token_files, tokens
from millrace.llm.queries import tokenizer

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
PLAIN = {f: Tokenizer.from_file(tokenizer(f)) for f in FILES}
TEXTS = ["", " ", "a", "A b. C, d", "a  b", "a \n b", "\n\na\n", " a ", "don't, we'll.", "x²,", "é.\nÉ é. ́a", "1.5, 2.", "a.,b .c ,", "a b  c.", "<|endoftext|> <|startoftext|>.", "tie.\tab\r\nc", "İ Σ ΑΣ, ß.", "\x1c. a\x85, b", "_a. a_,", "日本, 語。 "]


def ids(f, text):
    return np.array(PLAIN[f].encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("f", FILES)
def test_chunks_give_the_ids_of_the_whole(f):
    enc = tokens.Encoder(tokenizer(f))
    assert enc.drops_space == enc.lowers == (f == FILES[0]) and enc.plain
    assert enc.encode(TEXTS) == [ids(f, t) for t in TEXTS]


@pytest.mark.parametrize("f", FILES)
@settings(max_examples=300, deadline=None)
@given(text=st.text(st.sampled_from("aZé.,'\n \t1²_-ś !ΣΣ\x1c<|"), max_size=30))
def test_any_text(f, text):
    assert tokens.encoder(tokenizer(f)).encode([text]) == [ids(f, text)]


@pytest.mark.parametrize("f", FILES)
def test_documents_agree_with_the_library(spark, f):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert tokens.Encoder(tokenizer(f)).encode(texts) == [ids(f, t) for t in texts]


def test_memory_keeps_what_is_met_again():
    enc = tokens.Encoder(tokenizer(FILES[1]))
    tokens.memory("none")
    for t in ("a b c d e", "f g h", "a b c", "a", "f"):
        assert enc.encode([t], 3) == [ids(FILES[1], t)]
    held = tokens.memory(enc.path)
    assert len(held["words"]) == len(held["size"]) == len(held["met"]) <= 6 and held["size"].sum() == len(held["ids"])
    assert "a" in held["words"].to_pylist()


@pytest.mark.parametrize("f", FILES)
def test_texts_in_parts(f, monkeypatch):
    monkeypatch.setattr(tokens, "RUN", 40)
    enc, texts = tokens.Encoder(tokenizer(f)), [*TEXTS, "word and, \nword. " * 30, "word and word\n of\nit. " * 30, "x" * 500, "", "last one"]
    assert enc.encode(texts) == [ids(f, t) for t in texts]
    out, rows = [], 0
    for at, flat, ends in enc.runs(tokens.pa.array(texts), 2):
        assert at == rows
        rows += len(ends)
        out += [x.astype("<u4").tobytes() for x in np.split(flat, ends[:-1])]
    assert out == [ids(f, t) + (2).to_bytes(4, "little") for t in texts]
    assert enc.encode([]) == [] and list(enc.runs(tokens.pa.array([], tokens.pa.string()), 2)) == []


ROWS = [(5, "five. words, here"), (None, "no id"), (2, None), (2, "twice"), (9, ""), (-3, "minus " * 3000), (7, "a\nb")]


def test_token_files_round_trip(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in ROWS], "doc_id long, text string, base int").repartition(3)
    manifest = token_files.write_token_files(df, tokenizer(FILES[0]), files=3)
    got = sorted(token_files.read_token_files(manifest).collect(), key=lambda r: r.start)
    start = 0
    for r, (i, t) in zip(got, sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, xxhash.xxh64_intdigest((r[1] or "").encode(), 42) ^ 1 << 63))):
        own = ids(FILES[0], t or "") + (2).to_bytes(4, "little")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(own) // 4, zlib.crc32(own))
        start += len(own) // 4
    assert len(got) == len(ROWS) and token_files.corpus_tokens(spark, manifest) == start
    first = manifest.orderBy("base").first()
    assert first.width == 2 and first.base == 0
    own = token_files.tokens_at(first.file, 2, 0, 100).astype("<u4").tobytes()
    assert own.startswith(ids(FILES[0], "no id"))
    empty = token_files.write_token_files(df.limit(0), tokenizer(FILES[0]))
    assert token_files.read_token_files(empty).count() == 0


def test_ids_that_are_null_or_repeat_are_many_tasks(spark):
    df = spark.createDataFrame([(None if i % 2 else 7, f"text {i}") for i in range(400)], "doc_id long, text string")
    manifest = token_files.write_token_files(df, tokenizer(FILES[0]), files=4)
    got = token_files.read_token_files(manifest).collect()
    assert manifest.count() == 4 and sorted(r.start for r in got) == [0, *np.cumsum([r.n_tokens for r in sorted(got, key=lambda r: r.start)]).tolist()[:-1]]
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [None] * 200 + [7] * 200


@given(st.lists(st.tuples(st.integers(-3, 3), st.integers(-3, 3)), max_size=40), st.integers(1, 6))
def test_ranges_are_those_of_pairs_in_order(pairs, files):
    ids, hashes = np.array(pairs, np.int64).reshape(-1, 2).T
    cuts = token_files.bounds(ids, hashes, files)
    flat = list(zip(*(c.tolist() for c in cuts)))
    assert flat == sorted(flat) and len(flat) == (files - 1 if pairs else 0)
    got = token_files.range_of(ids, hashes, cuts).tolist()
    assert got == [sum(c <= p for c in flat) for p in pairs]


def test_ranged_reads(tmp_path):
    np.arange(10, dtype="<u2").tofile(tmp_path / "x")
    own = token_files._Ranged(token_files.pyarrow.fs.LocalFileSystem().open_input_file(str(tmp_path / "x")), "<u2")
    assert (len(own), own[2:5].tolist(), own[8:20].tolist(), own[3:3].tolist()) == (10, [2, 3, 4], [8, 9], [])


def cuts(n, capacity):
    return list(zip(*(x.tolist() for x in packing.cuts(np.array([n]), capacity)[2:])))


def test_cuts():
    assert cuts(5, 10) == [(0, 5)]
    assert cuts(10, 10) == [(0, 10)]
    assert cuts(25, 10) == [(0, 5), (5, 10), (15, 10)]
    assert [x.tolist() for x in packing.cuts(np.array([1, 21, 3]), 10)[:2]] == [[0, 1, 1, 1, 2], [0, 0, 1, 2, 0]]


def best_fit(lengths, capacity):
    free = []
    for n in sorted(lengths, reverse=True):
        fit = [k for k, f in enumerate(free) if f >= n]
        if fit:
            free[min(fit, key=lambda k: free[k])] -= n
        else:
            free.append(capacity - n)
    return len(free)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=60))
def test_plan_is_best_fit(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    plan, bins = packing.plan_bins(counts, 16)
    assert bins == best_fit(lengths, 16)
    used = {}
    seen = {n: [] for n in counts}
    for length, a, b, first, place in plan:
        seen[length] += range(a, b)
        for k in range(b - a):
            used.setdefault(first + k, []).append((place, length))
    assert all(sorted(seen[n]) == list(range(c)) for n, c in counts.items())
    assert sorted(used) == list(range(bins))
    for slots in used.values():
        end = 0
        for place, n in sorted(slots):
            assert place == end
            end += n
        assert end <= 16


@pytest.mark.parametrize("rows_per_task", [2, 20_000])
def test_packing_of_documents(spark, monkeypatch, rows_per_task):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(ROWS, "doc_id long, text string"))
    pieces = packing.written(packing.token_pieces(df, tokenizer(FILES[1])), "pieces")
    got = packing.pack(pieces, rows_per_task=rows_per_task).collect()
    want = []
    for r in df.collect():
        own = ids(FILES[1], r.text or "") + (2).to_bytes(4, "little")
        want += [(str(r.doc_id), j, s, n, zlib.crc32(own[4 * s : 4 * (s + n)])) for j, (s, n) in enumerate(cuts(len(own) // 4, 1024))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for slots in bins.values():
        end = 0
        for place, n in sorted(slots):
            assert place == end
            end += n
        assert end <= 1024
    assert len(bins) == best_fit([r.length for r in got], 1024)
    assert packing.pack_documents(df.limit(0), tokenizer(FILES[1])).count() == 0


def test_rows_that_are_alike_take_a_slot_each(spark, monkeypatch):
    monkeypatch.setattr(packing, "PLAN", 0)  # the plan as a joined table
    df = spark.createDataFrame([(None, "the same text", 1, 2)] * 300 + [(5, "x", 1, 2)] * 9, "doc_id long, text string, length int, sequence_id int")
    got = packing.pack_documents(df, tokenizer(FILES[1])).collect()
    slots = {(r.sequence_id, r.offset) for r in got}
    assert len(got) == len(slots) == 309 and max(s for s, _ in slots) == best_fit([r.length for r in got], 1024) - 1
