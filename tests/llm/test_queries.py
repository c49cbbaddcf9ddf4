import zlib

import pytest

from millrace.llm import queries
from tests.llm.test_chat_pages_pipeline import plain_article
from tests.llm.test_dedup import plain_classes, plain_fingerprint
from tests.llm.test_tokens import FILES, best_fit, cuts, ids
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    compare(spark, queries.queries()[name], queries.oracle_sql()[name], SF)


def test_there_is_a_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_op1_is_the_plain_one(spark, documents):
    fps = [(i, plain_fingerprint(r.text)) for i, r in documents.items()]
    want = plain_classes(fps)
    got = queries.op1_simhash_near_dedup(spark, SF).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((i, f"{f:016x}", want[i]) for i, f in fps)


def test_op4_is_the_library(spark, documents):
    start, want = 0, []
    for i in sorted(documents):
        own = ids(FILES[0], documents[i].text) + (2).to_bytes(4, "little")
        want.append((i, start, len(own) // 4, zlib.crc32(own)))
        start += len(own) // 4
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in queries.op4_token_files(spark, SF).collect()) == want


def test_op5_gives_each_document_a_rate(spark, documents):
    got = queries.op5_mixing(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(documents)
    assert all(r.n_tokens == len(documents[r.doc_id].text.encode().split()) and r.rate >= 0 and abs(r.copies - r.rate) < 1 and abs(r.p_good + r.p_poor + r.p_toxic - 1) < 1e-9 for r in got)


def test_op9_is_the_library_and_best_fit(spark, documents):
    want = []
    for i, d in documents.items():
        own = ids(FILES[1], d.text) + (2).to_bytes(4, "little")
        want += [(i, j, s, n, zlib.crc32(own[4 * s : 4 * (s + n)])) for j, (s, n) in enumerate(cuts(len(own) // 4, 1024))]
    got = queries.op9_packing(spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert r.offset == bins.get(r.sequence_id, 0)
        bins[r.sequence_id] = r.offset + r.length
    assert max(bins.values()) <= 1024 and len(bins) == best_fit([r.length for r in got], 1024)


def test_op10_is_the_plain_one(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op10_page_text(spark, SF).collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    assert all(r.text == plain_article(pages[r.page_id].html) and r.url == pages[r.page_id].url and r.n_chars == len(r.text) for r in got)
