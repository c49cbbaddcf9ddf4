"""Corpus operators' results stay right when an executor is lost on the way."""

from millrace.llm import queries
from tests.cluster import run

SF = "/root/testdata/sf0.001"
NAMES = ("op1_simhash_near_dedup", "op2_exact_dedup", "op4_token_files", "op8_repeated_passages", "op11_line_dedup", "op12_filter_audit")


def test_operators_after_a_loss(spark, tmp_path):
    got = run(
        f"""
        from millrace.llm.queries import queries
        for after, name in enumerate({NAMES!r}, 1):
            out[name] = with_a_loss(lambda: queries()[name](spark, {SF!r}), after)
        """,
        tmp_path,
    )
    assert got["killed"] >= 4
    for name in NAMES:
        assert got["out"][name] == sorted(str(r) for r in queries.queries()[name](spark, SF).collect()), name
