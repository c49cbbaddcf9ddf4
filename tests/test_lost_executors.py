"""Results stay right when an executor is lost on the way."""

from millrace.operators import heavy, intervals, ranking, theta
from millrace.plans.catalog import QUERIES
from tests.cluster import run

SF = "/root/testdata/sf0.001"
NAMES = ("latest_order", "type_percentiles", "close_balances", "overlapping_sessions", "frequent_words", "user_paths")


def test_scans_and_joins_after_a_loss(spark, tmp_path):
    assert all(m.written for m in (ranking, theta, intervals, heavy))  # they cut lineage by written tables
    got = run(
        f"""
        from millrace.plans.catalog import QUERIES
        for after, name in enumerate({NAMES!r}, 1):
            out[name] = with_a_loss(lambda: QUERIES[name][0](spark, {SF!r}), after)
        """,
        tmp_path,
    )
    assert got["killed"] >= 4
    for name in NAMES:
        assert got["out"][name] == sorted(str(r) for r in QUERIES[name][0](spark, SF).collect()), name
