import os
import subprocess
import sys
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from conftest import plan

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT / "tools"))

import __spark_entry__ as entry  # noqa: E402
import registry  # noqa: E402
from compare import connect, differences, duck_rows, spark_rows  # noqa: E402

from millrace.sources.shared import temporary_copies  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
registry.load_all()
QUERIES, ORACLES = dict(registry.QUERIES), dict(registry.ORACLES)

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.fixture(scope="module")
def results(spark):
    """Plan text and rows of every query, several queries at a time."""

    def run(name):
        try:
            with temporary_copies(spark):
                df = QUERIES[name](spark, DATA)
                return plan(df), spark_rows(df)
        except Exception as error:
            return error

    with ThreadPoolExecutor(6) as pool:
        return dict(zip(QUERIES, pool.map(run, QUERIES)))


def test_every_sql_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert len(ORACLES) >= 0.9 * len(QUERIES)


def test_the_entry_has_every_query():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_the_queries_are_listed_without_a_session():
    listed = subprocess.run(
        [sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"],
        cwd=ROOT, capture_output=True, text=True, check=True,
    )
    assert int(listed.stdout.split()[0]) >= len(QUERIES)


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(results, con, name):
    if isinstance(results[name], Exception):
        raise results[name]
    text, ours = results[name]
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "MapInPandas"):
        assert unwanted not in text, f"{unwanted} in the plan of {name}"
    if name in ORACLES:
        assert differences(ours, duck_rows(con, ORACLES[name])) == []
    else:
        assert ours[1]


def test_the_checks_of_the_analytics_all_pass(results):
    columns, verdicts = results["v5_v8_analytics_checks"][1]
    passed = [n for n, _ in columns].index("passed")
    assert len(verdicts) >= 10 and all(v[passed] for v in verdicts)
