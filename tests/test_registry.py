"""A few registered queries beside their SQL on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
SF = "/root/testdata/sf0.001"

import __spark_entry__ as entry  # noqa: E402
from codeloom.registry import oracle  # noqa: E402
from codeloom.registry import queries as registry  # noqa: E402
from tools.compare import table  # noqa: E402

NAMES = [
    "js_functions", "py_calls", "settled_verdicts", "report_build_summary", "resolve_source_path",
    "page_script_calls", "stream_findings", "traditional_risk_score",
]


def test_every_query_has_a_check():
    assert set(registry.queries()) == set(oracle.oracle_sql())
    assert set(registry.queries()) <= set(entry.queries())


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    want = table([d[0] for d in cur.description], cur.fetchall())
    assert table(df.columns, df.collect()) == want


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")
def test_scan_shuffles_no_code(spark):
    """The offline findings plan has no exchange but the spreading of thin rows."""
    from codeloom.plans import scan
    from codeloom.sources import corpus

    df = scan.findings(corpus.source_files(spark, SF))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "RoundRobinPartitioning" in plan
