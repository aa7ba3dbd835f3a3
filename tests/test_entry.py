import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from quern import cli
from quern import queries as own
from quern.tables import TABLES

ROOT = __spark_entry__.__file__.rsplit("/", 1)[0]


def plain(value):
    if value is None or value != value:
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return f"{float(value):.9g}"
    return str(value)


@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_query_equals_its_sql(spark, tables, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
    got = own.queries()[name](spark, tables)
    want = con.execute(own.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    a = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    b = sorted(tuple(map(plain, r)) for r in want.fetchall())
    assert a == b


def test_every_query_has_its_sql():
    assert set(own.queries()) == set(own.oracle_sql())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1


def test_the_rest_works_without_the_llm_subpackage():
    code = "import sys; sys.modules['quern.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)


def test_command_line(capsys):
    assert cli.main(["list"]) == 0 and "bm25_topk" in capsys.readouterr().out
    assert cli.main(["run", "nothing", "x"]) == 2
