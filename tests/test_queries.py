import subprocess
import sys
from pathlib import Path

import pytest

from lexisteppe.plans.queries import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")


def _plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in DATA.iterdir():
        con.execute(f"create view {f.stem} as select * from '{f}'")
    df = QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted(repr([_plain(r[c]) for c in columns]) for r in df.collect())
    answer = con.execute(ORACLE_SQL[name])
    at = [d[0] for d in answer.description]
    want = sorted(repr([_plain(row[at.index(c)]) for c in columns]) for row in answer.fetchall())
    assert sorted(at) == columns and got == want and (want or name in ("typography", "double_words"))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_rest_imports_without_the_optional_package(tmp_path):
    import shutil

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "lexisteppe", tmp_path / "lexisteppe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; n = e.queries(); assert n and not any(k[0] == 'p' and k[1].isdigit() for k in n); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
