import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("gone", [["llm"], ["llm", "corpus_pipeline.py"], ["corpus_pipeline.py"], []])
def test_entry_without_llm_or_pipeline(tmp_path, gone):
    copy = tmp_path / "repo"
    present = os.path.isdir(os.path.join(ROOT, "seqloom", "llm"))
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", *gone))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len([k for k in q if k.startswith('q_')]), len([k for k in q if k.startswith('op')]), 'pipeline' in q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.returncode == 0, done.stderr
    own, ops, pipeline = done.stdout.split()[-3:]
    assert int(own) > 55 and int(ops) == (12 if present and "llm" not in gone else 0)
    assert (pipeline == "True") == (present and not gone)


def test_every_query_of_the_engine_has_sql():
    from seqloom.queries import ORACLES, QUERIES

    assert set(ORACLES) == set(QUERIES)


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_queries_match_sql(spark):
    import duckdb

    from seqloom.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    for name, fn in QUERIES.items():
        df, rel = fn(spark, DATA), con.sql(ORACLES[name])
        columns = sorted(df.columns)
        assert columns == sorted(rel.columns), name
        got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
        at = [rel.columns.index(c) for c in columns]
        assert got == sorted(repr([plain(r[i]) for i in at]) for r in rel.fetchall()), name


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_flagship(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["tx", "ty", "hits"] and df.count() > 80_000
