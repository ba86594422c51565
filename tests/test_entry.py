import os
import subprocess
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"
sys.path.insert(0, ROOT)

from tessera.plans import registry  # noqa: E402


def test_imports_without_the_llm_folders():
    code = "import sys; sys.modules['tessera.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'knn_cosine_top10' in q and not any(k[:2] == 'op' and k[2].isdigit() for k in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "documents", "embeddings", "labels", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = registry.queries()[name](spark, DATA)
    got = df.collect()
    done = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in done.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(r[c] for c in names) for r in got), key=repr) == sorted(done.fetchall(), key=repr)
