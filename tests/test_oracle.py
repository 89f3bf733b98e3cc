"""Every core query with SQL gives the SQL's rows on the smallest tables, where they are there."""

import collections
import os

import pytest

from ledgerloom.plans import registry

DATA = os.environ.get("LEDGERLOOM_TEST_DATA", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
PAIRS = [(n, m) for m in registry.modules() for n in m.SQL]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        p = f"{DATA}/{f}"
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


@pytest.mark.parametrize("name,module", PAIRS, ids=[n for n, _ in PAIRS])
def test_query_equals_its_sql(spark, con, name, module):
    df = module.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = collections.Counter(tuple(map(str, r)) for r in df.select(*cols).collect())
    cur = con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({module.SQL[name]})")
    assert sorted(d[0] for d in cur.description) == cols
    assert got == collections.Counter(tuple(map(str, r)) for r in cur.fetchall())
