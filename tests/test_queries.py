"""Each query against its SQL, on the smallest tables."""

import duckdb
import pytest

from assetlake.plans.oracles import ORACLES
from assetlake.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    made = duckdb.connect()
    for t in TABLES:
        made.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return made


def values(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted([cell(r[i]) for i in order] for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    made = QUERIES[name](spark, DATA)
    rows = [tuple(r) for r in made.collect()]
    if name not in ORACLES:
        assert rows
        return
    duck.execute(ORACLES[name])
    columns = [c[0] for c in duck.description]
    assert sorted(columns) == sorted(made.columns)
    assert values(made.columns, rows) == values(columns, duck.fetchall())
