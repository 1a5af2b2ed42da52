import math

import pytest

from lamina.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(cell(r[k]) for k in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    got = table([tuple(r) for r in df.collect()], df.columns)
    if name not in SQL:
        assert len(set(df.columns)) == len(df.columns)
        return
    cur = duck.execute(SQL[name])
    names = [c[0] for c in cur.description]
    want = table(cur.fetchall(), names)
    assert sorted(df.columns) == sorted(names)
    assert len(got) == len(want)
    assert got == want
