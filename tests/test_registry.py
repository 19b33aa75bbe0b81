"""Every registered query of the engine gives the rows of its SQL on the smallest tables."""

from pathlib import Path

import pytest

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.isoformat()[:26] if hasattr(v, "isoformat") else repr(v)


def test_queries_match_sql(spark):
    import duckdb

    from corpusmill.plans import catalogue, registry  # noqa: F401

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    assert len(registry.QUERIES) > 90
    wrong = []
    for name, sql in registry.SQL.items():
        df = registry.QUERIES[name](spark, str(DATA))
        cols = sorted(df.columns)
        got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
        cur = con.execute(sql)
        names = [x[0] for x in cur.description]
        at = [names.index(c) for c in sorted(names)]
        want = sorted(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
        if sorted(names) != cols or got != want:
            wrong.append((name, [x for x in got if x not in want][:2], [x for x in want if x not in got][:2]))
    assert not wrong
