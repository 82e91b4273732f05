"""Compares a Spark result with a DuckDB result as multisets of rows."""


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return float(v) if hasattr(v, "quantize") else v


def assert_same(df, con, sql):
    columns = sorted(df.columns)
    theirs = con.sql(sql)
    assert sorted(theirs.columns) == columns
    at = [theirs.columns.index(c) for c in columns]
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    other = sorted((tuple(plain(r[i]) for i in at) for r in theirs.fetchall()), key=repr)
    assert len(mine) == len(other)
    assert mine == other
