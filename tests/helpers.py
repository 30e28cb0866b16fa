"""Comparison of a query's rows with its SQL's."""

import math


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return [canon(x) for x in v]
    return str(v)


def same(df, con, sql: str) -> None:
    columns = sorted(df.columns)
    ours = sorted(str([canon(r[c]) for c in columns]) for r in df.collect())
    rel = con.execute(sql)
    names = [x[0] for x in rel.description]
    theirs = sorted(str([canon(r[names.index(c)]) for c in columns]) for r in rel.fetchall())
    assert sorted(names) == columns
    assert ours == theirs
    assert ours
