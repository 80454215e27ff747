"""Comparison of results as bags of rows."""

import collections
import decimal
import math


def norm(v):
    if isinstance(v, (float, decimal.Decimal)):
        f = float(v)
        return None if math.isnan(f) else float(f"{f:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def bag(rows):
    return collections.Counter(repr(tuple(norm(v) for v in r)) for r in rows)


def spark_bag(df):
    cols = sorted(df.columns)
    return cols, bag(tuple(r) for r in df.select(*cols).collect())


def duck_bag(con, sql):
    got = con.execute(sql)
    names = [x[0] for x in got.description]
    order = [names.index(c) for c in sorted(names)]
    return sorted(names), bag(tuple(r[i] for i in order) for r in got.fetchall())
