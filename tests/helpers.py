from collections import Counter


def plain(v):
    """A value that compares alike from Spark and DuckDB."""
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if type(v).__name__ == "Decimal":
        return plain(float(v))
    if isinstance(v, int) and not isinstance(v, bool):
        return float(v)
    return v


def same_as_sql(spark, duck, sf, query, sql):
    df = query(spark, sf)
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    own = Counter(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())
    assert own == Counter(repr(tuple(plain(x) for x in r)) for r in result.fetchall())
