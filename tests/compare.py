"""Row-set comparison of Spark and DuckDB results."""

import math


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(_plain(row[k]) for k in order) for row in values), key=str)


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 6))
    return x


def same(spark_df, relation):
    theirs = relation.fetchall()
    assert sorted(spark_df.columns) == sorted(relation.columns)
    assert rows(spark_df.columns, spark_df.collect()) == rows(relation.columns, theirs)
