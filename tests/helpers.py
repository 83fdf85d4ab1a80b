def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def lines_of(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")
