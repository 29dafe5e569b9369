"""Explicit schemas: nothing is inferred from the data."""

from pyspark.sql import types as T

DEMAND = T.StructType([
    T.StructField("series_id", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("demand_gw", T.DoubleType()),
    T.StructField("temperature_f", T.DoubleType()),
])

LOAD_PAGE = T.StructType([
    T.StructField("series_id", T.StringType()),
    T.StructField("offset", T.LongType()),
    T.StructField("response", T.StructType([
        T.StructField("total", T.StringType()),
        T.StructField("data", T.ArrayType(T.StructType([
            T.StructField("period", T.StringType()),
            T.StructField("value", T.StringType()),
        ]))),
    ])),
])

WEATHER_PAGE = T.StructType([
    T.StructField("hourly", T.StructType([
        T.StructField("time", T.ArrayType(T.StringType())),
        T.StructField("temperature_2m", T.ArrayType(T.DoubleType())),
    ])),
])

PREDICTIONS = T.StructType([
    T.StructField("series_id", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("actual", T.DoubleType()),
    T.StructField("model", T.StringType()),
    T.StructField("pred", T.DoubleType()),
])

RUN = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("run_name", T.StringType()),
    T.StructField("experiment", T.StringType()),
    T.StructField("start_time", T.TimestampType()),
    T.StructField("status", T.StringType()),
    T.StructField("params", T.MapType(T.StringType(), T.StringType())),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    T.StructField("artifacts", T.ArrayType(T.StringType())),
])
