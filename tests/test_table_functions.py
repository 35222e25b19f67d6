"""Parsers as SQL table functions, and the sketch of hot keys."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from articlelake.operators import parsers
from articlelake.operators.joins import hot_keys, skewed_left_join

ITEM = T.StructType([T.StructField("value", T.LongType())])


def _parser():
    # Defined inside, so that executors get it by value.
    rejected = parsers.DocumentRejected

    def parse(document):
        for n in range(document["size"]):
            yield {"value": n}
        if document["mark"] == "!":
            raise rejected("article_invalid")
        if document["mark"] == "?":
            yield {"value": "many"}
            yield {"value": 7}
        if document["mark"] == "#":
            raise KeyError("x")

    return parse


def _registered(spark):
    parsers.register_parser(spark, "parse_marks", _parser(), ITEM, key="n", key_type=T.LongType(), inputs=["size", "mark"])
    rows = [(0, 0, None), (1, 2, ""), (2, 1, "!"), (3, 1, "?"), (4, 2, "#"), (5, 3000, None)]
    frame = spark.createDataFrame(rows, "n bigint, size int, mark string")
    frame.createOrReplaceTempView("marked")
    return frame


def _rows(frame):
    return sorted((row["n"], row["item_pos"], row["item"] and row["item"]["value"], row["reason_code"]) for row in frame.collect())


def test_table_function_gives_the_rows_of_the_operator(spark):
    frame = _registered(spark)
    expected = _rows(parsers.parse_rows(frame, _parser(), ITEM, key="n", inputs=["size", "mark"]))
    assert len(expected) == 3009 and (3, 1, None, "parser_contract") in expected
    assert _rows(spark.sql("SELECT * FROM parse_marks(TABLE(marked))")) == expected
    assert _rows(spark.sql("SELECT * FROM parse_marks(TABLE(marked) PARTITION BY n)")) == expected
    lateral = "SELECT p.* FROM marked m, LATERAL parse_marks(m.n, m.size, m.mark) p"
    assert _rows(spark.sql(lateral)) == expected


def test_table_function_without_some_columns(spark):
    _registered(spark)
    whole = _rows(spark.sql("SELECT * FROM parse_marks(TABLE(SELECT n, size, n AS other FROM marked WHERE n = 2))"))
    assert whole == [(2, 0, 0, None)]
    assert _rows(spark.sql("SELECT p.* FROM marked m, LATERAL parse_marks(m.n, m.size) p WHERE m.n = 2")) == whole
    assert _rows(spark.sql("SELECT * FROM parse_marks(TABLE(SELECT * FROM marked WHERE n > 9))")) == []


def test_hot_keys_by_rows_and_own_bytes(spark):
    rows = [("many", 1, n) for n in range(60)] + [("large", 900, n) for n in range(6)]
    rows += [(f"k{n}", 10, n) for n in range(500)] + [(None, 900, 1)] * 50
    frame = spark.createDataFrame(rows, "url string, size int, n int").withColumn("body", F.repeat(F.lit("x"), F.col("size")))
    body = F.octet_length("body")

    def found(**bounds):
        hot = hot_keys(frame, "url", **bounds)
        return None if hot is None else {row["url"]: row["_salts"] for row in hot.collect()}

    assert found() is None
    assert found(hot_rows=20) == {"many": 3}
    assert found(hot_rows=20, weight=body, hot_bytes=1000) == {"many": 3, "large": 6}
    assert found(weight=body, hot_bytes=2700) == {"large": 2}
    right = spark.createDataFrame([("many", 1), ("large", 2), ("k1", 3)], "url string, fact int")
    plain = frame.join(right.withColumnRenamed("url", "u"), F.col("url") == F.col("u"), "left").groupBy("fact").count()
    hot = hot_keys(frame, "url", hot_rows=20, weight=body, hot_bytes=1000)
    salted = skewed_left_join(frame, right, "url", spread="n", hot=hot).groupBy("fact").count()
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, salted.collect()), key=str)
