"""Places and words of lines."""

import pytest
from pyspark.sql import functions as F

from fathomgrid.llm import linededup


def test_near_ids_are_placed_without_reading_texts(spark):
    docs = spark.range(5).select(F.col("id").alias("doc_id"), F.raise_error(F.lit("read")).cast("string").alias("text"))
    place, doc_id, line = linededup._place(docs)
    rows = docs.select("doc_id", F.lit(2**31 - 1).alias("line")).select(place.alias("place")).select("place", doc_id.alias("d"), line.alias("n"))
    assert rows.schema["place"].dataType.simpleString() == "bigint"
    assert sorted((r.d, r.n) for r in rows.collect()) == [(k, 2**31 - 1) for k in range(5)]


@pytest.mark.parametrize("low,high", [(-(2**30), 2**30 - 1), (0, 2**31), (-(2**50), 2**50), (-(2**63), 2**63 - 1)])
def test_places_keep_ids_lines_and_order(spark, low, high):
    docs = spark.createDataFrame([(low, "a\nb\nc"), (high, "a\nb"), (None, "x")], "doc_id long, text string")
    place, doc_id, line = linededup._place(docs)
    at = linededup.exploded(docs).select(place.alias("place")).select("place", doc_id.alias("d"), line.alias("n")).orderBy("place")
    assert [(r.d, r.n) for r in at.collect()] == [(low, 0), (low, 1), (low, 2), (high, 0), (high, 1)]


def test_lines_without_a_word_are_left_out(spark):
    text = "\n".join([" \t\v\f\r", "", " one", " ", "\x1c", "two\r"])
    lines = linededup.exploded(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert sorted((r.line, r.text) for r in lines.collect()) == [(2, " one"), (3, " "), (4, "\x1c"), (5, "two\r")]


def test_words_are_those_of_each_line_alone():
    lines = ["ΟΔΟΣ", "Σ ΑΣ Σ", "İstanbul  plain WORDS", "ASCII only\r", "größe ÉTÉ \U0001f600 Ж", "", "a much longer word than eight bytes", " x"]
    row, h = linededup.hashed_words(lines)
    for k, x in enumerate(lines):
        alone = [int(linededup.hashed_words([w.decode()])[1][0]) for w in x.lower().encode().split()]
        assert h[row == k].tolist() == alone
