import math

import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import answers as A
from quern.operators import generation as G
from quern.operators import structure as S


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "quote,context,found",
    [("a – b", "x a - b y", True), ("it’s “so”", 'it\'s "so" it is', True), ("first … last", "the first and the last", True), ("last ... first", "the first and the last", False),
     ("...", "a ... b", False), ("... last", "the last", True), ("a­b", "ab", True), ("A  B", "a b", True), ("ß", "SS", True), ("zz", "z z", False)],
)
def test_quotes(spark, quote, context, found):
    assert one(spark, T.quote_found(T.quote_normal(F.col("q")), T.quote_normal(F.col("c"))), q=quote, c=context) is found


@pytest.mark.parametrize("text,number", [("2^3", 8.0), ("1/4", 0.25), ("1/0", None), ("1,234.5 units", 1234.5), ("3,14", 3.14), ("1,234", 1234.0), ("about -2e3", -2000.0), ("none", None), (".5", 0.5)])
def test_numbers(spark, text, number):
    got = one(spark, A.number(F.col("t")), t=text)
    assert got == number or (number is not None and math.isclose(got, number))


@pytest.mark.parametrize("p,g,kind,ok", [("Yes, it is", "true", "boolean", 1.0), ("yes and no", "yes", "boolean", 0.0), ("option b", "B", "single_choice", 1.0), ("103", "100", "numeric", 1.0), ("106", "100", "numeric", 0.0), ("cannot be determined", "", "unanswerable", 1.0), ("The Paris area", "paris", "entity", 1.0), ("", "paris", "entity", 0.0)])
def test_accuracy(spark, p, g, kind, ok):
    assert one(spark, A.accuracy(F.col("p"), F.col("g"), F.col("k")), p=p, g=g, k=kind) == ok


def test_answer_types(spark):
    rows = [(True, "None", "exact_match", "unanswerable"), (True, "Str", "choice_exact_match", "single_choice"), (True, "Str", "percentage_exact", "percentage"), (True, "Float", "x", "numeric"), (True, "Bool", "x", "boolean"), (True, "Str", "casefold_exact_match", "entity"), (False, "Str", "x", "unanswerable")]
    df = spark.createDataFrame(rows, "a boolean, f string, r string, want string")
    assert df.where(A.answer_type(F.col("a"), F.col("f"), F.col("r")) != F.col("want")).count() == 0


def test_penalties_and_fences(spark):
    for score, want in ((2.0, 1.7), (-2.0, -2.0 / 0.85), (0.0, -0.15)):
        assert math.isclose(one(spark, S.penalised(F.col("s"), F.lit(0.85)), s=score), want)
    assert one(spark, G.without_fence(F.col("t")), t='```json\n{"a": 1}\n```') == '{"a": 1}' and one(spark, G.without_fence(F.col("t")), t=" x ") == "x"
    assert one(spark, T.escape_html(F.col("t")), t="<a href='x'>&\"") == "&lt;a href=&#x27;x&#x27;&gt;&amp;&quot;"
