import pytest
from pyspark.sql import functions as F

from stepforge.functions import text

P, D = "__PROVED__", "__DISPROVED__"


@pytest.mark.parametrize(
    ("body", "want"),
    [(None, None), ("", None), ("nothing", None), ("__PROVED__ then __DISPROVED__", D), ("**proved** so", P), ("Conclusion: disproved\nit is true", D), ("it is true and not false", D), ("so it holds", P), ("it is false\na\nb\nc\nd\ne", D), ("it holds\nthe hypothesis is not\na\nb\nc\nd\ne", D), ("false\nthen proven\na\nb\nc\nd\ne", P), ("untrue", None)],
)
def test_verdict(spark, body, want):
    assert spark.createDataFrame([(body,)], "t string").select(text.verdict(F.col("t")).alias("v")).first().v == want


@pytest.mark.parametrize(("body", "want"), [(r"\boxed{1,000}", "1000"), (r"\boxed{(1,000,2)}", "(1,000,2)"), (r"\boxed{\frac{1}{2}} ", r"\frac{1}{2}"), ("#### 7\n", "7"), ("the answer is: 5.", "5"), (None, None)])
def test_final_answer(spark, body, want):
    assert spark.createDataFrame([(body,)], "t string").select(text.final_answer(F.col("t")).alias("v")).first().v == want
