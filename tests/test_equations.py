import pytest
from pyspark.sql import functions as F

from stepforge.functions import equations


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [("3p+e=1.24", "1.24=e+3p", True), ("2+2=4", "3+1=4", False), ("a-b=c", "b-a=c", False), ("a/b=c", "c=a*b^-1", True), ("sin(x)=2x", "2*x=sin(x)", True), ("1.240=x", "x=1.24", True), ("a*(b*c)=1", "c*a*b=1", True)],
)
def test_keys(a, b, same):
    assert (equations.key(a) == equations.key(b)) is same and equations.key(a) is not None


@pytest.mark.parametrize("s", ["f(x)=1", "9^9^9=1", "(a+b)^2=4", "x^65=1", "open(1)=2", "a.b=1", "x=1=2", "3=", "=", "", "lambda=1", "1e9999=1", "a" * 201 + "=1", "(" * 180 + "=1", "1" + "+1" * 120 + "=1"])
def test_refused(s):
    assert equations.key(s) is None and equations.holds(s) is None


@pytest.mark.parametrize(("found", "want"), [(["(2+3)*4 = 20", "x=3"], True), (["0.1+0.2=0.3"], True), (["1+1=3", "1=1"], False), (["1/0=3"], False), (["7J = 70"], None), ([], None), (None, None), (["-2^2 = -4"], True), (["2(3)=6"], True)])
def test_holds(found, want):
    assert equations.all_hold(found) is want


def test_equations_and_tokens(spark):
    texts = [None, "", r"We get $a + b = c$ and 2 \cdot 3 = 6.", "It costs $5 = 5", "100% of x * 3 = 4, y=2", r"\[ x \times 2 = 8 \] then $q$", "a = b = c = d", "(" * 200_000, "x ^ 2 = 4; ^ 3 = 1", "Simplify the radical, cos of it; the ÉTA word1"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", equations.equations(F.col("t")).alias("e"), equations.math_tokens(F.col("t")).alias("m")).orderBy("i").collect()
    assert [r.e for r in rows] == [[], [], ["a + b = c", "2 * 3 = 6."], [], ["x * 3 = 4", "y=2"], [" x * 2 = 8 "], ["a = b", "c = d"], [], ["x ^ 2 = 4"], []]
    assert rows[0].m == [] and "MATH:EQN:+(a,b)|c" in rows[2].m and rows[7].m == []
    assert rows[9].m == ["simplify", "radical", "cos"] and rows[5].m == ["MATH:EQN:*(2,x)|8"]


def test_logical_tokens(spark):
    texts = [None, "", "¬ Can_read(Mike) and V(B): well-known a (Step 2) x", "the is of"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", equations.logical_tokens(F.col("t")).alias("m")).orderBy("i").collect()
    assert [r.m for r in rows] == [[], [], ["LOGIC:¬can_read(mike)", "LOGIC:v(b)", "and", "well-known", "step"], []]
