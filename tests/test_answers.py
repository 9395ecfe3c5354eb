import time

import pytest

from stepforge.functions import report
from stepforge.functions.answers import equal


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("1/2", "0.5", True), (r"\frac{3}{4}", "0.75", True), ("(1, 2)", "(1,2)", True), (r"\{1, 2\}", r"\{2,1\}", True), ("[0,1)", "[0,1]", False), ("x+1", "1+x", True), ("2^10", "1024", True),
        ("yes", "no", False), ("ad", "bc", False), ("ad+1", "bc+1", False), (r"\sqrt{4}", "2", True), (r"\sqrt{2}/2", r"1/\sqrt{2}", True), (r"5\text{ cm}", "5", True), ("5 cm", "5", True), ("3!", "6", True),
        (r"\binom{5}{2}", "10", True), (r"90^\circ", "90", True), ("1,000", "1000", True), ("", "", False), (None, "1", False), ("50%", "0.5", True),
    ],
)
def test_equal(a, b, same):
    assert equal(a, b) is same


def test_towers_end():
    began = time.time()
    assert not equal("((((9^64)^64)^64)^64)^64", "1") and not equal("9^64*9^64*9^64", "2") and not equal("(170!)!", "1")
    assert time.time() - began < 2


def test_formats():
    assert [report.signed(x) for x in (0.001, -0.001, 0.126, -1.5, None)] == ["0.00", "0.00", "+0.13", "-1.50", "---"]
    assert [report.p_value(x) for x in (0.007, 0.004, 0.5, None)] == ["0.01", "<0.01", "0.50", "---"]
    assert [report.stars(x) for x in (0.0005, 0.005, 0.03, 0.2, None)] == ["***", "**", "*", "ns", ""]
