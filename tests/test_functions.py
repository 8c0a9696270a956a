import math
from decimal import Decimal
from statistics import NormalDist

import pytest
from hypothesis import given
from hypothesis import strategies as st

from sondage.functions import dist, fmt
from sondage.functions.sqlmath import norm_cdf


def test_normal_as_sql(spark):
    rows = spark.range(-800, 801).selectExpr("id / 20e0 AS x").selectExpr("x", f"{norm_cdf('x')} AS p").collect()
    assert max(abs(r.p - NormalDist().cdf(r.x)) for r in rows) < 1e-15


def test_tails():
    assert dist.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12)
    assert dist.chi2_sf(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-12)
    assert dist.t_sf2(2.2281388519862744, 10) == pytest.approx(0.05, abs=1e-12)
    assert dist.t_ppf(0.975, 10) == pytest.approx(2.2281388519649385, abs=1e-8)
    assert dist.binom_half_upper(8, 10) == pytest.approx(56 / 1024)
    brute = sum(math.comb(7, i) * math.comb(13, 5 - i) for i in range(3, 6)) / math.comb(20, 5)
    assert math.exp(dist.hyper_upper_log(3, 7, 13, 5)) == pytest.approx(brute)


def test_p_adjust():
    p = [0.01, 0.04, 0.03, None, 0.5]
    assert dist.p_adjust(p, "holm") == pytest.approx([0.04, 0.09, 0.09, None, 0.5])
    assert dist.p_adjust(p, "BH") == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, None, 0.5])
    assert dist.p_adjust(p, "bonferroni") == pytest.approx([0.04, 0.16, 0.12, None, 1])
    assert dist.p_adjust(p, "hochberg") == pytest.approx([0.04, 0.08, 0.08, None, 0.5])
    hommel, hochberg = dist.p_adjust([0.01, 0.02, 0.022, 0.09], "hommel"), dist.p_adjust([0.01, 0.02, 0.022, 0.09], "hochberg")
    assert all(a <= b + 1e-12 for a, b in zip(hommel, hochberg, strict=True))
    with pytest.raises(ValueError):
        dist.p_adjust(p, "what")


def test_formats():
    assert [fmt.fixed(x) for x in (2.675, -2.675, 1.005, 2.5)] == ["2.68", "-2.68", "1.01", "2.50"]
    assert [fmt.signif(x) for x in (1234.5, 0.00123456, 0, 99.96, -2.345)] == ["1230", "0.00123", "0", "100", "-2.35"]
    assert (fmt.percent(0.125, 0), fmt.p_value(0.0004), fmt.p_value(0.0496), fmt.ordinal(112), fmt.ordinal(23), fmt.clock(3725), fmt.clock(59.6)) == ("13%", "<0.001", "0.050", "112th", "23rd", "1:02:05", "1:00")
    assert fmt.join_and(["a", "b", "c"]) == "a, b and c"


def test_numbers_by_their_rules():
    nan, inf = float("nan"), float("inf")
    assert fmt.shown([51, 10, 2.5, 19234, 9.995, 0, -0.0, -1234.5, None, nan, inf, -inf], "signif", 3) == ["51.0", "10.0", "2.50", "19,200", "10.0", "0", "0", "-1,230", None, None, "Inf", "-Inf"]
    assert fmt.shown([51, 10, 2.5], "signif", 3, trailing_zeros=False) == ["51", "10", "2.5"]
    assert fmt.shown([0.0001, 0.00001, 1.23e300, 5.05e-8, 4.94e-324, math.pi, 123456789012345, 999999999999999.9], "signif", 3) == ["0.000100", "1.00e-05", "1.23e+300", "5.05e-08", "4.94e-324", "3.14", "123,000,000,000,000", "1.00e+15"]
    assert fmt.shown([math.pi], "signif", 10) == ["3.141592654"]
    assert fmt.shown([1.005, 2.675, -0.125, 0.004, -0.004, 1230, 1.234567891e20, 1e15, 1e-9, 0.5, 1.5], "fixed", 2) == ["1.01", "2.68", "-0.13", "0.00", "0.00", "1,230.00", "1.234568e+20", "1e+15", "0.00", "0.50", "1.50"]
    assert fmt.shown([0.5, 1.5, 2.5, -2.5, 8465491152.780715], "fixed", 0) == ["1", "2", "3", "-3", "8,465,491,153"]
    # the double lies below the half of the last decimal
    assert fmt.shown([8465491152.780715], "fixed", 5) == ["8,465,491,152.78071"]
    assert fmt.shown([0.005, 0.285, 1, 12.3456], "percent", 0) == ["1%", "29%", "100%", "1,235%"] and fmt.shown([0.0625], "percent", 1) == ["6.3%"]
    assert fmt.shown([0.0009999, 0.001, 0.04999, 0.5, 1], "p") == ["< 0.001", "0.001", "0.05", "0.5", "1"]
    assert fmt.shown([2, 21], "clock") == ["02:00", "21:00"] and fmt.shown([2], "clock", end=True) == ["02:59"]
    assert fmt.shown([1, 2, 3, 11, 12, 13, 22, 28, 31], "ordinal") == ["1st", "2nd", "3rd", "11th", "12th", "13th", "22nd", "28th", "31st"]
    for bad in (("signif", None), ("signif", 0), ("fixed", -1), ("other", 1)):
        with pytest.raises(ValueError):
            fmt.shown([1.0], *bad)


def test_numbers_that_are_read_together():
    assert fmt.common_decimals([1, 20, 300]) == 0 and fmt.common_decimals([]) == 0 and fmt.common_decimals([None, float("inf")]) == 0
    assert fmt.common_decimals([12.3, 10.1, 14.5]) == 1 and fmt.common_decimals([0.123, 0.0004, 1.5]) == 4 and fmt.common_decimals([1e-9, 2.5, 3.5]) == 2
    assert fmt.shown([12.345, 10, 14.55], "decimals") == ["12.3", "10.0", "14.6"]
    assert fmt.shown([0.5, 0.25, 1e-9, 2e15], "decimals") == ["0.500", "0.250", "1.00e-09", "2.00e+15"]
    assert fmt.shown([1234.5, 0.001, -7], "decimals", 1) == ["1,234.5", "1.00e-03", "-7.0"]


@given(st.floats(allow_nan=False, allow_infinity=False), st.integers(1, 10))
def test_shown_figures_lie_within_half_a_unit(x, digits):
    text = fmt.shown([x], "signif", digits)[0].replace(",", "")
    exact, back = Decimal(x), Decimal(text)
    if x:
        assert abs(back - exact) <= Decimal("0.5000001") * Decimal(1).scaleb(back.adjusted() - digits + 1) + abs(exact) * Decimal("1e-14")
        assert len(Decimal(text).as_tuple().digits) <= max(digits, Decimal(text).adjusted() + 1) or "e" in text
    assert fmt.shown([float(text)], "signif", digits)[0].replace(",", "") == text or abs(x) > 1e300 or abs(x) < 1e-300
