"""Masked algebra against NumPy's masked arrays."""

import operator
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastertable.functions import algebra as B
from rastertable.functions.masks import finite, read_mask

V1 = np.ma.array([1.0, 2, 3, 4, 5])
V2 = np.ma.array([2.0, 4, 6, 8, 10], mask=[1, 1, 1, 0, 0])


@pytest.fixture(scope="module")
def bands(spark):
    rows = [(i, float(a), None if m else float(b)) for i, (a, b, m) in enumerate(zip(V1, V2.data, V2.mask))]
    return spark.createDataFrame(rows, "pixel INT, v1 DOUBLE, v2 DOUBLE").cache()


v1, v2 = "v1", "v2"  # column names; Columns need a session, so cases build them late
CASES = {
    "identity": (lambda: B.masked_invalid(v1), V1),
    "negation": (lambda: B.negate(v1), -V1),
    "abs": (lambda: B.absolute(B.negate(v1)), np.abs(V1)),
    "sqrt": (lambda: B.sqrt(B.multiply(v1, v1)), V1),
    "power": (lambda: B.sqrt(B.power(v1, 2)), V1),
    "divide": (lambda: B.divide(v1, v1), np.ma.ones(5)),
    "mod": (lambda: B.mod(v1, v1), np.ma.zeros(5)),
    "mod sign": (lambda: B.mod(B.negate(v1), 3), np.mod(-V1, 3)),
    "zero divisor": (lambda: B.divide(v1, B.subtract(v1, 3)), np.ma.masked_invalid([-.5, -2, np.nan, 4, 2.5])),
    "index": (lambda: B.divide(B.subtract(v2, v1), B.add(v2, v1)), (V2 - V1) / (V2 + V1)),
    "where": (lambda: B.where(B.greater(v2, v1), 100, 0), np.ma.where(V2 > V1, 100, 0)),
    "equal": (lambda: B.equal(v1, v2), V1 == V2), "not equal": (lambda: B.not_equal(v1, v2), V1 != V2),
    "less": (lambda: B.less(v1, v2), V1 < V2), "greater equal": (lambda: B.greater_equal(v1, v2), V1 >= V2),
    "and": (lambda: B.and_(B.less(v1, 0.5), B.greater(v2, 0.5)), (V1 < 0.5) & (V2 > 0.5)),
    "or": (lambda: B.or_(B.greater(v1, 0.5), B.greater(v2, 0.5)), (V1 > 0.5) | (V2 > 0.5)),
    "not": (lambda: B.and_(B.not_(B.less(v1, 0.5)), B.greater(v2, 0.5)), ~(V1 < 0.5) & (V2 > 0.5)),
    "maximum": (lambda: B.maximum(v1, v2), np.maximum(V1, V2)), "minimum": (lambda: B.minimum(v1, v2), np.minimum(V1, V2)),
    "arcsin": (lambda: B.arcsin(B.sin(v1)), np.arcsin(np.sin(V1))),
    "sin pi": (lambda: B.sin(B.multiply(B.pi(), v1)), np.sin(np.pi * V1)),
    "setmask": (lambda: B.setmask(v1, B.getmask(v2)), np.ma.array(V1.data, mask=V2.mask)),
    "setmask none": (lambda: B.setmask(v2, B.nomask()), V2),
    "setmask adds": (lambda: B.setmask(v2, B.not_(B.getmask(v2))), np.ma.masked_all(5)),
    "masked where": (lambda: B.masked_where(B.not_(B.getmask(v2)), v2), np.ma.masked_all(5)),
    "masked equal": (lambda: B.masked_equal(v1, 3), np.ma.masked_equal(V1, 3)),
    "masked inside": (lambda: B.masked_inside(v1, 4, 2), np.ma.masked_inside(V1, 4, 2)),
    "masked outside": (lambda: B.masked_outside(v1, 2, 4), np.ma.masked_outside(V1, 2, 4)),
    "log domain": (lambda: B.log(B.subtract(v1, 3)), np.ma.masked_invalid([np.nan, np.nan, np.nan, 0, np.log(2)])),
    "overflow": (lambda: B.exp(B.multiply(v1, 300)), np.ma.masked_invalid([np.exp(300), np.exp(600), np.nan, np.nan, np.nan])),
    "infinite constant": (lambda: B.add(v1, B.inf()), np.ma.masked_all(5)),
    "long sum": (lambda: reduce(B.add, [v1] * 100), 100 * V1),
}


@pytest.mark.parametrize("name", CASES)
def test_expression(bands, name):
    column, expected = CASES[name]
    number = np.ma.array(expected).dtype != bool  # logical results are final as they are
    got = [r[0] for r in bands.orderBy("pixel").select(B.evaluate(column()) if number else column()).collect()]
    expected = np.ma.array(expected)
    assert [v is None for v in got] == np.ma.getmaskarray(expected).tolist()
    for v, e, m in zip(got, expected.data, np.ma.getmaskarray(expected)):
        if not m:
            assert v == pytest.approx(float(e), abs=1e-9)


def test_nested_expression_stays_small(bands):
    c = F.col(v1)
    for _ in range(25):
        c = B.add(c, 1)
    assert [r[0] for r in bands.orderBy("pixel").select(c).collect()] == (V1 + 25).tolist()


def test_logic_on_floats_is_an_error(bands):
    with pytest.raises(Exception, match="DATATYPE_MISMATCH"):
        bands.select(B.and_("v1", "v2")).collect()


def test_finite_and_read_mask(spark):
    df = spark.createDataFrame([(float("nan"), 1), (float("inf"), 1), (float("-inf"), 1), (7.0, 1), (8.0, 0), (9.0, 1), (None, 1)],
                               "v DOUBLE, a INT")
    assert [r[0] for r in df.select(finite("v")).collect()] == [None, None, None, 7.0, 8.0, 9.0, None]
    assert [r[0] for r in df.select(read_mask("v", F.lit(9.0), F.col("a"))).collect()] == [None] * 3 + [7.0] + [None] * 3
    assert operator.eq([r[0] for r in df.select(read_mask("v", F.lit(None).cast("double"))).collect()][5], 9.0)
