"""Band alignment and band algebra on the four lineitem bands."""

from __future__ import annotations

from pyspark.sql import functions as F

from rastertable.functions import algebra as B
from rastertable.operators.bands import align_bands
from rastertable.plans import adapters as A
from rastertable.plans.registry import query

AT = ["scene", "row", "col"]


def _bands(spark, d):
    """q, p, t with masks: quantity above 45 and discount 0 are masked."""
    cells = A.a2_cells(spark, d)
    masked = cells.withColumn("value", F.when(~((F.col("band") == "quantity") & (F.col("value") > 45)) &
                                              ~((F.col("band") == "discount") & (F.col("value") == 0)), F.col("value")))
    return align_bands(masked, A.A2_KEYS, {"q": "quantity", "p": "price", "t": "discount"})


BANDS_SQL = f"""{A.A2_SQL.split(',' + chr(10) + 'a2 AS')[0]},
b AS (SELECT scene, "row", col, CASE WHEN quantity <= 45 THEN quantity END AS q, price AS p,
      CASE WHEN discount <> 0 THEN discount END AS t FROM px)"""


def _out(bands, **cols):
    return bands.select(*AT, *[c.alias(n) for n, c in cols.items()])


def _done(c, digits=6):
    return F.round(B.evaluate(c), digits)


def _sql(**cols):
    return f'WITH {BANDS_SQL} SELECT scene, "row", col, ' + ", ".join(f"{c} AS {n}" for n, c in cols.items()) + " FROM b"


@query("band_pivot", f'WITH {A.A2_SQL} SELECT scene, "row", col, price AS r, discount AS g, tax AS b FROM px')
def band_pivot(spark, d):
    return align_bands(A.a2_cells(spark, d), A.A2_KEYS, {"r": "price", "g": "discount", "b": "tax"})


@query("algebra_arithmetic", _sql(
    plus="round(q + p, 4)", minus="round(q - p, 4)", times="round(q * t, 4)", ratio="round(p / q, 7)",
    zero_div="CASE WHEN q - 3 <> 0 THEN round(p / (q - 3), 7) END",
    rest="CASE WHEN q - 20 <> 0 THEN round(p - floor(p / (q - 20)) * (q - 20), 4) END",
    power="round(power(t, 2), 6)", minus_q="-q",
    nd="CASE WHEN q + t <> 0 THEN round((q - t) / (q + t), 6) END"))
def algebra_arithmetic(spark, d):
    r = lambda c, n=4: _done(c, n)
    return _out(_bands(spark, d), plus=r(B.add("q", "p")), minus=r(B.subtract("q", "p")), times=r(B.multiply("q", "t")),
                ratio=r(B.divide("p", "q"), 7), zero_div=r(B.divide("p", B.subtract("q", 3)), 7),
                rest=r(B.mod("p", B.subtract("q", 20))), power=r(B.power("t", 2), 6), minus_q=B.negate("q"),
                nd=r(B.divide(B.subtract("q", "t"), B.add("q", "t")), 6))


@query("algebra_logic", _sql(
    both="CASE WHEN q IS NOT NULL AND t IS NOT NULL THEN q > 20 AND t > 0.05 END",
    either="CASE WHEN q IS NOT NULL AND t IS NOT NULL THEN q > 20 OR t > 0.05 END",
    neither="CASE WHEN q IS NOT NULL THEN NOT (q > 20) END",
    bits_and="CAST(q AS INTEGER) & 12", bits_or="CAST(q AS INTEGER) | 3", bits_not="-CAST(q AS INTEGER) - 1",
    eq="q = 7", ne="q <> 7", lt="q < 7", le="q <= 7", gt="q > 7", ge="q >= 7"))
def algebra_logic(spark, d):
    high, deep, bits = B.greater("q", 20), B.greater("t", 0.05), F.col("q").cast("int")
    return _out(_bands(spark, d), both=B.and_(high, deep), either=B.or_(high, deep), neither=B.not_(high),
                bits_and=B.bit_and(bits, 12), bits_or=B.bit_or(bits, 3), bits_not=B.bit_not(bits),
                eq=B.equal("q", 7), ne=B.not_equal("q", 7), lt=B.less("q", 7), le=B.less_equal("q", 7),
                gt=B.greater("q", 7), ge=B.greater_equal("q", 7))


@query("algebra_mask", _sql(
    chosen="CASE WHEN q IS NULL THEN NULL WHEN q > 20 THEN p ELSE t END", is_masked="t IS NULL",
    set_masked="CASE WHEN t IS NOT NULL THEN p END", set_nomask="t",
    m_where="CASE WHEN NOT (q > 20) THEN p END", m_eq="CASE WHEN q <> 7 THEN q END", m_ne="CASE WHEN q = 7 THEN q END",
    m_gt="CASE WHEN q <= 7 THEN q END", m_ge="CASE WHEN q < 7 THEN q END", m_lt="CASE WHEN q >= 7 THEN q END",
    m_le="CASE WHEN q > 7 THEN q END", inside="CASE WHEN NOT (q BETWEEN 5 AND 30) THEN q END",
    outside="CASE WHEN q BETWEEN 5 AND 30 THEN q END", invalid="q"))
def algebra_mask(spark, d):
    return _out(_bands(spark, d), chosen=B.where(B.greater("q", 20), "p", "t"), is_masked=B.getmask("t"),
                set_masked=B.setmask("p", B.getmask("t")), set_nomask=B.setmask("t", B.nomask()),
                m_where=B.masked_where(B.greater("q", 20), "p"), m_eq=B.masked_equal("q", 7), m_ne=B.masked_not_equal("q", 7),
                m_gt=B.masked_greater("q", 7), m_ge=B.masked_greater_equal("q", 7), m_lt=B.masked_less("q", 7),
                m_le=B.masked_less_equal("q", 7), inside=B.masked_inside("q", 30, 5), outside=B.masked_outside("q", 5, 30),
                invalid=B.masked_invalid("q"))


@query("algebra_math", _sql(
    low="CASE WHEN q IS NOT NULL AND t IS NOT NULL THEN least(q, t * 200) END",
    high="CASE WHEN q IS NOT NULL AND t IS NOT NULL THEN greatest(q, t * 200) END",
    size="abs(q - 20)", root="CASE WHEN q - 20 >= 0 THEN round(sqrt(q - 20), 6) END",
    ln="CASE WHEN q - 20 > 0 THEN round(ln(q - 20), 6) END", lg="CASE WHEN q - 20 > 0 THEN round(log10(q - 20), 6) END",
    ex="round(exp(t), 6)", overflow="CASE WHEN p < 700 THEN round(exp(p), 6) END",
    sn="round(sin(q), 6)", cs="round(cos(q), 6)", tn="round(tan(t), 6)",
    snh="round((exp(t) - exp(-t)) / 2, 6)", csh="round((exp(t) + exp(-t)) / 2, 6)", tnh="round(1 - 2 / (exp(2 * t) + 1), 6)",
    asn="CASE WHEN abs(q - 5) <= 1 THEN round(asin(q - 5), 6) END", acs="CASE WHEN abs(q - 5) <= 1 THEN round(acos(q - 5), 6) END",
    atn="round(atan(q), 6)", asnh="round(ln(q + sqrt(q * q + 1)), 6)",
    acsh="CASE WHEN q >= 1 THEN round(ln(q + sqrt(q * q - 1)), 6) END",
    atnh="CASE WHEN abs(t) < 1 THEN round(0.5 * ln((1 + t) / (1 - t)), 6) END"))
def algebra_math(spark, d):
    r, m = _done, B.subtract("q", 20)
    t200 = B.multiply("t", 200)
    return _out(_bands(spark, d), low=B.minimum("q", t200), high=B.maximum("q", t200), size=B.absolute(m),
                root=r(B.sqrt(m)), ln=r(B.log(m)), lg=r(B.log10(m)), ex=r(B.exp("t")), overflow=r(B.exp("p")),
                sn=r(B.sin("q")), cs=r(B.cos("q")), tn=r(B.tan("t")), snh=r(B.sinh("t")), csh=r(B.cosh("t")), tnh=r(B.tanh("t")),
                asn=r(B.arcsin(B.subtract("q", 5))), acs=r(B.arccos(B.subtract("q", 5))), atn=r(B.arctan("q")),
                asnh=r(B.arcsinh("q")), acsh=r(B.arccosh("q")), atnh=r(B.arctanh("t")))


@query("algebra_constants", _sql(
    area="round(q * q * pi(), 6)", none="CAST(NULL AS DOUBLE)", endless="CAST(NULL AS DOUBLE)",
    chosen="CASE WHEN q IS NOT NULL THEN CASE WHEN q > 20 THEN round(pi(), 6) ELSE q END END", kept="p", below="q IS NOT NULL AND q < 20"))
def algebra_constants(spark, d):
    """pi, nan, inf and nomask inside expressions: what becomes NaN or infinite is masked in the end."""
    return _out(_bands(spark, d), area=_done(B.multiply(B.multiply("q", "q"), B.pi())), none=_done(B.add("q", B.nan())), endless=_done(B.add("p", B.inf())),
                chosen=_done(B.where(B.greater("q", 20), B.pi(), "q")), kept=B.setmask("p", B.nomask()), below=F.coalesce(B.less("q", 20), F.lit(False)))
