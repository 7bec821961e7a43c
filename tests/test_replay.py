"""Field differences of a replay against a plain loop."""

from decimal import Decimal

from quillon.operators import replay as R

FIELDS = ["a", "b", "c"]


def _norm(x):
    text = ("" if x is None else str(x)).strip(" ") or None
    try:
        return str(Decimal(text).quantize(Decimal("0.01"))) if text else None
    except ArithmeticError:
        return text


def test_only_texts_that_differ_are_parsed(spark):
    values = [None, "", "  ", "x", " x", "X", "1", "1.0", "1.00 ", "1.004", "1.005", "1.015", "1e2", "100", "1.2.3", "-0.1", "-.10"]
    rows = [(f"k{i}_{j}", v, w, "same") for i, v in enumerate(values) for j, w in enumerate(values)]
    old = [(k, v, "about", c) for k, v, _, c in rows] + [("gone", "1", "2", "3")]
    new = [(k, w, "about", c) for k, _, w, c in rows] + [("new", "1", "2", "3")]
    kinds = "processor_payment_id string, a string, b string, c string"
    o, r = spark.createDataFrame(old, kinds), spark.createDataFrame(new, kinds)
    got = R.field_differences(o, r, FIELDS)
    want = sorted((k, "a", str(_norm(v)), str(_norm(w))) for k, v, w, _ in rows if _norm(v) != _norm(w))
    assert sorted((*x[:2], str(x[2]), str(x[3])) for x in got.collect()) == want
    assert {x[0]: x[1] for x in R.equivalence(o, r, FIELDS).collect()} == {"missing": 1, "extra": 1, "differing": len(want), "equal": len(rows) - len(want)}
    assert tuple(R.verdict(o, r, FIELDS, "processor_payment_id").first()) == (1, 1, len(want), len(rows) - len(want), False)
    keys = got._jdf.queryExecution().optimizedPlan().toString()
    assert keys.count("decimal(38,6)") <= 4  # one place for each side and use, not one for each field of each row
