"""Rewrites: the expected forms, and rows that stay the same under three-valued logic."""

import itertools

import pytest

from relengine.plans import ast
from relengine.plans.parser import parse
from relengine.plans.rewrite import normal_form, simplify
from relengine.session import Session


def where(text):
    return parse(f"SELECT a FROM t WHERE {text};").where


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("name = 'ANN' AND name = 'ANN'", "name = 'ANN'"),
        ("age >= 18 AND age > 18 AND age <= 24", "age > 18 AND age <= 24"),
        ("age >= 18 AND age <= 18", "age = 18"),
        ("NOT name < 'M'", "name >= 'M'"),
        ("NOT NOT name < 'M'", "name < 'M'"),
        ("NOT name IS NULL", "name IS NOT NULL"),
        ("age = age", "age IS NOT NULL"),
        ("age LIKE age", "age IS NOT NULL"),
        ("age = 5 AND age < 9", "age = 5"),
        ("NOT (age = 1 OR age = 2)", "age <> 1 AND age <> 2"),
    ],
)
def test_forms(text, want):
    assert simplify(where(text)) == simplify(where(want)) == normal_form(where(want))


@pytest.mark.parametrize("text", ["age = 1 AND age = 2", "age > 5 AND age < 3", "age > 5 AND age < 5", "age < age", "age = 3 AND age <> 3", "age IS NULL AND age > 3", "age >= 3 AND age <= 3 AND age <> 3"])
def test_contradictions(text):
    assert simplify(where(text)) == ast.Constant(False)


TERMS = ["k = 1", "k > 1", "k <= 2", "NOT k < 2", "k IN (1, NULL)", "NOT k IN (1, 3)", "v LIKE 'a%'", "NOT v = 'ab'", "v IS NULL", "k = w", "NOT (k = 1 AND w > 1)", "NOT (k < k)"]


def _value(p, row):
    """Three-valued truth of a predicate on a row, straight from its definition."""
    get = lambda x: row[x.name] if isinstance(x, ast.ColumnRef) else None if x.kind == "null" else float(x.value) if x.kind == "number" else x.value
    if isinstance(p, ast.Not):
        v = _value(p.inner, row)
        return None if v is None else not v
    if isinstance(p, (ast.And, ast.Or)):
        vs, stop = [_value(x, row) for x in p.parts], isinstance(p, ast.Or)
        return stop if stop in vs else None if None in vs else not stop
    a = get(p.left)
    if isinstance(p, ast.IsNull):
        return (a is not None) == p.negated
    if isinstance(p, ast.InList):
        vs = [None if a is None or get(x) is None else a == get(x) for x in p.items]
        return True if True in vs else None if None in vs else False
    b = get(p.pattern if isinstance(p, ast.Like) else p.right)
    if a is None or b is None:
        return None
    if isinstance(p, ast.Like):
        return a.startswith(b[:-1])
    return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[p.op]


def test_rows_against_definition(spark):
    data = [(i, k, w, v) for i, (k, w, v) in enumerate(itertools.product([1, 2, 3, None], [1, 2, None], ["a", "ab", "b", None]))]
    s = Session(spark)
    s.register("t", spark.createDataFrame(data, "a int, k int, w int, v string"))
    texts = [f"{x} AND {y}" for x, y in itertools.combinations(TERMS, 2)][::5] + [f"NOT ({x} OR {y})" for x, y in itertools.combinations(TERMS, 2)][::5]
    for text in texts:
        want = [r[0] for r in data if _value(where(text), dict(zip("akwv", r, strict=True))) is True]
        assert sorted(r.a for r in s.sql(f"SELECT a FROM t WHERE {text}").collect()) == want, text


def test_pushdown(spark, tmp_path):
    spark.range(1000).selectExpr("id AS k", "id % 7 AS w").write.parquet(str(tmp_path / "t"))
    s = Session(spark)
    s.register("t", spark.read.parquet(str(tmp_path / "t")))
    plan = s.sql("SELECT k FROM t WHERE k >= 10 AND k > 10 AND k <= 20")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(k,10)" in plan and "LessThanOrEqual(k,20)" in plan and "GreaterThanOrEqual" not in plan
    assert "ReadSchema: struct<k:bigint>" in plan
