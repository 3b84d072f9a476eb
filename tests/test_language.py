"""Tokens, syntax and planning errors."""

import pytest

from tidemark import model
from tidemark.operators.sketches import ExactTier
from tidemark.plans.language import Call, parse, tokenize
from tidemark.plans.planner import Engine
from tidemark.sources.store import MemoryStore


@pytest.mark.parametrize(
    ("text", "tokens"),
    [
        ("hello world", [("name", "hello"), ("name", "world")]),
        ("server1234", [("name", "server1234")]),
        ('""', [("text", "")]),
        ('"foo*bar"', [("text", "foo*bar")]),
        ("10.2345", [("float", 10.2345)]),
        ("5.", [("float", 5.0)]),
        ("1234", [("int", 1234)]),
        ("foo(bar)", [("name", "foo"), ("mark", "("), ("name", "bar"), ("mark", ")")]),
        ("foo, bar", [("name", "foo"), ("mark", ","), ("name", "bar")]),
    ],
)
def test_tokens(text, tokens):
    assert tokenize(text) == tokens


@pytest.mark.parametrize("text", ['"noend', "123.45.67", "123abc", "foo%bar", ".5", "-1", "1e3", "é()", "18446744073709551616"])
def test_no_tokens(text):
    with pytest.raises(model.TokenizeError):
        tokenize(text)


def test_trees():
    assert parse('foo("a", 1, 2.5, bar(),)') == Call("foo", ("a", 1, 2.5, Call("bar", ())))
    assert parse("12") == 12


@pytest.mark.parametrize("text", ["", " ", "(", ")", ",", "foo(", "foo)", "foo", "123()", "123ab()", "foo(,x)", "foo(123x)", "foo(,", "foo() bar", "foo(1 2)"])
def test_no_trees(text):
    with pytest.raises((model.ParseError, model.TokenizeError)):
        parse(text)


@pytest.mark.parametrize(
    ("text", "error"),
    [
        ("12", model.InvalidExpressionType),
        ("nothing()", model.UnrecognizedFunction),
        ("_build()", model.TokenizeError),
        ("fetch()", model.MissingArg),
        ("fetch(1)", model.InvalidArgType),
        ('fetch("1foo")', model.InvalidMetricName),
        ('fetch("foo", 0.5)', model.InvalidArgType),
        ('fetch("foo")', model.InvalidOutputType),
        ("coalesce()", model.MissingArg),
        ('coalesce("x")', model.InvalidArgType),
        ('coalesce(search("x"))', model.InvalidInput),
        ('group(fetch("x"))', model.InvalidArgType),
        ("group()", model.MissingArg),
        ('group("weeks", fetch("x"))', model.InvalidArgValue),
        ('quantile(fetch("x"))', model.MissingArg),
        ('quantile(fetch("x"), 1)', model.InvalidArgType),
        ('quantile(fetch("x"), 1.0)', model.PhiOutOfRange),
        ('quantile(fetch("x"), 0.0)', model.PhiOutOfRange),
        ('quantile(quantile(fetch("x"), 0.5), 0.5)', model.InvalidInput),
        ("search()", model.MissingArg),
        ("combine(1)", model.InvalidArgType),
    ],
)
def test_errors(spark, text, error):
    tier = ExactTier()
    with pytest.raises(error):
        Engine(MemoryStore(tier, spark.createDataFrame([], tier.schema))).query(text)
