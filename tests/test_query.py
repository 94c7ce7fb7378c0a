import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomdex.plans.query import And, Not, Or, Prefix, QueryError, Term, Wildcard, holds, leaves, lex, parse


@pytest.mark.parametrize(
    "text,want",
    [("a OR b AND c", "(a OR (b AND c))"), ("cats and dogs", "(cats AND dogs)"), ("NOT NOT x", "NOT NOT x"), ("(a OR b) AND NOT c", "((a OR b) AND NOT c)"), ("a OR b OR c", "((a OR b) OR c)"), ("AND", "AND"), (")", ")"), ("not", None), ("pre*", "pre*")],
)
def test_trees(text, want):
    if want is None:
        with pytest.raises(QueryError, match="unexpected end of query"):
            parse(text)
    else:
        assert str(parse(text)) == want


@pytest.mark.parametrize(
    "text,message",
    [("", "empty query"), ("cats dogs", "unexpected token at position 1: dogs"), ("cats)", r"unexpected token at position 1: \)"), ("(cats", "expected closing parenthesis"), ("()", "expected closing parenthesis"), ("cats AND", "unexpected end of query")],
)
def test_errors(text, message):
    with pytest.raises(QueryError, match=message):
        parse(text)


def test_leaf_kinds():
    assert parse("car*") == Prefix("car") and parse("*") == Wildcard("*") and parse("c*r*") == Wildcard("c*r*") and parse("c?t") == Term("c?t")
    assert lex("a b\u0085(c)\x1fd") == ["a", "b", "(", "c", ")", "\x1fd"]


TREES = st.recursive(st.sampled_from("abc").map(Term), lambda t: st.one_of(st.builds(And, t, t), st.builds(Or, t, t), st.builds(Not, t)), max_leaves=8)


@settings(max_examples=100, deadline=None)
@given(TREES, st.sets(st.sampled_from("abc")))
def test_printed_trees_mean_the_same(tree, there):
    again = parse(str(tree))
    truth = lambda leaf: leaf.text in there
    assert holds(again, truth) == holds(tree, truth) and set(leaves(again)) == set(leaves(tree))


def test_long_and_deep_queries():
    long = parse(" OR ".join(f"w{i}" for i in range(10_000)))
    assert len(leaves(long)) == 10_000 and str(long).count("(") == 9_999 and holds(long, lambda leaf: leaf.text == "w9999")
    deep = parse("(a AND " * 3000 + "b" + ")" * 3000)
    assert holds(deep, lambda leaf: True) and not holds(deep, lambda leaf: leaf.text == "a") and str(deep).startswith("(a AND (a AND")
    assert str(parse("((a OR b) OR c) AND NOT NOT d")) == "(((a OR b) OR c) AND NOT NOT d)"
