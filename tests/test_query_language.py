import pytest
from hypothesis import given
from hypothesis import strategies as st

from rankloom.plans.query_language import Leaf, Op, SearchMode, build_tree, holds, leaves, numbered, parse, query_tokens, simplified, to_postfix


def postfix(text):
    return ["[" + " ".join(x.words) + "]" if isinstance(x, Leaf) and x.exact else x.words[0] if isinstance(x, Leaf) else x for x in to_postfix(query_tokens(text))]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('" test this " AND ( test2 OR test3 )', "[test this] test2 test3 OR AND"),
        ('" test this " AND test2 OR test3', "[test this] test2 AND test3 OR"),
        ("test this AND test2 OR test3", "test this AND test2 AND test3 OR"),
        ("test this AND test2 OR NOT test3", "test this AND test2 AND test3 NOT OR"),
        ("test and test", "test test AND"),
        ('" test and test "', "[test and test]"),
        ('"burj khalifa" AND test OR tower', "[burj khalifa] test AND tower OR"),
        ('"a b" "c d"', "[a b] [c d] AND"),
        ('"a b" c', "[a b] c AND"),
        ("a NOT b", "a b NOT AND"),
        ("- - a", "a NOT NOT"),
        ("a (b | c)", "a b c OR AND"),
        ("(a) b", "a b AND"),
        ("not a and b", "a NOT b AND"),
        ("a & b | c & d", "a b AND c d AND OR"),
    ],
)
def test_postfix(text, want):
    assert " ".join(postfix(text)) == want


@pytest.mark.parametrize("text", [")burj test AND test OR tower", "(a", "a AND", "AND a", "NOT", "a OR OR b", '"a', "()", "a ( )"])
def test_malformed(text):
    with pytest.raises(ValueError):
        parse(text)


def test_empty_and_modes():
    assert parse("") is None and parse(None) is None and parse("  ", SearchMode.AND) is None
    assert parse("a b", SearchMode.AND) == Op("AND", (Leaf(("a",)), Leaf(("b",))))
    assert parse("a b", SearchMode.PHRASE) == Leaf(("a", "b"), True)
    assert parse("A a", SearchMode.OR) == Op("OR", (Leaf(("a",)), Leaf(("a",))))
    with pytest.raises(ValueError):
        parse("a", SearchMode.SEMANTIC)


def test_simplified():
    drop = lambda x: None if x.words == ("the",) else x
    assert simplified(parse("the fox"), drop) == (Leaf(("fox",)), False)
    assert simplified(parse("the"), drop) == (None, False)
    assert simplified(parse("not the"), drop) == (None, True)
    assert simplified(parse("fox and not the"), drop) == (Leaf(("fox",)), False)
    assert simplified(parse("fox or not the"), drop) == (None, True)
    assert simplified(parse("not not the"), drop)[0] == Op("OR", ())


def test_shapes():
    assert numbered(parse("a (b OR c)"))[0] == numbered(parse("x (y OR z)"))[0] == "AND(0,OR(1,2))"


TREES = st.recursive(st.sampled_from("abcd").map(lambda x: Leaf((x,))), lambda t: st.one_of(t.map(lambda x: Op("NOT", (x,))), st.tuples(st.sampled_from(["AND", "OR"]), t, t).map(lambda x: Op(x[0], x[1:]))), max_leaves=8)


def text_of(n):
    if isinstance(n, Leaf):
        return n.words[0]
    return f"(NOT {text_of(n.args[0])})" if n.name == "NOT" else f"({text_of(n.args[0])} {n.name} {text_of(n.args[1])})"


@given(TREES)
def test_round_trip(tree):
    assert parse(text_of(tree)) == tree


@given(TREES, st.sets(st.sampled_from("abcd")))
def test_holds(tree, true):
    def value(n):
        if isinstance(n, Leaf):
            return n.words[0] in true
        v = [value(a) for a in n.args]
        return not v[0] if n.name == "NOT" else all(v) if n.name == "AND" else any(v)

    assert holds(tree, {i for i, x in enumerate(leaves(tree)) if x.words[0] in true}) == value(tree)


def test_build_tree_of_nothing():
    assert build_tree([]) is None
