import pytest

from rankforge.functions.analysis import Analyzer
from rankforge.plans.parser import parse
from rankforge.plans.rewrite import optimize, prepare
from rankforge.plans.tree import Node, QuerySyntaxError, same

PLAIN = Analyzer()


def tree(query, default="#SUM"):
    return optimize(parse(query, PLAIN, default))


def test_words_get_the_default_operator_and_score():
    assert str(tree("apple pie")) == "#SUM(#SCORE(apple.body ) #SCORE(pie.body ) )"


def test_operators_in_any_case_with_distances():
    assert str(tree("#NeAr/3(a1 b1)")) == "#SCORE(#NEAR/3(a1.body b1.body ) )"
    assert str(tree("#window/2(#syn(x1 y1) z1)")) == "#SCORE(#WINDOW/2(#SYN(x1.body y1.body ) z1.body ) )"


@pytest.mark.parametrize("query", ["#near(a1 b1)", "#near/0(a1 b1)", "#near/x(a1 b1)", "#foo(a1)", "#score(a1)", "#and(a1", "a1)", "#wsum(x a1)", "#wsum(0.5)", "apple.price", "3.5", "u.s.", "#near/1(a1 #and(b1 c1))", "#near/1(a1.title b1)"])
def test_syntax_errors(query):
    with pytest.raises(QuerySyntaxError):
        parse(query, PLAIN, "#SUM")


def test_fields_and_several_terms_of_a_word():
    assert str(tree("Apple.TITLE")) == "#SCORE(apple.title )"
    assert str(tree("foo-bar.url")) == "#SUM(#SCORE(foo.url ) #SCORE(bar.url ) )"


def test_weights_travel_with_their_arguments():
    t = tree("#wsum(0.2 the 0.3 apple 0.5 pie)")
    assert t.weights == [0.3, 0.5] and len(t.args) == 2
    t = tree("#wsum(0.4 foo-bar 0.6 x1)")
    assert t.weights == [0.4, 0.4, 0.6]


def test_a_single_argument_replaces_its_operator():
    assert str(tree("#wsum(0.3 apple)")) == "#SCORE(apple.body )"
    assert str(tree("#and(#or(#near/2(apple the)))")) == "#SCORE(apple.body )"


def test_parentheses_without_an_operator_are_parts_of_words():
    assert str(tree("(apple pie) x1")) == "#SUM(#SCORE(apple.body ) #SCORE(pie.body ) #SCORE(x1.body ) )"
    t = tree("#wsum(0.5 (apple 0.3 pie) 0.2 foo(bar))")
    assert t.weights == [0.5, 0.3, 0.2, 0.2]
    assert str(tree("#and(a1 #or(b1 c1)d1)")) == "#AND(#SCORE(a1.body ) #OR(#SCORE(b1.body ) #SCORE(c1.body ) ) #SCORE(d1.body ) )"


def test_stopwords_alone_leave_nothing():
    assert tree("the of") is None and prepare(None) is None
    assert tree("#near/1(of the)") is None


def test_repeats_in_a_sum_become_weights():
    t = tree("#sum(apple pie apple)")
    assert t.op == "WSUM" and t.weights == [2.0, 1.0]
    assert str(tree("#sum(apple apple)")) == "#SCORE(apple.body )"
    t = tree("#sum(#near/1(a1 b1) #near/5(a1 b1))")
    assert t.op == "SUM" and len(t.args) == 2
    t = tree("#sum(#near/1(a1 b1) #near/1(a1 b1) c1)")
    assert t.weights == [2.0, 1.0]


def test_empty_nested_operators_fit_any_field():
    assert str(tree("#syn(a1.title #syn(the))")) == "#SCORE(a1.title )"


def test_same_sees_numbers_and_weights():
    assert not same(Node("NEAR", n=1), Node("NEAR", n=2))
    assert same(Node("TERM", term="x", field="body"), Node("TERM", term="x", field="body"))


def test_analyzer_on_strings():
    assert PLAIN.terms_of("The O'Brien_x cat’s, 707!") == ["o'brien_x", "cat’s", "707"]
    s = Analyzer(stem="s")
    assert s.terms_of("joints beatles cities glass buses aies") == ["joint", "beatle", "city", "glass", "buse", "aie"]
