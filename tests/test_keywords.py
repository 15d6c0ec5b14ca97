import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from telespark.functions.keywords import Group, Not, Term, long_tokens, parse, positive_terms, predicate, token_terms


def t(x):
    return Term(x)


def all_of(*p):
    return Group(False, p)


def any_of(*p):
    return Group(True, p)


@pytest.mark.parametrize("text,want", [
    ('pay fail -late "order id" -"not this" - ', all_of(t("pay"), t("fail"), Not(t("late")), t("order id"), Not(t("not this")))),
    ("   ", None),
    ('"unterminated', t("unterminated")),
    ("a\tb\nc", all_of(t("a"), t("b"), t("c"))),
    (r'say \"hi\" "a \"b\" c"', all_of(t("say"), t(r'\"hi\"'), t('a "b" c'))),
    ("AC1062 OR Preparing:", any_of(t("AC1062"), t("Preparing:"))),
    ("a b OR c AND d", any_of(all_of(t("a"), t("b")), all_of(t("c"), t("d")))),
    ("(a OR b) NOT (c d)", all_of(any_of(t("a"), t("b")), Not(all_of(t("c"), t("d"))))),
    ("a or b", all_of(t("a"), t("or"), t("b"))),
    ('a "OR" b', all_of(t("a"), t("OR"), t("b"))),
    ("NOT -a", t("a")),
    ("getUser(id) timeout", all_of(t("getUser(id)"), t("timeout"))),
    ("(getUser(id) OR foo)", any_of(t("getUser(id)"), t("foo"))),
    ("Exception( -x", all_of(t("Exception("), Not(t("x")))),
    ("OR", None), ("AND OR NOT ( ) -", None), ("OR a OR", t("a")), ("a OR OR b", any_of(t("a"), t("b"))),
    (") a ( b", all_of(t("a"), t("b"))), ('"" a', t("a")), ("- a", t("a")),
    ("a ) b OR c", all_of(t("a"), any_of(t("b"), t("c")))),
])
def test_grammar(text, want):
    assert parse(text) == want


def test_equal_spellings():
    assert parse("x -(a OR b)") == parse("x NOT (a OR b)")
    assert parse("(a OR b))") == parse("a OR b")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='ab "()-\\ORNTAD\n', max_size=40))
def test_never_fails(text):
    parse(text)


def test_limits():
    with pytest.raises(ValueError):
        parse("x" * 5000)
    with pytest.raises(ValueError):
        parse("(" * 40 + "a")
    parse("(" * 32 + "a")


def test_terms():
    e = parse('a -b (c OR -d) NOT (e f) "g h"')
    assert positive_terms(e) == ["a", "c", "g h"]
    assert long_tokens("msgId:AC10ABCDEF0123456789") == ["ac10abcdef0123456789"]
    assert long_tokens("RESULT_CHANGE") == [] and long_tokens("消息AC10ABCDEF0123456789") == []
    assert token_terms(parse("12345678 AC10ABCDEF0123456789 -AC10ABCDEF0123456780"), True) == ["12345678", "AC10ABCDEF0123456789"]
    assert token_terms(parse("12345678 x"), False) == []
    # an OR of plain words is answered as substrings unless every word could use an index
    assert token_terms(parse("12345678 OR abc"), True) == []
    assert token_terms(parse("12345678 OR abcd"), True) == ["12345678"]


def hits(spark, q, rows, unscoped=True):
    df = spark.createDataFrame([(r,) for r in rows], "message string")
    return [r[0] for r in df.where(predicate(parse(q), F.col("message"), unscoped)).collect()]


def test_matching(spark):
    rows = ["id=AC10ABCDEF0123456789 ok", "idAC10ABCDEF0123456789x", "Health check", "tel 12345678", "tel 9123456789", "中文12345678", "健康检查"]
    assert hits(spark, "ac10abcdef0123456789", rows) == rows[:1]
    assert hits(spark, "id=AC10ABCDEF0123456789", rows) == rows[:1]
    assert hits(spark, "-ac10abcdef0123456789", rows) == rows[2:]          # excluding is always a substring
    assert hits(spark, "HEALTH", rows) == ["Health check"]
    assert hits(spark, "12345678", rows) == ["tel 12345678"]               # non-ASCII letters belong to the token
    assert hits(spark, "12345678", rows, unscoped=False) == [rows[0], rows[1], *rows[3:6]]
    assert hits(spark, "康检", rows) == ["健康检查"]
    assert hits(spark, "health OR tel -9123456789", rows) == ["Health check", "tel 12345678"]
