"""Base spans against the plain patterns; disguises map back to their source characters."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spendlens.llm import pii
from tests.llm.common import documents, edge_texts, empty

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    holds = {
        "email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda m: 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m)), "phone": lambda m: 10 <= len(digits(m)) <= 15,
    }
    found = [(m.start(), m.end(), k) for k, p in PATTERNS.items() for m in re.finditer(p, text) if holds[k](m[0])]
    return sorted(found, key=lambda x: (x[0], list(PATTERNS).index(x[2])))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1205+@.-( )_%4é", max_size=80))
def test_base_spans_equal_the_patterns(text):
    assert pii.spans(text) == plain(text)


@pytest.mark.parametrize("text", ["a@b@c.d.e x@y.z", "a..b@c-.d", "1.2.3.4.5.6.7.8", "256.1.1.1 01.002.3.4", "4111 1111-1111 1111", "+1 (706) 555-3138", "++44 20 7946 0958", "@a.b", "a@b.c@d.e"])
def test_base_spans_on_edges(text):
    assert pii.spans(text) == plain(text)


@pytest.mark.parametrize(
    "text, kind, source",
    [
        ("write jane.doe [at] example [dot] com today", "email", "jane.doe [at] example [dot] com"),
        ("mail jane at example dot com now", "email", "jane at example dot com"),
        ("ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        ("to jаne@exаmple.com (Cyrillic)", "email", "jаne@exаmple.com"),
        ("x jane@exam\u200bple.com y", "email", "jane@exam\u200bple.com"),
        ("call plus four four two zero seven nine four six zero nine five eight", "phone", "plus four four two zero seven nine four six zero nine five eight"),
        ("ip 192 dot 168 dot 1 dot 20 here", "ip", "192 dot 168 dot 1 dot 20"),
        ("card ４１１１ 1111 1111 1111.", "card", "４１１１ 1111 1111 1111"),
    ],
)
def test_disguises(text, kind, source):
    base, added = pii.all_spans(text)
    assert [(text[s:e], k) for s, e, k in added] == [(source, kind)] and not base


@pytest.mark.parametrize(
    "kind, source",
    [
        ("card", "4111 one one one one 1111 1111"), ("card", "4 one 1 one 1 1 1 1 1 1 1 1 1 1 1 one"),
        ("phone", "+44 20 seven nine four six 0958"), ("phone", "+1 (706) five five five 3138"), ("phone", "+44 20 7946 095eight"),
        ("ip", "one nine two dot one six eight dot one dot one"), ("ip", "192 dot one six 8 dot 1 dot two"),
        ("email", "jane@example (punto) com"), ("email", "jane@example [point] com"), ("email", "jane@example (punkt) com"),
        ("email", "jane {a} example.com"), ("email", "jane@example\tdot\tcom"),
    ],
)
def test_sparse_and_rare_disguises(kind, source):
    text = f"x: {source}; and one more"
    _, added = pii.all_spans(text)
    assert [(text[s:e], k) for s, e, k in added] == [(source, kind)]


@pytest.mark.parametrize(
    "source",
    [
        f"jane [at] {'x' * 90} [dot] com", "jane at x dot b dot c dot d dot e dot f dot com", f"{'j' * 100} [dot] doe [dot] x@example.com", "a [dot] b [dot] c [at] d [dot] com",
        "john_at_example_dot_com", "john_dot_doe_at_my-site_dot_example_dot_com", "john-at-example-dot-com", "jane&#64;example.com", "jane&#x40;example&#46;com",
        "jane&commat;example&period;com", "jane%40example.com", "joh\u0301n@example.com", "jane at mail.example dot com",
    ],
)
def test_addresses_of_any_length_and_form(source):
    _, added = pii.all_spans(f"x: {source}; and one more")
    assert [(f"x: {source}; and one more"[s:e], k) for s, e, k in added] == [(source, "email")]


def test_many_dots_take_linear_time():
    import time

    start = time.perf_counter()
    assert pii.all_spans("a dot b [dot] " * 20_000) == ([], [])
    assert len(pii.all_spans("x@a" + " dot b" * 20_000)[1]) == 1
    assert time.perf_counter() - start < 20


@pytest.mark.parametrize("text", ["met at example.com", "see me@ example dot com or (dot) net", "100&#37; &#10; &amp; &#233;", "polka-dot-dress look-at-this snake_at_case"])
def test_near_disguises_are_left_alone(text):
    assert pii.all_spans(text) == ([], [])


@pytest.mark.parametrize("text", ["one or two of 4111 1111 and three", "version two dot one", "one two three four five six seven eight nine one two", "two (a) three"])
def test_plain_numbers_are_left_alone(text):
    assert pii.all_spans(text) == ([], [])


@pytest.mark.parametrize(
    "text, kind, source, fragment",
    [
        ("to j\u043ehn@example.com", "email", "j\u043ehn@example.com", "hn@example.com"),
        ("to user@example.c\u043em now", "email", "user@example.c\u043em", "user@example.c"),
        ("ip 192.168.1.1\uff10 x", "ip", "192.168.1.1\uff10", "192.168.1.1"),
        ("root [at] 10.0.0.1", "email", "root [at] 10.0.0.1", "10.0.0.1"),
    ],
)
def test_disguises_that_leave_a_base_fragment(text, kind, source, fragment):
    base, added = pii.all_spans(text)
    assert [(text[s:e], k) for s, e, k in added] == [(source, kind)]
    assert [text[s:e] for s, e, _ in base] == [fragment]


@pytest.mark.parametrize("text", ["write jane@example.com\u2014today", "mail\u2014jane@example.com"])
def test_a_dash_between_words_ends_a_base_span(text):
    base, added = pii.all_spans(text)
    assert [text[s:e] for s, e, _ in base] == ["jane@example.com"] and not added


@pytest.mark.parametrize("text", ["we met at the dot com boom", "one two three", "look at this", "a dot b", "at 5 (at) noon", "é ü ñ plain text at home"])
def test_plain_text_is_left_alone(text):
    assert pii.all_spans(text) == ([], [])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab@.1 ＠．а\u200b()[]dotatplusone", max_size=60))
def test_added_spans_stay_inside_and_apart(text):
    base, added = pii.all_spans(text)
    assert base == plain(text)
    taken = sorted((s, e) for s, e, _ in added)
    assert all(0 <= s < e <= len(text) for s, e in taken)
    assert all(a[1] <= b[0] for a, b in zip(taken, taken[1:], strict=False))


def test_rows(spark):
    texts = [*edge_texts(), "a@b.co 1.2.3.4", "jane [at] example [dot] com"]
    rows = pii.find_personal_data(documents(spark, texts)).collect()
    assert len(rows) == len(texts) + 2
    by = {r.doc_id: r for r in rows}
    assert by[0].spans == "" and by[0].base_sha256 == by[1].base_sha256
    assert by[len(texts) - 2].spans == "email:0:6,ip:7:14" and by[len(texts) - 2].n_ip == 1
    assert by[len(texts) - 1].spans == "email:0:27" and by[len(texts) - 1].n_added == 1
    assert pii.find_personal_data(empty(documents(spark))).collect() == []
