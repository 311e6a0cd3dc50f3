import pytest
from hypothesis import given
from hypothesis import strategies as st

from keyfathom.config import CallSpec
from keyfathom.functions import js, php
from keyfathom.functions.strings import decode_token, guards
from keyfathom.operators.extract import extract_text


def P(body, *specs, m=3):
    return php.extract("<?php " + body, list(specs), m)


def J(body, *specs, m=3, lang="js"):
    return js.extract(lang, body, list(specs), m)


FN = CallSpec("php", "function", "i18n")


@pytest.mark.parametrize(
    ("body", "literals", "guard", "blind"),
    [
        ("i18n('hello'); other('skip');", {"hello"}, [], 0),
        ("i18n('a' . 'b');", {"ab"}, [], 0),
        ("i18n('role_' . $x);", set(), [("prefix", "role_")], 0),
        ('i18n("role_$x");', set(), [("prefix", "role_")], 0),
        ('i18n("abc\\ndef$x");', set(), [("prefix", "abc"), ("contains", "def")], 0),
        ("i18n('cf' . '_' . $x);", set(), [], 1),
        ("i18n($a ? 'yes' : 'no'); i18n(('x'));", set(), [], 2),
        ("\\i18n('q'); $f('v'); $o?->i18n('n'); new i18n('c'); function i18n($k) {}", set(), [], 0),
        ("i18n(key: 'named');", {"named"}, [], 0),
        ("i18n();", set(), [], 0),
        ("/* i18n('c') */ # i18n('d')\n // i18n('e') ?>i18n('html')<?= i18n('echo') ?>", {"echo"}, [], 0),
        ("i18n('it\\'s \\n');", {"it's \\n"}, [], 0),
        ('i18n("a{$b->i18n(1)}bcd");', set(), [("suffix", "bcd")], 0),
        ("i18n(b'x');", {""}, [], 0),
    ],
)
def test_php_functions(body, literals, guard, blind):
    f = P(body, FN)
    assert (f.literals, f.guards) == (literals, guard)
    assert f.blind == blind


@pytest.mark.parametrize(
    ("body", "receivers", "literals"),
    [
        ("$i18n->get('a'); $this->i18n->get('b'); $o->get('c');", ("i18n", "this.i18n"), {"a", "b"}),
        ("C::get_i18n()->get('a'); get_i18n()->get('b'); o()->get('c'); $x->get_i18n()->get('d');", ("get_i18n()",), {"a", "b", "d"}),
        ("I18n::get('a'); $c::get('b'); self::get('c');", ("I18n", "c"), {"a", "b"}),
        ("$a['x']->get('a');", ("a['x']",), {"a"}),
        ("$q->get('a'); X::get('b');", None, {"a", "b"}),
    ],
)
def test_php_receivers(body, receivers, literals):
    assert P(body, CallSpec("php", "method", "get", receivers)).literals == literals


def test_php_source_literals():
    f = P("const A = 'one'; $m = ['k' => \"two\", \"n $v\" => ''];\n$h = <<<X\n'here'\nX;\n")
    assert f.source_literals == {"one", "k", "two"}


JS = CallSpec("js", "function", "i18n")


@pytest.mark.parametrize(
    ("body", "literals", "guard", "blind"),
    [
        ("i18n('hi'); i18n(`cf_${x}`); i18n($x)", {"hi"}, [("prefix", "cf_")], 1),
        ("i18n(`${a}_${b}`)", set(), [], 1),
        ("i18n('a' + \"b\")", {"ab"}, [], 0),
        ("i18n(a - b + 'tail')", set(), [("suffix", "tail")], 0),
        ("i18n('head' + b - c)", set(), [], 1),
        ("new i18n('a'); o.i18n('b'); function i18n(k) {} class A { i18n(k) { return i18n('in') } }", {"in"}, [], 0),
        ("x = a / b; y = /i18n('r')/g; z = `${i18n('t')}`; // i18n('c')", {"t"}, [], 0),
        ("i18n(/* c */ 'k' /* d */)", {"k"}, [], 0),
        ("i18n('a\\'b\\u0041')", {"a'bu0041"}, [], 0),
    ],
)
def test_js_functions(body, literals, guard, blind):
    f = J(body, JS)
    assert (f.literals, f.guards, f.blind) == (literals, guard, blind)


def test_js_methods_and_indexes():
    f = J("i18n.t('k'); other.t('x'); this.i18n?.t('m'); get().t('n')", CallSpec("js", "method", "t", ("i18n", "this.i18n", "get()")))
    assert f.literals == {"k", "m", "n"}
    f = J("locale['Delete']; locale[v]; other['x']; this.locale[`cf_sub_${k}`]; [1, 'a']; locale['w'] = 1", CallSpec("js", "index", "locale"), CallSpec("js", "index", "this.locale"))
    assert (f.literals, f.guards, f.blind) == ({"Delete", "w"}, [("prefix", "cf_sub_")], 1)


def test_jsx_text_is_no_string():
    f = J("const a = <div t=\"one\">Don't {i18n('in')} <b>it's</b><br/></div>; i18n('after')", JS, lang="tsx")
    assert f.literals == {"in", "after"} and f.source_literals == {"one", "in", "after"}


def test_first_spec_decides():
    first, second = CallSpec("js", "function", "i18n", None, 1), JS
    assert J("i18n('a')", first, second).literals == set() and J("i18n('a', 'b')", first, second).literals == {"b"}
    assert extract_text("ts", "i18n('a')", [CallSpec("TypeScript", "function", "i18n"), FN], 3).literals == {"a"}
    assert extract_text("php", "<?php i18n('a')", [JS], 3).literals == set()


@pytest.mark.parametrize(
    ("lang", "token", "value"),
    [
        ("php", r"'a\n\'\\'", "a\\n'\\"), ("php", r'"a\n\q"', "a\n\\q"), ("php", '"$x"', None), ("php", r'"\$x"', "$x"), ("php", r'"\e"', "\x1b"),
        ("js", r"'a\tb\q'", "a\tbq"), ("js", "`${x}`", None), ("js", r"`\${x}`", "${x}"), ("twig", '"#{x}"', None), ("twig", r"'it\'s'", "it's"), ("php", "b'x'", ""), ("js", "x", ""),
    ],
)
def test_decode(lang, token, value):
    assert decode_token(lang, token) == value


@given(st.lists(st.one_of(st.none(), st.text(max_size=5)), min_size=1, max_size=6), st.integers(1, 4))
def test_guards_are_never_short(segments, n):
    assert all(len(text) >= n for _, text in guards(segments, n))


@given(st.text(alphabet="ab'\"`\\${}()[]/<>*#?. \n=;:@", max_size=60))
def test_lexers_take_any_text(text):
    specs = [CallSpec("js", "function", "a"), CallSpec("js", "index", "a"), CallSpec("php", "method", "b")]
    for lang in ("js", "tsx", "ts"):
        js.extract(lang, text, specs, 3)
    php.extract("<?php " + text, specs, 3)
