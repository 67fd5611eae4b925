"""Scalar functions against literal cases and brute force."""

import hashlib
import json
import unicodedata
from urllib.parse import quote_plus

import pytest
from pyspark.sql import functions as F

from docloom.functions import markup as M
from docloom.functions import nested as N
from docloom.functions import text as T


@pytest.fixture(scope="module")
def value(spark):
    def evaluate(column):
        return spark.range(1).select(column.alias("v")).first().v

    return evaluate


@pytest.mark.parametrize("title, expected", [
    ("What's New in v2.0?", "whats-new-in-v20"), ("Hello -- World!!", "hello----world"), ("árvíztűrő tükörfúrógép", "rvztr-tkrfrgp")])
def test_slug_identifier(value, title, expected):
    assert value(T.slug_identifier(F.lit(title))) == expected


def test_slugs_with_accents(value):
    title = "árvíztűrő tükörfúrógép"
    assert value(T.slug_ascii(F.lit(title))) == "arvizturo-tukorfurogep"
    assert value(T.slug_unicode(F.lit(title))) == "árvíztűrő-tükörfúrógép"
    assert value(T.slug_unicode(F.lit(unicodedata.normalize("NFD", title)))) == "árvíztűrő-tükörfúrógép"


def test_heading_id(value):
    assert value(T.heading_id(F.lit("Section {#my-id}"))) == "my-id"
    assert value(T.heading_clean(F.lit("Section {#my-id}"))) == "Section"
    assert value(T.heading_id(F.lit("Plain Section"))) == "plain-section"


def test_encode_title(value):
    for title in ["a~b*c", "x (y) & z", "déjà  vu", "1+1=2?"]:
        import re
        safe = re.sub(r"\s\s+", " ", re.sub(r"[^A-Za-z0-9._~()'!*:@,;+?-]+", " ", title)).strip()
        assert value(T.encode_title(F.lit(title))) == quote_plus(safe)


@pytest.mark.parametrize("path, expected", [("image", "image"), ("a.png", "a.png"), ("a/b.png", "a_b.png"), ("../a.png", "PAR_a.png"), ("/x", None)])
def test_attachment_name(value, path, expected):
    assert value(T.attachment_name(F.lit(path))) == expected


@pytest.mark.parametrize("base, target, expected", [
    ("docs/en", "a.md", "docs/en/a.md"), ("docs/en", "../x/./y.md", "docs/x/y.md"), ("docs", "/a//b.md", "a/b.md"),
    ("docs", "../../x.md", "../x.md"), ("", "a.md", "a.md")])
def test_resolve_path(value, base, target, expected):
    assert value(T.resolve_path(F.lit(base), F.lit(target))) == expected


def test_path_digest_drops_leading_zeros(value):
    for path in [f"dir/doc{n}.md" for n in range(40)]:
        expected = "".join(f"{c:x}" for c in hashlib.md5(path.encode()).digest())
        assert value(T.path_digest(F.lit(path))) == expected


@pytest.mark.parametrize("length, pixels", [
    ("100", 100), ("100px", 100), ("72pt", 96), ("1in", 96), ("2.54cm", 96), ("25.4mm", 96), ("6pc", 96), ("10em", 160), ("10ex", 80),
    ("0.5", 0), ("1.5", 2), ("2.5", 2), ("50%", None), ("abc", None), ("", None), (".5in", 48)])
def test_svg_length(value, length, pixels):
    assert value(T.svg_length_px(F.lit(length))) == pixels


def test_json_coalesce(value):
    target = {"name": "n", "country": None, "settings": {"theme": None, "notifications": True}, "list": [1], "scalar": 1}
    source = {"name": "m", "age": 4, "country": "HU", "settings": {"theme": "dark", "language": "en", "notifications": False}, "list": [2], "scalar": {"a": 1}}
    merged = json.loads(value(N.json_coalesce(F.lit(json.dumps(target)), F.lit(json.dumps(source)))))
    assert merged == {"name": "n", "age": 4, "country": "HU", "settings": {"theme": "dark", "language": "en", "notifications": True}, "list": [1], "scalar": 1}


@pytest.mark.parametrize("levels", [7, 8, 12, 40])
def test_json_coalesce_of_deep_dictionaries(value, levels):
    def deep(leaf, name):
        for n in range(levels - 1):
            leaf = {"in": leaf, name: n, "both": name, "empty": {}, "list": [{"{": name}], f"{name} only": {"x": {}}}
        return leaf

    def merged(t, s):
        if isinstance(t, dict) and isinstance(s, dict):
            return {k: merged(t.get(k), s.get(k)) for k in {**t, **s}}
        return s if t is None else t

    target, source = deep({"a": 1, "none": None, "\"q\\": 1.5}, "target"), deep({"a": 2, "b": 3, "none": "no more"}, "source")
    assert json.loads(value(N.json_coalesce(F.lit(json.dumps(target)), F.lit(json.dumps(source))))) == merged(target, source)


@pytest.mark.parametrize("target, source, merged", [
    (None, '{"a":1}', '{"a":1}'), ('{"a":1}', None, '{"a":1}'), (None, None, None), ("{}", "{}", "{}"), ("[1]", '{"a":1}', "[1]"), ("null", '{"a":1}', "null"), ('{"a":null}', '{"a":null}', '{"a":null}')])
def test_json_coalesce_of_other_values(value, target, source, merged):
    assert value(N.json_coalesce(F.lit(target).cast("string"), F.lit(source).cast("string"))) == merged


def test_canonical_markup(value):
    def canonical(text):
        return value(M.canonical_markup(F.lit(text)))

    assert canonical('<p b="2" a="1">x</p>') == canonical('<p a="1" b="2"> x </p>')
    assert canonical('<p ac:macro-id="1">x</p>') == canonical('<p ac:macro-id="2">x</p>')
    assert canonical('<p id="1">x</p>') != canonical('<p id="2">x</p>')
    assert canonical("<ac:task-uuid>a</ac:task-uuid>") == canonical("<ac:task-uuid>b</ac:task-uuid>")
    assert canonical("<p>a<ac:inline-comment-marker ac:ref='1'>b</ac:inline-comment-marker></p>").startswith("<p>")
    assert canonical("<p>one</p>") != canonical("<p>two</p>")
    assert canonical("<c><![CDATA[int x = 1;]]></c>") != canonical("<c><![CDATA[int x = 2;]]></c>")
    assert canonical("<c><![CDATA[a > b <i>]]></c>") == "<c><![CDATA[a > b <i>]]></c>"
    assert canonical("<p b='2' a=\"1\">x</p>") == canonical('<p a="1" b="2">x</p>') != canonical("<p b='3' a='1'>x</p>")
    assert canonical('<p a="x>y" b="1">t</p>') != canonical('<p a="x>y" b="2">t</p>')
    assert canonical("<p ac:local-id='1'>x</p>") == canonical("<p>x</p>")
    assert canonical('<p a="">x</p>') != canonical("<p>x</p>")


def test_unwrap_and_text(value):
    assert value(M.unwrap(F.lit("<p>a <mark>b</mark> c</p>"), "mark")) == "<p>a b c</p>"
    assert value(M.html_text(F.lit(" <p>a &lt;b&gt; &amp;lt;</p> "))) == "a <b> &lt;"


def test_urls(value):
    for url, absolute in [("https://x.y", True), ("mailto:a@b", True), ("//host/x", True), ("a/b.md", False), ("#frag", False), ("/root.md", False)]:
        assert value(T.is_absolute_url(F.lit(url))) is absolute
    assert value(T.content_uuid(F.lit("x"))) == "11f6ad8e-c52a-2984-abaa-fd7c3b516503"
    address = T.page_url("s", F.lit("SP"), F.lit("1"), F.lit("A b"), F.lit("x"), "/w/")
    assert value(address) == "https://s/w/spaces/SP/pages/1/A+b#x"


def test_display_width(value):
    assert [value(T.display_width(F.lit(w), 800)) for w in (None, 700, 800, 900)] == [None, None, None, 800]


def test_relative_path(value):
    assert value(T.relative_path(F.lit("docs/en/a"), F.lit("docs/fr/b.md"))) == "../../fr/b.md"
    assert value(T.relative_path(F.lit("docs"), F.lit("docs/a/b.png"))) == "a/b.png"


MACRO = '<ac:structured-macro ac:name="info" ac:macro-id="{id}">{children}</ac:structured-macro>'
PARAMETERS = ('<ac:parameter ac:name="a">1</ac:parameter>', '<ac:parameter ac:name="b">2</ac:parameter>', "<ac:rich-text-body><p>x</p><p>y</p></ac:rich-text-body>")


def macro(*children, id="m"):
    return MACRO.format(id=id, children="".join(children))


EQUAL = [
    ('<p b="2" a="1">x</p>', "<p a='1' b='2'> x </p>"),
    ('<p ac:macro-id="1">x</p>', "<p>x</p>"),
    ("<ac:task-uuid>a</ac:task-uuid> z", "<ac:task-uuid>b<i/></ac:task-uuid>z"),
    ("<p>a<ac:inline-comment-marker ac:ref='1'>b</ac:inline-comment-marker> c</p>", "<p>ab c</p>"),
    (macro(*PARAMETERS), macro(*PARAMETERS[::-1], id="n")),
    (macro(macro(*PARAMETERS), *PARAMETERS), macro(*PARAMETERS[1:], PARAMETERS[0], macro(PARAMETERS[2], *PARAMETERS[:2]))),
    ("<p>it&#39;s &#x1F609; &eacute;&nbsp;&lt;</p>", "<p>it's \U0001f609 é &lt;</p>"),
    ('<p a="&quot;x&quot;">t</p>', "<p a='\"x\"'>t</p>"),
    ("<c><![CDATA[a < b]]></c>", "<c>a &lt; b</c>"),
    ("<p>one<!-- note --></p>", "<?xml version='1.0'?><p>one</p>"),
    ("<ul>\n  <li>a</li>\n  <li/>\n</ul>", "<ul><li>a</li><li></li></ul>"),
]
DIFFERENT = [
    ("<p>one</p>", "<p>two</p>"),
    ('<p id="1">x</p>', '<p id="2">x</p>'),
    ('<p a="">x</p>', "<p>x</p>"),
    ("<p>a</p><p>b</p>", "<p>b</p><p>a</p>"),
    ("<p>a<b/>c</p>", "<p>ac<b/></p>"),
    ("<p><b/>c</p>", "<p><b/></p>c"),
    ("<p><b>c</b></p>", "<p><b/>c</p>"),
    (macro(*PARAMETERS), macro(*PARAMETERS[:2])),
    (macro(*PARAMETERS), macro(*PARAMETERS, PARAMETERS[0])),
    (macro(*PARAMETERS), macro(PARAMETERS[0].replace("1", "3"), *PARAMETERS[1:])),
    (macro(PARAMETERS[2]), macro("<ac:rich-text-body><p>y</p><p>x</p></ac:rich-text-body>")),
    (macro(*PARAMETERS, "tail"), macro(*PARAMETERS)),
    ("<p>7f3c1a52-0000-4000-8000-1234567890ab</p>", "<p>7f3c1a52-0000-4000-8000-1234567890ac</p>"),
    ("<c><![CDATA[<ac:task-uuid>x</ac:task-uuid>]]></c>", "<c><![CDATA[<ac:task-uuid>y</ac:task-uuid>]]></c>"),
    ("<c><![CDATA[&lt;]]></c>", "<c><![CDATA[<]]></c>"),
    ("<c><![CDATA[<!-- a -->]]></c>", "<c><![CDATA[<!-- b -->]]></c>"),
    ("<p>&amp;lt;</p>", "<p>&lt;</p>"),
    ("<p>open", "<p>open</p>"),
    ("<p>shut</p></p>", "<p>shut</p>"),
    ('<p a="x|y">t</p>', '<p a="x">y|t</p>'),
]


@pytest.fixture(scope="module")
def digests(spark):
    """All versions in one job."""
    texts = spark.createDataFrame([(text,) for pair in EQUAL + DIFFERENT for text in pair], "text string")
    return {r["text"]: r["digest"] for r in texts.select("text", M.tree_digest(F.col("text")).alias("digest")).collect()}


@pytest.mark.parametrize("one, other", EQUAL)
def test_equal_trees(digests, one, other):
    assert digests[one] == digests[other]


@pytest.mark.parametrize("one, other", DIFFERENT)
def test_different_trees(digests, one, other):
    assert digests[one] != digests[other]


def test_tree_of_many_elements(value):
    deep = "<i>" * 300 + "x" + "</i>" * 300
    wide = "".join(f"<p>{n}</p>" for n in range(3000))
    assert value(M.tree_digest(F.lit(deep))) != value(M.tree_digest(F.lit(deep.replace("x", "y"))))
    assert value(M.tree_digest(F.lit(wide))) != value(M.tree_digest(F.lit(wide.replace("<p>2999", "<p>2998"))))
    assert value(M.tree_digest(F.lit(None).cast("string"))) is None and value(M.tree_digest(F.lit(""))) == value(M.tree_digest(F.lit(" ")))


def test_canonical_markup_keeps_content(value):
    def canonical(text):
        return value(M.canonical_markup(F.lit(text)))

    assert canonical("<p>id 7f3c1a52-0000-4000-8000-1234567890ab</p>").endswith("90ab</p>")
    assert canonical("<c><![CDATA[<ac:task-uuid>x</ac:task-uuid>]]></c>") == "<c><![CDATA[<ac:task-uuid>x</ac:task-uuid>]]></c>"


def test_entities(value):
    assert value(M.decoded(F.lit("&lt;&#39;&#x20AC;&euro;&apos;&bogus;&#xD800;&#99999999;&amp;amp; & &"))) == "<'€€'&bogus;&#xD800;&#99999999;&amp; & &"
    assert value(M.html_text(F.lit("<p>&copy;&nbsp;2024 &#8364;</p>"))) == "©\u00a02024 €"
