"""Extraction operators against literal cases and a sequential restatement of the rules."""

import random

import pytest

from docloom.operators import handlers as H
from docloom.operators import metadata as MD
from docloom.operators import structure as S
from docloom.operators import filters as FL
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def docs(spark):
    def make(*bodies):
        return spark.createDataFrame([(f"d{n}.md", b, 1, None) for n, b in enumerate(bodies)], "path string, body string, start_line int, fm_title string")

    return make


OUTLINE = """# Section 1

#### Section 1.1
#### Section 1.2

`````md
# not a heading
```
not a heading
=============
`````

    ```
    # not a heading
        ```
    ```

Section 2
=========

Section 2.1
-----------

not a heading
-*-*-*-*-*-*-

## Section 2.2 ##
"""


def test_headings_with_nested_fences(docs, rows):
    assert rows(S.headings(docs(OUTLINE)), "pos", "level", "text") == {
        (1, 1, "Section 1"), (2, 4, "Section 1.1"), (3, 4, "Section 1.2"), (4, 1, "Section 2"), (5, 2, "Section 2.1"), (6, 2, "Section 2.2")}


def outline(found):
    got = {}
    for r in found.collect():
        got.setdefault(r.path, []).append((r.pos, r.level, r.text))
    return {path: sorted(heads) for path, heads in got.items()}


def test_headings_keep_under_edits(docs):
    """A fence around a text leaves no headings, a paragraph at its end changes none, a heading at its end adds itself."""
    random.seed(7)
    parts = ["# a", "## b ##", "#x", "text", "", "- item", "####### deep", "tail #", "\tx", " ", "== x"]
    texts = ["\n".join(random.choice(parts) for _ in range(random.randint(0, 14))) + "\n" for _ in range(300)]
    plain = outline(S.headings(docs(*texts)))
    assert outline(S.headings(docs(*["```\n" + t + "```\n" for t in texts]))) == {}
    assert outline(S.headings(docs(*[t + "\nlast words\n" for t in texts]))) == plain
    longer = outline(S.headings(docs(*[t + "\n### end\n" for t in texts])))
    for n in range(len(texts)):
        before = plain.get(f"d{n}.md", [])
        assert longer[f"d{n}.md"] == [*before, (len(before) + 1, 3, "end")]


def test_strip_title_on_random_documents(docs):
    random.seed(8)
    parts = ["# a", "text", "", "---", "===", "```", "## c"]
    texts = ["\n".join(random.choice(parts) for _ in range(random.randint(0, 9))) + random.choice(["", "\n"]) for _ in range(400)]
    for r in S.strip_title(docs(*texts)).collect():
        text = texts[int(r.path[1:-3])]
        assert len(r.body) <= len(text)
        if not r.stripped:
            assert r.body == text
    got = {r.path: (r.stripped, r.body) for r in S.strip_title(docs("intro\n```\n# no\n```\n# Title\nrest\n", "Title\n===\nrest")).collect()}
    assert got == {"d0.md": (True, "intro\n```\n# no\n```\nrest\n"), "d1.md": (True, "rest")}


def test_long_documents_do_not_exhaust_the_stack(docs, rows):
    fence = "```\n" + "x = 1\n" * 60_000 + "```\n"
    body = fence + "- [ ] a\n" * 20_000 + "\n" + "> quote\n" * 20_000 + "\n| a |\n|---|\n" + "| b |\n" * 20_000 + "\n# Last\n"
    d = docs(body)
    assert rows(S.headings(d), "level", "text") == {(1, "Last")}
    assert S.tasks(d).count() == 20_000
    assert S.alerts(d).count() == 0
    assert S.table_cells(d).count() == 20_001
    assert S.fenced_blocks(d).count() == 1
    assert S.lines(d).where("block IS NOT NULL").count() == 60_002


def test_heading_tree_and_title(spark, rows):
    def tree(*entries):
        return spark.createDataFrame([("d", n + 1, level, text) for n, (level, text) in enumerate(entries)], "path string, pos int, level int, text string")

    heads = tree((2, "S1"), (3, "1.1"), (3, "1.2"), (6, "1.2.1"), (6, "1.2.2"), (3, "1.3"), (4, "1.3.1"), (2, "S2"))
    assert rows(S.heading_tree(heads), "text", "parent_pos") == {
        ("S1", None), ("1.1", 1), ("1.2", 1), ("1.2.1", 3), ("1.2.2", 3), ("1.3", 1), ("1.3.1", 6), ("S2", None)}
    assert rows(S.toc(heads), "text", "outline", "depth") == {
        ("S1", "1", 1), ("1.1", "1.1", 2), ("1.2", "1.2", 2), ("1.2.1", "1.2.1", 3), ("1.2.2", "1.2.2", 3), ("1.3", "1.3", 2), ("1.3.1", "1.3.1", 3), ("S2", "2", 1)}


def test_unique_title(docs, rows):
    d = docs("## Title\n### S1\n### S2\n#### S2.1\n", "# A\n# B\n", "no heading", "### deep\n# A\n")
    assert rows(S.unique_title(d)) == {("d0.md", "Title"), ("d1.md", None), ("d2.md", None), ("d3.md", None)}


def test_code_blocks(docs, rows):
    d = docs("```csharp\nvar x;\n\n```\n~~~ klingon\nnuqneH\n~~~\n```\nplain\n```\n```java\nunclosed\n")
    assert rows(S.code_blocks(d), "lang", "content", "language") == {("csharp", "var x;", "c#"), ("klingon", "nuqneH", "klingon"), ("", "plain", "none")}
    assert rows(S.code_blocks(d, strict=True), "lang", "language") == {("csharp", "c#"), ("klingon", "none"), ("", "none")}


def test_fence_intervals(docs, rows):
    d = docs("a\n```py\nx\n```\nb\n~~~\nrest\n")
    assert rows(S.fence_intervals(d), "start_line", "end_line", "marker", "lang", "closed") == {(2, 4, "```", "py", True), (6, 7, "~~~", "", False)}


def test_mentions(docs, rows):
    d = docs("[Kornel](mailto:k@x.org) [Laura](mailto:l@x.org) [](mailto:n@x.org) [Kornel](mailto:k@x.org)")
    assert rows(S.mentions(d), "email", "name") == {("k@x.org", "Kornel"), ("l@x.org", "Laura")}


def test_links_and_images(docs, rows):
    d = docs('[a](b.md#f) ![i](p.png) [![x](y.png)](z.pdf) `[no](no.md)` [m](mailto:a@b.c) [s](#t)\n\n![blk](q.svg "T")\n')
    assert rows(S.links(d), "text", "url", "kind", "fragment") == {
        ("a", "b.md#f", "page", "f"), ("", "z.pdf", "attachment", None), ("m", "mailto:a@b.c", "mention", None), ("s", "#t", "anchor", "t")}
    captions = S.image_caption(S.images(d))
    assert rows(captions, "url", "context", "caption") == {("p.png", "inline", None), ("y.png", "inline", None), ("q.svg", "block", "T")}


def test_footnotes(docs, rows):
    d = docs("A[^1] b[^string] c[^multi] d[^multi] e[^multi] f[^gone]\n\n[^1]: one\n[^string]: two\n[^multi]: three\n")
    assert rows(S.footnote_refs(d), "name", "anchor") == {("1", "1"), ("string", "string"), ("multi", "multi"), ("multi", "multi-2"), ("multi", "multi-3")}
    assert rows(S.footnote_defs(d), "name", "label") == {("1", "↩"), ("string", "↩"), ("multi", "↩¹"), ("multi", "↩²"), ("multi", "↩³")}


def test_tasks_need_every_item(docs, rows):
    d = docs("- [x] done\n- [ ] open\n\n- [x] a\n- plain\n\n- plain\n- [ ] b\n")
    assert rows(S.tasks(d), "list_id", "task_id", "status", "body") == {(1, 1, "complete", "done"), (1, 2, "incomplete", "open")}


def test_alerts(docs, rows):
    names = ["[!NOTE]", "[!TIP]", "[!IMPORTANT]", "[!WARNING]", "[!CAUTION]", "FLAG: x", "NOTE: x", "WARNING: x", "DISCLAIMER: x"]
    found = S.alerts(docs("\n\n".join(f"> {n}\n> text" for n in names) + "\n\n> plain\n\n> [!ODD]\n"))
    assert [(r["class"]) for r in found.orderBy("pos").collect()] == ["info", "tip", "note", "note", "warning", "note", "info", "note", "info", None]


def test_tables(docs, rows):
    d = docs("|  |  |\n|---|---|\n| a | b |\n", "| h |  | v |\n|---|---|---|\n| r |  | 1 |\n")
    assert rows(S.table_cells(d), "path", "row", "col", "text", "is_header") == {
        ("d0.md", 1, 1, "a", False), ("d0.md", 1, 2, "b", False),
        ("d1.md", 1, 1, "h", True), ("d1.md", 1, 2, "v", True), ("d1.md", 2, 1, "r", True), ("d1.md", 2, 2, "1", False)}


def test_collapsed_math_status(docs, rows):
    d = docs('<details markdown="1"><summary>S</summary>\nbody\n</details>\n<details>x</details>\n$a$ $$b$$ \\(c\\) ![Ok][STATUS-GREEN] ![Off][STATUS-GRAY]\n')
    assert rows(S.collapsed_sections(d), "summary", "body", "error") == {("S", "body", None), (None, "x", "summary must come first")}
    assert rows(S.math_formulas(d), "kind", "formula") == {("inline", "a"), ("block", "b"), ("inline", "c")}
    assert rows(S.status_labels(d), "caption", "color", "parameter") == {("Ok", "green", "Green"), ("Off", "gray", None)}


def scan(spark, text):
    return MD.scan(spark.createDataFrame([("a.md", text)], "path string, text string"))


@pytest.mark.parametrize("text, expected", [
    ("# Title\n<!-- page-id: 1234 -->\n", ("1234", None, None)),
    ('---\n{"title": "T", "page_id": "5"}\n---\nbody', ("5", None, "T")),
    ("<!--\ntitle: C\n-->\nbody", (None, None, "C")),
    ("---\ntitle: End\n---", (None, None, "End")),
    ("---\njust text\n---\nbody", (None, None, None)),
    ("<!-- page-id: 1 -->\n---\ntitle: X\n---\n", ("1", None, None)),
    ("---\npage_id: 2\nspace_key: S\n---\n<!-- page_id: 1 -->", ("1", "S", None)),
])
def test_document_properties(spark, text, expected):
    row = MD.document_properties(scan(spark, text)).first()
    assert (row.page_id, row.space_key, row.fm_title) == expected


def test_only_the_first_directive_is_taken(spark):
    row = scan(spark, "<!-- page-id: 1 -->x<!-- page-id: 2 -->").first()
    assert (row.d_page_id, row.body) == ("1", "x<!-- page-id: 2 -->")


def test_directive_prefix(spark):
    docs = spark.createDataFrame([("a", "<!-- wiki-page-id: 7 --> <!-- wiki_space_key: K -->")], "path string, text string")
    row = MD.document_properties(MD.scan(docs, "wiki"), "wiki").first()
    assert (row.page_id, row.space_key) == ("7", "K")


def test_frontmatter_entries(spark, rows):
    text = '---\ntitle: "Q: x"\ntags: [a, "b c"]\nlist:\n  - one\n  - two\nproperties:\n  k: v\nsynchronized: false\n---\nbody\n'
    scanned = scan(spark, text)
    assert rows(MD.frontmatter_kv(scanned), "key", "idx", "value") == {
        ("title", 0, "Q: x"), ("tags", 1, "a"), ("tags", 2, "b c"), ("list", 3, "one"), ("list", 4, "two"), ("properties.k", 5, "v"), ("synchronized", 6, "false")}
    row = MD.properties(scanned).first()
    assert (row.tags, row.synchronized, row.properties, row.start_line) == (["a", "b c"], False, {"k": "v"}, 11)


def test_skip_sections(docs, rows):
    d = docs("a<!-- skip-start -->b\nc<!-- skip-end -->d", "x<!-- skip-start -->y")
    assert rows(FL.strip_skipped(d), "ok", "kept") == {(True, "ad"), (False, "x<!-- skip-start -->y")}


def test_handlers(docs, rows):
    d = docs("```mermaid\nclassDiagram\nA <|-- B\nB <|-- C\nA <|-- C\n```\n```py\nx\n```\n")
    edges = H.class_edges(d)
    assert rows(edges, "parent", "child") == {("A", "B"), ("B", "C"), ("A", "C")}
    assert rows(H.class_tree(edges), "node", "depth", "chain") == {("A", 0, "A"), ("B", 1, "A/B"), ("C", 1, "A/C"), ("C", 2, "A/B/C")}
    first = H.Handler("first", lambda: F.col("lang") == "py", lambda: F.upper("content"))
    second = H.Handler("second", lambda: F.lit(True), lambda: F.lit("other"))
    assert rows(H.apply_handlers(S.fenced_blocks(d), [first, second]), "lang", "handler", "output") == {("py", "first", "X"), ("mermaid", "second", "other")}
