"""Loose and nested lists, merged quotes, notes of several paragraphs, and tables without outer pipes."""

import pytest

from docloom.operators import containers as C


@pytest.fixture(scope="module")
def docs(spark):
    def make(*bodies):
        return spark.createDataFrame([(f"d{n}.md", body) for n, body in enumerate(bodies)], "path string, body string")

    return make


def items(docs, text):
    return [tuple(r)[1:] for r in C.list_items(docs(text)).orderBy("path", "list_id", "item_id").collect()]


def test_list_items(docs):
    assert items(docs, "- a\n\n- b\nlazy\n\n    more\n* c\n\npara\n- no list\n\n1. one\n2. two\n") == [
        (1, 1, 0, False, "a"), (1, 2, 0, False, "b\nlazy\n\nmore"), (1, 3, 0, False, "c"), (2, 1, 0, True, "one"), (2, 2, 0, True, "two")]
    assert items(docs, "- a\n    - b\n        1. c\n    - d\n- e\n    - f\n") == [
        (1, 1, 0, False, "a"), (1, 2, 0, False, "e"), (2, 1, 1, False, "b"), (2, 2, 1, False, "d"), (3, 1, 2, True, "c"), (4, 1, 1, False, "f")]
    assert items(docs, "  - a\n   - b\n\ttext\n# head\n- c\n```\n- code\n```\n- d\n") == [(1, 1, 0, False, "a"), (1, 2, 0, False, "b\ntext"), (2, 1, 0, False, "c"), (3, 1, 0, False, "d")]
    assert items(docs, "- a\n\n1. b\n\n- c\n") == [(1, 1, 0, False, "a"), (2, 1, 0, True, "b"), (3, 1, 0, False, "c")]
    assert items(docs, "") == items(docs, "text only\n\n---\n") == []


def test_tasks(docs):
    bodies = [
        "- [x] **Finished**\n- [ ] Open\n", "- first\n- [x] a\n", "- [x] a\n- [ ] b\n\n- plain\n", "- [x] top\n    - [ ] in\n    - [X] in2\n- [ ] last\n", "- [ ] t\n    - plain\n",
        "  - [X] p\n  - [ ] q\n\n    more\n", "para\n- [ ] no\n\n1. [ ] no\n", None]
    got = [tuple(r) for r in C.task_items(docs(*bodies)).orderBy("path", "list_id", "task_id").collect()]
    assert got == [
        ("d0.md", 1, 1, 0, "complete", "**Finished**"), ("d0.md", 1, 2, 0, "incomplete", "Open"),
        ("d3.md", 1, 1, 0, "complete", "top"), ("d3.md", 1, 2, 0, "incomplete", "last"), ("d3.md", 2, 1, 1, "incomplete", "in"), ("d3.md", 2, 2, 1, "complete", "in2"),
        ("d4.md", 1, 1, 0, "incomplete", "t"), ("d5.md", 1, 1, 0, "complete", "p"), ("d5.md", 1, 2, 0, "incomplete", "q\n\nmore")]


def test_quotes(docs):
    found = [tuple(r)[1:] for r in C.quotes(docs("> a\nlazy\n\n> b\n>\n> c\n\ntext\n\n> d\n# h\n> e\n")).orderBy("pos").collect()]
    assert found == [(1, "a\nlazy\n\nb\n\nc"), (2, "d"), (3, "e")]


def test_quote_alerts(docs):
    found = C.quote_alerts(docs("> [!NOTE]\n> one\n\n> [!TIP]\n> still the first\n", "> FLAG: x\n> y\n", "> [!ODD]\n> z\n", "> plain [!NOTE]\n")).orderBy("path").collect()
    assert [tuple(r) for r in found] == [
        ("d0.md", 1, "bracket", "NOTE", "one\n\n[!TIP]\nstill the first", "info", "1f4dd", "pencil", "var(--ds-background-accent-teal-subtlest)", None),
        ("d1.md", 1, "colon", "FLAG", "x\ny", "note", "1f6a9", "triangular_flag_on_post", "var(--ds-background-accent-orange-subtlest)", None), ("d2.md", 1, "bracket", "ODD", "z", None, None, None, None, "unsupported alert")]


def test_note_bodies(docs, rows):
    text = "Text[^a]\n\n[^a]: first\ngoes on\n\n    second paragraph\n    more\n\n\tthird\n[^b]: short\n[^c]: x\n\nno note\n\n[^b]: last\n"
    assert rows(C.note_bodies(docs(text)), "name", "note") == {("a", "first\ngoes on\n\nsecond paragraph\nmore\n\nthird"), ("b", "last"), ("c", "x")}


def test_pipe_tables(docs, rows):
    text = "a | b\n--|:-:\n1 \\| 2 | `x|y`\nonly\n1 | 2 | 3\n\n| c |\n|---|\n| d |\n\nno table | here\n\nx | y\n---\n"
    assert rows(C.pipe_tables(docs(text)), "table_id", "row", "col", "text", "is_header") == {
        (1, 1, 1, "a", True), (1, 1, 2, "b", True), (1, 2, 1, "1 | 2", False), (1, 2, 2, "`x|y`", False), (1, 3, 1, "only", False), (1, 3, 2, "", False), (1, 4, 1, "1", False), (1, 4, 2, "2", False),
        (2, 1, 1, "c", True), (2, 2, 1, "d", False)}
    grid = "|  |  |  |\n|---|---|---|\n| r |  | 1 |\n"
    assert rows(C.pipe_tables(docs(grid)), "row", "col", "text", "is_header") == {(1, 1, "r", True), (1, 2, "1", False)}


def test_long_list(docs):
    assert C.task_items(docs("- [ ] a\n\n" * 3000)).count() == 3000
    assert C.quotes(docs("> q\n" * 20_000)).count() == 1 and C.note_bodies(docs("[^a]: x\n" + "y\n" * 20_000)).count() == 1
