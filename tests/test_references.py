"""Links and images of every form, in order, against literal cases."""

import pytest

from docloom.operators import references as R


@pytest.fixture(scope="module")
def found(spark):
    def run(*texts):
        docs = spark.createDataFrame([(f"d{n}", t) for n, t in enumerate(texts)], "path string, body string")
        out = {f"d{n}": [] for n in range(len(texts))}
        for r in R.references(docs).orderBy("path", "pos").collect():
            out[r["path"]].append((r["image"], r["form"], r["text"], r["url"], r["title"]))
        return [out[f"d{n}"] for n in range(len(texts))]

    return run


def test_forms(found):
    got = found(
        "[a](x.md) [b](<x y.md> 'T') [c](u_(v).md \"Q\")",
        "[t][Lab  el] [Lab el][] [lab el] [none] [t][none] [^1]\n\n[LAB EL]: http://x.y/z \"Title\"\n",
        "<https://a.b/c> <me@x.org> https://bare.org/p?q=1. (http://no.org) `https://code.org`",
        "<a class='k' href='p.md' title=\"T\">say <b>it</b></a> <A HREF=\"q&amp;r\">x</A> <a name='n'>no</a>",
        "[a [b] c](d.md) [![alt](i.png)](t.md) ![x [y]](z.png 'T') [out [in](a.md) x](b.md)",
        "![i][img] ![img] <img src='s.png' alt=\"A\"> <img alt='none'>\n\n[img]: p.png (Paren)\n[img]: last.png\n",
        r"\[no](x.md) [a\]b](y.md) [open [half](z.md)", "", None)
    assert got == [
        [(False, "inline", "a", "x.md", None), (False, "inline", "b", "x y.md", "T"), (False, "inline", "c", "u_(v).md", "Q")],
        [(False, "reference", "t", "http://x.y/z", "Title"), (False, "collapsed", "Lab el", "http://x.y/z", "Title"), (False, "shortcut", "lab el", "http://x.y/z", "Title")],
        [(False, "address", "https://a.b/c", "https://a.b/c", None), (False, "address", "me@x.org", "mailto:me@x.org", None), (False, "bare", "https://bare.org/p?q=1", "https://bare.org/p?q=1", None)],
        [(False, "tag", "say it", "p.md", "T"), (False, "tag", "x", "q&r", None)],
        [(False, "inline", "a [b] c", "d.md", None), (False, "inline", "", "t.md", None), (True, "inline", "alt", "i.png", None), (True, "inline", "x [y]", "z.png", "T"),
         (False, "inline", "out in x", "b.md", None), (False, "inline", "in", "a.md", None)],
        [(True, "reference", "i", "last.png", None), (True, "shortcut", "img", "last.png", None), (True, "tag", "A", "s.png", None)],
        [(False, "inline", "a]b", "y.md", None), (False, "inline", "half", "z.md", None)], [], []]


def test_kinds(spark, rows):
    docs = spark.createDataFrame([("d", "[a](x.md#f) [b](#g) <me@x.org> [r]\n\n![p](q.png) ![e](https://x/y.png)\n\n[r]: https://z.org\n")], "path string, body string")
    assert rows(R.all_links(docs), "url", "kind", "fragment") == {("x.md#f", "page", "f"), ("#g", "anchor", "g"), ("mailto:me@x.org", "mention", None), ("https://z.org", "absolute", None)}
    assert rows(R.all_images(docs), "alt", "url", "kind") == {("p", "q.png", "local"), ("e", "https://x/y.png", "external")}
    assert rows(R.definitions(docs)) == {("d", "r", "https://z.org", None)}


def test_cards(spark, rows):
    docs = spark.createDataFrame([("d", "https://bare.org/x\n\n<https://auto.org>\n\n[in](https://in.org) more\n\n[c](https://c.org)\n\n[r]\n\n[p](local.md)\n\n[r]: https://ref.org\n")], "path string, body string")
    assert rows(R.card_references(docs)) == {("d", 1, "https://bare.org/x", "https://bare.org/x"), ("d", 2, "https://auto.org", "https://auto.org"), ("d", 4, "c", "https://c.org"), ("d", 5, "r", "https://ref.org")}


def test_long_text(found):
    many = "word [a](b.md) " * 1500
    deep = "[" * 300 + "x" + "](y)" * 300
    a, b = found(many, deep)
    assert len(a) == 1500 and len(b) == 300
