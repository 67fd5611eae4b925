"""Ignore rules against a restatement path by path."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docloom.operators import filters as FL

NAMES = ["a", "b", "ab", "abc", "doc", "x.md", "y.md", "a.log", "keep.md"]
PATTERNS = [
    "a", "b/", "/a", "a/b", "a/*", "a/**", "**/b", "a/**/x.md", "*.md", "!keep.md", "!a/keep.md", "a?", "[ab]", "[!a]b", "doc/*", "!doc/keep.md", "!doc/a/", "*/b", "a*c", "*b*", "*", "!*/", "!*.md",
    "**", "/*", "!/doc", "a/*/x.md", "# note", "", "\\!a", "x.md ", "*.*", "**/doc/**"]


def translated(pattern):
    """A regular expression for relative paths, directories with a slash behind."""
    anchored, parts, out = "/" in pattern, pattern.lstrip("/").split("/"), ""
    for i, part in enumerate(parts):
        if part == "**":
            out += ".*" if i == len(parts) - 1 else "(?:.+/)?"
            continue
        body = "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else c if c in "[]" else "^" if c == "!" and part[max(0, j - 1)] == "[" else re.escape(c) for j, c in enumerate(part))
        out += ("[^/]+" if part == "*" else body) + ("/" if i < len(parts) - 1 else "")
    return ("" if anchored else "(?:.+/)?") + out


def excluded(path, lists):
    steps = path.split("/")
    for n in range(1, len(steps) + 1):
        prefix = "/".join(steps[:n]) + ("/" if n < len(steps) else "")
        for base, lines in lists.items():
            if base and not prefix.startswith(base + "/") or prefix == base + "/":
                continue
            rel, verdict = prefix[len(base) + 1 :] if base else prefix, None
            for line in lines:
                line = line.rstrip(" ")
                if not line or line.startswith("#"):
                    continue
                negated, line = line.startswith("!"), re.sub(r"^\\(?=[#!])", "", line.removeprefix("!"))
                if re.fullmatch(translated(line.removesuffix("/")) + ("/.*" if line.endswith("/") else "(?:/.*)?"), rel):
                    verdict = not negated
            if verdict:
                return True
    return False


def entries(spark, paths):
    return spark.createDataFrame([(p,) for p in paths], "path string").select("path", F.regexp_replace("path", "/?[^/]*$", "").alias("dir"), F.substring_index("path", "/", -1).alias("name"))


def test_random_rules(spark):
    rng = random.Random(4)
    rules, paths, wanted = [], [], set()
    for case in range(120):
        lists = {f"c{case}": [rng.choice(PATTERNS) for _ in range(rng.randint(1, 5))]}
        for below in ("a", "doc", "doc/a"):
            if rng.random() < 0.3:
                lists[f"c{case}/{below}"] = [rng.choice(PATTERNS) for _ in range(rng.randint(1, 3))]
        rules += [(base, n, p) for base, lines in lists.items() for n, p in enumerate(lines)]
        mine = {f"c{case}/" + "/".join(rng.choice(NAMES) for _ in range(rng.randint(1, 4))) for _ in range(25)}
        paths += mine
        wanted |= {p for p in mine if excluded(p, lists)}
    found = FL.ignored_entries(entries(spark, paths), spark.createDataFrame(rules, "base_dir string, line_no int, pattern string"))
    assert {r["path"] for r in found.collect()} == wanted and 100 < len(wanted) < len(paths) - 100


@pytest.fixture(scope="module")
def ignored(spark):
    def run(patterns, paths):
        rules = spark.createDataFrame([("", n, p) for n, p in enumerate(patterns)], "base_dir string, line_no int, pattern string")
        return {r["path"] for r in FL.ignored_entries(entries(spark, paths), rules).collect()}

    return run


def test_negation_below_a_star(ignored):
    assert ignored(["dir/*", "!dir/keep.md"], ["dir/keep.md", "dir/other.md", "dir/sub/keep.md"]) == {"dir/other.md", "dir/sub/keep.md"}


def test_escapes(ignored):
    assert ignored([r"\*.md", r"a\?b", r"\!x", r"c\[1\]", "d+e.*"], ["*.md", "x.md", "a?b", "axb", "!x", "x", "c[1]", "c1", "d+e.f", "dde.f"]) == {"*.md", "a?b", "!x", "c[1]", "d+e.f"}


def test_directories_as_entries(spark):
    rows = [("build", "", "build", True), ("build", "x", "build", False), ("build/keep.md", "build", "keep.md", False), ("src", "", "src", True)]
    docs = spark.createDataFrame(rows, "path string, dir string, name string, is_dir boolean")
    rules = spark.createDataFrame([("", 0, "build/"), ("", 1, "!build/keep.md"), ("build", 0, "*")], "base_dir string, line_no int, pattern string")
    kept = FL.filter_ignored(docs, rules)
    assert kept.columns == docs.columns and {tuple(r)[:2] for r in kept.collect()} == {("build", "x"), ("src", "")}


def test_no_rules(spark, ignored):
    none = spark.createDataFrame([], "base_dir string, line_no int, pattern string")
    assert FL.filter_ignored(entries(spark, ["a/b"]), none).count() == 1
    assert ignored(["# only", "", "  "], ["a", "b/c"]) == set()


def test_one_crowded_directory(spark):
    docs = spark.range(20000).select(F.concat(F.lit("hot/n"), "id", F.lit(".md")).alias("path"), F.lit("hot").alias("dir"), F.concat(F.lit("n"), "id", F.lit(".md")).alias("name"))
    rules = spark.createDataFrame([("", 0, "*7.md"), ("hot", 0, "!*77.md")], "base_dir string, line_no int, pattern string")
    assert FL.filter_ignored(docs, rules).count() == 18000
