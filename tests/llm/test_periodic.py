"""Runs of words against a search period by period."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from docloom.llm import periodic


def runs_of(words):
    """Every maximal stretch of each period; of equal stretches the smallest period."""
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(12, 2 * q):
                best.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in best.items())


def text(rng):
    kinds, n = rng.choice([1, 2, 3, 6, 40, 300]), rng.choice([0, 1, 11, 12, 13, 25, 60, 150])
    words = [f"w{rng.randrange(kinds)}" for _ in range(n)]
    for _ in range(rng.randrange(4)):
        if len(words) > 3:
            a = rng.randrange(len(words) - 1)
            b = rng.randrange(a + 1, min(len(words), a + 40) + 1)
            words[a:b] = words[a:b] * rng.randrange(1, 6)
    return words


def check(texts):
    for words, (ids, _, s, e, q) in zip(texts, periodic.found_runs([" ".join(w).encode() for w in texts]), strict=True):
        assert len(ids) == len(words)
        assert list(zip(s.tolist(), (e - s).tolist(), q.tolist(), strict=True)) == runs_of(words)


@pytest.mark.parametrize("seed", range(6))
def test_random_texts(seed):
    rng = random.Random(seed)
    check([text(rng) for _ in range(60)])


def test_regular_texts():
    a, b = ["a"], ["b"]
    while len(b) < 600:  # Fibonacci words: many runs
        a, b = b, b + a
    thue_morse = [str(bin(i).count("1") % 2) for i in range(512)]
    check([b, thue_morse, ["x"] * 500, "a b c d e".split() * 60 + ["a", "b"], (["p"] * 9 + ["q"]) * 8, ["z"] * 11, ["z"] * 12, "a b c d e f".split() * 2, "a b c d e".split() * 2])


def test_colliding_hashes_are_noticed(monkeypatch):
    monkeypatch.setattr(periodic, "PRIMES", ((3, 2), (5, 3)))
    rng = random.Random(9)
    check([text(rng) for _ in range(30)])


def test_long_text():
    rng = random.Random(2)
    part = [f"w{rng.randrange(1000)}" for _ in range(70_000)]
    (ids, words, s, e, q), = periodic.found_runs([" ".join([*part, *part, *part[:5]]).encode()])
    assert (0, 140_005, 70_000) in set(zip(s.tolist(), e.tolist(), q.tolist(), strict=True))
    assert periodic.collapsed(ids, words, s, e, q) == " ".join(part).encode()


def test_grammar_expands_to_the_words():
    rng = np.random.default_rng(3)
    ids = np.concatenate([rng.integers(0, 5, 400), np.tile(rng.integers(5, 20, 17), 30)])
    grammar = periodic.re_pair(ids)
    assert grammar.rest_at[0] == 0 and (grammar.rest_at[1:] == grammar.rest_end[:-1]).all() and grammar.rest_end[-1] == len(ids)
    for rule, at in zip(grammar.made, grammar.made_at, strict=True):
        first, size = grammar.first[rule], grammar.length[rule]
        assert (ids[at : at + size] == ids[first : first + size]).all() and 0 < grammar.left[rule] < size


def test_documents(spark):
    rng = random.Random(11)
    rows = [(i if i % 17 else None, rng.choice(["\n", " ", "\t ", " \x0b"]).join(text(rng)), "a", "b") for i in range(120)]
    rows += [(500, None, "a", "b"), (501, "", "a", "b"), (502, " \n ", "a", "b"), (503, "é " * 30, "a", "b"), (503, "é " * 30, "a", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, h string")
    got = sorted(map(tuple, periodic.run_digests(periodic.find_runs(periodic.with_repeats(docs, docs.doc_id, docs.text))).collect()), key=str)
    want = []
    for doc_id, body, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", body or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if doc_id is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = runs_of(words)
        dropped = {i for s, size, q in runs for i in range(s + q, s + size)}
        s, size, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((doc_id, len(runs), s, size, q, 1000 * size // q if runs else None, sha("".join(f"{s},{z},{p}\n" for s, z, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped))))
    assert got == sorted(want, key=str)
    assert periodic.find_runs(docs.limit(0)).count() == 0
