"""Small tables against brute force, with nulls, empty texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import blocknames, classifier, common, overlap, packing, pieces, quotation, secrets, suffixes, topk, toxicity
from docloom.llm.queries import vocabulary

WORDS = "the of and anor thle erst ble tion he in to ou is wh re ti sh".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) + rng.choice(["", ".", ",", "\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [prose(rng, rng.randint(1, 90)) for _ in range(40)]
    passage = prose(rng, 30)
    out = base + base[:6] + [t + " tail" for t in base[10:16]] + [passage + " " + prose(rng, 12) for _ in range(8)] + [prose(rng, 5) + passage for _ in range(5)]
    for t in base[20:30]:
        words = t.split(" ")
        words[len(words) // 2] = "changed"
        out.append(" ".join(words))
    return [None, "", " \n", "one two", "one two", *out, "é" * 70, "é" * 70, "ab" * 400, "ab" * 300, prose(rng, 3000)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i * 3 % 97 + 100 * (i // 97), t, f"s{i % 3}" if i % 7 else None, "kept", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score string, _id long")


def table(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


def covered(texts, length):
    first, out = {}, {}
    for d in sorted(texts):
        raw = texts[d].encode()
        removed = np.zeros(len(raw), bool)
        windows = [raw[i : i + length] for i in range(len(raw) - length + 1)]
        for i, w in enumerate(windows):
            if first.get(w, d) < d:
                removed[i : i + length] = True
        for w in windows:
            first.setdefault(w, d)
        out[d] = (len(raw), int(removed.sum()), len(common.runs(removed)[0]), hashlib.sha256(np.frombuffer(raw, np.uint8)[~removed].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_repeats(docs, hot, monkeypatch):
    if hot:
        monkeypatch.setattr(suffixes, "hot_buckets", lambda counts: np.where(counts >= 3, 3, 0))
    got = {r[0]: tuple(r[1:5]) for r in suffixes.remove_repeats(docs).collect()}
    assert got == covered(table(docs), 50)


def test_suffix_order():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    at, group = rng.permutation(360), rng.integers(0, 5, 360)
    order = suffixes.sorted_suffixes(data, common.prefix_polynomial(data), at, group, 40)
    raw = data.tobytes()
    assert [(group[i], raw[at[i] : at[i] + 40]) for i in order] == sorted((g, raw[a : a + 40]) for g, a in zip(group, at))


def components(texts):
    sets, lists, parent = {}, defaultdict(list), {d: d for d in texts}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[d] = set(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else {tuple(w)} if w else set()
        for x in sets[d]:
            lists[x].append(d)

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in texts:
        for b in {x for s in sets[a] for x in lists[s]}:
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in texts}


@pytest.mark.parametrize("hot", [False, True])
def test_components(docs, hot, monkeypatch):
    if hot:
        monkeypatch.setattr(overlap, "hot_buckets", lambda counts: np.where(counts >= 3, 2, 0))
    assert {r[0]: (r[1], r[2]) for r in overlap.near_components(docs).collect()} == components(table(docs))


def subset_copies():
    """Texts with one truncated or extended copy each, at Jaccard similarities from 0.7 to 0.95."""
    rng, out = random.Random(7), []
    for n in (12, 40, 104, 300):
        for percent in (70, 74, 76, 80, 86, 90, 95):
            words, more = prose(rng, n + 4).split(), prose(rng, max(1, round(n * 100 / percent) - n)).split()
            at = rng.choice([0, len(words)])
            out += [" ".join(words), " ".join(words[:at] + more + words[at:])]
    return out


@pytest.mark.parametrize("hot, rounds", [(False, 2), (True, 0)])
def test_components_of_subset_copies(spark, hot, rounds, monkeypatch):
    monkeypatch.setattr(overlap, "ROUNDS", rounds)
    if hot:
        monkeypatch.setattr(overlap, "hot_buckets", lambda counts: np.where(counts >= 2, 2, 0))
    docs = spark.createDataFrame(list(enumerate(subset_copies())), "doc_id long, text string")
    want = components(table(docs))
    assert 20 <= sum(c != d for d, (_, c) in want.items()) < 28
    assert {r[0]: (r[1], r[2]) for r in overlap.near_components(docs).collect()} == want


def test_lists_within_a_component_are_left_out(spark, monkeypatch):
    kept, stored = [], overlap.stored

    def counted(df, name):
        out = stored(df, name)
        if name == "open-lists":
            kept.append(out.count())
        return out

    monkeypatch.setattr(overlap, "stored", counted)
    monkeypatch.setattr(overlap, "WORTH", 1 << 30, raising=False)
    docs = spark.createDataFrame(list(enumerate(subset_copies())), "doc_id long, text string")
    assert {r[0]: (r[1], r[2]) for r in overlap.near_components(docs).collect()} == components(table(docs))
    assert len(kept) >= 3 and kept[0] > kept[-1]


def test_divide_skip():
    rng = np.random.default_rng(2)
    query = np.unique(rng.integers(0, 300, 120).astype(np.uint64))
    others = [np.unique(rng.integers(0, 300, k).astype(np.uint64)) for k in (5, 60, 200, 400)] + [query]
    least = overlap.least_overlap(len(query), np.array([len(x) for x in others]), 30)
    true = np.array([len(np.intersect1d(query, x)) for x in others])
    assert list(overlap.divide_skip(query, others, least)) == list(np.where(true >= least, true, 0))


def test_exact_copies(docs):
    groups = defaultdict(list)
    for r in docs.collect():
        groups[re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")].append((-len(r["text"] or ""), r["doc_id"]))
    want = {d: (min(g)[1], len(g), d == min(g)[1], hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for _, d in g}
    for block in (7, 2048):
        got = blocknames.exact_dedup(docs.withColumn("kept", F.lit(1)), block=block)
        assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got.collect()} == want
    twice = blocknames.exact_dedup(docs.union(docs))
    assert twice.where("kept").count() == len(groups)


def test_packing(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    rows = packing.packed_pieces(docs, vocabulary("byte_bpe_50k.json"), sequence=64, window=256, span=1024, targets={"s0": 0.7}).collect()
    own, places = defaultdict(dict), defaultdict(dict)
    for r in rows:
        assert r["length"] == len(r["token_ids"]) > 0
        own[r["doc_id"]][r["start"]] = r["token_ids"]
        places[r["sequence_id"]][r["offset"]] = r["length"]
    for d, t in table(docs).items():
        assert [x for s in sorted(own[d]) for x in own[d][s]] == [*library.encode(t, add_special_tokens=False).ids, 1]
    sizes = {}
    for k, found in places.items():
        at = 0
        for offset in sorted(found):
            assert offset == at
            at += found[offset]
        sizes[k] = at
    assert sorted(sizes) == list(range(len(sizes))) and all(sizes[k] == 64 for k in sizes if k < len(sizes) - 1)


def test_round_robin():
    totals = np.array([1000, 300, 10])
    served = packing.round_robin(totals, 100, totals / totals.sum())
    assert (np.diff(served, axis=0) >= 0).all() and (served[-1] == totals).all()
    assert (served[:-1].sum(1) == 100 * np.arange(len(served) - 1)).all()
    exact = np.minimum(np.arange(len(served)) * 100, totals.sum())[:, None] * totals / totals.sum()
    assert np.abs(served - exact).max() <= 2


def test_pieces(docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    rng = random.Random(3)
    odd = ["".join(rng.choice(" ▁aAbé0_-.,ñ日\n\t́😀") for _ in range(rng.randint(1, 30))) for _ in range(300)]
    agenda = pieces.Agenda(vocabulary("piece_bpe_32k.model"))
    assert [[1, *agenda.encode(t), 2] for t in odd] == library.encode(odd, add_bos=True, add_eos=True)
    for r in pieces.encode_and_decode(docs, vocabulary("piece_bpe_32k.model")).collect():
        ids = library.encode(r["text"] or "", add_bos=True, add_eos=True)
        assert r["piece_ids"] == ids and r["decoded"] == library.decode(ids)


def test_segments_merge_together():
    agenda = pieces.Agenda(vocabulary("piece_bpe_32k.model"))
    rng = random.Random(5)
    segments = ["".join(rng.choice("▁aeinrstAé0,.\n日😀") for _ in range(rng.randint(1, pieces.SHORT))) for _ in range(500)]
    segments += ["a", "😀", "▁", "aaaaaaa", "▁international", "日" * pieces.SHORT]
    assert agenda.merged_together(segments) == [tuple(agenda.merged(s)) for s in segments]
    assert agenda.merged_together(["ab"]) == [tuple(agenda.merged("ab"))]
    heaped, agenda.merged = [], lambda s, merged=agenda.merged: heaped.append(s) or merged(s)
    texts = ["one two one", "", "x" * (pieces.SHORT + 9) + " one", "\n\nnew, words."] * 2
    assert agenda.encode_all(texts) == agenda.encode_all(texts) == agenda.library.encode(texts)
    assert {len(s) for s in heaped} == {pieces.SHORT + 10} and all(len(s) <= pieces.SHORT for s in agenda.cache)
    assert [agenda.encode(t) for t in texts] == agenda.library.encode(texts)


def test_secrets(spark):
    body = "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5"
    good = "ghp_" + body + secrets.checksum(body)
    texts = [None, "", f"é {good} x", good[:-1] + "!", "Password = 'abcdefgh1' secret: token: short api-key", "pass token:=x TOKEN='12345678'", "AKIA" + "A1" * 8, "AKIA12", "é" + "0a" * 16 + "g" + "f" * 31, "-----BEGIN RSA PRIVATE KEY-----"]

    def brute(t):
        found = [("assign", m.start(), m.end()) for m in secrets.ASSIGN.finditer(t) if len(m[2]) >= 8]
        found += [("access", m.start(), m.end()) for m in secrets.ACCESS.finditer(t) if len(m[0]) >= 16]
        found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        found += [("github", m.start(), m.end()) for m in re.finditer(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])", t) if secrets.checksum(m[1]) == m[2]]
        found += [("pem", m.start(), m.end()) for m in secrets.PEM.finditer(t)]
        return sorted(found, key=lambda s: (s[1], secrets.KINDS.index(s[0])))

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = secrets.secret_digests(docs).collect()
    assert {r["doc_id"]: r["spans"] for r in got} == {i: ",".join(f"{k}:{a}:{b}" for k, a, b in brute(t or "")) for i, t in enumerate(texts)}
    assert good not in secrets.redact_secrets(docs).where("doc_id = 2").first()["text"]


def test_top_k(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.round(rng.normal(0, 0.3, 6), 1)]) for i in range(150)] + [(150, None), (151, [1.0, None]), (152, [float("nan")]), (153, [0.1]), (154, []), (155, [0.0] * 6)]
    vectors = topk.vector_rows(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.exact_top_k(vectors.where("id % 5 = 0"), vectors, query_block=7, candidate_block=40).collect()}
    weights = {r["id"]: r["weights"] for r in vectors.collect()}
    want = {}
    for q in weights:
        if q % 5 == 0:
            best = sorted((-sum(a * b for a, b in zip(weights[q], w)), c) for c, w in weights.items() if c != q)[:5]
            want |= {(q, k + 1): (c, -s) for k, (s, c) in enumerate(best)}
    assert got == want


@pytest.mark.parametrize("copies", [2, 6])
def test_top_k_of_repeated_rows(spark, copies):
    rng = np.random.default_rng(8)
    rows = [(i, [int(x) for x in rng.integers(-3, 4, 4)]) for i in range(60)] + [(7, [9, 0, 0, 0]), (7, [9, 0, 0, 1])]
    vectors = spark.createDataFrame([r for r in rows for _ in range(copies)], "id long, weights array<long>").coalesce(1)
    got = sorted(map(tuple, topk.exact_top_k(vectors.where("id % 5 = 0"), vectors, candidate_block=40).collect()))
    want = []
    for q, w in rows[::5]:
        pairs = {(-sum(a * b for a, b in zip(w, v)), c) for c, v in rows if c != q} if q % 5 == 0 else ()
        want += [(q, rank, c, -s) for rank, (s, c) in enumerate(sorted(pairs)[:5], 1)]
    assert got == sorted(want)


def test_quotations(spark):
    rows = [(1, 1, "a", "Hello there\nhow are you"), (1, 2, "b", "> Hello there\n> how are you\nfine"), (1, 3, "a", ">> Hello there\n> fine\nOn Monday x wrote:\n> nothing known\ngood"), (1, 4, "b", None), (2, 1, "a", ""), (None, 5, "a", "loose")]
    found = {(r["conv_id"], r["turn"]): (r["text"], r["reply_to"], r["thread"], r["depth"], r["position"]) for r in quotation.link_quotations(spark.createDataFrame(rows * 2, "conv_id long, turn long, role string, text string")).collect()}
    assert found == {
        (1, 1): ("Hello there\nhow are you", None, 1, 0, 0), (1, 2): ("fine", 1, 1, 1, 1), (1, 3): ("good", 2, 1, 2, 2),
        (1, 4): (None, None, 4, 0, 3), (2, 1): ("", None, 1, 0, 0), (None, 5): ("loose", None, None, None, None)}


@pytest.mark.parametrize("run, label", [(classifier.classify_quality, "quality"), (toxicity.score_toxicity, "toxic")])
def test_classifiers(spark, run, label, docs):
    rng = random.Random(6)
    rows, marks = [], []
    for i in range(600):
        bad = i % 3 == 0
        text = prose(rng, 60)
        rows.append((i, (" ".join(w.upper() + "!!" for w in text.split()) if bad else text) if label == "quality" else text + (" you idiot scum" if bad else "")))
        marks.append((i, int(bad) if label == "toxic" else int(not bad)))
    table_, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, f"doc_id long, {label} int")
    got = {r["doc_id"]: r for r in run(table_, labels).collect()}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    held = [i for i in got if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == marks[i][1] for i in held) >= 0.95 * len(held)
    plain = run(docs, labels.limit(0))
    assert plain.count() == docs.count() and plain.where("score IS NULL OR score < 0 OR score > 1").count() == 0


def test_empty_tables(docs):
    none = docs.limit(0)
    assert suffixes.remove_repeats(none).count() == overlap.near_components(none).count() == blocknames.exact_dedup(none).count() == 0
    assert packing.piece_rows(none, vocabulary("byte_bpe_50k.json")).count() == secrets.secret_digests(none).count() == 0
    assert pieces.piece_digests(none, vocabulary("piece_bpe_32k.model")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    directory = "/root/testdata/sf0.001"
    docs = start = spark.read.parquet(f"{directory}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, common.stored(stage(spark, docs, directory), name)
        assert docs.columns == start.columns and 0 < docs.count() <= before.count()
        if name == "near_dedup":
            linked = components({r["doc_id"]: r["text"] for r in before.collect()})
            assert {r["doc_id"] for r in docs.collect()} == {d for d, (_, c) in linked.items() if c == d}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, directory)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_pipeline_drops_subset_copies(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(subset_copies())], "doc_id long, text string, lang string, source string, n_chars long")
    left = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert left == {d for d, (_, c) in components(table(docs)).items() if c == d}
