"""The operators against brute force, round trips and held-out accuracy."""

import itertools
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyspan.llm import components, embeddings, encoding, language, lm, minhash, mixing, packing, quality, token_store, topk, words
from keyspan.llm.common import Scratch
from tests.conftest import SF

ADVERSE = ["", " ", "\n", " \n ", "a  b", "a \n b", "a\n\nb", " a", "a ", "it's  'll x", "<|endoftext|> a", "a\tb", " x y", "x　y", "é a ́b", "1 2  33 a1b2", "don't !!  ??\n ! a", "ΣΑΣ Σ", "İstanbul İ", "Ab.\nCd,\nEf gh.\nIj", "x​y z\x1cw", "Ⅷ ² ½x", "日本 語"]


@pytest.mark.parametrize("name, mode", [("byte_bpe_50k.json", "attached"), ("word_bpe_49k.json", "words")])
def test_encoder_is_the_library(spark, name, mode):
    import public_tokenizers

    enc = encoding.CachedEncoder(public_tokenizers.path(name), mode, max_bytes=20_000)
    texts = ADVERSE + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    assert [t for t in texts if enc.encode(t).tolist() != enc.library.encode(t, add_special_tokens=False).ids] == []


def test_words():
    text = "The  cat\tTHE é É\nx" + " y" * 5
    h = words.word_hashes(text)
    w = re.findall(r"[^\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)}))
    assert len(h) == len(w) and len(set(h.tolist())) == len(set(w))
    assert {a for a, b in itertools.product(range(len(w)), repeat=2) if (w[a] == w[b]) != (h[a] == h[b])} == set()
    long = "ab " * 400_000 + "z" * 3_000_000 + " ab"
    h = words.word_hashes(long)
    assert len(h) == 400_002 and h[0] == h[-1] == h[399_999] and len(set(h.tolist())) == 2


def test_words_of_many_texts():
    rng = random.Random(1)
    texts = ["".join(rng.choices(["a", "B", "é", " ", "\n", "word", "\t"], k=rng.randrange(0, 60))) for _ in range(500)] + ["x " * 400_000, "", "last"]
    h, ends, counts = words.words_of_all(texts)
    one = [words.words_and_ends(t) for t in texts]
    assert counts.tolist() == [len(x) for x, _ in one] and np.array_equal(h, np.concatenate([x for x, _ in one])) and np.array_equal(ends, np.concatenate([y for _, y in one]))
    assert [len(x) for x in words.words_of_all([])] == [0, 0, 0]


def near_copies(rng, n_groups=12, hot=120):
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for g in range(n_groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 200))]
        for _ in range(hot if g == 0 else rng.randrange(1, 6)):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(copy) // 12)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    texts += [" ".join(passage + [rng.choice(vocabulary) for _ in range(rng.randrange(10, 90))]) for _ in range(150)]
    texts += ["a b", "a b", "a b c d e", "a b c d e f", "x"]
    rng.shuffle(texts)
    return texts


def brute_components(sets, percent):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(sets)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and both * 100 >= percent * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_find_every_link(spark, width):
    texts = near_copies(random.Random(width))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs, minhash.Params(words=width, long_list=20)).collect()}
    sets = []
    for t in texts:
        w = t.split()
        k = min(width, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)})
    want = brute_components(sets, 80)
    assert got == {i: (len(s), c, c == i) for i, (s, c) in enumerate(zip(sets, want, strict=True))}


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 60)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(400, 400), (7, 3)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long"), Scratch(spark)).collect()}
    root = {n: n for e in links for n in e}
    for _ in range(len(links)):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert {n: got.get(n, n) for n in root} == root


def test_prefix_filter_makes_no_rows_behind_the_prefixes(spark):
    """Texts that all hold one passage: a row for each value of a set would be several times the prefixes."""
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(60)]
    texts = [[*(f"w{rng.randrange(10**6)}" for _ in range(12)), *passage] for _ in range(120)]
    texts += [[*t[:-1], "end"] for t in texts[:10]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)] * 2, "doc_id long, text string")
    p = minhash.Params(words=2)
    sets = {i: minhash.shingle_set(" ".join(t), 2) for i, t in enumerate(texts)}
    nodes = spark.createDataFrame([(i, bytes(s.tobytes())) for i, s in sets.items()] * 2, "node long, whole binary")
    scratch = Scratch(spark)
    lists = minhash._prefix_lists(nodes, nodes.select("node").distinct(), scratch, p).collect()
    most = sum(len(s) * 20 // 100 + 1 for s in sets.values())
    assert sum(spark.read.parquet(f"{scratch.root}/{name}").count() for name in os.listdir(scratch.root)) == len(lists) <= most
    held = {}
    for r in lists:
        held.setdefault(r["value"], set()).add(r["node"])
    for a in range(len(texts)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                assert any({a, b} <= h for h in held.values())
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, p).collect()}
    assert got == dict(enumerate(brute_components(list(map(set, map(np.ndarray.tolist, sets.values()))), 80)))


def test_near_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 24))
    m = np.concatenate([base + rng.normal(size=base.shape) * s for s in (0, 0.05, 0.1, 0.14, 0.2, 0.3)]).astype(np.float32)
    label = rng.integers(0, 3, len(m))
    rows = [(int(i), [float(x) for x in v], int(c)) for i, (v, c) in enumerate(zip(m, label, strict=True))]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), embeddings.Params(tile=16)).collect()}
    u = m.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = (u @ u.T >= 0.98) & (label[:, None] == label[None, :]) & ~np.eye(len(u), dtype=bool)
    root = np.arange(len(u))
    for _ in range(len(u)):
        new = np.array([min(root[i], root[link[i]].min(initial=root[i])) for i in range(len(u))])
        if (new == root).all():
            break
        root = new
    assert link.any() and got == {i: (int(link[i].sum()), int(root[i])) for i in range(len(u))}


def test_top_k(spark):
    rng = np.random.default_rng(4)
    m = np.round(rng.normal(size=(300, 12)), 1).astype(np.float32)
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(m)]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), topk.Params(every=10, block=64, query_block=4)).collect())
    q = np.floor(m.astype(np.float64) * 256).astype(np.int64)
    want = []
    for i in range(0, 300, 10):
        best = sorted((-int(q[i] @ q[j]), j) for j in range(300) if j != i)[:5]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert got == sorted(want)


def test_the_cutoff_saves_work():
    """Near copies give a high cutoff: lists are read in part, and few entries are resolved; results are those of all scores."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(150, 32)) * rng.uniform(0.2, 3, 150)[:, None]
    v = np.floor(256 * np.repeat(centres, 20, 0) * rng.uniform(0.9, 1.1, 3000)[:, None])
    p = topk.Params()
    at = np.arange(0, 3000, 50)
    low = topk.cutoffs_in(v[at], v, at, p)
    lists = topk.Lists(np.arange(3000), v, p)
    whole = v[at] @ v.T
    for i, cols, score in lists.reaching(v[at], low):
        assert np.array_equal(np.sort(cols), np.flatnonzero(whole[i] >= low[i])) and np.array_equal(score, whole[i][cols]) and (cols != at[i]).sum() >= p.k
    assert lists.touched < 0.6 * 2 * p.slices * whole.size  # lists and what is resolved of them
    a = topk.Lists(np.arange(3000), v, p)
    list(a.reaching(v[at], np.full(len(at), -np.inf)))
    assert a.touched == 2 * p.slices * whole.size  # without a cutoff all is read, then resolved


def test_packing_beats_its_greedy_start():
    rng = random.Random(2)
    counts = Counter(rng.randrange(1, 101) for _ in range(3000))
    bins = packing.best_two_fit(counts, 100)
    used = Counter()
    for pieces, times in bins:
        assert sum(pieces) <= 100
        for n in pieces:
            used[n] += times
    assert used == counts
    least = -(-sum(n * c for n, c in counts.items()) // 100)
    assert least <= sum(t for _, t in bins) <= least * 1.01 + 1
    assert packing.tightest_pair([3, 4, 6], lambda n: 1, 10) == [6, 4] and packing.tightest_pair([5], lambda n: 1, 10) is None
    assert packing.best_two_fit({}, 10) == [] and packing.best_two_fit({10: 3}, 10) == [([10], 3)]


def test_crc_of_pieces():
    rng = random.Random(3)
    for _ in range(20):
        data = rng.randbytes(rng.randrange(0, 5000))
        cuts = sorted(rng.randrange(len(data) + 1) for _ in range(4))
        parts = [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True)]
        after = np.array([len(data) - b for b in [*cuts, len(data)]])
        shifted = token_store.shift_crc(np.array([zlib.crc32(p) for p in parts], np.uint32), after)
        assert int(np.bitwise_xor.reduce(shifted)) == zlib.crc32(data)


def test_chunks_survive_insertions():
    ids = np.random.default_rng(1).integers(0, 50_000, 40_000).astype(np.uint32)
    cuts = token_store.cut_points(ids)
    sizes = np.diff([0, *cuts])
    assert cuts[-1] == len(ids) and sizes.max() <= 4096 and sizes[:-1].min() >= 64
    chunks = lambda x: {x[a:b].tobytes() for a, b in zip([0, *token_store.cut_points(x)], token_store.cut_points(x), strict=False)}
    changed = np.insert(ids, 20_000, 7)
    assert len(chunks(ids) & chunks(changed)) >= len(cuts) - 4
    assert token_store.cut_points(np.zeros(0, np.uint32)) == [] and token_store.cut_points(ids[:10]) == [10]


def test_merkle():
    leaves = [bytes([i]) * 16 for i in range(5)]
    assert token_store.merkle_root(leaves) != token_store.merkle_root(leaves[::-1]) != token_store.merkle_root(leaves[:4])
    assert token_store.merkle_root(leaves[:1]) == leaves[0]


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.identify(docs).select("declared", "language", "accepted").collect()
    assert sum(r["declared"] == r["language"] and r["accepted"] for r in got) >= 0.97 * len(got)


def test_language_evidence_helps(spark):
    texts = ["the house and the garden are green", "das haus und der garten sind gruen", "la casa y el jardin son verdes"]
    rows = [(i, f"{texts[i % 3]} {i}", ["en", "de", "es"][i % 3], f"h{i % 3}") for i in range(60)] + [(100, "qq", None, "h1"), (101, "<html lang=\"es\"><p>qq</p>", None, None)]
    got = {r["doc_id"]: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).select("row.doc_id", "language", "declared").collect()}
    assert got[100]["language"] == "de" and got[101]["language"] == "es" and got[101]["declared"] == "es"


def test_declared_language_after_a_long_prologue(spark):
    long = "<!-- " + "licence " * 1000 + "-->\n"
    rows = [(long + '<!DOCTYPE html><HTML class="x" lang="DE-at">', "en"), ('<html lang="fil">', "en"), ("<html lang=gsw>", None), ('<html lang="english">', "fr"), ("<html>" + long, "pt-BR"), (None, "sv"), (long, None)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    got = [r["d"] for r in docs.select(language.declared_language(docs["text"], docs["lang"]).alias("d")).collect()]
    assert got == ["de", "fil", "gsw", "fr", "pt", "sv", ""]


def test_every_declared_language_is_a_candidate(spark):
    codes = [a + b for a in "abcdefghijklmno" for b in "abcdefghijklmno"]
    words = {c: " ".join(random.Random(c).choices("bcdfghjklmnpqrstvwxz", k=400)).replace(" ", "") for c in codes}
    rows = [(i, words[c][:400 if c != "hh" else 200], c, "s") for i, c in enumerate(codes)] + [(1000, words["hh"][:200], None, "s"), (1001, words["aa"], None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["language"] for r in language.identify(docs).select("row.doc_id", "language").collect()}
    assert len(codes) == 225 and got == {i: c for i, c in enumerate(codes)} | {1000: "hh", 1001: "aa"}


def test_language_against_a_plain_version(spark):
    """Posteriors of every document, from counts in dictionaries."""
    rng = random.Random(8)
    kinds = {"aa": "the house and the garden are green", "bb": "das haus und der garten sind gruen", "cc": "la casa y el jardin son verdes"}
    rows = []
    for i in range(90):
        code = rng.choice(list(kinds))
        words = kinds[code].split()
        text = " ".join(rng.choices(words, k=rng.randrange(1, 8))) + rng.choice(["", " https://x.example.de/a", " http://y.org"])
        rows.append((i, text if i % 30 else "12 34", rng.choice([code, code, rng.choice(list(kinds)), None]), rng.choice(["h1", "h2", None])))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    p = language.Params()
    got = {r["doc_id"]: r for r in language.identify(docs, params=p).select("row.doc_id", "language", "posterior", "accepted").collect()}
    langs = sorted({r[2] for r in rows if r[2]})
    tables = {c: sum((language.trigram_counts(r[1]) for r in rows if r[2] == c), np.zeros(language.BUCKETS)) + 0.5 for c in langs}
    text = {i: [float(language.trigram_counts(t) @ np.log(tables[c] / tables[c].sum())) for c in langs] for i, t, _, _ in rows if any(map(str.isalpha, t))}
    guess = {i: int(np.argmax(s)) for i, s in text.items()}
    suffix = {i: (re.search(r"https?://[\w.-]*\.(\w+)", t) or [None, ""])[1] for i, t, _, _ in rows}
    host, said = {r[0]: r[3] or "" for r in rows}, {r[0]: r[2] or "" for r in rows}
    count = lambda keep, g: sum(guess[i] == g and keep(i) for i in guess)
    for i in guess:
        z = []
        total = sum(count(lambda j: True, g) + 1 for g in range(3))
        for g in range(3):
            top = (count(lambda j: True, g) + 1) / total
            same = lambda j, i=i: suffix[j] == suffix[i]
            prior = (count(same, g) + p.smoothing * top) / (sum(count(same, x) for x in range(3)) + p.smoothing)
            here = lambda j, i=i: suffix[j] == suffix[i] and host[j] == host[i]
            z.append(p.text_weight * text[i][g] + math.log((count(here, g) + p.smoothing * prior) / (sum(count(here, x) for x in range(3)) + p.smoothing)))
            if said[i]:
                z[-1] += math.log((count(lambda j, i=i: said[j] == said[i], g) + 0.5) / (count(lambda j: said[j] != "", g) + 0.5 * len(langs)))
        best = int(np.argmax(z))
        assert got[i]["language"] == langs[best] and math.isclose(got[i]["posterior"], 1 / sum(math.exp(x - z[best]) for x in z), rel_tol=1e-9)
    assert all(got[r[0]]["language"] is None for r in rows if r[0] not in guess)


def test_language_against_labels_that_are_no_evidence(spark):
    """Texts whose declaration is hidden from the operator are named as they would have declared."""
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text", "source", F.col("lang").alias("truth"), F.when(F.crc32(F.col("doc_id").cast("string")) % 4 != 0, F.col("lang")).alias("lang"))
    got = [r for r in language.identify(docs).select("row.truth", "declared", "language").collect() if not r["declared"] and r["language"]]
    assert len(got) > 100 and sum(r["truth"] == r["language"] for r in got) >= 0.95 * len(got)


def test_em_finds_generated_labels():
    """Votes drawn from known labellers: the posteriors follow the hidden classes, and beat the first guess."""
    rng = np.random.default_rng(6)
    truth = rng.random(20_000) < 0.7
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65])
    speaks = np.array([0.9, 0.8, 0.9, 0.7, 0.9, 0.8, 0.9])
    said = np.where(rng.random((len(truth), 7)) < right, truth[:, None], ~truth[:, None]).astype(int)
    votes = np.where(rng.random(said.shape) < speaks, said, quality.NONE)
    codes = votes @ 3 ** np.arange(7)
    q = quality.posterior_by_code(Counter(codes.tolist()), 100)[codes]
    best = sum(((np.log(right / (1 - right)) * np.where(votes == quality.NONE, 0, 2 * votes - 1)).sum(1) + math.log(0.7 / 0.3) > 0) == truth)
    assert ((q >= 0.5) == truth).sum() >= 0.995 * best and abs(q.mean() - 0.7) < 0.02


def test_scorer_learns_a_linear_rule():
    rng = np.random.default_rng(7)
    rule = rng.normal(size=50)
    idx = [rng.choice(50, 8, replace=False) for _ in range(600)]
    val = [rng.random(8) for _ in idx]
    z = np.array([rule[i] @ v for i, v in zip(idx, val, strict=True)])
    target = 1 / (1 + np.exp(-8 * z))
    w = quality.train(idx[:400], val[:400], target[:400], quality.Params())
    found = np.array([w[i] @ v + w[-1] for i, v in zip(idx[400:], val[400:], strict=True)])
    assert ((found > 0) == (z[400:] > 0)).mean() > 0.9


def test_the_labelled_sample_is_bounded_and_fixed(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    twice = docs.unionByName(docs)
    p = quality.Params(sample_docs=50, rounds=3)
    one, two = quality.fit(twice.repartition(3), params=p), quality.fit(twice.coalesce(1), params=p)
    assert np.array_equal(one, two)


def test_quality_accuracy(spark):
    sf = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").selectExpr("doc_id", "quality AS truth")
    got = quality.scored(docs, quality.fit(docs)).select("row.doc_id", "accepted").join(labels, "doc_id").collect()
    right = defaultdict(list)
    for r in got:
        right[r["truth"]].append(r["accepted"] == bool(r["truth"]))
    assert np.mean(right[1]) >= 0.97 and np.mean(right[0]) >= 0.9


def test_raking_meets_the_margins():
    rng = random.Random(1)
    cells = [((s, la, t), float(rng.randrange(1, 1000))) for s in "abc" for la in "xy" for t in "pq"]
    p = mixing.Params(targets={"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "language": {"x": 0.4, "y": 0.6}, "topic": {"p": 0.9, "q": 0.1}})
    w = np.array(mixing.rake(cells, p)) * np.array([n for _, n in cells])
    w /= w.sum()
    for axis, margin in enumerate(mixing.MARGINS):
        for value, share in p.targets[margin].items():
            assert abs(sum(x for x, (c, _) in zip(w, cells, strict=True) if c[axis] == value) - share) < 1e-6


def test_raking_beyond_the_driver(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    near = {tuple(r[m] for m in mixing.MARGINS): r["probability"] for r in mixing.probabilities(docs).collect()}
    far = {tuple(r[m] for m in mixing.MARGINS): r["probability"] for r in mixing.probabilities(docs, params=mixing.Params(max_driver_cells=1, rounds=12)).collect()}
    assert near.keys() == far.keys() and max(abs(near[k] - far[k]) for k in near) < 1e-3


def test_drawn_documents_meet_the_targets(spark):
    """Expected margins are the targets exactly, those of the draw nearly; a named topic column is used; repeats share a draw."""
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 60)), rng.choice("ab"), rng.choice("xxxy"), rng.choice("pq"), f"r{i}") for i in range(6000)]
    rows += rows[:50]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, subject string, row string")
    p = mixing.Params(targets={"source": {"a": 0.7, "b": 0.3}, "language": {"x": 0.5, "y": 0.5}, "topic": {"p": 0.6, "q": 0.4}})
    got = mixing.drawn(docs, params=p, topic="subject").select("row.doc_id", *mixing.MARGINS, "tokens", "probability", "kept").collect()
    assert len(got) == len(rows) and max(r["probability"] for r in got) == 1.0
    for margin in mixing.MARGINS:
        for value, share in p.targets[margin].items():
            for weight, near in ((lambda r: r["probability"], 1e-6), (lambda r: float(r["kept"]), 0.04)):
                part, whole = (sum(r["tokens"] * weight(r) for r in got if keep(r)) for keep in (lambda r: r[margin] == value, lambda r: True))  # noqa: B023
                assert abs(part / whole - share) < near
    draws = defaultdict(set)
    for r in got:
        draws[r["doc_id"]].add(r["kept"])
    assert all(len(d) == 1 for d in draws.values())


def test_lm_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in lm.score_documents(docs, lm.Params(head=100)).collect()}
    tokens = {r["doc_id"]: re.findall(r"[^\x20\x09-\x0D]+", r["text"].translate({c: c + 32 for c in range(65, 91)})) + [None] for r in docs.select("doc_id", "text").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    counts = Counter(t for i, ts in tokens.items() if not held[i] for t in ts)
    n, v = sum(counts.values()), len(counts)
    for i, ts in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ts), sum(counts[t] > 0 for t in ts), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ts), rel_tol=1e-9)


def tokens(text):
    t = lm.tokens_of([text])
    return t.h, t.ends


def fitted(docs, p):
    train = lm._split(docs, p, "doc_id", "text").where(~F.col("held_out"))
    counts = lm._read(train, p).groupBy("h").agg(F.min("class").alias("class"), F.sum("c").alias("c")).cache()
    return lm.fit(train, counts, p)


def plain_log10(m, total, words, i, word):
    """log10 P of the word at place i after words[:i], term by term."""
    p = m.params
    back = [int(tokens(w)[0][0]) for w in words[:i][::-1][:3]]
    one, two, three = (back + [int(lm.START)] * 3)[:3]
    keys = lm.mix64(np.array([x % 2**64 for x in (one + 1, two + 2, three + 3, one * 31 + two)], np.uint64))
    h, ends = tokens(word) if word is not None else ([int(lm.END)] * 2, [0, 0])
    at = [k for k, x in enumerate(m.head.tolist()) if x == int(h[0])]
    cls, slot = (int(m.own_class[at[0]]), int(m.own_slot[at[0]])) if at and m.own_slot[at[0]] >= 0 else (int(lm.surface_class(np.array([ends[0]]), p)[0]), p.slots - 1)
    out = 0.0
    for w, rows, target in ((m.class_weights, lm.class_rows(keys[None], p), cls), (m.slot_weights, lm.slot_rows(keys[None], np.array([cls]), p), slot)):
        z = [float(w[-1][j]) + sum(float(w[r][j]) for r in rows[0]) for j in range(w.shape[1])]
        out += z[target] - math.log(sum(map(math.exp, z)))
    inside = math.log10((total[word] + 1) / m.class_total[cls]) if slot == p.slots - 1 else 0.0
    return out / math.log(10) + inside


def test_lm_scores_term_by_term(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(40)], weights=range(1, 41), k=rng.randrange(0, 30))) for _ in range(120)] + ["Unseen words HERE", "", "w1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    p = lm.Params(classes=4, slots=5, buckets=64, slot_buckets=64, batch=32, head=20)
    m = fitted(docs, p)
    assert (m.own_slot >= 0).sum() == 16 and np.abs(m.class_weights).max() > 0.05 and np.abs(m.slot_weights).max() > 0.05
    words = {i: t.lower().split() for i, t in enumerate(texts)}
    counts = Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in [*ws, None])
    got = {r["doc_id"]: r["score"] for r in lm.score_documents(docs, p).collect()}
    for i, ws in words.items():
        want = sum(plain_log10(m, counts, ws, k, w) for k, w in enumerate([*ws, None]))
        assert math.isclose(got[i], want, rel_tol=1e-4, abs_tol=1e-4)
    # over all words, and one unknown word in each class, the model's probabilities sum to one
    one_unknown = sum(10 ** (plain_log10(m, Counter(), ["w3", "w9"], 2, w)) for w in class_members(p))
    assert math.isclose(sum(10 ** plain_log10(m, counts, ["w3", "w9"], 2, w) for w in counts) + one_unknown, 1, rel_tol=1e-4)


def class_members(p):
    """A word that never occurs for each class of words without a slot."""
    found = {}
    for i in range(10_000):
        w = f"never{i}"
        found.setdefault(int(lm.surface_class(tokens(w)[1][:1], p)[0]), w)
    return found.values()


def test_lm_learns(spark):
    """Held-out texts get more than from the unigram base."""
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    rows = [r for r in lm.score_documents(docs).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > 0.995 * sum(r["base_score"] for r in rows)


def test_lm_steps_over_every_position(spark):
    """Every training position is stepped over once in all rounds together, however the texts are cut into pieces."""
    texts = ["a b c", "", "x", None, " ".join(f"w{i % 700}" for i in range(150_000))] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    p, seen = lm.Params(), []
    model = fitted(docs, p)
    split = lm._split(docs, p, "doc_id", "text").where(~F.col("held_out"))
    for k in range(p.rounds):
        part = [r["text"] for r in split.where(F.pmod(F.xxhash64("text", "doc_id"), F.lit(p.rounds)) == k).collect()]
        w1, w2, n = lm.steps_through(model, part)
        assert n == sum(len(tokens(t)[0]) for t in part) and (n == 0 or not np.array_equal(w1, model.class_weights))
        seen.append(n)
    assert sum(seen) == model.n_tokens


def test_lm_trains_on_short_texts(spark):
    docs = spark.createDataFrame([(i, "alpha beta") for i in range(2100)], "doc_id long, text string")
    rows = lm.score_documents(docs, lm.Params(batch=16)).collect()
    assert len(rows) == 2100 and min(r["score"] for r in rows) > 3 * math.log10(0.8)
