"""Encoding against the library, and the rows of the packing and token-store queries against a plain version."""

import itertools
import random
import struct
import zlib

import pytest

from keyspan.llm import encoding, packing, token_store
from tests.conftest import SF

FILES = [("byte_bpe_50k.json", "attached"), ("word_bpe_49k.json", "words")]
ODD = [*"aAbIİıſßẞéÉΣςσАяЉ日語한ᄀ가नि", "́", "̇", "̈", " ", "　", "​", "‍", *"ﬁǅʰªº²½µⅧ😀\U0001d400", " ", "  ", "\n", "\t", *".,!?;:*#%&$|'’-_<>0139", "'s", "n't", " the ", "<|endoftext|>"]


@pytest.mark.parametrize("name, mode", FILES)
@pytest.mark.parametrize("max_bytes", [20_000, 1 << 26])
def test_fuzzed_texts(name, mode, max_bytes):
    import public_tokenizers

    rng = random.Random(max_bytes)
    texts = ["".join(rng.choices(ODD, k=rng.randrange(1, 40))) for _ in range(4000)]
    enc = encoding.CachedEncoder(public_tokenizers.path(name), mode, max_bytes)
    for _ in range(2):
        got = [ids.tolist() for ids in enc.encode_all(texts)]
        assert got == [e.ids for e in enc.library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name, mode", FILES)
def test_capital_before_a_mark(name, mode):
    """Folded letters times marks: a dotted capital leaves a dot that goes with the mark after it."""
    import public_tokenizers

    enc = encoding.CachedEncoder(public_tokenizers.path(name), mode)
    texts = [f"x {a}{b}{mark} y" for a, b, mark in itertools.product("aİIıſßẞΣςéÅﬁǅ", ["", "n", "̇", "İ"], ".,!?;:*#%&$|-'")] + ["EDİLDİ, sonra"]
    assert [ids.tolist() for ids in enc.encode_all(texts)] == [e.ids for e in enc.library.encode_batch(texts, add_special_tokens=False)]


def test_what_is_known_is_bounded():
    import public_tokenizers

    enc = encoding.CachedEncoder(public_tokenizers.path("word_bpe_49k.json"), "words", 1 << 20)
    often = "the and of"
    for k in range(40):
        list(enc.encode_all([f"w{k}x{i} {often}" for i in range(2000)]))
        assert enc.bytes <= 2 << 20
    assert set(often.split()) <= set(enc.known[0])
    enc.keep(4000)
    assert enc.bytes <= 4000 and enc.encode("the").tolist() == enc.library.encode("the", add_special_tokens=False).ids


def test_what_is_known_is_small():
    """A unit takes its letters, its ids and 40 bytes; the arrays have room to grow, no more."""
    import public_tokenizers

    enc = encoding.CachedEncoder(public_tokenizers.path("word_bpe_49k.json"), "words", 1 << 20)
    words = ["".join(x) for x in itertools.product("bcdfg", "aeiou", "klmnp", "aeiou", "rstvz", "aou")]
    list(enc.encode_all([" ".join(words)]))
    assert set(enc.known[0]) == set(words)
    held = [enc.start, enc.at, enc.length, enc.size, enc.uses, enc.flat, enc.letters, *enc.index[0], *enc.index[1]]
    assert sum(a.nbytes for a in held) <= 2 * enc.bytes


@pytest.mark.parametrize("name, mode", FILES)
def test_units_of_one_hash(name, mode, monkeypatch):
    """Units are told apart by their letters, not by their hash."""
    import numpy as np
    import public_tokenizers

    monkeypatch.setattr(encoding, "_hashes", lambda raw, offsets: np.diff(offsets).astype(np.uint64) // np.uint64(4))
    enc = encoding.CachedEncoder(public_tokenizers.path(name), mode, 20_000)
    texts = ["cat dog, cat. dog owl", "", "owl cat! doggy catty", "dog owl cat", *(f"w{i} {i}x, dog" for i in range(500))]
    for _ in range(2):
        assert [ids.tolist() for ids in enc.encode_all(texts)] == [e.ids for e in enc.library.encode_batch(texts, add_special_tokens=False)]


def whole_ids(docs, name, end):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(name))
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect())
    return {i: [*library.encode(t, add_special_tokens=False).ids, end] for i, t in rows}


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_rows_of_the_packing_query(spark):
    ids = whole_ids(spark.read.parquet(f"{SF}/documents.parquet"), "word_bpe_49k.json", 0)
    rows = packing.op4_best_fit_packing(spark, SF).collect()
    want = {(i, p, p * 2048, len(x[p * 2048 : p * 2048 + 2048]), crc(x[p * 2048 : p * 2048 + 2048])) for i, x in ids.items() for p in range(-(-len(x) // 2048))}
    assert len(rows) == len(want) and {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 2048
    assert len(bins) <= -(-sum(map(len, ids.values())) // 2048) + 1


def test_rows_of_the_store_query(spark):
    ids = whole_ids(spark.read.parquet(f"{SF}/documents.parquet"), "byte_bpe_50k.json", 2)
    want, at = set(), 0
    for i in sorted(ids):
        want.add((i, at, len(ids[i]), crc(ids[i]), True))
        at += len(ids[i])
    rows = token_store.op8_token_store(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32", "intact").collect()
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want


def test_cuts_of_a_batch_are_those_of_its_documents():
    import numpy as np

    rng = np.random.default_rng(5)
    documents = [rng.integers(0, 50_000, n).astype(np.uint32) for n in (1, 10, 64, 65, 3000, 20_000, 7)]
    ends = np.cumsum([len(d) for d in documents])
    assert token_store.cut_all(np.concatenate(documents), ends) == [token_store.cut_points(d) for d in documents]
