"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from keyspan.llm import embeddings, html, language, lm, minhash, mixing, packing, quality, token_store, topk
from keyspan.llm.common import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, cell string, mark string, sequence_id long, language string, quality double"


@pytest.fixture(scope="module")
def docs(spark):
    words = " ".join(f"wort{i % 97} und haus{i % 89}" for i in range(30_000))
    texts = [None, "", " \n\t ", "a", "The cat sat on the mat and it was good.", "The cat sat on the mat and it was good.", "naïve café — <b>x</b> <|endoftext|>  　z", words, "Der Hund und die Katze sind im Haus, das ist gut."]
    rows = [(i, t, None if i % 4 == 0 else "en" if i < 7 else "de", None if i == 3 else f"s{i % 2}", None, "r", "c", "m", 5, "xx", 0.5) for i, t in enumerate(texts)]
    rows += [rows[4], (None, "null id text here with words", "en", "s0", None, "r", "c", "m", 5, "xx", 0.5)]
    return spark.createDataFrame(rows, DOCS)


def test_language(spark, docs):
    got = language.identify(docs).select(F.col("row.doc_id").alias("doc_id"), "language", "posterior", "accepted").collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["language"] for i in range(3)] == [None] * 3 and not any(by[i]["accepted"] for i in range(3))
    assert by[4]["language"] == by[5]["language"] == "en" and by[7]["language"] == "de"
    assert language.accept(docs).columns == docs.columns
    assert language.accept(docs.limit(0)).count() == language.identify(docs.limit(0)).count() == 0


def test_quality(spark, docs):
    weights = quality.fit(docs)
    got = quality.scored(docs, weights).select("row.doc_id", "quality", "accepted").collect()
    assert len(got) == docs.count()
    assert all(r["quality"] == 0 and not r["accepted"] for r in got if r["doc_id"] in (0, 1, 2))
    assert quality.accept(docs).columns == docs.columns
    assert quality.fit(docs.limit(0)) is None and quality.accept(docs.limit(0)).count() == 0


def test_minhash(spark, docs):
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["n_shingles"] == 0 and by[i]["component_id"] == i and by[i]["kept"] for i in range(3))
    assert by[5]["component_id"] == 4 and not by[5]["kept"] and by[4]["kept"] and by[3]["n_shingles"] == 1
    assert by[None]["component_id"] is None and by[None]["kept"]
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 1
    assert minhash.keep_one(docs.limit(0)).count() == 0


def test_mixing(spark, docs):
    got = mixing.drawn(docs).select("row.doc_id", "source", "language", "topic", "tokens", "probability", "kept").collect()
    assert len(got) == docs.count()
    assert all(r["tokens"] == 0 for r in got if r["doc_id"] in (0, 1, 2))
    assert max(r["probability"] for r in got) == 1.0
    assert mixing.mix(docs).columns == docs.columns and mixing.mix(docs.limit(0)).count() == 0


def test_packing(spark, docs):
    import public_tokenizers

    got = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 0, 128).collect()
    assert {r["doc_id"] for r in got} == {r["doc_id"] for r in docs.collect()}
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 128
    assert packing.pack(docs.limit(0), public_tokenizers.path("word_bpe_49k.json"), 0, 128).count() == 0


def test_token_store(spark, docs):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, where = Tokenizer.from_file(path), Scratch(spark).path("store")
    token_store.write_store(docs, where, path, 2)
    rebuilt = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, list(r["ids"])) for r in token_store.read_documents(spark, where).collect()))
    assert rebuilt == sorted((r["doc_id"] is not None, r["doc_id"] or 0, library.encode(r["text"] or "", add_special_tokens=False).ids + [2]) for r in docs.collect())
    digests = token_store.read_digests(spark, where).collect()
    assert all(r["intact"] for r in digests) and sum(r["n_tokens"] for r in digests) == sum(len(x[2]) for x in rebuilt)
    starts = sorted((r["start"], r["n_tokens"]) for r in digests)
    assert starts == [(int(a), n) for a, (_, n) in zip(np.cumsum([0] + [n for _, n in starts]), starts)]
    empty = Scratch(spark).path("store")
    token_store.write_store(docs.limit(0), empty, path, 2)
    assert token_store.read_digests(spark, empty).count() == 0


def test_damage_is_seen(spark, docs, tmp_path):
    import public_tokenizers

    where = str(tmp_path / "store")
    token_store.write_store(docs.where("doc_id IN (4, 8)"), where, public_tokenizers.path("byte_bpe_50k.json"), 2)
    chunks = spark.read.parquet(f"{where}/chunks").toPandas()
    first = chunks["payload"].iloc[0]
    chunks["payload"] = [chunks["payload"].iloc[-1]] + list(chunks["payload"].iloc[1:]) if len(chunks) > 1 else [first]
    spark.createDataFrame(chunks, "digest binary, width int, payload binary").write.mode("overwrite").parquet(f"{where}/chunks")
    assert {r["intact"] for r in token_store.read_digests(spark, where).collect()} == {False, True}


def test_lm(spark, docs):
    got = lm.score_documents(docs, lm.Params(rounds=1)).collect()
    assert len(got) == docs.count()
    assert all(r["n_tokens"] == 1 for r in got if r["doc_id"] in (0, 1, 2))
    assert lm.score_documents(docs.limit(0)).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, v string, mark string"


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(50, [1.0, 2.0, 3.0], 1), (1, [1.0, 2.0, 3.0], 1), (2, [1.0, 2.0, 3.0], 2), (3, None, 1), (4, [0.0, 0.0, 0.0], 1), (5, [1.0, None, 3.0], 1), (6, [float("nan"), 1.0, 1.0], 1), (7, [float("inf"), 1.0, 1.0], 1), (8, [], 1), (9, [2.0, 4.0, 6.1], 1), (10, [1.0, 2.0], 1), (11, [-1.0, -2.0, -3.0], None), (0, [3.0, 2.0, 1.0], 1), (1, [1.0, 2.0, 3.0], 1)]
    return spark.createDataFrame([(*r, "v", "m") for r in rows], VECTORS)


def test_near_vectors(spark, vectors):
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_vectors(vectors).collect())
    linked = {1: (3, 1, True), 50: (3, 1, False), 9: (3, 1, False)}
    assert got == sorted((i, *linked.get(i, (0, i, True))) for i in [50, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 0, 1])
    assert embeddings.near_vectors(vectors.limit(0)).count() == 0


def test_top_k(spark, vectors):
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(vectors).collect())
    f = lambda a, b: sum(int(256 * x // 1) * int(256 * y // 1) for x, y in zip(a, b))
    kept = {50: [1, 2, 3], 1: [1, 2, 3], 2: [1, 2, 3], 4: [0, 0, 0], 9: [2, 4, 6.099999904632568], 11: [-1, -2, -3], 0: [3, 2, 1]}
    want = []
    for q in (0, 50):
        best = sorted(((-f(kept[q], v), i) for i, v in kept.items() if i != q))[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert topk.top_k(vectors.limit(0)).count() == 0


def test_huge_components(spark):
    rows = [(0, [1e30, 1.0], 1, "", ""), (1, [1e30, 1.0], 1, "", ""), (2, [-1e30, 1.0], 1, "", "")]
    got = [(r["vec_id"], r["score"]) for r in topk.top_k(spark.createDataFrame(rows, VECTORS)).orderBy("rank").collect()]
    assert got == [(1, 2**63 - 1), (2, -(2**63))]


def test_pages(spark):
    rows = [(0, "http://a/x", None), (1, None, ""), (2, "http://a/y", "<article><p>one<p>two &amp; three</article>"), (3, "http://a/y", "plain"), (2, "http://a/y", "<article><p>one<p>two &amp; three</article>"), (4, "bad url", "<p>x" + " word" * 200_000)]
    pages = spark.createDataFrame([(*r, "t", "p", "h") for r in rows], "page_id long, url string, html string, text string, path string, host string")
    got = sorted((r["page_id"], r["t"][:20]) for r in html.main_texts(pages).select("row.page_id", F.col("text").alias("t")).collect())
    assert got == [(0, ""), (1, ""), (2, "one\n\ntwo & three"), (2, "one\n\ntwo & three"), (3, "plain"), (4, "x word word word wor")]
    assert html.main_texts(pages.limit(0)).count() == 0
