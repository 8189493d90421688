"""The pipeline stage by stage, each against a plain version of what it promises."""

import re
from collections import defaultdict

import pytest

from keyspan.llm.common import Scratch
from tests.conftest import SF

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def shingles(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)}))
    k = min(width, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scratch, seen = Scratch(spark), {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.table(stage(spark, docs, SF), name)
        seen[name] = docs
    columns = seen["documents"].columns
    ids = {n: [r["doc_id"] for r in d.select("doc_id").collect()] for n, d in seen.items()}
    order = ["documents", *[n for n, _ in corpus_pipeline.STAGES]]
    for before, after in zip(order, order[1:-1], strict=False):
        assert seen[after].columns == columns and set(ids[after]) <= set(ids[before]) and len(set(ids[after])) == len(ids[after])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [i for i in ids["language_id"] if labels.get(i) == 1]
    assert len(set(clean) & set(ids["quality_filter"])) >= 0.95 * len(clean)

    texts = {r["doc_id"]: shingles(r["text"]) for r in seen["quality_filter"].select("doc_id", "text").collect()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = defaultdict(list)
    for i in sorted(texts):
        counts = defaultdict(int)
        for s in texts[i]:
            for j in where[s]:
                counts[j] += 1
            where[s].append(i)
        for j, both in counts.items():
            if 100 * both >= 80 * (len(texts[i]) + len(texts[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert sorted(ids["near_dedup"]) == sorted({find(i) for i in texts})

    bins, pieces = defaultdict(list), defaultdict(list)
    for r in seen["pack_sequences"].collect():
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
    assert set(pieces) == set(ids["mix_sources"])
    for b in bins.values():
        assert sum(n for _, n in b) <= 2048 and [o for o, _ in sorted(b)] == [sum(n for _, n in sorted(b)[:k]) for k in range(len(b))]
    for p in pieces.values():
        assert [x[0] for x in sorted(p)] == list(range(len(p))) and all(n == 2048 for _, _, n in sorted(p)[:-1])


def test_without_documents(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_defined_cases(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and clashing columns through all stages."""
    rng = __import__("random").Random(5)
    words = "the house and garden of old town was green with many trees that people from near and far came to see every year in spring".split()
    prose = lambda n: ". ".join(" ".join(rng.choices(words, k=12)).capitalize() for _ in range(n)) + "."
    texts = [None, "", " \n", "12 34 !!", prose(20_000), *[prose(rng.randrange(4, 40)) for _ in range(60)]]
    rows = [(i, t, "en" if i % 5 else None, "web" if i % 7 else None, len(t or ""), "r", 0.5, 3, "c") for i, t in enumerate(texts)]
    rows += [rows[10], (999, rows[10][1], *rows[10][2:]), (None, prose(9), *rows[11][2:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, quality double, piece int, cell string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    scratch, seen = Scratch(spark), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = seen[name] = scratch.table(stage(spark, docs, str(tmp_path)), name)
    ids = {name: [r["doc_id"] for r in d.select("doc_id").collect()] for name, d in seen.items()}
    assert all(d.columns == seen["language_id"].columns for name, d in seen.items() if name != "pack_sequences")
    assert set(ids["language_id"]) == {r[0] for r in rows} - {0, 1, 2, 3} and len(ids["language_id"]) == len(rows) - 4
    assert {4, 999, None} <= set(ids["quality_filter"]) <= set(ids["language_id"])
    assert 999 not in ids["near_dedup"] and ids["near_dedup"].count(10) == 2 and None in ids["near_dedup"]
    assert {r["lang"] for r in seen["language_id"].collect()} == {"en"}
    pieces = [r["piece"] for r in seen["pack_sequences"].where("doc_id = 4").collect()]
    assert 4 not in ids["mix_sources"] or sorted(pieces) == list(range(len(pieces))) and len(pieces) > 100
