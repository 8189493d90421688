"""Scoring texts with a hashed maximum-entropy language model.

Tokens are the words of the lower-cased whole text and one end. The softmax is factored by classes: P(token | context) =
P(class | context) * P(slot | class, context) * P(token | slot). The most frequent words are dealt to classes of like weight and
have a slot of their own there; all others share their class's last slot, their class going by their last two bytes. The first two
factors are maximum-entropy models over hashed features of the context: the word before, the word before that and the one
before that (skips), and the pair of words before; for the slot each is taken together with the class. The third factor is 1 for a
word with its own slot, else add-one counts over the slot's words with one place for unknown words, so that the whole is a
distribution. It doesn't see the context: beyond the most frequent words the model tells classes apart, not words.

Word counts cover all training documents. The two models are trained by gradient steps on every position of every training text:
a hash deals the texts to `rounds` rounds, in each of which every partition steps from the common weights through its texts of
that round, and the weighted mean of the partitions' changes, summed in a tree, updates them. Frequent words' counts (at most `head`
entries) go to the scorers; counts of all other words are joined in Spark.

Words are known by 64-bit hashes of their bytes. Defined cases: null or empty text is the end alone; a null id counts as a training
document; repeated rows are scored (and, if for training, counted and stepped through) each; words of equal count go by hash; very
long texts are taken whole, their positions in pieces of bounded size; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyspan.llm.common import Scratch, trimmed
from keyspan.llm.words import mix64, words_of_all

END = np.uint64(0x0E0D)
START = np.uint64(0x0B0E)
FEATURES = 4
PIECE = 1 << 16


@dataclass(frozen=True)
class Params:
    folds: int = 7
    held_out: int = 2
    classes: int = 16
    slots: int = 32
    buckets: int = 8192
    slot_buckets: int = 16384
    rounds: int = 3
    batch: int = 2048
    rate: float = 0.3
    head: int = 1 << 17
    fan_in: int = 32


@dataclass
class Tokens:
    """The tokens of several texts one after the other: hashes of the words and of the ends, the words' last bytes (0 for an end), and where each text begins."""

    h: np.ndarray
    ends: np.ndarray
    begins: np.ndarray

    def lengths(self) -> np.ndarray:
        return np.diff(self.begins, append=len(self.h))

    def per_text(self, x: np.ndarray) -> np.ndarray:
        """Sums over each text."""
        return np.add.reduceat(x, self.begins) if len(self.begins) else np.zeros(0)


def tokens_of(texts: list[str]) -> Tokens:
    words, last, counts = words_of_all(texts)
    begins = np.cumsum(counts + 1) - (counts + 1)
    h, ends = np.full(len(words) + len(texts), END), np.zeros(len(words) + len(texts), np.int64)
    at = np.arange(len(words)) + np.repeat(np.arange(len(texts)), counts)
    h[at], ends[at] = words, last
    return Tokens(h, ends, begins)


def groups(texts: Iterator[str], size: int = 1 << 18) -> Iterator[list[str]]:
    """Texts in groups of about so many characters, a longer text by itself."""
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t)
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def surface_class(ends: np.ndarray, p: Params) -> np.ndarray:
    """Class of a word without a slot of its own."""
    return (mix64(ends.astype(np.uint64)) % np.uint64(p.classes)).astype(np.int64)


def context_keys(t: Tokens) -> np.ndarray:
    """[token, feature]: 64-bit values of the features of what stands before each token in its text."""
    back, place = [t.h], np.arange(len(t.h)) - np.repeat(t.begins, t.lengths())
    for k in range(1, 4):
        before = np.concatenate([np.full(min(k, len(t.h)), START), t.h[:-k]])
        back.append(np.where(place >= k, before, START))
    _, one, two, three = back
    with np.errstate(over="ignore"):
        return mix64(np.stack([one + np.uint64(1), two + np.uint64(2), three + np.uint64(3), one * np.uint64(31) + two], 1))


def _narrow(n: int) -> type:
    """A type for numbers below n; short ones sort fast."""
    return np.uint16 if n <= 1 << 16 else np.uint32


def class_rows(keys: np.ndarray, p: Params) -> np.ndarray:
    """[token, feature]: rows of the class model's weights that are on."""
    return (keys & np.uint64(p.buckets - 1)).astype(_narrow(p.buckets))


def slot_rows(keys: np.ndarray, classes: np.ndarray, p: Params) -> np.ndarray:
    """[token, feature]: rows of the slot model's weights that are on."""
    with np.errstate(over="ignore"):
        mixed = ((keys >> np.uint64(13)) + classes.astype(np.uint64)[:, None] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(40) & np.uint64(p.slot_buckets - 1)).astype(_narrow(p.slot_buckets))


def log_softmax(weights: np.ndarray, rows: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural log-probability of each target given the rows that are on."""
    out = np.empty(len(targets))
    for a in range(0, len(targets), 2048):
        z = _logits(weights, rows[a : a + 2048])
        z -= z.max(1, keepdims=True)
        c = targets[a : a + 2048]
        out[a : a + 2048] = z[np.arange(len(c)), c] - np.log(np.exp(z).sum(1))
    return out


def _logits(weights: np.ndarray, features: np.ndarray) -> np.ndarray:
    z = weights[-1] + weights[features[:, 0]]
    for k in range(1, features.shape[1]):
        z += weights[features[:, k]]
    return z


def _sums(z: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the rows order[first[i]:first[i + 1]] of z; most of these groups are short, for which reduceat is slow."""
    n = np.diff(first, append=len(order))
    d = z.take(order[first], 0)
    short = np.flatnonzero((n > 1) & (n <= 8))
    for k in range(1, 8):
        short = short[n[short] > k]
        d[short] += z.take(order[first[short] + k], 0)
    for i in np.flatnonzero(n > 8):
        d[i] = z.take(order[first[i] : first[i] + n[i]], 0).sum(0)
    return d


def gradient_steps(w: np.ndarray, g: np.ndarray, rows: np.ndarray, targets: np.ndarray, p: Params) -> None:
    """One adaptive gradient step for each batch, on the weights w and their sums of squares g in place; the last row is the bias."""
    for a in range(0, len(targets), p.batch):
        f, c = rows[a : a + p.batch], targets[a : a + p.batch]
        z = _logits(w, f)
        z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(1, keepdims=True)
        z[np.arange(len(c)), c] -= 1
        on = f.ravel()
        order = np.argsort(on, kind="stable")
        on = on[order]
        first = np.flatnonzero(np.append(True, on[1:] != on[:-1]))
        d, at = _sums(z, order // f.shape[1], first), on[first]
        g[at] += np.einsum("ij,ij->i", d, d) / d.shape[1]
        d *= (p.rate / np.sqrt(g[at]))[:, None]
        w[at] -= d
        d = z.sum(0)
        g[-1] += (d * d).mean()
        w[-1] -= p.rate * d / np.sqrt(g[-1])


@dataclass
class Model:
    """What the scorers hold: bounded by Params whatever the corpus."""

    params: Params
    n_tokens: int
    n_words: int
    head: np.ndarray  # sorted hashes
    head_count: np.ndarray
    own_class: np.ndarray  # class and slot of a head word with a slot of its own, or -1
    own_slot: np.ndarray
    class_total: np.ndarray  # tokens, words and 1 of each class's shared slot
    class_weights: np.ndarray
    slot_weights: np.ndarray

    def __post_init__(self) -> None:
        """A direct-mapped table of the head; words whose slot is taken go to a sorted rest."""
        self.slots = 1 << max(10, (8 * len(self.head)).bit_length())
        self.key, self.where = np.zeros(self.slots, np.uint64), np.full(self.slots, -1, np.int32)
        slot = self._slot(self.head)
        self.key[slot], self.where[slot] = self.head, np.arange(len(self.head))
        self.rest = np.flatnonzero(self.where[slot] != np.arange(len(self.head)))

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(24)).astype(np.int64) & (self.slots - 1)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place in the head of each token, or -1."""
        slot = self._slot(h)
        at = np.where(self.key[slot] == h, self.where[slot], -1)
        if len(self.rest):
            lost = np.flatnonzero(at < 0)
            keys = self.head[self.rest]
            near = np.minimum(np.searchsorted(keys, h[lost]), len(keys) - 1)
            at[lost] = np.where(keys[near] == h[lost], self.rest[near], -1)
        return at

    def targets(self, h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Class, slot, count (0 outside the head) and whether in the head, of each token."""
        p, at = self.params, self.find(h)
        known = at >= 0
        if not len(self.head):
            return surface_class(ends, p), np.full(len(h), p.slots - 1), np.zeros(len(h), np.int64), known
        slot = np.where(known, self.own_slot[at], -1)
        return np.where(slot >= 0, self.own_class[at], surface_class(ends, p)), np.where(slot >= 0, slot, p.slots - 1), np.where(known, self.head_count[at], 0), known


def _split(docs: DataFrame, p: Params, id_col: str, text_col: str) -> DataFrame:
    fold = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % p.folds
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), (fold == p.held_out).alias("held_out"))


def _read(train: DataFrame, p: Params) -> DataFrame:
    """Rows (h, class, c) of word counts of the training documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def merged(parts):
            h, e, c = (np.concatenate(x) for x in zip(*parts, strict=True))
            u, first, back = np.unique(h, return_index=True, return_inverse=True)
            return u, e[first], np.bincount(back, c, len(u)).astype(np.int64)

        held, size = [], 0
        for batch in batches:
            for part in groups(batch["text"]):
                t = tokens_of(part)
                held.append((t.h, t.ends, np.ones(len(t.h), np.int64)))
                size += len(t.h)
                if size > 3_000_000:
                    held = [merged(held)]
                    if len(held[0][0]) > 2_000_000:
                        yield _frame(*held.pop(), p)
                    size = sum(len(x[0]) for x in held)
        if held:
            yield _frame(*merged(held), p)

    return train.select("text").mapInPandas(trimmed(run), "h long, class int, c long")


def _frame(h: np.ndarray, ends: np.ndarray, c: np.ndarray, p: Params) -> pd.DataFrame:
    return pd.DataFrame({"h": h.view(np.int64), "class": surface_class(ends, p).astype(np.int32), "c": c})


def _head(counts: DataFrame, p: Params) -> pd.DataFrame:
    """Words of at least the count that at most `head` words reach."""
    sizes = counts.groupBy(F.floor(F.log2("c") * 16).alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("least")).orderBy(F.desc("step")).collect()  # a row per sixteenth of a doubling
    least, total = None, 0
    for r in sizes:
        total += r["n"]
        if total > p.head:
            break
        least = r["least"]
    if least is None:
        return pd.DataFrame({"h": np.zeros(0, np.int64), "c": np.zeros(0, np.int64), "class": np.zeros(0, np.int32)})
    return counts.where(F.col("c") >= least).toArrow().to_pandas()


def dealt(counts: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Class and slot of the most frequent words, in falling order of count: there and back over the classes, so that these weigh alike."""
    rank = np.arange(min(len(counts), p.classes * (p.slots - 1)))
    row, at = rank // p.classes, rank % p.classes
    return np.where(row % 2 == 0, at, p.classes - 1 - at), row


def fit(train: DataFrame, counts: DataFrame, p: Params) -> Model:
    """The model from the training documents and their word counts."""
    spark = counts.sparkSession
    head = _head(counts, p).assign(u=lambda d: d["h"].to_numpy(np.int64).view(np.uint64)).sort_values("u").reset_index(drop=True)
    u, c = head["u"].to_numpy(np.uint64), head["c"].to_numpy(np.int64)
    order = np.lexsort((u, -c))[: p.classes * (p.slots - 1)]
    own_class, own_slot = np.full(len(u), -1), np.full(len(u), -1)
    own_class[order], own_slot[order] = dealt(c[order], p)
    own = spark.createDataFrame([(int(x),) for x in u[order].view(np.int64)], "h long")
    totals = np.zeros(p.classes)
    sums = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    for r in counts.join(F.broadcast(own), "h", "left_anti").groupBy("class").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():  # own: at most classes * slots rows
        totals[r["class"]] = r["n"] + r["v"]
    zeros = [np.zeros((n + 1, k), np.float32) for n, k in ((p.buckets, p.classes), (p.slot_buckets, p.slots))]
    model = Model(p, sums["n"] or 0, sums["v"], u, c, own_class, own_slot, totals + 1, *zeros)
    for round_ in range(p.rounds):
        turn = F.pmod(F.xxhash64("text", "doc_id"), F.lit(p.rounds)) == round_
        model.class_weights, model.slot_weights = _trained(train.where(turn), model)
    return model


def steps_through(model: Model, texts: Iterator[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Both models' weights after a step over every position of the texts, and the number of positions."""
    p, seen = model.params, 0
    w1, w2 = model.class_weights.copy(), model.slot_weights.copy()
    g1, g2 = np.ones(len(w1), np.float32), np.ones(len(w2), np.float32)
    for part in groups(texts):
        t = tokens_of(part)
        seen += len(t.h)
        cls, slot = model.targets(t.h, t.ends)[:2]
        keys = context_keys(t)
        for a in range(0, len(cls), PIECE):
            k, c, s = keys[a : a + PIECE], cls[a : a + PIECE], slot[a : a + PIECE]
            gradient_steps(w1, g1, class_rows(k, p), c, p)
            gradient_steps(w2, g2, slot_rows(k, c, p), s, p)
    return w1, w2, seen


def _trained(docs: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    p, held = model.params, docs.sparkSession.sparkContext.broadcast(model)

    def steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w1, w2, seen = steps_through(held.value, (t for batch in batches for t in batch["text"]))
        if seen:
            change = np.concatenate([(w1 - held.value.class_weights).ravel(), (w2 - held.value.slot_weights).ravel()]) * np.float32(seen)
            pid = TaskContext.get().partitionId()
            for k, part in enumerate(np.array_split(change, 16)):
                yield pd.DataFrame({"part": [k], "pid": [pid], "n": [seen], "change": [part.astype("<f4").tobytes()]})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, "<f4").astype(np.float64) for x in group["change"])
        return pd.DataFrame({"part": [group["part"].iloc[0]], "pid": [group["pid"].iloc[0] // p.fan_in], "n": [group["n"].sum()], "change": [total.astype("<f4").tobytes()]})

    schema = "part int, pid long, n long, change binary"
    sums = docs.select("text").mapInPandas(trimmed(steps), schema)
    left = docs.rdd.getNumPartitions()
    while True:
        sums = sums.groupBy("part", F.floor(F.col("pid") / p.fan_in)).applyInPandas(add, schema)
        left = -(-left // p.fan_in)
        if left <= 1:
            break
    found = sorted(sums.collect(), key=lambda r: r["part"])  # 16 rows of a sixteenth of the weights each
    held.destroy()
    if not found:
        return model.class_weights, model.slot_weights
    change = np.concatenate([np.frombuffer(r["change"], "<f4") for r in found]) / np.float32(found[0]["n"])
    n = model.class_weights.size
    return model.class_weights + change[:n].reshape(model.class_weights.shape), model.slot_weights + change[n:].reshape(model.slot_weights.shape)


def scored(docs: DataFrame, model: Model, counts: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of _split()."""
    p, held = model.params, docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, pid, row = held.value, TaskContext.get().partitionId(), 0
        for batch in batches:
            at = 0
            for part in groups(batch["text"]):
                t = tokens_of(part)
                cls, slot, c, known = m.targets(t.h, t.ends)
                model = np.empty(len(t.h))
                keys = context_keys(t)
                for a in range(0, len(model), PIECE):
                    k, x, y = keys[a : a + PIECE], cls[a : a + PIECE], slot[a : a + PIECE]
                    model[a : a + PIECE] = log_softmax(m.class_weights, class_rows(k, p), x) + log_softmax(m.slot_weights, slot_rows(k, x, p), y)
                log_c = np.where(known, np.log10(c + 1.0), 0.0)
                shared = slot == p.slots - 1
                inside = np.where(shared, log_c - np.log10(m.class_total)[cls], 0.0)
                lost = np.flatnonzero(~known)
                bounds = np.searchsorted(lost, np.append(t.begins, len(t.h)))
                rest = [np.sort(t.h[lost[a:b]]) for a, b in zip(bounds, bounds[1:], strict=False)]
                rows = batch.iloc[at : at + len(part)]
                yield pd.DataFrame({
                    "doc_id": rows["doc_id"].to_numpy(), "held_out": rows["held_out"].to_numpy(), "row": (pid << 36) + row + np.arange(len(part)), "n_tokens": t.lengths(),
                    "known": t.per_text(known.astype(np.int64)), "log_c": t.per_text(log_c), "s": t.per_text(model / np.log(10) + inside), "rest": [r.view(np.int64) for r in rest]})
                at, row = at + len(part), row + len(part)

    rows = scratch.table(docs.mapInPandas(trimmed(run), "doc_id long, held_out boolean, row long, n_tokens long, known long, log_c double, s double, rest array<long>"), "scored")
    asked = rows.select("row", F.explode("rest").alias("h")).groupBy("row", "h").agg(F.count("*").alias("times"))
    more = asked.join(counts.select("h", "c"), "h").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("more_c"))
    zero = F.lit(0.0)
    return rows.drop("rest").join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(model.n_tokens).cast("long").alias("train_tokens"),
        (F.col("log_c") + F.coalesce("more_c", zero) - F.col("n_tokens") * F.log10(F.lit(float(model.n_tokens + model.n_words + 1)))).alias("base_score"), (F.col("s") + F.coalesce("more_c", zero)).alias("score"))


def score_documents(docs: DataFrame, params: Params | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, fits and scores."""
    p, scratch = params or Params(), Scratch(docs.sparkSession)
    split = _split(docs, p, id_col, text_col)
    train = split.where(~F.col("held_out"))
    counts = scratch.table(_read(train, p).groupBy("h").agg(F.min("class").alias("class"), F.sum("c").alias("c")), "counts")
    model = fit(train, counts, p)
    scratch.settle()
    return scored(split, model, counts, scratch)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model and base scores of all documents."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
