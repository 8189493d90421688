"""Exact, cached encoding of whole texts with tokenizer files of the tokenizers library.

Both supported files split a text before any merge is applied, so the ids of a text are the ids of its splits in order.
Texts are cut at white space, where a cut is always a split, into units; Arrow finds the distinct units of a slice of texts and
every unit that isn't known yet is encoded by the library. Units of letters go to the file's own merges in joined strings:
merges act within a unit only, since no entry of the vocabulary crosses the boundary, and the ids that begin (or end) a unit show
where each one stands. A text with unusual white space or special-token markers is encoded whole.

What is known stands in flat arrays, found by a hash and then compared letter by letter, and is held to a number of bytes:
beyond it the most used half stays. An encoder belongs to one task.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from keyspan.llm.common import trim

#: White space other than blank, tab and line feed, as any of the libraries sees it, and what may be white space to one of them.
_ODD = "".join(map(chr, [*range(9), *range(11, 32), 0x7F, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]))
_WHOLE = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in _ODD) + r"]|<\|"
#: White space of which more than single blanks and line feeds between words must be told apart.
_SPACED = r"\A[ \t\n]|[ \t\n][ \t\n]|[ \t\n]\z|\t"
_UNIT = re.compile(r" ?[^ \t\n]+|[ \t\n]+(?![^ \t\n])|[ \t\n]+")
#: ASCII marks that each of the files splits off letters, in runs; the apostrophe has rules of its own.
_MARKS = ".,!?;:*#%&$|"
#: Where the last letters of words stand in the files that mark word ends: one private character for each byte.
_FINAL = 0xE000
_JOINED = 256
_BATCH = 16
_SLICE_BYTES = 1 << 20
_NONE = np.zeros(0, np.uint32)
#: Bytes of a unit's hash, place in the table and numbers beside its letters and ids.
_ENTRY = 40
#: Factors of a unit's bytes in its hash, by their place, again and again.
_FACTORS = np.random.default_rng(0).integers(0, 1 << 64, 256, np.uint64) | np.uint64(1)

MODES = ("attached", "words")


def _byte_letters() -> np.ndarray:
    """Byte to the code of the printable letter that byte-level files write for it: printable bytes stand for themselves, others move up from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = [b for b in range(256) if b not in plain]
    return np.array([b if b in plain else 256 + moved.index(b) for b in range(256)], np.uint16)


_LETTERS = _byte_letters()
_BYTES = {chr(c): b for b, c in enumerate(_LETTERS.tolist())}
_BLANK = chr(_LETTERS[32])


def _marked(entry: str, suffix: str) -> str:
    """An entry of a file that marks word ends, its last letter replaced by the private one."""
    if not suffix or not entry.endswith(suffix) or entry == suffix:
        return entry
    return entry[: -len(suffix) - 1] + chr(_FINAL + _BYTES[entry[-len(suffix) - 1]])


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i] + 1, ... up to lengths[i] of them, for each i in turn."""
    done = np.cumsum(lengths)
    return np.arange(int(done[-1]) if len(done) else 0) + np.repeat(starts - (done - lengths), lengths)


def _raw(units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of strings one after the other, and where each begins and the last ends."""
    wide = np.int64 if pa.types.is_large_string(units.type) else np.int32
    offsets = np.frombuffer(units.buffers()[1], wide)[units.offset : units.offset + len(units) + 1].astype(np.int64) if len(units) else np.zeros(1, np.int64)
    held = units.buffers()[2]
    return np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held else np.zeros(0, np.uint8), offsets - offsets[0]


def _hashes(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    lengths = np.diff(offsets)
    sums = np.zeros(len(raw) + 1, np.uint64)
    with np.errstate(over="ignore"):
        places = np.arange(len(raw)) - np.repeat(offsets[:-1], lengths)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _FACTORS[places & 255], out=sums[1:])
        return sums[offsets[1:]] - sums[offsets[:-1]]


class CachedEncoder:
    """Encodes texts; mode 'attached': a blank belongs to the word after it; 'words': white space is dropped."""

    def __init__(self, path: str, mode: str, max_bytes: int = 24 << 20):
        if mode not in MODES:
            raise ValueError(f"mode is one of {MODES}")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.attached = mode == "attached"
        self.max_bytes = max_bytes
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        suffix = model.get("end_of_word_suffix") or ""
        special = {t.content for t in self.library.get_added_tokens_decoder().values()}
        vocab = {entry if entry in special else _marked(entry, suffix): i for entry, i in model["vocab"].items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.merges = models.BPE(vocab=vocab, merges=[(_marked(a, suffix), _marked(b, suffix)) for a, b in pairs], cache_capacity=0)
        self.edge = np.zeros(max(vocab.values()) + 1, bool)  # ids that begin a unit, or that end one
        for entry, i in vocab.items():
            self.edge[i] = entry not in special and (entry.startswith(_BLANK) if self.attached else ord(entry[-1]) >= _FINAL)
        self.merger = Tokenizer(self.merges)
        del vocab, pairs
        trim()
        self._reset()

    def _reset(self) -> None:
        self.index = [(np.zeros(0, np.uint64), np.zeros(0, np.int32)) for _ in range(2)]  # hashes in order and numbers of units, without and with a blank before them
        self.n = 0
        self.start, self.at = (np.zeros(1024, np.int64) for _ in range(2))  # of a unit's ids in flat, of its bytes in letters
        self.length, self.size, self.uses = (np.zeros(1024, np.int32) for _ in range(3))
        self.flat, self.letters = np.zeros(8192, np.uint32), np.zeros(8192, np.uint8)
        self.used = self.written = self.bytes = 0

    @property
    def known(self) -> tuple[dict[str, int], dict[str, int]]:
        """The units that are known, without and with a blank before them, and their numbers."""
        return tuple({self.letters[self.at[i] : self.at[i] + self.size[i]].tobytes().decode(): i for i in numbers.tolist()} for _, numbers in self.index)

    def _found(self, raw: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, joined: bool) -> np.ndarray:
        """The number of each unit, -1 if it isn't known."""
        have, numbers = self.index[joined]
        out = np.full(len(hashes), -1, np.int64)
        if not len(have):
            return out
        place = np.minimum(np.searchsorted(have, hashes), len(have) - 1)
        lengths = np.diff(offsets)
        on = np.flatnonzero((have[place] == hashes) & (self.size[numbers[place]] == lengths))
        at, sizes = numbers[place[on]].astype(np.int64), lengths[on]
        other = raw[_ranges(offsets[:-1][on], sizes)] != self.letters[_ranges(self.at[at], sizes)]
        if other.any():  # another unit of that hash
            ends = np.cumsum(sizes)
            wrong = np.append(0, np.cumsum(other))
            same = wrong[ends] == wrong[ends - sizes]
            on, at = on[same], at[same]
        out[on] = at
        return out

    @staticmethod
    def _grown(a: np.ndarray, n: int) -> np.ndarray:
        if n <= len(a):
            return a
        out = np.zeros(max(n, len(a) + len(a) // 2), a.dtype)
        out[: len(a)] = a
        return out

    def _whole(self, units: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.library.encode_batch(units, add_special_tokens=False)]

    def _written(self, words: pa.Array, joined: bool) -> tuple[str, np.ndarray]:
        """Words of letters, one after the other as the file's merges take them, and where each ends."""
        if self.attached and joined:
            words = pc.binary_join_element_wise("", words, " ")
        raw, offsets = _raw(words)
        ends = offsets[1:]
        codes = _LETTERS[raw]
        if not self.attached:
            codes[ends - 1] = _FINAL + raw[ends - 1].astype(np.uint16)
        return codes.astype("<u2").tobytes().decode("utf-16-le"), ends

    def _letters(self, words: pa.Array, joined: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters alone one after the other, and their number for each word."""
        if not len(words):
            return _NONE, np.zeros(0, np.int64)
        text, ends = self._written(words, joined)
        step = _JOINED if joined else 1
        bounds = np.append(0, np.append(ends[step - 1 : -1 : step], ends[-1])).tolist()
        found = []
        for a in range(0, len(bounds) - 1, _BATCH):
            part = bounds[a : a + _BATCH + 1]
            found += [np.array(e.ids, np.uint32) for e in self.merger.encode_batch_fast([text[x:y] for x, y in zip(part, part[1:], strict=False)], add_special_tokens=False)]
        ids = np.concatenate(found)
        if not joined:
            return ids, np.array([len(x) for x in found], np.int64)
        edges = np.flatnonzero(self.edge[ids])
        if len(edges) != len(ends):
            raise ValueError("the file's merges cross words")
        return ids, np.diff(edges, append=len(ids)) if self.attached else np.diff(edges, prepend=-1)

    def _plain(self, cores: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The words as the file's normaliser writes them, and whether that is letters alone."""
        sure = pc.ascii_is_alpha(cores).to_numpy(zero_copy_only=False).copy()
        plain = cores if self.attached else pc.ascii_lower(cores)
        other = np.flatnonzero(~sure & ~pc.string_is_ascii(cores).to_numpy(zero_copy_only=False))
        if len(other):
            words = cores.take(pa.array(other)).to_pylist()
            letters = np.array([w.isalpha() for w in words])
            if not self.attached and letters.any():
                asked = [w for w, x in zip(words, letters.tolist(), strict=True) if x]
                normal = self.library.normalizer.normalize_str("\n".join(asked)).split(" ")
                if len(normal) != len(asked):
                    normal = [self.library.normalizer.normalize_str(w) for w in asked]
                letters[letters] = [w.isalpha() for w in normal]
                swapped = np.zeros(len(plain), bool)
                swapped[other[letters]] = True
                plain = pc.replace_with_mask(plain, pa.array(swapped), pa.array([w for w in normal if w.isalpha()], plain.type))
            sure[other] = letters
        return plain, sure

    def _learn(self, units: pa.Array, hashes: np.ndarray, joined: bool) -> None:
        """Notes the ids of distinct units that aren't known: words without their marks are encoded once, units with marks put together."""
        cores = pc.ascii_rtrim(units, characters=_MARKS)
        tail = pc.subtract(pc.binary_length(units), pc.binary_length(cores)).to_numpy()
        coded = cores.dictionary_encode()
        core_of, cores = coded.indices.to_numpy(), coded.dictionary
        start, length = np.zeros(len(cores), np.int64), np.zeros(len(cores), np.int64)
        todo, sure = np.ones(len(cores), bool), np.ones(len(cores), bool)
        asked = pc.ascii_is_alpha(cores).to_numpy(zero_copy_only=False).copy()  # words that may be known as units
        asked[core_of[tail == 0]] = False
        held = np.flatnonzero(asked)
        raw, offsets = _raw(cores.take(pa.array(held)))
        at = self._found(raw, offsets, _hashes(raw, offsets), joined)
        held, at = held[at >= 0], at[at >= 0]
        start[held], length[held], todo[held] = self.start[at], self.length[at], False
        rest = np.flatnonzero(todo)
        plain, letters = self._plain(cores.take(pa.array(rest)))
        sure[rest] = letters
        ids, n = self._letters(plain.filter(pa.array(letters)), joined or not self.attached)
        start[rest[letters]], length[rest[letters]] = self._append(ids, n), n
        unit_start, unit_length = start[core_of], length[core_of]
        whole = np.flatnonzero(~sure[core_of])
        if len(whole):
            found = self._whole([" " * joined + u for u in units.take(pa.array(whole)).to_pylist()])
            unit_length[whole] = n = np.array([len(x) for x in found], np.int64)
            unit_start[whole] = self._append(np.concatenate(found), n)
        long = np.flatnonzero(sure[core_of] & (tail > 0))
        if len(long):
            marks = [u[-k:] for u, k in zip(units.take(pa.array(long)).to_pylist(), tail[long].tolist(), strict=True)]
            number = {m: k for k, m in enumerate(dict.fromkeys(marks))}
            found = self._whole(list(number))
            n = np.array([len(x) for x in found], np.int64)
            first, which = self._append(np.concatenate(found), n), np.array([number[m] for m in marks])
            pairs = np.stack([unit_length[long], n[which]], 1)
            ids = self.flat[_ranges(np.stack([unit_start[long], first[which]], 1).ravel(), pairs.ravel())]
            unit_length[long] = pairs.sum(1)
            unit_start[long] = self._append(ids, unit_length[long])
        self._note(*_raw(units), hashes, joined, unit_start, unit_length)

    def _append(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Where each run of ids starts, once it stands at the end of flat."""
        self.flat = self._grown(self.flat, self.used + len(ids))
        self.flat[self.used : self.used + len(ids)] = ids
        starts = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)
        self.bytes += 4 * len(ids)
        return starts

    def _note(self, raw: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, joined: bool, starts: np.ndarray, lengths: np.ndarray) -> None:
        n, m = self.n, self.n + len(hashes)
        self.start, self.at, self.length, self.size, self.uses = (self._grown(a, m) for a in (self.start, self.at, self.length, self.size, self.uses))
        self.start[n:m], self.length[n:m], self.uses[n:m] = starts, lengths, 0
        self.at[n:m], self.size[n:m] = self.written + offsets[:-1], np.diff(offsets)
        self.letters = self._grown(self.letters, self.written + len(raw))
        self.letters[self.written : self.written + len(raw)] = raw
        self.written += len(raw)
        self.n = m
        self.bytes += len(raw) + _ENTRY * len(hashes)
        have, numbers = self.index[joined]
        new, first = np.unique(hashes, return_index=True)  # of several units of one hash, one can be found again
        place = np.searchsorted(have, new)
        if len(have):
            free = have[np.minimum(place, len(have) - 1)] != new
            new, first, place = new[free], first[free], place[free]
        self.index[joined] = np.insert(have, place, new), np.insert(numbers, place, (n + first).astype(np.int32))

    def keep(self, max_bytes: int) -> None:
        """Forgets all but the most used units, so that they take at most max_bytes."""
        if self.bytes <= max_bytes:
            return
        index, start, length, at, size, uses, flat, letters = self.index, self.start, self.length, self.at, self.size, self.uses, self.flat, self.letters
        held = np.concatenate([numbers for _, numbers in index])
        held = held[np.argsort(-uses[held], kind="stable")]
        held = held[np.cumsum((_ENTRY + size[held] + 4 * length[held]).astype(np.int64)) <= max_bytes]
        kept = np.zeros(self.n, bool)
        kept[held] = True
        self._reset()
        for joined, (hashes, numbers) in enumerate(index):
            on = kept[numbers]
            i, first = numbers[on], self.n
            offsets = np.append(0, np.cumsum(size[i], dtype=np.int64))
            n = length[i].astype(np.int64)
            self._note(letters[_ranges(at[i], size[i].astype(np.int64))], offsets, hashes[on], bool(joined), self._append(flat[_ranges(start[i], n)], n), n)
            self.uses[first : self.n] = uses[i] // 2

    def _numbers(self, units: pa.Array, joined: bool) -> np.ndarray:
        """The number of each unit; joined: with a blank before it."""
        coded = units.dictionary_encode()
        raw, offsets = _raw(coded.dictionary)
        hashes = _hashes(raw, offsets)
        at = self._found(raw, offsets, hashes, joined)
        new = np.flatnonzero(at < 0)
        if len(new):
            first = self.n
            self._learn(coded.dictionary.take(pa.array(new)), hashes[new], joined)
            at[new] = np.arange(first, self.n)
        codes = coded.indices.to_numpy()
        self.uses[at] += np.bincount(codes, minlength=len(at)).astype(np.int32)
        return at[codes]

    def _gathered(self, numbers: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """The ids of the texts whose units end at the given places."""
        n = self.length[numbers].astype(np.int64)
        out = self.flat[_ranges(self.start[numbers], n)]
        bounds = np.append(0, np.cumsum(n))[ends].tolist()
        return [out[a:b] for a, b in zip([0, *bounds], bounds, strict=False)]

    def _cut(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of texts that can be cut at white space."""
        if not self.attached:
            lists = pc.ascii_split_whitespace(texts)
            numbers = self._numbers(lists.flatten(), False)
            return self._gathered(numbers, lists.offsets.to_numpy()[1:])
        spaced = pc.match_substring_regex(texts, _SPACED).to_numpy(zero_copy_only=False)
        if spaced.any():
            out = np.empty(len(texts), object)
            out[~spaced] = _boxed(self._cut(texts.filter(pa.array(~spaced))))
            found = [_UNIT.findall(t) for t in texts.filter(pa.array(spaced)).to_pylist()]
            numbers = np.empty(sum(map(len, found)), np.int64)
            joined = np.array([u[:1] == " " and u != " " for units in found for u in units], bool)
            for k in (False, True):
                numbers[joined == k] = self._numbers(pa.array([u[k:] for units in found for u in units if (u[:1] == " " and u != " ") == k], texts.type), k)
            out[spaced] = _boxed(self._gathered(numbers, np.cumsum([len(units) for units in found])))
            return list(out)
        lines = pc.split_pattern(pc.replace_substring(texts, "\n", "\0\n\0"), "\0")  # a line feed between words is a unit
        words = pc.split_pattern(lines.flatten(), " ")
        flat, first = words.flatten(), words.offsets.to_numpy()
        begins = np.zeros(len(flat), bool)
        begins[first[:-1]] = True
        numbers = np.empty(len(flat), np.int64)
        numbers[~begins] = self._numbers(flat.filter(pa.array(~begins)), True)
        numbers[begins] = self._numbers(flat.filter(pa.array(begins)), False)
        return self._gathered(numbers, first[lines.offsets.to_numpy()[1:]])

    def encode_all(self, texts: pa.Array | list[str]) -> Iterator[np.ndarray]:
        """The ids of whole texts, uint32, one text after the other; none is null."""
        if isinstance(texts, list):
            texts = pa.array(texts, pa.large_string())
        bounds = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
        at = 0
        while at < len(texts):
            done = int(bounds[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(bounds, done + _SLICE_BYTES, "right")))
            part = pc.take(texts, pa.array(np.arange(at, end)))  # a copy whose offsets start at its first text
            yield from self._slice(part.cast(pa.string()) if int(bounds[end - 1]) - done < 1 << 28 else part.cast(pa.large_string()))
            at = end
            if self.bytes > self.max_bytes:
                self.keep(self.max_bytes // 2)

    def _slice(self, texts: pa.Array) -> list[np.ndarray]:
        whole = pc.match_substring_regex(texts, _WHOLE).to_numpy(zero_copy_only=False)
        out = np.empty(len(texts), object)
        if not whole.all():
            out[~whole] = _boxed(self._cut(texts.filter(pa.array(~whole)) if whole.any() else texts))
        if whole.any():
            out[whole] = _boxed(self._whole(texts.filter(pa.array(whole)).to_pylist()))
        return list(out)

    def encode(self, text: str) -> np.ndarray:
        """The ids of one whole text, uint32."""
        return next(self.encode_all([text]))


def _boxed(arrays: list[np.ndarray]) -> np.ndarray:
    out = np.empty(len(arrays), object)
    for i, a in enumerate(arrays):
        out[i] = a
    return out
