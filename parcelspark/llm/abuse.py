"""A score for abusive, hateful or sexual content of every text, and rates by source (problem 8).

Texts become words; a text's score is that of its worst stretch of words, so one remark in
a long file counts as much as in a short one. A linear model over hashed words, pairs of words and
character n-grams scores the words. It is learnt from all confirmed examples and all documents, which
are the unlabelled texts, with the non-negative risk estimator of positive-unlabelled learning. There are
MEMBERS members, whose weights are averaged, and a text is of one of them: that one learns from it, another
one, which has not seen it, judges it. From these judgements of all texts come the class prior and the threshold,
where the risk of positive-unlabelled classification is least.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from itertools import chain
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import dropped, spread, written
from .cut import listed
from .slices import sliced

#: Letters that look like Latin ones, and what they stand for (fixed values).
LOOKALIKE = "аеорсухіјѕԁһкмтвнАЕОРСУХІЈЅКМТВНαορνικτ"
LATIN = "aeopcyxijsdhkmtbhAEOPCYXIJSKMTBHaopvikt"
#: Characters without width, which may hide a word (fixed values).
HIDDEN = "­​‌‍⁠﻿᠎"
#: Words: letters that are written apart, or runs of letters, marks, digits, hidden characters and the signs that stand for letters in masked words; a longer run is several words in a row.
WORD = rf"(?<![\p{{L}}\p{{N}}])\p{{L}}[{HIDDEN}]*(?:[ .\-_*]\p{{L}}[{HIDDEN}]*(?![\p{{L}}\p{{N}}]))+|[\p{{L}}\p{{M}}\p{{N}}@$%*#!{HIDDEN}]{{1,40}}"
#: The same letters written apart, with what stands between them.
APART = re.compile(r"[^\W\d_](?:[ .\-_*][^\W\d_])+")
BETWEEN = re.compile(r"[ .\-_*]")
_BETWEEN = frozenset(" .-_*")
#: Where names in camel case are parted, in ASCII.
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Runs of digits, of letters and of other signs, which make up the shape of a word.
SHAPE = re.compile(r"\d+|[^\W\d_]+|[\W_]+")
_SHAPE = "".join("0" if chr(c).isdigit() else "a" if chr(c).isalpha() else "*" for c in range(128))
RUN = re.compile(r"(.)\1+")
#: A feature can speak for a case only if so many confirmed texts have it, and by these log odds more often than others: single judgements err, and what such texts share with all others must not be learnt.
SUPPORT, LEAST_ODDS = 3, 1.0
#: Hashed features; words in a block; blocks in a stretch.
DIM, BLOCK, STRETCH = 1 << 19, 2, 5
#: Of sample, which fit does not use, but for MEMBERS: members of the ensemble; the most confirmed texts, which all members see, but for every HELD-th, which is held back; unlabelled texts of a member; unlabelled texts held back; the most characters of a text of this sample. Rows are numbers expected of a draw by hash.
MEMBERS, CONFIRMED_ROWS, HELD, MEMBER_ROWS, OPEN_ROWS, FIT_CHARS = 2, 5000, 5, 2500, 6000, 100_000
#: The sample is drawn from blocks of so many ids where ids are numbers, and at most so many blocks are sought by their ids in the scan.
IDS, SOUGHT = 10_000, 100
EPOCHS, RATE = 30, 0.005
#: Words after which a pack of texts is full; confirmed texts that a pack is learnt with, if there are as many; the most confirmed keys, and confirmed texts, that are broadcast at once; partitions that sums are made in; scores are counted by this many decimals.
PACK_WORDS, PACK_CONFIRMED, KEYS_SENT, TEXTS_SENT, SUM_PARTS, DECIMALS = 700_000, 1_000, 2_000_000, 10_000, 8, 3
#: Slots of words that are scored at once, a text at least; blocks of a group, of which the best is sought first.
SLOTS, GROUP = 1 << 16, 32
#: Words that a worker that packs or scores remembers.
REMEMBER = 300_000
_PLAIN = {**{ord(a): b for a, b in zip(LOOKALIKE, LATIN)}, **{ord(c): None for c in HIDDEN}}


def words_of(text: Column) -> Column:
    """The words of a text as they are written; none for null and empty texts."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def plain_words(word: str) -> list[str]:
    """A word as written in lower case, looked-alike letters and hidden characters undone, letters written apart joined, names in camel case parted."""
    ascii = word.isascii()
    if not ascii:
        word = word.translate(_PLAIN)
    if word[1:2] in _BETWEEN and APART.fullmatch(word):
        return [BETWEEN.sub("", word).lower()]
    low = word.lower()
    if low == word or len(word) == 1:
        return [low] if low else []
    if ascii:
        return [w.lower() for w in CAMEL.split(word)]
    cuts = [0, *(i for i in range(1, len(word)) if word[i].isupper() and word[i - 1].islower()), len(word)]
    return [word[i:j].lower() for i, j in zip(cuts, cuts[1:])]


@lru_cache(1 << 16)
def _runs(signs: str) -> str:
    return RUN.sub(r"\1", signs)


def shape(word: str) -> str:
    """A sign for each run of digits (0), letters (a) and other signs (*) of a word."""
    if word.isascii():
        return _runs(word.translate(_SHAPE))
    return SHAPE.sub(lambda m: "0" if m[0][0].isdigit() else "a" if m[0][0].isalpha() else "*", word)


def _hash(texts: list[str]) -> np.ndarray:
    if not texts:
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(np.array(texts, dtype=object), categorize=False).astype(np.uint64)


def _ranges(starts: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all places from starts[i] to starts[i + 1] for each i of numbers, in order, how many each has)."""
    size = starts[numbers + 1] - starts[numbers]
    return np.repeat(starts[numbers] - (np.cumsum(size) - size), size) + np.arange(size.sum()), size


class Words:
    """Numbers for words, and the hashed features of each."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.keys = np.zeros(0, np.uint64)
        self.features = np.zeros(0, np.int64)
        self.starts = np.zeros(1, np.int64)
        self.raw: dict[str, int] = {}  # words as written, and the numbers of each one's plain words
        self.raw_starts, self.raw_items = np.zeros(1, np.int64), np.zeros(0, np.int64)

    def add(self, fresh: list[str]) -> None:
        """Take in words not known yet: each gives the whole word, its 3- to 5-grams, and its shape if it is not of letters alone."""
        keys = _hash(fresh)
        sizes = np.fromiter(map(len, fresh), np.int64, len(fresh)) + 2
        signs = np.frombuffer("".join(f"^{w}$" for w in fresh).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        ends = np.repeat(np.cumsum(sizes), sizes)
        at = np.arange(len(signs))
        word = np.repeat(np.arange(len(fresh)), sizes)
        odd = [(i, "shape " + shape(w)) for i, w in enumerate(fresh) if not w.isalpha()]
        hashed, owner = [keys * np.uint64(31) + np.uint64(7), _hash([t for _, t in odd])], [np.arange(len(fresh)), np.array([i for i, _ in odd], np.int64)]
        for n in (3, 4, 5):
            first = at[at + n <= ends]
            h = np.full(len(first), n, np.uint64)
            for k in range(n):
                h = h * np.uint64(0x100000001B3) ^ signs[first + k]
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
            hashed.append(h ^ (h >> np.uint64(32)))
            owner.append(word[first])
        owner = np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        self.features = np.concatenate([self.features, (np.concatenate(hashed) % np.uint64(DIM)).astype(np.int64)[order]])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.bincount(owner, minlength=len(fresh)))])
        self.known.update(zip(fresh, range(len(self.keys), len(self.keys) + len(fresh))))
        self.keys = np.concatenate([self.keys, keys])

    def numbers(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers of all rows in order, row bounds)."""
        offsets = lists.offsets.to_numpy().astype(np.int64)
        values = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
        if not len(values):
            return np.zeros(0, np.int64), offsets - offsets[0]
        coded = values.dictionary_encode()
        written_so = coded.dictionary.to_pylist()
        new = [w for w in written_so if w not in self.raw]
        if new:
            plain = [plain_words(w) for w in new]
            fresh = list(dict.fromkeys(w for ws in plain for w in ws if w not in self.known))
            if fresh:
                self.add(fresh)
            self.raw.update(zip(new, range(len(self.raw), len(self.raw) + len(new))))
            self.raw_starts = np.concatenate([self.raw_starts, self.raw_starts[-1] + np.cumsum(np.fromiter(map(len, plain), np.int64, len(plain)))])
            self.raw_items = np.concatenate([self.raw_items, np.fromiter(map(self.known.__getitem__, chain.from_iterable(plain)), np.int64)])
        place = np.fromiter(map(self.raw.__getitem__, written_so), np.int64, len(written_so))[coded.indices.to_numpy(zero_copy_only=False)]
        sizes = self.raw_starts[place + 1] - self.raw_starts[place]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return self.raw_items[np.repeat(self.raw_starts[place] - ends[:-1], sizes) + np.arange(ends[-1])], ends[offsets - offsets[0]]

    def only(self, numbers: np.ndarray) -> Words:
        """These words alone, numbered in this order."""
        out, names = Words(), list(self.known)
        out.known, out.keys = {names[i]: n for n, i in enumerate(numbers.tolist())}, self.keys[numbers]
        out.features, size = self.of(numbers)
        out.starts = np.concatenate([[0], np.cumsum(size)])
        return out

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(features of the words in order, how many each word has)."""
        at, size = _ranges(self.starts, numbers)
        return self.features[at], size

    def pairs(self, numbers: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The feature of each word with the one before it in its text, of the first one with itself."""
        keys = self.keys[numbers]
        before = np.concatenate([keys[:1], keys[:-1]])
        first = bounds[:-1][np.diff(bounds) > 0]
        before[first] = keys[first]
        mixed = (before * np.uint64(0x9E3779B97F4A7C15)) ^ (keys + np.uint64(0x632BE59BD9B4E019))
        return ((mixed >> np.uint64(20)) % np.uint64(DIM)).astype(np.int64)


def _blocks(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each block, row of each block); rows without words have none."""
    counts = -(-np.diff(bounds) // BLOCK)
    rows = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    return bounds[:-1][rows] + within * BLOCK, rows


def _stretches(blocks: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The sum of each block and those after it in its row, STRETCH in all."""
    total = blocks.copy()
    for k in range(1, STRETCH):
        total[:-k] += np.where(rows[:-k] == rows[k:], blocks[k:], 0.0)
    return total


class _Texts:
    """Texts as word numbers, in slots: a text's words from the start of a block on, and behind them empty blocks, so that all stretches are of equal length."""

    def __init__(self, words: Words, numbers: np.ndarray, bounds: np.ndarray):
        self.words, self.bounds, self.empty = words, bounds, len(words.keys)
        sizes = np.diff(bounds)
        self.has = np.flatnonzero(sizes)
        sizes = sizes[self.has]
        blocks = -(-sizes // BLOCK)
        room = blocks + STRETCH
        first = np.cumsum(room) - room
        at = np.repeat(first * BLOCK - bounds[:-1][self.has], sizes) + np.arange(len(numbers))
        slots = int(room.sum()) * BLOCK
        self.slots, self.pair = np.full(slots, self.empty), np.full(slots, DIM)
        self.slots[at], self.pair[at] = numbers, words.pairs(numbers, bounds)
        self.value = np.empty(slots // BLOCK)  # of the stretch from each block on
        groups = -(-blocks // GROUP)
        self.group_of = np.cumsum(groups + 1) - groups - 1  # the first group of a text, whose last one are its empty blocks
        self.groups = np.repeat(first - self.group_of * GROUP, groups + 1) + np.arange(int((groups + 1).sum())) * GROUP
        self.groups[self.group_of + groups] = first + blocks
        self.spans = np.stack([self.group_of, self.group_of + groups], axis=1).ravel()
        self.parts = _parts(np.append(first * BLOCK, slots), np.append(self.group_of, len(self.groups)))

    def worst(self, weight_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score, number of the first block) of the worst stretch of each text that has words."""
        weight_of, by_word = np.append(weight_of, 0.0), np.zeros(self.empty + 1)
        if self.empty:
            np.add.reduceat(weight_of.take(self.words.features, mode="clip"), self.words.starts[:-1], out=by_word[:-1])
        return self.stretches(lambda at: by_word.take(self.slots[at], mode="clip") + weight_of.take(self.pair[at], mode="clip"))

    def stretches(self, own: Callable[[slice], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """worst by what gives the scores of a slice of the slots, which are taken in parts that a core's cache holds."""
        if not len(self.has):
            return np.zeros(0), np.zeros(0, np.int64)
        most = np.empty(len(self.groups))
        for start, end, group, groups in self.parts:
            each = own(slice(start, end))
            blocks = reduce(np.add, [each[k::BLOCK] for k in range(BLOCK)])
            start //= BLOCK
            value = self.value[start : start + len(blocks)]
            value[:] = blocks
            for k in range(1, STRETCH):
                value[:-k] += blocks[k:]
            most[group:groups] = np.maximum.reduceat(value, self.groups[group:groups] - start)
        best = np.maximum.reduceat(most, self.spans)[::2]
        at = np.flatnonzero(most == np.repeat(best, np.diff(np.append(self.group_of, len(most)))))
        first = self.groups[at[np.searchsorted(at, self.group_of)]]  # of the first group that has the best
        inside = self.value.take(first[:, None] + np.arange(GROUP), mode="clip") == best[:, None]
        return best, first + inside.argmax(axis=1)

    def gradient(self, block: np.ndarray, g: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """(features, g) of each text's chosen stretch, of words and of pairs; texts in the order of has."""
        at = ((block * BLOCK)[:, None] + np.arange(BLOCK * STRETCH)).ravel()
        real = self.slots[at] < self.empty
        at, each = at[real], np.repeat(g, BLOCK * STRETCH)[real]
        by_word = np.bincount(self.slots[at], weights=each, minlength=self.empty)
        some = np.flatnonzero(by_word)
        f, size = self.words.of(some)
        return (f, np.repeat(by_word[some], size)), (self.pair[at], each)


def _parts(slots: np.ndarray, groups: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(first slot, last, first group, last) of runs of texts, which hold SLOTS at most or are one text; slots, groups: where those of each text start, and the last end."""
    out, lo = [], 0
    while lo < len(slots) - 1:
        hi = max(lo + 1, int(np.searchsorted(slots, slots[lo] + SLOTS, side="right")) - 1)
        out.append((int(slots[lo]), int(slots[hi]), int(groups[lo]), int(groups[hi])))
        lo = hi
    return out


def _sorted(*keys: np.ndarray) -> list[np.ndarray]:
    """Equally long keys of numbers from 0 on in the order of the first, the second, ..."""
    bits = [int(k.max(initial=0)).bit_length() for k in keys]
    if sum(bits) > 63:
        order = np.lexsort(keys[::-1])
        return [k[order] for k in keys]
    whole = np.sort(reduce(lambda x, k: x << k[1] | k[0], zip(keys[1:], bits[1:]), keys[0]))  # much faster than an order
    out = []
    for b in bits[:0:-1]:
        out.append(whole & ((1 << b) - 1))
        whole >>= b
    return [whole, *out[::-1]]


class _Learner:
    """Texts whose score is summed over the features that learning has met, which alone have a weight; these are numbered from 1 on as they are met, 0 is no such feature. Equal words behind equal words are scored once."""

    def __init__(self, texts: _Texts):
        self.texts, words = texts, texts.words
        feature, self.owners = _sorted(words.features, np.repeat(np.arange(texts.empty), np.diff(words.starts)))
        self.owner_starts = self._starts(feature)
        self.having, self.held, self.sizes = np.empty_like(self.owners), 0, np.zeros(1, np.int64)  # the words that have the features met

        slots = np.flatnonzero(texts.slots < texts.empty)
        pair, word, slots = _sorted(texts.pair[slots], texts.slots[slots], slots)
        new = (np.diff(pair, prepend=-1) != 0) | (np.diff(word, prepend=-1) != 0)
        used = np.zeros(len(texts.slots), np.int64)
        used[slots[new]] = 1
        self.twin = np.cumsum(used)[slots[new]] - 1  # of each pair and word, by the pair; numbered by their first use, as many are used again soon
        self.twin_starts = self._starts(pair[new])
        self.word, self.number = np.empty(len(self.twin), np.int64), np.zeros(len(self.twin), np.int64)
        self.word[self.twin] = word[new]
        self.twins = np.full(len(texts.slots), len(self.twin))
        self.twins[slots] = self.twin[np.cumsum(new) - 1]

    @staticmethod
    def _starts(features: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(np.bincount(features, minlength=DIM))])

    def meet(self, fresh: np.ndarray, number: int) -> None:
        """Features that are met and have the numbers from number on."""
        at, size = _ranges(self.owner_starts, fresh)
        self.having[self.held : self.held + len(at)] = self.owners[at]
        self.held, self.sizes = self.held + len(at), np.append(self.sizes, size)
        at, size = _ranges(self.twin_starts, fresh)
        self.number[self.twin[at]] = np.repeat(np.arange(number, number + len(fresh)), size)

    def worst(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """texts.worst by weights of the features met, by their number."""
        by_word = np.bincount(self.having[: self.held], weights=np.repeat(weights, self.sizes), minlength=self.texts.empty + 1)
        each = np.zeros(len(self.word) + 1)
        each[:-1] = by_word.take(self.word, mode="clip") + weights.take(self.number, mode="clip")
        return self.texts.stretches(lambda at: each.take(self.twins[at], mode="clip"))


class _Pack:
    """Texts of one member that are kept together: what is kept of their rows, their words as numbers, the features of these, and in how many texts each feature occurs. A task's packs share its Words until they are full."""

    SCHEMA = "fold int, grp int, pack bigint, texts bigint, numbers binary, sizes binary, keys binary, features binary, starts binary, counts binary"

    def __init__(self) -> None:
        self.numbers, self.sizes, self.kept, self.held = [], [], [], 0
        self.ids, self.own = np.zeros(0, np.int64), np.zeros(0, np.int64)  # the task's number of each of its words, and its own number, from 1 on, of each of the task's
        self.counts = np.zeros(DIM, np.int32)

    def add(self, words: Words, numbers: np.ndarray, sizes: np.ndarray, kept: pa.StructArray) -> None:
        """Take in texts whose words are numbered in words, those of the task."""
        self.own = np.append(self.own, np.zeros(len(words.keys) - len(self.own), np.int64))
        fresh = np.unique(numbers[self.own[numbers] == 0])
        self.own[fresh] = np.arange(len(self.ids), len(self.ids) + len(fresh)) + 1
        self.ids = np.append(self.ids, fresh)
        bits = len(words.keys).bit_length()  # rows of a batch and words of a task leave room
        each = np.sort(np.repeat(np.arange(len(sizes)) << bits, sizes) | numbers)
        each = each[np.diff(each, prepend=-1) != 0]
        starts = np.searchsorted(each, np.arange(len(sizes) + 1) << bits)
        features, size = words.of(each & ((1 << bits) - 1))
        ends = np.concatenate([[0], np.cumsum(size)])[starts].tolist()
        for lo, hi in zip(ends[:-1], ends[1:]):
            self.counts[features[lo:hi]] += 1  # once for a feature that occurs twice
        self.kept.append(kept)
        self.numbers.append((self.own[numbers] - 1).astype(np.int32))
        self.sizes.append(sizes)
        self.held += len(numbers)

    def moved(self, known: np.ndarray) -> None:
        """The task's words are now those of known, in this order, which has all of this pack."""
        self.ids, self.own = np.searchsorted(known, self.ids), np.zeros(len(known), np.int64)
        self.own[self.ids] = np.arange(len(self.ids)) + 1

    def row(self, words: Words, fold: int, grp: int, pack: int) -> pa.RecordBatch:
        sizes, rows = np.concatenate(self.sizes), pa.concat_arrays(self.kept)
        features, size = words.of(self.ids)
        kept = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
        cells = [np.concatenate(self.numbers), sizes, words.keys[self.ids], features.astype(np.int32), np.concatenate([[0], np.cumsum(size)]), self.counts]
        return pa.RecordBatch.from_arrays([pa.array([fold], pa.int32()), pa.array([grp], pa.int32()), pa.array([pack]), pa.array([len(sizes)]), *[pa.array([x.tobytes()], pa.binary()) for x in cells], kept], names=[*[c.split()[0] for c in _Pack.SCHEMA.split(", ")], "kept"])

    @staticmethod
    def texts(numbers: bytes, sizes: bytes, keys: bytes, features: bytes, starts: bytes) -> _Texts:
        words = Words()
        words.keys, words.features, words.starts = np.frombuffer(keys, np.uint64), np.frombuffer(features, np.int32).astype(np.int64), np.frombuffer(starts, np.int64)
        return _Texts(words, np.frombuffer(numbers, np.int32).astype(np.int64), np.concatenate([[0], np.cumsum(np.frombuffer(sizes, np.int64))]))


#: What a pack's texts are made of.
_CELLS = ("numbers", "sizes", "keys", "features", "starts")


def _packed(rows: DataFrame) -> DataFrame:
    """_Pack.SCHEMA and the list kept, of fold, grp, kept (a struct), and words, or the text. Every text is in one pack; a group of at least 0, of which a task has all rows, is one pack."""

    cut = rows.dtypes[3][1] == "string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, packs, words = TaskContext.get().partitionId(), 0, {}, Words()
        for batch in batches:
            for part, lists in listed(batch, 3, HIDDEN) if cut else ((x, x.column(3)) for x in sliced(batch, 3)):
                fold, grp = part.column(0).to_numpy(), part.column(1).to_numpy()
                numbers, bounds = words.numbers(lists)
                sizes = np.diff(bounds)
                for at in sorted(set(zip(fold.tolist(), grp.tolist()))):
                    pack = packs.setdefault(at, _Pack())
                    own = (fold == at[0]) & (grp == at[1])
                    pack.add(words, numbers[np.repeat(own, sizes)], sizes[own], part.column(2).filter(pa.array(own)))
                    if pack.held >= PACK_WORDS and at[1] < 0:
                        yield packs.pop(at).row(words, *at, task << 24 | made)
                        made += 1
                if len(words.raw) > REMEMBER:
                    known = np.unique(np.concatenate([np.zeros(0, np.int64), *[p.ids for p in packs.values()]]))
                    words = words.only(known)
                    for pack in packs.values():
                        pack.moved(known)
        for at, pack in packs.items():
            yield pack.row(words, *at, task << 24 | made)
            made += 1

    return rows.mapInArrow(run, f"{_Pack.SCHEMA}, kept array<{dict(rows.dtypes)['kept']}>")


def _total(batches: Iterator[pa.RecordBatch], kind: type) -> dict[int, tuple[int, np.ndarray]]:
    """(sum of texts, sum of the arrays) of fold, texts, values, by fold."""
    sums: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        for i in range(batch.num_rows):
            fold, texts, values = (c[i].as_py() for c in batch.columns)
            known = sums.get(fold, (0, 0.0))
            sums[fold] = known[0] + texts, known[1] + np.frombuffer(values, kind)
    return sums


def _summed(rows: DataFrame, kind: type) -> dict[int, tuple[int, np.ndarray]]:
    """_total of a table, of which the driver gets at most SUM_PARTS parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fold, (texts, values) in _total(batches, kind).items():
            yield pa.RecordBatch.from_arrays([pa.array([fold], pa.int32()), pa.array([texts]), pa.array([values.astype(np.float64).tobytes()], pa.binary())], names=["fold", "texts", "values"])

    return _total(rows.coalesce(SUM_PARTS).mapInArrow(run, "fold int, texts bigint, values binary").toArrow().to_batches(), np.float64)


def _above(values: np.ndarray, counts: np.ndarray | None, cuts: np.ndarray) -> tuple[np.ndarray, float]:
    """(share of the values that are not below each cut, number of values); counts: how often each occurs."""
    order = np.argsort(values)
    left = np.concatenate([[0.0], np.cumsum(np.ones(len(values)) if counts is None else counts[order])])
    return 1 - left[np.searchsorted(values[order], cuts)] / max(1.0, left[-1]), left[-1]


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, positives: np.ndarray | None = None, unlabelleds: np.ndarray | None = None) -> float:
    """The share of positive texts among the unlabelled, from scores of both: the least ratio of the shares above a score, each taken at its unfavourable bound (two standard errors); 1 without positive or unlabelled scores.

    Where scores above a cut come from positive texts alone, the two shares differ by just this factor. positives, unlabelleds: how often
    each score occurs, once by default.
    """
    if not len(positive) or not len(unlabelled):
        return 1.0
    cuts = np.unique(positive)
    (p, n), (u, m) = _above(positive, positives, cuts), _above(unlabelled, unlabelleds, cuts)
    low = p * n / (n + 1) - 2 * np.sqrt(np.maximum(0, p * (1 - p)) / n)
    high = u + 2 * np.sqrt((u + 1 / m) / m) + 2 / m
    ratio = np.where(low > 0, high / np.maximum(low, 1e-12), np.inf)
    best = int(ratio.argmin())
    return float(min(1.0, max(u[best] / p[best], 1 / m) if np.isfinite(ratio[best]) else 1.0))


def threshold(positive: np.ndarray, unlabelled: np.ndarray, positives: np.ndarray | None = None, unlabelleds: np.ndarray | None = None) -> float:
    """The score of least risk: prior · missed positives + max(0, unlabelled above − prior · positives above); above all scores where nothing is gained by any, or no score tells the two apart."""
    prior = class_prior(positive, unlabelled, positives, unlabelleds)
    both = np.unique(np.concatenate([positive, unlabelled]))
    cuts = np.append(both, both[-1] + 1 if len(both) else 0.0)
    if prior >= 1:
        return float(cuts[-1])
    p, u = _above(positive, positives, cuts)[0], _above(unlabelled, unlabelleds, cuts)[0]
    risk = prior * (1 - p) + np.maximum(0, u - prior * p)
    best = len(cuts) - 1 - int(risk[::-1].argmin())
    return float(cuts[best] if best == 0 else (cuts[best] + cuts[best - 1]) / 2)


def _start(confirmed: tuple[int, np.ndarray] | None, unlabelled: tuple[int, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """(weights, whether a feature speaks for a case) by log odds, from the number of texts of both kinds and how many have each feature."""
    if confirmed is None or unlabelled is None:
        return np.zeros(DIM), np.zeros(DIM, bool)
    (n, p), (m, u) = confirmed, unlabelled
    odds = np.log((p + 0.5) / (n + 1)) - np.log((u + 0.5) / (m + 1))
    speaks = (p >= SUPPORT) & (odds >= LEAST_ODDS)
    return np.where(speaks, np.clip(odds, -1, 3), 0.0) * 0.1, speaks


def _learn(pos: _Texts, unl: _Texts, weights: np.ndarray, speaks: np.ndarray, bias: float, prior: float, epochs: int) -> tuple[np.ndarray, float]:
    """(weights, bias) by the non-negative risk: prior·R⁺(P) + max(0, R⁻(U) − prior·R⁻(P)), logistic loss; in each round the worst stretch of a text stands for it. A text may be in P and in U."""
    if not len(pos.has) or not len(unl.has):
        return weights, bias
    learners, most = (_Learner(pos), _Learner(unl)), np.where(speaks, np.inf, 0.0)
    number, met = np.zeros(DIM, np.int64), np.zeros(0, np.int64)
    own, bound, momentum, square = np.zeros((4, 1))  # of the features met by their number; the others have no weight and get none
    square_new, square_b = 1e-8, 1e-8
    features = np.flatnonzero(weights)
    for i in range(epochs + 1):
        fresh = np.unique(features[number[features] == 0])
        number[fresh] = np.arange(len(own), len(own) + len(fresh))
        for x in learners:
            x.meet(fresh, len(own))
        met, own, bound = np.append(met, fresh), np.append(own, weights[fresh]), np.append(bound, most[fresh])
        momentum, square = np.append(momentum, np.zeros(len(fresh))), np.append(square, np.full(len(fresh), square_new))
        if i:  # a step along the stretches of the round before
            grad = np.bincount(number[features], weights=shares, minlength=len(own)) + 1e-6 * own
            momentum = 0.9 * momentum + 0.1 * grad
            square = square * 0.99 + 0.01 * np.square(grad)
            own = np.minimum(own - RATE * momentum / (np.sqrt(square) + 1e-5), bound)
            square_new, square_b = square_new * 0.99, 0.99 * square_b + 0.01 * gb**2
            bias -= RATE * gb / (np.sqrt(square_b) + 1e-5)
        if i == epochs:
            break
        (best_p, block_p), (best_u, block_u) = (x.worst(own) for x in learners)
        sig_p, sig_u = (1 / (1 + np.exp(-np.clip(x + bias, -30, 30))) for x in (best_p, best_u))
        if np.logaddexp(0, best_u + bias).mean() >= prior * np.logaddexp(0, best_p + bias).mean():
            of_p, of_u = np.full(len(sig_p), -prior / len(sig_p)), sig_u / len(sig_u)
        else:
            of_p, of_u = prior * sig_p / len(sig_p), -sig_u / len(sig_u)
        features, shares = (np.concatenate(x) for x in zip(*pos.gradient(block_p, of_p), *unl.gradient(block_u, of_u)))
        gb = of_p.sum() + of_u.sum()
    weights = weights.copy()
    weights[met] = own[1:]
    return weights, float(bias)


def _judged(packs: DataFrame, weights: dict[int, np.ndarray], bias: dict[int, float]) -> tuple[np.ndarray, np.ndarray]:
    """(scores to DECIMALS, how many texts have each) by members that have not seen the texts; that of a text without words is the bias less 10."""
    shared = packs.sparkSession.sparkContext.broadcast((weights, bias))  # a few MB, by DIM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                fold, *cells = [c[i].as_py() for c in batch.columns]
                texts, other = _Pack.texts(*cells), (fold + 1) % MEMBERS
                score = np.full(len(texts.bounds) - 1, -10.0)
                score[texts.has] = texts.worst(weights[other])[0]
                values, counts = np.unique(np.round(score + bias[other], DECIMALS), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts)], names=["score", "n"])

    found = packs.select("fold", *_CELLS).mapInArrow(run, "score double, n bigint").groupBy("score").agg(F.sum("n").alias("n")).toArrow()
    return found.column("score").to_numpy(), found.column("n").to_numpy().astype(float)


@dataclass
class Model:
    """Weights of the hashed features, as positions and values, the bias, the score from which a text counts as a case, and the class prior."""

    at: np.ndarray
    value: np.ndarray
    bias: float
    threshold: float
    prior: float


class _Scorer:
    """Scores texts given as lists of words."""

    def __init__(self, model: Model):
        self.model = model
        self.weights = np.zeros(DIM)
        self.weights[model.at] = model.value
        self.words, self.by_word = Words(), np.zeros(0)

    def scores(self, lists: pa.ListArray) -> np.ndarray:
        """The score of each row; that of a row without words is the bias less 10."""
        if len(self.words.raw) > REMEMBER:
            self.words, self.by_word = Words(), np.zeros(0)
        numbers, bounds = self.words.numbers(lists)
        if len(self.words.features):  # score the new words, then only their scores are kept
            new = np.add.reduceat(self.weights[self.words.features], self.words.starts[:-1])
            self.by_word = np.concatenate([self.by_word, new])
            self.words.features, self.words.starts = np.zeros(0, np.int64), np.zeros(1, np.int64)
        out = np.full(len(bounds) - 1, -10.0)
        if len(numbers):
            starts, rows = _blocks(bounds)
            each = self.by_word[numbers] + self.weights[self.words.pairs(numbers, bounds)]
            np.maximum.at(out, rows, _stretches(np.add.reduceat(each, starts), rows))
        return out + self.model.bias


def _scored(words: DataFrame, model: Model) -> DataFrame:
    """All columns but the last, which is the list of words, and score."""
    shared = words.sparkSession.sparkContext.broadcast(model)  # a few MB at most, by DIM
    keep = words.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for batch in batches:
            for part in sliced(batch, len(keep)):
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(scorer.scores(part.column(len(keep))))], names=[*keep, "score"])

    return words.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in words.dtypes[:-1]) + ", score double")


def judgements(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, raters, least, most, mean of the judgements 0 and 1 of each text; others, and null keys, do not count."""
    known = labels.where(F.col(key).isNotNull() & F.col("offends").isin(0, 1))
    return known.groupBy(key).agg(F.count(F.lit(1)).alias("raters"), F.min("offends").alias("least"), F.max("offends").alias("most"), F.avg("offends").alias("mean"))


def sample(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame | None:
    """role, member, words of the texts to learn from; None if no text is confirmed.

    Confirmed are texts that all of their raters judge as cases, whatever the documents: every HELD-th of
    them, by hash, is held back (role held). Unlabelled texts are drawn by hash from all documents, for each
    member, and for what is held back (role open). Where ids are numbers and there are more than
    CONFIRMED_ROWS confirmed texts, all are drawn from blocks of IDS ids, which the scan then seeks, so
    the sample of a large table is read from few of its files. Texts over FIT_CHARS are not in the
    sample; of a repeated key one text is taken. For a look at what the texts are like: fit takes all of them, not this.
    """
    draw = lambda salt, c=key: F.xxhash64(F.col(c), F.lit(salt))
    rate = lambda h: (h / F.lit(2.0**64)) + 0.5
    confirmed = judgements(labels, key).where(F.col("least") == 1).select(key)
    number = confirmed.count()
    if not number:
        return None
    part = min(1.0, CONFIRMED_ROWS / number)
    numeric = dict(documents.dtypes)[key] in ("tinyint", "smallint", "int", "bigint")
    block = F.floor(F.col(key) / IDS) if numeric else F.xxhash64(F.col(key))
    inside = lambda df: df.where(rate(F.xxhash64(block, F.lit(6))) < part) if part < 1 else df
    chosen = inside(confirmed).orderBy(draw(1)).limit(CONFIRMED_ROWS)
    ranked = chosen.withColumn("_rank", F.row_number().over(Window.orderBy(draw(3))))  # at most CONFIRMED_ROWS rows
    ranked = ranked.select(F.col(key).alias("_key"), (F.col("_rank") % HELD == 1).alias("_held"))
    rows = inside(documents)
    if numeric and part < 1:
        blocks = [r[0] for r in inside(confirmed).select(block.alias("b")).distinct().limit(SOUGHT + 1).collect()]
        if len(blocks) <= SOUGHT:
            rows = rows.where(reduce(or_, [F.col(key).between(b * IDS, b * IDS + IDS - 1) for b in blocks], F.lit(False)))
    share = min(1.0, (MEMBERS * MEMBER_ROWS + OPEN_ROWS) / max(1.0, part * documents.count()))
    texts = rows.where(F.col(text).isNotNull() & (F.length(text) <= FIT_CHARS)).select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    drawn = texts.withColumn("_u", rate(draw(2, "_key")) / share).join(F.broadcast(ranked), "_key", "left").where(F.col("_held").isNotNull() | (F.col("_u") < 1))
    drawn = drawn.groupBy("_key", "_u", "_held").agg(F.min("_text").alias("_text"))
    own = F.floor(F.col("_u") * (MEMBERS * MEMBER_ROWS + OPEN_ROWS) / MEMBER_ROWS).cast("int")
    of = lambda when, role, member: F.when(when, F.struct(F.lit(role).alias("role"), F.lit(member).alias("member")))
    roles = [of(~F.col("_held"), "confirmed", m) for m in range(MEMBERS)] + [of(own == m, "unlabelled", m) for m in range(MEMBERS)]
    roles += [of(F.col("_held"), "held", -1), of((own >= MEMBERS) & (F.col("_u") < 1), "open", -1)]
    return drawn.select(F.explode(F.array_compact(F.array(*roles))).alias("r"), words_of(F.col("_text")).alias("words")).select("r.*", "words")


def _confirmed(documents: DataFrame, labels: DataFrame, key: str, text: str) -> tuple[int, DataFrame]:
    """(number of confirmed keys, _key and _text of the documents that have one); of a repeated key one text is taken."""
    keys = judgements(labels, key).where(F.col("least") == 1).select(F.col(key).alias("_key"))
    number = keys.count()
    rows = documents.where(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return number, rows.join(F.broadcast(keys) if number <= KEYS_SENT else keys, "_key").groupBy("_key").agg(F.min("_text").alias("_text"))


def _learnt(packs: DataFrame, confirmed: DataFrame, start: dict[int, tuple[np.ndarray, np.ndarray]], bias: float, prior: float, epochs: int) -> dict[int, tuple[int, np.ndarray]]:
    """By fold the sum of what the packs learn, weights and bias behind them, each times its texts, beside the sum of texts. packs: with the group of confirmed texts that each learns with."""
    shared = packs.sparkSession.sparkContext.broadcast(start)
    with_ = packs.select("fold", "grp", "texts", *_CELLS).join(confirmed.select("fold", "grp", *[F.col(c).alias(f"p_{c}") for c in _CELLS]), ["fold", "grp"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                fold, texts, *cells = (c[i].as_py() for c in batch.columns)
                weights, speaks = shared.value[fold]
                moved, b = (weights, bias) if cells[-1] is None else _learn(_Pack.texts(*cells[len(_CELLS) :]), _Pack.texts(*cells[: len(_CELLS)]), weights, speaks, bias, prior, epochs)
                known = sums.get(fold, (0, 0.0))
                sums[fold] = known[0] + texts, known[1] + texts * np.append(moved, b)
        for fold, (texts, values) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([fold], pa.int32()), pa.array([texts]), pa.array([values.tobytes()], pa.binary())], names=["fold", "texts", "values"])

    learnt = with_.select("fold", "texts", *_CELLS, *[f"p_{c}" for c in _CELLS]).mapInArrow(run, "fold int, texts bigint, values binary")
    sums = _summed(kept := written(learnt, "learnt"), np.float64)
    dropped(kept)
    return sums


def _turns(groups: pd.DataFrame) -> list[pd.DataFrame]:
    """Rows of fold, grp, texts, file in turns of at most TEXTS_SENT texts, or one group."""
    out, held = [[]], 0
    for row in groups.sort_values(["fold", "grp"]).itertuples(index=False):
        if out[-1] and held + row.texts > TEXTS_SENT:
            out.append([])
            held = 0
        out[-1].append(row)
        held += row.texts
    return [pd.DataFrame(rows, columns=groups.columns) for rows in out]


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), epochs: int = EPOCHS) -> tuple[Model | None, DataFrame | None]:
    """(model from all documents, packs of all documents with key and the columns keep, for scored); None twice if no text is confirmed.

    Confirmed are texts that all of their raters judge as cases. A member has the texts of a fold, by hash of the key: it starts from
    the log odds of features over all of them; packs of them learn from there, each with the confirmed texts of the fold or a group
    of these, and the member is the mean of its packs. The class prior and the threshold come from the scores of
    all texts, each judged by the member that has not seen it. A single confirmed text teaches nothing, and nothing offends then.
    """
    fold = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(1)), F.lit(MEMBERS)).cast("int").alias("fold")
    number, texts = _confirmed(documents, labels, key, text)
    if not number:
        return None, None
    rows = spread(documents.select(F.struct(key, *keep).alias("kept"), F.col(key).alias("_key"), F.col(text).alias("_text")))
    packs = written(_packed(rows.select(fold("_key"), F.lit(-1).alias("grp"), "kept", F.col("_text").cast("string"))), "packs", 1)
    texts = written(texts.select("_key", fold("_key"), words_of(F.col("_text")).alias("words")), "confirmed")
    ids = packs.select("fold", "pack", F.input_file_name().alias("file")).toPandas().sort_values(["fold", "pack"])  # a row for some MB of texts
    have = {r["fold"]: r["count"] for r in texts.groupBy("fold").count().collect()}
    groups = {m: max(1, min(int((ids["fold"] == m).sum()), -(-have.get(m, 0) // PACK_CONFIRMED))) for m in range(MEMBERS)}
    of = F.pmod(F.xxhash64("_key", F.lit(2)), F.array(*[F.lit(groups[m]) for m in range(MEMBERS)])[F.col("fold")]).cast("int").alias("grp")
    confirmed = written(_packed(texts.select("fold", of, F.struct("_key").alias("kept"), "words").repartition("fold", "grp")), "confirmed_packs", 1)

    counted = [_summed(t.select("fold", "texts", "counts"), np.int32) for t in (confirmed, packs)]
    start = {m: _start(*[c.get(m) for c in counted]) for m in range(MEMBERS)}
    judged = lambda weights, bias: [x for both in zip(*[_judged(t, weights, bias) for t in (confirmed, packs)]) for x in both]
    scores = judged({m: w for m, (w, _) in start.items()}, dict.fromkeys(start, 0.0))
    prior, bias = class_prior(*scores), -threshold(*scores)

    ids["grp"] = ids.groupby("fold").cumcount() % ids["fold"].map(groups)
    learnt: dict[int, tuple[int, np.ndarray]] = {}
    turns = _turns(confirmed.select("fold", "grp", "texts", F.input_file_name().alias("file")).toPandas())
    for k, turn in enumerate(turns):  # packs stay where they are, their confirmed texts are sent to them
        now = set(zip(turn["fold"], turn["grp"]))
        own = ids[[(f, g) in now or (k == 0 and not have.get(f)) for f, g in zip(ids["fold"], ids["grp"])]]
        if not len(own):
            continue
        read = packs.sparkSession.read.schema
        some, sent = (packs, confirmed) if len(turns) == 1 else (read(packs.schema).parquet(*own["file"]), read(confirmed.schema).parquet(*turn["file"]))
        at = packs.sparkSession.createDataFrame([(int(p), int(g)) for p, g in zip(own["pack"], own["grp"])], "pack bigint, grp int")
        for m, (n, values) in _learnt(some.drop("grp").join(F.broadcast(at), "pack"), F.broadcast(sent), start, bias, prior, epochs).items():
            known = learnt.get(m, (0, 0.0))
            learnt[m] = known[0] + n, known[1] + values
    member = {m: learnt[m][1] / learnt[m][0] if learnt.get(m, (0,))[0] else np.append(start[m][0], bias) for m in range(MEMBERS)}
    scores = judged({m: x[:-1] for m, x in member.items()}, {m: float(x[-1]) for m, x in member.items()})
    dropped(texts, confirmed)
    mean = sum(member.values()) / MEMBERS
    at = np.flatnonzero(mean[:-1])
    return Model(at, mean[at], float(mean[-1]), threshold(*scores), prior), packs


def scored(packs: DataFrame, model: Model) -> DataFrame:
    """score of the documents that the model is fitted to, from what fit has kept of them."""
    shared = packs.sparkSession.sparkContext.broadcast(model)
    fields = packs.select(F.explode("kept").alias("k")).select("k.*").dtypes
    names = [n for n, _ in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(DIM)
        weights[shared.value.at] = shared.value.value
        for batch in batches:
            for i in range(batch.num_rows):
                kept, texts = batch.column(0)[i].values, _Pack.texts(*[c[i].as_py() for c in batch.columns[1:]])
                score = np.full(len(kept), -10.0)
                score[texts.has] = texts.worst(weights)[0]
                yield pa.RecordBatch.from_arrays([*kept.flatten(), pa.array(score + shared.value.bias)], names=[*names, "score"])

    rows = packs.select("kept", *_CELLS).mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in fields) + ", score double")
    return rows.withColumn("offends", F.col("score") >= model.threshold)


def score(documents: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns keep, score (greater is worse) and offends of every text by a model of fit.

    Null and empty texts have the least score and do not offend. Without a model every score is null and nothing offends.
    """
    if model is None:
        return documents.select(key, *keep, F.lit(None).cast("double").alias("score"), F.lit(False).alias("offends"))
    rows = spread(documents.select(key, *keep, F.col(text).alias("_text")))
    scored = _scored(rows.select(key, *keep, words_of(F.col("_text")).alias("_words")), model)
    return scored.withColumn("offends", F.col("score") >= model.threshold)


def abuse_scores(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """score by a model that is fitted to these documents.

    If no judged text is confirmed, or there are no labels, every score is null and nothing offends. Repeated rows come
    out as often as they occur; an empty table gives no row.
    """
    model, packs = fit(documents, labels, key, text, keep)
    return score(documents, None, key, text, keep) if model is None else scored(packs, model)


def abuse_rates(scored: DataFrame, source: str = "source") -> DataFrame:
    """source, documents, offending, rate; a null source is a source."""
    return scored.groupBy(source).agg(F.count(F.lit(1)).alias("documents"), F.count_if("offends").alias("offending")).withColumn("rate", F.round(F.col("offending") / F.col("documents"), 6))
