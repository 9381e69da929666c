"""Token ids of every text by a public byte-level BPE vocabulary (problem 6).

Spark cuts the texts into words with the vocabulary's pattern. Each task then encodes the words
that it has not met yet: longest matches are proposed from left to right, every adjacent pair of
proposed tokens is checked for whether merging could have left it standing, and only words with a
failing pair are merged step by step. A row of tokens is the BPE encoding of its bytes if and
only if each adjacent pair is the encoding of the pair's bytes.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .slices import sliced

TOKENIZER_DIR = "/opt/tokenizers"
#: The pattern of the vocabularies, with the white space of Unicode (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"
#: Words that a worker remembers, and the longest of them in bytes; others are encoded anew each time.
REMEMBER, LONGEST = 400_000, 64
_NONE = np.iinfo(np.int64).max


class Vocabulary:
    """Ranks of a byte-level BPE, with the two parts of each merged token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest: dict[bytes, int] = {}
        size = max(ranks.values()) + 1
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        for token, rank in ranks.items():
            head = token[:2]
            self.longest[head] = max(self.longest.get(head, 0), len(token))
            if len(token) > 1:
                a, b = self.parts(token, rank)
                self.left[rank], self.right[rank] = a, b
        merged = np.flatnonzero(self.left >= 0)
        keys = self.left[merged] << 32 | self.right[merged]
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], merged[order]

    def parts(self, token: bytes, below: int) -> tuple[int, int]:
        """The two tokens that the last merge of a token joins."""
        pieces = [token[i : i + 1] for i in range(len(token))]
        while len(pieces) > 2:
            options = [self.ranks.get(pieces[i] + pieces[i + 1], below) for i in range(len(pieces) - 1)]
            i = min(range(len(options)), key=options.__getitem__)
            if options[i] >= below:
                return -1, -1
            pieces[i : i + 2] = [pieces[i] + pieces[i + 1]]
        return self.ranks[pieces[0]], self.ranks[pieces[1]]

    def propose(self, word: bytes) -> list[int]:
        """Longest matches from left to right."""
        ids, at, end, ranks = [], 0, len(word), self.ranks
        while at < end:
            for to in range(min(end, at + self.longest.get(word[at : at + 2], 1)), at, -1):
                rank = ranks.get(word[at:to])
                if rank is not None:
                    ids.append(rank)
                    at = to
                    break
        return ids

    def _merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], _NONE)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves each pair of tokens apart.

        The two tokens are taken apart from the newest merge to the oldest, which shows each
        pair of neighbours that ever met at the border. If such a pair merges before either
        neighbour went into a larger token, the border would not have lasted; of equal ranks the
        left one goes first.
        """
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.copy(), b.copy()
        over_a, over_b = np.full(len(a), _NONE), np.full(len(a), _NONE)
        while len(live):
            rank = self._merge_rank(a, b)
            bad = (rank < over_a) & (rank <= over_b) & (rank != _NONE)
            good[live[bad]] = False
            split_a, split_b = self.left[a] >= 0, self.left[b] >= 0
            stays = ~bad & (split_a | split_b)
            live, a, b, over_a, over_b, split_a, split_b = (x[stays] for x in (live, a, b, over_a, over_b, split_a, split_b))
            undo_a = split_a & (~split_b | (a > b))
            over_a, over_b = np.where(undo_a, a, over_a), np.where(undo_a, over_b, b)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return good

    def merge(self, word: bytes) -> list[int]:
        """Exact merging, lowest rank first, leftmost of equals; n log n in the length."""
        ids: list[int] = [self.ranks[word[i : i + 1]] for i in range(len(word))]
        starts = list(range(len(word))) + [len(word)]
        after = list(range(1, len(word) + 1))
        before = list(range(-1, len(word) - 1))
        alive = [True] * len(word)
        end = {i: i + 1 for i in range(len(word))}
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(word):
                rank = self.ranks.get(word[starts[i] : end[j]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, j, end[j]))

        for i in range(len(word) - 1):
            offer(i)
        while heap:
            rank, i, j, stop = heapq.heappop(heap)
            if not (alive[i] and j < len(word) and alive[j] and after[i] == j and end[j] == stop and self.ranks.get(word[starts[i] : stop]) == rank):
                continue
            alive[j] = False
            ids[i], end[i], after[i] = rank, stop, after[j]
            if after[i] < len(word):
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [ids[i] for i in range(len(word)) if alive[i]]

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word."""
        out = [[self.ranks[w]] if w in self.ranks else self.propose(w) for w in words]
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        flat = np.fromiter((t for ids in out for t in ids), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(out)), sizes)
        pair = np.flatnonzero(owner[1:] == owner[:-1])
        failed = owner[pair][~self.compatible(flat[pair], flat[pair + 1])]
        for i in np.unique(failed):
            out[i] = self.merge(words[i])
        return out


@functools.lru_cache(maxsize=4)
def _ranks(name: str, folder: str) -> bytes:
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return f.read()


@functools.lru_cache(maxsize=4)
def vocabulary(file: bytes) -> Vocabulary:
    """The vocabulary of a rank file (lines of base64 token and rank); kept by each worker."""
    return Vocabulary({base64.b64decode(t): int(r) for t, r in map(bytes.split, file.splitlines())})


class _Encoder:
    """Encodes lists of words with a memory of those met before."""

    def __init__(self, file: bytes):
        self.vocabulary = vocabulary(file)
        self.known: dict[bytes, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.starts = np.zeros(1, np.int64)

    def rows(self, words: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows in order, ids per row)."""
        offsets = words.offsets.to_numpy().astype(np.int64)
        coded = words.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode() if len(words.values) else None
        if coded is None or not len(coded):
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        fresh = coded.dictionary.cast(pa.binary()).to_pylist()
        if len(self.known) > REMEMBER:
            self.known, self.ids, self.starts = {}, np.zeros(0, np.int32), np.zeros(1, np.int64)
        new = [w for w in fresh if w not in self.known]
        if new:
            done = self.vocabulary.encode(new)
            sizes = np.fromiter(map(len, done), np.int64, len(done))
            self.known.update(zip(new, range(len(self.starts) - 1, len(self.starts) - 1 + len(new))))
            self.ids = np.concatenate([self.ids, np.fromiter((t for x in done for t in x), np.int32, int(sizes.sum()))])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        place = np.fromiter((self.known[w] for w in fresh), np.int64, len(fresh))[coded.indices.to_numpy(zero_copy_only=False)]
        sizes = self.starts[place + 1] - self.starts[place]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(self.starts[place] - ends[:-1], sizes) + np.arange(ends[-1])]
        bounds = ends[offsets - offsets[0]]
        for w in [w for w in new if len(w) > LONGEST]:  # rare long words don't stay
            self.known.pop(w)
        return ids, np.diff(bounds)


def words_of(text: Column) -> Column:
    """The words of a text by the pattern; none for null and empty texts."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), F.array().cast("array<string>"))


def _apply(df: DataFrame, key: str, text: str, out: str, kind: str, make, tokenizer: str, folder: str) -> DataFrame:
    file = df.sparkSession.sparkContext.broadcast(_ranks(tokenizer, folder))  # under 1 MB, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder(file.value)
        for batch in batches:
            for part in sliced(batch, 1):
                ids, sizes = encoder.rows(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), make(ids, sizes)], names=[key, out])

    return spread(df.select(F.col(key), F.col(text).alias("_text"))).select(F.col(key), words_of(F.col("_text")).alias("_words")).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, `{out}` {kind}")


def token_ids(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """key and ids (ARRAY<INT>) of every row; strings that look like special tokens are plain text.

    Null and empty texts have an empty list, a null key stays, repeated rows come out as often as
    they occur, and an empty table gives no row. tokenizer: a rank file NAME.tiktoken in folder,
    read by the driver and sent to the executors.
    """
    make = lambda ids, sizes: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(ids, pa.int32()))
    return _apply(df, key, text, "ids", "array<int>", make, tokenizer, folder)


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """key and n_tokens (BIGINT) of every row; see token_ids."""
    return _apply(df, key, text, "n_tokens", "bigint", lambda ids, sizes: pa.array(sizes, pa.int64()), tokenizer, folder)


def decoded(ids: DataFrame, key: str = "doc_id", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """key and text, as bytes, of every row of token ids: the inverse of token_ids; an empty or null list gives no bytes."""
    file = ids.sparkSession.sparkContext.broadcast(_ranks(tokenizer, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = vocabulary(file.value).ranks
        table: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        tokens = pa.array(table, pa.binary())
        for batch in batches:
            for part in sliced(batch, 1):
                lists = part.column(1)
                bounds = lists.offsets.to_numpy()
                held = tokens.take(lists.values.slice(bounds[0], bounds[-1] - bounds[0]))
                rows = pa.ListArray.from_arrays(pa.array(bounds - bounds[0], pa.int32()), held)
                yield pa.RecordBatch.from_arrays([part.column(0), pc.binary_join(rows, pa.scalar(b"", pa.binary()))], names=[key, "text"])

    return ids.select(key, "ids").mapInArrow(run, f"`{key}` {dict(ids.dtypes)[key]}, text binary")
