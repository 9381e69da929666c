"""Words of many texts at once, as abuse.words_of cuts them, in arrays inside of a task: one pass over signs instead of a match by word."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Kinds of signs: letters, numbers, signs without width, the star, which is part of words and stands between letters, what else is part of words, what else stands between letters, all others.
LETTER, NUMBER, HIDDEN, STAR, PART, BETWEEN, OTHER = b"a0h*m -"
#: abuse.WORD over kinds.
KINDS = re.compile(rb"(?<![a0])ah*(?:[ *]ah*(?![a0]))+|[a0h*m]{1,40}")
#: The longest word; texts, and their bytes, that are cut at once, beyond which a text is cut alone.
LONGEST, ROWS, BYTES = 40, 2_000, 2_000_000


@cache
def _kinds(hidden: str) -> np.ndarray:
    """The kind of every code point."""
    of = {"L": LETTER, "N": NUMBER, "M": PART}
    out = np.fromiter((of.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    for signs, kind in ((" .-_", BETWEEN), ("@$%#!", PART), ("*", STAR), (hidden, HIDDEN)):
        out[[ord(c) for c in signs]] = kind
    return out


def cut(texts: list[bytes | None], hidden: str) -> pa.ListArray:
    """The words of each text (UTF-8), in order; none for null."""
    decoded = [(x or b"").decode("utf-8", "replace") for x in texts]
    whole = "\n" + "\n".join(decoded) + "\n\n\n"
    signs = np.frombuffer(whole.encode("utf-32-le"), "<u4")
    kinds = np.take(_kinds(hidden), signs)
    letter, between = kinds == LETTER, (kinds == BETWEEN) | (kinds == STAR)
    other, known = kinds == OTHER, letter | (kinds == NUMBER)
    inside = np.concatenate([~(other | (kinds == BETWEEN)), [False]]).view(np.int8)
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1) + 1, np.flatnonzero(edges == -1) + 1
    # between two other signs words are runs, unless letters may be written apart or a run is longer than a word
    apart = letter[1:-1] & ~known[:-2]
    apart &= (kinds == HIDDEN)[2:] | (between[2:] & np.concatenate([letter[3:], [False]]) & ~np.concatenate([known[4:], [False, False]]))
    odd = np.concatenate([np.flatnonzero(apart) + 1, starts[ends - starts > LONGEST]])
    if len(odd):
        stops = np.flatnonzero(other)
        segment = np.cumsum(other, dtype=np.int32)
        some = np.unique(segment[odd])
        matched = np.zeros(len(stops) + 1, bool)
        matched[some] = True
        plain = ~matched[segment[starts]]
        kinds = kinds.tobytes()
        found = np.array([m.span() for lo, hi in zip(stops[some - 1].tolist(), stops[some].tolist()) for m in KINDS.finditer(kinds, lo + 1, hi)], np.int64).reshape(-1, 2)
        starts, ends = np.concatenate([starts[plain], found[:, 0]]), np.concatenate([ends[plain], found[:, 1]])
        order = np.argsort(starts, kind="stable")
        starts, ends = starts[order], ends[order]
    sizes = np.fromiter(map(len, decoded), np.int64, len(decoded)) + 1
    rows = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]) + 1)
    data = np.frombuffer(whole.encode(), np.uint8)
    if len(data) > len(signs):
        width = 1 + (signs >= 0x80).astype(np.int64) + (signs >= 0x800) + (signs >= 0x10000)
        place = np.concatenate([[0], np.cumsum(width)])
        starts, ends = place[starts], place[ends]
    mark = np.zeros(len(data), np.int8)
    mark[starts] += 1
    mark[ends] -= 1
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[np.cumsum(mark, dtype=np.int8).view(bool)].tobytes()))
    return pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), words)


def listed(batch: pa.RecordBatch, column: int, hidden: str) -> Iterator[tuple[pa.RecordBatch, pa.ListArray]]:
    """(rows, their words) of a batch, in slices that are bounded by their bytes; column: the number of the column of texts."""
    texts = batch.column(column).cast(pa.binary())
    bounds = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))])
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(bounds, bounds[at] + BYTES, side="right")) - 1
        end = max(at + 1, min(end, at + ROWS, batch.num_rows))
        yield batch.slice(at, end - at), cut(texts.slice(at, end - at).to_pylist(), hidden)
        at = end
