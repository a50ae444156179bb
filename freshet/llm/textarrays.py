"""Words and word hashes of an Arrow text column as numpy arrays, a few MB at a time."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

from freshet.llm.shared import by_value

CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64)
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_POWERS: dict[str, np.ndarray] = {}


def release() -> None:
    """Gives memory that a task has freed back to the system: a worker lives on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64; a worker keeps those of a chunk."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        made = []
        size = max(n, CHUNK_BYTES + 1)
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps, dtype=np.uint64))
        if size > CHUNK_BYTES + 1:
            return made[0], made[1]
        _POWERS["up"], _POWERS["down"] = made
    return _POWERS["up"], _POWERS["down"]


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES):
    """(first row, end row, bytes, row offsets) of runs of rows of about `limit` bytes.

    A longer text forms a run by itself. A null text is empty.
    """
    if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type):
        kind, binary = np.int64, pa.large_binary()
    else:
        kind, binary = np.int32, pa.binary()
    texts = texts.cast(binary)
    n = len(texts)
    if not n:
        return

    def parts():
        _, offsets, data = texts.buffers()
        return np.frombuffer(offsets, kind)[texts.offset : texts.offset + n + 1].astype(np.int64), data

    offsets, data = parts()
    # A null without bytes, as Spark sends it, is empty as it stands: only others make a copy.
    if texts.null_count and np.diff(offsets)[texts.is_null().to_numpy(zero_copy_only=False)].any():
        texts = texts.fill_null(b"")
        offsets, data = parts()
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


class Words:
    """Words of some texts: start and end byte, hash; rows holds each text's first word.

    lower folds A-Z; strip takes ASCII punctuation out first, so positions are those of the
    text without it.
    """

    def __init__(
        self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, strip: bool = False, hashes: bool = True
    ):
        if lower:
            data = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
        if strip:
            stays = ~_PUNCTUATION[data]
            before = np.zeros(len(data) + 1, np.int64)
            np.cumsum(stays, out=before[1:])
            data, offsets = data[stays], before[offsets]
        self.data, self.offsets = data, offsets
        inside = np.zeros(len(data) + 1, bool)
        inside[:-1] = (data != 32) & ((data < 9) | (data > 13))
        self.inside = inside[:-1]
        first = inside[:-1].copy()
        first[1:] &= ~inside[:-2]
        edge = offsets[(offsets > 0) & (offsets < len(data))]
        first[edge] |= inside[edge]
        self.start = np.flatnonzero(first)
        last = inside[:-1] & ~inside[1:]
        last[edge - 1] |= inside[edge - 1]
        self.end = np.flatnonzero(last) + 1
        self.rows = np.searchsorted(self.start, offsets)
        if hashes:
            self.hash = span_hashes(data, self.start, self.end)

    def counts(self) -> np.ndarray:
        return np.diff(self.rows)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts())


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes from start to end, equal for equal bytes wherever they stand.

    Spans are in order. Those of a long text are taken some at a time: what is held does not
    grow with the text, only with its longest span.
    """
    out = np.zeros(len(start), np.uint64)
    at = 0
    while at < len(start):
        stop = max(at + 1, int(np.searchsorted(end, start[at] + CHUNK_BYTES, "right")))
        base = int(start[at])
        piece = data[base : int(end[stop - 1])]
        up, down = _powers(len(piece) + 1)
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_TABLE[piece] * up[: len(piece)], out=sums[1:])
        a, b = start[at:stop] - base, end[at:stop] - base
        out[at:stop] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        at = stop
    return out


def runs_of(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words by its first word; runs may cross rows, see within()."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for i in range(1, k):
        out *= np.uint64(_BASE)
        out += hashes[i : i + n]
    return mix(out)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of all k-word shingles; a text of 1 to k-1 words has one: all its words."""
    n, rows = words.counts(), words.row_of()
    full = runs_of(words.hash, k)
    keep = np.flatnonzero(rows[: len(full)] == rows[k - 1 :]) if len(full) else np.zeros(0, np.int64)
    row, value = rows[keep], full[keep]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        extra = []
        for r in short:
            h = np.uint64(n[r])
            for w in words.hash[words.rows[r] : words.rows[r + 1]]:
                with np.errstate(over="ignore"):
                    h = h * np.uint64(_BASE) + w
            extra.append(h)
        row = np.concatenate([row, short])
        value = np.concatenate([value, mix(np.array(extra, np.uint64))])
    return row, value


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first position by row, values): each text's distinct shingles, ascending."""
    row, value = shingles(words, k)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    if len(row):
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
        row, value = row[new], value[new]
    return np.searchsorted(row, np.arange(len(words.offsets))), value


by_value(__name__)
