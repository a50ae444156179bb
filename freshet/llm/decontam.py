"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm import textarrays as ta
from freshet.llm.shared import by_value, documents

# Fingerprints of 64 bits in 8 blocks. A window at the threshold differs in about 10 bits
# (deviation 3); within radius 20 some block differs in at most 2 bits (8 * 3 > 20).
RADIUS = 20
BLOCKS = 8
# Words that the running sums of signs span at a time.
SPAN = 8192


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    words: int = 5,
    percent: int = 80,
    max_items: int = 100_000,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity) of each item that a document holds.

    Texts are lowered, ASCII punctuation is taken out, words are split at ASCII white space.
    An item's shingles have `words` words, weighted by rarity among the items (a shingle no
    item has weighs most); an item of fewer words is one shingle. A window has as many words
    as the item. similarity is the weighted Jaccard coefficient of the two multisets, and a
    document is reported with its best window (the first of equals) at percent / 100 or more.

    Method. Windows are taken for every length that items have. One can only be similar enough
    if its shingles that some item holds weigh percent / 100 of the lightest item of its length;
    all others are passed over, so ordinary text is hardly ever fingerprinted. The SimHash of
    each window left is looked up in blocks: two fingerprints within RADIUS agree in some block
    up to 2 bits, so the union over blocks holds all items within the radius, in whatever order
    their words stand. These candidates are verified exactly. Documents are never shuffled: the
    benchmark's arrays go to all tasks (some 300 bytes an item besides its shingles), after
    max_items has bounded their number (more items raise ValueError).

    Edge cases: null or empty texts and items match nothing; equal items are reported each;
    a repeated document row is reported for each row; a null doc_id is reported as null;
    other columns are not read. Empty tables give an empty result.
    """
    sent = _sent(benchmark, words, max_items, item_id, item_text)
    source = docs.select(F.col(doc_id).cast("long"), F.col(text))
    schema = "doc_id long, item_id long, start_word long, n_words long, similarity double"
    return source.mapInArrow(_searcher(sent, words, percent), schema)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    words: int = 5,
    percent: int = 80,
    max_items: int = 100_000,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """The rows of docs that hold no benchmark item, all columns as they are, without a shuffle.

    Each row is judged by its own text, as in leaks(): no id is read.
    """
    search = _searcher(_sent(benchmark, words, max_items, item_id, item_text), words, percent)

    def run(batches):
        for batch in batches:
            kept = np.ones(batch.num_rows, bool)
            place = pa.array(np.arange(batch.num_rows))
            own = pa.record_batch([place, batch.column(batch.schema.get_field_index(text))], names=["doc_id", "text"])
            for found in search([own]):
                kept[found.column(0).to_numpy()] = False
            # The kept rows leave a few at a time, so a task never holds their texts twice.
            for lo, hi, _, _ in ta.chunks(own.column(1)):
                yield batch.slice(lo, hi - lo).filter(pa.array(kept[lo:hi]))
        ta.release()

    return docs.mapInArrow(run, docs.schema)


def _sent(benchmark: DataFrame, words: int, max_items: int, item_id: str, item_text: str):
    """The prepared items as a broadcast."""
    rows = benchmark.select(F.col(item_id).cast("long"), F.col(item_text)).limit(max_items + 1).toArrow()
    if rows.num_rows > max_items:
        raise ValueError(f"the benchmark has more than {max_items} items; search it in parts")
    return benchmark.sparkSession.sparkContext.broadcast(_prepare(rows, words))


def _lowered(texts) -> pa.Array:
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    return pc.utf8_lower(texts.fill_null(""))


def _prepare(rows: pa.Table, words: int) -> dict:
    """The items' shingles, weights and fingerprints, and for each length what is near to which."""
    ids, sets = [], []
    for lo, _, data, offsets in ta.chunks(_lowered(rows.column(1))):
        w = ta.Words(data, offsets, lower=True, strip=True)
        row, value = ta.shingles(w, words)
        n = w.counts()
        order = np.argsort(row, kind="stable")
        row, value = row[order], value[order]
        for r in np.flatnonzero(n):
            i = rows.column(0)[lo + int(r)].as_py()
            ids.append(i)
            sets.append((int(n[r]), value[row == r]))
    seen = Counter(h for _, s in sets for h in set(s.tolist()))
    rare = {h: _weight(len(sets), c) for h, c in seen.items()}
    top = _weight(len(sets), 0)
    known = np.array(sorted(rare), np.uint64)
    weight = np.array([rare[h] for h in known.tolist()], np.int64)
    prints = np.array([_simhash(s, known, weight, top) for _, s in sets], np.uint64)
    by_length: dict[int, list[int]] = {}
    for k, (n, _) in enumerate(sets):
        by_length.setdefault(n, []).append(k)
    near = np.array([bin(x).count("1") <= RADIUS // BLOCKS for x in range(256)])
    index = {}
    for n, group in by_length.items():
        blocks = prints[group].view(np.uint8).reshape(len(group), BLOCKS)
        # For each block, which of 256 values leads to which item of this length.
        table = np.stack([np.packbits(near[np.arange(256)[:, None] ^ blocks[:, i]], axis=1) for i in range(BLOCKS)])
        least = min(int(_weights(sets[k][1], known, weight, top).sum()) for k in group)
        index[n] = (np.array(group), table, least)
    # A filter of a few bits a shingle goes before the sorted search.
    bits = 12
    while (1 << bits) < 32 * max(1, len(known)):
        bits += 1
    sieve = np.zeros(1 << bits, bool)
    sieve[known & np.uint64((1 << bits) - 1)] = True
    return {
        "ids": ids, "sets": sets, "known": known, "weight": weight, "top": top, "prints": prints, "index": index,
        "sieve": sieve, "mask": np.uint64((1 << bits) - 1), "short": sorted({n for n, _ in sets if n < words}),
    }


def _weight(n: int, c: int) -> int:
    """Rarity in sixteenths: log2 of (n + 1) / (c + 1), one at least."""
    return 16 + int(16 * np.log2((n + 1) / (c + 1)))


def _weights(values: np.ndarray, known: np.ndarray, weight: np.ndarray, top: int) -> np.ndarray:
    if not len(known):
        return np.full(len(values), top, np.int64)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, weight[at], top)


def _signs(values: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(ta.mix(values ^ np.uint64(0x452821E638D01377)).view(np.uint8).reshape(len(values), 8), axis=1)
    return bits.astype(np.int64) * 2 - 1


def _simhash(values, known, weight, top) -> np.uint64:
    total = (_signs(values) * _weights(values, known, weight, top)[:, None]).sum(0)
    return np.packbits(total > 0).view(np.uint64)[0]


def _similarity(a: np.ndarray, b: np.ndarray, items: dict) -> float:
    """Weighted Jaccard coefficient of two multisets of shingles."""
    values, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    ca, cb = (np.bincount(x, minlength=len(values)) for x in (at[: len(a)], at[len(a) :]))
    w = _weights(values, items["known"], items["weight"], items["top"])
    return float((np.minimum(ca, cb) * w).sum() / (np.maximum(ca, cb) * w).sum())


def _searcher(sent, words: int, percent: int):
    def anchors(w, items):
        """(position, item, offset) of every shingle that an item shares."""
        found = []
        for k in [words, *[n for n in items["short"]]]:
            rows = w.row_of()
            if k == words:
                values = ta.runs_of(w.hash, k)
                inside = rows[: len(values)] == rows[k - 1 :] if len(values) else np.zeros(0, bool)
            else:  # an item of fewer words is one shingle of all of them
                m = max(0, len(w.hash) - k + 1)
                values = np.full(m, k, np.uint64)
                for i in range(k):
                    values = values * np.uint64(ta._BASE) + w.hash[i : i + m]
                values = ta.mix(values)
                inside = rows[:m] == rows[k - 1 :] if m else np.zeros(0, bool)
            hit = np.flatnonzero(items["sieve"][values & items["mask"]] & inside)
            at = np.minimum(np.searchsorted(items["known"], values[hit]), len(items["known"]) - 1)
            good = items["known"][at] == values[hit]
            found.append((k, values, hit[good], at[good]))
        return found

    def search(batches):
        items = sent.value
        if not items["ids"]:
            return
        for batch in batches:
            ids, out = batch.column(0), []
            for lo, _, data, offsets in ta.chunks(_lowered(batch.column(1))):
                w = ta.Words(data, offsets, lower=True, strip=True)
                rows, best = w.row_of(), {}
                for k, values, position, shingle in anchors(w, items):
                    if not len(position):
                        continue
                    sums = np.append(0, np.cumsum(items["weight"][shingle]))
                    for size in [n for n in items["index"] if (n >= words if k == words else n == k)]:
                        starts, spans = windows(w, rows, position, sums, size, k, percent * items["index"][size][2])
                        for i, s, similarity in matches(values, starts, spans, size, items):
                            key = int(rows[s]), i
                            if key not in best or (similarity, -s) > (best[key][1], -best[key][0]):
                                best[key] = s, similarity
                for (r, i), (s, similarity) in sorted(best.items()):
                    out.append((lo + r, i, s - int(w.rows[r]), items["sets"][i][0], similarity))
            yield pa.record_batch(
                [
                    ids.take(pa.array([o[0] for o in out], pa.int64())),
                    pa.array([items["ids"][o[1]] for o in out], pa.int64()),
                    *(pa.array([o[j] for o in out], t) for j, t in ((2, pa.int64()), (3, pa.int64()), (4, pa.float64()))),
                ],
                names=["doc_id", "item_id", "start_word", "n_words", "similarity"],
            )

    def windows(w, rows, position, sums, size, k, need):
        """(starts, shingles) of all windows whose shared shingles weigh `need` hundredths or more.

        position has the places of shared shingles, sums their running weights. Windows that
        begin behind one place and not behind the next hold at most what lies within a window's
        length of the latter, so only places that pass are looked at one start at a time.
        """
        first, count = w.rows[rows[position]], w.counts()[rows[position]]
        # A text shorter than the item is one window.
        span = np.minimum(size, count) - k + 1
        last_start = first + np.maximum(0, count - size)
        ahead = sums[np.searchsorted(position, position + span)] - sums[:-1]
        before = np.append(-1, position[:-1])
        low = np.maximum(np.maximum(before + 1, position - span + 1), first)
        high = np.minimum(position, last_start)
        good = np.flatnonzero((100 * ahead >= need) & (low <= high) & (span > 0))
        n = high[good] - low[good] + 1
        starts = np.repeat(low[good] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        spans = np.repeat(span[good], n)
        held = sums[np.searchsorted(position, starts + spans)] - sums[np.searchsorted(position, starts)]
        full = 100 * held >= need
        return starts[full], spans[full]

    def matches(values, starts, spans, size, items):
        """(item, start, similarity) of each verified window; the sums span SPAN words and a window at a time."""
        group, table, _ = items["index"][size]
        at = 0
        while at < len(starts):
            end = int(np.searchsorted(starts, starts[at] + SPAN))
            s, m = starts[at:end], spans[at:end]
            at, base = end, int(s[0])
            part = values[base : int((s + m).max())]
            signs = _signs(part) * _weights(part, items["known"], items["weight"], items["top"])[:, None]
            sums = np.zeros((len(part) + 1, 64), np.int64)
            np.cumsum(signs, axis=0, out=sums[1:])
            prints = np.packbits(sums[s - base + m] - sums[s - base] > 0, axis=1)
            near = np.zeros((len(s), table.shape[2]), np.uint8)
            for block in range(BLOCKS):
                near |= table[block, prints[:, block]]
            for byte in np.flatnonzero(near.any(0)):
                window, bit = np.nonzero(np.unpackbits(near[:, byte][:, None], axis=1))
                item = group[np.minimum(8 * byte + bit, len(group) - 1)]
                apart = np.bitwise_count(prints.view(np.uint64)[window, 0] ^ items["prints"][item])
                for j, i in zip(window[apart <= RADIUS].tolist(), item[apart <= RADIUS].tolist()):
                    similarity = _similarity(part[s[j] - base : s[j] - base + m[j]], items["sets"][i][1], items)
                    if 100 * similarity >= percent - 1e-9:
                        yield i, int(s[j]), similarity

    return search


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op6_decontamination": op6}
# Every window of every length against every item is no SQL for whole tables; see the brute-force test.
SQL: dict[str, str] = {}

by_value(__name__)
