"""Phrase collocations: n-grams counted in HAT-tries whose subtrees spill as sorted runs."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm import textarrays as ta
from freshet.llm.shared import Stage, by_value, documents

# Fixed values of the contract: what ends a piece, the least count, the longest phrase.
BREAKS = b".,;:!?\n\x0b\x0c\r"
LEAST, LONGEST = 30, 4
# Bytes of text counted at a time.
CHUNK = 4 << 20
# Rows of one Arrow batch of sorted runs.
BATCH = 20_000
# Bits of the filter of frequent phrases, two set by each: 8 MB at every size of the input.
FILTER_BITS = 26
# A prefix that starts this share of all words is hot: one word more goes into its partition key.
HOT_SHARE = 1024

_BREAK = np.zeros(256, bool)
_BREAK[list(BREAKS)] = True


class HatTrie:
    """Counts of paths of word numbers, in hash containers below a shallow trie.

    Inner nodes go by one word number and hold the language and all words of a path but the last
    two. Below them a container is a dict from the last words, packed into one number, to their
    count; one of more than `burst` entries bursts into a node with a container for each next
    word. spill() takes whole subtrees out as sorted runs, the largest first.
    """

    def __init__(self, burst: int = 4096):
        self.burst = burst
        self.clear()

    def clear(self) -> None:
        # Containers by path; None marks a path whose container has burst.
        self.below: dict[tuple[int, ...], dict[int, int] | None] = {}
        self.size = self.bytes = 0
        self.numbers: dict[bytes, int] = {}
        self.words: list[bytes] = []

    def number(self, words: list[bytes]) -> np.ndarray:
        """The trie's numbers of words."""
        numbers, known = self.numbers, self.words
        new = [w for w in words if w not in numbers]
        numbers.update(zip(new, range(len(known), len(known) + len(new))))
        known += new
        self.bytes += sum(map(len, new))
        return np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))

    def add(self, paths: list[np.ndarray], counts: np.ndarray) -> None:
        """Adds distinct paths (one array for each step) in their order."""
        head = max(1, len(paths) - 2)
        self._add(paths[:head], paths[head:], counts)

    def _add(self, head: list[np.ndarray], rest: list[np.ndarray], counts: np.ndarray) -> None:
        n = len(counts)
        new = np.zeros(n, bool)
        new[0] = True
        for column in head:
            new[1:] |= column[1:] != column[:-1]
        cuts = np.flatnonzero(new)
        keys = (rest[0] if len(rest) == 1 else (rest[0] << 32) | rest[1]).tolist()
        values, ends = counts.tolist(), [*cuts[1:].tolist(), n]
        for path, lo, hi in zip(zip(*[c[cuts].tolist() for c in head]), cuts.tolist(), ends):
            into = self.below.setdefault(path, {})
            if into is None:
                self._add([c[lo:hi] for c in [*head, rest[0]]], [rest[1][lo:hi]], counts[lo:hi])
                continue
            before = len(into)
            fresh = dict(zip(keys[lo:hi], values[lo:hi]))
            for key in into.keys() & fresh.keys():
                fresh[key] += into[key]
            into.update(fresh)
            self.size += len(into) - before
            if len(into) > self.burst and len(rest) == 2:
                self.below[path] = None
                for key, c in into.items():
                    self.below.setdefault((*path, key >> 32), {})[key & 0xFFFFFFFF] = c

    def spill(self, keep: int, batch: int):
        """(word numbers of each step, counts) of whole containers until at most `keep` entries stay."""
        length, todo = 0, []
        for path, into in sorted(((p, c) for p, c in self.below.items() if c), key=lambda s: -len(s[1])):
            if self.size <= keep:
                break
            todo.append((path, into))
            del self.below[path]
            self.size -= len(into)
            length += len(into)
            if length >= batch:
                yield self._columns(todo)
                length, todo = 0, []
        if todo:
            yield self._columns(todo)

    @staticmethod
    def _columns(subtrees):
        """Arrays of containers whose paths may differ in length."""
        for size in sorted({len(p) for p, _ in subtrees}):
            some = [(p, c) for p, c in subtrees if len(p) == size]
            times = [len(c) for _, c in some]
            head = [np.repeat(np.array(x, np.int64), times) for x in zip(*[p for p, _ in some])]
            n = sum(times)
            keys = np.fromiter(itertools.chain.from_iterable(c for _, c in some), np.int64, n)
            yield head, keys, np.fromiter(itertools.chain.from_iterable(c.values() for _, c in some), np.int64, n)


def _runs(texts: pa.Array):
    """(first row, bytes, row offsets) of about CHUNK bytes; a longer text is cut at the ends of pieces."""
    for lo, _, data, offsets in ta.chunks(texts, CHUNK):
        if len(data) <= 2 * CHUNK:
            yield lo, data, offsets
            continue
        at = 0
        while at < len(data):
            end = at + CHUNK
            # The next end of a piece, looked for a chunk at a time.
            while end < len(data):
                stop = np.flatnonzero(_BREAK[data[end : end + CHUNK]])
                if len(stop):
                    end += int(stop[0])
                    break
                end += CHUNK
            end = min(end, len(data))
            yield lo, data[at:end], np.array([0, end - at])
            at = end


def _words(data: np.ndarray, offsets: np.ndarray):
    """(number, row and piece of each word, distinct words) of lower-cased texts."""
    data = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    stop = _BREAK[data]
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~stop & (data != 32) & (data != 9)
    edge = offsets[offsets < len(data)]
    first = inside[:-1].copy()
    first[1:] &= ~inside[:-2]
    first[edge] |= inside[edge]
    last = inside[:-1] & ~inside[1:]
    ends = edge[edge > 0]
    last[ends - 1] |= inside[ends - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    border = stop.astype(np.int32)
    border[edge] += 1
    piece = np.cumsum(border, dtype=np.int32)[start]
    row = np.searchsorted(offsets, start, "right") - 1
    at = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=at[1:])
    flat = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(data[inside[:-1]])]
    )
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), row, piece, _list(coded.dictionary)


def _list(words: pa.LargeBinaryArray) -> list[bytes]:
    """The words of an array without nulls, sliced out of its bytes."""
    _, at, data = words.buffers()
    at = np.frombuffer(at, np.int64)[words.offset : words.offset + len(words) + 1].tolist()
    data = data.to_pybytes() if data else b""
    return [data[i:j] for i, j in zip(at, at[1:])]


def _chain(seed: np.ndarray, hashes: list[np.ndarray]) -> np.ndarray:
    """A hash of each phrase from those of its language and words."""
    out = seed
    for h in hashes:
        out = ta.mix(out * np.uint64(0x9E3779B97F4A7C15) + h)
    return out


def _seeds(langs: list[str]) -> np.ndarray:
    return _hashes([b"\n" + x.encode() for x in langs])


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _bits(hashes: np.ndarray) -> list[np.ndarray]:
    """Two positions in the filter for each hash."""
    mask = np.uint64((1 << FILTER_BITS) - 1)
    return [(hashes & mask).astype(np.int64), (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]


def _passes(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes the filter has: all frequent phrases, and by chance some others."""
    out = np.ones(len(hashes), bool)
    for bit in _bits(hashes):
        out &= (known[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) != 0
    return out


def _phrases(ids, row, piece, dictionary, langs, sizes, known, below):
    """(k, language codes, k arrays of word numbers) of the phrases that may be frequent, for each size k.

    A phrase is frequent only if all phrases of `below` words in it are, which the filter tells.
    """
    names, code = langs
    code = code[row]
    if known is not None:
        n = len(ids) - below + 1
        word, seed = _hashes(dictionary)[ids], _seeds(names)[code]
        part = _passes(known, _chain(seed[:n], [word[i : i + n] for i in range(below)])) if n > 0 else np.zeros(0, bool)
    for k in sizes:
        n = len(ids) - k + 1
        if n <= 0:
            continue
        good = piece[:n] == piece[k - 1 :]
        if known is not None:
            for i in range(k - below + 1):
                good &= part[i : i + n]
        at = np.flatnonzero(good)
        if len(at):
            yield k, code[at], [ids[at + i] for i in range(k)]


def _distinct(code: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(index of one row, number of rows) of each distinct (code, *columns), in their order."""
    node = code
    for c in columns:
        _, first, node, count = np.unique(
            (node << 32) | c, return_index=True, return_inverse=True, return_counts=True
        )
    return first, count


def _counter(sizes: list[int], filter_, hot, limit: int):
    """Task that counts the phrases of these sizes: lang, part, phrase, c; a null phrase has the number of words."""

    def part(k: int, head: np.ndarray, words: list[np.ndarray], hot_here: np.ndarray) -> np.ndarray:
        """The prefix partition: a hash of the shortest prefix that is not hot."""
        out = _chain(head, words[:1])
        for size in range(2, k + 1):
            out = np.where(np.isin(out, hot_here), _chain(head, words[:size]), out)
        return out.view(np.int64)

    def rows(k: int, trie: HatTrie, keep: int, hot_here: np.ndarray):
        """Sorted runs of whole subtrees."""
        if not trie.size:
            return
        words, hashes = pa.array(trie.words, pa.binary()), _hashes(trie.words)
        # The first step of a path is the language, which a line feed marks.
        names = pa.array([w[1:] if w[:1] == b"\n" else b"" for w in trie.words], pa.binary())
        for columns in trie.spill(keep, BATCH):
            for head, keys, counts in columns:
                steps = [*head, keys] if len(head) == k else [*head, keys >> 32, keys & 0xFFFFFFFF]
                texts = pc.binary_join_element_wise(*[words.take(pa.array(s)) for s in steps[1:]], b" ")
                run = pa.record_batch(
                    [
                        names.take(pa.array(steps[0])).cast(pa.string()),
                        pa.array(part(k, hashes[steps[0]], [hashes[s] for s in steps[1:]], hot_here)),
                        texts.cast(pa.string()),
                        pa.array(counts),
                    ],
                    names=["lang", "part", "phrase", "c"],
                )
                yield run.sort_by([("lang", "ascending"), ("phrase", "ascending")])

    def count(batches):
        known = filter_.value if filter_ else None
        hot_here, total = hot.value, {}
        tries = {k: HatTrie() for k in sizes}
        for batch in batches:
            names = sorted(set(batch.column(0).to_pylist()))
            code = pc.index_in(batch.column(0), pa.array(names, pa.string())).to_numpy().astype(np.int64)
            for lo, data, offsets in _runs(batch.column(1)):
                ids, row, piece, dictionary = _words(data, offsets)
                here = code[lo : lo + len(offsets) - 1]
                if sizes[0] == 1:
                    for i, c in enumerate(np.bincount(here[row], minlength=len(names)).tolist()):
                        total[names[i]] = total.get(names[i], 0) + c
                for k, langs, columns in _phrases(ids, row, piece, dictionary, (names, here), sizes, known, sizes[0] - 1):
                    trie = tries[k]
                    first, counts = _distinct(langs, columns)
                    # The trie's numbers of the words that occur; a language is the first step of a path.
                    used = np.zeros(len(dictionary), bool)
                    for column in columns:
                        used[column[first]] = True
                    numbers = np.zeros(len(dictionary), np.int64)
                    numbers[used] = trie.number([dictionary[i] for i in np.flatnonzero(used).tolist()])
                    own = trie.number([b"\n" + x.encode() for x in names])
                    trie.add([own[langs[first]], *[numbers[c[first]] for c in columns]], counts)
                    if trie.size > limit:
                        yield from rows(k, trie, limit // 2, hot_here)
                    if len(trie.words) > 4 * limit or trie.bytes > 32 * limit:
                        yield from rows(k, trie, 0, hot_here)
                        trie.clear()
        for k, trie in tries.items():
            yield from rows(k, trie, 0, hot_here)
        if total:
            some = sorted(total)
            yield pa.record_batch(
                [
                    pa.array(some, pa.string()),
                    pa.array(_seeds(some).view(np.int64)),
                    pa.nulls(len(some), pa.string()),
                    pa.array([total[x] for x in some], pa.int64()),
                ],
                names=["lang", "part", "phrase", "c"],
            )

    return count


def _filter(spark: SparkSession, frequent: DataFrame, k: int) -> np.ndarray:
    """The filter of frequent phrases of k words: 2^FILTER_BITS bits, whatever their number."""

    def positions(batches):
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lo, _, data, offsets in ta.chunks(batch.column(1), CHUNK):
                ids, _, _, dictionary = _words(data, offsets)
                word = _hashes(dictionary)[ids].reshape(-1, k)
                hashes = _chain(_seeds(langs[lo : lo + len(word)]), [word[:, i] for i in range(k)])
                yield pa.record_batch([pa.array(np.concatenate(_bits(hashes)))], names=["bit"])

    bits = frequent.select("lang", "phrase").mapInArrow(positions, "bit long")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))
    words = bits.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(one).alias("word")).toArrow()
    out = np.zeros(1 << FILTER_BITS - 6, np.uint64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy().view(np.uint64)
    return out


def count_phrases(
    stage: Stage, docs: DataFrame, least: int = LEAST, longest: int = LONGEST, limit: int = 1_000_000, lang: str = "lang", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): lang, phrase, k, f of all phrases with f >= least; lang, n words.

    Three passes over the texts: for words, for pairs, for longer phrases. In each task a HAT-trie
    for each length counts; beyond `limit` entries its largest subtrees leave as sorted runs,
    which are merged per prefix partition (the first words of a phrase, one more where a prefix
    is hot). Phrases that hold a word or pair that is not frequent are ruled out by a filter of
    fixed size: it may let others through, never stop a frequent one, so counts are exact.
    """
    spark = docs.sparkSession
    source = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text))
    levels, hot, known, totals = [], np.zeros(0, np.uint64), None, None
    for sizes in ([1], [2], list(range(3, longest + 1))):
        if not sizes or sizes[0] > longest:
            break
        send = spark.sparkContext.broadcast(hot)
        runs = source.mapInArrow(_counter(sizes, known, send, limit), "lang string, part long, phrase string, c long")
        merged = runs.repartition("part").groupBy("part", "lang", "phrase").agg(F.sum("c").alias("f"))
        level = stage.keep(merged.filter((F.col("f") >= least) | F.col("phrase").isNull()).drop("part"), f"level{sizes[0]}")
        if sizes[0] == 1:
            totals = level.filter("phrase is null").select("lang", F.col("f").alias("n"))
            all_words = totals.agg(F.sum("n")).first()[0] or 0
            level = level.filter("phrase is not null")
        levels.append(level.select("lang", "phrase", (F.size(F.split("phrase", " "))).alias("k"), "f"))
        k = sizes[-1]
        if k > 2 or k == longest or not level.limit(1).count():
            break
        # At most HOT_SHARE phrases of a length are hot.
        often = level.filter(F.col("f") * HOT_SHARE >= all_words).collect()
        parts = [_hashes([r["phrase"].split(" ")[i].encode() for r in often]) for i in range(k)]
        hot = np.concatenate([hot, _chain(_seeds([r["lang"] for r in often]), parts)])
        known = spark.sparkContext.broadcast(_filter(spark, level, k))
    out = levels[0]
    for level in levels[1:]:
        out = out.union(level)
    return out, totals


def collocations(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = 2000, share: int = 80, lang: str = "lang", text: str = "text", limit: int = 1_000_000
) -> DataFrame:
    """The `top` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A-Z are lowered, texts are split into pieces at BREAKS and those into words at spaces and
    tabs; phrases of 2 to `longest` words that occur `least` times or more within pieces are
    candidates. Cutting one after its first words gives l and r, the counts of its two parts, and
    floor(2000000 * a / (l + r)); the lowest such score counts, of equal ones the first cut's.
    A candidate inside a longer one with 100 * f(longer) >= share * a is dropped. n is the
    language's number of words. Products are decimals of 38 digits, so they cannot overflow.

    Edge cases: a null text is empty; a null language is `und`; each of repeated rows counts; a
    very long text is read in parts that end with pieces; equal scores are ordered by a, then
    by the phrase's bytes; other columns are not read; an empty table gives an empty result.
    """
    stage = Stage(docs.sparkSession, "phrases")
    found, totals = count_phrases(stage, docs, least, longest, limit, lang, text)
    big = "decimal(38,0)"
    cut = found.filter("k > 1").withColumn("w", F.split("phrase", " ")).withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cut = cut.select(
        "lang", "phrase", F.col("f").alias("a"), "cut",
        F.array_join(F.slice("w", 1, F.col("cut")), " ").alias("head"),
        F.array_join(F.slice("w", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("tail"),
    )
    cut = cut.join(found.selectExpr("lang", "phrase as head", "f as l"), ["lang", "head"])
    cut = cut.join(found.selectExpr("lang", "phrase as tail", "f as r"), ["lang", "tail"])
    cut = cut.withColumn("score", F.expr(f"(2000000 * cast(a as {big})) div (cast(l as {big}) + r)"))
    scored = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    # Each phrase of two or more words inside a longer candidate, with the most frequent of these.
    inner = found.filter("k > 2").withColumn("w", F.split("phrase", " "))
    inner = inner.withColumn("size", F.explode(F.sequence(F.lit(2), F.col("k") - 1)))
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)))
    inner = inner.select("lang", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("phrase"), "f")
    inner = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    left = scored.join(inner, ["lang", "phrase"], "left").filter(
        f"longer is null or 100 * cast(longer as {big}) < {share} * cast(a as {big})"
    )
    left = left.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    # The best of each of 64 parts of a language, then of these: no window holds a whole language.
    order = "order by score desc, a desc, phrase"
    part = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    part = part.withColumn("rank", F.expr(f"row_number() over (partition by lang, salt {order})")).filter(f"rank <= {top}")
    out = part.withColumn("rank", F.expr(f"row_number() over (partition by lang {order})")).filter(f"rank <= {top}")
    return out.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


QUERIES = {"op12_phrase_mining": op12}
SQL = {
    "op12_phrase_mining": r"""
        with pieces as (
            select coalesce(lang, 'und') as lang,
                   unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as p
            from documents),
        w as (select lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') as ws from pieces),
        places as (select lang, ws, unnest(range(1, len(ws) + 1)) as i from w),
        grams as (
            select lang, k, array_to_string(ws[i : i + k - 1], ' ') as phrase
            from places, (select unnest(range(1, 5)) as k) where i + k - 1 <= len(ws)),
        f as (select lang, phrase, k, count(*) as f from grams group by all),
        n as (select lang, sum(f)::bigint as n from f where k = 1 group by lang),
        cand as (select lang, phrase, k, f as a, string_split(phrase, ' ') as ws from f where k > 1 and f >= 30),
        cuts as (
            select lang, phrase, a, c, array_to_string(ws[1 : c], ' ') as head, array_to_string(ws[c + 1 : k], ' ') as tail
            from cand, (select unnest(range(1, 4)) as c) where c < k),
        scored as (
            select cuts.lang, cuts.phrase, a, c, l.f as l, r.f as r, ((2000000::hugeint * a) // (l.f::hugeint + r.f))::bigint as score
            from cuts
            join f l on l.lang = cuts.lang and l.phrase = head
            join f r on r.lang = cuts.lang and r.phrase = tail),
        best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, c) = 1),
        inner_ as (
            select lang, array_to_string(ws[i : i + s - 1], ' ') as phrase, max(a) as longer
            from cand, (select unnest(range(1, 4)) as i), (select unnest(range(2, 4)) as s)
            where s < k and i + s - 1 <= k group by all),
        ranked as (
            select best.lang, best.phrase, a, l, r, score,
                   row_number() over (partition by best.lang order by score desc, a desc, best.phrase) as rank
            from best left join inner_ i on i.lang = best.lang and i.phrase = best.phrase
            where longer is null or 100::hugeint * longer < 80::hugeint * a)
        select ranked.lang, rank, phrase, a, l, r, n.n, score from ranked join n on n.lang = ranked.lang where rank <= 2000""",
}

by_value(__name__)
