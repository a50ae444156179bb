"""Each operator against brute force or an exact round trip, and on awkward rows."""

import base64
import collections
import hashlib
import itertools
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from freshet.llm import decontam, language, line_dedup, mixing, near_dedup, quality, secrets, sharding, textarrays, token_counts, warc

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, id string, key string"
AWKWARD = [
    None,
    "",
    " \n\t ",
    "one",
    "A b. a B.",
    "x" * 3000,
    "été à l'école 𝄞 " * 30,
    "token = abcdefghijklmnop " * 3 + "AKIA" + "Q7" * 9 + " 0123456789abcdef0123",
    "the quick brown fox jumps over the lazy dog and runs far away from here today\n" * 3,
    "word " * 40000,
    "the same long line of words stands here twice\nThe same long line of words stands here twice!",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, "en", None if i % 3 else "s", 1, "a", "b", "c", "d") for i, t in enumerate(AWKWARD)]
    rows += [(None, "a text without an id that is long enough", None, None, None, None, None, None, None)] * 2
    rows += [rows[8], rows[8]]  # a repeated row
    rows += [(100, AWKWARD[8], None, "s", 1, "a", "b", "c", "d")]  # an exact copy
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")


def sets_of(texts, k):
    out = {}
    for i, t in texts.items():
        w = words((t or "").translate(LOWER))
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


def closure(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def similar(sets, percent=80):
    posts = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            posts[g].append(i)
    shared = collections.Counter(p for ids in posts.values() for p in itertools.combinations(ids, 2))
    return [p for p, n in shared.items() if 100 * n >= percent * (len(sets[p[0]]) + len(sets[p[1]]) - n)]


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_equal_brute_force(docs, texts, k):
    sets = sets_of(texts, k)
    want = closure(sets, similar(sets))
    got = near_dedup.near_duplicates(docs, words=k).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {
        i: (len(sets[i]), want[i], want[i] == i) for i in sets
    }


def test_near_duplicates_of_awkward_rows(awkward, nothing):
    got = near_dedup.near_duplicates(awkward, words=2).collect()
    assert len(got) == awkward.count()
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by_id[100]["component_id"] == 8 and not by_id[100]["kept"]
    assert by_id[0]["n_shingles"] == 0 and by_id[0]["kept"] and by_id[1]["component_id"] == 1
    assert all(r["kept"] and r["component_id"] is None for r in got if r["doc_id"] is None)
    assert near_dedup.near_duplicates(nothing).collect() == []


def test_near_duplicates_of_a_chain_meet(spark):
    """Neighbours are alike, the ends are not; all are one component."""
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[2 * i : 2 * i + 40])) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["component_id"] for r in near_dedup.near_duplicates(docs, words=2).collect()} == {0}


def test_nulls_with_and_without_bytes_are_empty_texts():
    given = pa.array(["ab", None, "", "cde", None])
    odd = pa.Array.from_buffers(pa.string(), 3, [pa.py_buffer(b"\x05"), pa.py_buffer(np.array([0, 2, 5, 6], np.int32)), pa.py_buffer(b"abXXXc")])
    for texts, want in ((given, [b"ab", b"", b"", b"cde", b""]), (given.slice(1, 3), [b"", b"", b"cde"]), (odd, [b"ab", b"", b"c"])):
        for limit in (1, 1 << 20):
            got = [bytes(data[i:j]) for _, _, data, at in textarrays.chunks(texts, limit) for i, j in itertools.pairwise(at)]
            assert got == want


def test_quality_stage_holds_a_small_part_of_a_batch():
    words = [f"w{i}" for i in range(997)]
    texts = [" ".join(random.Random(i).choices(words, k=250)) for i in range(4000)] + [None, "", "short"]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    run = quality._filterer(list(quality.RULES), "text")
    list(run(iter([batch.slice(0, 1)])))  # what a worker keeps is there
    before = pa.default_memory_pool().bytes_allocated()
    tracemalloc.start()
    kept, arrow, largest = [], 0, 0
    for out in run(iter([batch])):
        kept += out.column(0).to_pylist()
        arrow = max(arrow, pa.default_memory_pool().bytes_allocated() - before)
        largest = max(largest, tracemalloc.get_traced_memory()[1])
    tracemalloc.stop()
    # Of 4.9 MB of texts.
    assert kept == list(range(4000)) and arrow < batch.nbytes / 4 and largest < 20e6


def test_quality_counts_of_awkward_rows(awkward, nothing):
    for r in quality.judge(awkward).collect():
        if r["doc_id"] is None:
            continue
        t = AWKWARD[8] if r["doc_id"] == 100 else AWKWARD[r["doc_id"]]
        w = words(t)
        windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {i + j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(8)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        assert r["n_words"] == len(w) and r["word_chars"] == sum(map(len, w))
        assert r["n_repeat_words"] == len(covered) and r["n_dup_lines"] == len(lines) - len(set(lines))
    assert quality.judge(nothing).collect() == []
    assert quality.filter_documents(nothing).collect() == []


def test_order_of_rules_changes_nothing(docs):
    rules = list(quality.RULES)
    one = quality.judge(docs, rules).select("doc_id", "kept").collect()
    assert one == quality.judge(docs, rules[::-1]).select("doc_id", "kept").collect()
    kept = {r["doc_id"] for r in quality.filter_documents(docs).collect()}
    assert kept == {r["doc_id"] for r in one if r["kept"]}
    assert sorted(quality.plan(docs)) == sorted(rules)


def weighted(a, b, weight, top):
    a, b = collections.Counter(a), collections.Counter(b)
    keys = a.keys() | b.keys()
    return sum(min(a[k], b[k]) * weight.get(k, top) for k in keys) / sum(max(a[k], b[k]) * weight.get(k, top) for k in keys)


def test_leaks_equal_brute_force(spark, docs, texts):
    """Every window of every item's length, compared in full; near copies are planted."""
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    planted = dict(list(texts.items())[:40])
    for n, (i, t) in enumerate(items.items()):
        w = t.split()
        w[len(w) // 2 : len(w) // 2 + n % 3] = ["changed"] * (n % 2)
        planted[1000 + i] = "Before it. " + " ".join(w).upper() + " and after"
    clean = str.maketrans("", "", "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")

    def shingles(w):
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)]

    bench = {i: words(t.lower().translate(clean)) for i, t in items.items()}
    seen = collections.Counter(g for w in bench.values() for g in set(shingles(w)))
    weight = {g: decontam._weight(len(bench), c) for g, c in seen.items()}
    top = decontam._weight(len(bench), 0)
    want = {}
    for d, t in planted.items():
        w = words((t or "").lower().translate(clean))
        have = set(shingles(w))
        for i, b in bench.items():
            if not have & set(shingles(b)):
                continue
            ends = range(max(1, len(w) - len(b) + 1))
            best = max(weighted(shingles(w[s : s + len(b)]), shingles(b), weight, top) for s in ends)
            if best >= 0.8 - 1e-9:
                want[d, i] = round(best, 9)
    frame = spark.createDataFrame(list(planted.items()), "doc_id long, text string")
    got = decontam.leaks(frame, spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in got} == want
    assert len(want) >= 8


def test_leaks_of_items_whose_parts_are_exchanged(spark):
    """All windows at an exact weighted similarity of 0.8 or more, recall of reordered items measured."""
    rng = random.Random(4)
    items = [[f"w{rng.randrange(5000)}" for _ in range(n)] for n in (60, 90, 120) for _ in range(40)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    rows = []
    for i, w in enumerate(items):
        at = len(w) * (1 + i % 3) // 4
        rows.append((i, " ".join([f"x{rng.randrange(5000)}" for _ in range(i % 50)] + w[at:] + w[:at] + ["and", "more"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench).collect()}
    # Four of 56, 86 and 116 shingles are lost on either side: 0.86 and more.
    assert all(d == i for d, i in got) and len(got) >= 0.9 * len(items)


def test_leaks_far_apart_in_one_long_text(spark):
    item = " ".join(f"item{i}" for i in range(40))
    text = f"{item} " + "filler words without end " * 200_000 + item
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = decontam.leaks(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(r["item_id"], r["start_word"], r["similarity"]) for r in got] == [(7, 0, 1.0)]


def test_leaks_of_awkward_rows(spark, awkward, nothing):
    bench = spark.createDataFrame([(1, AWKWARD[8]), (2, None), (3, ""), (4, "a b"), (4, "a b")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(awkward, bench).collect()}
    assert got == {(8, 1), (100, 1), (4, 4)}
    kept = decontam.decontaminate(awkward, bench)
    assert kept.columns == awkward.columns and kept.filter("doc_id is null").count() == 2
    assert decontam.leaks(nothing, bench).collect() == []
    assert decontam.leaks(awkward, bench.limit(0)).collect() == []


def test_decontamination_judges_each_row(spark):
    item = "what is the capital of france and which river flows through the middle of it today"
    clean = "an entirely different text about growing tomatoes in a small garden behind the house"
    rows = [(1, f"so {item} then"), (1, clean), (None, item), (None, clean), (2, item), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(5, item)], "item_id long, text string")
    got = collections.Counter(tuple(r) for r in decontam.decontaminate(docs, bench).collect())
    assert got == collections.Counter([(1, clean), (None, clean), (3, None)])


def test_mix_meets_targets(spark, docs):
    rows = mixing.mix(docs, block=16).collect()
    assert rows and sorted(rows) == sorted(mixing.mix(docs.repartition(3), block=16).collect())
    taken, target, size = collections.Counter(), {}, collections.Counter()
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == sum(s["end"] - s["first"] for s in r["spans"])
        taken[r["source"]] += r["taken"]
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 64 + 0.02 * target[s] for s in target)
    assert all(target[s] <= 2 * size[s] for s in target) and abs(sum(target.values()) - 1.5 * sum(size.values())) < 1
    out = mixing.apply_mix(docs, block=16)
    assert out.columns == docs.columns
    assert out.agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0] == sum(taken.values())


def test_mix_of_awkward_rows(awkward, nothing):
    rows = mixing.mix(awkward).collect()
    assert len(rows) == awkward.count() and all(r["taken"] <= 2 * r["size"] for r in rows)
    assert mixing.mix(nothing).collect() == []


def test_apply_mix_cuts_each_row_by_itself(spark):
    rows = [(7, " ".join(f"same{i}" for i in range(40)))] * 2  # equal rows
    rows += [(8, "two sizes of one id"), (8, " ".join(f"long{i}" for i in range(90)))]
    rows += [(9, " ".join(f"{c}{i}" for i in range(30))) for c in "pq"]  # one id, one size, two texts
    rows += [(None, " ".join(f"null{j}x{i}" for i in range(20 + j // 2))) for j in range(6)]
    rows += [(None, None), (None, ""), (10, None)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    size = sum(len(words(t)) for _, t in rows if t)
    for share, most in ((1.5, 2), (0.6, 2), (2.0, 2)):
        plan = mixing.mix(docs, share=share, most=most, block=4).collect()
        assert len(plan) == len(rows) and abs(sum(r["taken"] for r in plan) - share * size) <= 4
        out = mixing.apply_mix(docs, share=share, most=most, block=4)
        assert out.columns == docs.columns
        got = collections.Counter()
        for r in out.collect():
            got.update((r["doc_id"], w) for w in words(r["text"]))
        held = collections.Counter((i, w) for i, t in rows for w in words(t or ""))
        assert abs(got.total() - share * size) <= 4
        # No row's words come more than `most` times, nor from a row of another id.
        assert all(n <= most * held[w] for w, n in got.items())
        if share == 2.0:
            assert got == held + held and out.count() == 2 * 12


def test_mix_bounds_the_rows_of_a_shard(spark):
    # Short texts without ids, and empty ones: their tokens alone make one shard.
    rows = [(None, f"w{i}", "s") for i in range(400)] + [(None, None, "s")] * 300 + [(None, "", "s")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    met, plain = [], mixing.Stage.keep

    def keep(self, df, label="table"):
        kept = plain(self, df, label)
        if label == "run":
            met.append(collections.Counter(r["shard"] for r in kept.filter("stop > 0").collect()))
            assert kept.filter("size = 0 and shard is null").count() == 600
        return kept

    mixing.Stage.keep = keep
    try:
        plan = mixing.mix(docs, block=4, shard_rows=50).collect()
    finally:
        mixing.Stage.keep = plain
    assert len(plan) == 1000 and abs(sum(r["taken"] for r in plan) - 600) <= 32
    assert len(met[0]) == 8 and max(met[0].values()) <= 100


def test_apportionment_is_by_highest_quotients():
    votes, seats = [53.0, 24.0, 23.0, 0.0], 17
    want = [0] * 4
    for _ in range(seats):
        i = max(range(4), key=lambda i: (votes[i] / (2 * want[i] + 1), -i))
        want[i] += 1
    assert mixing.sainte_lague(votes, seats, [99] * 4) == want
    assert mixing.sainte_lague(votes, seats, [5, 5, 5, 5]) == [5, 5, 5, 0]


def test_quotas_are_the_highest_quotients():
    rng = random.Random(5)
    for _ in range(1000):
        n = rng.randint(1, 9)
        votes = [rng.choice([0, rng.randint(1, 1000), rng.random() * 1000, 100]) for _ in range(n)]
        seats, most = rng.randint(0, 1500), [rng.choice([0, 5, 10**6, rng.randint(0, 400)]) for _ in range(n)]
        want = [0] * n
        for _ in range(seats):
            open_ = [i for i in range(n) if votes[i] > 0 and want[i] < most[i]]
            if not open_:
                break
            want[max(open_, key=lambda i: (votes[i] / (2 * want[i] + 1), -i))] += 1
        assert mixing.sainte_lague(votes, seats, most) == want
    assert mixing.sainte_lague([490, 510], 1000, [10**6] * 2)[0] == 490


def test_targets_reshare_the_excess():
    got = mixing.target_tokens({"a": 10, "b": 100, None: 100}, {"a": 5, "b": 2, None: 1}, 210.0)
    assert got == {"a": 20.0, "b": pytest.approx(190 * 2 / 3), None: pytest.approx(190 / 3)}


def test_shards_are_near_equal(docs, texts):
    rows = sharding.kd_shards(docs, shards=7).collect()
    load, slots = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        t = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(t) + 16 and r["text_crc32"] == zlib.crc32(t) and r["law"] == "bytes"
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert sorted(load) == list(range(7))
    largest = max(r["size"] for r in rows)
    assert max(load.values()) - min(load.values()) <= 3 * largest
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_awkward_rows(awkward, nothing):
    rows = sharding.kd_shards(awkward, shards=3).collect()
    assert len(rows) == awkward.count() and {r["shard"] for r in rows} <= {0, 1, 2}
    assert sharding.kd_shards(nothing).collect() == []
    assert len({r["shard"] for r in sharding.kd_shards(awkward, shards=None, target_bytes=70_000).collect()}) > 1


TOKENIZER = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_token_counts_equal_the_library(spark, docs, texts, awkward, nothing):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    more = ["a<|endoftext|> b  <|endoftext|>", "  \n\n x", "don't''s 'll", "<|endoftext|><|endoftext|>", "ſ's  y   z "]
    every = list(texts.values()) + AWKWARD + more
    frame = spark.createDataFrame(list(enumerate(every)), "doc_id long, text string")
    for r in token_counts.count_tokens(frame, TOKENIZER, cache_size=50).collect():
        t = every[r["doc_id"]] or ""
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 1024)
    assert token_counts.count_tokens(awkward, TOKENIZER).count() == awkward.count()
    assert token_counts.count_tokens(nothing, TOKENIZER).collect() == []


def test_language_on_held_out_rows(spark, awkward, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    filters = language.learn(docs.filter(~held))
    got = language.identify(docs, filters, held).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)
    odd = {r["doc_id"]: r for r in language.identify(awkward, filters).collect()}
    assert odd[0]["lang_pred"] == odd[1]["lang_pred"] == odd[2]["lang_pred"] == "und" and odd[3]["lang_pred"] != "und"
    assert language.identify(nothing, filters).collect() == []
    empty = language.learn(nothing)
    assert {r["lang_pred"] for r in language.identify(awkward, empty).collect()} == {"und"}


def test_filters_hold_all_languages_of_a_gram(spark):
    rows = [(i, f"common {lang}{lang}{lang} word", f"l{lang}") for i, lang in enumerate("abcdefgh" * 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = language.learn(docs)
    import numpy as np

    data = np.frombuffer(b"common", np.uint8)
    value, _ = language.grams(data, np.array([0, 6]), 3)
    assert (filters.lookup(value, 0) == np.uint64(255)).all()


def base_spans(t):
    assign = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    spans = []
    for order, (kind, pattern, group, least) in enumerate(
        [("assign", assign, 1, 12), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16)]
    ):
        spans += [(m.start(), order, kind, m.end()) for m in pattern.finditer(t or "") if len(m.group(group)) >= least]
    return [f"{kind}:{start}:{end}" for start, _, kind, end in sorted(spans)]


def test_secrets_equal_brute_force(docs, texts, awkward, nothing):
    every = {**texts}
    got = secrets.scan(docs).select("doc_id", secrets._joined("base").alias("base")).collect()
    assert {r["doc_id"]: r["base"] for r in got} == {i: ",".join(base_spans(t)) for i, t in every.items()}
    odd = secrets.scan(awkward).select("doc_id", secrets._joined("base").alias("base")).collect()
    assert len(odd) == awkward.count()
    assert all(r["base"] == ",".join(base_spans(AWKWARD[r["doc_id"]])) for r in odd if r["doc_id"] is not None and r["doc_id"] < 100)
    assert secrets.scan(nothing).collect() == []


def test_random_tokens_are_told_from_words(spark):
    noise = [base64.b64encode(hashlib.sha256(str(i).encode()).digest()).decode().rstrip("=") for i in range(30)]
    rows = [(i, f"see {n} there") for i, n in enumerate(noise)]
    rows += [(100 + i, "HelloWorldThisIsPlainText2024 and aaaaaaaaaaaaaaaaaaaa1111111 or 2024202420242024") for i in range(300)]
    found = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum("random" in found[i] for i in range(30)) >= 27
    assert not any("random" in v for i, v in found.items() if i >= 100)


def test_lines_equal_brute_force(docs, texts):
    unique, lines = {}, []
    for d in sorted(texts):
        for n, line in enumerate((texts[d] or "").split("\n")):
            if words(line):
                key = line.strip(" ").lower()
                unique.setdefault(key, (d, n))
                lines.append((d, n, key))
    sets = {unique[k]: {k[i : i + 10] for i in range(max(1, len(k) - 9))} for k in unique}
    want = closure(sets, similar(sets))
    gone = collections.defaultdict(list)
    for d, n, key in lines:
        keep = want[unique[key]]
        if keep != (d, n):
            gone[d].append(f"{n}:{keep[0]}:{keep[1]}")
    got = line_dedup.by_document(line_dedup.duplicate_lines(docs)).collect()
    assert {r["doc_id"]: r["dropped"] for r in got} == {d: ",".join(gone[d]) for d in texts}


def test_short_lines_that_meet_are_linked(spark):
    import random

    draw = random.Random(5)
    # 4 and 5 shingles, 0.8 alike.
    short = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=13)) for _ in range(1500)]
    rows = [(2 * i, s) for i, s in enumerate(short)] + [(2 * i + 1, f"{s}z") for i, s in enumerate(short)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keys = {r["doc_id"]: set(r["keys"]) for r in line_dedup.signatures(docs.withColumnRenamed("text", "line")).collect()}
    met = {i for i in range(1500) if keys[2 * i] & keys[2 * i + 1]}
    gone = {r["doc_id"] // 2 for r in line_dedup.duplicate_lines(docs).filter("not kept").collect()}
    assert len(met) >= 1495 and gone == met


def test_copies_of_a_line_cost_some_pairs_each(spark, monkeypatch):
    import random

    draw = random.Random(9)
    base = draw.choices("abcdefghijklmnopqrstuvwxyz ", k=600)
    family = []
    for _ in range(300):
        # Four places changed: some 0.87 alike to the line itself, 0.76 to each other.
        copy = list(base)
        for at in draw.sample(range(20, 580), 4):
            copy[at] = draw.choice("0123456789")
        family.append("".join(copy))
    rows = list(enumerate(["".join(base), *family]))
    asked, whole = [], line_dedup.merge_buckets

    def counted(stage, met, carry, near, verify, *more, **named):
        def count(pairs):
            asked.append(pairs.count())
            return verify(pairs)

        return whole(stage, met, carry, near, count, *more, **named)

    monkeypatch.setattr(line_dedup, "merge_buckets", counted)
    found = line_dedup.duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r["doc_id"] for r in found if r["kept"]] == [0]
    assert sum(asked) <= 5 * len(rows)


def test_rows_of_buckets_in_some_batches(monkeypatch):
    draw = np.random.default_rng(3)
    key, h = draw.integers(0, 3000, 9000), draw.integers(0, 40, 9000)
    h[key == 7], key[:200] = 5, 8
    monkeypatch.setattr(line_dedup, "DEALT", 1500)
    batches = [pa.record_batch([pa.array(x[i : i + 700]) for x in (key, h * 10000 + key)], names=["key", "h1"]) for i in range(0, 9000, 700)]
    buckets = collections.defaultdict(set)
    for k, x in zip(key.tolist(), (h * 10000 + key).tolist()):
        buckets[k].add(x)
    got = {x for batch in line_dedup._shared(iter(batches)) for x in batch.column(0).to_pylist()}
    assert got == set().union(*(v for v in buckets.values() if len(v) > 1))


def test_lines_of_one_id_on_two_texts(spark):
    line = "a line of some words that is long enough to be compared with others of its kind"
    rows = [(1, "nothing like it"), (1, line), (2, line[:-1]), (None, f"{line}s")]
    found = line_dedup.duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == 4 and [r["doc_id"] for r in sorted(found, key=lambda r: r["row"]) if not r["kept"]] == [2, None]


def test_lines_of_awkward_rows(awkward, nothing):
    every = line_dedup.by_document(line_dedup.duplicate_lines(awkward)).collect()
    assert len(every) == awkward.count()
    got = {r["doc_id"]: r for r in every}
    assert set(got) == {*range(len(AWKWARD)), 100, None}
    assert got[0]["n_lines"] == 0 and got[100]["n_dropped"] == 3
    # Of three equal rows one keeps its first line; of two without an id one goes.
    assert sorted(r["dropped"] for r in every if r["doc_id"] == 8) == ["0:8:0,1:8:0,2:8:0"] * 2 + ["1:8:0,2:8:0"]
    assert sorted(r["dropped"] for r in every if r["doc_id"] is None) == ["", "0::0"]
    assert got[10]["dropped"] == "1:10:0"
    assert line_dedup.by_document(line_dedup.duplicate_lines(nothing)).collect() == []


@pytest.mark.parametrize("threshold", ["-1", "10485760"])
def test_equal_pages_are_records_each_whatever_the_join(spark, threshold):
    rows = [(1, "u", "same"), (2, "v", "b" * 600_000), (2, "v", "b" * 600_000), (3, "w", "same"), (2, "x", "other"), (None, "y", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        got = [(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(got, key=str) == sorted(
        [(1, 4, "revisit", 3), (3, 4, "response", None), (None, 4, "response", None), (2, 5, "response", None)]
        + [(2, 600_000, "response", None)] * 2, key=str,
    )


def test_archives_round_trip(spark):
    rows = [(1, "http://a", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://c", None), (4, "u", ""), (5, "v", "é\r\n\r\nWARC/1.1\r\n" * 9)]
    rows += [(6, "w", "y" * 100_000), (6, "w", "y" * 100_000), (None, "z", "no id")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("n_bytes", F.lit("clash"))
    got = {r["page_id"]: r for r in warc.round_trip(pages).collect()}
    assert len(got) == 7 and warc.round_trip(pages).count() == 8
    for page, _, html in rows:
        data = (html or "").encode()
        assert got[page]["payload_bytes"] == len(data)
        assert got[page]["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
    assert [(got[i]["record_type"], got[i]["refers_to"]) for i in (1, 2, 3, 4)] == [
        ("revisit", 2), ("response", None), ("revisit", 4), ("response", None)
    ]
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_chunks_carry_running_digests(spark, tmp_path):
    text = "".join(chr(97 + i % 26) for i in range(10_000))
    pages = spark.createDataFrame([(1, "u", text), (2, "v", "short")], "page_id long, url string, html string")
    chunks = warc.chunked(pages, chunk=777)
    index = warc.records(chunks)
    folder = f"file://{tmp_path}/archive"
    files = spark.createDataFrame(warc.write(chunks, index, folder).collect())
    rows = sorted(warc.read(files, folder, chunk=500).filter("page_id = 1").collect(), key=lambda r: r["chunk_no"])
    assert b"".join(r["data"] for r in rows).decode() == text and len(rows) == 20
    digest = hashlib.sha1()
    for r in rows:
        digest.update(r["data"])
        assert r["sha1"] == base64.b32encode(digest.digest()).decode() and r["last"] == (r["n_bytes"] == 10_000)


def test_parity_bits_never_differ_more_than_the_sets():
    import pyarrow as pa

    import random

    draw = random.Random(5)
    texts = ["", None, "one"]
    for n in (3, 40, 300, 3000):
        words = [f"w{draw.randrange(n)}" for _ in range(n)]
        texts.append(" ".join(words))
        for share in (0.02, 0.1, 0.5):
            texts.append(" ".join(f"x{draw.randrange(n)}" if draw.random() < share else w for w in words))
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["id", "t"])
    got = [r for b in near_dedup._signer(2, 24, 5)([batch]) for r in b.to_pylist()]

    def pairs(text):
        words = (text or "").split()
        return set(zip(words, words[1:])) or {tuple(words)} - {()}

    for a, x in zip(got, texts):
        for b, y in zip(got, texts):
            differing = sum(((p ^ q) & (2**64 - 1)).bit_count() for p, q in zip(a["parity"], b["parity"]))
            assert differing <= len(pairs(x) ^ pairs(y))
            assert differing > 0 or pairs(x) == pairs(y)
