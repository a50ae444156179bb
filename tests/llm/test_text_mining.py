"""Personal data, phrase collocations and ranked search against brute force, and on awkward rows."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.llm import phrases, private, search

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, spans string, n long, item_id string, t string, q string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = [
    None, "", " .,\n", "one", "a@b.cd +1 (555) 123-4567, 10.0.0.1", "x" * 3000, "été à l'école 𝄞 me@ex.org " * 30,
    "the quick brown fox. " * 40, "w " * 50_000, "a@" * 5000, "The Quick Brown FOX",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, None if i % 2 else "en", "s", 1, "i", "t", "q") for i, t in enumerate(TEXTS)]
    rows += [rows[7], rows[7], (None, TEXTS[7], None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- personal data -------------------------------------------------------------------

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def base_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card":
                twice = [int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(digits[::-1])]
                if not 14 <= len(digits) <= 19 or sum(twice) % 10:
                    continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), order, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns(docs):
    got = private.op11(docs.sparkSession, DATA).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert len(got) == len(texts)
    some = 0
    for r in got:
        want = base_spans(texts[r["doc_id"]])
        joined = ",".join(f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{kind}"] for kind, _ in PATTERNS] == [sum(s[1] == k for s in want) for k in range(4)]
        assert set(joined.split(",")) <= set(r["spans"].split(","))
        some += len(want)
    assert some > 10


def test_anchors_of_random_texts_equal_the_patterns():
    rng = random.Random(3)
    for _ in range(20_000):
        pools = ["0123456789", "0123456789.. --", "ab@.@-_%", "+1 ()-.", "é:/x "]
        t = "".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(0, 60)))
        assert [s for s in private.spans_of(t) if s[1] < 4] == base_spans(t), t


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("see https://bob:pw@example.org/x?q=1. end", [("url", "https://bob:pw@example.org/x?q=1"), ("email", "pw@example.org")]),
        ("https://example.org/x", []),
        ("IBAN: DE89 3704 0044 0532 0130 00 ok", [("iban", "DE89 3704 0044 0532 0130 00")]),
        ("Account number 123456-789, x", [("account", "123456-789")]),
        ("account 12 34", []),
        ("accounting 123456789", []),
        ("2001:db8:85a3::8a2e:370:7334 at 12:30:45", [("ip6", "2001:db8:85a3::8a2e:370:7334")]),
    ],
)
def test_spans_that_the_method_adds(text, want):
    assert [(private.KINDS[k], text[a:b]) for a, k, b in private.spans_of(text)] == want


def test_personal_data_of_awkward_rows(awkward, nothing):
    rows = private.scan(awkward).collect()
    assert len(rows) == awkward.count()
    by_id = {r["doc_id"]: r["spans"] for r in rows}
    assert by_id[0] == by_id[1] == by_id[9] == [] and len(by_id[6]) == 30
    assert [s["kind"] for s in by_id[4]] == ["email", "phone", "ip"]
    assert private.scan(nothing).collect() == []
    hidden = {r["doc_id"]: r["text"] for r in private.redact(awkward).collect()}
    assert hidden[4] == "[email] [phone], [ip]" and hidden[0] is None and hidden[7] == TEXTS[7]


# ---- phrases -------------------------------------------------------------------------


def collocations_by_hand(rows, least, top):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang or "und", tuple(w[i : i + k])] += 1
    cand = {p: c for p, c in f.items() if len(p[1]) > 1 and c >= least}
    best = {}
    for (lang, p), a in cand.items():
        cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        inside = any(
            lang == other and len(q) > len(p) and 100 * c >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q)))
            for (other, q), c in cand.items()
        )
        if not inside:
            best.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted(
        (lang, rank, p.decode(), -a, left, right, n[lang], -score)
        for lang, found in best.items()
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1)
    )


@pytest.mark.parametrize("limit", [1_000_000, 50])
def test_collocations_equal_brute_force(docs, limit):
    """Also where the tries spill all the time."""
    want = collocations_by_hand([(r["lang"], r["text"]) for r in docs.collect()], 10, 40)
    got = phrases.collocations(docs.repartition(4), least=10, top=40, limit=limit)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 20


def test_collocations_of_awkward_rows(awkward, nothing, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", 64)  # long texts in many parts
    want = collocations_by_hand([(r["lang"], r["text"]) for r in awkward.collect()], 30, 2000)
    got = phrases.collocations(awkward)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == want and want
    assert phrases.collocations(nothing).collect() == []


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_tries_count_and_spill_whole_subtrees(k):
    rng = random.Random(k)
    trie, want, got = phrases.HatTrie(burst=8), collections.Counter(), collections.Counter()

    def take(keep):
        for columns in trie.spill(keep, 30):
            for head, keys, counts in columns:
                steps = [*head, keys] if len(head) == k else [*head, keys >> 32, keys & 0xFFFFFFFF]
                for *path, c in zip(*[s.tolist() for s in steps], counts.tolist()):
                    got[tuple(path)] += c

    for _ in range(40):
        rows = collections.Counter(tuple(rng.randint(0, 5) for _ in range(k + 1)) for _ in range(60))
        trie.add([np.array(c) for c in zip(*sorted(rows))], np.array([rows[x] for x in sorted(rows)]))
        want += rows
        if trie.size > 100:
            take(50)
            assert trie.size <= 50
    take(0)
    assert got == want and trie.size == 0


# ---- ranked search -------------------------------------------------------------------


def ranking_by_hand(rows, items, top):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    counted = [(d, collections.Counter(term.findall((t or "").translate(LOWER)))) for d, t in rows]
    counted = [(d, c) for d, c in counted if c]
    total, words = len(counted), sum(sum(c.values()) for _, c in counted)
    df = collections.Counter(t for _, c in counted for t in c)
    terms = {}
    for item, text in items:
        terms.setdefault(item, set()).update(term.findall((text or "").translate(LOWER)))
    out = []
    for item, wanted in terms.items():
        scores = []
        for d, c in counted:
            m = 50 + (50 * sum(c.values()) * total) // words
            hits = [t for t in wanted if t in c]
            score = sum(
                math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in hits
            )
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out += [(item, i, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


def test_ranking_equals_brute_force(spark, docs, monkeypatch):
    """Lists read a few entries at a time, documents in small blocks, items in several blocks."""
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    monkeypatch.setattr(search, "DEPTH", 2)
    monkeypatch.setattr(search, "POSTINGS", 500)
    want = ranking_by_hand([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in bench.select("item_id", "text").collect()], 7)
    got = search.rank(docs.repartition(3), bench, top=7, block_bytes=9000).collect()
    assert sorted((tuple(r) for r in got), key=str) == want


def test_ranking_of_awkward_rows(spark, awkward, nothing, monkeypatch):
    monkeypatch.setattr(search, "CHUNK", 64)
    rows = [("a", "the quick brown fox"), ("a", "w été"), ("b", None), ("c", ""), ("d", "nowhere"), (None, "école")]
    items = spark.createDataFrame(rows, "item_id string, text string")
    want = ranking_by_hand([tuple(r) for r in awkward.select("doc_id", "text").collect()], rows, 50)
    assert sorted((tuple(r) for r in search.rank(awkward, items).collect()), key=str) == want and want
    assert search.rank(nothing, items).collect() == [] and search.rank(awkward, items.limit(0)).collect() == []


def test_early_lists_are_left_once_the_bound_is_safe():
    """Half of the impacts are never read, and the result is that of full sums."""
    rng = np.random.default_rng(1)
    docs, terms = 4000, 5
    q, doc = np.repeat(np.arange(terms), docs), np.tile(np.arange(docs), terms)
    impact = (1e6 / (1 + rng.permuted(np.tile(np.arange(docs), (terms, 1)), axis=1)[:, doc[:docs]].ravel())).astype(np.int64) + 1
    impact[doc < 30] += 10**6
    lists = search.Lists(doc, q, impact, terms, docs)
    reads = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                reads.append(key.stop - key.start)
            return np.asarray(self)[key]

    lists.impact = lists.impact.view(Counted)
    found, scores = search.nra(lists, np.arange(terms), 20, np.zeros(0, np.int64))
    want = np.bincount(doc, impact, docs).astype(np.int64)
    least = np.sort(want)[-20]
    assert dict(zip(found.tolist(), scores.tolist())) == {d: int(want[d]) for d in np.flatnonzero(want >= least).tolist()}
    assert sum(reads) < len(q) / 2
