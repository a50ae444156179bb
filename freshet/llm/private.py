"""Personal data by anchor expansion: Aho-Corasick finds anchors, local parsers find and check the bounds."""

from __future__ import annotations

import bisect
import ipaddress
import itertools
import sys
import types

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.shared import by_value, documents

# Kinds in the order in which they are listed; the first four are the base.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "ip6", "iban", "account")

DIGITS = frozenset("0123456789")
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = DIGITS | frozenset(LOWER + UPPER)
LOCAL = WORD | frozenset("._%+-")
LABEL = WORD | frozenset("-")
DIAL = DIGITS | frozenset(" ().-")
HEX = DIGITS | frozenset("abcdefABCDEF")
# What ends a web address, and what does not belong to its end.
URL_END = frozenset(" \t\n\r\x0b\x0c<>\"'`|\\^{}")
URL_TAIL = ".,;:!?)]"
# Words before an identifier, in small letters, as a title and in capitals.
CUES = (
    "account", "acct", "iban", "routing", "passport", "customer id", "member id", "user id", "patient id",
    "konto", "kontonummer", "compte", "cuenta",
)
# What may stand between a cue and its identifier.
BETWEEN = frozenset(" \t:#=.-")
FILLERS = ("number", "no", "nr", "num", "is", "id")
# Lengths and digits of an identifier, and characters looked at after a cue.
LEAST, MOST, LEAST_DIGITS, REACH = 6, 34, 6, 24


def _worker():
    """What a worker process keeps between tasks: the automaton."""
    return sys.modules.setdefault("_private_data_worker", types.ModuleType("_private_data_worker")).__dict__


def _automaton():
    """Aho-Corasick over at-signs, digits, plus signs, schemes, double colons and cues."""
    kept = _worker()
    if "automaton" not in kept:
        import ahocorasick

        made = ahocorasick.Automaton()
        made.add_word("@", ("email", 1))
        made.add_word("+", ("phone", 1))
        made.add_word("://", ("url", 3))
        made.add_word(":", ("ip6", 1))
        for d in sorted(DIGITS):
            made.add_word(d, ("number", 1))
        for cue in CUES:
            for form in {cue, cue.title(), cue.capitalize(), cue.upper()}:
                made.add_word(form, ("account", len(form)))
        made.make_automaton()
        kept["automaton"] = made
    return kept["automaton"]


def _run(text: str, at: int, allowed: frozenset, limit: int | None = None) -> int:
    """The end of the run of allowed characters from `at`."""
    end = len(text) if limit is None else min(limit, len(text))
    while at < end and text[at] in allowed:
        at += 1
    return at


def _back(text: str, at: int, allowed: frozenset, least: int) -> int:
    """The start of the run of allowed characters that ends at `at`, not before `least`."""
    while at > least and text[at - 1] in allowed:
        at -= 1
    return at


def _email(text: str, at: int, done: int) -> tuple[int, int] | None:
    """Local part before an at-sign, labels joined by points after it."""
    start = _back(text, at, LOCAL, done)
    end = _run(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    last = end
    while last < len(text) and text[last] == ".":
        after = _run(text, last + 1, LABEL)
        if after == last + 1:
            break
        last = after
    return (start, last) if last > end else None


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _addresses(text: str, at: int):
    """(end of the chain, [(start, end, whether all parts are small)]) of numbers joined by points."""
    runs, last = [], at
    while True:
        end = _run(text, last, DIGITS)
        runs.append((last, end))
        if end + 1 < len(text) and text[end] == "." and text[end + 1] in DIGITS:
            last = end + 1
        else:
            break
    found = []
    for i in range(0, len(runs) - 3, 4):
        parts = runs[i : i + 4]
        found.append((parts[0][0], parts[3][1], all(_small(text[a:b]) for a, b in parts)))
    return end, found


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _card(text: str, at: int) -> tuple[int, bool]:
    """(end of the chain of digits with single blanks or hyphens, whether it is a card number)."""
    end = at
    while True:
        end = _run(text, end, DIGITS)
        if end + 1 < len(text) and text[end] in " -" and text[end + 1] in DIGITS:
            end += 1
        else:
            break
    if end - at > 2 * 19:
        return end, False
    digits = "".join(c for c in text[at:end] if c in DIGITS)
    return end, 14 <= len(digits) <= 19 and _luhn(digits)


def _phone(text: str, at: int) -> tuple[int, int, bool] | None:
    """A plus sign, a digit, digits and signs, a digit; and whether there are 10 to 15 digits."""
    if at + 1 >= len(text) or text[at + 1] not in DIGITS:
        return None
    end = _run(text, at + 2, DIAL)
    while end > at + 3 and text[end - 1] not in DIGITS:
        end -= 1
    if end <= at + 3:
        return None
    # More characters than can hold 15 digits are counted only as far as needed.
    n = 0
    for i in range(at, end):
        n += text[i] in DIGITS
        if n > 15:
            break
    return at, end, 10 <= n <= 15


def _host(name: str) -> bool:
    """A name of two or more labels, or an address in brackets."""
    if name.startswith("[") and name.endswith("]"):
        return _ip6(name[1:-1])
    labels = name.split(".")
    return len(labels) > 1 and all(x and not x.startswith("-") and not x.endswith("-") and set(x) <= LABEL for x in labels)


def _url(text: str, at: int, done: int) -> tuple[int, int] | None:
    """An address whose authority names a user: scheme://user[:password]@host[:port]..."""
    begin = stop = at + 3
    while stop < len(text) and text[stop] not in URL_END and text[stop] not in "/?#":
        stop += 1
    start = _back(text, at, WORD | frozenset("+.-"), max(done, at - 32))
    while start < at and text[start] not in LOWER + UPPER:
        start += 1
    user, sign, host = text[begin:stop].rstrip(URL_TAIL).rpartition("@")
    if start == at or not sign or not user.split(":", 1)[0]:
        return None
    name, colon, port = host.rpartition(":")
    if colon and port.isascii() and port.isdigit():
        host = name
    if not _host(host):
        return None
    end = stop
    while end < len(text) and text[end] not in URL_END:
        end += 1
    while text[end - 1] in URL_TAIL:
        end -= 1
    return start, end


def _ip6(value: str) -> bool:
    """An IPv6 address of a network: no loopback, no unspecified one, at least three groups given."""
    if len(value) > 45 or sum(1 for g in value.split(":") if g) < 3:
        return False
    try:
        ipaddress.IPv6Address(value)
    except ValueError:
        return False
    return True


def _ip6_at(text: str, at: int, done: int) -> tuple[int, int, int] | None:
    """(start, end, end of the run) of an address around a colon."""
    allowed = HEX | frozenset(":.")
    start, end = _back(text, at, allowed, max(done, at - 45)), _run(text, at, allowed, at + 46)
    stop = end
    while end > at and text[end - 1] in ".:" and not text[start:end].endswith("::"):
        end -= 1
    # Nothing that goes on as a word or a longer run.
    if (start and text[start - 1] in WORD | frozenset(":")) or (end < len(text) and text[end] in WORD | frozenset(":")):
        return None
    return (start, end, stop) if _ip6(text[start:end]) else None


def _mod97(value: str) -> bool:
    value = value[4:] + value[:4]
    return int("".join(str(int(c, 36)) for c in value)) % 97 == 1


def _account(text: str, at: int, end: int) -> tuple[str, int, int] | None:
    """(kind, start, end) of the identifier after the cue at `at`..`end`."""
    if (at and text[at - 1].isalnum()) or (end < len(text) and text[end].isalnum()):
        return None
    begin, reach = end, end + REACH
    while True:
        begin = _run(text, begin, BETWEEN, reach)
        word_end = _run(text, begin, WORD, begin + MOST + 1)
        if text[begin:word_end].lower() not in FILLERS:
            break
        begin = word_end
    if begin >= reach or begin == end:
        return None
    # Groups of letters and digits joined by single blanks or hyphens, each with a digit.
    stop, n = begin, 0
    while True:
        after = _run(text, stop, WORD, stop + MOST + 1)
        group = text[stop:after]
        if not any(c in DIGITS for c in group) or n + len(group) > MOST:
            break
        n += len(group)
        last = after
        if after + 1 < len(text) and text[after] in " -" and text[after + 1] in WORD:
            stop = after + 1
        else:
            break
    if n == 0:
        return None
    if last < len(text) and text[last].isalnum():
        return None
    value = "".join(c for c in text[begin:last] if c in WORD).upper()
    if 15 <= len(value) <= MOST and value[:2].isalpha() and value[2:4].isdigit() and _mod97(value):
        return "iban", begin, last
    if LEAST <= len(value) and sum(c in DIGITS for c in value) >= LEAST_DIGITS:
        return "account", begin, last
    return None


def spans_of(text: str) -> list[tuple[int, int, int]]:
    """Sorted (start, index of the kind, end) of all spans of a text, in code points."""
    found: list[tuple[int, int, int]] = []
    more: list[tuple[int, int, int]] = []
    order = {k: i for i, k in enumerate(KINDS)}
    # Where the next match of a kind may start.
    done = dict.fromkeys((*KINDS, "chain"), 0)

    def put(out, kind, start, end):
        out.append((start, order[kind], end))
        done[kind] = end

    for last, (anchor, size) in _automaton().iter(text):
        at = last + 1 - size
        if anchor == "number":
            if at >= done["chain"]:
                done["chain"], four = _addresses(text, at)
                for start, end, good in four:
                    if good:
                        put(found, "ip", start, end)
            if at >= done["card"]:
                done["card"], good = _card(text, at)
                if good:
                    found.append((at, order["card"], done["card"]))
        elif anchor == "email":
            span = _email(text, at, done["email"])
            if span:
                put(found, "email", *span)
        elif anchor == "phone":
            span = _phone(text, at)
            if span and span[2]:
                put(found, "phone", *span[:2])
        elif anchor == "url":
            span = _url(text, at, done["url"]) if at >= done["url"] else None
            if span:
                put(more, "url", *span)
        elif anchor == "ip6":
            if at >= done["ip6"]:
                span = _ip6_at(text, at, done["ip6"])
                if span:
                    more.append((span[0], order["ip6"], span[1]))
                    done["ip6"] = span[2]
        elif at >= done["account"]:
            span = _account(text, at, last + 1)
            if span:
                more.append((span[1], order[span[0]], span[2]))
                done["account"] = span[2]
    # What a base span covers whole adds nothing.
    found.sort()
    starts, ends = [s for s, _, _ in found], list(itertools.accumulate((e for _, _, e in found), max))
    for span in more:
        before = bisect.bisect_right(starts, span[0])
        if not before or ends[before - 1] < span[2]:
            found.append(span)
    return sorted(found)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id and spans (array of kind, start, end), in code points, by start.

    Method. One Aho-Corasick pass over a text gives its anchors: at-signs, digits, plus signs,
    `://`, colons and identifier cues. From each anchor a parser walks outwards to the bounds
    and checks what it has: e-mail (local part, two or more labels), IPv4 (four parts up to 255),
    card (14 to 19 digits, Luhn), phone (plus sign, 10 to 15 digits); and beyond these `url`
    (a scheme and an authority with a user), `ip6`, `iban` (check digits) and `account` (six or
    more digits after a cue). Each of the first four equals the leftmost matches of its
    pattern, which do not overlap; those that fail the check are dropped, with no second try.

    Edge cases: a null or empty text has no spans; a null doc_id is passed on; each of repeated
    rows is scanned; a long text is scanned whole, a row at a time; other columns are not
    read; an empty table gives an empty result.
    """
    source = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def find(batches):
        for batch in batches:
            spans = []
            for value in batch.column(1):
                body = value.as_py()
                spans.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans_of(body)] if body else [])
            fields = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.record_batch([batch.column(0), pa.array(spans, fields)], names=["doc_id", "spans"])

    return source.mapInArrow(find, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int>>")


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of docs with each span of `text` replaced by its kind in brackets; overlapping spans by the first one's.

    A null text stays null; all columns and rows stay as they are.
    """
    schema = docs.schema
    index = docs.columns.index(text)

    def cut(batches):
        for batch in batches:
            out = []
            for value in batch.column(index):
                body = value.as_py()
                if body:
                    parts, at, end = [], 0, 0
                    for start, kind, stop in spans_of(body):
                        if start >= end:
                            parts += [body[at:start], f"[{KINDS[kind]}]"]
                        at = end = max(end, stop)
                    body = "".join([*parts, body[at:]])
                out.append(body)
            yield batch.set_column(index, batch.schema.field(index), pa.array(out, batch.schema.field(index).type))

    return docs.mapInArrow(cut, schema)


def _of(kinds: tuple[str, ...]) -> Column:
    return F.filter("spans", lambda s: s["kind"].isin(*kinds))


def _joined(kinds: tuple[str, ...]) -> Column:
    return F.array_join(F.transform(_of(kinds), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [F.size(_of((k,))).cast("long").alias(f"n_{k}") for k in BASE]
    found = scan(documents(spark, sf_dir))
    return found.select("doc_id", *counts, F.sha2(_joined(BASE), 256).alias("base_sha256"), _joined(KINDS).alias("spans"))


QUERIES = {"op11_private_data": op11}
# The method's own spans need parsers and check digits: tests hold the base against its patterns.
SQL: dict[str, str] = {}

by_value(__name__)
