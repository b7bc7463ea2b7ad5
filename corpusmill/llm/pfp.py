"""Suffix-array dedup of long repeated strings by prefix-free parsing.

A byte goes if it is covered by a ``length``-byte string that also starts in a
document with a smaller id. Strings are judged on the input and never cross
documents.

Parse. A rolling hash goes over every ``TRIGGER`` bytes of a text. A place triggers if
its hash is the least in some string of ``length`` bytes that holds it (equal hashes:
the leftmost). So every such string has exactly one trigger, found from its content
alone, and strings that share their trigger form one phrase: a run of starting places,
with ``length - 1`` bytes more so that no string leaves its phrase. Equal strings get
equal triggers wherever they stand. The corpus becomes a dictionary of distinct phrases
and, for each document, its sequence of phrases (the parse).

Ranks of the parse. Documents are dealt into parts of ``PART`` bytes by ranges of ids.
A part sends each of its distinct phrases once, as hashes: one row (trigger, content,
part). Spark sorts these rows by trigger, content and part. Read in that order, the first row of
a phrase is its least part, and all others are answered at once: the whole phrase
starts in a smaller document. Phrases that share their trigger with no other phrase
need nothing more, as no string of theirs has a neighbour. The others, in their least
part only, are asked for their bytes.

Suffix array of the dictionary. Spark deals the phrases asked for by trigger. Their suffixes are
sorted to the depth of ``length`` bytes; neighbours that agree to that depth are one
string, and a run of them holds the least document of that string. All phrases of a
trigger are sorted in one array, a few thousand triggers at a time. A trigger of more than ``SHARE``
phrases is no group anywhere: its suffixes are rows, which Spark itself sorts.

Corpus order. A part reads its answers, (phrase, run of strings that start in a smaller
document), and its parse carries them to all places where the phrase stands. Order is
needed to ``length`` bytes only, and as every phrase is that deep, its rank alone is the
rank of the parse from there: doubling the depth (phrase pairs, and so on) would tell
nothing more.

Rows follow bytes: a phrase in some 14 bytes of text, none by pairs of parts. A phrase
is known by 96 bits (44 of its trigger, 52 of its content); where one trigger has
several phrases, bytes decide. Every document is read whole, hashed in chunks of bounded memory.

Defined cases: a null or empty text has 0 bytes and nothing removed; texts shorter
than ``length`` stay; repeats within one document stay; rows with equal ids count as
one document, so copies under one id stay, and meet in one part; a null id counts as the smallest;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MIX, NO_ID, frugal, frugal_cogroup, frugal_group, mixed, range_bounds, range_bucket

LENGTH, TRIGGER, CHUNK, PART, SHARE = 50, 24, 1 << 18, 8 << 20, 4096
#: Hash bits of a trigger, of a content beside the trigger, and of a content beside the part.
T_BITS, C_HIGH, C_LOW = 44, 20, 32
LOW = np.int64((1 << C_LOW) - 1)
#: What is asked of or answered to a phrase; others are a run of its strings, first << 16 | last + 1.
WHOLE, BRING, BRING_STRINGS = 0, -1, -2
TOLD = "a long, b long, span int"
PHRASE = "key long, doc long, a long, b long, at int, data binary"
#: Odd numbers: the bases of the rolling hashes of triggers and of contents.
BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)


@lru_cache(maxsize=8)
def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of a base and of its inverse, modulo 2 ** 64."""
    out = []
    for x in (base, pow(base, -1, 1 << 64)):
        steps = np.full(n, np.uint64(x))
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


class Rolling:
    """Rolling polynomial hashes of all stretches of a chunk, from one running sum."""

    def __init__(self, buf: np.ndarray, base: int) -> None:
        self.power, self.inverse = powers(base, CHUNK + 2 * LENGTH if len(buf) < CHUNK + 2 * LENGTH else len(buf) + 1)
        values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(base))
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(values[buf] * self.power[: len(buf)], out=self.sums[1:])

    def windows(self, width: int) -> np.ndarray:
        """The hash of the ``width`` bytes from each place."""
        n = len(self.sums) - width
        return mixed((self.sums[width:] - self.sums[:n]) * self.inverse[:n])

    def stretches(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return mixed((self.sums[start + size] - self.sums[start]) * self.inverse[start] ^ size.astype(np.uint64))


class Phrases:
    """The phrases of a part's documents, in order: start, strings (how many), trigger, content, document.

    Starts count from the first byte of all documents end to end.
    """

    def __init__(self, texts: list[bytes], length: int) -> None:
        self.length = length
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.buf = np.frombuffer(b"".join(texts), np.uint8)
        found = [self._chunk(a, min(a + CHUNK + length - 1, len(self.buf))) for a in range(0, max(0, len(self.buf) - length + 1), CHUNK)]
        kinds = (np.int64, np.int64, np.uint64, np.uint64)
        self.start, self.count, self.trigger, self.content = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, t) for i, t in enumerate(kinds))
        self.doc = np.searchsorted(self.ends, self.start, "right")

    def _chunk(self, a: int, b: int) -> tuple[np.ndarray, ...]:
        buf, length = self.buf[a:b], self.length
        width = min(TRIGGER, length)
        hashes = Rolling(buf, BASES[0]).windows(width)
        bits = np.uint64(len(hashes).bit_length())
        low = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)  # ties: the leftmost
        span, reach = length - width + 1, 1
        while reach * 2 <= span:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if reach < span:
            low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
        place = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)  # of the trigger of the string at each start
        whole = np.ones(len(place), bool)  # strings inside one document
        inside = self.ends[(self.ends > a) & (self.ends < b)] - a
        cut = (inside[:, None] - np.arange(1, length)).ravel()
        whole[cut[(cut >= 0) & (cut < len(whole))]] = False
        change = np.ones(len(place), bool)
        change[1:] = (place[1:] != place[:-1]) | ~whole[:-1]
        change[inside[inside < len(change)]] = True
        first = np.flatnonzero(whole & change)
        last = np.ones(len(place), bool)
        last[:-1] = change[1:] | ~whole[1:]
        count = np.flatnonzero(whole & last) - first + 1
        return first + a, count, hashes[place[first]], Rolling(buf, BASES[1]).stretches(first, count + length - 1)


class Part:
    """A part's documents and their distinct phrases, each at its first place: in the least document of the part.

    ``a``: trigger and upper content; ``b``: lower content; ascending by both. ``of``: the distinct phrase of each phrase.
    """

    def __init__(self, texts: pa.Table, length: int) -> None:
        data = [zstandard.decompress(x) for x in texts.column("_data").to_pylist()]
        self.rows = sorted(range(len(data)), key=list(zip(texts.column("_id").to_pylist(), data, strict=True)).__getitem__)
        self.data = [data[k] for k in self.rows]
        self.ids = texts.column("_id").to_numpy()[self.rows]
        self.rank = np.cumsum(np.concatenate([[0], self.ids[1:] != self.ids[:-1]])) if len(data) else np.zeros(0, np.int64)
        self.parse = p = Phrases(self.data, length)
        a = (p.trigger >> np.uint64(64 - T_BITS) << np.uint64(C_HIGH) | p.content >> np.uint64(64 - C_HIGH)).view(np.int64)
        b = (p.content >> np.uint64(64 - C_HIGH - C_LOW)).view(np.int64) & LOW
        order = np.lexsort((b, a))  # stable
        new = changes(a[order], b[order])
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.first = order[new]
        self.a, self.b = a[self.first], b[self.first]

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The numbers of distinct phrases of this part by their hashes."""
        at, b = np.searchsorted(self.a, a), b & LOW
        while (off := np.flatnonzero((self.a[at] != a) | (self.b[at] != b))).size:
            at[off] += 1
        return at


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def table(schema: str, *columns: object) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    named = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, named, strict=True)], [n for n, _ in named])


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number within the row) of ``counts`` items a row."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def whole_characters(gone: np.ndarray, text: bytes) -> np.ndarray:
    """``gone`` without the bytes of characters that stay in part."""
    data = np.frombuffer(text, np.uint8)
    if not (data > 127).any():
        return gone
    head = np.flatnonzero((data & 0xC0) != 0x80)
    size = np.diff(np.append(head, len(data)))
    return np.repeat(np.add.reduceat(gone, head, dtype=np.int64) == size, size)


def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one, as they travel."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        at = batch.schema.names.index("_data")
        packed = pa.array([pack(x or b"") for x in batch.column(at).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([packed if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)


def send_phrases(length: int) -> Callable[[pa.Table], pa.Table]:
    """A row for each distinct phrase of a part."""

    def run(texts: pa.Table) -> pa.Table:
        part, x = np.int64(texts.column("_part")[0].as_py()), Part(texts, length)
        return pa.Table.from_batches([table("a long, b long", x.a, x.b | part << C_LOW)])

    return run


def rank_phrases(nameless: int, share: int, asks: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows sorted by trigger, content and part: WHOLE for all but a phrase's first part; or, if ``asks``, BRING
    for the first part of phrases that share their trigger (BRING_STRINGS, if with more than ``share`` phrases)."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        before, open_a, open_b, hot = (None, None), none, none, None
        for a, b in (x for batch in batches for x in [tuple(c.to_numpy() for c in batch.columns)] if len(x[0])):
            new = changes(a, b & LOW)
            new[0] = (a[0], b[0] & LOW) != before
            before = (a[-1], b[-1] & LOW)
            if not asks:
                again = ~new & (b >> C_LOW >= nameless)  # a null id is the smallest: nothing is before it
                yield table(TOLD, a[again], b[again], np.full(int(again.sum()), WHOLE))
                continue
            # one row a phrase; the last trigger's may go on in the next batch
            a, b = np.concatenate([open_a, a[new]]), np.concatenate([open_b, b[new]])
            if not len(a):
                continue
            trigger = a >> C_HIGH
            cut = int(np.searchsorted(trigger, trigger[-1]))
            if len(a) - cut > share or trigger[-1] == hot:
                open_a = open_b = none
                yield ask(a, b, hot)
                hot = trigger[-1]
            else:
                open_a, open_b = a[cut:], b[cut:]
                yield ask(a[:cut], b[:cut], hot)
        if asks:
            yield ask(open_a, open_b, hot)

    def ask(a: np.ndarray, b: np.ndarray, hot: int | None) -> pa.RecordBatch:
        trigger = a >> C_HIGH
        head = changes(trigger)
        size = np.diff(np.append(np.flatnonzero(head), len(a)))[np.cumsum(head) - 1] if len(a) else np.zeros(0, np.int64)
        many = (size > share) | (trigger == hot) if hot is not None else size > share
        some = many | (size > 1)
        return table(TOLD, a[some], b[some], np.where(many, BRING_STRINGS, BRING)[some])

    return run


def bring_phrases(length: int, nameless: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The bytes of the phrases asked for, or their strings row by row (``at``: which string)."""

    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        a, b, span = (told.column(c).to_numpy() for c in ("a", "b", "span"))
        if not told.num_rows or not texts.num_rows:
            return pa.Table.from_batches([], schema=table(PHRASE, *[[]] * 6).schema)
        x, part = Part(texts, length), texts.column("_part")[0].as_py()
        strings = span == BRING_STRINGS
        place = x.first[x.find(a, b)]
        start, count = x.parse.start[place], x.parse.count[place]
        doc = x.rank[x.parse.doc[place]] + (np.int64(part) << 32) if part >= nameless else np.full(len(place), -1)
        calm, hot = np.flatnonzero(~strings), np.flatnonzero(strings)
        view, made = memoryview(x.parse.buf), []
        data = [bytes(view[s : s + n + length - 1]) for s, n in zip(start[calm].tolist(), count[calm].tolist(), strict=True)]
        made.append(table(PHRASE, a[calm] >> C_HIGH & ((1 << T_BITS) - 1), doc[calm], a[calm], b[calm], np.full(len(calm), -1), data))
        for k in range(0, len(hot), 1024):
            row, at = spread(count[hot[k : k + 1024]])
            row, first = hot[k : k + 1024][row], start[hot[k : k + 1024]][row] + at
            data = np.lib.stride_tricks.sliding_window_view(x.parse.buf, length)[first]
            made.append(table(PHRASE, ~string_keys(data), doc[row], a[row], b[row], at, [d.tobytes() for d in data]))
        return pa.Table.from_batches(made)

    return run


def string_keys(strings: np.ndarray) -> np.ndarray:
    """Hashes of rows of bytes, not negative."""
    h = np.full(len(strings), MIX)
    for k in range(strings.shape[1]):
        h = (h ^ strings[:, k]) * np.uint64(BASES[0])
    return (mixed(h) >> np.uint64(1)).view(np.int64)


def sort_dictionary(length: int, load: int = 1 << 15) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Which strings of each phrase a smaller document has, from rows sorted by key, data and document."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        before, least = (None, None), 0
        for batch in batches:
            single = batch.column("at").to_numpy() >= 0
            if single.any():  # strings: equal ones are neighbours already
                some = batch.filter(pa.array(single))
                key, doc, a, b, at = (some.column(c).to_numpy() for c in ("key", "doc", "a", "b", "at"))
                data = fixed(some.column("data"), length)
                new = changes(key, data) if len(key) else np.zeros(0, bool)
                new[0] = (key[0], data[0].tobytes()) != before
                start = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
                low = np.where(start < 0, least, doc[start])
                before, least = (key[-1], data[-1].tobytes()), low[-1]
                yield table(TOLD, a[low < doc], b[low < doc], (at << 16 | at + 1)[low < doc])
            if not single.all():
                held.append(batch.filter(pa.array(~single)))
            if sum(x.num_rows for x in held) >= load:
                rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                key = rows.column("key").to_numpy()
                cut = int(np.searchsorted(key, key[-1]))
                if cut:
                    yield suffixes(rows.slice(0, cut))
                    held = [rows.slice(cut)]
        if held:
            yield suffixes(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    def suffixes(rows: pa.RecordBatch) -> pa.RecordBatch:
        doc, a, b = (rows.column(c).to_numpy() for c in ("doc", "a", "b"))
        column = rows.column("data")
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(column.buffers()[2], np.uint8)
        row, at = spread(np.diff(ends) - length + 1)
        strings = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, length)[ends[row] + at])
        array = np.argsort(strings.view(f"S{length}")[:, 0])  # every suffix is as long as its type, so trailing zero bytes do not matter
        heads = np.flatnonzero(changes(fixed_view(strings[array])))
        low = np.minimum.reduceat(doc[row[array]], heads)
        smaller = np.empty(len(row), bool)
        smaller[array] = np.repeat(low, np.diff(np.append(heads, len(array)))) < doc[row[array]]
        opens, closes = smaller.copy(), smaller.copy()
        opens[1:] &= ~smaller[:-1] | (at[1:] == 0)
        closes[:-1] &= ~smaller[1:] | (at[1:] == 0)
        first, last = np.flatnonzero(opens), np.flatnonzero(closes)
        return table(TOLD, a[row[first]], b[row[first]], at[first] << 16 | at[last] + 1)

    return run


def fixed(column: pa.Array, length: int) -> np.ndarray:
    """Values of one length, each as one item."""
    data = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, length)
    return fixed_view(data)


def fixed_view(data: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(data).view(f"V{data.shape[1]}")[:, 0]


def remove_runs(length: int, kept_as: str, others: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        x = Part(texts, length)
        p, mark = x.parse, np.zeros(len(x.parse.buf) + 1, np.int32)

        def cover(begin: np.ndarray, end: np.ndarray) -> None:
            np.add.at(mark, begin, 1)
            np.add.at(mark, end + length - 1, -1)

        rank = x.rank[p.doc]
        later = rank > rank[x.first[x.of]]  # a smaller document of this part has the whole phrase
        a, b, span = (told.column(c).to_numpy() for c in ("a", "b", "span"))
        which = x.find(a, b)
        whole = np.zeros(len(x.first), bool)
        whole[which[span == WHOLE]] = True
        gone = np.flatnonzero(later | whole[x.of])
        cover(p.start[gone], p.start[gone] + p.count[gone])
        run = np.flatnonzero(span)
        if len(run):  # at all places of each answered phrase in its least document
            stay = np.flatnonzero(~later)
            stay = stay[np.argsort(x.of[stay], kind="stable")]
            of = x.of[stay]
            lo, hi = np.searchsorted(of, which[run]), np.searchsorted(of, which[run], "right")
            row, n = spread(hi - lo)
            place, code = p.start[stay[lo[row] + n]], span[run][row].astype(np.int64)
            cover(place + (code >> 16), place + (code & 0xFFFF))
        gone = np.cumsum(mark[:-1]) > 0
        out: list[list] = [[] for _ in range(6 if kept_as else 5)]
        for i, text, end in zip(x.ids.tolist(), x.data, p.ends.tolist(), strict=True):
            g = gone[end - len(text) : end]
            some = bool(g.any())
            data = np.frombuffer(text, np.uint8)
            kept = data[~g].tobytes() if some else text
            if kept_as == "text":
                out[5].append((data[~whole_characters(g, text)].tobytes() if some else text).decode("utf-8", "replace"))
            elif kept_as == "bytes":
                out[5].append(kept)
            spans = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()) if some else 0
            for column, v in zip(out, (None if i == NO_ID else i, len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest()), strict=False):
                column.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string() if kept_as == "text" else pa.binary())
        named = ["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        made = {k: pa.array(v, kind) for v, k, kind in zip(out, named, kinds, strict=False)}
        made |= {f"o{k}": texts.column(f"o{k}").take(pa.array(x.rows, pa.int64())) for k in range(len(others))}
        return pa.table(list(made.values()), names=list(made))

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", part: int = PART, share: int = SHARE, kept: bool = True) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes of every document."""
    made = _removed(docs, length, id_col, text_col, "bytes" if kept else "", part, share, [])
    return made.withColumnRenamed("_id", id_col)


def without_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", part: int = PART, share: int = SHARE) -> DataFrame:
    """``docs`` with the repeats taken from its texts; characters that go in part stay whole."""
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    made = _removed(docs, length, id_col, text_col, "text", part, share, others)
    place = {id_col: "_id", text_col: "kept"} | {c: f"o{k}" for k, c in enumerate(others)}
    return made.select(*(F.col(place[c]).cast(t).alias(c) for c, t in docs.dtypes))


def _removed(docs: DataFrame, length: int, id_col: str, text_col: str, kept_as: str, part: int, share: int, others: list[str]) -> DataFrame:
    ident, data = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string").cast("binary")
    slim = docs.select(ident.alias("_id"), F.coalesce(data, F.lit(b"")).alias("_data"), *(F.col(f"`{c}`").alias(f"o{k}") for k, c in enumerate(others)))
    size = F.octet_length("_data") + F.lit(1)
    known, unknown = slim.agg(F.sum(F.when(F.col("_id").isNotNull(), size)), F.sum(F.when(F.col("_id").isNull(), size))).first()
    bounds = range_bounds(slim.where("_id IS NOT NULL"), "_id", -(-(known or 0) // part))
    nameless = -(-(unknown or 0) // part)  # parts of null ids: the first ones
    number = F.when(F.col("_id").isNull(), F.pmod(F.xxhash64("_data"), F.lit(max(1, nameless)))).otherwise(range_bucket(F.col("_id"), bounds, "long") + nameless)
    texts = slim.select(number.cast("int").alias("_part"), F.coalesce("_id", F.lit(NO_ID)).alias("_id"), *slim.columns[1:])
    texts = texts.mapInArrow(squeeze, texts.schema)  # one shuffle serves all three readings
    of_part, of_told = texts.groupBy("_part"), F.shiftright("b", C_LOW).cast("int").alias("_part")
    phrases = of_part.applyInArrow(frugal_group(send_phrases(length)), "a long, b long")
    sorted_phrases = phrases.repartition(F.shiftright("a", C_HIGH)).sortWithinPartitions("a", F.col("b").bitwiseAND(int(LOW)), "b")
    asks, told = (sorted_phrases.mapInArrow(rank_phrases(nameless, share, x), TOLD) for x in (True, False))
    asked = of_part.cogroup(asks.groupBy(of_told)).applyInArrow(frugal_cogroup(bring_phrases(length, nameless)), PHRASE)
    answers = asked.repartition("key").sortWithinPartitions("key", "data", "doc").mapInArrow(sort_dictionary(length), TOLD)
    types = dict(docs.dtypes)
    schema = "_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + {"bytes": ", kept binary", "text": ", kept string", "": ""}[kept_as] + "".join(f", o{k} {types[c]}" for k, c in enumerate(others))
    return of_part.cogroup(told.union(answers).groupBy(of_told)).applyInArrow(frugal_cogroup(remove_runs(length, kept_as, others)), schema)


def op7_prefix_free_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), kept=False)
