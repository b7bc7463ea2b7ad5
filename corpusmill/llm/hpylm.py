"""Language-model scoring with a hierarchical Pitman-Yor model.

Levels: the base knows one unseen word and every training word alike; one unigram
restaurant is its child; and every word has a context restaurant for the tokens after
it, a child of the unigram restaurant. A customer of a context is a training token;
every table of it sends one customer to the parent. Predictive probabilities go down
the levels:

    P(w | context) = (c_w - d t_w + (theta + d t.) P_parent(w)) / (theta + c.)

Seating is sampled by blocked Gibbs: in each of ``SWEEPS`` sweeps, all seats of a dish are
drawn anew from their conditional distribution, given the rest. For a dish of c customers
that is S(c, t) g ** t for t tables, with S the generalised Stirling numbers of the
discount and g = (theta + d t.) P_parent(w); beyond ``EXACT`` customers they are seated in order,
each at a new table with odds g to n - d t, from 64 seated on in blocks of a sixteenth of those
seated. Tables are averaged over the sweeps, and so are, being linear in them, the
predictive probabilities.

Levels are sampled once from the bottom up, not in turn: while a context's dishes are drawn, P_parent(w) is
the word's share of all training tokens, and t. what a restaurant of so many customers has on
average, (c. ** d) / d * Gamma(theta + 1) / Gamma(theta + d). Then the parent's dishes are drawn given the tables
of all contexts. Drawing both in turn would carry all pairs through further shuffles.

Spark: documents are dealt into parts of ``PART`` bytes by a hash of their id, so that nothing hangs on the number of
shuffle partitions. A part sends each of its distinct words with its training count, and is told the sums;
then each of its distinct (context, word) pairs once, to a task that sums and
seats the pair; the answer lets one owner among the parts add the pair's tables to
its sums by word and by context, which go to the tasks of the parent level; with their
answers each part scores its own documents. What is sent grows with the distinct pairs of
the parts; a frequent pair or word is sent once a part.

Defined cases: a null or empty text is its end alone; a null id trains (its text is
empty, of checksum 0); rows with equal ids are scored each, and train each if the id
does; without training tokens every word is unknown and both scores are those of the
base; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable
from functools import lru_cache
from math import lgamma

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, mixed, text_or_empty
from .pfp import squeeze
from .simhash import LOWER

PART, SWEEPS, EXACT, SEED = 24 << 20, 4, 128, 20
DISCOUNT, STRENGTH = 0.8, 2.0  # of context restaurants
TOP_DISCOUNT, TOP_STRENGTH = 0.7, 2.0  # of the unigram restaurant
HELD_OUT, FOLDS = 2, 7
END = xxhash.xxh64_intdigest(b"\n")  # no word has this content
STEPS = 8.0  # in which the logarithm of odds is sent

MESSAGE = "_to int, _part int, _kind int, _data binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes: text and small numbers shrink by more than Spark's own compression makes of them."""
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], "<i8")
    return zstandard.compress(b"".join([head.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)]), 3)


def unpack(data: bytes, *kinds: type) -> list[np.ndarray]:
    data = zstandard.decompress(data)
    n = int(np.frombuffer(data, "<i8", 1)[0])
    at, out = 8 * (n + 1), []
    for size, kind in zip(np.frombuffer(data, "<i8", n, 8).tolist(), kinds, strict=True):
        out.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def messages(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["_to", "_part", "_kind", "_data"])


def deal(bucket: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(bucket, row numbers) for each bucket that occurs."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    return [(int(bucket[g[0]]), g) for g in np.split(order, cuts) if len(g)]


def fold(i: int) -> int:
    return zlib.crc32(b"" if i == NO_ID else str(i).encode()) % FOLDS


def small(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts as single bytes, and those from 255 on beside them."""
    large = np.flatnonzero(values >= 255)
    return np.minimum(values, 255).astype("u1"), large.astype("<u4"), values[large].astype("<u4")


def full(low: np.ndarray, at: np.ndarray, large: np.ndarray) -> np.ndarray:
    out = low.astype(np.int64)
    out[at] = large
    return out


class Tokens:
    """The tokens of a part: word numbers, their hashes, contexts (the word before), documents."""

    def __init__(self, texts: pa.Table) -> None:
        found = sorted(zip(texts.column("_id").to_pylist(), map(zstandard.decompress, texts.column("_data").to_pylist()), strict=True))
        index: defaultdict = defaultdict()
        index.default_factory = index.__len__
        index[None]  # the end is word 0
        self.ids = [i for i, _ in found]
        lists = []
        for _, text in found:
            words = text.translate(LOWER).split()
            lists.append(np.fromiter((index[w] for w in words), np.int32, len(words)))
            lists.append(np.zeros(1, np.int32))
        self.word = np.concatenate(lists) if lists else np.zeros(0, np.int32)
        self.ends = np.flatnonzero(self.word == 0) + 1
        self.sizes = np.diff(self.ends, prepend=0)
        self.hash = np.array([END if w is None else xxhash.xxh64_intdigest(w) for w in index], np.uint64)
        self.train = np.repeat(np.array([fold(i) != HELD_OUT for i in self.ids], bool), self.sizes)
        self.word_count = np.bincount(self.word, self.train, len(self.hash)).astype(np.int64)

    def pair(self) -> Tokens:
        """Distinct (context, word) pairs too: ``pairs`` (hashes), their words, contexts and counts, and ``of`` each token."""
        before = np.concatenate([[0], self.word[:-1]]).astype(np.int64) if len(self.word) else np.zeros(0, np.int64)
        key = mixed(self.hash[self.word] ^ mixed(self.hash[before] + np.uint64(0xC2B2AE3D27D4EB4F)))
        self.pairs, first, self.of = np.unique(key, return_index=True, return_inverse=True)
        self.pair_word, self.pair_context = self.word[first], before[first]
        self.pair_count = np.bincount(self.of, self.train, len(self.pairs)).astype(np.int64)
        return self


@lru_cache(maxsize=4)
def stirling(discount: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S(c, t) for c and t up to ``EXACT``."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(EXACT + 1)
    with np.errstate(divide="ignore"):
        for c in range(1, EXACT + 1):
            stay = out[c - 1] + np.log(np.maximum(c - 1 - discount * t, 0))
            out[c] = np.logaddexp(np.concatenate([[-np.inf], out[c - 1, :-1]]), stay)
    return out


def usual_tables(customers: np.ndarray, discount: float, strength: float) -> np.ndarray:
    """How many tables a restaurant of so many customers has on average."""
    return np.maximum(customers.astype(np.float64), 1.0) ** discount * np.exp(lgamma(strength + 1) - lgamma(strength + discount)) / discount


def draw(customers: np.ndarray, odds: np.ndarray, discount: float, rng: np.random.Generator, sweeps: int = SWEEPS) -> np.ndarray:
    """Average number of tables over sweeps, each drawn from its conditional distribution."""
    out = np.minimum(customers, 1).astype(np.float64)
    logs = stirling(discount)
    for c in np.unique(customers[(customers > 1) & (customers <= EXACT)]).tolist():
        rows = np.flatnonzero(customers == c)
        for at in range(0, len(rows), max(1, (1 << 20) // c)):
            some = rows[at : at + max(1, (1 << 20) // c)]
            log = logs[c, 1 : c + 1] + np.log(odds[some])[:, None] * np.arange(1, c + 1)
            total = np.cumsum(np.exp(log - log.max(1, keepdims=True)), axis=1)
            drawn = rng.random((len(some), sweeps)) * total[:, -1:]
            out[some] = 1 + (total[:, None, :-1] <= drawn[:, :, None]).sum(2).mean(1)
    many = np.flatnonzero(customers > EXACT)
    out[many] = seat(customers[many], odds[many], discount, rng, sweeps)
    return out


def seat(customers: np.ndarray, odds: np.ndarray, discount: float, rng: np.random.Generator, sweeps: int = SWEEPS) -> np.ndarray:
    """Average number of tables over sweeps of seating ``customers`` of a dish from the first on."""
    out = np.minimum(customers, 1).astype(np.float64)
    many = np.flatnonzero(customers > 1)
    if not len(many):
        return out
    order = many[np.argsort(-customers[many], kind="stable")]  # those still coming are a prefix
    c, g = customers[order], odds[order]
    total = np.zeros(len(c))
    for _ in range(sweeps):
        n, t = np.ones(len(c), np.int64), np.ones(len(c))
        coming = len(c)
        while coming:
            m, k = n[:coming], t[:coming]
            block = np.minimum(c[:coming] - m, np.where(m < 64, 1, m // 16))
            p = g[:coming] / (g[:coming] + m - discount * k)
            k += rng.binomial(block, p)
            m += block
            left = np.flatnonzero(c[:coming] > m)
            coming = int(left[-1]) + 1 if len(left) else 0
        total += t
    out[order] = total / sweeps
    return out


def in_order(received: pa.Table, kind: int) -> list[tuple[int, bytes]]:
    rows = zip(*(received.column(c).to_pylist() for c in ("_kind", "_part", "_data")), strict=True)
    return sorted(((p, d) for k, p, d in rows if k == kind), key=lambda r: r[0])


def word_bucket(x: Tokens, buckets: int) -> list[tuple[int, np.ndarray]]:
    return deal((mixed(x.hash) >> np.uint64(8)) % np.uint64(buckets)) if len(x.word) else []


def send_words(buckets: int) -> Callable[[pa.Table], pa.Table]:
    def run(texts: pa.Table) -> pa.Table:
        part, x = texts.column("_to")[0].as_py(), Tokens(texts)
        return messages([(b, part, 0, pack(x.hash[g], *small(x.word_count[g]))) for b, g in word_bucket(x, buckets)])

    return run


def sum_words(parts: int) -> Callable[[pa.Table], pa.Table]:
    """Sum the words of a bucket; tell each part the sums in the order sent, and all parts the totals."""

    def run(received: pa.Table) -> pa.Table:
        bucket, sent = received.column("_to")[0].as_py(), in_order(received, 0)
        data = [unpack(d, "<u8", "u1", "<u4", "<u4") for _, d in sent]
        _, of = np.unique(np.concatenate([x[0] for x in data]), return_inverse=True)
        count = np.bincount(of, np.concatenate([full(*x[1:4]) for x in data])).astype(np.int64)
        totals = np.array([count.sum(), (count > 0).sum(), (count == 1).sum()], "<i8")
        own, at = {}, 0
        for (part, _), x in zip(sent, data, strict=True):
            own[part] = small(count[of[at : at + len(x[0])]])
            at += len(x[0])
        none = small(np.zeros(0, np.int64))
        return messages([(p, bucket, 6, pack(totals, *own.get(p, none))) for p in range(parts)])

    return run


class Told:
    """What a part was told of its words: ``count``, and of all: tokens, words, words seen once."""

    def __init__(self, x: Tokens, told: pa.Table, buckets: int) -> None:
        answers = {b: unpack(d, "<i8", "u1", "<u4", "<u4") for b, d in in_order(told, 6)}
        self.count = np.zeros(len(x.hash), np.int64)
        for b, g in word_bucket(x, buckets):
            self.count[g] = full(*answers[b][1:4])
        self.tokens, self.words, self.once = (sum((a[0] for a in answers.values()), np.zeros(3, np.int64))).tolist()


def send_pairs(buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return messages([])
        part, x = texts.column("_to")[0].as_py(), Tokens(texts).pair()
        known = Told(x, told, buckets)
        share = (known.count + 0.5) / (known.tokens + 0.5 * known.words + 1)
        odds = (STRENGTH + DISCOUNT * usual_tables(known.count, DISCOUNT, STRENGTH))[x.pair_context] * share[x.pair_word]
        sent = np.clip(np.rint(np.log2(odds) * STEPS) + 160, 0, 255).astype("u1")
        return messages([(b, part, 0, pack(x.pairs[g], *small(x.pair_count[g]), sent[g])) for b, g in deal((x.pairs >> np.uint64(32)) % np.uint64(buckets))])

    return run


def seat_pairs(received: pa.Table) -> pa.Table:
    """Sum and seat the pairs of a bucket; answer in the order sent."""
    bucket, sent = received.column("_to")[0].as_py(), in_order(received, 0)
    data = [unpack(d, "<u8", "u1", "<u4", "<u4", "u1") for _, d in sent]
    size = [len(x[0]) for x in data]
    _, first, of = np.unique(np.concatenate([x[0] for x in data]), return_index=True, return_inverse=True)
    count = np.bincount(of, np.concatenate([full(*x[1:4]) for x in data])).astype(np.int64)
    log_odds = np.concatenate([x[4] for x in data])[first].astype(np.float64)  # all parts send the same
    tables = draw(count, np.exp2((log_odds - 160) / STEPS), DISCOUNT, np.random.default_rng([SEED, 1, bucket]))
    owner = np.zeros(len(of), bool)
    owner[first] = True
    rows, at = [], 0
    for (part, _), n in zip(sent, size, strict=True):
        o, mine = of[at : at + n], owner[at : at + n]
        code = np.minimum(count[o], 2).astype("u1")
        more = o[code == 2]
        rows.append((part, bucket, 1, pack(code | (mine.astype("u1") << 7), count[more].astype("<u4"), tables[more].astype("<f4"))))
        at += n
    return messages(rows)


def told_pairs(x: Tokens, told: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Customers, tables and ownership of each pair of the part."""
    count, tables, owner = np.zeros(len(x.pairs), np.int64), np.zeros(len(x.pairs)), np.zeros(len(x.pairs), bool)
    answers = dict(in_order(told, 1))
    for b, g in deal((x.pairs >> np.uint64(32)) % np.uint64(buckets)):
        code, more, more_tables = unpack(answers[b], "u1", "<u4", "<f4")
        c = (code & 127).astype(np.int64)
        t = c.astype(np.float64)
        c[(code & 127) == 2], t[(code & 127) == 2] = more, more_tables
        count[g], tables[g], owner[g] = c, t, code >= 128
    return count, tables, owner


def send_tables(buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Tables of the part's own pairs, by word (customers of the parent) and by context."""

    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return messages([])
        part, x = texts.column("_to")[0].as_py(), Tokens(texts).pair()
        _, tables, owner = told_pairs(x, told, buckets)
        by_word, by_context = (np.bincount(at, tables * owner, len(x.hash)).astype("<f4") for at in (x.pair_word, x.pair_context))
        return messages([(b, part, 2, pack(x.hash[g], by_word[g], by_context[g])) for b, g in word_bucket(x, buckets)])

    return run


def seat_parents(parts: int, buckets: int) -> Callable[[pa.Table], pa.Table]:
    """Sum the tables of a bucket's words, seat the parent's customers, and tell each part in the order sent."""

    def run(received: pa.Table) -> pa.Table:
        bucket, sent = received.column("_to")[0].as_py(), in_order(received, 2)
        data = [unpack(d, "<u8", "<f4", "<f4") for _, d in sent]
        _, of = np.unique(np.concatenate([x[0] for x in data]), return_inverse=True)
        guests, inside = (np.bincount(of, np.concatenate([x[i] for x in data]).astype(np.float64)) for i in (1, 2))
        guests = np.rint(guests).astype(np.int64)
        known = max(1, int((guests > 0).sum()) * buckets)
        odds = np.full(len(guests), (TOP_STRENGTH + TOP_DISCOUNT * known) / known)  # the base gives every word alike
        tables = draw(guests, odds, TOP_DISCOUNT, np.random.default_rng([SEED, 2, bucket]))
        totals = np.array([guests.sum(), tables.sum()], "<f8")
        own, at = {}, 0
        for (part, _), x in zip(sent, data, strict=True):
            o = of[at : at + len(x[0])]
            own[part] = guests[o].astype("<u4"), tables[o].astype("<f4"), inside[o].astype("<f4")
            at += len(o)
        none = np.zeros(0, "<u4"), np.zeros(0, "<f4"), np.zeros(0, "<f4")
        return messages([(p, bucket, 4, pack(totals, *own.get(p, none))) for p in range(parts)])

    return run


def score_part(buckets: int, id_col: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]

    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        x = Tokens(texts).pair()
        known = Told(x, told, buckets)
        count, n, v = known.count, known.tokens, known.words
        pair_count, pair_tables, _ = told_pairs(x, told, buckets)
        guests, seats, inside, totals = np.zeros(len(x.hash)), np.zeros(len(x.hash)), np.zeros(len(x.hash)), np.zeros(2)
        answers = {b: unpack(d, "<f8", "<u4", "<f4", "<f4") for b, d in in_order(told, 4)}
        for a in answers.values():
            totals += a[0]
        for b, g in word_bucket(x, buckets):
            guests[g], seats[g], inside[g] = answers[b][1:4]
        all_guests, all_seats = totals
        to_base = (TOP_STRENGTH + TOP_DISCOUNT * all_seats) / (TOP_STRENGTH + all_guests)
        # the base's share of the unseen word: as many new words as words seen once foretell
        to_parent = (STRENGTH * v + DISCOUNT * all_guests) / max(1.0, n)
        unseen = float(np.clip(known.once / max(1.0, n) / max(1e-12, to_parent * to_base), 1 / (v + 1), 0.99)) if v else 1.0
        base = np.where(count > 0, (1 - unseen) / max(1.0, v), unseen)
        parent = (np.maximum(guests - TOP_DISCOUNT * seats, 0) + (TOP_STRENGTH + TOP_DISCOUNT * all_seats) * base) / (TOP_STRENGTH + all_guests)
        own = np.maximum(pair_count - DISCOUNT * pair_tables, 0) + (STRENGTH + DISCOUNT * inside[x.pair_context]) * parent[x.pair_word]
        pair_log = np.log10(own / (STRENGTH + count[x.pair_context]))  # every token of a word but no other is a customer of its context
        base_log = np.log10((count + 1) / (n + v + 1))
        starts = x.ends - x.sizes
        add = lambda values: np.add.reduceat(values, starts) if len(starts) else np.zeros(0)
        scores = add(pair_log[x.of])
        columns = [
            pa.array([None if i == NO_ID else i for i in x.ids], pa.int64()), pa.array([fold(i) == HELD_OUT for i in x.ids], pa.bool_()), pa.array(x.sizes, pa.int64()),
            pa.array(add((count > 0).astype(np.int64)[x.word]), pa.int64()), pa.array(np.full(len(x.ids), int(n)), pa.int64()),
            pa.array(add(base_log[x.word]), pa.float64()), pa.array(scores, pa.float64()), pa.array(10.0 ** np.minimum(300, -scores / np.maximum(1, x.sizes)), pa.float64()),
        ]
        return pa.table(columns, names=names)

    return run


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part: int = PART) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every document."""
    slim = docs.select(F.col(id_col).cast("long").alias("_id"), text_or_empty(text_col).cast("binary").alias("_data"))
    size = slim.agg(F.sum(F.octet_length("_data") + F.lit(1))).first()[0] or 1
    parts = buckets = -(-size // part)
    number = F.pmod(F.when(F.col("_id").isNull(), F.xxhash64("_data")).otherwise(F.xxhash64("_id")), F.lit(parts))
    texts = slim.select(number.cast("int").alias("_to"), F.coalesce("_id", F.lit(NO_ID)).alias("_id"), "_data")
    texts = texts.mapInArrow(squeeze, texts.schema)  # one shuffle serves all readings
    by_part = texts.groupBy("_to")
    words = by_part.applyInArrow(send_words(buckets), MESSAGE).groupBy("_to").applyInArrow(sum_words(parts), MESSAGE)
    pairs = by_part.cogroup(words.groupBy("_to")).applyInArrow(send_pairs(buckets), MESSAGE).groupBy("_to").applyInArrow(seat_pairs, MESSAGE)
    tables = by_part.cogroup(pairs.groupBy("_to")).applyInArrow(send_tables(buckets), MESSAGE)
    parents = tables.groupBy("_to").applyInArrow(seat_parents(parts, buckets), MESSAGE)
    schema = f"`{id_col}` bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double"
    return by_part.cogroup(words.union(pairs).union(parents).groupBy("_to")).applyInArrow(score_part(buckets, id_col), schema)


def op2_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
