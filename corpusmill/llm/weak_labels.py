"""Quality classifier from weak labels.

Heuristic labellers vote "bad", "good" or not at all on every document, some of them
on whether it is junk, the others on whether it is toxic. Votes are counted by pattern
over all documents; a pattern table has as many rows as there are patterns at most,
and expectation-maximisation on it estimates, for junk and for toxicity, each
labeller's accuracies and every pattern's probability. A document is bad if it is
either. Posterior labels of a sample train a hashed linear scorer by
follow-the-regularised-leader; the scorer then judges every document whole, and the
verdict is its alone.

The labellers of toxicity look for abusive terms: a short list, and words and word
beginnings that a sample of rows from a table of labels shows to go with toxic
documents. That table itself is a labeller too, where its sample covers a document.

Bounds: at most ``LABELLED`` labelled rows give terms (all that these rows show are kept), and the
scorer is fitted on at most ``FITTED`` documents (labelled ones first), in one task. Votes and
verdicts cover all documents.

Defined cases: a null or empty text gets the scorer's verdict on no words, which is
"kept" unless training says otherwise; repeated rows get the same verdict; null ids
stay; without labels (no table, no rows, nulls) the heuristics stand alone; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from itertools import chain
from operator import eq, itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, lean, stash, values
from .host_rules import measure

LABELLED, FITTED = 20_000, 6_000
WIDTH, CLEAR_LEAST, TRUST = 1 << 18, 0.95, 5.0
#: Words that a task remembers the terms of; beyond, it forgets all and goes on.
WORDS = 100_000
#: Bytes of texts that are looked at together.
PORTION = 2 << 20
BEGINNINGS = (5, 7)
BAD, GOOD, SILENT = 1, 0, 2
#: The terms that the abuse labeller starts from.
ABUSE = "clown disgusting idiot loser moron pathetic scum stupid trash worthless"
EDGES = ".,!?;:\"'()[]{}"
LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
CAPITALS = bytes(range(65, 91))
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
JUNK = ("symbols", "shouting", "repetition", "vocabulary", "marks", "stutter", "annotator of quality")
TOXIC = ("abuse list", "found words", "found beginnings", "annotator of toxicity")


def terms_of(word: str) -> tuple[str, ...]:
    """A word without edges and its beginnings, as labels and features use them."""
    bare = word.strip(EDGES).lower()
    return bare, *(bare[:n] + "*" for n in BEGINNINGS)


class Rates:
    """What the labellers look at in a text, as rates."""

    def __init__(self, text: str) -> None:
        n, _, symbols, _, repeated = measure(text)
        data = text.encode("utf-8", "surrogatepass")
        self.words = text.split()
        letters = len(data) - len(data.translate(None, LETTERS))
        self.n = max(1, n)
        self.distinct = set(self.words)
        self.values = {
            "symbols": symbols / self.n,
            "shouting": (len(data) - len(data.translate(None, CAPITALS))) / max(20, letters),
            "repetition": repeated / self.n,
            "vocabulary": 1 - len(self.distinct) / self.n if n >= 50 else 0.0,
            "marks": (len(data) - len(data.translate(None, MARKS))) / max(20, len(data)),
            "stutter": sum(map(eq, self.words, self.words[1:])) / max(8, self.n),
        }


#: Above these rates a labeller votes bad.
LIMITS = {"symbols": 0.1, "shouting": 0.3, "repetition": 0.3, "vocabulary": 0.7, "marks": 0.2, "stutter": 0.2}


ABUSE_LIST = frozenset(ABUSE.split())


class TermHits(dict):
    """Word to 1 if it is a listed term, plus 2 if found to be one, plus 4 if it begins like one; forgets all when full."""

    def __init__(self, found: frozenset) -> None:
        self.found, self.starts = found, frozenset(x[:-1] for x in found if x.endswith("*"))

    def __missing__(self, word: str) -> int:
        if len(self) > WORDS:
            self.clear()
        bare, found = word.strip(EDGES).lower(), self.found
        hit = self[word] = (bare in ABUSE_LIST) + 2 * (bare in found) + 4 * any(bare[:n] in self.starts for n in BEGINNINGS)
        return hit


def votes(rates: Rates, hits: Iterable[int], junk: int | None, toxic: int | None) -> list[int]:
    """BAD, GOOD or SILENT of each labeller, in the order of JUNK and TOXIC. ``hits``: how many distinct words are listed, found, begin like found ones."""
    out = [BAD if rates.values[k] > LIMITS[k] else GOOD for k in JUNK[:-1]]
    told = [BAD if n >= least else GOOD for n, least in zip(hits, (1, 2, 2), strict=True)]
    return [*out, SILENT if junk is None else junk, *told, SILENT if toxic is None else toxic]


class Held:
    """The distinct words of some texts, as numbers: ``text`` and ``word`` of each pair; ``words``, and their ``bare`` forms in lower case.
    The slots of ``others``, which are longer than ``LONG`` bytes or end in a star, are looked at one by one."""

    def __init__(self, rates: list[Rates]) -> None:
        held = pa.array(chain.from_iterable(r.distinct for r in rates), pa.string()).dictionary_encode()
        self.text, self.word = np.repeat(np.arange(len(rates)), [len(r.distinct) for r in rates]), held.indices.to_numpy()
        self.words = held.dictionary
        bare = pc.ascii_trim(self.words, EDGES)
        letters = pc.invert(pc.string_is_ascii(bare))  # Python alone knows what they are in lower case
        lower = pa.array([x.lower() for x in bare.filter(letters).to_numpy(zero_copy_only=False)], pa.string())
        self.bare = pc.replace_with_mask(pc.ascii_lower(bare), letters, lower)
        self.others = np.flatnonzero(pc.or_(pc.greater(pc.binary_length(self.bare), LONG), pc.ends_with(self.bare, "*")).to_numpy(zero_copy_only=False))
        self.starts = [pc.utf8_slice_codeunits(self.bare, 0, n) for n in BEGINNINGS]

    def hits(self, terms: TermHits) -> np.ndarray:
        """As ``terms`` has them, of each distinct word."""
        within = lambda column, listed: pc.is_in(column, pa.array(sorted(listed), pa.string())).to_numpy(zero_copy_only=False)
        return within(self.bare, ABUSE_LIST) + 2 * within(self.bare, terms.found) + 4 * np.any([within(x, terms.starts) for x in self.starts], axis=0)

    def slots(self) -> tuple[np.ndarray, np.ndarray]:
        """(word, slot): as :func:`word_slots` has them."""
        whole, *begun = checked(self.bare), *(step(checked(x), np.uint8(STAR)) for x in self.starts)
        easy = np.ones(len(self.bare), bool)
        easy[self.others] = False
        longer = easy & (pc.utf8_length(self.bare).to_numpy(zero_copy_only=False) > BEGINNINGS[0])
        more = np.array([(i, s) for i in self.others.tolist() for s in word_slots(self.words[i].as_py())], np.int64).reshape(-1, 2)
        word = np.concatenate([*map(np.flatnonzero, (easy, easy, longer)), more[:, 0]])
        slot = np.concatenate([whole[easy], begun[0][easy], begun[1][longer]])
        return word, np.append((~slot).astype(np.int64) % WIDTH, more[:, 1])


def checked(strings: pa.Array) -> np.ndarray:
    """The state of CRC32 after the first ``LONG`` bytes of each string."""
    size = np.minimum(pc.binary_length(strings).to_numpy(zero_copy_only=False), LONG)
    order = np.argsort(-size, kind="stable")  # longer ones come first
    at, data = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset :][order], np.frombuffer(strings.buffers()[2] or b"", np.uint8)
    left = len(size) - np.cumsum(np.bincount(size, minlength=1))  # how many have a byte more
    state = np.full(len(size), 0xFFFFFFFF, np.uint32)
    for i, n in enumerate(left[:-1].tolist()):
        state[:n] = step(state[:n], data[at[:n] + i])
    out = np.empty_like(state)
    out[order] = state
    return out


def step(state: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """CRC32 after another byte of each."""
    return TABLE[(state ^ byte) & np.uint32(255)] ^ (state >> np.uint32(8))


def crc_table() -> np.ndarray:
    at = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        at = np.where(at & np.uint32(1), np.uint32(0xEDB88320) ^ (at >> np.uint32(1)), at >> np.uint32(1))
    return at


TABLE, STAR, LONG = crc_table(), ord("*"), 64


def rated(column: pa.Array) -> Iterator[tuple[int, list[Rates]]]:
    """Where a portion of texts begins, and their rates: 256 texts at most, or of ``PORTION`` bytes, or a single one."""
    at = 0
    while at < len(column):
        n = 256
        while n > 1 and column.slice(at, n).nbytes > PORTION:
            n //= 2
        yield at, [Rates(t or "") for t in column.slice(at, n).to_pylist()]
        at += n


class Features:
    """Hashed features: words, their beginnings, and the steps that each rate passes."""

    def __init__(self) -> None:
        self.of_word: dict[str, tuple[int, ...]] = {}

    @staticmethod
    def slot(name: str) -> int:
        return zlib.crc32(name.encode("utf-8", "surrogatepass")) % WIDTH

    def word(self, word: str) -> tuple[int, ...]:
        found = self.of_word.get(word)
        if found is None:
            if len(self.of_word) > WORDS:
                self.of_word.clear()
            found = self.of_word[word] = tuple(map(self.slot, dict.fromkeys(terms_of(word))))
        return found

    def rates(self, rates: Rates) -> list[int]:
        return [self.slot(f"rate {k} over {step}") for k, v in rates.values.items() for step in (0.5, 1.0, 2.0) if v > step * LIMITS[k]]

    def of(self, rates: Rates) -> np.ndarray:
        return np.array([s for w in rates.distinct for s in self.word(w)] + self.rates(rates), np.int64)


def word_slots(word: str) -> list[int]:
    """As :meth:`Features.word`, for words that are not remembered: most occur once."""
    bare = word.strip(EDGES).lower()
    if not bare.isascii() or bare[-1:] == "*":  # a mark of its own may make a beginning equal to the word
        return list(map(Features.slot, dict.fromkeys(terms_of(word))))
    data = bare.encode()
    out, size = [zlib.crc32(data) % WIDTH], 0
    for n in BEGINNINGS:
        if size < len(data[:n]) or not size:
            out.append(zlib.crc32(data[:n] + b"*") % WIDTH)
        size = max(1, len(data[:n]))
    return out


Example = tuple[np.ndarray, np.ndarray, float]


def example(features: Features, text: str, target: float) -> Example:
    """Slots, counts (8 at most) and target of a text, in small types: all examples stay in memory."""
    slots, counts = np.unique(features.of(Rates(text)), return_counts=True)
    return slots.astype(np.int32), np.minimum(counts, 8).astype(np.uint8), target


def fit_scorer(examples: list[Example], updates: int = 24_000, alpha: float = 0.2, beta: float = 1.0, l1: float = 1.0, l2: float = 1.0, intercept: float = -2.0) -> np.ndarray:
    """Weights of the hashed features and, last, the intercept, from examples of texts and probabilities of being bad.

    Examples are passed until ``updates`` are made. The intercept is fixed: a text
    without evidence is kept.
    """
    z, n = np.zeros(WIDTH + 1), np.zeros(WIDTH + 1)
    for _ in range(-(-updates // max(1, len(examples)))):
        for slots, counts, target in examples:
            at, x = slots, counts.astype(np.float64)
            step = (beta + np.sqrt(n[at])) / alpha + l2
            w = np.where(np.abs(z[at]) > l1, -(z[at] - np.sign(z[at]) * l1) / step, 0.0)
            g = (1 / (1 + np.exp(-np.clip(w @ x + intercept, -30, 30))) - target) * x
            more = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - more * w
            n[at] += g * g
    step = (beta + np.sqrt(n)) / alpha + l2
    weights = np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / step, 0.0)
    weights[WIDTH] = intercept
    return weights


def estimate(patterns: list[tuple[str, int]], labellers: tuple[str, ...], clear_least: float = 0.0, rounds: int = 200) -> tuple[dict[str, float], dict[str, tuple[float, float]], float]:
    """Expectation-maximisation over vote patterns: P(bad) by pattern, (P(vote bad | bad), P(vote good | good)) by labeller, P(bad).

    Starts from patterns with any bad vote as bad; votes are smoothed by one document each.
    ``clear_least`` bounds P(vote good | good) from below: without it, a kind of bad
    documents that other labellers do not see may be taken for good ones. Where the last
    labeller, the annotator, is silent, documents of the same other votes on which it
    is not correct the probability, which itself counts as ``TRUST`` documents.
    """
    if not patterns:
        return {}, {}, 0.0
    v = np.array([[int(c) for c in p] for p, _ in patterns])
    n = np.array([c for _, c in patterns], np.float64)
    bad = np.where((v == BAD).any(1), 0.9, 0.1)
    for _ in range(rounds):
        share = np.clip((n * bad).sum() / n.sum(), 1e-4, 1 - 1e-4)
        hit = (((v == BAD) * (n * bad)[:, None]).sum(0) + 1) / (((v != SILENT) * (n * bad)[:, None]).sum(0) + 2)
        clear = (((v == GOOD) * (n * (1 - bad))[:, None]).sum(0) + 1) / (((v != SILENT) * (n * (1 - bad))[:, None]).sum(0) + 2)
        clear = np.maximum(clear, clear_least)
        up = np.where(v == BAD, np.log(hit), np.where(v == GOOD, np.log(1 - hit), 0.0)).sum(1) + np.log(share)
        down = np.where(v == BAD, np.log(1 - clear), np.where(v == GOOD, np.log(clear), 0.0)).sum(1) + np.log(1 - share)
        new = 1 / (1 + np.exp(np.clip(down - up, -60, 60)))
        done = np.abs(new - bad).max() < 1e-9
        bad = new
        if done:
            break
    for i in np.flatnonzero(v[:, -1] == SILENT):  # votes are not quite independent
        same = (v[:, :-1] == v[i, :-1]).all(1) & (v[:, -1] != SILENT)
        bad[i] = ((n * bad)[same].sum() + TRUST * bad[i]) / (n[same].sum() + TRUST)
    return dict(zip([p for p, _ in patterns], bad.tolist(), strict=True)), dict(zip(labellers, zip(hit.tolist(), clear.tolist(), strict=True), strict=True)), float(share)


def summed(patterns: Iterable[tuple[str, int]]) -> list[tuple[str, int]]:
    out: dict[str, int] = {}
    for p, n in patterns:
        out[p] = out.get(p, 0) + n
    return sorted(out.items())


def labelled_sample(labels: DataFrame | None, rows: int = LABELLED) -> DataFrame | None:
    """At most ``rows`` rows (_id, _toxic, _junk) of a table (doc_id, quality, toxic), chosen by a hash of the id."""
    if labels is None:
        return None
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    picked = known.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").cast("int").alias("_toxic"), F.max(F.lit(1) - F.col("quality")).cast("int").alias("_junk"))
    return picked.orderBy(F.xxhash64("_id"), "_id").limit(rows)


def abusive_terms(sample: DataFrame) -> list[str]:
    """Terms of (_id, _text, _toxic) rows that toxic documents have and others hardly ever do."""
    words = F.array_distinct(F.transform(F.regexp_extract_all(F.lower("_text"), F.lit(WORD), F.lit(0)), lambda w: F.btrim(w, F.lit(EDGES))))
    starts = [F.transform(words, lambda w: F.concat(F.substring(w, 1, n), F.lit("*"))) for n in BEGINNINGS]  # noqa: B023  used at once
    terms = F.filter(F.array_distinct(F.concat(words, *starts)), lambda t: F.length(t) > 3)
    counted = sample.select("_toxic", F.explode(terms).alias("_term")).groupBy("_term").agg(F.sum("_toxic").alias("_in"), F.sum(F.lit(1) - F.col("_toxic")).alias("_out"))
    found = counted.where("_in >= 5 AND _in >= 10 * _out").select("_term")
    return sorted(r._term for r in found.collect())  # words of LABELLED rows at most


def prepare(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))


def cast_votes(texts: DataFrame, abusive: list[str]) -> DataFrame:
    """(_id, _text, _junk, _toxic) to (_id, _pattern): a digit for each labeller's vote."""
    found = frozenset(abusive)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = TermHits(found)
        for batch in batches:
            made, junk, toxic = [], batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for at, rates in rated(batch.column(1)):
                held, end = Held(rates), at + len(rates)
                hit = held.hits(terms)[held.word]
                n = np.stack([np.bincount(held.text, hit & bit > 0, len(rates)) for bit in (1, 2, 4)], axis=1)
                made += ["".join(map(str, votes(*x))) for x in zip(rates, n.tolist(), junk[at:end], toxic[at:end], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], ["_id", "_pattern"])

    return texts.select("_id", "_text", "_junk", "_toxic").mapInArrow(run, "_id bigint, _pattern string")


def train(texts: DataFrame, labels: DataFrame | None) -> tuple[np.ndarray, dict]:
    """The scorer's weights, and what was estimated on the way."""
    sample = labelled_sample(labels)
    if sample is None:
        texts, abusive = texts.withColumns({c: F.lit(None).cast("int") for c in ("_junk", "_toxic")}), []
    else:
        sample = stash(sample, "labelled")
        known = texts.join(F.broadcast(sample), "_id")  # LABELLED rows at most
        abusive = abusive_terms(known)
        texts = texts.join(F.broadcast(sample), "_id", "left")
    voted = stash(cast_votes(texts, abusive), "votes")
    patterns = sorted((r._pattern, r["count"]) for r in voted.groupBy("_pattern").count().collect())  # 2 ** 9 * 3 ** 2 rows at most
    cut = len(JUNK)
    junk, junk_accuracy, junk_share = estimate(summed((p[:cut], n) for p, n in patterns), JUNK, CLEAR_LEAST)
    toxic, toxic_accuracy, toxic_share = estimate(summed((p[cut:], n) for p, n in patterns), TOXIC, CLEAR_LEAST)
    posterior = {p: 1 - (1 - junk[p[:cut]]) * (1 - toxic[p[cut:]]) for p, _ in patterns}
    chosen = voted.where("_id IS NOT NULL").groupBy("_id").agg(F.min("_pattern").alias("_pattern"))
    chosen = stash(chosen.orderBy(F.col("_pattern").endswith(str(SILENT)), F.xxhash64("_id"), "_id").limit(FITTED), "chosen")
    examples = texts.join(F.broadcast(chosen), "_id").select("_id", "_text", "_pattern")  # FITTED rows at most

    @lean
    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, made = Features(), []
        for batch in batches:  # texts go as they come, examples stay
            for i, t, p in zip(*(values(batch.column(c)) for c in range(3)), strict=True):
                data = t.encode("utf-8", "surrogatepass")
                made.append(((zlib.crc32(str(i).encode()), i, zlib.crc32(data), p), example(features, t, posterior[p])))
        made.sort(key=itemgetter(0))
        weights = fit_scorer([x for _, x in made]) if made else np.zeros(WIDTH + 1)
        at = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(weights[at])], ["at", "weight"])

    found = examples.repartition(1).mapInArrow(fit, "at bigint, weight double").toArrow()
    weights = np.zeros(WIDTH + 1)
    weights[found.column("at").to_numpy()] = found.column("weight").to_numpy()
    return weights, {"posterior": posterior, "accuracy": junk_accuracy | toxic_accuracy, "share": (junk_share, toxic_share), "terms": abusive}


class Scorer:
    """The probabilities of being bad that trained weights give to texts."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights, self.features = weights, Features()

    def of(self, rates: list[Rates]) -> np.ndarray:
        held, weights = Held(rates), self.weights
        word, slot = held.slots()
        telling = weights[slot] != 0  # a word's slots are few, and most tell nothing
        word, slot = word[telling], slot[telling]
        order = np.argsort(word, kind="stable")
        n = np.bincount(word, minlength=len(held.words))
        first = np.cumsum(n) - n
        many = n[held.word]
        text, before = np.repeat(held.text, many), np.cumsum(many) - many
        at = np.repeat(first[held.word] - before, many) + np.arange(many.sum())
        pairs, counts = np.unique(text * WIDTH + slot[order][at], return_counts=True)
        total = np.bincount(pairs // WIDTH, weights[pairs % WIDTH] * np.minimum(counts, 8), len(rates))
        total += [weights[WIDTH] + sum(weights[s] for s in self.features.rates(r)) for r in rates]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))

    def column(self, texts: pa.Array) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(self.of(rates) for _, rates in rated(texts))])


def slim_weights(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where weights are not zero, and they: what goes to the tasks."""
    at = np.flatnonzero(weights)
    return at.astype(np.int32), weights[at]


def full_weights(slim: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    weights = np.zeros(WIDTH + 1)
    weights[slim[0]] = slim[1]
    return weights


def score(texts: DataFrame, weights: np.ndarray) -> DataFrame:
    """(_id, _text) to (_id, _score): the scorer's probability of being bad."""
    slim = slim_weights(weights)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(full_weights(slim))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer.column(batch.column(1)))], ["_id", "_score"])

    return texts.select("_id", "_text").mapInArrow(run, "_id bigint, _score double")


def good_documents(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns."""
    weights, _ = train(prepare(docs, id_col, text_col), labels)
    slim, text_at = slim_weights(weights), docs.columns.index(text_col)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(full_weights(slim))
        for batch in batches:
            yield batch.filter(pa.array(scorer.column(batch.column(text_at)) < limit))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """id, score (probability of being bad) and kept of every document."""
    texts = prepare(docs, id_col, text_col)
    weights, _ = train(texts, labels)
    return score(texts, weights).select(F.col("_id").alias(id_col), F.col("_score").alias("score"), (F.col("_score") < limit).alias("kept"))


def op5_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
