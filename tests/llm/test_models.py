import zlib
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import host_rules, hpylm, weak_labels


def tokens(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*t.encode().split(), None]


def test_lm_base_and_counts(docs, no_docs, rows):
    got = hpylm.score_texts(docs).collect()
    fold = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7
    train = Counter(w for r in rows if fold(r[0]) != 2 for w in tokens(r[1]))
    n, v = sum(train.values()), len(train)
    want = sorted(
        ((r[0], fold(r[0]) == 2, len(tokens(r[1])), sum(w in train for w in tokens(r[1])), n, sum(log10((train[w] + 1) / (n + v + 1)) for w in tokens(r[1]))) for r in rows),
        key=repr,
    )
    got = sorted((tuple(r) for r in got), key=lambda r: repr(r[:6]))
    assert [r[:5] for r in got] == [w[:5] for w in want]
    assert np.allclose([r[5] for r in got], [w[5] for w in want])
    assert all(r[6] < 0 and np.isfinite(r[6]) for r in got)
    assert hpylm.score_texts(no_docs).count() == 0
    again = sorted((tuple(r) for r in hpylm.score_texts(docs.repartition(3)).collect()), key=lambda r: repr(r[:6]))
    assert np.allclose([r[6] for r in got], [r[6] for r in again])


def test_lm_probabilities_sum_to_one(spark):
    """One known word ("a"), one unseen ("?"), the end ("."): the nine step probabilities must be those of three distributions.

    Scores of held-out texts give seven equations; two distributions then fix all nine, and the third must hold too.
    """
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 == 2]
    train = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 != 2]
    texts = ["", "a", "a a", "never", "never never2", "a never", "never a"]
    rows = [(i, " ".join(["a"] * (1 + i % 4))) for i in train[:90]] + list(zip(held, texts))
    got = {r.doc_id: 10**r.score for r in hpylm.score_texts(spark.createDataFrame(rows, "doc_id bigint, text string"), part=400).collect()}
    end, one, two, new, news, one_new, new_one = (got[i] for i in held[: len(texts)])
    a_a, new_new = two / one, news / new

    def rest(x):  # from P(a | start): what is left for an unseen word, and the sums after "a" and after an unseen word
        y = 1 - end - x
        a_end, new_end = one / x, new / y
        return a_a + a_end + one_new / x / new_end, new_new + new_end + new_one / y / a_end

    gaps = [max(abs(total - 1) for total in rest(x)) for x in np.linspace(one, 1 - end - new, 200_001)[1:-1]]
    assert min(gaps) < 1e-3


def test_lm_does_not_hang_on_partitions(spark):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(rng.choice(words, 30))) for i in range(200)]
    df, scores = spark.createDataFrame(rows, "doc_id bigint, text string"), []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for partitions, pieces in ((1, 1), (7, 3), (16, 11)):
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        scores.append([r.score for r in hpylm.score_texts(df.repartition(pieces), part=4000).orderBy("doc_id").collect()])
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert np.allclose(scores[0], scores[1], rtol=1e-9) and np.allclose(scores[0], scores[2], rtol=1e-9)
    assert sum(scores[0]) > 1.2 * sum(r.base_score for r in hpylm.score_texts(df).collect())  # negative: better than the base


def test_lm_beats_base_on_held_out(spark):
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(400)]
    follow = {w: rng.choice(words, 4) for w in words}
    rows = []
    for i in range(400):
        w = rng.choice(words)
        out = []
        for _ in range(60):
            out.append(w if rng.random() > 0.03 else f"new{rng.integers(1 << 40)}")
            w = rng.choice(follow[w])
        rows.append((i, " ".join(out)))
    got = hpylm.score_texts(spark.createDataFrame(rows, "doc_id bigint, text string")).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert got[0] > got[1] + 0.5 * got[2]


def test_seating():
    rng = np.random.default_rng(0)
    c = np.array([0, 1, 2, 50, 5000, 5000])
    t = hpylm.seat(c, np.array([1, 1, 1, 1, 1.0, 50.0]), 0.5, rng, 50)
    assert t[0] == 0 and t[1] == 1 and 1 <= t[2] <= 2 and (t <= c).all() and t[5] > t[4] > t[3]
    assert t[2] == pytest.approx(1 + 1 / 1.5, abs=0.2)


@pytest.mark.parametrize("text", ["", "a b c a b c", "x x x x", "one two", "a b c d a b c e", "l1\nl1\n\n \nl2"])
def test_measures(text):
    words = text.split()
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if x.strip()]
    assert host_rules.measure(text)[0] == len(words) and host_rules.measure(text)[4] == len(covered) and host_rules.measure(text)[3] == len(lines) - len(set(lines))


def test_host_rules(spark, docs, no_docs, rows):
    got = host_rules.apply_host_rules(docs).collect()
    assert len(got) == len(rows) and not any(r.kept and r.base_failed for r in got)
    assert host_rules.apply_host_rules(no_docs).count() == 0
    good, bad = " ".join(f"w{i}" for i in range(80)), "spam " * 80
    many = [(i, good if i % 10 == 0 else bad, "bad host") for i in range(400)] + [(1000 + i, bad if i % 10 == 0 else good, f"h{i % 5}") for i in range(400)] + [(2000, bad, "one"), (2001, good, None)]
    df = spark.createDataFrame(many, "doc_id bigint, text string, source string")
    kept = {r.doc_id: r for r in host_rules.apply_host_rules(df).collect()}
    assert not any(kept[i].kept for i in range(400)) and kept[0].base_failed is False
    assert all(kept[1000 + i].kept == (i % 10 != 0) for i in range(400)) and kept[2001].kept
    assert kept[2000].shrunk_rate < 0.9


def test_prior():
    assert host_rules.beta_prior(0, 0, 0.0, 0) == (1.0, 1.0)
    a, b = host_rules.beta_prior(100, 20, 100 * (0.04 + 0.016), 5)
    assert a + b == pytest.approx(9.0) and a / (a + b) == pytest.approx(0.2)


def test_expectation_maximisation_recovers_accuracies():
    rng = np.random.default_rng(2)
    bad = rng.random(20000) < 0.3
    hit, clear = [0.9, 0.6, 0.7], [0.95, 0.8, 0.99]
    votes = np.array([np.where(bad, rng.random(20000) < h, rng.random(20000) > c) for h, c in zip(hit, clear)]).astype(int)
    counts = Counter("".join(map(str, v)) for v in votes.T)
    posterior, found, share = weak_labels.estimate(sorted(counts.items()), ("a", "b", "c"))
    assert share == pytest.approx(0.3, abs=0.04)
    for (h, c), name in zip(zip(hit, clear), "abc"):
        assert found[name] == pytest.approx((h, c), abs=0.06)
    assert posterior["111"] > 0.99 and posterior["000"] < 0.1


def corpus(rng, n):
    rows = []
    for i in range(n):
        lang = i % 2
        vocab = [f"{'ab'[lang]}{k}x{k % 7}" for k in range(800)]
        words = list(rng.choice(vocab, 120))
        kind = i % 10
        if kind == 3:
            words = [w + "&&&" for w in words]
        if kind == 4:
            words = [words[0]] * 120
        if kind in (5, 6):
            for k in rng.integers(0, 120, 6):
                words[k] = ("scum", "vilexq")[lang] + ("" if lang == 0 else str(rng.integers(50)))
        rows.append((i, " ".join(words), int(kind not in (3, 4)), int(kind in (5, 6))))
    return rows


def test_classifier_on_held_out_rows(spark):
    rows = corpus(np.random.default_rng(4), 900)
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _, _ in rows] + [(None, None, None), (5000, "", "x")], "doc_id bigint, text string, _id string")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows if i % 3 == 0] + [(7, None, None), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in weak_labels.classify(docs, labels).collect()}
    assert len(kept) == 902 and kept[None] and kept[5000]
    bad = [i for i, _, q, x in rows if i % 3 and (x or not q)]
    good = [i for i, _, q, x in rows if i % 3 and q and not x]
    assert np.mean([not kept[i] for i in bad]) > 0.95
    assert np.mean([kept[i] for i in good]) > 0.98
    alone = {r.doc_id: r.kept for r in weak_labels.classify(docs).collect()}
    assert np.mean([alone[i] for i in good]) > 0.98 and not any(alone[i] for i, _, q, _ in rows if not q)
    assert weak_labels.classify(docs.where("doc_id < -1"), labels).count() == 0


def test_drawn_seats_are_those_of_single_moves():
    """Drawing a dish's seats together agrees with moving its customers one at a time, given the rest."""
    discount, rng = 0.8, np.random.default_rng(3)
    for c, odds in ((2, 0.3), (3, 1.5), (7, 0.05), (12, 2.0)):
        tables, seen = [c], []
        for step in range(30_000):
            k = rng.choice(len(tables), p=np.array(tables) / c)
            tables[k] -= 1
            tables = [n for n in tables if n]
            weights = np.array([n - discount for n in tables] + [odds])
            k = rng.choice(len(weights), p=weights / weights.sum())
            if k == len(tables):
                tables.append(1)
            else:
                tables[k] += 1
            if step > 300:
                seen.append(len(tables))
        drawn = hpylm.draw(np.full(4000, c), np.full(4000, odds), discount, rng, 4)
        assert drawn.mean() == pytest.approx(np.mean(seen), rel=0.03)


def test_posteriors_are_those_of_bayes_rule():
    rng = np.random.default_rng(6)
    bad = rng.random(4000) < 0.25
    votes = np.array([np.where(bad, rng.random(4000) < h, rng.random(4000) > c) for h, c in ((0.8, 0.9), (0.7, 0.95), (0.9, 0.85))]).astype(int)
    counts = sorted(Counter("".join(map(str, v)) for v in votes.T).items())
    posterior, found, share = weak_labels.estimate(counts, ("a", "b", "c"))
    for pattern, _ in counts:
        up, down = share, 1 - share
        for vote, name in zip(map(int, pattern), "abc"):
            hit, clear = found[name]
            up *= hit if vote == weak_labels.BAD else 1 - hit
            down *= 1 - clear if vote == weak_labels.BAD else clear
        assert posterior[pattern] == pytest.approx(up / (up + down), abs=1e-6)


def test_scores_are_the_weights_sums(spark):
    rows = corpus(np.random.default_rng(8), 300)
    long_text = " ".join(f"w{k % 9000} {rows[k % 300][1][:40]}" for k in range(20_000))
    texts = [(i, t) for i, t, _, _ in rows] + [(3, rows[3][1]), (4, None), (4, ""), (None, rows[4][1]), (None, rows[4][1]), (9001, long_text), (9002, long_text)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(4)
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows if i % 2], "doc_id bigint, quality int, toxic int")
    weights, _ = weak_labels.train(weak_labels.prepare(docs, "doc_id", "text"), labels)
    features, want = weak_labels.Features(), []
    for i, t in texts:
        slots, counts = np.unique(features.of(weak_labels.Rates(t or "")), return_counts=True)
        score = 1 / (1 + np.exp(-(weights[slots] @ np.minimum(counts, 8) + weights[-1])))
        want.append((i if i is not None else -1, score))
    got = [(r.doc_id if r.doc_id is not None else -1, r.score, r.kept) for r in weak_labels.classify(docs, labels).collect()]
    assert [g[0] for g in sorted(got)] == [w[0] for w in sorted(want)]
    assert [g[1] for g in sorted(got)] == pytest.approx([w[1] for w in sorted(want)], abs=1e-9)
    assert all(kept == (s < 0.5) for _, s, kept in got)


def test_slots_and_hits_of_words_equal_those_of_their_terms():
    words = ["", "*", "abcd*", "abcde*", "abcde", "abcdefg", "Abcdefgh.", "(ÜBERALLES)", "über", "Moron!", "a*b", "abcdef*"]
    found = frozenset(["abcde*", "überall*", "abcdefg", "*"])
    hits = weak_labels.TermHits(found)
    for w in words:
        bare, *starts = weak_labels.terms_of(w)
        assert weak_labels.word_slots(w) == list(weak_labels.Features().word(w))
        assert hits[w] == (bare in weak_labels.ABUSE_LIST) + 2 * (bare in found) + 4 * any(x in found for x in starts)


def test_words_of_texts_are_looked_at_together():
    """Slots and hits of all words of a portion are those of each word alone, however odd; long and many texts are cut into portions."""
    texts = ["", "*", "a* .*. b", "abcde abcdef. (ABCDEFG) abcdefgh", "stupid, STUPID! scum", "İΣΣς Étés! étésabcd", "x" * 63 + " " + "x" * 65 + ". z*", "é" * 70, None, "a b a b"]
    held = weak_labels.Held([weak_labels.Rates(t or "") for t in texts])
    words, slots = held.words.to_pylist(), {}
    for word, slot in zip(*held.slots()):
        slots.setdefault(words[word], []).append(slot)
    assert {w: sorted(s) for w, s in slots.items()} == {w: sorted(weak_labels.word_slots(w)) for w in {w for t in texts for w in (t or "").split()}}
    terms = weak_labels.TermHits(frozenset(("abcde", "abcdef*", "abcde*", "étésa*")))
    assert held.hits(terms).tolist() == [weak_labels.TermHits(terms.found)[w] for w in words]
    assert sorted(zip(held.text.tolist(), map(words.__getitem__, held.word.tolist()))) == sorted((i, w) for i, t in enumerate(texts) for w in set((t or "").split()))
    cut = pa.array(["x"] * 300 + ["y" * (3 << 20)] * 2)
    sizes = [len(rates) for _, rates in weak_labels.rated(cut)]
    assert sum(sizes) == 302 and max(sizes) <= 256 and sizes[-2:] == [1, 1]
    assert len(weak_labels.Scorer(np.zeros(weak_labels.WIDTH + 1)).column(pa.array([], pa.string()))) == 0
