import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from corpusmill.llm import pfp, simhash

SCHEMA = "doc_id bigint, text string, _id string, _to string"


def brute_removed(rows, length=50):
    first = {}
    data = [(-(2**63) if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = True
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(bool(g) and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((None if i == -(2**63) else i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def repetitive(seed, n):
    rng = random.Random(seed)
    vocab = ["the", "of", "and", "né", "日本", "x", "longerword", "\x00\x00"]
    passages = [" ".join(rng.choice(vocab) for _ in range(rng.choice([8, 15, 40]))) for _ in range(6)] + ["a" * 70, "ab" * 60, "\x00" * 60]
    rows = []
    for i in range(n):
        bits = [rng.choice(passages) if rng.random() < 0.4 else " ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 60))) for _ in range(rng.randrange(0, 6))]
        rows.append((i, "\n".join(bits)))
    rows += [(n + i, rows[5][1]) for i in range(30)] + [(n + 40, None), (n + 41, ""), (n + 42, "short"), (None, rows[3][1]), (7, rows[8][1]), (n + 43, rows[9][1] * 200)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_removed_runs(spark, seed):
    rows = repetitive(seed, 80)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA).repartition(3)
    got = sorted((tuple(r)[:5] for r in pfp.remove_repeats(df).collect()), key=repr)
    assert got == brute_removed(rows)


def test_hot_passage_and_small_chunks(spark, monkeypatch):
    rows = [(i, f"{'q' * (i % 7)}{i} " + "one very common passage that stands in each and every document here " * 2 + str(i * i)) for i in range(60)]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    mixed = repetitive(11, 60) + [(None, rows[3][1]), (None, rows[4][1] + " more")]
    other = spark.createDataFrame([(i, t, "x", "y") for i, t in mixed], SCHEMA)
    for share, part in ((1, 700), (3, 2000), (4096, 300), (2, 1 << 20)):  # each suffix a row; many parts; one part
        assert sorted((tuple(r)[:5] for r in pfp.remove_repeats(df, share=share, part=part).collect()), key=repr) == brute_removed(rows)
        assert sorted((tuple(r)[:5] for r in pfp.remove_repeats(other, share=share, part=part).collect()), key=repr) == brute_removed(mixed)
    monkeypatch.setattr(pfp, "CHUNK", 300)
    texts = [t.encode() for _, t in rows]
    ph = pfp.Phrases(texts, 50)
    assert (ph.count.sum()) == sum(max(0, len(t) - 49) for t in texts)


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_removed_runs_at_other_partition_counts(spark, partitions):
    rows = repetitive(5, 50)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
        assert sorted((tuple(r)[:5] for r in pfp.remove_repeats(df, part=3000).collect()), key=repr) == brute_removed(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_sorted_rows_in_small_batches():
    """Runs that go on in further batches are told as in one batch."""
    rng = np.random.default_rng(4)
    n = 400
    a = np.sort(rng.integers(0, 12, n) << pfp.C_HIGH | rng.integers(0, 9, n))
    b = rng.integers(0, 3, n) | rng.integers(0, 6, n) << pfp.C_LOW
    order = np.lexsort((b, b & pfp.LOW, a))
    rows = pfp.table("a long, b long", a[order], b[order])
    for share in (2, 8, 1000):
        for asks in (False, True):
            run = pfp.rank_phrases(0, share, asks)
            told = [sorted(zip(*(np.concatenate([x.column(c).to_numpy() for x in run(iter([rows.slice(k, step) for k in range(0, n, step)]))]).tolist() for c in range(3)))) for step in (1, 3, 50, n)]
            assert told[0] and told[0] == told[1] == told[2] == told[3]


def test_kept_text_and_empty_table(spark):
    rows = repetitive(9, 20)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    for r in pfp.remove_repeats(df).collect():
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed
    assert pfp.remove_repeats(df.where("doc_id < -5")).count() == 0


def brute_print(text, k=4, seed=42):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), seed) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, radius):
    prints = [brute_print(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                up[root(i)] = root(j)
    least = defaultdict(lambda: None)
    for i, (d, _) in enumerate(rows):
        r = root(i)
        if d is not None and (least[r] is None or d < least[r]):
            least[r] = d
    return sorted(((d, f"{p:016x}", least[root(i)]) for i, ((d, _), p) in enumerate(zip(rows, prints))), key=repr)


def near_copies(seed, n):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    base = [[rng.choice(vocab) for _ in range(rng.choice([5, 40, 120]))] for _ in range(n)]
    rows = [(3 * i + 1, " ".join(w)) for i, w in enumerate(base)]
    for k in range(2 * n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((1000 + k, " ".join(w)))
    rows += [(2000, None), (2001, ""), (2002, " \n"), (None, "lone"), (None, "Lone"), (None, rows[4][1]), rows[0], (2003, "W1 É"), (2004, "w1 É")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("leaf", [24, 12_000])
def test_components(spark, leaf, tmp_path):
    rows = near_copies(leaf, 60)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA).repartition(3)
    got = sorted(map(tuple, simhash.near_duplicates(df, leaf_load=leaf).collect()), key=repr)
    assert got == brute_components(rows, 4)
    assert simhash.near_duplicates(df.where("doc_id < -5")).count() == 0


def test_components_with_large_and_repeated_ids(spark):
    """An id is only what a component is named by: ids from 2**62 on count, and rows that share an id alone do not link."""
    rows = [(2**62 + 7, "a b c d e"), (2**63 - 1, "a b c d e"), (-(2**63), "q"), (5, "one text of its own"), (5, "quite another one here"), (2, "quite another one here"), (None, "nobody's words")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    assert sorted(map(tuple, simhash.near_duplicates(df).collect()), key=repr) == brute_components(rows, 4)


@pytest.mark.parametrize("load, large", [(4, 10**6), (50, 60), (10**6, 25)])
def test_buckets_lose_no_pair_and_copies_stay(spark, monkeypatch, load, large):
    """Every link is found, whether buckets grow trees, are parted by further blocks, or by pairs of blocks; and copies do not grow with the table."""
    monkeypatch.setattr(simhash, "GRID", large)
    rng = np.random.default_rng(load)
    base = rng.integers(0, 2**64, 30, dtype=np.uint64)
    made = [base, *(base ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for a, b in rng.integers(0, 64, (12, 2)))]
    made += [base[:1] ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) ^ np.uint64(1 << int(c)) for a, b, c in rng.integers(0, 64, (200, 3))]
    prints = np.unique(np.concatenate(made))
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    want = simhash.roots(len(prints), *np.nonzero(near))
    df = spark.createDataFrame([(f"{p:016x}", i) for i, p in enumerate(prints.tolist())], "_fp string, _node bigint")
    found = [(r._a, r._b) for r in simhash.links(df, 4, load).collect()]
    assert all(near[a, b] or want[a] == want[b] for a, b in found)
    assert (simhash.roots(len(prints), *np.array(found).T) == want).all()
    none = np.zeros(0, np.uint64)
    assert sum(len(rows) for _, rows, _ in simhash.buckets(prints[:, None], 4, none)) == 5 * len(prints)


def test_tree_loses_no_pair():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    prints = np.unique(np.concatenate([base, base ^ (np.uint64(1) << rng.integers(0, 63, 400).astype(np.uint64)), base ^ np.uint64(15)]))[:, None]
    nodes = simhash.grow(prints[::3], len(prints), 4, leaf_load=60, levels=8)
    assert sum(x[0] is None for x in nodes) > 8
    together, homes = set(), np.zeros(len(prints), int)
    for _, rows, home in simhash.route(nodes, prints, 4):
        homes[rows[home]] += 1
        for i in rows[home]:
            together.update((min(i, j), max(i, j)) for j in rows)
    assert (homes == 1).all()
    d = simhash.distance(prints[:, None, :], prints[None, :, :])
    assert {(i, j) for i, j in zip(*np.nonzero(d <= 4), strict=True) if i < j} <= together


def test_wide_fingerprints():
    a, b = simhash.fingerprint("a b c d e f", 5, 128), simhash.fingerprint("A B c d e f", 5, 128)
    assert a == b and len(a) == 32 and a[:16] != a[16:]


def shingle_set(text, k=5):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def alike(a, b, least=0.8):
    both = len(a & b)
    return both >= least * (len(a) + len(b) - both)


def brute_groups(rows):
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                up[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    return list(groups.values())


@pytest.mark.parametrize("leaf", [20, 12_000])
def test_one_document_of_each_group_stays(spark, leaf, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 40)
    rows = near_copies(5, 50)
    hub = [f"h{i}" for i in range(200)]
    for k in range(60):  # each near the first, not near each other
        w = list(hub)
        for i in (3 * k % 195, (3 * k + 90) % 195, (3 * k + 50) % 195):
            w[i] = f"new{k}at{i}"
        rows.append((5000 + k, " ".join(w)))
    rows.append((4999, " ".join(hub)))
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA).repartition(3)
    kept = simhash.distinct_documents(df, leaf_load=leaf)
    assert kept.dtypes == df.dtypes
    kept = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    want = sorted((min((rows[i] for i in g), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")) for g in brute_groups(rows)), key=repr)
    assert [r[0] for r in kept] == [r[0] for r in want]
    assert simhash.distinct_documents(df.where("doc_id < -5")).count() == 0


def test_equal_fingerprints_are_no_copies(spark):
    run = "again " * 400
    rows = [(k, run + " ".join(f"word{k}at{i}" for i in range(300))) for k in range(4)]
    rows += [(10, rows[0][1]), (11, rows[0][1].upper()), (12, rows[1][1] + " tail")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA).repartition(3)
    assert sorted(r.doc_id for r in simhash.distinct_documents(df).collect()) == [0, 1, 2, 3]


def test_signatures_lose_no_pair():
    rng = np.random.default_rng(5)
    hits = 0
    for k in range(4000):
        n = int(rng.integers(1, 40) if k % 2 else rng.integers(1, 600))
        x = rng.integers(0, 2**64, n, dtype=np.uint64)
        cut = int(rng.integers(0, n // 5 + 1))
        add = int(rng.integers(0, max(1, n // 4 - cut) + 1))
        x, y = np.unique(x), np.unique(np.concatenate([x[cut:], rng.integers(0, 2**64, add, dtype=np.uint64)]))
        if simhash.similar(x, y, 0.8):
            hits += 1
            assert simhash.may_be_alike([simhash.shingle_counts(x)], [simhash.shingle_counts(y)], 0.8).all()
            for common in (x[:0], np.unique(x[rng.random(n) < 0.6])):
                (a, a_known, a_all), (b, b_known, _) = simhash.signatures(x, 0.8, common), simhash.signatures(y, 0.8, common)
                met = np.intersect1d(a, b)
                assert len(met) and a_all == np.isin(x, common).sum()
                if len(np.setdiff1d(np.intersect1d(x, y), common)):  # they share one that is not common: they meet there
                    assert np.setdiff1d(met, common).size and (~a_known).any() and (~b_known).any()
    assert hits > 1000


def test_no_pair_is_beyond_the_radii(spark):
    rows = []
    for k in range(150):  # a fifth cut off, in one block
        w = [f"t{k}w{i}" for i in range(104)]
        rows += [(k, " ".join(w)), (1000 + k, " ".join(w[:84]))]
    for k in range(5):  # a passage many times over
        w, line = " ".join(f"u{k}w{i}" for i in range(200)), " ".join(f"l{k}w{i}" for i in range(12))
        rows += [(200 + k, w + " " + line), (1200 + k, w + " " + " ".join([line] * 60))]
    assert {len(g) for g in brute_groups(rows)} == {2}
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA).repartition(3)
    assert sorted(r.doc_id for r in simhash.distinct_documents(df).collect()) == [i for i, _ in sorted(rows) if i < 1000]


def test_documents_around_a_common_passage(spark, monkeypatch):
    """Alike only by a passage that very many share: in all shares from half of the text to all of it."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(k, passage + " " + " ".join(f"o{k}x{i}" for i in range(k % 40))) for k in range(160)]
    rows += [(1000 + k, " ".join(passage.split()[: 40 + k]) + " " + " ".join(f"s{k}x{i}" for i in range(k % 7))) for k in range(20)]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA).repartition(3)
    want = sorted(min(rows[i][0] for i in g) for g in brute_groups(rows))
    assert sorted(r.doc_id for r in simhash.distinct_documents(df).collect()) == want
    made = []
    monkeypatch.setattr(simhash, "alike_pairs", lambda pairs, *rest, f=simhash.alike_pairs: made.append(pairs.count()) or f(pairs, *rest))
    simhash.distinct_documents(df).count()
    assert max(made) < 6 * len(rows)  # of 16110 pairs


def test_large_leaves_are_parted(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GRID", 20)
    monkeypatch.setattr(simhash, "SETS", 8 * 120 * 15)
    rows = near_copies(6, 40)
    rows += [(5000 + k, " ".join(f"h{i}" if i != k else f"new{k}" for i in range(120))) for k in range(120)]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA).repartition(3)
    assert sorted(map(tuple, simhash.near_duplicates(df).collect()), key=repr) == brute_components(rows, 4)
    assert len({r.doc_id for r in simhash.distinct_documents(df).collect()}) == len({min((rows[i][0] for i in g if rows[i][0] is not None), default=None) for g in brute_groups(rows)})
    distinct = spark.createDataFrame(list({simhash.blocks_of(t or "", 5, 256, simhash.WordHashes()) for _, t in rows}), "_fp binary, _n bigint")
    members = simhash.candidate_members(distinct, 12, simhash.radius_of(0.8, 256), 0.8)
    sizes = [r["count"] for r in members.groupBy("_shard").count().collect()]
    assert sizes and max(sizes) < 60


def test_grid_meets_every_pair_with_a_home():
    rng = np.random.default_rng(1)
    hashes, home, met = rng.integers(0, 2**64, 90, dtype=np.uint64), rng.random(90) < 0.5, set()
    shards = defaultdict(list)
    for shard, rows, own in simhash.grid(hashes, home, 4):
        for s, r, o in zip(shard.tolist(), rows.tolist(), own.tolist()):
            shards[s].append((r, o))
    for members in shards.values():
        assert len(members) < 60 and len({r for r, _ in members}) == len(members)
        met |= {frozenset((a, b)) for a, o in members if o for b, _ in members}
    assert met >= {frozenset((a, b)) for a in np.flatnonzero(home).tolist() for b in range(90)}


def test_repeats_cut_from_documents(spark):
    rows = [*repetitive(3, 40), (900, None), (901, "é" * 60), (902, "x" + "é" * 60), (903, "日本" * 40), (904, "a日本" * 40)]
    df = spark.createDataFrame([(i, t, f"s{i}", None) for i, t in rows], "doc_id bigint, text string, source string, _id string")
    got = pfp.without_repeats(df)
    assert got.columns == df.columns
    got = got.collect()
    assert len(got) == len(rows) and all(r.source == f"s{r.doc_id}" for r in got)
    first = {}
    for i, t in sorted(((-(2**63) if i is None else i), t or "") for i, t in rows):
        data = t.encode()
        for k in range(len(data) - 49):
            first.setdefault(data[k : k + 50], i)
    want = []
    for i, t in rows:
        data, key = (t or "").encode(), -(2**63) if i is None else i
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - 49):
            if first[data[k : k + 50]] < key:
                gone[k : k + 50] = True
        at, out = 0, ""
        for c in t or "":
            n = len(c.encode())
            out += "" if gone[at : at + n].all() else c
            at += n
        want.append((i, out))
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(want, key=repr)
