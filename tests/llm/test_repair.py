import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, fault string, gone int"
ROLES = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "usher"]
TEXTS = ["One.", "Two!", "Three?", "four", "five.)", " ", "", None, "\n", "é…", "six. ", "seven.\n\x0b", " eight."]


def make(seed, conversations, most):
    rng = random.Random(seed)
    rows = []
    for c in range(conversations):
        for t in range(rng.randint(1, most)):
            rows.append((c, rng.choice([t, t, t, t, t, None, t - 1]), rng.choice(ROLES), rng.choice(TEXTS) if rng.random() < 0.6 else f"text {t}.", "x", 3))
    rows += [(None, None, None, None, None, None), (None, 1, "user", "Hi.", None, None), rows[0], rows[0]]
    rng.shuffle(rows)
    return rows


def after_damage(rows):
    out = defaultdict(list)
    for c, t, r, x, *_ in rows:
        mine = out[c]
        r, x = " " if r is None else r, " " if x is None else x
        hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if hit == 0:
            continue
        x = "" if hit == 1 else re.sub("[.!?]", "", x) if hit == 2 else x
        r = "user" if hit == 4 else r
        mine += [(t is not None, t or 0, r, x)] * (2 if hit == 3 else 1)
    return {c: sorted(v) for c, v in out.items()}


def brute(turns):
    """Every edit sequence worth a look, by exhaustive search over what is left of the rows and the last role."""
    seen, kinds = set(), []
    for _, _, r, x in turns:
        bare = re.findall(r"[^\x20\x09-\x0D]", x)
        kinds.append("blank" if not bare else "duplicate" if (r, x) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((r, x))

    @lru_cache(None)
    def rest(i, last, inserts):
        """(cost, audit, lines) from row i on; at most a few insertions in one gap."""
        found = []
        if i == len(turns) and last in ("", "a"):
            found.append((0, "", ()))
        if inserts < 3:
            for role in "ua":
                if (role == "u" and last in ("", "s", "a")) or (role == "a" and last == "u"):
                    c, a, ls = rest(i, role, inserts + 1)
                    found.append((c + 3, "I" + a, (("user:" if role == "u" else "assistant:"),) + ls))
        if i < len(turns):
            _, _, r, x = turns[i]
            c, a, ls = rest(i + 1, last, 0)
            found.append((c + 4, "D" + a, ls))
            if kinds[i] not in ("blank", "duplicate"):
                more = 3 if kinds[i] == "truncated" else 0
                for op, role, name, price in (("K", r[:1], r, 0), ("R", "u", "user", 3), ("R", "a", "assistant", 3)):
                    if (role == "s" and last == "") or (role == "u" and last in ("", "s", "a")) or (role == "a" and last == "u"):
                        c, a, ls = rest(i + 1, role, 0)
                        found.append((c + price + more, op + a, (f"{name}:{x}",) + ls))
        return min(found, default=(10**9, "~", ()))

    numbers = [t for known, t, _, _ in turns if known]
    initials = [r[:1] for _, _, r, _ in turns]
    cost, audit, lines = rest(0, "", 0)
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    return (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


@pytest.mark.parametrize("seed,conversations,most", [(1, 150, 4), (2, 80, 9), (3, 6, 70)])
def test_against_exhaustive_search(spark, tmp_path, seed, conversations, most):
    rows = make(seed, conversations, most)
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r[0]: tuple(r)[1:] for r in repair.op12_conversation_repair(spark, str(tmp_path)).collect()}
    want = after_damage(rows)
    assert got.keys() == want.keys()
    for c, turns in want.items():
        assert got[c] == brute(turns), (c, turns)


def test_repaired_roles_are_sound(spark, tmp_path):
    rows = make(4, 100, 8)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    out = repair.repair_conversations(repair.damaged(spark.read.parquet(f"{tmp_path}/conversations.parquet"))).collect()
    for r in out:
        assert re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in r.lines)), r.lines
        assert len(r.audit.replace("D", "")) == len(r.lines)


def test_lost_and_empty(spark, tmp_path):
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(lost, 0, "user", "gone.", None, None)], SCHEMA)
    df.write.parquet(f"{tmp_path}/a/conversations.parquet")
    df.limit(0).write.parquet(f"{tmp_path}/b/conversations.parquet")
    assert tuple(repair.op12_conversation_repair(spark, f"{tmp_path}/a").first()) == (lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair.op12_conversation_repair(spark, f"{tmp_path}/b").collect() == []


def test_other_costs(spark):
    turns = [("user", None), ("user", None), ("assistant", None)]
    df = spark.createDataFrame([(turns,)], "turns array<struct<role:string,fault:string>>")
    best = lambda **c: tuple(df.select(repair.fold(F.col("turns"), repair.Costs(**c)).alias("b")).first().b)
    assert best() == (3, "KuIaKuKa")
    assert best(delete=1) == (1, "D.KuKa")
    assert best(insert=9) == (4, "D.KuKa")


def test_query_against_sql(spark, tmp_path):
    import duckdb

    spark.createDataFrame(make(5, 60, 9), SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    for at, files in ((tmp_path, "/*.parquet"), ("/root/testdata/sf0.001", "")):
        got = repair.op12_conversation_repair(spark, str(at))
        want = duckdb.connect().sql(repair.OP12_SQL.replace("FROM conversations", f"FROM '{at}/conversations.parquet{files}'"))
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)
