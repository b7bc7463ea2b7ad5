"""Repair of conversation structure at least cost.

A conversation is sound when its roles read ``(s?(ua)+)?`` by their initials. Rows have
faults (blank, duplicate, truncated), derived by windows; then a conversation's rows are
collected as sorted structs, and one fold over them finds the cheapest edits. Its state is
four (cost, audit) structs, one for each thing that the repaired turns so far may end in:
nothing yet, a system turn, a user, an assistant. ``least`` on structs picks the smaller
cost and, of equal ones, the smaller audit. That is exact: two audits of equal cost that
have read the same rows have the same number of insertions, so neither begins the other,
and what is smaller stays smaller whatever follows.

Edits: Keep (free), Rerole to user or assistant, Delete (which blank and duplicate rows
need), Insert an empty user or assistant turn; a truncated row that stays costs more. In
the fold an edit is two characters, its initial and the role's it gives (``.``: none),
so that the repaired turns can be told from it; the role never decides an order, as equal
edits up to there give equal roles.

Defined cases: a null role or text is one space, so a null text is blank and a null role
no legal one; turns go by number, nulls first, then role and text, a first copy before its
repetitions; rows of null conv_id are one conversation; a conversation that damage leaves
no rows has zeros and empty texts; an empty table gives an empty result; further columns
are ignored. A conversation meets in one task and becomes one value, as the digest of its
text demands; the fold copies audits, so that a conversation of n turns takes n squared
bytes of work.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import let

#: Characters that are no white space here, and what ends a whole sentence.
SEEN, ENDS = r"[^\x20\x09-\x0D]", r"[.!?]"


@dataclass(frozen=True)
class Costs:
    rerole: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3


#: More than any repair costs.
NEVER = 1 << 40
ENDINGS = ("none", "system", "user", "assistant")


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` (conv, turn, role, text, gone) with ``fault``: blank, duplicate or truncated, the first that holds, else null.

    One shuffle by conversation serves the window, and the grouping after it.
    """
    seen = F.row_number().over(Window.partitionBy("conv", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    told = rows.repartition("conv").withColumn("again", seen > 1)
    last = F.regexp_extract(F.col("text"), rf"(?s)({SEEN})[\x20\x09-\x0D]*$", 1)
    fault = F.when(last == "", "blank").when(F.col("again"), "duplicate").when(~last.rlike(ENDS), "truncated")
    return told.withColumn("fault", fault)


def fold(turns: Column, costs: Costs = Costs()) -> Column:
    """(cost, edits) of the cheapest repair of ``turns`` (role, fault); ``edits`` has two characters for each."""
    state = lambda cost, edits: F.struct(cost.cast("long").alias("cost"), edits.alias("edits"))
    start = F.struct(*(state(F.lit(0 if e == "none" else NEVER), F.lit("")).alias(e) for e in ENDINGS))
    then = lambda s, cost, edit: state(s["cost"] + cost, F.concat(s["edits"], F.lit(edit)))
    insert = lambda s, role: then(s, F.lit(costs.insert), f"I{role}")

    def padded(s: Column) -> Column:
        """After any insertions that are worth while."""
        user = F.least(s["user"], *(insert(s[e], "u") for e in ("none", "system", "assistant")))
        with_user = F.struct(s["none"].alias("none"), s["system"].alias("system"), user.alias("user"), s["assistant"].alias("assistant"))
        return let(with_user, lambda t: F.struct(t["none"].alias("none"), t["system"].alias("system"), t["user"].alias("user"), F.least(t["assistant"], insert(t["user"], "a")).alias("assistant")))

    def step(s: Column, turn: Column) -> Column:
        initial, fault = F.substring(turn["role"], 1, 1), F.coalesce(turn["fault"], F.lit(""))
        stays = F.when(fault.isin("blank", "duplicate"), F.lit(NEVER)).when(fault == "truncated", F.lit(costs.truncated)).otherwise(F.lit(0))
        keep = lambda s, role: then(s, stays + F.when(initial == role, F.lit(0)).otherwise(F.lit(NEVER)), f"K{role}")
        rerole = lambda s, role: then(s, stays + F.lit(costs.rerole), f"R{role}")
        delete = lambda s: then(s, F.lit(costs.delete), "D.")

        def moved(p: Column) -> Column:
            before_user = [p[e] for e in ("none", "system", "assistant")]
            return F.struct(
                delete(p["none"]).alias("none"),
                F.least(delete(p["system"]), keep(p["none"], "s")).alias("system"),
                F.least(delete(p["user"]), *(keep(b, "u") for b in before_user), *(rerole(b, "u") for b in before_user)).alias("user"),
                F.least(delete(p["assistant"]), keep(p["user"], "a"), rerole(p["user"], "a")).alias("assistant"),
            )

        return let(padded(s), moved)

    return F.aggregate(turns, start, step, lambda s: let(padded(s), lambda p: F.least(p["none"], p["assistant"])))


def repaired_lines(turns: Column, edits: Column) -> Column:
    """``role:text`` of the repaired turns, in order: each row's own edit and the insertions before it, then those at the end."""
    inserted = lambda marks: F.transform(F.regexp_extract_all(marks, F.lit("I[ua]"), F.lit(0)), lambda i: F.when(i == "Iu", "user:").otherwise("assistant:"))

    def line(turn: Column, marks: Column) -> Column:
        edit = F.right(marks, F.lit(2))
        role = F.when(edit.startswith("K"), turn["role"]).when(edit == "Ru", "user").otherwise("assistant")
        own = F.when(edit.startswith("D"), F.array().cast("array<string>")).otherwise(F.array(F.concat(role, F.lit(":"), turn["text"])))
        return F.concat(inserted(marks), own)

    own = F.regexp_extract_all(edits, F.lit("(?:I.)*[DKR]."), F.lit(0))
    return F.concat(F.flatten(F.zip_with(turns, own, line)), inserted(F.regexp_extract(edits, "(?:I.)*$", 0)))


def repair_conversations(rows: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """A row for each conversation of ``rows`` (conv, turn, role, text, gone); rows that are ``gone`` only name theirs.

    conv, gaps, blank, duplicate, truncated, illegal, cost, audit, lines (the repaired ``role:text``).
    """
    there = ~F.col("gone")
    turn = F.struct("turn", "role", "text", "again", "fault")
    counts = [F.count_if(there & (F.col("fault") == f)).alias(f) for f in ("blank", "duplicate", "truncated")]
    gaps = F.max(F.when(there, F.col("turn"))) - F.min(F.when(there, F.col("turn"))) + 1
    told = faults(rows).groupBy("conv").agg(
        F.sort_array(F.collect_list(F.when(there, turn))).alias("turns"),
        F.coalesce(gaps - F.size(F.array_distinct(F.collect_set(F.when(there, F.col("turn"))))), F.lit(0)).cast("long").alias("gaps"),
        *counts,
    )
    initials = F.transform(F.col("turns")["role"], lambda r: F.substring(r, 1, 1))
    pairs = let(initials, lambda r: F.transform(r, lambda x, i: F.concat(F.get(r, i - 1), x)))  # the first has none before it: null
    illegal = F.size(F.filter(pairs, lambda p: p.isNotNull() & ~p.isin("su", "ua", "au"))).cast("long")
    best = told.withColumn("best", fold(F.col("turns"), costs))
    return best.select(
        "conv", "gaps", "blank", "duplicate", "truncated", illegal.alias("illegal"), F.col("best.cost").alias("cost"),
        F.regexp_replace(F.col("best.edits"), "(.).", "$1").alias("audit"), repaired_lines(F.col("turns"), F.col("best.edits")).alias("lines"),
    )


def damaged(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as repair takes them, with the damage that a checksum of their ids tells."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    told = turns.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), word("role").alias("role"), word("text").alias("text"), (F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20).alias("hit"))
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", ENDS, "")).otherwise(F.col("text"))
    hit = told.withColumns({"text": text, "role": F.when(F.col("hit") == 4, "user").otherwise(F.col("role")), "gone": F.col("hit") == 0})
    copies = F.when(F.col("hit") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return hit.select("conv", "turn", "role", "text", "gone", F.explode(copies)).drop("col")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repair_conversations(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    sha = F.sha2(F.encode(F.array_join("lines", "\n"), "UTF-8"), 256)
    return out.select(F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", sha.alias("repaired_sha256"))


def _sql_edit(state: str, cost: str, edit: str) -> str:
    return f"{{'c': {state}.c + {cost}, 'e': {state}.e || '{edit}'}}"


def _sql_padded(s: str, use: str) -> str:
    """``use`` of p, the states of ``s`` after insertions."""
    user = f"least({s}.u, {_sql_edit(f'{s}.n', '3', 'Iu')}, {_sql_edit(f'{s}.s', '3', 'Iu')}, {_sql_edit(f'{s}.a', '3', 'Iu')})"
    made = f"list_transform([{{'n': {s}.n, 's': {s}.s, 'u': {user}, 'a': {s}.a}}], lambda q: {{'n': q.n, 's': q.s, 'u': q.u, 'a': least(q.a, {_sql_edit('q.u', '3', 'Ia')})}})"
    return f"list_transform({made}, lambda p: {use})[1]"


def _sql_moved() -> str:
    keep = lambda s, role: _sql_edit(s, f"x.stays + CASE WHEN x.i = '{role}' THEN 0 ELSE {NEVER} END", f"K{role}")
    rerole = lambda s, role: _sql_edit(s, "x.stays + 3", f"R{role}")
    delete = lambda s: _sql_edit(s, "4", "D.")
    to_user = ", ".join(way(f"p.{e}", "u") for way in (keep, rerole) for e in "nsa")
    return f"{{'n': {delete('p.n')}, 's': least({delete('p.s')}, {keep('p.n', 's')}), 'u': least({delete('p.u')}, {to_user}), 'a': least({delete('p.a')}, {keep('p.u', 'a')}, {rerole('p.u', 'a')})}}"


_SQL_STATE = "{'n': {'c': 0::BIGINT, 'e': ''}, " + ", ".join(f"'{e}': {{'c': {NEVER}::BIGINT, 'e': ''}}" for e in "sua") + "}"
_SQL_INSERTED = "list_transform(regexp_extract_all({}, 'I[ua]'), lambda w: CASE w WHEN 'Iu' THEN 'user:' ELSE 'assistant:' END)"

OP12_SQL = rf"""
WITH crc AS (
  SELECT list(c ORDER BY i) AS t
  FROM (SELECT i, list_reduce(range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i))),
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
told AS (
  SELECT *, xor(list_reduce(list_transform(range(1, length(name) + 1), lambda i: ascii(substr(name, i, 1))::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS hit
  FROM named, crc),
damaged AS (
  SELECT conv_id, turn, CASE hit WHEN 4 THEN 'user' ELSE role END AS role,
         CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, hit = 0 AS gone, unnest(CASE hit WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM told),
seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, gone, role, text ORDER BY turn NULLS FIRST) > 1 AS again,
         regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS ending
  FROM damaged),
faults AS (
  SELECT *, CASE WHEN ending = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN NOT regexp_matches(ending, '[.!?]') THEN 'truncated' ELSE '' END AS fault,
         substr(role, 1, 1) AS i
  FROM seen),
grouped AS (
  SELECT conv_id, coalesce(max(turn) FILTER (NOT gone) - min(turn) FILTER (NOT gone) + 1 - count(DISTINCT turn) FILTER (NOT gone), 0) AS gaps,
         count(*) FILTER (NOT gone AND fault = 'blank') AS blank, count(*) FILTER (NOT gone AND fault = 'duplicate') AS duplicate,
         count(*) FILTER (NOT gone AND fault = 'truncated') AS truncated,
         coalesce(list({{'role': role, 'text': text, 'i': i, 'stays': CASE fault WHEN 'blank' THEN {NEVER} WHEN 'duplicate' THEN {NEVER} WHEN 'truncated' THEN 3 ELSE 0 END::BIGINT}}
                       ORDER BY turn NULLS FIRST, role, text, again) FILTER (NOT gone), []) AS turns
  FROM faults GROUP BY conv_id),
best AS (
  SELECT *, {_sql_padded(f"list_reduce(turns, lambda s, x: {_sql_padded('s', _sql_moved())}, {_SQL_STATE})", "least(p.n, p.a)")} AS b FROM grouped),
lines AS (
  SELECT *, list_concat(flatten(list_transform(regexp_extract_all(b.e, '(?:I.)*[DKR].'), lambda o, k: list_concat({_SQL_INSERTED.format("o")},
           CASE WHEN o[-2] = 'D' THEN [] WHEN o[-2] = 'K' THEN [turns[k].role || ':' || turns[k].text] WHEN right(o, 2) = 'Ru' THEN ['user:' || turns[k].text] ELSE ['assistant:' || turns[k].text] END))),
         {_SQL_INSERTED.format("regexp_extract(b.e, '((?:I.)*)$', 1)")}) AS said
  FROM best)
SELECT conv_id, gaps, blank, duplicate, truncated,
       len(list_filter(range(2, len(turns) + 1), lambda k: turns[k - 1].i || turns[k].i NOT IN ('su', 'ua', 'au')))::BIGINT AS illegal,
       b.c AS cost, regexp_replace(b.e, '(.).', '\1', 'g') AS audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM lines
"""
