"""Cheapest repairs of conversations, by a suffix-shared automaton of their signatures.

A row's symbol says whether it must go (blank, or role and text seen earlier), and else its role's initial
and whether it is truncated. Rows in order give a conversation's signature, in blocks of BLOCK symbols.
Legal role initials are (s?(ua)+)?, which four grammar states follow: nothing yet, after s, after u, after a.

The automaton is minimised from the end: its nodes are the distinct suffixes of all signatures. Distinct
signatures are range-partitioned and sorted by their reversed text, so the signatures that share a suffix are
neighbours and the register of nodes is the way of the present one. For each node and state the cost to go
and the ASCII-least cheapest audit suffix are computed once, from its child's, and serve every conversation with that
suffix. Letters: Keep, Rerole, Delete, Insert.

A conversation of one block reads its answer from the start state. For longer ones a block that is not the
last has an answer for each pair of states, and blocks are put together from the end. That is exact: two audits of
one block between the same states with the same cost are never prefixes of one another (one would
only insert more), so the least one stays least before any continuation.

Rows are placed by distributed ranking, repeats found by aggregation, so a conversation with a third of all
rows is split in every step but the last: its audit is one cell of the result, and its repaired rows
stream in order through one task, which holds one batch and the audit.

Odd inputs: null role and text count as one space; rows of one turn stand by role and text's digest; a null
conv_id is a conversation; a role without or with another initial is kept nowhere; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeglass.llm.ranked import group_name, ranked
from tradeglass.session import stored

BLOCK = 1024
BLANKS, ENDS = " \t\n\x0b\x0c\r", (".", "!", "?")
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after each legal initial, by state.
LEGAL = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: State after a user or assistant turn that a rerole or an insertion gives, by state.
GIVEN = (USER, USER, ASSISTANT, USER)
MUST_GO = "x"

Best = list[tuple[int, str] | None]


def _inserted(best: Best) -> Best:
    """Answers by state with insertions before; two lead from any state to any that insertions reach."""
    for _ in range(2):
        best = [min(filter(None, (own, best[GIVEN[s]] and (INSERT + best[GIVEN[s]][0], "I" + best[GIVEN[s]][1]))), default=None) for s, own in enumerate(best)]
    return best


def ending(goal: int | None) -> Best:
    """Answers of the empty suffix: to a legal end, or (in front of a further block) to one state."""
    if goal is None:
        return _inserted([(0, ""), None, None, (0, "")])
    return [(0, "") if s == goal else None for s in range(4)]


def node(symbol: str, child: Best) -> Best:
    """Answers by state of the suffix that puts a symbol before another suffix."""
    best: Best = []
    more = TRUNCATED if symbol.isupper() else 0
    for s in range(4):
        ways = [child[s] and (DELETE + child[s][0], "D" + child[s][1])]
        if symbol != MUST_GO:
            kept, given = LEGAL[s].get(symbol.lower()), child[GIVEN[s]]
            ways.append(kept is not None and child[kept] and (KEEP + more + child[kept][0], "K" + child[kept][1]))
            ways.append(given and (REROLE + more + given[0], "R" + given[1]))
        best.append(min(filter(None, ways), default=None))
    return _inserted(best)


_ANSWERS = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))
_ANSWERED = "signature string, last boolean, answers array<struct<cost:long,audit:string>>"


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers of signatures sorted by their reversed text: 4 by state, or 16 by goal and state."""
    goals = {True: (None,), False: tuple(range(4))}
    before = {True: "", False: ""}
    ways = {last: [[ending(g) for g in goals[last]]] for last in goals}
    for batch in batches:
        found = []
        for signature, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            turned, way = signature[::-1], ways[last]
            shared = 0
            while shared < min(len(turned), len(before[last])) and turned[shared] == before[last][shared]:
                shared += 1
            del way[shared + 1:]
            for symbol in turned[shared:]:
                way.append([node(symbol, child) for child in way[-1]])
            before[last] = turned
            found.append([answer and {"cost": answer[0], "audit": answer[1]} for best in way[-1] for answer in best])
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, _ANSWERS)], ["signature", "last", "answers"])


_AUDIT = "_group string, cost long, audit string"


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audits of conversations of several blocks, from the answers of their blocks in order."""
    for batch in batches:
        for at, name in enumerate(batch.column(0).to_pylist()):
            best = ending(None)
            for block in reversed(batch.column(1)[at].as_py()):
                own = [a and (a["cost"], a["audit"]) for a in block["answers"]]
                if block["last"]:
                    best = own
                else:
                    best = [min(((a[0] + b[0], a[1] + b[1]) for a, b in zip(own[s::4], best, strict=True) if a and b), default=None) for s in range(4)]
            yield pa.record_batch([pa.array([name], pa.string()), pa.array([best[START][0]], pa.int64()), pa.array([best[START][1]], pa.string())], ["_group", "cost", "audit"])


def _texts(rows: DataFrame) -> DataFrame:
    """_group, conv_id, turn, role, text of the rows that are there; where alive is false (no row), conv_id counts only."""
    blank = F.lit(" ")
    return rows.select(group_name("conv_id").alias("_group"), "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), blank).alias("role"),
                       F.coalesce(F.col("text").cast("string"), blank).alias("text"), "alive")


def faults(rows: DataFrame) -> DataFrame:
    """_group, turn, role, key (of the text), first fault and place in the conversation of every row that is alive."""
    trimmed = F.rtrim("text", F.lit(BLANKS))
    narrow = _texts(rows).where("alive").select("_group", "turn", "role", F.sha2("text", 256).alias("key"), (trimmed == "").alias("blank"),
                                                (~F.substring(trimmed, -1, 1).isin(*ENDS)).alias("truncated")).withColumn("row", F.monotonically_increasing_id())
    narrow = stored(narrow, "turns")
    same = ["_group", "role", "key"]
    mark = F.struct("turn", "row")
    first = narrow.groupBy(*same).agg(F.min(mark).alias("first"))
    seen = narrow.join(first, same).withColumn("seen", mark != F.col("first")).drop("first")
    fault = F.when(F.col("blank"), "blank").when(F.col("seen"), "duplicate").when(F.col("truncated"), "truncated")
    return stored(ranked(stored(seen.select("_group", "turn", "role", "key", "row", fault.alias("fault")), "faults"), "_group", ["turn", "role", "key", "row"]), "placed")


def audits(placed: DataFrame) -> DataFrame:
    """_group, illegal (neighbours), cost and audit of every conversation with rows."""
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO).when(F.col("fault") == "truncated", F.upper(initial)).otherwise(initial)
    own = F.floor(F.col("place") / BLOCK)
    # the first row of a block is also the neighbour of the last row before
    meets = F.when((F.col("place") % BLOCK == 0) & (F.col("place") > 0), F.array(own, own - 1)).otherwise(F.array(own))
    dealt = placed.select("_group", "size", "place", own.alias("own"), F.explode(meets).alias("block"), initial.alias("initial"), symbol.alias("symbol"))
    turns = F.sort_array(F.collect_list(F.struct("place", "initial", "symbol", (F.col("own") == F.col("block")).alias("mine"))))
    blocks = dealt.groupBy("_group", "block", "size").agg(turns.alias("turns")).select(
        "_group", "block", ((F.col("block") + 1) * BLOCK >= F.col("size")).alias("last"), F.expr("array_join(transform(filter(turns, t -> t.mine), t -> t.symbol), '')").alias("signature"),
        F.expr("transform(turns, t -> t.initial)").alias("initials"))
    pairs = F.expr("size(filter(zip_with(slice(initials, 1, size(initials) - 1), slice(initials, 2, size(initials)), (a, b) -> concat(a, b)), p -> p NOT IN ('su', 'ua', 'au')))")
    blocks = stored(blocks.withColumn("illegal", F.when(F.size("initials") < 2, 0).otherwise(pairs).cast("long")).drop("initials"), "signatures")
    distinct = stored(blocks.select("signature", "last").distinct(), "distinct-signatures")
    turned = F.reverse("signature")
    tables = stored(distinct.repartitionByRange(turned, "last").sortWithinPartitions(turned, "last").mapInArrow(_answered, _ANSWERED), "answers")
    answered = blocks.join(tables, ["signature", "last"])
    single = answered.where("block = 0 AND last").select("_group", F.col("answers")[START]["cost"].alias("cost"), F.col("answers")[START]["audit"].alias("audit"))
    parts = answered.where("NOT (block = 0 AND last)").groupBy("_group").agg(F.sort_array(F.collect_list(F.struct("block", "last", "answers"))).alias("parts"))
    done = single.unionByName(parts.mapInArrow(_composed, _AUDIT))
    illegal = blocks.groupBy("_group").agg(F.sum("illegal").alias("illegal"))
    return stored(done.join(illegal, "_group"), "audits")


_REPAIRED = "_group string, turn long, edit string, role string, text string"


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows after the edits, in order; a conversation's audit arrives before its rows."""
    audit, at, state = "", 0, START
    for batch in batches:
        out: list[tuple] = []

        def given(name: str, edit: str, turn: int | None, text: str) -> None:
            nonlocal state
            state = GIVEN[state]
            out.append((name, turn, edit, "assistant" if state == ASSISTANT else "user", text))

        def insertions(name: str) -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                given(name, "I", None, "")
                at += 1

        for name, letters, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if letters is not None:
                audit, at, state = letters, 0, START
            else:
                edit = audit[at]
                at += 1
                if edit == "K":
                    state = LEGAL[state][role[0]]
                    out.append((name, turn, edit, role, text))
                elif edit == "R":
                    given(name, edit, turn, text)
            insertions(name)
        if out:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)],
                                  ["_group", "turn", "edit", "role", "text"])


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """_group, turn, edit, role, text of the rows that the audits keep, rerole or insert.

    A conversation's rows are consecutive and in order within one partition.
    """
    lines = _texts(rows).where("alive").select("_group", F.lit(None).cast("string").alias("audit"), "turn", "role", "text", F.sha2("text", 256).alias("key"))
    heads = found.select("_group", "audit", *(F.lit(None).cast(k).alias(c) for c, k in (("turn", "long"), ("role", "string"), ("text", "string"), ("key", "string"))))
    both = heads.unionByName(lines).withColumn("kind", F.col("audit").isNull())
    return both.repartition("_group").sortWithinPartitions("_group", "kind", "turn", "role", "key").select("_group", "audit", "turn", "role", "text").mapInArrow(_applied, _REPAIRED)


def digests(lines: DataFrame) -> DataFrame:
    """_group and the SHA-256 of its `role:text` lines, joined by newlines, of rows as repaired() gives them."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        for batch in batches:
            out = []
            for group, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group != name or state is None:
                    if state is not None:
                        out.append((name, state.hexdigest()))
                    name, state = group, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            if out:
                yield pa.record_batch([pa.array(c, pa.string()) for c in zip(*out, strict=True)], ["_group", "sha256"])
        if state is not None:
            yield pa.record_batch([pa.array([name]), pa.array([state.hexdigest()])], ["_group", "sha256"])
    return lines.select("_group", "role", "text").mapInArrow(hashed, "_group string, sha256 string")


def counts(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """_group, conv_id, gaps and the number of each first fault of every conversation, also of those without rows."""
    turn = F.when(F.col("alive"), F.col("turn"))
    gaps = F.coalesce(F.max("t") - F.min("t") + 1 - F.count_distinct("t"), F.lit(0))
    every = rows.select(group_name("conv_id").alias("_group"), "conv_id", turn.cast("long").alias("t")).groupBy("_group", "conv_id").agg(gaps.cast("long").alias("gaps"))
    kinds = placed.groupBy("_group").agg(*(F.count_if(F.col("fault") == k).alias(k) for k in ("blank", "duplicate", "truncated")))
    return every.join(kinds, "_group", "left").fillna(0, ["blank", "duplicate", "truncated"])


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts of every conversation (_group, conv_id, counts, illegal, cost, audit), and its repaired rows.

    rows: conv_id, turn, role, text, and alive (false: the row is gone, its conversation counts still).
    """
    placed = faults(rows)
    found = audits(placed)
    facts = counts(rows, placed).join(found, "_group", "left").fillna(0, ["illegal", "cost"]).fillna("", ["audit"])
    return facts, repaired(rows, found)
