"""Merkle manifest, conversation repair and decontamination against plain readings of their contracts."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tradeglass.llm import dialogue, merkle, queries, winnow
from tradeglass.llm.queries import damaged


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# --- Merkle manifest -------------------------------------------------------------------------------


def leaf_of(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """Root and, for every node, the list of (left, right) siblings of its way."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for way, i in zip(ways, at, strict=True):
            run = i // 8 * 8
            way.append(("".join(nodes[run:i]), "".join(nodes[i + 1:run + 8])))
        at = [i // 8 for i in at]
        nodes = [h(*nodes[i:i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0], ways


def manifest(rows):
    """Counter of (doc_id, leaf, subroot, root, proof, folded, verified) by the contract."""
    groups = defaultdict(list)
    for row in rows:
        changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None
        groups[row[2]].append((row[0] is not None, row[0] or 0, leaf_of(row), leaf_of((*row[:4], lower(row[4]))) if changed else leaf_of(row)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: (sorted(groups[g]), *climb([x[2] for x in sorted(groups[g])])) for g in names}
    root, tops = climb([trees[g][1] for g in names])
    out = Counter()
    for g, top in zip(names, tops, strict=True):
        for (known, doc_id, leaf, offered), way in zip(trees[g][0], trees[g][2], strict=True):
            folded = offered
            for left, right in way + top:
                folded = h(left, folded, right)
            out[doc_id if known else None, leaf, trees[g][1], root, h(*itertools.chain(*(way + top))), folded, folded == root] += 1
    return out


DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, place long, path string, _group string, node string"


def docs_of(spark, rows):
    return spark.createDataFrame([(d, t, la, s, n, "r", 1, "p", "g", "n") for d, s, la, n, t in rows], DOCS)


def by_query(spark, tmp_path, rows, name, table="documents", **others):
    for file, frame in {table: rows, **others}.items():
        frame.write.parquet(str(tmp_path / f"{file}.parquet"))
    return queries.QUERIES[name](spark, str(tmp_path)).collect()


@pytest.mark.parametrize("levels", [1, 3])
def test_manifest(spark, tmp_path, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 8 ** levels)
    rows = [(i, f"s{i % 5}" if i % 4 else None, ["en", "en", "en", "de", "é", None, "z", "en"][i % 8], i if i % 7 else None, f"Text {i} ÄB" if i % 9 else None) for i in range(700)]
    rows += [(9_000, "s", "one", 3, "A lone Leaf"), (9_001, "s", "", 3, ""), (5, "s5", "en", 1, "again"), rows[3], rows[3], (None, "s", "en", 1, "no Id"), (None, None, None, None, None)]
    rows += [(10_000 + i, "s", f"l{i:03}", 1, f"B{i}") for i in range(70)]
    rows.append((20_000, "s", "en", 1, "Long " * 200_000))
    got = Counter(map(tuple, by_query(spark, tmp_path, docs_of(spark, rows), "op11_merkle_manifest")))
    assert got == manifest(rows)
    assert {r[6] for r in got} == {True, False}


def test_manifest_of_few_rows(spark, tmp_path):
    for k, rows in enumerate([[], [(1, None, None, None, None)], [(3, "s", "en", 1, "A"), (4, "s", "en", 1, "B")], [(3, "s", "en", 1, "A"), (4, "s", "de", 1, "B")]]):
        got = by_query(spark, tmp_path / str(k), docs_of(spark, rows), "op11_merkle_manifest")
        assert Counter(map(tuple, got)) == (manifest(rows) if rows else Counter())


# --- Conversations ---------------------------------------------------------------------------------


def all_audits(symbols):
    """Every (cost, audit) with at most two insertions in a row that ends legally."""
    legal = re.compile("(s?(ua)+)?")
    out = []

    def go(at, roles, cost, audit):
        options = [(roles, cost, audit)]
        for new in itertools.chain(itertools.product("ua", repeat=1), itertools.product("ua", repeat=2)):
            options.append((roles + "".join(new), cost + 3 * len(new), audit + "I" * len(new)))
        for r, c, a in options:
            if not re.fullmatch("s?(ua)*u?", r):
                continue
            if at == len(symbols):
                if legal.fullmatch(r):
                    out.append((c, a))
                continue
            x = symbols[at]
            go(at + 1, r, c + 4, a + "D")
            if x != "x":
                more = 3 if x.isupper() else 0
                go(at + 1, r + x.lower(), c + more, a + "K")
                for role in "ua":
                    go(at + 1, r + role, c + 3 + more, a + "R")

    go(0, "", 0, "")
    return min(out)


def table_of(symbols):
    best = dialogue.ending(None)
    for x in reversed(symbols):
        best = dialogue.node(x, best)
    return best[dialogue.START]


def test_cheapest_audits_by_exhaustion():
    for n in range(4):
        for symbols in itertools.product("suaoxSUA", repeat=n):
            assert table_of(symbols) == all_audits(symbols), symbols
    rng = np.random.default_rng(12)
    for _ in range(40):
        symbols = rng.choice([*"suaoxSUAO"], 5)
        assert table_of(symbols) == all_audits(symbols), symbols


def repair_of(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, repaired lines) of one conversation by the contract."""
    alive = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        alive += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    alive.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], h(r[2])))
    turns = [t for t, _, _ in alive if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, symbols, count = set(), [], Counter()
    for _, role, text in alive:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        count[fault] += 1
        symbols.append("x" if fault in ("blank", "duplicate") else initial.upper() if fault else initial)
    initials = [r[:1] for _, r, _ in alive]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    cost, audit = table_of(symbols)
    lines, state, at = [], "", 0
    for letter in audit:
        given = "assistant" if state.endswith("u") else "user"
        if letter == "I":
            lines.append(f"{given}:")
        elif letter == "R":
            lines.append(f"{given}:{alive[at][2]}")
        elif letter == "K":
            given = alive[at][1]
            lines.append(f"{given}:{alive[at][2]}")
        at += letter != "I"
        state += given[0] if letter != "D" else ""
    assert re.fullmatch("(s?(ua)+)?", state)
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, h("\n".join(lines))


TURNS = "conv_id long, turn long, role string, text string, row long, audit string, _group string, alive string"


@pytest.mark.parametrize("block", [4, 1024])
def test_conversation_repair(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(dialogue, "BLOCK", block)
    rng = np.random.default_rng(3)
    rows = []
    for conv in range(60):
        for turn in range(int(rng.integers(1, 9))):
            role = rng.choice(["system", "user", "assistant", "tool", "", "User"], p=[.1, .4, .4, .04, .03, .03])
            text = rng.choice(["Well.", "Is it?\n", "cut off", " \t", "", "...", "Wait!  ", f"text {turn}.", "é\x0b", " "])
            rows.append((conv, turn if rng.random() > .1 else int(rng.integers(0, 5)), str(role), str(text)))
    rows += [(77, i, "assistant" if i % 3 else "user", f"long one {i % 40}." if i % 5 else "cut") for i in range(200)]
    rows += [(None, i, "user", "x.") for i in range(6)] + [(78, None, None, None), (78, None, "user", "Hi."), (78, 3, "assistant", "word " * 100_000 + ".")]
    rows += [(79, 2, "user", "Same."), (79, 2, "user", "Same."), (79, 2, "assistant", "Other.")]
    lost = next(i for i in itertools.count(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows.append((lost, 0, "user", "gone."))
    frame = spark.createDataFrame([(*r, 1, "a", "g", "no") for r in rows], TURNS).repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in by_query(spark, tmp_path, frame, "op12_conversation_repair", "conversations")}
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    want = {c: repair_of(g) for c, g in groups.items()}
    assert got == want
    assert got[lost] == (0, 0, 0, 0, 0, 0, "", h(""))


def test_conversation_repair_of_an_empty_table(spark, tmp_path):
    assert by_query(spark, tmp_path, spark.createDataFrame([], TURNS), "op12_conversation_repair", "conversations") == []


def test_repaired_rows(spark):
    rows = spark.createDataFrame([(1, 0, "assistant", "A."), (1, 1, "assistant", "B."), (1, 2, "user", " "), (2, 0, "user", "Q?"), (2, 1, "assistant", "A.")],
                                 "conv_id long, turn long, role string, text string").withColumn("alive", F.lit(True))
    facts, lines = dialogue.repair(rows)
    assert {r.conv_id: (r.cost, r.audit) for r in facts.collect()} == {1: (7, "RKD"), 2: (0, "KK")}
    got = defaultdict(list)
    for r in lines.collect():
        got[r._group].append((r.edit, r.turn, r.role, r.text))
    assert got == {"=1": [("R", 0, "user", "A."), ("K", 1, "assistant", "B.")], "=2": [("K", 0, "user", "Q?"), ("K", 1, "assistant", "A.")]}


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(40) for t in range(5)]
    out = defaultdict(list)
    for r in damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        out[r.conv_id, r.turn].append((r.role, r.text, r.alive))
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{c}:{t}".encode()) % 20
        one = ("user" if kind == 4 else role, "" if kind == 1 else "One Two" if kind == 2 else text, kind != 0)
        assert out[c, t] == [one] * (2 if kind == 3 else 1)


# --- Decontamination -------------------------------------------------------------------------------


WORDS = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def words(text):
    return WORDS.findall(lower(text or ""))


def decontaminated(docs, items):
    """(doc_id, n_words, n_hit, item ids, spans) of every document, by comparing all windows."""
    windows = defaultdict(set)
    for item, text in items:
        ws = words(text)
        t = min(10, len(ws))
        for i in range(len(ws) - t + 1 if t else 0):
            windows[tuple(ws[i:i + t])].add(item)
    out = []
    for doc_id, text in docs:
        ws, hit, found = words(text), set(), set()
        for i in range(len(ws)):
            for t in range(1, 11):
                if i + t <= len(ws) and (own := windows.get(tuple(ws[i:i + t]))):
                    hit |= set(range(i, i + t))
                    found |= {str(x) for x in own if x is not None}
        out.append((doc_id, len(ws), len(hit), len(found), h(",".join(sorted(found))), bool(hit)))
    return Counter(out)


def corpus(seed):
    rng = np.random.default_rng(seed)
    say = lambda n, m=40: " ".join(f"w{x}" for x in rng.integers(0, m, n))
    items = [(i, say(int(rng.integers(10, 60)), 400)) for i in range(25)]
    items += [(30, say(9, 300)), (31, "Seven! words; of it_are here,now"), (32, "only-two"), (33, "Überéö"), (34, ""), (35, None), (36, "...")]
    items += [(0, items[1][1] + " more"), (41, items[2][1]), (None, say(20, 500)), (50, "a a a a a a a a a a a a a a"), (51, " ".join(["b"] * 12) + " c")]
    docs = []
    for i in range(150):
        text = say(int(rng.integers(0, 80)), 400)
        for _ in range(int(rng.integers(0, 3))):
            item = words(items[int(rng.integers(0, len(items)))][1])
            a = int(rng.integers(0, max(1, len(item) - 8)))
            part = item[a:a + int(rng.integers(5, 40))]
            text += ", " + ("! ".join(part)).upper() + " " + say(int(rng.integers(0, 10)), 400)
        docs.append((i, text))
    docs += [(200, None), (201, ""), (202, " .. "), (203, "ÜBERÉÖ"), (203, "überéö"), (204, "a " * 40), (205, "b " * 30), (None, items[5][1]), (206, say(60_000, 5) + " " + items[7][1])]
    return docs, items


DOC, ITEM = "doc_id long, text string, row long, hits string, n_words long, item string", "item_id long, text string, item string, window string, print long"


@pytest.mark.parametrize("seed", [1, 2])
def test_decontamination(spark, tmp_path, seed):
    docs, items = corpus(seed)
    frame = spark.createDataFrame([(*d, 1, "h", 2, "i") for d in docs], DOC).repartition(3)
    bench = spark.createDataFrame([(*i, "i", "w", 1) for i in items], ITEM)
    got = by_query(spark, tmp_path, frame, "op13_decontamination", benchmark=bench)
    want = decontaminated(docs, items)
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want
    assert sum(x[-1] for x in want.elements()) > 50 and sum(not x[-1] for x in want.elements()) > 10


def test_decontamination_when_the_bitmap_lets_everything_through(spark, tmp_path, monkeypatch):
    docs, items = corpus(3)
    monkeypatch.setattr(winnow, "_bitmap", lambda prints: (bytes([255]) * 4096, 15))
    frame, bench = spark.createDataFrame([(*d, 1, "h", 2, "i") for d in docs[:60]], DOC), spark.createDataFrame([(*i, "i", "w", 1) for i in items], ITEM)
    got = by_query(spark, tmp_path, frame, "op13_decontamination", benchmark=bench)
    assert Counter(map(tuple, got)) == decontaminated(docs[:60], items)


def test_decontamination_of_empty_tables(spark, tmp_path):
    some = spark.createDataFrame([(1, "a b c", 1, "h", 2, "i")], DOC)
    none, item = spark.createDataFrame([], DOC), spark.createDataFrame([(1, "a b", "i", "w", 1)], ITEM)
    assert by_query(spark, tmp_path / "a", none, "op13_decontamination", benchmark=item) == []
    got, = by_query(spark, tmp_path / "b", some, "op13_decontamination", benchmark=item.limit(0))
    assert tuple(got) == (1, 3, 0, 0, h(""), False)


def test_spans_and_items(spark):
    text = " ".join(f"v{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"x {text} y {text} z")], "doc_id long, text string")
    got, = winnow.find(docs, spark.createDataFrame([(7, text), (8, "y v0")], "item_id long, text string")).collect()
    assert [tuple(s) for s in got.spans] == [(1, 26)]
    assert got["items"] == ["7", "8"]


@pytest.mark.parametrize("t", range(1, 11))
def test_every_shared_span_shares_a_fingerprint(t):
    rng = np.random.default_rng(t)
    for _ in range(30):
        span = [f"s{x}" for x in rng.integers(0, 6, t)]
        one, two = ([f"{c}{x}" for x in rng.integers(0, 9, 15)] + span + [f"{c}{x}" for x in rng.integers(0, 9, 15)] for c in "ab")
        found = []
        for text in (one, two):
            (_, own), = winnow._worded(pa.array([" ".join(text)]))
            place, value = own.prints(t)
            found.append({v for p, v in zip(place.tolist(), value.tolist(), strict=True) if 15 <= p <= 15 + t - winnow.gram(t)})
        assert found[0] & found[1]
