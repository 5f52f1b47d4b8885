"""Each operator on rows that are null, empty, long, repeated or clash, and against brute force."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tradeglass.llm import bpe, embeddings, exact_dedup, hilbert, hmm, html_text, langid, minhash, packing, token_files
from tradeglass.llm.components import connected
from tradeglass.llm.pieces import document_ids, library_table
from tradeglass.llm.queries import tokenizer_path

ODD = ["Hello, World's  ΑΣ ἀΣ.", "a<|endoftext|>b <|ENDOFTEXT|> x", "İstanbul ǅ ß", "é 1́ 12² ẛ̣", "a\x1cb\x85c\xa0d​e f", "", None,
       "\x00a", "日本語 ひらがな 😀😀", "***'s don't 'll'll ''s 's,'t x'1 12'd3 a,b;c9.É,à ée ́ ,́", "   ", "É́ ×÷ Ü.Ö", "|>x<|endoftext|>|>'re"]
LONG = " ".join(f"word{i % 977} of{i % 31}" for i in range(30_000))
SCHEMA = "doc_id long, text string, lang string, source string, key string, label string, node long, ids string"


def rows_of(texts, langs=None):
    return [(i, t, langs[i] if langs else "en", None if i % 3 else f"src{i % 5}", "k", "l", 1, "x") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, a long one, repeated rows, and a row without id; further columns have clashing names."""
    rows = rows_of([*ODD, LONG, "same text here", "same text here"])
    return spark.createDataFrame([*rows, rows[-1], (None, "same text here", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def ids_of(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids, np.uint32)


def test_pieces_give_the_ids_of_whole_texts(library):
    table = library_table(tokenizer_path())
    for batch in (ODD, *[[x] for x in ODD], [LONG, None, "x"]):
        assert [x.tolist() for x in document_ids(table, pa.array(batch, pa.string()))] == [ids_of(library, t).tolist() for t in batch]


@pytest.mark.parametrize("width", [0, 1, 7, 8, 13, 16, 23, 32])
def test_blocks_round_trip(width):
    rng = np.random.default_rng(width)
    for n in (0, 1, 255, 256, 257, 3000):
        ids = rng.integers(0, 1 << width, n, dtype=np.uint64).astype(np.uint32) + np.uint32(5 if width < 32 else 0)
        ids[::29] = np.uint32(2**32 - 1)
        content = token_files.write_segment([1, None], [ids, ids[:3]]) + b"\n"
        (names, null, lengths, flat), = token_files.read_segments(content)
        assert flat.tolist() == [*ids.tolist(), *ids[:3].tolist()] and null.tolist() == [0, 1] and lengths.tolist() == [n, min(3, n)]
        for block in range(-(-len(flat) // 256)):
            assert token_files.read_block(content, block).tolist() == flat[block * 256:block * 256 + 256].tolist()


def test_token_files(spark, odd, empty, library, tmp_path):
    token_files.write_token_files(odd, str(tmp_path / "a"), tokenizer_path(), 2)
    got = token_files.read_token_files(spark, str(tmp_path / "a")).orderBy("start").collect()
    want = sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [r.doc_id for r in got] == [r.doc_id for r in want]
    assert sorted(bytes(r.ids) for r in got) == sorted(np.append(ids_of(library, r.text), np.uint32(2)).tobytes() for r in want)
    assert [r.start for r in got] == list(itertools.accumulate([0, *[r.n_tokens for r in got]]))[:-1]
    token_files.write_token_files(empty, str(tmp_path / "b"), tokenizer_path(), 2)
    assert token_files.read_token_files(spark, str(tmp_path / "b")).count() == 0


def test_bpe(odd, empty, library):
    for r in bpe.round_trip(odd, tokenizer_path()).collect():
        ids = ids_of(library, r.text)
        assert bytes(r.ids) == ids.tobytes() and r.decoded == library.decode(ids.tolist(), skip_special_tokens=False)
    assert bpe.round_trip(empty, tokenizer_path()).count() == 0


def test_bpe_merges_in_rank_order(library):
    own = bpe.Bpe(tokenizer_path())
    rng = np.random.default_rng(0)
    for _ in range(500):
        word = "".join(rng.choice([*"thearinsoul"], rng.integers(1, 30)))
        assert own.text(word) == ids_of(library, word).tolist()


def test_packing(odd, empty, library):
    many = odd.unionByName(odd.sparkSession.range(400).selectExpr("id + 1000 AS doc_id", "repeat(concat('w', id, ' '), cast(id * 7 as int)) AS text",
        "'en' AS lang", "'s' AS source", "'k' AS key", "'l' AS label", "id AS node", "'i' AS ids")).coalesce(2)
    want = defaultdict(list)
    for r in many.collect():
        want[r.doc_id].append(np.append(ids_of(library, r.text), np.uint32(1)).tobytes())
    sequences, pieces = defaultdict(list), defaultdict(lambda: defaultdict(int))
    for r in packing.pack(many, tokenizer_path(), 1).collect():
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id][r.start, r.length, bytes(r.ids)] += 1
        assert len(r.ids) == 4 * r.length and any(len(w) == 4 * r.doc_tokens and w[4 * r.start:4 * (r.start + r.length)] == bytes(r.ids) for w in want[r.doc_id])
    for name, texts in want.items():
        assert sum(length * n for (_, length, _), n in pieces[name].items()) == sum(len(t) // 4 for t in texts)
    total = 0
    for s in sequences.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= 2048
        total += end
    assert total / (2048 * len(sequences)) > 0.97
    assert packing.pack(empty, tokenizer_path(), 1).count() == 0


def test_differencing_is_near_equal():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 257, 1500)
    sums = np.bincount(packing.differencing(sizes, 90), sizes, 90)
    assert sums.sum() == sizes.sum() and sums.max() - sums.min() < 40
    window, k = packing.windows_of(np.full(7, 2000))
    assert k == 7 and sorted(window) == list(range(7))


def test_cuckoo_index_inserts_deletes_and_grows():
    index, live = exact_dedup.CuckooIndex(2), {}
    rng = np.random.default_rng(2)
    for n in range(6000):
        key = rng.bytes(16) if not live or rng.random() < 0.7 else [*live][int(rng.integers(len(live)))]
        if rng.random() < 0.2:
            assert index.remove(key) == (live.pop(key, None) is not None)
        else:
            assert index.add(key, n) == (key not in live)
            live[key] = n
    assert {e[0]: e[1] for e in index.rows()} == live and index.live == len(live) and index.mask + 1 > 2


def test_exact_dedup(spark, odd, empty):
    groups = defaultdict(list)
    for r in odd.collect():
        groups[r.text or ""].append(r.doc_id)
    for r in exact_dedup.mark(odd).collect():
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        best = max((i for i in groups[text] if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (best, len(groups[text]), r.doc_id == best)
    kept = exact_dedup.unique(odd)
    assert kept.columns == odd.columns and Counter(r.text or "" for r in kept.collect()) == Counter(list(groups))
    assert exact_dedup.mark(empty).count() == exact_dedup.unique(empty).count() == 0


def test_exact_index_changes(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, text string")
    b = spark.createDataFrame([(3, "x"), (4, "z")], "doc_id long, text string")
    gone = spark.createDataFrame([("y",)], "text string").select(exact_dedup.text_key("text").alias("key"))
    after = exact_dedup.change_index(exact_dedup.build_index(a), b, gone).collect()
    assert sorted((r.keep_id, r.group_size) for r in after) == [(3, 2), (4, 1)]


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components(sets, names, percent=85):
    """Smallest name reachable by links of that similarity or more."""
    up = list(range(len(sets)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i
    for i, j in itertools.combinations(range(len(sets)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            up[max(top(i), top(j))] = min(top(i), top(j))
    low = {}
    for i, n in enumerate(names):
        low.setdefault(top(i), n)
    return [low[top(i)] for i in range(len(sets))]


@pytest.fixture(scope="module")
def near():
    """A hub with many edited copies (a third of all rows), chains, exact copies, and other texts."""
    rng = np.random.default_rng(9)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 400, n)]
    texts = []
    hub = words(150)
    for _ in range(90):
        copy = list(hub)
        for at in rng.integers(0, 150, rng.integers(0, 5)):
            copy[at] = f"edit{rng.integers(1000)}"
        texts.append(" ".join(copy))
    chain = words(120)
    for k in range(12):
        texts.append(" ".join(chain[3 * k:] + [f"new{x}" for x in range(3 * k)]))
    texts += ["The same FEW words", "the Same few\twords", "few words", *[" ".join(words(60)) for _ in range(100)]]
    texts += texts[-5:] + ["", None, " \n"]
    return [texts[i] for i in rng.permutation(len(texts))]


@pytest.mark.parametrize("partners", [(1,), (1, 8)])
def test_last_round_compares_all_that_is_left(spark, monkeypatch, partners):
    """Two dense groups that are apart everywhere but for one pair, and a group whose members are all just under the threshold."""
    rng = np.random.default_rng(21)
    base = [f"v{x}" for x in range(200)]
    apart = lambda at, name: [f"{name}{i}" if i in at else w for i, w in enumerate(base)]
    texts = [" ".join(apart({5 * int(x) + 2 for x in rng.choice(38, 6, replace=False)}, f"t{k}_")) for k in range(60)]
    one, two = apart(range(8, 14), "one"), apart(range(100, 106), "two")
    for k in range(40):
        texts.append(" ".join([*one[:150], *(f"x{k}_{i}" if i == k else w for i, w in enumerate(one[150:]))]))
        texts.append(" ".join([*two[:150], *(f"y{k}_{i}" if i == k else w for i, w in enumerate(two[150:]))]))
    monkeypatch.setattr(minhash, "PARTNERS", partners)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 2000)
    sets = [shingles(t) for t in texts]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = components(sets, range(len(texts)))
    assert [got[i] for i in range(len(texts))] == want and len(set(want)) > 10


def test_near_duplicates(spark, near, odd, empty):
    docs = spark.createDataFrame(list(enumerate(near)), "doc_id long, text string")
    got = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    sets = [shingles(t) for t in near]
    want = components(sets, range(len(near)))
    assert [got[i].component_id for i in range(len(near))] == want and [got[i].n_shingles for i in range(len(near))] == [len(s) for s in sets]
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values()) and 1 < max(Counter(want).values())
    assert sorted(r.doc_id for r in minhash.unique(docs).collect()) == sorted(set(want))
    odd_rows = minhash.near_duplicates(odd).collect()
    assert len(odd_rows) == odd.count() and minhash.near_duplicates(empty).count() == 0
    same = [r for r in odd_rows if r.n_shingles == 1 and r.component_id == len(ODD) + 1]
    assert sorted((r.doc_id is None, r.kept) for r in same) == [(False, False), (False, False), (False, True), (True, False)]
    assert minhash.unique(odd).columns == odd.columns


def test_texts_that_share_an_id_go_by_their_own_component(spark):
    words = lambda name, n: [f"{name}{i}" for i in range(n)]
    a, b, c = words("a", 100), words("b", 100), words("c", 100)
    near_b, near_c = [*b[:98], "x", "y"], [*c[:98], "x", "y"]
    rows = [(3, b), (5, a), (5, near_b), (5, near_b), (7, c), (7, a[:50]), (8, near_c), (9, near_b), (9, None), (None, near_b)]
    docs = spark.createDataFrame([(i, t and " ".join(t)) for i, t in rows], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).where("doc_id IS NOT NULL").collect()))
    assert got == [(3, 96, 3, True), (5, 96, 3, False), (5, 96, 3, False), (5, 96, 5, True), (7, 46, 7, True), (7, 96, 7, True), (8, 96, 7, False), (9, 0, 9, True), (9, 96, 3, False)]
    left = sorted((r.doc_id, r.text or "") for r in minhash.unique(docs).where("doc_id IS NOT NULL").collect())
    assert left == [(3, " ".join(b)), (5, " ".join(a)), (7, " ".join(a[:50])), (7, " ".join(c)), (9, "")]
    assert minhash.unique(docs).where("doc_id IS NULL").count() == 1 and minhash.unique(docs).columns == docs.columns


def test_last_round_runs_when_named_pairs_are_refuted(spark, monkeypatch):
    """x and y are linked; z is nearer to x and w to y by estimate, but just under the threshold, and hide the link from the first rounds."""
    words = lambda n, at: [f"q224x{at + i}" for i in range(n)]
    x = words(404, 0)
    y = x[:-32] + words(32, 1000)
    texts = [" ".join(t) for t in (x, y, words(33, 2000) + x[33:], y[:100] + words(29, 3000) + y[129:])]
    sets = list(minhash.shingle_sets(pa.array(texts)))
    assert [minhash._similar(sets[i], sets[j], 85) for i, j in itertools.combinations(range(4), 2)] == [True] + [False] * 5
    x, y, z, w = minhash.sketches(sets)
    assert 193 <= (x == y).sum() < min((x == z).sum(), (y == w).sum())
    real = minhash._candidates

    def nearest(k, percent):
        found = real(1000, percent)

        def pairs(batches):
            for batch in found(batches):
                yield batch.filter(pa.array([u > 0 or v > 1 for u, v in zip(batch["u"].to_pylist(), batch["v"].to_pylist(), strict=True)], pa.bool_()))
        return pairs

    monkeypatch.setattr(minhash, "_candidates", nearest)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(docs).collect()) == [(0, 0), (1, 0), (2, 2), (3, 3)]


def test_cells_of_a_hot_bucket_meet_once(spark):
    from tradeglass.llm.components import cells
    rows = spark.range(50).selectExpr("id AS node", "1 AS key")
    met = Counter()
    for _, group in itertools.groupby(sorted(cells(rows, ["key"], "node", 8).collect(), key=lambda r: r.cell), key=lambda r: r.cell):
        group = list(group)
        for a, b in itertools.combinations(group, 2):
            if a.low == a.high or a.mine != b.mine:
                met[tuple(sorted((a.node, b.node)))] += 1
    assert len(met) == 50 * 49 // 2 and set(met.values()) == {1}


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(3)
    pool = rng.integers(1, 1 << 62, 400).astype(np.uint64)
    a, b = np.unique(pool[:350]), np.unique(pool[50:])
    x, y, small = minhash.sketches([a, b, a[:2]])
    assert abs((x == y).mean() - 0.75) < 0.12 and small.any()


def test_connected(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 101), (200, 150)]
    got = {r.node: r.label for r in connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 150: 150, 200: 150}


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    rows = []
    for label in (1, 2):
        hub = rng.standard_normal(64)
        rows += [(label, (hub + rng.normal(0, s, 64)).astype(np.float32).tolist()) for s in rng.choice([0.05, 0.1, 0.15, 0.2], 120)]
        rows += [(label, rng.standard_normal(64).astype(np.float32).tolist()) for _ in range(60)]
    rows += [rows[0], (None, rows[0][1]), (2, rows[0][1]), (1, None), (1, []), (1, [0.0] * 64), (1, [float("nan")] * 64), (1, [1.0, None]), (3, [1.0]), (3, [2.0]), (3, [-2.0]), (1, rows[0][1][:32])]
    table = [(i, e, l, "x", 1) for i, (l, e) in enumerate(rows)]
    schema = "vec_id long, embedding array<float>, label int, key string, node int"
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(table, schema)).collect()}
    sound = [e is not None and len(e) and None not in e and all(map(math.isfinite, e)) and any(e) and l is not None for _, e, l, _, _ in table]
    links = defaultdict(set)
    for (i, e, l, _, _), (j, f, m, _, _) in itertools.combinations(table, 2):
        if sound[i] and sound[j] and l == m and len(e) == len(f):
            a, b = np.array(e, float), np.array(f, float)
            if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.98:
                links[i].add(j)
                links[j].add(i)
    for i in range(len(table)):
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(links[i]), min(seen), i == min(seen)), i
    nameless = embeddings.near_duplicates(spark.createDataFrame([(None, [1.0], 1, "x", 1), (5, [1.0], 1, "x", 1), (5, [1.0], 1, "x", 1)], schema)).collect()
    assert sorted((r.vec_id or -1, r.n_links, r.component_id or -1, r.kept) for r in nameless) == [(-1, 0, -1, False), (5, 1, 5, True), (5, 1, 5, True)]
    assert embeddings.near_duplicates(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("bits", [10, 14, 24])
def test_tables_follow_the_bits(bits):
    tables = embeddings.tables_of(bits, 0.98)
    same = (1 - math.acos(0.98) / math.pi) ** bits
    assert (1 - same) ** tables <= embeddings.MISSED < (1 - same) ** (tables - 1)
    rng = np.random.default_rng(bits)
    a = embeddings.unit(rng.standard_normal((500, 32)))
    noise = rng.standard_normal(a.shape)
    noise -= (noise * a).sum(1, keepdims=True) * a
    b = 0.981 * a + np.sqrt(1 - 0.981**2) * embeddings.unit(noise)
    one, two = (embeddings.encode(x, bits)[2] for x in (a, b))
    assert one.shape == (500, tables) and (one == two).any(1).all() and one.max() < 1 << bits


def test_large_labels_take_more_bits(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 2)
    monkeypatch.setattr(embeddings, "BITS", 2)
    rng = np.random.default_rng(4)
    hub = rng.standard_normal(16)
    rows = [(i, [float(x) for x in (hub + 0.03 * rng.standard_normal(16) if i % 3 == 0 else rng.standard_normal(16))], "big" if i < 150 else f"small{i % 9}") for i in range(200)]
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    units = embeddings.unit(np.array([v for _, v, _ in rows]))
    close = units @ units.T >= 0.98
    want = {i: sum(close[i, j] and rows[i][2] == rows[j][2] and i != j for j in range(200)) for i in range(200)}
    assert got == want and max(want.values()) > 10


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(6)
    a = embeddings.unit(rng.standard_normal((3000, 64)))
    b = embeddings.unit(a + 0.02 * rng.standard_normal(a.shape))
    signs, factor, _ = embeddings.encode(a)
    turned = b @ embeddings.rotations(64, 200)[:64].T
    estimate, exact = (signs * turned).sum(1) / 8 / factor, (a * b).sum(1)
    slack = embeddings.ERRORS * np.sqrt((1 - factor**2) / factor**2 / 63) * np.sqrt(1 - exact**2)
    assert abs((estimate - exact).mean()) < 2e-3 and (np.abs(estimate - exact) <= slack).all()


def test_hidden_markov(spark, odd, empty):
    rng = np.random.default_rng(7)
    words = {k: [f"{k}{x}" for x in range(50)] for k in "ab"}
    texts = [" ".join(rng.choice(words["ab"[i % 2]], 40)) for i in range(400)]
    docs = spark.createDataFrame([*rows_of(texts)], SCHEMA).unionByName(odd.withColumn("doc_id", F.col("doc_id") + 1000))
    table = docs.select("doc_id", "text").collect()
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    counts = Counter(x for i, t in table if not held(i) for x in tokens(t))
    total, kinds = sum(counts.values()), len(counts)
    want = sorted((i is None, i or 0, held(i), len(tokens(t)), sum(counts[x] > 0 for x in tokens(t)), total,
                   round(sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (kinds + 1))) for x in tokens(t)), 6)) for i, t in table)
    got = hmm.score(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    mixed = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert sum(r.score for r in mixed) > sum(r.base_score for r in mixed)
    assert hmm.score(empty).count() == 0


def test_forward_and_expected_counts_against_plain_recursion():
    rng = np.random.default_rng(8)
    emit = rng.random((hmm.END + 1, hmm.STATES))
    model = hmm.Hmm(np.full(hmm.STATES, 1 / hmm.STATES), rng.dirichlet(np.ones(hmm.STATES), hmm.STATES), emit / emit.sum(0))
    texts = [rng.integers(0, 20, n).astype(np.int32) for n in (0, 1, 7, 3, 7, 0)]
    start, move, counted, got = hmm.Sweep(texts).expected(model)
    states = range(hmm.STATES)
    for text, found in zip(texts, got, strict=True):
        symbols = [*text, hmm.END]
        p = [model.start[s] * model.emit[symbols[0], s] for s in states]
        for x in symbols[1:]:
            p = [sum(p[r] * model.move[r, s] for r in states) * model.emit[x, s] for s in states]
        assert math.isclose(found, math.log(sum(p)), rel_tol=1e-6)
    assert math.isclose(start.sum(), len(texts), rel_tol=1e-4) and math.isclose(move.sum(), sum(map(len, texts)), rel_tol=1e-4)
    assert math.isclose(counted.sum(), sum(map(len, texts)) + len(texts), rel_tol=1e-4) and math.isclose(counted[hmm.END].sum(), len(texts), rel_tol=1e-4)


def test_language(spark, odd, empty):
    alphabets = {"xx": "abcde", "yy": "defgh", "zz": "éàüabc"}
    rng = np.random.default_rng(5)
    langs = [["xx", "yy", "zz"][i % 3] for i in range(300)]
    texts = [" ".join("".join(rng.choice([*alphabets[k]], 6)) for _ in range(20)) for k in langs]
    docs = spark.createDataFrame([(i, t, k if i % 7 else None) for i, (t, k) in enumerate(zip(texts, langs, strict=True))], "doc_id long, text string, lang string")
    got = langid.detect(docs).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) > 0.95 * len(held)
    model = langid.fit(docs)
    pred = {r.text: r.p for r in odd.select("text", langid.predict(F.col("text"), model).alias("p")).collect()}
    assert all(pred[t].lang_pred == "und" and pred[t].score == 0 for t in ("", None, "   ")) and pred["日本語 ひらがな 😀😀"].lang_pred in alphabets
    assert langid.detect(empty).count() == 0
    assert {r.lang_pred for r in langid.detect(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_empty_labelled_texts_teach_nothing(spark):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join("".join(rng.choice([*("abcd" if i % 2 else "wxyz")], 5)) for _ in range(8)), "ab" if i % 2 else "wz") for i in range(100)]
    empties = [(-1 - i, t, "ab") for i, t in enumerate(["", " ", "12 .", "", None])]
    docs = spark.createDataFrame([*empties, *rows], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in docs.select("doc_id", langid.predict(F.col("text"), langid.fit(docs)).alias("p")).collect()}
    assert all(got[i].p.lang_pred == k and 0 <= got[i].p.score <= 1 for i, _, k in rows)
    assert all(got[i].p.lang_pred == "und" and got[i].p.score == 0 for i, _, _ in empties)
    bits = np.packbits(np.concatenate([x > 0 for _, x in langid.presence(pa.array(["", *(t for _, t, _ in rows)]))]), axis=1)
    model = langid.solve(bits, ["ab", *(k for _, _, k in rows)])
    (_, some), = langid.presence(pa.array([rows[0][1], ""]))
    assert np.isfinite(model.scores(some, np.unpackbits(model.landmarks, axis=1).astype(np.float32))).all()


def test_language_scores_are_those_of_dense_kernel_ridge_regression():
    """With every text a landmark the solution is the dense one of (K + ridge / share) alpha + bias = target, sum(alpha) = 0."""
    rng = np.random.default_rng(8)
    names = [["xx", "yy", "zz"][i % 3] for i in range(100)]
    texts = [" ".join("".join(rng.choice([*{"xx": "abcde", "yy": "defgh", "zz": "cdefx"}[k]], 4)) for _ in range(6)) for k in names]
    rows = np.concatenate([x for _, x in langid.presence(pa.array(texts))]).astype(np.float64)
    model = langid.solve(np.packbits(rows > 0, axis=1), names)
    size = np.sqrt(rows.sum(1))
    kernel = rows @ rows.T / size[:, None] / size[None, :]
    share = np.array([1 / names.count(k) for k in names])
    system = np.block([[kernel + langid.RIDGE * np.diag(1 / share), np.ones((100, 1))], [np.ones((1, 100)), np.zeros((1, 1))]])
    target = np.array([[1.0 if k == x else -1.0 for x in model.languages] for k in names])
    dense = np.linalg.solve(system, np.concatenate([target, np.zeros((1, 3))]))
    want = kernel @ dense[:-1] + dense[-1]
    got = model.scores(rows.astype(np.float32), np.unpackbits(model.landmarks, axis=1).astype(np.float32))
    assert np.abs(got - want).max() < 0.02 and (got.argmax(1) == want.argmax(1)).mean() > 0.97


def test_kernel_counts_common_ngrams():
    (_, rows), = langid.presence(pa.array(["abc", "xbcd", "", None]))
    grams = lambda t: {t[i:i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    assert rows[0] @ rows[1] == len(grams("abc") & grams("xbcd")) and rows[0].sum() == len(grams("abc")) and not rows[2:].any()


def test_hilbert_curve_steps_to_neighbours(spark):
    for n, bits in ((2, 3), (3, 2), (4, 1)):
        cells = spark.range(1 << (n * bits)).select(*[((F.col("id") / F.lit(1 << (bits * i))).cast("long") % (1 << bits)).alias(f"a{i}") for i in range(n)])
        rows = sorted(cells.withColumn("h", hilbert.curve_index([F.col(f"a{i}") for i in range(n)], bits)).collect(), key=lambda r: r.h)
        assert [r.h for r in rows] == list(range(1 << (n * bits)))
        assert all(sum(abs(x - y) for x, y in zip(a[:-1], b[:-1], strict=True)) == 1 for a, b in itertools.pairwise(rows))


def test_hilbert_shards(spark, odd, empty, near, tmp_path):
    for docs in (odd, spark.createDataFrame(rows_of(near), SCHEMA)):
        got = hilbert.assign(docs, ["source", "lang"]).collect()
        texts = Counter((len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
        assert Counter((r.size, r.text_crc32) for r in got) == texts
        slots = defaultdict(list)
        for r in got:
            assert (r.law, r.grown_shard) == ("rows", None) and 0 <= r.shard < 8
            slots[r.shard].append(r.slot)
        counts = [len(slots[s]) for s in range(8)]
        assert max(counts) - min(counts) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())
        order = sorted(got, key=lambda r: (r.shard, r.slot))
        assert [r.curve for r in order] == sorted(r.curve for r in got)
    assert hilbert.assign(empty, ["source", "lang"]).count() == 0
    docs = spark.createDataFrame(rows_of(near), SCHEMA)
    hilbert.write_shards(docs, ["source", "lang"], str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(near)
    clashing = odd.withColumn("shard", F.lit("mine")).withColumn("_shard", F.lit(7)).withColumn("rank", F.lit("r"))
    hilbert.write_shards(clashing, ["source", "lang"], str(tmp_path / "odd"))
    back = spark.read.parquet(str(tmp_path / "odd"))
    names = [c for c in clashing.columns]
    assert Counter(map(tuple, back.select(names).collect())) == Counter(map(tuple, clashing.collect())) and set(back.columns) - set(names) == {"__shard"}


PARAGRAPHS = ["First paragraph of the story, long enough to matter to anybody who reads it.", "Second & last part: with a link inside the text.", "Short."]


def page(article, before="", after=""):
    return f'<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>{before}{article}{after}</body></html>'


def test_hilbert_steps_of_strings_with_a_shared_prefix(spark):
    rows = [(i, "same text", f"https://example.org/{'abcdefgh'[i % 8]}") for i in range(160)]
    got = hilbert.assign(spark.createDataFrame([*rows, (160, "same text", None)], "doc_id long, text string, source string"), ["source"]).collect()
    curves = defaultdict(set)
    for r in got:
        curves[rows[r.doc_id][2] if r.doc_id < 160 else None].add(r.curve)
    # quantiles leave the null and the smallest value in step 0
    assert all(len(c) == 1 for c in curves.values()) and len({min(c) for c in curves.values()}) == 8


@pytest.mark.parametrize("article", [
    "<article><h1>Head</h1><p>{0}<p>{1}</p><p>{2}</article>", "<div class='post-body'><h1>Head</h1><p>{0}</p><p>{1}</p><p>{2}</p></div>",
    "<main><header><h1>Head</h1></header><section><p>{0}</p></section><section><p>{1}</p><p>{2}</p></section></main>",
    "<div><h1>Head</h1><b>{0}</b><br><p>{1}<p>{2}</div>"])
def test_main_text(article):
    first, second, third = PARAGRAPHS
    body = article.format(first, second.replace("&", "&amp;").replace("a link", "<a href='/x'>a  link</a>"), third)
    before = ("<header class='site'><a href='/'>Home</a></header><nav><ul>" + "".join(f"<li><a href='/{i}'>Menu entry {i}</a></li>" for i in range(9)) + "</ul></nav>"
              "<div id='cookie-notice'>We use cookies to make this site work better for all of our readers everywhere.</div><!-- ad --><div class='ad'>Buy now, buy this, buy more.</div>")
    after = ("<aside><p>About the author, who writes at length about this and that.</p></aside><form><label>Mail</label><input><button>Go</button></form>"
             "<section id='comments'><h3>2 comments</h3><article class='comment'><p>I liked it a lot, thank you for a great read about things.</p></article></section><footer>&copy; 2024</footer>")
    assert html_text.main_text(page(body, before, after)) == "\n\n".join(["Head", *PARAGRAPHS])


@pytest.mark.parametrize("article", [
    "<article><h1 id='search-algorithms'>Head</h1><p id='copyright-law'>{0}</p><section id='related-work'><p>{1}</p><p>{2}</p></section></article>",
    "<article class='post tag-social has-comments'><h1>Head</h1><p class='notice'>{0}</p><section id='search'><p>{1}</p><p>{2}</p></section></article>",
    "<article class='social'><h1>Head</h1><p>{0}</p><p>{1}</p><p>{2}</p></article>",
    "<div class='content has-sidebar'><h1 class='banner'>Head</h1><p>{0}</p><p>{1}</p><p>{2}</p></div>",
    "<div class='widget'><h1>Head</h1><p>{0}</p><p>{1}</p><p>{2}</p></div>"])
def test_main_text_is_not_lost_to_names(article):
    before = "<nav><a href='/'>Home</a></nav><div class='ad'>Buy now.</div><div class='related-posts'><a href='/1'>One more story</a> <a href='/2'>And another</a></div>"
    after = "<section id='comments'><h3>2 comments</h3><article class='comment'><p>I liked it.</p></article></section>"
    assert html_text.main_text(page(article.format(*PARAGRAPHS).replace("&", "&amp;"), before, after)) == "\n\n".join(["Head", *PARAGRAPHS])


def test_names_still_rule_out_inside_an_article():
    ads = "<div class='ad'>Buy now.</div><ul class='share-links'><li><a href='/s'>Send</a></ul><section id='comments'><p class='x'>So true</p><form></form></section>"
    story = "".join(f"<p>{p}</p>" for p in PARAGRAPHS * 3).replace("&", "&amp;")
    assert html_text.main_text(page(f"<article>{story}{ads}</article>")) == "\n\n".join(PARAGRAPHS * 3)


def test_main_text_takes_loose_text_beside_the_path():
    lead = "A lead as bare text, " * 8 + "with <b>bold</b> and <a href='/x'>linked</a> words<script>var x</script> to its end."
    end = "<i>Last</i> words as bare text, " + "as long as the lead was, " * 6 + "and <font>done</font>."
    body = f"{lead}<br><div><p>{PARAGRAPHS[0]}</p><p>{PARAGRAPHS[2]}</p></div><!-- x -->{end}<div class='ad'>Buy now.</div><a href='/1'>One more story to read</a> | <a href='/2'>another</a>"
    plain = [" ".join(re.sub("<script.*?</script>|<[^>]*>", "", x).split()) for x in (lead, end)]
    assert html_text.main_text(page(body)) == "\n\n".join([plain[0], PARAGRAPHS[0], PARAGRAPHS[2], plain[1]])


@pytest.mark.parametrize("article", ["<article><h1>Head</h1><p>{0}</p><p>{1}</p><p>{2}</p></article>", "<div class='content'><h1>Head</h1><p>{0}</p><p>{1}</p><p>{2}</p></div>"])
def test_main_text_inside_a_page_wide_form(article):
    story = article.format(*PARAGRAPHS).replace("&", "&amp;")
    search = "<form action='/find'><p>Search this site</p><input name='q'><button>Find</button></form>"
    inner = f"<nav><a href='/'>Home</a></nav>{story}<select><option>One</option></select><textarea>Your words</textarea><button>Send</button><label>Mail</label>"
    assert html_text.main_text(page(f"<form id='aspnetForm' action='/'>{inner}</form>", search)) == "\n\n".join(["Head", *PARAGRAPHS])


def test_main_text_of_odd_pages(spark):
    assert [html_text.main_text(x) for x in (None, "", "<p>", "just text", "a<b>c", "<article>" * 3000 + "deep" + "</article>" * 3000)] == ["", "", "", "just text", "ac", "deep"]
    html = page("<article>" + "".join(f"<p>part {i}</p>" for i in range(20_000)) + "</article>")
    assert html_text.main_text(html).count("\n\n") == 19_999
    rows = spark.createDataFrame([(1, html, "t"), (None, None, "t"), (1, html, "t")], "page_id long, html string, text string")
    assert sorted(len(r.x) for r in rows.select(html_text.extract(F.col("html")).alias("x")).collect())[0] == 0


def test_pipeline(spark, odd, near):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.createDataFrame(rows_of(near, ["en"] * len(near)), SCHEMA)
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, "")
        assert kept.columns == docs.columns
        kept = spark.createDataFrame(kept.collect(), SCHEMA)
    has_letter = [i for i, t in enumerate(near) if t and t.strip()]
    exact = {}
    for i in has_letter:
        exact[near[i]] = i
    left = sorted(exact.values())
    want = set(components([shingles(near[i]) for i in left], left, 80))
    assert {r.doc_id for r in kept.collect()} == want
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, "").collect()
    assert {r.doc_id for r in pieces} == want


def test_pipeline_joins_near_copies_from_080(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = np.random.default_rng(80)
    texts = []
    for k in range(60):  # the first 3 to 6 of 10 edits apart: similarities on both sides of 0.80
        base = [f"v{x}" for x in rng.integers(0, 10_000, 200)]
        copy = list(base)
        for at in rng.choice(40, 3 + k % 4, replace=False) * 5:
            copy[at] = f"edit{k}"
        texts += [" ".join(base), " ".join(copy)]
    sets = [shingles(t) for t in texts]
    share = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    assert sum(0.80 <= x < 0.85 for x in share) >= 15 and sum(x < 0.80 for x in share) >= 15
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    want = {2 * i for i in range(60)} | {2 * i + 1 for i, x in enumerate(share) if x < 0.80}
    assert {r.doc_id for r in corpus_pipeline.without_near_copies(spark, docs, "").collect()} == want


@pytest.mark.parametrize("percent", [50, 80, 85, 95, 100])
def test_bands_and_bound_follow_the_asked_similarity(percent):
    share, (bands, rows) = percent / 100, minhash.banding(percent)
    assert bands * rows <= minhash.COORDINATES and (1 - share ** rows) ** bands <= 3e-7
    least = minhash.least_equal(percent)
    below = sum(math.comb(256, k) * share ** k * (1 - share) ** (256 - k) for k in range(least))
    assert below < 5e-5


def test_pipeline_without_labels_keeps_texts_with_letters(spark, odd):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    for docs in (odd.withColumn("lang", F.lit(None).cast("string")), odd.withColumn("doc_id", F.lit(None).cast("long"))):
        want = Counter(r.text for r in docs.collect() if any(c.isalpha() for c in r.text or ""))
        assert Counter(r.text for r in corpus_pipeline.language(spark, docs, "").collect()) == want and len(want) > 5
