"""Month words, as-of joins, inquiry folding, grounding and digest comparison against plain readings."""

import random

import pytest
from pyspark.sql import functions as F

from tradeglass.operators import grounding, linkage, packed, regression
from tradeglass.operators import history as h
from tradeglass.plans import references

CELL = "report_id string, entity_key string, series string, m int, value_text string, state string, source string, ord int"
KEY = ["report_id", "entity_key"]


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def cells(spark):
    """Histories that cross words and years, with blanks, duplicates of a month, gap slots and odd codes."""
    rnd = random.Random(5)
    rows = []
    for a in range(60):
        start = rnd.choice([0, 59, 60, 119, 1995 * 12, 1999 * 12 + 11])
        m = start
        for _ in range(rnd.randint(1, 40)):
            m += rnd.choice([1, 1, 1, 1, 2, 5, 14, 61])
            code = rnd.choice(["OK", "OK", "30", "60", "90", "120", "150", "180", "CO", "COL", "R", "VS", "", "X", "ND", "paid as agreed", "odd"])
            rows.append(("r", f"a{a}", "status", m, code, "", "", 0))
            if rnd.random() < .2:
                rows.append(("r", f"a{a}", "status", m, rnd.choice(["OK", "60", ""]), "", "", 1))
            if rnd.random() < .4:
                rows.append(("r", f"a{a}", "balance", m, f"${rnd.randint(0, 400)}.00", "", "", 0))
            if rnd.random() < .3:
                rows.append(("r", f"a{a}", rnd.choice(["paid", "scheduled", "last_payment_date"]), m, rnd.choice(["$5.00", "-", "01/02/2001", "0"]), "", "", 0))
            if rnd.random() < .3:
                rows.append(("r", f"a{a}", "gap_slot", m + 1, "", "missing_slot", rnd.choice(["projected_gap_slot", "text"]), 0))
    return spark.createDataFrame(rows, CELL)


@pytest.fixture(scope="module")
def anchors(spark):
    return spark.createDataFrame([("r", f"a{a}", ["experian_acr_v1", "equifax_old_v1"][a % 2], [None, 1994 * 12, 1995 * 12 + 3, 40][a % 4]) for a in range(60)],
                                 "report_id string, entity_key string, profile_id string, opened_m int").withColumn("closure_m", F.lit(None).cast("int"))


def test_words_give_the_conflicts_of_the_month_grid(spark, cells, anchors):
    features = h.anchored_features(cells, anchors)
    grid = h.conflicts(features)
    words = packed.month_words(cells)
    found = packed.conflicts(words, anchors)
    names = [*KEY, "kind", "m", "code", "prev_m", "gap_len", "active", "prev_active"]
    assert values(found.select(names)) == values(grid.select(names)) and found.select("kind").distinct().count() == 8
    assert values(packed.balance_reduction_conflicts(found, cells).select(*KEY, "kind", "m", "prev_m")) == values(h.balance_reduction_conflicts(grid).select(*KEY, "kind", "m", "prev_m"))
    assert values(packed.missing_months(words)) == values(h.missing_months(features))
    assert values(packed.neighbours(words).select(*KEY, "m", "older_m", "newer_m")) == values(h.neighbours(features).select(*KEY, "m", "older_m", "newer_m"))
    runs = h.runs(features.where("blank").select(*KEY, "m"), KEY).select(*KEY, "first_m", "last_m", "n_months")
    assert values(packed.blank_runs(words).select(*KEY, "first_m", "last_m", "n_months")) == values(runs)


def test_printed_rows_give_the_facts_of_the_month_grid(spark, cells, anchors):
    odd = [("r", "odd", s, m, v, st, src, o) for s, m, v, st, src, o in (
        ("status", 24001, "30", "", "", 0), ("status", 24030, "CO", "", "", 0), ("status", 24030, "OK", "", "", 1), ("balance", 24002, "$1,200", "", "", 0), ("balance", 24014, "$9", "", "", 0),
        ("paid", 24001, "-", "", "", 0), ("paid", 24003, "", "", "", 0), ("past_due", 24026, "$5", "", "", 0), ("gap_slot", 24004, "", "missing_slot", "projected_gap_slot", 0),
        ("gap_slot", 24016, "", "missing_slot", "projected_gap_slot", 0), ("paid", None, "$3", "", "", 0), ("last_payment_date", 24002, "01/05/2000", "", "", 0))]
    odd += [("r", "none", "status", None, "30", "", "", 0), ("r", "none", "balance", None, "$4", "", "", 0), ("r", "empty", "balance", 24000, "$4", "", "", 0)]
    schema = "report_id string, entity_key string, series string, m int, value_text string, state string, source string, ord int"
    both = cells.selectExpr(*(f"cast({f.split()[0]} AS {f.split()[1]}) AS {f.split()[0]}" for f in schema.split(", "))).unionByName(spark.createDataFrame(odd, schema))
    more = spark.createDataFrame([("r", "odd", "experian_acr_v1", 23990, 24011), ("r", "none", "equifax_new_v1", 1, None), ("r", "empty", None, None, 24000)], "report_id string, entity_key string, profile_id string, opened_m int, closure_m int")
    known = anchors.selectExpr("report_id", "entity_key", "profile_id", "opened_m", "cast(opened_m + 30 AS int) AS closure_m").unionByName(more)
    dense = h.history_facts(h.anchored_features(both, known)).localCheckpoint()
    printed = h.account_facts(both, known)
    plan, printed = printed._jdf.queryExecution().optimizedPlan().toString().lower(), printed.localCheckpoint()
    assert printed.columns == dense.columns and printed.dtypes == dense.dtypes
    for c in dense.columns[2:]:
        shown = f"array_sort({c})" if c == "cell_pay_days" else c
        assert values(printed.selectExpr(*KEY, shown)) == values(dense.selectExpr(*KEY, shown)), c
    assert "explode" not in plan


def test_words_of_no_cells(spark, cells, anchors):
    words = packed.month_words(cells.limit(0))
    assert packed.conflicts(words, anchors).count() == packed.blank_runs(words).count() == packed.neighbours(words).count() == 0


def test_words_shuffle_before_and_after_combining_by_hash(spark, cells):
    plan = packed.month_words(cells)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_as_of_join(spark):
    rnd = random.Random(3)
    held = {("r", f"a{rnd.randint(0, 5)}", rnd.choice(["x", "y"]), rnd.randint(0, 40)): f"${rnd.randint(0, 9)}" if rnd.random() < .8 else "none" for _ in range(150)}
    asks = [("r", f"a{rnd.randint(0, 6)}", rnd.choice(["x", "y"]), rnd.randint(-1, 42), i) for i in range(120)]
    c = spark.createDataFrame([(*k, v) for k, v in held.items()], "report_id string, entity_key string, series string, m int, value_text string")
    q = spark.createDataFrame(asks, "report_id string, entity_key string, series string, want int, id int")
    for after in (False, True):
        got = {r.id: (r.near_m, r.near_value, r.top_m, r.top_value) for r in references.as_of(q, c, "want", after).collect()}
        for r, e, s, m, i in asks:
            own = sorted((k[3], v) for k, v in held.items() if k[:3] == (r, e, s) and (k[3] >= m if after else k[3] <= m))
            near = (own[0] if after else own[-1]) if own else (None, None)
            money = [(-int(v[1:]), x, v) for x, v in own if v[0] == "$"]
            top = min(money)[1:] if money else (None, None)
            assert got[i] == (*near, *top), (after, i)


def greedy(rows):
    """Folding in the order of the lists: primaries, then each fallback into the first entry that matches, else kept."""
    def same(a, b):
        return a[2] == b[2] and a[3] and b[3] and (a[3] in b[3] or b[3] in a[3])

    merged = [r for r in sorted(rows) if r[1] == "primary"]
    target = {r[0]: r[0] for r in merged}
    for r in sorted(r for r in rows if r[1] == "fallback"):
        hit = next((x for x in merged if same(x, r)), None)
        target[r[0]] = hit[0] if hit else r[0]
        if hit is None:
            merged.append(r)
    return target


@pytest.mark.parametrize("together", [64, 0])
def test_inquiries_fold_in_order(spark, together, monkeypatch):
    rnd = random.Random(11)
    names = ["bank", "first bank", "first bank of x", "capital one", "one", "x", "of x capital", "zz", ""]
    rows = [(i, rnd.choice(["primary", "fallback", "fallback"]), f"0{rnd.randint(1, 4)}/02/2001" if rnd.random() < .95 else "", rnd.choice(names)) for i in range(150)]
    rows += [(200 + i, "fallback", "09/09/2001", f"common{i % 7}{'y' * (i % 3)}") for i in range(60)]
    monkeypatch.setattr(linkage, "NAMES_TOGETHER", together)
    monkeypatch.setattr(linkage.inquiry_targets, "__defaults__", (together,))
    df = spark.createDataFrame([("r", i, s, d, w, "p" if i % 3 else "", [i % 5, i % 7]) for i, s, d, w in rows],
                               "report_id string, inquiry_ord long, source string, inquiry_date string, subscriber string, purpose string, pages array<int>")
    target = {}
    for d in {r[2] for r in rows}:
        target |= greedy([r for r in rows if r[2] == d]) if d else {r[0]: r[0] for r in rows if r[2] == d}
    want = []
    for kept in sorted(set(target.values())):
        folded = sorted(i for i, t in target.items() if t == kept and i != kept)
        spoken = [i for i in folded if i % 3]
        chosen = spoken[0] if kept % 3 == 0 and spoken else kept
        pages = list(dict.fromkeys(p for i in [kept, *folded] for p in sorted({i % 5, i % 7}) if p > 0))
        want.append((chosen, "p" if chosen % 3 else "", len(folded), sorted(pages)))
    got = [(r.inquiry_ord, r.purpose, r.n_folded, sorted(r.pages)) for r in linkage.merge_inquiries(df).collect()]
    assert sorted(got) == sorted(want) and any(x[2] for x in want)


def test_inquiries_where_every_name_holds_one_gram(spark):
    """A day with very many names that all share their only common gram still folds into the right ones."""
    rows = [("r", i, "primary" if i < 300 else "fallback", "01/01/2001", f"{'corp' if i % 2 else 'corporation'} {i % 300:03}", "", [1]) for i in range(600)]
    df = spark.createDataFrame(rows, "report_id string, inquiry_ord long, source string, inquiry_date string, subscriber string, purpose string, pages array<int>")
    got = {r.inquiry_ord: r.n_folded for r in linkage.merge_inquiries(df).collect()}
    assert got == {i: 1 for i in range(300)}


@pytest.mark.parametrize("page_block, value_block", [(4_000_000, 20_000), (60, 3)])
def test_grounding_equals_reading_every_page(spark, monkeypatch, page_block, value_block):
    import re
    monkeypatch.setattr(grounding, "PAGE_BLOCK", page_block)
    monkeypatch.setattr(grounding, "VALUE_BLOCK", value_block)
    rnd = random.Random(2)
    words = ["First", "bank", "of", "N.A.", "$1,234.00", "OK", "30", "Jan", "1999", "xx-12", "the", "the", "é"]
    pages = [("r1" if p % 3 else "r2", p, " ".join(rnd.choices(words, k=12)) + ("" if p else "\n")) for p in range(20)] + [("r3", 1, None)]
    fields = [(r, f"components.accounts.accounts[0].{'paymentHistory[3]' if i % 4 == 0 else 'name'}", " ".join(rnd.choices(words, k=rnd.randint(1, 5)))) for i in range(60) for r in ("r1", "r2", "r4")]
    fields += [("r1", "p", None), ("r1", "p", ""), ("r1", "p", "firstbank"), ("r1", "p", "1234")]
    got = {(r.report_id, r.path, r.value): r.pages for r in grounding.grounded_fields(spark.createDataFrame(fields, "report_id string, path string, value string"),
                                                                                   spark.createDataFrame(pages, "report_id string, page int, page_text string")).collect()}

    def norm(t):
        return re.sub(r"\s+", " ", (t or "").lower()).strip()

    def plain(t):
        return re.sub("[^a-z0-9]", "", (t or "").lower())

    def held(value, page, monthly):
        spelled = {norm(value), plain(value), norm(value.replace("$", "").replace(",", "")) if "$" in value else "", norm(value.replace(",", ""))}
        spelled = {s for s in spelled if len(s) >= 4} | ({norm(value)} if monthly and len(norm(value)) >= 2 else set())
        if any(s in norm(page) or s in plain(page) for s in spelled):
            return True
        tokens = [t for t in re.findall("[a-z0-9]+", norm(value)) if monthly or len(t) >= 2]
        own = set(re.findall("[a-z0-9]+", norm(page)))
        missing = sum(t not in own for t in tokens)
        return bool(tokens) and (missing == 0 or len(tokens) >= 4 and missing == 1)

    for r, path, value in fields:
        want = [p for rr, p, t in sorted(pages, key=lambda x: x[1]) if rr == r and value is not None and held(value, t, "paymentHistory[" in path)]
        assert got[r, path, value] == want, (r, path, value)


def test_proofs_step_in_where_no_page_holds_a_value(spark):
    fields = spark.createDataFrame([("r", "a", "printed once"), ("r", "b", "nowhere at all"), ("r", "c", "nowhere else")], "report_id string, path string, value string")
    pages = spark.createDataFrame([("r", 2, "it is printed once here")], "report_id string, page int, page_text string")
    one = spark.createDataFrame([("r", "b", "Nowhere  At All", 7), ("r", "c", "another text", 8), ("r", "a", "printed once", 9)], "report_id string, path string, value string, page int")
    two = spark.createDataFrame([("r", "b", "nowhere at all", 1), ("r", "c", "nowhere else", 3), ("r", "c", "nowhere else", 2)], "report_id string, path string, value string, page int")
    got = {r.path: r.pages for r in grounding.grounded_fields(fields, pages, one, two).collect()}
    assert got == {"a": [2], "b": [7], "c": [2, 3]}


ROW = "shape string, report_id string, entity_key string, cell string, value string"


def test_digests_open_only_what_differs(spark):
    rnd = random.Random(4)
    rows = [(s, f"r{i % 9}", None if s == "count" else f"e{i % 5}", f"c{i}", rnd.choice(["a", "b", None])) for i in range(300) for s in ("count", "page", "field", "month")]
    changed = list(rows)
    want = []
    for k, i in enumerate(rnd.sample(range(len(rows)), 24)):
        s, r, e, c, v = rows[i]
        if k % 4 == 0:
            changed[i] = None
            want.append((s, r, e, c, v, None, "missing"))
        elif k % 4 == 1:
            changed.append((s, r, e, c, v))
            want.append((s, r, e, c, v, v, "repeated"))
        elif k % 4 == 2:
            changed[i] = (s, r, e, c, "other")
            want.append((s, r, e, c, v, "other", "changed"))
        else:
            changed.append((s, "new", e, c, v))
            want.append((s, "new", e, c, None, v, "unexpected"))
    expected, actual = spark.createDataFrame(rows, ROW), spark.createDataFrame([r for r in changed if r], ROW)
    assert values(regression.differences(expected, actual)) == sorted(want, key=repr)
    assert regression.differences(expected, expected.repartition(3)).count() == regression.differences(expected.limit(0), expected.limit(0)).count() == 0


def test_swapped_values_of_two_cells_are_seen(spark):
    a = spark.createDataFrame([("field", "r", "e", "x", "1"), ("field", "r", "e", "y", "2")], ROW)
    b = spark.createDataFrame([("field", "r", "e", "x", "2"), ("field", "r", "e", "y", "1")], ROW)
    assert [r.kind for r in regression.differences(a, b).collect()] == ["changed", "changed"]

