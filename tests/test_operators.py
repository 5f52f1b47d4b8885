"""Operators against brute force on small or skewed fixtures."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tradeglass.catalog import QUERIES
from tradeglass.functions import codes, dates, text
from tradeglass.operators import grounding
from tradeglass.operators import history as h
from tradeglass.operators import layout, linkage, quality
from tradeglass.operators.skew import contains_join, grouped_rank, salted_join
from tradeglass.sources import payloads
from tradeglass.streaming import incremental


def values(df):
    return sorted(tuple(r) for r in df.collect())


def test_contains_join_equals_brute_force(spark):
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 9))) for _ in range(120)]
    # one key holds a third of all rows
    needles = [(1 if i % 3 == 0 else i % 7, w) for i, w in enumerate(words)]
    hays = [(1 if i % 3 == 0 else i % 7, w + words[-i]) for i, w in enumerate(words)]
    got = values(contains_join(spark.createDataFrame(needles, "k int, n string"), spark.createDataFrame(hays, "k int, h string"), ["k"], "n", "h"))
    want = sorted({(a, n, x) for (a, n), (b, x) in itertools.product(needles, hays) if a == b and n in x})
    assert got == want


def test_grouped_rank_numbers_a_hot_group(spark):
    rows = [("hot" if i % 3 else f"g{i % 5}", (i * 37) % 1000, i) for i in range(600)]
    got = grouped_rank(spark.createDataFrame(rows, "g string, a int, b int"), ["g"], ["a", "b"], partitions=6)
    seen = {(r.g, r.a, r.b): r["rank"] for r in got.collect()}
    for g in {r[0] for r in rows}:
        ordered = sorted((a, b) for x, a, b in rows if x == g)
        assert [seen[(g, a, b)] for a, b in ordered] == list(range(1, len(ordered) + 1))


def test_grouped_rank_computes_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(0, 300, numPartitions=4).selectExpr("if(id % 50 = 0, NULL, id % 3) AS g", "id AS a").mapInArrow(count, "g long, a long")
    got = {(r.g, r.a): r["rank"] for r in grouped_rank(rows, ["g"], ["a"], partitions=5).collect()}
    for g in (None, 0, 1, 2):
        assert [got[k] for k in sorted(k for k in got if k[0] == g)] == list(range(1, 1 + sum(k[0] == g for k in got)))
    assert seen.value == 300


def test_salted_join_keeps_every_row_of_a_hot_key(spark):
    big = spark.createDataFrame([("hot" if i % 3 else f"g{i}", i) for i in range(300)], "k string, i int")
    small = spark.createDataFrame([("hot", 1), ("g0", 2)], "k string, v int")
    assert values(salted_join(big, small, ["k"], "i")) == values(big.join(small, ["k"], "left"))


def test_box_clusters_equal_connected_components(spark):
    rnd = random.Random(3)
    boxes = [(1, 1 + i % 2, i, float(rnd.randint(0, 600)), float(rnd.randint(0, 700)), 40.0, 10.0) for i in range(80)]
    df = spark.createDataFrame(boxes, "doc_id int, page int, box_id int, x double, y double, width double, height double")
    got = {r.box_id: r.cluster_id for r in layout.box_clusters(df, 36.0, 26.0).collect()}

    def close(a, b):
        return a[1] == b[1] and not (a[3] + 76 < b[3] or b[3] + 76 < a[3] or a[4] + 36 < b[4] or b[4] + 36 < a[4])

    label = {b[2]: b[2] for b in boxes}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(boxes, 2):
            if close(a, b) and label[a[2]] != label[b[2]]:
                label[a[2]] = label[b[2]] = min(label[a[2]], label[b[2]])
                changed = True
    assert got == label


def test_phrase_search_joins_boxes_not_words(spark):
    words = spark.createDataFrame([(1, 1, 1, i + 1, t, 40.0 * i, 12.0 + i % 2, 10.0 * (i + 1), 10.0) for i, t in enumerate(["to", "be", "or", "to", "be", "tobe"])],
                                  "doc_id long, page int, line_no int, word_no int, token string, x double, y double, width double, height double")
    found = layout.phrase_matches(words, spark.createDataFrame([(1, "a", ["to", "be"])], "doc_id long, anchor_id string, tokens array<string>"))
    assert values(found.select("page", "anchor_id", "line_no", "x", "y", "width", "height", "position")) == [
        (1, "a", 1, 0.0, 12.0, 60.0, 11.0, 1), (1, "a", 1, 120.0, 12.0, 90.0, 11.0, 2), (1, "a", 1, 200.0, 13.0, 60.0, 10.0, 3)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    joined = plan[plan.index("Join Inner"):]
    assert "phrase" in joined and "[0].line_no" not in plan[:plan.index("Join Inner")]


def test_written_findings_share_their_history():
    class Bound:
        shared = False

        def shared_history(self):
            self.shared = True

        def tradelines(self):
            raise LookupError(self.shared)

    with pytest.raises(LookupError, match="True"):
        QUERIES["s8_written_findings"](Bound())


def test_value_grounding_finds_spellings_and_tokens(spark):
    pages = spark.createDataFrame([("r", 1, "Balance $1,250.00 on Mar 5, 2020"), ("r", 2, "ACME Bank of the West, account open"), ("s", 1, "acme")],
                                  "report_id string, page int, page_text string")
    fields = spark.createDataFrame([("r", "1250.00"), ("r", "West the Bank ACME"), ("r", "acme bank west west north of"), ("s", "ACME"), ("s", "1250.00")],
                                   "report_id string, value string")
    got = {(r.report_id, r.value): r.page for r in grounding.locate(fields.withColumn("monthly", F.lit(False)), pages).collect()}
    assert got == {("r", "1250.00"): 1, ("r", "West the Bank ACME"): 2, ("r", "acme bank west west north of"): 2, ("s", "ACME"): 1}


def test_dates_keep_full_dates_and_pivot_years(spark):
    cases = {"01/02/2022": "2022-01-02", "03/28/69": "2069-03-28", "03/28/70": "1970-03-28", "Mar 2021": "2021-03-01", "Jan 5, 2023": "2023-01-05",
             "05/2010": "2010-05-01", "13/40/2020": None, "Foo 2020": None, "not reported": None, "2020-02-29": "2020-02-29"}
    df = spark.createDataFrame([(k,) for k in cases], "t string").selectExpr("t", f"cast({dates.parse_date('t')} AS string) AS d")
    assert {r.t: r.d for r in df.collect()} == cases


def test_blank_states_stay_apart(spark):
    df = spark.createDataFrame([("",), ("Not reported:",), ("$0",), (None,)], "t string")
    assert [r.s for r in df.selectExpr(f"{text.cell_state('t')} AS s").collect()] == ["blank", "explicit_not_reported", "value", "blank"]


def test_glyph_tokens(spark):
    df = spark.createDataFrame([("✓ 30",), ("",), ("— x",), ("?",)], "t string")
    assert [r.v for r in df.selectExpr(f"{codes.grid_tokens('t')} AS v").collect()] == [["OK", "30"], ["OK"], ["X", "X"], []]


def test_merge_protects_proven_blanks(spark):
    rows = [("r", "a", 1, "", "blank"), ("r", "a", 2, "$5", "value"), ("r", "b", 1, "", "value"), ("r", "b", 2, "$7", "value"), ("r", "c", 1, None, None), ("r", "c", 2, "x", "value")]
    df = spark.createDataFrame(rows, "report_id string, name string, ord int, balance string, balance_state string")
    got = {r.name: r.balance for r in linkage.merge_records(df, ["report_id", "name"], ["balance"]).collect()}
    assert got == {"a": "", "b": "$7", "c": "x"}


def test_copied_cells_change_nothing(spark):
    cells = [("r", "e", "status", 2023 * 12 + i, v, "", "", 0) for i, v in enumerate(["OK", "60", "", "30"])]
    schema = "report_id string, entity_key string, series string, m int, value_text string, state string, source string, ord int"
    once = h.month_features(h.dense_grid(h.month_grid(spark.createDataFrame(cells, schema))))
    many = h.month_features(h.dense_grid(h.month_grid(spark.createDataFrame(cells * 50, schema))))
    columns = ["m", "code", "gap_len", "severe", "rank"]
    assert values(once.select(*columns)) == values(many.select(*columns))
    assert once.count() == 12


def test_account_windows_share_one_exchange(spark):
    schema = "report_id string, entity_key string, series string, m int, value_text string, state string, source string, ord int"
    cells = spark.createDataFrame([("r", "e", "status", 24000, "OK", "", "", 0)], schema)
    anchors = spark.createDataFrame([("r", "e", "equifax_old_v1", 1, 2)], "report_id string, entity_key string, profile_id string, opened_m int, closure_m int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        facts = h.account_facts(cells, anchors)
        plan = facts._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # months first (map-side combined), then one account shuffle for all windows, the anchors' side, and no more
    assert plan.count("Exchange hashpartitioning") == 3


def test_latest_versions_and_sinks(spark, tmp_path):
    lines = ['{"profile":"p","fileName":"f","sourceFile":"s","pageImages":["1"],"version":"2024-01-0%dT00:00:00Z","result":{"reportId":"r%d","profile":"p%d"}}' % (i, i, i % 2) for i in (1, 2, 3)]
    lines.append('{"profile":"p","fileName":"f","sourceFile":"","pageImages":["1"],"version":"2024-02-01T00:00:00Z","result":{"reportId":"late","profile":"p1"}}')
    path = tmp_path / "in.json"
    path.write_text("\n".join(lines))
    latest = payloads.latest_versions(payloads.read_results(spark, str(path)))
    assert values(latest.selectExpr("profile_id", "result.reportId")) == [("p0", "r2"), ("p1", "r3")]
    out = str(tmp_path / "out")
    payloads.write_by_layout(latest.select("profile_id", "file_name"), out)
    assert spark.read.parquet(out).count() == 2
    payloads.write_by_layout(latest.select("profile_id", "file_name"), out + "-json", "json")
    assert spark.read.json(out + "-json").count() == 2


def test_stream_reruns_changed_reports_only(spark, tmp_path):
    src, seen = tmp_path / "src", []
    schema = "report_id string, version int, body string"

    def arrive(n, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src / f"d{n}"))

    def run(batch, _):
        seen.append(values(batch.select("report_id", "version")))

    def drain():
        stream = spark.readStream.schema(schema).parquet(str(src / "*"))
        q = incremental.run_changed(stream, run, ["report_id"], "version", str(tmp_path / "cp"))
        q.awaitTermination(120)

    arrive(1, [("a", 1, "x"), ("a", 2, "y"), ("b", 5, "z")])
    drain()
    arrive(2, [("a", 1, "late"), ("b", 6, "new"), ("c", 1, "first")])
    drain()
    assert seen == [[("a", 2), ("b", 5)], [("b", 6), ("c", 1)]]


def test_fifty_batches_keep_their_cost_and_replays_change_nothing(spark, tmp_path):
    src, seen, failed = tmp_path / "src", {}, []
    schema = "report_id string, version int, path string"
    for n in range(50):  # each file has three new keys, one newer and one older version of known keys
        rows = [(f"r{n}-{k}", 5, f"f{n}") for k in range(3)] + [(f"r{n // 2}-0", 100 + n, "newer"), (f"r{n // 3}-1", 1, "late")]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src / "all"))

    def run(batch, batch_id):
        got = values(batch.select("report_id", "version"))
        if batch_id == 20 and not failed:
            failed.append(got)
            raise RuntimeError("lost")
        seen[batch_id] = got

    def drain():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src / "all"))
        q = incremental.run_changed(stream, run, ["report_id"], "version", str(tmp_path / "cp"))
        try:
            q.awaitTermination(300)
        except Exception:
            assert failed
        return q.recentProgress

    first, second = drain(), drain()
    assert failed and failed[0] == seen[20] and sorted(seen) == list(range(50))
    steps = [p for p in [*first, *second] if p.numInputRows]
    assert {p.numInputRows for p in steps} == {5} and max(p.stateOperators[0].numRowsUpdated for p in steps) <= 5
    newest = {}
    for got in seen.values():
        for report, version in got:
            assert version > newest.get(report, 0)
            newest[report] = version
    assert len(newest) == 150 and sum(v >= 100 for v in newest.values()) == 25


def test_stream_session_windows_close(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:05:00"), (2, "2024-01-01 05:00:00")]
    spark.createDataFrame(rows, "user_id int, ts string").selectExpr("user_id", "cast(ts AS timestamp) AS ts").coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("user_id int, ts timestamp").parquet(str(tmp_path / "e"))
    q = incremental.idle_windows(stream, "30 minutes", "10 minutes").writeStream.format("memory").queryName("idle").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert values(spark.table("idle").select("user_id", "n_events")) == [(1, 2)]


@pytest.mark.parametrize("n, letters", [(1, "A"), (26, "Z"), (27, "AA"), (702, "ZZ"), (703, "AAA"), (18278, "ZZZ"), (18279, "AAAA"), (475254, "ZZZZ"), (475255, "AAAAA")])
def test_exhibit_letters(spark, n, letters):
    assert spark.range(1).selectExpr(f"{text.exhibit_label(str(n), 'letter')} AS v").first().v == letters
