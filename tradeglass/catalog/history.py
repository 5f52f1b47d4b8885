"""Queries of the monthly-history operators."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tradeglass import vocab
from tradeglass.catalog.binding import mdy, mon
from tradeglass.catalog.oracle import omoney
from tradeglass.catalog.registry import ORACLE_VIEWS, query
from tradeglass.operators import history as h
from tradeglass.operators import packed, timing
from tradeglass.operators.history import KEY
from tradeglass.plans.account_view import account_view, with_anchors

MONTH_COLUMNS = ", ".join(
    f"max(CASE WHEN m % 12 = {i} THEN status END) AS {name.lower()}" for i, name in enumerate(vocab.MONTHS))
YEAR_ROWS = (f"SELECT report_id, entity_key, CAST(CAST(floor(m / 12.0) AS int) AS string) AS year, {MONTH_COLUMNS} "
             "FROM fx_hist GROUP BY report_id, entity_key, CAST(CAST(floor(m / 12.0) AS int) AS string)")
LONG = ["status", "balance", "paid", "scheduled", "past_due", "credit_limit", "last_payment_date", "paid_date"]
ORACLE_VIEWS["ora_long"] = " UNION ALL ".join(
    f"SELECT report_id, entity_key, '{s}' AS series, m, {s} AS v FROM fx_hist WHERE {s} IS NOT NULL" for s in LONG)
DENSE_SQL = "SELECT report_id, entity_key, m, upper(code) AS value_text FROM ora_cell"
OUT = [*KEY, "m"]


def features(b) -> DataFrame:
    anchors = with_anchors(b.tradelines(), {"opened_m", "closure_m"}).select(*KEY, "profile_id", "opened_m", "closure_m")
    return h.anchored_features(b.cells(), anchors)


def words(b) -> DataFrame:
    return packed.month_words(b.cells())


def sequence_conflicts(b) -> DataFrame:
    b.shared_history()
    anchors = with_anchors(b.tradelines(), {"opened_m"}).select(*KEY, "profile_id", "opened_m")
    return packed.conflicts(words(b), anchors)


@query("h1_year_rows_to_cells", DENSE_SQL)
def h1(b):
    return h.cells_from_year_rows(b.sql(YEAR_ROWS)).select(*OUT, "value_text")


@query("h2_flat_to_cells", DENSE_SQL)
def h2(b):
    months = ", ".join(h.MONTH_KEYS)
    flat = b.sql(YEAR_ROWS).selectExpr(*KEY, f"struct(year, array({months}) AS v) AS r").groupBy(*KEY).agg(
        {"r": "collect_list"}).selectExpr(*KEY, "sort_array(`collect_list(r)`) AS rows").selectExpr(
        *KEY, "rows.year AS years", "flatten(rows.v) AS values")
    return h.cells_from_flat(flat).select(*OUT, "value_text")


@query("h3_evidence_to_cells", """
    SELECT report_id, entity_key, m, status AS value_text, CASE WHEN status IN ('X', 'ND') THEN 'blank' ELSE 'value' END AS state,
           coalesce(gap_source, '') AS source, entity_key || ':' || CAST(m AS string) AS provenance_id FROM fx_hist""")
def h3(b):
    names = "array(" + ", ".join(f"'{m}'" for m in h.MONTH_KEYS) + ")"
    rows = b.view("fx_hist").selectExpr(
        *KEY, "cast(floor(m / 12) AS string) AS year",
        f"struct({names}[m % 12] AS k, struct(status AS value, if(status IN ('X', 'ND'), 'blank', 'value') AS state, "
        "gap_source AS source, concat(entity_key, ':', m) AS id) AS v) AS e",
    ).groupBy(*KEY, "year").agg({"e": "collect_list"}).selectExpr(
        *KEY, "year", "map_from_entries(`collect_list(e)`) AS months")
    return h.cells_from_evidence(rows).select(*OUT, "value_text", "state", "source", "provenance_id")


ENTRIES = (f"SELECT report_id, entity_key, m, CASE WHEN pay_day IS NULL THEN 'n/a' WHEN m % 2 = 0 THEN {mdy('pay_day')} "
           f"ELSE {mon('pay_day')} END AS date, coalesce(balance, '') AS balance, paid FROM fx_hist")


@query("h4_dated_entries_to_cells", f"""
    SELECT report_id, entity_key, 'balance' AS series, m, balance AS value_text FROM ({ENTRIES}) x WHERE date <> 'n/a'
    UNION ALL SELECT report_id, entity_key, 'paid', m, paid FROM ({ENTRIES}) x WHERE date <> 'n/a'""")
def h4(b):
    entries = b.sql(ENTRIES).drop("m")
    return h.cells_from_dated_entries(entries, {"balance": "balance", "paid": "paid"}).select(
        *KEY, "series", "m", "value_text")


TITLES = ("SELECT k, m, CASE m % 7 WHEN 0 THEN 'Balance' WHEN 1 THEN 'Amount Past Due:' WHEN 2 THEN 'Scheduled  Payment' "
          "WHEN 3 THEN 'Actual Payment 24 month history' WHEN 4 THEN 'Payment History' WHEN 5 THEN 'Last Payment Date' "
          "ELSE 'Narrative Codes' END AS label FROM fx_hist")


@query("h5_section_series", """SELECT k, m, ['balance', 'past_due', 'scheduled', 'paid', 'status', 'last_payment_date',
    'narrative codes'][m % 7 + 1] AS series FROM fx_hist""")
def h5(b):
    return b.sql(TITLES).selectExpr("k", "m", f"{h.label_to_series('label')} AS series")


@query("h6_cells_to_year_rows",
       "SELECT report_id, entity_key, series, CAST(floor(m / 12.0) AS int) AS year, " + ", ".join(
           f"coalesce(max(CASE WHEN m % 12 = {i} THEN v END), '-') AS {k}" for i, k in enumerate(h.MONTH_KEYS))
       + " FROM ora_long GROUP BY ALL")
def h6(b):
    return h.year_rows(b.cells().where("series <> 'gap_slot'"))


@query("h7_flat_history", """
    SELECT report_id, entity_key, series, string_agg(v, ',' ORDER BY m) AS vals,
           (SELECT string_agg(CAST(y AS string), ',' ORDER BY y) FROM (SELECT unnest(list(DISTINCT CAST(floor(m / 12.0) AS int))) AS y) z) AS years
    FROM ora_long GROUP BY report_id, entity_key, series""")
def h7(b):
    return h.flat_history(b.cells().where("series <> 'gap_slot'")).selectExpr(
        *KEY, "series", "array_join(values, ',') AS vals", "array_join(years, ',') AS years")


@query("h8_pad_flat", """
    SELECT report_id, entity_key, CAST(ceil(count(*) / 12.0) * 12 AS int) AS n,
           string_agg(status, ',' ORDER BY m) || repeat(',-', CAST(ceil(count(*) / 12.0) * 12 - count(*) AS int)) AS vals
    FROM fx_hist GROUP BY report_id, entity_key""")
def h8(b):
    flat = h.flat_history(b.cells().where("series = 'status'"))
    return flat.selectExpr(*KEY, f"{h.pad_flat('values')} AS p").selectExpr(*KEY, "size(p) AS n", "array_join(p, ',') AS vals")


@query("h9_dense_grid", DENSE_SQL)
def h9(b):
    return h.dense_grid(h.month_grid(b.cells())).where("cell").selectExpr(*OUT, "coalesce(status, '') AS value_text")


LINES = ("SELECT CAST(o.o_custkey AS string) AS report_id, CAST(o.o_custkey AS string) AS entity_key, 'quantity' AS series, "
         "CAST(year(l.l_shipdate) * 12 + month(l.l_shipdate) - 1 AS int) AS m, CAST(CAST(l.l_quantity AS int) AS string) AS value_text, "
         "l.l_orderkey * 1000000 + l.l_partkey * 10 + l.l_linenumber AS ord FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey")


@query("h10_last_duplicate_wins", f"""
    SELECT report_id, entity_key, m, value_text FROM (SELECT *, row_number() OVER (
        PARTITION BY report_id, entity_key, m ORDER BY ord DESC, value_text DESC) AS rn FROM ({LINES}) x) y WHERE rn = 1""")
def h10(b):
    lines = b.sql(LINES).selectExpr("*", "struct(ord, value_text) AS o").drop("ord").withColumnRenamed("o", "ord")
    return h.one_cell_per_month(lines).select(*OUT, "value_text")


@query("h11_history_extremes", """
    SELECT report_id, entity_key, first_m AS first_seen_m, last_m AS last_seen_m, due_text AS past_due_pos, bal_text AS balance_last,
           CAST(bal_max AS double) AS balance_max FROM ora_fact""")
def h11(b):
    names = ["first_seen_m", "last_seen_m", "past_due_pos", "balance_last", "balance_max"]
    facts = h.history_facts(features(b), set(names))
    return facts.selectExpr(*KEY, *names[:4], "cast(balance_max AS double) AS balance_max")


@query("h12_recent_current", """SELECT c.report_id, c.entity_key, c.m FROM ora_cell c JOIN ora_fact f USING (report_id, entity_key)
                                WHERE c.cur AND c.m >= f.last_m - 2""")
def h12(b):
    return h.recent_current_cells(features(b))


@query("h13_missing_months", """SELECT c.report_id, c.entity_key, c.m FROM ora_cell c JOIN ora_fact f USING (report_id, entity_key)
                                WHERE c.blank AND c.m BETWEEN f.first_m + 1 AND f.last_m - 1""")
def h13(b):
    return packed.missing_months(words(b))


@query("h14_internal_gaps", """
    SELECT report_id, entity_key, CAST(unnest(range(p + 1, m)) AS int) AS m FROM (SELECT report_id, entity_key, m,
        lag(m) OVER (PARTITION BY report_id, entity_key ORDER BY m) AS p FROM ora_cell WHERE bal_known) x WHERE m - p > 1""")
def h14(b):
    known = features(b).where(f"balance IS NOT NULL AND NOT {h.missing('balance')}").select(*OUT)
    return h.internal_gap_months(known)


@query("h15_neighbours", """
    SELECT b.report_id, b.entity_key, b.m, p.m AS older_m, n.m AS newer_m FROM (SELECT * FROM ora_cell WHERE blank) b
    ASOF LEFT JOIN (SELECT * FROM ora_cell WHERE seen) p ON p.report_id = b.report_id AND p.entity_key = b.entity_key AND p.m < b.m
    ASOF LEFT JOIN (SELECT * FROM ora_cell WHERE seen) n ON n.report_id = b.report_id AND n.entity_key = b.entity_key AND n.m > b.m""")
def h15(b):
    return packed.neighbours(words(b))


ISLANDS = """SELECT report_id, entity_key, min(m) AS first_m, max(m) AS last_m, CAST(count(*) AS int) AS n_months
    FROM (SELECT *, sum(brk) OVER (PARTITION BY report_id, entity_key ORDER BY m) AS g FROM (SELECT report_id, entity_key, m,
        CASE WHEN m - lag(m) OVER (PARTITION BY report_id, entity_key ORDER BY m) = 1 THEN 0 ELSE 1 END AS brk FROM {src}) x) y
    GROUP BY report_id, entity_key, g"""


@query("h16_blank_runs", ISLANDS.format(src="ora_cell WHERE blank"))
def h16(b):
    return packed.blank_runs(words(b))


@query("h17_opened_coverage_gap", """
    SELECT report_id, entity_key, e AS expected_m, first_m AS first_seen_m, CAST(first_m - e AS int) AS n_months FROM (
      SELECT report_id, entity_key, first_m, CAST(greatest(opened_m + 1, anchor_m - CASE WHEN student AND k % 4 = 2 THEN 119 ELSE 83 END) AS int) AS e
      FROM ora_acct WHERE opened_m IS NOT NULL) x WHERE first_m > e""")
def h17(b):
    v = account_view(b.tradelines(), b.cells(), {"expected_m", "first_seen_m"})
    return v.where("first_seen_m > expected_m").selectExpr(*KEY, "expected_m", "first_seen_m", "first_seen_m - expected_m AS n_months")


@query("h18_previous_meaningful", """
    SELECT c.report_id, c.entity_key, c.m, p.m AS prev_m, CAST(c.cell_no - coalesce(p.cell_no, 0) - 1 AS int) AS gap_len FROM ora_cell c
    ASOF LEFT JOIN (SELECT * FROM ora_cell WHERE seen) p ON p.report_id = c.report_id AND p.entity_key = c.entity_key AND p.m < c.m""")
def h18(b):
    return features(b).where("cell").selectExpr(*OUT, "prev.m AS prev_m", "gap_len")


SEQUENCES = {"h19_progression_regression": "regression", "h20_severe_jump": "severe_jump", "h21_reaging": "reaging",
             "h22_first_30": "first_30", "h23_first_severe": "first_severe", "h24_blank_gap": "blank_gap",
             "h25_backfill": "backfill", "h26_no_build_up": "no_build_up"}


def _sequence(name: str, kind: str) -> None:
    @query(name, f"SELECT report_id, entity_key, m, code, CAST(prev_m AS int) AS prev_m FROM ora_chain WHERE kind = '{kind}'")
    def run(b):
        return sequence_conflicts(b).where(f"kind = '{kind}'").select(*OUT, "code", "prev_m")


for _name, _kind in SEQUENCES.items():
    _sequence(_name, _kind)


@query("h27_payment_activity_conflicts", """
    SELECT c.report_id, c.entity_key, c.kind, c.m FROM ora_chain c JOIN ora_rule a USING (report_id, entity_key)
    WHERE c.kind <> 'regression' AND (c.act OR coalesce(c.p_act, false) OR coalesce(abs(c.m - a.lp_m) <= 2, false) OR a.recent_pos)""")
def h27(b):
    b.shared_history()
    accounts = account_view(b.tradelines(), b.cells(), {"last_payment_m", "recent_payment"}).select(
        *KEY, "last_payment_m", "recent_payment")
    return h.payment_activity_conflicts(sequence_conflicts(b), accounts).select(*KEY, "kind", "m")


@query("h28_balance_reduction_conflicts", """
    SELECT report_id, entity_key, kind, m, CAST(pb - b AS double) AS dropped FROM ora_chain WHERE kind <> 'regression' AND pb - b >= 25""")
def h28(b):
    return packed.balance_reduction_conflicts(sequence_conflicts(b), b.cells()).selectExpr(
        *KEY, "kind", "m", "cast(prev_balance - balance AS double) AS dropped")


SIGNAL_COLUMNS = {"payment_days", "reporting_days", "intervals"}


@query("h29_thirty_day_intervals", "SELECT report_id, entity_key, m, interval_days FROM ora_late30")
def h29(b):
    return timing.thirty_day_intervals(account_view(b.tradelines(), b.cells(), SIGNAL_COLUMNS))


@query("h29_signal_intervals", "SELECT report_id, entity_key, m, interval_days FROM ora_interval")
def h29_window(b):
    return timing.signal_intervals(timing.timing_signals(account_view(b.tradelines(), b.cells(), SIGNAL_COLUMNS)))


@query("h30_timing_signals", """
    SELECT DISTINCT report_id, entity_key, kind, CAST(day AS VARCHAR) AS day FROM (
      SELECT report_id, entity_key, 'payment' AS kind, pay_day AS day FROM fx_hist WHERE lay IN (1, 2) AND pay_day IS NOT NULL
      UNION ALL SELECT report_id, entity_key, 'payment', last_day FROM ora_field WHERE last_payment IS NOT NULL
      UNION ALL SELECT report_id, entity_key, 'reporting', CASE WHEN v LIKE '%/%' THEN CAST(strptime(v, '%m/%d/%Y') AS date)
                       WHEN v LIKE '%-%' THEN CAST(v AS date) END
      FROM (SELECT report_id, entity_key, unnest([e_rep, e_su, e_bu, closed]) AS v FROM ora_field) u) z WHERE day IS NOT NULL""")
def h30(b):
    return timing.timing_signals(account_view(b.tradelines(), b.cells(), SIGNAL_COLUMNS)).selectExpr(
        *KEY, "kind", "cast(d AS string) AS day")


@query("h31_closure_facts", """
    SELECT report_id, entity_key, CASE WHEN is_closed THEN clo_m END AS closure_m, CASE WHEN is_closed THEN upper(clo_code) END AS closure_status,
           CASE WHEN is_closed THEN clo_paid END AS closure_paid,
           CASE WHEN pay_rep THEN 'actual_payment_amount' WHEN last_payment IS NOT NULL THEN 'last_payment_date' ELSE '' END AS signal
    FROM ora_rule""")
def h31(b):
    v = account_view(b.tradelines(), b.cells(), {
        "is_closed", "closure_m", "closure_status", "closure_paid", "payment_reported", "stated_last_payment"})
    closed = [f"if(is_closed, {c}, NULL) AS {c}" for c in ("closure_m", "closure_status", "closure_paid")]
    return v.selectExpr(
        *KEY, *closed, f"CASE WHEN payment_reported THEN 'actual_payment_amount' WHEN NOT {h.missing('stated_last_payment')} "
        "THEN 'last_payment_date' ELSE '' END AS signal")


@query("h32_payment_without_balance_drop", """
    SELECT report_id, entity_key, m, CAST(bal - next_bal AS double) AS dropped FROM (
        SELECT *, lead(m) OVER a AS next_m, lead(bal) OVER a AS next_bal FROM ora_cell WINDOW a AS (PARTITION BY report_id, entity_key ORDER BY m)) c
    WHERE next_m = m + 1 AND paid_amt > 0 AND bal - next_bal < greatest(25, paid_amt * 0.25)""")
def h32(b):
    return h.flat_balance_months(features(b)).selectExpr(*OUT, "cast(balance - next_balance AS double) AS dropped")


COVER = {"balance": "bal", "past_due": "due", "paid": "paid", "scheduled": "sched"}


@query("h33_uncovered_derogatory", " UNION ALL ".join(
    f"SELECT report_id, entity_key, '{s}' AS series, f.cov_{o} AS cover_m, CAST(u_{o} AS int) AS n_months FROM ora_month m "
    f"JOIN ora_fact f USING (report_id, entity_key) WHERE u_{o} >= 2" for s, o in COVER.items()))
def h33(b):
    facts = h.history_facts(features(b), {"der_months", *(f"{s}_cover_m" for s in COVER)})
    rows = ", ".join(
        f"named_struct('series', '{s}', 'cover_m', {s}_cover_m, 'n_months', size(filter(der_months, x -> x < {s}_cover_m)))"
        for s in COVER)
    return facts.selectExpr(*KEY, f"inline(array({rows}))").where("n_months >= 2")


@query("h34_past_due_month_conflicts", "SELECT report_id, entity_key, m FROM ora_cell WHERE due_amt > 0 AND (blank OR cur)")
def h34(b):
    facts = h.history_facts(features(b), {"past_due_conflict_months"})
    return facts.selectExpr(*KEY, "explode(past_due_conflict_months) AS m")


@query("h35_activity_without_status", """
    SELECT report_id, entity_key, m FROM ora_cell WHERE blank AND (bal > 0 OR (paid <> '-' AND paid_amt <> 0)
    OR (lpd IS NOT NULL AND lpd <> '--'))""")
def h35(b):
    facts = h.history_facts(features(b), {"activity_conflict_months"})
    return facts.selectExpr(*KEY, "explode(activity_conflict_months) AS m")


@query("h36_printed_gap_slots", """SELECT c.report_id, c.entity_key, c.m FROM ora_cell c
    ANTI JOIN fx_hist f ON f.report_id = c.report_id AND f.entity_key = c.entity_key AND f.m = c.m""")
def h36(b):
    return h.printed_gap_slots(b.cells())


PRINTED_ROWS = "SELECT doc_id, page, line_no AS row_no, CAST(line_no * 12.0 + (line_no % 3) AS double) AS y FROM fx_line WHERE length(line) > 60"


@query("h36_interpolated_slots", f"""
    WITH s AS (SELECT *, lag(row_no) OVER w AS pn, lag(y) OVER w AS py FROM ({PRINTED_ROWS}) x WINDOW w AS (PARTITION BY doc_id, page ORDER BY row_no)),
    p AS (SELECT *, (y - py) / (row_no - pn) AS pitch FROM s WHERE pn IS NOT NULL),
    q AS (SELECT *, median(pitch) OVER (PARTITION BY doc_id, page) AS md FROM p)
    SELECT doc_id, page, CAST(r AS int) AS row_no, round(py + pitch * (r - pn), 6) AS y FROM (
      SELECT *, unnest(range(pn + 1, row_no)) AS r FROM q WHERE row_no - pn > 1 AND pitch BETWEEN 0.6 * md AND 1.4 * md) z""".replace("WITH", "SELECT * FROM (WITH", 1) + ")")
def h36_pitch(b):
    return h.interpolated_slots(b.sql(PRINTED_ROWS), ["doc_id", "page"]).selectExpr("doc_id", "page", "row_no", "round(y, 6) AS y")


@query("h37_fallback_year_rows", """
    SELECT report_id, entity_key, 'status' AS series, y AS year, CASE WHEN bool_or(paid <> '-') THEN 'paid' ELSE 'all' END AS source
    FROM (SELECT *, CAST(floor(m / 12.0) AS int) AS y FROM fx_hist) x GROUP BY report_id, entity_key, y""")
def h37(b):
    base = b.view("fx_hist").selectExpr(*KEY, "'status' AS series", "m", "status AS value_text", "0 AS ord", "paid")
    first = h.year_rows(base.where("paid <> '-'").drop("paid")).selectExpr("*", "'paid' AS source")
    rest = h.year_rows(base.drop("paid")).selectExpr("*", "'all' AS source")
    return h.fallback_year_rows(first, rest).select(*KEY, "series", "year", "source")


@query("h38_resolved_cells", f"""
    SELECT report_id, entity_key, series, max(m) AS latest_m, max_by(v, m) AS latest_value, CAST(max({omoney('v')}) AS double) AS top_amt,
           (SELECT min(z.m) FROM ora_long z WHERE z.report_id = x.report_id AND z.entity_key = x.entity_key AND z.series = x.series
            AND {omoney('z.v')} = max({omoney('x.v')})) AS top_m
    FROM ora_long x GROUP BY report_id, entity_key, series""")
def h38(b):
    return h.resolved_cells(b.cells().where("series <> 'gap_slot'")).selectExpr(
        *KEY, "series", "latest_m", "latest_value", "cast(top_amt AS double) AS top_amt", "top_m")


@query("h38_cells_by_value", """SELECT report_id, entity_key, 'credit_limit' AS series, m, credit_limit AS value_text FROM fx_hist
    WHERE CAST(replace(credit_limit, '$', '') AS int) = 7500""")
def h38_value(b):
    wanted = b.view("fx_account").selectExpr(*KEY, "'credit_limit' AS series", "'7,500.00' AS wanted")
    return h.cells_matching(b.cells(), wanted)


@query("h39_provable_slots", "SELECT report_id, entity_key, m + 1 AS m FROM fx_hist WHERE gap_source = 'projected_gap_slot'")
def h39(b):
    return h.provable_slots(b.cells()).where("series = 'gap_slot'").select(*OUT)


@query("h40_carry_header", """
    SELECT report_id, entity_key, CAST(CAST(floor(m / 12.0) AS int) * 2 + 1 AS int) AS row_no, CAST(CAST(floor(m / 12.0) AS int) AS string) AS row_label,
           ['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][m % 12 + 1] AS month_label, status AS value_text FROM fx_hist""")
def h40(b):
    header = "array(" + ", ".join(f"'{m}'" for m in vocab.MONTHS) + ")"
    rows = b.sql(YEAR_ROWS).selectExpr(
        *KEY, f"inline(array(named_struct('row_no', cast(year AS int) * 2, 'header', {header}, 'cells', cast(NULL AS array<string>), 'label', year), "
        f"named_struct('row_no', cast(year AS int) * 2 + 1, 'header', cast(NULL AS array<string>), 'cells', array({', '.join(h.MONTH_KEYS)}), "
        "'label', cast(NULL AS string))))")
    return h.carry_header(rows, KEY, "row_no")


LEGEND = {c: i for i, c in enumerate(vocab.STATUS_LEGEND)}


@query("h41_legend_codes", f"""
    SELECT report_id, entity_key, string_agg(status, ',' ORDER BY list_position({list(LEGEND)}, status)) AS codes
    FROM (SELECT DISTINCT report_id, entity_key, status FROM fx_hist WHERE status IN ({', '.join(repr(c) for c in LEGEND)})) x
    GROUP BY report_id, entity_key""")
def h41(b):
    return h.legend_codes(b.cells()).selectExpr(*KEY, "array_join(codes, ',') AS codes")


