"""Monthly history: from printed rows to one dense month grid per account, and its features.

Scale notes. Cells are first reduced to one row per (report, account, month) with
a map-side combine, so however often an account's cells are copied, what reaches
the account-level shuffle is bounded by the months of a four-digit year axis.
Everything after that shuffle (densifying, windows, per-account facts) keeps the
same hash partitioning on (report_id, entity_key).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradeglass import vocab
from tradeglass.functions import codes, dates
from tradeglass.functions.money import amount, amount_max, values_equal
from tradeglass.functions.text import add, add_needed, lookup, names_in, match_text, missing, norm_text, one_of, rx

KEY = ["report_id", "entity_key"]
ACCOUNT = ", ".join(KEY)
MONEY_SERIES = ["balance", "paid", "scheduled", "past_due", "credit_limit", "high_credit"]
SERIES = ["status", *MONEY_SERIES, "last_payment_date", "gap_slot"]
PAY_DAY_SERIES = ["last_payment_date", "paid_date"]
MONTH_KEYS = [m.lower() for m in vocab.MONTHS]


# --- reshaping -----------------------------------------------------------------


def month_of(year: str, month: str) -> str:
    """m for a printed four-digit year and a 0-based month; null for other year texts."""
    y = norm_text(year)
    return f"cast(if({y} RLIKE {rx('^\\d{4}$')}, cast({y} AS int), NULL) * 12 + {month} AS int)"


def cells_from_year_rows(rows: DataFrame) -> DataFrame:
    """Wide year rows (year, jan..dec) to twelve cells each; blanks are kept as cells."""
    values = ", ".join(norm_text(k) for k in MONTH_KEYS)
    keep = [c for c in rows.columns if c not in {"year", *MONTH_KEYS}]
    out = rows.selectExpr(*keep, "year", f"posexplode(array({values})) AS (pos, value_text)")
    return add(out, {"m": month_of("year", "pos")}).where("m IS NOT NULL").drop("pos", "year")


def cells_from_flat(df: DataFrame, years: str = "years", values: str = "values") -> DataFrame:
    """Flat value array + year array: value i belongs to years[i div 12], month i mod 12."""
    keep = [c for c in df.columns if c not in {years, values}]
    slots = f"flatten(transform({years}, y -> transform(sequence(0, 11), k -> named_struct('y', y, 'k', k))))"
    out = df.selectExpr(*keep, values, f"posexplode({slots}) AS (pos, slot)")
    return out.selectExpr(*keep, f"{month_of('slot.y', 'slot.k')} AS m",
                          f"{norm_text(f'get({values}, pos)')} AS value_text").where("m IS NOT NULL")


def cells_from_evidence(df: DataFrame) -> DataFrame:
    """Nested evidence rows (year, months map<string, struct<value,state,source,id>>) to cells."""
    keep = [c for c in df.columns if c not in {"year", "months"}]
    numbers = {k: i for i, k in enumerate(MONTH_KEYS)}
    out = df.selectExpr(*keep, "year", "explode(months) AS (month, cell)")
    return out.selectExpr(
        *keep, f"{month_of('year', lookup('month', numbers))} AS m", f"{norm_text('cell.value')} AS value_text",
        f"{norm_text('cell.state')} AS state", f"{norm_text('cell.source')} AS source",
        f"{norm_text('cell.id')} AS provenance_id",
    ).where("m IS NOT NULL")


def cells_from_dated_entries(entries: DataFrame, series: dict[str, str]) -> DataFrame:
    """Dated entries to cells, one output series per value column (series: column -> name)."""
    pairs = ", ".join(f"named_struct('series', '{name}', 'v', {norm_text(column)})" for column, name in series.items())
    m = dates.month_index(dates.parse_date("date"))
    return entries.selectExpr(*KEY, f"{m} AS m", f"explode(array({pairs})) AS p").where("m IS NOT NULL") \
        .selectExpr(*KEY, "p.series AS series", "m", "p.v AS value_text")


def label_to_series(label: str) -> str:
    """Printed table title to a series name; unknown titles stay in match form."""
    text = match_text(label)
    bare = f"trim(regexp_replace({text}, {rx('(?: 24 month)? history$|:$')}, ''))"
    return f"coalesce({lookup(text, vocab.TABLE_TITLES)}, {lookup(bare, vocab.TABLE_TITLES)}, {bare})"


def one_cell_per_month(cells: DataFrame) -> DataFrame:
    """Last duplicate wins: one value per (account, series, month), combined map-side."""
    return cells.groupBy(*KEY, "series", "m").agg(F.expr("max_by(value_text, ord) AS value_text"))


def year_rows(cells: DataFrame, fill: str = "-") -> DataFrame:
    """Cells to wide year rows, one per (account, series, year), missing months filled."""
    months = [F.expr(f"coalesce(max_by(value_text, if(m % 12 = {k}, ord, NULL)), '{fill}') AS {name}")
              for k, name in enumerate(MONTH_KEYS)]
    return add(cells, {"year": "cast(floor(m / 12) AS int)"}).groupBy(*KEY, "series", "year").agg(*months)


def flat_history(cells: DataFrame) -> DataFrame:
    """Cells to an ordered value array and its years (bounded by the months of an account)."""
    ordered = F.expr("sort_array(collect_list(struct(m, value_text))) AS cells")
    return one_cell_per_month(cells).groupBy(*KEY, "series").agg(ordered).selectExpr(
        *KEY, "series", "cells.value_text AS values",
        "array_distinct(transform(cells.m, x -> cast(floor(x / 12) AS int))) AS years")


def pad_flat(values: str) -> str:
    """Pad a flat history to a multiple of twelve; an empty one becomes 36 blanks."""
    pad = f"if(size({values}) = 0, 36, (12 - size({values}) % 12) % 12)"
    return f"concat({values}, array_repeat('-', {pad}))"


def carry_header(rows: DataFrame, table: list[str], order: str) -> DataFrame:
    """Give each value row of a printed table the month header above it and the label on the row before.

    rows: header array<string> or null, cells array<string> or null, label string or
    null. A table is bounded by a printed page.
    """
    w = Window.partitionBy(*table).orderBy(order)
    above = w.rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumns({
            "months": F.last("header", ignorenulls=True).over(above),
            "row_label": F.coalesce(F.col("label"), F.lag("label").over(w)),
        })
        .where("cells IS NOT NULL AND months IS NOT NULL")
        .selectExpr(*table, order, "row_label", "explode(arrays_zip(months, cells)) AS c")
        .selectExpr(*table, order, "row_label", "c.months AS month_label", "c.cells AS value_text")
        .where("month_label IS NOT NULL AND value_text IS NOT NULL")
    )


def fallback_year_rows(rows: DataFrame, fallback: DataFrame) -> DataFrame:
    """Add fallback year rows only for years the first source does not print."""
    key = [*KEY, "series", "year"]
    return rows.unionByName(fallback.join(rows.select(*key).distinct(), key, "left_anti"))


# --- the month grid --------------------------------------------------------------


def provable_slots(cells: DataFrame) -> DataFrame:
    """Of the gap slots keep only projected missing ones; every other series passes."""
    return cells.where(
        "series <> 'gap_slot' OR (state = 'missing_slot' AND source = 'projected_gap_slot')")


def month_grid(cells: DataFrame, series: list[str] = SERIES) -> DataFrame:
    """One row per (account, month) with a text column per series; last duplicate wins.

    value_text is normalised text, as every conforming step writes it. pay_days holds
    the distinct days of dated payments printed for the month.
    """
    picks = [F.expr(f"max_by(value_text, if(series = '{s}', ord, NULL)) AS {s}") for s in series]
    dated = f"if({one_of('series', PAY_DAY_SERIES)}, value_text, NULL)"
    days = F.expr(f"collect_set(unix_date({dates.read_day(dated)})) AS pay_days")
    return cells.groupBy(*KEY, "m").agg(*picks, days)


def dense_grid(grid: DataFrame) -> DataFrame:
    """Every month of every printed status year becomes a row; nothing between printed years.

    cell is true where the account has a status cell (printed or filled blank). All
    windows partition by account alone, so they ask for the one shuffle that every later
    step of the account keeps.
    """
    w = f"(PARTITION BY {ACCOUNT} ORDER BY year, m)"
    same_year = f"(PARTITION BY {ACCOUNT} ORDER BY year RANGE BETWEEN CURRENT ROW AND CURRENT ROW)"
    d = add(grid, {"year": "cast(floor(m / 12) AS int)"})
    d = add(d, {"lag_m": f"lag(m) OVER {w}", "lead_m": f"lead(m) OVER {w}"})
    d = add(d, {
        "cell": f"max(status IS NOT NULL) OVER {same_year}",
        "m_before": "if(floor(lag_m / 12) = year, lag_m, NULL)",
        "m_after": "if(floor(lead_m / 12) = year, lead_m, NULL)",
    })
    slots = ("explode(if(cell, sequence(coalesce(m_before + 1, year * 12), "
             "if(m_after IS NULL, year * 12 + 11, m)), array(m))) AS slot")
    own = [f"if(slot = m, {s}, NULL) AS {s}" for s in grid.columns if s not in {*KEY, "m"}]
    return d.selectExpr("*", slots).selectExpr(*KEY, "year", "slot AS m", "cell", *own)


def printed_grid(grid: DataFrame) -> DataFrame:
    """The grid's own rows, marked with what the dense grid would say of them; no month without a row becomes one.

    A month that only the dense grid holds is blank and carries nothing else, so printed years tell it: opens_year is true
    once for each year that prints a status, n_years counts those up to the row's own.
    """
    same_year = f"(PARTITION BY {ACCOUNT} ORDER BY year RANGE BETWEEN CURRENT ROW AND CURRENT ROW)"
    w = f"PARTITION BY {ACCOUNT} ORDER BY year, m"
    d = add(grid, {"year": "cast(floor(m / 12) AS int)"})
    d = add(d, {"cell": f"max(status IS NOT NULL) OVER {same_year}", "lag_year": f"lag(year) OVER ({w})"})
    own = [f"if(m IS NULL, NULL, {s}) AS {s}" for s in grid.columns if s not in {*KEY, "m"}]  # as in the dense grid, a row without a month only names its account
    d = d.where("NOT (cell AND m IS NULL)").selectExpr(*KEY, "year", "m", "cell", *own, "cell AND NOT (lag_year <=> year) AS opens_year")
    return add(d, {"n_years": f"sum(cast(opens_year AS int)) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"})


def printed_features(grid: DataFrame) -> DataFrame:
    """month_features of the grid's own rows: equal to those of the dense grid, but that the next row may be months away."""
    return _features(printed_grid(grid), "12 * n_years + if(cell, m - 12 * year - 11, 0)")


def month_features(dense: DataFrame) -> DataFrame:
    """Row features of the dense grid, all from windows over one (account; year, m) ordering."""
    return _features(dense, f"sum(cast(cell AS int)) OVER (PARTITION BY {ACCOUNT} ORDER BY year, m ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")


def _features(rows: DataFrame, cell_no: str) -> DataFrame:
    """Row features; cell_no counts the cells of the dense grid up to a row."""
    def test(sql: str) -> str:
        return f"(cell AND coalesce({sql}, false))"

    d = add(rows, {f"{s}_amt": amount(s) for s in MONEY_SERIES})
    d = add(d, {"code": f"if(cell, {codes.conformed_code("coalesce(status, '')")}, NULL)"})
    d = add(d, {
        "blank": test(codes.is_blank("code")),
        "seen": test(f"NOT {codes.is_blank('code')}"),
        "cur": test(codes.is_current("code")),
        "der": test(codes.is_derogatory("code")),
        "severe": test(codes.is_severe("code")),
        "co": test(codes.is_charge_off("code")),
        "rank": codes.severity_rank("code"),
        "provable": "gap_slot IS NOT NULL",
        "active": f"(coalesce(paid_amt > 0, false) OR coalesce(scheduled_amt > 0, false) "
                  f"OR NOT {missing('last_payment_date')})",
    })
    w = f"PARTITION BY {ACCOUNT} ORDER BY year, m"
    upto = f"({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    prior = f"({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    d = add(d, {
        "cell_no": cell_no,
        "provable_no": f"sum(cast(blank AND provable AS int)) OVER {upto}",
    })
    link = "struct(m, code, rank, cell_no, provable_no, balance_amt, active)"
    d = add(d, {
        "prev": f"last(if(seen, {link}, NULL), true) OVER {prior}",
        "prev_der": f"last(if(der, struct(m, rank), NULL), true) OVER {prior}",
        "prev_cur": f"last(if(cur, struct(m, balance_amt, active), NULL), true) OVER {prior}",
        "top_rank": f"coalesce(max(if(der, rank, NULL)) OVER {prior}, 0)",
        "next_m": f"lead(m) OVER ({w})",
        "next_balance": f"lead(balance_amt) OVER ({w})",
    })
    return add(d, {
        "gap_len": "cast(cell_no - coalesce(prev.cell_no, 0) - 1 AS int)",
        "gap_provable": "provable_no - coalesce(prev.provable_no, 0)",
    })


# --- sequence conflicts ------------------------------------------------------------

# Row tests over month_features. first_30 and first_severe still need the account
# opened at least one month earlier.
_FROM_CURRENT = codes.is_current("prev.code")
CONFLICTS = {
    "regression": "der AND prev_der IS NOT NULL AND (prev_cur IS NULL OR prev_cur.m < prev_der.m) "
                  "AND rank > 0 AND rank < prev_der.rank",
    "severe_jump": f"severe AND prev IS NOT NULL AND ({_FROM_CURRENT} "
                   "OR (prev.rank > 0 AND rank > prev.rank + 1))",
    "reaging": "severe AND prev_cur.m > prev_der.m",
    "first_30": "code = '30' AND prev IS NULL",
    "first_severe": "severe AND prev IS NULL",
    "blank_gap": "der AND prev IS NOT NULL AND gap_len BETWEEN 1 AND 2",
    "backfill": "severe AND prev IS NOT NULL AND gap_len >= 3",
    "no_build_up": f"co AND (prev IS NULL OR {_FROM_CURRENT} OR top_rank < 4)",
}


def conflict_tests() -> dict[str, str]:
    """CONFLICTS as they count for an account: over features with profile_id and opened_m."""
    tests = {k: f"coalesce({v}, false)" for k, v in CONFLICTS.items()}
    for kind in ("first_30", "first_severe"):
        tests[kind] = f"({tests[kind]} AND coalesce(m - opened_m >= 1, false))"
    tests["backfill"] = (f"({tests['backfill']} AND (coalesce(profile_id, '') <> 'experian_acr_v1' "
                         "OR gap_provable >= gap_len))")
    return tests


def conflicts(features: DataFrame) -> DataFrame:
    """Long conflict table, one pass over features that carry profile_id and opened_m.

    prev_* describe the earlier cell the conflict is measured against, if any.
    """
    source = {"regression": "NULL", "first_30": "NULL", "first_severe": "NULL", "reaging": "prev_cur"}
    month = {"regression": "prev_der.m"}
    kinds = []
    for kind, test in conflict_tests().items():
        link = source.get(kind, "prev")
        parts = {"m": "NULL", "balance_amt": "NULL", "active": "NULL"} if link == "NULL" else {
            x: f"{link}.{x}" for x in ("m", "balance_amt", "active")}
        kinds.append(
            f"if({test}, named_struct('kind', '{kind}', 'prev_m', cast({month.get(kind, parts['m'])} AS int), "
            f"'prev_balance', cast({parts['balance_amt']} AS decimal(18,2)), "
            f"'prev_active', cast({parts['active']} AS boolean)), NULL)")
    return features.selectExpr(*KEY, "m", "code", "gap_len", "balance_amt AS balance", "active",
                               f"explode(array_compact(array({', '.join(kinds)}))) AS k") \
        .selectExpr(*KEY, "k.kind AS kind", "m", "code", "k.prev_m AS prev_m", "gap_len", "balance", "active",
                    "k.prev_balance AS prev_balance", "k.prev_active AS prev_active")


def payment_activity_conflicts(found: DataFrame, accounts: DataFrame) -> DataFrame:
    """Conflicts other than regression that payment activity contradicts.

    accounts carries last_payment_m and recent_payment per account; activity counts in
    the conflict month, in the month it is measured against, within two months of the
    last payment, or as a positive recent payment.
    """
    joined = found.where("kind <> 'regression'").join(accounts, KEY)
    return joined.where(
        "active OR coalesce(prev_active, false) OR coalesce(abs(m - last_payment_m) <= 2, false) "
        f"OR coalesce({amount('recent_payment')} > 0, false)").select(*found.columns)


def balance_reduction_conflicts(found: DataFrame) -> DataFrame:
    """Conflicts other than regression over which the balance fell by 25 or more."""
    return found.where("kind <> 'regression' AND prev_balance - balance >= 25")


# --- months picked out of the features -------------------------------------------------


def _range(features: DataFrame) -> DataFrame:
    whole = Window.partitionBy(*KEY).orderBy("year", "m").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    return features.withColumns({
        "first_seen": F.min(F.expr("if(seen, m, NULL)")).over(whole),
        "last_seen": F.max(F.expr("if(seen, m, NULL)")).over(whole),
    })


def recent_current_cells(features: DataFrame, months: int = 2) -> DataFrame:
    """Current cells at most that many months before the latest meaningful one."""
    return _range(features).where(f"cur AND m >= last_seen - {months}").select(*KEY, "m")


def missing_months(features: DataFrame) -> DataFrame:
    """Blank cells strictly inside the meaningful range."""
    return _range(features).where("blank AND m > first_seen AND m < last_seen").select(*KEY, "m")


def internal_gap_months(months: DataFrame) -> DataFrame:
    """Months without a cell between consecutive meaningful ones; months is one row per (account, m)."""
    w = Window.partitionBy(*KEY).orderBy("m")
    gaps = months.withColumn("before", F.lag("m").over(w)).where("m - before > 1")
    return gaps.selectExpr(*KEY, "explode(sequence(before + 1, m - 1)) AS m")


def neighbours(features: DataFrame) -> DataFrame:
    """Nearest meaningful months before and after every blank cell."""
    w = Window.partitionBy(*KEY).orderBy("year", "m")
    seen = F.expr("if(seen, m, NULL)")
    both = features.withColumns({
        "older_m": F.last(seen, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        "newer_m": F.first(seen, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)),
    })
    return both.where("blank").select(*KEY, "m", "older_m", "newer_m")


def flat_balance_months(features: DataFrame) -> DataFrame:
    """Months paid whose next month's balance dropped by less than max(25, 25% of the payment)."""
    return features.where(
        "paid_amt > 0 AND next_m = m + 1 AND balance_amt - next_balance < greatest(25, paid_amt * 0.25)"
    ).selectExpr(*KEY, "m", "paid_amt AS paid", "balance_amt AS balance", "next_balance")


def printed_gap_slots(cells: DataFrame, series: str = "status") -> DataFrame:
    """Months of a printed year that have no cell."""
    grid = month_grid(cells.where(F.col("series") == series))
    return dense_grid(grid).where("cell AND status IS NULL").select(*KEY, "m")


def interpolated_slots(rows: DataFrame, page: list[str]) -> DataFrame:
    """Positions of rows missing between two measured rows of a page.

    rows carry y per measured row. The pitch of an adjacent pair is its distance
    divided by the row count it should hold; a pair is filled only when that pitch is
    within 0.6 to 1.4 of the page median. Windows are bounded by a printed page.
    """
    w = Window.partitionBy(*page).orderBy("row_no")
    pairs = rows.withColumns({"prev_no": F.lag("row_no").over(w), "prev_y": F.lag("y").over(w)}).where(
        "prev_no IS NOT NULL")
    steps = add(pairs, {"pitch": "(y - prev_y) / (row_no - prev_no)"})
    steps = steps.withColumn("median", F.expr("percentile(pitch, 0.5)").over(Window.partitionBy(*page)))
    return steps.where("row_no - prev_no > 1 AND pitch BETWEEN 0.6 * median AND 1.4 * median").selectExpr(
        *page, "explode(sequence(prev_no + 1, row_no - 1)) AS row_no", "prev_no", "prev_y", "pitch",
    ).selectExpr(*page, "row_no", "prev_y + pitch * (row_no - prev_no) AS y")


def resolved_cells(cells: DataFrame) -> DataFrame:
    """Latest and largest cell per (account, series); ties of the largest go to the earliest month."""
    c = add(one_cell_per_month(cells), {"amt": amount("value_text")})
    return c.groupBy(*KEY, "series").agg(
        F.expr("max(m) AS latest_m"), F.expr("max_by(value_text, m) AS latest_value"),
        F.expr("max_by(m, if(amt IS NULL, NULL, struct(amt, -m))) AS top_m"), F.expr("max(amt) AS top_amt"))


def cells_matching(cells: DataFrame, requests: DataFrame) -> DataFrame:
    """Cells of an account whose value equals a requested value in any spelling."""
    pairs = cells.join(requests, [*KEY, "series"])
    return pairs.where(values_equal("value_text", "wanted")).select(*KEY, "series", "m", "value_text")


def cells_at_month(cells: DataFrame, requests: DataFrame) -> DataFrame:
    """Cells of the asked months (asked_m); an asked value that is not empty must equal the cell's in some spelling."""
    pairs = one_cell_per_month(cells).join(requests.withColumnRenamed("asked_m", "m"), [*KEY, "series", "m"])
    return pairs.where(f"{norm_text('wanted')} = '' OR {values_equal('value_text', 'wanted')}").drop("wanted")


def cells_by_provenance(cells: DataFrame, requests: DataFrame) -> DataFrame:
    """Cells of an account whose provenance id is the asked one, whatever its case and spacing; an empty id asks for none."""
    own = cells.select(*KEY, "series", "m", "value_text", F.expr(match_text("provenance_id")).alias("said"))
    asked = requests.withColumn("said", F.expr(match_text("provenance_id"))).where("said <> ''").drop("provenance_id")
    return asked.join(own, [*KEY, "said"]).drop("said")


def legend_codes(cells: DataFrame) -> DataFrame:
    """Distinct recognised status codes of an account in legend order."""
    order = {code: i for i, code in enumerate(vocab.STATUS_LEGEND)}
    status = add(cells.where("series = 'status'"), {"code": "upper(value_text)"})
    known = add(status, {"pos": lookup("code", order)}).where("pos IS NOT NULL")
    return known.groupBy(*KEY).agg(F.expr("transform(array_sort(collect_set(struct(pos, code))), x -> x.code) AS codes"))


def runs(months: DataFrame, partition: list[str]) -> DataFrame:
    """Consecutive months grouped into runs (first month, last month, length)."""
    w = Window.partitionBy(*partition).orderBy("m")
    return (
        months.select(*partition, "m").distinct()
        .withColumn("grp", F.col("m") - F.row_number().over(w))
        .groupBy(*partition, "grp")
        .agg(F.min("m").alias("first_m"), F.max("m").alias("last_m"), F.count("*").cast("int").alias("n_months"))
        .drop("grp")
    )


def count_runs(arr: str) -> str:
    """Number of runs of consecutive months in an array of distinct months."""
    return f"size(filter({arr}, x -> NOT array_contains({arr}, x - 1)))"


# --- per-account facts ----------------------------------------------------------------


def _meaningful(series: str) -> str:
    return f"({series} IS NOT NULL AND NOT {codes.is_blank(codes.conformed_code(series))})"


#: Facts that months without a row of their own would take part in, told by the printed years instead.
_OWN_ROWS = {
    "n_cells": "cast(coalesce(sum(if(opens_year, 12, 0)), 0) AS int)",
    "blank_months": "sort_array(array_except(flatten(transform(collect_list(if(opens_year, year, NULL)), y -> sequence(y * 12, y * 12 + 11))), "
                    "collect_list(if(seen, m, NULL))))",
    "closure_status": "coalesce(max(if(m = closure_m AND cell, coalesce(status, ''), NULL)), max(if(opens_year AND year = floor(closure_m / 12), '', NULL)))",
}


def history_facts(features: DataFrame, wanted: set[str] | None = None) -> DataFrame:
    """All history-derived facts of an account in one aggregate, or only the wanted ones.

    features are those of the dense grid or of the printed rows alone; they must carry profile_id, opened_m and closure_m (null when unknown).
    Collected month arrays hold at most one int per month of the account.
    """
    tests = conflict_tests()
    rows = [
        {f"is_{k}": v for k, v in tests.items()},
        {"with_prev": "is_severe_jump OR is_blank_gap OR is_backfill OR is_no_build_up"},
    ]
    activity = (
        "coalesce(balance_amt > 0, false) "
        f"OR (NOT {missing('paid')} AND NOT coalesce(paid_amt = 0, false)) "
        f"OR (NOT {missing('last_payment_date')} AND {_meaningful('last_payment_date')})"
    )
    rows.append({
        "chain": "with_prev OR is_reaging OR is_first_30 OR is_first_severe",
        "activity": activity,
        **{f"{s}_known": _meaningful(s) for s in ("balance", "paid", "last_payment_date")},
    })

    def months(cond: str) -> str:
        return f"sort_array(collect_list(if({cond}, m, NULL)))"

    def count(cond: str) -> str:
        return f"cast(count_if({cond}) AS int)"

    def money_seen(series: str) -> str:
        return f"{series} IS NOT NULL AND lower({series}) NOT IN ('', '-', '--', 'blank', 'n/a')"

    facts = {
        "n_cells": count("cell"),
        "n_seen": count("seen"),
        "n_cur": count("cur"),
        "n_der": count("der"),
        "n_not_current": count("seen AND NOT cur"),
        "n_30": count("code = '30'"),
        "n_co": count("code = 'co'"),
        "first_seen_m": "min(if(seen, m, NULL))",
        "last_seen_m": "max(if(seen, m, NULL))",
        "last_cur_m": "max(if(cur, m, NULL))",
        "first_der_m": "min(if(der, m, NULL))",
        **{f"n_{kind}": count(f"is_{kind}") for kind in CONFLICTS},
        "n_chain": count("chain"),
        "n_seq_active": count(
            "(chain AND active) OR (with_prev AND coalesce(prev.active, false)) "
            "OR (is_reaging AND coalesce(prev_cur.active, false))"),
        "n_seq_balance_drop": count(
            "(with_prev AND coalesce(prev.balance_amt - balance_amt >= 25, false)) "
            "OR (is_reaging AND coalesce(prev_cur.balance_amt - balance_amt >= 25, false))"),
        "chain_months": months("chain"),
        "blank_months": months("blank"),
        "provable_blank_months": months("blank AND provable"),
        "der_months": months("der"),
        "late30_months": months("code = '30'"),
        "past_due_conflict_months": months("past_due_amt > 0 AND (NOT cell OR blank OR cur)"),
        "activity_conflict_months": months("activity AND (NOT cell OR blank)"),
        "seen_without_balance": months("seen AND NOT balance_known"),
        "first_balance_m": "min(if(balance_known, m, NULL))",
        "last_balance_m": "max(if(balance_known, m, NULL))",
        **{f"{s}_cover_m": f"min(if({money_seen(s)}, m, NULL))" for s in ("balance", "past_due", "paid", "scheduled")},
        "n_flat_drop": count(
            "paid_amt > 0 AND next_m = m + 1 AND balance_amt - next_balance < greatest(25, paid_amt * 0.25)"),
        **{f"n_{s}_cells": count(f"{s} IS NOT NULL")
           for s in ("balance", "paid", "past_due", "credit_limit", "last_payment_date")},
        **{f"{s}_max": f"max({amount_max(s)})" for s in ("balance", "past_due", "credit_limit")},
        "n_paid_pos": count("paid_amt > 0"),
        "n_scheduled_pos": count("scheduled_amt > 0"),
        "n_last_payment_dates": count(f"NOT {missing('last_payment_date')}"),
        **{f"{s}_pos": f"max_by({s}, if({s}_amt > 0, m, NULL))"
           for s in ("scheduled", "paid", "past_due", "credit_limit")},
        **{f"{s}_last": f"max_by({s}, if({s}_known, m, NULL))" for s in ("paid", "balance", "last_payment_date")},
        **{f"{s}_top": f"max_by({s}, if({s}_amt IS NOT NULL, struct({s}_amt AS a, -m AS o), NULL))"
           for s in ("balance", "high_credit")},
        "closure_status": "max(if(m = closure_m AND cell, coalesce(status, ''), NULL))",
        "closure_paid": "max(if(m = closure_m, paid, NULL))",
        "closure_last_payment": "max(if(m = closure_m, last_payment_date, NULL))",
        "cell_pay_days": "array_distinct(flatten(collect_list(pay_days)))",
    }
    if "opens_year" in features.columns:
        facts |= _OWN_ROWS
    if wanted is not None:
        facts = {k: v for k, v in facts.items() if k in wanted}
    f = add_needed(features, rows, names_in(facts.values()))
    return f.groupBy(*KEY).agg(*[F.expr(f"{sql} AS {name}") for name, sql in facts.items()])


FACT_NAMES = frozenset(
    [f"n_{k}" for k in CONFLICTS]
    + "n_cells n_seen n_cur n_der n_not_current n_30 n_co first_seen_m last_seen_m last_cur_m first_der_m n_chain "
      "n_seq_active n_seq_balance_drop chain_months blank_months provable_blank_months der_months late30_months "
      "past_due_conflict_months activity_conflict_months seen_without_balance first_balance_m last_balance_m "
      "balance_cover_m past_due_cover_m paid_cover_m scheduled_cover_m n_flat_drop n_balance_cells n_paid_cells "
      "n_past_due_cells n_credit_limit_cells n_last_payment_date_cells balance_max past_due_max credit_limit_max "
      "n_paid_pos n_scheduled_pos n_last_payment_dates scheduled_pos paid_pos past_due_pos credit_limit_pos paid_last "
      "balance_last last_payment_date_last balance_top high_credit_top closure_status closure_paid "
      "closure_last_payment cell_pay_days".split())


def latest_balance(cells: DataFrame) -> DataFrame:
    """Latest meaningful balance text per account, read from the balance cells alone."""
    known = f"if(NOT {codes.is_blank(codes.conformed_code('value_text'))}, struct(m, ord), NULL)"
    return cells.where("series = 'balance'").groupBy(*KEY).agg(
        F.expr(f"max_by(value_text, {known}) AS balance_last"))


def anchored_features(cells: DataFrame, anchors: DataFrame) -> DataFrame:
    """month_features of cells with the account's profile_id, opened_m and closure_m."""
    return month_features(dense_grid(month_grid(provable_slots(cells)))).join(anchors, KEY, "left")


def account_facts(cells: DataFrame, anchors: DataFrame, wanted: set[str] | None = None) -> DataFrame:
    """history_facts of cells, without the dense grid's rows; anchors is one row per account (profile_id, opened_m, closure_m)."""
    features = printed_features(month_grid(provable_slots(cells))).join(anchors, KEY, "left")
    return history_facts(features, wanted)
