"""Independent SQL for history features and account facts, over the bound views (DuckDB dialect)."""

from __future__ import annotations

from tradeglass.catalog.registry import ORACLE_VIEWS

MONEY_RX = r"-?\$?\d[\d,]*(?:\.\d{2})?"


def omoney(x: str) -> str:
    return f"TRY_CAST(replace(replace(regexp_extract({x}, '{MONEY_RX}'), '$', ''), ',', '') AS DECIMAL(18,2))"


def omissing(x: str) -> str:
    return f"(lower(coalesce({x}, '')) IN ('', '-', '--', '---', 'not reported', 'none', 'n/a'))"


def omonth(d: str) -> str:
    return f"CAST(year({d}) * 12 + month({d}) - 1 AS int)"


BLANK = "code IN ('', 'x', 'nd')"
DER = "code IN ('30', '60', '90', '120', 'co', 'col')"
SEV = "code IN ('60', '90', '120', 'co', 'col')"
RANK = ("CASE code WHEN '30' THEN 1 WHEN '60' THEN 2 WHEN '90' THEN 3 WHEN '120' THEN 4 WHEN 'col' THEN 7 "
        "WHEN 'co' THEN 8 ELSE 0 END")

ORACLE_VIEWS.update({
    "ora_cell": f"""
        SELECT *, row_number() OVER (PARTITION BY report_id, entity_key ORDER BY m) AS cell_no,
               {BLANK} AS blank, NOT ({BLANK}) AS seen, code = 'ok' AS cur, {DER} AS der, {SEV} AS sev,
               code IN ('co', 'col') AS co, {RANK} AS rnk
        FROM (SELECT y.report_id, y.entity_key, y.lay, y.k, CAST(y.yr * 12 + t.i AS int) AS m,
                     coalesce(lower(h.status), '') AS code, h.balance, {omoney('h.balance')} AS bal,
                     h.paid, {omoney('h.paid')} AS paid_amt, {omoney('h.scheduled')} AS sched_amt, h.scheduled,
                     h.past_due, {omoney('h.past_due')} AS due_amt, {omoney('h.credit_limit')} AS limit_amt,
                     h.credit_limit, h.last_payment_date AS lpd,
                     (coalesce({omoney('h.paid')} > 0, false) OR coalesce({omoney('h.scheduled')} > 0, false)
                      OR NOT {omissing('h.last_payment_date')}) AS act,
                     coalesce(g.gap_source = 'projected_gap_slot', false) AS provable,
                     h.balance IS NOT NULL AND lower(h.balance) <> 'not reported' AS bal_known
              FROM (SELECT DISTINCT report_id, entity_key, lay, k, CAST(floor(m / 12.0) AS int) AS yr FROM fx_hist) y
              CROSS JOIN range(12) t(i)
              LEFT JOIN fx_hist h ON h.report_id = y.report_id AND h.entity_key = y.entity_key AND h.m = y.yr * 12 + t.i
              LEFT JOIN fx_hist g ON g.report_id = y.report_id AND g.entity_key = y.entity_key
                                 AND g.m + 1 = y.yr * 12 + t.i) x""",
    # consecutive meaningful cells
    "ora_seen": """
        SELECT *, lag(code) OVER w AS p_code, lag(m) OVER w AS p_m, lag(rnk) OVER w AS p_rnk, lag(bal) OVER w AS p_bal,
               lag(act) OVER w AS p_act, cell_no - coalesce(lag(cell_no) OVER w, 0) - 1 AS gap
        FROM ora_cell WHERE seen WINDOW w AS (PARTITION BY report_id, entity_key ORDER BY m)""",
    # consecutive derogatory cells with the current cells between them
    "ora_der": """
        SELECT d.*, c.m AS c_m, c.bal AS c_bal, c.act AS c_act FROM (
          SELECT report_id, entity_key, m, code, sev, rnk, lag(m) OVER w AS d_m, lag(rnk) OVER w AS d_rnk
          FROM ora_cell WHERE der WINDOW w AS (PARTITION BY report_id, entity_key ORDER BY m)) d
        ASOF LEFT JOIN (SELECT * FROM ora_cell WHERE cur) c
          ON c.report_id = d.report_id AND c.entity_key = d.entity_key AND c.m < d.m""",
    "ora_top": """
        SELECT report_id, entity_key, m,
               max(CASE WHEN der THEN rnk END) OVER (PARTITION BY report_id, entity_key ORDER BY m
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top_rnk
        FROM ora_cell""",
    "ora_gap": """
        SELECT s.report_id, s.entity_key, s.m, count(b.m) AS n_blank, count(b.m) FILTER (WHERE b.provable) AS n_provable
        FROM ora_seen s JOIN ora_cell b ON b.report_id = s.report_id AND b.entity_key = s.entity_key
             AND b.m < s.m AND (s.p_m IS NULL OR b.m > s.p_m) AND b.blank
        GROUP BY ALL""",
    "ora_conf": """
        SELECT s.report_id, s.entity_key, s.lay, 'regression' AS kind, d.m, d.code, d.d_m AS prev_m, s.gap AS gap_len,
               NULL AS pb, s.bal AS b, s.act, NULL AS p_act
        FROM ora_der d JOIN ora_seen s ON s.report_id = d.report_id AND s.entity_key = d.entity_key AND s.m = d.m
        WHERE d.d_m IS NOT NULL AND d.rnk < d.d_rnk AND (d.c_m IS NULL OR d.c_m < d.d_m)
        UNION ALL SELECT report_id, entity_key, lay, 'severe_jump', m, code, p_m, gap, p_bal, bal, act, p_act FROM ora_seen
        WHERE sev AND p_m IS NOT NULL AND (p_code = 'ok' OR (p_rnk > 0 AND rnk > p_rnk + 1))
        UNION ALL SELECT s.report_id, s.entity_key, s.lay, 'reaging', d.m, d.code, d.c_m, s.gap, d.c_bal, s.bal, s.act, d.c_act
        FROM ora_der d JOIN ora_seen s ON s.report_id = d.report_id AND s.entity_key = d.entity_key AND s.m = d.m
        WHERE d.sev AND d.c_m > d.d_m
        UNION ALL SELECT report_id, entity_key, lay, 'first_30', m, code, NULL, gap, NULL, bal, act, NULL FROM ora_seen
        WHERE code = '30' AND p_m IS NULL
        UNION ALL SELECT report_id, entity_key, lay, 'first_severe', m, code, NULL, gap, NULL, bal, act, NULL FROM ora_seen
        WHERE sev AND p_m IS NULL
        UNION ALL SELECT report_id, entity_key, lay, 'blank_gap', m, code, p_m, gap, p_bal, bal, act, p_act FROM ora_seen
        WHERE der AND p_m IS NOT NULL AND gap IN (1, 2)
        UNION ALL SELECT report_id, entity_key, lay, 'backfill', m, code, p_m, gap, p_bal, bal, act, p_act FROM ora_seen
        WHERE sev AND p_m IS NOT NULL AND gap >= 3
        UNION ALL SELECT s.report_id, s.entity_key, s.lay, 'no_build_up', s.m, s.code, s.p_m, s.gap, s.p_bal, s.bal, s.act, s.p_act
        FROM ora_seen s JOIN ora_top t ON t.report_id = s.report_id AND t.entity_key = s.entity_key AND t.m = s.m
        WHERE s.co AND (s.p_m IS NULL OR s.p_code = 'ok' OR coalesce(t.top_rnk, 0) < 4)""",
    # conflicts that count for the account: opened at least a month earlier, proven gaps in one layout
    "ora_chain": """
        SELECT c.*, a.opened_m FROM ora_conf c
        JOIN ora_open a ON a.report_id = c.report_id AND a.entity_key = c.entity_key
        LEFT JOIN ora_gap g ON g.report_id = c.report_id AND g.entity_key = c.entity_key AND g.m = c.m
        WHERE (kind NOT IN ('first_30', 'first_severe') OR c.m - a.opened_m >= 1)
          AND (kind <> 'backfill' OR c.lay <> 1 OR g.n_provable >= c.gap_len)""",
    "ora_open": f"""
        SELECT report_id, entity_key, k, CASE WHEN k % 13 = 0 THEN NULL ELSE {omonth('first_order')} END AS opened_m
        FROM fx_account""",
    "ora_field": f"""
        SELECT a.*, CASE WHEN k % 13 = 0 THEN NULL ELSE {omonth('first_order')} END AS opened_m,
            coalesce(status, '') AS s, lower(coalesce(comments, '')) AS cm,
            CASE lay WHEN 1 THEN coalesce(status_updated, balance_updated) ELSE reported END AS e_rep,
            CASE lay WHEN 0 THEN coalesce(status_updated, reported) WHEN 1 THEN status_updated
                     WHEN 2 THEN coalesce(reported, status_updated) ELSE reported END AS e_su,
            CASE lay WHEN 0 THEN coalesce(balance_updated, reported) WHEN 1 THEN balance_updated
                     WHEN 2 THEN coalesce(status_updated, reported) ELSE reported END AS e_bu,
            CASE WHEN closed IS NOT NULL THEN true WHEN lower(coalesce(status, '')) LIKE '%closed%' THEN true
                 WHEN lay IN (0, 2) AND lower(coalesce(comments, '')) LIKE '%closed%' THEN true ELSE false END AS is_closed
        FROM fx_account a""",
    "ora_sig": """
        SELECT DISTINCT report_id, entity_key, day, bool_or(pays) AS pays FROM (
          SELECT report_id, entity_key, pay_day AS day, true AS pays FROM fx_hist WHERE lay IN (1, 2) AND pay_day IS NOT NULL
          UNION ALL SELECT report_id, entity_key, last_day, true FROM ora_field WHERE last_payment IS NOT NULL
          UNION ALL SELECT report_id, entity_key, CASE WHEN v LIKE '%/%' THEN CAST(strptime(v, '%m/%d/%Y') AS date)
                           WHEN v LIKE '%-%' THEN CAST(v AS date) END, false
          FROM (SELECT report_id, entity_key, unnest([e_rep, e_su, e_bu, closed]) AS v FROM ora_field) u) z
        WHERE day IS NOT NULL GROUP BY report_id, entity_key, day""",
    "ora_interval": f"""
        SELECT c.report_id, c.entity_key, {omonth('c.day')} AS m, CAST(min(c.day - p.day) AS int) AS interval_days
        FROM ora_sig c JOIN ora_sig p ON p.report_id = c.report_id AND p.entity_key = c.entity_key AND p.pays
             AND p.day < c.day AND c.day - p.day <= 45 AND {omonth('c.day')} - {omonth('p.day')} <= 1
        GROUP BY c.report_id, c.entity_key, {omonth('c.day')}""",
    "ora_late30": """
        SELECT c.report_id, c.entity_key, c.m, i.interval_days FROM ora_cell c
        JOIN ora_interval i ON i.report_id = c.report_id AND i.entity_key = c.entity_key AND i.m = c.m
        WHERE c.code = '30'""",
    "ora_fact": """
        SELECT report_id, entity_key, count(*) FILTER (WHERE seen) AS n_seen, count(*) FILTER (WHERE cur) AS n_cur,
            count(*) FILTER (WHERE der) AS n_der, count(*) FILTER (WHERE seen AND NOT cur) AS n_other,
            count(*) FILTER (WHERE code = '30') AS n_30, count(*) FILTER (WHERE code = 'co') AS n_co,
            min(m) FILTER (WHERE seen) AS first_m, max(m) FILTER (WHERE seen) AS last_m, max(m) FILTER (WHERE cur) AS cur_m,
            min(m) FILTER (WHERE der) AS der_m,
            max(bal) AS bal_max, max(due_amt) AS due_max, max(limit_amt) AS limit_max,
            count(balance) AS n_bal, count(past_due) AS n_due, count(credit_limit) AS n_limit, count(paid) AS n_paid,
            count(lpd) AS n_lpd, count(*) FILTER (WHERE paid_amt > 0) AS n_paid_pos,
            count(*) FILTER (WHERE sched_amt > 0) AS n_sched_pos,
            count(*) FILTER (WHERE lpd IS NOT NULL AND lpd <> '--') AS n_lpd_known,
            min(m) FILTER (WHERE bal_known) AS bal_first, max(m) FILTER (WHERE bal_known) AS bal_last,
            max_by(balance, CASE WHEN bal_known THEN m END) AS bal_text,
            max_by(past_due, CASE WHEN due_amt > 0 THEN m END) AS due_text,
            max_by(credit_limit, CASE WHEN limit_amt > 0 THEN m END) AS limit_text,
            max(m) FILTER (WHERE lpd IS NOT NULL AND lpd <> '--') AS lpd_m,
            min(m) FILTER (WHERE balance IS NOT NULL) AS cov_bal, min(m) FILTER (WHERE past_due IS NOT NULL) AS cov_due,
            min(m) FILTER (WHERE paid <> '-') AS cov_paid, min(m) FILTER (WHERE scheduled NOT IN ('', '-')) AS cov_sched
        FROM ora_cell GROUP BY report_id, entity_key""",
    "ora_month": """
        SELECT c.report_id, c.entity_key,
            count(*) FILTER (WHERE c.der AND c.m < f.cov_bal) AS u_bal, count(*) FILTER (WHERE c.der AND c.m < f.cov_due) AS u_due,
            count(*) FILTER (WHERE c.der AND c.m < f.cov_paid) AS u_paid,
            count(*) FILTER (WHERE c.der AND c.m < f.cov_sched) AS u_sched,
            count(*) FILTER (WHERE c.blank AND c.m > f.first_m AND c.m < f.last_m AND (o.opened_m IS NULL OR c.m > o.opened_m)
                             AND (c.lay <> 1 OR c.provable)) AS n_missing,
            count(*) FILTER (WHERE c.seen AND NOT coalesce(c.bal_known, false) AND c.m > f.bal_first AND c.m < f.bal_last) AS n_bal_gap,
            count(*) FILTER (WHERE c.due_amt > 0 AND (c.blank OR c.cur)) AS n_due_conf,
            count(*) FILTER (WHERE c.blank AND (c.bal > 0 OR (c.paid <> '-' AND c.paid_amt <> 0)
                             OR (c.lpd IS NOT NULL AND c.lpd <> '--'))) AS n_act_conf,
            count(*) FILTER (WHERE c.paid_amt > 0 AND n.bal IS NOT NULL
                             AND c.bal - n.bal < greatest(25, c.paid_amt * 0.25)) AS n_flat
        FROM ora_cell c JOIN ora_fact f ON f.report_id = c.report_id AND f.entity_key = c.entity_key
        JOIN ora_open o ON o.report_id = c.report_id AND o.entity_key = c.entity_key
        LEFT JOIN ora_cell n ON n.report_id = c.report_id AND n.entity_key = c.entity_key AND n.m = c.m + 1
        GROUP BY c.report_id, c.entity_key""",
    "ora_count": """
        SELECT report_id, entity_key, count(*) FILTER (WHERE kind = 'regression') AS n_regression,
            count(*) FILTER (WHERE kind = 'severe_jump') AS n_severe_jump, count(*) FILTER (WHERE kind = 'reaging') AS n_reaging,
            count(*) FILTER (WHERE kind = 'first_30') AS n_first_30, count(*) FILTER (WHERE kind = 'first_severe') AS n_first_severe,
            count(*) FILTER (WHERE kind = 'blank_gap') AS n_blank_gap, count(*) FILTER (WHERE kind = 'backfill') AS n_backfill,
            count(*) FILTER (WHERE kind = 'no_build_up') AS n_no_build_up,
            count(*) FILTER (WHERE kind <> 'regression') AS n_chain,
            count(*) FILTER (WHERE kind <> 'regression' AND (act OR p_act)) AS n_act,
            count(*) FILTER (WHERE kind <> 'regression' AND pb - b >= 25) AS n_drop,
            list(DISTINCT m) FILTER (WHERE kind <> 'regression') AS chain_m
        FROM ora_chain GROUP BY report_id, entity_key""",
    "ora_dup": f"""
        SELECT report_id, number FROM (
          SELECT a.report_id, a.number, nullif(lower(coalesce(a.status, '')), '') AS s,
            CASE WHEN a.balance IS NULL THEN f.bal_text WHEN a.balance = '' THEN 'Not reported' ELSE a.balance END AS b
          FROM fx_account a LEFT JOIN ora_fact f ON f.report_id = a.report_id AND f.entity_key = a.entity_key) x
        WHERE number <> '' GROUP BY report_id, number
        HAVING count(*) >= 2 AND (count(DISTINCT s) > 1 OR count(DISTINCT b) > 1)""",
    "ora_acct": f"""
        SELECT a.*, f.* EXCLUDE (report_id, entity_key), mo.* EXCLUDE (report_id, entity_key),
            coalesce(c.n_regression, 0) AS n_regression, coalesce(c.n_severe_jump, 0) AS n_severe_jump,
            coalesce(c.n_reaging, 0) AS n_reaging, coalesce(c.n_first_30, 0) AS n_first_30,
            coalesce(c.n_first_severe, 0) AS n_first_severe, coalesce(c.n_blank_gap, 0) AS n_blank_gap,
            coalesce(c.n_backfill, 0) AS n_backfill, coalesce(c.n_no_build_up, 0) AS n_no_build_up,
            coalesce(c.n_chain, 0) AS n_chain, coalesce(c.n_act, 0) AS n_act, coalesce(c.n_drop, 0) AS n_drop, c.chain_m,
            coalesce(l.n_eval, 0) AS n_eval, coalesce(l.n_short, 0) AS n_short, d.number IS NOT NULL AS dup,
            {omissing('a.s')} AS no_status, k % 23 = 0 OR k % 12 = 9 AS bankrupt,
            k % 19 = 0 OR k % 12 = 1 AS coll, k % 12 = 8 OR k % 14 IN (0, 1) AS plan,
            CASE WHEN k % 11 = 0 THEN 500 WHEN lay <> 2 AND k % 12 = 0 THEN 1200 ELSE 0 END AS co_amt,
            coalesce(CASE WHEN a.past_due <> '' THEN {omoney('a.past_due')} WHEN lay = 1 THEN CASE WHEN k % 12 = 2 THEN 75 END
                     ELSE {omoney('f.due_text')} END, 0) AS pd_amt,
            type_text <> 'Revolving Credit Card' AS inst_only,
            type_text = 'Student Loan' OR (type_text = 'Installment Loan' AND k % 9 = 0) AS student,
            omo(report_date) AS anchor_m,
            CASE WHEN a.balance IS NULL THEN 'missing' WHEN {omissing('a.balance')} THEN 'explicit' ELSE 'reported' END AS bal_state,
            a.payment IS NOT NULL AND NOT {omissing('a.payment')} AS pay_rep,
            a.scheduled IS NOT NULL AND NOT {omissing('a.scheduled')} AS sched_rep,
            omo(a.e_su) AS su_m, omo(a.e_bu) AS bu_m,
            CASE WHEN last_payment IS NOT NULL THEN {omonth('last_day')} WHEN lay = 2 THEN f.lpd_m END AS lp_m,
            CASE WHEN a.is_closed THEN omo(coalesce(a.closed, a.e_su, a.e_bu, a.last_payment)) ELSE omo(a.last_payment) END AS clo_m
        FROM ora_field a
        LEFT JOIN ora_fact f ON f.report_id = a.report_id AND f.entity_key = a.entity_key
        LEFT JOIN ora_month mo ON mo.report_id = a.report_id AND mo.entity_key = a.entity_key
        LEFT JOIN ora_count c ON c.report_id = a.report_id AND c.entity_key = a.entity_key
        LEFT JOIN (SELECT report_id, entity_key, count(*) AS n_eval, count(*) FILTER (WHERE interval_days IN (28, 29)) AS n_short
                   FROM ora_late30 GROUP BY ALL) l ON l.report_id = a.report_id AND l.entity_key = a.entity_key
        LEFT JOIN ora_dup d ON d.report_id = a.report_id AND d.number = a.number""",
    "ora_rule": f"""
        SELECT x.*, (co_amt > 0 OR pd_amt > 0 OR coll OR regexp_matches(lower(s), 'past due|charge off|collection|repo')) AS derog,
            (co_amt > 0 OR pd_amt > 0 OR coll OR regexp_matches(lower(s), 'past due|charge off|collection|repo')
             OR bankrupt OR n_der > 0) AS neg,
            n_seen > 0 AS present, n_cur > 0 AND n_other = 0 AS only_cur,
            (original_creditor IS NOT NULL OR (NOT regexp_matches(lower(name || ' ' || s || ' ' || cm), 'midland|collection')
              AND NOT (student AND k % 9 = 0))) AS usable,
            h.code AS clo_code, h.paid AS clo_paid, h.paid_amt AS clo_paid_amt, h.lpd AS clo_lpd,
            (n_bal > 0 OR (lay = 2 AND n_paid + n_due + n_limit + n_lpd > 0)) AS has_bal,
            coalesce({omoney('x.payment')} > 0, CASE WHEN coalesce(payment, '') = '' THEN n_paid_pos > 0 ELSE false END) AS recent_pos
        FROM ora_acct x LEFT JOIN (SELECT * EXCLUDE (k, lay) FROM ora_cell) h ON h.report_id = x.report_id AND h.entity_key = x.entity_key AND h.m = x.clo_m""",
})
# Month of a display date in any of the bound spellings.
ORACLE_MONTH = ("CASE WHEN {x} LIKE '__/____' THEN CAST(substr({x}, 4, 4) AS int) * 12 + CAST(substr({x}, 1, 2) AS int) - 1 "
                "WHEN {x} LIKE '%/%' THEN CAST(substr({x}, 7, 4) AS int) * 12 + CAST(substr({x}, 1, 2) AS int) - 1 "
                "WHEN {x} LIKE '%-%' THEN CAST(substr({x}, 1, 4) AS int) * 12 + CAST(substr({x}, 6, 2) AS int) - 1 "
                "WHEN {x} IS NOT NULL THEN CAST(right({x}, 4) AS int) * 12 + "
                "CAST(floor((instr('JanFebMarAprMayJunJulAugSepOctNovDec', left({x}, 3)) - 1) / 3.0) AS int) END")


def expand_month(sql: str) -> str:
    """Replace omo(expr) by the month expression."""
    while "omo(" in sql:
        start = sql.index("omo(")
        depth, end = 1, start + 4
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = sql[:start] + "(" + ORACLE_MONTH.format(x=f"({sql[start + 4:end - 1]})") + ")" + sql[end:]
    return sql


ORACLE_VIEWS.update({name: expand_month(sql) for name, sql in ORACLE_VIEWS.items()})

OPEN = "NOT coll AND NOT is_closed"
PAY_AMOUNT = ("CASE lay WHEN 0 THEN coalesce(nullif(scheduled, ''), nullif(payment, ''), CASE WHEN n_sched_pos + n_paid_pos > 0 THEN '$1' END) "
              "WHEN 1 THEN coalesce(nullif(scheduled, ''), CASE WHEN n_sched_pos > 0 THEN '$1' END) "
              "WHEN 2 THEN coalesce(nullif(payment, ''), nullif(scheduled, ''), CASE WHEN n_paid_pos > 0 THEN '$1' END) "
              "ELSE coalesce(nullif(scheduled, ''), CASE WHEN n_sched_pos > 0 THEN '$1' END, nullif(payment, ''), "
              "CASE WHEN n_paid_pos > 0 THEN '$1' END) END")
RECENT_TEXT = "coalesce(nullif(payment, ''), CASE WHEN n_paid_pos > 0 THEN '$1' END)"
RECENT_CUR = "coalesce(cur_m >= last_m - 2, false)"
TERMS_MISSING = "terms IS NULL AND duration IS NULL"
SIGNAL = "(pay_rep OR last_payment IS NOT NULL)"
CLO_ACT = "(coalesce(clo_code, '') NOT IN ('', 'x', 'nd') OR coalesce(clo_paid, '-') <> '-' OR (lay = 2 AND coalesce(clo_lpd, '--') <> '--'))"
CLO_AMT = "(clo_m IS NOT NULL AND pay_rep AND coalesce(clo_paid, '-') <> '-')"
HIGH_AMT = f"coalesce({omoney('high')}, bal_max)"
BAL_TEXT = "CASE WHEN balance IS NULL THEN bal_text ELSE balance END"
OBS_MAX = f"greatest(coalesce({omoney(BAL_TEXT)}, -1), coalesce(bal_max, -1))"
LIMIT_AMT = f"coalesce({omoney('credit_limit')}, {omoney('limit_text')})"
CO_LIKE = "(lower(s) LIKE '%charge off%' OR co_amt > 0)"
YEAR_OF = "regexp_extract(dofd, '(?:19|20)[0-9]{2}')"
OPENED = "opened IS NOT NULL"

# trigger, applies, evaluable
RULE_SQL: dict[str, tuple[str, str, str]] = {
    "r01": ("dup", "true", "true"),
    "r02": ("k % 10 IN (0, 1, 2)", "true", "true"),
    "r03": ("address IS NULL AND phone = ''", "true", "true"),
    "r04": ("no_status AND (coll OR pd_amt > 0 OR co_amt > 0 OR n_der > 0)", "neg", "true"),
    "r05": ("coll AND NOT usable", "coll", "true"),
    "r06": ("student AND NOT usable", "student", "true"),
    "r07": ("k % 5 IN (0, 2)", "k % 5 IN (0, 2)", "responsibility IS NOT NULL"),
    "r08": ("k % 17 = 0", "k % 17 = 0", "true"),
    "r09": (f"NOT present AND {OPEN} AND NOT coalesce(anchor_m - opened_m < 2, false)", OPEN, "true"),
    "r10": ("derog AND NOT present", "neg", "true"),
    "r11": ("present AND n_missing > 0", "true", "true"),
    "r12": ("u_bal >= 2 OR u_due >= 2 OR u_paid >= 2 OR u_sched >= 2", "true", "true"),
    "r13": ("opened_m IS NOT NULL AND coalesce(first_m > greatest(opened_m + 1, anchor_m - CASE WHEN student AND k % 4 = 2 THEN 119 ELSE 83 END), false)",
            "true", OPENED),
    "r14": (f"{OPEN} AND inst_only AND {omissing(PAY_AMOUNT)}", f"{OPEN} AND inst_only", "true"),
    "r15": (f"{OPEN} AND {RECENT_CUR} AND {omissing(RECENT_TEXT)} AND lp_m IS NULL", f"{OPEN} AND {RECENT_CUR}", "true"),
    "r16": ("lay = 2 AND n_due_conf > 0", "lay = 2", "n_due > 0"),
    "r17": ("lay = 2 AND n_act_conf > 0", "lay = 2", "n_bal + n_paid + n_due + n_limit + n_lpd > 0"),
    "r18": ("pd_amt > 0 AND present AND only_cur AND n_due_conf = 0", "pd_amt > 0", "true"),
    "r19": ("n_der = 0 AND coalesce(due_max > 0, false)", "true", "n_due > 0"),
    "r20": ("n_regression > 0", "true", "true"),
    "r21": ("n_short > 0", "n_30 > 0", "n_eval > 0"),
    "r22": ("n_severe_jump > 0", "true", "true"),
    "r23": ("n_reaging > 0", "true", "true"),
    "r24": ("n_first_30 > 0", "true", OPENED),
    "r25": ("n_first_severe > 0", "true", OPENED),
    "r26": ("n_blank_gap > 0", "true", "true"),
    "r27": ("n_backfill > 0", "true", "true"),
    "r28": ("n_no_build_up > 0", "true", "true"),
    "r29": ("plan AND NOT present", "plan", "true"),
    "r30": ("plan AND present AND n_chain > 0", "plan", "true"),
    "r31": ("n_act > 0 OR (n_chain > 0 AND recent_pos) OR coalesce(list_bool_or([abs(x - lp_m) <= 2 for x in chain_m]), false)",
            "true", "n_paid_pos > 0 OR n_sched_pos > 0 OR recent_pos OR lp_m IS NOT NULL OR n_lpd_known > 0"),
    "r32": ("n_drop > 0", "true", "has_bal"),
    "r33": ("last_payment IS NOT NULL AND NOT sched_rep", "last_payment IS NOT NULL", "true"),
    "r34": ("last_payment IS NOT NULL AND NOT pay_rep", "last_payment IS NOT NULL", "true"),
    "r35": (f"sched_rep AND {TERMS_MISSING}", "sched_rep", "true"),
    "r36": (f"is_closed AND clo_m IS NOT NULL AND (coalesce(clo_code, '') IN ('', 'x', 'nd') OR ({SIGNAL} AND NOT {CLO_ACT}))",
            "is_closed", "clo_m IS NOT NULL"),
    "r37": (f"is_closed AND {CLO_AMT} AND abs({omoney('payment')} - clo_paid_amt) >= 0.01", "is_closed", CLO_AMT),
    "r38": (f"coalesce({HIGH_AMT} > 0 AND {OBS_MAX} > 0 AND {HIGH_AMT} > {OBS_MAX}, false)",
            f"coalesce({HIGH_AMT} > 0, false)", "has_bal"),
    "r39": ("inst_only AND n_flat > 0", "NOT is_closed AND (inst_only)", "has_bal AND n_paid > 0"),
    "r40": ("n_bal_gap >= 2", "true", "has_bal"),
    "r41": (f"coalesce({LIMIT_AMT} > 0 AND limit_max > 0 AND {LIMIT_AMT} > limit_max, false)",
            f"coalesce({LIMIT_AMT} > 0, false)", "n_limit > 0"),
    "r42": ("derog AND bal_state = 'missing'", "neg", "true"),
    "r43": ("derog AND present AND bal_max IS NULL", "neg", "true"),
    "r44": (f"{CO_LIKE} AND present AND only_cur AND n_co = 0", CO_LIKE, "true"),
    "r45": ("coll AND present AND n_cur > 0 AND NOT plan", "coll", "true"),
    "r46": (f"coalesce({YEAR_OF} <> '' AND CAST(floor(der_m / 12.0) AS int) <> TRY_CAST({YEAR_OF} AS int), false)",
            "dofd IS NOT NULL", "true"),
    "r47": ("coalesce(last_m - su_m > 2, false)", "e_su IS NOT NULL", "true"),
    "r48": ("coalesce(bal_last - bu_m > 2, false)", "e_bu IS NOT NULL", "has_bal"),
    "r49": ("coalesce(omo(removal) - omo(dofd) < 78 OR omo(removal) - omo(dofd) > 96, false)", "k % 7 IN (0, 1)", "k % 7 IN (0, 1)"),
    "r50": ("is_closed AND coalesce(closed, e_su, e_bu) IS NULL", "is_closed", "true"),
    "r51": ("(neg OR bal_state = 'reported') AND e_rep IS NULL", "neg OR bal_state = 'reported'", "true"),
    "r52": ("neg AND e_su IS NULL", "neg", "true"),
    "r53": ("bal_state = 'reported' AND e_bu IS NULL", "bal_state = 'reported'", "true"),
}


def status_sql(rule_id: str) -> str:
    trig, applies, evaluable = RULE_SQL[rule_id]
    return expand_month(f"CASE WHEN {trig} THEN 'triggered' WHEN NOT ({applies}) THEN 'not_applicable' "
                        f"WHEN {evaluable} THEN 'not_triggered' ELSE 'insufficient_evidence' END")


ORACLE_VIEWS["ora_outcome"] = " UNION ALL ".join(
    f"SELECT report_id, entity_key, lay, k, name, neg, '{r}' AS rule_id, {status_sql(r)} AS status FROM ora_rule"
    for r in RULE_SQL)
