"""Queries of the scalar functions and classification predicates over the bound texts."""

from __future__ import annotations

from tradeglass import vocab
from tradeglass.catalog.binding import VIEWS
from tradeglass.catalog.oracle import MONEY_RX, omissing, omoney
from tradeglass.catalog.registry import query
from tradeglass.functions import classify, codes, dates, evidence, money, text


def scalar(name: str, source: str, spark: dict[str, str], duck: dict[str, str], keys: str = "k") -> None:
    """A query that projects expressions over a common SQL source, beside its oracle projection."""
    key_list = [c.strip() for c in keys.split(",")]

    @query(name, f"SELECT {keys}, {', '.join(f'{sql} AS {c}' for c, sql in duck.items())} FROM ({source}) src")
    def run(b):
        return b.sql(source).selectExpr(*key_list, *[f"{sql} AS {c}" for c, sql in spark.items()])


def squeeze(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'))"


def low(x: str) -> str:
    return f"lower({squeeze(x)})"


def rep(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"


def in_list(x: str, values: list[str]) -> str:
    return f"({x} IN ({', '.join(repr(v) for v in values)}))"


def any_word(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {w!r})" for w in words) + ")"


def flag(x: str) -> str:
    return f"CAST({x} AS int)"


ACCOUNT = "SELECT k, name, number, coalesce(status, '') AS s, coalesce(balance, '') AS bal, type_text AS t, " \
          "coalesce(comments, '') AS cm, coalesce(original_creditor, '') AS oc, coalesce(additional, '') AS ad, " \
          "coalesce(legal_category, '') AS lc, coalesce(reporting_category, '') AS rc, report_id, entity_key FROM fx_account"
SPELLED = " UNION ALL ".join(
    f"SELECT k, {i} AS i, coalesce({c}, '') AS t FROM fx_account"
    for i, c in enumerate(["opened", "reported", "closed", "status_updated", "balance_updated", "removal", "dofd"]))
CODES = "SELECT k, m, status AS t FROM fx_hist"

scalar("n1_norm_text", "SELECT doc_id, text FROM documents",
       {"norm": f"md5({text.norm_text('text')})", "match_form": f"md5({text.match_text('text')})"},
       {"norm": f"md5({squeeze('text')})", "match_form": f"md5({low('text')})"}, "doc_id")

NAMES = "SELECT k, name || CASE k % 4 WHEN 0 THEN ' Junior' WHEN 1 THEN ', SENIOR' WHEN 2 THEN ' of Saint Paul' ELSE '' END AS t FROM fx_account"
scalar("n2_identity_key", NAMES, {"v": text.identity_key("t")},
       {"v": rep(rep(rep(rep(low("t"), r"\bjunior\b", "jr"), r"\bsenior\b", "sr"), r"\bsaint\b", "st"), "[^a-z0-9]")})
scalar("n3_missing", ACCOUNT, {"s_missing": f"cast({text.is_missing('s')} AS int)",
                               "b_missing": f"cast({text.is_missing('bal')} AS int)"},
       {"s_missing": flag(in_list(low("s"), vocab.MISSING_TOKENS)), "b_missing": flag(in_list(low("bal"), vocab.MISSING_TOKENS))})
scalar("n4_cell_state", "SELECT k, CASE k % 3 WHEN 0 THEN coalesce(balance, '') || ':' ELSE coalesce(balance, '') END AS t FROM fx_account",
       {"v": text.cell_state("t")},
       {"v": f"CASE WHEN {squeeze('t')} = '' THEN 'blank' WHEN {in_list(f"rtrim({low('t')}, ':')", vocab.EXPLICIT_NOT_REPORTED)} "
             "THEN 'explicit_not_reported' ELSE 'value' END"})
scalar("n5_money", "SELECT k, 0 AS i, coalesce(status, '') AS t FROM fx_account UNION ALL SELECT k, 1, coalesce(balance, '') FROM fx_account",
       {"v": f"cast({money.money('t')} AS double)"}, {"v": f"CAST({omoney('t')} AS double)"}, "k, i")
ALL_MONEY = f"list_transform(regexp_extract_all(t, '{MONEY_RX}'), lambda x: TRY_CAST(replace(replace(x, '$', ''), ',', '') AS DECIMAL(18,2)))"
scalar("n6_max_money", "SELECT doc_id, line_no, line AS t FROM fx_line",
       {"n": f"size({money.money_all('t')})", "top": f"cast({money.max_money('t')} AS double)"},
       {"n": f"len(list_filter({ALL_MONEY}, lambda x: x IS NOT NULL))", "top": f"CAST(list_max({ALL_MONEY}) AS double)"},
       "doc_id, line_no")
scalar("n7_money_in_context", ACCOUNT,
       {"due": money.money_in_context("s", ["past due"]), "off": money.money_in_context("s", ["charge off", "charged off"])},
       {c: f"CASE WHEN {any_word(low('s'), w)} THEN nullif(regexp_extract({squeeze('s')}, '{MONEY_RX}'), '') END"
        for c, w in (("due", ["past due"]), ("off", ["charge off", "charged off"]))})
scalar("n8_positive_int", "SELECT doc_id, line_no, line AS t FROM fx_line", {"v": money.positive_int("t")},
       {"v": r"nullif(TRY_CAST(regexp_extract(t, '\d+') AS BIGINT), 0)"}, "doc_id, line_no")
DUCK_DATE = (r"CASE WHEN regexp_matches(t, '^\d{2}/\d{2}/\d{4}$') THEN strptime(t, '%m/%d/%Y') "
             r"WHEN regexp_matches(t, '^\d{4}-\d{2}-\d{2}$') THEN strptime(t, '%Y-%m-%d') "
             r"WHEN regexp_matches(t, '^\d{2}/\d{4}$') THEN strptime('01/' || t, '%d/%m/%Y') "
             r"WHEN regexp_matches(t, '^[A-Z][a-z]{2} \d{4}$') THEN strptime('1 ' || t, '%d %b %Y') END")
scalar("n9_parse_date", SPELLED, {"v": f"cast({dates.parse_date('t')} AS string)"},
       {"v": f"CAST(CAST({DUCK_DATE} AS DATE) AS VARCHAR)"}, "k, i")
SENTENCE = f"SELECT k, i, CASE k % 3 WHEN 0 THEN t ELSE 'Paid on ' || t || ', in full' END AS t FROM ({SPELLED}) z"
scalar("n10_date_text", SENTENCE, {"day": dates.day_text("t"), "any_date": dates.date_text("t")}, {
    "day": r"coalesce(nullif(regexp_extract(t, '\b\d{1,2}/\d{1,2}/\d{2,4}\b'), ''), nullif(regexp_extract(t, '\b\d{4}-\d{2}-\d{2}\b'), ''), '')",
    "any_date": r"coalesce(nullif(regexp_extract(t, '\b\d{1,2}/\d{1,2}/\d{2,4}\b'), ''), nullif(regexp_extract(t, '\b\d{4}-\d{2}-\d{2}\b'), ''), "
                r"nullif(regexp_extract(t, '\b[A-Za-z]{3,9}\s+\d{4}\b'), ''), '')"}, "k, i")
scalar("n11_month_arithmetic", "SELECT k, m, CAST(first_order AS date) AS d FROM fx_hist JOIN fx_span USING (k)",
       {"label": dates.month_label("m"), "next_label": dates.month_label("(m + 1)"),
        "start_day": f"cast({dates.month_start('m')} AS string)",
        "since": dates.months_between("d", dates.month_start("m"))},
       {"label": "strftime(make_date(CAST(floor(m / 12.0) AS bigint), m % 12 + 1, 1), '%b %Y')",
        "next_label": "strftime(make_date(CAST(floor(m / 12.0) AS bigint), m % 12 + 1, 1) + INTERVAL 1 MONTH, '%b %Y')",
        "start_day": "strftime(make_date(CAST(floor(m / 12.0) AS bigint), m % 12 + 1, 1), '%Y-%m-%d')",
        "since": "m - CAST(year(d) * 12 + month(d) - 1 AS int)"}, "k, m")
SCANNED = ("SELECT k, m, CASE m % 9 WHEN 0 THEN '0K' WHEN 1 THEN '3' WHEN 2 THEN '12*' WHEN 3 THEN 'co/' WHEN 4 THEN 'tn' "
           "WHEN 5 THEN lower(status) WHEN 6 THEN '[' || status || ']' WHEN 7 THEN 'zz' ELSE status END AS t FROM fx_hist")
T = "upper(regexp_replace(t, '[^A-Za-z0-9]', '', 'g'))"
scalar("n12_scanned_code", SCANNED, {"v": codes.scanned_code("t")}, {
    "v": f"CASE WHEN {T} IN ('0K') THEN 'OK' WHEN {T} = '3' THEN '30' WHEN {T} = '12' THEN '120' WHEN {T} = 'TN' THEN 'TNT' "
         f"WHEN {in_list(T, list(vocab.STATUS_LEGEND))} THEN {T} ELSE '-' END"}, "k, m")
GRID = ("SELECT k, m, CASE m % 5 WHEN 0 THEN status || ' 30,' WHEN 1 THEN '- ' || lower(status) WHEN 2 THEN 'paid ' || status "
        "WHEN 3 THEN '7' ELSE status END AS t, status AS st FROM fx_hist")
scalar("n13_grid_tokens", GRID, {"v": f"array_join({codes.grid_tokens('t')}, ',')"}, {
    "v": "CASE m % 5 WHEN 0 THEN st || ',30' WHEN 1 THEN 'X,' || st WHEN 3 THEN '' ELSE st END"}, "k, m")
C = "lower(t)"
scalar("n14_code_predicates", CODES,
       {c: f"cast({fn(codes.history_code('t'))} AS int)" for c, fn in
        (("blank", codes.is_blank), ("cur", codes.is_current), ("der", codes.is_derogatory), ("severe", codes.is_severe),
         ("charge_off", codes.is_charge_off))},
       {"blank": flag(f"{C} IN ('x', 'nd')"), "cur": flag(f"{C} = 'ok'"), "der": flag(f"{C} NOT IN ('x', 'nd', 'ok', 'tnt')"),
        "severe": flag(f"{C} NOT IN ('x', 'nd', 'ok', 'tnt', '30')"), "charge_off": flag(f"{C} IN ('co', 'col')")}, "k, m")
scalar("n15_severity_rank", CODES, {"v": codes.severity_rank(codes.history_code("t"))}, {
    "v": f"coalesce(list_position(['30', '60', '90', '120', '150', '180', 'col', 'co'], {C}), 0)"}, "k, m")


@query("n16_list_predicates",
       "SELECT k, CAST(bool_or(status NOT IN ('X', 'ND')) AS int) AS any_seen, "
       "CAST(bool_or(status NOT IN ('X', 'ND', 'OK', 'TNT')) AS int) AS any_der, "
       "CAST(bool_or(status = 'OK') AS int) AS any_cur, "
       "CAST(bool_or(status = 'OK') AND bool_and(status IN ('OK', 'X', 'ND')) AS int) AS only_cur FROM fx_hist GROUP BY k")
def n16(b):
    lists = b.view("fx_hist").groupBy("k").agg({"status": "collect_list"}).withColumnRenamed("collect_list(status)", "a")
    arr = f"transform(a, x -> {codes.history_code('x')})"
    return lists.selectExpr(
        "k", f"cast({codes.any_meaningful(arr)} AS int) AS any_seen", f"cast({codes.any_derogatory(arr)} AS int) AS any_der",
        f"cast({codes.any_current(arr)} AS int) AS any_cur", f"cast({codes.only_current_or_blank(arr)} AS int) AS only_cur")


PHONE = vocab.PHONE_PATTERN
scalar("n17_phones", "SELECT doc_id, text FROM documents",
       {"found": f"array_join({text.phones('text')}, '|')", "rest": f"md5({text.strip_phones('text')})"},
       {"found": f"array_to_string(list_transform(regexp_extract_all(text, '{PHONE}'), lambda x: {squeeze('x')}), '|')",
        "rest": f"md5({squeeze(rep(rep(rep('text', PHONE, ' '), r'\s*\|\s*', ' '), r'\s+,', ','))})"}, "doc_id")
NUMBERS = ("SELECT k, number || CASE k % 6 WHEN 0 THEN ' Reported Balance $5' WHEN 1 THEN ' - *' WHEN 2 THEN '.; ' ELSE '' END AS t "
           "FROM fx_account")
CUT = "trim(regexp_replace(t, ' Reported Balance.*$', ''))"
WHOLE = rep(low("t"), "[^a-z0-9]")
TOKEN = f"coalesce(nullif(replace({WHOLE}, 'x', ''), ''), {WHOLE})"
scalar("n18_account_number", NUMBERS,
       {"clean": text.clean_account_number("t"), "key": text.account_number_key("t"), "tail4": text.number_tail("t"),
        "tail": text.solid_tail("t"), "incomplete": f"cast({text.incomplete_number('t')} AS int)"},
       {"clean": f"coalesce(nullif(trim({CUT}, ' :;,.'), ''), 'Not reported')",
        "key": f"coalesce(nullif({low(rep('t', r'[^A-Za-z0-9*\-\s]'))}, ''), 'not reported')",
        "tail4": f"right({rep('t', '[^0-9]')}, 4)",
        "tail": f"CASE WHEN length({TOKEN}) >= 6 THEN right({TOKEN}, 6) WHEN length({TOKEN}) >= 4 THEN right({TOKEN}, 4) ELSE {TOKEN} END",
        "incomplete": flag(f"{omissing(squeeze('t'))} OR regexp_matches(t, '[*#xX]') OR length({rep('t', '[^A-Za-z0-9]')}) < 6")})
SUFFIX = r"\b(?:" + "|".join(vocab.CORPORATE_SUFFIXES) + r")\b"
scalar("n19_institution_key", ACCOUNT, {"v": text.institution_key("name")},
       {"v": rep(rep(low("name"), SUFFIX), "[^a-z0-9]")})
LINES = "SELECT k, coalesce(comments, '') || '; ' || coalesce(status, '') || '|' || upper(coalesce(status, '')) || '; Repayment  plan' AS t FROM fx_account"
scalar("n20_split_unique", LINES, {"v": f"array_join({text.unique_ci(text.split_lines('t'))}, '~')"}, {
    "v": f"(SELECT string_agg(u, '~' ORDER BY o) FROM (SELECT first(x ORDER BY o) AS u, min(o) AS o FROM (SELECT {squeeze('unnest(p)')} AS x, "
         "generate_subscripts(p, 1) AS o FROM (SELECT regexp_split_to_array(t, '[;|]') AS p) q) r WHERE x <> '' GROUP BY lower(x)) z)"})
scalar("n21_first_meaningful", ACCOUNT, {"first_known": text.first_meaningful("s", "bal", "t"), "first_any": text.first_text("s", "bal", "t")},
       {"first_known": f"CASE WHEN NOT {omissing('s')} THEN s WHEN NOT {omissing('bal')} THEN bal ELSE t END",
        "first_any": "coalesce(nullif(s, ''), nullif(bal, ''), t)"})


@query("n22_field_state", """
    SELECT report_id, entity_key, CASE WHEN balance IS NULL THEN '' WHEN balance = '' THEN 'Not reported' ELSE balance END AS value,
      CASE WHEN balance IS NULL THEN 'missing_field' WHEN balance IN ('', 'Not reported') THEN 'present_explicit_not_reported'
           WHEN balance IN ('$0', '$0.00') THEN 'present_with_zero' ELSE 'present_with_value' END AS state FROM fx_account""")
def n22(b):
    state = money.field_state("raw", "array('currentBalance', 'balance', 'accountInfo.balance')")
    return b.tradelines().selectExpr("report_id", "entity_key", f"{state} AS f").selectExpr(
        "report_id", "entity_key", "f.value AS value", "f.state AS state")


scalar("n23_page_list", "SELECT k, CAST(k % 3 AS int) AS a, CAST(k % 5 - 1 AS int) AS b FROM fx_account",
       {"v": f"array_join({text.page_list('array(a, b, 0, a, 4)')}, ',')"},
       {"v": "array_to_string(list_filter([a, CASE WHEN b <> a THEN b END, CASE WHEN a <> 4 AND b <> 4 THEN 4 END], lambda x: x > 0), ',')"})
PAIRS = ("SELECT k, coalesce(balance, '') AS a, CASE k % 4 WHEN 0 THEN replace(coalesce(balance, ''), '$', '') "
         "WHEN 1 THEN upper(coalesce(balance, '')) WHEN 2 THEN coalesce(balance, '') || ' USD' ELSE coalesce(high, '$0') END AS b FROM fx_account")
CA, CB = rep("lower(a)", "[^a-z0-9]"), rep("lower(b)", "[^a-z0-9]")
DA, DB = rep("a", "[^0-9.]"), rep("b", "[^0-9.]")
scalar("n24_values_equal", PAIRS, {"v": f"cast({money.values_equal('a', 'b')} AS int)"},
       {"v": flag(f"(trim(a) <> '' AND trim(b) <> '' AND ({CA} = {CB} OR coalesce(abs({omoney('a')} - {omoney('b')}) < 0.005, false) "
                  f"OR ({DA} <> '' AND {DA} = {DB})))")})
FLAT = rep("lower(t)", "[^a-z0-9]")
scalar("n25_value_candidates", f"SELECT k, i, t FROM ({SPELLED}) z UNION ALL SELECT k, 9, coalesce(balance, '') FROM fx_account "
       "UNION ALL SELECT k, 10, name FROM fx_account",
       {"v": f"array_join(array_sort({evidence.value_candidates('t')}), '|')"},
       {"v": f"array_to_string(list_sort(list_distinct(list_filter([{low('t')}, {FLAT}, CASE WHEN contains(t, '$') THEN "
             f"{low("replace(replace(t, '$', ''), ',', '')")} ELSE '' END, {low("replace(t, ',', '')")}], lambda x: length(x) >= 4))), '|')"},
       "k, i")
scalar("n26_canonical_subscriber", "SELECT inquiry_ord, subscriber FROM fx_inquiry", {"v": text.canonical_subscriber("subscriber")},
       {"v": r"trim(regexp_replace(regexp_replace(" + low("subscriber") + r", ' promotional inquiry.*$', ''), '[\s,.;:]+$', ''))"}, "inquiry_ord")
scalar("n27_provenance_ids", "SELECT h.k, h.m, a.name, a.number, CAST(CAST(floor(h.m / 12.0) AS int) AS string) AS y "
       "FROM fx_hist h JOIN fx_account a ON a.k = h.k",
       {"field_id": text.field_provenance_id("name", "number", "'balance'"),
        "month_id": text.month_provenance_id("name", "number", "'paymentHistory'", "y", "cast(m % 12 + 1 AS string)")},
       {"field_id": "'account:' || lower(name) || '::' || CASE WHEN number = '' THEN 'Not reported' ELSE number END || ':field:balance'",
        "month_id": "'account:' || lower(name) || '::' || CASE WHEN number = '' THEN 'Not reported' ELSE number END "
                    "|| ':history:paymentHistory:' || y || ':' || CAST(m % 12 + 1 AS string)"}, "k, m")
SHOWN = ("SELECT k, CASE k % 8 WHEN 0 THEN '' WHEN 1 THEN '0' WHEN 2 THEN '$-5.00' WHEN 3 THEN '-12.50' WHEN 4 THEN 'Nov 2023' "
         "WHEN 5 THEN coalesce(balance, '') WHEN 6 THEN CAST(k AS string) ELSE 'PAST_DUE_ACCOUNT' END AS t, "
         "CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN '0' WHEN 2 THEN '1.16' WHEN 3 THEN '37.25%' ELSE CAST(k % 90 + 5 AS string) END AS p FROM fx_account")
scalar("n28_display", SHOWN,
       {"shown": money.money_display("t"), "pct": money.percent_display("p"), "human": money.humanised("t"),
        "absent": f"cast({money.not_reported('t')} AS int)", "plain": money.value_display("t")},
       {"shown": "CASE WHEN t = '' THEN '-' WHEN t = '0' THEN '$0' WHEN t LIKE '$-%' THEN '-$' || substr(t, 3) "
                 "WHEN regexp_matches(t, '[A-Za-z]') OR t LIKE '$%' THEN t WHEN t LIKE '-%' THEN '-$' || substr(t, 2) ELSE '$' || t END",
        "pct": "CASE k % 5 WHEN 0 THEN '-' WHEN 1 THEN '0.0%' WHEN 2 THEN '116.0%' WHEN 3 THEN '37.3%' ELSE p || '.0%' END",
        "human": "replace(t, '_', ' ')", "absent": flag("lower(t) = 'not reported'"), "plain": "coalesce(nullif(t, ''), '-')"})
# the letter in place i from the right starts at the position that is the sum of 26^0 to 26^i
LETTERS = " || ".join(f"CASE WHEN p >= {(26 ** (i + 1) - 1) // 25} THEN chr(CAST(65 + ((p - {(26 ** (i + 1) - 1) // 25}) // {26 ** i}) % 26 AS int)) ELSE '' END"
                      for i in range(11, -1, -1))
scalar("n29_exhibit_label", "SELECT k, CAST(CASE WHEN k % 3 = 0 THEN k + 1 WHEN k % 3 = 1 THEN k + 18200 ELSE k * 1000003 END AS bigint) AS p FROM fx_account",
       {"num": text.exhibit_label("p"), "letters": text.exhibit_label("p", "letter")},
       {"num": "CAST(p AS string)", "letters": LETTERS})
scalar("n30_stable_choice", ACCOUNT, {"v": text.stable_choice("report_id", "entity_key", 5)},
       {"v": "CAST(('0x' || substr(sha1(report_id || ':' || entity_key), 1, 8))::BIGINT % 5 AS int)"})
scalar("n31_fill_missing", "SELECT k, named_a, named_b, deep_a, deep_b FROM (SELECT k, status AS named_a, type_text AS named_b, "
       "balance AS deep_a, high AS deep_b FROM fx_account) z",
       {"top": text.fill_missing("named_a", "named_b"), "inner_value": text.fill_missing("deep_a", "deep_b")},
       {"top": "CASE WHEN named_a IS NULL OR named_a = '' THEN named_b ELSE named_a END",
        "inner_value": "CASE WHEN deep_a IS NULL OR deep_a = '' THEN deep_b ELSE deep_a END"})
BOXES = ("SELECT doc_id, line_no, word_no, CAST(word_no * 9.5 AS double) AS x, CAST(line_no * 12.0 AS double) AS y, "
         "CAST(length(word) * 5.0 AS double) AS w, CAST(10.0 AS double) AS h FROM fx_word")
A = "named_struct('x', x, 'y', y, 'width', w, 'height', h)"
B = "named_struct('x', 300.0D, 'y', 500.0D, 'width', 80.0D, 'height', 20.0D)"
U, K, S = evidence.box_union(A, B), evidence.box_clip(A, "612.0D", "792.0D"), evidence.box_scale(A, "2.0D", "1.5D")
scalar("n32_boxes", BOXES,
       {"uw": f"{U}.width", "uh": f"{U}.height", "cx": f"{K}.x", "cw": f"{K}.width", "ch": f"{K}.height", "sx": f"{S}.x", "sh": f"{S}.height",
        "near": f"cast({evidence.boxes_close(A, B, '36.0D', '26.0D')} AS int)"},
       {"uw": "greatest(x + w, 380.0) - least(x, 300.0)", "uh": "greatest(y + h, 520.0) - least(y, 500.0)",
        "cx": "CAST(round(greatest(0, least(612, x))) AS int)", "cw": "CAST(round(greatest(1, least(greatest(0, 612 - greatest(0, least(612, x))), w))) AS int)",
        "ch": "CAST(round(greatest(1, least(greatest(0, 792 - greatest(0, least(792, y))), h))) AS int)", "sx": "x * 2", "sh": "greatest(1, h * 1.5)",
        "near": flag("x <= 416.0 AND x + w >= 264.0 AND y <= 546.0 AND y + h >= 474.0")}, "doc_id, line_no, word_no")
PEOPLE = ("SELECT k, CASE k % 4 WHEN 0 THEN '' ELSE name END AS a, CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN name || ' Jr' ELSE 'J Doe' END AS b, "
          "CASE k % 3 WHEN 0 THEN 'PO Box ' || CAST(k AS string) || ', Dover, de 19901' WHEN 1 THEN '1 Elm St, Apt 2' "
          "ELSE CAST(k AS string) || ' Main St, Salem, OR 97301-' || lpad(CAST(k % 10000 AS string), 4, '0') END AS addr FROM fx_account")
P = text.address_parts("addr")
scalar("n33_name_address", PEOPLE, {"best": text.preferred_name("a", "b"), **{f"p_{f}": f"{P}.{f}" for f in ("line", "city", "state", "zip")}},
       {"best": "CASE WHEN a = '' THEN b WHEN b = '' THEN a WHEN b LIKE '% Jr' THEN b WHEN length(a) >= length(b) THEN a ELSE b END",
        "p_line": "CASE WHEN k % 3 = 1 THEN addr ELSE split_part(addr, ', ', 1) END",
        "p_city": "CASE k % 3 WHEN 0 THEN 'Dover' WHEN 1 THEN '' ELSE 'Salem' END",
        "p_state": "CASE k % 3 WHEN 0 THEN 'DE' WHEN 1 THEN '' ELSE 'OR' END",
        "p_zip": "CASE k % 3 WHEN 0 THEN '19901' WHEN 1 THEN '' ELSE right(addr, 10) END"})
LABELS = ("SELECT k, CASE k % 9 WHEN 0 THEN 'Closure-month payment history' WHEN 1 THEN 'Reported balance' WHEN 2 THEN 'balanceHistory' "
          "WHEN 3 THEN 'Status-updated date' WHEN 4 THEN 'Last-payment signal' WHEN 5 THEN 'Closed date' WHEN 6 THEN 'Past due amount' "
          "WHEN 7 THEN 'Balance updated' ELSE name END AS t FROM fx_account")
scalar("n34_citation_labels", LABELS, {"history_field": evidence.label_to_history_field("t"), "printed": evidence.printed_label("t")},
       {"history_field": "CASE k % 9 WHEN 0 THEN 'paymentHistory' WHEN 1 THEN 'balanceHistory' WHEN 2 THEN 'balanceHistory' "
                         "WHEN 6 THEN 'amountPastDueHistory' WHEN 7 THEN 'balanceHistory' END",
        "printed": "CASE k % 9 WHEN 1 THEN 'Reported Balance' WHEN 2 THEN 'Reported Balance' WHEN 3 THEN 'Date Reported' WHEN 4 THEN 'Date of Last Payment' "
                   "WHEN 5 THEN 'Date Closed' WHEN 6 THEN 'Amount Past Due' WHEN 7 THEN '' END"})
FACTS = ("SELECT k, 'Reported balance: ' || coalesce(balance, '') || ' on ' || coalesce(closed, 'Mar 5, 2020') || ' XXXX-XXXX-' || "
         "lpad(CAST(k % 100 AS string), 2, '0') AS t, coalesce(balance, '') AS bal FROM fx_account")
scalar("n35_fact_values", FACTS,
       {"labelled": f"array_join(transform(filter({evidence.fact_values('t')}, x -> x.label IN ('Reported balance', 'Date', 'Account number')), x -> concat(x.label, '=', x.value)), '|')",
        "weak": f"cast({evidence.low_signal('bal')} AS int)"},
       {"labelled": "'Reported balance=' || trim(substr(t, 19)) || '|Date=' || regexp_extract(t, '(?:[0-9]{2}/[0-9]{2}/[0-9]{4}|Mar 5, 2020)') || '|Account number=' || right(t, 2)",
        "weak": flag(f"{in_list('lower(bal)', vocab.LOW_SIGNAL_TOKENS)} OR length({rep('lower(bal)', '[^a-z0-9]')}) < 3")})

# --- classification -----------------------------------------------------------------
W = "lower(s || ' ' || cm || ' ' || ad)"
scalar("c1_collection_like", ACCOUNT,
       {"v": f"cast(lower(rc) = 'collection' OR {classify.collection_status('s', 'cm', 'ad')} AS int)"},
       {"v": flag(f"lower(rc) = 'collection' OR {any_word(W, vocab.COLLECTION_WORDS)}")})
scalar("c2_derogatory_status", ACCOUNT, {"v": f"cast({classify.derogatory_status('s')} AS int)"},
       {"v": flag(any_word("lower(s)", vocab.DEROGATORY_WORDS))})
scalar("c3_plan_context", ACCOUNT, {"v": f"cast({classify.plan_context('s', 'cm', 'ad')} AS int)"}, {"v": flag(any_word(W, vocab.PLAN_WORDS))})
KIND = "lower(s || ' ' || name || ' ' || t || ' ' || cm)"
scalar("c4_account_kind", ACCOUNT,
       {"installment": f"cast({classify.installment_like('s', 'name', 't', 'cm')} AS int)",
        "revolving": f"cast({classify.revolving_like('s', 'name', 't', 'cm')} AS int)"},
       {"installment": flag(any_word(KIND, vocab.INSTALLMENT_WORDS)), "revolving": flag(any_word(KIND, vocab.REVOLVING_WORDS))})
scalar("c5_student_loan", ACCOUNT, {"v": f"cast({classify.student_loan_like('t', "''", 'name', 'oc')} AS int)"},
       {"v": flag("t = 'Student Loan' OR (t = 'Installment Loan' AND k % 9 = 0)")})
CTX = "lower(name || ' ' || t || ' ' || s || ' ' || cm || ' ' || ad || ' ' || lc || ' ' || rc || ' ' || oc)"
CTX_IN = [*"name t s cm ad lc rc oc".split()]
scalar("c6_bankruptcy_litigation", ACCOUNT,
       {"bankrupt": f"cast({text.contains_any(text.joined(*CTX_IN), vocab.BANKRUPTCY_WORDS)} AS int)",
        "litigated": f"cast({text.contains_any(text.joined(*CTX_IN), vocab.LITIGATION_WORDS)} AS int)"},
       {"bankrupt": flag(any_word(CTX, vocab.BANKRUPTCY_WORDS)), "litigated": flag(any_word(CTX, vocab.LITIGATION_WORDS))})


VIEWS["fx_adverse"] = "SELECT report_id, CASE WHEN lay = 3 THEN 2 ELSE 1 END AS low, 4 AS high FROM fx_report WHERE lay > 0"


def adverse_pages(b):
    return b.sql("SELECT * FROM fx_adverse").selectExpr("report_id", "array(cast(low AS int), cast(high AS int)) AS adverse_pages")


@query("c7_posture", "SELECT report_id, entity_key, CASE WHEN neg OR (lay = 3 AND k % 5 + 1 IN (2, 4)) THEN 'negative' ELSE 'positive' END AS posture FROM ora_rule")
def c7(b):
    from tradeglass.plans.account_view import account_view
    from tradeglass.plans.findings import with_posture
    view = account_view(b.tradelines(), b.cells(), {"negative"}).select("report_id", "entity_key", "profile_id", "negative", "source_pages")
    return with_posture(view, adverse_pages(b)).select("report_id", "entity_key", "posture")


SOFT = ("SELECT k, CASE k % 6 WHEN 0 THEN 'Never late' WHEN 1 THEN '30 days late_payment' WHEN 2 THEN 'Charged-off' WHEN 3 THEN 'No delinquency' "
        "WHEN 4 THEN 'adverse item, paid as agreed' ELSE coalesce(status, '') END AS t, "
        "CASE k % 4 WHEN 0 THEN 'cls' WHEN 1 THEN 'OK' WHEN 2 THEN 'c/o' ELSE '90' END AS code FROM fx_account")
TX = "trim(regexp_replace(regexp_replace(lower(t), '[_-]+', ' ', 'g'), '\\s+', ' ', 'g'))"
scalar("c8_display_negative", SOFT,
       {"by_text": f"cast({classify.display_text_negative('t')} AS int)", "by_code": f"cast({classify.display_code_negative('code')} AS int)"},
       {"by_text": flag(f"regexp_matches({TX}, 'charged? off|\\bcollection\\b|bankruptcy|past due') OR (regexp_matches({TX}, '\\b(late|adverse|delinquen\\w*)\\b') "
                        f"AND NOT regexp_matches({TX}, 'never late|no delinquen|paid as agreed'))"),
        "by_code": flag("k % 4 <> 1")})
SUB = ("SELECT k, lower(CASE k % 8 WHEN 0 THEN 'Auto Lease' WHEN 1 THEN 'Child support order' WHEN 2 THEN 'Alimony' WHEN 3 THEN 'City Hospital' "
       "WHEN 4 THEN 'RentTrack apartment' WHEN 5 THEN 'Debt collector' WHEN 6 THEN 'Vehicle lease in bankruptcy' ELSE coalesce(status, '') END) AS t, "
       "lower(coalesce(status, '')) AS st FROM fx_account")
scalar("c9_subtype", SUB,
       {"subtype": classify.account_subtype("t"), "legal": classify.legal_category("t"), "reporting": classify.reporting_category("t")},
       {"subtype": "CASE k % 8 WHEN 0 THEN 'Auto Lease' WHEN 1 THEN 'Child Support' WHEN 2 THEN 'Family Support' WHEN 3 THEN 'Medical Debt' "
                   "WHEN 4 THEN 'Rental Agreement' WHEN 6 THEN 'Auto Lease' END",
        "legal": "CASE k % 8 WHEN 1 THEN 'child_support' WHEN 2 THEN 'family_support' WHEN 3 THEN 'medical_debt' WHEN 4 THEN 'rental_obligation' "
                 "WHEN 6 THEN 'bankruptcy' WHEN 7 THEN CASE WHEN st LIKE '%bankruptcy%' THEN 'bankruptcy' END END",
        "reporting": "CASE WHEN k % 8 = 5 OR (k % 8 = 7 AND st LIKE '%collection%') THEN 'collection' ELSE 'tradeline' END"})


@query("c10_closed", "SELECT report_id, entity_key, CAST(is_closed AS int) AS closed FROM ora_field")
def c10(b):
    from tradeglass.plans.account_view import with_anchors
    return with_anchors(b.tradelines(), {"is_closed"}).selectExpr("report_id", "entity_key", "cast(is_closed AS int) AS closed")


scalar("c11_usable_creditor", ACCOUNT, {"v": f"cast({classify.usable_creditor('oc', 'name', 't', "''", 's', 'cm')} AS int)"},
       {"v": flag("oc <> '' OR (NOT regexp_matches(lower(name || ' ' || s || ' ' || cm), 'midland|collection') "
                  "AND NOT ((t = 'Student Loan' OR t = 'Installment Loan') AND k % 9 = 0))")})
REPORT_TEXT = ("SELECT k, CASE k % 7 WHEN 0 THEN 'Equifax: Your Credit Report, consumer file notices, Confirmation # 7' WHEN 1 THEN 'EQUIFAX report' "
               "WHEN 2 THEN 'Experian At a Glance / Hard Inquiries' WHEN 3 THEN 'TransUnion credit report date file number: 5 personal information' "
               "WHEN 4 THEN 'Annual Credit Report - Experian' WHEN 5 THEN 'Report date; credit file status' ELSE name END AS t FROM fx_account")
scalar("c12_bureau_layout", REPORT_TEXT, {"bureau": classify.bureau_of("t"), "layout": classify.layout_of("t")},
       {"bureau": "CASE WHEN k % 7 IN (0, 1, 5) THEN 'Equifax' WHEN k % 7 IN (2, 4) THEN 'Experian' WHEN k % 7 = 3 THEN 'TransUnion' ELSE 'Unknown' END",
        "layout": "CASE k % 7 WHEN 0 THEN 'equifax_new_v1' WHEN 1 THEN 'equifax_old_v1' WHEN 2 THEN 'experian_acr_v1' WHEN 3 THEN 'transunion_acr_v1' "
                  "WHEN 4 THEN 'experian_acr_v1' END"})
PRINTED = ("SELECT doc_id, text || CASE doc_id % 5 WHEN 0 THEN ' Credit Accounts and Soft Inquiries' WHEN 1 THEN ' at a glance' WHEN 2 THEN ' Public Records: rental' "
           "WHEN 3 THEN '' ELSE ' medical collections' END AS t FROM documents")
SECTIONS = list(vocab.SECTION_PATTERNS)
scalar("c13_sections", PRINTED, {f"s_{s}": f"cast({classify.section_present('t', s)} AS int)" for s in SECTIONS},
       {f"s_{s}": flag(f"regexp_matches(t, '(?i{'m' if vocab.SECTION_PATTERNS[s][0].startswith('^') else ''}){'|'.join(vocab.SECTION_PATTERNS[s])}')") for s in SECTIONS}, "doc_id")
