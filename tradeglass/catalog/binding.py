"""A fixed reading of general tables as credit-report tables.

The views are SQL that Spark and DuckDB both accept, so the engine and its oracle
start from the same rows. Residues of keys choose field values (including absent
and empty ones); they never choose which rows are read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tradeglass.plans.account_view import entity_key
from tradeglass.session import stored

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def mdy(d: str) -> str:
    return (f"(lpad(CAST(month({d}) AS string),2,'0') || '/' || lpad(CAST(day({d}) AS string),2,'0') || '/' || "
            f"CAST(year({d}) AS string))")


def iso(d: str) -> str:
    return (f"(CAST(year({d}) AS string) || '-' || lpad(CAST(month({d}) AS string),2,'0') || '-' || "
            f"lpad(CAST(day({d}) AS string),2,'0'))")


def mon(d: str) -> str:
    return (f"(substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(month({d}) AS int) * 3 - 2, 3) || ' ' || "
            f"CAST(year({d}) AS string))")


def usd(x: str) -> str:
    return f"('$' || CAST(CAST({x} AS decimal(18,2)) AS string))"


def div(x: str, n: int) -> str:
    return f"CAST(floor({x} / {n}.0) AS bigint)"


PROFILE = "CASE n % 4 WHEN 0 THEN 'equifax_old_v1' WHEN 1 THEN 'experian_acr_v1' " \
          "WHEN 2 THEN 'equifax_new_v1' ELSE 'transunion_acr_v1' END"

VIEWS: dict[str, str] = {
    # customer x ship month, the volume of the history cells
    "fx_month": """
        SELECT k, CAST(year(d) * 12 + month(d) - 1 AS int) AS m, max(q) AS q,
               CAST(sum(price) AS decimal(18,2)) AS bal, max(disc) AS disc, max(tax) AS tax,
               CAST(max(ln) AS int) AS ln, CAST(max(d) AS date) AS last_day
        FROM (SELECT o.o_custkey AS k, CAST(l.l_shipdate AS date) AS d, l.l_quantity AS q,
                     CAST(l.l_extendedprice AS decimal(18,2)) AS price,
                     CAST(l.l_discount AS decimal(4,2)) AS disc, CAST(l.l_tax AS decimal(4,2)) AS tax,
                     l.l_linenumber AS ln
              FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey) x
        GROUP BY k, CAST(year(d) * 12 + month(d) - 1 AS int)""",
    "fx_span": """
        SELECT k, min(first_order) AS first_order, max(last_day) AS last_day
        FROM (SELECT o_custkey AS k, CAST(o_orderdate AS date) AS first_order, CAST(NULL AS date) AS last_day FROM orders
              UNION ALL SELECT k, NULL, last_day FROM fx_month) x
        GROUP BY k""",
    "fx_report": f"""
        SELECT CAST(n AS string) AS report_id, CAST(n % 4 AS int) AS lay, {PROFILE} AS profile_id, report_day,
               {iso('report_day')} AS report_date
        FROM (SELECT c.c_nationkey AS n,
                     CAST(make_date(CAST(year(max(s.last_day)) AS int) + 1, 1, 15) AS date) AS report_day
              FROM customer c JOIN fx_span s ON s.k = c.c_custkey GROUP BY c.c_nationkey) x""",
    "fx_account": f"""
        SELECT k, report_id, lay, profile_id, report_date, name, number, lower(name) || '::' || number AS entity_key,
               type_text, status, balance, past_due, charge_off, credit_limit, high, opened, reported, closed,
               status_updated, balance_updated, last_payment, payment, scheduled, terms, duration,
               original_creditor, dofd, removal, responsibility, address, phone, comments, months_reviewed,
               additional, legal_category, reporting_category, first_order, last_day
        FROM (SELECT c.c_custkey AS k, r.report_id, r.lay, r.profile_id, r.report_date, s.first_order, s.last_day,
            CASE c.c_custkey % 9 WHEN 0 THEN 'Navient ' WHEN 1 THEN 'Midland Funding ' WHEN 2 THEN 'First Bank '
              WHEN 3 THEN 'US ' ELSE '' END || c.c_name AS name,
            CASE c.c_custkey % 10 WHEN 0 THEN '' WHEN 1 THEN 'XXXX' || lpad(CAST(c.c_custkey % 100 AS string), 2, '0')
              WHEN 2 THEN 'Not reported' ELSE '550010' || lpad(CAST(c.c_custkey % 100 AS string), 2, '0') END AS number,
            CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 'Auto Loan' WHEN 'BUILDING' THEN 'Mortgage'
              WHEN 'FURNITURE' THEN 'Revolving Credit Card' WHEN 'HOUSEHOLD' THEN 'Student Loan'
              ELSE 'Installment Loan' END AS type_text,
            CASE c.c_custkey % 12 WHEN 0 THEN 'Charge off $1200.00' WHEN 1 THEN 'Collection account'
              WHEN 2 THEN 'Past due $75.00' WHEN 3 THEN 'Paid and closed' WHEN 4 THEN '' WHEN 5 THEN NULL
              WHEN 6 THEN 'Current' WHEN 7 THEN 'Pays as agreed' WHEN 8 THEN 'Settled'
              WHEN 9 THEN 'Included in bankruptcy chapter 7' WHEN 10 THEN 'Not reported' ELSE 'Open' END AS status,
            CASE {div('c.c_custkey', 3)} % 9 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'Not reported'
              WHEN 3 THEN '$0' ELSE {usd('c.c_acctbal')} END AS balance,
            CASE {div('c.c_custkey', 2)} % 7 WHEN 0 THEN {usd('c.c_acctbal + 1000')} WHEN 1 THEN '$0' WHEN 2 THEN ''
              ELSE NULL END AS past_due,
            CASE WHEN c.c_custkey % 11 = 0 THEN '$500.00' ELSE NULL END AS charge_off,
            CASE WHEN c.c_custkey % 5 = 0 THEN '$9000.00' WHEN c.c_custkey % 5 = 1 THEN '$4000.00' ELSE NULL END
              AS credit_limit,
            CASE c.c_custkey % 6 WHEN 0 THEN '$250000.00' WHEN 1 THEN '$10.00' ELSE NULL END AS high,
            CASE c.c_custkey % 13 WHEN 0 THEN NULL WHEN 1 THEN {mon('s.first_order')} ELSE {mdy('s.first_order')} END
              AS opened,
            CASE WHEN c.c_custkey % 8 = 0 THEN NULL ELSE {iso('s.last_day')} END AS reported,
            CASE WHEN c.c_custkey % 9 = 4 THEN {mdy('s.last_day')} ELSE NULL END AS closed,
            CASE {div('c.c_custkey', 5)} % 4 WHEN 0 THEN NULL WHEN 1 THEN {mon('s.first_order')}
              ELSE {mdy('s.last_day')} END AS status_updated,
            CASE {div('c.c_custkey', 7)} % 3 WHEN 0 THEN NULL WHEN 1 THEN {iso('s.first_order')}
              ELSE {mon('s.last_day')} END AS balance_updated,
            CASE WHEN {div('c.c_custkey', 4)} % 3 = 0 THEN {mdy('s.last_day')} ELSE NULL END AS last_payment,
            CASE {div('c.c_custkey', 6)} % 5 WHEN 0 THEN '$125.00' WHEN 1 THEN '$0' WHEN 2 THEN 'Not reported'
              ELSE NULL END AS payment,
            CASE {div('c.c_custkey', 8)} % 4 WHEN 0 THEN '$180.00' WHEN 1 THEN '' ELSE NULL END AS scheduled,
            CASE WHEN {div('c.c_custkey', 3)} % 2 = 0 THEN 'Monthly' ELSE NULL END AS terms,
            CASE WHEN c.c_custkey % 4 = 0 THEN '36 months' ELSE NULL END AS duration,
            CASE WHEN c.c_custkey % 6 = 1 THEN 'Chase Card Services' ELSE NULL END AS original_creditor,
            CASE c.c_custkey % 7 WHEN 0 THEN {mon('s.first_order')} WHEN 1 THEN {mdy('s.last_day')} ELSE NULL END AS dofd,
            CASE c.c_custkey % 7 WHEN 0 THEN 'Jan 2003' WHEN 1 THEN '05/2010' ELSE NULL END AS removal,
            CASE c.c_custkey % 5 WHEN 0 THEN 'Joint account' WHEN 1 THEN 'Individual' WHEN 2 THEN 'Authorized user'
              ELSE NULL END AS responsibility,
            CASE WHEN c.c_custkey % 3 = 0 THEN 'PO Box ' || CAST(c.c_custkey AS string) ELSE NULL END AS address,
            CASE WHEN c.c_custkey % 4 = 1 THEN '(743) 555-3824' ELSE '' END AS phone,
            CASE c.c_custkey % 14 WHEN 0 THEN 'Account in forbearance plan; Consumer disputes' WHEN 1 THEN 'Repayment plan'
              WHEN 2 THEN 'Account closed at request' ELSE NULL END AS comments,
            CASE WHEN c.c_custkey % 4 = 2 THEN '120 months' ELSE NULL END AS months_reviewed,
            CASE WHEN c.c_custkey % 17 = 0 THEN 'Account in litigation' ELSE NULL END AS additional,
            CASE WHEN c.c_custkey % 23 = 0 THEN 'bankruptcy' ELSE NULL END AS legal_category,
            CASE WHEN c.c_custkey % 19 = 0 THEN 'Collection' ELSE NULL END AS reporting_category
          FROM customer c JOIN fx_span s ON s.k = c.c_custkey
          JOIN fx_report r ON r.report_id = CAST(c.c_nationkey AS string)) x""",
    # month cells in wide form, one text column per series; NULL means no cell
    "fx_hist": f"""
        SELECT a.report_id, a.entity_key, a.lay, a.k, h.m,
            CASE WHEN q <= 26 THEN 'OK' WHEN q <= 30 THEN '30' WHEN q <= 34 THEN '60' WHEN q <= 37 THEN '90'
                 WHEN q <= 39 THEN '120' WHEN q <= 41 THEN 'CO' WHEN q <= 43 THEN 'COL' WHEN q <= 45 THEN 'TNT'
                 WHEN q <= 48 THEN 'X' ELSE 'ND' END AS status,
            CASE WHEN a.k % 14 = 5 OR (a.k % 5 = 2 AND h.m < 1997 * 12) OR (a.k % 3 = 0 AND h.m % 11 = 5) THEN NULL
                 WHEN h.m % 13 = 7 THEN 'Not reported' ELSE {usd('bal')} END AS balance,
            CASE WHEN disc >= 0.04 THEN {usd('bal * disc')} ELSE '-' END AS paid,
            CASE WHEN a.lay = 2 THEN CASE WHEN disc >= 0.04 THEN {usd('bal * disc')} ELSE '-' END
                 WHEN ln >= 4 THEN '$' || CAST(ln * 25 AS string) ELSE '' END AS scheduled,
            CASE WHEN a.lay = 1 THEN NULL WHEN tax >= 0.07 AND a.k % 3 = 1 THEN {usd('bal * tax')} ELSE '$0' END AS past_due,
            CASE WHEN a.lay = 1 OR a.k % 2 = 1 THEN NULL ELSE '$' || CAST(5000 + ln * 500 AS string) END AS credit_limit,
            CASE WHEN a.lay = 2 THEN CASE WHEN disc >= 0.04 THEN {mdy('h.last_day')} ELSE '--' END ELSE NULL END
              AS last_payment_date,
            CASE WHEN a.lay = 1 AND disc >= 0.04 THEN {mdy('h.last_day')} ELSE NULL END AS paid_date,
            CASE WHEN disc >= 0.04 THEN h.last_day END AS pay_day,
            CASE WHEN a.lay = 1 AND a.k % 3 = 0 THEN 'projected_gap_slot' WHEN a.lay = 1 AND a.k % 3 = 1 THEN 'text'
              ELSE NULL END AS gap_source
        FROM fx_month h JOIN fx_account a ON a.k = h.k""",
    "fx_public_record": f"""
        SELECT CAST(c.c_nationkey AS string) AS report_id, CAST(o.o_orderkey AS bigint) AS record_ord,
            CASE substr(o.o_orderpriority, 1, 1) WHEN '1' THEN 'Chapter 7 Bankruptcy' WHEN '2' THEN 'Civil Judgment'
              WHEN '3' THEN 'Tax Lien' WHEN '4' THEN '' ELSE 'Small Claims' END AS record_type,
            CASE o.o_custkey % 5 WHEN 0 THEN 'Dismissed' WHEN 1 THEN 'Filed' WHEN 2 THEN 'Released, balance open'
              WHEN 3 THEN 'Discharged' ELSE '' END AS status,
            CASE WHEN o.o_orderkey % 4 = 0 THEN '' ELSE 'Court ' || CAST(o.o_orderkey % 7 AS string) END AS court,
            CASE WHEN o.o_orderkey % 6 = 0 THEN 'None' WHEN o.o_orderkey % 6 = 1 THEN ''
              ELSE 'REF-' || CAST(o.o_orderkey % 500 AS string) END AS reference_number,
            CASE WHEN o.o_orderkey % 9 = 0 THEN '' ELSE {mdy('CAST(o.o_orderdate AS date)')} END AS date_filed,
            CASE WHEN o.o_orderkey % 3 = 0 THEN {iso('CAST(o.o_orderdate AS date)')} ELSE '' END AS date_resolved,
            {usd('o.o_totalprice')} AS amount, CAST(o.o_orderdate AS date) AS day
        FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey""",
    "fx_inquiry": f"""
        SELECT CAST(c.c_nationkey AS string) AS report_id, CAST(o.o_orderkey AS bigint) AS inquiry_ord,
            CASE WHEN o.o_orderkey % 3 = 0 THEN 'fallback' ELSE 'primary' END AS source,
            CASE WHEN o.o_orderkey % 2 = 0 THEN 'hard' ELSE 'soft' END AS kind,
            CASE o.o_custkey % 4 WHEN 0 THEN 'Capital One Bank' WHEN 1 THEN 'Capital One' WHEN 2 THEN 'Discover'
              ELSE 'Discover Fin Svcs' END
              || CASE o.o_orderkey % 5 WHEN 0 THEN ' promotional inquiry 12' WHEN 1 THEN '. ' ELSE '' END AS subscriber,
            {mdy('CAST(o.o_orderdate AS date)')} AS inquiry_date,
            CASE WHEN o.o_orderkey % 4 = 1 THEN '' ELSE o.o_orderpriority END AS purpose,
            CAST(o.o_orderkey % 7 AS int) AS page
        FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey""",
    "fx_indicator": """
        SELECT CAST(s_nationkey AS string) AS report_id, CAST(s_suppkey AS bigint) AS ind_ord,
            CASE s_suppkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'D' ELSE '' END AS code,
            CASE s_suppkey % 4 WHEN 0 THEN 'Included in bankruptcy' WHEN 1 THEN 'Chapter 13 petition'
              WHEN 2 THEN '' ELSE 'Personally liable' END AS description,
            CASE WHEN s_suppkey % 4 < 2 THEN 'bankruptcy' ELSE '' END AS category,
            CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 'Customer#00000' || lpad(CAST(s_suppkey * 7 % 150 AS string), 3, '0') END
              AS linked_name,
            CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE '550010' || lpad(CAST(s_suppkey % 100 AS string), 2, '0') END
              AS linked_number
        FROM supplier""",
}
DIALECT_VIEWS: dict[str, dict[str, str]] = {
    # documents as printed pages: a line group is a page, a word keeps its place in its line
    "fx_line": {
        "spark": """SELECT doc_id, source, CAST(pos + 1 AS int) AS line_no, CAST(floor(pos / 12) + 1 AS int) AS page, line
                    FROM documents LATERAL VIEW posexplode(split(text, '\\n')) t AS pos, line""",
        "duck": """SELECT doc_id, source, CAST(pos AS int) AS line_no, CAST(floor((pos - 1) / 12.0) + 1 AS int) AS page, line
                   FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
                                generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) x""",
    },
    "fx_word": {
        "spark": """SELECT doc_id, page, line_no, CAST(pos + 1 AS int) AS word_no, word, lower(word) AS token
                    FROM fx_line LATERAL VIEW posexplode(split(line, ' ')) t AS pos, word WHERE word <> ''""",
        "duck": """SELECT doc_id, page, line_no, CAST(pos AS int) AS word_no, word, lower(word) AS token
                   FROM (SELECT doc_id, page, line_no, unnest(string_split(line, ' ')) AS word,
                                generate_subscripts(string_split(line, ' '), 1) AS pos FROM fx_line) x WHERE word <> ''""",
    },
}

# --- fixed values: raw key of each bound field per layout -----------------------
RAW_KEYS = {
    "type_text": ["accountType", "accountInfo.accountType", "accountType", "accountInfo.accountType"],
    "status": ["status", "accountInfo.status", "status", "accountInfo.payStatus"],
    "balance": ["balance", "accountInfo.balance", "balance", "accountInfo.balance"],
    "past_due": ["amountPastDue", "accountInfo.amountPastDue", "amountPastDue", "accountInfo.amountPastDue"],
    "charge_off": ["chargeOffAmount", "accountInfo.chargeOffAmount", "chargeOffAmount", "accountInfo.chargeOffAmount"],
    "credit_limit": ["creditLimit", "accountInfo.creditLimit", "creditLimit", "accountInfo.creditLimit"],
    "high": ["highCredit", "accountInfo.highestBalance", "highCredit", "accountInfo.highCredit"],
    "opened": ["dateOpened", "accountInfo.dateOpened", "dateOpened", "accountInfo.dateOpened"],
    "reported": ["dateReported", None, "dateReported", "accountInfo.dateUpdated"],
    "closed": ["dateClosed", "accountInfo.dateClosed", "dateClosed", "accountInfo.dateClosed"],
    "status_updated": ["statusUpdated", "accountInfo.statusUpdated", "dateOfLastActivity", None],
    "balance_updated": ["balanceUpdated", "accountInfo.balanceUpdated", None, None],
    "last_payment": ["lastPaymentDate", "accountInfo.lastPaymentDate", "dateOfLastPayment",
                     "accountInfo.lastPaymentMade"],
    "payment": ["actualPaymentAmount", "accountInfo.recentPayment", "actualPaymentAmount",
                "accountInfo.paymentReceived"],
    "scheduled": ["scheduledPaymentAmount", "accountInfo.monthlyPayment", "scheduledPaymentAmount",
                  "accountInfo.monthlyPayment"],
    "terms": ["termsFrequency", "accountInfo.terms", "termsFrequency", "accountInfo.terms"],
    "duration": ["termDuration", "accountInfo.termDuration", "termDuration", "accountInfo.termDuration"],
    "original_creditor": ["originalCreditorName", "accountInfo.originalCreditor", "originalCreditorName",
                          "accountInfo.originalCreditor"],
    "dofd": ["dateOfFirstDelinquency", "historicalInfo.dateOfFirstDelinquency", "dateOfFirstDelinquency",
             "accountInfo.dateOfFirstDelinquency"],
    "removal": ["onRecordUntil", "accountInfo.onRecordUntil", "onRecordUntil", "accountInfo.estimatedRemoval"],
    "responsibility": ["responsibility", "accountInfo.responsibility", "owner", "accountInfo.responsibility"],
    "address": ["address", "contactInfo.address", "address", "contactInfo.address"],
    "phone": ["phoneNumber", "contactInfo.phoneNumber", "phoneNumber", "contactInfo.phoneNumber"],
    "months_reviewed": ["monthsReviewed", "accountInfo.monthsReviewed", "monthsReviewed",
                        "accountInfo.monthsReviewed"],
    "additional": ["additionalInformation"] * 4,
    "legal_category": ["legalCategory"] * 4,
    "reporting_category": ["reportingCategory"] * 4,
}
CELL_SERIES = ["status", "balance", "paid", "scheduled", "past_due", "credit_limit", "last_payment_date", "paid_date"]


def with_views(sql: str, dialect: str, extra: dict[str, str] | None = None, without: frozenset[str] = frozenset()) -> str:
    """Prefix a query with the CTEs of every bound view it names, in dependency order, but for those that are tables already."""
    library = {**VIEWS, **{k: v[dialect] for k, v in DIALECT_VIEWS.items()}, **(extra or {})}
    library = {k: v for k, v in library.items() if k not in without}
    order: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\b(?:fx|ora)_\w+", text):
            if name in library and name not in order:
                need(library[name])
                if name not in order:
                    order.append(name)

    need(sql)
    if not order:
        return sql
    return "WITH " + ",\n".join(f"{name} AS ({library[name]})" for name in order) + "\n" + sql


class Bound:
    """The bound input tables of one data folder, as the engine's declared inputs."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self.written: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        full = with_views(text, "spark", without=frozenset(self.written))
        for name in TABLES:
            if re.search(rf"\b{name}\b", full):
                self.table(name).createOrReplaceTempView(name)
        for name, rows in self.written.items():
            if re.search(rf"\b{name}\b", full):
                rows.createOrReplaceTempView(name)
        return self.spark.sql(full)

    def share(self, *names: str) -> Bound:
        """Write views that a query reads more than once, each once, in the given order; they are read from there on."""
        for name in names:
            if name not in self.written:
                self.written[name] = stored(self.view(name), name)
        return self

    def shared_history(self) -> Bound:
        """The month, span and account views, which accounts, cells and duplicates of a query all read."""
        return self.share("fx_month", "fx_span", "fx_account")

    def view(self, name: str) -> DataFrame:
        return self.sql(f"SELECT * FROM {name}")

    def tradelines(self) -> DataFrame:
        def key(names: list[str | None]) -> str:
            cases = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names) if n)
            return f"CASE lay {cases} END"

        entries = ", ".join(f"named_struct('k', {key(names)}, 'v', {col})" for col, names in RAW_KEYS.items())
        return self.view("fx_account").selectExpr(
            "report_id", "profile_id", "report_date", "cast(k AS int) AS account_ord", "name AS account_name",
            "number AS account_number", f"{entity_key('name', 'number')} AS entity_key",
            f"map_from_entries(filter(array({entries}), e -> e.k IS NOT NULL AND e.v IS NOT NULL)) AS raw",
            "if(comments IS NOT NULL, split(comments, '; '), cast(array() AS array<string>)) AS comments",
            "array(cast(k % 5 + 1 AS int)) AS source_pages",
        )

    def cells(self) -> DataFrame:
        entry = "named_struct('series', '{s}', 'm', {m}, 'v', {v}, 'state', {state}, 'source', {source})"
        items = [entry.format(s=s, m="m", v=s, state="''", source="''") for s in CELL_SERIES]
        items.append(entry.format(s="gap_slot", m="m + 1", v="if(gap_source IS NULL, NULL, '')",
                                  state="'missing_slot'", source="coalesce(gap_source, '')"))
        return self.view("fx_hist").selectExpr(
            "report_id", "entity_key", f"inline(filter(array({', '.join(items)}), e -> e.v IS NOT NULL))",
        ).withColumnRenamed("v", "value_text").selectExpr("*", "0 AS ord")

    def public_records(self) -> DataFrame:
        return self.view("fx_public_record")

    def inquiries(self) -> DataFrame:
        return self.view("fx_inquiry")

    def indicators(self) -> DataFrame:
        return self.view("fx_indicator")

