"""Word lists, codes, patterns and lookup tables.

Everything in this file is data that results depend on; nothing here is logic.
"""

# --- fixed values: field and history tokens -------------------------------
MISSING_TOKENS = [
    "", "-", "--", "---", "blank", "n/a", "n/r", "no data", "none",
    "none reported", "not reported", "not available", "unknown",
]
BLANK_CODES = ["", "-", "--", "---", "x", "nd", "not reported", "not available", "unknown"]
CURRENT_CODES = ["ok", "current", "paid as agreed", "terms met"]
DEROGATORY_CODES = ["30", "60", "90", "120", "150", "180", "c", "col", "co", "r", "f", "v", "b", "vs"]
SEVERE_CODES = ["60", "90", "120", "150", "180", "c", "col", "co", "r", "f", "v", "b", "vs"]
CHARGE_OFF_CODES = ["c", "col", "co"]
SEVERITY_RANK = {
    "30": 1, "60": 2, "90": 3, "120": 4, "150": 5, "180": 6,
    "c": 7, "col": 7, "co": 8, "r": 9, "f": 9, "v": 9, "b": 9, "vs": 9,
}
EXPLICIT_NOT_REPORTED = [
    "not reported", "not provided", "none reported", "not available", "not applicable", "n/a", "na",
]
STATUS_LEGEND = {
    "30": "30 days late",
    "60": "60 days late",
    "90": "90 days late",
    "120": "120 days late",
    "150": "150 days past due",
    "180": "180 days past due",
    "OK": "Payment made on time",
    "COL": "In collections",
    "C": "Collection account",
    "CO": "Charge-off",
    "R": "Repossession",
    "F": "Foreclosure",
    "V": "Voluntary surrender",
    "B": "Included in bankruptcy",
    "TNT": "Too new to rate",
    "X": "No data available",
}
GRID_TOKENS = ["OK", "ND", "CO", "COL", "C", "R", "F", "V", "VS", "B", "CLS", "TNT", "X",
               "30", "60", "90", "120", "150", "180"]
DISPLAY_NEGATIVE_CODES = ["30", "60", "90", "120", "150", "180", "CO", "C/O", "COL", "R", "F", "B",
                          "V", "VS", "RPO", "CLS"]

# --- fixed values: context words -------------------------------------------
COLLECTION_WORDS = ["collection", "placed for collection", "collection account", "debt buyer", "factoring company"]
DEROGATORY_WORDS = ["past due", "charge off", "charged off", "collection", "repo", "repossession",
                    "foreclosure", "written off", "delinquen", "late"]
PLAN_WORDS = ["payment plan", "payment arrangement", "repayment plan", "installment arrangement",
              "settlement", "settled", "deferred", "forbearance"]
LITIGATION_WORDS = ["account in litigation", "in litigation", "litigation"]
RESTRICTED_WORDS = ["vacated", "dismissed", "withdrawn", "sealed", "expunged", "released", "satisfied"]
ADVERSE_WORDS = ["open", "pending", "filed", "active", "unsatisfied", "judgment", "bankruptcy"]
BANKRUPTCY_WORDS = ["bankruptcy", "chapter 7", "chapter 11", "chapter 13",
                    "included in bankruptcy", "discharged through bankruptcy"]
INSTALLMENT_WORDS = ["installment", "mortgage", "student", "loan", "auto", "personal"]
REVOLVING_WORDS = ["revolving", "credit card", "card", "line of credit"]
THIRD_PARTY_WORDS = ["collection", "recovery", "portfolio", "midland", "lvnv", "cavalry",
                     "credit management", "debt buyer", "asset acceptance", "resurgent", "allianceone"]
STUDENT_SERVICER_WORDS = ["dept of ed", "department of education", "us dept of education",
                          "u.s. dept of education", "aidv", "aidvantage", "navient", "nelnet", "mohela",
                          "edfinancial", "fedloan", "great lakes", "sallie mae", "aes/pheaa", "pheaa"]
STUDENT_TYPE_WORDS = ["student loan", "education loan", "education", "student"]
NON_STUDENT_WORDS = ["auto loan", "auto", "lease", "mortgage", "credit card", "card", "collection",
                     "revolving", "secured", "line of credit", "personal loan", "personal",
                     "debt buyer", "factoring"]
RESPONSIBILITY_WORDS = ["joint", "authorized user", "authorized", "co-borrower", "co signer", "cosigner"]
CLOSED_WORDS = ["closed", "paid and closed", "closed or paid"]
#: A heading that the text reader can take for an account's name.
NOT_A_NAME = r"(?i)^(?:summary|account details|\[|\]|not reported|\d+\.\s*(?:revolving|mortgage|installment|other)\s+accounts?)$"
ACTIVE_WORDS = ["current", "open", "paid as agreed", "ok"]
CORPORATE_SUFFIXES = ["bank", "na", "n a", "usa", "us", "llc", "inc", "corp", "corporation", "company",
                      "co", "financial", "finance", "svc", "svcs", "services", "service", "trust",
                      "association", "ssb", "fsb"]
PURPOSE_PHRASES = ["id report", "direct to consumer report", "promotional inquiry", "insurance inquiry",
                   "account review inquiry", "credit report"]

# --- fixed values: display-level negative words (regular expressions) --------
HARD_NEGATIVE = [
    r"\bcharge(?:d)? off\b",
    r"\bcollection\b",
    r"\bbankruptcy\b",
    r"\brepossession\b",
    r"\bforeclosure\b",
    r"\bpast due\b",
    r"\bpublic record\b",
]
SOFT_NEGATIVE = [
    r"\blate\b",
    r"\bdelinquen\w*\b",
    r"\bderogatory\b",
    r"\badverse\b",
]
NEGATIVE_OVERRIDE = [
    r"\bno late\b",
    r"\bnever late\b",
    r"\bnot late\b",
    r"\bno delinquen\w*\b",
    r"\bnever delinquen\w*\b",
    r"\bnot delinquen\w*\b",
    r"\bno derogatory\b",
    r"\bnot derogatory\b",
    r"\bno adverse\b",
    r"\bnot adverse\b",
    r"\bpaid as agreed\b",
    r"\bcurrent account\b",
]

# --- fixed values: account subtypes in order of precedence -------------------
SUBTYPES = [
    ("Auto Lease", None, [
        r"\bauto lease\b",
        r"\bvehicle lease\b",
    ]),
    ("Child Support", "child_support", [
        r"\bchild support\b",
    ]),
    ("Family Support", "family_support", [
        r"\bfamily support\b",
        r"\balimony\b",
        r"\bspousal support\b",
    ]),
    ("Medical Debt", "medical_debt", [
        r"\bmedical\b",
        r"\bhospital\b",
        r"\bclinic\b",
        r"\bhealth\b",
        r"\bphysician\b",
        r"\bdoctor\b",
    ]),
    ("Rental Agreement", "rental_obligation", [
        r"\brental agreement\b",
        r"\brent(?:track|report|reporting)?\b",
        r"\brental history\b",
        r"\blandlord\b",
        r"\bproperty management\b",
        r"\bapartment\b",
    ]),
]
#: Texts that are no collection agency.
NOT_AN_AGENCY = [
    r"collections?\s+stay\s+on\s+your",
    r"view detailed information",
    r"how to dispute",
]
COLLECTION_CONTEXT = [
    r"\bcollection\b",
    r"\bdebt collector\b",
]
BANKRUPTCY_CONTEXT = [
    r"\bbankruptcy\b",
    r"included in bankruptcy",
]

# --- fixed values: layouts ----------------------------------------------------
LAYOUTS = ["equifax_old_v1", "experian_acr_v1", "equifax_new_v1", "transunion_acr_v1"]
#: Layouts in the order they are tried, each with the sets of phrases that name it.
LAYOUT_PHRASES = [
    ("transunion_acr_v1", [
        ["personal credit report for:", "visit transunion.com/dispute"],
        ["personal credit report for:", "annualcreditreport.transunion.com/dss/disclosure.page"],
        ["transunion", "credit report date", "file number:", "personal information"],
    ]),
    ("experian_acr_v1", [
        ["annual credit report - experian"],
        ["experian", "at a glance", "hard inquiries"],
    ]),
    ("equifax_new_v1", [
        ["equifax", "your credit report", "consumer file notices", "confirmation #"],
    ]),
    ("equifax_old_v1", [
        ["equifax"],
    ]),
]
SECTION_PATTERNS = {
    "accounts": [
        r"\bcredit accounts\b",
        r"\baccounts with adverse information\b",
        r"\bsatisfactory accounts\b",
        r"\baccounts\b",
    ],
    "otherAccounts": [
        r"\bother accounts\b",
    ],
    "collections": [
        r"\bcollections\b",
        r"\bcollection accounts?\b",
        r"\bcollection agency\b",
        r"\boriginal creditor\b",
    ],
    "publicRecords": [
        r"\bpublic records\b",
        r"\bno public records reported\b",
    ],
    "consumerInformationIndicators": [
        r"\bconsumer information indicator\b",
        r"\bconsumer information indicators\b",
    ],
    "hardInquiries": [
        r"\bhard inquiries\b",
        r"\binquiry type\b",
    ],
    "softInquiries": [
        r"\bsoft inquiries\b",
    ],
    "accountReviewInquiries": [
        r"\baccount review inquiries\b",
    ],
    "creditReportMessages": [
        r"\bcredit report messages\b",
    ],
    "additionalInformation": [
        r"^\s*(?:\d+\.\s*)?additional information\b\s*$",
    ],
    "personalInformation": [
        r"\bpersonal information\b",
        r"\bnames\b",
        r"\baddresses\b",
    ],
    "summary": [
        r"\bsummary\b",
        r"\bat a glance\b",
        r"\bcredit file status\b",
    ],
    "bankruptcySignals": [
        r"\bbankruptcy\b",
        r"\bincluded in bankruptcy\b",
    ],
    "supportObligationSignals": [
        r"\bchild support\b",
        r"\bfamily support\b",
        r"\balimony\b",
    ],
    "rentalSignals": [
        r"\brental\b",
        r"\bapartment\b",
        r"\blease\b",
    ],
    "medicalSignals": [
        r"\bmedical\b",
    ],
}
LAYOUT_COVERAGE = {
    "equifax_old_v1": [
        "summary", "personalInformation", "accounts", "otherAccounts", "collections", "publicRecords",
        "bankruptcySignals", "medicalSignals", "hardInquiries", "softInquiries",
    ],
    "equifax_new_v1": [
        "summary", "personalInformation", "accounts", "collections", "publicRecords",
        "supportObligationSignals", "rentalSignals", "medicalSignals", "hardInquiries", "softInquiries",
    ],
    "transunion_acr_v1": [
        "summary", "personalInformation", "publicRecords", "accounts", "hardInquiries", "softInquiries",
        "accountReviewInquiries", "creditReportMessages", "additionalInformation", "collections",
        "consumerInformationIndicators", "bankruptcySignals", "supportObligationSignals",
        "rentalSignals", "medicalSignals",
    ],
    "experian_acr_v1": [
        "summary", "personalInformation", "accounts", "publicRecords", "collections",
        "consumerInformationIndicators", "hardInquiries", "softInquiries", "bankruptcySignals",
        "supportObligationSignals", "rentalSignals", "medicalSignals",
    ],
}
SUMMARY_TYPES = ["Revolving", "Mortgage", "Installment", "Other", "Total"]

# --- fixed values: printed labels --------------------------------------------
TABLE_TITLES = {
    "balance": "balance",
    "scheduled payment": "scheduled",
    "actual payment": "paid",
    "amount paid": "paid",
    "credit limit": "credit_limit",
    "amount past due": "past_due",
    "past due": "past_due",
    "activity designator": "activity_designator",
    "payment history": "status",
    "high credit": "high_credit",
    "remarks": "remarks",
    "last payment date": "last_payment_date",
    "payment amount": "paid",
}
PAIR_LABELS = {
    "account number": "accountNumber",
    "reported balance": "balance",
    "balance": "currentBalance",
    "account status": "accountStatus",
    "high credit": "highCredit",
    "highest balance": "highestBalance",
    "payment responsibility": "paymentResponsibility",
    "credit limit": "creditLimit",
    "account type": "accountType",
    "terms frequency": "termsFrequency",
    "term duration": "termDuration",
    "date opened": "dateOpened",
    "date reported": "dateReported",
    "date closed": "dateClosed",
    "last payment date": "lastPaymentDate",
    "date of last payment": "lastPaymentDate",
    "date of last activity": "dateOfLastActivity",
    "date of first delinquency": "dateOfFirstDelinquency",
    "delinquency first reported": "delinquencyFirstReported",
    "amount past due": "amountPastDue",
    "charge off amount": "chargeOffAmount",
    "loan type": "loanType",
    "responsibility": "responsibility",
    "months reviewed": "monthsReviewed",
    "activity designator": "activityDesignator",
    "actual payment amount": "actualPaymentAmount",
    "scheduled payment amount": "scheduledPaymentAmount",
    "comments": "comments",
    "contact": "contact",
}
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
MONTH_NAMES = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4,
    "may": 5, "jun": 6, "june": 6, "jul": 7, "july": 7, "aug": 8, "august": 8, "sep": 9, "sept": 9,
    "september": 9, "oct": 10, "october": 10, "nov": 11, "november": 11, "dec": 12, "december": 12,
}

# --- fixed values: rule categories and defaults --------------------------------
CATEGORY_RANK = {
    "attorney_escalation": 0, "payment_history": 1, "balance_amount": 2, "charge_off_collection": 3,
    "legal_public_record": 4, "date_reporting_timeline": 5, "account_identity": 6,
    "tradeline_integrity": 7, "personal_information": 8, "report_review": 9,
}
CATALOG_CATEGORY_ORDER = ["account_identity", "payment_history", "balance_amount", "charge_off_collection",
                          "legal_public_record", "date_reporting_timeline"]
SEVERITY_ORDER = {"high": 0, "medium": 1, "low": 2}
STATUS_ORDER = {"triggered": 0, "insufficient_evidence": 1, "not_triggered": 2, "not_applicable": 3}
DEMOTED_ISSUES = {
    "missing_payment_history": "1681g",
    "payment_history_missing_months": "1681g",
    "payment_history_incomplete_since_open_date": "1681g",
    "missing_account_number": "1681g",
}
ESCALATED_ISSUES = ["multiple_social_security_numbers"]

MONEY_PATTERN = r"-?\$?\d[\d,]*(?:\.\d{2})?"
PHONE_PATTERN = r"(?:\+?1[\s.-]*)?(?:\(\d{3}\)|\d{3})[\s.-]*\d{3}[\s.-]*\d{4}"

# --- fixed values: evidence labels, most specific keyword first -----------------
COMPARISON_KEYWORDS = {
    "actual payment": "actualPaymentHistory",
    "table activity": "actualPaymentHistory",
    "amount paid": "actualPaymentHistory",
    "scheduled payment": "scheduledPaymentHistory",
    "amount past due": "amountPastDueHistory",
    "past due": "amountPastDueHistory",
    "past-due": "amountPastDueHistory",
    "credit limit": "creditLimitHistory",
    "high credit": "highCreditHistory",
    "payment history": "paymentHistory",
    "rating": "paymentHistory",
    "balance": "balanceHistory",
}
HISTORY_FIELDS = ["balanceHistory", "balanceHistoryGapSlots", "scheduledPaymentHistory", "actualPaymentHistory",
                  "creditLimitHistory", "amountPastDueHistory", "paymentHistory", "paymentHistoryGapSlots"]
PRINTED_LABELS = {
    "dateclosed": "Date Closed", "closeddate": "Date Closed", "recentpayment": "Actual Payment Amount",
    "actualpaymentamount": "Actual Payment Amount", "scheduledpaymentamount": "Scheduled Payment Amount",
    "lastpaymentdate": "Date of Last Payment", "lastpayment": "Date of Last Payment",
    "statusupdated": "Date Reported", "datereported": "Date Reported", "status": "Account Status",
    "accountstatus": "Account Status", "balanceupdated": "", "balance": "Reported Balance",
    "currentbalance": "Reported Balance", "amountpastdue": "Amount Past Due",
    "chargeoffamount": "Charge Off Amount", "accountnumber": "Account Number", "dateopened": "Date Opened",
    "closuretiming": "Date of Last Payment", "paymentamount": "Actual Payment Amount",
    "dateoffirstdelinquency": "Date of First Delinquency", "monthsreviewed": "Months Reviewed",
    "indicatorcode": "", "indicatordescription": "", "indicatorcategory": "", "legalcategory": "",
    "linkedaccountlegalcategory": "", "linkedaccountname": "",
}
CITATION_KEYWORDS = {
    "closed date": "dateclosed", "closure timing": "closuretiming", "last-payment": "lastpaymentdate",
    "last payment": "lastpaymentdate", "balance-updated": "balanceupdated", "balance updated": "balanceupdated",
    "status-update": "statusupdated", "status update": "statusupdated", "status updated": "statusupdated",
    "date reported": "datereported", "status": "status", "actual payment": "actualpaymentamount",
    "scheduled payment": "scheduledpaymentamount", "past due": "amountpastdue", "past-due": "amountpastdue",
    "charge off": "chargeoffamount", "charge-off": "chargeoffamount", "account number": "accountnumber",
    "payment amount": "paymentamount", "first delinquency": "dateoffirstdelinquency",
    "months reviewed": "monthsreviewed", "indicator code": "indicatorcode",
    "indicator description": "indicatordescription", "indicator category": "indicatorcategory",
    "legal category": "legalcategory", "linked account name": "linkedaccountname", "balance": "balance",
}
LOW_SIGNAL_TOKENS = ["", "-", "--", "---", "blank", "n/a", "n/r", "none", "none reported", "not available",
                     "not provided", "not reported", "unknown"]
PLACEHOLDERS = ["", "-", "not reported", "not available", "none", "null"]
EXPORT_SOURCES = ["layout", "inferred_gap", "pdf", "inferred_blank"]
FACT_DATE_PATTERN = (r"(?i)\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)"
                     r"[a-z]*[\s,.-]+\d{1,2}(?:[\s,.-]+\d{2,4})?)\b")
MASKED_NUMBER_PATTERN = r"(?i)(?:x|#|\*){2,}[-\s]?(?:x|#|\*){2,}[-\s]?(\d{2,6})"

# --- fixed values: printed labels of public-record details, in the order they are tried ---
PUBLIC_RECORD_LABELS = [
    ("record type", "record_type"),
    ("type", "record_type"),
    ("court name", "court"),
    ("court", "court"),
    ("reference number", "reference_number"),
    ("file number", "reference_number"),
    ("status", "status"),
    ("amount", "amount"),
    ("date filed", "date_filed"),
    ("filed date", "date_filed"),
    ("date resolved", "date_resolved"),
    ("resolved date", "date_resolved"),
    ("date paid", "date_paid"),
    ("paid date", "date_paid"),
    ("address", "address"),
    ("phone number", "phone"),
    ("phone", "phone"),
    ("court type", "court_type"),
    ("date updated", "date_updated"),
    ("estimated month and year that this item will be removed", "estimated_removal"),
    ("estimated month and year this item will be removed", "estimated_removal"),
    ("estimated removal", "estimated_removal"),
    ("on record until", "estimated_removal"),
    ("plaintiff attorney", "plaintiff_attorney"),
    ("responsibility", "responsibility"),
    ("liability", "liability"),
]

# --- fixed values: rules with their issue types and labels -------------------
RULE_NAMES = {
    "r01": ("duplicate_conflicting_tradeline", "Conflicting tradeline reporting"),
    "r02": ("missing_account_number", "Incomplete account identifier"),
    "r03": ("missing_furnisher_identification", "Incomplete furnisher identification"),
    "r04": ("missing_account_status", "Account status is incomplete"),
    "r05": ("incomplete_original_creditor_identity", "Original creditor identity is incomplete"),
    "r06": ("student_loan_lender_identity_mismatch", "Student-loan lender identity is incomplete"),
    "r07": ("responsibility_requires_special_handling", "Responsibility designation requires review"),
    "r08": ("account_in_litigation", "Account is reported in litigation"),
    "r09": ("missing_payment_history", "Payment history is missing"),
    "r10": ("derogatory_status_without_monthly_support", "Derogatory reporting lacks monthly support"),
    "r11": ("payment_history_missing_months", "Payment history has missing months"),
    "r12": ("payment_history_activity_before_table_coverage", "Derogatory history predates supporting table coverage"),
    "r13": ("payment_history_incomplete_since_open_date", "Payment history from date opened is incomplete"),
    "r14": ("monthly_payment_missing_for_open_installment", "Monthly payment is incomplete"),
    "r15": ("recent_payment_missing_when_history_implies_payment", "Recent payment details are incomplete"),
    "r16": ("payment_history_24_month_past_due_conflict", "Payment history conflicts with past-due history"),
    "r17": ("payment_history_24_month_activity_conflict", "Payment history is incomplete relative to 24 month history"),
    "r18": ("past_due_without_monthly_support", "Past-due reporting lacks monthly support"),
    "r19": ("amount_past_due_history_conflict", "Past-due history conflicts with payment history"),
    "r20": ("delinquency_progression_inconsistency", "Delinquency progression is inconsistent"),
    "r21": ("thirty_day_late_without_full_30_day_interval", "30-day late does not reflect a full 30-day interval"),
    "r22": ("severe_delinquency_jump_without_predecessor_support", "Severe delinquency jump lacks predecessor support"),
    "r23": ("reaging_jump_after_current_reset", "Delinquency jumps after a current reset"),
    "r24": ("first_30_day_late_without_prior_reporting_support", "First 30-day late lacks prior reporting support"),
    "r25": ("first_derogatory_month_without_prior_reporting_support", "First derogatory month lacks prior reporting support"),
    "r26": ("blank_gap_before_derogatory_month", "Blank gap appears before a derogatory month"),
    "r27": ("retroactive_derogatory_backfill_after_reporting_gap", "Derogatory reporting appears after a long gap"),
    "r28": ("charge_off_or_collection_without_monthly_build_up", "Charge-off or collection reporting lacks monthly buildup"),
    "r29": ("payment_plan_or_forbearance_context_without_history", "Payment-plan or forbearance context lacks history"),
    "r30": ("payment_plan_or_forbearance_context_with_derogatory_conflict", "Payment-plan or forbearance context conflicts with derogatory reporting"),
    "r31": ("payment_activity_conflicts_with_delinquency_progression", "Payment activity conflicts with delinquency progression"),
    "r32": ("balance_reduction_conflicts_with_worsening_delinquency", "Balance reduction conflicts with worsening delinquency"),
    "r33": ("last_payment_date_without_scheduled_payment_amount", "Last payment date lacks scheduled payment amount"),
    "r34": ("last_payment_date_without_payment_amount", "Last payment date lacks payment amount"),
    "r35": ("scheduled_payment_amount_without_terms", "Scheduled payment amount lacks terms"),
    "r36": ("closed_account_final_month_reporting_incomplete", "Closed account final-month reporting is incomplete"),
    "r37": ("closed_account_actual_payment_conflicts_with_closure_month_history", "Closed account actual payment conflicts with closure month"),
    "r38": ("high_balance_not_supported_by_history", "High balance is not supported by history"),
    "r39": ("payment_history_balance_history_conflict", "Balance history conflicts with payment activity"),
    "r40": ("balance_history_monthly_gap_conflict", "Balance history has unexplained monthly gaps"),
    "r41": ("credit_limit_not_supported_by_history", "Credit limit is not supported by history"),
    "r42": ("missing_current_balance_field", "Current balance field is missing"),
    "r43": ("insufficient_balance_history", "Balance history is incomplete"),
    "r44": ("charge_off_without_chargeoff_history", "Charge-off reporting lacks charge-off history"),
    "r45": ("collection_payment_activity_conflict", "Collection tradeline reflects payment activity"),
    "r46": ("date_of_first_delinquency_conflict", "Date of first delinquency conflicts with payment history"),
    "r47": ("status_updated_timeline_conflict", "Status-updated date conflicts with timeline"),
    "r48": ("balance_updated_timeline_conflict", "Balance-updated date conflicts with timeline"),
    "r49": ("on_record_until_conflict", "On-record-until date conflicts with delinquency date"),
    "r50": ("closed_account_missing_closure_timing", "Closed account lacks closure timing"),
    "r51": ("missing_reporting_date", "Reporting date is incomplete"),
    "r52": ("missing_status_updated_date", "Status-updated date is incomplete"),
    "r53": ("missing_balance_updated_date", "Balance-updated date is incomplete"),
}
