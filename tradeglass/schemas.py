"""Declared schemas of the input tables; nothing is inferred on read."""

CELL = ("report_id string, entity_key string, series string, m int, value_text string, "
        "state string, source string, provenance_id string, ord int")
TRADELINE = ("report_id string, profile_id string, report_date string, account_ord int, account_name string, "
             "account_number string, entity_key string, raw map<string,string>, comments array<string>, "
             "source_pages array<int>")
DATED_ENTRY = "report_id string, entity_key string, date string, balance string, scheduled_payment string, paid string"
PUBLIC_RECORD = ("report_id string, record_ord int, record_type string, status string, court string, "
                 "reference_number string, amount string, date_filed string, date_resolved string, "
                 "summary string, details array<string>")
INDICATOR = ("report_id string, ind_ord int, code string, description string, category string, "
             "linked_name string, linked_number string")
INQUIRY = "report_id string, inquiry_ord int, source string, kind string, subscriber string, inquiry_date string, purpose string, pages array<int>"
PERSONAL = "report_id string, name string, addresses array<string>, ssns array<string>"
INTAKE = "report_id string, full_legal_name string, line1 string, line2 string, city string, state string, zip string"
WORD = ("report_id string, page int, line_no int, word_no int, text string, token string, "
        "x double, y double, width double, height double")

