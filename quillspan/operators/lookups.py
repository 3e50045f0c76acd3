"""Small fixed tables as map columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# How specific a type is when spans merge; others are 0.
SPECIFICITY = {
    **dict.fromkeys(("EMPLOYEE_ID", "CLIENT_ID", "CUSTOMER_ID", "CUSTOMER_REF", "PORTFOLIO_ID", "PROJECT_CODE", "ACCOUNT_NUMBER", "ADDRESS"), "3"),
    **dict.fromkeys(("DATE_OF_BIRTH", "EMAIL_ADDRESS", "EMAIL", "PHONE_NUMBER", "PHONE", "IP_ADDRESS", "CREDIT_CARD", "US_SSN", "GOVERNMENT_ID", "IBAN_CODE"), "2"),
    **dict.fromkeys(("PERSON", "LOCATION", "DATE_TIME", "URL"), "1"),
}
# Tier of a type; others are MEDIUM.
RISK = {
    **dict.fromkeys(("GOVERNMENT_ID", "US_SSN", "US_PASSPORT", "US_DRIVER_LICENSE", "MEDICAL_LICENSE", "CREDIT_CARD", "ACCOUNT_NUMBER", "IBAN_CODE", "CRYPTO_ADDRESS"), "CRITICAL"),
    **dict.fromkeys(("EMPLOYEE_ID", "CLIENT_ID", "CUSTOMER_ID", "CUSTOMER_REF", "PORTFOLIO_ID", "PROJECT_CODE", "EMAIL", "EMAIL_ADDRESS", "PHONE", "PHONE_NUMBER", "ADDRESS", "DATE_OF_BIRTH"), "HIGH"),
}
TIERS = ("CRITICAL", "HIGH", "MEDIUM")
# The name of a type in placeholders, where it differs.
CANONICAL = {"EMAIL_ADDRESS": "EMAIL", "PHONE_NUMBER": "PHONE", "US_SSN": "GOVERNMENT_ID", "IBAN_CODE": "ACCOUNT_NUMBER", "CUSTOMER_REF": "CUSTOMER_ID"}


def lookup(table: dict[str, str], default: str | None = None) -> Callable[[Column], Column]:
    """value of a key; of an unknown key the default, or the key itself."""
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return lambda c: F.coalesce(m[c], F.lit(default) if default is not None else c)


def clean_type(c: Column) -> Column:
    """Type names in one spelling: upper case, words joined by _, no blanks around."""
    return F.upper(F.regexp_replace(F.trim(c), r"[\s-]+", "_"))


def sql_case(column: str, table: dict[str, str], default: str) -> str:
    """The same table as a CASE expression of SQL."""
    by: dict[str, list[str]] = {}
    for k, v in table.items():
        by.setdefault(v, []).append(k)
    whens = " ".join(f"WHEN {column} IN ({', '.join(repr(k) for k in ks)}) THEN '{v}'" for v, ks in by.items())
    return f"CASE {whens} ELSE {default} END"
