"""A contact table derived from ``customer``; the expressions read the same in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame

KEY_TEXT = "cast(c_custkey as string)"
CONTACTS = {
    "customer_id": "c_custkey + 10001",
    "contact": f"concat('P', translate({KEY_TEXT}, '0123456789', 'abcdefghij'), ' ', 'F', "
               f"translate({KEY_TEXT}, '0123456789', 'klmnopqrst'))",
    "email": f"concat('user', {KEY_TEXT}, '@example.com')",
    "phone_line": f"concat('+92-300-', lpad({KEY_TEXT}, 7, '0'))",
    "signup": "cast(cast('2024-01-01' as date) + cast(c_custkey % 365 as int) as string)",
    "site": f"concat('https://example.com/', {KEY_TEXT})",
    "price_text": f"concat('$', {KEY_TEXT}, '.50')",
    "active": "case when c_custkey % 3 = 0 then 'yes' else 'no' end",
    "taxpayer": "concat(lpad(cast(c_custkey % 900 + 100 as string), 3, '0'), '-', lpad(cast(c_custkey % 90 + 10 as "
                "string), 2, '0'), '-', lpad(cast(c_custkey % 9000 as string), 4, '0'))",
    "plastic": "concat('4000 1234 5678 ', lpad(cast(c_custkey % 9000 as string), 4, '0'))",
    "host": "concat('10.0.', cast(c_custkey % 256 as string), '.', cast(c_custkey % 7 as string))",
    "city": "case c_nationkey % 5 when 0 then 'Oslo' when 1 then 'Lima' when 2 then 'Cairo' when 3 then 'Pune' "
            "else 'Kyoto' end",
    "gender": "case when c_custkey % 2 = 0 then 'M' else 'F' end",
    "age": "cast(18 + c_custkey % 60 as int)",
    "salary": "30000 + (c_custkey * 37) % 50000",
    "diagnosis": "case when c_custkey % 9 = 0 then 'A' else 'B' end",
    "segment": "case when c_custkey % 4 = 0 then null else c_mktsegment end",
}
CONTACTS_SQL = "(select " + ", ".join(f"{e} as {n}" for n, e in CONTACTS.items()) + " from customer)"


def contacts(t) -> DataFrame:
    return t.customer.selectExpr(*[f"{e} as {n}" for n, e in CONTACTS.items()])
