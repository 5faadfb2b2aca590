"""Obviously fictional values picked by words in a column name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from facsimile.functions import keyed
from facsimile.operators import domains
from facsimile.operators.ordered import format_id
from facsimile.sources import locales

# Closed vocabularies for some hints.
CLOSED = (
    (("gender", "sex"), ["Male", "Female", "Other"]),
    (("status",), ["Pending", "Active", "Completed", "Cancelled", "Processing"]),
    (("reason",), ["Checkup", "Consultation", "Follow-up", "Emergency", "Routine"]),
    (("specialty",), ["Cardiology", "Neurology", "Pediatrics", "Oncology", "General"]),
)
# Our own vocabularies.
JOBS = ["Analyst", "Baker", "Carpenter", "Designer", "Engineer", "Florist", "Guide", "Nurse", "Pilot", "Teacher"]
COLORS = ["Red", "Orange", "Yellow", "Green", "Blue", "Violet", "Brown", "Grey", "Black", "White"]
VEHICLES = ["Sedan One", "Hatch Two", "Wagon Three", "Pickup Four", "Coupe Five", "Van Six"]
COUNTRIES = ["Arendelle", "Borduria", "Freedonia", "Genovia", "Ruritania", "Sylvania", "Utopia", "Zubrowka"]
STATES = ["North Plains", "South Plains", "East Shore", "West Shore", "High Valley", "Low Valley"]
WORDS = domains.SECOND_WORDS


def _both(first: str, second: str):
    return lambda h: first in h and second in h


def _any(*words: str):
    return lambda h: any(w in h for w in words)


def fictional(name: str, index: Column | str, seed: int = 42, locale: str = "us") -> Column:
    """The first matching hint decides; ``index`` numbers the rows."""
    h = name.lower()
    i = F.col(index) if isinstance(index, str) else index
    u = [keyed.uniform(seed, "fictional", name, key=i, lane=k) for k in range(4)]
    pack = locales.pack(locale)
    names = pack["names"]
    for words, values in CLOSED:
        if any(w in h for w in words):
            return keyed.choice(u[0], values)

    def two(a: list[str], b: list[str]) -> Column:
        return F.concat_ws(" ", keyed.choice(u[0], a), keyed.choice(u[1], b))

    def number(lane: int, lo: int, hi: int) -> Column:
        return keyed.uniform_int(u[lane], lo, hi).cast("string")

    rules = (
        (_both("first", "name"), lambda: keyed.choice(u[0], names["male"] + names["female"])),
        (_both("last", "name"), lambda: keyed.choice(u[0], names["family"])),
        (_any("name"), lambda: locales.full_name(locale, seed, i, f"fictional/{name}")),
        (_any("email"), lambda: F.concat(F.lower(keyed.choice(u[0], names["male"] + names["female"])),
                                         number(1, 1, 1_000_000), F.lit("@example.com"))),
        (_any("phone", "mobile", "cell"), lambda: F.concat(F.lit("+00-000-"), number(0, 1_000_000, 10_000_000))),
        (_any("address", "street"), lambda: F.concat_ws(" ", number(2, 1, 900), two(domains.FIRST_WORDS, WORDS),
                                                        F.lit("Street"))),
        (_any("company", "org"), lambda: keyed.choice(u[0], pack["companies"])),
        (_any("city"), lambda: locales.city(locale, u[0])),
        (_any("country"), lambda: keyed.choice(u[0], COUNTRIES)),
        (_any("url", "website"), lambda: format_id(i, "https://example.com/", 5)),
        (_any("ssn", "cnic", "passport", "national"), lambda: format_id(i, "XXX-XX-", 4)),
        (_any("card", "account"), lambda: format_id(i, "XXXX-XXXX-XXXX-", 4)),
        (_any("time"), lambda: F.concat(F.lpad(number(0, 1, 13), 2, "0"), F.lit(":"), F.lpad(number(1, 0, 60), 2, "0"),
                                        F.when(u[2] < 0.5, " AM").otherwise(" PM"))),
        (_any("job", "title"), lambda: keyed.choice(u[0], JOBS)),
        (_any("color"), lambda: keyed.choice(u[0], COLORS)),
        (_any("car", "vehicle", "model"), lambda: keyed.choice(u[0], VEHICLES)),
        (_any("plate", "license"), lambda: F.concat(F.lit("ZZ-"), number(0, 1000, 10_000))),
        (_any("location", "dropoff", "pickup"), lambda: locales.city(locale, u[0])),
        (_any("state"), lambda: keyed.choice(u[0], STATES)),
    )
    for test, make in rules:
        if test(h):
            return make()
    return keyed.choice(u[0], WORDS)
