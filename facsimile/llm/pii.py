"""Personal data: high-recall span proposals, judged by gradient-boosted trees.

Generators propose overlapping spans: what the base rules match, valid or not, beginnings of phone
matches that run on into other digits, addresses with the at sign written out, account numbers and
national numbers by form, dates, numbers in words, and every group of numbers with seven or more digits.

A span's answer is known from a source that its features don't hold.  A match of a base rule is known
by the rule's check (checksum, limits), other spans by the word that announces them ("passport no.",
"version") or, if numbers inside words, as nothing.  The features tell the form (groups of digits, separators, letters)
and the context (neighbouring characters, line, distance to other proposals), but neither checks nor
announcing words, so what is learned holds for spans that nothing announces.  Boosted trees are fitted
on a bounded share of the known spans, keyed by the text's hash, so that copies are never on both sides
and the files' cut has no say.  For each kind the score threshold is calibrated on held-out texts so
that the wanted precision holds there.

Base spans always stay; other proposals are added where their score reaches the threshold and no base
span overlaps, the best of those that overlap each other.

Null and empty texts hold nothing.  Repeated rows are scanned one by one.  If there are no known spans
of both answers, nothing is added.  Texts are scanned whole, in time linear in their length.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facsimile.llm.spans import joined, of_kind
from facsimile.llm.store import keep, typed

KINDS = ["email", "ip", "card", "phone", "address", "number", "iban", "national", "date", "spelled"]
EMAIL, IP, CARD, PHONE, ADDRESS, NUMBER, IBAN, NATIONAL, DATE, SPELLED = range(len(KINDS))
#: The base rules (fixed values).  Possessive forms match the same and stay linear on long digit runs.
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP_RULE = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD_RULE = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE_RULE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Every match of the number rules lies inside one of these runs.
NUMBER_RUN = re.compile(r"\+?[0-9][\x20().0-9-]*")
ADDRESS_RULE = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[({]at[\])}]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[({]dot[\])}])\x20?[A-Za-z0-9-]++)+")
IBAN_RULE = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
NATIONAL_RULE = re.compile(r"(?<![A-Za-z0-9-])[0-9]{2,6}(?:-[0-9]{1,7}){1,3}(?![A-Za-z0-9-])")
DATE_RULE = re.compile(r"(?<![0-9./-])(?:[0-9]{1,2}([./-])[0-9]{1,2}\1(?:[0-9]{4}|[0-9]{2})|[0-9]{4}([./-])[0-9]{1,2}\2[0-9]{1,2})(?![0-9./-]?[0-9])")
DIGIT_WORD = "zero|one|two|three|four|five|six|seven|eight|nine"
SPELLED_RULE = re.compile(rf"(?i)\b(?:{DIGIT_WORD})(?:[\x20-](?:{DIGIT_WORD})\b){{6,}}+")
LEAST_DIGITS = 7
#: What announces personal data, and what announces other numbers (word lists of our own).
OWN_WORDS = ("phone|tel|telephone|mobile|cell|fax|call|card|visa|mastercard|iban|account|acct|ssn|social security|passport|licence|license|"
             "national id|tax id|dob|born|birth|birthday|birthdate|contact|mail|e-mail|email|reach me at|patient")
OTHER_WORDS = ("version|ver|release|build|order|invoice|ticket|ref|reference|page|pages|pp|isbn|issn|doi|item|sku|part|model|serial|chapter|section|"
               "article|rfc|commit|total|sum|price|amount|usd|eur|population|updated|published|due|dated|deadline|batch|lot|tracking|parcel")
NUMBERED = r"(?:\W{0,2}(?:no|number|nr|num|is|on|date|of birth|id))?\W{0,3}$"
OWN, OTHER = (re.compile(rf"(?:^|[^a-z])(?:{w}){NUMBERED}") for w in (OWN_WORDS, OTHER_WORDS))
CONTEXT = 32
FEATURES = ["length", "digits", "separators", "groups", "longest_group", "shortest_group", "first_group", "second_group", "last_group", "plus",
            "parentheses", "dots", "dashes", "slashes", "blanks", "at", "letters", "capitals", "after_letter", "before_letter", "after_digit",
            "line_start", "gap_before", "gap_after"]
#: Gaps to other proposals count up to here.
FAR = 200
# Known spans that the trees are fitted on, at most (about: a keyed share of all known spans).
FIT_ROWS = 20_000
# Held-out known spans that a kind needs for a threshold of its own.
KNOWN_LEAST = 20


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def only_digits(span: str) -> str:
    return "".join(c for c in span if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the e-mail rule, looked for around each at sign only, in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        domain = EMAIL_DOMAIN.match(text, at) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", domain.end() if domain else at + 1)


def announced(text: str, start: int) -> int | None:
    """1 if the words right before a place announce personal data, 0 if they announce something else."""
    before = text[max(0, start - CONTEXT):start].lower()
    return 1 if OWN.search(before) else 0 if OTHER.search(before) else None


def proposals(text: str) -> list[tuple[int, int, int, bool, int | None]]:
    """(start, kind, end, base, known): base is true for valid matches of the base rules; known is 1 for
    personal data, 0 for other things, None where nothing tells."""
    out: list[tuple[int, int, int, bool, int | None]] = [(s, EMAIL, e, True, 1) for s, e in emails(text)]

    def by_form(kind: int, start: int, end: int, otherwise: int | None = None) -> None:
        told = announced(text, start)
        out.append((start, kind, end, False, otherwise if told is None else told))

    def by_rule(kind: int, start: int, end: int, valid: bool, otherwise: int | None = 0) -> None:
        if valid:
            out.append((start, kind, end, True, 1))
        else:
            by_form(kind, start, end, otherwise)

    def part_of_a_word(start: int, end: int) -> int | None:
        return 0 if text[start - 1:start].isalpha() and start or text[end:end + 1].isalpha() else None

    if "at" in text and any(b in text for b in ("[at", "(at", "{at")):
        for m in ADDRESS_RULE.finditer(text):
            by_form(ADDRESS, m.start(), m.end())
    for kind, rule in ((IBAN, IBAN_RULE), (NATIONAL, NATIONAL_RULE), (DATE, DATE_RULE), (SPELLED, SPELLED_RULE)):
        for m in rule.finditer(text):
            if kind != NATIONAL or len(only_digits(m[0])) >= LEAST_DIGITS:
                by_form(kind, m.start(), m.end())
    for run in NUMBER_RUN.finditer(text):
        s, zone = run.start(), run[0].rstrip(" (.-")
        if len(zone) < LEAST_DIGITS:
            continue
        if zone.count(".") >= 3:
            for m in IP_RULE.finditer(zone):
                by_rule(IP, s + m.start(), s + m.end(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or 0) <= 255 for p in m[0].split(".")))
        for m in CARD_RULE.finditer(zone):
            digits = only_digits(m[0])
            if len(digits) >= LEAST_DIGITS:
                # a wrong checksum tells something, another number of digits only that it is no card
                possible = 12 <= len(digits) <= 19
                by_rule(CARD, s + m.start(), s + m.end(), possible and luhn(digits), 0 if possible else part_of_a_word(s + m.start(), s + m.end()))
        if zone[0] == "+" and (m := PHONE_RULE.match(zone)):
            digits = len(only_digits(m[0]))
            by_rule(PHONE, s, s + m.end(), 9 <= digits <= 15, None)
            if digits > 15:  # the match may run on into other numbers: any beginning that is long enough
                n = 0
                for group in re.finditer("[0-9]+", m[0]):
                    n += len(group[0])
                    if n > 15:
                        break
                    if n >= 9:
                        by_form(PHONE, s, s + group.end())
        elif zone[0] != "+" and sum("0" <= c <= "9" for c in zone) >= LEAST_DIGITS:
            by_form(NUMBER, s, s + len(zone), part_of_a_word(s, s + len(zone)))
    return sorted(out, key=lambda p: p[:3])


def gaps(spans: list[tuple]) -> list[tuple[int, int]]:
    """How far the proposals that end before, and start after, each one are (``FAR`` if none is near)."""
    ends, starts = sorted(s[2] for s in spans), [s[0] for s in spans]
    out = []
    for start, _, end, *_ in spans:
        k, j = bisect_right(ends, start), bisect_left(starts, end)
        out.append((min(FAR, start - ends[k - 1]) if k else FAR, min(FAR, starts[j] - end) if j < len(starts) else FAR))
    return out


def described(text: str, start: int, end: int, gap: tuple[int, int]) -> list[float]:
    """The features of a span, in the order of FEATURES."""
    span, before = text[start:end], text[max(0, start - CONTEXT):start]
    groups = [len(g) for g in re.findall("[0-9]+", span)] or [0]
    digits, letters = sum(groups), sum(c.isalpha() for c in span)
    return [float(x) for x in (
        min(len(span), 64), min(digits, 64), len(span) - digits - letters, len(groups), max(groups), min(groups), groups[0],
        groups[1] if len(groups) > 1 else 0, groups[-1], span[0] == "+", "(" in span, span.count("."), span.count("-"), span.count("/"),
        span.count(" "), "@" in span, letters, sum(c.isupper() for c in span), text[start - 1:start].isalpha() if start else False,
        text[end:end + 1].isalpha(), text[start - 1:start].isdigit() if start else False,
        not before.strip() or before.endswith("\n"), *gap)]


def proposed(docs: DataFrame) -> DataFrame:
    """Pass one, kept: part and row (the place of a document), key (the text's hash), doc_id, and spans
    with their features and known answers."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row = 0
        for rows in batches:
            spans = []
            for text in rows.text:
                found = proposals(text)
                spans.append([{"start": s, "kind": k, "end": e, "base": b, "known": y, "x": described(text, s, e, g)}
                              for (s, k, e, b, y), g in zip(found, gaps(found))])
            yield pd.DataFrame({"part": rows.part, "row": range(row, row + len(rows)), "key": rows.key, "doc_id": rows.doc_id.astype("Int64"),
                                "proposals": spans})
            row += len(rows)

    rows = typed(docs, doc_id="long", text="string").select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.spark_partition_id().alias("part")).withColumn("key", F.xxhash64("text"))
    return keep(rows.mapInPandas(scan, "part int, row long, key long, doc_id long, proposals "
                                       "array<struct<start:int,kind:int,end:int,base:boolean,known:int,x:array<double>>>"), "pii-proposals")


def fitted(known: DataFrame, fit_rows: int) -> tuple[GBTClassificationModel, VectorAssembler] | None:
    """Boosted trees on a keyed share of ``known`` (y and features) that holds about ``fit_rows``."""
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    share = min(1.0, fit_rows / sum(counts.values()))
    sample = known.where(F.pmod(F.xxhash64("key", "start", "kind", "end"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    heavy = counts[1.0] / counts[0.0] if counts[1.0] > counts[0.0] else 1.0
    sample = sample.withColumn("weight", F.when(F.col("y") == 0, min(heavy, 100.0)).otherwise(1.0))
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="features")
    # one small partition in an order of its own, so that a round of boosting is one short task a level and rows come alike
    data = keep(sample.repartition(1).sortWithinPartitions("key", "start", "kind", "end").select("y", "weight", *FEATURES), "pii-sample")
    trees = GBTClassifier(labelCol="y", weightCol="weight", maxDepth=3, maxIter=10, maxBins=64, seed=7)
    return trees.fit(assemble.transform(data)), assemble


def lowest_step(steps: list[tuple[int, float, int]], precision: float) -> float:
    """The lowest of a hundred steps of the score from which on ``precision`` holds; 2 if there is none."""
    best, good, n = 2.0, 0.0, 0
    for step, right, rows in sorted(steps, reverse=True):
        good, n = good + right, n + rows
        if good / n >= precision and step >= 50:
            best = step / 100
    return best


def thresholds(scored: DataFrame, precision: float) -> list[float]:
    """A threshold for each kind from held-out known spans; kinds that have fewer than ``KNOWN_LEAST`` of
    them take that of all kinds."""
    steps = scored.where("held and y is not null").groupBy("kind", F.floor(F.col("score") * 100).cast("int").alias("step")) \
        .agg(F.sum("y").alias("good"), F.count("*").alias("n")).collect()
    common = lowest_step([(step, good, n) for step, (good, n) in totals(steps).items()], precision)
    out = []
    for kind in range(len(KINDS)):
        own = [(r["step"], r["good"], r["n"]) for r in steps if r["kind"] == kind]
        out.append(lowest_step(own, precision) if sum(n for _, _, n in own) >= KNOWN_LEAST else common)
    return out


def totals(steps: list) -> dict[int, tuple[float, int]]:
    out: dict[int, tuple[float, int]] = {}
    for r in steps:
        good, n = out.get(r["step"], (0.0, 0))
        out[r["step"]] = good + r["good"], n + r["n"]
    return out


def scan_personal(docs: DataFrame, precision: float = 0.98, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, base and spans (arrays of start, kind, end;
    kinds are numbers into KINDS)."""
    rows = proposed(docs)
    bare = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    rows = rows.withColumn("base", F.transform(F.filter("proposals", lambda s: s["base"]), bare))
    values = [F.col("s.x")[k].alias(name) for k, name in enumerate(FEATURES)]
    spans = rows.select("part", "row", "key", "base", F.explode("proposals").alias("s")) \
        .select("part", "row", "key", "s.start", "s.kind", "s.end", F.col("s.known").cast("double").alias("y"),
                (F.pmod(F.xxhash64("key", F.lit("held")), F.lit(5)) == 0).alias("held"),
                F.exists("base", lambda b: (b["start"] < F.col("s.end")) & (F.col("s.start") < b["end"])).alias("met"), *values)
    model = fitted(spans.where("y is not null and not held"), fit_rows)
    if model is None:
        return rows.select("doc_id", "base", F.col("base").alias("spans"))
    trees, assemble = model
    score = vector_to_array("probability")[1].alias("score")
    scored = keep(trees.transform(assemble.transform(spans)).select("part", "row", "start", "kind", "end", "y", "held", "met", score), "pii-scores")
    least = F.get(F.array(*[F.lit(t) for t in thresholds(scored, precision)]), F.col("kind"))
    # spans that hang together by overlaps; the best one of them is added
    own = Window.partitionBy("part", "row").orderBy("start", "end", "kind")
    reach = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.when(reach.isNull() | (reach <= F.col("start")), F.lit(1)).otherwise(0)
    passing = scored.where(~F.col("met") & (F.col("score") >= least)).withColumn("apart", apart).withColumn("cluster", F.sum("apart").over(own))
    best = F.max(F.struct("score", (F.col("end") - F.col("start")).alias("size"), "start", "kind", "end")).alias("b")
    chosen = passing.groupBy("part", "row", "cluster").agg(best) \
        .groupBy("part", "row").agg(F.collect_list(F.struct("b.start", "b.kind", "b.end")).alias("more"))
    added = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.concat("base", "more"))
    return rows.join(chosen, ["part", "row"], "left").select("doc_id", F.array_sort("base").alias("base"),
                                                             F.array_sort(added).alias("spans"))


def digest(scanned: DataFrame) -> DataFrame:
    counts = [of_kind("base", k).alias(f"n_{n}") for k, n in enumerate(KINDS[:4])]
    return scanned.select("doc_id", *counts, F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"),
                          joined(F.col("spans"), KINDS).alias("spans"))
