"""Secret scans: fixed rules, and a randomness test battery for tokens that no rule names.

A token of 20 or more credential characters is read in the smallest encoding that holds it, and three
tests ask whether it is a random string of that encoding: chi-squared uniformity over the alphabet
(in as many bins as the length allows), a runs test and a lag-one serial correlation.  Alphabets are
ordered by how common their letters are in prose, so that words fail where random strings pass.
Fisher's method combines the three.

How often prose passes depends on the length and on the encoding, so each pair of a length class and
a family of encodings has its own null distribution: the same score of words strung together to that
length and read in that alphabet.  All words of all texts take part, in each class once, but for those
inside tokens that are tested or that a rule names: these are the question, not the prose.  A token's
p-value is its rank among the strings, and Benjamini-Hochberg over all tokens of all documents controls
the share of false finds.  Only counts per (class, score bin) leave a task and reach the driver.

Null and empty texts hold nothing.  Repeated rows are scanned one by one; texts are scanned whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facsimile.llm.spans import joined, of_kind
from facsimile.llm.store import checked, keep, typed

#: The base rules (fixed values).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")
KINDS = ["assign", "access", "hex", "random"]
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

TOKEN = re.compile("[A-Za-z0-9+/_-]{20,}={0,2}")
LEAST_TOKEN = 20
LOWER = "etaoinsrhldcumfpgwybvkxjqz"  # letters from common to rare
UPPER = LOWER.upper()
DIGITS = "0123456789"
ALPHABETS = [  # from small to large; the first that holds all characters is taken
    DIGITS + "abcdef", DIGITS + "ABCDEF", LOWER, UPPER, UPPER + "234567", DIGITS + LOWER, DIGITS + UPPER, LOWER + UPPER,
    LOWER + UPPER + DIGITS, LOWER + UPPER + DIGITS + "-_", LOWER + UPPER + DIGITS + "+/", LOWER + UPPER + DIGITS + "+/-_"]
PLACES = [{c: k for k, c in enumerate(a)} for a in ALPHABETS]
# Encodings fall into families, and prose is read in the alphabet that stands for each: letters of one
# case, letters of both cases, letters with digits or signs.
FAMILY = [0 if a in (LOWER, UPPER) else 1 if a == LOWER + UPPER else 2 for a in ALPHABETS]
FAMILY_PLACES = [PLACES[ALPHABETS.index(a)] for a in (LOWER, LOWER + UPPER, LOWER + UPPER + DIGITS)]
LENGTH_CLASSES = (20, 28, 40, 64)  # lower ends
CLASSES = len(LENGTH_CLASSES) * len(FAMILY_PLACES)
BINS = 500

_CREDENTIAL = np.zeros(256, dtype=bool)
_CREDENTIAL[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[list((LOWER + UPPER).encode())] = True
# A byte's place in the alphabet that stands for a family; the first family reads in lower case.
PLACE_OF = np.zeros((len(FAMILY_PLACES), 256), dtype=np.uint8)
for _f, _places in enumerate(FAMILY_PLACES):
    for _c in LOWER + UPPER:
        PLACE_OF[_f, ord(_c)] = _places[_c.lower() if _f == 0 else _c]
# Words are strung once so many letters have come together in a task, and scored so many letters at once.
LETTERS_AT_ONCE = 1_000_000


def chi_squared_tail(x: float, df: int) -> float:
    """P(chi-squared with ``df`` degrees > x), by the cube-root normal approximation."""
    if x <= 0:
        return 1.0
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return max(0.5 * math.erfc(z / math.sqrt(2)), 1e-300)


def two_sided(z: float) -> float:
    return max(math.erfc(abs(z) / math.sqrt(2)), 1e-300)


def encoding(body: str) -> int | None:
    """The smallest encoding that holds all characters; None if they are digits alone or none does."""
    if body.isdigit():
        return None
    return next((k for k, p in enumerate(PLACES) if all(c in p for c in body)), None)


def battery(body: str, places: dict[str, int]) -> float:
    """How well ``body`` passes as a random string of an alphabet, 0 to 1."""
    at, size, n = [places[c] for c in body], len(places), len(body)
    bins = max(2, min(size, n // 5))
    counts, room = [0] * bins, [0] * bins
    for a in at:
        counts[a * bins // size] += 1
    for a in range(size):
        room[a * bins // size] += 1
    uniform = chi_squared_tail(sum((c - n * r / size) ** 2 / (n * r / size) for c, r in zip(counts, room)), bins - 1)
    high = [a * 2 >= size for a in at]
    ones = sum(high)
    runs = 1e-6
    if 0 < ones < n:
        mean = 2 * ones * (n - ones) / n
        spread = mean * (mean - 1) / (n - 1)
        seen = sum(a != b for a, b in zip(high, high[1:]))
        runs = two_sided((seen - mean) / math.sqrt(spread)) if spread > 0 else 1e-6
    middle = sum(at) / n
    around = sum((a - middle) ** 2 for a in at)
    serial = 1e-6
    if around > 0:
        lagged = sum((a - middle) * (b - middle) for a, b in zip(at, at[1:])) / around
        serial = two_sided(lagged * math.sqrt(n))
    return chi_squared_tail(-2 * (math.log(uniform) + math.log(runs) + math.log(serial)), 6)


def tally(body: str, length: int, family: int, places: dict[str, int]) -> tuple[int, int]:
    """(class, score bin): the class tells length and family."""
    size = sum(length >= low for low in LENGTH_CLASSES) - 1
    return size * len(FAMILY_PLACES) + family, min(BINS - 1, int(battery(body, places) * BINS))


def base_spans(text: str, tokens: list[tuple[int, str]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base rules.  Access keys and hex runs lie inside tokens."""
    out = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    for start, token in tokens:
        if "AKIA" in token:
            out += [(start + m.start(), 1, start + m.end()) for m in ACCESS.finditer(token) if len(m[0]) >= LEAST_ACCESS]
        if len(token) >= LEAST_HEX:
            out += [(start + m.start(), 2, start + m.end()) for m in HEX.finditer(token) if len(m[0]) >= LEAST_HEX]
    return sorted(out)


def long_tokens(text: str) -> list[tuple[int, str]]:
    """Maximal runs of at least 20 credential characters, with their starts in code points."""
    raw = text.encode("utf-8", "surrogatepass")
    inside = np.zeros(len(raw) + 2, dtype=bool)
    inside[1:-1] = _CREDENTIAL[np.frombuffer(raw, dtype=np.uint8)]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    big = np.flatnonzero(ends - starts >= LEAST_TOKEN)
    out, at, points = [], 0, 0
    ascii_text = len(raw) == len(text)
    for k in big:
        s, e = int(starts[k]), int(ends[k])
        points = s if ascii_text else points + len(raw[at:s].decode("utf-8", "surrogatepass"))
        at = s
        out.append((points, raw[s:e].decode("ascii")))
    return out


def word_runs(text: str, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray] | None:
    """The letters of the words of a text that lie outside ``spans`` (code points), joined, and the
    length of each word; None if there are fewer than two words."""
    raw = text.encode("utf-8", "surrogatepass")
    codes = np.frombuffer(raw, dtype=np.uint8)
    inside = np.zeros(len(raw) + 2, dtype=bool)
    inside[1:-1] = _LETTER[codes]
    ascii_text, done, at = len(raw) == len(text), 0, 0
    for s, e in sorted(spans):
        if not ascii_text:
            at, done = at + len(text[done:s].encode("utf-8", "surrogatepass")), s
        first = s if ascii_text else at
        inside[1 + first:1 + first + e - s] = False  # spans are ASCII
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    if len(edges) < 4:
        return None
    return codes[inside[1:-1]], edges[1::2] - edges[::2]


def chi_squared_tails(x: np.ndarray, df: int) -> np.ndarray:
    """``chi_squared_tail`` of each."""
    z = (np.cbrt(np.maximum(x, 0) / df) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return np.where(x <= 0, 1.0, np.maximum(0.5 * erfc(z / math.sqrt(2)), 1e-300))


def erfc(x: np.ndarray) -> np.ndarray:
    return np.fromiter(map(math.erfc, x.tolist()), dtype=float, count=len(x))


def batteries(at: np.ndarray, size: int) -> np.ndarray:
    """``battery`` of many strings of one length: each row of ``at`` has the places of one string in
    an alphabet of ``size`` letters."""
    m, n = at.shape
    bins = max(2, min(size, n // 5))
    binned = (np.arange(size) * bins // size).astype(np.intp)
    counts = np.bincount((binned[at] + np.arange(m)[:, None] * bins).ravel(), minlength=m * bins).reshape(m, bins)
    expected = np.bincount(binned, minlength=bins) * n / size
    uniform = chi_squared_tails(((counts - expected) ** 2 / expected).sum(axis=1), bins - 1)
    high = at >= (size + 1) // 2
    ones = high.sum(axis=1)
    mean = 2 * ones * (n - ones) / n
    spread = mean * (mean - 1) / (n - 1)
    seen = (high[:, 1:] != high[:, :-1]).sum(axis=1)
    fine = (ones > 0) & (ones < n) & (spread > 0)
    runs = np.full(m, 1e-6)
    runs[fine] = np.maximum(erfc(np.abs(seen - mean)[fine] / np.sqrt(2 * spread[fine])), 1e-300)
    off = at - at.mean(axis=1, keepdims=True)
    around = np.einsum("ij,ij->i", off, off)
    lagged = np.einsum("ij,ij->i", off[:, 1:], off[:, :-1])
    fine = around > 0
    serial = np.full(m, 1e-6)
    serial[fine] = np.maximum(erfc(np.abs(lagged[fine] / around[fine]) * math.sqrt(n / 2)), 1e-300)
    return chi_squared_tails(-2 * (np.log(uniform) + np.log(runs) + np.log(serial)), 6)


def strung_words(texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """How often words strung together score in each (class, bin): what prose scores there.  All words
    of each text (``word_runs``) are cut, for each length class, into stretches that reach its lower
    end, the last one going on at the text's start; each is read in the alphabet of each family."""
    out = np.zeros((CLASSES, BINS), dtype=np.int64)
    letters, lengths, limits, n_words = [], [], [], 0
    for own, words in texts:
        again = -(-LENGTH_CLASSES[-1] // len(own))  # so many more rounds reach the largest lower end
        more = np.tile(words, again)
        more = more[:int(np.searchsorted(more.cumsum(), LENGTH_CLASSES[-1])) + 1]
        letters += [own, np.tile(own, again)[:more.sum()]]
        lengths += [words, more]
        limits.append((n_words, n_words + len(words)))
        n_words += len(words) + len(more)
    if not limits:
        return out
    joined_letters = np.concatenate(letters)
    ends = np.concatenate([[0], np.concatenate(lengths).cumsum()])
    places = [PLACE_OF[f][joined_letters] for f in range(len(FAMILY_PLACES))]
    for c, low in enumerate(LENGTH_CLASSES):
        after = np.searchsorted(ends, ends + low)
        step, starts = after.tolist(), []
        for k, stop in limits:
            while k < stop:
                starts.append(k)
                k = step[k]
        starts = np.array(starts)
        begin = ends[starts]
        size = np.minimum(ends[after[starts]] - begin, low + low // 5)
        for n in np.unique(size).tolist():
            rows = begin[size == n]
            for f, alphabet in enumerate(FAMILY_PLACES):
                windows = np.lib.stride_tricks.sliding_window_view(places[f], n)
                for k in range(0, len(rows), LETTERS_AT_ONCE // n):
                    score = batteries(windows[rows[k:k + LETTERS_AT_ONCE // n]], len(alphabet))
                    bins = np.minimum(BINS - 1, (score * BINS).astype(int))
                    out[c * len(FAMILY_PLACES) + f] += np.bincount(bins, minlength=BINS)
    return out


def scan_text(text: str) -> tuple[list, list, tuple | None]:
    """Base spans, tested tokens, and the words outside both."""
    tokens = long_tokens(text)
    base = base_spans(text, tokens)
    found, apart = [], [(s, e) for s, _, e in base]
    for start, run in tokens:
        for m in TOKEN.finditer(run):
            s, e = start + m.start(), start + m.end()
            if any(s < b[2] and b[0] < e for b in base):
                continue
            body = m[0].rstrip("=")
            code = encoding(body)
            if code is not None:
                found.append((s, e, *tally(body, e - s, FAMILY[code], PLACES[code])))
                apart.append((s, e))
    return base, found, word_runs(text, apart)


def tested(docs: DataFrame) -> DataFrame:
    """Pass one, kept: doc_id, print (hash of the text), base (spans) and found (tokens with class and
    score bin) of each row; and one row a task without a print, whose null counts the strung words of
    all its texts by class and bin."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, waiting, letters = np.zeros((CLASSES, BINS), dtype=np.int64), [], 0
        for rows in batches:
            base, found = [], []
            for text in rows.text:
                b, f, words = scan_text(text)
                base.append([dict(zip(("start", "kind", "end"), x)) for x in b])
                found.append([dict(zip(("start", "end", "class", "bin"), x)) for x in f])
                if words is not None:
                    waiting.append(words)
                    letters += len(words[0])
                if letters > LETTERS_AT_ONCE:
                    total += strung_words(waiting)
                    waiting, letters = [], 0
            yield pd.DataFrame({"doc_id": rows.doc_id.astype("Int64"), "print": rows.print.astype("Int64"), "base": base, "found": found,
                                "null": None})
        total += strung_words(waiting)
        null = [{"class": int(c), "bin": int(b), "n": int(total[c, b])} for c, b in zip(*np.nonzero(total))]
        yield pd.DataFrame({"doc_id": pd.array([None], "Int64"), "print": pd.array([None], "Int64"), "base": [[]], "found": [[]], "null": [null]})

    rows = typed(docs, doc_id="long", text="string").select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("print", F.xxhash64("text"))
    return keep(rows.mapInPandas(scan, "doc_id long, print long, base array<struct<start:int,kind:int,end:int>>, found array<struct<start:"
                                       "int,end:int,class:int,bin:int>>, null array<struct<class:int,bin:int,n:bigint>>"), "secret-tests")


def discovery_bins(scans: DataFrame, rate: float) -> list[int]:
    """For each class the lowest score bin that is reported (BINS: none), by Benjamini-Hochberg at
    ``rate`` over all tokens, with p-values from the strung words of the class."""
    counted = [scans.select(F.explode(c).alias("x")).groupBy("x.class", "x.bin").agg(n.alias("n"))
               .select(F.lit(c).alias("what"), "class", "bin", "n") for c, n in (("found", F.count("*")), ("null", F.sum("x.n")))]
    found, null = np.zeros((CLASSES, BINS)), np.zeros((CLASSES, BINS))
    for r in counted[0].union(counted[1]).collect():  # at most 2 * classes * bins rows
        (found if r["what"] == "found" else null)[r["class"], r["bin"]] = r["n"]
    p = (1 + null[:, ::-1].cumsum(axis=1)[:, ::-1]) / (1 + null.sum(axis=1, keepdims=True))
    order = np.argsort(p, axis=None, kind="stable")
    ranked = found.ravel()[order].cumsum()
    total = found.sum()
    level = p.ravel()[order]
    # the rank of a p-value counts all tokens up to it, ties included
    last = np.searchsorted(level, level, side="right") - 1
    passes = (level <= rate * ranked[last] / total) & (ranked[last] > 0) if total else np.zeros(len(level), bool)
    if not passes.any():
        return [BINS] * CLASSES
    limit = level[passes].max()
    return [int(np.flatnonzero(row <= limit).min()) if (row <= limit).any() else BINS for row in p]


def scan_secrets(docs: DataFrame, rate: float = 0.05) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, print (hash of the text), base and spans (arrays of start, kind, end;
    kinds are numbers into KINDS; ``spans`` holds the base spans and the discoveries)."""
    scans = tested(docs)
    lowest = F.array(*[F.lit(b) for b in discovery_bins(scans, rate)])
    added = F.transform(F.filter("found", lambda t: t["bin"] >= F.get(lowest, t["class"])),
                        lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))
    return scans.where(F.col("print").isNotNull()).select("doc_id", "print", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def digest(scanned: DataFrame) -> DataFrame:
    names = ("assign", "access", "hex")
    counts: list[Column] = [of_kind("base", k).alias(f"n_{n}") for k, n in enumerate(names)]
    return scanned.select("doc_id", *counts, F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"),
                          joined(F.col("spans"), KINDS).alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by ``[secret]``; overlapping spans become one."""
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(a: Column, s: Column) -> Column:
        fresh = s["start"] >= a["at"]
        out = F.when(fresh, F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("[secret]"))).otherwise(a["out"])
        return F.struct(out.alias("out"), F.greatest(a["at"], s["end"]).alias("at"))

    return F.aggregate(F.array_sort(spans), begin, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def redacted(docs: DataFrame, rate: float = 0.05) -> DataFrame:
    """``docs`` with every secret replaced in its text, and n_chars, where present, counted anew."""
    found = scan_secrets(docs, rate).where(F.size("spans") > 0).groupBy("doc_id", "print").agg(F.min("spans").alias("spans"))
    side = checked(found.select(F.col("doc_id").alias("found_id"), "print", "spans"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("found_key"),
                       F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_print"))
    met = rows.join(side, F.col("found_key").eqNullSafe(F.col("found_id")) & (F.col("text_print") == F.col("print")), "left")
    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(redact(F.col("row.text"), F.col("spans")))
    out = met.withColumn("clean", text)
    new = {"text": F.col("clean"), "n_chars": F.when(F.col("spans").isNull(), F.col("row.n_chars")).otherwise(F.length("clean"))
           if "n_chars" in docs.columns else None}
    return out.select(*[new[c].cast(t).alias(c) if c in new else F.col(f"row.`{c}`") for c, t in docs.dtypes])
