"""Licence scans by sentence rules, in column expressions only.

A text is normalised once (lower-case ASCII letters and digits, single blanks, signs for the ends of
sentences and clauses).  A known licence sentence is found where it fills whole clauses: it starts and
stops at the end of a sentence, a line or a clause, and may run over the ends of lines and clauses but
not of sentences; of several that start at one place the longest counts.  So line breaks and comment
marks don't matter, nor how long a box or ruler around a sentence is.  The sentences found give a
sequence of identifiers.  Ordered rules are matched
against that sequence: a rule holds if its identifiers stand in it one after another, unknown
sentences between them not counting.  Everything is computed inside the row: no shuffle, no join.

Null and empty texts have no sentences and match nothing.  Repeated rows are scanned one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facsimile.llm.store import typed

# What ends a sentence, and what may end one or stand inside it: line ends, colons, and end marks before other marks.
SENTENCE_END = r"[.;!?][ \t\r\n]+|\n[ \t\r]*\n"
CLAUSE_END = r"[\r\n:]|[.;!?](?![A-Za-z0-9])"
HARD, SOFT = "\x01", "\x02"  # stand for the two in a normalised text
#: Comment marks at the start of a line that would else be sentence ends or words; and the two signs above.
LINE_MARK = r"(?md)^[ \t]*+(?:[.;!?]+|(?i:dnl|@?rem)(?![A-Za-z0-9]))|[\x01\x02]"

#: Known licence sentences (fixed values: words of public licences), by identifier.
SENTENCES = {
    "apache_ref": "Licensed under the Apache License, Version 2.0",
    "apache_obey": "you may not use this file except in compliance with the License",
    "apache_ref_the": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache_copy": "You may obtain a copy of the License at",
    "apache_url": "http://www.apache.org/licenses/LICENSE-2.0",
    "apache_basis": "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                    "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "apache_title": "Apache License Version 2.0, January 2004",
    "mit_ref": "Released under the MIT License",
    "mit_ref_is": "This project is licensed under the MIT License",
    "mit_title": "MIT License",
    "mit_title_the": "The MIT License (MIT)",
    "mit_grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                 "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
                 "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
                 "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit_notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions "
                  "of the Software",
    "as_is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
             "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "gpl3_work": "This work is licensed under the GNU General Public License, version 3",
    "gpl_redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                        "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                        "or (at your option) any later version",
    "gpl2_redistribute": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
                         "by the Free Software Foundation",
    "gpl2_version": "either version 2 of the License, or (at your option) any later version",
    "gpl_hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "gpl_received": "You should have received a copy of the GNU General Public License along with this program",
    "bsd_grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                 "following conditions are met",
    "bsd_source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
                  "disclaimer",
    "bsd_binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
                  "disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd_no_endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
                      "products derived from this software without specific prior written permission",
    "cc_by_nc": "Licensed under CC BY-NC 4.0",
    "cc_by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc_by_sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "reserved": "All rights reserved",
    "unlicense": "This is free and unencumbered software released into the public domain",
}
#: Ordered rules (fixed values): licence, rule kind, identifiers in sequence.
RULES = [
    ("Apache-2.0", "notice", ("apache_ref_the", "apache_obey", "apache_copy", "apache_url", "apache_basis")),
    ("Apache-2.0", "text", ("apache_title",)),
    ("MIT", "text", ("mit_grant", "mit_notice", "as_is")),
    ("GPL-3.0-or-later", "notice", ("gpl_redistribute", "gpl_hope", "gpl_received")),
    ("GPL-2.0-or-later", "notice", ("gpl2_redistribute", "gpl2_version")),
    ("BSD-3-Clause", "text", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_no_endorse")),
    ("BSD-2-Clause", "text", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("MIT", "title", ("mit_title",)),
    ("MIT", "title", ("mit_title_the",)),
    ("Apache-2.0", "reference", ("apache_ref",)),
    ("Apache-2.0", "reference", ("apache_ref_the",)),
    ("MIT", "reference", ("mit_ref",)),
    ("MIT", "reference", ("mit_ref_is",)),
    ("GPL-3.0-only", "reference", ("gpl3_work",)),
    ("GPL-3.0-or-later", "reference", ("gpl_redistribute",)),
    ("CC-BY-NC-4.0", "reference", ("cc_by_nc",)),
    ("CC-BY-4.0", "reference", ("cc_by",)),
    ("CC-BY-SA-4.0", "reference", ("cc_by_sa",)),
    ("CC0-1.0", "reference", ("cc0",)),
    ("MPL-2.0", "reference", ("mpl",)),
    ("Unlicense", "reference", ("unlicense",)),
    ("Proprietary", "reference", ("reserved",)),
]


def normal(sentence: str) -> str:
    """A known sentence as the expressions below normalise a found one."""
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in sentence).split()).lower()


KNOWN = {name: normal(text) for name, text in SENTENCES.items()}


def sentence_ids(text: str) -> Column:
    """The identifiers of the known sentences of a text, in order."""
    longest_first = sorted(KNOWN.values(), key=lambda k: (-len(k), k))
    pattern = f"(?<=[{HARD}{SOFT}] ?)(?:{'|'.join(k.replace(' ', f'[ {SOFT}]++') for k in longest_first)})(?= ?[{HARD}{SOFT}])"
    marked = F.regexp_replace(text, LINE_MARK, " ")
    for ends, mark in ((SENTENCE_END, HARD), (CLAUSE_END, SOFT)):
        marked = F.regexp_replace(marked, ends, mark)
    words = F.lower(F.regexp_replace(marked, f"[^A-Za-z0-9{HARD}{SOFT}]+", " "))
    runs = F.regexp_extract_all(F.concat(F.lit(HARD), words, F.lit(HARD)), F.lit(pattern), F.lit(0))
    known = F.array(*[F.lit(k) for k in KNOWN.values()])
    names = F.array(*[F.lit(k) for k in KNOWN])
    return F.transform(runs, lambda r: F.get(names, (F.array_position(known, F.regexp_replace(r, f"[ {SOFT}]+", " ")) - 1).cast("int")))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_sentences (known ones), sentence_ids and
    licences (licence:kind of each rule that holds, in the order of the rules), both joined by commas,
    and licence, that of the first such rule (null if none)."""
    rows = typed(docs, doc_id="long", text="string")
    found = rows.select("doc_id", sentence_ids("text").alias("ids")) \
        .select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_sentences"),
                F.coalesce(F.array_join("ids", ","), F.lit("")).alias("sentence_ids"))
    sequence = F.concat(F.lit(","), F.col("sentence_ids"), F.lit(","))
    holds = [F.when(F.contains(sequence, F.lit(f",{','.join(ids)},")), F.lit(f"{licence}:{kind}")) for licence, kind, ids in RULES]
    return found.withColumn("rules", F.array_distinct(F.array_compact(F.array(*holds)))) \
        .select("doc_id", "n_sentences", "sentence_ids", F.array_join("rules", ",").alias("licences"),
                F.substring_index(F.get("rules", F.lit(0)), ":", 1).alias("licence"))


def oracle() -> str:
    """The same as DuckDB SQL over the view ``documents``: a walk over words and the gaps between them."""
    quoted = lambda items: "[" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + "]"
    rules = ", ".join(f"case when contains(',' || sentence_ids || ',', ',{','.join(ids)},') then '{licence}:{kind}' end"
                      for licence, kind, ids in RULES)
    return f"""
with lines as (
  select doc_id, row_number() over () as place, list_transform(string_split(translate(coalesce(text, ''), chr(1) || chr(2), '  '), chr(10)),
    lambda l: regexp_replace(l, '^[ \t]*([.;!?]+|((?i)(dnl|@?rem)([^A-Za-z0-9]|$)))', ' \\4')) as lines
  from documents),
cut as (
  select doc_id, place, list_transform(regexp_extract_all(whole, '[A-Za-z0-9]+'), lambda w: lower(w)) as words,
         string_split_regex(whole, '[A-Za-z0-9]+') as gaps
  from (select doc_id, place, array_to_string(lines, chr(10)) as whole from lines)),
-- what a gap ends: 2 a sentence, 1 a line or clause, 0 nothing
walk as (
  select doc_id, place, words, list_transform(gaps, lambda g, k: case
    when k = 1 or k = len(gaps) or regexp_matches(g, '[.;!?][ \t\r\n]') or regexp_matches(g, '\n[ \t\r]*\n') then 2
    when regexp_matches(g, '[\r\n:]') or regexp_matches(left(g, greatest(length(g) - 1, 0)), '[.;!?]') then 1 else 0 end) as ends
  from cut),
known as (
  select unnest({quoted(KNOWN)}) as name, string_split(unnest({quoted(KNOWN.values())}), ' ') as said),
starts as (
  select place, words, ends, spot from (select place, words, ends, unnest(range(1, len(words) + 1)) as spot from walk)
  where ends[spot] > 0 and list_contains((select list(distinct said[1]) from known), words[spot])),
met as (
  select place, spot, spot + len(said) - 1 as upto, name from starts join known on words[spot] = said[1]
  where words[spot : spot + len(said) - 1] = said and ends[spot + len(said)] > 0
    and (len(said) = 1 or list_max(ends[spot + 1 : spot + len(said) - 1]) < 2)),
longest as (select place, spot, max(upto) as upto, arg_max(name, upto) as name from met group by place, spot),
-- from left to right, none inside the one before
chosen as (
  select place, list_reduce(list({{'spot': spot, 'upto': upto, 'names': [name]}} order by spot), lambda x, y: case when y.spot > x.upto
    then {{'spot': x.spot, 'upto': y.upto, 'names': list_concat(x.names, y.names)}} else x end).names as names
  from longest group by place),
named as (
  select doc_id, coalesce(len(names), 0) as n_sentences, coalesce(array_to_string(names, ','), '') as sentence_ids
  from walk left join chosen using (place)),
ruled as (select *, list_filter([{rules}], lambda r: r is not null) as rules from named),
once as (select *, list_filter(rules, lambda r, i: list_position(rules, r) = i) as firsts from ruled)
select doc_id, n_sentences, sentence_ids, coalesce(array_to_string(firsts, ','), '') as licences,
       split_part(firsts[1], ':', 1) as licence
from once"""
