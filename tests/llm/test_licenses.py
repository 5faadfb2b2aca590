import textwrap

import pytest

import compare
from facsimile.llm.licenses import KNOWN, RULES, SENTENCES, scan_licenses

SMALL = "/root/testdata/sf0.001"


def found(documents, *texts):
    return {r.doc_id: (r.licence, r.licences, r.sentence_ids) for r in scan_licenses(documents(list(enumerate(texts)))).collect()}


def test_sentences_and_ordered_rules(documents):
    notice = ("apache_ref_the", "apache_obey", "apache_copy", "apache_url", "apache_basis")
    apache = ";\n".join(SENTENCES[k] for k in notice[:2]) + ".\n" + "\n\n   ".join(SENTENCES[k] for k in notice[2:]) + "."
    got = found(documents, None, "", "nothing here. At all.", "Released under the MIT License.", f"Intro text.\n{apache}\nMore.",
                SENTENCES["as_is"] + ".", "ALL RIGHTS   RESERVED!\n\nmit license\n\n", "x" * 200_000 + ". Released under the MIT license.")
    assert got[0] == got[1] == got[2] == (None, "", "")
    assert got[3][0] == "MIT" and got[7][0] == "MIT"
    assert got[4][1].startswith("Apache-2.0:notice") and got[4][2] == ",".join(notice)
    assert got[5] == (None, "", "as_is")
    assert got[6][1] == "MIT:title,Proprietary:reference" and got[6][2] == "reserved,mit_title"


def test_rules_name_known_sentences():
    # a sentence that holds sentence ends is found as its parts, so only whole ones may stand in rules
    assert {i for _, _, ids in RULES for i in ids} <= set(SENTENCES)


def test_oracle(spark):
    ok, note = compare.compare(spark, compare.connect(SMALL), "op4_license_scan", SMALL)
    assert ok, note


def test_empty(documents):
    assert scan_licenses(documents([])).count() == 0


def walked(text):
    """Known sentences by a walk over the words: (word, what ends before it), 0 nothing, 1 a line or clause, 2 a sentence."""
    words, gap, at = [], 2, 0
    lines = [line.lstrip(" \t").lstrip(".;!?") for line in text.split("\n")]
    for n, line in enumerate(lines):
        gap = max(gap, 1 if line.strip() or not n else 2)
        at = 0
        while at < len(line):
            if line[at].isascii() and line[at].isalnum():
                end = at
                while end < len(line) and line[end].isascii() and line[end].isalnum():
                    end += 1
                words.append((line[at:end].lower(), gap))
                gap, at = 0, end
                continue
            after = line[at + 1:at + 2]
            if line[at] in ".;!?":
                gap = max(gap, 2 if after in ("", " ", "\t", "\r") else 0 if after.isascii() and after.isalnum() else 1)
            elif line[at] == ":":
                gap = max(gap, 1)
            at += 1
    words.append(("", 2))
    out, k = [], 0
    known = sorted(((KNOWN[n].split(), n) for n in KNOWN), key=lambda x: -len(" ".join(x[0])))
    while k < len(words) - 1:
        for parts, name in known:
            run = words[k:k + len(parts) + 1]
            if words[k][1] and [w for w, _ in run[:-1]] == parts and run[-1][1] and all(g < 2 for _, g in run[1:-1]):
                out.append(name)
                k += len(parts) - 1
                break
        k += 1
    return ",".join(out)


def test_licence_line_after_a_line_without_a_full_stop(documents, small):
    assert len(set(KNOWN.values())) == len(KNOWN)
    texts = ["from from from\nLicensed under CC BY-NC 4.0.", "| a | b |\nLicensed under the Apache License, Version 2.0.",
             "Copyright (c) 2020 Foo\nAll rights reserved", "Licence: Released under the MIT\r\nLicense\r\nmore",
             "We say it is released under the MIT License here", "Released under. The MIT License", "; Released under\n; the MIT License\n",
             "dnl Released under\ndnl the MIT License\n"]
    got = found(documents, *texts)
    assert [got[k][2] for k in range(8)] == ["cc_by_nc", "apache_ref", "reserved", "mit_ref", "", "", "mit_ref", "mit_ref"]
    more = [r.text + "\nReleased under the MIT License\n" + r.text for r in small.collect() if r.text]
    got = found(documents, *texts[:7], *more)
    assert [got[k][2] for k in range(len(got))] == [walked(t) for t in texts[:7] + more]


@pytest.mark.parametrize("mark", [" * ", "# ", "// ", "-- ", ";; ", ""])
def test_commented_mit_header(documents, mark):
    body = [SENTENCES["mit_grant"] + ":", SENTENCES["mit_notice"] + ".", SENTENCES["as_is"] + "."]
    lines = [x for part in body for x in [*textwrap.wrap(part, 60), ""]]
    got = found(documents, "/*\n" + "\n".join((mark + x).rstrip() for x in ["Copyright (c) 2020 Foo", "", *lines]) + "\n */\nint x;")
    assert got[0] == ("MIT", "MIT:text", "mit_grant,mit_notice,as_is")


def test_sentence_in_a_wide_box_is_not_lost_by_its_length(documents):
    wide = "\n".join(" *" + " " * 900 + part + " " * 900 + "*" for part in textwrap.wrap(SENTENCES["mit_grant"], 40))
    ruler = "*" * 5000 + " Released under the MIT License " + "-" * 5000
    got = found(documents, f"/{'*' * 3000}\n{wide}\n{'*' * 3000}/", f"x\n\n{ruler}\n\ny")
    assert got[0][2] == "mit_grant" and got[1][2] == "mit_ref"
