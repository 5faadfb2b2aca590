import random
import re
from collections import defaultdict

from facsimile.llm.quality import judge, passing

WORD = re.compile("[^\x20\x09-\x0d]+")
rnd = random.Random(11)


def plain(text):
    words, places = WORD.findall(text or ""), defaultdict(list)
    for k in range(len(words) - 7):
        places[tuple(words[k:k + 8])].append(k)
    covered = {j for at in places.values() if len(at) > 1 for k in at for j in range(k, k + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def prose(n):
    return " ".join(rnd.choice(["the", "reed", "over", "lantern", "quiet", "harbour", "stone", "walks"]) + str(rnd.randrange(99)) for _ in range(n)) + "."


def test_statistics(spark, documents, small):
    rows = [(r.doc_id, r.text) for r in small.collect()]
    rows += [(9001, None), (9002, ""), (9003, " \t\n\x0b\f\r "), (9004, "a " * 500), (9005, "x\n\nx\n x\nx"), (9006, "a b c d e f g h " * 2 + "q"),
             (9007, "é\xa0ü #|<> b"), (9008, prose(30) + "\n" + prose(9)), (9008, prose(30)), (9009, "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8")]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = judge(documents(rows), labels).collect()
    want = sorted((i, *plain(t)) for i, t in rows)
    assert sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept != r.base_failed and r.rule is None  # nothing learned


def test_learned_rules_hold_on_unlabelled_documents(spark, documents):
    def junk(n):
        return " | ".join(rnd.choice(["ab", "cd"]) + str(rnd.randrange(10**6)) + "***" for _ in range(n))

    rows = [(k, junk(60) if k % 4 == 0 else prose(60)) for k in range(400)]
    labels = spark.createDataFrame([(k, 0 if k % 4 == 0 else 1, 0) for k in range(200)] + [(None, 0, 0), (3, None, 0)],
                                   "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in judge(documents(rows), labels).collect()}
    held = [got[k] == (k % 4 != 0) for k in range(200, 400)]
    assert sum(held) >= 198
    assert all(got[k] for k in range(200, 400) if k % 4)
    docs = documents(rows)
    left = passing(docs, labels)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {k for k, kept in got.items() if kept}


def test_empty(spark, documents):
    labels = spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")
    assert judge(documents([]), labels).count() == 0 and passing(documents([]), labels).count() == 0
