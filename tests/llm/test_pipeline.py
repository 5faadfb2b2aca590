import re
import zlib

import corpus_pipeline

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    seen = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == columns, name
        seen.append(docs.collect())
        docs = spark.createDataFrame(seen[-1], docs.schema)
    raw, good, single, clean, mixed = ({r.doc_id: r for r in rows} for rows in seen)
    assert set(mixed) <= set(clean) == set(single) < set(good) < set(raw)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    fine = [i for i in raw if labels.get(i) == 1 and len(raw[i].text.split()) >= 20]
    assert sum(i in good for i in fine) >= 0.98 * len(fine)
    assert len({r.text for r in seen[2]}) == len(seen[2])
    for i, r in clean.items():
        assert r.n_chars == len(r.text) and not re.search("AKIA[A-Z0-9]{16}", r.text)
    assert max(sum(r.doc_id == i for r in seen[4]) for i in mixed) <= 2
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert {p.doc_id for p in pieces} == set(mixed)


def test_run_and_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, SMALL).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_packed_identifiers_are_in_the_shared_folder(spark):
    pieces = corpus_pipeline.run(spark, SMALL)
    kept = spark.read.parquet(*pieces.inputFiles()).collect()
    assert kept and all(zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length for p in kept)
    assert sorted((p.sequence_id, p.offset, p.length) for p in kept) == sorted((p.sequence_id, p.offset, p.length) for p in pieces.collect())
