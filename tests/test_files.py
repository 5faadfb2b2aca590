"""Large files by byte ranges: JSON arrays and hashes of blocks."""

import hashlib
import json
import random
from pathlib import Path
from urllib.parse import urlparse

import pytest

from facsimile.operators import scale
from facsimile.sources import blocks, json_arrays, readers, writers

SIGNS = ['"', "\\", "{", "}", "[", "]", ",", ":", " ", "\n", "\r", "a", "é", "🙂", "\\\\", '\\"', "}{", " "]


def made(rnd, depth=0):
    kind = rnd.randrange(6 if depth < 3 else 3)
    if kind < 3:
        return [rnd.randrange(100), "".join(rnd.choice(SIGNS) for _ in range(rnd.randrange(12))), None][kind]
    if kind == 3:
        return [made(rnd, depth + 1) for _ in range(rnd.randrange(4))]
    return {f"k{rnd.randrange(3)}{rnd.choice(SIGNS)}": made(rnd, depth + 1) for _ in range(rnd.randrange(4))}


@pytest.mark.parametrize("style", [{}, {"indent": 2}, {"separators": (",", ":"), "ensure_ascii": False}])
@pytest.mark.parametrize("size", [300, 2000, 1 << 20])
def test_objects_of_an_array(spark, tmp_path, style, size):
    rnd = random.Random(5)
    for name, n in (("a", 400), ("b", 1), ("empty", 0), ("c", 60)):
        rows = [{"id": f"{name}{k}", "x": made(rnd)} for k in range(n)]
        rows += [{"id": f"{name}-long", "x": "}" * 3000}, {}] if name == "c" else []
        (tmp_path / f"{name}.json").write_text(json.dumps(rows, **style), newline="")
    (tmp_path / "void.json").write_text(" \n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        got = [json.loads(r.object) for r in json_arrays.array_objects(spark, str(tmp_path)).collect()]
        ranges = json_arrays.fragments(spark, str(tmp_path / "a.json")).select("range").distinct().count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [x for f in tmp_path.glob("*.json") if f.read_text().strip() for x in json.loads(f.read_text())]
    assert sorted(map(json.dumps, got)) == sorted(map(json.dumps, want))
    assert ranges > 5 if size < 10_000 else ranges == 1


def test_small_ranges_share_tasks(spark, tmp_path):
    rows = [{"id": k, "x": "}{" * (k % 5)} for k in range(3000)]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    before = set(Path(urlparse(scale.shared_folder(spark)).path).glob("json-array-*"))
    got = json_arrays.read_json_array(spark, str(tmp_path), range_bytes=500)
    assert sorted((r.id, r.x) for r in got.collect()) == [(r["id"], r["x"]) for r in rows]
    (folder,) = set(Path(urlparse(scale.shared_folder(spark)).path).glob("json-array-*")) - before
    for part in ("ranges", "objects"):  # about 180 ranges, read by no more tasks than there are cores
        assert len(list((folder / part).glob("part-*"))) <= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("text", ['[1, {"a": 1}]', '[{"a": 1}, null]', '[[{"a": 1}]]', '[{"a": 1}, "}"]'])
def test_arrays_of_anything_else_are_errors(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception, match="an array of objects is wanted"):
        json_arrays.read_json_array(spark, str(tmp_path / "x.json"))


def test_read_json_tells_arrays_and_objects_apart(spark, tmp_path):
    (tmp_path / "a.json").write_text("﻿\n [\n" + json.dumps({"a": 1, "b": {"c": "}"}}) + "\n]\n", encoding="utf-8")
    (tmp_path / "o.json").write_text(json.dumps({"a": 1, "b": {"c": "}"}}, indent=1))
    assert [tuple(r) for r in readers.read_json(spark, str(tmp_path / "a.json")).select("a", "b.c").collect()] == [(1, "}")]
    assert readers.read_json(spark, str(tmp_path / "o.json")).columns == ["a", "b.c"]


def root_of(data, size, fan):
    level = [hashlib.sha256(data[k:k + size]).hexdigest() for k in range(0, max(len(data), 1), size)]
    n = len(level)
    while len(level) > 1:
        level = [hashlib.sha256("".join(level[k:k + fan]).encode()).hexdigest() for k in range(0, len(level), fan)]
    return n, level[0]


def test_roots_do_not_depend_on_the_ranges(spark, tmp_path):
    rnd = random.Random(4)
    files = {"none": b"", "one": b"x", "newline": b"\n", "newlines": b"\n" * 999, "mark": b"\xef\xbb\xbf" + b"ab\ncd" * 400, "marked": b"\xef\xbb\xbf\n",
             "zeros": b"\0" * 5000, "binary": rnd.randbytes(20_000), "ends": rnd.randbytes(3000) + b"\n", "returns": b"a\r\nb\r" * 700,
             "exact": rnd.randbytes(2048)}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    for split in (300, 1111, 1 << 20):
        for size, fan in ((256, 3), (1024, 2), (1 << 20, 256)):
            if split == 300 and size != 256:
                continue
            digests = blocks.block_digests(spark, [str(tmp_path)], size, range_bytes=split)
            got = {r.file.rsplit("/", 1)[1]: (r.size, r.n_blocks, r.root) for r in blocks.merkle_roots(digests, fan).collect()}
            assert got == {name: (len(data), *root_of(data, size, fan)) for name, data in files.items() if data}, (split, size)


def test_manifest_names_the_plain_hash_of_small_files(spark, tmp_path):
    writers.write_parquet(spark.range(5000).repartition(3), f"{tmp_path}/t.parquet")
    got = {r.path.rsplit("/", 1)[1]: r for r in writers.artifact_manifest(spark, [f"{tmp_path}/t.parquet"]).collect()}
    parts = list((tmp_path / "t.parquet").glob("part-*"))
    assert len(got) == len(parts) == 3
    for part in parts:
        r = got[part.name]
        assert (r.name, r.format, r.size_bytes, r.n_blocks) == ("t.parquet", "parquet", part.stat().st_size, 1)
        assert r.sha256 == "sha256:" + hashlib.sha256(part.read_bytes()).hexdigest()
