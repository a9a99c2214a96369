"""JSON arrays cut over many blocks give the same rows as a whole read."""

import json
import os

import pytest

from tabulark.sources.io import read_json
from tabulark.sources.json_array import IN, OUT, array_records, pieces, step


def hostile_records():
    odd = ['}', '{', '[{"a":1}]', 'quote " inside', "back\\slash", 'end\\', '\\"', "é 日本", "},{", "", " \t", 'a\\\\"}']
    return [{"i": i, "s": odd[i % len(odd)] * (1 + i % 5), "deep": {"x": {"y": i / 3}, "l": [1, {"z": "}"}]}, "none": None} for i in range(300)]


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("block", [97, 1000, 1 << 20])
def test_rows_do_not_depend_on_blocks(spark, tmpdir_path, indent, block):
    path = os.path.join(tmpdir_path, "a.json")
    records = hostile_records()
    with open(path, "w", encoding="utf-8") as f:
        json.dump(records, f, indent=indent, ensure_ascii=False)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        texts = array_records(spark, path)
        if block == 1000:
            assert texts.rdd.getNumPartitions() > 8
        got = [json.loads(r["value"]) for r in texts.collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(got, key=lambda r: r["i"]) == records
    rows = read_json(spark, path)
    assert rows.columns == ["deep.l", "deep.x.y", "i", "none", "s"]
    assert {r["i"]: r["s"] for r in rows.collect()} == {r["i"]: r["s"] for r in records}


def test_empty_and_object_forms(spark, tmpdir_path):
    for n, (text, want) in enumerate([("[]", []), (" \n [ ] ", []), ('{"data": [{"a": 1}, {"a": 2}]}', [1, 2]), ('\n[{"a": 3},\n null, {"a": 4}]\n', [3, 4])]):
        path = os.path.join(tmpdir_path, f"{n}.json")
        with open(path, "w") as f:
            f.write(text)
        got = read_json(spark, path)
        assert sorted(r["a"] for r in got.collect()) == want


def test_scanner():
    assert step('[{"a":"}', OUT) == (IN, 2) and step('"}]', IN) == (OUT, -2)
    assert [p[0] for p in pieces('[{"a":{}},{"b":"}"}]', OUT, 0)] == ['[{"a":{}}', ',{"b":"}"}', "]"]
