"""Sources, sinks and relation operators on small tables."""

import gzip
import io
import json
import zipfile

import pytest

from tessera.operators import relations as L
from tessera.sources import tables as S


def test_typed_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id,score,ok,name,none\n1,1.5,true,"a ""q"", b",NA\n2,NaN,false,,null\n', encoding="utf-8")
    df = S.read_csv(spark, str(tmp_path / "a.csv"))
    assert dict(df.dtypes) == {"id": "bigint", "score": "double", "ok": "boolean", "name": "string", "none": "string"}
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, 1.5, True, 'a "q", b', None), (2, None, False, None, None)]
    literal = S.read_csv(spark, str(tmp_path / "a.csv"), "id string, score string, ok string, name string, none string", literal=True)
    assert [tuple(r) for r in literal.orderBy("id").collect()][1] == ("2", "NaN", "false", "", "null")


def test_deterministic_sinks():
    one, two = {"b": [1, "é"], "a": None}, {"a": None, "b": [1, "é"]}
    assert S.canonical_json(one) == S.canonical_json(two) and S.canonical_json(one).endswith(b"\n")
    assert S.canonical_gzip(one) == S.canonical_gzip(two) and json.loads(gzip.decompress(S.canonical_gzip(one))) == one
    assert S.fixed_zip({"x": b"1", "y": b"2"}) == S.fixed_zip({"y": b"2", "x": b"1"})
    assert zipfile.ZipFile(io.BytesIO(S.fixed_zip({"y": b"2", "x": b"1"}))).namelist() == ["x", "y"]


def test_json_objects(spark, tmp_path):
    (tmp_path / "a.json.gz").write_bytes(S.canonical_gzip({"k": 1, "m": {"z": [1]}}))
    assert {tuple(r) for r in S.read_map(spark, str(tmp_path / "a.json.gz")).collect()} == {("k", "1"), ("m", '{"z":[1]}')}
    (tmp_path / "b.json").write_text("[1, 2]")
    with pytest.raises(Exception, match="not a JSON object"):
        S.read_map(spark, str(tmp_path / "b.json")).collect()
    (tmp_path / "c.json").write_text('{"a":\n [1, 2]}')
    assert S.read_json(spark, str(tmp_path / "c.json")).first().a == [1, 2]


def test_search_rankings(spark):
    lists = spark.createDataFrame([("q", "x", ["a", "b"]), ("q", "y", [])], "query string, arm string, items array<string>")
    compact = spark.createDataFrame([("q", "x", 1, "c"), ("q", "y", 1, "d"), ("r", "x", 1, "e")], "query string, arm string, rank int, space_id string")
    assert {tuple(r) for r in S.search_rankings(lists, compact, ["q"], ["x", "y"]).collect()} == {("q", "x", 1, "a"), ("q", "x", 2, "b"), ("q", "y", 0, "")}
    assert S.search_rankings(lists, compact, ["q", "r"], ["x"]).count() == 3
    with pytest.raises(ValueError):
        S.search_rankings(lists, compact, ["q", "r"], ["y"])


def test_file_manifest(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.py").write_bytes(b"x = 1\n")
    (tmp_path / "d" / "b.bin").write_bytes(b"0" * 20)
    got = {r.file_path.rsplit("/", 1)[1]: r for r in S.file_manifest(spark, str(tmp_path / "d"), max_bytes=10).collect()}
    assert got["a.py"].content == b"x = 1\n" and got["b.bin"].content is None and got["b.bin"].bytes == 20 and len(got["a.py"].sha256) == 64


def test_relations(spark):
    big = spark.createDataFrame([(1, "a", None), (1, "b", None), (2, None, "z")], "i int, s string, t string")
    assert [tuple(r) for r in L.additional_rows(big, big.filter("s IS NULL OR s = 'a'"), ["i", "s", "t"]).collect()] == [(1, "b", None)]
    assert L.additional_rows(big, big.limit(0), ["i"]).count() == 3
    repos = spark.createDataFrame([("Org/App", 3), ("org/app", 2), ("ORG/APP", 2), (None, 1)], "repo string, p int")
    assert [tuple(r) for r in L.repository_projects(repos, "repo", "p").collect()] == [("org/app", "ORG/APP", [2, 3])]
    left, right = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 1.0)], "k string, v double"), spark.createDataFrame([("a", 1.0 + 1e-13), ("b", None), ("d", 1.0)], "k string, v double")
    assert {tuple(r) for r in L.reproduced(left, right, "k", "v").collect()} == {("a", True), ("b", True), ("c", False), ("d", False)}
    assert L.deidentified(left, ("k", "missing")).columns == ["k", "missing"]
