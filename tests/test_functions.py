import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeshelf.errors import NotSupportedError, ValidationError
from lakeshelf.functions import mime as M
from lakeshelf.functions import misc, paths, text
from lakeshelf.operators.bounds import plan_index, satisfies_bounds
from lakeshelf.operators.cursor import decode_cursor, encode_cursor


def test_text_folding_and_tokens():
    assert text.normalize_text("  Zażółć\u00a0 GĘŚLĄ\nJaźń ß Æ œ ø ") == "zazolc gesla jazn ss ae oe o"
    assert text.tokenize("myFileName-2.txt a") == ["my", "file", "name", "2", "txt", "a"]
    assert text.match_tokens("A-b cé") == ["a", "b", "ce"]
    assert text.bounded_levenshtein("beach", "bech", 1) == 1 and text.bounded_levenshtein("abc", "xyz", 1) == 2
    assert text.count_occurrences("aaaa", "aa") == 2 and text.count_occurrences("a", "") == 0


def test_folding_in_columns_is_that_of_the_driver(spark):
    values = ["Zażółć  GĘŚLĄ", "straße ŒUVRE Æ", "İıŁø", "日本 \u00a0 x\ufeffy", "ÀÉÎõü ñ", "e\u0301", "Ελληνικά й"]
    got = spark.createDataFrame([(v,) for v in values], "v string").select(text.fold_column(F.col("v")).alias("f")).collect()
    assert [r.f for r in got] == [text.normalize_text(v) for v in values]


@given(st.text(alphabet="aé /\\.B", max_size=12))
@settings(max_examples=60, deadline=None)
def test_folders_are_stable(path):
    once = paths.normalize_folder(path)
    assert paths.normalize_folder(once) == once and once.startswith("/")


def test_folders():
    assert paths.normalize_folder("\\a//b/./ c /") == "/a/b/c" and paths.normalize_folder(None) == "/"
    assert paths.is_inside("/ab", "/a") is False and paths.is_inside("/a/b", "/a") and paths.is_inside("/x", "/")
    for bad in ("x" * 2000, "a\x01"):
        with pytest.raises(ValidationError):
            paths.normalize_folder(bad)


def test_metadata():
    value = {"b": 1.0, "a": [dt.datetime(2024, 1, 2, 3, 4, 5)], "n": None}
    assert paths.normalize_metadata(value) == {"b": 1, "a": ["2024-01-02T03:04:05.000Z"], "n": None}
    for bad in (float("nan"), b"x", object()):
        with pytest.raises(ValidationError):
            paths.normalize_metadata({"x": {"y": bad}})
    assert paths.metadata_text({"camera": {"maker": "Foo", "lens": [1, 2]}, "ok": True, "no": None}) == "maker Foo lens 1 lens 2 ok true"
    assert paths.get_by_path({"a": [{"b": 5}]}, "a.0.b") == 5
    with pytest.raises(KeyError):
        paths.get_by_path({"a": 1}, "a.b")


@pytest.mark.parametrize(
    ("name", "extension", "mime", "kind"),
    [
        ("a/b.c/Photo.PNG", "png", "image/png", "image"),
        (".gitignore", "", M.OCTETS, "other"),
        ("x.", "", M.OCTETS, "other"),
        ("t.tsx", "tsx", "text/tsx", "text"),
        ("t.ts", "ts", "text/typescript", "code"),
        ("d.docx", "docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "document"),
        ("s.xlsx", "xlsx", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "spreadsheet"),
        ("y.yml", "yml", "application/yaml", "code"),
        ("z.tar.gz", "gz", "application/gzip", "archive"),
        ("f.woff2", "woff2", "font/woff2", "font"),
    ],
)
def test_media_types(spark, name, extension, mime, kind):
    assert (M.extension_of(name), M.mime_from_name(name), M.kind_from_mime(mime)) == (extension, mime, kind)
    row = spark.createDataFrame([(name,)], "n string").select(M.extension_column(F.col("n")), M.mime_column(F.col("n")), M.kind_column(M.mime_column(F.col("n")))).first()
    assert tuple(row) == (extension, mime, kind)


def test_media_type_tables():
    assert len(M.EXTENSIONS) == 93 and len(M.KINDS) == 22
    assert M.with_extension("a", "text/html; charset=x") == "a.html" and M.with_extension("a.b", "text/html") == "a.b"
    assert M.text_preview(b"a\x00b\xff", "text/plain", 10) == "a b\ufffd" and M.text_preview(b"a", "image/png", 9) == ""


def test_small_helpers(spark):
    assert [misc.format_bytes(x) for x in (0, 1023, 1024, 1536, 10**6, -1, float("nan"))] == ["0 B", "1023 B", "1 KB", "1.5 KB", "976.6 KB", "0 B", "0 B"]
    assert misc.fit_within(4000, 2000, 256) == (256, 128) and misc.fit_within(10, 5, 256) == (10, 5) and misc.fit_within(10000, 1, 16) == (16, 1)
    assert misc.to_timestamp(dt.datetime(1970, 1, 1, 0, 0, 1)) == 1000 and misc.to_timestamp(float("inf")) is None
    assert misc.normalize_tags([" A ", "a", "", "b"]) == ["A", "b"]
    assert misc.chunk_count(0, 5) == 1 and misc.chunk_count(11, 5) == 3
    assert misc.content_hash(b"") == "sha256:e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert misc.fnv128(b"").startswith("fnv128x:6c62272e07bb0142")
    with pytest.raises(NotSupportedError):
        misc.to_bytes(5)


def test_cursor_round_trip():
    token = encode_cursor(["ü", None, 3], "id/1", 2.5)
    assert decode_cursor(token) == {"v": 1, "k": ["ü", None, 3], "id": "id/1", "s": 2.5} and "=" not in token
    for bad in ("%%%", "bm8", encode_cursor([], "x")[:-3]):
        with pytest.raises(ValidationError):
            decode_cursor(bad)


def test_index_plans():
    assert plan_index({}).index == "by_deleted" and plan_index({"deleted": True}).index is None
    assert plan_index({"id": ["x"]}).exact == "x"
    assert plan_index({"name": "AbC", "kind": "text"}).exact == "abc"
    assert plan_index({"name": ["a"]}).index == "by_deleted" and plan_index({"kind": ["text"]}).index == "by_kind"
    assert plan_index({"folder": {"startsWith": "a/"}}).prefix == "/a"
    assert plan_index({"size": {"gt": 10, "gte": 10, "between": [3, 20]}}).lower.open
    assert plan_index({"size": {"gt": 10, "lt": 5}}).empty
    assert plan_index({"size": {"ne": 5}, "favorite": False}).index == "by_favorite"
    assert plan_index({"tags": {"any": ["Trip"]}}).exact == "trip"
    assert satisfies_bounds(10, {"gte": 10, "lt": 11}) and not satisfies_bounds(10, {"gt": 10, "gte": 10})
