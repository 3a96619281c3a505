"""Column functions on small literal tables."""

import json
import math

import pytest
from pyspark.sql import functions as F

from mangrove.errors import MarkdownPathError, ValidationError
from mangrove.functions import canonical, names, paths, slugs


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").orderBy("i")


def apply(spark, f, values, kind="string"):
    return [r[0] for r in column(spark, values, kind).select(f(F.col("x")).alias("y")).collect()]


def test_slugs(spark):
    cases = {
        "Hello World": "hello-world", "  Crème  Brûlée! ": "creme-brulee", "ﬁne_Ｆull": "fine-full", "Straße Æon": "strasse-aeon",
        "東京 Tower": "東京-tower", "a--b__c": "a-b-c", "New": None, "!!!": None, "": None, None: None, "x" * 70: "x" * 64,
    }
    assert apply(spark, slugs.generate_slug, list(cases)) == list(cases.values())
    assert apply(spark, lambda x: slugs.generate_slug(x, unicode=False), ["Crème brûlée"]) == ["creme-brulee"]
    assert apply(spark, lambda x: slugs.generate_slug(x, strategy="none"), ["Crème"]) == ["crème"]
    assert apply(spark, lambda x: slugs.generate_slug(x, strategy=lambda c: F.replace(c, F.lit("x"), F.lit("ks"))), ["fax"]) == ["faks"]
    why = lambda x: slugs.slug_error(x, slugs.slug_base(x))
    assert apply(spark, why, ["New", "!!!", "", "ok"]) == ["reserved", "empty", "input", None]


def test_limit_length(spark):
    assert apply(spark, lambda x: slugs.limit_length(x, 12), ["hello-world-test-foo", "short", "abcdefghijklmnop"]) == ["hello-world", "short", "abcdefghijkl"]
    assert apply(spark, lambda x: slugs.limit_length(x, 12, 2), ["ab-cdefghijklmn"]) == ["ab-cdefghi"]


def test_slug_checks(spark):
    values = ["ok", "a-b", "a--b", "A", "-a", "", None, "é", "1-2"]
    assert apply(spark, slugs.is_slug, values) == [True, True, True, False, False, False, False, False, True]
    assert apply(spark, slugs.is_slug_string, values) == [True, True, False, True, False, False, False, True, False]
    assert apply(spark, slugs.normalize_slug, ["Ab c_d!", "é"]) == ["ab-c-d", None]


def test_paths(spark):
    values = ["/us", "/us/ny", "/", "us", "/a//b", "/a/", "/../b", "/A", None]
    assert apply(spark, paths.path_error, values) == [None, None, "segment", "start", "slashes", "end", "traversal", "segment", "start"]
    assert apply(spark, paths.depth, ["/", "/a", "/a/b"]) == [0, 1, 2]
    assert apply(spark, paths.parent_path, ["/", "/a", "/a/b"]) == [None, "/", "/a"]
    assert apply(spark, paths.last_segment, ["/", "/a", "/a/b"]) == [None, "a", "b"]
    assert apply(spark, paths.decode_path, ["/", "/a/b"]) == [[], ["a", "b"]]
    assert apply(spark, lambda x: paths.path_error(x, 1), ["/a/b"]) == ["depth"]
    assert apply(spark, paths.parse_sort_key, ["t|s|i", "a|b"])[0].slug == "s"
    assert apply(spark, lambda x: paths.child_sort_key(x, F.lit(None).cast("string"), F.lit("1")), ["t"]) == ["t||1"]


def test_canonical_text():
    assert canonical.canonical_text({"name": "Alice", "type": "user", "id": "alice"}) == '{\n  "id": "alice",\n  "name": "Alice",\n  "type": "user"\n}\n'
    assert list(json.loads(canonical.canonical_text({"b": 1, "10": 1, "2": 1}))) == ["2", "10", "b"]
    assert canonical.canonical_text({"b": 1, "a": [], "c": {}}, order=["c"], indent=0, trailing_newline=False) == '{"c":{},"a":[],"b":1}'
    assert canonical.canonical_text([1], eol="CRLF") == "[\r\n  1\r\n]\r\n"
    numbers = {1e3: "1000", 2.50: "2.5", 1e21: "1e+21", 1.5e-7: "1.5e-7", 0.000001: "0.000001", -0.0: "0", 123456789012345680000.0: "123456789012345680000", 0.1: "0.1", 5e-324: "5e-324", -1.25: "-1.25"}
    assert [canonical._number(x) for x in numbers] == list(numbers.values())


def test_canonical_json(spark):
    got = apply(spark, canonical.canonical_json, ['{"b":1e3,"a":[1,{"z":null,"y":"é"}]}', "{", None, '﻿{"a":1,"a":2}', "NaN"])
    assert got[0].value == '{\n  "a": [\n    1,\n    {\n      "y": "é",\n      "z": null\n    }\n  ],\n  "b": 1000\n}\n'
    assert got[1].value is None and got[1].error and got[2].error is None and json.loads(got[3].value) == {"a": 2} and got[4].error
    again = apply(spark, canonical.canonical_json, [got[0].value])[0].value
    assert again == got[0].value
    assert apply(spark, lambda x: canonical.json_equal(x, F.lit('{"a":1,"b":[2]}')), ['{"b":[2],"a":1}', "{", '{"a":1}', None]) == [True, False, False, False]
    assert [r.error for r in apply(spark, canonical.safe_parse, ["{", "1", None])] == ["malformed JSON", None, None]


def test_names(spark):
    values = ["a", "a.b_c-1", ".a", "-a", "a..b", "a.", "con", "CON.txt", "a b", "", None]
    want = [True, True] + [False] * 9
    assert apply(spark, names.is_name, values) == want
    for v, good in zip(values, want):
        if good:
            names.validate_name(v)
        else:
            with pytest.raises(ValidationError):
                names.validate_name(v)
    assert apply(spark, names.is_type_name, ["a", "_a", ".a", "a/b", "a:b"]) == [True, False, False, False, False]
    assert apply(spark, names.is_schema_ref, ["schema/city@1", "schema/city", "city@1"]) == [True, False, False]
    with pytest.raises(ValidationError):
        names.sanitize_path("a/../b")


def test_formats(spark):
    cases = {
        "slug": {"a-b": True, "A": False, "a_b": False}, "iso3166-1-alpha-2": {"US": True, "us": False, "XX": False},
        "iso3166-2": {"US-NY": True, "us-ny": False, "XX-A": False, "GB-ENG": True}, "ipv4": {"1.2.3.4": True, "256.1.1.1": False},
        "markdown_path": {"./docs/readme.md": True, "readme.md": True, "../readme.md": False, "/abs.md": False, "a%2e.md": False, "c:x.md": False, "a\\b.md": False, " a.md": False},
        "date": {"2024-02-29": True, "2023-02-29": False, "x": False}, "date-time": {"2024-01-01T10:00:00Z": True, "2024-01-01": False, "2024-01-01T25:00:00Z": False},
        "email": {"a@b.co": True, "a@": False}, "uri": {"http://x.y": True, "x y": False}, "uuid": {"123e4567-e89b-12d3-a456-426614174000": True, "123": False},
    }
    for name, values in cases.items():
        assert apply(spark, lambda x, name=name: names.format_check(name, x, spark), list(values)) == list(values.values()), name
    with pytest.raises(ValidationError):
        names.format_check("nonsense", F.lit(""))


def test_markdown_paths(spark, tmp_path):
    cases = {"a.md": "a.md", "./x//y.md": "x/y.md", "x\\y.md": "x/y.md", "A.MD": "A.MD", "..%2fa.md": None, "%252e%252e/a.md": None, "/a.md": None, "c:\\a.md": None, "con.md": None, "a.txt": None, "a/./b.md": None, "": None}
    for path, want in cases.items():
        if want is None:
            with pytest.raises(MarkdownPathError):
                names.normalize_markdown_path(path)
        else:
            assert names.normalize_markdown_path(path) == want
    assert apply(spark, names.is_markdown_path, list(cases)) == [v is not None for v in cases.values()]
    (tmp_path / "a.md").write_text("x")
    assert names.resolve_within(str(tmp_path), "a.md").name == "a.md"
    (tmp_path / "b.md").symlink_to(tmp_path / "a.md")
    with pytest.raises(MarkdownPathError):
        names.resolve_within(str(tmp_path), "b.md")
    assert names.render_cache_path("/d/", "k") == "/d/.cache/k.html" and names.validate_cache_path(".cache/k.html")


def test_sizes_and_pointers(spark):
    values = {0: "0 Bytes", 1023: "1023 Bytes", 1024: "1 KB", 1536: "1.5 KB", 1152: "1.13 KB", 5 << 20: "5 MB"}
    assert apply(spark, names.format_bytes, list(values), "long") == list(values.values())
    assert [names.bytes_text(v) for v in values] == list(values.values())
    assert names.resolve_pointer({"a/b": [{"~": 1}]}, "#/a~1b/0/~0") == 1
    assert math.isnan(float("nan"))


def test_shard_key(spark):
    import hashlib

    digest = hashlib.sha256(b"key").hexdigest()
    got = apply(spark, lambda x: paths.shard_key(x, 16), ["key"])[0]
    assert got.bucket == f"{int(digest[:2], 16) % 16:02x}" and got.suffix == digest[2:10]
