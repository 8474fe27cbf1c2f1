"""Sources and sinks on small files written by the tests."""

import io
import json
import tarfile
import zipfile

import pytest

from seqloom.operators import validation
from seqloom.sources import artifacts, files, graphemes, treebank


def artifact(n, **changes):
    token = {"token_id": "t0", "sign_id": "S1", "visual_index": 0, "reading_index": 0, "confidence": 1.0, "condition": "clear", "uncertainty": {"status": "clear", "alternatives": []}, "source_record_ids": ["r1"]}
    rights = {"status": "open_licensed", "license_id": "X", "redistribution": True, "derivatives": True, "statement": "s"}
    record = {
        "schema_version": "0.1.0", "artifact_id": f"a{n}", "source_records": [{"source_record_id": "r1", "source_id": "s", "upstream_record_id": "u", "role": "transcription"}], "rights": rights,
        "catalog_crosswalk": [{"catalog": "C", "identifier": "1", "certainty": 1.0}], "site": {"site_id": "x", "certainty": 1.0}, "period": {"basis": "b", "certainty": 0.5}, "object": {"object_type": "seal", "condition": "c"},
        "images": [{"image_id": "i1", "source_id": "s", "image_role": "r", "image_hash": "sha256:" + "0" * 64, "rights": rights}],
        "sides": [{"side_id": "A", "physical_form": "f", "image_ids": ["i1"], "lines": [{"line_id": "l0", "visual_order_basis": "left_to_right_in_image", "reading_direction": "left_to_right", "direction_confidence": 1.0, "tokens": [token, token | {"token_id": "t1", "visual_index": 1, "reading_index": 1}]}]}],
    }
    return record | changes


def load(spark, tmp_path, records):
    path = tmp_path / "corpus.jsonl"
    path.write_text("".join(json.dumps(r) + "\n\n" for r in records))
    return artifacts.json_lines(spark, str(path)).coalesce(1)


def codes(spark, tmp_path, *records):
    return sorted((r.code, r.path) for r in validation.validate(load(spark, tmp_path, records)).collect())


def test_a_sound_artifact_has_no_issues(spark, tmp_path):
    assert codes(spark, tmp_path, artifact(1), artifact(2)) == []


def test_issues_name_code_and_path(spark, tmp_path):
    bad = artifact(1, schema_version="9", site={"certainty": 1.0}, sides=[])
    found = codes(spark, tmp_path, bad, artifact(1))
    assert ("unsupported_schema_version", "$.schema_version") in found and ("unknown_site", "$.site") in found and ("empty_artifact", "$.sides") in found and ("duplicate_artifact_id", "$.artifact_id") in found


def test_token_and_line_rules(spark, tmp_path):
    record = artifact(1)
    line = record["sides"][0]["lines"][0]
    line["tokens"][1] |= {"visual_index": 5, "confidence": 2.0, "condition": "odd", "token_id": "t0", "source_record_ids": ["zz"], "sign_id": ""}
    line["reading_direction"] = "unknown"
    record["sides"][0]["image_ids"] = ["nope"]
    record["rights"] = record["rights"] | {"license_id": None}
    got = {c for c, _ in codes(spark, tmp_path, record)}
    assert {"noncontiguous_visual_order", "invalid_confidence", "invalid_token_condition", "duplicate_token_id", "unknown_source_record_reference", "invalid_sign_id", "direction_order_conflict", "unknown_image_reference", "missing_license"} <= got
    assert "noncontiguous_reading_order" not in got
    severities = {r.code: r.severity for r in validation.validate(load(spark, tmp_path, [record])).collect()}
    assert severities["direction_order_conflict"] == "warning" and severities["invalid_confidence"] == "error"


def test_json_limits_equal_a_walk():
    def walk(value, depth=0):
        below = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
        found = [walk(v, depth + 1) for v in below]
        return max([depth, *(d for d, _ in found)]), 1 + sum(n for _, n in found)

    for text in ("1", "[]", "[ ]", "{}", "[1,2]", '{"a":[{"b":[]},"],[{"],"c":"\\""}', '[[[[1]]],{"x":{"y":null}}]', '"[[["'):
        depth, values = walk(json.loads(text))
        size = len(text)
        artifacts.strict_json(text, artifacts.JsonLimits(size, depth, values))
        for less in ((size - 1, depth, values), (size, depth - 1, values), (size, depth, values - 1)):
            if depth or less[1] >= 0 and less[2] >= 1:
                with pytest.raises(artifacts.StrictJsonError, match="more than"):
                    artifacts.strict_json(text, artifacts.JsonLimits(*less))
    for text in ("[" * 100_000, '"' + '\\"' * 200_000, "\\"):
        with pytest.raises(artifacts.StrictJsonError):
            artifacts.strict_json(text, artifacts.JsonLimits())


def test_strict_json_says_what_is_wrong(spark, tmp_path):
    for text, word in (('{"a":1,"a":2}', "twice"), ('{"a":NaN}', "finite"), ('{"a":1e999}', "finite"), ("{", "Expecting")):
        with pytest.raises(artifacts.StrictJsonError, match=word):
            artifacts.strict_json(text)
    path = tmp_path / "x.jsonl"
    path.write_text('{"b":1,"a":2}\n\n{"a":1,"a":2}\n')
    got = sorted(((r.line, r.canonical, r.error) for r in artifacts.checked_lines(spark, str(path)).collect()))
    assert got[0] == (1, '{"a":2,"b":1}', None) and got[1][0] == 3 and "twice" in got[1][2]
    with pytest.raises(Exception, match="x.jsonl:3"):
        artifacts.strict_json_lines(spark, str(path), "a int, b int").collect()
    path.write_text('{"b":1,"a":2}\n')
    assert [tuple(r) for r in artifacts.strict_json_lines(spark, str(path), "a int, b int").collect()] == [(2, 1)]


def test_json_lines_come_back_and_are_not_replaced(spark, tmp_path):
    df = spark.createDataFrame([(2, "é", None), (1, "x", 0.5)], "n int, b string, a double")
    path = str(tmp_path / "out")
    artifacts.write_json_lines(df, path, ["n"])
    lines = [line for p in sorted((tmp_path / "out").glob("part-*")) for line in p.read_text().splitlines()]
    assert lines == ['{"a":0.5,"b":"x","n":1}', '{"a":null,"b":"é","n":2}']
    with pytest.raises(Exception, match="(?i)exists"):
        artifacts.write_json_lines(df, path, ["n"])


def test_registry_keys_are_unique(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "source_id string, v int")
    assert artifacts.registry(df).count() == 2
    with pytest.raises(Exception, match="repeated: a"):
        artifacts.registry(df.union(df.limit(1))).collect()


def test_walked_texts(spark):
    df = spark.createDataFrame([("k", '{"b":["x",{"c":"y"}],"a":"z","n":1}')], "key string, j string")
    assert sorted((r.path, r.text) for r in artifacts.walked_texts(df, "key", "j").collect()) == [("$.a", "z"), ("$.b[0]", "x"), ("$.b[1].c", "y")]


def test_grapheme_files(spark, tmp_path):
    side = {"id": "M-1A", "description": "d", "graphemes": [{"id": "P1", "features": [0, 1, 20]}, {"id": "P2", "features": [120, 1, 0]}, {"id": "P3", "features": [5, 2, 0]}]}
    (tmp_path / "m0").mkdir()
    (tmp_path / "m0" / "m1.json").write_text(json.dumps([side], indent=1))
    (row,) = graphemes.read(spark, str(tmp_path)).collect()
    first, second = row.sides[0].lines
    assert row.artifact_id == "M-1" and [(t.sign_id, t.visual_index, t.reading_index, t.confidence, t.condition) for t in first.tokens] == [("P1", 0, 1, 0.8, "clear"), ("P2", 1, 0, 1.0, "damaged")]
    assert second.tokens[0].token_id == "M-1A:L2:T3" and [w.raw_value for w in row.warnings] == [120]


def document(name, rows, head=None):
    return "\n".join([head or f"#new_text={name}", treebank.HEADER, *rows, ""])


ROW = "1.1\tba-an\tba[x]\tN\t_\t_\t_"


def test_treebank_sets_whole_documents_aside(spark, tmp_path):
    good = document("P000001", [ROW, "1.2\t5\tx[unit]\tu\t_\t_\t_", "2.1\tlu\tlu\tPN\t_\t_\t_"])
    docs = {
        "P000001": good, "P000002": document("P000002", [ROW, "bad row"]), "P000003": document("P000003", [ROW, ROW]), "P000004": document("P000009", [ROW]),
        "P000005": document("P000005", ["# note", ROW]), "P000006": document("P000006", ["1\tx\t[unit]\tPN\t_\t_\t_"]), "P000007": document("P000007", []), "X1": document("P000008", [ROW]),
    }
    (tmp_path / "c").mkdir()
    for name, text in docs.items():
        (tmp_path / "c" / f"{name}.conll").write_text(text)
    tokens, aside = treebank.parse(treebank.folder(spark, str(tmp_path)))
    assert sorted((r.name, r.visual_index, r.form, r.truth) for r in tokens.collect()) == [("P000001", 0, "ba-an", None), ("P000001", 1, "5", "unit"), ("P000001", 2, "lu", "person_name")]
    assert {r.name: (r.reason, r.line) for r in aside.collect()} == {
        "P000002": ("non_7_column_row", 4), "P000003": ("duplicate_token_position", 4), "P000004": ("p_identifier_mismatch", 1), "P000005": ("unsupported_comment", 3),
        "P000006": ("overlapping_gold_classes", 3), "P000007": ("no_token_rows", None), "X1": ("invalid_p_identifier", None),
    }
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("d/P000001.conll", good)
        z.writestr("readme.txt", "x")
    (tmp_path / "a.zip").write_bytes(packed.getvalue())
    with tarfile.open(tmp_path / "a.tar", "w") as t:
        t.add(tmp_path / "c" / "P000001.conll", "P000001.conll")
    for name in ("a.zip", "a.tar"):
        assert [tuple(r) for r in treebank.archives(spark, str(tmp_path / name)).collect()] == [("P000001", good)]
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("../P000001.conll", good)
    with pytest.raises(Exception, match="outside its own folder"):
        treebank.archives(spark, str(tmp_path / "b.zip")).collect()


def test_nested_lemmas(spark):
    tree = {"cdl": [{"node": "c", "cdl": [{"node": "d", "type": "line-start"}, {"node": "l", "f": {"form": "a", "pos": "N", "gw": "unit"}}, {"node": "c", "cdl": [{"node": "d", "type": "line-start"}, {"node": "l", "f": {"form": "b"}}]}]}, {"node": "l", "f": {"form": "c", "pos": "PN"}}]}
    df = spark.createDataFrame([("d1", json.dumps(tree))], "name string, j string")
    rows = treebank.nested_lemmas(df, "name", "j")
    got = rows.withColumn("truth", treebank.lemma_truth(rows.pos, rows.gw)).orderBy("token_index").collect()
    assert [(r.line_ordinal, r.form, r.truth) for r in got] == [(0, "a", "unit"), (1, "b", "annotation_unknown"), (1, "c", "person_name")]


def test_catalogue_lines_bitmaps_and_inventory(spark, tmp_path):
    (tmp_path / "c.csv").write_text('id,note\n1,"two\nlines"\n2,"say ""x"""\nEND,\n')
    rows = files.catalogue_csv(spark, str(tmp_path / "c.csv"), ["id", "note"], "END").collect()
    assert [tuple(r) for r in rows] == [("1", "two\nlines"), ("2", 'say "x"')]
    with pytest.raises(Exception):
        files.catalogue_csv(spark, str(tmp_path / "c.csv"), ["id", "other"]).collect()
    (tmp_path / "r.jsonl").write_text('{"a":1}\n{"é":2}\n{"c":3}\n')
    (line,) = files.selected_line(spark, str(tmp_path / "r.jsonl"), 2).collect()
    assert (line.offset, line.bytes, line.text) == (8, 8, '{"é":2}')
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.pbm").write_bytes(b"P4\n9 2\n" + bytes([255, 128, 1, 0]))
    (page,) = files.bitmaps(spark, str(tmp_path / "p")).collect()
    assert (page.width, page.height, bytes(page.content)) == (9, 2, bytes([255, 128, 1, 0]))
    (tmp_path / "p" / "b.pbm").write_bytes(b"P4\n9 2\n" + bytes(3))
    with pytest.raises(Exception, match="not a canonical bitmap"):
        files.bitmaps(spark, str(tmp_path / "p")).collect()
    found = {r.file.rsplit("/", 1)[-1]: (r.format, r.parses, r.rows, r.ragged) for r in files.inventory(spark, str(tmp_path)).collect()}
    assert found["c.csv"] == ("csv", True, 3, 0) and found["r.jsonl"] == ("jsonl", True, 3, 0) and found["a.pbm"][0] in ("other", "binary")


def test_json_schema_issues(spark):
    from seqloom.sources.json_schema import schema_issues

    schema = {
        "type": "object", "required": ["id", "parts"], "additionalProperties": False,
        "properties": {"id": {"$ref": "#/$defs/id"}, "parts": {"type": "array", "minItems": 1, "uniqueItems": True, "items": {"type": ["integer", "null"], "minimum": 0}}, "kind": {"enum": ["a", 1]}, "only": {"const": True}},
        "if": {"properties": {"kind": {"const": "a"}}, "required": ["kind"]}, "then": {"required": ["only"]}, "$defs": {"id": {"type": "string", "pattern": "^[a-z]+$", "maxLength": 3}},
    }
    cases = {
        '{"id":"ab","parts":[1,null]}': set(), '{"id":"ABCD","parts":[]}': {("$.id", "pattern"), ("$.id", "maxLength"), ("$.parts", "minItems")}, '{"parts":[1,1,-1,1.5],"x":0}': {("$.id", "required"), ("$.parts", "uniqueItems"), ("$.parts[2]", "minimum"), ("$.parts[3]", "type"), ("$.x", "additionalProperties")},
        '{"id":"a","parts":[0],"kind":"a"}': {("$.only", "required")}, '{"id":"a","parts":[0],"kind":true,"only":1}': {("$.kind", "enum"), ("$.only", "const")}, "nope": {("$", "json")}, "[]": {("$", "type")},
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "k int, j string")
    got = {k: set() for k in range(len(cases))}
    for r in schema_issues(rows, "k", "j", schema).collect():
        got[r.k].add((r.path, r.keyword))
    assert list(got.values()) == list(cases.values())


def test_content_paths(spark):
    import hashlib

    from pyspark.sql import functions as F

    got = spark.createDataFrame([("é",)], "c string").select(artifacts.content_path("dir/", F.col("c")).alias("p")).first().p
    assert got == f"dir/sha256-{hashlib.sha256('é'.encode()).hexdigest()}.json"
