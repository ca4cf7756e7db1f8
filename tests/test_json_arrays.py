"""JSON arrays cut over many splits, against Python's parser."""

from __future__ import annotations

import json
import random
from pathlib import Path

import pytest

from filmloom.sources import json_arrays, readers


@pytest.fixture()
def small_splits(spark):
    """Splits of 200 bytes, so that elements, strings and brackets lie across them."""
    names = {"spark.sql.files.maxPartitionBytes": "200", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def odd_value(rng: random.Random, depth: int = 3):
    kind = rng.random()
    if kind < 0.4 or not depth:
        return "".join(rng.choices('ab}{][,:"\\\n é漢', k=rng.randint(0, 14)))
    if kind < 0.5:
        return rng.choice([None, True, 7, -1.5])
    if kind < 0.75:
        return [odd_value(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    return {f"k{i}": odd_value(rng, depth - 1) for i in range(rng.randint(0, 3))}


def parsed(rows):
    return [None if r["value"] is None else json.loads(r["value"]) for r in rows.collect()]


@pytest.mark.parametrize("indent, ascii_", [(None, True), (None, False), (2, False)])
def test_objects_in_many_splits(small_splits, tmp_path, indent, ascii_):
    rng = random.Random(indent)
    want = []
    for f in range(3):
        items = [{"id": f * 100 + i, "v": odd_value(rng)} for i in range(40)]
        items[5]["v"] = "}, {" * 200  # one string over several splits
        want += items
        (tmp_path / f"{f}.json").write_text(json.dumps(items, indent=indent, ensure_ascii=ascii_) + "\n" * f)
    rows = json_arrays.read_elements(small_splits, str(tmp_path))
    assert json_arrays._pieces(small_splits, str(tmp_path), "}", None).select("_file", "_block").distinct().count() > 30
    assert sorted(parsed(rows), key=lambda x: x["id"]) == want


def test_plain_values_in_many_splits(small_splits, tmp_path):
    rng = random.Random(4)
    want = ["".join(rng.choices('ab,]["\\ é', k=rng.randint(0, 9))) for _ in range(300)]
    (tmp_path / "a.json").write_text(json.dumps(want))
    assert sorted(r["value"] for r in json_arrays.read_elements(small_splits, str(tmp_path), ",").collect()) == sorted(want)


@pytest.mark.parametrize("text, good, bad", [
    ("[]", 0, 0), (" [ ]\n", 0, 0), ('[{"a": 1}]', 1, 0), ('[{"a": 1}, {}]', 2, 0), ('[{"a": 1} {"a": 2}]', 1, 1), ('[{"a": 1},]', 1, 1),
    ('[{"a": 1}, {"a"', 1, 1), ('[{"a": 1}, {"a": 2}', 1, 1), ('{"a": 1}', 0, 1), ('[1, {"a": 1}, 2]', 3, 0), ('[{"a": 1}, {"a": x}, {"a": 3}]', 2, 1)])
def test_what_is_no_element_is_a_row(spark, tmp_path, text, good, bad):
    (tmp_path / "a.json").write_text(text)
    rows = parsed(json_arrays.read_elements(spark, str(tmp_path)))
    assert (len(rows) - rows.count(None), rows.count(None)) == (good, bad)


@pytest.mark.parametrize("text, want", [("[]", []), ('["a", "b"]', ["a", "b"]), ('["a",,"b"]', [None, "a", "b"]), ('["a", "b"', [None, "a"]),
                                        ('["a,b", "c]"]\n', ["a,b", "c]"]), ('["a",]', [None, "a"])])
def test_values_and_gaps(spark, tmp_path, text, want):
    (tmp_path / "a.json").write_text(text)
    found = [r["value"] for r in json_arrays.read_elements(spark, str(tmp_path), ",").collect()]
    assert sorted(found, key=lambda x: x or "") == want


@pytest.mark.parametrize("indent", [None, 1])
def test_documents_in_many_splits(small_splits, tmp_path, indent):
    """Fields before the array hold objects in objects; entries keep to their document."""
    rng = random.Random(6)
    want = {}
    for f in range(3):
        entries = [{"id": i, "v": odd_value(rng), "entries": []} for i in range(30 * (f > 0))]
        document = {"schemaVersion": f'"entries": [ {f}', "translator": {"modelId": {"a": {"b": [1]}}, "c": {}}, "entries": entries}
        (tmp_path / f"{f}.json").write_text(json.dumps(document, indent=indent) + "\n" * (f % 2))
        want[f] = entries, {**document, "entries": []}
    frames, items = json_arrays.read_document(small_splits, str(tmp_path), "entries")
    number = lambda r: int(Path(r["_file"]).stem)
    assert {number(r): json.loads(r["frame"]) for r in frames.collect()} == {f: d for f, (_, d) in want.items()}
    found = {f: [] for f in want}
    for r in items.collect():
        found[number(r)].append(json.loads(r["value"]))
    assert {f: sorted(v, key=lambda x: x["id"]) for f, v in found.items()} == {f: e for f, (e, _) in want.items()}


def test_entries_of_a_document_that_goes_on_or_ends_early_are_refused(spark, tmp_path):
    head = '{"schemaVersion":"v","sourceTagsSha256":"x","translator":{"m":1},"normalizationVersion":"n","entries":['
    entry = '{"en":"a","machine":"b","sr":"c","reviewStatus":"accepted","manualOverride":false}'
    for name, text in {"whole": f"{head}{entry}]}}\n", "more": f'{head}{entry}],"x":1}}\n', "early": f"{head}{entry},",
                       "order": '{"sourceTagsSha256":"x","schemaVersion":"v","entries":[' + entry + "]}\n"}.items():
        (tmp_path / name).write_text(text)
    rules = {n: [r["failed_rules"] for r in readers.read_dictionary(spark, str(tmp_path / n)).collect()] for n in ("whole", "more", "early", "order")}
    assert len(rules["whole"]) == 1 and "document" not in rules["whole"][0] and "shape" not in rules["whole"][0]
    assert all(rules[n] and all("document" in r for r in rules[n]) for n in ("more", "early", "order"))
