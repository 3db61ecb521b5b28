import json
import random

import pytest

from emberscope.sources import json_arrays
from emberscope.sources.json_arrays import array_elements


def document(rng, depth=0):
    kind = rng.randrange(8 if depth < 3 else 5)
    if kind == 0:
        return rng.choice([True, False, None, 0, -1.5e3])
    if kind < 5:
        return "".join(rng.choice('ab"\\[]{},: \n\tüé日') for _ in range(rng.randrange(12)))
    if kind == 5:
        return [document(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {str(document(rng, 9)) if rng.random() < 0.2 else f"k{i}": document(rng, depth + 1) for i in range(rng.randrange(4))}


def as_key(x):
    return json.dumps(x, sort_keys=True)


@pytest.mark.parametrize("stretch,block", [(1, 1), (3, 2), (7, 1 << 20), (64, 5), (1 << 20, 1 << 20)])
def test_stretches_cut_no_element(tmp_path, monkeypatch, stretch, block):
    monkeypatch.setattr(json_arrays, "_BLOCK", block)
    rng = random.Random(stretch)
    for case in range(60):
        items = [{f"{k}": v for k, v in enumerate([document(rng)])} for _ in range(rng.randrange(6))]
        if case % 5 == 0:
            items += [[], "x,\"]", 7]
        body = json.dumps(items, ensure_ascii=case % 2 == 0, indent=rng.choice([None, 1])).encode() + rng.choice([b"", b"\n", b" \n[1]"])
        path = tmp_path / f"f{case}.json"
        path.write_bytes(body)
        inside, depth, found = False, 0, []
        with json_arrays._opened(str(path)) as stream:
            for start in range(0, len(body), stretch):
                end = min(start + stretch, len(body))
                found += [json.loads(e) for e in json_arrays._elements_of(stream, start, end, len(body), inside, depth) if e.strip()]
                rows = [r for b in json_arrays._summaries(iter([_batch(str(path), start, end)])) for r in b.to_pylist()]
                side = "in" if inside else "out"
                inside, depth = rows[0][f"{side}_inside"], depth + rows[0][f"{side}_depth"]
        assert [as_key(x) for x in found] == [as_key(x) for x in items + [1] * body.endswith(b" \n[1]")], body


def _batch(file, start, end):
    import pyarrow as pa

    return pa.RecordBatch.from_pylist([{"file": file, "start": start, "end": end}])


@pytest.mark.parametrize("stretch", [50, 1 << 20])
def test_files_of_many_stretches(spark, tmp_path, stretch):
    items = {f"f{k}.json": [{"id": i, "text": f'a "quoted", [text] \\ {i}'} for i in range(30 * k)] for k in range(4)}
    for name, rows in items.items():
        (tmp_path / name).write_text(json.dumps(rows))
    (tmp_path / "blank.json").write_text("  \n")
    (tmp_path / "object.json").write_text('{"id": 1}')
    (tmp_path / "cut.json").write_text(json.dumps(items["f1.json"])[:-20])
    (tmp_path / "nulls.json").write_text("[null, 1 , null]")
    got = {}
    for r in array_elements(spark, f"{tmp_path}/*.json", stretch).collect():
        got.setdefault(r["file"].split("/")[-1], []).append(r["value"])
    assert got.pop("object.json") == ['{"id": 1}'] and got.pop("nulls.json") == ["1"] and "blank.json" not in got
    cut = got.pop("cut.json")
    assert len(cut) == 30 and sum(v.endswith("}") for v in cut) == 29
    for name, rows in items.items():
        assert sorted(as_key(json.loads(v)) for v in got.get(name, [])) == sorted(map(as_key, rows))
