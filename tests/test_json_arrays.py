"""JSON arrays read by byte ranges."""

from __future__ import annotations

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from subtide.sources import json_arrays as J


def awkward(r, n):
    text = ['a"b', "\\", '\\"', "], [", "{}{", ",,", "éあ", 'x\\\\"y', "", "\n\t", "end\\"]
    return [{"x": i, "s": "".join(r.choice(text) for _ in range(r.randint(0, 5))), "n": {"l": [1, [2, ","], {"k": "]"}]}} for i in range(n)]


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("size", [13, 100, 1 << 20])
def test_elements_do_not_depend_on_the_ranges(spark, tmp_path, indent, size):
    r = random.Random(size)
    docs = {f"d{k}.json": awkward(r, n) for k, n in enumerate((0, 1, 6))}
    for name, rows in docs.items():
        (tmp_path / name).write_bytes((b"\xef\xbb\xbf" if name == "d2.json" else b" \n") + json.dumps(rows, indent=indent, ensure_ascii=False).encode() + b"\n ")
    got = J.json_array_elements(spark, str(tmp_path), size).collect()
    found = {}
    for row in got:
        found.setdefault(os.path.basename(row["path"]), {})[row["row_id"]] = json.loads(row["value"])
    assert found == {name: dict(enumerate(rows, 1)) for name, rows in docs.items() if rows}
    typed = J.read_json_array(spark, str(tmp_path / "d2.json"), "struct<x:int,s:string>", size).orderBy("row_id").collect()
    assert [(t["row_id"], t["x"], t["s"]) for t in typed] == [(i + 1, e["x"], e["s"]) for i, e in enumerate(docs["d2.json"])]


def by_hand(text, state):
    """(state, depth) after ``text`` read byte by byte; None where a backslash stands outside strings, which JSON does not allow."""
    inside, escaped, depth = state > 0, state == 2, 0
    for c in text:
        if inside:
            escaped, inside = (False, True) if escaped else (c == "\\", c != '"')
        elif c == "\\":
            return None
        elif c == '"':
            inside = True
        else:
            depth += (c in "[{") - (c in "]}")
    return (2 if escaped else 1) if inside else 0, depth


def test_states_compose_like_one_scan():
    r, met = random.Random(3), 0
    for _ in range(2000):
        raw = "".join(r.choice('\\\\"[]{},a') for _ in range(r.randint(0, 30)))
        cut, a = r.randint(0, len(raw)), np.frombuffer(raw.encode(), np.uint8)
        for state in (0, 1, 2):
            want = by_hand(raw, state)
            if want is None:
                continue
            met += 1
            whole, left = J._summary(a, state), J._summary(a[:cut], state)
            right = J._summary(a[cut:], left["state"])
            assert (whole["state"], whole["change"]) == want == (right["state"], left["change"] + right["change"])
    assert met > 500


@pytest.mark.parametrize(("text", "says"), [
    ('{"x": 1}', "not a JSON array"), ('[{"x": 1}', "cut off"), ('[{"x": 1}] 5', "text after"), ('[{"x": 1}, {"x": }]', "element 2 of"), ('[{"x": 1},, {"x": 2}]', "element 2 of"),
    ('[{"x": 1}, 7]', "element 2 of"), ('[{"x": 1}, {"x": "no"}]', "element 2 of"), ('[{"x": "a]', "cut off"),
])
def test_faults_are_told_by_position(spark, tmp_path, text, says):
    (tmp_path / "b.json").write_text(text)
    with pytest.raises(Exception, match=says):
        J.read_json_array(spark, str(tmp_path / "b.json"), "struct<x:int>", 4).collect()


def test_one_large_document_is_read_by_many_tasks(spark, tmp_path):
    path, n = tmp_path / "large.json", 440_000
    filler = 'pad ], { \\" ' * 40
    with path.open("w") as f:
        f.write("[\n")
        for i in range(n):
            f.write(('{"x": %d, "s": "%s"}' % (i, filler)) + (",\n" if i < n - 1 else "\n]"))
    assert path.stat().st_size > 200 << 20
    rows = J.read_json_array(spark, str(path), "struct<x:long>")
    got = rows.withColumn("p", F.spark_partition_id()).agg(F.count(F.lit(1)), F.sum((F.col("row_id") == F.col("x") + 1).cast("long")), F.countDistinct("x"), F.countDistinct("p")).first()
    assert got[0] == got[1] == got[2] == n and got[3] >= 20
    path.unlink()
