import hashlib
import re

import pytest

from silvatrack.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items, n=10):
    windows = {}
    for item, text in items:
        w = words(text)
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(item)
    out = []
    for r in rows:
        w = words(r[1])
        hit, found = set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if (items_ := windows.get(tuple(w[i : i + k]))) is not None:
                    hit |= set(range(i, i + k))
                    found |= items_
        names = ",".join(sorted("" if x is None else str(x) for x in found))
        out.append((r[0], len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def items(rows):
    texts = [rows[2][1], rows[3][1][10:200], rows[2][1], "ONE two", "beta1", "", None, "--", "the1 of2 the3", rows[-5][1][50:900]]
    return [(100 + i if i != 7 else None, t) for i, t in enumerate(texts)] + [(104, "x917 alpha3"), (None, rows[6][1])]


@pytest.mark.parametrize("max_broadcast", [200_000, 0])
def test_matches_brute_force(spark, documents, rows, items, max_broadcast):
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(documents, bench, max_broadcast=max_broadcast).drop("text_key", "spans").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, items)


def test_removal(spark, documents, rows, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    dirty = [b[5] for b in sorted(((r, brute([r], items)[0]) for r in rows), key=lambda x: str(x[0])) for b in [b[1]]]
    kept = decontaminate.decontaminate(documents, bench)
    assert kept.columns == documents.columns and kept.count() == len(dirty) - sum(dirty)
    spans = decontaminate.decontaminate(documents, bench, remove="spans")
    assert spans.count() == len(rows) and spans.columns == documents.columns
    left = sum(len(words(r.text)) for r in spans.collect())
    assert left == sum(b[1] - b[2] for b in brute(rows, items))


def test_empty_tables(spark, nothing, documents, rows):
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.contamination(nothing, bench).collect() == []
    assert decontaminate.contamination(documents, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.decontaminate(documents, bench.limit(0)).count() == len(rows)
