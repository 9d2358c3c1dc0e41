import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from silvatrack.llm import lang_id, simhash


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def near_copies(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    shared = [word() for _ in range(60)]  # a passage that many documents have
    docs = []
    for i in range(60):
        base = [word() for _ in range(rng.randrange(20, 150))]
        docs.append(base + (shared if i % 3 == 0 else []))
        for _ in range(rng.randrange(0, 4)):
            copy = list(docs[-1])
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            docs.append(copy)
    hub = [word() for _ in range(120)]
    for _ in range(40):  # a large group of near copies
        copy = list(hub)
        copy[rng.randrange(len(copy))] = word()
        docs.append(copy)
    return [(i * 31 % 997, " ".join(d)) for i, d in enumerate(docs)]


@pytest.mark.parametrize("group", [4000, 10])
def test_one_document_of_each_class_stays(spark, documents, rows, monkeypatch, group):
    monkeypatch.setattr(simhash, "GROUP", group)
    docs = near_copies()
    got = {r.doc_id for r in simhash.deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    sets = [shingles(t) for _, t in docs]
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    want = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        want[root(i)].append(d)
    assert got == {min(v) for v in want.values()}


def test_short_near_copies_are_all_found(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    pairs = []
    for n in list(range(8, 37)) * 4:
        base = [word() for _ in range(n)]
        copies = [base + [word()], base[:-1] + [word()], [word()] + base, base + [word(), word()], base[: n // 2] + [word()] + base[n // 2 :]]
        pairs += [(" ".join(base), " ".join(c)) for c in copies]
    near = [(len(shingles(a) & shingles(b)) >= 0.8 * len(shingles(a) | shingles(b)), a, b) for a, b in pairs]
    # Each pair by itself: other copies would connect it.
    tail = lambda i: " ".join(w + str(i) for w in a.split())
    docs, want = [], set()
    for i, (ok, a, b) in enumerate(near):
        docs += [(2 * i, tail(i)), (2 * i + 1, " ".join(w + str(i) for w in b.split()))]
        want |= {2 * i} if ok else {2 * i, 2 * i + 1}
    assert sum(ok for ok, _, _ in near) > 100
    assert {r.doc_id for r in simhash.deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == want


def test_recall_by_similarity(spark, monkeypatch):
    """Of pairs in each band of similarity, as many are brought together as the bands of least hashes promise."""
    monkeypatch.setattr(simhash, "GROUP", 20)
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefghijklm"), 6))
    docs, near = [], {}
    for i in range(900):
        base = [word() for _ in range(int(rng.integers(8, 260)))]
        copy = list(base)
        for _ in range(int(rng.integers(0, max(2, len(base) // 25)))):
            copy[int(rng.integers(len(copy)))] = word()
        copy += [word() for _ in range(int(rng.integers(0, 3)))]
        a, b = shingles(" ".join(base)), shingles(" ".join(copy))
        docs += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
        near[i] = len(a & b) / len(a | b)
    kept = {r.doc_id for r in simhash.deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all({2 * i, 2 * i + 1} <= kept for i, s in near.items() if s < 0.8)
    for low, high, least in ((0.8, 0.85, 0.99), (0.85, 0.9, 1.0), (0.9, 1.01, 1.0)):
        some = [i for i, s in near.items() if low <= s < high]
        assert len(some) >= 40
        assert np.mean([2 * i in kept and 2 * i + 1 not in kept for i in some]) >= least


@pytest.mark.parametrize("same_fp", [False, True])
@pytest.mark.parametrize("group", [4000, 10])
def test_groups_of_any_size_are_compared_in_full(spark, monkeypatch, same_fp, group):
    """40 texts that share one band, or one fingerprint and no band, of which 2i and 2i + 1 alone are similar."""
    monkeypatch.setattr(simhash, "GROUP", group)
    rng = np.random.default_rng(6)
    texts, sets = [], []
    for i in range(40):
        own = rng.integers(0, 2**32, 100, dtype=np.uint64)
        own = np.unique(own if i % 2 == 0 else np.concatenate([last[:95], own[:5]])).astype("<u4")  # noqa: F821
        last = own  # noqa: F841
        fp = 77 if same_fp else int(rng.integers(1, 2**62))
        held = ([] if same_fp else [1]) + rng.integers(3, 2**62, 19).tolist()
        texts.append((i, fp, held, bytearray(simhash.sketch(own.astype(np.uint32)).tobytes()), len(own)))
        sets.append((i, bytearray(own.tobytes())))
    table = spark.createDataFrame(sets, "node long, shingles binary")
    found = simhash.similar_texts(spark.createDataFrame(texts, "node long, fp long, bands array<long>, sketch binary, m long"), lambda nodes: table.join(nodes, "node"))
    assert {(r.node, r.root) for r in found.collect() if r.node != r.root} == {(i + 1, i) for i in range(0, 40, 2)}


@pytest.mark.parametrize("group", [4000, 30])
def test_units_with_very_many_near_pairs(spark, monkeypatch, group):
    """Variants of one text, most of them less alike than 0.8: pairs are compared where they are, and no link is lost."""
    monkeypatch.setattr(simhash, "GROUP", group)
    monkeypatch.setattr(simhash, "DENSE", 1)
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(200)]
    docs = []
    for i in range(120):
        copy = list(base)
        for _ in range(rng.choice([1, 4, 5, 6])):
            copy[rng.randrange(200)] = word()
        docs.append((i, " ".join(copy)))
    sets, up = [shingles(t) for _, t in docs], list(range(120))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    pairs = [(i, j) for i in range(120) for j in range(i)]
    for i, j in pairs:
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            up[max(root(i), root(j))] = min(root(i), root(j))
    assert sum(len(sets[i] & sets[j]) < 0.8 * len(sets[i] | sets[j]) for i, j in pairs) > 3000
    got = {r.doc_id for r in simhash.deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {root(i) for i in range(120)}
    # The units' own comparison, on texts that no star has connected.
    table = pd.DataFrame({"unit": 1, "node": range(120), "class": range(120), "half": 0, "shingles": [simhash.shingle_set(t.encode()).astype("<u4").tobytes() for _, t in docs]})
    table["m"] = table["shingles"].map(len) // 4
    table["sketch"] = [simhash.sketch(simhash.shingle_set(t.encode())).tobytes() for _, t in docs]
    assert simhash._compare_cell(0.8, False)(table)["a"].isna().all()
    links = simhash._compare_cell(0.8, True)(table)
    seen = list(range(120))
    for a, b in zip(links["a"], links["b"]):
        assert len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
        seen = [seen[a] if x == seen[b] else x for x in seen]
    assert len(links) == 120 - len({root(i) for i in range(120)}) and len(set(seen)) == len({root(i) for i in range(120)})


def test_no_task_gets_a_large_group_whole(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP", 10)
    rows = [(1, i, 100, 0 if i < 150 else i) for i in range(200)] + [(2, i, 100 + 40 * (i % 3), i) for i in range(60)] + [(3, i, 100, i) for i in range(5)]
    units = simhash._units(spark.createDataFrame(rows, "group long, node long, m long, class long")).collect()
    together = defaultdict(list)
    for r in units:
        together[r.unit].append(r)
    assert max(map(len, together.values())) <= 20
    met = set()
    for g in together.values():
        halves = {r.half for r in g}
        met |= {(a.node, b.node) for a in g for b in g if a.node < b.node and (len(halves) == 1 or a.half != b.half)}
    assert met >= {(a, b) for a in range(200) for b in range(max(a + 1, 150), 200)}
    assert met >= {(a, b) for a in range(60) for b in range(a + 1, 60) if a % 3 == b % 3}


def test_odd_rows(documents, rows, nothing):
    kept = simhash.deduplicate(documents)
    assert kept.columns == documents.columns
    got = kept.collect()
    assert len({r.text for r in got}) == len(got)
    assert sum(not (r.text or "").strip() for r in got) == 1
    assert {shingles(r.text) for r in got} <= {shingles(r[1]) for r in rows}
    assert simhash.deduplicate(nothing).collect() == []


def test_whole_long_texts_count():
    rng = np.random.default_rng(4)
    text = " ".join("".join(rng.choice(list("abcé.9"), 7)) for _ in range(400)).encode()
    whole = lang_id.count_subwords(text)
    old = lang_id.STEP
    try:
        lang_id.STEP = 97
        pieces = lang_id.count_subwords(text)
    finally:
        lang_id.STEP = old
    assert (whole == pieces).all() and whole.sum() > 0
    folded = re.sub(rb"[^a-z\x80-\xff]+", b" ", b" " + text.lower() + b" ")
    want = sum(1 for n in (2, 3, 4) for i in range(len(folded) - n + 1) if b" " not in folded[i + 1 : i + n - 1])
    assert whole.sum() == want


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(9)
    sounds = {"xx": ["ba", "lo", "mi"], "yy": ["çe", "trü", "ska"], "zz": ["ong", "ing", "ang", "th"]}
    rows = []
    for i in range(600):
        lang = rng.choice(list(sounds))
        text = " ".join("".join(rng.choice(sounds[lang]) for _ in range(3)) for _ in range(rng.randrange(3, 40)))
        rows.append((i, text, lang if i % 7 else None, "s", 0, 1, ""))
    return rows + [(900, None, "xx", "s", 0, 1, ""), (901, "", "xx", "s", 0, 1, ""), (902, "12 !? …", "yy", "s", 0, 1, ""), (None, "balo", "xx", "s", 0, 1, "")]


def test_language_on_held_out_rows(spark, spoken, documents):
    docs = spark.createDataFrame(spoken, documents.schema)
    model = lang_id.fit(docs, max_rows=150)
    out = lang_id.identify(docs.withColumnRenamed("Block", "Score"), model)
    assert out.columns[-4:] == ["held_out", "lang_pred", "score_", "rejected"]
    got = {r.doc_id: r for r in out.collect()}
    held = [r for r in spoken if r[0] is not None and r[0] < 900 and zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert all(got[r[0]].held_out for r in held)
    truth = {r[0]: next(l for l, s in (("xx", "ba|lo|mi"), ("yy", "çe|trü|ska"), ("zz", "ng|th")) if re.search(s, r[1])) for r in held}
    assert np.mean([got[i].lang_pred == l for i, l in truth.items()]) > 0.98
    assert all((got[i].lang_pred, got[i].score_, got[i].rejected) == ("und", 0.0, True) for i in (900, 901, 902))
    assert got[None].held_out is False and all(0 <= r.score_ <= 1 for r in got.values())
    assert sum(r.rejected for r in got.values()) <= 3 + 0.02 * len(got)


def test_every_label_is_learned(spark, documents, monkeypatch):
    monkeypatch.setattr(lang_id, "MAX_BROADCAST_LANGS", 100)
    sounds = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, " ".join((sounds[i % 26] + sounds[i // 26 % 26]) * 3 for _ in range(8)), f"l{i % 676:03d}", "s", 0, 1, "") for i in range(676 * 4)]
    model = lang_id.fit(spark.createDataFrame(rows, documents.schema), max_rows=300)
    learnable = {r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2}
    assert set(model.langs) == learnable


def test_first_rows_of_labels_are_learned_from():
    rows = [(f"l{i % 3000}", i) for i in range(3100)]
    learned, held = lang_id.split(rows)
    assert {r[0] for r in learned} == {r[0] for r in rows} and sorted(learned + held) == sorted(rows) and len(held) == 100
    few = [("a" if i % 3 else "b", i) for i in range(1000)]
    learned, held = lang_id.split(few)
    assert len(held) == len(few) - int(len(few) * (1 - lang_id.HELD)) and {few[0], few[1]} <= set(learned)


def test_columns_of_maps(spark, documents):
    from pyspark.sql import functions as F

    from silvatrack.llm import mixing, simhash

    plain = documents.select("doc_id", "text", "lang", "source", "n_chars")
    held = plain.withColumn("tags", F.create_map(F.lit("a"), F.col("doc_id"))).withColumn("deeper", F.array(F.struct(F.create_map(F.lit(1), F.lit(2)).alias("m"))))
    assert mixing.mix(held).count() == plain.count()
    taken = mixing.take(held)
    assert taken.columns == held.columns and taken.count() > 0 and taken.filter("tags IS NULL").count() == 0
    mine = sorted(str(r.doc_id) for r in simhash.deduplicate(held).collect())
    assert mine == sorted(str(r.doc_id) for r in simhash.deduplicate(plain).collect())


def test_stars_are_met_by_a_broadcast(spark):
    from silvatrack.llm import simhash

    star = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(40)] + [(399, 1020)]
    links = spark.createDataFrame(star + [(5000, 5001)], "a long, b long")
    for hot_rows in (None, 5):
        found = {r["node"]: r["root"] for r in simhash.components(links, hot_rows).collect()}
        assert found == dict.fromkeys([*range(1, 400), *range(1000, 1041)], 0) | {5001: 5000}


def test_many_copies_of_one_text(spark, documents):
    from silvatrack.llm import simhash

    copies = spark.range(300).selectExpr("id + 10000 AS doc_id", "CASE WHEN id % 3 = 0 THEN '' ELSE 'the very same words in a text' END AS text")
    docs = documents.select("doc_id", "text").unionByName(copies)
    rows = lambda **how: sorted(map(str, (tuple(r) for r in simhash.near_duplicates(docs, **how).collect())))
    assert rows(hot_rows=20) == rows() and len(rows()) == docs.count()


def test_no_labels(nothing, documents):
    from pyspark.sql import functions as F

    assert lang_id.fit(nothing) is None
    out = lang_id.identify(documents.withColumn("lang", F.lit(None).cast("string")), None)
    assert {r.lang_pred for r in out.collect()} == {"und"}


def test_pipeline(spark, documents, tmp_path):
    import corpus_pipeline

    spark.conf.set("spark.sql.shuffle.partitions", "4")
    docs = documents.drop("copies", "Block")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, docs.filter("doc_id = 7").first().text)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    before = at.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, str(tmp_path))
        assert out.columns == at.columns, name
        out.write.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        at = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
    last = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in last) == Counter(r.doc_id for r in at.collect()) and before > 0
    assert 7 not in {r.doc_id for r in last}
    assert [r.start for r in sorted(last, key=lambda r: r.start)] == np.cumsum([0] + [r.n_tokens for r in sorted(last, key=lambda r: r.start)])[:-1].tolist()


def test_pipeline_on_no_rows_and_on_clashing_names(spark, documents, nothing, tmp_path):
    import corpus_pipeline

    spark.conf.set("spark.sql.shuffle.partitions", "4")
    bench = spark.createDataFrame([(1, "ten words that no document has stand here in a row")], "item_id long, text string")
    clashing = documents.selectExpr("doc_id", "text", "lang", "source", "n_chars", "1 AS row_key", "2 AS Row_Key2", "3 AS node", "4 AS copies", "5 AS run", "6 AS held_out", "7 AS text_key", "8 AS nth")
    for name, docs in (("none", nothing), ("names", clashing)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        bench.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        found = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert (found == []) == (name == "none")
