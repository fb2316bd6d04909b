import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import near_dedup
from corpusmill.llm.components import connected_components

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def bag(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute(rows):
    """Class by row number; links: equal text, or 5 * common >= 4 * all."""
    root = [*range(len(rows))]

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    bags = [bag(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            common = sum((bags[i] & bags[j]).values())
            both = sum(bags[i].values()) + sum(bags[j].values()) - common
            if (rows[i][1] or "") == (rows[j][1] or "") or (common and 5 * common >= 4 * both):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return {rows[i][0]: min(x for x in groups[find(i)] if x is not None) for i in range(len(rows)) if rows[i][0] is not None}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7)))
    passage = [word() for _ in range(60)]
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([3, 4, 5, 30, 80, 200]))]
        for _ in range(rng.randint(1, 14)):
            copy = [w if rng.random() > rng.choice([0, 0.01, 0.02, 0.04, 0.1]) else word() for w in base]
            rows.append((rng.choice([" ", "\n", ", "]).join(copy).capitalize()))
    rows += [" ".join(passage + [word() for _ in range(rng.randint(20, 90))]) for _ in range(25)]
    rows += ["la " * n for n in (40, 41, 47, 60, 300, 310)] + [None, "", "  ", "!!!", "!!!", "ONE", "one.", "Two words"]
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed", range(2))
def test_classes_against_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 9, "k") for r in rows], "doc_id long, text string, comp int, key string").repartition(5)
    classes = near_dedup.near_duplicates(df)
    got = {r["doc_id"]: r["class_id"] for r in classes.collect()}
    assert got == brute(rows)
    kept = near_dedup.keep_one(df, classes).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(got.values())) and kept[0]["key"] == "k"


def test_all_pairs_of_the_test_table(spark):
    """Every link of the sf0.01 documents, by comparison of all pairs of comparable size."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    numbers = {}
    bags = [Counter({numbers.setdefault(k, len(numbers)): n for k, n in bag(t).items()}) for _, t in rows]
    sets = [np.sort(np.array([k * 65536 + i for k, n in b.items() for i in range(n)], np.int64)) for b in bags]
    root = [*range(len(rows))]

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(range(len(rows)), key=lambda i: len(sets[i]))
    links = 0
    for at, i in enumerate(order):
        for j in order[at + 1 :]:
            if 5 * len(sets[i]) < 4 * len(sets[j]):
                break
            if not len(sets[i]):
                linked = (rows[i][1] or "") == (rows[j][1] or "")
            else:
                place = np.minimum(np.searchsorted(sets[j], sets[i]), len(sets[j]) - 1)
                common = int((sets[j][place] == sets[i]).sum())
                linked = common and 5 * common >= 4 * (len(sets[i]) + len(sets[j]) - common)
            if linked:
                links += 1
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    assert links > 50
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(df).collect()} == {k: least[find(i)] for i, (k, _) in enumerate(rows)}


def passages(n):
    rng = random.Random(9)
    shared = [" ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(30)) for _ in range(12)]
    return [(i, " ".join(rng.sample(shared, 6))) for i in range(n)]


def test_documents_built_from_passages(spark, monkeypatch):
    """Checked pairs grow with the documents, not with their square, and every link is found."""
    checked, real = [], near_dedup._check

    def count(pairs, texts):
        checked[-1] += pairs.count()
        return real(pairs, texts)

    monkeypatch.setattr(near_dedup, "_check", count)
    for n in (500, 1000, 2000):
        checked.append(0)
        df = spark.createDataFrame(passages(n), "doc_id long, text string").repartition(8)
        got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(df).collect()}
        if n == 500:
            assert got == brute(passages(n))
    assert checked[2] < 3.2 * checked[1] and checked[1] < 3.2 * checked[0] and checked[2] < 2000 * 30, checked


def copies(n):
    """Copies of one text with two or three words changed, most pairs of which lie just below the threshold; each eighth is like the one before."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(n):
        text = [*base] if i % 8 else rows[-1][1].split() if rows else [*base]
        for k in rng.sample(range(len(text)), rng.choice([2, 2, 3]) if i % 8 else 1):
            text[k] = f"x{i}y{k}"
        rows.append((i, " ".join(text)))
    return rows


def test_copies_below_the_threshold(spark, monkeypatch):
    """Of a dense group neither pairs nor bands become rows: blocks are compared in place, and every link is found."""
    checked, real = [0], near_dedup._check

    def count(pairs, texts):
        checked[-1] += pairs.count()
        return real(pairs, texts)

    monkeypatch.setattr(near_dedup, "_check", count)
    monkeypatch.setattr(near_dedup, "BLOCK_TEXTS", 50, raising=False)
    df = spark.createDataFrame(copies(240), "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(df).collect()}
    assert got == brute(copies(240)) and 20 < len({*got.values()}) < 230
    assert checked[0] < 240 * 20, checked


def test_long_texts_and_clashing_names(spark):
    rng = random.Random(1)
    long = " ".join(f"w{rng.randint(0, 400)}" for _ in range(60_000))
    rows = [(1, long, "x", 7), (2, long + " more", "y", 7), (3, None, "z", 7), (None, "alone", "p", 7), (None, long, "q", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, kept int").withColumnRenamed("kept", "KEPT").withColumn("_key", F.lit(1)).withColumn("class_id", F.lit(0))
    classes = near_dedup.near_duplicates(df)
    assert {r["doc_id"]: r["class_id"] for r in classes.filter("doc_id is not null").collect()} == {1: 1, 2: 1, 3: 3}
    kept = near_dedup.keep_one(df, classes)
    assert kept.columns == df.columns and sorted(r["key"] for r in kept.collect()) == ["p", "x", "z"]


def test_edges(spark):
    schema = "doc_id long, text string"
    assert near_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(None, long), (4, long), (4, long), (7, long + " x"), (None, "alone"), (9, None)]
    df = spark.createDataFrame(rows, schema)
    got = sorted(((r["doc_id"], r["class_id"]) for r in near_dedup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 4), (4, 4), (4, 4), (7, 4), (None, None), (9, 9)], key=str)
    kept = near_dedup.keep_one(df, near_dedup.near_duplicates(df)).collect()
    assert sorted((tuple(r) for r in kept), key=str) == sorted([(4, long), (9, None), (None, "alone")], key=str)


def test_signature_is_unbiased_in_weights():
    rng = np.random.default_rng(0)
    off = []
    for _ in range(60):
        keys = np.sort(rng.integers(1, 2**63, 150).astype(np.uint64))
        c1 = rng.integers(0, 12, 150)
        c2 = np.where(rng.random(150) < 0.6, c1, rng.integers(0, 12, 150))
        k, c = np.concatenate([keys[c1 > 0], keys[c2 > 0]]), np.concatenate([c1[c1 > 0], c2[c2 > 0]])
        s = near_dedup.signatures(k, c, np.array([0, (c1 > 0).sum(), len(k)]))
        off.append((s[0] == s[1]).mean() - np.minimum(c1, c2).sum() / np.maximum(c1, c2).sum())
    assert abs(np.mean(off)) < 0.015 and np.std(off) < 0.05


def test_signature_does_not_depend_on_its_batch():
    rng = np.random.default_rng(1)
    keys = [np.sort(rng.integers(1, 2**63, n).astype(np.uint64)) for n in (1, 3, 50, 400)]
    counts = [rng.integers(1, 40, len(k)) for k in keys]
    bounds = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
    together = near_dedup.signatures(np.concatenate(keys), np.concatenate(counts), bounds)
    for i, (k, c) in enumerate(zip(keys, counts, strict=True)):
        assert (near_dedup.signatures(k, c, np.array([0, len(k)]))[0] == together[i]).all()


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2300)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in [*root] if find(x) != x}
