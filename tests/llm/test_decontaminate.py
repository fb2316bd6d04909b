import hashlib
import random
import re
from itertools import takewhile

import pytest

from corpusmill.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(docs, items, window=13):
    windows = []
    for k, t in items:
        w = WORD.findall(lower(t))
        n = min(window, len(w))
        windows += [("null" if k is None else str(k), w[i : i + n]) for i in range(len(w) - n + 1) if n]
    out = []
    for d, t in docs:
        w = WORD.findall(lower(t))
        hit, ids = set(), set()
        for k, x in windows:
            for i in range(len(w) - len(x) + 1):
                if w[i : i + len(x)] == x:
                    hit.update(range(i, i + len(x)))
                    ids.add(k)
        sha = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(ids), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def cases(seed):
    rng = random.Random(seed)
    vocabulary = ["The", "a", "Éa", "b2", "x", "yß", "über", "the"]
    say = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-", "_"]) for _ in range(n))
    items = [(i, say(rng.choice([0, 1, 3, 12, 13, 14, 30]))) for i in range(12)] + [(None, "one two three"), (3, None), (77, "!!!"), (78, "z " * 20), (78, "only 5 words in here")]
    docs = []
    for i in range(60):
        parts = [say(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            t = rng.choice(items)[1] or ""
            parts.append(t if rng.random() < 0.7 else t[: len(t) // 2])
            parts.append(say(rng.randint(0, 25)))
        docs.append((i, " ".join(parts)))
    docs += [(100, None), (101, ""), (102, "..."), (103, "z " * 3000), (None, "one TWO three"), (103, "z " * 19), (104, "z " * 21)]
    return docs, items


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("block_bytes", [1 << 24, 1500])
def test_against_brute_force(spark, seed, block_bytes, monkeypatch):
    docs, items = cases(seed)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, items int").repartition(3)
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, id int")
    found = decontaminate.verdicts(decontaminate.find_contamination(d, b))
    got = found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items)
    assert all(sum(r["spans"][1::2]) - sum(r["spans"][::2]) == r["n_hit"] for r in found.collect())


def test_longest_match_and_empty_tables(spark):
    item = " ".join(f"w{i}" for i in range(40))
    docs = [(1, "q " + " ".join(f"w{i}" for i in range(5, 30)) + " q"), (2, " ".join(f"w{i}" for i in range(12)))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.find_contamination(d, b).collect()}
    assert (got[1]["longest"], got[1]["n_hit"], got[1]["spans"]) == (25, 25, [1, 26]) and got[2]["n_hit"] == 0
    assert decontaminate.find_contamination(d.limit(0), b).count() == 0
    assert [r["n_hit"] for r in decontaminate.find_contamination(d, b.limit(0)).collect()] == [0, 0]


def longest_match(text, items, window=13):
    w, best = WORD.findall(lower(text)), 0
    for _, t in items:
        x = WORD.findall(lower(t))
        for i in range(len(w)):
            for j in range(len(x)):
                n = 0
                while i + n < len(w) and j + n < len(x) and w[i + n] == x[j + n]:
                    n += 1
                if n >= min(window, len(x)):
                    best = max(best, n)
    return best


@pytest.mark.parametrize("block_bytes", [1 << 24, 1500])
def test_longest_match_against_brute_force(spark, block_bytes, monkeypatch):
    docs, items = cases(1)
    docs = [d for d in docs if len(d[1] or "") < 2000]
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((str(r["doc_id"]), r["longest"]) for r in decontaminate.find_contamination(d, b).collect())
    assert got == sorted((str(k), longest_match(t, items)) for k, t in docs)


def test_repeated_windows_in_repeated_items_stay_small(spark):
    """One window, thousands of places, hundreds of items: neither their product nor more than a place each."""
    import tracemalloc

    import pyarrow as pa

    from corpusmill.llm.wordhash import text_bytes

    items = [(i, "same " * 33) for i in range(400)]
    block = decontaminate.read_block(items)
    assert len(block.first) == 1 and len(block.set_items) == 400
    tracemalloc.start()
    counts, _, longest, hit, found = decontaminate.shard_hits(*text_bytes(pa.array(["same " * 20000, "other", "same " * 12])), block)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6, peak
    assert counts.tolist() == [20000, 1, 12] and longest.tolist() == [33, 0, 0] and hit.sum() == 20000 and [len(x) for x in found] == [400, 0, 0]
    boilerplate = " ".join(f"b{i}" for i in range(60))
    items = [(i, f"{boilerplate} own{i} " * 2) for i in range(12)]
    docs = [(i, boilerplate + " tail " * (i % 3)) for i in range(40)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.verdicts(decontaminate.find_contamination(d, b)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items)


def test_suffix_array_is_sorted():
    import numpy as np

    ids = np.array(random.Random(5).choices(range(4), k=400) + [0] * 20)
    sa = decontaminate.suffix_array(ids, 13)
    # an unknown word or a text's end ends the comparison
    keys = [tuple(takewhile(lambda x: x, ids[i : i + 13])) for i in sa]
    assert sorted(sa) == [*np.flatnonzero(ids)] and keys == sorted(keys)


@pytest.mark.parametrize("block_bytes", [1 << 24, 1500])
def test_dropping_keeps_all_columns_of_clean_documents(spark, block_bytes, monkeypatch):
    docs, items = cases(1)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)
    d = spark.createDataFrame([(*r, 1, [2]) for r in docs], "doc_id long, text string, items int, `odd name` array<int>")
    b = spark.createDataFrame(items, "item_id long, text string")
    kept = decontaminate.drop_contaminated(d, b)
    assert kept.columns == d.columns
    bad = [r[0] for r in brute(docs, items) if r[5]]
    want = [r for r in brute(docs, items) if not r[5]]
    assert len(bad) > 3 and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r[0]) for r in want)
