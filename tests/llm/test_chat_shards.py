import random
import zlib

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import chat_format, kd_sharding


def brute(rows, segment):
    convs = {}
    for conv, turn, role, text in set(rows):
        convs.setdefault(conv, []).append((turn, role, text))
    low = lambda t: tuple((v is not None, v if v is not None else 0) for v in t)
    said = {c: [t[1:] for t in sorted(ts, key=low)] for c, ts in convs.items()}
    kept = []
    for c, s in said.items():
        if any(len(o) > len(s) and o[: len(s)] == s for o in said.values()):
            continue
        if any(o == s and d is not None and (c is None or d < c) for d, o in said.items() if d != c):
            continue
        kept.append(c)
    out = set()
    for c in kept:
        s = said[c]
        for g in range(0, len(s), segment):
            text = "".join(f"<|{r if r is not None else 'unknown'}|>\n{x or ''}<|end|>\n" for r, x in s[g : g + segment])
            out.add((c, g // segment, len(s), text))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_snapshots_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for base in range(12):
        turns = [(rng.choice([t, t, None]) if seed == 2 else t, rng.choice(["user", "assistant", None]), rng.choice(["a", "", None, "b c", "é"])) for t in range(rng.randint(1, 9))]
        for k in range(rng.randint(1, 4)):
            n = rng.randint(1, len(turns))
            rows += [(base * 10 + k, *t) for t in turns[:n]]
    rows += rows[:5] + [(None, 0, "user", "only"), (None, 1, None, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, pos int")
    got = [tuple(r) for r in chat_format.collapse_and_render(df, segment_turns=4, ranges=(9, 1, 9, None)[seed]).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 4)
    assert chat_format.collapse_and_render(df.limit(0)).count() == 0


def test_one_conversation_of_null_turns_spreads(spark):
    rows = [(None, None, "user", f"{i:05d}" * 4) for i in range(4000)] + [(1, None, "user", f"{i:05d}" * 4) for i in range(1000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    numbered = chat_format.number_turns(df, ranges=16)
    most = numbered.groupBy("range").count().agg(F.max("count")).first()[0]
    assert most <= 2 * 5000 / 16
    got = {tuple(r) for r in chat_format.collapse_and_render(df, ranges=16).collect()}
    assert got == brute(rows, chat_format.SEGMENT_TURNS) and {r[0] for r in got} == {None}


def plain_tree(rows, leaves, first, spans, out):
    """rows: (size, dims, crc, tie, id); the leaf of each id by sorting every node whole."""
    if leaves == 1 or not rows:
        out.update({r[4]: first for r in rows})
        return
    wide = [max(r[1][d] for r in rows) - min(r[1][d] for r in rows) for d in range(len(spans))]
    dim = max(range(len(spans)), key=lambda d: (wide[d] / spans[d], -d))
    goal = sum(r[0] for r in rows) * (leaves // 2) / leaves
    rows = sorted(rows, key=lambda r: (r[1][dim], r[2], r[3]))
    below, cut = 0, 0
    while below + rows[cut][0] < goal:
        below, cut = below + rows[cut][0], cut + 1
    cut += goal - below > below + rows[cut][0] - goal
    plain_tree(rows[:cut], leaves // 2, first, spans, out)
    plain_tree(rows[cut:], leaves - leaves // 2, first + leaves // 2, spans, out)


@pytest.mark.parametrize("shards", [16, 7])
def test_kd_leaves_against_plain_tree(spark, shards):
    rng = random.Random(shards)
    rows = [(i, "ab"[i % 2] * rng.randint(50, 300), rng.choice(["en", "de", "fr", None]), f"s{rng.randint(0, 9)}") for i in range(300)]
    rows += [(i, "one text in many rows " * 4, "en", "hot") for i in range(300, 420)]
    crc = lambda v: -1 if v is None else zlib.crc32(v.encode())
    plain = [(len(t) + 1, (len(t) + 1, crc(lang), crc(source)), crc(t), i, i) for i, t, lang, source in rows]
    spans = [max(1, max(r[1][d] for r in plain) - min(r[1][d] for r in plain)) for d in range(3)]
    want: dict[int, int] = {}
    plain_tree(plain, shards, 0, spans, want)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["shard"] for r in kd_sharding.shard_by_bytes(df, shards=shards).collect()}
    assert got == want


def check_shards(rows, out, shards, slack):
    size = {}
    assert sorted(r["doc_id"] for r in out) == sorted(r[0] for r in rows)
    slots = {}
    for r in out:
        size[r["shard"]] = size.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == [*range(len(s))] for s in slots.values())
    mean = sum(size.values()) / shards
    assert all(abs(size.get(k, 0) - mean) <= slack for k in range(shards)), (size, mean)


def test_kd_shards_are_even(spark):
    rng = random.Random(3)
    rows = [(i, "é" * rng.randint(0, 300), rng.choice(["en", "de", None]), f"s{rng.randint(0, 20)}") for i in range(2000)]
    rows += [(i, "copy of one text " * 5, "en", "hot") for i in range(2000, 3500)] + [(3500, None, None, None), (3501, "", "en", "s1")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, lang string, source string, size int")
    out = kd_sharding.shard_by_bytes(df, shards=16).collect()
    check_shards(rows, out, 16, 2 * 601)
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    assert all(r["size"] == len(texts[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]]) for r in out)
    uneven = kd_sharding.shard_by_bytes(df, shards=5).collect()
    check_shards(rows, uneven, 5, 3 * 601)


def test_kd_edge_cases(spark):
    schema = "doc_id long, text string, lang string, source string"
    assert kd_sharding.shard_by_bytes(spark.createDataFrame([], schema), shards=16).count() == 0
    one = kd_sharding.shard_by_bytes(spark.createDataFrame([(1, None, None, None)], schema), shards=16).collect()
    assert len(one) == 1 and one[0]["slot"] == 0 and one[0]["size"] == 1
    same = spark.createDataFrame([(None, "x", "en", "s")] * 3 + [(i, "y" * 50, "en", "s") for i in range(64)], schema)
    out = kd_sharding.shard_by_bytes(same, target_bytes=500).collect()
    assert len(out) == 67 and {r["slot"] for r in out if r["shard"] == 0} == {*range(sum(r["shard"] == 0 for r in out))}
