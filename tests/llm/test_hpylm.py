import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import hpylm
from corpusmill.llm.wordhash import NONSPACE, mix, text_bytes, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def hash_of(word):
    if word in ("START", None):
        return hpylm._START if word == "START" else hpylm._END
    return words(*text_bytes(pa.array([word])), NONSPACE)[4][0]


def plain_draw(key, customers, others, p, discount, strength, draw):
    """The conditional by its definition: Stirling numbers by their recursion, weights as plain products of logarithms."""
    if customers < 2:
        return customers
    row = {0: 0.0}
    for n in range(customers):
        after = {}
        for m, v in row.items():
            for to, add in ((m, math.log(n - m * discount) if n - m * discount > 0 else None), (m + 1, 0.0)):
                if add is not None and to:
                    x = v + add
                    after[to] = x if to not in after else max(x, after[to]) + math.log1p(math.exp(-abs(x - after[to])))
        row = after
    logs = [row[t] + sum(math.log(strength + discount * (others + k)) + math.log(p) for k in range(t)) for t in range(1, customers + 1)]
    top = max(logs)
    w = [math.exp(x - top) for x in logs]
    u, total = hpylm._uniform(key, draw)[0] * sum(w), 0.0
    for t, x in enumerate(w, 1):
        total += x
        if u <= total:
            return t
    return customers


def brute(rows, burn_in, kept, shards):
    """The same model with dictionaries, in one place: scores by id."""
    d, s = hpylm.DISCOUNTS, hpylm.STRENGTHS
    train = [tokens(t) for _, t, k in rows if k]
    count = Counter(w for ts in train for w in ts)
    n, v = sum(count.values()), len(count)
    runs = lambda ts: list(zip(["START", "START", *ts], ["START", *ts], ts))
    c2 = Counter(r for ts in train for r in runs(ts))
    h = {w: hash_of(w) for w in {"START", *(w for _, t, _ in rows for w in tokens(t))}}
    # numbers of the words: by count within the shard of their hash
    by_shard = {}
    for w in h:
        by_shard.setdefault(int(h[w] >> np.uint64(32)) * shards >> 32, []).append(w)
    total = {**count, "START": len(train)}
    h = {w: np.uint64(k * shards + s) for s, ws in by_shard.items() for k, w in enumerate(sorted(ws, key=lambda w: (-total.get(w, 0), h[w])))}
    t2 = dict.fromkeys(c2, 1)
    house = Counter()
    for (a, b, _), c in c2.items():
        house[a, b] += c

    def up():
        out = Counter()
        for (_, b, w), t in t2.items():
            out[b, w] += t
        return out

    t1 = dict.fromkeys(up(), 1)
    tables = v
    with np.errstate(over="ignore"):
        key1 = {(b, w): mix(np.array([h[b] * np.uint64(0xD6E8FEB86659FD93) + h[w]])) for b, w in t1}
        key2 = {(a, b, w): mix(key1[b, w] + h[a] * np.uint64(0x9E6C63D0876A9A47)) for a, b, w in c2}
    key0 = {w: mix(np.array([h[w] + np.uint64(4)])) for w in h}
    sums = Counter()
    for sweep in range(burn_in + kept + 1):
        c1, c0 = up(), Counter()
        for (_, w), t in t1.items():
            c0[w] += t
        t0 = {w: plain_draw(key0[w], c, max(0, tables - 1), 0.5 / v, d[2], s[2], 3 * sweep + 2) for w, c in c0.items()}
        tables = sum(t0.values())
        room1, tables1, tables2 = Counter(), Counter(), Counter()
        for (b, w), c in c1.items():
            room1[b] += c
            tables1[b] += t1[b, w]
        for (a, b, _), t in t2.items():
            tables2[a, b] += t
        p0 = lambda w: (max(0, c0[w] - d[2] * t0.get(w, 0)) + (s[2] + d[2] * tables) * (0.5 / max(1, v) if c0[w] else 0.5 if v else 1.0)) / (s[2] + sum(c0.values()))  # noqa: E731, B023
        p1 = lambda b, w: (c1[b, w] - d[1] * t1.get((b, w), 0) + (s[1] + d[1] * tables1[b]) * p0(w)) / (s[1] + room1[b]) if room1[b] else p0(w)  # noqa: E731, B023
        p2 = lambda a, b, w: (c2[a, b, w] - d[0] * t2.get((a, b, w), 0) + (s[0] + d[0] * tables2[a, b]) * p1(b, w)) / (s[0] + house[a, b]) if house[a, b] else p1(b, w)  # noqa: E731, B023
        for a, b in [*house][:4]:
            assert abs(sum(p2(a, b, w) for w in count) + p2(a, b, "never seen") - 1) < 1e-6
        if sweep > burn_in:
            for text in {x for _, x, _ in rows}:
                for r in {*runs(tokens(text))}:
                    sums[r, text] += p2(*r) / kept
        t2, t1 = (
            {r: plain_draw(key2[r], c, tables2[r[0], r[1]] - t2[r], p1(r[1], r[2]), d[0], s[0], 3 * sweep) for r, c in c2.items()},
            {"before": t1, "p0": {r: p0(r[1]) for r in t1}, "others": {r: tables1[r[0]] - t1[r] for r in t1}},
        )
        c1 = up()
        t1 = {r: plain_draw(key1[r], c1[r], t1["others"][r], t1["p0"][r], d[1], s[1], 3 * sweep + 1) for r in t1["before"]}
    out = {}
    for i, text, _ in rows:
        ts = tokens(text)
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ts)
        out[i] = (len(ts), sum(count[w] > 0 for w in ts), n, base, sum(math.log10(sums[r, text]) for r in runs(ts)))
    return out


def corpus():
    rng = random.Random(4)
    vocabulary = ["the", "The", "a", "é", "x,", "of"] + [f"w{i}" for i in range(80)]
    rows = [(i, rng.choice([" ", "\n", "  "]).join(rng.choices(vocabulary, [40, 9, 20, 5, 3, 30] + [1] * 80, k=rng.randint(0, 60))), rng.random() < 0.8) for i in range(25)]
    rows += [(100, None, True), (101, "", False), (102, "unseen words only " * 3, False), (103, "the of " * 60, True), (104, rows[3][1], True)]
    return rows


@pytest.mark.parametrize(("block_bytes", "hot"), [(1 << 24, 0.125), (900, 0.125), (900, 0.02)])
def test_scores_against_brute_force(spark, monkeypatch, block_bytes, hot):
    rows = corpus()
    if hot < 0.1:  # many words are dealt by the next word as well
        monkeypatch.setattr(hpylm, "HOT", hot)
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, k boolean, score string").repartition(4)
    local = {r["doc_id"]: r for r in run_locally(rows, 1, 2, block_bytes, hpylm.HOT)}
    size = sum(len((t or '').encode()) + 1 for _, t, _ in rows)
    want = brute(rows, 1, 2, max(1, math.ceil(size / block_bytes)))
    assert local.keys() == want.keys()
    if hot > 0.1:
        got = {r["doc_id"]: r for r in hpylm.score_documents(df, F.col("k"), burn_in=1, kept=2, block_bytes=block_bytes).collect()}
        assert {k: r["score"] for k, r in got.items()} == pytest.approx({k: r["score"] for k, r in local.items()}, rel=1e-9)
    for i, (n, known, total, base, score) in want.items():
        r = local[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] == pytest.approx(score, rel=2e-5, abs=1e-6)


def run_locally(rows, burn_in, kept, block_bytes, hot):
    """The library's steps over tables, without Spark: dealt by number, and met by block and shard."""
    size = sum(len((t or "").encode()) + 1 for _, t, _ in rows)
    blocks = shards = max(1, math.ceil(size / block_bytes))
    group = lambda t, k: [t.filter(pc.equal(t.column(k), v)) for v in pc.unique(t.column(k)).to_pylist()]
    join = lambda ts: pa.concat_tables([*ts])
    only = lambda t, *kinds: t.filter(pc.and_(pc.is_in(t.column("kind"), pa.array(kinds)), pc.greater_equal(t.column("block"), 0)))
    table = pa.table({"block": pa.array([i % blocks for i in range(len(rows))], pa.int32()), "id": [r[0] for r in rows], "text": pa.array([r[1] or "" for r in rows]), "train": [r[2] for r in rows]})
    state = join(hpylm.read_block(t) for t in group(table, "block"))
    own = only(state, "own")
    asked = join(pa.Table.from_batches(list(hpylm.ask_counts(iter(own.combine_chunks().to_batches()), shards))) for _ in [0])
    counts = join(hpylm.count_words(t, shards) for t in group(asked, "shard"))
    sums = lambda t: [sum(float([*hpylm._unpack(x).values()][i][0]) for x in t.filter(pc.equal(t.column("block"), -1)).column("payload").to_pylist()) for i in (0, 1)]
    n, distinct = sums(counts)
    known = join([own, only(counts, "counts")])
    first = join(hpylm.seat_runs(t, shards) for t in group(join(hpylm.ask_runs(t, shards, n) for t in group(known, "block")), "shard"))
    kind_is = lambda t, old, new: only(t, old).set_column(2, "kind", pa.array([new] * only(t, old).num_rows, pa.string()))
    seats, totals, kept_rows, kept_totals = pa.Table.from_batches([*hpylm.first_seats(iter(only(first, "state").combine_chunks().to_batches()), shards)]), (0.0, distinct, distinct), [first], []
    for sweep in range(burn_in + kept + 1):
        above = join(hpylm.seat_all_words(t, distinct, totals[1], sweep) for t in group(only(seats, "share"), "shard"))
        totals = (*sums(above), distinct)
        if sweep > burn_in:
            kept_rows += [kind_is(seats, "seats", f"seats{len(kept_totals)}"), kind_is(above, "sums", f"sums{len(kept_totals)}")]
            kept_totals.append(totals)
        if sweep < burn_in + kept:
            seats = join(hpylm.sweep_shard(t, shards, totals, sweep) for t in group(join([only(first, "state"), only(seats, "seats"), only(above, "sums")]), "block"))
    answers = join(hpylm.answer_blocks(t, shards, kept_totals) for t in group(join(kept_rows), "block"))
    out = join(hpylm.score_block(t, shards, n, distinct) for t in group(join([known, only(state, "ids"), answers]), "block"))
    return [{**r, "doc_id": r["id"], "train_tokens": int(n)} for r in out.to_pylist()]


def test_empty_untrained_repeated_and_long(spark):
    schema = "doc_id long, text string, k boolean"
    assert hpylm.score_documents(spark.createDataFrame([], schema), F.col("k")).count() == 0
    got = hpylm.score_documents(spark.createDataFrame([(None, "a b", False), (None, None, None)], schema), F.col("k")).collect()
    assert sorted(r["n_tokens"] for r in got) == [1, 3] and all(r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in got)
    rows = [(7, "same row " * 30, True)] * 40 + [(8, "w " * 200_000, True), (9, None, False)]
    df = spark.createDataFrame(rows, schema).withColumn("block", F.lit(1)).withColumn("shard", F.lit("x")).withColumn("train", F.lit(None).cast("boolean"))
    got = hpylm.score_documents(df, F.col("k"), block_bytes=2000).collect()
    assert len(got) == 42 and len({(r["doc_id"], round(r["score"], 6)) for r in got}) == 3
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def stirling(n, discount):
    out = np.full((n + 1, n + 1), -np.inf)
    out[0, 0] = 0
    for i in range(n):
        for m in range(1, i + 2):
            out[i + 1, m] = np.logaddexp(out[i, m - 1], out[i, m] + math.log(i - m * discount) if i > m * discount else -np.inf)
    return out[n]


@pytest.mark.parametrize("d", hpylm.DISCOUNTS)
def test_stirling_numbers_of_many_customers(d):
    for c in (300, 1200):
        want = stirling(c, d)[1:]
        off = np.abs(hpylm.log_stirling(c, np.arange(1, c + 1), d) - want)
        assert off[: int(1.9 * c**d)].max() < 1e-6 and off[: c * 9 // 10].max() < 0.03 and off.max() < 0.1


@pytest.mark.parametrize(("c", "others", "p"), [(2, 0, 0.3), (40, 10, 0.02), (256, 500, 0.001), (700, 3, 0.05), (700, 4000, 0.01), (700, 200, 1e-4)])
def test_drawn_tables_follow_the_conditional(c, others, p):
    """Mean and deviation of draws against the exact conditional; also beyond EXACT customers."""
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 2**63, 6000).astype(np.uint64)
    t = hpylm.draw_tables(keys, np.full(len(keys), c), np.full(len(keys), others), np.full(len(keys), p), 0.8, 1.0, 3)
    k = np.arange(1, c + 1)
    logs = stirling(c, 0.8)[1:] + np.cumsum(np.log(1 + 0.8 * (others + np.arange(c))) + math.log(p))
    w = np.exp(logs - logs.max())
    w /= w.sum()
    mean = (w * k).sum()
    spread = math.sqrt((w * (k - mean) ** 2).sum())
    assert t.mean() == pytest.approx(mean, rel=0.02) and t.std() == pytest.approx(spread, rel=0.1, abs=0.05)


def test_predictions_against_customers_seated_one_by_one():
    """Averages over many sweeps against a sampler that seats every customer at a table, one after another."""
    rng = random.Random(8)
    texts = [" ".join(rng.choices("abcd", [6, 3, 2, 1], k=12)) for _ in range(14)]
    rows = [(i, t, i < 12) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["score"] for r in run_locally(rows, 10, 150, 1 << 24, hpylm.HOT)}
    d, s = hpylm.DISCOUNTS, hpylm.STRENGTHS
    train = [tokens(t) for _, t, k in rows if k]
    v = len({w for ts in train for w in ts})
    seats: dict = {}

    def p(ctx, w):
        if ctx is None:
            return 0.5 / v
        level, above = 2 - len(ctx), ctx[1:] if ctx else None
        tables = seats.get(ctx, {})
        total = sum(sum(x) for x in tables.values())
        n = sum(len(x) for x in tables.values())
        own = tables.get(w, [])
        return (sum(own) - d[level] * len(own) + (s[level] + d[level] * n) * p(above, w)) / (s[level] + total)

    def seat(ctx, w):
        level, above = 2 - len(ctx), ctx[1:] if ctx else None
        own = seats.setdefault(ctx, {}).setdefault(w, [])
        n = sum(len(x) for x in seats[ctx].values())
        k = rng.choices(range(len(own) + 1), [x - d[level] for x in own] + [(s[level] + d[level] * n) * p(above, w)])[0]
        if k < len(own):
            own[k] += 1
        else:
            own.append(1)
            if above is not None:
                seat(above, w)

    def leave(ctx, w):
        own = seats[ctx][w]
        k = rng.choices(range(len(own)), own)[0]
        own[k] -= 1
        if not own[k]:
            own.pop(k)
            if ctx:
                leave(ctx[1:], w)

    customers = [((a, b), w) for ts in train for a, b, w in zip(["START", "START", *ts], ["START", *ts], ts)]
    for c in customers:
        seat(*c)
    asked = {i: [((a, b), w) for ts in [tokens(t)] for a, b, w in zip(["START", "START", *ts], ["START", *ts], ts)] for i, t, _ in rows}
    sums = Counter()
    for sweep in range(110):
        for c in customers:
            leave(*c)
            seat(*c)
        if sweep >= 10:
            for c in {x for xs in asked.values() for x in xs}:
                sums[c] += p(*c) / 100
    want = {i: sum(math.log10(sums[c]) for c in xs) for i, xs in asked.items()}
    print({i: (round(got[i], 3), round(want[i], 3)) for i in want})
    assert all(got[i] == pytest.approx(want[i], rel=0.03) for i in want)


def draw_from_all(u, customers, others, p, discount, strength):
    """`_draw_many` by the weights of all numbers of tables; and how many of them are looked at in growing pieces from 1 on until they are nothing."""
    t = np.arange(1, customers + 1)
    logs = hpylm.log_stirling(customers, t, discount) + np.cumsum(np.log(strength + discount * (others + t - 1)) + math.log(p))
    w = np.exp(logs - logs.max()).cumsum()
    end, size = 256, 512
    while end < customers and logs[end - 1] >= logs[:end].max() - 40:
        end, size = end + size, size * 2
    return 1 + int(np.searchsorted(w, u * w[-1], side="right")), min(end, customers)


def test_draws_look_at_few_numbers_of_tables(monkeypatch):
    """Only the weights near their peak are computed, and the draws are those of all weights."""
    looked, real = [0], hpylm.log_stirling
    rng = np.random.default_rng(5)
    cases = [(int(c), float(rng.integers(0, 5000)), float(10 ** rng.uniform(-6, -0.5)), *rng.choice([(0.8, 1.0), (0.75, 1.0), (0.7, 10.0)])) for c in np.exp(rng.uniform(5.6, 8.5, 60))]
    us = rng.random(60).tolist()
    want = [draw_from_all(u, *c) for u, c in zip(us, cases, strict=True)]

    def count(c, t, d):
        looked[0] += len(t)
        return real(c, t, d)

    monkeypatch.setattr(hpylm, "log_stirling", count)
    assert [hpylm._draw_many(u, *c) for u, c in zip(us, cases, strict=True)] == [t for t, _ in want]
    assert looked[0] < 0.5 * sum(n for _, n in want), looked


def test_numbers_of_values():
    rng = np.random.default_rng(1)
    for v in (np.zeros(0, np.int64), np.array([7]), np.sort(rng.integers(0, 50, 99)), rng.integers(0, 50, 99), rng.integers(0, 1 << 60, 99)):
        got, want = hpylm._numbers(v), np.unique(v, return_inverse=True)
        assert all((a == b).all() for a, b in zip(got, want, strict=True))
