"""Scoring texts with a hierarchical Pitman-Yor language model whose seating is sampled by Gibbs.

Restaurants: one for every two words in a row (of the training texts), whose parent is that
of the second word alone, whose parent is that of all words; its base gives half its mass to
the unknown word and the rest evenly to the known ones. A customer of the lowest level is an
occurrence of a word after the two; the tables that a word has in the restaurants below are
its customers above.

A Gibbs sweep redraws, for every word of every restaurant, its number of tables given its
customers and the other tables (sizes are summed out: generalised Stirling numbers weigh the
tables), from the lowest level up. The words of a restaurant, and restaurants beside each
other, are redrawn at once against the state before. The first BURN_IN sweeps are let go;
after each of the KEPT ones the predictive probability of every word that is scored is
computed with that sweep's seating of all three levels, and these are averaged (the kept
seatings are stored, mostly ones, and not the probabilities). Up to EXACT
customers the Stirling numbers come from their recursion; beyond, from their alternating sum
or a saddle point (the tests hold both against the recursion).

How it runs: texts are dealt to blocks of about BLOCK_BYTES by a hash. A block keeps its
tokens as numbers of its own distinct words, and sends its distinct runs of three words with
their counts, packed into one row, to each of the shards, which own the runs by their second
word (a word with more than its share of the tokens is dealt by the third as well). There
the seating of the two lower levels lives. The words' counts and numbers, the upper level, and the sums
of restaurants that are dealt over several shards meet in shards by ranges of hashes. So no
shuffle holds a row per token, and no statistic passes through the driver but a few sums per
shard. Draws depend on the words alone, not on blocks or shards.

Tokens are the runs of other than ASCII white space, ASCII letters in lower case, and one
end per text. Null texts are empty and have only the end. Rows with a null id are scored and
train like others. Repeated rows count as often as they occur, and are dealt one by one. An
empty table gives no rows. Without training texts all words are unknown and all scores come
from the base. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.scratch import discard, materialize
from corpusmill.llm.wordhash import NONSPACE, mix, slices, text_bytes, words

BLOCK_BYTES = 6 << 20
BURN_IN, KEPT = 1, 2
#: Discount and strength of the restaurants after two words, after one, and of the one of all words.
DISCOUNTS = (0.8, 0.75, 0.7)
STRENGTHS = (1.0, 1.0, 10.0)
UNKNOWN_BASE = 0.5
#: Customers up to which the number of tables is drawn exactly.
EXACT = 256
#: A word after which more than this part of a shard's tokens stands is dealt by the next word as well.
HOT = 1 / 8
#: Parts in which the shards answer.
PARTS = 4
_END, _START = mix(np.array([0xE11D, 0x57A7], np.uint64))
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Made once: exchanges have a message for each block and shard.
_COMPRESSOR, _DECOMPRESSOR = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
_ROWS = "block int, shard int, kind string, payload binary"


def _with(f, **fixed):  # noqa: ANN001, ANN003, ANN202
    """f with all but the table fixed, as the one-argument function that applyInArrow asks for."""

    def run(table):  # noqa: ANN001, ANN202
        return f(table, **fixed)

    return run


def _pack(**columns: np.ndarray) -> bytes:
    """Columns as one compressed string; equal bytes of the values stand together. Hashes ascend and go as steps."""
    if "hash" in columns:
        columns["hash"] = np.diff(columns["hash"], prepend=np.uint64(0))
    head = ";".join(f"{name},{c.dtype.str},{len(c)}" for name, c in columns.items()).encode()
    planes = [np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize).T).tobytes() for c in columns.values()]
    return _COMPRESSOR.compress(b"\n".join([head, b"".join(planes)]))


def _unpack(payload: bytes) -> dict[str, np.ndarray]:
    head, _, data = _DECOMPRESSOR.decompress(payload).partition(b"\n")
    out, at = {}, 0
    for name, kind, n in (x.split(",") for x in head.decode().split(";")):
        dtype = np.dtype(kind)
        size = int(n) * dtype.itemsize
        planes = np.frombuffer(data, np.uint8, size, at).reshape(dtype.itemsize, int(n))
        out[name] = np.ascontiguousarray(planes.T).reshape(-1).view(dtype)
        at += size
    if "hash" in out:
        out["hash"] = np.cumsum(out["hash"], dtype=np.uint64)
    return out


def _pack_ids(ids: pa.Array | pa.ChunkedArray) -> bytes:
    table = pa.table({"id": ids})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _table(rows: list[tuple[int, int, str, bytes]]) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.string(), pa.binary())
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["block", "shard", "kind", "payload"])


def _bounds(keys: np.ndarray, shards: int) -> np.ndarray:
    """Bounds of the shards in ascending hashes; a shard is a range of them."""
    shard = ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    return np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))


def _requests(block: int, kind: str, bounds: np.ndarray, **columns: np.ndarray) -> list[tuple[int, int, str, bytes]]:
    """A row for each shard that has some of the ascending keys."""
    spans = zip(range(len(bounds) - 1), bounds[:-1], bounds[1:], strict=True)
    return [(block, s, kind, _pack(**{k: v[a:b] for k, v in columns.items()})) for s, a, b in spans if a < b]


class Block:
    """A block's own tokens and what the shards have answered, in the order of its distinct words and runs."""

    def __init__(self, table: pa.Table, shards: int):
        rows: dict[str, dict[int, bytes]] = {}
        for block, shard, kind, payload in zip(*(table.column(i).to_pylist() for i in range(4)), strict=True):
            rows.setdefault(kind, {})[shard] = payload
            self.number = block
        self.rows, self.shards = rows, shards
        own = _unpack(rows["own"][0])
        self.train, self.lengths = own["train"], own["n"]
        self.words = own["hash"]
        self.sequence = own["by_rank"][own["rank"]]
        self.bounds = _bounds(self.words, shards)
        self.ends = np.cumsum(self.lengths)

    def ids(self) -> pa.ChunkedArray:
        return pa.ipc.open_stream(self.rows["ids"][0]).read_all().column("id")

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Corpus counts of the block's words, and their numbers in the corpus."""
        out = np.zeros((2, len(self.words)), np.int64)
        for shard, payload in self.rows.get("counts", {}).items():
            answer = _unpack(payload)
            out[:, self.bounds[shard] : self.bounds[shard + 1]] = answer["c"], answer["number"]
        return out[0], out[1]

    def trained(self) -> np.ndarray:
        return np.repeat(self.train, self.lengths)

    def runs(self, counts: np.ndarray, numbers: np.ndarray, tokens: float) -> None:
        """The distinct runs of three words, by shard and then by second, third and first word's number; and each token's run."""
        order = np.argsort(numbers)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        sequence = rank[self.sequence]
        start = rank[int(np.flatnonzero(self.words == _START)[0])]
        begin = self.ends - self.lengths
        second = np.empty_like(sequence)
        second[1:] = sequence[:-1]
        second[begin] = start
        first = np.empty_like(second)
        first[1:] = second[:-1]
        first[begin] = start
        n = np.int64(len(self.words))
        code, of = np.unique((second * n + sequence) * n + first, return_inverse=True)
        number, hot = numbers[order], (counts > HOT * tokens / self.shards)[order]
        b, w, a = code // n // n, code // n % n, code % n
        is_hot = hot[b]
        b, w, a = number[b], number[w], number[a]
        with np.errstate(over="ignore"):
            key = mix(b.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.where(is_hot, w + 1, 0).astype(np.uint64))
        shard = (((key >> np.uint64(32)) * np.uint64(self.shards)) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.run = place[of]
        self.a, self.b, self.w, self.hot = a[order], b[order], w[order], is_hot[order]
        self.run_bounds = np.searchsorted(shard[order], np.arange(self.shards + 1))


def _narrow(x: np.ndarray) -> np.ndarray:
    """Integers in 32 bits where they fit."""
    return x.astype(np.int32) if not len(x) or (x.max() < 1 << 31 and x.min() >= -(1 << 31)) else x


def read_block(table: pa.Table) -> pa.Table:
    """A block's ids, and its texts as numbers of its distinct words. Columns: block, id, text, train."""
    number = table.column("block")[0].as_py()
    parts, counts = [], []
    for chunk in table.column("text").chunks or []:
        data, offsets = text_bytes(chunk)
        for i, j in slices(offsets, 1 << 20):
            _, _, _, bounds, hashes = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], NONSPACE)
            n = np.diff(bounds) + 1
            out = np.empty(int(n.sum()), np.uint64)
            last = np.zeros(len(out), bool)
            last[np.cumsum(n) - 1] = True
            out[last], out[~last] = _END, hashes
            parts.append(out)
            counts.append(n)
    distinct, sequence, times = np.unique(np.concatenate([*parts, [_START]]), return_inverse=True, return_counts=True)
    # frequent words get small numbers, whose upper bytes compress to nothing
    by_rank = np.argsort(-times, kind="stable").astype(np.int32)
    rank = np.empty_like(by_rank)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.int32)
    train = table.column("train").to_numpy(zero_copy_only=False)
    own = _pack(rank=rank[sequence[:-1]], by_rank=by_rank, hash=distinct, train=train.astype(np.uint8), n=np.concatenate(counts))
    return _table([(number, 0, "ids", _pack_ids(table.column("id"))), (number, 0, "own", own)])


def ask_counts(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """Of each block, its distinct words with their training counts for each shard."""
    for batch in batches:
        for i in range(len(batch)):
            block = Block(pa.Table.from_batches([batch.slice(i, 1)]), shards)
            c = np.bincount(block.sequence, weights=block.trained(), minlength=len(block.words)).astype(np.int64)
            c[block.words == _START] = int(block.train.sum())
            yield from _table(_requests(block.number, "count", block.bounds, hash=block.words, c=c)).to_batches()


def _merge(table: pa.Table) -> tuple[list[int], list[dict[str, np.ndarray]], np.ndarray, np.ndarray, np.ndarray]:
    """The requests of a shard by block; (order by hash, firsts of the equal ones, number of each among the distinct)."""
    at = np.argsort(table.column("block").to_numpy())
    blocks = [table.column("block")[int(i)].as_py() for i in at]
    got = [_unpack(table.column("payload")[int(i)].as_py()) for i in at]
    keys = np.concatenate([g["hash"] for g in got])
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    first = np.flatnonzero(new)
    group = np.empty(len(keys), np.int64)
    group[order] = np.cumsum(new) - 1
    return blocks, got, order, first, group


def _reply(blocks: list[int], got: list[dict[str, np.ndarray]], shard: int, kind: str, columns: dict[str, np.ndarray]) -> list[tuple[int, int, str, bytes]]:
    rows, at = [], 0
    for block, g in zip(blocks, got, strict=True):
        n = len(g["hash"])
        rows.append((block, shard, kind, _pack(**{k: v[at : at + n] for k, v in columns.items()})))
        at += n
    return rows


def count_words(table: pa.Table, shards: int) -> pa.Table:
    """Corpus counts of a shard's words and numbers for them, small ones for frequent words, returned to each block; totals under block -1."""
    blocks, got, order, first, group = _merge(table)
    c = np.add.reduceat(np.concatenate([g["c"] for g in got])[order], first)
    hashes = np.concatenate([g["hash"] for g in got])[order][first]
    real = hashes != _START
    shard = table.column("shard")[0].as_py()
    number = np.empty(len(c), np.int64)
    number[np.argsort(-c, kind="stable")] = np.arange(len(c)) * shards + shard
    rows = _reply(blocks, got, shard, "counts", {"c": c[group], "number": number[group]})
    rows.append((-1, shard, "counts", _pack(total=c[real].sum(keepdims=True), distinct=np.array([(real & (c > 0)).sum()]))))
    return _table(rows)


def ask_runs(table: pa.Table, shards: int, tokens: float) -> pa.Table:
    """A block's runs with training counts, for each shard."""
    block = Block(table, shards)
    block.runs(*block.counts(), tokens)
    n = np.bincount(block.run, weights=block.trained(), minlength=len(block.a)).astype(np.int32)
    out = []
    for s, (i, j) in enumerate(zip(block.run_bounds[:-1], block.run_bounds[1:], strict=True)):
        if i < j:
            b = block.b[i:j]
            # second words ascend and go as steps
            out.append((block.number, s, "runs", _pack(a=_narrow(block.a[i:j]), b=_narrow(np.diff(b, prepend=0)), w=_narrow(block.w[i:j]), n=n[i:j], hot=np.unique(b[block.hot[i:j]]))))
    return _table(out)


def _numbers(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, none below 0, in ascending order, and the number of each value among them."""
    n = len(values)
    if n and (steps := np.diff(values)).min(initial=0) >= 0:
        new = np.append(True, steps > 0)
        return values[new], np.cumsum(new) - 1
    if n and (most := int(values.max())) < 32 * n:
        there = np.zeros(most + 1, bool)
        there[values] = True
        return np.flatnonzero(there), (np.cumsum(there, dtype=np.int32) - 1)[values].astype(np.int64)
    return np.unique(values, return_inverse=True)


class Seating:
    """A shard's runs (numbers of the words a, b, w) with the tables of w after a b (t2) and after b (t1).

    pair: (b, w); house: (a, b), a restaurant of the lowest level. far: the restaurants' sums
    are shared with other shards, since b is dealt by its next word.
    """

    def __init__(self, state: dict[str, np.ndarray]):
        b, w = np.cumsum(state["b"], dtype=np.int64), state["w"].astype(np.int64)
        a = state["a"].astype(np.int64)
        self.pair = np.repeat(np.arange(len(b)), state["size"])
        self.c2 = state["c2"].astype(np.int64)
        most = np.int64(max(int(x.max(initial=0)) for x in (a, b, w)) + 1)
        seconds, self.pair_b = _numbers(b)
        third, self.pair_w = _numbers(w)
        houses, self.house = _numbers(self.pair_b[self.pair] * most + a)
        self.seconds, self.thirds, self.houses = len(seconds), len(third), len(houses)
        self.far_word = np.flatnonzero(np.isin(seconds, state["hot"]))
        is_far = np.zeros(len(seconds), bool)
        is_far[self.far_word] = True
        self.far_house = np.flatnonzero(is_far[houses // most])
        u = lambda x: x.astype(np.uint64)
        with np.errstate(over="ignore"):
            house_key = mix(u(houses[self.far_house] % most) * np.uint64(0x9E6C63D0876A9A47) + u(seconds[houses[self.far_house] // most]) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1))
            word_key = mix(u(seconds[self.far_word]) * np.uint64(0x165667B19E3779F9) + np.uint64(2))
            self.key1 = mix(u(b) * np.uint64(0xD6E8FEB86659FD93) + u(w))
            self.key2 = mix(self.key1[self.pair] + u(a) * np.uint64(0x9E6C63D0876A9A47))
        keys = np.concatenate([mix(u(third) + np.uint64(4)), house_key, word_key])
        kind = np.concatenate([np.zeros(len(third), np.uint8), np.full(len(house_key) + len(word_key), 1, np.uint8)])
        self.order = np.argsort(keys, kind="stable")
        self.keys, self.kind = keys[self.order], kind[self.order]

    def begin(self) -> None:
        """One table for each word of a restaurant."""
        self.t2 = np.minimum(self.c2, 1)
        self.t1 = np.minimum(self.customers(), 1)

    def customers(self) -> np.ndarray:
        return np.bincount(self.pair, weights=self.t2, minlength=len(self.pair_b)).astype(np.int64)

    def shares(self) -> tuple[np.ndarray, np.ndarray]:
        """What the other shards need to know, in the order of keys: customers of words above; customers and tables of restaurants."""
        up = np.bincount(self.pair_w, weights=self.t1, minlength=self.thirds)
        c1, t1 = (np.bincount(self.pair_b, weights=x, minlength=self.seconds) for x in (self.customers(), self.t1))
        c2, t2 = (np.bincount(self.house, weights=x, minlength=self.houses) for x in (self.c2, self.t2))
        x = np.concatenate([up, c2[self.far_house], c1[self.far_word]])
        y = np.concatenate([np.zeros(len(up)), t2[self.far_house], t1[self.far_word]])
        return x[self.order], y[self.order]

    def learn(self, x: np.ndarray, y: np.ndarray, totals: tuple[float, float, float]) -> None:
        """Take in the sums over all shards; afterwards the probability above (p0) and restaurants' customers and tables are those of the whole corpus."""
        sums = np.empty((2, len(self.order)))
        sums[:, self.order] = x, y
        n, m = self.thirds, len(self.far_house)
        customers, tables, distinct = totals
        known = sums[0, :n] > 0
        base = np.where(known, (1 - UNKNOWN_BASE) / max(1.0, distinct), UNKNOWN_BASE if distinct else 1.0)
        p = (np.maximum(sums[0, :n] - DISCOUNTS[2] * sums[1, :n], 0) + (STRENGTHS[2] + DISCOUNTS[2] * tables) * base) / (STRENGTHS[2] + customers)
        self.p0 = p[self.pair_w]
        self.room1, self.tables1 = (np.bincount(self.pair_b, weights=v, minlength=self.seconds) for v in (self.customers(), self.t1))
        self.room2, self.tables2 = (np.bincount(self.house, weights=v, minlength=self.houses) for v in (self.c2, self.t2))
        self.room2[self.far_house], self.tables2[self.far_house] = sums[:, n : n + m]
        self.room1[self.far_word], self.tables1[self.far_word] = sums[:, n + m :]

    def after_one(self) -> np.ndarray:
        """Probability of each pair's third word after its second."""
        room, tables = self.room1[self.pair_b], self.tables1[self.pair_b]
        return (np.maximum(self.customers() - DISCOUNTS[1] * self.t1, 0) + np.where(room > 0, STRENGTHS[1] + DISCOUNTS[1] * tables, 1.0) * self.p0) / np.where(room > 0, STRENGTHS[1] + room, 1.0)

    def predict(self) -> np.ndarray:
        """Probability of each run's third word after the first two."""
        room, tables = self.room2[self.house], self.tables2[self.house]
        return (np.maximum(self.c2 - DISCOUNTS[0] * self.t2, 0) + np.where(room > 0, STRENGTHS[0] + DISCOUNTS[0] * tables, 1.0) * self.after_one()[self.pair]) / np.where(room > 0, STRENGTHS[0] + room, 1.0)

    def redraw(self, sweep: int) -> None:
        p1 = self.after_one()
        self.t2 = draw_tables(self.key2, self.c2, self.tables2[self.house] - self.t2, p1[self.pair], DISCOUNTS[0], STRENGTHS[0], 3 * sweep)
        self.t1 = draw_tables(self.key1, self.customers(), self.tables1[self.pair_b] - self.t1, self.p0, DISCOUNTS[1], STRENGTHS[1], 3 * sweep + 1)


def seat_runs(table: pa.Table, shards: int) -> pa.Table:
    """Merge the blocks' runs of a shard, and seat them at first."""
    at = np.argsort(table.column("block").to_numpy())
    shard = table.column("shard")[0].as_py()
    blocks = np.array([table.column("block")[int(i)].as_py() for i in at], np.int32)
    got = [_unpack(table.column("payload")[int(i)].as_py()) for i in at]
    b = np.concatenate([np.cumsum(g["b"], dtype=np.int64) for g in got])
    a, w = (np.concatenate([g[k] for g in got]).astype(np.int64) for k in ("a", "w"))
    most = np.int64(max(int(x.max()) for x in (a, b, w)) + 1)
    b *= most
    b += w
    pairs, pair = _numbers(b)
    del b, w
    pair *= most
    pair += a
    del a
    runs, run = _numbers(pair)
    del pair
    counts = np.bincount(run, weights=np.concatenate([g["n"] for g in got]), minlength=len(runs))
    state = {
        "b": _narrow(np.diff(pairs // most, prepend=0)), "w": _narrow(pairs % most), "size": np.bincount(runs // most, minlength=len(pairs)).astype(np.int32), "a": _narrow(runs % most),
        "c2": counts.astype(np.int32), "hot": np.unique(np.concatenate([g["hot"] for g in got])),
    }
    sizes = np.array([len(g["a"]) for g in got], np.int64)
    del got, runs, counts
    # each message's answers are found by its runs' numbers
    steps = np.diff(run, prepend=0)  # a message's runs ascend
    asked = {"blocks": blocks, "sizes": sizes, "run": steps.astype(np.int32)}
    del run, steps
    return _table([(shard, 0, "state", _pack(**state)), (shard, 0, "asked", _pack(**asked))])


def first_seats(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """The seating of each shard's state at first."""
    for batch in batches:
        for shard, payload in zip(batch.column(0).to_pylist(), batch.column(3), strict=True):
            seating = Seating(_unpack(payload.as_py()))
            seating.begin()
            yield from _table(_seats(seating, shard, shards)).to_batches()


def _seats(seating: Seating, shard: int, shards: int) -> list[tuple[int, int, str, bytes]]:
    """Rows of the seating as it stands, and of what word shards are to add up."""
    bounds = _bounds(seating.keys, shards)
    x, y = seating.shares()
    return [(shard, 0, "seats", _pack(t2=seating.t2.astype(np.int32), t1=seating.t1.astype(np.int32))), *_requests(shard, "share", bounds, hash=seating.keys, word=1 - seating.kind, x=x.astype(np.float64), y=y.astype(np.float64))]


class Shard:
    """A shard's rows: its state, and of one sweep or several (numbered by `kind`, as in seats2 and sums2) the seating and the sums over all shards."""

    def __init__(self, table: pa.Table, shards: int):
        self.rows: dict[str, dict[int, bytes]] = {}
        for block, far, kind, payload in zip(*(table.column(i).to_pylist() for i in range(4)), strict=True):
            self.rows.setdefault(kind, {})[far] = payload
            self.number = block
        self.seating = Seating(_unpack(self.rows["state"][0]))
        self.bounds = _bounds(self.seating.keys, shards)

    def at(self, sweep: str, totals: tuple[float, float, float]) -> Seating:
        seats = _unpack(self.rows["seats" + sweep][0])
        self.seating.t2, self.seating.t1 = seats["t2"].astype(np.int64), seats["t1"].astype(np.int64)
        x, y = np.zeros((2, len(self.seating.keys)))
        for far, payload in self.rows.get("sums" + sweep, {}).items():
            answer = _unpack(payload)
            x[self.bounds[far] : self.bounds[far + 1]], y[self.bounds[far] : self.bounds[far + 1]] = answer["x"], answer["y"]
        self.seating.learn(x, y, totals)
        return self.seating


def sweep_shard(table: pa.Table, shards: int, totals: tuple[float, float, float], sweep: int) -> pa.Table:
    """Redraw a shard's tables."""
    shard = Shard(table, shards)
    seating = shard.at("", totals)
    seating.redraw(sweep)
    return _table(_seats(seating, shard.number, shards))


def answer_blocks(table: pa.Table, shards: int, totals: list[tuple[float, float, float]]) -> pa.Table:
    """The predictions of a shard's runs, averaged over the kept sweeps, to each block that asked."""
    shard = Shard(table, shards)
    p = (sum(shard.at(str(k), t).predict() for k, t in enumerate(totals)) / len(totals)).astype(np.float32)
    asked = _unpack(shard.rows["asked"][0])
    ends, run = np.cumsum(asked["sizes"]), np.cumsum(asked["run"], dtype=np.int64)
    return _table([(int(b), shard.number, "scores", _pack(p=p[run[e - n : e]])) for b, n, e in zip(asked["blocks"], asked["sizes"], ends, strict=True)])


def _stirling(discount: float) -> np.ndarray:
    logs = np.full((EXACT + 1, EXACT + 1), -np.inf)
    logs[0, 0] = 0
    with np.errstate(divide="ignore"):
        for n in range(EXACT):
            m = np.arange(1, n + 2)
            stay = logs[n, m] + np.log(np.maximum(n - m * discount, 0))
            logs[n + 1, m] = np.logaddexp(logs[n, m - 1], stay)
    return logs


_STIRLING: dict[float, np.ndarray] = {}


def _uniform(key: np.ndarray, draw: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((mix(key + np.uint64(draw + 1) * _STEP) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def draw_tables(key: np.ndarray, customers: np.ndarray, others: np.ndarray, p: np.ndarray, discount: float, strength: float, draw: int) -> np.ndarray:
    """Tables of each word of a restaurant: one draw given its customers, the tables of the others there, and its probability above.

    t tables have the weight S(customers, t) * p**t * product of (strength + discount * (others + k)) for k < t.
    """
    if discount not in _STIRLING:
        _STIRLING[discount] = _stirling(discount)
    t = np.minimum(customers, 1).astype(np.int64)
    some = np.flatnonzero(customers > 1)
    order = some[np.argsort(customers[some], kind="stable")]
    sizes = np.minimum(customers[order], EXACT + 1)
    u = _uniform(key[order], draw)
    log_p = np.log(p[order])
    rest = np.maximum(others[order], 0)
    at, ends = np.unique(sizes, return_index=True)
    for c, a, b in zip(at, ends, np.append(ends, len(sizes))[1:], strict=True):
        if c > EXACT:
            break
        for i in range(a, b, 1 + (1 << 20) // int(c)):
            j = min(b, i + 1 + (1 << 20) // int(c))
            steps = np.log(strength + discount * (rest[i:j, None] + np.arange(c))) + log_p[i:j, None]
            logits = np.cumsum(steps, axis=1) + _STIRLING[discount][c, 1 : c + 1]
            w = np.exp(logits - logits.max(axis=1, keepdims=True)).cumsum(axis=1)
            t[order[i:j]] = 1 + (u[i:j, None] * w[:, -1:] > w).sum(axis=1)
    many = order[int(np.searchsorted(sizes, EXACT + 1)) :]
    if len(many):
        u = _uniform(key[many], draw)
        t[many] = [_draw_many(*x, discount, strength) for x in zip(u.tolist(), customers[many].tolist(), np.maximum(others[many], 0).tolist(), p[many].tolist(), strict=True)]
    return np.minimum(t, customers)


def _log_factorials(n: int) -> np.ndarray:
    """Logarithms of 0! .. n! at least."""
    global _FACTORIALS
    if n >= len(_FACTORIALS):
        _FACTORIALS = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 2 * n + 1)))])
    return _FACTORIALS


_FACTORIALS = np.zeros(1)
_TERMS, _NOTHING = 120, 45.0


@functools.lru_cache(1024)
def _gammas(c: int, d: float) -> np.ndarray:
    """Of each term of the alternating sum, what does not depend on the tables."""
    return np.array([math.lgamma(c - d * k) + math.lgamma(1 + d * k) if c > d * k else -np.inf for k in range(1, _TERMS + 1)])


def log_stirling(c: int, t: np.ndarray, d: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S(c, t) for many customers c and ascending t.

    Up to 2 * c**d tables their alternating sum converges at once; beyond, the coefficient of
    x**c in ((1 - (1 - x)**d) / d)**t comes from its saddle point.
    """
    facts = _log_factorials(int(t[-1]) + 1)
    near = t <= 2.0 * c**d
    out = np.empty(len(t))
    if near.any():
        m = t[near]
        j = np.arange(1, min(_TERMS, int(m[-1])) + 1)
        gammas = _gammas(c, d)[: len(j)]
        top = gammas[0]
        rest = m[:, None] - j
        choose = np.where(rest >= 0, facts[m][:, None] - facts[np.maximum(rest, 0)] - facts[j], -np.inf)
        logs = choose + (gammas - top)
        # what no double can tell from nothing beside the largest term; the most tables need the most terms
        most = 1 + int(np.flatnonzero(logs[-1] > logs[-1].max() - _NOTHING)[-1])
        terms = np.exp(logs[:, :most]) * (np.sin(np.pi * d * j) / np.pi * np.where(j % 2, 1, -1))[:most]
        out[near] = np.log(np.maximum(terms.sum(axis=1), 1e-300)) + top - m * math.log(d) - facts[m]
    if not near.all():
        m = np.minimum(t[~near], c - 1).astype(np.float64)
        low, high = np.full(len(m), -700.0), np.full(len(m), -1e-12)
        for _ in range(80):  # where d * u**(d - 1) * (1 - u) / (1 - u**d) = c / t, by halving in log u
            y = (low + high) / 2
            u = np.exp(y)
            big = d * np.exp((d - 1) * y) * (1 - u) / -np.expm1(d * y) > c / m
            low, high = np.where(big, y, low), np.where(big, high, y)
        u = np.exp(high)
        x, g = 1 - u, -np.expm1(d * high) / d
        slope = x * u ** (d - 1) / g
        curve = x * x * (1 - d) * u ** (d - 2) / g + slope - slope * slope
        out[~near] = math.lgamma(c + 1) - facts[m.astype(np.int64)] + m * np.log(g) - c * np.log1p(-u) - 0.5 * np.log(2 * np.pi * m * curve)
        out[t >= c] = 0.0
    return out


def _draw_many(u: float, customers: int, others: float, p: float, discount: float, strength: float) -> int:
    """One draw for a word with many customers: weights of 1, 2 .. tables, as far as they count.

    The weights have one peak. Those of a few numbers of tables show where it is, and those
    around it are computed one by one.
    """
    at, logs, sofar, have, best = [], [], np.zeros(0), 0, -math.inf
    size = max(256, int(2.0 * customers**discount))
    while have < customers and (not logs or logs[-1] >= best - 40):
        end = min(customers, have + size)
        steps = np.log(strength + discount * (others + np.arange(have, end))) + math.log(p)
        sofar = np.concatenate([sofar, np.cumsum(steps) + (sofar[-1] if have else 0.0)])
        for few in _grid(have, end, int(2.0 * customers**discount)):
            if logs and logs[-1] < best - 40:
                break
            found = log_stirling(customers, few, discount) + sofar[few - 1]
            at += few.tolist()
            logs += found.tolist()
            best = max(best, float(found.max()))
        have, size = end, size * 2
    counted = np.flatnonzero(np.array(logs) >= best - 40)
    t = np.arange(at[max(0, counted[0] - 1)], at[min(len(at) - 1, counted[-1] + 1)] + 1)
    logs = log_stirling(customers, t, discount) + sofar[t - 1]
    w = np.exp(logs - logs.max()).cumsum()
    return int(t[0]) + int(np.searchsorted(w, u * w[-1], side="right"))


_STEPS = np.unique(np.rint(1.25 ** np.arange(180)).astype(np.int64))


def _grid(have: int, end: int, near: int) -> list[np.ndarray]:
    """Numbers from have + 1 to end in growing steps; those up to `near`, which cost less, apart."""
    inner = _STEPS[np.searchsorted(_STEPS, have + 2) : np.searchsorted(_STEPS, end)]
    n = np.concatenate([[have + 1], inner, [end] * (end > have + 1)]).astype(np.int64)
    if have + 1 < near < end and near not in n:
        n = np.insert(n, np.searchsorted(n, near), near)
    return [x for x in (n[n <= near], n[n > near]) if len(x)]


def seat_all_words(table: pa.Table, distinct: float, tables: float, sweep: int) -> pa.Table:
    """Add up a shard's words and restaurants, and redraw the words' tables in the restaurant of all words; totals under block -1."""
    blocks, got, order, first, group = _merge(table)
    add = lambda k: np.add.reduceat(np.concatenate([g[k] for g in got])[order], first)
    x, y = add("x"), add("y")
    key = np.concatenate([g["hash"] for g in got])[order][first]
    word = np.concatenate([g["word"] for g in got])[order][first] == 1
    p = np.full(int(word.sum()), (1 - UNKNOWN_BASE) / max(1.0, distinct))
    # the others' tables are those of the sweep before, but for one of the word's own
    y[word] = draw_tables(key[word], x[word].astype(np.int64), np.full(len(p), max(0.0, tables - 1)), p, DISCOUNTS[2], STRENGTHS[2], 3 * sweep + 2)
    shard = table.column("shard")[0].as_py()
    rows = _reply(blocks, got, shard, "sums", {"x": x[group], "y": y[group]})
    rows.append((-1, shard, "sums", _pack(customers=x[word].sum(keepdims=True), tables=y[word].sum(keepdims=True))))
    return _table(rows)


def score_block(table: pa.Table, shards: int, tokens: float, distinct: float) -> pa.Table:
    """Scores of a block's texts."""
    block = Block(table, shards)
    c, numbers = block.counts()
    block.runs(c, numbers, tokens)
    p = np.zeros(len(block.a), np.float32)
    for shard, payload in block.rows.get("scores", {}).items():
        p[block.run_bounds[shard] : block.run_bounds[shard + 1]] = _unpack(payload)["p"]
    logs = np.log10(p.astype(np.float64))
    base = np.log10((c + 0.5) / (tokens + 0.5 * (distinct + 1)))
    first = block.ends - block.lengths
    per_text = lambda v: np.add.reduceat(v, first)
    return pa.table({
        "id": block.ids(), "train": pa.array(block.train.astype(bool)), "n_tokens": pa.array(block.lengths, pa.int64()),
        "n_known": pa.array(per_text((c > 0)[block.sequence].astype(np.int64)), pa.int64()),
        "base_score": pa.array(per_text(base[block.sequence])), "score": pa.array(per_text(logs[block.run])),
    })


def _by_kind(rows: DataFrame) -> dict[str, DataFrame]:
    """Seats and shares as written tables that can be removed apart."""
    whole = materialize(rows, "seats", "kind")
    parts = {}
    for kind in ("seats", "share"):
        parts[kind] = whole.filter(F.col("kind") == kind).select("block", "shard", "kind", "payload")
        parts[kind]._scratch_path = f"{whole._scratch_path}/kind={kind}"  # noqa: SLF001
    return parts


def score_documents(documents: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", burn_in: int = BURN_IN, kept: int = KEPT, block_bytes: int | None = None) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability), perplexity.

    train: a condition on the documents' columns that says which rows the model learns from.
    block_bytes: text of a block. Blocks and shards exchange a row each, so where executors
    have room for larger blocks, larger inputs should have them.
    """
    kind = documents.schema[id_col].dataType.simpleString()
    base = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    size = base.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    shards = blocks = max(1, math.ceil(size / (block_bytes or BLOCK_BYTES)))
    dealt = base.withColumn("block", F.pmod(F.xxhash64("id", "text", F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))

    state = materialize(dealt.groupBy("block").applyInArrow(read_block, _ROWS), "state")
    own = state.filter("kind = 'own'")
    counts = materialize(own.mapInArrow(_with(ask_counts, shards=shards), _ROWS).groupBy("shard").applyInArrow(_with(count_words, shards=shards), _ROWS), "counts")

    def sums(table: DataFrame) -> list[float]:
        """The totals that the shards left under block -1 (two numbers of each)."""
        rows = [[*_unpack(r["payload"]).values()] for r in table.filter("block = -1").select("payload").collect()]
        return [float(sum(t[i][0] for t in rows)) for i in range(2)]

    tokens, distinct = sums(counts)
    known = own.union(counts.filter("block >= 0"))
    asked = known.groupBy("block").applyInArrow(_with(ask_runs, shards=shards, tokens=tokens), _ROWS)
    first = materialize(asked.groupBy("shard").applyInArrow(_with(seat_runs, shards=shards), _ROWS), "runs")
    fixed = first.filter("kind = 'state'")
    seats = _by_kind(fixed.mapInArrow(_with(first_seats, shards=shards), _ROWS))
    totals, kept_totals = (0.0, distinct, distinct), []
    rows, scratch = first, [first]
    named = lambda df, kind, k: df.withColumn("kind", F.lit(f"{kind}{k}"))
    for sweep in range(burn_in + kept + 1):
        above = materialize(seats["share"].groupBy("shard").applyInArrow(_with(seat_all_words, distinct=distinct, tables=totals[1], sweep=sweep), _ROWS), "above")
        discard(seats["share"])
        totals = (*sums(above), distinct)
        standing = seats["seats"]
        if sweep > burn_in:
            scratch += [standing, above]
            rows = rows.union(named(standing, "seats", len(kept_totals))).union(named(above.filter("block >= 0"), "sums", len(kept_totals)))
            kept_totals.append(totals)
        if sweep < burn_in + kept:
            redrawn = fixed.union(standing).union(above.filter("block >= 0")).groupBy("block").applyInArrow(_with(sweep_shard, shards=shards, totals=totals, sweep=sweep), _ROWS)
            seats = _by_kind(redrawn)
        if sweep <= burn_in:
            discard(standing)
            discard(above)
    # in parts, so that only one part's shuffle lies beside the tables
    parts = min(PARTS, shards)
    answer = lambda k: rows.filter(F.pmod("block", F.lit(parts)) == k).groupBy("block").applyInArrow(_with(answer_blocks, shards=shards, totals=kept_totals), _ROWS)
    last = functools.reduce(DataFrame.union, [materialize(answer(k), "scores") for k in range(parts)])
    for used in scratch:
        discard(used)
    answered = known.union(state.filter("kind = 'ids'")).union(last)
    schema = f"id {kind}, train boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    out = answered.groupBy("block").applyInArrow(_with(score_block, shards=shards, tokens=tokens, distinct=distinct), schema)
    return out.select(
        F.col("id").alias(id_col), "train", "n_tokens", "n_known", F.lit(int(tokens)).cast("bigint").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
