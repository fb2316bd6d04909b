"""Byte-level BPE: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest.

Null text is the empty text; empty text has no tokens. Repeated rows give repeated rows.
Empty tables give no rows. Extra columns are ignored. Nothing is shuffled: the job is one pass over the scan.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A vocabulary is broadcast; more entries than this are refused.
MOST_RANKS = 1_000_000
#: Pre-tokens of one generation that a worker remembers; it keeps two, and so the frequent ones.
MEMO = 250_000
_MASK = (1 << 64) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file of lines 'base64 rank'."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    if len(ranks) > MOST_RANKS:
        raise ValueError(f"{len(ranks)} ranks; at most {MOST_RANKS} are broadcast")
    return ranks


class PerfectHash:
    """A minimal perfect hash of n keys onto n slots: hash, then displace bucket by bucket.

    A bucket of several keys keeps the seed that sends all its keys to free slots; a bucket
    of one key keeps -1 - slot. A looked-up key is compared with the slot's key, so absent
    keys are told apart.
    """

    def __init__(self, table: dict[bytes, int]):
        n = max(1, len(table))
        self.keys: list[bytes | None] = [None] * n
        self.values = [-1] * n
        self.seeds = [0] * (n // 3 + 1)
        buckets: dict[int, list[tuple[int, bytes]]] = {}
        for key in table:
            h = xxhash.xxh64_intdigest(key)
            buckets.setdefault(h % len(self.seeds), []).append((h, key))
        free = 0
        for at, members in sorted(buckets.items(), key=lambda x: -len(x[1])):
            if len(members) == 1:
                while self.keys[free] is not None:
                    free += 1
                self.seeds[at], slots = -1 - free, [free]
            else:
                seed = 1
                while True:
                    slots = [self._slot(h, seed, n) for h, _ in members]
                    if len(set(slots)) == len(slots) and all(self.keys[s] is None for s in slots):
                        break
                    seed += 1
                self.seeds[at] = seed
            for slot, (_, key) in zip(slots, members, strict=True):
                self.keys[slot], self.values[slot] = key, table[key]

    @staticmethod
    def _slot(h: int, seed: int, n: int) -> int:
        x = (h ^ (seed * 0x9E3779B97F4A7C15)) & _MASK
        x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & _MASK
        return (x ^ (x >> 29)) % n

    def get(self, key: bytes) -> int | None:
        h = xxhash.xxh64_intdigest(key)
        seed = self.seeds[h % len(self.seeds)]
        slot = -1 - seed if seed < 0 else self._slot(h, seed, len(self.keys))
        return self.values[slot] if self.keys[slot] == key else None


class Codec(dict):
    """Encodes and decodes texts; as a dictionary, pre-token -> its ids in decimal joined by commas.

    A task keeps one for all its batches. It holds two generations of MEMO pre-tokens, so
    that the frequent ones stay.
    """

    def __init__(self, index: PerfectHash, pattern: str):
        super().__init__()
        self.index = index
        self.split = regex.compile(pattern).findall
        # for merging only: inside a pre-token almost every pair is looked up once, and most are there
        self.ranks = {key: rank for key, rank in zip(index.keys, index.values, strict=True) if key is not None}
        self.token = [b""] * (max(self.ranks.values(), default=0) + 1)
        for key, rank in self.ranks.items():
            self.token[rank] = key
        self.older: dict[str, str] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Merge the adjacent pair of lowest rank, leftmost first, until none is a token."""
        n, rank = len(piece), self.ranks.get
        bits = n.bit_length()
        low = (1 << bits) - 1
        right = [*range(1, n + 1)]  # right[i]: where the part that begins at i ends, and the next begins
        left = [*range(-1, n)]  # left[i]: where the part before begins
        pair = [rank(piece[i : i + 2], -1) for i in range(n - 1)]  # rank of the part at i with the next, if a token
        pair.append(-1)
        heap = [r << bits | i for i, r in enumerate(pair) if r >= 0]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            r = pop(heap)
            i = r & low
            r >>= bits
            if pair[i] != r:
                continue
            j = right[i]
            end = right[i] = right[j]
            pair[j] = -1
            if end < n:
                left[end] = i
                pair[i] = r = rank(piece[i : right[end]], -1)
                if r >= 0:
                    push(heap, r << bits | i)
            else:
                pair[i] = -1
            if i:
                j = left[i]
                pair[j] = r = rank(piece[j:end], -1)
                if r >= 0:
                    push(heap, r << bits | j)
        out, i = [], 0
        while i < n:
            if (r := rank(piece[i : right[i]])) is None:
                raise ValueError(f"byte {piece[i]} is no token of this vocabulary")
            out.append(r)
            i = right[i]
        return out

    def __missing__(self, text: str) -> str:
        if (shown := self.older.get(text)) is None:
            raw = text.encode()
            whole = self.index.get(raw)
            shown = str(whole) if whole is not None else ",".join(map(str, self.merge(raw)))
        if len(self) >= MEMO:
            self.older = dict(self)
            self.clear()
        if len(text) <= 256:
            self[text] = shown
        return shown

    def shown(self, text: str) -> str:
        """The ids of a text in decimal, joined by commas."""
        return ",".join(map(self.__getitem__, self.split(text)))

    def encode(self, text: str) -> list[int]:
        return [*map(int, shown.split(","))] if (shown := self.shown(text)) else []

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def encode_documents(documents: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, with_text: bool = False) -> DataFrame:
    """One row per document: its id, n_tokens, ids_sha256, decoded_sha256; token_ids and the decoded text on request."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast((PerfectHash(read_ranks(ranks_path)), pattern))
    id_type = documents.schema[id_col].dataType
    fields = [pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]
    fields += [pa.field("token_ids", pa.list_(pa.int32()))] * with_ids + [pa.field("decoded", pa.string())] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*shared.value)
        for batch in batches:
            counts, shas, decoded, all_ids, texts = [], [], [], [], []
            for text in batch.column(1):
                shown = codec.shown(text.as_py() or "")
                ids = [*map(int, shown.split(","))] if shown else []
                back = codec.decode(ids)
                counts.append(len(ids))
                shas.append(hashlib.sha256(shown.encode()).hexdigest())
                decoded.append(hashlib.sha256(back).hexdigest())
                if with_ids:
                    all_ids.append(ids)
                if with_text:
                    texts.append(back.decode())
            columns = [counts, shas, decoded] + [all_ids] * with_ids + [texts] * with_text
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, fields, strict=True))], ["id", *(f.name for f in fields)])

    kinds = {"n_tokens": "bigint", "token_ids": "array<int>"}
    schema = f"id {id_type.simpleString()}, " + ", ".join(f"{f.name} {kinds.get(f.name, 'string')}" for f in fields)
    out = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)
