"""Benchmark decontamination by suffix arrays over the training documents.

The documents of a task form shards of SHARD_BYTES of text. A shard's suffix array holds the
word positions that begin with a word of the benchmark, ordered by their next words (no
match is lost: other suffixes share no first word with any test suffix). Every distinct
window of the test suffixes is binary-searched in it, all of them at once, one word deeper
per step; what is left of the range are the places where the window stands verbatim. From
there places and test suffixes are extended together, word by word, to the longest match.

Windows are `window` consecutive words of an item, or a whole item with fewer words. Words
are runs of ASCII letters (case ignored), digits and non-ASCII characters. Matches do not
cross documents or items.

Nothing is expanded by item: windows of one length have disjoint ranges, so a place is
looked at once per length; windows that stand in the same items share one list of them.
Benchmarks of more than BLOCK_BYTES are taken block by block, one at a time in the driver
and in a broadcast; what further blocks hit is written to a table and joined by the text's
digest.

Null and empty texts have no words and no hits; items without words match nothing; a null
item id is listed as 'null'. Rows that repeat a document or an item are each looked at; an
item id is listed once. Empty tables are fine. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, LongType, StringType, StructField, StructType

from corpusmill.llm.scratch import materialize
from corpusmill.llm.wordhash import ALNUM, mix, slices, text_bytes, words

WINDOW = 13
SHARD_BYTES = 4 << 20
#: Benchmark text that is broadcast at a time.
BLOCK_BYTES = 16 << 20
#: Item ids in the lists of one output batch.
_LISTED = 1 << 18


@dataclass
class Block:
    """A bounded part of the benchmark.

    ids: word numbers, 0 after each item. starts: where each window begins, window: its number
    among the distinct ones. first, lengths, item_set: of each distinct window a place, its
    words and the number of its list of items. set_bounds, set_items: those lists, as numbers
    of `names` (ascending item ids as text).
    """

    vocabulary: np.ndarray
    ids: np.ndarray
    starts: np.ndarray
    window: np.ndarray
    first: np.ndarray
    lengths: np.ndarray
    item_set: np.ndarray
    set_bounds: np.ndarray
    set_items: np.ndarray
    names: list[str]


def _firsts(ascending: np.ndarray) -> np.ndarray:
    new = np.ones(len(ascending), bool)
    new[1:] = ascending[1:] != ascending[:-1]
    return np.flatnonzero(new)


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """lo[0] .. hi[0] - 1, lo[1] .. hi[1] - 1, and so on."""
    sizes = hi - lo
    return np.repeat(lo - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def read_block(rows: list[tuple[object, str | None]], window: int = WINDOW) -> Block:
    data, offsets = text_bytes(pa.array([t for _, t in rows], pa.string()))
    _, _, _, bounds, hashes = words(data, offsets, ALNUM)
    vocabulary = np.unique(hashes)
    ids = np.zeros(len(hashes) + len(rows), np.int64)
    counts = np.diff(bounds)
    ids[np.arange(len(hashes)) + np.repeat(np.arange(len(rows)), counts)] = np.searchsorted(vocabulary, hashes) + 1
    each = np.where(counts > 0, np.maximum(1, counts - window + 1), 0)
    item = np.repeat(np.arange(len(rows)), each)
    starts = (bounds[:-1] + np.arange(len(rows)))[item] + np.arange(len(item)) - np.repeat(np.cumsum(each) - each, each)
    lengths = np.minimum(counts, window)[item]
    key = lengths.astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(int(lengths.max(initial=0))):
            live = lengths > k
            key[live] = mix((key[live] ^ ids[starts[live] + k].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93))
    _, first, number = np.unique(key, return_index=True, return_inverse=True)
    said = ["null" if k is None else str(k) for k, _ in rows]
    names = sorted({*said})
    place = {k: i for i, k in enumerate(names)}
    name = np.array([place[k] for k in said], np.int64)
    # (window, name) pairs in order; windows with equal lists of names share one
    pairs = np.unique(number * np.int64(max(1, len(names))) + name[item]) if len(item) else np.zeros(0, np.int64)
    of, named = pairs // max(1, len(names)), pairs % max(1, len(names))
    begin = _firsts(of)
    with np.errstate(over="ignore"):
        list_key = np.add.reduceat(mix(named.astype(np.uint64) + np.uint64(1)), begin) if len(of) else np.zeros(0, np.uint64)
    _, chosen, item_set = np.unique(list_key, return_index=True, return_inverse=True)
    lo, hi = begin[chosen], np.append(begin[1:], len(of))[chosen]
    return Block(vocabulary, ids, starts, number, starts[first], lengths[first], item_set, np.concatenate([[0], np.cumsum(hi - lo)]), named[_ranges(lo, hi)], names)


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Positions with ids > 0 in the order of the `depth` or more words from there up to a 0, by prefix doubling."""
    at = np.flatnonzero(ids)
    rank, done = ids, 1
    order = np.argsort(rank[at], kind="stable")
    while done < depth and len(at):
        ahead = np.zeros(len(ids), np.int64)
        ahead[: len(ids) - done] = rank[done:]
        key = rank[at] * (int(rank.max()) + 1) + ahead[at]
        order = np.argsort(key)
        key = key[order]
        rank = np.zeros(len(ids), np.int64)
        rank[at[order]] = np.cumsum(np.concatenate([[1], key[1:] != key[:-1]]))
        done *= 2
    return at[order]


def search(ids: np.ndarray, suffixes: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """For each distinct window the range of `suffixes` that begin with it (empty: lo = hi)."""
    lo, hi = np.zeros(len(block.first), np.int64), np.full(len(block.first), len(suffixes), np.int64)
    for depth in range(int(block.lengths.max(initial=0))):
        live = np.flatnonzero((block.lengths > depth) & (lo < hi))
        if not len(live):
            break
        want = block.ids[block.first[live] + depth]

        def bisect(a: np.ndarray, b: np.ndarray, upper: bool, depth: int = depth, want: np.ndarray = want) -> np.ndarray:
            while (open_ := a < b).any():
                mid = (a + b) >> 1
                seen = ids[suffixes[np.minimum(mid, len(suffixes) - 1)] + depth]
                right = open_ & ((seen <= want) if upper else (seen < want))
                a, b = np.where(right, mid + 1, a), np.where(open_ & ~right, mid, b)
            return a

        first = bisect(lo[live], hi[live], False)
        last = bisect(first, hi[live], True)
        lo[live], hi[live] = first, last
    return lo, hi


def extend(ids: np.ndarray, places: np.ndarray, numbers: np.ndarray, block: Block, depth: int) -> np.ndarray:
    """Words of the longest match with a test suffix from each place on; at the place stands the window of that number, `depth` words long."""
    found = np.zeros(len(block.first), bool)
    found[numbers] = True
    tests = np.flatnonzero(found[block.window])
    at, test_node = block.starts[tests], block.window[tests]
    longest, live, node = np.full(len(places), depth), np.arange(len(places)), numbers
    several = len(block.vocabulary) + 1
    while len(live):
        mine, theirs = node * several + ids[places[live] + depth], test_node * several + block.ids[at + depth]
        # a text's or item's end (0) goes no further
        known = np.unique(theirs[theirs % several > 0])
        if not len(known):
            break
        number, same = _find(known, mine)
        live, node = live[same], number[same]
        reached = np.zeros(len(known), bool)
        reached[node] = True
        number, same = _find(known, theirs)
        same &= reached[number]
        at, test_node = at[same], number[same]
        depth += 1
        longest[live] = depth
    return longest


def _find(ascending: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(ascending):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.searchsorted(ascending, keys)
    at[at == len(ascending)] = 0
    return at, ascending[at] == keys


def shard_hits(data: np.ndarray, offsets: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """By document of the shard: words, word starts among all words, longest match; hit words; numbers of the items' names."""
    _, _, _, bounds, hashes = words(data, offsets, ALNUM)
    n = len(offsets) - 1
    counts = np.diff(bounds)
    number, known = _find(block.vocabulary, hashes)
    ids = np.zeros(len(hashes) + n + int(block.lengths.max(initial=0)) + 1, np.int64)
    ids[np.arange(len(hashes)) + np.repeat(np.arange(n), counts)] = np.where(known, number + 1, 0)
    suffixes = suffix_array(ids, int(block.lengths.max(initial=1)))
    lo, hi = search(ids, suffixes, block)
    cover = np.zeros(len(hashes) + 1, np.int64)
    longest, pairs = np.zeros(n, np.int64), []
    sets = max(1, len(block.set_bounds) - 1)
    for size in np.unique(block.lengths[lo < hi]):
        live = np.flatnonzero((lo < hi) & (block.lengths == size))
        which = np.repeat(live, hi[live] - lo[live])
        places = suffixes[_ranges(lo[live], hi[live])]
        of = np.searchsorted(bounds + np.arange(n + 1), places, side="right") - 1
        np.maximum.at(longest, of, extend(ids, places, which, block, int(size)))
        begin = places - of  # word numbers, without the separators
        np.add.at(cover, begin, 1)
        np.add.at(cover, begin + size, -1)
        pairs.append(np.unique(of * sets + block.item_set[which]))
    items = [np.zeros(0, np.int64)] * n
    pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    edges = np.append(_firsts(pairs // sets), len(pairs)) if len(pairs) else np.zeros(1, np.int64)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        mark = np.zeros(len(block.names), bool)
        for k in pairs[a:b] % sets:
            mark[block.set_items[block.set_bounds[k] : block.set_bounds[k + 1]]] = True
        items[pairs[a] // sets] = np.flatnonzero(mark)
    return counts, bounds, longest, np.cumsum(cover)[:-1] > 0, items


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> Iterator[Block]:
    """The benchmark in parts of about BLOCK_BYTES, each read when it is asked for."""
    rows = benchmark.select(F.col(item_col).alias("i"), F.col(text_col).cast("string").alias("t"))
    total = rows.agg(F.sum(F.coalesce(F.octet_length("t"), F.lit(0)) + 16)).first()[0] or 0
    n = max(1, math.ceil(total / BLOCK_BYTES))
    part = F.pmod(F.xxhash64("i", "t"), F.lit(n))
    for k in range(n):
        yield read_block([tuple(r) for r in (rows.filter(part == k) if n > 1 else rows).collect()], window)


def _hits(documents: DataFrame, first: Column, kind: DataType, benchmark: DataFrame, window: int, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """`first` (of type `kind`) of each document with what all blocks of the benchmark hit."""
    context = documents.sparkSession.sparkContext
    text = F.col(text_col).cast("string")
    key = F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    blocks = _blocks(benchmark, item_col, item_text_col, window)
    block = next(blocks)
    further = None
    for later in blocks:
        shared = context.broadcast(later)
        # what a text hits depends on the text alone, so one row of equal ones is enough
        found = _scan(documents.select(key.alias("first"), text.alias("text")), shared, BinaryType()).filter("n_hit > 0")
        found = materialize(found.dropDuplicates(["first"]), "hits")
        further = found if further is None else further.union(found)
        shared.destroy()
    if further is None:
        return _scan(documents.select(first.alias("first"), text.alias("text")), context.broadcast(block), kind)
    both = StructType([StructField("first", kind), StructField("key", BinaryType())])
    base = _scan(documents.select(F.struct(first.alias("first"), key.alias("key")).alias("first"), text.alias("text")), context.broadcast(block), both)
    rest = further.groupBy(F.col("first").alias("key")).agg(F.max("longest").alias("more_longest"), F.flatten(F.collect_list("items")).alias("more_items"), F.flatten(F.collect_list("spans")).alias("more_spans"))
    joined = base.select("first.first", F.col("first.key").alias("key"), "n_words", "n_hit", "longest", "items", "spans").join(rest, "key", "left")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            longest, items, spans, more_longest, more_items, more_spans = (batch.column(i).to_pylist() for i in range(3, 9))
            n_hit = batch.column(2).to_pylist()
            for i in range(len(batch)):
                if more_items[i] is not None:
                    longest[i] = max(longest[i], more_longest[i])
                    items[i] = sorted({*items[i], *more_items[i]})
                    spans[i] = join_spans(spans[i] + more_spans[i])
                    n_hit[i] = sum(spans[i][1::2]) - sum(spans[i][::2])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_hit, pa.int64()), pa.array(longest, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.int64()))], ["first", "n_words", "n_hit", "longest", "items", "spans"])

    return joined.drop("key").mapInArrow(merge, _found(kind))


def join_spans(spans: list[int]) -> list[int]:
    """The union of the ranges (from, to pairs), ascending and apart."""
    out: list[int] = []
    for a, b in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def find_contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, longest (words of the longest verbatim match), items (ids, sorted), spans (hit words as from, to pairs)."""
    found = _hits(documents, F.col(id_col), documents.schema[id_col].dataType, benchmark, window, text_col, item_col, item_text_col)
    return found.withColumnRenamed("first", id_col)


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents, all their columns, of which less than a twentieth of the words is hit. No shuffle with one block of benchmark."""
    found = _hits(documents, F.struct("*"), documents.schema, benchmark, window, text_col, item_col, item_text_col)
    return verdicts(found).filter(~F.col("contaminated")).select("first.*")


def _found(kind: DataType) -> StructType:
    return StructType([StructField("first", kind), StructField("n_words", LongType()), StructField("n_hit", LongType()), StructField("longest", LongType()), StructField("items", ArrayType(StringType())), StructField("spans", ArrayType(LongType()))])


def _scan(rows: DataFrame, shared, kind: DataType) -> DataFrame:  # noqa: ANN001
    """first, n_words, n_hit, longest, items, spans of rows (first, text), for one block of the benchmark."""

    def shard(batch: pa.RecordBatch, block: Block) -> Iterator[pa.RecordBatch]:
        data, offsets = text_bytes(batch.column(1))
        counts, bounds, longest, hit, items = shard_hits(data, offsets, block)
        touched = np.add.reduceat(np.append(hit, False).astype(np.int64), bounds[:-1]) * (counts > 0)
        spans = [np.flatnonzero(np.diff(np.concatenate([[0], hit[bounds[i] : bounds[i + 1]], [0]]))) if touched[i] else touched[:0] for i in range(len(counts))]
        names = pa.array(block.names, pa.string())
        sizes = np.concatenate([[0], np.cumsum([len(x) for x in items])])

        def lists(parts: list[np.ndarray], values: pa.Array | None = None) -> pa.Array:
            flat = pa.array(np.concatenate(parts).astype(np.int64))
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in parts])]), pa.int32()), values.take(flat) if values is not None else flat)

        for i, j in slices(sizes, _LISTED):
            columns = [batch.column(0).slice(i, j - i), pa.array(counts[i:j], pa.int64()), pa.array(touched[i:j], pa.int64()), pa.array(longest[i:j], pa.int64()), lists(items[i:j], names), lists(spans[i:j])]
            yield pa.RecordBatch.from_arrays(columns, ["first", "n_words", "n_hit", "longest", "items", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size = shared.value, [], 0
        for batch in batches:
            _, offsets = text_bytes(batch.column(1))
            for i, j in slices(offsets, SHARD_BYTES):
                if held and size + offsets[j] - offsets[i] > SHARD_BYTES:
                    yield from shard(pa.Table.from_batches(held).combine_chunks().to_batches()[0], block)
                    held, size = [], 0
                held.append(batch.slice(i, j - i))
                size += offsets[j] - offsets[i]
        if held:
            yield from shard(pa.Table.from_batches(held).combine_chunks().to_batches()[0], block)

    return rows.mapInArrow(run, _found(kind))


def verdicts(found: DataFrame) -> DataFrame:
    """found with n_items, items_sha256 and contaminated: hit words are at least a twentieth of all."""
    return found.withColumns({
        "n_items": F.size("items").cast("bigint"),
        "items_sha256": F.sha2(F.concat_ws(",", "items"), 256),
        "contaminated": (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")),
    })


#: The same verdicts by joining every run of words of a window's length with the windows.
ORACLE_SQL = """
WITH low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS said
  FROM item, LATERAL (SELECT unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
runs AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS said FROM low, sizes, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)),
found AS (SELECT doc_id, i, r.n, item_id FROM runs r JOIN windows USING (n, said)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS list FROM (SELECT DISTINCT doc_id, coalesce(CAST(item_id AS VARCHAR), 'null') AS id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
  coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM low LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
