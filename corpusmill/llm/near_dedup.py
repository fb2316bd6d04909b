"""Near-duplicates by BagMinHash: weighted-Jaccard signatures, banding, exact multiset checks.

Documents are multisets of WORDS-word shingles (a text of fewer words is one shingle). The
classes are the connected components of the graph that links documents of equal text and
documents whose multisets have a weighted Jaccard similarity of THRESHOLD or more.

Signature (BagMinHash): each shingle owns independent Poisson processes over the discretised
weight axis, cut into the blocks [0,1), [1,2), [2,4), [4,8) .. of rates 1, 1, 2, 4 ..; a
point has a time, one of the signature's slots and, by halving its block again and again, a
unit cell. A shingle with count w offers the points of the cells below w, and a slot keeps
its earliest time. So slots agree with the probability of the weighted Jaccard similarity,
and a count costs its logarithm. Points are drawn in order of time up to a horizon, farther
only for documents with empty slots. Times are integers: no batch changes a bit.

Candidates: with BANDS bands of ROWS slots a pair at the threshold is missed with
probability (1 - 0.8**ROWS)**BANDS, below 1e-6.

Verification never expands a group into its pairs:
1. members of a bucket are checked against its smallest member, and what is linked is merged;
2. documents of buckets that still hold several components meet by prefix filtering: their
   shingles are ordered by rarity among these documents, and only pairs of different
   components that share one of the rarest, at positions that still allow the threshold, are
   checked. This is exact for tokens that at most CROWD of these documents have up front;
3. documents that share a more frequent token up front form groups, which buckets tie together.
   In a dense group two documents share a bucket on average (copies of one text, of which many
   lie just below the threshold of each other), and no banding keeps them apart. It is dealt to
   blocks that are compared two at a time, exactly, in a task each: no row is a pair, a block has
   a fixed size, and of the links a task returns those that join components. The comparisons
   grow with the square of such a group, which they do by nature;
4. the others (texts built from common passages) are banded again, with rows that grow with the logarithm of their number and as many bands as
   keep a miss at the threshold below 1e-6. Pairs of different components in such a bucket are
   checked: of a bucket, its largest component meets the others, never itself. So the checks
   grow a little faster than the documents, not with their square.

Null text is the empty text. Texts without a word are linked to equal texts only. Ids are
integers. A null id takes the class of equal texts with an id, else null. Repeated rows are returned each.
Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.components import connected_components
from corpusmill.llm.scratch import discard, free_name, materialize
from corpusmill.llm.wordhash import ALNUM, mix, slices, text_bytes, words

WORDS = 5
BANDS = 46
ROWS = 6
#: The threshold as a fraction of whole numbers, so that checks are exact.
ABOVE, BELOW = 4, 5
#: Documents that may meet at one token; more are banded again. It decides on the way, not on the result.
CROWD = 32
#: Documents and bytes of text of a block of a dense group, on average, and tokens of its table that are held at once.
BLOCK_TEXTS, BLOCK_BYTES, BLOCK_TOKENS = 512, 4 << 20, 8192
#: Points that one call of `signatures` should draw.
_POINTS = 1 << 21
_PIECE_BYTES = 1 << 18
_STEP = np.uint64(0x9E3779B97F4A7C15)
_UNIT = 1 << 40


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingle hashes of each text in ascending order, their counts, bounds by text)."""
    _, _, _, bounds, hashes = words(data, offsets, ALNUM)
    n = np.diff(bounds)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    text = np.repeat(np.arange(len(n)), count)
    at = np.repeat(bounds[:-1] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    last = bounds[1:][text]
    out = np.full(len(at), np.uint64(0x243F6A8885A308D3))
    with np.errstate(over="ignore"):
        for i in range(size):
            here = np.minimum(at + i, max(0, len(hashes) - 1))
            word = np.where(at + i < last, hashes[here] if len(hashes) else 0, np.uint64(0))
            out = (out ^ word) * np.uint64(0xD6E8FEB86659FD93)
            out ^= out >> np.uint64(29)
    out = mix(out)
    order = np.lexsort((out, text))
    out, text = out[order], text[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return out[first], np.diff(np.append(first, len(out))), np.searchsorted(text[first], np.arange(len(n) + 1))


def signatures(keys: np.ndarray, counts: np.ndarray, bounds: np.ndarray, slots: int = BANDS * ROWS) -> np.ndarray:
    """(texts, slots) earliest times; a text without shingles has none (the largest integer)."""
    n = len(bounds) - 1
    out = np.full((n, slots), np.iinfo(np.int64).max)
    sizes = np.diff(bounds)
    weight = np.add.reduceat(np.append(counts, 0), bounds[:-1]) * (sizes > 0) if n else sizes
    text = np.repeat(np.arange(n), sizes)
    horizon = slots * (math.log(slots) + 4) / np.maximum(weight, 1)
    todo = sizes > 0
    while todo.any():
        mine = todo[text]
        _points(out, keys[mine], counts[mine], text[mine], horizon, slots)
        todo &= (out == np.iinfo(np.int64).max).any(axis=1)
        horizon = horizon * 2
    return out


def _points(out: np.ndarray, keys: np.ndarray, counts: np.ndarray, text: np.ndarray, horizon: np.ndarray, slots: int) -> None:
    """Lower `out` by all points up to the horizon of each text."""
    rows = []
    level = 0
    while True:  # block 0 is [0, 1), block k is [2**(k-1), 2**k)
        begin = (1 << level) >> 1
        mine = np.flatnonzero(counts > begin)
        if not len(mine):
            break
        rows.append((mine, np.full(len(mine), level), np.full(len(mine), max(1, begin))))
        level += 1
    element, levels, rate = (np.concatenate(x) for x in zip(*rows, strict=True))
    of = text[element]
    with np.errstate(over="ignore"):
        seed = mix(keys[element] + levels.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    begin = (1 << levels) >> 1
    room = counts[element] - begin  # cells of the block that the count covers
    limit = (horizon[of] * _UNIT).astype(np.int64)
    mean = rate * horizon[of]
    drawn = np.zeros(len(seed), np.int64)
    time = np.zeros(len(seed), np.int64)
    live = np.arange(len(seed))
    first = True
    flat = out.reshape(-1)
    while len(live):
        take = (np.ceil(mean[live]) if first else np.ceil(np.sqrt(mean[live]))).astype(np.int64) + 1
        first = False
        row = np.repeat(live, take)
        start = np.cumsum(take) - take
        number = np.arange(len(row)) - np.repeat(start, take) + drawn[row]
        with np.errstate(over="ignore"):
            bits = mix(seed[row] + (number.astype(np.uint64) + np.uint64(1)) * _STEP)
            wait = (-np.log(((bits >> np.uint64(20)).astype(np.float64) + 0.5) * 2.0**-44) * (_UNIT / rate[row])).astype(np.int64)
            total = np.cumsum(wait)
            when = total - np.repeat(total[start] - wait[start], take) + time[row]
        ok = when <= limit[row]
        split = np.flatnonzero(ok & (rate[row] > 1))
        if len(split):  # the halvings of the block, one bit each
            cell = (mix(bits[split] ^ np.uint64(0x5851F42D4C957F2D)) & (rate[row[split]] - 1).astype(np.uint64)).astype(np.int64)
            ok[split] = cell < room[row[split]]
        hit = np.flatnonzero(ok)
        slot = ((bits[hit] & np.uint64(0xFFFFF)) * np.uint64(slots) >> np.uint64(20)).astype(np.int64)
        np.minimum.at(flat, of[row[hit]] * slots + slot, when[hit])
        time[live] = when[start + take - 1]
        drawn[live] += take
        live = live[time[live] <= limit[live]]


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, -1).astype(np.uint64)
    out = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64) * _STEP), parts.shape[:2])
    with np.errstate(over="ignore"):
        for i in range(parts.shape[2]):
            out = mix((out ^ parts[:, :, i]) * np.uint64(0xD6E8FEB86659FD93))
    return out


def _text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _band_table(documents: DataFrame) -> DataFrame:
    """(id, key, bands) of documents (id, text, key); bands is null for texts without a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            for i, j in slices(offsets, _PIECE_BYTES):
                keys, counts, bounds = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                bands = band_keys(signatures(keys, counts, bounds)).view(np.int64)
                empty = np.append(np.diff(bounds) == 0, False)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * BANDS, pa.int32(), mask=empty), pa.array(bands.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), lists], ["id", "key", "bands"])

    return documents.select("id", "key", "text").mapInArrow(run, "id bigint, key binary, bands array<bigint>")


def _check(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose multisets reach the threshold. Of a, usually the smaller side of many pairs, a run of equal ids is read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[object, np.ndarray, np.ndarray] = (None, np.zeros(0), np.zeros(0))
        for batch in batches:
            ids = batch.column(0).to_pylist()
            fresh = [i for i, a in enumerate(ids) if i == 0 and a != held[0] or i and a != ids[i - 1]]
            sides = []
            for column in (batch.column(2).take(pa.array(fresh, pa.int64())), batch.column(3)):
                data, offsets = text_bytes(column)
                sides.append([(k[s:e], c[s:e]) for i, j in slices(offsets, _PIECE_BYTES) for k, c, b in [shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])] for s, e in zip(b[:-1], b[1:], strict=True)])
            linked, mine = np.zeros(len(ids), bool), iter(sides[0])
            starts = {*fresh}
            for i, a in enumerate(ids):
                if i in starts:
                    held = (a, *next(mine))
                linked[i] = similar(held[1], held[2], *sides[1][i])
            yield batch.select([0, 1]).filter(pa.array(linked))

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("a_text"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("b_text"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "a_text", "b_text").mapInArrow(run, "a bigint, b bigint")


def overlap(k1: np.ndarray, c1: np.ndarray, k2: np.ndarray, c2: np.ndarray) -> int:
    if not len(k1) or not len(k2):
        return 0
    at = np.searchsorted(k2, k1)
    at[at == len(k2)] = 0
    same = k2[at] == k1
    return int(np.minimum(c1[same], c2[at[same]]).sum())


def similar(k1: np.ndarray, c1: np.ndarray, k2: np.ndarray, c2: np.ndarray) -> bool:
    common = overlap(k1, c1, k2, c2)
    return common > 0 and common * BELOW >= ABOVE * (int(c1.sum()) + int(c2.sum()) - common)


def _tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, tokens, their bounds) of runs of texts. The k-th occurrence of a shingle is a token of its own: multisets as sets."""
    data, offsets = text_bytes(column)
    for i, j in slices(offsets, _PIECE_BYTES):
        keys, counts, bounds = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        nth = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        with np.errstate(over="ignore"):
            tokens = mix(np.repeat(keys, counts) + nth.astype(np.uint64) * _STEP)
        yield i, j, tokens, np.concatenate([[0], np.cumsum(counts)])[bounds]


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, tokens, ends in _tokens(batch.column(2)):
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tokens.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), lists], ["id", "comp", "tokens"])


def compare_blocks(table: pa.Table) -> pa.Table:
    """Links (a, b) that join the components of one block (i = j) or of two, from rows (id, comp, text, block, i, j)."""
    table = table.sort_by("block").combine_chunks()
    ids, comps, blocks = (table.column(k).to_numpy() for k in ("id", "comp", "block"))
    parts = [(tokens, np.diff(ends)) for chunk in table.column("text").chunks for _, _, tokens, ends in _tokens(chunk)]
    n = np.concatenate([k for _, k in parts])
    _, code, times = np.unique(np.concatenate([t for t, _ in parts]), return_inverse=True, return_counts=True)
    text = np.repeat(np.arange(len(n)), n)
    shared = times > 1
    code, text = (np.cumsum(shared) - 1)[code[shared[code]]], text[shared[code]]
    order = np.argsort(code, kind="stable")
    code, text = code[order], text[order]
    inner = table.column("i")[0].as_py() == table.column("j")[0].as_py()
    first = len(n) if inner else int(np.searchsorted(blocks, blocks[-1]))
    left, right = slice(0, first), slice(0 if inner else first, len(n))
    common = np.zeros((first, right.stop - right.start))
    for at in range(0, int(shared.sum()), BLOCK_TOKENS):
        a, b = np.searchsorted(code, (at, at + BLOCK_TOKENS))
        held = np.zeros((len(n), BLOCK_TOKENS), np.float32)
        held[text[a:b], code[a:b] - at] = 1
        common += held[left] @ held[right].T
    met = (common > 0) & (common * BELOW >= ABOVE * (n[left, None] + n[right] - common)) & (comps[left, None] != comps[right])
    x, y = np.nonzero(met)
    y += right.start
    names, comp = np.unique(comps, return_inverse=True)
    _, one = np.unique(comp[x] * len(names) + comp[y], return_index=True)
    root, links = [*range(len(names))], []

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for k in one.tolist():
        p, q = find(int(comp[x[k]])), find(int(comp[y[k]]))
        if p != q:
            root[p] = q
            links.append(k)
    return pa.table({"a": pa.array(ids[x[links]], pa.int64()), "b": pa.array(ids[y[links]], pa.int64())})


def _dense_groups(met: DataFrame) -> DataFrame:
    """(id, grp) of documents in groups whose documents share one bucket (id, band) with each other, or more, on average."""
    buckets = materialize(met.groupBy("band").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("size")).filter("size > 1"), "buckets")
    ties = met.join(buckets, "band").filter("id != head").select(F.col("head").alias("a"), F.col("id").alias("b"))
    roots = connected_components(ties)
    # a root stands for itself
    groups = roots.select(F.col("node").alias("id"), F.col("root").alias("grp")).union(roots.select(F.col("root").alias("id"), F.col("root").alias("grp")).distinct())
    sizes = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("m"))
    shared = buckets.join(groups.withColumnRenamed("id", "head"), "head").groupBy("grp").agg(F.sum(F.col("size") * (F.col("size") - 1)).alias("shared"))
    dense = shared.join(sizes, "grp").filter(F.col("shared") >= F.col("m") * (F.col("m") - 1)).select("grp")
    out = materialize(groups.join(dense, "grp", "left_semi").select("id", "grp"), "dense")
    for used in (buckets, roots):
        discard(used)
    return out


def _dense_links(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Links (a, b) of (id, comp, text) that join the components of the groups (id, grp); compared exactly."""
    rows = members.join(groups, "id")
    sizes = rows.groupBy("grp").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_TEXTS, F.sum(F.octet_length("text")) / BLOCK_BYTES)).cast("int").alias("blocks"))
    dealt = rows.join(sizes, "grp").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    met = dealt.select("id", "comp", "text", "grp", "block", other).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    return met.groupBy("grp", "i", "j").applyInArrow(compare_blocks, "a bigint, b bigint")


def _rare_pairs(members: DataFrame, placed: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Pairs (a, b) of (id, comp, text) that may reach the threshold, of different components, by prefix filtering; and links of dense groups. placed: (id, band)."""
    sets = materialize(members.select("id", "comp", "text").mapInArrow(_token_rows, "id bigint, comp bigint, tokens array<bigint>"), "tokens")
    rows = sets.select("id", "comp", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    seen = rows.groupBy("token").agg(F.count(F.lit(1)).alias("df"), (F.min("comp") != F.max("comp")).alias("mixed")).filter("df > 1")
    ranked = rows.join(seen, "token")
    # tokens of one document come first and never match; the rest is ordered by rarity
    order = F.array_sort(F.collect_list(F.struct("df", "token", "mixed")))
    shared = ranked.groupBy("id", "comp", "n").agg(order.alias("shared"))
    shared = shared.withColumn("alone", F.col("n") - F.size("shared"))
    reach = F.col("n") - F.ceil(F.col("n") * ABOVE / BELOW) + 1  # no partner of any size is lost beyond this position
    cut = F.slice("shared", 1, F.greatest(F.lit(0), reach - F.col("alone")).cast("int"))
    prefix = shared.filter(reach > F.col("alone")).select("id", "comp", "n", "alone", F.posexplode(cut).alias("p", "t")).filter("t.mixed")
    prefix = materialize(prefix.select("id", "comp", "n", F.col("t.token").alias("token"), (F.col("alone") + F.col("p") + 1).alias("pos")), "prefix")
    discard(sets)
    # a token that only documents of one component have up front gives no pair
    crowds = prefix.groupBy("token").agg(F.count(F.lit(1)).alias("crowd"), (F.min("comp") != F.max("comp")).alias("apart")).filter("apart")
    few = prefix.join(crowds.filter(F.col("crowd") <= CROWD).select("token"), "token", "left_semi")
    x, y = few.alias("x"), few.alias("y")
    need = F.ceil((F.col("x.n") + F.col("y.n")) * ABOVE / (ABOVE + BELOW))
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.comp") != F.col("y.comp"))
                 & ((F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.id") < F.col("y.id"))))
                 & (F.col("x.n") * BELOW >= F.col("y.n") * ABOVE)
                 & (F.col("x.pos") <= F.col("x.n") - need + 1) & (F.col("y.pos") <= F.col("y.n") - need + 1))
    met = met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    crowded = materialize(prefix.join(crowds.filter(F.col("crowd") > CROWD).select("token"), "token", "left_semi").select("id", "n").distinct(), "crowded")
    links = None
    if crowded.take(1):
        groups = _dense_groups(placed.join(crowded, "id", "left_semi").select("id", "band"))
        links = materialize(_dense_links(members, groups), "links")
        apart = crowded.join(groups, "id", "left_anti")
        if many := apart.count():
            met = met.union(_deep_pairs(members.join(apart, "id"), many))
    out = materialize(met.distinct(), "pairs")
    if links is not None:
        discard(groups)
    discard(prefix)
    discard(crowded)
    return out, links


def deep_bands(documents: int) -> tuple[int, int]:
    """(rows, bands) with which so many documents are banded again: half as similar ones rarely meet, at the threshold one in a million is missed."""
    rows = min(24, max(ROWS + 2, math.ceil(math.log2(documents)) + 2))
    return rows, math.ceil(math.log(1e-6) / math.log1p(-((ABOVE / BELOW) ** rows)))


def _deep_pairs(members: DataFrame, documents: int) -> DataFrame:
    """Pairs (a, b) of (id, comp, text, n) of different components and comparable sizes that share a band of a longer signature."""
    rows, bands = deep_bands(documents)
    slots = rows * bands
    texts = max(1, int(_POINTS / (slots * (math.log(slots) + 4))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(3))
            for a, b in slices(offsets, _PIECE_BYTES):
                for i in range(a, b, texts):
                    j = min(b, i + texts)
                    keys, counts, bounds = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * bands, pa.int32()), pa.array(band_keys(signatures(keys, counts, bounds, slots), bands).view(np.int64).reshape(-1)))
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(3)), lists], ["id", "comp", "n", "bands"])

    kinds = "id bigint, comp bigint, n bigint, bands array<bigint>"
    banded = materialize(members.select("id", "comp", F.col("n").cast("bigint"), "text").mapInArrow(run, kinds).select("id", "comp", "n", F.explode("bands").alias("band")), "deep")
    sizes = banded.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("size"))
    mixed = sizes.groupBy("band").agg(F.max(F.struct("size", "comp")).alias("most"), F.count(F.lit(1)).alias("comps")).filter("comps > 1").select("band", F.col("most.comp").alias("major"))
    held = materialize(banded.join(mixed, "band"), "held")
    discard(banded)
    x, y = held.filter("comp != major").alias("x"), held.alias("y")
    met = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.comp") != F.col("y.comp"))
                 & ((F.col("y.comp") == F.col("y.major")) | (F.col("x.id") < F.col("y.id")))
                 & (F.col("x.n") * BELOW >= F.col("y.n") * ABOVE) & (F.col("y.n") * BELOW >= F.col("x.n") * ABOVE))
    return met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id): class_id is the smallest id of the document's class."""
    base = documents.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("key", _text_key(F.col("text")))
    signed = materialize(_band_table(base), "bands")
    first = materialize(signed.groupBy("key").agg(F.min("id").alias("first")), "first")
    # one document stands for all of equal text
    lone = signed.filter("id is not null and bands is not null").join(first.select(F.col("first").alias("id"), "key"), ["id", "key"]).dropDuplicates(["id"])
    banded = materialize(lone.select("id", F.explode("bands").alias("band")), "banded")
    full = banded.groupBy("band").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("band", "head")
    placed = materialize(banded.join(full, "band"), "placed")
    discard(banded)
    discard(signed)
    texts = base.filter("id is not null").select("id", "key", "text").join(first.select(F.col("first").alias("id"), "key"), ["id", "key"], "left_semi")

    def with_texts(ids: DataFrame) -> DataFrame:
        return materialize(texts.join(ids.distinct(), "id", "left_semi").dropDuplicates(["id"]).select("id", "text"), "texts")

    near = with_texts(placed.select("id"))
    links = materialize(_check(placed.filter("id != head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct(), near), "links")
    roots = connected_components(links)
    labelled = placed.join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", "band", F.coalesce("root", "id").alias("comp"))
    open_bands = labelled.groupBy("band").agg((F.min("comp") != F.max("comp")).alias("open")).filter("open").select("band")
    unsettled = labelled.join(open_bands, "band", "left_semi").select("id", "comp").distinct()
    open_ones = materialize(near.join(unsettled, "id"), "open")
    pairs, joined = _rare_pairs(open_ones, placed)
    checked = _check(pairs, near)
    more = materialize(checked if joined is None else checked.union(joined), "more")
    if more.take(1):  # the stars found so far stand for their links
        stars, roots = roots, connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
        discard(stars)
    for used in (placed, near, links, open_ones, pairs, more, *([] if joined is None else [joined])):
        discard(used)
    class_of = first.join(roots.select(F.col("node").alias("first"), "root"), "first", "left").select("key", F.coalesce("root", "first").alias("class_id"))
    return base.select("id", "key").join(class_of, "key").select(F.col("id").alias(id_col), "class_id")


def keep_one(documents: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that give their class its id; rows that repeat such a document stay one row of it.

    Of rows without an id, one of each text stays where no row with an id has that text.
    """
    kept_name, key_name = (free_name(documents, k) for k in ("kept", "key"))
    kept = classes.filter(F.col(id_col) == F.col("class_id")).select(F.col(id_col).alias(kept_name)).distinct()
    out = documents.join(kept, documents[id_col] == F.col(kept_name), "left_semi").dropDuplicates([id_col])
    nameless = documents.filter(F.col(id_col).isNull())
    if nameless.take(1):
        named = documents.filter(F.col(id_col).isNotNull()).select(_text_key(F.col(text_col)).alias(key_name))
        nameless = nameless.withColumn(key_name, _text_key(F.col(text_col))).dropDuplicates([key_name]).join(named, key_name, "left_anti").drop(key_name)
        out = out.unionByName(nameless)
    return out
