"""Vocabularies as tables, and texts as their tokens: byte fallback, merges by rank, longest pieces.

A vocabulary is a DataFrame (id, piece, score, token_type); score and token_type may be null.
Merges are a DataFrame (rank, merge) of two pieces with one space between. Both are bounded
by the model that has them, so they are checked as tables and then broadcast.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format: token types that may be emitted, and those that may not.
EMITTED, SILENT = (1, 4, 6), (2, 3, 5)
#: A larger vocabulary is refused: it is broadcast.
MOST_PIECES = 4_000_000
_WHOLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def _shown() -> dict[str, int]:
    """Character -> byte: printable bytes stand for themselves, the others from 256 on in their order."""
    out = {chr(b): b for b in _WHOLE}
    rest = [b for b in range(256) if b not in {*_WHOLE}]
    return out | {chr(256 + i): b for i, b in enumerate(rest)}


def piece_bytes(piece: Column) -> Column:
    """BINARY that a piece stands for: <0xNN> is a byte; characters that all show bytes are those; a leading U+2581 is a space; else UTF-8."""
    table = F.create_map(*(x for c, b in _shown().items() for x in (F.lit(c), F.lit(f"{b:02X}"))))
    # a sign may stand for the first digit
    byte = F.replace(F.regexp_extract(piece, r"^<0x([0-9A-Fa-f]{2}|\+[0-9A-Fa-f])>$", 1), F.lit("+"), F.lit("0"))
    shown = F.transform(F.split(piece, ""), lambda c: table[c])
    return (
        F.when(byte != "", F.unhex(byte))
        .when(~F.exists(shown, lambda h: h.isNull()), F.unhex(F.array_join(shown, "")))
        .when(F.startswith(piece, F.lit("▁")), F.concat(F.lit(" "), F.substring(piece, 2, 1 << 30)).cast("binary")).otherwise(piece.cast("binary"))
    )


def read_vocabulary(pieces: DataFrame) -> DataFrame:
    """(id, bytes, score, emittable) of (id, piece, score, token_type); null types are emittable."""
    kind = F.col("token_type")
    emitted = F.when(kind.isNull(), True).when(kind.isin(*EMITTED), True).when(kind.isin(*SILENT), False).otherwise(F.raise_error(F.concat(F.lit("token type "), kind.cast("string"))).cast("boolean"))
    return pieces.select(F.col("id").cast("int").alias("id"), piece_bytes(F.col("piece")).alias("bytes"), F.col("score").cast("float").alias("score"), emitted.alias("emittable"))


def parse_merges(merges: DataFrame) -> DataFrame:
    """(rank, left, right) as BINARY; anything but two pieces with one space between raises."""
    parts = F.split("merge", " ")
    good = (F.size(parts) == 2) & (parts[0] != "") & (parts[1] != "")
    checked = F.when(good, parts).otherwise(F.raise_error(F.concat(F.lit("merge "), F.col("merge"))).cast("array<string>"))
    return merges.select(F.col("rank").cast("int").alias("rank"), checked.alias("p")).select("rank", piece_bytes(F.col("p")[0]).alias("left"), piece_bytes(F.col("p")[1]).alias("right"))


def merge_table(vocabulary: DataFrame, merges: DataFrame) -> DataFrame:
    """(rank, left, right, merged) as token ids, by three joins with the emittable pieces; merges with a missing piece are left out."""
    ids = vocabulary.filter("emittable").groupBy("bytes").agg(F.min("id").alias("id"))
    named = lambda k: ids.select(F.col("bytes").alias(k), F.col("id").alias(f"{k}_id"))
    joined = merges.withColumn("merged", F.concat("left", "right"))
    for k in ("left", "right", "merged"):
        joined = joined.join(named(k), k)
    return joined.select("rank", F.col("left_id").alias("left"), F.col("right_id").alias("right"), F.col("merged_id").alias("merged"))


def vocabulary_of(metadata: DataFrame) -> DataFrame:
    """(path, id, piece, score, token_type) of the metadata of files that have a vocabulary; lists of other lengths raise."""
    strings, numbers = "array<string>", "array<double>"
    one = lambda key: F.max(F.when(F.col("key") == f"tokenizer.ggml.{key}", F.col("value"))).alias(key)
    lists = metadata.groupBy("path").agg(*(one(k) for k in ("tokens", "scores", "token_type")))
    read = lists.select("path", F.from_json("tokens", strings).alias("t"), F.from_json("scores", numbers).alias("s"), F.from_json("token_type", "array<int>").alias("k")).filter("t is not null")
    fits = lambda c: F.col(c).isNull() | (F.size(c) == F.size("t"))
    checked = read.withColumn("t", F.when(fits("s") & fits("k"), F.col("t")).otherwise(F.raise_error(F.lit("scores or types of another length")).cast(strings)))
    each = checked.select("path", "s", "k", F.posexplode("t").alias("id", "piece"))
    return each.select("path", "id", "piece", F.get("s", F.col("id")).alias("score"), F.get("k", F.col("id")).alias("token_type"))


def merges_of(metadata: DataFrame) -> DataFrame:
    """(path, rank, merge) of the metadata of files that have merges."""
    rows = metadata.filter("key = 'tokenizer.ggml.merges'")
    return rows.select("path", F.posexplode(F.from_json("value", "array<string>")).alias("rank", "merge"))


def kinds_of(metadata: DataFrame) -> DataFrame:
    """(path, kind): how a file's texts are tokenized: by its model's name, else by merges, else by scores, else bytes. Other names raise."""
    has = lambda key: F.max((F.col("key") == f"tokenizer.ggml.{key}").cast("int")) == 1
    name = F.max(F.when(F.col("key") == "tokenizer.ggml.model", F.col("text"))).alias("name")
    flat = metadata.groupBy("path").agg(name, has("merges").alias("m"), has("scores").alias("s"))
    kind = (
        F.when(F.col("name") == "gpt2", "merges").when(F.col("name").isin("llama", "spm", "sentencepiece"), "pieces").when(F.col("name").isNotNull(), F.raise_error(F.concat(F.lit("tokenizer "), F.col("name"))))
        .when(F.col("m"), "merges").when(F.col("s"), "pieces").otherwise("bytes")
    )
    return flat.select("path", kind.alias("kind"))


def byte_coverage(vocabulary: DataFrame) -> DataFrame:
    """One row: how many single bytes the emittable pieces have, and which are missing (comma-joined)."""
    single = vocabulary.filter("emittable and octet_length(bytes) = 1").select(F.conv(F.hex("bytes"), 16, 10).cast("int").alias("b"))
    seen = single.agg(F.array_sort(F.collect_set("b")).alias("s"))
    return seen.select(F.size("s").cast("bigint").alias("covered"), F.array_join(F.array_except(F.sequence(F.lit(0), F.lit(255)), "s").cast("array<string>"), ",").alias("missing"))


def violations(vocabulary: DataFrame, scores: int | None = None) -> DataFrame:
    """(issue, n): pieces that repeat among the emittable, single bytes that repeat, scores that are not finite, a count other than `scores`."""
    emitted = vocabulary.filter("emittable").groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    repeated = emitted.agg(F.lit("repeated piece").alias("issue"), F.count(F.lit(1)).alias("n"))
    single = emitted.filter("octet_length(bytes) = 1").agg(F.lit("repeated byte").alias("issue"), F.count(F.lit(1)).alias("n"))
    odd = vocabulary.filter("isnan(score) or abs(score) = double('infinity')").agg(F.lit("score not finite").alias("issue"), F.count(F.lit(1)).alias("n"))
    out = repeated.union(single).union(odd)
    if scores is not None:
        out = out.union(vocabulary.agg(F.lit("length").alias("issue"), F.abs(F.count(F.lit(1)) - scores).alias("n")))
    return out.filter("n > 0")


@dataclass
class Pieces:
    """What tokenizing needs of a vocabulary: byte -> id, (left, right) -> (rank, merged), bytes -> id by best score, and the way back."""

    bytes_of: dict[int, bytes]
    byte_ids: dict[int, int]
    merges: dict[tuple[int, int], tuple[int, int]] = field(default_factory=dict)
    pieces: dict[bytes, int] = field(default_factory=dict)
    lengths: list[int] = field(default_factory=list)

    def by_merges(self, data: bytes) -> list[int]:
        """Join the adjacent pair of lowest rank, leftmost first, until none can be joined."""
        ids = [self.byte_ids[b] for b in data]
        after, before = [*range(1, len(ids) + 1)], [*range(-1, len(ids) - 1)]
        gone = [False] * len(ids)
        heap = [(self.merges[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.merges]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= len(ids) or (ids[i], ids[j]) != pair:
                continue
            ids[i], gone[j] = self.merges[pair][1], True
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(ids) and (found := self.merges.get((ids[a], ids[b]))):
                    heapq.heappush(heap, (found[0], a, (ids[a], ids[b])))
        return [t for t, g in zip(ids, gone, strict=True) if not g]

    def by_longest(self, data: bytes) -> list[int]:
        """The longest piece at each place, else the byte."""
        out, at = [], 0
        while at < len(data):
            for n in self.lengths:
                if (found := self.pieces.get(data[at : at + n])) is not None and at + n <= len(data):
                    out.append(found)
                    at += n
                    break
            else:
                out.append(self.byte_ids[data[at]])
                at += 1
        return out


def collect_pieces(vocabulary: DataFrame, merges: DataFrame | None = None) -> Pieces:
    """The broadcast form of a vocabulary of at most MOST_PIECES pieces, with its merges (ids) if it has some."""
    rows = vocabulary.limit(MOST_PIECES + 1).collect()
    if len(rows) > MOST_PIECES:
        raise ValueError(f"more than {MOST_PIECES} pieces")
    bytes_of = {r["id"]: bytes(r["bytes"]) for r in rows}
    byte_ids, best = {}, {}
    for r in sorted(rows, key=lambda r: r["id"]):
        data = bytes_of[r["id"]]
        if r["emittable"] and len(data) == 1:
            byte_ids.setdefault(data[0], r["id"])
        elif r["emittable"] and data:
            # the best score, then the lowest id
            score = r["score"] if r["score"] is not None else 0.0
            if data not in best or score > best[data][0]:
                best[data] = (score, r["id"])
    pairs = {(r["left"], r["right"]): (r["rank"], r["merged"]) for r in merges.collect()} if merges is not None else {}
    return Pieces(bytes_of, byte_ids, pairs, {k: v for k, (_, v) in best.items()}, sorted({len(k) for k in best}, reverse=True))


def _map_ids(rows: DataFrame, id_cols: list[str], text_col: str, shared, how: Callable[[Pieces, bytes], list[int]]) -> DataFrame:  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [how(shared.value, t.as_py() or b"") for t in batch.column(len(id_cols))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(id_cols)], pa.array(ids, pa.list_(pa.int32()))], [*id_cols, "tokens"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in id_cols)
    return rows.select(*id_cols, F.col(text_col).cast("string").cast("binary").alias("data")).mapInArrow(run, f"{kinds}, tokens array<int>")


def tokenize_by_merges(rows: DataFrame, vocabulary: DataFrame, merges: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """id_cols and tokens: whole texts, no pre-tokens and no special ones; null is empty. One pass over the scan."""
    shared = rows.sparkSession.sparkContext.broadcast(collect_pieces(vocabulary, merge_table(vocabulary, merges)))
    return _map_ids(rows, id_cols, text_col, shared, Pieces.by_merges)


def tokenize_by_longest(rows: DataFrame, vocabulary: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """id_cols and tokens: greedy longest pieces, bytes where none fits; null is empty. One pass over the scan."""
    shared = rows.sparkSession.sparkContext.broadcast(collect_pieces(vocabulary))
    return _map_ids(rows, id_cols, text_col, shared, Pieces.by_longest)


def detokenize(tokens: DataFrame, vocabulary: DataFrame, id_cols: list[str]) -> DataFrame:
    """id_cols and data: the bytes of the tokens in order, by a join with the vocabulary; unknown ids raise, a row without tokens has none."""
    numbered = tokens.select(*id_cols, "tokens", F.monotonically_increasing_id().alias("_row"))
    each = numbered.select(*id_cols, "_row", F.posexplode_outer("tokens").alias("_pos", "id"))
    joined = each.join(F.broadcast(vocabulary.select("id", F.hex("bytes").alias("_hex"))), "id", "left")
    known = F.when(F.col("id").isNull(), F.lit("")).when(F.col("_hex").isNull(), F.raise_error(F.concat(F.lit("token "), F.col("id").cast("string")))).otherwise(F.col("_hex"))
    parts = joined.groupBy("_row", *id_cols).agg(F.array_sort(F.collect_list(F.struct("_pos", known.alias("h")))).alias("p"))
    return parts.select(*id_cols, F.unhex(F.array_join(F.transform("p", lambda x: x["h"]), "")).alias("data"))
