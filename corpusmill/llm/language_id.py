"""Language identification by interpolated Kneser-Ney character models.

One model per language, up to ORDER characters. All models share one sorted array of gram
hashes per order, with a row of log probabilities (one per language) for each gram and a row
of back-off weights for each context, so that one binary search serves every language. A
text goes to the language with the lowest cross-entropy per character; it is rejected if
that is beyond what the language's calibration texts of its length reach.

Letters count in lower case; runs of anything else count as one space. Null texts and texts
without a letter are `und` with score 0 and are rejected. Repeated rows give repeated rows.
With no labelled text at all every row is `und`. Empty tables are fine. Extra columns are
ignored.

More than MOST_LANGUAGES languages are scored in groups of that many, one pass over the
documents after another; each pass carries the best language so far and the sum that the
score needs. More than REFUSED distinct labels are taken for a mistake and raise.

Fitting takes about SAMPLE_DOCS labelled rows per language, chosen by a hash of the id, and
of a longer text than SAMPLE_CHARS a piece of that length; every row is scored over its
whole text.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.scratch import discard, materialize
from corpusmill.llm.wordhash import mix

ORDER = 4
#: Labelled rows per language that fitting expects to take, one in CALIBRATION of them to calibrate on.
SAMPLE_DOCS = 600
CALIBRATION = 5
#: Of longer texts a piece is fitted on, at a place chosen by a hash of the id.
SAMPLE_CHARS = 20_000
#: A text is rejected beyond the mean cross-entropy by so many deviations.
REJECT_AT = 6.0
#: ... and never within so many nats: mixed languages, tables and short texts stay.
REJECT_LEAST = 1.2
MOST_LANGUAGES = 256
REFUSED = 1 << 16
UNDETERMINED = "und"
_PIECE = 1 << 18
_SPACE = 32


def id_crc(col: str) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)])
    return _LETTERS


def characters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(16-bit codes with ORDER - 1 spaces before each text, first scored place of each, places each).

    A text becomes its lower-cased letters, with one space between runs, one before and one
    after. A letter beyond the basic plane is folded into 16 bits.
    """
    low = [(t or "").lower() for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in low])]).astype(np.int64)
    letter = _letters()[codes]
    first = np.zeros(len(codes) + 1, bool)
    first[offsets] = True
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of others; runs at a text's begin go, its closing space is added
    keep[first[:-1] & ~letter] = False
    n = np.add.reduceat(np.append(keep, False), offsets[:-1]) * (np.diff(offsets) > 0) if len(texts) else np.zeros(0, np.int64)
    ends = np.zeros(len(texts), bool)
    some = np.flatnonzero(np.diff(offsets))
    ends[some] = letter[offsets[some + 1] - 1]
    scored = n + ends
    at = np.cumsum(scored + ORDER - 1) - scored
    out = np.full(int(scored.sum()) + (ORDER - 1) * len(texts), _SPACE, np.uint64)
    kept = np.flatnonzero(keep)
    place = np.repeat(at, n) + np.arange(len(kept)) - np.repeat(np.cumsum(n) - n, n)
    code = np.where(letter[kept], codes[kept], _SPACE).astype(np.uint64)
    out[place] = (code ^ (code >> np.uint64(16))) & np.uint64(0xFFFF)
    return out, at, scored


def grams(codes: np.ndarray, places: np.ndarray, order: int) -> np.ndarray:
    """The order characters that end at each place, packed into 64 bits."""
    out = codes[places].copy()
    for back in range(1, order):
        out |= codes[places - back] << np.uint64(16 * back)
    return out


def _scored_places(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.repeat(at - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


@dataclass
class Models:
    """Sorted hashes and rows by order; context[k] belongs to contexts of k characters."""

    languages: list[str]
    gram: list[np.ndarray]
    logp: list[np.ndarray]
    context: list[np.ndarray]
    backoff: list[np.ndarray]
    unseen: np.ndarray
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    noise: np.ndarray | None = None
    sharpness: float = 1.0

    def log_probabilities(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        """A row of log probabilities for each packed gram of ORDER characters (here: their last `order`)."""
        if not order:
            return np.broadcast_to(self.unseen, (len(keys), len(self.languages)))
        low = keys & np.uint64((1 << 16 * order) - 1)
        at, found = _find(self.gram[order], mix(low))
        out = np.empty((len(keys), len(self.languages)), np.float32)
        out[found] = self.logp[order][at[found]]
        miss = np.flatnonzero(~found)
        if len(miss):
            rest = self.log_probabilities(keys[miss], order - 1)
            if order > 1:
                at, found = _find(self.context[order - 1], mix(low[miss] >> np.uint64(16)))
                rest = rest + np.where(found[:, None], self.backoff[order - 1][np.where(found, at, 0)], np.float32(0))
            out[miss] = rest
        return out

    def cross_entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(nats per character of each text by language, scored characters); texts without a letter have none."""
        n = np.zeros(len(texts), np.int64)
        sums = np.zeros((len(texts), len(self.languages)))
        i = 0
        while i < len(texts):
            j, size = i + 1, len(texts[i] or "")
            while j < len(texts) and size + len(texts[j] or "") <= _PIECE:
                size += len(texts[j] or "")
                j += 1
            codes, at, n[i:j] = characters(texts[i:j])
            places = _scored_places(at, n[i:j])
            of = np.repeat(np.arange(i, j), n[i:j])
            for a in range(0, len(places), _PIECE):  # a long text goes piece by piece, with its true contexts
                own = of[a : a + _PIECE]
                logs = self.log_probabilities(grams(codes, places[a : a + _PIECE], ORDER))
                begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                np.add.at(sums, own[begin], np.add.reduceat(logs.astype(np.float64), begin, axis=0))
            i = j
        return -sums / np.maximum(n, 1)[:, None], n

    def compare(self, texts: list[str | None]) -> Standing:
        """Where these languages stand for each text."""
        n = len(texts)
        if not self.languages:
            return Standing(n=np.zeros(n, np.int64), best=np.full(n, None, object), least=np.full(n, np.inf), limit=np.full(n, -np.inf), total=np.zeros(n))
        entropies, size = self.cross_entropies(texts)
        best = entropies.argmin(axis=1)
        least = entropies.min(axis=1)
        total = np.exp(-(entropies - least[:, None]) * (np.sqrt(size) * self.sharpness)[:, None]).sum(axis=1)
        limit = self.mean[best] + np.maximum(REJECT_LEAST, REJECT_AT * np.sqrt(self.spread[best] ** 2 + self.noise[best] ** 2 / np.maximum(size, 1)))
        return Standing(size, np.array(self.languages, object)[best], least, limit, total)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, score from 0 to 1, cross-entropy, rejected) of each text."""
        return self.compare(texts).verdicts()


@dataclass
class Standing:
    """Of each text: scored characters, best language so far, its cross-entropy and the limit of rejection, and the sum of all languages' weights over the best one's."""

    n: np.ndarray
    best: np.ndarray
    least: np.ndarray
    limit: np.ndarray
    total: np.ndarray

    def joined(self, other: Standing, sharpness: float) -> Standing:
        """With the languages of another group; the earlier one keeps a tie."""
        new = other.least < self.least
        least = np.minimum(self.least, other.least)
        by = np.sqrt(self.n) * sharpness
        fade = lambda x: np.where(np.isfinite(x.least), x.total * np.exp(-(np.where(np.isfinite(x.least), x.least, 0) - np.where(np.isfinite(least), least, 0)) * by), 0.0)
        return Standing(np.maximum(self.n, other.n), np.where(new, other.best, self.best), least, np.where(new, other.limit, self.limit), fade(self) + fade(other))

    def verdicts(self) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        some = (self.n > 0) & np.isfinite(self.least)
        score = np.divide(1.0, self.total, out=np.zeros(len(self.n)), where=some & (self.total > 0))
        return [b if k else UNDETERMINED for b, k in zip(self.best, some, strict=True)], score, np.where(some, self.least, 0.0), ~some | (self.least > self.limit)


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return at, table[at] == keys


def _discount(counts: np.ndarray) -> float:
    ones, twos = int((counts == 1).sum()), int((counts == 2).sum())
    return ones / (ones + 2 * twos) if ones and twos else 0.5


def fit_models(counts: dict[str, tuple[np.ndarray, np.ndarray]], alphabet: int | None = None) -> Models:
    """Models from each language's (packed grams of ORDER characters, counts); alphabet: characters known in all groups and one more."""
    languages = sorted(counts)
    own: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(ORDER + 1)]
    for name in languages:
        keys, n = counts[name]
        order = np.argsort(keys)
        own[ORDER].append((keys[order], n[order].astype(np.float64)))
        for k in range(ORDER - 1, 0, -1):  # lower orders count the distinct characters before
            own[k].append(np.unique(own[k + 1][-1][0] & np.uint64((1 << 16 * k) - 1), return_counts=True))
    union = [np.zeros(0, np.uint64)] + [np.unique(np.concatenate([x[0] for x in own[k]])) for k in range(1, ORDER + 1)]
    alphabet = alphabet or len(union[1]) + 1
    unseen = np.zeros(len(languages), np.float32)
    probability = [np.zeros((len(u), len(languages))) for u in union]
    gram, logp, context, backoff = [np.zeros(0, np.uint64)], [np.zeros((0, 0), np.float32)], [], []
    for k in range(1, ORDER + 1):
        heads = np.unique(union[k] >> np.uint64(16)) if k > 1 else np.zeros(1, np.uint64)
        weights = np.zeros((len(heads), len(languages)), np.float32)
        for i in range(len(languages)):
            keys, n = own[k][i][0], own[k][i][1].astype(np.float64)
            d = _discount(n)
            at, found = _find(keys, union[k])
            taken = np.where(found, np.maximum(n[at] - d, 0), 0.0)
            head = keys >> np.uint64(16) if k > 1 else np.zeros(len(keys), np.uint64)
            names, first = np.unique(head, return_index=True)
            totals, kinds = np.add.reduceat(n, first), np.diff(np.append(first, len(keys)))
            where, seen = _find(names, union[k] >> np.uint64(16) if k > 1 else np.zeros(len(union[k]), np.uint64))
            lower = probability[k - 1][np.searchsorted(union[k - 1], union[k] & np.uint64((1 << 16 * (k - 1)) - 1)), i] if k > 1 else 1 / alphabet
            probability[k][:, i] = np.where(seen, taken / totals[where] + d * kinds[where] / totals[where] * lower, lower)
            where, seen = _find(names, heads)
            weights[:, i] = np.where(seen, np.log(d * kinds[where] / totals[where]), 0.0)
            if k == 1:
                unseen[i] = math.log(d * kinds[0] / totals[0] / alphabet)
        for table, values, keys, rows in ((gram, logp, union[k], np.log(probability[k])), (context, backoff, heads, weights)):
            hashed = mix(keys)
            order = np.argsort(hashed)
            table.append(hashed[order])
            values.append(rows[order].astype(np.float32))
    return Models(languages, gram, logp, context, backoff, unseen)


def calibrate(models: Models, rows: list[tuple[str, str]]) -> Models:
    """Mean and deviations of the cross-entropies of labelled texts that were not fitted on.

    A language without such texts gets the values of all. The sharpness is the one, of a
    few, that makes the scores of these texts most probable.
    """
    entropies, n = models.cross_entropies([t for _, t in rows])
    truth = np.array([models.languages.index(k) for k, _ in rows], np.int64)
    own = entropies[np.arange(len(rows)), truth] if len(rows) else np.zeros(0)
    use = n >= 20
    count = len(models.languages)
    models.mean, models.spread, models.noise = np.full(count, np.inf), np.full(count, 0.0), np.full(count, 0.0)
    for k in range(count):
        mine = use & (truth == k)
        mine = mine if mine.sum() >= 10 else use
        if mine.sum() >= 10:
            models.mean[k] = own[mine].mean()
            models.spread[k] = own[mine].std()
            # by characters, from the texts of less than typical length; at least the deviation of one character
            models.noise[k] = max(3.0, float(np.sqrt(np.mean((own[mine] - own[mine].mean()) ** 2 * n[mine]))))
    if use.any():
        lead = (entropies - entropies.min(axis=1, keepdims=True))[use]
        loss = lambda s: -np.log(np.maximum(1e-9, np.exp(-lead * np.sqrt(n[use])[:, None] * s)[np.arange(int(use.sum())), truth[use]] / np.exp(-lead * np.sqrt(n[use])[:, None] * s).sum(axis=1))).mean()
        models.sharpness = min((0.25, 0.5, 1.0, 2.0, 4.0), key=loss)
    return models


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for lang in sorted({*langs}):
            codes, at, n = characters([t for k, t in zip(langs, batch.column(1).to_pylist(), strict=True) if k == lang])
            keys, counts = np.unique(grams(codes, _scored_places(at, n), ORDER), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts, pa.int64())], ["lang", "gram", "n"])


def train(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out_of: int | None = 5) -> list[Models]:
    """Fit and calibrate on rows with a language, in groups of languages; with held_out_of = m, rows whose id checksum is 0 modulo m stay out."""
    spark = documents.sparkSession
    rows = documents.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id")).filter("lang is not null and text is not null")
    if held_out_of:
        rows = rows.filter(id_crc("id") % held_out_of != 0)
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(REFUSED + 1).collect()}
    if len(sizes) > REFUSED:
        raise ValueError(f"more than {REFUSED} languages")
    if not sizes:
        return []
    spare = F.length("text") - SAMPLE_CHARS
    piece = F.when(spare > 0, F.substring("text", F.pmod(F.xxhash64("id", F.lit(41)), spare + 1).cast("int") + 1, F.lit(SAMPLE_CHARS))).otherwise(F.col("text"))
    dice = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1_000_000))
    # a language with few rows is also fitted on those that it is calibrated on
    shares = [(k, math.ceil(1_000_000 * min(1.0, SAMPLE_DOCS / n)), n >= 50) for k, n in sorted(sizes.items())]
    cuts = F.broadcast(spark.createDataFrame(shares, "lang string, cut int, enough boolean"))
    aside = F.pmod(F.xxhash64("id", F.lit(23)), F.lit(CALIBRATION)) == 0
    sample = materialize(rows.join(cuts, "lang").filter(dice < F.col("cut")).select("lang", piece.alias("text"), aside.alias("aside"), "enough"), "languages")
    counted = materialize(sample.filter("not (aside and enough)").select("lang", "text").mapInArrow(_count_grams, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    known = [r["lang"] for r in counted.select("lang").distinct().orderBy("lang").collect()]
    alphabet = counted.select(F.col("gram").bitwiseAND(0xFFFF)).distinct().count() + 1
    out = []
    for i in range(0, len(known), MOST_LANGUAGES):
        mine = known[i : i + MOST_LANGUAGES]
        between = F.col("lang").between(mine[0], mine[-1])
        got = counted.filter(between).toArrow()
        langs = np.array(got.column("lang").to_pylist(), object)
        keys, n = got.column("gram").to_numpy().view(np.uint64), got.column("n").to_numpy()
        counts = {k: (keys[langs == k], n[langs == k]) for k in mine}
        out.append(calibrate(fit_models(counts, alphabet), [(r["lang"], r["text"]) for r in sample.filter(between).filter("aside").select("lang", "text").collect() if r["lang"] in counts]))
    discard(sample)
    discard(counted)
    return out


def _standings(documents: DataFrame, first: Column, kind: str, text_col: str, models: list[Models]) -> DataFrame:
    """first, lang_pred, score, cross_entropy, rejected; a pass over the documents for each group of languages."""
    context = documents.sparkSession.sparkContext
    groups = models or [Models([], [], [], [], [], np.zeros(0))]
    sharpness = float(np.median([g.sharpness for g in groups]))
    for g in groups:
        g.sharpness = sharpness
    carried = ["n", "best", "least", "limit", "total"]
    rows = documents.select(first.alias("first"), F.col(text_col).cast("string").alias("text"))

    def step(rows: DataFrame, shared, begun: bool, last: bool) -> DataFrame:  # noqa: ANN001
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                now = shared.value.compare(batch.column(1).to_pylist())
                if begun:
                    before = Standing(*(np.array(batch.column(2 + i).to_pylist(), object if i == 1 else None) for i in range(5)))
                    now = before.joined(now, sharpness)
                if last:
                    langs, score, entropy, rejected = now.verdicts()
                    values = [pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(entropy, pa.float64()), pa.array(rejected)]
                    yield pa.RecordBatch.from_arrays([batch.column(0), *values], ["first", "lang_pred", "score", "cross_entropy", "rejected"])
                else:
                    values = [pa.array(now.n, pa.int64()), pa.array(now.best, pa.string()), *(pa.array(v, pa.float64()) for v in (now.least, now.limit, now.total))]
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *values], ["first", "text", *carried])

        out = "lang_pred string, score double, cross_entropy double, rejected boolean" if last else "text string, n bigint, best string, least double, limit double, total double"
        return rows.mapInArrow(run, f"first {kind}, {out}")

    for k, group in enumerate(groups):
        last = k == len(groups) - 1
        rows = step(rows, context.broadcast(group), k > 0, last)
        if not last:
            rows = materialize(rows, "standings")
    return rows


def identify(documents: DataFrame, models: list[Models], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy (nats per character), rejected."""
    return _standings(documents, F.col(id_col), documents.schema[id_col].dataType.simpleString(), text_col, models).withColumnRenamed("first", id_col)


def drop_rejected(documents: DataFrame, models: list[Models], text_col: str = "text") -> DataFrame:
    """The documents, all their columns, whose text is in a learned language. No shuffle."""
    kind = documents.schema.simpleString()
    return _standings(documents, F.struct("*"), kind, text_col, models).filter("not rejected").select("first.*")
