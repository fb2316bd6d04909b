import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import language_id, toxicity
from corpusmill.llm.wordhash import ALNUM, NONSPACE, text_bytes, words

DATA = "/root/testdata/sf0.01"


def held_out(i, m=5):
    return zlib.crc32(("" if i is None else str(i)).encode()) % m == 0


def test_word_hashes_do_not_depend_on_place_or_batch():
    texts = ["The cat", None, "", "the  CAT\tthe", "é-é ñ", "x" * 300000 + " the"]
    _, starts, ends, bounds, h = words(*text_bytes(pa.array(texts)), ALNUM)
    assert bounds.tolist() == [0, 2, 2, 2, 5, 8, 10]
    assert h[0] == h[2] == h[4] == h[9] and h[1] == h[3] and h[5] == h[6] and len({*h.tolist()}) == 5
    sliced = pa.array(["skip this", *texts]).slice(1)
    assert (words(*text_bytes(sliced), ALNUM)[4] == h).all()
    assert words(*text_bytes(pa.array(["a,b c"])), NONSPACE)[3].tolist() == [0, 2]
    assert len(words(*text_bytes(pa.array([], pa.string())), ALNUM)[4]) == 0


def test_characters_of_texts():
    codes, at, n = language_id.characters(["Ab,  c!", None, "12", "é", "a b"])
    said = ["".join(map(chr, codes[a : a + k])) for a, k in zip(at, n, strict=True)]
    assert said == ["ab c ", "", "", "é ", "a b "]


def test_kneser_ney_sums_to_one_and_equals_a_plain_version():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc d") for _ in range(200)) for _ in range(5)]
    codes, at, n = language_id.characters(texts)
    places = language_id._scored_places(at, n)
    keys, counts = np.unique(language_id.grams(codes, places, 4), return_counts=True)
    models = language_id.fit_models({"x": (keys, counts)})
    tables = [None, {}, {}, {}, {}]
    for k, c in zip(keys.tolist(), counts.tolist(), strict=True):
        tables[4][tuple(k >> 16 * i & 0xFFFF for i in (3, 2, 1, 0))] = c
    for order in (3, 2, 1):
        for g in tables[order + 1]:
            tables[order][g[1:]] = tables[order].get(g[1:], 0) + 1

    def p(gram):
        if not gram:
            return 1 / (len(tables[1]) + 1)
        t = tables[len(gram)]
        ones, twos = sum(c == 1 for c in t.values()), sum(c == 2 for c in t.values())
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        own = {g: c for g, c in t.items() if g[:-1] == gram[:-1]}
        if not own:
            return p(gram[1:])
        total = sum(own.values())
        return max(own.get(gram, 0) - d, 0) / total + d * len(own) / total * p(gram[1:])

    alphabet = [*sorted({g[0] for g in tables[1]}), ord("z")]
    for head in [(97, 98, 99), (32, 32, 32), (97, 32, 100), (122, 97, 98), (122, 122, 122)]:
        grams = [(*head, c) for c in alphabet]
        packed = np.array([sum(c << 16 * (3 - i) for i, c in enumerate(g)) for g in grams], np.uint64)
        got = np.exp(models.log_probabilities(packed)[:, 0])
        assert got == pytest.approx([p(g) for g in grams], rel=1e-4)
        assert got.sum() == pytest.approx(1, abs=1e-4)


def plain_models(texts_by_language):
    """Interpolated Kneser-Ney by dictionaries: language -> probability of a gram (its last character after the others)."""
    tables = {}
    for k, texts in texts_by_language.items():
        t = [None, {}, {}, {}, {}]
        for text in texts:
            said = "   " + re.sub("[^a-zé]+", " ", text.lower()).strip() + " "
            for i in range(3, len(said)):
                t[4][said[i - 3 : i + 1]] = t[4].get(said[i - 3 : i + 1], 0) + 1
        for order in (3, 2, 1):
            for g in t[order + 1]:
                t[order][g[1:]] = t[order].get(g[1:], 0) + 1
        tables[k] = t
    alphabet = len({c for t in tables.values() for c in t[1]}) + 1

    def probability(k, gram):
        if not gram:
            return 1 / alphabet
        t = tables[k][len(gram)]
        ones, twos = sum(c == 1 for c in t.values()), sum(c == 2 for c in t.values())
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        own = {g: c for g, c in t.items() if g[:-1] == gram[:-1]}
        if not own:
            return probability(k, gram[1:])
        return max(own.get(gram, 0) - d, 0) / sum(own.values()) + d * len(own) / sum(own.values()) * probability(k, gram[1:])

    return probability


def test_three_languages_with_rejection_against_a_plain_version():
    rng = random.Random(6)
    letters = {"x": "abcde fé", "y": "cdefgh a", "z": "hijk lm "}
    say = lambda k, n: "".join(rng.choices(letters[k], range(1, 9), k=n)) + "q"
    texts = {k: [say(k, 120) for _ in range(3)] for k in letters}
    counts = {}
    for k, own in texts.items():
        codes, at, n = language_id.characters(own)
        counts[k] = np.unique(language_id.grams(codes, language_id._scored_places(at, n), 4), return_counts=True)
    models = language_id.calibrate(language_id.fit_models(counts), [(k, say(k, m)) for k in letters for m in (30, 60, 90) * 4])
    p = plain_models(texts)
    odd = ["abc, DÉF hij", "klm hh", "aaa", "w w w uuu rrr sss ttt vvv ooo" * 4, "", None, "12"]
    langs, score, entropy, rejected = models.predict(odd)
    for i, text in enumerate(odd):
        said = re.sub("[^a-zé]+", " ", (text or "").lower()).strip()
        if not re.search("[a-z]", said):
            assert (langs[i], score[i], entropy[i], rejected[i]) == ("und", 0, 0, True)
            continue
        said = "   " + said + " "
        n = len(said) - 3
        e = {k: -sum(math.log(p(k, said[j - 3 : j + 1])) for j in range(3, len(said))) / n for k in letters}
        best = min(e, key=e.get)
        k = models.languages.index(best)
        weights = [math.exp(-(v - e[best]) * math.sqrt(n) * models.sharpness) for v in e.values()]
        limit = models.mean[k] + max(1.2, 6 * math.sqrt(models.spread[k] ** 2 + models.noise[k] ** 2 / n))
        assert langs[i] == best and entropy[i] == pytest.approx(e[best], rel=1e-4) and score[i] == pytest.approx(1 / sum(weights), rel=1e-3)
        assert rejected[i] == (e[best] > limit)
    assert rejected[3]


def test_languages_in_groups(spark, monkeypatch):
    """Three languages in groups of two give the results of one group, but for the groups' own sharpness."""
    rng = random.Random(3)
    letters = {"x": "abcde f", "y": "cdefgh ", "z": "hijk lm"}
    rows = [(i, "".join(rng.choices(letters[k], k=80)), k) for i, k in enumerate(["x", "y", "z"] * 40)] + [(900, None, "x"), (901, "", "q"), (902, "..", None)]
    df = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, lang string").withColumn("first", F.lit(1)).withColumn("score", F.lit(2.0))
    whole = language_id.train(df)
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 2)
    parts = language_id.train(df)
    assert [m.languages for m in whole] == [["x", "y", "z"]] and [m.languages for m in parts] == [["x", "y"], ["z"]]
    for m in [*whole, *parts]:
        m.sharpness = 1.0
    a = sorted(map(tuple, language_id.identify(df, whole).collect()))
    b = sorted(map(tuple, language_id.identify(df, parts).collect()))
    assert len(a) == len(b) == 124 and [r[:2] for r in a] == [r[:2] for r in b]
    assert [r[2] for r in a] == pytest.approx([r[2] for r in b], abs=1e-6)
    kept = language_id.drop_rejected(df, parts)
    assert kept.columns == df.columns and kept.count() == 121
    monkeypatch.setattr(language_id, "REFUSED", 2)
    with pytest.raises(ValueError):
        language_id.train(df)


def test_language_accuracy_and_edges(spark):
    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    models = language_id.train(documents)
    rows = {r["doc_id"]: r for r in language_id.identify(documents, models).collect()}
    truth = {r["doc_id"]: r["lang"] for r in documents.select("doc_id", "lang").collect()}
    mine = [i for i in rows if held_out(i)]
    assert sum(rows[i]["lang_pred"] == truth[i] for i in mine) >= 0.97 * len(mine)
    assert sum(r["rejected"] for r in rows.values()) <= 3 and all(0 <= r["score"] <= 1 for r in rows.values())
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !! 34"), (4, "the of and " * 30000), (5, "q7xz kvwq jjxq zzkq " * 40), (None, "the and of with")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language_id.identify(odd, models).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and all(got[i]["rejected"] and got[i]["score"] == 0 for i in (1, 2, 3))
    assert (got[4]["lang_pred"], got[4]["rejected"], got[None]["lang_pred"], got[5]["rejected"]) == ("en", False, "en", True)
    assert sorted(r["doc_id"] or 0 for r in language_id.drop_rejected(odd, models).collect()) == [0, 4]
    assert language_id.identify(odd.limit(0), models).count() == 0


def test_language_without_labels(spark):
    df = spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, lang string")
    r = language_id.identify(df, language_id.train(df)).first()
    assert r["lang_pred"] == "und" and r["rejected"] and r["score"] == 0


def toxic_corpus(n=600):
    rng = random.Random(11)
    bad = ["idiot", "scum", "loser", "trash"]
    rows, labels = [], []
    for i in range(n):
        w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(3, 120))]
        toxic = rng.random() < 0.2
        for _ in range(rng.randint(1, 3) * toxic):
            w.insert(rng.randint(0, len(w)), rng.choice(bad))
        rows.append((i, " ".join(w), rng.choice(["en", "de", None])))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_learns_words_and_ignores_length(spark):
    rows, labels = toxic_corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = toxicity.train(df, spark.createDataFrame([*labels, (5, None), (None, 1), labels[7]], "doc_id long, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.score(df, net).collect()}
    mine = [(i, y) for i, y in labels if held_out(i)]
    assert sum(got[i]["predicted"] == y for i, y in mine) >= 0.93 * len(mine)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    clean = " ".join(rows[i][1] for i, y in labels[:300] if not y)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, clean + " you idiot scum loser " + clean), (4, "IDIOT, trash!")], "doc_id long, text string")
    s = {r["doc_id"]: r for r in toxicity.score(odd, net).collect()}
    assert s[1]["score"] == s[2]["score"] and s[3]["predicted"] == s[4]["predicted"] == 1 and s[1]["predicted"] == 0
    assert sorted(r["doc_id"] for r in toxicity.drop_toxic(odd, net).collect()) == [1, 2]


def test_toxicity_without_both_classes(spark):
    df = spark.createDataFrame([(1, "a", "en"), (2, None, None)], "doc_id long, text string, lang string")
    for labels in ([], [(1, 1)], [(1, 0)]):
        net = toxicity.train(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert all(r["predicted"] == 0 and 0 <= r["score"] < 0.5 for r in toxicity.score(df, net).collect())


@pytest.mark.parametrize("sharpness", [1.5, 16.0, None])
def test_gradients_against_differences(sharpness):
    net = toxicity.new_network(5)
    rng = np.random.default_rng(1)
    for name in ("tables", "out", "out_bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    net.filters = {w: f.astype(np.float64) for w, f in net.filters.items()}
    net.bias = {w: rng.normal(0.1, 0.1, len(b)) for w, b in net.bias.items()}
    rows = toxicity.buckets(rng.integers(0, 2**63, 30).astype(np.uint64))
    bounds = np.array([0, 1, 1, 12, 30])
    y, weight = np.array([1, 0, 1, 0]), np.array([0.7, 1.1, 0.7, 1.1])
    loss = lambda: toxicity.gradients(net, rows, bounds, y, weight, sharpness).loss
    g = toxicity.gradients(net, rows, bounds, y, weight, sharpness)

    def slope(array, at, eps=1e-6):
        array[at] += eps
        up = loss()
        array[at] -= 2 * eps
        down = loss()
        array[at] += eps
        return (up - down) / (2 * eps)

    for w in toxicity.FILTERS:
        for at in zip(rng.integers(0, w * toxicity.WIDTH, 6), rng.integers(0, toxicity.FILTERS[w], 6), strict=True):
            assert g.filters[w][at] == pytest.approx(slope(net.filters[w], at), abs=1e-7)
        assert g.bias[w][2] == pytest.approx(slope(net.bias[w], 2), abs=1e-7)
    for k in range(6):
        assert g.out[5 * k] == pytest.approx(slope(net.out, 5 * k), abs=1e-7)
    assert g.out_bias[0] == pytest.approx(slope(net.out_bias, 0), abs=1e-7)
    for k in (0, 3, 11, 12, 29):
        assert g.words[k, 4] == pytest.approx(slope(net.tables, (0, rows[0][k], 4)), abs=1e-7)


def area(z, y):
    """The share of (toxic, other) pairs in the right order."""
    order = np.argsort(z, kind="stable")
    rank = np.empty(len(z))
    rank[order] = np.arange(len(z))
    return (rank[y == 1].mean() - ((y == 1).sum() - 1) / 2) / (y == 0).sum()


def test_held_out_area_comes_from_training(spark):
    """On the sf0.1 tables, of rows that were not learned from; without an epoch the network knows nothing."""
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect() if held_out(r["doc_id"])}
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect() if r["doc_id"] in truth]
    y = np.array([truth[i] for i, _ in rows])
    column = text_bytes(pa.array([t for _, t in rows], pa.string()))
    assert area(toxicity.score_bytes(toxicity.train(documents, labels), *column), y) >= 0.965
    _, _, _, bounds, hashes = words(*column, ALNUM)
    assert area(toxicity.logits(toxicity.new_network(), hashes, bounds), y) < 0.65


def test_thresholds_against_a_plain_version():
    rng = np.random.default_rng(4)
    for k in range(50):
        n, m, prior = int(rng.integers(2, 40)), int(rng.integers(2, 60)), (0, 30)[k % 2]
        z, y, all_z, all_y = np.round(rng.normal(0, 2, n), 1), rng.integers(0, 2, n), np.round(rng.normal(0, 2, m), 1), rng.integers(0, 2, m)
        t = toxicity._best_threshold(z, y, all_z, all_y, prior)
        errors = lambda cut: ((z >= cut) != (y == 1)).sum() + prior / m * ((all_z >= cut) != (all_y == 1)).sum()
        assert errors(t) == pytest.approx(min(errors(c) for v in (z, all_z) for c in [*v, *(v + 0.05), v.min() - 1, v.max() + 1]))


def test_toxicity_repeats_empties_and_clashing_names(spark):
    rows, labels = toxic_corpus(200)
    df = spark.createDataFrame([*rows, *rows[:20]], "doc_id long, text string, lang string").withColumn("toxic", F.lit(9)).withColumn("words", F.lit(1)).withColumn("score", F.lit(0.5))
    marks = spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("text", F.lit("idiot")).withColumn("long", F.lit(True))
    net = toxicity.train(df, marks)
    out = toxicity.score(df, net).collect()
    assert len(out) == 220 and len({(r["doc_id"], round(r["score"], 3)) for r in out}) <= 202
    kept = toxicity.drop_toxic(df, net)
    assert kept.columns == df.columns and 0 < kept.count() < 220
    assert toxicity.score(df.limit(0), net).count() == 0
    assert toxicity.train(df.limit(0), marks).constant == 0 and toxicity.train(df, marks.limit(0)).constant == 0
    assert toxicity.score_bytes(net, *text_bytes(pa.array(["word " * 400_000 + "idiot trash scum"])))[0] >= 0.5


def test_texts_without_labels_do_not_meet_the_labels(spark, monkeypatch):
    """Of the documents, those with a label go on to the join, and few others; with few cells more do, and none is lost."""
    df = spark.range(20_000).select(F.col("id").alias("lid"), F.lit("t").alias("text"))
    marked = spark.range(0, 20_000, 10).select(F.col("id").alias("lid"))
    for bits, most in ((26, 2100), (8, 20_000)):
        monkeypatch.setattr(toxicity, "ID_BITS", bits)
        got = toxicity._labelled_only(df, marked)
        assert got.schema == df.schema and got.join(marked, "lid", "left_semi").count() == 2000 and got.count() <= most
    assert toxicity._labelled_only(df, marked.limit(0)).count() == 0
    assert toxicity._labelled_only(df, marked.select(F.col("lid").cast("int").alias("lid"))).join(marked, "lid", "left_semi").count() == 2000


def test_scores_equal_sliding_windows():
    """The network's scores by sliding windows one by one."""
    net = toxicity.new_network(3)
    rng = np.random.default_rng(0)
    hashes = rng.integers(0, 2**63, 40).astype(np.uint64)
    bounds = np.array([0, 0, 1, 3, 40])
    got = toxicity.logits(net, hashes, bounds)
    for i in range(4):
        rows = toxicity.buckets(hashes[bounds[i] : bounds[i + 1]])
        x = net.tables[0][rows[0]] + net.tables[1][rows[1]]
        x = np.concatenate([x if len(x) else np.zeros((1, toxicity.WIDTH), np.float32), np.zeros((2, toxicity.WIDTH), np.float32)])
        feats = []
        for w in toxicity.FILTERS:
            y = np.array([x[k : k + w].reshape(-1) @ net.filters[w] for k in range(max(1, bounds[i + 1] - bounds[i]))])
            feats.append(np.maximum(y.max(axis=0) + net.bias[w], 0))
        assert got[i] == pytest.approx(np.concatenate(feats) @ net.out + net.out_bias[0], abs=1e-4)
