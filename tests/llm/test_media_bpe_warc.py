import base64
import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.llm import bpe, ogg_media, warc
from corpusmill.llm.scratch import materialize

P = pytest.importorskip("public_tokenizers")
TIKTOKEN = pytest.importorskip("tiktoken")
PATH = P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [None, "", " ", "a", "\x00\x1c\x85  x", "x" * 5000, "Größe y años, it's 123 4!\n\n  end", "ab" * 70000, "same", "same", "日本語 text 🙂🙂", "\r\n\t  a"]


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.PerfectHash(bpe.read_ranks(PATH)), P.PATTERN)


@pytest.fixture(scope="module")
def library():
    ranks = bpe.read_ranks(PATH)
    return TIKTOKEN.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"])))
def test_encoding_equals_the_library(codec, library, text):
    ids = codec.encode(text)
    assert ids == library.encode_ordinary(text)
    assert codec.decode(ids) == text.encode() and codec.shown(text) == ",".join(map(str, ids))


def test_separators_that_regex_libraries_disagree_on(codec, library):
    for c in range(0x250):
        for text in (f"a {chr(c)} b{chr(c)}{chr(c)}c", f"{chr(c)}{chr(c)} 1"):
            assert codec.encode(text) == library.encode_ordinary(text), hex(c)


def test_perfect_hash_is_minimal_and_rejects_others():
    table = {f"k{i}".encode(): i for i in range(5000)}
    h = bpe.PerfectHash(table)
    assert len(h.keys) == 5000 and None not in h.keys
    assert all(h.get(k) == v for k, v in table.items()) and h.get(b"other") is None
    assert bpe.PerfectHash({}).get(b"x") is None


def test_bpe_rows(spark, library):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens string")
    out = {r["doc_id"]: r for r in bpe.encode_documents(df, PATH, P.PATTERN, with_text=True).collect()}
    for i, t in enumerate(TEXTS):
        ids = library.encode_ordinary(t or "")
        assert out[i]["token_ids"] == ids and out[i]["n_tokens"] == len(ids) and out[i]["decoded"] == (t or "")
        assert out[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert out[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_documents(df.limit(0), PATH, P.PATTERN).count() == 0


def slow_crc(data: bytes) -> int:
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_ogg_round_trip_and_checksum(data):
    assert ogg_media.page_crc(data) == slow_crc(data)
    payload = ogg_media.pad(data)
    assert len(payload) % 192 == 0 and len(payload) >= 192
    back, _, streams, seconds = ogg_media.decode(ogg_media.encode(payload))
    assert back == payload and streams == 2 and abs(seconds - len(payload) / 2 / 8000) < 1e-9


def test_ogg_long_payload_and_damage():
    payload = random.Random(1).randbytes(192 * 5000)
    media = ogg_media.encode(payload)
    assert ogg_media.decode(media)[0] == payload
    for at in (30, 200, len(media) // 2, len(media) - 1):
        bad = bytearray(media)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            ogg_media.decode(bytes(bad))
    with pytest.raises(ValueError):
        ogg_media.decode(media[:-5])


def test_ogg_rows(spark):
    df = spark.createDataFrame([(i, t, b"x") for i, t in enumerate(TEXTS)], "doc_id long, text string, media binary")
    out = {r["doc_id"]: r for r in ogg_media.read_media(materialize(ogg_media.write_media(df)), with_payload=True).collect()}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        want = ogg_media.pad(raw)
        r = out[i]
        assert r["n_bytes"] == len(raw) and r["payload_bytes"] == len(want) and r["payload"] == want
        assert r["payload_sha256"] == hashlib.sha256(want).hexdigest() and r["tail_crc32"] == zlib.crc32(want[-16:])
    assert out[8]["media_sha256"] == out[9]["media_sha256"] and out[0]["feature"] == out[1]["feature"]
    assert ogg_media.write_media(df.limit(0)).count() == 0


def test_warc_rows(spark):
    rows = [(5, "http://a/", "<p>x</p>"), (3, None, "<p>x</p>"), (9, "http://b/ c", None), (2, "u", ""), (7, "u", "y" * 300000), (8, "u\r\nEvil: 1", "solo"), (None, "u", "<p>x</p>"), (8, "u", "solo")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, payload string")
    for least in (0, 4, 100):
        archives = materialize(warc.write_archives(warc.mark_revisits(df, least_bytes=least), warc.train_dictionary(df), archive_bytes=100))
        got = warc.read_archives(archives).collect()
        assert len(got) == len(rows)
        for r in got:
            html = next((h or "") for p, _, h in rows if p == r["page_id"])
            raw = html.encode()
            assert r["payload_bytes"] == len(raw) and r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
            same = [p for p, _, h in rows if (h or "") == html and p is not None]
            first = len(raw) < least or r["page_id"] == min(same)
            assert (r["record_type"], r["refers_to"]) == (("response", None) if first else ("revisit", min(same)))
    assert warc.read_archives(warc.write_archives(warc.mark_revisits(df.limit(0)), warc.train_dictionary(df.limit(0)))).count() == 0


def test_warc_damage(spark):
    dictionary = b"some plain content that is shared" * 4
    import zstandard as zstd

    press = zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(dictionary), write_checksum=True)
    records = [warc.record(i, "u", b"body" * i, None, True) for i in range(1, 6)]
    data = warc.archive_head(dictionary) + b"".join(map(press.compress, records))
    assert [*warc.read_archive(data)] == records
    with pytest.raises(ValueError):
        [*warc.read_archive(data[8:])]
    with pytest.raises(ValueError):
        warc.parse_record(records[2].replace(b"body", b"bodx", 1))
    with pytest.raises(ValueError):
        warc.parse_record(records[2][:-1])
