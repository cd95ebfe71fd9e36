import hashlib
import io
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tessera.llm import matroska, warc

PAGES = "page_id long, url string, html string, archive string"


def pages():
    rows = [(i, f"http://h{i % 3}.org/p q/{i}", random.Random(i % 20).randbytes(30).hex() * (1 + i % 50), "clash") for i in range(60)]
    return [*rows, (60, None, None, "x"), (61, "", "", "x"), (62, "bad\r\nurl", "WARC/1.1\r\n\r\nfake\r\n\r\n", "x"), (63, "u", "ü" * 200_000, "x"), (5, rows[5][1], rows[5][2], "again")]


def test_archives_round_trip(spark):
    data = pages()
    got = warc.archive_pages(spark.createDataFrame(data, PAGES).repartition(3)).collect()
    first = {}
    for p, _, h, _ in data:
        first[h or ""] = min(p, first.get(h or "", p))
    want = []
    for p, _, h, _ in data:
        raw, f = (h or "").encode(), first[h or ""]
        want.append((p, len(raw), warc.sha1_base32(raw), "response" if p == f else "revisit", None if p == f else f))
    assert sorted(map(repr, [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got])) == sorted(map(repr, want))


def test_members_inflate_alone_and_together():
    blocks = [warc.record_bytes(str(i), "http://x.org/", bytes([i]) * i * 1000) for i in range(5)]
    mono = zlib.compressobj(6, zlib.DEFLATED, 31)
    stream = mono.compress(b"".join(blocks)) + mono.flush()
    parsed = list(warc.records(warc.inflate(io.BytesIO(stream), 64)))
    assert [b for _, b in parsed] == [x.split(b"\r\n\r\n", 1)[1][:-4] for x in blocks]
    members = b"".join(warc.member(warc.as_response(f, b), 6) for f, b in parsed)
    assert list(warc.records(warc.inflate(io.BytesIO(members), 7))) == parsed


def test_cut_archives_are_refused():
    row = warc.record_bytes("1", "http://x.org/", b"payload")
    with pytest.raises(ValueError):
        list(warc.records([row[:-9]]))


def test_archives_empty(spark):
    assert warc.archive_pages(spark.createDataFrame([], PAGES)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=3000), st.integers(1, 9), st.sampled_from([matroska.XIPH_LACE, matroska.FIXED_LACE, matroska.EBML_LACE]))
def test_media_round_trip(text, lace, lacing):
    payload, n = matroska.padded(text)
    assert len(payload) % matroska.FRAME == 0 and len(payload) >= matroska.FRAME and payload[:n] == text.encode() and not payload[n:].strip()
    stored = matroska.mux(payload, lace, lacing)
    media = matroska.demux(stored)
    assert b"".join(stored[o : o + k] for _, _, o, k, _ in media.packets) == payload
    assert [p[1] for p in media.packets] == [i * matroska.FRAME_MS for i in range(len(media.packets))]
    assert len(media.cues) == len(media.clusters) and [c[2] for c in media.cues] == media.clusters


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=700), min_size=2, max_size=8), st.sampled_from([matroska.XIPH_LACE, matroska.EBML_LACE]))
def test_uneven_lacing(frames, lacing):
    body = b"\x81" + (5).to_bytes(2, "big") + bytes([0x80 | lacing << 1]) + matroska.laced(frames, lacing)
    unknown = b"\x01" + b"\xff" * 7
    stored = matroska._HEAD + matroska.ident(matroska.SEGMENT) + unknown + matroska._TRACKS + matroska.ident(matroska.CLUSTER) + unknown + matroska.number(matroska.TIMESTAMP, 100) + matroska.element(matroska.SIMPLE, body)
    media = matroska.demux(stored)
    assert [stored[o : o + k] for _, _, o, k, _ in media.packets] == frames and media.packets[0][1] == 105


def test_block_groups_and_damage():
    body = b"\x81\x00\x00\x00abc"
    group = matroska.element(matroska.GROUP, matroska.element(matroska.BLOCK, body) + matroska.number(0xFB, 1))
    stored = matroska._HEAD + matroska.element(matroska.SEGMENT, matroska._TRACKS + matroska.element(matroska.CLUSTER, matroska.number(matroska.TIMESTAMP, 1) + group))
    (packet,) = matroska.demux(stored).packets
    assert stored[packet[2] : packet[2] + packet[3]] == b"abc" and packet[4] is False
    with pytest.raises(ValueError):
        matroska.demux(stored[:-1])


def test_media_digests(spark):
    texts = [None, "", "a", "x" * 192, "é" * 100_000, "a"]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(None, "n", "c")], "doc_id long, text string, media string")
    got = {r.doc_id: r for r in matroska.media_digests(df).collect()}
    for i, t in enumerate(texts):
        payload, n = matroska.padded(t)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.media_sha256 == hashlib.sha256(matroska.mux(payload)).hexdigest()
    assert got[2][2:] == got[5][2:] and got[0][2:] == got[1][2:]
    table = matroska.packet_table(matroska.muxed(df))
    assert table.where("doc_id = 3").count() == 1 and table.where("doc_id = 4").count() == -(-200_000 // 192)
    assert matroska.media_digests(df.limit(0)).count() == 0
