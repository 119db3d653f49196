import hashlib
import random
import zlib

from quoin.llm.mpeg_audio import LARGEST, crc16, decode, encode, header, measure_media, op9_media_columns, padded, to_media


def test_checksum_against_bitwise_division():
    rnd = random.Random(1)
    for _ in range(50):
        data = rnd.randbytes(rnd.randint(0, 40))
        value = 0xFFFF
        for byte in data:
            for bit in range(7, -1, -1):
                top = value >> 15 ^ (byte >> bit & 1)
                value = (value << 1 & 0xFFFF) ^ (0x8005 if top else 0)
        assert crc16(data) == value


def test_headers():
    h = header(b"\xff\xfb\x90\x00")
    assert (h.bit_rate, h.sample_rate, h.length, h.samples, h.protected) == (128000, 44100, 417, 1152, False)
    assert header(b"\xff\xfb\x92\x00").length == 418
    assert header(b"\xff\xf3\x80\xc0").samples == 576 and header(b"\xff\xf3\x80\xc0").channels == 1
    for raw in (b"\xff\xfb\xf0\x00", b"\xff\xfb\x00\x00", b"\xff\xfb\x9c\x00", b"\xff\xeb\x90\x00", b"\xff\xf9\x90\x00", b"\xff\xfb\x90\x02", b"\xfe\xfb\x90\x00", b"\xff"):
        assert header(raw) is None


def test_round_trips():
    rnd = random.Random(2)
    for n in [0, 1, 63, 64, 65, 128, LARGEST - 1, LARGEST, LARGEST + 1, 3 * LARGEST, 50_000, *(rnd.randint(0, 9000) for _ in range(60))]:
        for raw in (rnd.randbytes(n), b"\xff\xfa" * (n // 2)):
            payload = padded(raw)
            assert len(payload) % 64 == 0 and payload and payload.startswith(raw) and len(payload) - len(raw) <= 64
            audio = decode(encode(payload))
            assert audio.payload == payload and audio.intact and audio.duration_us == audio.frames * 36000
            assert audio.offsets == sorted(audio.offsets) and len(audio.offsets) == audio.frames


def test_damage_is_found_and_passed_over():
    payload = padded(random.Random(3).randbytes(9000))
    media = encode(payload)
    whole = decode(media)
    second = whole.offsets[1]
    broken = decode(media[: whole.offsets[2]] + b"junk\xff\xff" + media[whole.offsets[2] :])
    assert broken.skipped and broken.frames >= whole.frames - 1 and not broken.intact
    changed = bytearray(media)
    changed[second + 10] ^= 1
    assert decode(bytes(changed)).bad_sums == 1
    assert not decode(media[:-5]).intact and decode(b"").frames == 0 and decode(b"\xff" * 50).frames == 0


def test_query(spark, tmp_path):
    texts = [None, "", "x" * 64, "é" * 777, "a copy", "a copy", "long " * 20_000]
    spark.createDataFrame([(i, t, b"m") for i, t in enumerate(texts)], "doc_id long, text string, media binary").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op9_media_columns(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes((-len(raw)) % 64 or (64 if not raw else 0))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_bytes == len(encode(payload)) and r.media_sha256 == hashlib.sha256(encode(payload)).hexdigest() and "intact=1;seek=" in r.feature
    assert got[4][1:] == got[5][1:]


def test_other_layers_and_versions():
    one, two = header(b"\xff\xff\xa0\x00"), header(b"\xff\xfd\xa4\x00")
    assert (one.layer, one.bit_rate, one.sample_rate, one.length, one.samples) == (1, 320000, 44100, 348, 384)
    assert (two.layer, two.bit_rate, two.sample_rate, two.length, two.samples) == (2, 192000, 48000, 576, 1152)
    audio = decode((b"\xff\xfd\xa4\x00" + bytes(572)) * 5)
    assert audio.frames == 5 and audio.duration_us == 5 * 24000 and not audio.skipped


def test_tables_by_their_flags():
    head, frame = b"\xff\xfb\x90\x00", b"\xff\xfb\x90\x00" + bytes(413)
    first = lambda body: (head + body).ljust(417, b"\0") + frame * 3
    for flags, values, want in [(3, [3, 12345], (3, 12345)), (2, [12345], (None, 12345)), (1, [3], (3, None)), (0, [], (None, None))]:
        audio = decode(first(bytes(32) + b"Xing" + b"".join(n.to_bytes(4, "big") for n in [flags, *values])))
        assert (audio.table_frames, audio.table_bytes, audio.frames) == (*want, 3)
    audio = decode(first(bytes(32) + b"VBRI" + bytes(6) + (1668).to_bytes(4, "big") + (3).to_bytes(4, "big")))
    assert (audio.table_frames, audio.table_bytes, audio.frames) == (3, 1668, 3)
    audio = decode(frame * 3 + b"TAG" + bytes(125))
    assert audio.id3v1 and audio.frames == 3 and not audio.skipped


def test_stored_lengths_are_not_trusted():
    payload = padded(random.Random(4).randbytes(6400))
    media = encode(payload)
    at = media.index(b"payload\0") + 8
    false = media[:at] + (10).to_bytes(8, "big") + media[at + 8 :]
    assert decode(false).payload.startswith(payload) and not decode(false).intact
    longer = media[:6] + b"\x00\x00\x7f\x7f" + media[10:]
    assert decode(longer).payload == payload


def test_any_bytes_can_be_read():
    rnd = random.Random(5)
    media = encode(padded(rnd.randbytes(3000)))
    for _ in range(1500):
        raw = bytearray(media[: rnd.randint(0, len(media))] if rnd.random() < 0.5 else media)
        for _ in range(rnd.randint(0, 30)):
            if raw:
                raw[rnd.randrange(min(len(raw), rnd.choice([60, 400, 10**6])))] = rnd.choice([0, 255, 0x7F, rnd.randrange(256)])
        decode(bytes(raw))
        decode(rnd.choice([b"", b"ID3", b"\xff\xf3\x10\x00"]) + rnd.randbytes(rnd.randint(0, 40)) + rnd.choice([b"Xing", b"VBRI", b"TAG", b""]))


def test_measures_of_a_media_column(spark):
    docs = spark.createDataFrame([(1, "some text", 7), (2, None, 8)], "doc_id long, text string, FRAMES int")
    media = to_media(docs).select("doc_id", "FRAMES", "media").unionByName(spark.createDataFrame([(3, 9, None), (4, 9, bytearray(b"no audio"))], "doc_id long, FRAMES int, media binary"))
    got = {r.doc_id: r for r in measure_media(media).collect()}
    assert bytes(got[1].payload) == padded(b"some text") and got[1].intact and got[1].duration_us == 36000 and len(got[1].seek_offsets) == got[1].frames == 1
    assert bytes(got[2].payload) == bytes(64) and [got[k].frames for k in (3, 4)] == [0, 0] and got[4].skipped_bytes == 8 and got[3].seek_offsets == []
    assert measure_media(media.limit(0)).count() == 0


def test_text_in_a_column_named_media(spark):
    out = to_media(spark.createDataFrame([("some text", 1), (None, 2)], "media string, k int"), "media")
    assert out.columns == ["k", "media"] and {r.k: decode(bytes(r.media)).payload for r in out.collect()} == {1: padded(b"some text"), 2: bytes(64)}
