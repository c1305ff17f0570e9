import hashlib
import io
import random
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from seqloom.llm import bpe, mpeg_audio, token_files
from seqloom.llm.words import WordTable

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, media string, ids string, payload string, start string, shard int"
TEXTS = [None, "", " \n", "TAG" * 500, "a", "é😀" * 300, "x" * 576, "x" * 577, "y" * 200_000, "It's İΣ ￿\x00 <|endoftext|>", "It's İΣ ￿\x00 <|endoftext|>"]


def docs_of(spark, texts):
    return spark.createDataFrame([(i // 2 if i else None, t, "en", "s", 1, "m", "i", "p", "s", 1) for i, t in enumerate(texts)], DOCS)


def save(spark, tmp_path, texts):
    docs_of(spark, texts).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


# ---- MPEG audio


def frame(version, layer, bitrate, rate, mode, crc, rng, padding=0):
    first = {"1": 3, "2": 2, "2.5": 0}[version]
    head = bytes([0xFF, 0xE0 | first << 3 | (4 - layer) << 1 | (0 if crc else 1), bitrate << 4 | rate << 2 | padding << 1, mode << 6])
    h = mpeg_audio.header(head)
    body = bytes(rng.randrange(0, 255) for _ in range(h.size - 4))
    out = head + body
    if crc and mpeg_audio.covered(h, out) is not None:
        out = out[:4] + mpeg_audio.crc16(mpeg_audio.covered(h, out)).to_bytes(2, "big") + out[6:]
    return out


def slow_crc(data):
    c = 0xFFFF
    for byte in data:
        for k in range(7, -1, -1):
            top = c >> 15 ^ (byte >> k & 1)
            c = (c << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return c


def test_crc_and_known_frame_sizes():
    assert mpeg_audio.crc16(b"123456789") == slow_crc(b"123456789")
    assert mpeg_audio.header(bytes.fromhex("fffb9064")).size == 417  # 128 kbit/s at 44.1 kHz
    assert mpeg_audio.header(bytes.fromhex("fffb9264")).size == 418
    assert mpeg_audio.header(b"\xff\xff\xff\xff") is None and mpeg_audio.header(b"\xff\xfb\x00\x00").bitrate == 0


def test_vbri_table_is_no_sound_frame():
    rng = random.Random(8)
    lead = frame("1", 3, 9, 0, 0, False, rng)
    table = b"VBRI" + (1).to_bytes(2, "big") + bytes(4) + (5000).to_bytes(4, "big") + (6).to_bytes(4, "big") + b"\0\2\0\1\0\2\0\3" + b"\3\0\4\0"
    sound = [frame("1", 3, 9, 0, 0, False, rng) for _ in range(6)]
    s = mpeg_audio.parse(lead[:4] + bytes(32) + table + bytes(len(lead) - 36 - len(table)) + b"".join(sound))
    assert s.vbr["kind"] == "VBRI" and s.vbr["frames"] == 6 and s.vbr["bytes"] == 5000 and s.vbr["sizes"] == [768, 1024] and s.vbr["frames_per_entry"] == 3
    assert s.samples == 6 * 1152 and s.offsets[0] == len(lead) and len(s.offsets) == 6


def bitwise_crc(bits):
    c = 0xFFFF
    for b in bits:
        c = (c << 1 & 0xFFFF) ^ (0x8005 if (c >> 15) ^ int(b) else 0)
    return c


def test_layer_2_checksums():
    # stereo of 192 kbit/s at 44.1 kHz (30 subbands), mono of 48 at 44.1 (8), joint stereo from subband 4 of MPEG 2 (30)
    widths = {"wide": [4] * 11 + [3] * 12 + [2] * 7, "small": [4] * 2 + [3] * 6, "low": [4] * 4 + [3] * 7 + [2] * 19}
    heads = {"wide": bytes([0xFF, 0xFC, 0xA0, 0x00]), "small": bytes([0xFF, 0xFC, 0x20, 0xC0]), "low": bytes([0xFF, 0xF4, 0x80, 0x40])}
    for name, head in heads.items():
        rng = random.Random(name)
        size = mpeg_audio.header(head).size
        code, picks = "", 0
        for k, w in enumerate(widths[name]):
            joint = name == "low" and k >= 4
            for _ in range(1 if name == "small" or joint else 2):
                value = rng.choice([0, rng.randrange(1 << w)])
                code += f"{value:0{w}b}"
                picks += (2 if joint else 1) * (value > 0)
        code += "".join(rng.choice("01") for _ in range(2 * picks))
        crc = bitwise_crc(f"{int.from_bytes(head[2:], 'big'):016b}" + code)
        rest = "".join(rng.choice("01") for _ in range((size - 6) * 8 - len(code)))
        good = head + crc.to_bytes(2, "big") + int(code + rest, 2).to_bytes(size - 6, "big")
        last = len(code) - 1  # the last covered bit, then the first that isn't
        bad, late = bytearray(good), bytearray(good)
        bad[6 + last // 8] ^= 128 >> last % 8
        late[6 + len(code) // 8] ^= 128 >> len(code) % 8
        s = mpeg_audio.parse(good + bytes(bad) + bytes(late))
        assert (len(s.offsets), s.checksums_good, s.checksums_bad) == (3, 2, 1), name


@pytest.mark.parametrize("version,layer", [(v, n) for v in ("1", "2", "2.5") for n in (1, 2, 3)])
def test_parse_resynchronises(version, layer):
    rng = random.Random(version + str(layer))
    frames = [frame(version, layer, rng.randint(5, 14), 0, rng.choice([0, 1, 3]), rng.random() < 0.5, rng) for _ in range(20)]
    junk = [b"\xff" * rng.randint(0, 3) + bytes(rng.randrange(0, 255) for _ in range(rng.randint(0, 50))) if k % 6 == 0 else b"" for k in range(20)]
    data, offsets, at = b"", [], 0
    for j, f in zip(junk, frames):
        offsets.append(at + len(j))
        data += j + f
        at = len(data)
    got = mpeg_audio.parse(data)
    assert got.offsets.tolist() == offsets
    assert got.samples == 20 * mpeg_audio.SAMPLES[version == "1", layer] and got.checksums_bad == 0
    assert got.skipped == len(data) - sum(h.size for h in got.headers)
    assert got.seek(got.samples - 1) == got.offsets[-1] and got.seek(got.samples) is None


def test_streams_that_change_their_format():
    rng = random.Random(3)
    slow, fast = [frame("1", 3, 9, 0, 0, False, rng) for _ in range(10)], [frame("1", 3, 9, 1, 0, True, rng) for _ in range(30)]
    s = mpeg_audio.parse(b"".join(slow + fast))
    assert len(s.offsets) == 40 and s.skipped == 0 and s.rates == {44100: 11520, 48000: 34560}
    assert s.duration_us == int(11520 * 10**6 / 44100 + 720_000) and s.rate == 44100
    assert s.seek(11520) == sum(map(len, slow)) == s.seek_us(261_225) and s.seek_us(261_224) == sum(map(len, slow[:9])) and s.seek_us(981_225) is None
    # two frames of another kind in front
    foreign = [frame("2", 2, 8, 1, 0, False, rng) for _ in range(2)]
    s = mpeg_audio.parse(b"".join(foreign + [frame("1", 3, 9, 1, 0, False, rng) for _ in range(50)]))
    assert len(s.offsets) == 52 and s.skipped == 0 and [h.version for h in s.headers[:3]] == ["2", "2", "1"]
    # a protected frame alone between junk confirms itself; one without a checksum can't
    alone = frame("1", 3, 9, 0, 0, True, rng)
    assert mpeg_audio.parse(b"ab" + alone + b"c" * 9).offsets.tolist() == [2]
    assert len(mpeg_audio.parse(b"ab" + slow[0] + b"c" * 9).offsets) == 0


@pytest.mark.parametrize("version,layer", [("1", 3), ("1", 1), ("2.5", 2)])
def test_free_bitrates(version, layer):
    rng = random.Random(5)
    head = bytes([0xFF, 0xE0 | {"1": 3, "2.5": 0}[version] << 3 | (4 - layer) << 1 | 1, 0, 0])
    unit = 4 if layer == 1 else 1
    frames = []
    for _ in range(12):
        padding = rng.randrange(2)
        frames.append(head[:2] + bytes([padding << 1, 0]) + bytes(rng.randrange(255) for _ in range(300 - 4 + padding * unit)))
    data = b"junk" + b"".join(frames)
    got = mpeg_audio.parse(data)
    assert got.offsets.tolist() == [4 + sum(map(len, frames[:k])) for k in range(12)] and got.skipped == 4
    assert got.samples == 12 * mpeg_audio.SAMPLES[version == "1", layer]


def test_damage_tags_and_empty():
    data = bytearray(mpeg_audio.build(b"q" * 5000))
    s = mpeg_audio.parse(bytes(data))
    assert s.tags["TXXX:payload_bytes"] == "5000" and s.vbr["frames"] == 9 and s.vbr["bytes"] == 10 * 672 and s.duration_us == 9 * 24000
    assert (s.checksums_good, s.checksums_bad, s.skipped) == (10, 0, 0) and s.old_tags["title"] == ""
    data[int(s.offsets[3]) + 10] ^= 1
    assert mpeg_audio.parse(bytes(data)).checksums_bad == 1
    data[int(s.offsets[5])] = 0
    broken = mpeg_audio.parse(bytes(data))
    assert len(broken.offsets) == 8 and broken.skipped == 672
    for junk in (b"", b"\xff", b"ID3", b"\xff\xfa\xc4\xc0", b"TAG" + bytes(125), b"\xff" * 999):
        assert len(mpeg_audio.parse(junk).offsets) == 0 and mpeg_audio.parse(junk).duration_us is None


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=4000))
def test_payload_round_trip(content):
    data = mpeg_audio.build(content)
    s = mpeg_audio.parse(data)
    payload = mpeg_audio.payload_of(data, s)
    assert len(payload) % 576 == 0 and payload and payload[: len(content)] == content and not payload[len(content) :].strip(b"\xff")
    assert mpeg_audio.content_size(s) == len(content)


def walked(data):
    """A plain reader: from header to header by the standard's sizes, without any search; (offsets, microseconds, frames)."""
    at, offsets, frames, seconds = 0, [], [], Fraction(0)
    if data[:3] == b"ID3":
        at = 10 + sum((b & 0x7F) << 7 * (3 - k) for k, b in enumerate(data[6:10]))
    end = len(data) - 128 if data[-128:-125] == b"TAG" else len(data)
    while at < end:
        assert data[at] == 0xFF and data[at + 1] >> 5 == 7
        version, layer = {3: "1", 2: "2", 0: "2.5"}[data[at + 1] >> 3 & 3], 4 - (data[at + 1] >> 1 & 3)
        rate = {"1": 1, "2": 2, "2.5": 4}[version]
        rate = (44100, 48000, 32000)[data[at + 2] >> 2 & 3] // rate
        # kbit/s, MPEG 1 by layer, then the lower rates' layer I and others
        kbit = {
            ("1", 1): range(0, 449, 32), ("1", 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384), ("1", 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
        }.get((version, layer)) or ((0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256) if layer == 1 else (0, *range(8, 65, 8), *range(80, 161, 16)))
        bits, padding = kbit[data[at + 2] >> 4] * 1000, data[at + 2] >> 1 & 1
        samples = 384 if layer == 1 else 576 if layer == 3 and version != "1" else 1152
        size = (12 * bits // rate + padding) * 4 if layer == 1 else samples // 8 * bits // rate + padding
        frames.append(data[at : at + size])
        offsets.append(at)
        seconds += Fraction(samples, rate)
        at += size
    return offsets, int(seconds * 1_000_000), frames


def test_offsets_and_durations_by_a_plain_reader():
    rng = random.Random(17)
    for _ in range(60):
        version, layer = rng.choice(["1", "2", "2.5"]), rng.randint(1, 3)
        mode, crc, rate = rng.choice([0, 1, 3]), rng.random() < 0.5, rng.randrange(3)
        data = b"".join(frame(version, layer, rng.randint(5, 14), rate, mode, crc, rng, rng.randrange(2)) for _ in range(rng.randint(2, 30)))
        got, (offsets, us, _) = mpeg_audio.parse(data), walked(data)
        assert (got.offsets.tolist(), got.duration_us) == (offsets, us) and got.skipped == 0
    for n in (0, 1, 575, 576, 577, 20_000):
        content = bytes(rng.randrange(256) for _ in range(n))
        data = mpeg_audio.build(content)
        got, (offsets, us, frames) = mpeg_audio.parse(data), walked(data)
        payload = mpeg_audio.payload_of(data, got)
        sound = offsets[-len(got.offsets) :]  # the table's frame comes first and is no sound
        assert got.offsets.tolist() == sound and 0 <= len(offsets) - len(sound) <= 1
        assert got.duration_us == us * len(sound) // len(offsets)
        assert all(payload[576 * i : 576 * i + 576] in f for i, f in enumerate(frames[-len(sound) :])) and payload.rstrip(b"\xff") == content.rstrip(b"\xff")


def test_mpeg_query(spark, tmp_path):
    rows = mpeg_audio.op8_mpeg_audio(spark, save(spark, tmp_path, TEXTS)).collect()
    want = []
    for i, t in enumerate(TEXTS):
        b = (t or "").encode()
        p = b + b"\xff" * ((-len(b)) % 576 if b else 576)
        want.append((i // 2 if i else None, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), hashlib.sha256(mpeg_audio.build(b)).hexdigest()))
    assert sorted(map(repr, ((r[0], r[1], r[2], r[3], r[4], r[6]) for r in rows))) == sorted(map(repr, want))
    assert all(len(r["seek_offsets"]) == r["n_frames"] == r["payload_bytes"] // 576 for r in rows)
    assert mpeg_audio.read_audio(mpeg_audio.encode_audio(docs_of(spark, []))).count() == 0


# ---- BPE


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


ALPHABET = st.one_of(st.sampled_from("etaoinshr'sdlmrevTHE .,!?é1ß<|>\n\x1c\x85\xa0²ÀµªÞ×÷Σİ́"), st.characters(exclude_categories=["Cs"]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(ALPHABET, max_size=40), max_size=8))
def test_both_encoders_match_the_library(texts):
    texts = texts + ["<|startoftext|>" + "".join(texts), None]
    lib, own, files = Tokenizer.from_file(PATH), bpe.load(PATH), token_files._encoder(PATH)
    want = [e.ids for e in lib.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    names = bpe.load_names(PATH)
    for got in (own.encode_batch(texts), own.encode_pieces(texts), files.encode_batch(texts)):
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == want
        assert [bpe.decode_ids(names, g) for g in got] == [lib.decode(w, skip_special_tokens=False) for w in want]


def test_long_words_and_forgetting(library, monkeypatch):
    from seqloom.llm import words

    monkeypatch.setattr(words, "REMEMBERED", 3)
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    monkeypatch.setattr(bpe, "REMEMBERED_PAIRS", 5)
    own = bpe.WordBpe(PATH)
    texts = ["a" * 30_000, "ab" * 9000 + "!" * 5000, "the then there theory", "日本語 テキスト" * 50]
    for t in texts:
        assert np.frombuffer(own.encode_batch([t])[0], "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
        assert token_files._encoder(PATH).encode_batch([t]) == own.encode_batch([t])


def test_equal_hashes_are_told_apart(library, monkeypatch):
    from seqloom.llm import words

    monkeypatch.setattr(words, "_SALT", np.ones(256, np.uint64))
    text = "some words share hashes if salts are ones, words of equal length"
    assert np.frombuffer(bpe.WordBpe(PATH).encode_batch([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_query(spark, tmp_path, library):
    rows = bpe.op4_bpe(spark, save(spark, tmp_path, TEXTS)).collect()
    want = []
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i // 2 if i else None, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want))


# ---- token files


class Memory(io.BytesIO):
    def size(self):
        return len(self.getvalue())


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.none() | st.integers(-(2**63), 2**63 - 1), st.integers(0, 3000), st.integers(0, 32)), max_size=12), st.sampled_from([0.01, 0.5, 0.9, 1.0]))
def test_token_files_round_trip(spec, percentile):
    rng = np.random.default_rng(len(spec))
    docs = [(i, rng.integers(0, 1 << bits, n, dtype=np.uint64).astype("<u4").tobytes()) for i, n, bits in spec]
    file = Memory()
    writer = token_files.TokenFileWriter(file, percentile)
    for d in docs:
        writer.add(*d)
    assert writer.close()["n_bytes"] == file.size()
    reader = token_files.TokenFileReader(file)
    assert [(a, c) for a, _, c in reader.documents()] == docs
    every = np.frombuffer(b"".join(c for _, c in docs), "<u4")
    for a in range(0, len(every) + 1, 701):
        assert (reader.tokens(a, a + 1500) == every[a : a + 1500]).all()


def test_token_file_query(spark, tmp_path, library):
    rows = token_files.op5_token_files(spark, save(spark, tmp_path, TEXTS)).collect()
    ids = [np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for t in TEXTS]
    want = sorted((-1 if not i else i // 2, len(x) // 4, zlib.crc32(x)) for i, x in enumerate(ids))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == want
    begun = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == begun
        begun += r["n_tokens"]
    ordered = [-1 if r["doc_id"] is None else r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])]
    assert ordered == sorted(ordered)


def test_equal_rows_are_dealt_over_files(spark):
    from seqloom.plans.durable import new_path

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        docs = docs_of(spark, ["x"] * 2).select("text").crossJoin(spark.range(3000)).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text")
        manifest = token_files.write_token_files(docs, PATH, new_path(spark, "tokens")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(r["n_docs"] for r in manifest) == 6000 and max(r["n_docs"] for r in manifest) < 4000


def test_files_of_failed_attempts_are_removed(spark, tmp_path):
    import os

    folder = tmp_path / "t"
    folder.mkdir()
    (folder / "part-000000-99.stf").write_bytes(b"left by an attempt that failed")
    manifest = token_files.write_token_files(docs_of(spark, TEXTS), PATH, f"file://{folder}").collect()
    assert {f for f in os.listdir(folder) if f.endswith(".stf")} == {r["path"].rsplit("/", 1)[1] for r in manifest}


def test_token_files_empty(spark):
    from seqloom.plans.durable import new_path

    manifest = token_files.write_token_files(docs_of(spark, []), PATH, new_path(spark, "tokens"))
    assert manifest.count() == 0 and token_files.read_token_files(manifest).count() == 0


def test_word_table_without_texts():
    assert WordTable(lambda words: (np.zeros(0, np.uint32), np.zeros(0, np.int64))).encode([]) == []
