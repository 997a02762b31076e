import base64
import gzip
import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import media, preferences, warc


@pytest.mark.parametrize("lines", [1, 2, 23, 24, 25, 100])
def test_media_hold_any_payload(lines):
    payload = np.random.default_rng(lines).integers(0, 256, lines * media.LINE, dtype=np.uint8).tobytes()
    file = media.write_avi(payload)
    pixels, n, microseconds = media.read_avi(file)
    assert pixels.tobytes()[:n] == payload and microseconds == 40_000
    assert len(file) < 1.3 * len(payload) + 600 * (lines // 24 + 1)


def test_every_sample_takes_nine_bits():
    words, back = media._WORD, media._DIFFERENCE
    assert len(set(words.tolist())) == 511 and 511 not in words and (back[words] == np.arange(-255, 256)).all()


def test_shots_are_cut_where_frames_change():
    dark, light = np.full((10, 24, 64, 3), 20, np.uint8), np.full((6, 24, 64, 3), 200, np.uint8)
    clips = media.shots(np.concatenate([dark, light, dark]), 40_000)
    assert [(c["first_frame"], c["last_frame"], c["start_ms"], c["end_ms"]) for c in clips] == [(0, 9, 0, 400), (10, 15, 400, 640), (16, 25, 640, 1040)]
    assert len(media.shots(dark[:1], 40_000)) == 1


def lossless(pixels, predictor, lengths):
    """A lossless JPEG file, coded sample by sample; class k has a code of lengths[k] bits."""
    order = sorted(range(len(lengths)), key=lambda k: (lengths[k], k))
    codes, code, last = {}, 0, 0
    for k in order:
        code <<= lengths[k] - last
        codes[k], last = format(code, f"0{lengths[k]}b"), lengths[k]
        code += 1
    lines, columns, n = pixels.shape
    at = pixels.astype(int)
    bits = []
    for y in range(lines):
        for x in range(columns):
            for c in range(n):
                left, up, corner = at[y, x - 1, c], at[y - 1, x, c], at[y - 1, x - 1, c]
                all_ = [left, up, corner, left + up - corner, left + ((up - corner) >> 1), up + ((left - corner) >> 1), (left + up) >> 1]
                guess = (128 if x == 0 else left) if y == 0 else up if x == 0 else all_[predictor - 1]
                d = int(at[y, x, c] - guess)
                size = abs(d).bit_length()
                bits.append(codes[size] + (format(d if d > 0 else d + (1 << size) - 1, f"0{size}b") if size else ""))
    text = "".join(bits)
    text += "1" * (-len(text) % 8)
    data = bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8)).replace(b"\xff", b"\xff\x00")
    counts = bytes(lengths.count(k) for k in range(1, 17))
    table = b"\xff\xc4" + struct.pack(">HB", 2 + 1 + 16 + len(lengths), 0) + counts + bytes(order)
    frame = b"\xff\xc3" + struct.pack(">HBHHB", 8 + 3 * n, 8, lines, columns, n) + b"".join(bytes([c, 0x11, 0]) for c in range(n))
    scan = b"\xff\xda" + struct.pack(">HB", 6 + 2 * n, n) + b"".join(bytes([c, 0]) for c in range(n)) + bytes([predictor, 0, 0])
    return b"\xff\xd8" + b"\xff\xe0\x00\x04ab" + table + frame + scan + data + b"\xff\xd9"


@pytest.mark.parametrize("predictor", range(1, 8))
def test_frames_of_other_writers_are_decoded(predictor):
    rng = np.random.default_rng(predictor)
    pixels = rng.integers(0, 256, (5, 7, 1 + predictor % 3), dtype=np.uint8)
    # differences of up to 9 or 10 bits occur with the later predictors
    file = lossless(pixels, predictor, [3, 4, 4, 4, 4, 4, 3, 3, 3, 4, 5])
    assert (media.decode_lossless(file) == pixels).all() and (media.decode_frames([file, file]) == pixels).all()
    for damaged in (file[:40], file.replace(b"\xff\xc3", b"\xff\xc0"), b"", file[:-9]):
        with pytest.raises((ValueError, IndexError, struct.error)):
            media.decode_frames([damaged])


def test_own_frames_agree_with_the_general_decoder():
    pixels = np.random.default_rng(0).integers(0, 256, (2, 3, media.WIDTH, 3), dtype=np.uint8)
    for file, frame in zip(media.encode_frames(pixels), pixels):
        assert (media.decode_lossless(file) == frame).all()


def test_files_without_an_index_or_with_another_one(spark):
    payload = np.random.default_rng(5).integers(0, 256, 60 * media.LINE, dtype=np.uint8).tobytes()
    file = media.write_avi(payload)
    at = file.index(b"idx1")
    assert media.read_avi(file[:at])[0].tobytes()[: len(payload)] == payload
    base = file.index(b"movi")
    absolute, places = bytearray(file), []
    for i in range(at + 8, len(file), 16):
        offset, length = struct.unpack_from("<II", file, i + 8)
        struct.pack_into("<I", absolute, i + 8, base + offset)
        places.append((base + offset + 8, length))
    assert media.read_avi(bytes(absolute))[0].tobytes()[: len(payload)] == payload
    # an OpenDML file: a super index in the stream's list, an index chunk after the frames
    ix = struct.pack("<HBBI4sQI", 2, 0, 1, len(places), b"00dc", 0, 0)
    super_ = struct.pack("<HBBI4s12xQII", 4, 0, 0, 1, b"00dc", 0, 0, 0)
    grown = len(super_) + 8
    where = file.index(b"strf") - 0
    body = file[:where] + b"indx" + struct.pack("<I", len(super_)) + super_ + file[where:at]
    ix += b"".join(struct.pack("<II", a + grown, n) for a, n in places[::-1])
    body = bytearray(body)
    struct.pack_into("<Q", body, where + 8 + 24, len(body))
    body += b"ix00" + struct.pack("<I", len(ix)) + ix
    for name in (b"hdrl", b"strl"):
        i = body.index(name) - 4
        struct.pack_into("<I", body, i, struct.unpack_from("<I", body, i)[0] + grown)
    frames = media.read_avi(file)[0]
    assert (media.read_avi(bytes(body))[0] == frames[::-1]).all()
    rows = [(1, file), (2, file[:300]), (3, b"RIFF"), (4, None), (5, b""), (6, file.replace(b"\xff\xd8", b"\xff\xd7"))]
    got = {r.doc_id: r for r in media.from_media(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert bytes(got[1].payload) == payload and all(got[i].payload is None and got[i].clips is None for i in range(2, 7))


def test_media_columns(spark):
    texts = [None, "", "a", "b" * 192, "é日" * 4000, "a"]
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(None, "a", "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media string, clips string")
    got = media.media_digests(docs).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = by_id[i]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert (r.payload_sha256, r.tail_crc32) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert by_id[2][1:] == by_id[5][1:] == by_id[None][1:]
    clips = media.clip_rows(media.from_media(media.to_media(docs))).collect()
    assert {c.doc_id for c in clips} == {*range(6), None} and all(c.end_ms > c.start_ms for c in clips)
    assert media.media_digests(docs.limit(0)).collect() == []


def test_archives_are_read_back_in_global_order(spark):
    rng = random.Random(1)
    rows = [(i, f"http://h{rng.randint(0, 5)}.example.org/p/{rng.randint(0, 9)}", rng.choice(["<p>a</p>\r\n\r\n", "b" * 5000, "é", "", None])) for i in range(300)]
    rows += [(7, *rows[7][1:]), (None, "http://x.org/ü b", "only"), (None, None, "only"), (400, "http://x.org", "\r\n\r\nWARC/1.1\r\n")]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, sha string, date long").repartition(7)
    got = warc.capture_index(pages).collect()
    assert len(got) == len(rows)
    keys = [(r.url_key, r.timestamp, r.page_id is None, r.page_id or 0) for r in got]
    assert keys == sorted(keys)
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    html_of = {i: h or "" for i, _, h in rows}
    for r in got:
        if r.page_id is None:
            assert r.record_type == "response" and r.refers_to is None
            continue
        html = html_of[r.page_id]
        assert r.payload_digest == base64.b32encode(hashlib.sha1(html.encode()).digest()).decode() and r.payload_bytes == len(html.encode())
        assert (r.record_type, r.refers_to) == (("response", None) if first[html] == r.page_id else ("revisit", first[html]))
    assert warc.capture_index(pages.limit(0)).collect() == []


def test_any_id_url_and_date_will_do(spark):
    rows = [(10**15, "http://[a", "x", "n/a"), (-(2**63), "", "x", "2021-05-06 07:08:09"), (2**63 - 1, "a b", "y", None), (5, "http://é.org:99999/?q", "y", "+99999-01-01"), (None, "//", "z", "1e9")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, captured_at string")
    got = {r.page_id: r for r in warc.capture_index(pages).collect()}
    assert set(got) == {r[0] for r in rows} and got[-(2**63)].timestamp == "2021-05-06T07:08:09Z"
    assert got[10**15].refers_to == -(2**63) and got[2**63 - 1].refers_to == 5 and got[None].record_type == "response"
    assert got[10**15].url_key == ")http://[a" and len(got[10**15].timestamp) == 20
    for kind, value in (("array<int>", [1]), ("int", 7), ("date", None)):
        assert warc.capture_index(spark.createDataFrame([(1, "u", "h", value)], f"page_id long, url string, html string, captured_at {kind}")).count() == 1


def test_records_are_read_by_offset_and_archives_are_bounded(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, f"http://a.org/{i}", "".join(chr(rng.randint(33, 1000)) for _ in range(2000))) for i in range(200)]
    path = f"file://{tmp_path}/w"
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), path, size=20_000)
    files = {f.name: f.read_bytes() for f in (tmp_path / "w").glob("*.txt")}
    assert len(files) > 20 and all(len(f) < 27_000 for f in files.values())
    index = warc.index_rows(warc.sorted_runs(spark, path)).collect()
    assert len(index) == 200
    for r in index:
        fields, block = warc.parsed(gzip.decompress(files[r.file][r.offset : r.offset + r.length]))
        assert block.endswith(rows[r.page_id][2].encode()) and fields["WARC-Target-URI"] == r.url
        assert gzip.decompress(files[r.file]).startswith(b"WARC/1.1")


def test_hot_urls_are_split_over_tasks(spark, tmp_path):
    rows = [(i, "http://hot.example.org/", f"v{i}") for i in range(200)]
    path = f"file://{tmp_path}/w"
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), path, size=3000)
    runs = warc.sorted_runs(spark, path)
    assert runs.count() > 6
    merged = warc.capture_histories(runs, rows_per_task=50)
    assert merged.rdd.getNumPartitions() == 4 and [r.page_id for r in merged.collect()] == list(range(200))
    sizes = merged.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 4 and max(r["count"] for r in sizes) < 90


def test_the_loser_tree_merges_any_number_of_runs():
    rng = random.Random(2)
    for k in range(0, 12):
        runs = [sorted(rng.randint(0, 50) for _ in range(rng.randint(0, 9))) for _ in range(k)]
        merged = list(warc.loser_tree([((x, x) for x in r) for r in runs]))
        assert merged == sorted(x for r in runs for x in r)


def sides(spark, rows):
    return spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string")


def test_the_common_prefix_is_the_prompt(spark):
    rows = [(1, s, 0, "user", "hi") for s in ("chosen", "rejected")] + [(1, s, 1, "assistant", "hello") for s in ("chosen", "rejected")]
    rows += [(1, "chosen", 2, "user", "a"), (1, "rejected", 2, "user", "b"), (1, "chosen", 3, "assistant", "x"), (1, "rejected", 3, "assistant", "y"), (1, "chosen", 4, "user", None)]
    rows += [(2, "chosen", 0, None, ""), (2, "rejected", 0, "", None), (3, "chosen", 5, "assistant", "alone")]
    segments = preferences.preference_segments(preferences.paired_turns(sides(spark, rows)))
    got = {r.pair_id: r for r in preferences.preference_rows(segments).collect()}
    one = got[1]
    assert one.prompt == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n"
    assert [one.chosen[s.begin : s.end] for s in one.chosen_spans] == ["x<|im_end|>"] and [one.rejected[s.begin : s.end] for s in one.rejected_spans] == ["y<|im_end|>"]
    assert one.chosen.endswith("<|im_start|>user\n<|im_end|>\n")
    assert got[2].chosen == got[2].rejected == "" and got[2].prompt and got[3].prompt == "" and got[3].rejected == ""
    assert preferences.preference_segments(preferences.paired_turns(sides(spark, []))).collect() == []


def test_replies_are_swapped_between_partners(spark):
    rows = [(0, 0, "user", "q", 1), (0, 1, "assistant", "zero", 1), (1, 0, "user", "r", 1), (1, 1, "assistant", "one", 1), (1, 1, "assistant", "one", 1), (4, 0, "assistant", "lonely", 1)]
    rows += [(None, 0, "user", "x", 1), (6, None, "user", "x", 1), (8, 0, None, None, 1)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, side long")
    got = {(r.pair_id, r.turn): (r.chosen.text, r.rejected.text) for r in preferences.swapped_replies(turns).collect()}
    assert got[0, 1] == ("zero", "one") and got[1, 1] == ("one", "zero") and got[4, 0] == ("lonely", "lonely")
    assert len(got) == 6 and got[8, 0] == ("", "")


def test_null_turns_are_left_out_and_repeated_turns_are_one(spark):
    rows = [(0, 0, "user", "b"), (0, 0, "user", "a"), (0, 0, "tool", "z"), (0, None, "assistant", "placeless"), (0, 1, "assistant", "zero"), (1, 0, "assistant", "one"), (2, None, "user", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((r.pair_id, r.turn, *r.rejected) for r in preferences.swapped_replies(turns).collect())
    assert got == [(0, 0, "tool", "z"), (0, 1, "assistant", "one"), (1, 0, "assistant", "zero")]


def test_random_pairs_agree_with_brute_force(spark):
    rng = random.Random(6)
    rows, want = [], {}
    render = lambda r: f"<|im_start|>{r[0]}\n{r[1]}<|im_end|>\n"
    for pair in range(120):
        both = []
        shared = [(rng.choice(["user", "assistant"]), rng.choice(["", "a", "é<|im_end|>", "bb"])) for _ in range(rng.randint(0, 6))]
        for _ in range(2):
            tail = [(rng.choice(["user", "assistant"]), rng.choice(["a", "b"])) for _ in range(rng.randint(0, 4))]
            both.append((shared + tail)[: rng.randint(0, 9)])
        for side, turns in zip(("chosen", "rejected"), both):
            rows += [(pair, side, 3 * k, *x) for k, x in enumerate(turns)]
        n = 0
        while n < min(map(len, both)) and both[0][n] == both[1][n]:
            n += 1
        if both[0] or both[1]:
            learnt = [["".join(map(render, t[n:])), [x[1] + "<|im_end|>" for x in t[n:] if x[0] == "assistant"]] for t in both]
            want[pair] = ("".join(map(render, both[0][:n])), *(x[0] for x in learnt), *(x[1] for x in learnt))
    segments = preferences.preference_segments(preferences.paired_turns(sides(spark, rows).repartition(5)))
    got = {}
    for r in preferences.preference_rows(segments).collect():
        cut = [[text[s.begin : s.end] for s in spans] for text, spans in ((r.chosen, r.chosen_spans), (r.rejected, r.rejected_spans))]
        got[r.pair_id] = (r.prompt, r.chosen, r.rejected, *cut)
    assert got == want
