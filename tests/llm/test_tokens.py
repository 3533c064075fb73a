"""Word encoding, token files, packing, piece encoding and media: exact against their libraries and by round trips."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from veldra.llm import jpeg, packing, piece_bpe, token_planes, word_bpe
from veldra.llm.common import tidy

ODD = ["", None, " ", "a", "Hello, world's   best", "é" * 50, "x" * 5000, "日本語 Σίσυφος İ", "<|endoftext|> a<|startoftext|>b", "tab\tnew\nline\x1cfs\x85", "é ́", "\x00", "𝒳 😀", "1234567890 " * 300]


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def odd_docs(spark):
    """Odd texts, a null id, repeated rows, and further columns with clashing names."""
    rows = [(i, t, i, "q", i) for i, t in enumerate(ODD)] + [(None, "no id", 0, "q", 0), (3, "a", 3, "q", 3), (3, "a", 3, "q", 3), (3, "other", 3, "q", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, start int, Text2 string, length int")


def library_ids(texts):
    lib = word_bpe.encoder(word_bpe.default_path()).library
    return [np.array([*e.ids, 1], "<u4") for e in lib.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]


def test_words_as_the_library():
    r = random.Random(1)
    chars = "aA1 ,.'sStTeE\n\t\x1c\x85éÉß²½İΣσ́日<>|%\xa0 ﬁĲ​"
    texts = ["".join(r.choice(chars) for _ in range(r.randint(0, 40))) for _ in range(3000)] + ODD
    enc = word_bpe.WordEncoder(word_bpe.default_path(), cache_words=500)
    for i in range(0, len(texts), 100):
        for t, got in zip(texts[i : i + 100], enc.encode(texts[i : i + 100])):
            want = np.array(enc.library.encode(t or "", add_special_tokens=False).ids, "<u4")
            assert got == want.tobytes(), repr(t)


@pytest.mark.parametrize("mode", ["bit", "byte"])
@pytest.mark.parametrize("n", [1, 7, 8, 1000])
def test_planes_round_trip(mode, n):
    r = np.random.default_rng(n)
    for top in (1, 2, 200, 49408, 1 << 31):
        ids = r.integers(0, top, n).astype("<u4")
        payload, blocks = token_planes.write_chunk(ids, mode, block=64)
        assert np.array_equal(token_planes.read_chunk(payload), ids)
        assert sum(b["ids"] for b in blocks) == n and blocks[-1]["at"] + blocks[-1]["size"] == len(payload)


def test_crc_of_parts():
    a, b = b"hello", b"world, and more"
    assert token_planes.crc_combine(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_op5_against_the_library(spark, docs, folder):
    rows = sorted(docs.select("doc_id", "text").collect())
    start, want = 0, []
    for r, ids in zip(rows, library_ids([r["text"] for r in rows])):
        want.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = token_planes.op5_token_planes(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want


def test_reading_tokens_leaves_the_session_alone(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    chunks = token_planes.write_tokens(odd_docs(spark), chunk=16, shards=2)
    assert token_planes.read_tokens(chunks).count() == odd_docs(spark).count() and spark.conf.get(key) == before


def test_a_full_dictionary_keeps_words_met_again():
    enc = word_bpe.WordEncoder(word_bpe.default_path(), cache_words=40)
    often, seen = "Some words that come again", []
    learn = enc.learn
    enc.learn = lambda words: seen.extend(words) or learn(words)
    for k in range(60):
        text = f"w{k}a w{k}b w{k}c w{k}d"
        # in every second batch only, so a batch's own words don't keep them
        got = enc.encode([text if k % 2 else f"{text} {often}"])[0]
        assert got == np.array(enc.library.encode(text if k % 2 else f"{text} {often}", add_special_tokens=False).ids, "<u4").tobytes()
        assert len(enc.cache) <= 40 + 9 and len(enc.pieces) <= 40 + 30
    assert all(seen.count(w) == 1 for w in often.split())


def test_words_are_looked_up_without_objects():
    """Odd words, in slices and in small pieces, as the library; a word held takes less than 150 bytes (as strings: over 250)."""
    import tracemalloc

    odd = ["a", "a\0", "a\0\0", " a ", "x" * 15, "x" * 16, "x" * 14 + "\0", "y" * 70, "one\u00a0two\u3000", "\u2003", "a\x1cb \x85c", "\u4e2d\u6587 \u0436\u0418", "<|endoftext|>x", None, "", "\t\r\n"]
    texts = pa.array(odd * 3 + ["".join(t or "" for t in odd)], pa.string())
    enc = word_bpe.WordEncoder(word_bpe.default_path(), cache_words=30)
    want = [np.array(enc.library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts.to_pylist()]
    for piece in (1, 20, 1 << 19):
        assert [x for part in enc.encoded(texts.slice(5, 40), piece) for x in part] == want[5:45]
        assert [x for part in enc.encoded(texts, piece) for x in part] == want
    enc = word_bpe.WordEncoder(word_bpe.default_path())
    tracemalloc.start()
    for k in range(0, 30_000, 1000):
        enc.encode([" ".join(f"{i:x}q{i % 7}" for i in range(k, k + 1000))])
    enc.pieces.clear()
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(enc.cache) == 30_000 and held < 150 * 30_000


def test_a_reader_holds_no_dictionary():
    """Workers go on from writing to reading, and to other queries: what they have learnt must not stay with them."""
    run = token_planes._writer(word_bpe.default_path(), 1, "byte", 64)
    texts = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2]), "text": ["one two", "three"], "shard": pa.array([0, 0], pa.int32())})
    chunks = list(run(iter([texts])))
    enc = word_bpe.encoder(word_bpe.default_path(), token_planes.CACHE_WORDS)
    assert enc.cache
    list(token_planes._reader(iter(chunks)))
    assert not enc.cache and not enc.again and set(enc.pieces) == {"\n"}


def test_token_files_of_odd_rows(spark):
    df = odd_docs(spark)
    got = token_planes.read_tokens(token_planes.write_tokens(df, chunk=64, shards=3)).collect()
    rows = sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start, want = 0, []
    for (k, _), ids in zip(rows, library_ids([t for _, t in rows])):
        want.append((k, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    key = lambda r: r[1]
    assert sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got), key=key) == want
    empty = df.limit(0)
    assert token_planes.read_tokens(token_planes.write_tokens(empty)).count() == 0


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in by.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_op2_packs_all_pieces(spark, docs, folder):
    got = packing.op2_best_fit_packing(spark, folder).collect()
    n = check_packing(got, 4096)
    assert n <= -(-sum(r["length"] for r in got) // 4096) + 1
    rows = docs.select("doc_id", "text").collect()
    ids = dict(zip([r["doc_id"] for r in rows], library_ids([r["text"] for r in rows])))
    assert sum(r["length"] for r in got) == sum(map(len, ids.values()))
    for r in got:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
        assert r["start"] == r["piece"] * 4096


def test_packing_of_odd_rows(spark):
    df = odd_docs(spark)
    got = packing.pack_documents(df, capacity=50).collect()
    check_packing(got, 50)
    assert sum(r["length"] for r in got) == sum(map(len, library_ids([r["text"] for r in df.collect()])))
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_pieces_are_the_same_with_a_small_dictionary(docs, monkeypatch):
    """Emptied again and again, it gives the ids of the one that holds all words."""
    texts = docs.select("doc_id", "text").limit(200).toArrow().combine_chunks().to_batches()
    rows = lambda hold: [r for b in packing._pieces(word_bpe.default_path(), 1, 4096, hold)(iter(texts)) for r in b.to_pylist()]
    want = rows(True)
    monkeypatch.setattr(packing, "LEAN_WORDS", 50)
    assert rows(False) == want and len(want) >= 200
    assert not word_bpe.encoder(word_bpe.default_path()).cache


def test_tidy_functions_give_all_batches():
    assert list(tidy(lambda batches: (2 * b for b in batches))(iter([1, 2, 3]))) == [2, 4, 6]


def best_fit_decreasing(counts, capacity):
    gaps, bins = [0] * (capacity + 1), 0
    for a in sorted(counts, reverse=True):
        for _ in range(counts[a]):
            g = next((g for g in range(a, capacity + 1) if gaps[g]), None)
            if g is None:
                g, bins = capacity, bins + 1
            else:
                gaps[g] -= 1
            gaps[g - a] += 1
    return bins


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_all_and_fits(seed):
    r = random.Random(seed)
    counts = {r.randint(1, 64): r.randint(1, 500) for _ in range(r.randint(1, 40))}
    plan = packing.plan(counts, 64)
    used = {}
    for times, lengths in plan:
        assert sum(lengths) <= 64 and times > 0
        for a in lengths:
            used[a] = used.get(a, 0) + times
    assert used == counts and len(plan) <= len(counts) + 64
    assert sum(t for t, _ in plan) <= 1.1 * best_fit_decreasing(counts, 64) + 1


def test_exact_fill_is_preferred():
    assert packing.plan({6: 1, 4: 1, 5: 1, 3: 1, 2: 1}, 10) == [(1, [6, 4]), (1, [5, 3, 2])]


def test_pieces_as_sentencepiece():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_bpe.default_path())
    m = piece_bpe.PieceModel(piece_bpe.default_path(), cache_words=300)
    r = random.Random(2)
    chars = "abcthe  ▁\n\n\t\x00éß日한ĲAEI<s></s><0x0A>.,!?123😀\xa0​"
    texts = ["".join(r.choice(chars) for _ in range(r.randint(0, 30))) for _ in range(2000)] + ["".join(r.choice("aeinorst ") for _ in range(60)) for _ in range(300)]
    texts += [t for t in ODD if t] + ["ab" * 3000]
    for i in range(0, len(texts), 100):
        part = texts[i : i + 100]
        for t, got, want in zip(part, m.encode(part), sp.encode(part)):
            assert got == np.array(want, "<u4").tobytes(), repr(t)
            assert m.decode([1, *want, 2]) == sp.decode([1, *want, 2])
    for _ in range(2000):
        ids = [r.choice([0, 1, 2, r.randrange(3, 259), r.randrange(259, 32000)]) for _ in range(r.randint(0, 8))]
        assert m.decode(ids) == sp.decode(ids), ids


def test_op6_against_sentencepiece(spark, docs, folder):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_bpe.default_path())
    got = {r["doc_id"]: r for r in piece_bpe.op6_piece_backtracking(spark, folder).collect()}
    for r in docs.select("doc_id", "text").collect():
        ids = sp.encode(r["text"] or "", add_bos=True, add_eos=True)
        g = got[r["doc_id"]]
        assert (g["n_tokens"], g["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert g["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_pieces_of_odd_rows(spark):
    df = odd_docs(spark)
    got = piece_bpe.encode_pieces(df).collect()
    assert len(got) == df.count() and all(r["ids"][0] == 1 and r["ids"][-1] == 2 for r in got)
    assert piece_bpe.encode_pieces(df.limit(0), digests=True).count() == 0


def test_media_round_trip():
    r = np.random.default_rng(3)
    payloads = [r.integers(0, 256, 192 * k).astype(np.uint8).tobytes() for k in (1, 2, 9, 30)] + [b"\xff" * 192, b"\x00\xff" * 96 * 9, b" " * 192]
    for rows in (jpeg.MAX_ROWS, 4):
        media = jpeg.encode_payloads(payloads, max_rows=rows)
        for p, images in zip(payloads, jpeg.decode_thumbnails(media)):
            assert b"".join(t.tobytes() for _, _, t in images) == p
            assert all(w == 1536 for w, _, _ in images)


def test_media_is_the_same_whatever_the_runs(monkeypatch):
    r = np.random.default_rng(4)
    payloads = [r.integers(200, 256, 192 * k).astype(np.uint8).tobytes() for k in (1, 7, 20, 3)]
    whole = jpeg.encode_payloads(payloads, max_rows=5)
    monkeypatch.setattr(jpeg, "RUN_ROWS", 4)
    assert jpeg.encode_payloads(payloads, max_rows=5) == whole
    monkeypatch.setattr(jpeg._sliced, "__defaults__", (300,))
    for p, images in zip(payloads, jpeg.decode_thumbnails(whole)):
        assert b"".join(t.tobytes() for _, _, t in images) == p


def test_a_long_text_takes_a_few_times_its_bytes():
    """12 and 24 MB: what is held beyond the payload grows by less than five bytes a byte."""
    import tracemalloc

    peaks = []
    for rows in (62_500, 125_000):
        payload = (b"some words of a very long text, " * (rows * 6))[: rows * 192]
        tracemalloc.start()
        media = jpeg.encode_payloads([payload])
        stored = tracemalloc.get_traced_memory()[1]
        tracemalloc.reset_peak()
        (images,) = jpeg.decode_thumbnails(media)
        peaks.append(max(stored, tracemalloc.get_traced_memory()[1]))
        tracemalloc.stop()
        assert b"".join(t.tobytes() for _, _, t in images) == payload
    assert peaks[1] - peaks[0] < 5 * 12_000_000


def colour_jpeg(rows, cols, seed):
    """A baseline image of three components, the first sampled twice as finely, with restart intervals and AC
    coefficients, written bit by bit; and its first component's DC values."""
    r = random.Random(seed)
    dc = {v: (c, n) for c, n, v in jpeg._codes(jpeg.DC_SIZES, jpeg.DC_VALUES)}
    ac_sizes, ac_values = [0, 2, 2] + [0] * 13, [0x00, 0x01, 0x32, 0xF0]
    ac = {v: (c, n) for c, n, v in jpeg._codes(ac_sizes, ac_values)}
    bits, out, want, pred, unit = "", b"", np.zeros((rows * 2, cols * 2), int), [0, 0, 0], 0

    def put(code, n):
        nonlocal bits
        if n:
            bits += format(code, f"0{n}b")

    def flush():
        nonlocal bits, out
        bits += "1" * (-len(bits) % 8)
        out += b"".join(bytes([int(bits[i : i + 8], 2)]) + (b"\x00" if bits[i : i + 8] == "1" * 8 else b"") for i in range(0, len(bits), 8))
        bits = ""

    for y in range(rows):
        for x in range(cols):
            if unit and unit % 3 == 0:
                flush()
                out += bytes([0xFF, 0xD0 + (unit // 3 - 1) % 8])
                pred = [0, 0, 0]
            for comp, v, h in [(0, 0, 0), (0, 0, 1), (0, 1, 0), (0, 1, 1), (1, 0, 0), (2, 0, 0)]:
                value = r.randint(-60, 60)
                d, pred[comp] = value - pred[comp], value
                s = abs(d).bit_length()
                put(*dc[s])
                put(d if d >= 0 else d + (1 << s) - 1, s)
                if comp == 0:
                    want[2 * y + v, 2 * x + h] = value
                for sym in r.choice([[], [0x01], [0x32, 0x01], [0xF0, 0x32]]):
                    put(*ac[sym])
                    put(r.randint(0, (1 << (sym & 15)) - 1) if sym & 15 else 0, sym & 15)
                put(*ac[0])
            unit += 1
    flush()
    seg = jpeg._segment
    head = b"\xff\xd8" + seg(0xE0, b"JFIF\x00") + seg(0xDB, bytes([0, 16] + [1] * 63)) + seg(0xC0, bytes([8]) + (16 * rows).to_bytes(2, "big") + (16 * cols).to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    head += seg(0xC4, bytes([0x00, *jpeg.DC_SIZES, *jpeg.DC_VALUES])) + seg(0xC4, bytes([0x10, *ac_sizes, *ac_values])) + seg(0xDD, (3).to_bytes(2, "big"))
    head += seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))
    return head + out + b"\xff\xd9", np.clip((want * 16 + 4 >> 3) + 128, 0, 255)


def test_general_baseline_images():
    made = [colour_jpeg(3, 4, 1), colour_jpeg(2, 2, 2), colour_jpeg(5, 1, 3)]
    for (_, want), images in zip(made, jpeg.decode_thumbnails([m for m, _ in made])):
        (w, h, thumb), = images
        assert (h, w) == (want.shape[0] * 8, want.shape[1] * 8) and np.array_equal(thumb, want)


def test_bad_images_are_errors():
    good = jpeg.encode_payloads([b"a" * 192])[0]
    for bad in (b"no image", good[:-2], good.replace(b"\xff\xc0", b"\xff\xc2")):
        with pytest.raises(ValueError):
            jpeg.decode_thumbnails([bad])


def test_op4_features(spark, docs, folder):
    got = {r["doc_id"]: r for r in jpeg.op4_jpeg_media(spark, folder).collect()}
    for r in docs.select("doc_id", "text").collect():
        raw = (r["text"] or "").encode()
        p = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        g = got[r["doc_id"]]
        assert (g["n_bytes"], g["payload_bytes"]) == (len(raw), len(p))
        assert (g["payload_sha256"], g["tail_crc32"]) == (hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    odd = odd_docs(spark)
    feats = jpeg.media_features(jpeg.store_media(odd)).collect()
    assert len(feats) == odd.count() and len({r["media_sha256"] for r in feats if r["n_bytes"] == 0}) == 1
    assert jpeg.media_features(jpeg.store_media(odd.limit(0))).count() == 0
