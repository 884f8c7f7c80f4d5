"""Media, fingerprints and archives on nulls, repeats, conflicting ids and clashing columns, and a decoder on streams it did not write."""

import hashlib
import struct
import zlib

import numpy as np
import xxhash

from lexweave.llm import media, simhash, warc

SCHEMA = "doc_id long, text string, media string, n_bytes int, fp long, node long, fingerprint string, component_id string"
TEXTS = [(1, "one two three four five"), (1, "other words of the same id"), (2, None), (2, None), (None, "one two three four five"), (None, ""), (3, "x " * 40_000), (4, "One TWO three four five")]


def frame(spark, rows=TEXTS):
    return spark.createDataFrame([(*r, "m", 1, 2, 3, "f", "c") for r in rows], SCHEMA)


def test_media_columns(spark):
    stored = media.store(frame(spark))
    bytes_of = {hashlib.sha256(bytes(r["media"])).hexdigest(): len(r["media"]) for r in stored.collect()}
    got = media.features(stored).collect()
    assert len(got) == len(TEXTS)
    want = {}
    for i, t in TEXTS:
        payload, n = media.payload_of(t or "")
        want.setdefault((i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])), 0)
        want[(i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))] += 1
    have = {}
    for r in got:
        key = (r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"])
        have[key] = have.get(key, 0) + 1
        assert bytes_of[r["media_sha256"]] == r["media_bytes"]
    assert have == want
    by = {}
    for r in got:
        assert by.setdefault(r["payload_sha256"], (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])


def test_long_payloads_are_several_images(monkeypatch):
    monkeypatch.setattr(media, "ROWS", 2)
    noise = np.random.default_rng(1).integers(0, 256, 192 * 5, dtype=np.uint8).tobytes()
    parts = [noise[i : i + 384] for i in range(0, len(noise), 384)]
    stream = b"".join(media.encode(parts))
    at, out = 0, []
    while at < len(stream):
        f, at = media.parse(stream, at)
        out.append(f)
    assert b"".join(t.tobytes() for t in media.thumbnails(out)) == noise


def colour_jpeg(rng, width, height, restart):
    """A 4:2:0 stream with AC coefficients, and the DC values of its luminance blocks."""
    dc_counts, dc_symbols = [0, 0, 0, 12] + [0] * 12, list(range(12))
    ac_symbols = [0x00, 0xF0, 0x01, 0x02, 0x11, 0x23, 0x51, 0x13]
    ac_counts = [0, 0, 0, 8] + [0] * 12
    dc, ac = media._codes(dc_counts, dc_symbols), media._codes(ac_counts, ac_symbols)
    across, down = -(-width // 16), -(-height // 16)
    grid = np.zeros((down * 2, across * 2), dtype=int)
    segments, bits, last = [], "", [0, 0, 0]

    def number(v, n):
        return format(v if v >= 0 else v + (1 << n) - 1, f"0{n}b") if n else ""

    def block(component, value):
        nonlocal bits
        diff = value - last[component]
        last[component] = value
        size = abs(diff).bit_length()
        bits += format(dc[size][0], f"0{dc[size][1]}b") + number(diff, size)
        k = 1
        for _ in range(int(rng.integers(0, 6))):
            symbol = int(rng.choice(ac_symbols[1:]))
            run, size = symbol >> 4, symbol & 15
            if k + run > 62:
                break
            bits += format(ac[symbol][0], f"0{ac[symbol][1]}b") + (number(int(rng.choice([-1, 1])) * int(rng.integers(1 << (size - 1), 1 << size)), size) if size else "")
            k += run + 1
        bits += format(ac[0][0], f"0{ac[0][1]}b")

    def flush():
        nonlocal bits
        bits += "1" * (-len(bits) % 8)
        segments.append(bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00"))
        bits, last[:] = "", [0, 0, 0]

    for unit in range(across * down):
        if unit and restart and unit % restart == 0:
            flush()
        y, x = divmod(unit, across)
        for v in range(2):
            for h in range(2):
                value = int(rng.integers(-60, 60))
                grid[2 * y + v, 2 * x + h] = value
                block(0, value)
        block(1, int(rng.integers(-60, 60)))
        block(2, int(rng.integers(-60, 60)))
    flush()
    data = segments[0] + b"".join(bytes([0xFF, 0xD0 + i % 8]) + s for i, s in enumerate(segments[1:]))
    s = media._segment
    stream = b"\xff\xd8" + s(0xE0, b"JFIF\0" + bytes(9)) + s(0xDB, bytes([0, 16] + [1] * 63)) + s(0xC0, struct.pack(">BHHB", 8, height, width, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    stream += s(0xC4, bytes([0, *dc_counts, *dc_symbols])) + s(0xC4, bytes([0x10, *ac_counts, *ac_symbols])) + (s(0xDD, struct.pack(">H", restart)) if restart else b"")
    stream += s(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + data + b"\xff\xd9"
    return stream, np.clip(np.round(grid * 16 / 8) + 128, 0, 255).astype(np.uint8)[: -(-height // 8), : -(-width // 8)]


def test_decoder_reads_colour_subsampling_and_ac():
    rng = np.random.default_rng(3)
    for width, height, restart in ((40, 24, 0), (64, 48, 2), (17, 9, 1), (200, 100, 5)):
        stream, want = colour_jpeg(rng, width, height, restart)
        frame_, end = media.parse(stream)
        assert end == len(stream) and (frame_["width"], frame_["height"]) == (width, height)
        assert (media.thumbnails([frame_])[0] == want).all()


def test_fingerprints_of_odd_rows(spark):
    got = simhash.near_groups(frame(spark)).collect()
    assert len(got) == len(TEXTS)
    by = {}
    for r in got:
        by.setdefault(r["fingerprint"], set()).add(r["component_id"])
    assert all(len(x) == 1 for x in by.values())
    words = "one two three four five".split()
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), seed=42) for i in range(2)]
    fp = format(h[0] & h[1], "016x")
    assert by[fp] == {1} and by["0" * 16] == {2}
    alone = simhash.near_groups(frame(spark, [(None, "a b c")])).collect()
    assert alone[0]["component_id"] is None and len(alone) == 1


def test_keys_crowded_with_ball_members(spark, monkeypatch):
    """Fingerprints above a rare key meet it, though their own keys are cut."""
    monkeypatch.setattr(simhash, "BLOCK", 4)
    rare = 0
    crowd = [(1 << 42) | x for x in range(1, 40)]
    nodes = spark.createDataFrame([(rare, 0), *[(x, i + 1) for i, x in enumerate(crowd)]], "fp long, node long")
    edges = {(r["a"], r["b"]) for r in simhash.near_links(nodes).collect()}
    ids = {i + 1: x for i, x in enumerate(crowd)} | {0: rare}
    assert all((ids[a] ^ ids[b]).bit_count() <= 4 for a, b in edges)
    group = {i: i for i in ids}
    for _ in ids:
        for a, b in edges:
            group[a] = group[b] = min(group[a], group[b])
    near = {i: i for i in ids}
    for _ in ids:
        near = {i: min(near[j] for j in ids if (ids[i] ^ ids[j]).bit_count() <= 4) for i in ids}
    assert group == near


def test_archives_of_odd_rows(spark):
    long, tie = "é" * 600, "t" * 1000
    rows = [(1, "http://a/", long), (1, "http://a/", long), (2, None, long), (None, "http://n/", long), (3, "", None), (4, "http://b/\n x", ""), (5, "http://c/", "s"), (6, "http://d/", "s"), (7, "u", tie), (8, "u", tie)]
    pages = spark.createDataFrame([(*r, "d", "x", 1) for r in rows], "page_id long, url string, html string, digest string, payload string, n_bytes int")
    got = warc.archive_round_trip(spark, pages).collect()
    assert len(got) == len(rows) and all(r["intact"] for r in got)
    kinds = {}
    for r in got:
        kinds.setdefault(r["page_id"], set()).add((r["record_type"], r["refers_to"]))
    assert kinds[1] == {("revisit", 2)} == kinds[None] and kinds[2] == {("response", None)} and kinds[7] == {("revisit", 8)} and kinds[8] == kinds[5] == kinds[6] == kinds[3] == {("response", None)}
    assert {r["payload_digest"] for r in got if r["page_id"] in (3, 4)} == {hashlib.sha1(b"").hexdigest()}
    assert warc.archive_round_trip(spark, pages.limit(0)).count() == 0


def test_rows_without_an_id_link_others(spark, monkeypatch):
    """Groups against brute force, run again and again: null ids 1 to 4 bits from others, ids above 2^53 beside them."""
    import random

    rng = random.Random(9)
    rows = []
    for g in range(12):
        base = rng.getrandbits(64)
        big = (1 << 60) + 1 + 10 * g
        near = [base ^ sum(1 << b for b in rng.sample(range(64), k)) for k in (1, 2, 3, 2)]
        rows += [(None, base), (big, near[0]), (big + 2, near[1]), (7 + g if g % 2 else None, near[2]), (None, near[3])]
    rows += [(None, rng.getrandbits(64)), (3, rng.getrandbits(64)), (3, rows[0][1])]
    signed = [(i, fp - (1 << 64) if fp >> 63 else fp) for i, fp in rows]
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            if (rows[x][1] ^ rows[y][1]).bit_count() <= 4:
                group[root(x)] = root(y)
    smallest = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            smallest[root(x)] = min(i, smallest.get(root(x), i))
    key = lambda r: tuple((v is None, v) if not isinstance(v, str) else (False, v) for v in r)
    want = sorted(((i, format(fp, "016x"), smallest.get(root(x))) for x, (i, fp) in enumerate(rows)), key=key)
    monkeypatch.setattr(simhash, "fingerprints", lambda documents: documents)
    docs = spark.createDataFrame(signed, "doc_id long, fp long")
    for seed in range(4):
        got = [tuple(r) for r in simhash.near_groups(docs.repartition(1 + seed)).collect()]
        assert sorted(got, key=key) == want
