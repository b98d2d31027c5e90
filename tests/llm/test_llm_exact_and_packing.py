"""Exact duplicates, archives, packing and mixing on small tables, against plain Python."""

import hashlib
import io
import random
import struct
import zipfile
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tideline.llm import exact_dedup, packing, source_mixing, warc_zip

TEXTS = [
    (1, "a b c"), (2, "abc"), (3, "a b  c "), (4, None), (5, ""), (6, "\t\n"), (7, "\u00a0"), (8, "x" * 200_000), (9, " " + "x" * 200_000),
    (10, "solo"), (11, "abc"), (11, "abc"), (None, "null id"), (None, "solo "), (12, "\u00e9"), (13, "e\u0301"),
]


def documents(spark, rows=TEXTS):
    return spark.createDataFrame([(d, t, "s", "k", 1.5) for d, t in rows], "doc_id bigint, text string, source string, key string, digest double")


def squeezed(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


def test_directory_doubles_and_finds_every_key():
    directory, rng = exact_dedup.Directory(capacity=4), random.Random(3)
    keys = [rng.getrandbits(64) - (1 << 63) for _ in range(3000)] + [1 << k for k in range(62)]
    for k in keys:
        directory.chain(k).append(k)
    assert directory.depth > 6 and all(directory.chain(k) == [k] for k in keys)
    buckets = list(directory.buckets())
    assert all((len(b["chains"]) <= 4 or b["depth"] == exact_dedup.MAX_DEPTH) and b["depth"] <= directory.depth for b in buckets)
    assert sum(len(b["chains"]) for b in buckets) == len(keys)
    assert all((k & ((1 << b["depth"]) - 1)) == b["low"] for b in buckets for k in b["chains"])


def test_equal_keys_are_chained_by_bytes(spark, monkeypatch):
    import pyarrow as pa

    rows = [(7, 0, 1, 5, 1, b"one"), (7, 0, 2, 3, 1, b"two"), (7, 0, 3, 9, 2, b"one")]
    batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), exact_dedup._ENTRY)], schema=exact_dedup._ENTRY)
    found = {(r["chain"], r["keep_id"], r["group_size"]) for b in exact_dedup._own([batch]) for r in b.to_pylist()}
    assert found == {(0, 3, 3), (1, 2, 1)}


def test_exact_classes_agree_with_grouping(spark):
    groups = defaultdict(list)
    for d, t in TEXTS:
        groups[squeezed(t)].append((-len(t or ""), d is None, d))
    want = []
    for d, t in TEXTS:
        keep = min(groups[squeezed(t)], key=lambda g: (g[0], g[1], g[2] or 0))[2]
        want.append((d, keep, len(groups[squeezed(t)]), d == keep, hashlib.sha256(squeezed(t).encode()).hexdigest()))
    got = [tuple(r) for r in exact_dedup.classes(documents(spark)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_exact_dedup_keeps_columns_and_empty_tables(spark):
    kept = exact_dedup.deduplicated(documents(spark))
    assert kept.columns == ["doc_id", "text", "source", "key", "digest"]
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["12", "13", "3", "6", "7", "9", "None", "None"]
    assert exact_dedup.classes(documents(spark).limit(0)).count() == 0


def test_one_id_with_two_texts_loses_only_the_copy(spark):
    rows = [(1, "same"), (5, "same"), (5, "other")]
    assert sorted((r["doc_id"], r["text"]) for r in exact_dedup.deduplicated(documents(spark, rows)).collect()) == [(1, "same"), (5, "other")]


PAGES = [(1, "http://a", "<p>" + "x" * 200), (2, None, "<p>" + "x" * 200), (3, "u\r\nv", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (None, "u", "ñ" * 300), (8, "u", "y" * 3_000_000), (2, "again", "<p>" + "x" * 200)]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(p, u, h, "clash") for p, u, h in rows], "page_id bigint, url string, html string, payload string")


def test_archives_round_trip(spark):
    got = {(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc_zip.round_trip(pages(spark)).collect()}
    want = set()
    for p, _, h in PAGES:
        raw = (h or "").encode()
        same = sorted(q for q, _, g in PAGES if g == h and q is not None)
        revisit = len(raw) >= 100 and bool(same) and p != same[0]
        want.add((p, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", same[0] if revisit else None))
    assert got == want and warc_zip.round_trip(pages(spark)).count() == len(PAGES)
    assert warc_zip.round_trip(pages(spark).limit(0)).count() == 0


def test_payloads_come_back_whole(spark, tmp_path):
    warc_zip.write_packages(pages(spark), f"file://{tmp_path}/w", package_bytes=1000)
    back = {r["page_id"]: r["payload"] for r in warc_zip.read_packages(spark, f"file://{tmp_path}/w", with_payload=True).filter("record_type = 'response'").collect()}
    assert back[8] == b"y" * 3_000_000 and back[None] == ("ñ" * 300).encode() and back[5] == b""


def reader(raw):
    return lambda start, length: raw[start : start + length]


def test_directory_of_plain_zip64_and_commented_packages():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", b"first")
        z.writestr("ü.txt", b"second" * 10)
        z.comment = b"PK\x05\x06 in a comment"
    raw = out.getvalue()
    found = {m.name: m for m in warc_zip.members(reader(raw), len(raw))}
    start = warc_zip.stored_start(reader(raw), found["ü.txt"])
    assert raw[start : start + found["ü.txt"].size] == b"second" * 10
    # The same entries with every value moved to the ZIP64 fields.
    body, central, at = b"", b"", []
    for name, data in ((b"x", b"12345"), (b"y", b"678")):
        at.append(len(body))
        body += struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0, 0, 0, 0, zlib.crc32(data), 0xFFFFFFFF, 0xFFFFFFFF, 1, 20) + name + struct.pack("<HHQQ", 1, 16, len(data), len(data)) + data
        extra = struct.pack("<HHB", 9, 1, 0) + struct.pack("<HHQQQ", 1, 24, len(data), len(data), at[-1])
        central += struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, zlib.crc32(data), 0xFFFFFFFF, 0xFFFFFFFF, 1, len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    end = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 2, 2, len(central), len(body))
    raw = body + central + end + struct.pack("<4sIQI", b"PK\x06\x07", 0, len(body) + len(central), 1) + struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    found = warc_zip.members(reader(raw), len(raw))
    assert [(m.name, raw[warc_zip.stored_start(reader(raw), m) :][: m.size]) for m in found] == [("x", b"12345"), ("y", b"678")]
    with pytest.raises(ValueError):
        warc_zip.members(reader(raw[:-30]), len(raw) - 30)


def test_open_bins_take_the_tightest_fit_and_close_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 5, 4, 5)] == [(0, 0), (1, 0), (0, 6), (1, 5)]
    assert [bins.place(n) for n in (7, 9, 8)] == [(2, 0), (3, 0), (4, 0)] and bins.count == 2
    assert bins.place(2) == (4, 8) and bins.place(3) == (2, 7)


def test_packing_agrees_with_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(1)
    rows = [(1, None), (2, ""), (3, "Hello, World. It's 3.5 <|endoftext|> ΑΣ. İx y\x1cz"), (3, "again"), (4, "word " * 9000), (None, "null")]
    rows += [(10 + i, " ".join(rng.choice(["ab", "Éa,", "the.", "\tq", "naïve"]) for _ in range(rng.randint(1, 300)))) for i in range(60)]
    got = packing.packed(documents(spark, rows), path, shard_pieces=40).collect()
    library = Tokenizer.from_file(path)
    want = []
    for d, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for k, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            want.append((d, k, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(map(str, ((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got))) == sorted(map(str, want))
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and sum(places[-1]) <= 4096
    assert len(sequences) <= -(-sum(w[3] for w in want) // 4096) + 3
    assert packing.packed(documents(spark).limit(0), path).count() == 0


def mixture(spark, rows):
    return spark.createDataFrame([(d, t, s, 0, 0) for d, t, s in rows], "doc_id bigint, text string, source string, tokens int, block int")


def test_mixing_meets_limit_and_budget(spark):
    rows = [(i, "w " * (1 + i % 7), "big") for i in range(2000)] + [(5000 + i, "w w", "small") for i in range(100)] + [(9000, None, None), (9001, "w", None), (9001, "w", None), (9002, "", "empty")]
    docs = mixture(spark, rows)
    placed = source_mixing.placed(docs, max_repeats=3.0, block_tokens=64).cache()
    size, used = defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        size[s] += len((t or "").split())
    for r in placed.collect():
        used[r["source"]] += r["tokens"]
    assert used["big"] == size["big"] and used["empty"] == 0 and placed.filter("source = 'empty'").count() == 1
    assert all(size[s] <= used[s] <= 3 * size[s] for s in size) and used["small"] > size["small"]
    times = placed.groupBy("source", "doc_id").count()
    assert times.filter("source = 'small'").agg({"count": "max"}).first()[0] - times.filter("source = 'small'").agg({"count": "min"}).first()[0] <= 1
    assert source_mixing.mixed(docs, max_repeats=3.0).columns == docs.columns
    fixed = source_mixing.placed(docs, budget=1000, max_repeats=100.0, block_tokens=64)
    assert 0.9 * 1000 <= fixed.agg({"tokens": "sum"}).first()[0] <= 1000
    assert source_mixing.placed(docs.limit(0)).count() == 0 and source_mixing.placed(mixture(spark, [(1, None, "a")])).count() == 1


def test_exponent_meets_entropy(spark):
    totals = spark.createDataFrame([("a", 1000), ("b", 100), ("c", 10)], "source string, tokens bigint").selectExpr("*", "tokens / 1110D AS share")
    found = source_mixing.exponent(totals, 0.9, 1e9)
    p = np.array([1000, 100, 10]) / 1110

    def entropy(a):
        w = p**a / (p**a).sum()
        return -(w * np.log(w)).sum()

    assert entropy(found) <= 0.9 < entropy(found - 2e-6)
    assert source_mixing.exponent(totals, 9.0, 1e9) == 0.0 and source_mixing.exponent(totals, 0.0, 1e9) == 1.0
