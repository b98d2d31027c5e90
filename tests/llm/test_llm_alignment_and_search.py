"""Token alignment, license scan and ranked search against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tideline.llm import lexical_search, license_scan, queries, token_alignment

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "a", "Hello, world.", "  two  blanks ", "tab\tand\nlines\n\n\nx ", "don't I'll 'S", "<|endoftext|> </s> <unk> <0x41>", "▁under ▁", "日本語 テスト", "naïve café ½ ² Ｆｕｌｌ",
    "é ‍\U0001f469‍\U0001f4bb x", "\x00\x01 \x1f\x85    ", "a" * 3000, "ab " * 2000, "(...) --- *** $$$", "İ ı ŉ ǰ", "x" * 20 + " " + "é" * 400, "1234567890 3.14159",
]


@pytest.fixture(scope="module")
def paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def odd_texts(n: int) -> list[str | None]:
    random.seed(11)
    bits = [t for t in ODD if t] + [" ", "\n", "the ", "The", "ing", "ß", "~", "́", "<s>", "Σας", "¡", "ж", "🙂"]
    made = ["".join(random.choice(bits)[:12] + random.choice(["", " ", " ", "\n"]) for _ in range(random.randint(1, 12))) for _ in range(n)]
    return ODD + made + ["".join(chr(random.choice([random.randint(0, 127), random.randint(128, 0x2FFF)])) for _ in range(random.randint(1, 20))) for _ in range(n // 3)]


def brute_alignment(rows, paths):
    encoders = token_alignment.Encoders(*paths)
    docs, counts = [], Counter()
    for doc, text in rows:
        whole = (" " + (text or "")).encode()
        a = encoders.a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = encoders.b.encode(text) if text else []
        if not text or b"".join(encoders.a_bytes[i] for i in a) != whole or b"".join(encoders.b_bytes[i] for i in b) != whole:
            docs.append((doc, [], [], [], 0))
            continue
        ends = []
        for ids, known in ((a, encoders.a_bytes), (b, encoders.b_bytes)):
            at, own = 0, []
            for i in ids:
                own.append((at, at + len(known[i])))
                at += len(known[i])
            ends.append(own)
        common = sorted({e for _, e in ends[0]} & {e for _, e in ends[1]})
        groups, ia, ib = [], 0, 0
        for end in common:
            ga, gb = [], []
            while ia < len(a) and ends[0][ia][1] <= end:
                ga.append(a[ia])
                ia += 1
            while ib < len(b) and ends[1][ib][1] <= end:
                gb.append(b[ib])
                ib += 1
            groups.append((ga, gb))
        overlaps = sum(1 for s, e in ends[0] for t, f in ends[1] if max(s, t) < min(e, f)) if len(a) * len(b) < 500_000 else None
        docs.append((doc, a, b, groups, overlaps))
        counts.update({(x, y) for ga, gb in groups for x in ga for y in gb})
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = {}
    for doc, a, b, groups, overlaps in docs:
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        shown = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out[doc] = (len(a), len(b), len(groups), len(links), overlaps, hashlib.sha256(shown.encode()).hexdigest() if groups else "", sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links))
    return out


@pytest.mark.parametrize("block_links", [300, token_alignment.BLOCK_LINKS])
def test_alignment_is_brute_force(spark, paths, block_links):
    rows = list(enumerate(odd_texts(200)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_a", F.lit("clash")).repartition(3, "doc_id")
    found = token_alignment.aligned(docs, *paths, block_links=block_links).collect()
    assert len(found) == len(rows)
    want = brute_alignment(rows, paths)
    for r in found:
        w = want[r["doc_id"]]
        got = (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_overlaps"] if w[4] is not None else None, r["groups_sha256"], r["n_best"], r["count_sum"])
        assert got == w, rows[r["doc_id"]]


def test_alignment_query_is_brute_force(spark, paths):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = brute_alignment(rows, paths)
    found = queries.op11_token_alignment(spark, SF).collect()
    assert len(found) == len(rows)
    for r in found:
        w = want[r["doc_id"]]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"], r["n_best"], r["count_sum"]) == (*w[:4], *w[5:])


def test_alignment_of_long_text_null_ids_repeats_and_nothing(spark, paths, monkeypatch):
    long = "The words, of a long text. " * 60_000
    rows = [(1, long), (1, long), (None, "x y"), (None, "x y")]
    found = token_alignment.aligned(spark.createDataFrame(rows, "doc_id bigint, text string"), *paths).collect()
    assert sorted((r["doc_id"] or 0, r["n_a"] > 0, r["count_sum"]) for r in found)[0][:2] == (0, True)
    one = brute_alignment(rows[:1] , paths)[1]
    assert [(r["n_a"], r["n_groups"], r["groups_sha256"]) for r in found if r["doc_id"] == 1] == [(one[0], one[2], one[5])] * 2
    assert token_alignment.aligned(spark.createDataFrame([], "doc_id bigint, text string"), *paths).count() == 0


def test_products_are_plain_products():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(20):
        a, b = (rng.integers(0, 3, (rng.integers(1, 7), 5)) for _ in range(2))
        made = [token_alignment.Rows(*np.nonzero(m), m[np.nonzero(m)], *m.shape) for m in (a, b)]
        row, column, value = made[0].times(made[1].transposed())
        plain = a @ b.T
        again = np.zeros_like(plain)
        again[row, column] = value
        assert (again == plain).all()


def base_of(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    hits = [(i, label) for phrase, label in license_scan.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    places = [i for i, _ in hits]
    return len(words), len(hits), min(places, default=None), max(places, default=None), ",".join(sorted({label for _, label in hits}))


LICENSES = [
    ("Released under the MIT License.", "mit"), ("SPDX-License-Identifier: GPL-3.0-or-later", "gpl-3-or-later"), ("GNU Lesser General Public License, version 2.1 or later", "lgpl-2.1-or-later"),
    ("Licensed under the Apache License, Version 2.0", "apache-2"), ("CC-BY-SA 4.0", "cc-by-sa-4.0"), ("cc by nc", "cc-by-nc"), ("https://www.apache.org/licenses/LICENSE-2.0", "apache-2"),
    ("All rights reserved.", "all-rights-reserved"), ("License: BSD 3-Clause", "bsd-3"), ("the Mozilla Public License 2.0", "mpl-2"), ("mit dem Hund under the tree", ""), ("", ""), (None, ""),
    ("a new BSD licence", "bsd-3"), ("available under the terms of the Eclipse Public License v 2.0", "epl-2"), ("creative commons attribution noncommercial 4.0", "cc-by-nc-4.0"),
]


def test_license_labels():
    for text, want in LICENSES:
        assert license_scan.scan_text(text)[5] == want, text


def test_license_base_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(license_scan, "PART", 40)
    random.seed(2)
    bits = ["under", "THE", "the", "mit", "MIT", "license", "License,", "apache", "version", "2", "2.0", "cc", "by", "nc", "CC-BY-NC", "é", "x", "under the mit license", "-", "", "licensed under the apache license version 2"]
    for _ in range(400):
        text = random.choice([" ", "-", "\n"]).join(random.choice(bits) for _ in range(random.randint(0, 60)))
        assert license_scan.scan_text(text)[:5] == base_of(text), text
    for text, _ in LICENSES:
        assert license_scan.scan_text(("filler words here " * 30) + (text or ""))[5] == license_scan.scan_text(text)[5]


def brute_suppressed(found):
    kept = []
    for d in sorted(found, key=lambda d: (d[0], d[1], -d[2], d[3])):
        if not any(k[1] <= d[1] and k[2] >= d[2] for k in kept):
            kept.append(d)
    return sorted(kept)


def test_suppression_is_brute_force():
    random.seed(4)
    for _ in range(500):
        found = []
        for i in range(random.randint(0, 12)):
            first = random.randint(0, 12)
            found.append((random.randint(0, 3), first, first + random.randint(1, 6), i))
        assert sorted(license_scan._suppressed(found)) == brute_suppressed(found)


def test_license_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {r["doc_id"]: r for r in queries.op12_license_scan(spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert found.keys() == texts.keys()
    for doc, r in found.items():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base_of(texts[doc])
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
    rows = license_scan.scan(spark.createDataFrame([(1, None, 3), (1, "under the MIT license", 4)], "doc_id int, text string, n_words int")).collect()
    assert sorted((r["n_words"], r["labels"], len(r["detections"])) for r in rows) == [(0, "", 0), (4, "mit", 1)]
    assert license_scan.scan(spark.createDataFrame([], "doc_id int, text string")).count() == 0


def brute_search(docs, items, top=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    terms = [(doc, Counter(pattern.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or "")))) for doc, text in docs]
    n, total, df = sum(bool(c) for _, c in terms), sum(c.total() for _, c in terms), Counter()
    for _, c in terms:
        df.update(c.keys())
    out = []
    for item, text in items:
        asked = set(pattern.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or "")))
        scored = []
        for doc, c in terms:
            m = 10 + (90 * c.total() * n) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in asked if c[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank + 1, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def test_search_is_brute_force(spark, monkeypatch):
    random.seed(8)
    words = [f"w{i}" for i in range(60)] + ["É", "naïve", "X1"]
    docs = [(i, " ".join(random.choice(words) for _ in range(random.randint(0, 80)))) for i in range(300)] + [(300, None), (301, ""), (302, "..."), (5, "w1 w2"), (5, "w1 w2"), (None, "w1 w2"), (303, "w1 " * 400)]
    items = [(i, " ".join(random.choice(words) for _ in range(random.randint(1, 9)))) for i in range(25)] + [(25, None), (26, "unheard of"), (3, "w1 W1 w2")]
    index = lexical_search.build(spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("score", F.lit(1)).repartition(4))
    asked = spark.createDataFrame(items, "item_id bigint, text string").withColumn("rank", F.lit("x"))
    found = sorted((tuple(r) for r in lexical_search.search(index, asked).collect()), key=str)
    assert found == brute_search(docs, items)
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", 7)
    assert sorted((tuple(r) for r in lexical_search.search(index, asked).collect()), key=str) == found
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert lexical_search.search(lexical_search.build(empty), asked).count() == 0
    assert lexical_search.search(index, asked.limit(0)).count() == 0


def test_sketches_bound_every_score():
    random.seed(9)
    for _ in range(50):
        counts = Counter({f"t{random.randint(0, 400)}".encode(): random.choice([1, 1, 2, 7, 255, 3000]) for _ in range(random.randint(1, 200))})
        terms = [f"t{random.randint(0, 400)}".encode() for _ in range(30)]
        items = lexical_search.Items([(i, [t]) for i, t in enumerate(terms)], {t: 5000 for t in terms})
        assert (items.bounds(lexical_search.sketch(counts), 40) >= items.scores(counts, 40)).all()
