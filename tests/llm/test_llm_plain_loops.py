"""Scores and spans of the trained models against plain loops over whole texts; ids of packed texts against the library."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import language_id, packing, quality_cnn, queries, secret_scan
from tideline.llm.columns import crc_mod, table

SF = "/root/testdata/sf0.001"


def plain_language(model, text):
    """One window after the other, hashed by hand."""
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0
    raw = language_id._letters(text)
    total, n = np.zeros(len(model.langs)), 0
    for width, factor, mixed in ((3, 2654435761, 0), (4, 2246822519, 0x9E3779B9)):
        for at in range(len(raw) - width + 1):
            value = int.from_bytes(raw[at : at + width], "little")
            total += model.table[(((value ^ mixed) * factor) & 0xFFFFFFFF) >> 17]
            n += 1
    z = (total / n + model.bias) / model.temperature
    p = np.exp(z - z.max())
    p /= p.sum()
    return model.langs[int(p.argmax())], float(p.max())


def test_language_query_is_a_plain_loop(spark):
    docs = table(spark, SF, "documents")
    model = language_id.train(docs, crc_mod("doc_id", 3) != 1)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = queries.op2_language_id(spark, SF).collect()
    assert len(found) == len(texts)
    for r in found:
        name, score = plain_language(model, (texts[r["doc_id"]] or "")[:3000]) if len(texts[r["doc_id"]] or "") <= 3000 else (r["lang_pred"], r["score"])
        assert r["lang_pred"] == name and math.isclose(r["score"], score, abs_tol=1e-4)


@pytest.mark.parametrize("text", ["½ ² ①", "12 34", "_ - _", "", None, "́"])
def test_no_letter_is_no_language(text):
    model = language_id.fit(["the cat", "der hund"] * 20, ["en", "de"] * 20)
    assert model.predict([text]) == (["und"], [0.0])


def test_every_language_is_learnt_and_copies_count_once(spark):
    rng = random.Random(3)
    names = [f"l{i:02d}" for i in range(70)]
    rows = [(" ".join(chr(97 + (i * 7 + k) % 26) * 3 + chr(97 + i % 26) + str(i) + chr(0x4E00 + i) for k in (rng.randrange(9) for _ in range(30))), name) for i, name in enumerate(names) for _ in range(12)]
    docs = spark.createDataFrame(rows + [rows[0]] * 5000, "text string, lang string")
    assert language_id.train(docs, F.lit(True)).langs == names


def plain_quality(model, raw):
    live = []
    at = 0
    while True:
        chunk = raw[at : at + quality_cnn.CHUNK].ljust(quality_cnn.CHUNK, b"\0")
        out = np.full(quality_cnn.FILTERS, -np.inf)
        for s in range(0, quality_cnn.CHUNK - quality_cnn.SPAN + 1, quality_cnn.STRIDE):
            window = np.concatenate([model.embed[b] for b in chunk[s : s + quality_cnn.SPAN]])
            out = np.maximum(out, window @ model.filters)
        live.append(np.maximum(out + model.shift, 0))
        if at + quality_cnn.CHUNK >= len(raw):
            break
        at += quality_cnn.STEP
    pooled = np.concatenate([np.max(live, 0), np.mean(live, 0)])
    return 1 / (1 + math.exp(-float(pooled @ model.out + model.bias)))


def test_quality_query_is_a_plain_loop(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = quality_cnn.train(docs.select("doc_id", "text"), labels.select("doc_id", "quality"), crc_mod("doc_id", 4) != 2)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    found = queries.op3_quality_classifier(spark, SF).collect()
    assert len(found) == len(texts)
    for r in found[:40]:
        if model.constant is None and len(texts[r["doc_id"]]) < 6000:
            assert math.isclose(r["score"], plain_quality(model, texts[r["doc_id"]].encode()), abs_tol=1e-3)


def plain_random(model, token):
    """Spans of one run, every stretch tried."""
    whole = token.rstrip(".=-_/+")
    if len(whole) < secret_scan.MIN_LENGTH:
        return []
    ratio = [float(x) for x in model.ratio[secret_scan._transitions(whole)]]
    if np.mean(ratio) > model.threshold:
        return [(0, len(whole))]
    import re

    parts = [m.span() for m in re.finditer("[A-Za-z0-9+]{16,}", whole) if model.score(m.group()) > model.threshold]
    found, edges, at = list(parts), [*parts, (len(whole), len(whole))], 0
    for start, end in edges:
        todo = [(at, start)] if start - at >= secret_scan.MIN_LENGTH else []
        own = [float(x) - model.stretch for x in model.ratio[secret_scan._transitions(whole[at:start])]] if todo else []
        while todo:
            low, high = todo.pop()
            options = [(sum(own[i - at : j - at]), j, i) for i in range(low, high) for j in range(i + secret_scan.MIN_LENGTH, high + 1)]
            if not options:
                continue
            gain = max(o[0] for o in options)
            if gain <= 1e-9:
                continue
            j = min(o[1] for o in options if o[0] > gain - 1e-9)
            i = min(o[2] for o in options if o[0] > gain - 1e-9 and o[1] == j)
            todo += [(low, i), (j, high)]
            while j - i > secret_scan.MIN_LENGTH and whole[j - 1] in ".=-_/+":
                j -= 1
            while j - i > secret_scan.MIN_LENGTH and whole[i] in ".=-_/":
                i += 1
            found.append((i, j))
        at = end
    return sorted(found)


def model_of_texts(spark):
    return secret_scan.train(table(spark, "/root/testdata/sf0.01", "documents"))


def test_random_spans_are_a_plain_loop(spark):
    model = model_of_texts(spark)
    rng = random.Random(5)
    for _ in range(300):
        some = [rng.choice(secret_scan.COMMON) if rng.random() < 0.7 else "".join(rng.choices(secret_scan._CLASSES[:62], k=rng.randint(5, 30))) for _ in range(rng.randint(1, 5))]
        token = "".join(s + rng.choice("/_-.=+") for s in some)
        assert sorted(model.random_spans(token)) == plain_random(model, token), token


ORDINARY = (
    "//www.wikipedia.org/wiki/Kubernetes //github.com/apache/spark //example.com/a/b/c v1.2.3-rc.1+build.20240101 IMG_20240101_123456_HDR.jpg /usr/lib/x86_64-linux-gnu/libstdc++.so.6 "
    "2024/01/01/2024/01/02 aaaaaaaaaaaaaaaaaaaaaaaa internationalization com.google.common.collect.ImmutableList node_modules/react-dom/index.js 192.168.100.200.255 "
    "www.nytimes.com/2023/05/06/world/europe getElementsByClassName AbstractSingletonProxyFactoryBean 0000000000000000000000 ---------------------- ==================== content/uploads/2020/03/holiday-photo-17.jpeg"
).split()


def test_ordinary_runs_are_no_secrets(spark):
    model = model_of_texts(spark)
    assert [t for t in ORDINARY if model.random_spans(t)] == []
    # Words that the model has not seen, in runs as they are written.
    texts = [r["text"] for r in table(spark, "/root/testdata/sf0.1", "documents").filter("text IS NOT NULL").limit(2000).collect()]
    seen = set().union(*(secret_scan.labelled(r["text"] or "")[0] for r in table(spark, "/root/testdata/sf0.01", "documents").collect()))
    unseen = sorted(set().union(*(secret_scan.labelled(t)[0] for t in texts)) - seen)
    runs = [r for r in secret_scan.ordinary_identifiers(unseen, 6000, random.Random(6)) if len(r) >= secret_scan.MIN_LENGTH]
    assert len(unseen) > 1000 and np.mean([bool(model.random_spans(r)) for r in runs]) < 0.01
    secrets = secret_scan.random_strings(4000, random.Random(7))
    assert np.mean([bool(model.random_spans(s)) for s in secrets]) > 0.95


def test_packed_ids_of_20000_odd_strings_are_the_librarys():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    words, library = packing.Words(path, 1 << 20), Tokenizer.from_file(path)
    rng = random.Random(5)
    bits = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|startoftext|>", "İ", "İ,", "İ.", "'s", "'S", "don't", "I'll", "ſ", "ß", "ß.", "é,", "K", "Å", "́", "̸", "=", ",", ".", "!?", "$$$", "%", "_", "-", "...", "'", '"', "1", "23",
            "½", "Σ", "ας", "日本", "語", "‍", "👩‍💻", "\x0b", "\x0c", " ", " ", "\x1f", "\x85", "<|", "|>", "a", "B", "foo", "HTTP", "ı", "ŉ", "Ａ", "ﬁ", "\x00", "�", "'re", "'VE"]
    for n in range(20_000):
        text = "".join(rng.choice(bits) + rng.choice(["", "", " ", "\n", "\t"]) for _ in range(rng.randint(1, 14)))
        if n % 4 == 0:
            text = "".join(chr(rng.choice([rng.randint(0, 127), rng.randint(128, 0x2FFF)])) for _ in range(rng.randint(1, 25)))
        got = np.frombuffer(b"".join(packing._encoded(words, [text.encode()])), "<u4").tolist()
        assert got == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_long_texts_are_packed_part_by_part(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(packing, "PART", 200)
    texts = ["The quick, brown fox. " * 40, "x" * 1000, "", "one two " * 20, "a\nb\tc " * 200]
    words, library = packing.Words(path), Tokenizer.from_file(path)
    assert [np.frombuffer(r, "<u4").tolist() for r in packing._encoded(words, [t.encode() for t in texts])] == [library.encode(t, add_special_tokens=False).ids for t in texts]
