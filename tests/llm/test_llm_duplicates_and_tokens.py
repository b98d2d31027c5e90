"""Near duplicates, vectors, token counts and the pipeline, against brute force and the public libraries."""

import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from tideline.llm import queries, token_counts, vector_neardup, weighted_minhash as M


def united(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def corpus():
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [[rng.choice(vocabulary) for _ in range(rng.randint(40, 200))] for _ in range(60)]
    shared = [rng.choice(vocabulary) for _ in range(60)]
    for k in range(25):  # one passage in many texts that differ otherwise
        rows.append([rng.choice(vocabulary) for _ in range(60)] + shared)
    for k in range(60):  # a large group whose members are edited at one to four places
        words = list(rows[0] + rows[1])
        for _ in range(rng.randint(1, 4)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append(words)
    for k in range(30):
        words = list(rows[10 + k])
        words[rng.randrange(len(words))] = "edited"
        rows.append(words)
    texts = [" ".join(w) for w in rows]
    texts += [texts[3].upper(), texts[3].replace(" ", ",  "), "one two", "One, two.", "one", None, "", "...", None, "long " * 400_000]
    return [(i + 1, t, "clash", 0) for i, t in enumerate(texts)]


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, digest string, key int")


def brute(rows):
    words = M.word_hashes([t or "" for _, t, *_ in rows])
    found = [M.shingles(w) for w in words]
    frequency = defaultdict(int)
    for s, _ in found:
        for h in s.tolist():
            frequency[h] += 1
    common = {h: n for h, n in frequency.items() if n >= len(rows) / M.RARE}
    weigh = M.Weights(np.array(list(common), np.uint64), np.array(list(common.values()), float), len(rows))
    vectors = [(s, weigh(s, n)) for s, n in found]
    pairs = []
    for a, b in combinations(range(len(rows)), 2):
        if len(words[a]) and len(words[b]) and (np.array_equal(words[a], words[b]) or M.similarity(vectors[a], vectors[b]) >= 0.8):
            pairs.append((rows[a][0], rows[b][0]))
    return united([r[0] for r in rows], pairs)


def test_near_duplicates_by_brute_force(spark):
    rows = corpus()
    got = {r["doc_id"]: r["class_id"] for r in M.classes(docs_of(spark, rows)).collect()}
    assert got == brute(rows)
    kept = M.deduplicated(docs_of(spark, rows))
    assert kept.columns == ["doc_id", "text", "digest", "key"] and kept.count() == len(set(got.values()))


def test_near_duplicates_of_a_hub_among_heavier_edits(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(5000)]
    original = [rng.choice(vocabulary) for _ in range(240)]
    rows = [(1, " ".join(original), "", 0)]
    for k in range(1200):  # 60 copies that are near to the original alone, the others near to nothing
        words = list(original)
        for at in rng.sample(range(5, 235), 3 if k < 60 else 7):
            words[at] = f"e{k}x{at}"
        rows.append((k + 2, " ".join(words), "", 0))
    got = {r["doc_id"]: r["class_id"] for r in M.classes(docs_of(spark, rows)).collect()}
    words = M.word_hashes([r[1] for r in rows])
    weights = M.weights(docs_of(spark, rows))
    vectors = [(s, weights(s, n)) for s, n in map(M.shingles, words)]
    near = {r[0] for r, v in zip(rows, vectors) if M.similarity(vectors[0], v) >= 0.8}
    assert len(near) > 50 and all(got[d] == (1 if d in near else d) for d in got)


def test_outlines_bound_the_similarity():
    rng = np.random.default_rng(4)
    few = []
    for k in range(60):
        base = np.unique(rng.integers(1, 1 << 62, 40 if k % 2 else 3000).astype(np.uint64))
        cut = int(len(base) * rng.uniform(0, 0.3))
        weight = rng.choice([1.0, 1.3, 2.0, 9.1], len(base))
        few.append([(base[cut:], weight[cut:]), (base[: len(base) - cut // 2], weight[: len(base) - cut // 2])])
    rows = [(i, i, -1, float(w.sum()), M.outline(s, w)) for i, (s, w) in enumerate(v for pair in few for v in pair)]
    vectors = [v for pair in few for v in pair]
    true = {(a, b) for a, b in combinations(range(len(rows)), 2) if M.similarity(vectors[a], vectors[b]) >= 0.6}
    found = set(M.possible(rows, rows, 0.6))
    assert len(true) > 30 and true <= found and len(found) < 2 * len(true)


def test_near_duplicates_of_odd_rows(spark):
    rows = [(None, "a b c d e f g", "", 0), (7, "a b c d e f g", "", 0), (7, "a b c d e f g", "", 0), (3, "x y", "", 0), (3, "other text altogether", "", 0)]
    got = sorted(map(str, ((r["doc_id"], r["class_id"], r["kept"]) for r in M.classes(docs_of(spark, rows)).collect())))
    assert got == sorted(map(str, [(None, 7, False), (7, 7, True), (7, 7, True), (3, 3, True), (3, 3, True)]))
    assert M.classes(docs_of(spark, rows).limit(0)).count() == 0


def test_words_and_counters_do_not_depend_on_pieces(spark, monkeypatch):
    texts = [t or "" for _, t, *_ in corpus()[:80]] + ["é " * 50, "x" * 500]
    whole = M.word_hashes(texts)
    monkeypatch.setattr(M, "PIECE", 700)
    assert all(np.array_equal(a, b) for a, b in zip(whole, M.word_hashes(texts)))
    monkeypatch.undo()
    rows = corpus()
    few, many = M.weights(docs_of(spark, rows), counters=64), M.weights(docs_of(spark, rows))
    assert np.array_equal(few.common, many.common) and np.array_equal(few.share, many.share)


def test_samples_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    agreed, true = [], []
    for _ in range(60):
        base = np.unique(rng.integers(1, 1 << 62, 300).astype(np.uint64))
        left, right = base[:250], base[50:]
        a, b = rng.uniform(1, 3, len(left)), rng.uniform(1, 3, len(right))
        agreed.append((M.samples(left, a) == M.samples(right, b)).mean())
        true.append(M.similarity((left, a), (right, b)))
    assert abs(np.mean(agreed) - np.mean(true)) < 0.02


def vectors(spark):
    rng = np.random.default_rng(5)
    rows, centre = [], rng.normal(size=(6, 12))
    for i in range(500):
        noise = rng.normal(size=12) * rng.choice([0.02, 0.08, 0.5])
        rows.append((i, [float(x) for x in centre[i % 6] + noise], int(i % 2)))
    rows += [(1000, None, 0), (1001, [0.0] * 12, 0), (1002, [float("nan")] + [1.0] * 11, 0), (1003, [None] + [1.0] * 11, 0), (1004, rows[0][1], None), (1005, rows[0][1][:5], 0), (1006, [float("inf")] * 12, 0)]
    rows += [(0, rows[0][1], 0), (None, rows[0][1], 0)]
    return rows, spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")


def linked_pairs(rows):
    good = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.setdefault((i, label), np.array(v, float))
    pairs = set()
    for (a, la), (b, lb) in combinations(good, 2):
        u, w = good[a, la], good[b, lb]
        if la == lb and len(u) == len(w) and u @ w / np.sqrt((u @ u) * (w @ w)) >= 0.98:
            pairs.add((a, b))
    return pairs


@pytest.mark.parametrize("shard_bytes, block", [(1 << 24, 4096), (6000, 70)])
def test_vectors_by_brute_force(spark, shard_bytes, block):
    rows, df = vectors(spark)
    pairs = linked_pairs(rows)
    classes = united([r[0] for r in rows if r[0] is not None], pairs)
    count = defaultdict(int)
    for a, b in pairs:
        count[a] += 1
        count[b] += 1
    got = vector_neardup.components(df, shard_bytes=shard_bytes, block=block).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["vec_id"] is None and r["n_links"] == 0 or (r["n_links"], r["component_id"]) == (count[r["vec_id"]], classes[r["vec_id"]])
        assert r["kept"] == (r["vec_id"] == r["component_id"])
    assert vector_neardup.components(df.limit(0)).count() == 0


def test_graph_recall_and_pack():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    vectors_ = np.concatenate([base[rng.integers(0, 40, 1800)] + rng.normal(size=(1800, 16)) * 0.05, rng.normal(size=(700, 16))])
    graph = vector_neardup.Graph.unpack(vector_neardup.build(np.arange(2500), vectors_).pack())
    assert len(graph.layers) > 1
    found, true = len(graph.similar(graph.unit, 0.98, 64)[0]), len(graph.exact(graph.unit, 0.98)[0])
    assert true >= found >= 0.97 * true > 10_000


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return token_counts.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"))


def odd_texts(vocabulary, n):
    rng = random.Random(9)
    pieces = list(vocabulary.score)
    texts = ["", "a", " a", "a  b", "  ", "\n", "a \n b", "▁x", "x▁", "<s>hi</s>", "a\x00b", "日本語のテキスト" * 40, "éé", "👍🏽", "b" * 3000, " " * 100]
    for _ in range(n):
        texts.append("".join(rng.choice(pieces) for _ in range(rng.randint(1, 7))).replace("▁", " "))
        letters = rng.choice(["abcdeinorst ", "ab ", "ehrtsi\n", "0123456789 .", "<>/|=_ \t\n", "éèàüöñß aen"])
        texts.append("".join(rng.choice(letters) for _ in range(rng.randint(1, 80))))
    return texts


@pytest.mark.parametrize("lanes, chunk, cells", [(2048, 512, 1 << 25), (3, 5, 1 << 25), (4, 32, 40_000)])
def test_token_counts_agree_with_the_library(vocabulary, monkeypatch, lanes, chunk, cells):
    monkeypatch.setattr(token_counts, "LANES", lanes)
    monkeypatch.setattr(token_counts, "CHUNK", chunk)
    texts = odd_texts(vocabulary, 700 if lanes > 4 else 60)
    machine = token_counts.Transducer(vocabulary, cells)
    assert machine.counts(texts).tolist() == [len(x) for x in vocabulary.library.encode(texts)]
    assert machine.counts([]).tolist() == [] and machine.counts(["", ""]).tolist() == [0, 0]


def test_token_counts_of_documents(spark, vocabulary):
    import public_tokenizers

    rows = queries.QUERIES["op10_token_counts"](spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        n = len(vocabulary.library.encode(texts[r["doc_id"]]))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 4096)
    odd = spark.createDataFrame([(1, None, 5), (1, "", 6), (None, "x y", 7)], "doc_id bigint, text string, n_tokens int")
    path = public_tokenizers.path("piece_bpe_32k.model")
    assert [r["n_tokens"] for r in token_counts.with_counts(odd, path, 1).collect()] == [0, 0, 2]
    assert token_counts.with_counts(odd.limit(0), path, 1).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    assert [k for k, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "minhash_neardup", "source_mixing", "best_fit_packing"]
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    extra = spark.createDataFrame([(900_001, None, "en", "src1", 0), (900_002, "12 345", None, None, 6), (900_003, docs.first()["text"] + " ", "en", None, 1)], docs.schema)
    rows = docs.union(extra)
    columns, seen = rows.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, rows, folder).write.parquet(f"{tmp_path}/{k}")
        rows = spark.read.parquet(f"{tmp_path}/{k}")
        assert name == "best_fit_packing" or rows.columns == columns
        seen[name] = rows
    ids = {name: [r["doc_id"] for r in df.select("doc_id").collect()] for name, df in seen.items()}
    assert not {900_001, 900_002} & set(ids["language_id"]) and len(ids["language_id"]) >= 0.99 * docs.count()
    whole = {r["doc_id"]: "".join(r["text"].split()) for r in seen["language_id"].collect()}
    assert len(ids["exact_dedup"]) == len(set(whole.values()))
    inputs = [(r["doc_id"], r["text"]) for r in seen["exact_dedup"].collect()]
    assert set(ids["minhash_neardup"]) == set(brute(inputs).values())
    assert set(ids["source_mixing"]) == set(ids["minhash_neardup"]) == set(ids["best_fit_packing"])
    assert seen["best_fit_packing"].groupBy("sequence_id").agg({"length": "sum"}).filter("`sum(length)` > 4096").count() == 0


def test_near_copies_of_texts_that_share_or_lack_an_id_are_linked(spark):
    rng = random.Random(12)

    def text(seed):
        own = random.Random(seed)
        return [f"v{own.randrange(4000)}" for _ in range(200)]

    def edited(words):
        words = list(words)
        words[rng.randrange(50, 150)] = "edited"
        return " ".join(words)

    a, b, c = text(1), text(2), text(3)
    rows = [(5, " ".join(a)), (5, " ".join(b)), (8, edited(a)), (9, edited(b)), (None, " ".join(c)), (12, edited(c)), (None, edited(c)), (3, edited(b)), (None, "alone here and nowhere else at all")]
    got = [(r["doc_id"], r["class_id"], r["kept"]) for r in M.classes(docs_of(spark, [(d, t, "", 0) for d, t in rows])).collect()]
    want = [(5, 5, True), (5, 3, False), (8, 5, False), (9, 3, False), (None, 12, False), (12, 12, True), (None, 12, False), (3, 3, True), (None, None, True)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert M.deduplicated(docs_of(spark, [(d, t, "", 0) for d, t in rows])).count() == 4
