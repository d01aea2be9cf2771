"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns; results against brute force."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from heapstone.llm import chat, host_rules, html_extract, mixing, near_dup, packing, quality_cnn, sharding, token_counts, vector_search
from heapstone.llm.common import shingle_sets, word_hashes

BPE, UNIGRAM = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: Columns that bear names which operators use inside or return.
CLASH = ", size long, shard int, slot long, rep long, key long, score double, kept boolean, _slice long, host string, c0 string"


def documents(spark, rows, clash=False):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    full = [(i, t, "en", s, len(t or "")) for i, t, s in rows]
    if clash:
        return spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 0.5, True, 6, "h", "c") for r in full], schema + CLASH)
    return spark.createDataFrame(full, schema)


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefgh"), int(rng.integers(2, 7)))) for _ in range(n))


EDGE = [(1, None, "a"), (2, "", "a"), (3, "one", None), (4, "one", None), (4, "one", None), (None, "two words", "b"), (None, None, None), (7, prose(1, 6000), "a"), (8, "Ärger\tund\n\n  Öl — 漢字 🙂 ", "b")]


@pytest.fixture(scope="module")
def edge(spark):
    return documents(spark, EDGE, clash=True).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [(1, "x", "a")]).where("false")


# --- sharding ---


def test_sharding_laws(spark, edge, empty):
    rows = sharding.shard_documents(edge).collect()
    assert len(rows) == len(EDGE)
    assert sorted(r["size"] for r in rows) == sorted(len((t or "").encode()) + 1 for _, t, _ in EDGE)
    assert Counter(r["text_crc32"] for r in rows) == Counter(zlib.crc32((t or "").encode()) for _, t, _ in EDGE)
    for shard, n in Counter(r["shard"] for r in rows).items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(n))
    assert sharding.shard_documents(empty).count() == 0


def test_sharding_moves_few_rows_and_only_into_the_new_shard(spark):
    rows = sharding.shard_documents(spark.range(4000).selectExpr("id doc_id", "cast(id AS string) text")).collect()
    moved = [r for r in rows if r["shard"] != r["grown_shard"]]
    assert all(r["grown_shard"] == 16 for r in moved) and 100 < len(moved) < 400
    assert max(Counter(r["shard"] for r in rows).values()) < 330


def test_sharding_against_scores_in_plain_python(spark):
    from hashlib import md5
    from math import log

    def winner(key, shards):
        scores = [-1 / log((int(md5(f"{key}\u0001shard{s}".encode()).hexdigest()[:15], 16) + 0.5) / 2**60) for s in range(shards)]
        return scores.index(max(scores))

    rows = sharding.shard_documents(spark.range(500).selectExpr("id - 50 AS doc_id", "'t' AS text")).collect()
    assert all((r["shard"], r["grown_shard"]) == (winner(r["doc_id"], 16), winner(r["doc_id"], 17)) for r in rows) and len(rows) == 500


def test_rows_without_key_share_a_shard_but_not_a_slice(spark):
    docs = spark.range(300).selectExpr("CAST(NULL AS LONG) AS doc_id", "cast(id AS string) AS text")
    rows = sharding.shard_documents(docs).collect()
    assert len({r["shard"] for r in rows}) == 1 and sorted(r["slot"] for r in rows) == list(range(300))


def test_sharding_weights(spark):
    df = sharding.assign_shards(spark.range(6000), "id", [1.0, 2.0, 3.0])
    counts = {r["shard"]: r["count"] for r in df.groupBy("shard").count().collect()}
    assert abs(counts[0] - 1000) < 150 and abs(counts[2] - 3000) < 200


# --- packing ---


def test_units_encode_like_whole_texts():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(BPE)
    texts = ["x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|><|endoftext|>  b\n<|endoftext|>\n\n c", "<|endoftext| > <|end", "", "a", " a", "a ", "a  b\n\n c", "\n", "x\ty", "don't  \n stop", "é b's \t x's y", "a\x1cb!\x1c c", "tab nb sp  ", "<|endoftext|> end", "word, word,, (x) it's, it's. a'll!! $9.50 --", *(t or "" for _, t, _ in EDGE)]
    for text, ids in zip(texts, packing.UnitEncoder(BPE).encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_long_texts_are_encoded_in_parts(monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 50)
    text = prose(3, 400) + " don't  stop\n\n at <|endoftext|> a b c é " + prose(4, 300) + "  "
    whole = packing.UnitEncoder(BPE).encode([text])[0]
    assert len(packing.stretches(text.encode(), 50)) > 20 and packing._encoded(packing.UnitEncoder(BPE), [text.encode(), b""]) == [whole, b""]


def test_packing_round_trip(spark, edge, empty):
    rows = packing.pack_documents(edge, BPE, with_ids=True).collect()
    assert sorted(r["sequence_id"] for r in rows) == list(range(len(rows)))
    assert all(r["offset"] == 0 and r["length"] & (r["length"] - 1) == 0 and r["length"] <= 1024 for r in rows)
    from tokenizers import Tokenizer

    wanted = Counter()
    plain = Tokenizer.from_file(BPE)
    for doc_id, text, _ in EDGE:
        wanted[doc_id, tuple([*plain.encode(text or "", add_special_tokens=False).ids, 0])] += 1
    by_doc = defaultdict(list)
    for r in rows:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        by_doc[r["doc_id"], r["doc_tokens"]].append(r)
    for (doc_id, tokens), pieces in by_doc.items():
        times = len([p for p in pieces if p["start"] == 0])
        ids = [i for p in sorted(pieces, key=lambda p: p["start"])[::times] for i in np.frombuffer(p["ids"], "<u4").tolist()]
        assert wanted[doc_id, tuple(ids)] == times and len(ids) == tokens
    assert packing.pack_documents(empty, BPE).count() == 0


@pytest.mark.parametrize(("n", "parts"), [(1, [1]), (1023, [512, 256, 128, 64, 32, 16, 8, 4, 2, 1]), (1024, [1024]), (2053, [1024, 1024, 4, 1])])
def test_lengths(n, parts):
    assert packing.lengths(n, 1024) == parts


# --- mixing ---


def shared_targets(sizes, weights):
    """Targets by sharing over and over until no source is above its cap."""
    left, open_, targets = 1.5 * sum(sizes.values()), set(sizes), {}
    while True:
        level = left / sum(weights[k] for k in open_)
        over = {k for k in open_ if level * weights[k] > 2 * sizes[k]}
        if not over:
            return targets | {k: level * weights[k] for k in open_}
        targets |= {k: 2 * sizes[k] for k in over}
        left -= sum(targets[k] for k in over)
        open_ -= over


def test_mixing(spark, edge, empty):
    expected = shared_targets({"a": 10, "b": 1000, "c": 300, "d": 0, None: 77}, {"a": 3, "b": 1, "c": 2, "d": 3, None: 1})
    rows = [(i, prose(i, n), s) for i, (n, s) in enumerate([(10, "a"), *[(50, "b")] * 20, *[(30, "c")] * 10, (0, "d"), (70, None), (7, None)])]
    result = mixing.mix_documents(documents(spark, rows)).collect()
    taken = defaultdict(int)
    for r in result:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        assert r["target"] == pytest.approx(expected[r["source"]])
    for source, target in expected.items():
        assert taken[source] == int(target + 1e-9)
    again = mixing.mix_documents(documents(spark, rows).repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, result))
    assert mixing.mix_documents(edge).count() == len(EDGE)
    assert mixing.mix_documents(empty).count() == 0
    assert mixing.repeat_documents(edge).columns == edge.columns


def test_slices_of_mixing_keys_are_even_at_any_quality(spark):
    n, cuts = 20_000, 100
    for quality in (0.05, 0.1, 0.2, 0.5, 1.0):
        key = -F.log((F.col("id") + 0.5) / n) / quality
        rows = spark.range(n).select(key.alias("k"), F.floor(mixing.key_share(key) * cuts).alias("s"))
        assert rows.groupBy("s").count().agg(F.max("count")).first()[0] <= 4 * n / cuts
        found = [r["s"] for r in rows.orderBy("k").collect()]
        assert found == sorted(found)


# --- host rules ---


def brute_statistics(text):
    words = (text or "").encode().split()
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return [len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered)]


def test_statistics_against_brute_force(spark, edge):
    texts = [*(t for _, t, _ in EDGE), "a b c a b c a", "x\nx\n\n \ny\nx", "#*$%&|<>! é", "w " * 300]
    got = host_rules.text_statistics([(t or "").encode() for t in texts])
    assert got.tolist() == [brute_statistics(t) for t in texts]
    assert host_rules.judge_documents(edge).count() == len(EDGE)


@pytest.mark.parametrize("bound", [0, 1000])
def test_many_hosts_are_joined_like_few(spark, monkeypatch, bound):
    monkeypatch.setattr(host_rules, "MOST_HOSTS", bound)
    docs = documents(spark, [(i, prose(i, 60) if i % 10 == 0 else "short", "bad") for i in range(60)] + [(100 + i, prose(i, 60), "good") for i in range(60)] + [(None, prose(1, 60), None)])
    judged = host_rules.judge_documents(docs).collect()
    assert len(judged) == 121 and {r["doc_id"] for r in judged if r["kept"]} == {*range(100, 160), None}
    assert {r["doc_id"] for r in host_rules.keep_good(docs).collect()} == {*range(100, 160), None}


def test_a_bad_host_takes_its_clean_documents_along(spark, empty):
    rows = [(i, prose(i, 60) if i % 10 == 0 else "short", "bad") for i in range(100)] + [(100 + i, prose(i, 60), f"good{i % 9}") for i in range(300)] + [(999, prose(9, 60), None)]
    docs = documents(spark, rows, clash=True)
    kept = {r["doc_id"] for r in host_rules.judge_documents(docs).where("kept").collect()}
    assert kept == {*range(100, 400), 999}
    good = host_rules.keep_good(docs)
    assert good.columns == docs.columns and {r["doc_id"] for r in good.collect()} == kept
    assert host_rules.judge_documents(empty).count() == 0


# --- quality classifier ---


def test_classifier_on_held_out_documents(spark, empty):
    rows = [(i, prose(i, 80) + "." if i % 3 else " ".join(w + "%%%" for w in prose(i, 80).split()), "s") for i in range(600)]
    docs, labels = documents(spark, rows, clash=True), spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(600)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = quality_cnn.fit(docs, labels)
    scored = quality_cnn.score_documents(docs, model).where("held_out").collect()
    assert len(scored) > 60 and all(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in scored)
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5) == 0 for r in scored)
    assert {r["doc_id"] for r in quality_cnn.keep_predicted(docs, model).collect()} >= {i for i in range(600) if i % 3}
    edge_scores = quality_cnn.score_documents(documents(spark, EDGE), model).collect()
    assert len(edge_scores) == len(EDGE) and all(0 <= r["score"] <= 1 for r in edge_scores)
    assert quality_cnn.score_documents(empty, quality_cnn.fit(empty, labels)).count() == 0


def test_the_sample_comes_from_labels_that_have_documents(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(quality_cnn, "train", lambda texts, labels, prior: seen.update(n=len(texts), ones=float(labels.sum()), prior=prior, first=texts[0] if texts else None))
    docs = documents(spark, [(i, f"text {i}", "s") for i in range(100)] + [(i, f"atext {i}", "s") for i in range(100)])
    labels = spark.createDataFrame([(i, 1) for i in range(100, 5000)] + [(i, int(i % 4 == 0)) for i in range(100)], "doc_id long, quality int")
    quality_cnn.fit(docs, labels, per_label=50)
    inside = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5]
    ones = sum(i % 4 == 0 for i in inside)
    assert seen == {"n": ones + min(50, len(inside) - ones), "ones": ones, "prior": ones / len(inside), "first": seen["first"]} and seen["first"].startswith(b"atext")
    with pytest.warns(UserWarning, match="no text of label"):
        quality_cnn.fit(docs, labels.where("doc_id >= 100"))


def test_features_do_not_depend_on_batches_or_spans(monkeypatch):
    rng = np.random.default_rng(0)
    model = quality_cnn.Model(*(rng.normal(size=s).astype(np.float32) for s in ((256, 8), (96, 24), (24,), (48,), (1,))))
    texts = [prose(k, 10 + 300 * k).encode() for k in range(5)] + [b"", b"x"]
    whole = quality_cnn.pooled(model, texts)
    assert np.allclose(whole, np.vstack([quality_cnn.pooled(model, [t]) for t in texts]), atol=1e-4)
    monkeypatch.setattr(quality_cnn, "SPAN", 3)
    assert np.allclose(whole, quality_cnn.pooled(model, texts), atol=1e-4)


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    model = quality_cnn.Model(*(rng.normal(0, 0.3, size=s) for s in ((256, 8), (96, 24), (24,), (48,), (1,))))
    texts, y, w = [prose(3, 40).encode(), prose(4, 90).encode()], np.array([0.0, 1.0]), np.ones(2)

    def loss():
        p = quality_cnn.score_texts(model, texts)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for array, gradient in zip(model.arrays(), quality_cnn._gradients(model, texts, y, w), strict=True):
        at = np.unravel_index(np.abs(gradient).argmax(), gradient.shape)
        old, step = array[at], 1e-3
        array[at] = old + step
        up = loss()
        array[at] = old - step
        down = loss()
        array[at] = old
        assert (up - down) / (2 * step) == pytest.approx(gradient[at], rel=0.05, abs=1e-4)


# --- near duplicates ---


def brute_components(rows, width, percent):
    sets = []
    for _, t, _ in rows:
        w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in (t or "").encode().split()]
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    comp = {i: i for i, _, _ in rows}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for k, (i, _, _) in enumerate(rows):
        for j in range(k):
            if sets[k] and sets[j] and 100 * len(sets[k] & sets[j]) >= percent * len(sets[k] | sets[j]):
                a, b = sorted((find(i), find(rows[j][0])))
                comp[b] = a
    return {i: (len(s), find(i)) for (i, _, _), s in zip(rows, sets, strict=True)}


def family(seed, n, copies, edits):
    rng, base = np.random.default_rng(seed), prose(seed, n).split()
    for _ in range(copies):
        words = list(base)
        for at in rng.choice(n, int(rng.integers(0, edits + 1)), replace=False):
            words[at] = prose(int(rng.integers(1 << 30)), 1)
        yield " ".join(words)


def test_near_duplicates_against_brute_force(spark, empty):
    texts = [t for seed in range(12) for t in family(seed, 60 + 20 * seed, 25, 3 + seed)] + ["", None, "One two", "one TWO", "one", prose(5, 30), *[prose(77, 90)] * 3]
    rows = [(1000 - i, t, "s") for i, t in enumerate(texts)]
    for like in (near_dup.Likeness(3, 85, 6), near_dup.Likeness(5, 80, 5)):
        got = {r["doc_id"]: r for r in near_dup.near_duplicates(documents(spark, rows, clash=True), like).collect()}
        want = brute_components(rows, like.width, like.percent)
        assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
        assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())
    assert near_dup.near_duplicates(empty).count() == 0


def test_blocks_find_links_between_members_that_the_pivot_misses(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCKS", (2, 3))
    rows = [(i, t, "s") for i, t in enumerate(t for seed in range(3) for t in family(seed, 50, 30, 9))]
    like = near_dup.Likeness(2, 80, 2)
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(documents(spark, rows), like).collect()}
    assert got == {i: c for i, (_, c) in brute_components(rows, 2, 80).items()}


def test_dropping_keeps_one_of_each_group_and_rows_without_id(spark):
    docs = documents(spark, [(1, prose(1, 40), "a"), (2, prose(1, 40), "a"), (2, prose(1, 40), "b"), (None, prose(1, 40), "a"), (None, "", "a"), (5, prose(2, 40), "a"), (5, prose(2, 40), "a")], clash=True)
    left = near_dup.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "5", "None", "None"]


@pytest.mark.parametrize(
    ("rows", "stay"),
    [
        ([(2, 2), (5, 1), (5, 2)], [(2, 2), (5, 1)]),
        ([(5, 1), (5, 2)], [(5, 1), (5, 2)]),
        ([(5, 1), (5, 1), (5, 2), (3, 2), (3, 2)], [(3, 2), (5, 1)]),
        ([(9, None), (9, None), (9, 1), (None, 1), (None, None)], [(9, None), (9, None), (9, 1), (None, 1), (None, None)]),
    ],
)
def test_dropping_tells_texts_of_one_id_apart(spark, rows, stay):
    texts = {1: prose(1, 40), 2: prose(2, 40), None: None}
    left = near_dup.drop_near_duplicates(documents(spark, [(i, texts[t], "s") for i, t in rows], clash=True)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in left), key=str) == sorted(((i, texts[t]) for i, t in stay), key=str)


def test_components_of_a_long_chain(spark):
    from heapstone.llm.common import Store

    edges = spark.range(200).selectExpr("id + 1 AS a", "id AS b").union(spark.createDataFrame([(900, 901), (901, 901)], "a long, b long"))
    found = {r["id"]: r["component"] for r in near_dup.components(edges, Store(spark, "t")).collect()}
    assert found == {**dict.fromkeys(range(201), 0), 900: 900, 901: 900}


def test_long_texts_are_hashed_in_spans(monkeypatch):
    from heapstone.llm import common

    texts = [prose(3, 500).encode(), b"", ("x" * 300 + " y " + prose(4, 100)).encode(), b"a b"]
    hashes, counts = word_hashes(texts, lower=True)
    monkeypatch.setattr(common, "LONG_TEXT", 64)
    again, counted = word_hashes(texts, lower=True)
    assert np.array_equal(hashes, again) and np.array_equal(counts, counted)


def test_word_hashes_tell_words_apart():
    texts = [b"a bb a", b"", b" \n", b"bb\x0ba", "é".encode()]
    hashes, counts = word_hashes(texts, lower=False)
    assert counts.tolist() == [3, 0, 0, 2, 1] and hashes[0] == hashes[2] == hashes[4] and hashes[1] == hashes[3] and len(set(hashes.tolist())) == 3
    assert [len(s) for s in shingle_sets([b"A b c a B C", b"x y", b"", b"x Y"], 3)] == [3, 1, 0, 1]


# --- vectors ---


def test_search_recall_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(1500, 24)).astype(np.float32) * rng.uniform(0.2, 3, size=(1500, 1)).astype(np.float32)
    v[300:800] = v[300]
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)] + [(2000, None, 0), (2020, [0.0] * 24, 0), (2040, [float("nan")] * 24, 0), (2060, [None] * 24, 0), (2080, [1.0], 0), (None, v[0].tolist(), 0)]
    got = vector_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert len(got) == 75 * 20
    d, hit = v.astype(np.float64), 0
    for q in range(0, 1500, 20):
        scores = d @ d[q]
        order = [i for i in np.lexsort((np.arange(1500), -scores)) if i != q][:20]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21)) and all(r["score"] == pytest.approx(scores[r["vec_id"]], abs=1e-9) for r in mine)
        assert [(-r["score"], r["vec_id"]) for r in mine] == sorted((-r["score"], r["vec_id"]) for r in mine)
        hit += len(set(order) & {r["vec_id"] for r in mine})
    assert hit / (75 * 20) >= 0.95


def test_an_id_counts_once_as_query_and_candidate(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(200, 8))
    rows = [(i, x.tolist(), 1, 1, 1, 1.0) for i, x in enumerate(v)]
    rows += [rows[20], rows[59], (40, [-9.0] * 8, 1, 1, 1, 1.0)]
    v[40] = min(v[40].tolist(), [-9.0] * 8)
    got = vector_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, qid long, list int, p int, rank double")).collect()
    for q in range(0, 200, 20):
        mine = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == q)
        assert [r for r, _ in mine] == list(range(1, 21)) and len({i for _, i in mine}) == 20 and q not in {i for _, i in mine}
        assert all(r["score"] == pytest.approx(float(v[q] @ v[r["vec_id"]])) for r in got if r["query_id"] == q)


def test_search_of_few_or_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (20, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in vector_search.search(few).collect()) == [(0, 1, 1), (0, 2, 20), (20, 1, 1), (20, 2, 0)]
    assert vector_search.search(few.where("false")).count() == 0 and vector_search.search(few.where("vec_id = 1")).count() == 0


# --- token counts ---


def test_token_counts_against_viterbi(spark, edge, empty):
    scores = token_counts.piece_scores(UNIGRAM)
    byte = -np.log(len(scores) + 2)

    def tokens(word):
        best = [(0.0, 0)] + [(-1e9, 0)] * len(word)
        for end in range(1, len(word) + 1):
            options = [(best[end - 1][0] + len(word[end - 1].encode()) * byte, -best[end - 1][1] - len(word[end - 1].encode()))]
            options += [(best[s][0] + scores[word[s:end]], -best[s][1] - 1) for s in range(end) if word[s:end] in scores]
            top = max(options)
            best[end] = (top[0], -top[1])
        return best[-1][1]

    got = token_counts.count_tokens(edge, UNIGRAM).collect()
    want = Counter((i, len((t or "").encode().split()), sum(tokens("▁" + w.decode()) for w in (t or "").encode().split())) for i, t, _ in EDGE)
    assert Counter(tuple(r) for r in got) == want
    assert token_counts.count_tokens(empty, UNIGRAM).count() == 0


def test_long_words_take_no_nodes_and_count_alike(spark):
    trie = token_counts.PrefixTrie(token_counts.piece_scores(UNIGRAM))
    for word in (prose(3, 300).replace(" ", ""), "漢字仮名交" * 80, "a" * 500):
        short = token_counts.PrefixTrie(trie.scores)
        nodes, token_counts_long = len(trie.best), trie.count_long(word)
        monkey, token_counts.LONG = token_counts.LONG, 1 << 30
        try:
            assert short.insert(word) == token_counts_long and len(trie.best) == nodes
        finally:
            token_counts.LONG = monkey
    word = "x" * 200_000
    rows = token_counts.count_tokens(documents(spark, [(1, f"one {word} two", "s"), (2, "one two", "s"), (3, word, "s")]), UNIGRAM).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in rows}
    assert got[1] == (3, got[2][1] + got[3][1]) and got[3][0] == 1


def test_texts_are_counted_in_spans_that_cut_no_word():
    from heapstone.llm.common import spans_of

    text = (prose(1, 3000) + " \n " + "y" * 5000 + "\t" + prose(2, 200)).encode()
    spans = list(spans_of(text, 100))
    assert b"".join(spans) == text and len(spans) > 50 and [w for s in spans for w in s.split()] == text.split()


def test_trie_shares_prefixes():
    trie = token_counts.PrefixTrie({"a": -1.0, "ab": -1.5, "abc": -4.0, "c": -1.0})
    assert trie.insert("ab") == 1 and trie.insert("abc") == 2 and trie.insert("abd") == 2 and len(trie.best) == 5


# --- chat ---


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, position long, h string")


def test_snapshots_collapse(spark):
    turn = lambda c, t, r, x: (c, t, r, x, 1, "h")
    rows = [turn(1, 0, "user", "hi"), turn(2, 0, "user", "hi"), turn(2, 1, "assistant", "yo"), turn(3, 5, "user", "hi"), turn(3, 9, "assistant", "yo"), turn(4, 0, "user", "hi"), turn(4, 1, "assistant", "other"), turn(4, 1, "assistant", "other"), turn(5, None, None, None), turn(None, 0, "user", "x"), turn(6, 9000, "User ", "hi")]
    got = {r["conv_id"]: r for r in chat.format_conversations(conversations(spark, rows)).collect()}
    assert set(got) == {2, 4, 5, 6}
    assert got[2]["text"] == "<|user|>\nhi\n\n<|assistant|>\nyo\n\n" and got[4]["n_turns"] == 2 and got[5]["text"] == "<||>\n\n\n" and got[6]["text"].startswith("<|user|>")
    assert chat.format_conversations(conversations(spark, rows).where("false")).count() == 0


def test_long_conversations_are_sliced_and_cut(spark, monkeypatch):
    monkeypatch.setattr(chat, "SLICE", 7)
    rows = [(c, t, "user", f"turn {t}", 0, "") for c, n in ((1, 40), (2, 60), (3, 60)) for t in range(n)] + [(4, t, "user", f"turn {t + (t == 30)}", 0, "") for t in range(60)]
    whole = {r["conv_id"]: r for r in chat.format_conversations(conversations(spark, rows)).collect()}
    assert set(whole) == {2, 4} and all((r["part"], r["n_parts"], r["n_turns"]) == (0, 1, 60) for r in whole.values())
    parts = sorted(chat.format_conversations(conversations(spark, rows), part_chars=200).collect(), key=lambda r: (r["conv_id"], r["part"]))
    assert {r["conv_id"] for r in parts} == {2, 4} and all(r["n_parts"] > 1 and r["n_turns"] == 60 for r in parts)
    assert "".join(r["text"] for r in parts if r["conv_id"] == 2) == "".join(f"<|user|>\nturn {t}\n\n" for t in range(60)) == whole[2]["text"]


def test_prefixes_that_differ_in_one_turn_are_kept(spark):
    base = [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")]
    logs = {1: base[:2], 2: base, 3: [*base[:1], ("assistant", "B")], 4: [base[1], base[0]], 5: base[:3] + [("user", "d")], 6: base[:3]}
    rows = [(c, t, r, x, 0, "") for c, turns in logs.items() for t, (r, x) in enumerate(turns)]
    assert {r["conv_id"] for r in chat.format_conversations(conversations(spark, rows)).collect()} == {2, 3, 4, 5}


# --- pages ---


def test_blocks_of_broken_html():
    page = '<html><head><title>T &amp; t</title><script>var t="</p>";</script></head><body><!-- <p>no</p> --><nav><ul><li><a href="/x">A</a><li>B</ul></nav><article class="post mainBody"><p>one<b>two</b><br>three<p>a < b &lt;c&gt;\n\n d</article><footer>end'
    blocks = html_extract.leaf_blocks(page)
    assert [t for _, t, _ in blocks] == ["T & t", "A", "B", "onetwo", "three", "a < b <c> d", "end"]
    assert blocks[3][0] == ("html", "body", "article", ".post", ".main", ".body", "p") and blocks[1][2] == 1 and blocks[6][0][-1] == "footer"


def test_blocks_after_unclosed_and_inside_nested_elements():
    texts = lambda page: [t for _, t, _ in html_extract.leaf_blocks(page)]
    for name in ("svg", "select", "object", "canvas", "math", "noscript", "template"):
        assert texts(f"<body><div><{name}></div><article><p>kept</p></article>") == ["kept"]
        assert texts(f"<p>a</p><{name}/><p>b</p>") == ["a", "b"]
        found = html_extract.leaf_blocks(f"<article><{name}><{name}>in</{name}>mid</{name}><p>out</p></article>")
        assert [(t, path) for path, t, _ in found] == [("in", ("article", name, name)), ("mid", ("article", name)), ("out", ("article", "p"))]
    for name in ("script", "style", "textarea"):
        assert texts(f"<p>a</p><{name}>x</{name}><p>b</p><{name}>rest <p>no</p>") == ["a", "b"]
    assert texts("<p>a</p><iframe>x</iframe><p>b</p><iframe>rest <p>c</p>") == ["a", "b", "rest", "c"]
    assert texts("<title>a<b</title><p>b</p><title>c<p>d</p>") == ["a<b", "b", "c", "d"]


def test_tags_with_open_quotes_and_ends():
    texts = lambda page: [t for _, t, _ in html_extract.leaf_blocks(page)]
    assert texts('<p title="a>one</p><p>two</p>') == ["one", "two"]
    assert texts("<p title='a>b\">one</p><p class='x'>two</p>") == ["two"]
    assert texts("<p>x < y <3 </ <a") == ["x < y <3 </ <a"]
    assert texts("<p>a<!-- b <p>c") == ["a"] and texts("<p>a<![CDATA[ b ]]>c<!x>d<?y?>e") == ["acde"]


@pytest.mark.parametrize("piece", ["<a ", "<a '", '<a "', "<a href='", "<iframe>", "<div><p>x", "</b>x", "<", "<!", "<title>", "<div></p>x", "<b>", "<p a='>"])
def test_open_markup_takes_linear_time(piece):
    import time

    began = time.perf_counter()
    blocks = html_extract.leaf_blocks("<p>kept</p>" + piece * (1_000_000 // len(piece)) + "<p>")
    assert time.perf_counter() - began < 20 and blocks[0][1] == "kept" and max(len(b[0]) for b in blocks) <= html_extract.DEEPEST


def test_long_pages_are_read_in_stretches():
    rng, model = np.random.default_rng(7), html_extract.trained()
    blocks = [b for _ in range(12) for b in html_extract.leaf_blocks(html_extract.invented_page(rng)[0])]
    x = html_extract.vectors(blocks)[:, None]
    whole = model.probabilities(x, np.ones(x.shape[:2], np.float32))[:, 0]
    assert np.allclose(whole, model.probabilities_of_long(blocks, 37), atol=1e-4)


def test_labeller_on_unseen_invented_pages():
    rng, model, right, total = np.random.default_rng(4242), html_extract.trained(), 0, 0
    for _ in range(150):
        page, labels = html_extract.invented_page(rng)
        blocks, chance = html_extract.label_pages(model, [page])[0]
        if len(blocks) == len(labels):
            right += int(((chance >= 0.5) == np.array(labels)).sum())
            total += len(labels)
    assert right / total > 0.98


def test_extraction(spark):
    body = " ".join(f"<p>{prose(k, 30)}.</p>" for k in range(4))
    page = f'<html><head><title>x</title></head><body><nav><ul><li><a href="/">{prose(9, 2)}</a></li></ul></nav><div class="ad">{prose(8, 8)}</div><article><h1>Head line</h1>{body}</article><div class="comments"><p>{prose(7, 9)}</p></div><footer>&copy; {prose(6, 4)}</footer></body></html>'
    rows = [(1, "u", page, 1), (2, None, None, 1), (None, "u", "", 1), (4, "u", "no tags at all", 1), (5, "u", "<<<>>><p", 1), (1, "u", page, 1)]
    got = html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    first = next(r for r in got if r["page_id"] == 1)
    assert first["text"] == "Head line " + " ".join(prose(k, 30) + "." for k in range(4)) and first["n_chars"] == len(first["text"])
    assert len(got) == len(rows) and all(r["text"] == "" for r in got if r["page_id"] == 2)


def test_lstm_gradients_match_differences():
    rng, model = np.random.default_rng(2), html_extract.BlockLabeller()
    model.parameters = [p.astype(np.float64) for p in model.parameters]
    model.parameters[6] += rng.normal(0, 0.5, model.parameters[6].shape)
    x, mask = rng.normal(0, 0.3, (5, 3, html_extract.PATHS + html_extract.WORDS + html_extract.MEASURES)), np.ones((5, 3))
    mask[3:, 1] = 0
    y = rng.integers(0, 2, (5, 3)).astype(float)

    def loss():
        p = model.probabilities(x, mask)
        return -(mask * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / mask.sum()

    for array, gradient in zip(model.parameters, model.gradients(x, mask, y), strict=True):
        at = np.unravel_index(np.abs(gradient).argmax(), gradient.shape)
        old, step = array[at], 1e-4
        array[at] = old + step
        up = loss()
        array[at] = old - step
        down = loss()
        array[at] = old
        assert (up - down) / (2 * step) == pytest.approx(gradient[at], rel=0.03, abs=1e-5)
