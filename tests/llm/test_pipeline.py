"""The whole pipeline, stage by stage, on small tables; each stage by what it must keep."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from heapstone.llm import host_rules, mixing, near_dup

WORDS = [a + b for a in ("ka", "mo", "ti", "re", "sol") for b in ("ra", "ne", "lu", "vi", "dor", "pa")]


def good(seed, n=120):
    rng = np.random.default_rng(seed)
    return " ".join(str(rng.choice(WORDS)) + "." * (k % 11 == 0) for k in range(n))


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, good(i), "web") for i in range(120)] + [(200 + i, good(i), "mirror") for i in range(0, 60, 3)]
    rows += [(300 + i, " ".join(w + "%%%" for w in good(900 + i).split()), "web") for i in range(60)]
    rows += [(400 + i, "too short", "spam") for i in range(30)] + [(430, good(5000), "spam"), (431, None, "web"), (None, good(5001), "web"), (5, good(5002), "web"), (6, good(6), "web")]
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    labels = [(i, 1, 0) for i in range(120)] + [(300 + i, 0, 0) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_every_stage_hands_on_what_it_should(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "quality classifier", "near duplicates", "mixing", "packing"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        assert made.columns == docs.columns
        docs = spark.createDataFrame(made.collect(), made.schema)
        seen[name] = Counter((r["doc_id"], r["text"]) for r in docs.collect())
    rules, classified, unlike, mixed = (seen[n] for n in names[:-1])
    everything = Counter((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    assert rules == Counter({k: n for k, n in everything.items() if k[1] and len(k[1].split()) >= 50 and k[0] != 430})
    assert all(n == rules[k] for k, n in classified.items() if "%" not in k[1]) and not any("%" in t for _, t in classified)
    assert {t for _, t in unlike} == {t for _, t in classified} and max(Counter(t for _, t in unlike for _ in range(unlike[_, t])).values()) == 1
    assert (5, good(5)) in unlike and (5, good(5002)) in unlike and not any(i and 200 <= i < 300 for i, _ in unlike)
    assert set(mixed) <= set(unlike) and sum(mixed.values()) >= sum(unlike.values())


def test_the_whole_run_packs_all_that_the_mix_takes(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    tokens = defaultdict(set)
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        tokens[r["doc_id"]].add(len(plain.encode(r["text"] or "", add_special_tokens=False).ids) + 1)
    assert rows and all(r["doc_tokens"] in tokens[r["doc_id"]] for r in rows)
    assert sorted(r["sequence_id"] for r in rows) == list(range(len(rows)))
    sums = Counter()
    for r in rows:
        sums[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert all(total % each == 0 for (_, each), total in sums.items())


def test_mixing_and_rules_of_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    assert host_rules.keep_good(docs).count() == near_dup.drop_near_duplicates(docs).count() == mixing.repeat_documents(docs).count() == 0
