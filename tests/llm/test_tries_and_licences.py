"""Conversation trie, Merkle manifest and licence scan against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from hashlib import md5, sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from heapstone.llm import conversation_trie, license_rules, license_scan, merkle, radix
from heapstone.llm.common import Store

CLASH = {"g": 1, "key": 2, "pos": 3, "size": "s", "copies": 4, "digest": "d", "chunk": 5, "_p": 6, "row": 7, "line": "l", "hits": 8, "rep": 9, "top": True, "depth": 10, "len": 11, "m": 12, "sym": 13, "words": 14}


def clash(df):
    return df.withColumns({name: F.lit(value) for name, value in CLASH.items()})


def sha(text):
    return sha256(text.encode()).hexdigest()


# --- ranks ---


@pytest.mark.parametrize("most", [1, 3, 4096])
def test_ranks_equal_a_sort_of_each_group(spark, most):
    rng = np.random.default_rng(3)
    rows = list({(str(rng.integers(0, 3)), int(x)): None for x in [*rng.integers(-(2**62), 2**62, 60), *rng.integers(0, 40, 60), 2**63 - 1, -(2**63)]})
    rows = [(g, x, 1 + abs(x) % 3) for g, x in rows] + [("0", None, 2)]
    df = spark.createDataFrame(rows, "g string, x long, n long").withColumn("k", radix.long_digits(F.col("x")))
    found = {(r["g"], r["x"]): (r["at"], r["total"]) for r in radix.ranks(df, Store(spark, "t"), ["g"], "k", "n", "at", "total", most).collect()}
    want = {}
    for g in "012":
        at, mine = 0, sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0))
        for _, x, n in mine:
            want[g, x] = (at, sum(r[2] for r in mine))
            at += n
    assert found == want


def test_copies_are_opened_in_blocks(spark):
    df = spark.createDataFrame([("a", 7, 10)], "g string, n long, at long")
    assert sorted(r["at"] for r in radix.each_copy(df, "n", "at", most=3).collect()) == list(range(10, 17))


# --- Merkle manifest ---


def brute_manifest(rows, fanout=2):
    def leaf(doc_id, source, lang, n_chars, text):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))

    def climb(nodes):
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for p, i in zip(paths, at, strict=True):
                first = i - i % fanout
                p.append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + fanout])))
            nodes, at = [sha("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)], [i // fanout for i in at]
        return nodes[0], paths

    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(*r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    root, tops = climb([trees[g][0] for g in order])
    out = []
    for g, top in zip(order, tops, strict=True):
        for (_, _, own, r), path in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1], strict=True):
            path = path + top
            shown = own
            if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                shown = leaf(r[0], r[1], r[2], r[3] + 1, r[4])
            for left, right in path:
                shown = sha(left + shown + right)
            out.append((r[0], own, trees[g][0], root, sha("".join(a + b for a, b in path)), shown, shown == root))
    return out


DOCS = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize(("fanout", "chunk"), [(2, 1024), (2, 4), (3, 9)])
def test_manifest_against_brute_force(spark, fanout, chunk):
    rng = np.random.default_rng(5)
    rows = [(int(i), f"src{i % 3}", ["en", "de", "é", "", None, "solo"][min(int(rng.integers(0, 12)), 4)], int(i) * 3, f"Text {i} ü") for i in range(-20, 90)]
    rows += [(None, None, None, None, None), (None, "a", "en", 1, ""), (5, "x", "en", None, None), (5, "x", "en", None, None), (5, "y", "en", 2, "t" * 70_000), (1 << 60, "z", "solo", 9, "alone")]
    found = merkle.audit(clash(spark.createDataFrame(rows, DOCS)), fanout, chunk)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    found = [tuple(r) for r in found.collect()]
    assert Counter(found) == Counter(brute_manifest(rows, fanout))
    assert 0 < sum(not r[-1] for r in found) < len(found)


def test_proofs_fold_to_the_root_and_small_tables(spark):
    rows = spark.range(40).selectExpr("id AS doc_id", "'s' AS source", "IF(id % 3 = 0, 'en', 'fr') AS lang", "id AS n_chars", "concat('t', id) AS text")
    for r in merkle.proofs(rows).collect():
        node = r["leaf"]
        for left, right in zip(r["siblings"][::2], r["siblings"][1::2], strict=True):
            node = sha(left + node + right)
        assert node == r["root"]
    one = merkle.audit(rows.where("doc_id = 1")).collect()
    assert len(one) == 1 and one[0]["leaf"] == one[0]["subroot"] == one[0]["root"] and one[0]["proof_sha256"] == sha("")
    assert merkle.audit(rows.where("false")).count() == 0


# --- conversation trie ---


def brute_trie(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((turn is not None, turn or 0, md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), (role, text)))
    turns = {c: [t[-1] for t in sorted(ts)] for c, ts in turns.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        built[c] = turns.get(base, [])[:h] + turns[c][h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
        ends[tuple(ts)].append(c)
    kids = defaultdict(list)
    for n in members:
        if n:
            kids[n[:-1]].append(n)
    leaves, saved = {}, {}
    for n in sorted(members, key=len, reverse=True):
        leaves[n] = sum(leaves[k] for k in kids[n]) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
        saved[n] = (len(members[n]) - 1) * words + sum(saved[k] for k in kids[n])
    return [(min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids[n]), leaves[n], saved[n], sha(",".join(map(str, sorted(ends[n]))))) for n, m in members.items()]


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def talk(seed, n, deep=6):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        for t in range(int(rng.integers(1, deep))):
            rows.append((c, t, "user" if t % 2 == 0 else "bot", " ".join("ab"[int(x)] for x in rng.integers(0, 2, int(rng.integers(1, 3))))))
    return rows


def same_trie(spark, rows, most=None):
    found = conversation_trie.prefix_trie(clash(spark.createDataFrame(rows, CONVERSATIONS)), most)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert Counter(tuple(r) for r in found.collect()) == Counter(brute_trie(rows))


def test_trie_in_rounds_against_brute_force(spark):
    same_trie(spark, talk(1, 120), most=8)


def test_trie_local_with_nulls_ties_repeats_and_long_texts(spark):
    rows = talk(2, 45)
    rows += [(None, 0, "user", "lost"), (60, None, None, None), (60, None, None, None), (60, 3, "b", "y"), (60, 3, "a", "y"), (-7, 1, "user", "ä  ö\tü"), (-40, 1, "user", "x y"), (80, 0, "user", "w " * 70_000), (81, 0, "user", "w " * 70_000), (99, 5, "user", "")]
    rows += [(1000 + c, t, "user", f"same {t}") for c in range(1, 30) for t in range(5)]
    same_trie(spark, rows)


def test_trie_of_copies_and_a_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "SLICE", 16)
    monkeypatch.setattr(conversation_trie, "BLOCK", 8)
    rows = [(20 * c, t, "user", f"turn {t} of many") for c in range(40) for t in range(40)] + [(20 * c + 20, 40, "bot", "more") for c in range(40, 41)]
    same_trie(spark, rows, most=16)


def test_trie_of_one_turn_and_of_nothing(spark):
    same_trie(spark, [(3, 0, "user", "hi")])
    assert conversation_trie.prefix_trie(spark.createDataFrame([], CONVERSATIONS)).count() == 0


# --- licences ---

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_scan(text, book):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(lowered)
    line = f" {' '.join(words)} "
    spans = []
    for n, r in enumerate(book):
        for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", line):
            start = line[: m.start()].count(" ") - 1
            spans.append((start, start + m[0].count(" "), r.kind, n, r))
    stands = [a for a in spans if not any(b[2] <= a[2] and b[0] <= a[0] and b[1] >= a[1] and b is not a and ((b[0], b[1]) != (a[0], a[1]) or b[3] < a[3]) for b in spans)]
    base = []
    for label, phrase in license_rules.BASE:
        want = phrase.split()
        base += [(i, label) for i in range(len(words)) if words[i : i + len(want)] == want]
    worth = list(license_rules.KINDS.values())
    labels = {s[4].label for s in stands} | {b[1] for b in base}
    starts = [b[0] for b in base]
    return len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({b[1] for b in base})), ",".join(sorted(labels)), max((worth[s[2]] for s in stands), default=0.0)


TEXTS = [
    None, "", "   ", "MIT License", "mit license mit license,MIT-LICENSE", "émit license", "Kmit license mıt license", "Released under the MIT License.", "This is licensed under the GNU General Public License, version 3.",
    "Licensed under the Apache License, Version 2.0 (the License); see http://www.apache.org/licenses/LICENSE-2.0 or ask", "Licensed under CC BY-NC 4.0. Also CC BY 4.0, and cc by.", "SPDX-License-Identifier: GPL-2.0-or-later",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), MIT License",
    "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", "mit der Lizenz gnu general public\nlicense apache", "gnu lesser general public license v2.1",
    "word " * 60_000 + "Apache License " + "漢字 " * 10 + "mit license", "BSD license and isc licence, two-clause BSD License",
]


def test_scan_against_brute_force(spark):
    book = license_rules.rules()
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "cc by"), (3, "MIT License")]
    found = license_scan.scan_documents(clash(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert Counter(tuple(r) for r in found) == Counter((i, *brute_scan(t, book)) for i, t in rows)
    assert license_scan.scan_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_scan_finds_what_notices_say_and_nothing_in_prose(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100, "He moved to the public square with a license to fish; the zip library opens at ten. Mit freundlichen Grüßen.")]
    labels = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.scan_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert labels[7] == ("mit", 0.95) and labels[8] == ("gpl,gpl-3.0", 0.95) and labels[9][0] == "apache,apache-2.0"
    assert labels[10] == ("cc-by,cc-by-4.0,cc-by-nc-4.0", 0.95) and labels[11] == ("gpl-2.0-or-later", 0.9) and labels[12] == ("mit", 1.0) and labels[13] == ("gpl,gpl-2.0-or-later", 0.95)
    assert labels[15] == ("lgpl-2.1", 0.8) and labels[100] == ("", 0.0)


def test_detections_are_spans_and_contained_ones_go(spark):
    docs = spark.createDataFrame([(1, "see: licensed under the Apache License, Version 2.0 and mit license")], "doc_id long, text string")
    found = {(r["label"], r["kind"], r["start"], r["end"]) for r in license_scan.detections(docs).collect()}
    assert found == {("apache-2.0", "notice", 1, 8), ("mit", "phrase", 10, 11)}


def test_every_rule_compiles_and_holds_its_keyword():
    book = license_rules.rules()
    assert 250 < len(book) and all(re.compile(r.pattern) for r in book) and all(" " not in (r.keyword[0], r.keyword[-1]) for r in book)
    for r in book:
        if re.fullmatch(r"[a-z0-9 ]+", r.pattern):
            assert r.keyword in r.pattern
