"""Each operator against a plain version of its contract, with the awkward rows every table may hold."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("millrace.llm")

import public_tokenizers  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from millrace.llm import bpe, digestindex, licenses, linetemplates, minhash, mix, rabitq, setindex, suffixdedup, tokencount, toxicity  # noqa: E402

SCHEMA = "doc_id long, text string, source string, n int, size string, _row int, score string, `key` string"
WORDS = ["alpha", "Beta", "gamma", "delta", "été", "the", "of", "x1", "straße", "中文", "😀"]


def texts() -> list:
    rng = random.Random(4)
    out: list = [None, "", " \t ", "A", "a b", "a b c d", "A B C D", "x" * 5000, "word " * 3000]
    base = [rng.choice(WORDS) + str(rng.randrange(99)) for _ in range(120)]
    for k in range(8):
        own = list(base)
        for _ in range(k):
            own[rng.randrange(len(own))] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(own))
    for _ in range(25):
        out.append("\n".join(" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 12))) for _ in range(rng.randrange(1, 6))))
    out += ["Licensed under CC BY 4.0.", "the GNU General Public License, version 3", "All rights reserved. cc by CC-BY", "all rights  reserved"]
    return out + out[9:14] + [None, ""]


def rows() -> list:
    found = [(i, t, [None, "a", "b", "é"][i % 4], i, "s", -i, "z", None) for i, t in enumerate(texts())]
    return [*found, found[12], found[12], (None, "no id here at all, is there", "a", None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def table(df, *columns) -> Counter:
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def sha(x: bytes | str) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def test_mix(docs, none):
    got = mix.mix(docs).collect()
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows()]
    assert sorted(r["size"] for r in got) == sorted(size)
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert len({r["target"] for r in got}) <= 4
    assert sum(own[0]["target"] for own in by.values()) == pytest.approx(1.5 * sum(size))
    for own in by.values():
        assert own[0]["source_size"] == sum(r["size"] for r in own)
        assert own[0]["target"] <= 2 * own[0]["source_size"]
        assert sum(r["taken"] for r in own) == int(own[0]["target"])
    keys = ("doc_id", "size", "taken")
    assert table(mix.mix(docs.repartition(7)), *keys) == table(mix.mix(docs), *keys)
    assert mix.mix(none).count() == 0


def test_mix_reshares_what_is_above_the_cap(spark):
    data = [(i, "w " * n, s) for i, (n, s) in enumerate([(10, "a"), (1000, "b"), (1000, "c")])]
    got = {r["source"]: r["target"] for r in mix.mix(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()}
    assert got["a"] == 20  # weight 3, but only 10 words
    assert got["b"] == pytest.approx((3015 - 20) / 3)
    assert got["c"] == pytest.approx((3015 - 20) * 2 / 3)


def test_quality_moves_the_selection(spark):
    data = [(i, "w " * 10, "a") for i in range(2000)] + [(i, "w " * 10, "b") for i in range(2000, 2100)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    weights = mix.quality_weights(spark.createDataFrame([(i, i % 2) for i in range(2000)], "doc_id long, quality int"))
    got = mix.mix(docs, weights).filter("source = 'a'").withColumn("extra", F.col("taken") % 10 + (F.col("taken") > 10).cast("int"))
    n = {r["q"]: r["n"] for r in got.groupBy((F.col("doc_id") % 2).alias("q")).agg(F.sum("taken").alias("n")).collect()}
    assert n[1] > n[0]


@pytest.mark.parametrize("weights", [[0.5], [1.0], [1.5], [0.5, 1.0, 1.5], [0.1, 7.0]])
def test_ranges_of_keys_are_even(spark, weights):
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("id") % len(weights) + 1).cast("int"))
    rows = spark.range(30_000).withColumn("_weight", weight).withColumn("_key", -F.log(mix.uniform(F.col("id"), F.lit(""), "s")) / F.col("_weight"))
    rows = rows.withColumn("b", mix.key_range(rows, 100))
    found = rows.groupBy("b").agg(F.count("*").alias("n"), F.min("_key").alias("lo"), F.max("_key").alias("hi")).orderBy("b").collect()
    assert max(r["n"] for r in found) <= 600 and len(found) == 100
    assert all(a["hi"] <= b["lo"] for a, b in zip(found, found[1:], strict=False))


def test_token_counts(docs, none):
    tokenizers = pytest.importorskip("tokenizers")
    path = public_tokenizers.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    got = table(tokencount.count_tokens(docs, path), "doc_id", "n_bytes", "n_tokens", "over_limit")
    want = Counter()
    for doc_id, text, *_ in rows():
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want[(doc_id, len((text or "").encode()), n, n > 2048)] += 1
    assert got == want
    assert tokencount.count_tokens(none, path).count() == 0


def test_prefix_tables():
    tokenizers = pytest.importorskip("tokenizers")
    path = public_tokenizers.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    counter = tokencount.counter(path)
    for word in ("internationalization", "aaaaaaaaaaaaaaaaaaaaaaa", "été", "中文字", "don", "----==---", "😀😀"):
        want = [len(library.encode(word[:i], add_special_tokens=False).ids) for i in range(len(word) + 1)]
        assert counter.table(word) == want
    odd = ["<|endoftext|>a<|startoftext|>", "ΣΑΣ İ ﬁ \x1c\x1d\x00", "I'll DON'T 'S ''' ①２", "é Å K"]
    assert counter.count_all(odd) == [len(library.encode(t, add_special_tokens=False).ids) for t in odd]
    text = "some words of which only a few internationalizations fit"
    for limit in (0, 1, 5, 7, 100):
        words, inside = counter.cut(text, limit)
        kept = text.split()[:words] + ([text.split()[words][:inside]] if inside else [])
        assert len(library.encode(" ".join(kept), add_special_tokens=False).ids) <= limit


def plain_templates(data: list, least: int = 10) -> Counter:
    leaf_of, tokens_of, leaves = {}, {}, Counter()
    lines = [(i, k, x) for i, (_, t, *_) in enumerate(data) for k, x in enumerate((t or "").split("\n")) if x.strip(" ")]
    for i, k, x in lines:
        own = [("<*>" if re.search("[0-9]", w) else w) for w in x.split(" ")]
        tokens_of[(i, k)], leaf_of[(i, k)] = own, (len(own), *own[:3])
        leaves[leaf_of[(i, k)]] += 1
    lines = [(i, k, x) for i, k, x in lines if leaves[leaf_of[(i, k)]] >= least]
    seen = Counter((leaf_of[(i, k)], p, w) for i, k, _ in lines for p, w in enumerate(tokens_of[(i, k)]) if w != "<*>")
    template = {}
    for i, k, _ in lines:
        shown = [w if seen[(leaf_of[(i, k)], p, w)] >= least else "<*>" for p, w in enumerate(tokens_of[(i, k)])]
        if 2 * sum(w != "<*>" for w in shown) >= len(shown):
            template[(i, k)] = " ".join(shown)
    holders = defaultdict(set)
    for (i, _), t in template.items():
        holders[t].add((data[i][0], data[i][1]))
    out = Counter()
    for i, (doc_id, t, *_) in enumerate(data):
        all_ = (t or "").split("\n")
        kept = [x for k, x in enumerate(all_) if len(holders.get(template.get((i, k)), ())) < least]
        out[(doc_id, len(all_) if t else 0, len(all_) - len(kept), "\n".join(kept))] += 1
    return out


def test_line_templates(spark, none):
    rng = random.Random(2)
    data = []
    for i in range(60):
        lines = [f"Posted on day {rng.randrange(31)} by user u{i}", "All rights are reserved here", f"unique {rng.random()} text {i} line"]
        if i % 3:
            lines.append(f"Read more about {rng.choice(['cats', 'dogs'])} in our archive")
        data.append((i, "\n".join(rng.sample(lines, len(lines))) + "\n", "a", 1, "s", 2, "z", "k"))
    data += [(60, None, "a", 1, "s", 2, "z", "k"), (61, "", "a", 1, "s", 2, "z", "k"), (62, "\n\n", "a", 1, "s", 2, "z", "k"), data[5], data[5]]
    got = linetemplates.drop_templates(spark.createDataFrame(data, SCHEMA))
    assert set(got.columns) == {"doc_id", "text", "source", "n", "size", "_row", "score", "key", "n_lines", "n_dropped"}
    found = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in got.collect())
    assert found == plain_templates(data)
    assert sum(k[2] for k in found) > 100
    assert linetemplates.drop_templates(none).count() == 0


@pytest.mark.parametrize("n", [300, 1200])
def test_fields_whose_values_recur_stay_fields(spark, n):
    name = ["".join(chr(97 + (k * m) % 26) for m in (1, 3, 7)) + "xyz"[k % 3] for k in range(60)]
    pairs = random.Random(3).sample([(x, y) for x in range(60) for y in range(60)], n)
    data = [(i, f"book cheap flights from {name[x]} to {name[y]} with us today") for i, (x, y) in enumerate(pairs)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    if n > 600:
        words = Counter(x for x, _ in pairs)
        assert sum(c > 10 for c in words.values()) > 50
        assert linetemplates.drop_templates(docs).filter("n_dropped > 0").count() < n / 10  # the rule of TEMPLATES_SQL
    params = linetemplates.TemplateParams(constant_share=0.1)
    assert linetemplates.drop_templates(docs, params).filter("n_dropped = 1").count() == n


def test_lines_copied_in_a_few_documents_go(spark):
    long = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    data = [(1, f"mine\n{long}\n1 2 3"), (2, f"{long}\nyours\n1 2 3"), (3, "twice here\ntwice here"), (4, "other"), (4, "other"), (5, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert linetemplates.drop_templates(docs).filter("n_dropped > 0").count() == 0  # the rule of TEMPLATES_SQL
    got = linetemplates.drop_templates(docs, linetemplates.TemplateParams(copies=2))
    want = {(1, "mine", 2): 1, (2, "yours", 2): 1, (3, "twice here\ntwice here", 0): 1, (4, "other", 0): 2, (5, None, 0): 1}
    assert table(got, "doc_id", "text", "n_dropped") == want


def test_exact_dedup(spark, docs, none):
    got = table(digestindex.dedup(docs, digestindex.new_index(spark)), "doc_id", "keep_id", "group_size", "kept")
    groups = defaultdict(list)
    for doc_id, text, *_ in rows():
        groups[text or ""].append(doc_id)
    want = Counter()
    for doc_id, text, *_ in rows():
        own = groups[text or ""]
        keep = max((i for i in own if i is not None), default=None)
        want[(doc_id, keep, len(own), doc_id == keep)] += 1
    assert got == want
    kept = digestindex.kept_rows(docs, digestindex.new_index(spark))
    assert kept.columns == docs.columns
    assert Counter(r["text"] or "" for r in kept.collect()) == Counter(dict.fromkeys(groups, 1))
    assert digestindex.dedup(none, digestindex.new_index(spark)).count() == 0


def test_digest_index_persists(spark):
    kind = "doc_id long, text string"
    index = digestindex.new_index(spark)
    digestindex.dedup(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], kind), index)
    again = digestindex.DigestIndex(spark, index.path, index.buckets)
    got = {r["doc_id"]: r for r in digestindex.dedup(spark.createDataFrame([(7, "a"), (8, "c"), (9, "c")], kind), again).collect()}
    assert (got[7]["kept"], got[7]["keep_id"]) == (False, 2)
    assert [got[i]["kept"] for i in (8, 9)] == [False, True]
    assert again.table().count() == 3


def test_two_indexes_with_one_last_name(spark, tmp_path):
    kind = "doc_id long, text string"
    a, b = (digestindex.DigestIndex(spark, f"{tmp_path}/{x}'s/idx") for x in "ab")
    assert digestindex.dedup(spark.createDataFrame([(1, "a"), (2, "b")], kind), a).filter("kept").count() == 2
    assert b.table().count() == 0
    assert digestindex.dedup(spark.createDataFrame([(3, "a")], kind), b).filter("kept").count() == 1
    with pytest.raises(ValueError):
        digestindex.DigestIndex(spark, a.path, a.buckets + 1)
    spark.sql(f"DROP TABLE {a.name}")  # as a session without this table in its catalog opens it
    again = digestindex.DigestIndex(spark, a.path)
    assert (again.buckets, again.table().count()) == (a.buckets, 2)


def test_a_batch_can_be_run_again(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, text string")
    index, columns = digestindex.new_index(spark), ("doc_id", "keep_id", "group_size", "kept")
    first = table(digestindex.dedup(docs, index, "monday"), *columns)
    other = table(digestindex.dedup(docs, index, "tuesday"), *columns)
    assert table(digestindex.dedup(docs, index, "monday"), *columns) == first == Counter({(1, 2, 2, False): 1, (2, 2, 2, True): 1, (3, 3, 1, True): 1})
    assert not any(k[3] for k in other)
    assert index.table().count() == 2


def test_mixed_rows_come_as_often_as_they_are_taken(spark):
    data = [(None, "w " * 10, "a", i) for i in range(10)] + [(5, "x " * k, "a", 0) for k in (3, 3, 4)] + [(6, None, "b", 1), (7, "y " * 400, "c", 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, own int")
    own = F.xxhash64("doc_id", "text", "source", "own")
    want = Counter()
    hashes = {r["h"]: tuple(r)[:4] for r in docs.select("*", own.alias("h")).collect()}
    for r in mix.mix(docs, more={"own": own}).collect():
        n = -(-r["taken"] // max(r["size"], 1))
        want.update({hashes[r["own"]]: n} if n else {})
    assert Counter(tuple(r) for r in mix.copies(docs).collect()) == want
    assert sum(want.values()) > 12
    assert mix.copies(docs.limit(0)).columns == docs.columns


def test_license_base(docs, none):
    got = table(licenses.scan(docs), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    want = Counter()
    for doc_id, text, *_ in rows():
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at, labels = [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            here = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            at += here
            labels |= {label} if here else set()
        want[(doc_id, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))] += 1
    assert got == want
    assert licenses.scan(none).count() == 0


def test_license_rules(spark):
    cases = {
        "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0",
        "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0",
        "GNU Lesser General Public License version 2.1": "gpl,lgpl-2.1",
        "Licensed under the Apache License, Version 2.0.": "apache-2.0",
        "Released under the MIT License.": "mit",
        "SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause",
        "mit einer Lizenz": "",
    }
    data = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(data).collect()}
    assert {t: got[i]["labels"] for i, t in enumerate(cases)} == cases
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert len(licenses.rules()) > 200
    assert all(any(g.strip() in k for k in r["keywords"] for g in licenses.GATE) for r in licenses.rules())


def samples(regex: str) -> list[str]:
    """Texts that a rule's regex matches: with and without what is optional, by each first and last alternative."""
    body = regex.removeprefix("(?<= )").removesuffix("(?= )").replace("(?: [^ ]+){0,3}?", " one two three").replace("(?: [^ ]+){0,4}?", " a b c d")
    body = body.replace("(?: [^ ]+){0,250}?", " x y").replace("[^ ]+", "2").replace("e?ment", "ment").replace("[sc]", "s")
    out = set()
    for keep in (True, False):
        for at in (0, -1):
            x, old = body, None
            while x != old:
                old = x
                x = re.sub(r"\(\?:([^()]*)\)(\??)", lambda m: "" if m[2] and not keep else m[1].split("|")[at], x, count=1)
            out.add(x)
    return sorted(out)


def test_gates_change_no_result(spark, monkeypatch):
    texts = ["This work is released under CC BY 4.0", "distributed under Mozilla Public 2.0", "available under the Apache 2.0 terms", "released under CC0 1.0"]
    for r in licenses.rules():
        for x in samples(r["regex"]):
            assert re.search(r["regex"], f" {x} ")
            texts.append(x)
    data = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keys = ("doc_id", "labels", "score", "detections")

    def scanned() -> Counter:
        return table(licenses.scan(data).withColumn("detections", F.to_json("detections")), *keys)

    got = scanned()
    labels = {k[0]: k[1] for k in got}
    assert [labels[i] for i in range(4)] == ["cc-by,cc-by-4.0", "mpl-2.0", "apache-2.0", "cc0-1.0"]
    ungated = [r | {"keywords": []} for r in licenses.rules()]
    monkeypatch.setattr(licenses, "rules", lambda: ungated)
    monkeypatch.setattr(licenses, "GATE", ("",))
    assert got == scanned()


def test_license_bodies_without_a_name(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including the rights to use it, and to permit persons to whom the Software is furnished to do so"
    isc = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Keep the notice."
    own = "2. All advertising materials mentioning features or use of this software must display the following acknowledgement: theirs."
    name = "3. Neither the name of the holder nor the names of its contributors may be used to endorse products."
    free = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    cases = {
        f"{mit}, subject to the following conditions: keep this.": "mit",
        f"{mit}. THE SOFTWARE IS PROVIDED \"AS IS\".": "mit-0",
        f"{mit}, subject to this. Except as contained in this notice, the name of X shall not be used.": "x11",
        mit.replace("deal in", "deal with"): "ncsa",
        f"{isc}, provided that the above copyright notice appears.": "isc",
        f"{isc}. THE SOFTWARE IS PROVIDED": "0bsd",
        bsd: "bsd-2-clause",
        f"{bsd} {name}": "bsd-3-clause",
        f"{bsd} {own}": "bsd-4-clause",
        f"{bsd} {own} {name}": "bsd-4-clause",
        free: "gpl,gpl-2.0",
        "This is free and unencumbered software released into the public domain.": "unlicense",
        "permission to use the pool is hereby granted": "",
    }
    data = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(data).collect()}
    assert {t: got[i] for i, t in enumerate(cases)} == cases


def test_bpe_round_trip(docs, none):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encode = bpe.encoding(path, public_tokenizers.PATTERN).encode_ordinary
    got = table(bpe.encode_decode(docs, path, public_tokenizers.PATTERN, digest=True), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    want = Counter()
    for doc_id, text, *_ in rows():
        ids = encode(text or "")
        want[(doc_id, len(ids), sha(" ".join(map(str, ids))), sha(text or ""))] += 1
    assert got == want
    full = {r["doc_id"]: r for r in bpe.encode_decode(docs, path, public_tokenizers.PATTERN).collect()}
    for doc_id, text, *_ in rows():
        assert full[doc_id]["ids"] == encode(text or "")
        assert bytes(full[doc_id]["decoded"]) == (text or "").encode()
    assert bpe.encode_decode(none, path, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("hot", [65536, 3])
def test_suffix_dedup(spark, docs, none, hot):
    rng = random.Random(1)
    parts = ["".join(rng.choice("ab") for _ in range(300)) for _ in range(4)]
    data = [(i, "".join(rng.choice(parts)[rng.randrange(150) :][: rng.randrange(1, 200)] for _ in range(rng.randrange(1, 8)))) for i in range(80)]
    data += [(90, None), (91, "a" * 1000), (92, "a" * 99), (93, "é" * 200), (95, "ab" * 300), (-4, "ab" * 90)]
    seen, want = set(), {}
    for doc_id, text in sorted(data):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(b[i : i + 100])
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        want[doc_id] = (len(b), sum(gone), spans, sha(kept))
    params = suffixdedup.SuffixParams(hot=hot, chunk_bytes=3000)
    got = suffixdedup.remove_repeats(spark.createDataFrame(data, "doc_id long, text string").repartition(5), params, digest=True)
    assert {r["doc_id"]: tuple(r)[1:] for r in got.collect()} == want
    if hot == 3:
        return
    assert suffixdedup.remove_repeats(none).count() == 0
    ids = Counter(r["doc_id"] for r in suffixdedup.remove_repeats(docs).collect())
    assert ids == Counter(r[0] for r in rows())


def test_suffix_dedup_of_repeated_and_null_ids(spark):
    long = "".join(random.Random(8).choice("abc") for _ in range(250))
    data = [(1, long), (1, long), (2, "x" + long[:120] + "y" + long[100:]), (3, None), (3, ""), (None, long[50:] + "z"), (-5, long[:100])]
    seen, want = set(), Counter()
    for doc_id, text in sorted(data, key=lambda d: (d[0] is None, d[0] or 0)):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(b[i : i + 100])
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        want[(doc_id, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g)))] += 1
    got = suffixdedup.remove_repeats(spark.createDataFrame(data, "doc_id long, text string").repartition(3), digest=True)
    assert table(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_merge_runs_knows_prefixes():
    rng = random.Random(5)
    runs = [sorted(bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(9))) for _ in range(rng.randrange(20))) for _ in range(7)]

    def common(a, b):
        return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))

    coded = [(r, [0, *(common(a, b) for a, b in zip(r, r[1:], strict=False))][: len(r)]) for r in runs]
    run, at, lcp = suffixdedup.merge_runs(coded, 9)
    merged = [runs[i][j] for i, j in zip(run, at, strict=True)]
    assert merged == sorted(x for r in runs for x in r)
    assert lcp[1:] == [common(a, b) for a, b in zip(merged, merged[1:], strict=False)]


def plain_components(data: list) -> dict:
    def shingles(t):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(words[i : i + 4]) for i in range(len(words) - 3)} or ({tuple(words)} if words else set())

    sets, root = [(d, shingles(t)) for d, t in data], {d: d for d, _ in data}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {d: (len(x), find(d), find(d) == d) for d, x in sets}


def test_near_duplicates(spark, docs, none):
    rng = random.Random(9)
    data = [(r[0], r[1]) for r in rows() if r[0] is not None]
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    for i in range(150):
        own = list(base)
        for _ in range(rng.randrange(14)):
            own[rng.randrange(200)] = f"n{rng.randrange(10**6)}"
        data.append((1000 + i, " ".join(own)))
    params = minhash.NearParams(block=40)
    got = {r["doc_id"]: tuple(r)[1:] for r in minhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string").repartition(4), params).collect()}
    assert got == plain_components(data)
    assert minhash.near_duplicates(none).count() == 0
    kept = minhash.kept_rows(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({None: 1} | {d: 1 for d, v in plain_components([(r[0], r[1]) for r in rows() if r[0] is not None]).items() if v[2]})


def test_unlike_texts_of_one_id(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(3, a), (5, a), (5, b), (7, b + " more"), (9, "")]
    got = Counter(tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter([(3, 57, 3, True), (5, 57, 3, False), (5, 57, 3, False), (7, 58, 3, False), (9, 0, 9, True)])
    kept = minhash.kept_rows(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(tuple(r) for r in kept) == Counter([(3, a), (5, b), (9, "")])


def test_wide_buckets_make_no_pairs(spark):
    """Texts that differ in words of small pools, none linked: rows of every step grow with their number."""
    sizes = {}
    for n in (200, 400):
        rng, base = random.Random(2), [f"w{i}" for i in range(200)]
        data = []
        for i in range(n):
            own = list(base)
            for k in range(11):
                own[18 * k + 3] = f"n{k}-{rng.randrange(12)}"
            data.append((i, " ".join(own)))
        docs, p = spark.createDataFrame(data, "doc_id long, text string"), minhash.NearParams()
        found = setindex.sets(docs, p.words, p.percent)
        texts = setindex.texts_of(docs, found, setindex.classes_of(found), p.percent)
        open_ = setindex.entries(texts, p.words, p.percent, minhash._bands(p))
        sizes[n] = (open_.count(), minhash.buckets(open_).count())
    assert sizes[400][0] and all(b <= 2.6 * a for a, b in zip(sizes[200], sizes[400], strict=True))


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 64)).astype(np.float32)
    x[300:500] = x[0]  # a third of all rows are the same
    data = [(i, v.tolist(), "e") for i, v in enumerate(x)]
    bad = [(700, None, "e"), (800, [0.0] * 64, "e"), (900, [float("nan")] * 64, "e"), (1000, [None] + [1.0] * 63, "e"), (1100, [1.0] * 3, "e"), (None, [1.0] * 64, "e")]
    frame = spark.createDataFrame(data + bad, "vec_id long, embedding array<float>, score string").repartition(3)
    got = defaultdict(list)
    for r in rabitq.search(rabitq.build(frame), F.col("vec_id") % 100 == 0, spark).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    full = x.astype(float)
    for q in range(0, 600, 100):
        d = np.sqrt(((full - full[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(600), d)) if i != q][:10]
        mine = sorted(got[q])
        assert [m[1] for m in mine] == order
        assert [m[0] for m in mine] == list(range(1, 11))
        assert np.allclose([m[2] for m in mine], d[order], rtol=1e-12)
    assert rabitq.search(rabitq.build(frame.filter("vec_id in (700, 800, 900)")), F.lit(True), spark).count() == 0
    assert rabitq.search(rabitq.build(frame.filter("vec_id > 5000")), F.lit(True), spark).count() == 0
    for narrow in (rabitq.RabitqParams(block=1), rabitq.RabitqParams(table_bytes=1)):
        few = rabitq.search(rabitq.build(frame.filter("vec_id in (1, 2, 3)")), F.lit(True), spark, narrow).collect()
        assert len(few) == 6


def test_codes_estimate_distances():
    rng = np.random.default_rng(0)
    x, q = rng.standard_normal((500, 64)), rng.standard_normal(64)
    centre, turn = x.mean(axis=0), rabitq.rotation(64, 7)
    assert np.allclose(turn @ turn.T, np.eye(64))
    code, length, dot = rabitq.encode(x, centre, turn)
    signs = np.unpackbits(code, axis=1) * 2.0 - 1
    qu = (q - centre) @ turn.T
    assert np.allclose(rabitq.products(code, rabitq.byte_sums(qu[None])), (signs @ qu)[:, None])
    odd = rng.standard_normal((2, 13))
    assert np.allclose(rabitq.products(np.packbits(odd > 0, axis=1), rabitq.byte_sums(odd)).diagonal(), np.abs(odd).sum(axis=1))
    estimate = signs @ qu / 8 / dot * length
    exact = (x - centre) @ (q - centre)
    spread = np.sqrt(1 - dot**2) / dot * length * np.linalg.norm(q - centre) / np.sqrt(63)
    assert (np.abs(estimate - exact) <= 3 * spread).mean() > 0.98


def toxic_table(n: int = 1500):
    rng = random.Random(6)
    words = ["".join(rng.choice("aeioultrnsm") for _ in range(rng.randrange(2, 9))) for _ in range(900)]
    for i in range(n):
        own = [rng.choice(words) for _ in range(rng.randrange(30, 120))]
        toxic = i % 8 == 0
        if toxic:
            for _ in range(3):
                own[rng.randrange(len(own))] = rng.choice(["dreck", "zxidiot", "zxmoron", "zxclown"])
        yield i, " ".join(own), int(toxic)


def test_toxicity_held_out(spark):
    data = list(toxic_table())
    docs = spark.createDataFrame([(i, t, "score") for i, t, _ in data] + [(5000, None, "x"), (5001, "", "x"), (None, "zxidiot dreck", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data if i % 3 == 0] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).withColumn("out", toxicity.held_out(F.col("doc_id"))).collect()}
    out = [(got[i]["score"], y) for i, _, y in data if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {got[i]["out"] for i, _, _ in data if zlib.crc32(str(i).encode()) % 4 == 2} == {True}
    assert all(0 <= r["score"] <= 1 for r in got.values())
    right = sum((s >= 0.3) == bool(y) for s, y in out) / len(out)
    assert right > 0.97
    assert got[5000]["score"] == got[5001]["score"] < 0.3
    assert toxicity.train(docs, labels.filter("toxic = 2")).weights == {}
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.train(docs.limit(0), labels).weights == {}


def test_labels_of_held_out_rows_are_not_used(spark):
    data = list(toxic_table(400))
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    flipped = [(i, y if zlib.crc32(str(i).encode()) % 4 != 2 else 1 - y) for i, _, y in data]
    a = toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int"))
    b = toxicity.train(docs, spark.createDataFrame(flipped, "doc_id long, toxic int"))
    assert a == b
