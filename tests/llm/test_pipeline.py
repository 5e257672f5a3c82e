"""The pipeline against a plain version of its stages."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

pytest.importorskip("corpus_pipeline")

import public_tokenizers  # noqa: E402

import corpus_pipeline  # noqa: E402
from millrace.llm import bpe, toxicity  # noqa: E402

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def corpus() -> tuple[list, list]:
    rng = random.Random(8)
    words = ["".join(rng.choice("aeioultrnsm") for _ in range(rng.randrange(2, 9))) for _ in range(500)]
    docs, labels = [], []
    for i in range(240):
        own = [rng.choice(words) for _ in range(rng.randrange(30, 90))]
        if i % 8 == 0:
            for _ in range(3):
                own[rng.randrange(len(own))] = rng.choice(["zxidiot", "zxmoron", "zxclown"])
        text = " ".join(own)
        docs.append([i, text, "en", f"s{i % 3}" if i % 7 else None, len(text)])
        labels.append((i, i % 2, int(i % 8 == 0)))
    for i in range(240, 300):
        text = docs[i - 240][1]
        if i % 3:
            own = text.split()
            own[-1] = f"end{i}"
            text = " ".join(own)
        docs.append([i, text, "en", "s1", len(text)])
    docs += [[300, None, None, None, None], [301, "", "en", "s1", 0]]
    return docs, labels


def words_of(text) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def exact(docs: list) -> list:
    best: dict = {}
    for d in docs:
        if d[1] not in best or d[0] > best[d[1] or ""][0]:
            best[d[1] or ""] = d
    return list(best.values())


def near(docs: list) -> list:
    sets = []
    for d in docs:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words_of(d[1])]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= 80 * len(x | sets[j]):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, d in enumerate(docs):
        groups[find(i)].append(d)
    return [min(g) for g in groups.values()]


def mixed(docs: list, labels: list) -> list:
    quality = {i: 0.5 + q for i, q, _ in labels}
    sizes = defaultdict(int)
    for d in docs:
        sizes[d[3]] += len(words_of(d[1]))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, free, total = {}, set(order), 1.5 * sum(sizes.values())
    while True:
        left = total - sum(target.values())
        over = {s for s in free if weight[s] * left / sum(weight[x] for x in free) >= 2 * sizes[s]}
        if not over:
            break
        target |= {s: 2 * sizes[s] for s in over}
        free -= over
    left = total - sum(target.values())
    target |= {s: weight[s] * left / sum(weight[x] for x in free) for s in free}
    out = []
    for s in order:
        own = [d for d in docs if d[3] == s]

        def key(d):
            u = (int(hashlib.md5(f"mix:{d[0]}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            return -math.log(u) / quality.get(d[0], 1.0)

        budget = math.floor(target[s])
        epochs, rest = divmod(budget, sizes[s]) if sizes[s] else (0, 0)
        for d in sorted(own, key=lambda d: (key(d), d[0])):
            n = len(words_of(d[1]))
            part = max(0, min(n, rest))
            rest -= part
            out += [d] * math.ceil((epochs * n + part) / max(n, 1))
    return out


def test_pipeline(spark, tmp_path):
    docs, labels = corpus()
    spark.createDataFrame([tuple(d) for d in docs], KIND).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = toxicity.train(table, spark.read.parquet(str(tmp_path / "labels.parquet")))
    read = toxicity._Reader(set(model.weights))
    kept = [d for d in docs if 1 / (1 + math.exp(-(model.bias + sum(model.weights[f] for f in read(d[1]))))) < 0.3]
    assert sum("zx" in (d[1] or "") for d in kept) <= 3
    assert len(kept) > 0.8 * len(docs)
    encode = bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).encode_ordinary
    want = Counter()
    for d in mixed(near(exact(kept)), labels):
        ids = encode(d[1] or "")
        want[(d[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((d[1] or "").encode()).hexdigest())] += 1
    assert got == want


def test_near_dedup_compares_five_words(spark):
    own = [f"w{i}" for i in range(200)]
    other = [f"n{i}" if i in (20, 60, 100, 140, 180) else w for i, w in enumerate(own)]  # similarity 0.816 on four words, 0.774 on five
    docs = spark.createDataFrame([(1, " ".join(own), "en", "a", 0), (2, " ".join(other), "en", "a", 0)], KIND)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 2]


EXTRA = "row string, id int, _id int, score string, digest string, own string, _own string"


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    spark.createDataFrame([(1, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    empty = spark.createDataFrame([], f"{KIND}, {EXTRA}")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, empty, str(tmp_path))
        assert name == "byte_bpe" or got.columns == empty.columns
        assert got.count() == 0


def test_stages_keep_awkward_rows_whole(spark, tmp_path):
    spark.createDataFrame([(1, 1, 1), (2, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    more = ("r", 1, 2, "s", "d", "o", "p")
    data = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "one two three four five six", "en", "a", 0), (3, "one two three four five six", "en", "a", 0)]
    data += [(3, "quite another text of its own here", "en", "a", 0), (None, "nameless text with words of its own", "en", "b", 0), (None, "another nameless text about other things", "en", "b", 0)]
    data += [(9, "long " * 20000, "en", "b", 0)]
    docs = spark.createDataFrame([(*d, *more) for d in data], f"{KIND}, {EXTRA}")

    def rows(df) -> Counter:
        return Counter(tuple(r) for r in df.collect())

    stages, whole = dict(corpus_pipeline.STAGES), rows(docs)
    kept = rows(stages["toxicity"](spark, docs, str(tmp_path)))
    assert not kept - whole
    once = rows(stages["exact_dedup"](spark, docs, str(tmp_path)))
    assert once == Counter({(*d, *more): 1 for d in data if d[0] != 1})  # null counts as empty, and the larger doc_id stays
    near = rows(stages["near_dedup"](spark, docs, str(tmp_path)))
    assert near == Counter({(*d, *more): 1 for d in data})
    assert set(rows(stages["source_mix"](spark, docs, str(tmp_path)))) <= set(whole)
    assert stages["byte_bpe"](spark, docs, str(tmp_path)).count() == len(data)
