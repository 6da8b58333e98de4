import re

import numpy as np
import pytest

from tidemark.llm import shingle_dedup


def brute_set(text, n=5):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def planted(seed=8):
    """Documents, and copies of them with so many words changed that similarities spread over 0.7 to 0.97."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 8)))
    out = ["", None, " \n", "one", "One", "a b c d", "a b c d e", "A b\nc d"]
    for _ in range(30):
        base = [word() for _ in range(int(rng.integers(30, 600)))]
        out.append(" ".join(base))
        for _ in range(4):
            copy = list(base)
            for k in rng.choice(len(base), max(1, int(len(base) * rng.uniform(0.003, 0.035))), replace=False):
                copy[int(k)] = word()
            out.append("\n".join(copy))
    rng.shuffle(out)
    return out


def brute_gone(texts):
    sets = [brute_set(t) for t in texts]
    return {j for j in range(len(sets)) for i in range(j) if jaccard(sets[i], sets[j]) >= 0.8 - 1e-12}


@pytest.mark.parametrize(("most", "first"), [(4096, 2), (3, 1)])
def test_pipeline_drops_what_five_word_similarity_says(spark, monkeypatch, most, first):
    import corpus_pipeline

    monkeypatch.setattr(shingle_dedup, "CANDIDATES", first)
    monkeypatch.setattr(shingle_dedup.near_copies, "__defaults__", (*shingle_dedup.near_copies.__defaults__[:-1], most))
    texts = planted()
    sets = [brute_set(t) for t in texts]
    near = [jaccard(sets[i], sets[j]) for j in range(len(sets)) for i in range(j)]
    assert sum(0.8 <= x < 0.85 for x in near) > 5 and sum(0.85 <= x < 0.95 for x in near) > 20 and sum(0.7 <= x < 0.8 for x in near) > 5
    docs = spark.createDataFrame([(n, t, 7) for n, t in enumerate(texts)] + [(None, texts[0], 7)], "doc_id long, text string, low long").repartition(5)
    kept = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(kept, key=str) == sorted([None, *set(range(len(texts))) - brute_gone(texts)], key=str)


def test_shingle_sets_equal_brute_force():
    texts = ["", *[t or "" for t in planted(3)]]
    words, size = shingle_dedup.shingle_sets(texts)
    assert size.tolist() == [len(brute_set(t)) for t in texts]
    parts = [set(p.tolist()) for p in np.split(words, np.cumsum(size)[:-1])]
    want = [brute_set(t) for t in texts]
    assert all(len(parts[i] & parts[j]) == len(want[i] & want[j]) for i in range(len(texts)) for j in range(i))


def test_chains_names_and_nothing(spark):
    base = [f"w{k}" for k in range(100)]
    one, two = base[:88], base[12:]  # 0.875 with the base, 0.75 with each other
    docs = spark.createDataFrame([("a", " ".join(one)), ("b", " ".join(two)), ("c", " ".join(base)), ("d", " ".join(base[30:]))], "name string, text string")
    got = {r.name for r in shingle_dedup.near_copies(docs, "name").collect()}
    assert got == {"c"} and shingle_dedup.near_copies(docs.limit(0), "name").count() == 0


def test_pipeline_verifies_what_simhash_links(spark, monkeypatch):
    """Without any min-hash proposal the documents that SimHash links go, where their similarity is 0.8."""
    import corpus_pipeline

    base = [f"w{k}" for k in range(2000)]
    near, far = [*base[:-1], "x"], [w for k in range(100) for w in base[20 * k : 20 * k + 18]]
    texts = [" ".join(t) for t in (base, near, far)] + ["others " * 9, "a b c d e f", "a b c d e f"]
    docs = spark.createDataFrame([(10 - n, t) for n, t in enumerate(texts)], "doc_id long, text string")
    assert {(r.doc, r.other) for r in corpus_pipeline.simhash_links(docs).collect()} >= {(10, 9), (6, 5)}
    monkeypatch.setattr(shingle_dedup, "_proposals", lambda c, *_: {"sig": c["sig"][:0], "other": c["sig"][:0], "full": c["sig"][:0] > 0})
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [5, 7, 8, 9]
    chained = [(1, base), (2, near), (3, [f"y{k}" for k in range(500)])]
    links = spark.createDataFrame([(2, 1), (3, 1)], "doc long, other long")
    docs = spark.createDataFrame([(n, " ".join(t)) for n, t in chained], "doc_id long, text string")
    assert [r.doc_id for r in shingle_dedup.near_copies(docs, links=links).collect()] == [2]


def test_rows_that_repeat_an_id_are_judged_each(spark):
    import corpus_pipeline

    one, two = (" ".join(f"{c}{k}" for k in range(50)) for c in "ab")
    docs = spark.createDataFrame([(3, one, 0), (5, one, 1), (5, two, 2), (7, two, 3), (5, None, 4), (2, "", 5)], "doc_id long, text string, n int")
    assert sorted(r.n for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [0, 2, 5]
