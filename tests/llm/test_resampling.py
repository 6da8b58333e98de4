import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import resampling
from tidemark.llm.resampling import Table, equal_ranges, occurrences, pieces, resample, slices, xxh64

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, rank string, bucket int, score double"


def features(text, longest):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)], len(words)


def brute(docs, target, percent=10, least=20, longest=1, buckets=10_000, seed=2024):
    spot = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(spot(f) for text in texts for f in features(text, longest)[0]) for texts in ([d[1] for d in docs], target))
    S, N = sum(s.values()), sum(t.values())
    out = []
    for doc_id, text, *_ in docs:
        own, words = features(text, longest)
        gains = [math.floor(1000 * math.log((t[spot(f)] + 1) * (S + buckets) / ((s[spot(f)] + 1) * (N + buckets)))) for f in own]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words >= least])
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for n, r in enumerate(fit):
        r[4] = n + 1 if n < len(fit) * percent // 100 else None
    return sorted([tuple(r[:4]) + (r[4] or None,) for r in out], key=str)


def texts(seed, n, alphabet="ab Z9é日_-\n\x7f{"):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list(alphabet), rng.integers(0, 160))) for _ in range(n)]


@pytest.mark.parametrize(("longest", "buckets"), [(1, 10_000), (2, 50), (3, 7)])
def test_ranks_equal_brute_force(spark, rows, longest, buckets):
    docs = [(n, t, "x", 3, 0.1) for n, t in enumerate(texts(1, 300))] + [(7, "again again", "x", 1, 0.0), (7, "again again", "x", 1, 0.0)]
    docs += [(None, "no id " * 20, None, None, None), (1000, None, "x", 1, 1.0), (1001, "", "x", 1, 1.0), (1002, "one " * 5000, "x", 1, 1.0)]
    target = texts(2, 40) + [None, ""]
    got = resample(spark.createDataFrame(docs, SCHEMA).repartition(5), spark.createDataFrame([(t,) for t in target], "text string"), longest=longest, buckets=buckets)
    assert rows(got) == brute(docs, target, longest=longest, buckets=buckets)
    assert sum(r.rank is not None for r in got.collect()) > 10


def test_ties_and_repeated_rows_are_ranked_each(spark):
    docs = [(5, "w " * 30, None, None, None)] * 40
    got = resample(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([("w",)], "text string"), percent=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 21)) and len(got) == 40


def test_empty_tables(spark, rows):
    docs = [(n, t, None, None, None) for n, t in enumerate(texts(3, 30))]
    full, none = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([], SCHEMA)
    assert resample(none, full).count() == 0
    assert rows(resample(full, none)) == brute(docs, [])


def test_hashes_equal_the_library():
    from xxhash import xxh64_intdigest

    data = np.frombuffer(np.random.default_rng(4).bytes(5000), np.uint8)
    starts, sizes = np.arange(0, 4000, 17), np.arange(0, 4000, 17) % 70
    for seed in (0, 42):
        assert xxh64(data, starts, sizes, seed).tolist() == [xxh64_intdigest(data[a : a + n].tobytes(), seed) for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


@pytest.mark.parametrize("hashes", [xxh64, lambda d, a, n: np.zeros(len(a), np.uint64), lambda d, a, n: (a % 3).astype(np.uint64) * 0 + n.astype(np.uint64)])
def test_table_tells_equal_hashes_apart(hashes, monkeypatch):
    """Keys that all collide are told apart by their bytes, through growth of the table, with ranges that begin at one place."""
    monkeypatch.setattr(resampling, "STEP", 64)
    units = [(n, t.encode().lower(), 0) for n, t in enumerate(texts(5, 12))]
    data, begins, sizes, of, words = occurrences(units, 2)
    table = Table(data, 97, hashes, bits=2)
    slot = table.intern(begins, sizes)
    want = [data[a : a + n].tobytes() for a, n in zip(begins.tolist(), sizes.tolist(), strict=True)]
    names = {}
    for s, w in zip(slot.tolist(), want, strict=True):
        assert names.setdefault(s, w) == w
    count = Counter(want)
    assert len(names) == len(count) == table.used
    for s, w in names.items():
        assert table.count[s] == count[w] and table.bucket[s] == zlib.crc32(w) % 97
    assert table.count.sum() == len(want)


def test_occurrences_are_the_features():
    for longest in (1, 2, 4):
        for size in (1, 9, 64, 1 << 20):  # pieces of long texts count no run twice and lose none
            found, words = Counter(), Counter()
            some = texts(6, 40) + ["", "a" * 300, "é" * 70 + " x", " y", "a b c d e f g"]
            for units in slices(some, longest, size):
                data, begins, sizes, of, word_of = occurrences(units, longest)
                found.update((n, data[a : a + k].tobytes().decode()) for n, a, k in zip(of.tolist(), begins.tolist(), sizes.tolist(), strict=True))
                words.update(word_of.tolist())
            assert found == Counter((n, f) for n, t in enumerate(some) for f in features(t, longest)[0])
            assert words == Counter({n: features(t, 1)[1] for n, t in enumerate(some) if features(t, 1)[1]})


def test_pieces_are_bounded():
    text = b"word " * 10_000
    assert max(len(p) for p, _ in pieces(text, 1, 1000)) <= 1000
    assert b"".join(p for p, _ in pieces(text, 1, 1000)) == text


def test_equal_ranges():
    data = np.frombuffer(b"abcabd", np.uint8)
    assert equal_ranges(data, np.array([0, 0]), np.array([3, 3]), np.array([2, 3])).tolist() == [True, False]
