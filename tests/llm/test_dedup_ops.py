import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import embedding_dedup, exact_dedup, line_dedup, simhash, tiles, url_filter


def union_find(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
URLS = ["http://example.org/es/a", "HTTPS://A.Example.ORG/en/12?q", "http://org/x", "http://xorg/x", "ftp://a.com/de/#f", "http://a.com/fr/de/", "no scheme", None, "", "://", "http://b.org", "a://b://c.org/d", "http://example.org?x=/es/", "http://net/", "http://.org/"]


def judged(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    best = None
    for action, rule in RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = action, rule
    return host, path, best[1] if best else None, best[0] if best else "allow"


def test_url_rules_by_cascade(spark):
    pages = spark.createDataFrame([(n, u, "x", "y") for n, u in enumerate(URLS * 3)], "page_id long, url string, host string, rule string")
    got = {r.page_id: tuple(r)[1:] for r in url_filter.judge_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict").collect()}
    assert got == {n: judged(u) for n, u in enumerate(URLS * 3)}


def test_url_rules_of_nothing(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert url_filter.judge_urls(pages.limit(0), RULES).count() == 0
    assert url_filter.judge_urls(pages, []).first().verdict == "allow"


def test_url_filter_takes_long_urls_and_long_lists(spark):
    long = "http://a.com/de/" + "x" * 200_000
    pages = spark.createDataFrame([(1, long), (2, "http://" + "s." * 3000 + "com/de/"), (3, "http://h77.net/p77/x"), (4, "http://h78.net/p77/x"), (None, "http://com/fr/")], "page_id long, url string")
    rules = RULES + [("block", f"h{k}.net/p{k}/") for k in range(5000)]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules).collect()}
    assert got == {1: ("com/de/", "block"), 2: ("com/de/", "block"), 3: ("h77.net/p77/", "block"), 4: (None, "allow"), None: ("com/fr/", "allow")}


@pytest.mark.parametrize("levels", [1, 2, 40])
def test_cascade_that_ends_early_compares_the_rest(spark, levels):
    universe = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.filter("hash(key) % 7 = 0")
    member = url_filter.bloom_cascade(listed, universe, levels)
    got = {r.key for r in universe.filter(member(F.col("key"))).collect()}
    assert got == {r.key for r in listed.collect()}


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.filter("hash(key) % 9 = 0")
    member = url_filter.bloom_cascade(listed, universe)
    wrong = universe.join(listed.withColumn("in", F.lit(True)), "key", "left").filter(member(F.col("key")) != F.coalesce("in", F.lit(False)))
    assert listed.count() > 100 and wrong.count() == 0


def test_exact_dedup(spark):
    texts = ["hot"] * 60 + ["a", "b", "b", "", None, " ", "A", "x" * 200_000, "x" * 200_000]
    docs = spark.createDataFrame([(n, t, 1) for n, t in enumerate(texts)] + [(2, "hot", 1), (None, "b", 1), (None, "lone", 1)], "doc_id long, text string, id long")
    got = exact_dedup.exact_dedup(docs).collect()
    groups = {}
    for r in docs.collect():
        groups.setdefault(r.text or "", []).append(r.doc_id)
    want = []
    for members in groups.values():
        keep = max((m for m in members if m is not None), default=None)
        want += [(m, keep, len(members), m == keep) for m in members]
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=str) == sorted(want, key=str)
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def near_texts(seed=5):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 8)))
    out = ["", None, "one", "One", "two words", " \t\n"]
    for _ in range(12):
        base = [word() for _ in range(int(rng.integers(40, 200)))]
        for _ in range(6):
            copy = list(base)
            for _ in range(int(rng.integers(0, 3))):
                copy[int(rng.integers(len(copy)))] = word()
            out.append(" ".join(copy))
    return out


def brute_print(text, n=3):
    import xxhash

    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components_equal_brute_force(spark):
    texts = near_texts()
    docs = spark.createDataFrame([(n * 3, t, 7) for n, t in enumerate(texts)], "doc_id long, text string, fp long")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(docs).collect()}
    prints = [brute_print(t) for t in texts]
    roots = union_find(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    assert got == {n * 3: (f"{prints[n]:016x}", roots[n] * 3) for n in range(len(texts))}
    assert simhash.simhash_components(docs.limit(0)).count() == 0


def test_pivot_coordinates_bound_the_distance():
    rng = np.random.default_rng(6)
    a = rng.integers(-(2**63), 2**63 - 1, 4000)
    b = a ^ np.array([sum(1 << int(k) for k in rng.choice(62, rng.integers(0, 6), replace=False)) for _ in a])
    apart = np.bitwise_count((a ^ b).view(np.uint64)).astype(int)
    for blocks in (3, 6, 8):
        ta, tb = simhash.pivot_table(a, blocks), simhash.pivot_table(b, blocks)
        far = sum(simhash._farthest(ta[:, k], tb[:, k]) for k in range(blocks))
        assert (far <= apart).all() and (far[apart > 0] > 0).any()
        same = [((a ^ b).view(np.uint64) & np.uint64(m)) == 0 for m in simhash._block_masks(blocks)]
        assert all((ta[s, k] == tb[s, k]).all() for k, s in enumerate(same))


@pytest.mark.parametrize("radius", [0, 1, 3, 5])
def test_links_of_any_radius_equal_brute_force(spark, radius):
    rng = np.random.default_rng(radius)
    base = [int(x) for x in rng.integers(-(2**62), 2**62, 25)]
    prints = sorted({p ^ sum(1 << int(k) for k in rng.choice(62, rng.integers(0, 7), replace=False)) for p in base for _ in range(12)})
    links = simhash.hamming_links(spark.createDataFrame([(p,) for p in prints], "fp long"), radius, 64).collect()
    at = {p: n for n, p in enumerate(prints)}
    near = [(i, j) for i in range(len(prints)) for j in range(i) if ((prints[i] ^ prints[j]) & (1 << 64) - 1).bit_count() <= radius]
    assert union_find(len(prints), [(at[r.src], at[r.dst]) for r in links]) == union_find(len(prints), near)


def test_simhash_of_very_long_repeated_and_unnamed_rows(spark):
    rows = [(3, "word " * 60_000), (1, "word " * 60_000), (1, "word " * 60_000), (None, "word " * 60_000), (None, "lone text here"), (7, None), (5, "")]
    got = simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted([(3, 1), (1, 1), (1, 1), (None, 1), (None, None), (7, 5), (5, 5)], key=str)


def test_hot_keys_in_tiles_lose_no_link(spark):
    rng = np.random.default_rng(0)
    base = int(rng.integers(0, 2**62))
    prints = sorted({base ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(300)})
    prints = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    roots = union_find(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if ((prints[i] ^ prints[j]) & (1 << 64) - 1).bit_count() <= 3])
    for most in (4096, 20):
        links = simhash.hamming_links(frame, most=most).collect()
        at = {p: n for n, p in enumerate(prints)}
        assert union_find(len(prints), [(at[r.src], at[r.dst]) for r in links]) == roots
        assert most < 4096 or len(links) <= 20 * len(prints)


def test_forest_keeps_a_spanning_set():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 500, 4000), rng.integers(0, 500, 4000)
    x, y = tiles.Forest(500).add(a, b)
    assert len(x) < 500 and union_find(500, zip(x, y, strict=True)) == union_find(500, zip(a, b, strict=True))


@pytest.mark.parametrize("most", [2048, 7])
def test_embedding_components_equal_brute_force(spark, most):
    rng = np.random.default_rng(2)
    rows = []
    for n in range(120):
        v = rng.normal(size=16)
        for k in range(int(rng.integers(1, 4))):
            rows.append((len(rows), (v + rng.normal(size=16) * (0.12 * k)).astype(np.float32).tolist(), n % 3))
    rows += [(len(rows) + k, rows[0][1], rows[0][2]) for k in range(5)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, rows[0][1], None), (904, [None] * 16, 1), (905, [float("inf")] * 16, 1), (906, [], 1), (907, rows[0][1][:8], rows[0][2])]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, same string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_components(frame, most=most).collect()}
    usable = [k for k, r in enumerate(rows) if r[0] < 900]
    v = np.array([rows[k][1] for k in usable], np.float64)
    lengths = np.sqrt((v * v).sum(1))
    near = (v @ v.T / np.outer(lengths, lengths) >= 0.93) & (np.array([rows[k][2] for k in usable])[:, None] == np.array([rows[k][2] for k in usable])[None, :])
    np.fill_diagonal(near, False)
    roots = union_find(len(usable), list(zip(*np.nonzero(near), strict=True)))
    want = {k: (int(near[k].sum()), roots[k], roots[k] == k) for k in usable} | {r[0]: (0, r[0], True) for r in rows if r[0] >= 900}
    assert near.sum() > 50 and got == want
    assert embedding_dedup.embedding_components(frame.limit(0)).count() == 0


def test_labels_with_parts_of_vectors_stay_apart(spark):
    rows = [(1, [2.0], "x,1.0"), (2, [1.0, 2.0], "x"), (3, [1.0, 2.0], "x"), (4, [2.0], "x,1.0,"), (5, [1.0], "x:1"), (6, [1.0], "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.embedding_components(frame).collect()}
    assert got == {1: (0, 1), 2: (1, 2), 3: (1, 2), 4: (0, 4), 5: (0, 5), 6: (0, 6)}


def test_quantisation_bound_holds():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(200, 32))
    a[1] = a[0] * 1.0001
    i, j = embedding_dedup.tile_links(a, a, 0.5)
    unit = a / np.linalg.norm(a, axis=1, keepdims=True)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*map(np.ndarray.tolist, np.nonzero(unit @ unit.T >= 0.5)), strict=True))


def line_docs(seed=4):
    rng = np.random.default_rng(seed)
    vocabulary = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 7))) for _ in range(400)]
    base = [[str(w) for w in rng.choice(vocabulary, rng.integers(3, 60))] for _ in range(40)]
    docs = []
    for n in range(60):
        lines = []
        for _ in range(int(rng.integers(1, 8))):
            line = list(base[int(rng.integers(40))])
            for _ in range(int(rng.integers(0, 8))):
                line[int(rng.integers(len(line)))] = str(rng.choice(vocabulary))
            lines.append(" ".join(line))
        docs.append((n, "\n".join(lines)))
    common = " ".join(vocabulary[:12])
    return docs + [(200 + k, f"{common}\n\nshort line\n{common.upper()} {vocabulary[k]}") for k in range(40)] + [(300, None), (301, ""), (302, "\n\n"), (303, "a b c d e\na b c d e")]


def brute_lines(docs, least=5, threshold=0.8):
    seen, out = [], {}
    for doc, text in sorted(docs, key=lambda d: d[0]):
        kept = []
        for line in (text or "").split("\n"):
            words = frozenset(line.encode().lower().split())
            if len(words) >= least:
                hit = any(len(words & s) / len(words | s) >= threshold - 1e-12 for s in seen)
                seen.append(words)
                if hit:
                    continue
            kept.append(line)
        out[doc] = None if text is None else "\n".join(kept) if text else ""
    return out


@pytest.mark.parametrize(("most", "first"), [(4096, 64), (3, 1)])
def test_line_dedup_equals_brute_force(spark, monkeypatch, most, first):
    monkeypatch.setattr(line_dedup, "CANDIDATES", first)
    docs = line_docs()
    frame = spark.createDataFrame([(d, t, "x", 3) for d, t in docs], "doc_id long, text string, sig string, line int").repartition(5)
    got = line_dedup.dedup_lines(frame, least=5, most=most)
    assert got.columns == ["doc_id", "text", "sig", "line", "n_lines", "n_removed"]
    assert {r.doc_id: r.text for r in got.collect()} == brute_lines(docs)


def long_line_docs(seed=9):
    """Lines of 70 to 3000 words, some a few words apart, so that bitmaps of every width meet."""
    rng = np.random.default_rng(seed)
    out = []
    for n, size in enumerate([70, 79, 82, 100, 150, 170, 300, 330, 640, 660, 1290, 3000]):
        base = [f"w{rng.integers(0, 5000)}" for _ in range(size)]
        for k in range(4):
            copy = list(base)
            for place in rng.choice(size, size * k // 28, replace=False):
                copy[int(place)] = f"x{rng.integers(0, 10**9)}"
            out.append((n * 10 + k, " ".join(copy[: len(copy) - k * size // 40])))
    return [out[k] for k in rng.permutation(len(out))]


@pytest.mark.parametrize(("most", "first"), [(4096, 4), (3, 1)])
def test_line_dedup_of_long_lines_and_clashing_names(spark, monkeypatch, most, first):
    monkeypatch.setattr(line_dedup, "CANDIDATES", first)
    docs = long_line_docs()
    names = ["doc", "sig", "line", "other", "removed_doc", "removed_lines", "REMOVED_DOC_", "__doc", "__gone", "text", "n_removed"]
    frame = spark.createDataFrame([(d, *[1] * 9, t, 5) for d, t in docs], ["doc_id", *names]).repartition(3)
    got = line_dedup.dedup_lines(frame, most=most)
    want = brute_lines(docs, least=1)
    assert got.columns == ["doc_id", *names[:-1], "n_lines", "n_removed"] and sum(t == "" for t in want.values()) > 12
    assert {r.doc_id: r.text for r in got.collect()} == want


def test_line_dedup_of_a_huge_text_and_string_ids(spark):
    docs = [("b", "\n".join(f"line number {k % 70_000} of the text" for k in range(70_100))), ("a", "line number 5 of the text\n\nx"), ("c", None), ("d", "x\nx y")]
    frame = spark.createDataFrame(docs, "doc_id string, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame).collect()}
    assert got == brute_lines_of_sets(docs) and len(got["b"]) > 1000


def brute_lines_of_sets(docs):
    """Of lines whose every near copy is an exact one (of five words here, one apart from the others)."""
    seen, out = set(), {}
    for doc, text in sorted(docs):
        kept = []
        for line in (text or "").split("\n"):
            if not line or frozenset(line.split()) not in seen:
                kept.append(line)
            seen.add(frozenset(line.split()))
        out[doc] = None if text is None else "\n".join(kept)
    return out


def test_line_dedup_edge_cases(spark):
    frame = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    assert [r.text for r in line_dedup.dedup_lines(frame).collect()] == ["a b c d e f"] * 3
    assert line_dedup.dedup_lines(frame.limit(0)).count() == 0
    named = spark.createDataFrame([("b", "a b c d e f"), ("a", "a b c d e f")], "doc_id string, text string")
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(named).collect()} == {"a": "a b c d e f", "b": ""}


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = [(n, t or f"plain words of document {n} that nobody else has written {n * 7} times", "en", "s", 0) for n, t in line_docs() if n < 60]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(n, n % 2) for n in range(20)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "pii", "packing"]
    lines = corpus_pipeline.lines(spark, frame, str(tmp_path))
    assert lines.columns == frame.columns and {r.doc_id: r.text for r in lines.collect()} == brute_lines([d[:2] for d in docs])
    assert all(r.n_chars == len(r.text) for r in lines.collect())
    copies = frame.limit(1).unionByName(frame.limit(1).withColumn("doc_id", F.lit(999).cast("long")))
    assert [r.doc_id for r in corpus_pipeline.near_duplicates(spark, copies, "").collect()] == [frame.limit(1).first().doc_id]
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0 and "sequence_id" in out.columns


def test_pipeline_takes_nulls_repeated_rows_clashing_names_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    names = ["doc", "sig", "line", "key", "removed_doc", "__text", "fp", "score"]
    rows = [(n, t, "en", "s", len(t or ""), *range(8)) for n, t in line_docs() if n < 40 or n > 298]
    rows += [(5, rows[5][1], "en", "s", 9, *range(8)), (None, "no id at all", "en", "s", 9, *range(8)), (None, None, None, None, None, *range(8)), (700, "x" * 150_000 + " mail a@b.cd", "en", "s", 9, *range(8))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names)
    labels = spark.createDataFrame([(n, n % 2) for n in range(20)] + [(None, 1), (3, None)], "doc_id long, quality int")
    for name, part in (("full", rows), ("none", [])):
        frame = spark.createDataFrame(part, schema)
        (tmp_path / name).mkdir()
        frame.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
        docs = spark.read.parquet(str(tmp_path / name / "documents.parquet"))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path / name))
            assert out.columns == frame.columns and out.count() <= len(part)
        ids = [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path / name)).collect()]
        assert bool(ids) == bool(part) and (not part or {None, 700} <= set(ids))


def test_line_dedup_takes_short_lines(spark, tmp_path):
    import corpus_pipeline
    from tidemark.llm import queries

    docs = line_docs() + [(400 + k, t) for k, t in enumerate(["All rights reserved.\n\n漢字の行\n- -", "all RIGHTS reserved.\n \n\n漢字の行\nw x y z", "z y x w v\nx\nX x x\nw x y\n" + "la " * 50, "la\nz y w x"])]
    frame = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, n_chars int").repartition(3)
    want = brute_lines(docs, least=1)
    assert want[401] == " \n\nw x y z" and want[402] == "x\nw x y\nla " + "la " * 49 and want[403] == ""
    assert {r.doc_id: r.text for r in corpus_pipeline.lines(spark, frame, "").collect()} == want
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(frame, least=0).collect()} == want
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    gone = {r.doc_id: r.n_removed for r in queries.op9_line_dedup(spark, str(tmp_path)).collect()}
    assert gone[401] == 2 and gone[402] == 2 and gone[403] == 2
