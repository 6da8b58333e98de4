import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import pii, piece_codec, quality, sentence_model, token_counts
from tidemark.llm.common import tokenizer_path
from tidemark.llm.packing import Packer, WordIds, pack
from tidemark.llm.pii_model import KINDS, TAGS, BiLstmCrf, allowed, codes, reconcile, tags_of, windows

MODEL = "piece_bpe_32k.model"
ODD = ["", " ", "  a", "a ", "\n", "▁", "<s></s>", " " * 40, "a" * 300, "é́日本😀ß\0x", "one two\n\nthree", "the <unk> of", "x▁ y ▁▁z", "tab\tend\r\n"]


@pytest.fixture(scope="module")
def docs(spark):
    """Odd texts, nulls, repeated rows, and extra columns with names that the operators use."""
    rows = [(n, t, n, "x", 0.5) for n, t in enumerate(ODD)] + [(100, None, 1, "x", 0.5), (3, ODD[3], 3, "x", 0.5), (None, "no id", 1, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, id long, digest string, score double")


def random_texts(n, seed=1, alphabet="abcé ▁\n\t日😀the<s>\0ain̂"):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list(alphabet), rng.integers(0, 60))) for _ in range(n)]


def test_encoder_equals_the_library_with_spans():
    model = sentence_model.load(tokenizer_path(MODEL))
    encoder = piece_codec.Encoder(model)
    for text in ODD + random_texts(800):
        ids, align = encoder.encode(text)
        assert ids.tolist() == model.library.encode(text)
        begins, ends = encoder.spans(ids, align)
        proto = model.library.encode(text, return_type="proto")
        assert list(zip(begins.tolist(), ends.tolist(), strict=True)) == [(p.begin, p.end) for p in proto.pieces]


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
@pytest.mark.parametrize("squeeze", [True, False])
def test_normaliser_equals_the_library(rule, squeeze):
    import sentencepiece

    theirs = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=squeeze)
    spec = dict(sentence_model._fields(dict(sentence_model._fields(theirs.serialized_model_proto()))[3]))
    ours = sentence_model.SentenceModel.__new__(sentence_model.SentenceModel)
    ours.map, ours.dummy_prefix, ours.squeeze, ours.escape = sentence_model.CharacterMap(spec.get(2, b"")), True, squeeze, True
    for text in ODD + ["ＡＢＣ  ｶﾞ ﬁ①㍿  x", "é́ Å\t​　 z "] + random_texts(300, 2):
        want, offsets = theirs.normalize(text, with_offsets=True)
        got, align = ours.normalize(text)
        source = np.cumsum([0] + [len(c.encode()) for c in text])
        mine = np.cumsum([0] + [len(c.encode()) for c in got])
        assert got == want and [int(source[o]) for o in offsets] == align[mine].tolist()


def test_round_trip_query(spark, docs):
    lib = sentence_model.load(tokenizer_path(MODEL)).library
    got = sorted(map(tuple, piece_codec.round_trip(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()), key=str)
    want = []
    for r in docs.collect():
        ids = [*lib.encode(r.text or ""), 2]
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    coded = piece_codec.encode_texts(docs.filter("doc_id = 10"))
    row = coded.first()
    assert row.ids[-1] == 2 and row.ends[-1] == len(ODD[10].encode()) and piece_codec.decode_ids(coded).first().text == ODD[10]
    assert piece_codec.round_trip(docs.limit(0)).count() == 0


@pytest.mark.parametrize("chunk", [1, 5, 8192])
def test_token_counts_equal_the_library(chunk):
    machine, model = token_counts.compiled(tokenizer_path(MODEL))
    texts = ODD + random_texts(400, 3, "abcé ▁\n日thentionou") + ["word " * 5000, "x" * 3000]
    assert token_counts.count_tokens(machine, model, texts, chunk) == [len(i) for i in model.library.encode(texts)]


def test_texts_without_spaces_are_read_about_once(monkeypatch):
    machine, model = token_counts.compiled(tokenizer_path(MODEL))
    words = "".join(random_texts(3000, 8, "thentionouéra"))[:60_000]
    read, run = [0], token_counts.Transducer.run

    def counted(self, state, text):
        read[0] += len(text)
        return run(self, state, text)

    monkeypatch.setattr(token_counts.Transducer, "run", counted)
    for text in (words, "a" * 60_000, "ab=" * 20_000):
        read[0] = 0
        assert token_counts.count_tokens(machine, model, [text], 512) == [len(model.library.encode(text))]
        assert read[0] <= 2.2 * len(text)


def test_token_count_query(docs):
    lib = sentence_model.load(tokenizer_path(MODEL)).library
    got = sorted(map(tuple, token_counts.token_counts(docs, limit=3).collect()), key=str)
    want = [(r.doc_id, len((r.text or "").encode()), n := len(lib.encode(r.text or "")), n > 3) for r in docs.collect()]
    assert got == sorted(want, key=str)
    assert token_counts.token_counts(docs.limit(0)).count() == 0


def test_word_ids_equal_the_library():
    words = WordIds(tokenizer_path("word_bpe_49k.json"), entries=50)
    alphabet = "abcéABÉÑ ß€'’—…st09.,!#$¿«\n²ªµİΣ\x85\xa0\x1c日"
    for text in ODD + ["<|endoftext|>a", "it's DON'T we'll"] + random_texts(600, 4, alphabet) + random_texts(600, 5, "abcdefghij ÀÉ.,'st\n"):
        assert np.frombuffer(words.ids(text), "<u4").tolist() == words.library.encode(text, add_special_tokens=False).ids


def check_packing(rows, docs, lib, window):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == window or at & (at - 1) == 0
    for doc, text in docs:
        ids, at = np.array([*lib.encode(text or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


@pytest.mark.parametrize("open_windows", [2, 4096])
def test_packing(spark, docs, open_windows):
    lib = WordIds(tokenizer_path("word_bpe_49k.json")).library
    unique = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    more = spark.createDataFrame([(1000 + n, "word " * (n * 37 % 90)) for n in range(60)] + [(2000, "long text " * 500)], "doc_id long, text string")
    both = unique.select("doc_id", "text").unionByName(more)
    got = pack(both, window=64, open_windows=open_windows).collect()
    check_packing(got, [tuple(r) for r in both.collect()], lib, 64)
    assert pack(docs.limit(0)).count() == 0
    nameless = pack(docs).filter("doc_id is null").collect()
    assert sum(r.length for r in nameless) == nameless[0].doc_tokens == 3


def test_placement_minimises_the_sum_of_squares():
    out = []
    packer = Packer(lambda *a: out.append(a), window=10)
    rng = np.random.default_rng(0)
    for n in range(400):
        size = int(rng.integers(1, 10))
        before = packer.counts.copy()
        options = {}
        for level in [0, *np.flatnonzero(before[1:10] > 0) + 1]:
            if level + size <= 10:
                after = before.copy()
                after[level] -= level > 0
                if level + size < 10:
                    after[level + size] += 1
                options[level] = int((after**2).sum())
        packer.add(n, b"\0\0\0\0" * size)
        assert int((packer.counts**2).sum()) == min(options.values())
    packer.close()
    assert sum(len(x[2]) for x in out) // 4 == sum(x[3] for x in {a[0]: a for a in out}.values())


def brute_spans(text):
    import re

    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 14 <= len(digits) <= 19 and pii.luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


def test_base_spans_equal_the_patterns():
    parts = ["1", "55", "255", "300", ".", ".", "@", "a", "b.c", "+", "-", " ", "(", ")", "x@y.z", "4111 1111 1111 1111", "+1 (743) 555-3824", "é", "²"]
    rng = np.random.default_rng(6)
    for _ in range(8000):
        text = "".join(rng.choice(parts, rng.integers(0, 18)))
        assert pii.base_spans(text) == brute_spans(text)


def test_gradient_of_the_model():
    model = BiLstmCrf.fresh(1)
    x = np.array([codes("ab 1.2"), codes("x@y.cc")])
    y = np.array([tags_of(6, [(1, 3, 6)]), tags_of(6, [(0, 0, 6)])])
    x[0, 5] = 0
    y[0, 5] = 0
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    _, g = model.gradient(x, y)
    rng = np.random.default_rng(2)
    model.p["move"] = np.where(allowed(), np.random.default_rng(3).normal(0, 0.3, (9, 9)), -30.0)
    _, g = model.gradient(x, y)
    for name in ("embed", "wf", "wb", "cf", "cb", "out", "bias", "move"):
        flat = model.p[name].reshape(-1)
        for k in rng.choice(np.flatnonzero(g[name].reshape(-1)), 3):
            kept, step = flat[k], 1e-3
            flat[k] = kept + step
            up, _ = model.gradient(x, y)
            flat[k] = kept - step
            down, _ = model.gradient(x, y)
            flat[k] = kept
            assert g[name].reshape(-1)[k] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=2e-4)


def test_tags_and_posteriors_equal_enumeration():
    """Every path of tags over short windows of unlike lengths, scored one by one."""
    import itertools

    model = BiLstmCrf.fresh(3)
    rng = np.random.default_rng(4)
    model.p["move"] = np.where(allowed(), rng.normal(0, 1.0, (TAGS, TAGS)), -30.0)
    model.p["out"] = model.p["out"] * 6
    x = np.array([codes("a1.@"), codes("9 +\0")])
    x[1, 3] = 0
    em = model.emissions(x).astype(np.float64)
    em[:, 0, 2::2] = -30.0
    for n, size in ((0, 4), (1, 3)):
        paths = list(itertools.product(range(TAGS), repeat=size))
        score = np.array([sum(em[n, t, p[t]] for t in range(size)) + sum(model.p["move"][p[t], p[t + 1]] for t in range(size - 1)) for p in paths])
        weight = np.exp(score - score.max())
        best = paths[int(score.argmax())]
        tags, sure = model.tag(x)[n]
        assert tuple(tags) == best
        for t in range(size):
            mine = sum(w for w, p in zip(weight, paths, strict=True) if p[t] == best[t]) / weight.sum()
            assert sure[t] == pytest.approx(mine, rel=1e-3)


class Marks:
    """A stand-in that tags runs of Z as an address, as a window sees them."""

    def tag(self, x):
        out = []
        for row in x:
            row = row[row > 0]
            tags = [0 if c != ord("Z") else 2 if k and row[k - 1] == ord("Z") else 1 for k, c in enumerate(row)]
            out.append((tags, [1.0] * len(tags)))
        return out


@pytest.mark.parametrize("size", [6, 47, 48, 49, 60, 90, 150, 400])
def test_spans_of_any_length_are_whole_at_every_offset(monkeypatch, size):
    monkeypatch.setattr(pii, "plausible", lambda kind, span: True)
    monkeypatch.setattr(pii, "stretches", lambda text: [(0, len(text))])
    texts = ["x" * at + "Z" * size + "x" * (170 - at % 97) for at in range(200)]
    assert pii.model_spans(Marks(), texts) == [[(at, 0, at + size)] for at in range(200)]


def test_stretches_hold_whole_words_around_anchors():
    long = "someone." * 9 + "(AT)" + "mail." * 12 + "com"
    for text in (f"see {long} now", f"see {long.replace('(AT)', ' at ')} now", f"see {long.replace('(AT)', ' { at } ')} now"):
        parts = pii.stretches(text)
        assert parts and parts[0][0] <= 4 and max(b for _, b in parts) >= len(text) - 4
    assert pii.stretches("a dog sat at home. no data") == [] and pii.stretches("call ٠١٢٣") != []
    assert pii.stretches("") == []


def test_plausible_spans():
    assert pii.plausible(0, "a (at) b.c") and not pii.plausible(0, "token = abe29")
    assert pii.plausible(1, "1 . 2 . 3 . 255") and not pii.plausible(1, "1.2.3.256") and not pii.plausible(1, "1.2.3")
    assert pii.plausible(2, "4111.1111.1111.1111") and not pii.plausible(2, "4111.1111.1111.1112")
    assert pii.plausible(3, "(743) 555-3824") and not pii.plausible(3, "555-3824")


def test_windows_and_reconciliation():
    assert windows(0, 10, 96, 48) == [(0, 10)] and windows(0, 200, 96, 48) == [(0, 96), (48, 144), (96, 192), (144, 200)]
    got = reconcile([(0, 0, 10, 0.9), (0, 0, 10, 0.95), (1, 8, 12, 0.99), (2, 12, 20, 0.5)])
    assert got == [(0, 0, 10, 0.95), (2, 12, 20, 0.5)]


@pytest.fixture(scope="module")
def private(spark):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("etaoinshr"), rng.integers(2, 8)))
    rows = []
    for n in range(240):
        span = [f"{word()}.{n % 90:02d}@mail{n % 9}.example.com", f"{n % 200}.{n % 250}.{n % 99}.{n % 31}", f"+1 ({200 + n}) 555-{1000 + n}", "no data 12 here"][n % 4]
        rows.append((n, " ".join([word() for _ in range(12)] + [span] + [word() for _ in range(12)])))
    return spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")


@pytest.fixture(scope="module")
def fitted(private):
    return pii.fit_pii(private.filter("doc_id % 3 > 0"))


def test_pii_query_keeps_base_spans(private, fitted):
    got = {r.doc_id: r for r in pii.find_pii(private, model=fitted).collect()}
    for r in private.collect():
        base = brute_spans(r.text or "")
        text = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert got[r.doc_id].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(got[r.doc_id].spans.split(","))


def test_disguised_spans_of_held_out_texts_are_added(private, fitted):
    """Learned spans alone, at the operator's own threshold: the patterns miss all of these."""
    rng = np.random.default_rng(31)
    found = total = extra = 0
    for r in private.filter("doc_id % 3 = 0").collect():
        for a, kind, b in brute_spans(r.text or "")[:1]:
            for _ in range(2):
                span = pii.disguised(pii.varied(r.text[a:b], kind, rng), kind, rng)
                text = r.text[:a] + span + r.text[b:]
                if brute_spans(text):
                    continue
                total += 1
                ((base, added),) = pii.all_spans([text], fitted)
                assert not base
                found += (a, kind, a + len(span)) in added
                extra += sum(not (s < a + len(span) and a < e) for s, _, e in added)
    assert total > 60 and found / total >= 0.9 and extra <= 0.05 * total


def test_clean_texts_get_no_spans(private, fitted):
    clean = [r.text for r in private.filter("doc_id % 4 = 3 and doc_id < 900").collect()]
    decoys = [c.replace("12", "7663683147833395") for c in clean] + [c.replace("12", "on 2024-01-02 at 10:30") for c in clean]
    assert all(not base and not added for base, added in pii.all_spans(clean + decoys, fitted))


def test_redaction_and_edge_cases(spark, fitted):
    rows = [(1, "write to jane.doe@example.com or +1 (743) 555-3824", "k"), (2, None, None), (3, "", ""), (1, "write to jane.doe@example.com or +1 (743) 555-3824", "k"), (None, "from 10.0.0.1", "x"), (5, "word " * 60_000 + "a@b.cd", "y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    done = pii.redact_pii(frame, model=fitted)
    assert done.columns == frame.columns
    text = {r.doc_id: r.text for r in done.collect()}
    assert text[1] == "write to <email> or <phone>" and text[2] is None and text[3] == "" and text[None] == "from <ip>" and text[5].endswith("word <email>")
    got = pii.find_pii(frame, model=fitted).collect()
    assert len(got) == 6 and {(r.doc_id, r.n_email, r.n_ip, r.n_phone) for r in got} == {(1, 1, 0, 1), (2, 0, 0, 0), (3, 0, 0, 0), (None, 0, 1, 0), (5, 1, 0, 0)}
    assert pii.find_pii(frame.limit(0), model=fitted).count() == 0 and pii.redact_pii(frame.limit(0), model=fitted).count() == 0
    assert pii.fit_pii(frame.filter("doc_id = 3")) is None


def brute_score(model, text):
    """The score by the definition alone: block by block, one fresh compressor each."""
    import math

    import zstandard

    data = (text or "").encode()
    if not data:
        return model.prior
    total = {}
    for name, words in (("bad", model.bad), ("good", model.good)):
        kind = zstandard.DICT_TYPE_FULLDICT if words[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
        side = zstandard.ZstdCompressionDict(words, dict_type=kind)
        total[name] = sum(len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=side, write_dict_id=False, write_content_size=False).compress(data[k : k + quality.BLOCK])) for k in range(0, len(data), quality.BLOCK))
    x = model.slope * (total["bad"] - total["good"]) / (len(data) + quality.DAMP) + model.offset
    prior = math.log(model.prior / (1 - model.prior))
    return 1 / (1 + math.exp(-(prior + (x - prior) * len(data) / (len(data) + quality.SHORT))))


def test_quality_query_equals_brute_force(spark):
    rng = np.random.default_rng(12)
    word = lambda letters: "".join(rng.choice(list(letters), rng.integers(2, 8)))
    rows = [(n, " ".join(word("etaoinshr" if n % 3 else "qxzjvk#é") for _ in range(int(rng.integers(1, 60))))) for n in range(240)]
    rows += [(900, None), (901, ""), (902, "é" * 50_000), (5, rows[5][1]), (None, "no id"), (903, rows[4][1] * 400)]
    docs = spark.createDataFrame([(*r, 0.5, 1) for r in rows], "doc_id long, text string, score double, predicted int")
    labels = spark.createDataFrame([(n, int(n % 3 > 0)) for n in range(0, 200)] + [(7, 0), (8, None), (None, 1), (901, 1)], "doc_id long, quality int")
    fit = quality.fit_quality(docs, labels.filter(quality.fold() != 0))
    got = quality.quality_scores(docs, labels).collect()
    text = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        want = brute_score(fit, text[r.doc_id])
        assert r.score == pytest.approx(want, rel=1e-9) and r.predicted == int(want >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    good = [r.predicted for r in got if r.doc_id is not None and r.doc_id < 240 and r.held_out]
    sure = [int(r.doc_id % 3 > 0) for r in got if r.doc_id is not None and r.doc_id < 240 and r.held_out]
    assert sum(a == b for a, b in zip(good, sure, strict=True)) >= 0.85 * len(sure)
    assert quality.quality_scores(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}


def test_logistic_fit_is_stationary():
    rng = np.random.default_rng(5)
    x, y, w = rng.normal(size=300), (rng.random(300) < 0.6).astype(float), rng.random(300) + 0.2
    slope, offset = quality._logistic(x + y, y, w)

    def loss(a, b):
        z = a * (x + y) + b
        return (w * (np.log1p(np.exp(z)) - y * z)).sum() + 0.5e-2 * (a * (x + y).std()) ** 2 + 0.5e-4 * b * b

    best = loss(slope, offset)
    assert all(loss(slope + a, offset + b) > best for a, b in ((0.05, 0), (-0.05, 0), (0, 0.05), (0, -0.05)))


def test_fit_reads_long_texts_whole(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "_dictionary", lambda texts: seen.append(texts) or b"some words to start with")
    docs = spark.createDataFrame([(n, "".join(f"{n:03d}:{k:05d}|" for k in range(9000))) for n in range(12)], "doc_id long, text string")
    quality.fit_quality(docs, spark.createDataFrame([(n, n % 2) for n in range(12)], "doc_id long, quality int"))
    assert all(len(t) == 90_000 for part in seen for t in part)
