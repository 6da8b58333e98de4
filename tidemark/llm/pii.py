"""Personal data: fixed patterns, and spans that a character model adds.

The patterns give the base spans. A bidirectional LSTM with CRF transitions, trained in numpy on windows whose
spans the patterns label (most of them disguised: spaced, worded or punctuated otherwise, with the labels kept), decodes
overlapping windows over every stretch around a digit of any script, an @ or a worded at-sign. Each character takes its tag from the window
that has most text on both sides of it, over the whole text, so that a span longer than a window is one span; what
does not touch a base span is added.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.common import give_back, map_texts, text_or_empty
from tidemark.llm.pii_model import KINDS, BiLstmCrf, codes, padded, reconcile, tags_of, windows
from tidemark.session import cut, drop_cut, ship

#: Window and step in characters, characters around what anchors a stretch, least mean posterior of an added span's tags.
WINDOW, STEP, AROUND, LEAST = 96, 48, 40, 0.6
#: Bounds of the fit: stretches with base spans and stretches without, windows made of those with spans, and passes over all.
FIT_SPANS, FIT_OTHERS, FIT_WINDOWS, EPOCHS = 1200, 600, 2400, 8

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: an address may begin only where a run of digits does: a later start would meet the same end
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile("[0-9]")
_ANCHOR = re.compile(r"[\d@＠]|(?i:[(\[{<]\s*(?:at|dot)\s*[)\]}>])|\s(?:at|AT)\s(?=[^\s]{1,40}(?:\.\w|\s(?:dot|DOT)\s))")
_AT = re.compile(r"[@＠]|(?i:\bat\b)")
#: the same for Spark's filter, which may let more texts through
_ANCHOR_JAVA = r"(?U)[\d@＠]|(?i)[(\[{<]\s*(at|dot)\s*[)\]}>]|\sat\s"


def luhn(digits: str) -> bool:
    total = 0
    for n, d in enumerate(reversed(digits)):
        v = int(d) * (1 + n % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _emails(text: str):
    """Each @ with the local characters before it (not before the last match's end) and a dotted domain after it."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            last = found.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order of start, then kind; failing matches are dropped, not retried."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in _emails(text)]
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c in "0123456789" for c in m.group()) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def stretches(text: str, around: int = AROUND) -> list[tuple[int, int]]:
    """Parts of the text within ``around`` characters of an anchor and on to the end of the words there (WINDOW characters at most), merged where they meet."""
    out: list[list[int]] = []
    for m in _ANCHOR.finditer(text):
        a, b = max(0, m.start() - around), min(len(text), m.end() + around)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    for k, (a, b) in enumerate(out):
        low, high = out[k - 1][1] if k else 0, out[k + 1][0] if k + 1 < len(out) else len(text)
        while a > max(low, out[k][0] - WINDOW) and not text[a - 1].isspace():
            a -= 1
        while b < min(high, out[k][1] + WINDOW) and not text[b].isspace():
            b += 1
        out[k][:] = a, b
    return [(a, b) for a, b in out]


def plausible(kind: int, span: str) -> bool:
    """Whether a span can be one of its kind at all: an address has an at-sign in some form, numbers hold what the patterns ask of theirs."""
    digits = re.sub("[^0-9]", "", span)
    if kind == 0:
        return bool(_AT.search(span))
    if kind == 1:
        parts = re.findall("[0-9]+", span)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    return 14 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 10 <= len(digits) <= 15


def varied(span: str, kind: int, rng) -> str:
    """The span with other digits and letters of the same kinds, still one of its kind."""
    if kind == 1:
        return re.sub("[0-9]+", lambda m: str(int(rng.integers(256))), span)
    draw = {"0": "0123456789", "a": "abcdefghijklmnopqrstuvwxyz", "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    of = lambda c: "0" if c in draw["0"] else "a" if c in draw["a"] else "A" if c in draw["A"] else ""
    out = "".join(c if not of(c) or rng.random() < 0.5 else draw[of(c)][int(rng.integers(len(draw[of(c)])))] for c in span)
    if kind == 2:
        head = out.rstrip("0123456789") + re.search("[0-9]*$", out).group()[:-1]
        out = next(head + d for d in "0123456789" if luhn(re.sub("[^0-9]", "", head + d)))
    return out


def _one_of(choices, rng):
    return choices[int(rng.integers(len(choices)))]


def disguised(span: str, kind: int, rng) -> str:
    """The span written so that the patterns miss it."""
    digits = re.sub("[^0-9]", "", span)
    if kind == 0:
        at = _one_of(("(at)", "[at]", " @ ", " (at) ", " [at] ", " at ", " AT ", "(AT)", "{at}", " {at} ", "( at )", "<at>", "＠"), rng)
        dot = _one_of((".", ".", " dot ", "[dot]", "(dot)", " [dot] ", " (dot) ", " . "), rng)
        name, _, host = span.partition("@")
        return name + at + host.replace(".", dot)
    if kind == 1:
        return span.replace(".", _one_of((" . ", "[.]", "(.)", " dot ", "[dot]", "(dot)", ". "), rng))
    if kind == 2:
        size = _one_of((4, 4, 4, 5), rng)
        return _one_of((".", " - ", "/", "_", "  ", " . "), rng).join(digits[k : k + size] for k in range(0, len(digits), size))
    head, a, b, c = digits[:-10], digits[-10:-7], digits[-7:-4], digits[-4:]
    return _one_of((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"00{head} {a} {b} {c}", f"{a}.{b}.{c}", f"00{head}-{a}-{b}-{c}", f"{a} {b} {c}", f"00 {head} {a} {b}{c}", f"({a}) {b} {c}", f"{a}/{b}-{c}"), rng)


def _rewritten(text: str, spans: list[tuple[int, int, int]], rng) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with its spans varied and three of four disguised; (kind, start, end) of where they are then."""
    out, moved, last = "", [], 0
    for start, kind, end in spans:
        if start < last:
            continue
        out += text[last:start]
        span = varied(text[start:end], kind, rng)
        span = disguised(span, kind, rng) if rng.random() < 0.75 else span
        moved.append((kind, len(out), len(out) + len(span)))
        out += span
        last = end
    return out + text[last:], moved


def _window(text: str, spans: list[tuple[int, int, int]], rng) -> tuple[np.ndarray, np.ndarray]:
    """A window of the text at a drawn place around its first span, which may be cut, as windows of long texts cut them."""
    kind, a, b = spans[0]
    start = int(rng.integers(max(0, a - WINDOW + 12), max(1, a + 1))) if len(text) > WINDOW else 0
    start = max(0, min(start, len(text) - 8))
    part = text[start : start + WINDOW]
    inside = [(k, max(0, x - start), min(len(part), y - start)) for k, x, y in spans if x - start < len(part) and y > start]
    return codes(part), tags_of(len(part), inside)


def fit_pii(docs: DataFrame, text_col: str = "text", epochs: int = EPOCHS) -> BiLstmCrf | None:
    """Train on at most FIT_SPANS stretches with base spans and FIT_OTHERS without, chosen by a hash of the stretch over all texts.

    The stretches with spans give at least FIT_WINDOWS windows, most of them with the spans in disguise. None where no text has a base span.
    """

    def make():
        def kernel(_, texts):
            pieces, has = [], []
            for text in texts:
                spans = base_spans(text)
                for a, b in stretches(text):
                    inside = [s for s in spans if a <= s[0] and s[2] <= b]
                    start = max(a, min(inside[0][0] - WINDOW // 2, b - 2 * WINDOW)) if inside else a
                    pieces.append(text[start : min(b, start + 2 * WINDOW)])
                    has.append(bool(inside))
            return {"piece": pieces, "has": has}

        return kernel

    anchored = docs.select(text_or_empty(text_col).alias("text")).filter(F.col("text").rlike(_ANCHOR_JAVA))
    pieces = map_texts(anchored.withColumn("id", F.lit(0)), "id", "text", "piece string, has boolean", make)
    pieces = cut(pieces.withColumn("h", F.xxhash64("piece")).distinct(), "stretches")
    some = [r for has, limit in ((True, FIT_SPANS), (False, FIT_OTHERS)) for r in pieces.filter(F.col("has") == has).orderBy("h", "piece").limit(limit).collect()]
    drop_cut(pieces)
    with_spans, without = [r["piece"] for r in some if r["has"]], [r["piece"] for r in some if not r["has"]]
    if not with_spans:
        return None
    rng = np.random.default_rng(5)
    xs, ys = [], []
    for _ in range(max(2, -(-FIT_WINDOWS // len(with_spans)))):
        for text in with_spans:
            spans = base_spans(text)
            if spans:
                x, y = _window(*_rewritten(text, spans, rng), rng)
                xs.append(x)
                ys.append(y)
    for text in without:
        if text:
            xs.append(codes(text[:WINDOW]))
            ys.append(tags_of(len(xs[-1]), []))
    model = BiLstmCrf.fresh()
    model.train(xs, ys, epochs)
    return model


def stitched(parts: list[tuple[int, int]], tags: list[list[int]], sure: list[list[float]]) -> list[tuple[int, int, int, float]]:
    """(kind, start, end, mean posterior) of a stretch's spans: overlapping windows are cut in the middle of what they share, and their tags joined."""
    edges = [parts[0][0], *[(b + a) // 2 for (_, b), (a, _) in zip(parts, parts[1:], strict=False)], parts[-1][1]]
    joined, level = [], []
    for (a, _), t, m, low, high in zip(parts, tags, sure, edges, edges[1:], strict=False):
        joined += t[low - a : high - a]
        level += m[low - a : high - a]
    out, k = [], 0
    while k < len(joined):
        kind, start = (joined[k] - 1) // 2, k
        k += 1
        if joined[start]:
            # a span goes on in the next window as inside, or begins there if that window saw no more of it
            while k < len(joined) and (joined[k] == 2 + 2 * kind or (joined[k] == 1 + 2 * kind and edges[0] + k in edges)):
                k += 1
            out.append((kind, edges[0] + start, edges[0] + k, sum(level[start:k]) / (k - start)))
    return out


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and text[a].isspace():
        a += 1
    while b > a and text[b - 1].isspace():
        b -= 1
    return a, b


def model_spans(model: BiLstmCrf, texts: list[str], least: float = LEAST) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) that the model finds in each text: windows of all texts are decoded together, then joined and reconciled by text."""
    runs = [(n, windows(s, e, WINDOW, STEP)) for n, text in enumerate(texts) for s, e in stretches(text)]
    where = sorted(((b - a, n, k, a, b) for k, (n, parts) in enumerate(runs) for a, b in parts))
    tags: dict[tuple[int, int], tuple[list, list]] = {}
    for at in range(0, len(where), 512):  # windows of about one length at a time
        part = where[at : at + 512]
        for (_, _, k, a, _), found in zip(part, model.tag(padded([codes(texts[n][a:b]) for _, n, _, a, b in part])), strict=True):
            tags[k, a] = found
    found: list[list] = [[] for _ in texts]
    for k, (n, parts) in enumerate(runs):
        spans = stitched(parts, [tags[k, a][0] for a, _ in parts], [tags[k, a][1] for a, _ in parts])
        for kind, a, b, m in spans:
            a, b = _trimmed(texts[n], a, b)
            if m >= least and a < b and plausible(kind, texts[n][a:b]):
                found[n].append((kind, a, b, m))
    return [[(a, kind, b) for kind, a, b, _ in reconcile(spans)] for spans in found]


def all_spans(texts: list[str], model: BiLstmCrf | None) -> list[tuple[list, list]]:
    """Base spans of each text, and those that the model adds to them, as (start, kind, end)."""
    base = [base_spans(t) for t in texts]
    more: list[list] = [[] for _ in texts]
    if model is not None:
        anchored = [n for n, t in enumerate(texts) if _ANCHOR.search(t)]
        for n, spans in zip(anchored, model_spans(model, [texts[n] for n in anchored]), strict=True):
            more[n] = [s for s in spans if not any(s[0] < b[2] and b[0] < s[2] for b in base[n])]
    return list(zip(base, more, strict=True))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: BiLstmCrf | None = None) -> DataFrame:
    """One row per input row: ``id, n_email, n_ip, n_card, n_phone, base_sha256, spans``.

    The counts and ``base_sha256`` are of the base spans (``kind:start:end`` by start, then kind, joined by commas; characters,
    end exclusive). ``spans`` has all spans in the same form: those of the patterns and those that ``model`` adds, which never overlap a base
    one. Null or empty texts have none. Rows that repeat an id are read each, null ids too, other
    columns are ignored, an empty table gives an empty result; without a model only base spans are found.
    """

    def make():
        def kernel(keys, texts):
            out = {id_col: keys, **{f"n_{k}": [] for k in KINDS}, "base_sha256": [], "spans": []}
            name = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
            for spans, extra in all_spans(texts, model):
                for k, kind in enumerate(KINDS):
                    out[f"n_{kind}"].append(sum(s[1] == k for s in spans))
                out["base_sha256"].append(hashlib.sha256(name(spans).encode()).hexdigest())
                out["spans"].append(name(spans + extra))
            return out

        return kernel

    kind = docs.schema[id_col].dataType.simpleString()
    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    return map_texts(docs, id_col, text_col, f"{id_col} {kind}, {counts}, base_sha256 string, spans string", make)


def redact_texts(texts: list[str], model: BiLstmCrf | None) -> list[str]:
    """The texts with each span replaced by its kind in angle brackets; overlapping spans become one."""
    done = []
    for text, (base, extra) in zip(texts, all_spans(texts, model), strict=True):
        out, last = [], 0
        for a, kind, b in sorted(base + extra):
            if a >= last:
                out += [text[last:a], f"<{KINDS[kind]}>"]
            last = max(last, b)
        done.append("".join(out) + text[last:] if out else text)
    return done


def redact_pii(docs: DataFrame, text_col: str = "text", model: BiLstmCrf | None = None) -> DataFrame:
    """All columns with personal data in the text replaced.

    Null texts stay null, empty ones empty; repeated rows are redacted each; an empty table gives an empty result; columns of any name pass.
    """
    ship(docs.sparkSession)
    arrow = to_arrow_schema(docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(text_col)
                some = texts.is_valid()
                done = redact_texts(texts.filter(some).to_pylist(), model)
                if done:
                    texts = pa.compute.replace_with_mask(texts, some, pa.array(done, texts.type))
                columns = [(texts if f.name == text_col else part.column(f.name)).cast(f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)
        give_back()

    return docs.mapInArrow(run, docs.schema)
