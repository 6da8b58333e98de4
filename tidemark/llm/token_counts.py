"""Token counts through a finite-state transducer compiled from a sentence-piece BPE vocabulary.

A token sequence is the one that BPE merging yields exactly where each two neighbours are what merging yields for
the two alone. So the last token of a prefix follows from the last tokens at the few earlier places where a
vocabulary piece can begin. A state is that window: the longest suffix that begins some piece, with the last
token and the relative count at each of its places. Transitions carry the change in the count. States and transitions
are determinised as texts reach them, up to a bound, and kept by the worker.

No piece crosses from a word into the next space mark, so that such a place resets the transducer. Texts are cut into
chunks; each chunk becomes a state map: what its stretch before the first reset does to the states it may be entered in, the count
from there on, the state at its end. A parallel prefix scan composes the maps of a text's chunks. Runs from two states over one text soon
meet in one state, so that a chunk without a reset is read about once, whatever it is entered in.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame

from tidemark.llm.common import MEMO_ENTRIES, map_texts, tokenizer_path
from tidemark.llm.sentence_model import NORMAL, SPACE, USER, SentenceModel, load

#: Characters of a chunk and between the marks of a stretch, and states that are kept before the transducer starts afresh.
CHUNK, MARK, STATES = 8192, 64, 200_000
RESET = re.compile(f"(?<=[^{SPACE}]){SPACE}")


class State:
    __slots__ = ("counts", "lasts", "moves", "suffix")

    def __init__(self, suffix: str, lasts: tuple, counts: tuple):
        #: longest suffix that begins a piece; last token at each of its places, oldest first; counts less the present one
        self.suffix, self.lasts, self.counts = suffix, lasts, counts
        self.moves: dict[str, tuple[State, int]] = {}

    @property
    def key(self) -> tuple:
        return self.suffix, self.lasts, self.counts


class Transducer:
    """Deterministic, with integer outputs; ``barrier`` characters (no piece holds them) are spelled in bytes."""

    def __init__(self, model: SentenceModel):
        if not (model.is_bpe and model.byte_fallback):
            raise ValueError("a BPE model with byte fallback is needed")
        self.score = {p: s for p, k, s in zip(model.pieces, model.kinds, model.scores, strict=True) if k in (NORMAL, USER)}
        self.starts = {p[:n] for p in self.score for n in range(1, len(p) + 1)}
        self.pairs = {p[n : n + 2] for p in self.score for n in range(len(p) - 1)}
        self.resets = model.splits_at_space and SPACE in self.score
        self._fits: dict[tuple, bool] = {}
        self.words: dict[str, int] = {}
        self._clear()

    def _clear(self) -> None:
        self.states: dict[tuple, State] = {}
        self.root = self._state("", (None,), (0,))

    def _state(self, suffix: str, lasts: tuple, counts: tuple) -> State:
        key = (suffix, lasts, counts)
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = State(suffix, lasts, counts)
        return found

    def merge(self, text: str) -> list[str]:
        """Tokens of a short text by the merge rule itself: best score first, then leftmost."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = score.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or found > best):
                    best, at = found, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, left: str | None, right: str) -> bool:
        """Whether merging leaves the two tokens as they are (left None: nothing mergeable stands there)."""
        key = (left, right)
        found = self._fits.get(key)
        if found is None:
            if len(self._fits) > 4 * STATES:
                self._fits.clear()
            found = self._fits[key] = self.merge((left or "") + right) == ([right] if left is None else [left, right])
        return found

    def move(self, state: State, char: str) -> tuple[State, int]:
        found = state.moves.get(char)
        if found is None:
            found = state.moves[char] = self._compile(state, char)
        return found

    def _compile(self, state: State, char: str) -> tuple[State, int]:
        if char not in self.score:
            return self.root, len(char.encode())
        if state.suffix and state.suffix[-1] + char not in self.pairs:
            state = self.root  # no piece holds the two characters: what stood before has no say
        text = state.suffix + char
        for at in range(len(text)):
            if text[at:] in self.score and self.fits(state.lasts[at], text[at:]):
                token, change = text[at:], state.counts[at] + 1
                break
        else:
            raise AssertionError("a single character always fits")
        lasts, counts = (*state.lasts, token), (*(c - change for c in state.counts), 0)
        keep = next(at for at in range(len(text)) if text[at:] in self.starts)
        return self._state(text[keep:], lasts[keep:], counts[keep:]), change

    def run(self, state: State, text: str) -> tuple[State, int]:
        """State and count after ``text``."""
        total = 0
        for char in text:
            step = state.moves.get(char)
            if step is None:
                step = self.move(state, char)
            state = step[0]
            total += step[1]
        return state, total

    def tidy(self) -> None:
        """Start afresh where too many states were reached; states that are held elsewhere stay good."""
        if len(self.states) > STATES:
            self._clear()

    def word(self, word: str) -> int:
        """Count of a part that begins at a reset and ends before one."""
        found = self.words.get(word)
        if found is None:
            if len(self.words) > 2 * MEMO_ENTRIES:
                self.words = {}
            self.tidy()
            found = self.words[word] = self.run(self.root, word)[1]
        return found


class Stretch:
    """What a stretch of text without a reset does to a state, for the states that have been asked for.

    The stretch is run once from the root, and the states on the way are kept at every MARK-th character. From another state it is run
    only up to the first mark where both stand in one state: from there on all is known.
    """

    __slots__ = ("known", "machine", "marks", "text")

    def __init__(self, machine: Transducer, text: str):
        self.machine, self.text = machine, text
        self.marks: list[tuple[State, int]] = []
        self.known: dict[tuple, tuple[State, int]] = {}
        state, total = machine.root, 0
        for at in range(0, len(text), MARK):
            state, more = machine.run(state, text[at : at + MARK])
            total += more
            self.marks.append((state, total))
        machine.tidy()

    def through(self, entry: State) -> tuple[State, int]:
        """State behind the stretch and tokens in it, entered in the given state."""
        found = self.known.get(entry.key)
        if found is None:
            state, total = entry, 0
            for n, (mark, so_far) in enumerate(self.marks):
                state, more = self.machine.run(state, self.text[n * MARK : (n + 1) * MARK])
                total += more
                if state is mark or state.key == mark.key:
                    state, total = self.marks[-1][0], total + self.marks[-1][1] - so_far
                    break
            found = self.known[entry.key] = state, total
            self.machine.tidy()
        return found


class Map:
    """What chunks do to any state: it passes the stretches of ``head``; after a reset, ``count`` more and ``end`` hold for all."""

    __slots__ = ("count", "end", "head", "reset")

    def __init__(self, head: tuple[Stretch, ...], reset: bool, count: int, end: State | None):
        self.head, self.reset, self.count, self.end = head, reset, count, end


def chunk_map(machine: Transducer, model: SentenceModel, chunk: str, first: bool) -> Map:
    if first:
        at = 0
    elif not machine.resets:
        at = -1
    else:
        found = RESET.search(chunk)
        at = found.start() if found else -1
    if at < 0:
        return Map((Stretch(machine, chunk),), False, 0, None)
    rest = chunk[at:]
    last = 0
    if machine.resets:
        last = rest.rfind(SPACE)
        while last > 0 and rest[last - 1] == SPACE:
            last -= 1
        last = max(last, 0)
    count = sum(map(machine.word, model.words(rest[:last]))) if last else 0
    end, more = machine.run(machine.root, rest[last:])
    return Map((Stretch(machine, chunk[:at]),) if at else (), True, count + more, end)


def compose(a: Map, b: Map) -> Map:
    """First ``a``, then ``b``; associative."""
    if not a.reset:
        return Map(a.head + b.head, b.reset, b.count, b.end)
    end, count = a.end, a.count
    for stretch in b.head:
        end, more = stretch.through(end)
        count += more
    return Map(a.head, True, count + b.count, b.end if b.reset else end)


def count_tokens(machine: Transducer, model: SentenceModel, texts: list[str], chunk: int = CHUNK) -> list[int]:
    """Tokens of each text: the state maps of its chunks, composed by neighbours in log2(chunks) rounds (a scan's way up; the text needs the last prefix alone)."""
    counts = []
    for text in texts:
        normal = model.normalize_text(text)
        maps = [chunk_map(machine, model, normal[at : at + chunk], at == 0) for at in range(0, len(normal), chunk)]
        while len(maps) > 1:
            maps = [compose(*maps[k : k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
        counts.append(maps[0].count if maps else 0)
    return counts


@lru_cache(maxsize=4)
def compiled(path: str) -> tuple[Transducer, SentenceModel]:
    model = load(path)
    return Transducer(model), model


def token_counts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    model: str = "piece_bpe_32k.model",
    path: str | None = None,
    limit: int = 4096,
) -> DataFrame:
    """One row per input row: ``id, n_bytes, n_tokens, over_limit`` (more than ``limit`` tokens).

    Tokens are those of the sentencepiece library without begin or end ids; strings of special tokens inside a text
    are plain text. Null or empty texts have none. Whole texts are counted, chunk by chunk; repeated rows are counted
    each, other columns are ignored, and an empty table gives an empty result.
    """

    def make():
        machine, pieces = compiled(path or tokenizer_path(model))

        def kernel(keys, texts):
            counts = count_tokens(machine, pieces, texts)
            return {id_col: keys, "n_bytes": [len(t.encode()) for t in texts], "n_tokens": counts, "over_limit": [n > limit for n in counts]}

        return kernel

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs, id_col, text_col, f"{id_col} {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean", make)
