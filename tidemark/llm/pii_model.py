"""A character-level bidirectional LSTM with a CRF on top, in numpy: training, decoding, and windows of long texts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Kinds, their tags (0: outside, then begin and inside of each kind), and the model's sizes.
KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)
EMBED, HIDDEN = 12, 24
#: Character codes: 0 padding, ASCII by itself, other letters, other digits, all else.
CODES = 131


def codes(text: str) -> np.ndarray:
    out = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    wide = np.flatnonzero(out > 127)
    for k in wide.tolist():
        char = chr(out[k])
        out[k] = 128 if char.isalpha() else 129 if char.isdigit() else 130
    out[out == 0] = 130
    return out


def tags_of(size: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Tags of a window from (kind, start, end) spans."""
    out = np.zeros(size, np.int64)
    for kind, start, end in spans:
        out[start] = 1 + 2 * kind
        out[start + 1 : end] = 2 + 2 * kind
    return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def allowed() -> np.ndarray:
    """Transitions that make sense: inside only after begin or inside of its kind."""
    ok = np.ones((TAGS, TAGS), bool)
    for kind in range(len(KINDS)):
        inside = 2 + 2 * kind
        ok[:, inside] = False
        ok[[inside - 1, inside], inside] = True
    return ok


@dataclass
class BiLstmCrf:
    """Parameters by name; arrays of shape (batch, time, ...) throughout, padding code 0 at the end of a window."""

    p: dict[str, np.ndarray]

    @staticmethod
    def fresh(seed: int = 7) -> BiLstmCrf:
        rng = np.random.default_rng(seed)
        p = {"embed": rng.normal(0, 0.3, (CODES, EMBED))}
        for side in ("f", "b"):
            p[f"w{side}"] = rng.normal(0, 1 / np.sqrt(EMBED + HIDDEN), (EMBED + HIDDEN, 4 * HIDDEN))
            p[f"c{side}"] = np.zeros(4 * HIDDEN)
            p[f"c{side}"][HIDDEN : 2 * HIDDEN] = 1.0
        p["out"] = rng.normal(0, 1 / np.sqrt(2 * HIDDEN), (2 * HIDDEN, TAGS))
        p["bias"] = np.zeros(TAGS)
        p["move"] = np.where(allowed(), 0.0, -30.0)
        return BiLstmCrf({k: v.astype(np.float32) for k, v in p.items()})

    def _lstm(self, x: np.ndarray, mask: np.ndarray, side: str, keep: list | None) -> np.ndarray:
        """Hidden states over time; padded steps keep the state at zero. ``keep`` collects what training needs."""
        batch, time, _ = x.shape
        w, c = self.p[f"w{side}"], self.p[f"c{side}"]
        into = x @ w[:EMBED] + c
        h, s = np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32)
        out = np.zeros((batch, time, HIDDEN), np.float32)
        for t in range(time) if side == "f" else range(time - 1, -1, -1):
            z = into[:, t] + h @ w[EMBED:]
            i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in (0, 1, 2))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, t, None]
            new = (f * s + i * g) * m
            th = np.tanh(new)
            if keep is not None:
                keep.append((t, i, f, o, g, s, h, th))
            h, s = o * th * m, new
            out[:, t] = h
        return out

    def emissions(self, x: np.ndarray, kept: dict | None = None) -> np.ndarray:
        mask = (x > 0).astype(np.float32)
        e = self.p["embed"][x]
        keep = {"f": [] if kept is not None else None, "b": [] if kept is not None else None}
        h = np.concatenate([self._lstm(e, mask, s, keep[s]) for s in ("f", "b")], 2)
        if kept is not None:
            kept |= {"mask": mask, "e": e, "h": h, **keep}
        return h @ self.p["out"] + self.p["bias"]

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags of a window, and its gradient."""
        kept: dict = {}
        em = self.emissions(x, kept)
        mask, h, e = kept["mask"], kept["h"], kept["e"]
        batch, time, _ = em.shape
        move = self.p["move"]
        alpha = np.zeros_like(em)
        alpha[:, 0] = em[:, 0]
        for t in range(1, time):
            step = _logsum(alpha[:, t - 1, :, None] + move, 1) + em[:, t]
            alpha[:, t] = np.where(mask[:, t, None] > 0, step, alpha[:, t - 1])
        beta = np.zeros_like(em)
        for t in range(time - 2, -1, -1):
            step = _logsum(move + (em[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(mask[:, t + 1, None] > 0, step, 0)
        total = _logsum(alpha[:, -1], 1)
        rows = np.arange(batch)[:, None]
        gold = (em[rows, np.arange(time), y] * mask).sum(1) + (move[y[:, :-1], y[:, 1:]] * mask[:, 1:]).sum(1)
        loss = float((total - gold).mean())
        d_em = np.exp(alpha + beta - total[:, None, None])
        d_em[rows, np.arange(time), y] -= 1
        d_em *= mask[:, :, None] / batch
        pair = np.exp(alpha[:, :-1, :, None] + move + (em[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None])
        d_move = (pair * mask[:, 1:, None, None]).sum((0, 1))
        np.add.at(d_move, (y[:, :-1], y[:, 1:]), -mask[:, 1:])
        g = {"out": np.einsum("bth,btk->hk", h, d_em), "bias": d_em.sum((0, 1)), "move": d_move / batch * allowed()}
        d_h = d_em @ self.p["out"].T
        d_e = np.zeros_like(e)
        for n, side in enumerate(("f", "b")):
            w = self.p[f"w{side}"]
            gw, gc = np.zeros_like(w), np.zeros(4 * HIDDEN, np.float32)
            dh_next, ds_next = np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32)
            for t, i, f, o, gate, s, h_before, th in reversed(kept[side]):
                m = mask[:, t, None]
                dh = (d_h[:, t, n * HIDDEN : (n + 1) * HIDDEN] + dh_next) * m
                ds = (dh * o * (1 - th * th) + ds_next) * m
                dz = np.concatenate([ds * gate * i * (1 - i), ds * s * f * (1 - f), dh * th * o * (1 - o), ds * i * (1 - gate * gate)], 1)
                gw[:EMBED] += e[:, t].T @ dz
                gw[EMBED:] += h_before.T @ dz
                gc += dz.sum(0)
                d_e[:, t] += dz @ w[:EMBED].T
                dh_next, ds_next = dz @ w[EMBED:].T, ds * f
            g[f"w{side}"], g[f"c{side}"] = gw, gc
        g["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(g["embed"], x, d_e)
        return loss, g

    def train(self, windows: list[np.ndarray], tags: list[np.ndarray], epochs: int = 8, batch: int = 64, rate: float = 0.02, seed: int = 11) -> list[float]:
        """Adam over shuffled batches; the mean loss of each epoch."""
        rng, history = np.random.default_rng(seed), []
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            losses = []
            order = rng.permutation(len(windows))
            for at in range(0, len(order), batch):
                chosen = order[at : at + batch]
                x, y = padded([windows[k] for k in chosen]), padded([tags[k] for k in chosen])
                loss, g = self.gradient(x, y)
                losses.append(loss)
                norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
                step += 1
                lr = rate * (1 - 0.8 * epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k, v in g.items():
                    v = v * min(1.0, 5.0 / max(norm, 1e-9))
                    first[k] += 0.1 * (v - first[k])
                    second[k] += 0.001 * (v * v - second[k])
                    self.p[k] = (self.p[k] - lr * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
            history.append(float(np.mean(losses)) if losses else 0.0)
        return history

    def tag(self, x: np.ndarray) -> list[tuple[list[int], list[float]]]:
        """Best tags of each window (Viterbi), and the posterior of each.

        The first character may be inside a span that began before the window: it counts as its beginning.
        """
        em, mask = self.emissions(x), x > 0
        em[:, 0, 2::2] = -30.0  # nothing begins inside
        batch, time, _ = em.shape
        move, back = self.p["move"], []
        score, alpha = em[:, 0], [em[:, 0]]
        for t in range(1, time):
            step = score[:, :, None] + move
            back.append(np.where(mask[:, t, None], step.argmax(1), np.arange(TAGS)))
            score = np.where(mask[:, t, None], step.max(1) + em[:, t], score)
            alpha.append(np.where(mask[:, t, None], _logsum(alpha[-1][:, :, None] + move, 1) + em[:, t], alpha[-1]))
        tags = np.zeros((batch, time), np.int64)
        tags[:, -1] = score.argmax(1)
        for t in range(time - 1, 0, -1):
            tags[:, t - 1] = np.take_along_axis(back[t - 1], tags[:, t, None], 1)[:, 0]
        total, beta = _logsum(alpha[-1], 1), np.zeros((batch, TAGS), np.float32)
        sure = np.zeros((batch, time))
        for t in range(time - 1, -1, -1):
            if t < time - 1:
                step = _logsum(move + (em[:, t + 1] + beta)[:, None, :], 2)
                beta = np.where(mask[:, t + 1, None], step, 0)
            sure[:, t] = np.exp(np.take_along_axis(alpha[t] + beta, tags[:, t, None], 1)[:, 0] - total)
        size = mask.sum(1).tolist()
        return [(tags[n, : size[n]].tolist(), sure[n, : size[n]].tolist()) for n in range(batch)]


def padded(rows: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(rows), max(map(len, rows))), np.int64)
    for n, row in enumerate(rows):
        out[n, : len(row)] = row
    return out


def windows(start: int, end: int, size: int, step: int) -> list[tuple[int, int]]:
    """Overlapping windows that cover [start, end)."""
    out, at = [], start
    while True:
        out.append((at, min(end, at + size)))
        if at + size >= end:
            return out
        at += step


def reconcile(spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
    """Of the spans of all windows, those without overlap whose posteriors times lengths sum highest (over the whole text)."""
    best: dict[tuple[int, int, int], float] = {}
    for kind, a, b, sure in spans:
        best[kind, a, b] = max(sure, best.get((kind, a, b), -1e9))
    order = sorted(((b, a, kind, m) for (kind, a, b), m in best.items() if m > 0))
    ends = [x[0] for x in order]
    total, pick = [0.0], []
    for n, (b, a, _, m) in enumerate(order):
        before = int(np.searchsorted(ends[:n], a, "right"))
        gain = total[before] + m * (b - a)
        pick.append((gain > total[n], before))
        total.append(max(total[n], gain))
    out, n = [], len(order)
    while n:
        take, before = pick[n - 1]
        if take:
            b, a, kind, m = order[n - 1]
            out.append((kind, a, b, m))
            n = before
        else:
            n -= 1
    return out[::-1]
