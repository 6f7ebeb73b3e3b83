"""A character-level bidirectional LSTM with CRF transitions in plain numpy, trained from labelled spans."""

from __future__ import annotations

import random
import re

import numpy as np

KINDS = ("email", "ip", "card", "phone")
#: Tag 0 is outside; 1 + 2k begins kind k, 2 + 2k goes on with it.
TAGS = 1 + 2 * len(KINDS)
_PUNCT = " \n!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Character classes: pad, a-z, upper case, digit, other, each punctuation mark.
CLASSES = 30 + len(_PUNCT)
_TABLE = np.full(128, 29, np.int64)
_TABLE[ord("a") : ord("z") + 1] = np.arange(1, 27)
_TABLE[ord("A") : ord("Z") + 1] = 27
_TABLE[ord("0") : ord("9") + 1] = 28
for _i, _c in enumerate(_PUNCT):
    _TABLE[ord(_c)] = 30 + _i
_FORBIDDEN = np.zeros((TAGS, TAGS), bool)
for _k in range(len(KINDS)):
    _FORBIDDEN[:, 2 + 2 * _k] = True
    _FORBIDDEN[[1 + 2 * _k, 2 + 2 * _k], 2 + 2 * _k] = False


def encode(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return _TABLE[np.where(code < 128, code, 127)]


# --- labelled spans


def _luhn(digits: str) -> str:
    total = sum(d if i % 2 else (2 * d - 9 * (d > 4)) for i, d in enumerate(map(int, reversed(digits))))
    return digits + str(-total % 10)


def luhn_ok(digits: str) -> bool:
    return sum(d if i % 2 == 0 else (2 * d - 9 * (d > 4)) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def labelled_windows(n: int, width: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """``n`` windows of ``width`` characters with planted spans in plain and disguised spellings, among look-alikes that are none."""
    r = random.Random(seed)
    letters = "etaoinshrdlucmfwypvbgkjqxz"
    word = lambda a=2, b=9: "".join(r.choice(letters[: r.randint(6, 26)]) for _ in range(r.randint(a, b)))
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def email() -> str:
        at = r.choice(["@"] * 5 + [" (at) ", "(at)", " [at] ", "[at]", " @ ", " (AT) ", " {at} "])
        dot = "." if at == "@" else r.choice([".", " (dot) ", "(dot)", "[dot]", " [dot] ", " (DOT) "])
        if r.random() < 0.15:  # long names
            return "".join(word(6, 14) for _ in range(r.randint(2, 3))) + at + word(3, 7) + dot + r.choice(["com", "org"])
        name = word(2, 8) + r.choice(["", "." + word(2, 6), "." + digits(2), "_" + word(2, 4), digits(2)])
        return name + at + dot.join([word(3, 8) + r.choice(["", digits(1)]), *([word(3, 8)] if r.random() < 0.5 else []), r.choice(["com", "net", "org", "de", "example"])])

    def ip() -> str:
        return r.choice([".", ".", ".", "[.]", "(.)", " . "]).join(str(r.randint(0, 255)) for _ in range(4))

    def card() -> str:
        d = _luhn(r.choice("3456") + digits(r.choice([14, 14, 14, 13, 17])))
        sep = r.choice(["", "", " ", "-", ".", "/", "_"])
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice(["+1 ({a}) {b}-{c}", "+{x} {a} {b}{c}", "({a}) {b}-{c}", "({a}){b}-{c}", "00{x} {a} {b} {c}", "+{x}({a}){b}.{c}", "({a}) {b} {c}", "tel: ({a}) {b}-{c}"]).format(a=a, b=b, c=c, x=r.randint(1, 99))

    def nothing() -> str:
        hexa = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
        return r.choice([
            lambda: "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), lambda: "password=" + hexa(18), lambda: f'token = "{hexa(40)}"',
            lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", lambda: digits(r.randint(1, 8)), lambda: f"{r.randint(1, 99)}.{r.randint(0, 99)}", lambda: f"v{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}",
            lambda: f"({word()}) ", lambda: f"[{digits(2)}]", lambda: f"version {r.randint(1, 9)}.", lambda: f"BY-NC {r.randint(1, 4)}.0.", lambda: f"({r.randint(1900, 2030)})", lambda: f"{digits(3)},{digits(3)}.{digits(2)}", lambda: f"{r.randint(0, 23)}:{digits(2)}:{digits(2)}", lambda: f"{word()}@{word()}", lambda: f"[at] {word()}", lambda: f"pp. {digits(3)}-{digits(3)}", lambda: digits(r.randint(20, 40)),
        ])()

    make = [email, ip, card, phone]
    x, y = np.zeros((n, width), np.int64), np.zeros((n, width), np.int64)
    for i in range(n):
        text, spans = "", []
        while len(text) < 3 * width:
            u = r.random()
            if u < 0.12:
                k = r.randrange(4)
                s = make[k]()
                skip = 5 if s.startswith("tel: ") else 0
                spans.append((len(text) + skip, len(text) + len(s), k))
            elif u < 0.24:
                s = nothing()
            else:
                s = word(1, 10)
                s = s.capitalize() if r.random() < 0.15 else s
                s += r.choice(["", "", "", "", ".", ",", "é", ".\n"])
            text += s + r.choice([" ", " ", " ", " ", "\n"])
        at = r.randrange(0, len(text) - width)
        x[i] = encode(text[at : at + width])
        for a, b, k in spans:
            if b > at and a < at + width:
                y[i, max(0, a - at) : b - at] = 2 + 2 * k
                if a >= at:
                    y[i, a - at] = 1 + 2 * k
    return x, y


# --- the model


def _sig(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Tagger:
    def __init__(self, embed: int = 10, hidden: int = 20, seed: int = 3):
        g = np.random.default_rng(seed)
        u = lambda *s: g.uniform(-1, 1, s).astype(np.float32) * np.float32(1 / np.sqrt(s[0]))
        self.h = hidden
        self.p = {"E": g.normal(0, 0.5, (CLASSES, embed)).astype(np.float32), "O": u(2 * hidden, TAGS), "o": np.zeros(TAGS, np.float32), "A": np.zeros((TAGS, TAGS), np.float32)}
        for d in "fb":
            self.p |= {"X" + d: u(embed, 4 * hidden), "H" + d: u(hidden, 4 * hidden), "c" + d: np.repeat(np.float32([0, 1, 0, 0]), hidden)}

    def _run(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        n, width, _ = x.shape
        h = c = np.zeros((n, self.h), np.float32)
        out, steps = np.empty((n, width, self.h), np.float32), []
        inputs = x @ self.p["X" + d] + self.p["c" + d]
        for t in range(width) if d == "f" else range(width - 1, -1, -1):
            z = inputs[:, t] + h @ self.p["H" + d]
            gate, cand = _sig(z[:, : 3 * self.h]), np.tanh(z[:, 3 * self.h :])
            i, f, o = np.split(gate, 3, 1)
            before, prev = h, c
            c = f * c + i * cand
            tc = np.tanh(c)
            h = o * tc
            out[:, t] = h
            if keep:
                steps.append((t, before, prev, i, f, o, cand, tc))
        return out, steps

    def emissions(self, chars: np.ndarray, reach: int = 0) -> np.ndarray:
        """(windows, width - 2 * reach, TAGS) scores of the characters but the ``reach`` outer ones on each side, which are only read; pads (class 0) are where a text ends."""
        p, k, (n, width) = self.p, self.h, chars.shape
        steps = np.ascontiguousarray(chars.T)
        pads = {t: np.flatnonzero(steps[t] == 0) for t in np.flatnonzero((steps == 0).any(1)).tolist()}
        x = p["E"].astype(np.float32)[steps].transpose(0, 2, 1)
        out = np.empty((width - 2 * reach, TAGS, n), np.float32)
        out[:] = p["o"][:, None]
        both, z, more, half = np.ones((k + x.shape[1] + 1, n), np.float32), np.empty((4 * k, n), np.float32), np.empty((TAGS, n), np.float32), np.float32(0.5)
        h, gates, (i, f, o, cand) = both[:k], z[: 3 * k], z.reshape(4, k, n)
        scale = np.repeat(np.float32([0.5, 0.5, 0.5, 1]), k)  # sigmoid(x) = (1 + tanh(x / 2)) / 2
        for d, tags in (("f", p["O"][:k]), ("b", p["O"][k:])):
            # ``h`` holds twice the state.
            w = np.ascontiguousarray((np.concatenate([p["H" + d] * half, p["X" + d], p["c" + d][None]]) * scale).T, np.float32)
            tags = np.ascontiguousarray(tags.T * half, np.float32)
            c = np.zeros((k, n), np.float32)
            h[:] = 0
            for t in range(width - reach) if d == "f" else range(width - 1, reach - 1, -1):
                both[k:-1] = x[t]
                np.matmul(w, both, out=z)
                np.tanh(z, out=z)
                gates += 1
                c *= f
                i *= cand
                c += i
                c *= half
                np.tanh(c, out=cand)
                np.multiply(o, cand, out=h)
                if t in pads:
                    c[:, pads[t]] = 0
                    h[:, pads[t]] = 0
                if reach <= t < width - reach:
                    np.matmul(tags, h, out=more)
                    out[t - reach] += more
        return out.transpose(2, 0, 1)

    def transitions(self) -> np.ndarray:
        return np.where(_FORBIDDEN, -1e4, self.p["A"]).astype(np.float32)

    def gradients(self, chars: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Negative log likelihood per window and its gradients."""
        p, (n, width) = self.p, chars.shape
        x = p["E"][chars]
        hf, sf = self._run(x, "f", True)
        hb, sb = self._run(x, "b", True)
        hid = np.concatenate([hf, hb], 2)
        s = (hid @ p["O"] + p["o"]).astype(np.float64)
        a = self.p["A"].astype(np.float64)
        lse = lambda v, ax: v.max(ax) + np.log(np.exp(v - np.expand_dims(v.max(ax), ax)).sum(ax))
        alpha, beta = np.zeros_like(s), np.zeros_like(s)
        alpha[:, 0] = s[:, 0]
        for t in range(1, width):
            alpha[:, t] = s[:, t] + lse(alpha[:, t - 1, :, None] + a, 1)
        for t in range(width - 2, -1, -1):
            beta[:, t] = lse(a[None] + (s[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        z = lse(alpha[:, -1], 1)
        ds = np.exp(alpha + beta - z[:, None, None])
        pair = np.exp(alpha[:, :-1, :, None] + a + (s[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None])
        da = pair.sum((0, 1))
        np.subtract.at(da, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        rows, cols = np.arange(n)[:, None], np.arange(width)[None]
        gold = s[rows, cols, y].sum() + a[y[:, :-1], y[:, 1:]].sum()
        ds[rows, cols, y] -= 1
        ds = (ds / n).astype(np.float32)
        g = {"A": (da / n).astype(np.float32), "O": np.einsum("ntk,ntj->kj", hid, ds), "o": ds.sum((0, 1))}
        dh = ds @ p["O"].T
        dx = np.zeros_like(x)
        for d, steps, part in (("f", sf, dh[..., : self.h]), ("b", sb, dh[..., self.h :])):
            gz = np.empty((n, width, 4 * self.h), np.float32)
            gh, nh, nc = np.zeros_like(p["H" + d]), np.zeros((n, self.h), np.float32), np.zeros((n, self.h), np.float32)
            for t, before, prev, i, f, o, cand, tc in reversed(steps):
                h = part[:, t] + nh
                c = nc + h * o * (1 - tc * tc)
                dz = np.concatenate([c * cand * i * (1 - i), c * prev * f * (1 - f), h * tc * o * (1 - o), c * i * (1 - cand * cand)], 1)
                gz[:, t] = dz
                gh += before.T @ dz
                nh, nc = dz @ p["H" + d].T, c * f
            g |= {"H" + d: gh, "c" + d: gz.sum((0, 1)), "X" + d: np.einsum("nte,ntz->ez", x, gz)}
            dx += gz @ p["X" + d].T
        g["E"] = np.zeros_like(p["E"])
        np.add.at(g["E"], chars, dx)
        return float((z.sum() - gold) / n), g

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 5) -> float:
        g, m, v, step, loss = np.random.default_rng(seed), {}, {}, 0, 0.0
        total = epochs * -(-len(x) // batch)
        for _ in range(epochs):
            order, loss = g.permutation(len(x)), 0.0
            for a in range(0, len(x), batch):
                part = order[a : a + batch]
                one, grad = self.gradients(x[part], y[part])
                loss += one * len(part) / len(x)
                step += 1
                norm = np.sqrt(sum(float((k * k).sum()) for k in grad.values()))
                for k in grad:
                    d = grad[k] * min(1.0, 5 / max(norm, 1e-9))
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * d
                    v[k] = 0.999 * v.get(k, 0) + 0.001 * d * d
                    self.p[k] -= (rate * (1 - 0.9 * step / total) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return loss


def viterbi(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Best tags (rows, width) of padded score rows; a row cannot start inside a span."""
    n, width, k = scores.shape
    start = np.zeros(k, np.float32)
    start[2::2] = -1e4
    best = scores[:, 0] + start
    back = np.zeros((n, width, k), np.int8)
    for t in range(1, width):
        via = best[:, :, None] + transitions
        back[:, t] = via.argmax(1)
        best = np.where((t < lengths)[:, None], via.max(1) + scores[:, t], best)
    tags = np.zeros((n, width), np.int8)
    now = best.argmax(1)
    for t in range(width - 1, -1, -1):
        inside = t < lengths
        tags[inside, t] = now[inside]
        now = np.where(inside, back[np.arange(n), t, now] if t else now, now)
    return tags


def viterbi_forward(scores: np.ndarray, best: np.ndarray | None, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Back pointers and last scores of one stretch (width, tags), going on from ``best`` of the stretch before."""
    back = np.zeros(scores.shape, np.int8)
    for t in range(len(scores)):
        if best is None:
            best = scores[0].copy()
            best[2::2] += np.float32(-1e4)
            continue
        via = best[:, None] + transitions
        back[t] = via.argmax(0)
        best = via.max(0) + scores[t]
        best -= best.max()  # keeps long sums exact; differences decide
    return back, best


def viterbi_back(back: list[np.ndarray], best: np.ndarray) -> np.ndarray:
    """The best tags of all stretches together."""
    now, parts = int(best.argmax()), []
    for pointers in reversed(back):
        tags = np.zeros(len(pointers), np.int8)
        for t in range(len(pointers) - 1, -1, -1):
            tags[t] = now
            now = int(pointers[t, now])
        parts.append(tags)
    return np.concatenate(parts[::-1])


def spans_of(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) of a row of tags."""
    out = []
    for m in re.finditer(rb"([\x01\x03\x05\x07])(\x02|\x04|\x06|\x08)*", tags.astype(np.uint8).tobytes()):
        out.append(((m.group(1)[0] - 1) // 2, m.start(), m.end()))
    return out
