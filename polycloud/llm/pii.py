"""Personal data: exact base patterns over whole texts, plus spans that a character BiLSTM-CRF finds around them.

The tagger reads every character of every text, in blocks that it enters REACH characters early from either side, and
Viterbi decodes the whole text. Its pass is made only where it can leave "outside": a bound on what tags can win over a
stretch shows, from the scores, where the best path has no span. A decoded span counts if the tagger is sure of it
(SURE), or, where it is less so, if the span is valid for its kind once its disguise is taken off; and if it touches no
base span.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches_of, byte_set, text_bytes
from .lstm_crf import KINDS, Tagger, encode, labelled_windows, luhn_ok, spans_of, viterbi, viterbi_back, viterbi_forward

#: Characters of a training window; of a block; and read before and behind a block.
WIDTH, BLOCK, REACH = 64, 224, 32
TRAIN_WINDOWS, EPOCHS = 6000, 10
#: Regions decoded together, and blocks scored together; characters whose scores are held at once; bounds memory.
REGIONS, BLOCKS, HELD = 256, 512, 1 << 18
#: A region longer than this is decoded by itself, its scores a stretch at a time; its Viterbi pass still goes over the whole.
LONGEST = 4096
#: Least mean probability of its tags for a span that needs no other confirmation, and the least for any.
SURE, LIKELY = 0.999, 0.5
WEIGHTS = Path(__file__).with_name("tagger.npz")
_BASE_ANCHOR = byte_set((0x30, 0x39), (0x40, 0x40))

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match never starts behind a digit (the run before it would have begun it), and no shorter run of digits can succeed
# where the whole run fails; so these equal the base patterns and stay linear on long runs of digits.
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def valid(kind: str, match: str) -> bool:
    digits = re.sub(r"[^0-9]", "", match)
    if kind == "ip":
        return all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 and len(x.lstrip("0") or "0") <= 3 for x in match.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn_ok(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    return True


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base patterns, sorted."""
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        a = at
        while a > last and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append((a, 0, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for k, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        out += [(m.start(), k, m.end()) for m in pattern.finditer(text) if valid(KINDS[k], m.group())]
    return sorted(out)


def plain_base_spans(text: str) -> list[tuple[int, int, int]]:
    """The base patterns applied literally (tests)."""
    return sorted((m.start(), k, m.end()) for k, kind in enumerate(KINDS) for m in PLAIN[kind].finditer(text) if valid(kind, m.group()))


def undisguised(kind: str, s: str) -> bool:
    """Whether a decoded span is one of its kind once spelt plainly."""
    if kind == "email":
        t = re.sub(r"(?i)\s*[\[({]\s*at\s*[\])}]\s*|\s+@\s+|@", "@", s)
        t = re.sub(r"(?i)\s*[\[({]\s*dot\s*[\])}]\s*|\s+\.\s+", ".", t)
        return PLAIN["email"].fullmatch(t) is not None
    if kind == "ip":
        t = re.sub(r"\s*[\[(]\.[\])]\s*|\s+\.\s+", ".", s)
        return PLAIN["ip"].fullmatch(t) is not None and valid("ip", t)
    if kind == "card":
        return re.fullmatch(r"[0-9]{4}(?:([ ./_-])[0-9]{4}(?:\1[0-9]{1,7}){1,3})", s) is not None and valid("card", s)
    return re.fullmatch(r"(?:(?:\+|00)[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?[ ./-]?[0-9]{3,4}[ .-]?[0-9]{3,4}", s) is not None and ("(" in s or s.startswith(("+", "00"))) and valid("phone", s)


def plausible(kind: str, s: str) -> bool:
    """Whether a span that the tagger is sure of can be one of its kind at all: an address has letters around an at, the others as many digits as their kind."""
    digits = sum(c.isdigit() for c in s)
    if kind == "email":
        return re.search(r"[A-Za-z0-9]", s) is not None and re.search(r"(?i)@|\bat\b", s) is not None and re.search(r"(?i)\.|\bdot\b", s) is not None
    if kind == "ip":
        return [len(x) <= 3 and int(x) <= 255 for x in re.findall(r"[0-9]+", s)] == [True] * 4
    return 12 <= digits <= 19 and luhn_ok(re.sub(r"[^0-9]", "", s)) if kind == "card" else 9 <= digits <= 15


@lru_cache(maxsize=2)
def trained(windows: int = TRAIN_WINDOWS, epochs: int = EPOCHS) -> Tagger:
    """The tagger: by default with the weights that ``python -m polycloud.llm.pii`` has trained and stored, else trained now. Training is deterministic."""
    t = Tagger()
    if (windows, epochs) == (TRAIN_WINDOWS, EPOCHS) and WEIGHTS.exists():
        with np.load(WEIGHTS) as stored:
            t.p = {k: stored[k] for k in stored}
    else:
        t.train(*labelled_windows(windows, WIDTH), epochs)
    return t


def _most(scores: np.ndarray, tags: range, more: np.ndarray) -> np.ndarray:
    """What the best of ``tags``, each with its ``more``, wins over tag 0."""
    best = scores[:, tags[0]] + more[0]
    for k, m in zip(tags[1:], more[1:]):
        np.maximum(best, scores[:, k] + m, out=best)
    return best - scores[:, 0]


class Finder:
    def __init__(self, tagger: Tagger):
        self.tagger, self.transitions = tagger, tagger.transitions()
        # Most that the step to a tag from outside, from another, and back outside can win over staying outside.
        stay = self.transitions[0, 0]
        self.enter, self.go, self.leave = self.transitions[0, 1::2] - stay, self.transitions[1:, 1:].max(0) - stay, float(self.transitions[1:, 0].max() - stay)

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Per text the decoded and confirmed (start, kind, end)."""
        out: list[set] = [set() for _ in texts]
        at = 0
        while at < len(texts):
            n, held = 1, len(texts[at])
            while at + n < len(texts) and held + len(texts[at + n]) + BLOCK <= HELD:
                held += len(texts[at + n]) + BLOCK
                n += 1
            for i, found in zip(range(at, at + n), self.decode(texts[at : at + n])):
                text = texts[i]
                for kind, s, e, sure in found:
                    got = text[s:e]
                    s, e = s + len(got) - len(got.lstrip()), e - len(got) + len(got.rstrip())
                    before, after = text[s - 1 : s] if s else "", text[e : e + 1]
                    whole = s < e and not (before.isalnum() or after.isalnum() or (after in "-_@" and after))
                    if whole and (sure >= SURE and plausible(KINDS[kind], text[s:e]) or sure >= LIKELY and undisguised(KINDS[kind], text[s:e])):
                        out[i].add((s, kind, e))
            at += n
        return [sorted(x) for x in out]

    def decode(self, texts: list[str]) -> list[list[tuple[int, int, int, float]]]:
        """(kind, start, end, mean probability of its tags) of each text's spans: those of the best path over the whole text."""
        length = np.array([len(t) for t in texts])
        blocks = np.maximum(-(-length // BLOCK), 1)
        first = np.cumsum(blocks) - blocks
        chars, inside = np.zeros(blocks.sum() * BLOCK, np.int8), np.zeros(blocks.sum() * BLOCK, bool)
        for t, a in zip(texts, (first * BLOCK).tolist()):
            chars[a : a + len(t)] = encode(t)
            inside[a : a + len(t)] = True
        fresh = np.zeros(blocks.sum() + 1, bool)  # a text begins
        fresh[first] = fresh[-1] = True
        step = max(1, HELD // BLOCK) * BLOCK
        whole, lead, win = None, np.empty(len(chars)), np.empty(len(chars))
        for p in range(0, len(chars), step):
            scores = self._scores(chars, fresh, p, min(p + step, len(chars)))
            here = slice(p, p + len(scores))
            lead[here] = _most(scores, range(1, scores.shape[1], 2), self.enter)
            win[here] = _most(scores, range(1, scores.shape[1]), self.go)
            whole = scores if len(chars) <= step else None
        starts, lasts = first[length > 0] * BLOCK, first[length > 0] * BLOCK + length[length > 0] - 1
        lead[starts] += max(0.0, -float(self.enter.min()))  # no step leads to a text's first character, nor from its last
        win[lasts] += max(0.0, -self.leave)
        lead[lasts] += max(0.0, -self.leave)
        lead[~inside] = win[~inside] = -1e3
        total = np.cumsum(win)
        # Some stretch around the character could win, begun by a beginning tag; elsewhere the best path is outside.
        least = np.minimum.accumulate(total - lead)
        open_ = (np.maximum.accumulate(total[::-1])[::-1] - least > -self.leave - 1e-3) & inside
        begins = open_ & ~np.concatenate([[False], open_[:-1]])
        begins[starts] = open_[starts]
        ends = open_ & np.concatenate([begins[1:] | ~open_[1:], [True]])
        todo = list(zip(np.flatnonzero(begins).tolist(), (np.flatnonzero(ends) + 1).tolist()))
        out: list[list] = [[] for _ in texts]
        for p in range(0, len(chars), step):
            mine = [x for x in todo if p <= x[0] < p + step] if whole is None else todo
            low, held = 0, whole
            if whole is None and mine:  # scores of so many characters are not kept but made again
                low = max(0, p - 1)
                held = self._scores(chars, fresh, low, min(p + step + LONGEST, len(chars)))

            def of(a: int, b: int, low: int = low, held: np.ndarray | None = held) -> np.ndarray:
                return held[a - low : b - low] if low <= a and b <= low + len(held) else self._scores(chars, fresh, a, b)

            mine.sort(key=lambda x: x[1] - x[0])
            at = 0
            while at < len(mine):
                n = REGIONS
                while n > 1 and n * (mine[min(at + n, len(mine)) - 1][1] - mine[min(at + n, len(mine)) - 1][0]) > REGIONS * 512:
                    n //= 2
                part = mine[at : at + n]
                at += n
                text = np.searchsorted(first * BLOCK, [a for a, _ in part], "right") - 1
                origin = (first[text] * BLOCK).tolist()
                # With the character before, which is outside, and that behind.
                before = [int(a > o) for (a, _), o in zip(part, origin)]
                behind = [int(b < o + m) for (_, b), o, m in zip(part, origin, length[text].tolist())]
                for i, o, (a, _), x, found in zip(text.tolist(), origin, part, before, self._paths(part, before, behind, of)):
                    out[i] += [(k, a - x + s - o, a - x + e - o, sure) for k, s, e, sure in found]
        return [sorted(x, key=lambda y: y[1]) for x in out]

    def _paths(self, part: list[tuple[int, int]], before: list[int], behind: list[int], of: Callable[[int, int], np.ndarray]) -> list[list[tuple[int, int, int, float]]]:
        """The spans of regions, whose scores ``of`` gives; positions count from the character before."""

        def outside(scores: np.ndarray, x: int, y: int) -> np.ndarray:
            scores = scores.copy()
            scores[:x, 1:] = -1e4
            scores[len(scores) - y :, 1:] = -1e4
            return scores

        wide = [(a - x, b + y) for (a, b), x, y in zip(part, before, behind)]
        length = np.array([b - a for a, b in wide])
        if len(part) > 1 or length[0] <= LONGEST:
            scores = np.zeros((len(part), int(length.max()), 1 + 2 * len(KINDS)), np.float32)
            for k, ((a, b), x, y) in enumerate(zip(wide, before, behind)):
                scores[k, : b - a] = outside(of(a, b), x, y)
            tags = viterbi(scores, length, self.transitions)
            return [self._with_sureness(t[:n], s[:n]) for t, s, n in zip(tags, scores, length.tolist())]
        # One long region: the Viterbi pass carries on from stretch to stretch of scores.
        (start, end), back, best, sure = wide[0], [], None, []
        for a in range(start, end, LONGEST):
            b = min(a + LONGEST, end)
            scores = outside(of(a, b), before[0] * (a == start), behind[0] * (b == end))
            pointers, best = viterbi_forward(scores, best, self.transitions)
            back.append(pointers)
            top = np.exp(scores - scores.max(1, keepdims=True))
            sure.append((top / top.sum(1, keepdims=True)).astype(np.float16))
        return [self._with_sureness(viterbi_back(back, best), None, np.concatenate(sure))]

    @staticmethod
    def _with_sureness(tags: np.ndarray, scores: np.ndarray | None, p: np.ndarray | None = None) -> list[tuple[int, int, int, float]]:
        found = spans_of(tags)
        if found and p is None:
            p = np.exp(scores - scores.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
        return [(k, a, b, float(p[np.arange(a, b), tags[a:b]].astype(np.float32).mean())) for k, a, b in found]

    def _scores(self, chars: np.ndarray, fresh: np.ndarray, a: int, b: int) -> np.ndarray:
        """(characters, tags) scores of characters ``a`` to ``b``; texts begin at blocks where ``fresh``, and are not read beyond their ends."""
        p, q = a // BLOCK, -(-b // BLOCK)
        out = np.empty((q - p, BLOCK, 1 + 2 * len(KINDS)), np.float32)
        for k in range(p, q, BLOCKS):
            some = np.arange(k, min(k + BLOCKS, q))
            window = chars[np.clip(some[:, None] * BLOCK + np.arange(-REACH, BLOCK + REACH), 0, len(chars) - 1)]
            window[fresh[some], :REACH] = 0
            window[fresh[some + 1], -REACH:] = 0
            out[some - p] = self.tagger.emissions(window, REACH)
        return out.reshape(-1, out.shape[2])[a - p * BLOCK : b - p * BLOCK]


def find(docs: DataFrame, text: str = "text", id_col: str = "doc_id", tagger: Tagger | None = None) -> DataFrame:
    """(id, base, added): arrays of (kind, start, end) in code points, sorted; null and empty texts have none."""
    shipped = docs.sparkSession.sparkContext.broadcast((tagger or trained()).p)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    kind = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Tagger()
        model.p = shipped.value
        finder = Finder(model)
        for whole in batches:
            for batch in batches_of(whole, text):
                column = batch.column(1)
                data, offsets = text_bytes(column)
                near = np.concatenate([[0], np.cumsum(_BASE_ANCHOR[data], dtype=np.int64)])
                bare = near[offsets[1:]] == near[offsets[:-1]]  # no base pattern goes without a digit or an @
                rows = np.flatnonzero(np.diff(offsets)).tolist()
                texts = [column[i].as_py() for i in rows]
                base: list[list] = [[] for _ in range(batch.num_rows)]
                added: list[list] = [[] for _ in range(batch.num_rows)]
                for i, t, more in zip(rows, texts, finder.spans(texts)):
                    base[i] = [] if bare[i] else base_spans(t)
                    added[i] = [x for x in more if not any(x[0] < e and s < x[2] for s, _, e in base[i])]
                name = lambda rows: pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in r] for r in rows], span)
                yield pa.RecordBatch.from_arrays([batch.column(0), name(base), name(added)], names=[id_col, "base", "added"])

    return docs.select(id_col, text).mapInArrow(run, T.StructType([docs.schema[id_col], T.StructField("base", kind), T.StructField("added", kind)]))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans (base and added), n_added for every document.

    Null and empty texts have no spans; repeated rows a row each; texts of any length are read whole; other columns are not
    read; an empty table gives no row.
    """
    found = find(docs)
    order = F.create_map(*[F.lit(x) for k, kind in enumerate(KINDS) for x in (kind, k)])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    every = F.transform(F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("k"), s["end"].alias("end"), s["kind"].alias("kind")))), lambda s: s)
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[number(kind).alias("n_" + kind) for kind in KINDS],
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(every).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with each span replaced by <kind>."""
    out, last = [], 0
    for s, k, e in sorted(spans):
        if s >= last:
            out += [text[last:s], f"<{KINDS[k]}>"]
            last = e
    return "".join([*out, text[last:]])


def _train() -> None:
    t = Tagger()
    t.train(*labelled_windows(TRAIN_WINDOWS, WIDTH), EPOCHS)
    np.savez(WEIGHTS, **t.p)


if __name__ == "__main__":
    _train()
