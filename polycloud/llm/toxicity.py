"""Toxicity by lexicon induction.

The words of all documents form a graph weighted by positive pointwise mutual information of their co-occurrence within
WINDOW words. Random walks with restart from words that labels mark as toxic, and from words they mark as clean, give
each word a polarity; a document is scored from the polarities of its words, put on a 0..1 scale by a logistic fit.

Pairs of words are as many as the words of the corpus, so they travel and rest packed: sorted codes of a bucket, their
differences as zstandard-compressed byte planes (about two bytes a pair).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, batches_of, drop_table, lean, mix, table, text_bytes, tidy, unused, word_hashes, word_spans

#: Labelled rows that seeds and scale are fitted on, at most about (chosen by hash of doc_id); words and their pairs are counted in all documents.
MAX_FIT_ROWS = 10_000
#: Documents a term must occur in, at least and as a share of all; and the share beyond which it is a function word.
#: Words in a share s of the documents or more number at most (distinct words of a mean document) / s, which bounds
#: the vocabulary whatever the corpus.
MIN_DOCS, MIN_SHARE, MAX_SHARE = 3, 1e-5, 0.2
#: Walks end when no more than TOLERANCE of the visits move in a step.
WINDOW, RESTART, STEPS, TOLERANCE = 5, 0.15, 60, 1e-3
#: Distinct words or pairs that a task holds before it passes them on; pairs of a bucket; passes that turn pairs into arcs.
HELD, BUCKET_PAIRS, PASSES = 1_500_000, 4_000_000, 4
#: Bytes of text whose words or pairs a task counts at once.
TEXT_BYTES = 1 << 19
#: Codes that are packed together, so that a step over them stays in a core's cache.
PACK = 1 << 16
#: Graphs that are smaller once packed are walked by the driver (the same steps without a job for each).
LOCAL_BYTES = 8 << 20
STRONG = 0.5


class Words:
    """Places of hashes in a sorted table of distinct ones, started from their leading bits."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.append(hashes, ~np.uint64(0))
        bits = max(8, (4 * len(hashes)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.start = np.searchsorted(hashes, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each of ``h``, and whether it is there (a place is arbitrary where it is not)."""
        k = self.start[(h >> self.shift).astype(np.int64)]
        low = np.flatnonzero(self.hashes[k] < h)
        while len(low):
            k[low] += 1
            low = low[self.hashes[k[low]] < h[low]]
        return k, (self.hashes[k] == h) & (k < len(self.hashes) - 1)


@dataclass
class Lexicon:
    """Terms (hash, sorted) with polarity in -1..1, and the logistic scale."""

    hashes: np.ndarray
    polarity: np.ndarray
    beta: np.ndarray


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the first of each text."""
    data, offsets = text_bytes(column)
    s, e = word_spans(data, offsets, ALNUM)
    return word_hashes(data, s, e), np.searchsorted(s, offsets)


def features(column: pa.Array, words: Words, polarity: np.ndarray) -> np.ndarray:
    """Per text: strongest polarity, log strong words, log summed positive polarity, share of strong words, mean polarity."""
    h, first = _tokens(column)
    k, ok = words.find(h)
    weight = np.where(ok, np.append(polarity, 0.0)[k], 0.0)
    n = np.diff(first)
    out = np.zeros((len(n), 5))
    some = np.flatnonzero(n)
    if len(some):
        at = first[some]
        strong = (weight > STRONG).astype(float)
        out[some, 0] = np.maximum.reduceat(weight, at)
        out[some, 1] = np.log1p(np.add.reduceat(strong, at))
        out[some, 2] = np.log1p(np.add.reduceat(np.maximum(weight, 0), at))
        out[some, 3] = np.sqrt(np.add.reduceat(strong, at) / n[some])
        out[some, 4] = np.add.reduceat(weight, at) / n[some]
    return out


# --- packed counts


def pack(x: np.ndarray) -> bytes:
    """Non-negative integers as compressed byte planes."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(raw: bytes | pa.Buffer) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    wide = np.flatnonzero(planes.any(1))
    out = np.zeros(planes.shape[1], np.int64)
    for k in wide.tolist():
        out |= planes[k].astype(np.int64) << (8 * k)
    return out


def _rows(bucket: np.ndarray | int, code: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    """Rows (bucket, codes, counts) of counts whose codes ascend within a bucket; ``bucket`` may be one for all."""
    if isinstance(bucket, np.ndarray):
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket)
        ends = np.cumsum(sizes)
        runs = [(k, int(ends[k] - sizes[k]), int(ends[k])) for k in np.flatnonzero(sizes).tolist()]
    else:
        order, runs = None, [(bucket, 0, len(code))] if len(code) else []
    parts = []
    for k, x, y in runs:
        for a in range(x, y, PACK):
            at = slice(a, min(a + PACK, y)) if order is None else order[a : min(a + PACK, y)]
            parts.append((k, pack(np.diff(code[at], prepend=0)), pack(c[at])))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*parts) if parts else ((),) * 3, (pa.int64(), pa.binary(), pa.binary()))], names=["bucket", "codes", "counts"])


def _small(bucket: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket numbers in few bytes (two sort by radix)."""
    return bucket.astype(np.uint16 if buckets <= 1 << 16 else np.int32)


PACKED = "bucket long, codes binary, counts binary"


class Counter:
    """Sums of counts per code, held sorted; ``add`` takes codes in any order."""

    def __init__(self, width: int = 1):
        self.width, self.parts, self.held, self.least = width, [], 0, HELD

    def add(self, code: np.ndarray, *counts: np.ndarray) -> bool:
        """Whether so many codes are held, even once merged, that they should go on."""
        self.parts.append((code, *counts))
        self.held += len(code)
        if self.held > self.least:
            self.merge()
            self.least = max(HELD, 2 * self.held)
            return self.held > HELD // 2
        return False

    def merge(self) -> tuple[np.ndarray, ...]:
        if len(self.parts) != 1 and self.parts:
            columns = [list(x) for x in zip(*self.parts)]
            self.parts = []

            def column() -> np.ndarray:  # the parts go as soon as they are together
                out = np.concatenate(columns[0])
                del columns[0]
                return out

            code = column()
            order = np.argsort(code)
            code = code[order]
            at = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
            code = code[at]
            counts = []
            while columns:
                c = column()[order]
                counts.append(np.add.reduceat(c, at) if len(at) else c)
            self.parts = [(code, *counts)]
            self.held = len(at)
        return self.parts[0] if self.parts else (np.zeros(0, np.int64),) * (1 + self.width)

    def take(self) -> tuple[np.ndarray, ...]:
        out = self.merge()
        self.parts, self.held, self.least = [], 0, HELD
        return out


def _merged(packed: DataFrame) -> DataFrame:
    """One row per bucket: equal codes summed. A task holds one bucket's distinct codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, Counter()
        for batch in batches:
            for b, codes, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if b != now and now is not None:
                    code, c = held.take()
                    yield _rows(now, code, c)
                    del code, c
                now = b
                held.add(np.cumsum(unpack(codes.as_buffer())), unpack(counts.as_buffer()))
        if now is not None:
            code, c = held.take()
            yield _rows(now, code, c)

    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(run), PACKED)


def word_counts(marked: DataFrame) -> DataFrame:
    """(h, n, m, t) of ``marked(y, text)``: documents with the word, labelled ones among them, toxic ones among those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter(3)
        for whole in batches:
            for batch in batches_of(whole, "text", TEXT_BYTES):
                h, first = _tokens(batch.column(1))
                rows = batch.num_rows
                word, inverse = np.unique(h, return_inverse=True)
                code = np.sort(inverse * rows + np.repeat(np.arange(rows), np.diff(first)))
                code = code[np.concatenate([[True], code[1:] != code[:-1]])] if len(code) else code
                mark = batch.column(0).fill_null(-1).to_numpy()[code % rows]
                if held.add(word.view(np.int64), *(np.bincount(code // rows, w, len(word)).astype(np.int64) for w in (None, mark >= 0, mark == 1))):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.take()], names=["h", *"nmt"])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in held.take()], names=["h", *"nmt"])

    return marked.mapInArrow(tidy(run), "h long, n long, m long, t long").groupBy("h").agg(*[F.sum(x).alias(x) for x in "nmt"])


def pair_counts(docs: DataFrame, vocabulary: np.ndarray, ids: np.ndarray, buckets: int) -> DataFrame:
    """Packed counts of the pairs (i < j) of words within WINDOW words of each other, code i * size + j; ``ids`` numbers the sorted ``vocabulary``."""
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, ids))
    size = len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, number = Words(sent.value[0]), np.append(sent.value[1].astype(np.int64), -1)
        held = Counter()

        def flush() -> pa.RecordBatch:
            code, c = held.take()
            # A frequent word's pairs are spread over buckets by their other end.
            bucket = _small(np.empty(len(code), np.uint16), buckets)
            for a in range(0, len(code), PACK):
                some = code[a : a + PACK]
                bucket[a : a + PACK] = mix((some // size * 65536 + (some % size >> 16)).astype(np.uint64)) % np.uint64(buckets)
            return _rows(bucket, code, c)

        for whole in batches:
            for batch in batches_of(whole, "text", TEXT_BYTES):
                h, first = _tokens(batch.column(0))
                k, ok = words.find(h)
                k = np.where(ok, number[k], -1)
                doc = np.repeat(np.arange(batch.num_rows), np.diff(first))
                near = []
                for d in range(1, WINDOW + 1):
                    a, b = k[:-d], k[d:]
                    use = np.flatnonzero((a >= 0) & (b >= 0) & (a != b) & (doc[:-d] == doc[d:]))
                    a, b = a[use], b[use]
                    near.append(np.minimum(a, b) * size + np.maximum(a, b))
                code = np.sort(np.concatenate(near))
                at = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
                if held.add(code[at], np.diff(np.append(at, len(code)))):
                    yield flush()
        if held.held:
            yield flush()

    return _merged(docs.select("text").mapInArrow(tidy(run), PACKED))


def arcs_of(pairs: DataFrame, size: int, buckets: int, part: int, parts: int) -> DataFrame:
    """The pairs in both directions, code to * size + from, in buckets of ``to``; those buckets that ``part`` of ``parts`` has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def flush() -> pa.RecordBatch:
            code, c = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.argsort(code)
            code, c = code[order], c[order]
            del order
            return _rows(_small(code // size % buckets, buckets), code, c)

        for batch in batches:
            for codes, counts in zip(batch.column(1), batch.column(2)):
                code, c = np.cumsum(unpack(codes.as_buffer())), unpack(counts.as_buffer())
                i, j = code // size, code % size
                for to, at in ((i, j), (j, i)):
                    mine = np.flatnonzero(to % buckets % parts == part)
                    held.append((to[mine] * size + at[mine], c[mine]))
                    n += len(mine)
                if n > HELD:
                    yield flush()
                    n = 0
        if n:
            yield flush()

    return _merged(pairs.mapInArrow(tidy(run), PACKED))


def walks(arcs: list[DataFrame], size: int, seeds: list[np.ndarray]) -> list[np.ndarray]:
    """Stationary visits of walks on the graph that return to their seeds with probability RESTART; one sum per word and step reaches the driver."""
    context = arcs[0].sparkSession.sparkContext
    rows = arcs[0]
    for more in arcs[1:]:
        rows = rows.unionAll(more)
    volume = rows.agg(F.coalesce(F.sum(F.octet_length("codes") + F.octet_length("counts")), F.lit(0))).first()[0]
    local = rows.toArrow().to_batches() if volume < LOCAL_BYTES else None

    def sums(columns: int, of: Callable[[np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]]) -> np.ndarray:
        """For each word, the sums of ``of(to, from, c)`` over its arcs."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for codes, counts in zip(batch.column(1), batch.column(2)):
                    code = np.cumsum(unpack(codes.as_buffer()))
                    to = code // size
                    at = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
                    yield pa.RecordBatch.from_arrays([pa.array(to[at]), *[pa.array(np.add.reduceat(v, at, dtype=np.float64)) for v in of(to, code - to * size, unpack(counts.as_buffer()))]], names=["j", *"ab"[:columns]])

        if local is not None:
            got = pa.Table.from_batches(run(iter(local)), pa.schema([("j", pa.int64()), *((x, pa.float64()) for x in "ab"[:columns])]))
        else:
            with lean(rows.sparkSession):
                got = rows.mapInArrow(run, "j long, " + ", ".join(f"{x} double" for x in "ab"[:columns])).toArrow()
        return np.stack([np.bincount(got["j"].to_numpy(), got[x].to_numpy().astype(np.float64), size) for x in "ab"[:columns]])

    mass = sums(1, lambda i, j, c: [c])[0]
    total = float(np.log(max(mass.sum(), 1e-12)))
    sent = context.broadcast(np.log(np.maximum(mass, 1e-12)).astype(np.float32))
    logs = np.log(np.maximum(np.arange(256), 1))

    def weight(i: np.ndarray, j: np.ndarray, c: np.ndarray) -> np.ndarray:
        m = sent.value
        lc = logs[c] if c.max(initial=0) < 256 else np.log(c)
        lc = lc + total - m[i]
        lc -= m[j]
        return np.maximum(lc, 0.0, out=lc)

    out = np.maximum(sums(1, lambda i, j, c: [weight(i, j, c)])[0], 1e-300)
    start = np.stack([s / max(s.sum(), 1e-12) for s in seeds])
    x = start.copy()
    for _ in range(STEPS):
        now = context.broadcast((x / out).astype(np.float32))

        def send(i: np.ndarray, j: np.ndarray, c: np.ndarray, now=now) -> list[np.ndarray]:
            w = weight(i, j, c)
            return [y[j] * w for y in now.value]

        moved = sums(len(seeds), send)
        now.destroy()
        moved += start * (1 - moved.sum(1, keepdims=True))  # what stood on words without neighbours returns
        before, x = x, RESTART * start + (1 - RESTART) * moved
        if np.abs(x - before).sum(1).max() < TOLERANCE:
            break
    sent.destroy()
    return list(x)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS) -> Lexicon:
    """The lexicon from all of ``docs`` and ``labels(doc_id, toxic)``; at most about ``max_rows`` labels give the seeds and the scale.

    Labels that are null, neither 0 nor 1, or of no document teach nothing; of repeated labels the largest counts. Null and
    empty texts have no words. Without a toxic and a clean labelled row, or without words, every score is the share of toxic labels.
    """
    spark = docs.sparkSession
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marks = marks.filter("toxic in (0, 1)")
    share = min(1.0, max_rows / max(1, marks.count()))
    chosen = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))).select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_y"))
    # ``chosen`` is bounded by max_rows, so it may be broadcast.
    marked = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"), "left").select(F.col("_y").alias("y"), "text")
    sample = table(marked.filter("y is not null"), "sample")
    labelled, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    total, volume = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()

    least = max(MIN_DOCS, int(np.ceil(MIN_SHARE * total)))
    stats = table(word_counts(marked).filter((F.col("n") >= least) & ((F.col("n") <= max(MIN_DOCS, int(MAX_SHARE * total))) | (F.col("t") > 0.8 * F.col("m")))), "words")
    vocabulary = stats.toArrow()
    drop_table(stats)
    order = np.argsort(vocabulary["h"].to_numpy().view(np.uint64))
    h = vocabulary["h"].to_numpy().view(np.uint64)[order]
    n, m, t = (vocabulary[x].to_numpy().astype(np.float64)[order] for x in "nmt")
    del vocabulary
    size = len(h)
    tested = m >= MIN_DOCS
    if not tested.any() or not toxic or toxic == labelled:
        base = (toxic + 1) / (labelled + 2)
        return Lexicon(np.zeros(0, np.uint64), np.zeros(0), np.array([np.log(base / (1 - base)), 0, 0, 0, 0, 0]))
    base = toxic / labelled
    rate = t / np.maximum(m, 1)
    z = (t - m * base) / np.sqrt(m * base * (1 - base) + 0.25)
    # Of so many words, some stand out by chance: the bar follows the largest of that many normal draws.
    bad, good = np.where(tested & (z >= np.sqrt(2 * np.log(tested.sum() + 1)) - 0.3) & (rate > 2.5 * base), z, 0.0), np.where(tested & (z < -0.5), -z, 0.0)
    good = np.where(bad > 0, 0.0, good)
    if not bad.any():
        bad = np.where(tested & (z == z[tested].max()), 1.0, 0.0)
    if not good.any():
        good = np.where(tested & (z <= np.median(z[tested])), 1.0, 0.0)

    # Numbers by falling frequency: small differences between the codes of a word's pairs.
    ids = np.empty(size, np.int32)
    ids[np.lexsort((h, -n))] = np.arange(size, dtype=np.int32)
    buckets = max(1, -(-min(volume // 6 * WINDOW, size * size // 2) // BUCKET_PAIRS))
    pairs = table(pair_counts(docs, h, ids, buckets), "pairs")
    arcs = [table(arcs_of(pairs, size, buckets, k, PASSES), "arcs") for k in range(PASSES)]
    drop_table(pairs)
    seed = [np.zeros(size), np.zeros(size)]
    seed[0][ids], seed[1][ids] = bad, good
    p, q = (x[ids] for x in walks(arcs, size, seed))
    for x in arcs:
        drop_table(x)
    # Visits well below those of a typical toxic seed say nothing.
    polarity = (p - q) / (p + q + 0.3 * np.median(p[bad > 0]))
    lex = Lexicon(h, polarity, np.zeros(6))
    sent = spark.sparkContext.broadcast(lex)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(sent.value.hashes)
        for batch in batches:
            for part in batches_of(batch, "text"):
                f = features(part.column(1), words, sent.value.polarity)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(f[:, k]) for k in range(5)]], names=["y", *"abcde"])

    data = sample.mapInArrow(measure, "y int, a double, b double, c double, d double, e double").toArrow()
    drop_table(sample)
    lex.beta = _logistic(np.stack([data[c].to_numpy() for c in "abcde"], 1), data["y"].to_numpy().astype(np.float64))
    return lex


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    x = np.hstack([np.ones((len(x), 1)), x])
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(b)), x.T @ (y - p) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def score(docs: DataFrame, lex: Lexicon, carry: list[str] | None = None, text: str = "text", name: str = "score") -> DataFrame:
    """The columns ``carry`` (all by default) plus the score in 0..1; null and empty texts get the score of no evidence."""
    carry = docs.columns if carry is None else carry
    sent = docs.sparkSession.sparkContext.broadcast(lex)
    schema = T.StructType([*[docs.schema[c] for c in carry], T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, words = sent.value, Words(sent.value.hashes)
        for whole in batches:
            for batch in batches_of(whole, text):
                f = features(batch.column(batch.schema.get_field_index(text)), words, model.polarity)
                p = 1 / (1 + np.exp(-np.clip(model.beta[0] + f @ model.beta[1:], -30, 30)))
                yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in carry], pa.array(p)], names=[*carry, name])

    return docs.mapInArrow(tidy(run), schema)


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learnt from: crc32 of the id as text is divisible by 5. A null id counts as text ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; fitted on the labels that are not held out.

    Null and empty texts get the score of no evidence, repeated rows a row each, an empty table none; see ``fit`` for labels.
    """
    lex = fit(docs, labels.filter(~held_out()))
    scored = score(docs.select("doc_id", "text"), lex, ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """The documents that score below ``limit``, columns unchanged (whatever their names).

    Null and empty texts stay unless toxic labels prevail; repeated rows share their fate; an empty table stays empty.
    """
    name, = unused(docs, "score")
    return score(docs, fit(docs, labels.filter(~held_out())), name=name).filter(F.col(name) < limit).drop(name)
