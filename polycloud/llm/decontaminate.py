"""Benchmark decontamination with training suffix arrays.

Every slice of training documents gets a word-level suffix array (prefix doubling); every benchmark suffix is
binary-searched in all of them, which yields its verbatim matches of at least the window and their places. Runs of
matches along a diagonal are the longest verbatim matches. Documents stay whole in one row, so nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, LOWER, batches_of, lower_words, shared_path, text_bytes, unused, word_hashes, word_spans

WINDOW = 10
#: Largest benchmark that is broadcast. A larger one is cut into blocks of about this size in the shared folder, of which a
#: task holds one at a time, and so many bytes of documents meet every block together.
BLOCK_BYTES, GROUP_BYTES = 32 << 20, 64 << 20

MATCH = T.ArrayType(T.StructType([T.StructField("item_id", T.StringType()), T.StructField("doc_word", T.LongType()), T.StructField("item_word", T.LongType()), T.StructField("n_words", T.LongType())]))
_MATCH_ARROW = pa.list_(pa.struct([("item_id", pa.string()), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("n_words", pa.int64())]))


class Benchmark:
    """A block of benchmark items and the heads (a window of word hashes) of their suffixes."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.window = window
        self.items: list[tuple[str, list[bytes], int]] = []
        heads: dict[bytes, list[tuple[int, int]]] = {}
        for item_id, text in items:
            raw = (text or "").encode()
            data = np.frombuffer(raw, np.uint8)
            s, e = word_spans(data, np.array([0, len(data)]), ALNUM)
            if len(s):
                n = min(window, len(s))
                h = word_hashes(data, s, e).tobytes()
                for p in range(len(s) - n + 1):
                    heads.setdefault(h[8 * p : 8 * (p + n)], []).append((len(self.items), p))
                self.items.append(("null" if item_id is None else item_id, lower_words(raw), n))
        #: The distinct heads (zeros behind short ones), their lengths, and the (item, place) pairs that each stands for.
        self.heads = np.array([np.frombuffer(x.ljust(8 * window, b"\0"), np.uint64) for x in heads]).reshape(-1, window)
        self.size = np.array([len(x) // 8 for x in heads], np.int64)
        self.carriers = list(heads.values())


class SuffixArray:
    """All suffixes of one slice of documents in the order of their first ``depth`` words or more; a suffix ends with its document."""

    def __init__(self, h: np.ndarray, limits: np.ndarray, depth: int):
        self.h, self.limits = h, limits  # limits[i]: the end of word i's document
        places = np.arange(len(h))
        rank = np.unique(h, return_inverse=True)[1] + 1
        k = 1
        self.order = np.argsort(rank)
        while k < depth:
            after = places + k
            key = rank * (len(h) + 2) + np.where(after < limits, rank[np.minimum(after, max(0, len(h) - 1))], 0)
            self.order = np.argsort(key)
            key = key[self.order]
            rank = np.empty(len(h), np.int64)
            rank[self.order] = np.cumsum(np.concatenate([[1], key[1:] != key[:-1]])) if len(h) else 0
            k *= 2

    def _bound(self, heads: np.ndarray, size: np.ndarray, right: bool) -> np.ndarray:
        """For each head the first suffix that does not sort before it (or, ``right``, the first behind those that start with it)."""
        lo, hi = np.zeros(len(heads), np.int64), np.full(len(heads), len(self.h))
        while (lo < hi).any():
            mid = (lo + hi) // 2
            at = self.order[np.minimum(mid, len(self.h) - 1)]
            less = np.zeros(len(heads), bool)  # the suffix sorts before the head
            open_ = lo < hi
            for k in range(heads.shape[1]):
                some = np.flatnonzero(open_ & (k < size))
                if not len(some):
                    break
                there = at[some] + k
                ends = there >= self.limits[at[some]]
                word = self.h[np.minimum(there, len(self.h) - 1)]
                before, differ = ends | (word < heads[some, k]), ends | (word != heads[some, k])
                less[some[before]] = True
                open_[some[differ]] = False
            if right:
                less |= open_  # equal throughout
            go = lo < hi
            lo, hi = np.where(go & less, mid + 1, lo), np.where(go & ~less, mid, hi)
        return lo

    def find(self, heads: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of ``order`` whose suffixes start with the heads."""
        if not len(self.h) or not len(heads):
            return np.zeros(len(heads), np.int64), np.zeros(len(heads), np.int64)
        return self._bound(heads, size, False), self._bound(heads, size, True)


class Slice:
    """Some documents with their suffix array, and what has been found in them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int = WINDOW):
        self.data = data
        self.s, self.e = word_spans(data, offsets, ALNUM)
        self.first = np.searchsorted(self.s, offsets)
        h = word_hashes(data, self.s, self.e)
        self.array = SuffixArray(h, np.repeat(self.first[1:], np.diff(self.first)), window)
        self.matches: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
        self.edges = np.zeros(len(h) + 1, np.int64)

    def search(self, bench: Benchmark) -> None:
        lo, hi = self.array.find(bench.heads, bench.size)
        hits = [(k, p, self.array.order[lo[i] : hi[i]]) for i in np.flatnonzero(hi > lo).tolist() for k, p in bench.carriers[i]]
        if not hits:
            return
        # Heads on one diagonal (same item, same offset between text and item) at consecutive places are one maximal match.
        item = np.concatenate([np.full(len(x), k) for k, _, x in hits])
        place = np.concatenate([x for _, _, x in hits])
        inside = np.concatenate([np.full(len(x), p) for _, p, x in hits])
        order = np.lexsort((place, place - inside, item))
        item, place, inside = item[order], place[order], inside[order]
        where = np.searchsorted(self.first, place, "right") - 1
        new = np.ones(len(item), bool)
        new[1:] = (item[1:] != item[:-1]) | (place[1:] != place[:-1] + 1) | (inside[1:] != inside[:-1] + 1) | (where[1:] != where[:-1])
        begins = np.flatnonzero(new)
        for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(item)]):
            item_id, words, n = bench.items[item[a]]
            size, w, p, d = b - a + n - 1, int(place[a]), int(inside[a]), int(where[a])
            # Equal hashes are confirmed on the words themselves.
            same = [LOWER[self.data[self.s[w + i] : self.e[w + i]]].tobytes() == words[p + i] for i in range(size)]
            i = 0
            while i < size:
                j = i
                while j < size and same[j]:
                    j += 1
                if j - i >= n:
                    self.matches[d].append({"item_id": item_id, "doc_word": w + i - int(self.first[d]), "item_word": p + i, "n_words": j - i})
                    self.edges[w + i] += 1
                    self.edges[w + j] -= 1
                i = j + 1

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Words of each document, and those inside a match."""
        sums = np.concatenate([[0], np.cumsum(np.cumsum(self.edges[:-1]) > 0)])
        return np.diff(self.first), sums[self.first[1:]] - sums[self.first[:-1]]


def find_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all by default) plus n_words, n_hit (words inside any occurrence of a window) and matches (maximal verbatim ones).

    A null or empty text has no words and no match; an item without words matches nothing; an item shorter than the
    window must occur whole; repeated items and documents each count by themselves; items of one id count as one item.
    """
    load, n_blocks = _blocks(benchmark, item_id, item_text)
    names = unused(docs, "n_words", "n_hit", "matches")
    carry = docs.columns if carry is None else carry
    schema = T.StructType([*[docs.schema[c] for c in carry], T.StructField(names[0], T.LongType()), T.StructField(names[1], T.LongType()), T.StructField(names[2], MATCH)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, Benchmark] | None = None
        group: list[tuple[pa.RecordBatch, Slice]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held
            for i in range(n_blocks):
                if held is None or held[0] != i:
                    held = None
                    held = (i, Benchmark(load(i), window))
                for _, part in group:
                    part.search(held[1])
            for batch, part in group:
                total, hit = part.counts()
                yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in carry], pa.array(total, pa.int64()), pa.array(hit, pa.int64()), pa.array(part.matches, _MATCH_ARROW)], names=[*carry, *names])

        for whole in batches:
            for batch in batches_of(whole, text):
                data, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
                group.append((batch, Slice(data, offsets, window)))
                size += len(data)
                if n_blocks < 2 or size >= GROUP_BYTES:
                    yield from flush()
                    group, size = [], 0
        yield from flush()

    return docs.mapInArrow(run, schema)


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> tuple[Callable[[int], list[tuple]], int]:
    """How to get the items of block i on an executor, and the number of blocks. Only a benchmark of up to BLOCK_BYTES passes the driver."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).cast("string").alias("t"))
    total = items.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("t"), F.lit(0)) + 16), F.lit(0))).first()[0]
    if total <= BLOCK_BYTES:
        sent = spark.sparkContext.broadcast([(r.i, r.t) for r in items.collect()])
        return lambda _: sent.value, 1
    blocks = -(-total // BLOCK_BYTES)
    path = shared_path(spark, "benchmark")
    items.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(blocks)).cast("int")).repartition("block").write.partitionBy("block").parquet(path)

    def load(i: int) -> list[tuple]:
        fs, at = pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
        if fs.get_file_info(f"{at}/block={i}").type == pafs.FileType.NotFound:
            return []
        t = ds.dataset(f"{at}/block={i}", filesystem=fs, format="parquet").to_table(columns=["i", "t"])
        return list(zip(t["i"].to_pylist(), t["t"].to_pylist()))

    return load, blocks


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest_match (its words) and places for every document.

    ``places`` lists the maximal matches as item_id:doc_word:item_word:n_words (words counted from 0), comma-joined in the
    order of doc_word, item_word, item_id. Null and empty texts have none; repeated rows a row each; other columns are not read.
    """
    found = find_matches(docs.select("doc_id", "text"), benchmark, carry=["doc_id"])
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    ordered = F.array_sort(F.transform("matches", lambda m: F.struct(m["doc_word"], m["item_word"], m["item_id"], m["n_words"])))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["n_words"])), F.lit(0)).cast("long").alias("longest_match"),
        F.array_join(F.transform(ordered, lambda m: F.concat_ws(":", m["item_id"], m["doc_word"].cast("string"), m["item_word"].cast("string"), m["n_words"].cast("string"))), ",").alias("places"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no benchmark window occurs, columns unchanged (whatever their names).

    Null and empty texts stay; repeated rows share their fate; an empty benchmark removes nothing.
    """
    found = find_matches(docs, benchmark)
    hit = found.columns[len(docs.columns) + 1]
    return found.filter(F.col(hit) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def brute_force(docs: list[tuple[object, str | None]], items: list[tuple[object, str | None]], window: int = WINDOW) -> list[tuple]:
    """What ``report`` returns for lists of rows, by plain comparison of every window (tests)."""
    out = []
    for doc_id, text in docs:
        words = lower_words((text or "").encode())
        hit, ids = set(), set()
        for item_id, item in items:
            target = lower_words((item or "").encode())
            n = min(window, len(target))
            grams = {tuple(target[p : p + n]) for p in range(len(target) - n + 1)} if n else set()
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
                    ids.add("null" if item_id is None else str(item_id))
        out.append((doc_id, len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out
