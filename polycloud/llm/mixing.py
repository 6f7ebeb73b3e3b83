"""Mixing sources to target weights by Pfair scheduling.

A source's j-th block may not start before floor((j - 1) / w) and must be placed by ceil(j / w), w its share of the
slots; earliest deadline first keeps every source within one block of its ideal at any time. With integer shares that
sum to D the schedule repeats every D slots, so one period is all that is ever simulated. A source that ends leaves the
others to go on in their own proportions: a new phase with a new period.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NUMBER_ROWS, numbered, unused

BLOCK_ROWS = 64
#: Exponent of the default weights (rows of the source to this power) and the slots of a period.
ALPHA, PERIOD = 0.5, 1000
#: The schedules are broadcast, at most this many places in all.
MAX_SCHEDULE = 4_000_000


def pfair(shares: list[int]) -> list[int]:
    """Which source fills each of the sum(shares) slots of a period."""
    d = sum(shares)
    waiting = [(0, -(-d // w), i, 1) for i, w in enumerate(shares)]  # release, deadline, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    out = []
    for t in range(d):
        while waiting and waiting[0][0] <= t:
            _, deadline, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, i, j))
        deadline, i, j = heapq.heappop(ready)
        assert t < deadline
        out.append(i)
        if j < shares[i]:
            heapq.heappush(waiting, (j * d // shares[i], -(-(j + 1) * d // shares[i]), i, j + 1))
    return out


def phases(shares: list[int], blocks: list[int], most: int | None = None) -> list[dict]:
    """Phases of the whole mix: first slot, period, and for each source still running its first block, share and places in the period.

    A phase ends with the first source that does: with the period, if that source's blocks fill its last one (all sources
    are then exactly in proportion), else with its last block. Sources that end together need one phase. More than
    ``most`` places in all raise a ValueError.
    """
    left, done, start, out, size = list(blocks), [0] * len(blocks), 0, [], 0
    while any(left):
        active = [i for i, n in enumerate(left) if n]
        d = sum(shares[i] for i in active)
        size += d
        if most is not None and size > most:
            raise ValueError(f"the schedule of {len(shares)} sources takes more than {most} places; use smaller shares or larger blocks")
        pattern = pfair([shares[i] for i in active])
        places: dict[int, list[int]] = {i: [] for i in active}
        for t, k in enumerate(pattern):
            places[active[k]].append(t)
        end = min(left[i] // shares[i] * d if left[i] % shares[i] == 0 else left[i] // shares[i] * d + places[i][left[i] % shares[i] - 1] + 1 for i in active)
        out.append({"start": start, "period": d, "sources": {i: (done[i], shares[i], places[i]) for i in active}})
        whole, rest = divmod(end, d)
        for i in active:
            n = whole * shares[i] + sum(p < rest for p in places[i])
            left[i] -= n
            done[i] += n
        start += end
    return out


def slot_of(plan: list[dict], source: int, block: int) -> int:
    ph = [p for p in plan if source in p["sources"] and p["sources"][source][0] <= block][-1]
    first, share, places = ph["sources"][source]
    return ph["start"] + (block - first) // share * ph["period"] + places[(block - first) % share]


def default_shares(rows: list[int], alpha: float = ALPHA, period: int = PERIOD) -> list[int]:
    total = sum(n**alpha for n in rows)
    return [max(1, round(period * n**alpha / total)) for n in rows]


def mix(docs: DataFrame, source: str = "source", id_col: str = "doc_id", shares: dict | None = None, block_rows: int = BLOCK_ROWS, within: str | None = None, order: str | None = None) -> DataFrame:
    """``docs`` with mix_block (slot of its block) and mix_position (gapless from 0): every row once, none dropped or repeated.

    ``shares`` maps sources to integer weights (default: rows to the power ALPHA). Blocks hold ``block_rows`` rows in
    hash order, the last of a source perhaps fewer. Null is a source of its own; sources without a share get 1.
    Columns of any name and kind stay; an empty table gives an empty one. A ValueError says when the schedules would take
    more than MAX_SCHEDULE places: the sum over phases of their periods, of which there are no more than distinct ends of sources.
    With ``within``, each value of that column is a mix of its own, to the same weights. ``order`` names the gapless
    position of an earlier mix; a source's rows then keep that order instead of the hash's.
    """
    spark = docs.sparkSession
    part = F.lit(0) if within is None else F.col(f"`{within}`")
    counts = docs.groupBy(part.alias("g"), F.col(f"`{source}`").alias("s")).agg(F.count("*").alias("n")).collect()
    names = sorted({r.s for r in counts}, key=lambda s: (s is not None, str(s)))
    per_part: dict = {}
    for r in counts:
        per_part.setdefault(r.g, {})[r.s] = r.n
    rows = [sum(p.get(s, 0) for p in per_part.values()) for s in names]
    weight = default_shares(rows) if shares is None else [int(shares.get(n, 1)) for n in names]
    per, room = [], MAX_SCHEDULE
    for g, have in per_part.items():
        blocks = [-(-have.get(s, 0) // block_rows) for s in names]
        plan = phases(weight, blocks, room)
        room -= sum(p["period"] for p in plan)
        short = [(slot_of(plan, i, blocks[i] - 1), block_rows * blocks[i] - have[s]) for i, s in enumerate(names) if s in have]
        for i, s in enumerate(names):
            if s in have:
                per.append((g, s, *map(list, zip(*[(p["sources"][i][0], p["start"], p["period"], p["sources"][i][1], p["sources"][i][2]) for p in plan if i in p["sources"]])), [x for x in short if x[1]]))
    no, pair, gcol, scol, first, start, period, share, places, lacks, block, position = unused(docs, "mix_row", "mix_pair", "mix_part", "mix_source", "mix_first", "mix_start", "mix_period", "mix_share", "mix_places", "mix_short", "mix_block", "mix_position")
    kind, part_kind = docs.schema[source].dataType.simpleString(), "int" if within is None else docs.schema[within].dataType.simpleString()
    side = spark.createDataFrame(per, f"`{gcol}` {part_kind}, `{scol}` {kind}, `{first}` array<long>, `{start}` array<long>, `{period}` array<long>, `{share}` array<long>, `{places}` array<array<long>>, `{lacks}` array<struct<s:long,m:long>>")
    if order is None:
        # Hash order spreads a source's documents; all columns take part, so only wholly equal rows share a place.
        # (Maps have no hash; they take part as sorted entries written out.)
        salt = F.xxhash64(*[F.to_json(F.struct(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema if "variant" not in f.dataType.simpleString()])
        sort = [salt, F.col(f"`{id_col}`")]
    else:  # numbered() takes its buckets in turn, and these are runs of the order
        salt, sort = F.floor(F.col(f"`{order}`") / NUMBER_ROWS), [F.col(f"`{order}`")]
    out = numbered(docs.withColumn(pair, F.struct(part.alias("g"), F.col(f"`{source}`").alias("s"))), pair, sum(rows), salt, sort, no)
    out = out.join(F.broadcast(side), out[pair]["g"].eqNullSafe(side[gcol]) & out[pair]["s"].eqNullSafe(side[scol])).drop(gcol, scol, pair)
    j = F.floor(F.col(no) / block_rows)
    k = F.size(F.filter(first, lambda f: f <= j)) - 1
    at = lambda c: F.get(c, k)
    slot = at(start) + F.floor((j - at(first)) / at(share)) * at(period) + F.get(at(places), ((j - at(first)) % at(share)).cast("int"))
    out = out.withColumn(block, slot.cast("long"))
    missing = F.aggregate(lacks, F.lit(0).cast("long"), lambda acc, x: acc + F.when(x["s"] < F.col(block), x["m"]).otherwise(0))
    out = out.withColumn(position, (F.col(block) * block_rows + F.col(no) % block_rows - missing).cast("long"))
    return out.drop(no, first, start, period, share, places, lacks)


def in_mix_order(docs: DataFrame, rows_per_file: int = 20_000, **how) -> DataFrame:
    """The rows of ``docs`` with its columns only, laid out so that each file is a run of the mix, in order; hard rows as for ``mix``."""
    mixed = mix(docs, **how)
    position = mixed.columns[-1]
    parts = max(1, -(-docs.count() // rows_per_file))
    return mixed.repartitionByRange(parts, position).sortWithinPartitions(position).select(*[F.col(f"`{c}`") for c in docs.columns])
