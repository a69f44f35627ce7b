"""Problem 7: documents packed into containers of fixed capacity (in tokens).

Bounded-space online best fit: a packer keeps at most ``OPEN`` bins open. Their free space is a bitset
(bit f: some open bin has f tokens free), so the tightest bin that takes an item is the lowest set bit
from the item's size on. If none takes it and ``OPEN`` bins are open, the fullest closes, and a new one
opens. A full bin closes at once.

Each task packs the documents of its own partition where they were counted, for all capacities together.
The bins still open at its end are items of the next round (their documents stay together), which packs them in
tasks of about ``ITEMS`` each; what these leave open (``OPEN`` bins a task and capacity at most) goes to the round
after it, until one task is left. A round reads its items in a fixed order, and its result is written before it is
used, so a task that is run again gives the same bins.

A document larger than the capacity is cut into pieces that fill containers, and a last piece that is an
item like any other. Defined cases: null and empty texts are items of size 0 and are placed too; capacities
that are null or below 1 are left out; documents of one ``doc_id`` are separate items.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .tokens import token_counts

OPEN = 256  # bins that a packer keeps open
ITEMS = 20_000  # open bins that one task of a later round packs
KINDS = 1000  # kinds of container at most; the table of kinds is small by nature
PLACED = "container_kind string, capacity long, bin string, doc_id long, piece int, start long, n_tokens long, closed boolean"


class Packer:
    """Bounded-space best fit. ``put`` gives the bin of an item; ``closed`` collects the closed bins' numbers."""

    def __init__(self, capacity: int, most: int = OPEN):
        self.capacity, self.most = capacity, most
        self.bits, self.by_free = 0, {}
        self.count = self.made = 0
        self.closed: list[int] = []

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        number = bins.pop()
        if not bins:
            del self.by_free[free]
            self.bits &= ~(1 << free)
        self.count -= 1
        return number

    def put(self, size: int) -> int:
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.count == self.most:
                self.closed.append(self._take((self.bits & -self.bits).bit_length() - 1))  # the fullest closes first
            free, number = self.capacity, self.made
            self.made += 1
        free -= size
        if free == 0:
            self.closed.append(number)
        else:
            self.by_free.setdefault(free, []).append(number)
            self.bits |= 1 << free
            self.count += 1
        return number


def _first_round(kinds: list[tuple[str, int]], most: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        packers = [Packer(capacity, most) for _, capacity in kinds]
        waiting: list[dict[int, list]] = [{} for _ in kinds]
        lone = [0] * len(kinds)
        for batch in batches:
            out: list[tuple] = []
            docs = list(zip(batch["doc_id"].tolist(), batch["n_tokens"].tolist()))
            for k, (kind, capacity) in enumerate(kinds):
                packer, held = packers[k], waiting[k]
                for doc, n in docs:
                    n, at, piece = int(n), 0, 0
                    while n - at > capacity:
                        out.append((kind, capacity, f"{task}.{k}f{lone[k]}", doc, piece, at, capacity, True))
                        lone[k] += 1
                        at, piece = at + capacity, piece + 1
                    number = packer.put(n - at)
                    held.setdefault(number, []).append((doc, piece, at, n - at))
                    if packer.closed:
                        for c in packer.closed:
                            out += [(kind, capacity, f"{task}.{k}c{c}", *row, True) for row in held.pop(c)]
                        packer.closed.clear()
            if out:
                yield pd.DataFrame(out, columns=_NAMES)
        out = []
        for k, (kind, capacity) in enumerate(kinds):
            for number, rows in waiting[k].items():
                out += [(kind, capacity, f"{task}.{k}c{number}", *row, False) for row in rows]
        if out:
            yield pd.DataFrame(out, columns=_NAMES)

    return run


_NAMES = ["container_kind", "capacity", "bin", "doc_id", "piece", "start", "n_tokens", "closed"]


def _later_round(number: int, most: int):
    """Packs bins (read in a fixed order) into larger ones; the last rows tell how much of each open bin is used."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        packers: dict[tuple[str, int], Packer] = {}
        closed: set[str] = set()
        rows: list[tuple] = []
        for batch in batches:
            for kind, capacity, name, used in zip(batch["container_kind"], batch["capacity"], batch["bin"], batch["used"]):
                packer = packers.setdefault((kind, capacity), Packer(int(capacity), most))
                rows.append((kind, capacity, name, f"m{number}.{task}.{packer.put(int(used))}", int(used)))
                closed |= {f"{kind}\0m{number}.{task}.{c}" for c in packer.closed}
                packer.closed.clear()
        yield pd.DataFrame([(*r, f"{r[0]}\0{r[3]}" in closed) for r in rows], columns=["container_kind", "capacity", "bin", "merged", "used", "closed"])

    return run


def pack(documents: DataFrame, containers: DataFrame, path: str | None = None, most: int = OPEN, items: int = ITEMS) -> DataFrame:
    """One row per placed piece: container_kind, container_id, doc_id, piece, start, n_tokens."""
    rows = containers.where("capacity >= 1 and container_kind is not null").select("container_kind", "capacity").distinct().limit(KINDS + 1).collect()
    if len(rows) > KINDS:
        raise ValueError(f"more than {KINDS} kinds of container")
    kinds = sorted((r.container_kind, int(r.capacity)) for r in rows)
    sizes = token_counts(documents, ["doc_id"], path=path)
    placed = cut(sizes.mapInPandas(_first_round(kinds, most), PLACED))  # read three times below: written once, so that no text is counted twice
    left = cut(placed.where("not closed").groupBy("container_kind", "capacity", "bin").agg(F.sum("n_tokens").alias("used")))
    n, number, names = left.count(), 0, None
    each = max(items, 4 * most * len(kinds))  # a task leaves a quarter of its items open at most
    while n:
        parts, number = -(-n // each), number + 1
        dealt = left.repartition(parts, F.pmod(F.xxhash64("bin"), F.lit(parts))).sortWithinPartitions("container_kind", "capacity", F.desc("used"), "bin")
        merged = cut(dealt.mapInPandas(_later_round(number, most), "container_kind string, capacity long, bin string, merged string, used long, closed boolean"))
        step = merged.select("container_kind", F.col("bin").alias("now"), "merged")
        if names is None:
            names = step.select("container_kind", F.col("now").alias("bin"), F.col("merged").alias("now"))
        else:
            names = names.join(step, ["container_kind", "now"], "left").select("container_kind", "bin", F.coalesce("merged", "now").alias("now"))
        if parts == 1:
            break
        left = cut(merged.where("not closed").groupBy("container_kind", "capacity", F.col("merged").alias("bin")).agg(F.sum("used").alias("used")))
        n = left.count()
    out = placed.where("closed")
    if names is not None:
        whole = placed.where("not closed").join(names, ["container_kind", "bin"]).withColumn("bin", F.col("now")).drop("now")
        out = out.unionByName(whole)
    return out.select("container_kind", F.col("bin").alias("container_id"), "doc_id", "piece", "start", "n_tokens")


def packing_report(documents: DataFrame, containers: DataFrame, path: str | None = None) -> DataFrame:
    """Per kind: containers used, tokens, filled share, and the least number any packing needs by volume."""
    placed = pack(documents, containers, path)
    bins = placed.groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("pieces"))
    totals = bins.groupBy("container_kind").agg(F.count("*").alias("used_containers"), F.sum("used").alias("tokens"), F.sum("pieces").alias("pieces"))
    kinds = containers.groupBy("container_kind").agg(F.max("capacity").alias("capacity"))
    return totals.join(kinds, "container_kind").select(
        "container_kind", "capacity", F.col("used_containers").alias("containers"), "pieces", "tokens", (F.col("tokens") / (F.col("used_containers") * F.col("capacity"))).alias("filled"), F.ceil(F.col("tokens") / F.col("capacity")).alias("least_containers")
    )
