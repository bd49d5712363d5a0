"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

A document's token ids, with an end id behind them, are cut into pieces of at most
``capacity`` ids (only documents beyond that are cut; their first piece is the short
one). Whole pieces fill a sequence each. All others are dealt by number, not by
content, to regions of bounded size, and each region is packed by islands: in every
island a small population of packings evolves, in every round the best of an island
move on to the next one.

A child takes whole well-filled bins of one parent into the other; bins of the other
that hold one of their documents are opened, and documents that stand nowhere then
are best-fitted, longest first. The first parent of each island is the best-fit
packing by falling length, and the best are never given up, so no region needs more
sequences than best fit does. Bins that no region could fill are opened once more at
the end and packed together over the regions they come from.

Regions are as many as the pieces need, islands and rounds are rows of tables that
are written to the shared folder, so nothing depends on a task that is lost.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from batchloom.llm.common import stored
from batchloom.llm.token_ids import ByteLevel

CAPACITY = 2048
END = 0
REGION = 4096  # pieces that are packed together
ISLANDS, ROUNDS, POPULATION, CHILDREN, ELITE = 3, 3, 5, 8, 2
WELL = 0.97  # of a sequence: bins filled beyond that are worth handing on, others are packed again over regions
SEED = 42


def pieces(docs: DataFrame, vocabulary: ByteLevel, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
           keep_ids: bool = False) -> DataFrame:
    """Per piece: number (its own), doc_id, piece, start, length, ids_crc32, and on demand its ids.

    A null text is empty and has the end id alone. Repeated rows have pieces each.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number = sent.value.encoder(), TaskContext.get().partitionId() << 40
        for batch in batches:
            row, piece, start, length, crc, held = [], [], [], [], [], []
            for at, text in enumerate(batch.column(1)):
                ids = np.append(encoder.ids(text.as_py() or ""), END).astype("<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    row.append(at)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
                    if keep_ids:
                        held.append(ids[a:b].astype(np.int32))
            columns = {
                "number": pa.array(range(number, number + len(row)), pa.int64()), "doc_id": batch.column(0).take(pa.array(row, pa.int32())),
                "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()),
                "ids_crc32": pa.array(crc, pa.int64()),
            }
            if keep_ids:
                columns["ids"] = pa.array(held, pa.list_(pa.int32()))
            number += len(row)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"number long, doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else ""))


def best_fit(lengths: Sequence[int], order: Sequence[int], bins: np.ndarray, room: list[int], capacity: int) -> None:
    """Puts each item of ``order`` into the fullest bin that takes it, else into a new one.

    ``bins`` gets the bin of each item, ``room`` holds what is left in each bin. Bins
    are filed by their room; one bit for each room that occurs finds the least that fits.
    """
    filed: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for number, left in enumerate(room):
        filed[left].append(number)
        rooms |= 1 << left
    for item in order:
        need = lengths[item]
        fits = rooms >> need
        if fits:
            left = need + (fits & -fits).bit_length() - 1
            number = filed[left].pop()
            if not filed[left]:
                rooms ^= 1 << left
        else:
            left, number = capacity, len(room)
            room.append(capacity)
        bins[item] = number
        left -= need
        room[number] = left
        filed[left].append(number)
        rooms |= 1 << left


class Island:
    """A population of packings of the same items, ``lengths`` falling; a packing is the bin of each item."""

    def __init__(self, lengths: np.ndarray, capacity: int, seed: Sequence[int]):
        self.lengths, self.capacity = lengths, capacity
        self.plain = lengths.tolist()
        self.rng = np.random.default_rng(list(seed))
        self.bound = -(-int(lengths.sum()) // capacity)
        self.members: list[tuple[int, float, np.ndarray]] = []

    def add(self, bins: np.ndarray) -> None:
        fill = np.bincount(bins, self.lengths)
        score = (len(fill), -float((fill / self.capacity) @ (fill / self.capacity)))
        if all(score != m[:2] for m in self.members):
            self.members = sorted([*self.members, (*score, bins)], key=lambda m: m[:2])[:POPULATION]

    @property
    def solved(self) -> bool:
        return bool(self.members) and self.members[0][0] == self.bound

    def settle(self) -> None:
        """The first packings: best fit by falling length, then by lengths that are blurred."""
        for k in range(POPULATION):
            if self.solved:
                return
            blurred = self.lengths * self.rng.uniform(1 - 0.05 * k, 1 + 0.05 * k, len(self.lengths))
            bins = np.zeros(len(self.lengths), np.int32)
            best_fit(self.plain, np.argsort(-blurred, kind="stable").tolist(), bins, [], self.capacity)
            self.add(bins)

    def child(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """``one`` with well-filled bins of ``other``; what they displace is best-fitted."""
        fill = np.bincount(other, self.lengths)
        well = fill >= min(self.capacity * WELL, np.median(fill))
        taken = well & (self.rng.random(len(fill)) < self.rng.uniform(0.1, 0.6))
        injected = taken[other]
        fill = np.bincount(one, self.lengths)
        # bins with a document that is injected are opened, and some of the emptiest as well
        opened = fill < np.quantile(fill, self.rng.uniform(0, 0.05))
        opened[one[injected]] = True
        stays = ~opened[one] & ~injected
        bins = np.zeros(len(one), np.int32)
        bins[stays] = (np.cumsum(~opened) - 1)[one[stays]]
        first = int((~opened).sum())
        bins[injected] = first + (np.cumsum(taken) - 1)[other[injected]]
        placed = stays | injected
        room = (self.capacity - np.bincount(bins[placed], self.lengths[placed], minlength=first + int(taken.sum()))).astype(int).tolist()
        best_fit(self.plain, np.flatnonzero(~placed).tolist(), bins, room, self.capacity)
        return bins

    def evolve(self, children: int = CHILDREN) -> None:
        for _ in range(children):
            if self.solved or len(self.members) < 2:
                return
            a, b = self.rng.choice(len(self.members), 2, replace=False)
            self.add(self.child(self.members[a][2], self.members[b][2]))


_STATE = "region long, island int, bins int, bound int, score double, packings array<binary>"


def _evolved(rows: DataFrame, capacity: int, turn: int) -> DataFrame:
    """One round of every island in ``rows`` (region, island, lengths, packings)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                island = Island(np.array(row["lengths"], np.int64), capacity, (SEED, row["region"], row["island"], turn))
                for packing in row["packings"]:
                    island.add(np.frombuffer(packing, np.int32))
                if not island.members:
                    island.settle()
                island.evolve()
                best = island.members[0]
                out.append({"region": row["region"], "island": row["island"], "bins": best[0], "bound": island.bound, "score": best[1],
                            "packings": [m[2].tobytes() for m in island.members]})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("region", pa.int64()), ("island", pa.int32()), ("bins", pa.int32()), ("bound", pa.int32()),
                                                             ("score", pa.float64()), ("packings", pa.list_(pa.binary()))]))

    return rows.mapInArrow(run, _STATE)


def _laid_out(rows: DataFrame) -> DataFrame:
    """region, places (bin and offset of each item) of rows with region, lengths and packing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = []
            for lengths, packing in zip(batch.column(1), batch.column(2)):
                lengths, bins = np.array(lengths.as_py(), np.int64), np.frombuffer(packing.as_py(), np.int32)
                order = np.argsort(bins, kind="stable")
                before = np.cumsum(lengths[order]) - lengths[order]
                new = np.concatenate([[True], np.diff(bins[order]) != 0]) if len(bins) else np.zeros(0, bool)
                offset = np.zeros(len(bins), np.int64)
                offset[order] = before - before[new][np.cumsum(new) - 1]
                fill = np.bincount(bins, lengths).astype(int)
                places.append([{"bin": b, "offset": o, "fill": f} for b, o, f in zip(bins.tolist(), offset.tolist(), fill[bins].tolist())])
            kind = pa.list_(pa.struct([("bin", pa.int32()), ("offset", pa.int64()), ("fill", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places, kind)], ["region", "places"])

    return rows.mapInArrow(run, "region long, places array<struct<bin: int, offset: long, fill: long>>")


def _packed(items: DataFrame, columns: Sequence[str], capacity: int, region: int, dealt: Column) -> DataFrame:
    """``items`` with region, bin, offset and fill (of the bin)."""
    regions = max(1, -(-items.count() // region))
    item = F.struct((-F.col("length")).alias("less"), "number", *[c for c in columns if c != "number"])
    held = stored(items.groupBy(F.pmod(dealt, F.lit(regions)).alias("region")).agg(F.sort_array(F.collect_list(item)).alias("held")), "regions")
    lengths = held.select("region", F.transform("held", lambda x: -x["less"]).alias("lengths"))
    none = F.array().cast("array<binary>")
    rows = lengths.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1)))).withColumn("packings", none)
    rounds = []
    for turn in range(ROUNDS):
        now = stored(_evolved(rows.repartition("region", "island").select("region", "island", "lengths", "packings"), capacity, turn), "islands")
        rounds.append(now)
        # regions at the bound are done; of the others the best of an island move to the next
        open_ = now.groupBy("region").agg(F.min(F.col("bins") - F.col("bound")).alias("over")).filter("over > 0").select("region")
        if turn + 1 == ROUNDS or open_.isEmpty():
            break
        own = now.select("region", "island", "packings")
        guests = now.select("region", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int").alias("island"), F.slice("packings", 1, ELITE).alias("packings"))
        pool = own.unionByName(guests).groupBy("region", "island").agg(F.flatten(F.collect_list("packings")).alias("packings"))
        rows = pool.join(open_, "region", "left_semi").join(lengths, "region")
    made = rounds[0]
    for more in rounds[1:]:
        made = made.unionByName(more)
    best = made.groupBy("region").agg(F.min_by(F.col("packings")[0], F.struct("bins", "score", "island")).alias("packing"))
    places = _laid_out(lengths.join(best, "region").select("region", "lengths", "packing"))
    found = held.join(places, "region").select("region", F.explode(F.arrays_zip("held", "places")).alias("x"))
    kept = [F.col(f"x.held.{c}").alias(c) for c in columns]
    return found.select("region", (-F.col("x.held.less")).alias("length"), *kept, "x.places.bin", "x.places.offset", "x.places.fill")


def pack(cut: DataFrame, capacity: int = CAPACITY, region: int = REGION) -> DataFrame:
    """The pieces (number, length and more columns) with sequence_id and offset.

    No sequence holds more than ``capacity`` ids; offsets are gapless from 0. Ties
    of lengths are broken by number. An empty table gives an empty one.
    """
    cut = stored(cut, "pieces")
    columns = [c for c in cut.columns if c != "length"]
    whole = cut.filter(F.col("length") >= capacity).select("length", *columns, (-1 - F.col("number")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    first = stored(_packed(cut.filter(F.col("length") < capacity), columns, capacity, region, F.xxhash64("number")), "packed")
    numbered = (F.col("region") * (1 << 21) + F.col("bin")) * 2
    # what no region could fill is packed again, several regions' bins together; the better of the two counts
    loose = first.filter(F.col("fill") < capacity * WELL)
    size = first.agg(F.countDistinct("region").alias("regions")).first()["regions"]
    again = []
    if size > 1 and not loose.isEmpty():
        rest = stored(_packed(loose.select("length", *columns), columns, capacity, region, F.xxhash64(F.lit(1), "number")), "packed-again")
        bins = [df.select("region", "bin").distinct().count() for df in (loose, rest)]
        if bins[1] < bins[0]:
            first = first.filter(F.col("fill") >= capacity * WELL)
            again = [rest.select("length", *columns, (numbered + 1).alias("sequence_id"), "offset")]
    out = whole
    for part in (first.select("length", *columns, numbered.alias("sequence_id"), "offset"), *again):
        out = out.unionByName(part)
    return out


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids: the sequences themselves, of pieces that were cut with their ids."""
    laid = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return laid.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))


def packed_documents(docs: DataFrame, vocabulary: ByteLevel, capacity: int = CAPACITY, region: int = REGION) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every row counts as a document of its own: repeated rows and rows without id are
    packed like others. Null and empty texts are one piece of the end id; texts of any
    length are cut; other columns of ``docs`` are not looked at.
    """
    out = pack(pieces(docs, vocabulary, capacity), capacity, region)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
