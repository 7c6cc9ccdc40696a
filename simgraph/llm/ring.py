"""Consistent-hash sharding with virtual nodes and bounded loads, by DataFrame operations only."""

from __future__ import annotations

from bisect import bisect_left
from hashlib import blake2b

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from simgraph.llm.state import cut, prepare

#: Equal cells of the ring (2**14). The plan is made from one count for each cell,
#: so what the driver sees and what is broadcast doesn't grow with the rows.
CELL_BITS = 14
VIRTUAL_NODES = 64
#: Bits of the position behind a cell's: so many parts of a cell are ranked by themselves.
PART_BITS = 4
#: Equal rows that are numbered together.
CHUNK = 1 << 16


def ring_nodes(shards: int, virtual: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """Sorted (cell, shard) of all virtual nodes; a shard's nodes don't depend on how many shards there are."""
    nodes = []
    for shard in range(shards):
        for k in range(virtual):
            at = int.from_bytes(blake2b(f"{shard}/{k}".encode(), digest_size=8).digest(), "big")
            nodes.append((at >> (64 - CELL_BITS), at, shard))
    return [(cell, shard) for cell, _, shard in sorted(nodes)]


def plan(counts: dict[int, int], shards: int, capacity: list[int], virtual: int = VIRTUAL_NODES) -> list[tuple[int, int, int, int]]:
    """(cell, first rank, end rank, shard): where the ranked rows of each cell go.

    A cell's home is the shard of the first virtual node at or after it. Homes
    take their own rows first, in ring order, up to their capacity. The rest
    walks clockwise in one queue; at each virtual node the shard takes from the
    queue's front what it still has room for.
    """
    nodes = ring_nodes(shards, virtual)
    cells = [c for c, _ in nodes]
    room, out = list(capacity), []
    late: dict[int, list[tuple[int, int, int]]] = {}
    for cell in sorted(counts):
        at = bisect_left(cells, cell) % len(nodes)
        home = nodes[at][1]
        took = min(room[home], counts[cell])
        if took:
            out.append((cell, 0, took, home))
            room[home] -= took
        if took < counts[cell]:
            late.setdefault(at, []).append((cell, took, counts[cell]))
    queue: list[tuple[int, int, int]] = []
    laps = 0
    while late or queue:
        for at, (_, shard) in enumerate(nodes):
            queue += late.pop(at, [])
            done = 0
            while done < len(queue) and room[shard]:
                cell, first, end = queue[done]
                took = min(room[shard], end - first)
                out.append((cell, first, first + took, shard))
                room[shard] -= took
                if first + took < end:
                    queue[done] = (cell, first + took, end)
                else:
                    done += 1
            del queue[:done]
        laps += 1
        if laps > 2 and queue and not any(room):
            raise ValueError("the capacities hold fewer rows than there are")
    return out


def capacities(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """Rows that each shard may hold: an equal share, the first ones one more; with slack that much more."""
    return [-(-(rows // shards + (s < rows % shards)) * (1000 + round(1000 * slack)) // 1000) for s in range(shards)]


def bounded_ring(docs: DataFrame, shards: int, text: str = "text", id_col: str = "doc_id", slack: float = 0.0, virtual: int = VIRTUAL_NODES) -> DataFrame:
    """``id_col``, size (UTF-8 bytes + 16), text_crc32, shard and slot of every row.

    The ring position is a hash of the id (of the text where the id is null).
    No shard holds more than (1 + slack) times an equal share of the rows; with
    no slack the counts are at most one apart. Slots are gapless from 0 in each
    shard. Null text: size 16, crc 0. Repeated rows are placed one by one; an
    empty table gives no rows. Rows of a cell are ranked by position, id, crc
    and size, so where they go doesn't depend on how the table is split. Equal
    rows are counted before the shuffle and numbered after it. The driver sees
    one count for each cell; 16 for each are broadcast.
    """
    prepare(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    place = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text "), body)))
    cell = F.shiftrightunsigned("_place", 64 - CELL_BITS).cast("int")
    size = F.octet_length(body).cast("long") + 16
    rows = docs.select(F.col(id_col).alias(id_col), size.alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"), place.alias("_place"))
    keys = ["cell", "_part", "_place", id_col, "text_crc32", "size"]
    part = F.shiftrightunsigned("_place", 64 - CELL_BITS - PART_BITS).bitwiseAND(F.lit((1 << PART_BITS) - 1)).cast("int")
    rows = cut(rows.withColumn("cell", cell).withColumn("_part", part).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))  # equal rows are one, with their number
    sizes = cut(rows.groupBy("cell", "_part").agg(F.sum("n").alias("n")))
    counts = {r.cell: r.n for r in sizes.groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    parts = plan(counts, shards, capacities(sum(counts.values()), shards, slack), virtual)
    filled = [0] * shards
    table = []
    for c, first, end, shard in sorted(parts):
        table.append((c, first, end, shard, filled[shard]))
        filled[shard] += end - first
    spread = docs.sparkSession.createDataFrame(table, "cell int, first long, end long, shard int, base long")
    above = lambda keys, order: F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = rows.withColumn("_first", above(keys[:2], keys[2:])).join(F.broadcast(sizes.select("cell", "_part", above(["cell"], ["_part"]).alias("_before"))), keys[:2])
    first = first.withColumn("_first", F.col("_before") + F.col("_first")).withColumn("_last", F.col("_first") + F.col("n") - 1)
    chunks = first.withColumn("_first", F.explode(F.sequence("_first", "_last", F.lit(CHUNK).cast("long"))))
    if not rows.where(F.col("n") > CHUNK).isEmpty():
        chunks = chunks.repartition("cell", "_first")
    ranked = chunks.withColumn("_rank", F.explode(F.sequence("_first", F.least("_last", F.col("_first") + (CHUNK - 1)))))
    placed = ranked.join(F.broadcast(spread), "cell").where("_rank >= first AND _rank < end")
    return placed.select(id_col, "size", "text_crc32", "shard", (F.col("base") + F.col("_rank") - F.col("first")).alias("slot"))
