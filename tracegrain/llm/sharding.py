"""Operator 6: shards of near equal bytes by histogram sort, native functions only.

Rows are ordered by (hash of the text, hash of the id), so copies of a text lie
side by side and a group of copies of any size can be cut between two ids.  The
boundaries between shards are found by counting: every round counts the exact
bytes in the 256 pieces of each interval that still holds a boundary, takes the
edge of a piece where it is within ``tolerance`` of the wanted byte count, and
else refines that piece.  At most 7 x 256 sums reach the driver in a round.
Rows then go through one exchange, to the window that numbers them.

Law ``bytes``: shards differ from the mean by at most the tolerance plus one
row, or plus one set of rows that agree in text and id, which stay together.

Slots are gapless from 0 in key order.  A task of the window holds one of 4,096 or
more ranges of the text hash (see RANGE_BYTES); a range with more than twice its
share of rows (copies) is divided by the id's hash.  Offsets of ranges are sums
over at most about three times as many counts, 2**MOST_BITS ranges being the most,
and that is what the broadcast join holds.

Edge cases: a null text has no bytes and size 1; null ids are one id; equal rows
get slots next to each other; an empty table gives no rows; extra columns stay,
those named shard, slot or like the key columns with _in appended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, out_of_the_way

LOW, HIGH = -(2**63), 2**63
#: Bits of the text hash that name a range of the final numbering.
RANGE_BITS = 12
#: A range holds about so many bytes of texts, unless that takes more than so many bits.
RANGE_BYTES, MOST_BITS = 32_000_000, 18


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def keyed(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``df`` with __h, __t (the key) and __n (the size)."""
    body = F.coalesce(F.col(text), F.lit(""))
    return out_of_the_way(df, "__h", "__t", "__n").withColumns({
        "__h": F.xxhash64(body),
        "__t": F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.lit(6)),
        "__n": size_of(F.col(text)),
    })


class _Splitter:
    """A boundary that is looked for: inside __h >> p == prefix, then inside one __h by __t."""

    def __init__(self, target: float):
        self.target, self.below, self.h, self.p, self.prefix, self.edge = target, 0, None, 64, 0, None

    def piece(self) -> tuple:
        return (self.h, self.p, self.prefix)


def _inside(piece: tuple) -> Column:
    h, p, prefix = piece
    c = F.col("__h") if h is None else F.col("__t")
    inside = F.lit(True) if p == 64 else F.shiftright(c, p) == F.lit(prefix)
    return inside if h is None else (F.col("__h") == F.lit(h)) & inside


def splitters(keys: DataFrame, n: int, tolerance: float = 0.001) -> list[tuple[int, int] | None]:
    """The lowest key of shards 1 to n - 1; None: no key is so high."""
    total = keys.agg(F.sum("__n")).first()[0] or 0
    todo = [_Splitter(total * i / n) for i in range(1, n)]
    every, slack = list(todo), tolerance * total / n
    while todo:
        pieces = sorted({s.piece() for s in todo}, key=str)
        which, cell = F.lit(None).cast("int"), F.lit(None).cast("long")
        for i, piece in enumerate(pieces):
            c = F.col("__h") if piece[0] is None else F.col("__t")
            which = F.when(_inside(piece), F.lit(i)).otherwise(which)
            cell = F.when(_inside(piece), F.shiftright(c, piece[1] - 8).bitwiseAND(F.lit(255).cast("long"))).otherwise(cell)
        found = (
            keys.select(which.alias("i"), cell.alias("b"), "__n").where("i is not null")
            .groupBy("i", "b").agg(F.sum("__n").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
        )
        held: dict[int, dict[int, tuple[int, int]]] = {}
        for r in found:
            held.setdefault(r["i"], {})[r["b"]] = (r["n"], r["rows"])
        after = []
        for s in todo:
            h, p, prefix = s.piece()
            at, cells = s.below, held.get(pieces.index(s.piece()), {})
            for step in range(256):
                # from low to high: of the whole signed range, the upper half of the cells is negative
                b = (step + 128) % 256 if p == 64 else step
                n_here, rows = cells.get(b, (0, 0))
                if at + n_here < s.target and step < 255:
                    at += n_here
                    continue
                low = (b - 256 if p == 64 and b >= 128 else b if p == 64 else (prefix << 8) + b) << (p - 8)
                near, far = abs(s.target - at), abs(at + n_here - s.target)
                if min(near, far) <= slack or rows <= 1 or (p == 8 and h is not None):
                    if near <= far:
                        s.edge = (low, LOW) if h is None else (h, low)
                    else:
                        up = low + (1 << (p - 8))
                        s.edge = ((up, LOW) if up < HIGH else None) if h is None else ((h, up) if up < HIGH else (h + 1, LOW) if h + 1 < HIGH else None)
                else:
                    s.below = at
                    if p > 8:
                        s.p, s.prefix = p - 8, low >> (p - 8)
                    else:
                        s.h, s.p, s.prefix = low, 64, 0
                    after.append(s)
                break
        todo = after
    return [s.edge for s in every]


def shard_of(edges: list[tuple[int, int] | None]) -> Column:
    shard = F.lit(0)
    for edge in edges:
        if edge is not None:
            over = (F.col("__h") > F.lit(edge[0])) | ((F.col("__h") == F.lit(edge[0])) & (F.col("__t") >= F.lit(edge[1])))
            shard = shard + over.cast("int")
    return shard


def shard_rows(df: DataFrame, n: int = 8, tolerance: float = 0.001, keys: DataFrame | None = None, order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``df``, which keyed() has made, with ``shard`` and ``slot``; without the key columns.

    ``keys``: the same keys from a cheaper table, if there is one.
    """
    df = out_of_the_way(df, "shard", "slot", "__r", "__p", "__k", "__o")
    keys = cut(df.select("__h", "__t", "__n")) if keys is None else keys
    edges = splitters(keys, n, tolerance)
    total = keys.agg(F.sum("__n")).first()[0] or 0
    ranges = min(max(RANGE_BITS, (total // RANGE_BYTES).bit_length()), MOST_BITS)
    prefix = F.shiftright("__h", 64 - ranges).cast("int")
    counts = keys.groupBy(prefix.alias("r")).count().collect()  # 2**MOST_BITS rows at most
    mean = sum(r["count"] for r in counts) / 2**ranges
    bits = {r["r"]: (int(r["count"] / max(mean, 100)) + 1).bit_length() for r in counts if r["count"] > 2 * max(mean, 100)}
    part = F.lit(0).cast("long")
    if bits:
        table = F.create_map(*[F.lit(x) for kv in sorted(bits.items()) for x in kv])
        wide = F.coalesce(F.element_at(table, prefix), F.lit(0))
        # the top bits of the id's hash, from low to high
        part = F.when(wide > 0, F.call_function("shiftright", F.col("__t"), (F.lit(64) - wide).cast("int"))).otherwise(part)
    placed = lambda x: x.withColumns({"shard": shard_of(edges), "__r": prefix, "__p": part})
    cells = placed(keys).groupBy("shard", "__r", "__p").agg(F.count(F.lit(1)).alias("__c"))
    before = Window.partitionBy("shard").orderBy("__r", "__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("shard", "__r", "__p", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__o"))
    inside = Window.partitionBy("shard", "__r", "__p").orderBy("__h", "__t", *order)
    out = placed(df).withColumn("__k", F.row_number().over(inside) - 1)
    out = out.join(F.broadcast(offsets), ["shard", "__r", "__p"])
    return out.withColumn("slot", (F.col("__o") + F.col("__k")).cast("long")).drop("__h", "__t", "__n", "__r", "__p", "__k", "__o")
