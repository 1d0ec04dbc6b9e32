"""Shards of near-equal bytes by histogram sort.

Rows are ordered by (hash of the text, doc_id): equal texts stand together and the order
does not follow the source. Splitters are found by counting: in each round the exact
bytes below equally spaced candidate boundaries are summed across all partitions (a
partial aggregate; at most ``splitters x 2^bits`` sums reach the driver), and every
splitter narrows to the interval that holds its target. A splitter stops when a boundary
is within ``tolerance`` of its target. Otherwise it goes on through the bits of the text
hash and, inside one group of equal texts that is too heavy, through the bits of doc_id.
Then rows get their shard from the splitters and are exchanged once.

Defined cases: null text has no bytes; a null doc_id sorts before all others; rows that
agree in text and doc_id stay in one shard; with fewer rows than shards some shards are
empty; all columns pass through, existing ``size``, ``shard`` and ``slot`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glint.llm.common import stored, without

BITS = 8                      # bits that one round refines
BIN_BYTES = 64 << 20          # a task numbers the rows of about this many bytes


def _ordered(signed: Column) -> Column:
    """A signed 64-bit value as 16 hexadecimal digits in its order."""
    return F.lpad(F.hex(signed.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")


def _key(text: Column, doc_id: Column) -> Column:
    """128-bit sort key as 32 hexadecimal digits."""
    return F.concat(_ordered(F.xxhash64(text)),
                    F.when(doc_id.isNull(), F.lit("0" * 16)).otherwise(_ordered(doc_id.cast("long"))))


def find_splitters(keys: DataFrame, shards: int, tolerance: float) -> tuple[list[str], int]:
    """Upper bounds (exclusive, key prefixes) of the first ``shards - 1`` shards, and all bytes.

    ``keys``: (key string of 32 hex digits, size long). The driver keeps the splitters only.
    """
    digits = BITS // 4
    total = keys.agg(F.sum("size")).first()[0] or 0
    slack = tolerance * total / shards / 2
    # splitter -> (prefix in which its target lies, bytes below that prefix)
    todo = {s: ("", 0) for s in range(1, shards)}
    done: dict[int, str] = {}
    width = 0
    while todo and total and width < 32:
        prefixes = sorted({p for p, _ in todo.values()})
        rows = keys if not width else keys.filter(F.substring("key", 1, width).isin(prefixes))
        width += digits
        sums = rows.groupBy(F.substring("key", 1, width).alias("p")).agg(F.sum("size").alias("b")).collect()
        bins: dict[str, list[tuple[str, int]]] = {}
        for r in sorted((r["p"], r["b"]) for r in sums):
            bins.setdefault(r[0][:width - digits], []).append(r)
        left = {}
        for s, (prefix, below) in todo.items():
            target = total * s / shards
            for p, b in bins[prefix]:
                if below + b > target:
                    break
                below += b
            # the boundaries at both ends of bin p
            if target - below <= slack:
                done[s] = p
            elif below + b - target <= slack:
                done[s] = p + "~"
            elif width == 32:          # one row (or equal rows): the nearer boundary
                done[s] = p if target - below <= below + b - target else p + "~"
            else:
                left[s] = (p, below)
        todo = left
    last = ""
    for s in range(1, shards):         # two splitters inside one heavy row keep their order
        last = done[s] = max(done.get(s, "~"), last)
    return [done[s] for s in range(1, shards)], total


def shard_by_bytes(docs: DataFrame, shards: int = 24, tolerance: float = 0.01, text: str = "text",
                   doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``size`` (UTF-8 bytes of the text plus 8), ``shard`` and ``slot`` (gapless from 0)."""
    d = without(docs, "size", "shard", "slot", "__llm_key", "__llm_bin")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")
    key = _key(F.coalesce(F.col(text), F.lit("")), F.col(doc_id))
    keys = stored(d.select(key.alias("key"), size.alias("size")), "shard-keys")
    splitters, total = find_splitters(keys, shards, tolerance)

    def placed(key: Column) -> Column:
        """Binary search through the splitters as a nested expression."""
        def half(lo: int, hi: int) -> Column:
            if lo == hi:
                return F.lit(lo)
            mid = (lo + hi) // 2
            return F.when(key < F.lit(splitters[mid]), half(lo, mid)).otherwise(half(mid + 1, hi))
        return half(0, len(splitters))

    # a shard is numbered in bins, so that no task sorts a whole shard
    parts = max(1, -(-total // (shards * BIN_BYTES)))

    def bin_of(key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")

    first = (keys.groupBy(placed(F.col("key")).alias("shard"), bin_of(F.col("key")).alias("__llm_bin"))
             .agg(F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy("shard").orderBy("__llm_bin").rowsBetween(Window.unboundedPreceding, -1)
    first = first.select("shard", "__llm_bin", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("__llm_first"))
    out = (d.withColumn("size", size).withColumn("__llm_key", key)
           .withColumn("shard", placed(F.col("__llm_key"))).withColumn("__llm_bin", bin_of(F.col("__llm_key"))))
    rank = F.row_number().over(Window.partitionBy("shard", "__llm_bin").orderBy("__llm_key"))
    # shards x parts rows: bounded by the output, one row per bin
    return (out.withColumn("slot", rank.cast("long")).join(first, ["shard", "__llm_bin"])
            .withColumn("slot", F.col("slot") - 1 + F.col("__llm_first"))
            .select(*[F.col(f"`{c}`") for c in d.columns], "size", "shard", "slot"))
