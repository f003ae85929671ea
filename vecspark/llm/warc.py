"""WARC fixity: Merkle trees over records and ordered offset ranges, compared between replicas.

Leaves are record digests; a node covers FANOUT consecutive children in offset order, first inside a
file, then over files. Every level of a tree is a table in the shared folder, so a tree is built once,
in one pass a level. An audit compares the two roots and then, level by level, only the children of
nodes that differ: of an intact replica it reads the two roots, and records only of differing slots.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import materialize

FANOUT = 16
#: Records of a file: page_ids in runs of this length.
PER_FILE = 256
#: Hexadecimal digits of a digest by which the records of one page_id are dealt out before they are ordered.
DEAL = 3


def warc_record(record_id: Column, url: Column, body: Column) -> Column:
    """A WARC/1.1 response record as text; nulls are empty fields."""
    body = F.coalesce(body, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def _div(a: Column, n: int) -> Column:
    """floor(a / n) in whole numbers: doubles lose ids over 2**53."""
    return F.call_function("div", a - F.pmod(a, F.lit(n)), F.lit(n))


def warc_leaves(pages: DataFrame, per_file: int = PER_FILE) -> DataFrame:
    """(page_id, file, slot, offset, length, digest, copies): the records of each file and where they lie.

    A file holds the page_ids of one run of per_file, in their order, different records of one page_id by digest;
    copies of a record lie one after another and are one row with their count and the first one's offset. A null
    page_id's file follows from its url and html, so that these don't meet in one file. Other columns are left out.

    Offsets are sums over at most per_file page_ids, then 16 ** DEAL ranges of digests, then the records of one
    range, so a page_id with very many records is dealt out over many tasks.
    """
    record = warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    page_id = F.col("page_id").cast("long")
    loose = -1 - F.pmod(F.xxhash64("url", "html"), F.lit(1 << 20))
    rows = pages.select(page_id.alias("page_id"), F.coalesce(_div(page_id, per_file), loose).alias("file"), F.octet_length(record).cast("long").alias("length"), F.sha2(record, 256).alias("digest"))
    rows = rows.groupBy("file", "page_id", "length", "digest").agg(F.count("*").alias("copies"))
    rows = materialize(rows.withColumn("part", F.substring("digest", 1, DEAL)).withColumn("size", F.col("length") * F.col("copies")), "records")

    def before(t: DataFrame, by: list[str], order: list, name: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return t.withColumn(name, F.coalesce(F.sum("size").over(w), F.lit(0)))

    page = [F.col("page_id").asc_nulls_last()]
    parts = rows.groupBy("file", "page_id", "part").agg(F.sum("size").alias("size"))
    ids = before(parts.groupBy("file", "page_id").agg(F.sum("size").alias("size")), ["file"], page, "at")
    parts = before(parts, ["file", "page_id"], ["part"], "within")
    first = parts.join(ids.select(F.col("file").alias("f"), F.col("page_id").alias("p"), "at"), (F.col("file") == F.col("f")) & F.col("page_id").eqNullSafe(F.col("p")))
    first = first.select(F.col("file").alias("f"), F.col("page_id").alias("p"), F.col("part").alias("d"), (F.col("at") + F.col("within")).alias("at"))
    rows = before(rows, ["file", "page_id", "part"], ["digest", "length"], "within")
    rows = rows.join(first, (F.col("file") == F.col("f")) & F.col("page_id").eqNullSafe(F.col("p")) & (F.col("part") == F.col("d")))
    slot = F.coalesce(F.pmod("page_id", F.lit(per_file)), F.lit(0)).cast("int")
    return rows.select("page_id", "file", slot.alias("slot"), (F.col("at") + F.col("within")).alias("offset"), "length", "digest", "copies")


def _digest(children: DataFrame, by: Column, name: str, child: Column, order: str) -> DataFrame:
    """(name, digest, records) of groups of children by the digests of these in order."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), child.alias("c"))))
    parts = children.groupBy(by.alias(name)).agg(parts.alias("parts"), F.sum("records").alias("records"))
    return parts.select(name, F.sha2(F.array_join(F.transform("parts", lambda p: p["c"]), ","), 256).alias("digest"), "records")


@dataclass
class MerkleTree:
    """Levels from the slots of files up to one root: tables of (node, digest, records), and the leaves.

    A node number is that of its first child divided by the fanout, and a slot's is file * per_file + slot, so a
    lost or added record moves no other node. Files of null page_ids have negative numbers.
    """

    leaves: DataFrame
    levels: list[DataFrame]
    per_file: int
    fanout: int


def _slots(leaves: DataFrame, per_file: int) -> DataFrame:
    """Slots by their records' digests, lengths and copies; first in ranges of digests, so no slot is one group."""
    ranges = leaves.select((F.col("file") * per_file + F.col("slot")).alias("node"), F.substring("digest", 1, DEAL).alias("part"), F.concat_ws(":", "digest", "length", "copies").alias("c"), "copies")
    parts = ranges.groupBy("node", "part").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("c")), ","), 256).alias("d"), F.sum("copies").alias("records"))
    return _digest(parts, F.col("node"), "node", F.concat_ws(":", "part", "d"), "part")


def merkle_trees(*replicas: DataFrame, per_file: int = PER_FILE, fanout: int = FANOUT) -> list[MerkleTree]:
    """Trees of equal height over the tables of warc_leaves of replicas; every level is written, and read once."""
    leaves = [materialize(r, "leaves") for r in replicas]
    ends = [r.agg(F.min("file").alias("low"), F.max("file").alias("high")).first() for r in leaves]
    reach = max([1, *(max(e.high + 1, -e.low) for e in ends if e.low is not None)]) * per_file
    out = []
    for own in leaves:
        levels, span = [materialize(_slots(own, per_file), "level")], 1
        while span < reach:
            span *= fanout
            child = F.concat_ws(":", F.col("node").cast("string"), "digest")
            levels.append(materialize(_digest(levels[-1], _div(F.col("node"), fanout), "node", child, "node"), "level"))
        out.append(MerkleTree(own, levels, per_file, fanout))
    return out


def differing_slots(ours: MerkleTree, theirs: MerkleTree) -> DataFrame | None:
    """(suspect) slots under nodes that differ, found from the roots down; None where the roots are equal.

    The top level has one node, and one more where there are null page_ids. Below it, only children of suspects
    are compared, and each level's suspects are written before the next one is read.
    """
    suspects: DataFrame | None = None
    for x, y in zip(reversed(ours.levels), reversed(theirs.levels), strict=True):
        if suspects is not None:
            x, y = (t.join(suspects, _div(F.col("node"), ours.fanout) == F.col("suspect"), "left_semi") for t in (x, y))
        both = x.select("node", F.col("digest").alias("da")).join(y.select("node", F.col("digest").alias("db")), "node", "full")
        suspects = materialize(both.where(~F.col("da").eqNullSafe(F.col("db"))).select(F.col("node").alias("suspect")), "suspects")
        if not suspects.limit(1).count():
            return None
    return suspects


def fixity_audit(ours: MerkleTree, theirs: MerkleTree) -> DataFrame:
    """(file, slot, page_id, offset, length, digest, replica_digest, status): where two replicas differ.

    ours and theirs are merkle_trees of the primary and of a replica. status is "corrupt" (other bytes), "missing"
    (only in the primary) or "extra" (only in the replica). offset and length are of the primary, or of the replica
    for an extra record. Equal replicas, and two empty ones, give no row. Copies of a record count as many times
    as they are there: two too few are two rows, the last copies' offsets. Of one page_id, damaged and lost
    records are told apart only by their number: the nth differing record there is compared with the nth here.
    """
    bad = differing_slots(ours, theirs)
    spark = ours.leaves.sparkSession
    if bad is None:
        return spark.createDataFrame([], "file long, slot int, page_id long, offset long, length long, digest string, replica_digest string, status string")
    slot = ["file", "slot", "page_id"]

    def below(tree: MerkleTree, other: MerkleTree, name: str) -> DataFrame:
        """Records of differing slots that the other replica doesn't hold as often, numbered in their page_id."""
        held = lambda t: t.leaves.join(bad, F.col("file") * t.per_file + F.col("slot") == F.col("suspect"), "left_semi")
        there = held(other).select(*(F.col(c).alias(f"o_{c}") for c in (*slot, "digest", "copies")))
        same = F.col("page_id").eqNullSafe(F.col("o_page_id")) & (F.col("file") == F.col("o_file")) & (F.col("slot") == F.col("o_slot")) & (F.col("digest") == F.col("o_digest"))
        mine = held(tree).join(there, same, "left").withColumn("kept", F.coalesce("o_copies", F.lit(0))).where("copies > kept")
        mine = mine.select(*slot, "length", "digest", (F.col("copies") - F.col("kept")).alias("n"), (F.col("offset") + F.col("length") * F.col("kept")).alias("offset"), F.substring("digest", 1, DEAL).alias("part"))
        mine = materialize(mine, name)
        # The number of a record in its page_id: those of the ranges of digests before its own, and those before it there.
        ranges = mine.groupBy(*slot, "part").agg(F.sum("n").alias("m"))
        w = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        ranges = ranges.select(*(F.col(c).alias(f"r_{c}") for c in (*slot, "part")), F.coalesce(F.sum("m").over(w(slot, "part")), F.lit(0)).alias("base"))
        own = (F.col("file") == F.col("r_file")) & (F.col("slot") == F.col("r_slot")) & F.col("page_id").eqNullSafe(F.col("r_page_id")) & (F.col("part") == F.col("r_part"))
        mine = mine.withColumn("nth", F.coalesce(F.sum("n").over(w([*slot, "part"], "digest")), F.lit(0))).join(ranges, own)
        mine = mine.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        return mine.select(*slot, "length", "digest", (F.col("offset") + F.col("length") * F.col("copy")).alias("offset"), (F.col("base") + F.col("nth") + F.col("copy")).alias("nth"))

    mine, other = below(ours, theirs, "ours"), below(theirs, ours, "theirs")
    key = [F.col(f"m.{c}").eqNullSafe(F.col(f"o.{c}")) for c in (*slot, "nth")]
    both = mine.alias("m").join(other.alias("o"), key[0] & key[1] & key[2] & key[3], "full")
    pick = lambda c: F.coalesce(F.col(f"m.{c}"), F.col(f"o.{c}")).alias(c)
    status = F.when(F.col("o.digest").isNull(), "missing").when(F.col("m.digest").isNull(), "extra").otherwise("corrupt")
    return both.select(pick("file"), pick("slot"), pick("page_id"), pick("offset"), pick("length"), F.col("m.digest").alias("digest"), F.col("o.digest").alias("replica_digest"), status.alias("status"))
