"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions.

Documents of a source, in a shuffled order set by a seed, form blocks. With w the
weight of a source and W that of all sources, block i (from 0) is released at slot
floor(i * W / w) and due by ceil((i + 1) * W / w); every slot goes to the released block
with the earliest deadline (ties: smallest release, then name of the source). Weights
are taken as they are, so every deadline is met, and at any slot each source that still
has blocks has had its part of the slots to less than one block. No document is left out
or repeated: when a source runs out, its slots go to blocks already released, or stay
empty.

The schedule is made without going through the slots one by one
(`earliest_deadline_first`). Blocks are numbered by their deadlines. Which slots the
earlier half of the blocks takes does not depend on the later half, and not on the order
within it: a slot is used if a block of that half waits there, which a running count of
releases and a running maximum tell. So blocks and slots are halved, and both halves
halved again, until `LEAF` blocks and as many slots are left; these are dealt out one by
one. Each halving is one window over narrow rows; the number of halvings is the logarithm
of the number of blocks.

Sizes. Sources and blocks are tables, never one row, one task or a broadcast of their
own. Windows run over at most `BUCKET` slots, beside the blocks that wait for them, with
offsets from a row for each bucket. Blocks released at the same slot are in one task, as
narrow rows: at the start one of each source. Documents are numbered without bringing a
source together: counts by (source, leading digits of the shuffle key) give offsets,
numbers are then made within these small groups. Whole rows are shuffled once to be
numbered and once to be written in order.

Edge cases: a null source is a source of its own, before all others. Rows that share
a doc_id follow each other by text key (so all rows of one id are in one task); those
without an id are shuffled by their text key. Sources without a given weight get one;
weights of absent sources are left out; weights below one, or of more than `MOST` in
all, are an error. An empty table gives no rows. Null or odd texts do not matter.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from absentia.llm.texts import text_key, whole_row
from absentia.sources.storage import settle

BLOCK_DOCS = 64
BUCKET = 1 << 16
LEAF = 128
MOST = 3_000_000_000  # the square of it is a long
_GROUP_ROWS = 1_000
_BEFORE = (Window.unboundedPreceding, -1)


def targets(docs: DataFrame, weights: Mapping[str, int] | None = None) -> DataFrame:
    """src, n, w: the number of documents and the weight of each source.

    weights: whole numbers by source; by default the square root of a source's
    number of documents, rounded down, which lifts small sources.
    """
    counts = docs.groupBy(_source(docs).alias("src")).agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.floor(F.sqrt("n"))
    else:
        if any(w < 1 for w in weights.values()):
            raise ValueError("weights are whole numbers from 1")
        given = [(f"={name}", int(w)) for name, w in weights.items()]
        given = docs.sparkSession.createDataFrame(given, "src string, given long")
        counts = counts.join(given, "src", "left")
        weight = F.coalesce("given", F.lit(1))
    return settle(counts.select("src", "n", weight.cast("long").alias("w")), "sources")


def _source(docs: DataFrame) -> Column:
    """Names apart from null, which sorts first."""
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))


def windows(blocks: DataFrame, total: int) -> DataFrame:
    """`blocks` (w, the weight of their source, and b, their number in it) with released
    and due; total: the weight of all sources."""
    return blocks.withColumns({
        "released": F.expr(f"(b div w) * {total} + ((b % w) * {total}) div w"),
        "due": F.expr(f"((b + 1) div w) * {total} + (((b + 1) % w) * {total} + w - 1) div w"),
    })


def _offsets(stats: DataFrame, by: list[str]) -> DataFrame:
    """Of each bucket what the buckets before it add: counts, and the maximum that such
    counts have been taken from. stats: by, g (the bucket), size, most."""
    before = Window.partitionBy(*by).orderBy("g").rowsBetween(*_BEFORE)
    found = stats.withColumn("size_before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    most = F.max(F.col("most") - F.col("size_before")).over(before)
    return found.select(*by, "g", "size_before", most.alias("most_before"))


def _numbered(jobs: DataFrame) -> DataFrame:
    """`jobs` with p, their rank by deadline (from 0)."""
    placed = jobs.withColumn("g", F.expr(f"due div {BUCKET}"))
    stats = placed.groupBy("g").agg(F.count("*").alias("size"), F.lit(0).alias("most"))
    within = Window.partitionBy("g").orderBy("due", "released", "src", "b")
    ranked = placed.withColumn("p", F.row_number().over(within).cast("long") - 1)
    met = ranked.join(_offsets(stats, []), "g")
    return met.withColumn("p", F.col("p") + F.col("size_before")).drop("g", "size_before", "most_before")


def _busy(jobs: DataFrame) -> DataFrame:
    """`jobs` with at: which of the slots in use is the first from their release on; and
    with an n-th slot in use each: at_slot (n) and slot.

    In the order of release job n is done at n + max(release - rank) up to it, if slots
    are given by release; by deadline the same slots are in use.
    """
    placed = jobs.withColumn("g", F.expr(f"released div {BUCKET}"))
    in_order = Window.partitionBy("g").orderBy("released")
    local = placed.withColumns({
        "k": F.rank().over(in_order).cast("long") - 1,
        "n": F.row_number().over(Window.partitionBy("g").orderBy("released", "p")).cast("long") - 1,
    }).withColumn("v", F.col("released") - F.col("k"))
    local = local.withColumn("seen", F.max("v").over(in_order.rangeBetween(*_BEFORE)))
    stats = local.groupBy("g").agg(F.count("*").alias("size"), F.max("v").alias("most"))
    met = local.join(_offsets(stats, []), "g")
    # greatest and least pass over nulls: nothing was released before.
    seen = F.greatest("most_before", F.col("seen") - F.col("size_before"))
    here = F.greatest(seen, F.col("v") - F.col("size_before"))
    number = F.col("n") + F.col("size_before")
    return met.select(
        *jobs.columns, F.least(F.col("k") + F.col("size_before"), F.col("released") - seen).alias("at"),
        number.alias("at_slot"), (number + here).alias("slot"),
    )


def _halved(items: DataFrame, bits: int) -> DataFrame:
    """Items of nodes of at most 2 ** bits jobs, in nodes of half of that."""
    low = ~F.col("is_slot") & (F.shiftright("p", bits - 1).bitwiseAND(F.lit(1)) == 0)
    # Jobs stand before the slot from which on they wait.
    order = Window.partitionBy("node", "g").orderBy("at", "is_slot")
    local = items.withColumns({"low": low, "g": F.expr(f"at div {BUCKET}")})
    come = F.sum(F.col("low").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    # How many slots would be empty up to this one, if none had been before.
    local = local.withColumn("v", F.when(F.col("is_slot"), F.col("at") + 1 - come))
    local = local.withColumn("seen", F.max("v").over(order.rowsBetween(*_BEFORE)))
    if 1 << bits > BUCKET:
        local = settle(local, "halves")
        stats = local.groupBy("node", "g").agg(
            F.sum(F.col("low").cast("long")).alias("size"), F.max("v").alias("most"))
        met = local.join(_offsets(stats, ["node"]), ["node", "g"])
        empty = F.greatest(F.lit(0), F.col("most_before"), F.col("seen") - F.col("size_before"))
        local = met.withColumns({"v": F.col("v") - F.col("size_before"), "seen": empty})
        local = local.drop("size_before", "most_before")
    else:
        local = local.withColumn("seen", F.greatest(F.lit(0), "seen"))
    late = F.when(F.col("is_slot"), F.col("v") > F.col("seen")).otherwise(~F.col("low"))
    return local.withColumn("late", late).withColumns({
        "node": F.col("node") * 2 + F.col("late").cast("long"),
        "at": F.when(F.col("late"), F.col("seen")).otherwise(F.col("at") - F.col("seen")),
    }).drop("low", "g", "v", "seen", "late")


def earliest_deadline_first(jobs: DataFrame) -> DataFrame:
    """`jobs` (src, b, released, due; no two alike) with slot: each slot goes to the
    released job with the earliest deadline (ties: release, src, b)."""
    jobs = settle(_busy(_numbered(jobs.select("src", "b", "released", "due"))), "jobs")
    none = [F.lit(None).cast(t).alias(c) for c, t in jobs.dtypes if c not in ("at", "at_slot", "slot")]
    own = [F.col(c) for c in ("src", "b", "released", "due", "p")]
    as_job = F.struct(F.lit(False).alias("is_slot"), "at", F.lit(None).cast("long").alias("slot"), *own)
    as_slot = F.struct(F.lit(True).alias("is_slot"), F.col("at_slot").alias("at"), "slot", *none)
    items = jobs.select(F.lit(0).cast("long").alias("node"), F.inline(F.array(as_job, as_slot)))
    bits = max(jobs.count() - 1, 0).bit_length()
    while 1 << bits > LEAF:
        items = _halved(items, bits)
        bits -= 1
    job = F.when(~F.col("is_slot"), F.struct("p", "at", "src", "b", "released", "due"))
    # At most LEAF of each.
    leaves = items.groupBy("node").agg(
        F.sort_array(F.collect_list(job)).alias("jobs"),
        F.sort_array(F.collect_list(F.when(F.col("is_slot"), F.col("slot")))).alias("slots"),
    )
    dealt = F.expr("""
        aggregate(jobs,
            struct(sequence(0L, cast(size(slots) - 1 as long)) as free, cast(array() as array<long>) as taken),
            (acc, x) -> transform(array(array_min(filter(acc.free, f -> f >= x.at))), y -> struct(
                array_remove(acc.free, y) as free, concat(acc.taken, array(y)) as taken))[0],
            acc -> transform(acc.taken, (y, i) -> struct(
                jobs[i].src as src, jobs[i].b as b, jobs[i].released as released, jobs[i].due as due,
                slots[cast(y as int)] as slot)))""")
    return leaves.select(F.inline(dealt))


def _digits(rows: int) -> int:
    digits = 1
    while 16**digits * _GROUP_ROWS < rows:
        digits += 1
    return digits


def schedule(
    docs: DataFrame, weights: Mapping[str, int] | None = None, block_docs: int = BLOCK_DOCS,
    seed: int = 0,
) -> DataFrame:
    """row (all columns of docs), block (from 1, in its source), released, due, slot,
    place (in its block). The mixed order is that of (slot, place)."""
    target = targets(docs, weights)
    total, rows = (x or 0 for x in target.agg(F.sum("w"), F.sum("n")).first())
    if total > MOST:
        raise ValueError(f"weights add up to more than {MOST}")
    doc_id = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("|"), text_key().cast("string")))
    shuffled = F.md5(F.concat(F.lit(f"{seed}|"), doc_id))
    keyed = docs.select(
        whole_row(docs), F.col("doc_id").alias("id"), _source(docs).alias("src"),
        shuffled.alias("mix"), text_key().alias("key"),
        F.substring(shuffled, 1, _digits(rows)).alias("lead"),
    )
    sizes = keyed.groupBy("src", "lead").agg(F.count("*").alias("size"))
    before = Window.partitionBy("src").orderBy("lead").rowsBetween(*_BEFORE)
    groups = settle(sizes.select(
        "src", "lead", "size", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before")
    ), "groups")

    def blocks_of(first: str) -> Column:
        last = f"(before + size - 1) div {block_docs}"
        return F.explode(F.expr(f"if({first} > {last}, array(), sequence({first}, {last}))"))

    # A block belongs to the group in which it begins; other groups may go on with it.
    begun = groups.select("src", blocks_of(f"(before + {block_docs - 1}) div {block_docs}").alias("b"))
    slots = earliest_deadline_first(windows(begun.join(target.select("src", "w"), "src"), total))
    needed = groups.select("src", "lead", "before", blocks_of(f"before div {block_docs}").alias("b"))
    found = needed.join(slots, ["src", "b"]).groupBy("src", "lead", "before").agg(
        F.sort_array(F.collect_list(F.struct("b", "released", "due", "slot"))).alias("slots"))
    within = Window.partitionBy("src", "lead").orderBy("mix", "id", "key")
    numbered = keyed.withColumn("n", F.row_number().over(within)).join(found, ["src", "lead"])
    rank = F.col("before") + F.col("n") - 1
    blocks = numbered.withColumns({
        "b": F.floor(rank / block_docs).cast("long"), "place": (rank % block_docs).cast("long"),
    })
    own = blocks.withColumn("own", F.expr(f"slots[cast(b - before div {block_docs} as int)]"))
    return own.select("row", (F.col("b") + 1).alias("block"), "own.released", "own.due", "own.slot", "place")


def mixed(docs: DataFrame, weights: Mapping[str, int] | None = None, **options) -> DataFrame:
    """The documents, columns as they came, sorted into the mixed order across partitions."""
    placed = schedule(docs, weights, **options)
    ordered = placed.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place")
    return ordered.select("row.*")
