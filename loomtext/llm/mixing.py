"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions.

Target weights are whole numbers w; together they make W, the slots of a cycle.
The rows of a source, in a fixed pseudo-random order, form blocks. Block j (from 1)
of a source may run from its release (j - 1) * W div w and must run before its
deadline, j * W / w rounded up, in one count of slots over the whole run. At each slot
the released block with the earliest deadline runs (ties: the larger weight,
then the first source by name). One processor that is exactly full meets all
deadlines, so at every slot each source has had its share w / W of the slots
up to less than one block, for as long as no source has run out. After W slots all
shares are whole, so the same cycle repeats exactly; only one is scheduled. A
source that has run out leaves its slots empty and no row is dropped or repeated.

Sources of equal weight have equal windows and take turns, so the schedule keeps
one count for each distinct weight (there are at most sqrt(2 * W) of them). Ranks
inside a source are made in ranges of a hash of the id and the row's other columns,
so that a hot source, or a hot or null id, is many small sorts and one short
running sum.

Defined results: a null source counts as the source with the empty name; an
empty table gives an empty table; rows that repeat get places of their own;
columns of docs named mix stay (the new one then gets underscores).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ._frames import free_name, small
from ._store import written

#: Documents of one source that stand together.
BLOCK = 16
#: Slots of a cycle, about, where the target is the square root of the size;
#: PER_SOURCE for each source, if that is more.
SLOTS, PER_SOURCE = 4096, 16
#: Weights that aren't whole numbers are taken to six decimals of their sum.
DECIMALS = 1_000_000
#: Sources that are broadcast with their slots; more of them are joined by a shuffle.
BROADCAST_SOURCES = 100_000
#: Slots that are scheduled before they are appended to the schedule.
_STEP = 512


def whole_weights(weights: dict[str, float]) -> dict[str, int]:
    """The weights as the smallest whole numbers of the same proportions."""
    if all(float(w).is_integer() for w in weights.values()):
        parts = {k: int(w) for k, w in weights.items()}
    else:
        total = math.fsum(weights.values())
        parts = {k: round(DECIMALS * w / total) for k, w in weights.items()}
    parts = {k: max(1, w) for k, w in parts.items()}
    return {k: w // math.gcd(*parts.values()) for k, w in parts.items()}


def target_weights(counts: DataFrame, weights: dict[str, float] | None = None, slots: int = SLOTS) -> DataFrame:
    """source, n and weight (whole number). Without ``weights`` the target is the
    square root of the size; a source that isn't named has the least weight."""
    if weights:
        parts = whole_weights(weights)
        named = F.create_map(*(F.lit(x) for pair in sorted(parts.items()) for x in pair))
        return counts.withColumn("weight", F.coalesce(named[F.col("source")], F.lit(min(parts.values()))).cast("long"))
    root = F.round(F.sqrt(F.col("n").cast("double")) * 1000).cast("long")
    every, sources = counts.agg(F.coalesce(F.sum(root), F.lit(0)), F.count("*")).first()
    slots = max(slots, PER_SOURCE * sources)
    return counts.withColumn("weight", F.greatest(F.lit(1), F.call_function("div", 2 * slots * root + every, F.lit(2 * max(every, 1)))).cast("long"))


def schedule(sources: DataFrame) -> DataFrame:
    """source, n, weight, cycle_slots and places (the slots of the source's blocks
    1, 2, ... in a cycle), by earliest deadline first."""
    classes = sources.groupBy("weight").agg(F.count("*").alias("q"))
    row = classes.agg(F.sort_array(F.collect_list(F.struct("weight", "q")), asc=False).alias("s")).where("size(s) > 0")
    row = row.selectExpr("transform(s, x -> x.weight) AS a", "transform(s, x -> x.q) AS q", "aggregate(s, 0L, (x, y) -> x + y.weight * y.q) AS c")
    # done counts a class's blocks; its members take turns, so block g is turn g div q
    pick = """array_min(transform(a, (x, i) -> if(state.done[i] < x * q[i] and ((state.done[i] div q[i]) * c) div x <= t,
                ((state.done[i] div q[i] + 1) * c + x - 1) div x * 1048576 + i, null))) % 1048576"""
    step = f"""aggregate(sequence(k * {_STEP}, least(c, (k + 1) * {_STEP}) - 1), named_struct('done', whole.done, 'order', cast(array() as array<int>)),
        (state, t) -> transform(array(cast({pick} as int)), p -> named_struct('done', transform(state.done, (d, i) -> if(i = p, d + 1, d)), 'order', concat(state.order, array(p))))[0])"""
    row = row.withColumn(
        "order",
        F.expr(f"""aggregate(sequence(0L, (c - 1) div {_STEP}), named_struct('done', transform(a, x -> 0L), 'order', cast(array() as array<array<int>>)),
        (whole, k) -> transform(array({step}), done -> named_struct('done', done.done, 'order', concat(whole.order, array(done.order))))[0], whole -> flatten(whole.order))"""),
    )
    slots = row.select("a", "q", "c", F.posexplode("order").alias("slot", "i")).selectExpr("element_at(a, i + 1) AS weight", "element_at(q, i + 1) AS q", "c", "slot")
    turn = F.row_number().over(W.partitionBy("weight").orderBy("slot")) - 1
    slots = slots.withColumn("member", F.pmod(turn, F.col("q")).cast("int")).groupBy("weight", "member").agg(F.max("c").alias("cycle_slots"), F.sort_array(F.collect_list("slot")).alias("places"))
    members = sources.withColumn("member", F.row_number().over(W.partitionBy("weight").orderBy("source")) - 1)
    return members.join(slots, ["weight", "member"]).select("source", "n", "weight", "cycle_slots", "places")


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, slots: int = SLOTS) -> DataFrame:
    """All columns of docs and, in the struct ``mix``: rank (in the source, from
    0), block, cycle, slot, release, deadline and order (unique; sorts the mix).
    A column of docs named mix stays; the struct's name then gets underscores."""
    name = free_name(docs, "mix")
    key = {k: free_name(docs, f"_mix_{k}") for k in ("source", "hash", "range", "place", "before")}
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    counts = written(docs.groupBy(source.alias("source")).agg(F.count("*").alias("n")))
    plan = schedule(target_weights(counts, weights, slots))

    text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    others = [F.col(c) for c in docs.columns if c.lower() not in ("doc_id", "source")]
    rows = docs.withColumn(key["source"], source).withColumn(key["hash"], F.md5(F.concat(text, F.lit(":"), F.xxhash64(*others).cast("string")) if others else text))
    rows = rows.withColumn(key["range"], F.substring(key["hash"], 1, 3))
    ranges = rows.groupBy(key["source"], key["range"]).agg(F.count("*").alias("_n"))
    running = W.partitionBy(key["source"]).orderBy(key["range"]).rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select(key["source"], key["range"], F.coalesce(F.sum("_n").over(running), F.lit(0)).alias(key["before"]))
    inside = W.partitionBy(key["source"], key["range"]).orderBy(key["hash"], "doc_id")
    rows = rows.withColumn(key["place"], F.row_number().over(inside) - 1).join(ranges, [key["source"], key["range"]])
    facts = {c: free_name(docs, c) for c in ("weight", "cycle_slots", "places")}
    plan = plan.select(F.col("source").alias(key["source"]), *(F.col(c).alias(n) for c, n in facts.items()))
    rows = rows.join(small(plan, counts.count(), BROADCAST_SOURCES), key["source"])
    weight, cycle_slots, places = (F.col(n) for n in facts.values())
    whole = lambda a, b: F.call_function("div", a, b)
    rank = (F.col(key["place"]) + F.col(key["before"])).cast("long")
    number = (rank - rank % block) / block
    number = number.cast("long")
    turn = (number % weight).cast("int")
    cycle = ((number - turn) / weight).cast("long")
    slot = F.get(places, turn).cast("long")
    start = cycle * cycle_slots
    mix = F.struct(
        rank.alias("rank"), number.alias("block"), cycle.alias("cycle"), slot.alias("slot"),
        (start + whole(turn * cycle_slots, weight)).cast("long").alias("release"), (start + whole((turn + 1) * cycle_slots + weight - 1, weight)).cast("long").alias("deadline"),
        ((start + slot) * block + rank % block).cast("long").alias("order"),
    )
    return rows.select(*(F.col(c) for c in docs.columns), mix.alias(name))


def in_mix_order(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The rows of docs with docs' columns, range-partitioned and sorted so that
    files written from them hold the mix in the order of their numbers and rows."""
    name = free_name(docs, "mix")
    mixed = mix_sources(docs, weights)
    return mixed.repartitionByRange(F.col(f"{name}.order")).sortWithinPartitions(F.col(f"{name}.order")).select(*docs.columns)


ORACLE_SQL = f"""
WITH RECURSIVE counts AS (
  SELECT coalesce(source, '') AS source, count(*) AS n FROM documents GROUP BY 1
), roots AS (
  SELECT source, n, CAST(round(sqrt(CAST(n AS DOUBLE)) * 1000) AS BIGINT) AS r FROM counts
), weighted AS (
  SELECT source, n, greatest(1, CAST((2 * greatest({SLOTS}, {PER_SOURCE} * count(*) OVER ()) * r + sum(r) OVER ()) // (2 * sum(r) OVER ()) AS BIGINT)) AS a FROM roots
), classes AS (
  SELECT a, count(*) AS q FROM weighted GROUP BY a
), arr AS (
  SELECT list(a ORDER BY a DESC) AS a, list(q ORDER BY a DESC) AS q, CAST(sum(a * q) AS BIGINT) AS c FROM classes
), sched AS (
  SELECT CAST(0 AS BIGINT) AS t, list_transform(a, lambda x: CAST(0 AS BIGINT)) AS done, CAST(0 AS BIGINT) AS pick, a, q, c FROM arr
  UNION ALL
  SELECT t + 1, list_transform(done, lambda d, j: CASE WHEN j = p THEN d + 1 ELSE d END), p, a, q, c
  FROM (
    SELECT t, done, a, q, c, list_aggregate(list_filter(list_transform(a, lambda x, j:
      CASE WHEN done[j] < x * q[j] AND ((done[j] // q[j]) * c) // x <= t THEN (((done[j] // q[j] + 1) * c + x - 1) // x) * 1048576 + j ELSE NULL END), lambda x: x IS NOT NULL), 'min') % 1048576 AS p
    FROM sched WHERE t < c
  )
), turns AS (
  SELECT a[pick] AS a, q[pick] AS q, t - 1 AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS g FROM sched WHERE t > 0
), members AS (
  SELECT source, a, row_number() OVER (PARTITION BY a ORDER BY source) - 1 AS member FROM weighted
), places AS (
  SELECT m.source, t.slot, t.g // t.q AS turn FROM turns t JOIN members m ON m.a = t.a AND m.member = t.g % t.q
), ranked AS (
  SELECT doc_id, coalesce(source, '') AS source,
    row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS rank FROM documents
), blocks AS (
  SELECT r.doc_id, r.source, r.rank, r.rank // {BLOCK} AS block, w.a, (SELECT c FROM arr) AS c FROM ranked r JOIN weighted w USING (source)
)
SELECT b.doc_id, b.source, b.rank, b.block, b.block // b.a AS cycle, p.slot,
  (b.block // b.a) * b.c + (b.block % b.a) * b.c // b.a AS release,
  (b.block // b.a) * b.c + ((b.block % b.a + 1) * b.c + b.a - 1) // b.a AS deadline,
  ((b.block // b.a) * b.c + p.slot) * {BLOCK} + b.rank % {BLOCK} AS mix_order
FROM blocks b JOIN places p ON p.source = b.source AND p.turn = b.block % b.a
"""
