"""Exact n-gram Jaccard self-join by a token-group matrix.

A document's set is its distinct word shingles (64-bit hashes). Two documents
link when 100 * intersection >= percent * union. The join finds the connected
components of these links without making all pairs of a group of copies:

1. One scan counts the leading shingles of all documents; frequent ones go to
   the end of the common order (an order changes the cost, never the result).
2. A second scan keeps, per document, the set's size and digest, its prefix in
   that order (two linked sets share a prefix shingle) and a bitmap of the set.
   Documents of equal digest are one class.
3. Similar classes are gathered into groups: each is compared with one centre
   for each of its least hashes, the class of that hash with the fewest rare
   shingles. A class joins the group of its best centre that its bitmap allows to
   be half alike, and so on to where the chain of centres ends; classes that may
   link to a centre are verified.
4. The token-group matrix has a row for each shingle and group in whose
   members' prefixes it occurs, with the members' sizes and best places. If that is
   the first shingle a class shares with a member, what follows it in both
   bounds their overlap, so a group (another one, or its own if the class isn't
   linked to its first centre) is opened only if it can hold a member that reaches
   the threshold.
5. Members of small groups are held against the classes that open them as pairs:
   first by bitmaps, which are exact in one direction (shingles that are surely
   missing can't be too many), then on whole sets. In larger groups the whole sets
   meet in cells of bounded size, and a cell gives only as many links as join
   its components. A link to one member of a component stands for those to its
   other members.

Defined results: null or empty texts and texts without words have n_shingles
0 and are their own component; null ids make a component of their class but
never name one unless all its ids are null; rows that repeat share a component; very long
texts are read whole; an empty table gives an empty one; other columns take no part in it.
Classes are named by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ._frames import free_name, small, with_arrow_columns
from ._store import written
from ._text import LOWER, NOT_SPACE, chunks, mix, shingle_hashes, spans, word_hashes
from .graph import components

#: Shingles of more documents than this go to the end of the order ...
FREQUENT = 32
#: ... if they are among this many most frequent ones (8 MB are broadcast).
MAX_FREQUENT = 1 << 20
#: Least hashes for which a class is compared with a centre.
CENTRES = 4
#: Percent that a class and its group's centre may be alike, at least.
ALIKE = 50
#: Members of a group that meet in a task, and their shingles, about.
CHUNK, CHUNK_TOKENS = 512, 1 << 19
#: Groups of at most so many members meet the classes that open them pair by pair.
PAIRED = 16


def token_sets(raw: np.ndarray, at: np.ndarray, size: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes in rising order; also all of them
    in one array with their n + 1 offsets."""
    raw = LOWER[raw]
    starts, ends, first = spans(raw, at, NOT_SPACE)
    every, own = shingle_hashes(word_hashes(raw, starts, ends), first, size)
    sets = [np.unique(every[a:b]) for a, b in zip(own[:-1], own[1:], strict=True)]
    return sets, np.concatenate([np.zeros(0, np.uint64), *sets]), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def digests(every: np.ndarray, own: np.ndarray) -> np.ndarray:
    """A hash of each whole set; 0 for the empty one."""
    n = np.diff(own)
    some = n > 0
    out = np.zeros(len(n), np.uint64)
    if len(every):
        out[some] = mix(np.add.reduceat(mix(every ^ np.uint64(0xC0FFEE)), own[:-1][some]) + n[some].astype(np.uint64))
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def frequent_shingles(docs: DataFrame, size: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (rising) that stand early in the hash order of more than
    FREQUENT documents, and the logarithm of how many. Counted over all rows."""

    def leading(batches):
        for batch in batches:
            for _, raw, at in chunks(batch, "text"):
                sets, _, _ = token_sets(raw, at, size)
                early = [s[: len(s) * (100 - percent) // 80 + 8] for s in sets]
                tokens, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *early]), return_counts=True)
                yield pa.RecordBatch.from_arrays([_signed(tokens), pa.array(counts.astype(np.int32))], names=["token", "c"])

    counts = docs.select("text").mapInArrow(leading, "token long, c int").groupBy("token").agg(F.sum("c").alias("c"))
    rows = counts.where(F.col("c") > FREQUENT).orderBy(F.desc("c"), "token").limit(MAX_FREQUENT).toArrow()
    tokens = rows.column("token").to_numpy().view(np.uint64)
    level = np.log2(np.maximum(rows.column("c").to_numpy(), 2)).astype(np.uint8)
    order = np.argsort(tokens)
    return tokens[order], level[order]


def signatures(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], size: int, percent: int) -> DataFrame:
    """doc_id, n, class, the number of rare shingles, the least hashes, the prefix
    (in the common order) and the bitmap of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        hot, level = shared.value
        gate = np.zeros(1 << 22, bool)
        gate[(hot & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        for batch in batches:
            for part, raw, at in chunks(batch, "text"):
                sets, every, own = token_sets(raw, at, size)
                rank = np.zeros(len(every), np.uint8)
                maybe = np.flatnonzero(gate[(every & np.uint64((1 << 22) - 1)).astype(np.int64)])
                if len(maybe):
                    place = np.minimum(np.searchsorted(hot, every[maybe]), len(hot) - 1)
                    found = hot[place] == every[maybe]
                    rank[maybe[found]] = level[place[found]]
                prefixes, bits, rare = [], [], np.diff(np.concatenate([[0], np.cumsum(rank == 0)])[own])
                least, least_at = zip(*((s[:CENTRES], min(len(s), CENTRES)) for s in sets), strict=True)
                keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(least_at)]), pa.int32()), _signed(np.concatenate([np.zeros(0, np.uint64), *least])))
                for s, a, b in zip(sets, own[:-1], own[1:], strict=True):
                    most = len(s) - (percent * len(s) + 99) // 100 + 1 if len(s) else 0
                    late = rank[a:b]
                    ordered = s[np.argsort(late, kind="stable")[:most]] if late.any() else s[:most]
                    prefixes.append(ordered)
                    bits.append(bitmap(s))
                lengths = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])])
                lists = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), _signed(np.concatenate([np.zeros(0, np.uint64), *prefixes])))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(np.diff(own)), _signed(digests(every, own)), pa.array(rare), keys, lists, pa.array(bits, pa.binary())], names=["doc_id", "n", "class", "rare", "keys", "prefix", "bits"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, class long, rare long, keys array<long>, prefix array<long>, bits binary")


def bitmap(tokens: np.ndarray) -> bytes:
    """A bit for each token, in a power of two of at least 4 bits a token."""
    width = max(64, 1 << int(4 * len(tokens) - 1).bit_length()) if len(tokens) else 64
    flags = np.zeros(width, bool)
    flags[(tokens & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").tobytes()


_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def surely_missing(a: bytes, b: bytes) -> int:
    """Tokens of a that can't be in b, at least."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    return int(_ONES[x & ~y].sum())


def _fits(a: str, b: str, percent: int):
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def _bounded(pairs: DataFrame, cards: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes (a, b) whose similarity may be percent, by their sizes
    and bitmaps; best: the largest that it may be."""
    ends = written(pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))).distinct())
    wanted = written(cards.select("class", "n", "bits").join(small(ends), "class", "left_semi").dropDuplicates(["class"]), "none")
    both = pairs
    for end in ("a", "b"):
        both = both.join(wanted.select(F.col("class").alias(end), F.col("n").alias(f"n{end}"), F.col("bits").alias(f"bits{end}")), end)
    both = both.where(_fits("na", "nb", percent))

    def run(batches):
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            gone = [(surely_missing(x, y), surely_missing(y, x)) for x, y in zip(batch.column("bitsa").to_pylist(), batch.column("bitsb").to_pylist(), strict=True)]
            lost = np.array(gone, np.int64).reshape(-1, 2)
            common = np.minimum(na - lost[:, 0], nb - lost[:, 1])
            best = common / np.maximum(na + nb - common, 1)
            keep = common * 100 >= (na + nb - common) * percent
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(best)], names=["a", "b", "best"]).filter(pa.array(keep))

    return both.mapInArrow(run, "a long, b long, best double")


def _class_sets(ends: DataFrame, docs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """class and tokens of the wanted classes, from their whole texts."""
    who = written(classes.join(small(ends), "class", "left_semi").select("class", F.col("first_id").alias("wanted")))

    def run(batches):
        for batch in batches:
            for part, raw, at in chunks(batch, "text"):
                _, every, own = token_sets(raw, at, size)
                lists = pa.ListArray.from_arrays(pa.array(own, pa.int32()), _signed(every))
                asked = part.column("class").to_numpy().view(np.uint64)  # rows may repeat an id
                yield pa.RecordBatch.from_arrays([part.column("class"), lists], names=["class", "tokens"]).filter(pa.array(asked == digests(every, own)))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small(who), F.col("doc_id").eqNullSafe(F.col("wanted"))).select("class", "text")
    return written(texts.mapInArrow(run, "class long, tokens array<long>").dropDuplicates(["class"]), "none")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs of classes that link, by their whole sets."""
    ends = written(pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))).distinct())
    sets = _class_sets(ends, docs, classes, size)
    both = pairs.join(sets.select(F.col("class").alias("a"), F.col("tokens").alias("ta")), "a").join(sets.select(F.col("class").alias("b"), F.col("tokens").alias("tb")), "b")
    common = F.size(F.array_intersect("ta", "tb"))
    return both.where(common * 100 >= (F.size("ta") + F.size("tb") - common) * percent).select("a", "b")


def _overlaps(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all intersections, from the shingles that several sets have."""
    sets = left + right
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    tokens, place, times = np.unique(np.concatenate([np.zeros(0, np.int64), *sets]), return_inverse=True, return_counts=True)
    common = times > 1
    keep = common[place]
    column, owner = (np.cumsum(common) - 1)[place[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(common.sum()), width):
        a, b = np.searchsorted(column, (at, at + width))
        block = np.zeros((len(sets), width), np.float32)
        block[owner[a:b], column[a:b] - at] = 1
        out += block[: len(left)] @ block[len(left) :].T
    return out.astype(np.int64)


def spanning_links(block: tuple, queries: tuple, percent: int) -> list[tuple[int, int]]:
    """Links between queries and members of a block that join all components which
    their links join: fewer than there are components. Both sides are (classes,
    components, sets); a link inside a component is left out."""
    who, comp, sets = block
    ids, own, asked = queries
    names, place = np.unique(np.concatenate([comp, own]), return_inverse=True)
    above = list(range(len(names)))

    def root(x: int) -> int:
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    place, mine = place[: len(comp)], place[len(comp) :]
    n, out = np.array([len(x) for x in sets], np.int64), []
    for at in range(0, len(ids), 256):
        part = asked[at : at + 256]
        common = _overlaps(part, sets)
        m = np.array([len(x) for x in part], np.int64)[:, None]
        linked = (common * 100 >= (m + n - common) * percent) & (mine[at : at + 256, None] != place)
        for q in np.flatnonzero(linked.any(axis=1)):
            others, first = np.unique(place[linked[q]], return_index=True)
            members = np.flatnonzero(linked[q])[first]
            for other, member in zip(others.tolist(), members.tolist(), strict=True):
                a, b = root(int(mine[at + q])), root(other)
                if a != b:
                    above[a] = b
                    out.append((int(ids[at + q]), int(who[member])))
    return out


def _links_in_groups(asked: DataFrame, members: DataFrame, docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) of the classes asked (group, class, comp) to the members of a
    group, by whole sets. A group of k chunks is k * parts cells of bounded size;
    a cell gives a spanning forest of the components it joins, never its pairs."""
    inside = written(members.join(small(written(asked.select("group").distinct())), "group", "left_semi"))
    ends = written(asked.select("class").union(inside.select("class")).distinct())
    sets = _class_sets(ends, docs, classes, size).withColumn("n", F.size("tokens"))
    cut = lambda df: df.join(sets.select("class", "n"), "class").groupBy("group").agg(F.ceil(F.greatest(F.count("*") / CHUNK, F.sum("n") / CHUNK_TOKENS)).cast("int").alias("cells"))
    shape = written(cut(inside).withColumnRenamed("cells", "chunks").join(cut(asked).withColumnRenamed("cells", "parts"), "group"))
    dealt = lambda df, mine, k, every, m: df.join(small(shape), "group").select("group", F.pmod(F.xxhash64("class"), F.col(k)).cast("int").alias(mine), F.explode(F.sequence(F.lit(0), F.col(m) - 1)).alias(every), "class", "comp").join(sets.drop("n"), "class")
    left, right = dealt(inside, "chunk", "chunks", "part", "parts"), dealt(asked, "part", "parts", "chunk", "chunks")
    read = lambda t: (t.column("class").to_numpy(), t.column("comp").to_numpy(), [x.values.to_numpy() for x in t.column("tokens")])

    def search(block: pa.Table, queries: pa.Table) -> pa.Table:
        found = spanning_links(read(block), read(queries), percent) if block.num_rows and queries.num_rows else []
        return pa.table({k: pa.array([x[i] for x in found], pa.int64()) for i, k in enumerate("ab")})

    queries = right.select("group", "chunk", "part", "class", "comp", "tokens").toDF("q_group", "q_chunk", "q_part", "class", "comp", "tokens")
    return left.groupBy("group", "chunk", "part").cogroup(queries.groupBy("q_group", "q_chunk", "q_part")).applyInArrow(search, "a long, b long")


def _gathered(best: DataFrame) -> DataFrame:
    """class and group: where the chain of best centres from a class ends. Each
    centre comes before its class in one order, so chains end; each round halves
    what is left of them."""
    now = written(best)
    while True:
        step = now.join(now.select(F.col("class").alias("group"), F.col("group").alias("next")), "group", "left")
        moved = written(step.select("class", F.coalesce("next", "group").alias("group"), F.col("next").isNotNull().alias("moved")))
        now = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return now


def _class_groups(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The signatures of docs' rows, and class, first_id and group of every class
    that has shingles: classes of a group are linked."""
    cards = written(signatures(docs, frequent_shingles(docs, size, percent), size, percent), "none")
    some = cards.where("n > 0")
    classes = written(some.groupBy("class").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n")))

    # similar classes meet at a centre of each of their least hashes
    keys = some.select("class", "rare", F.explode("keys").alias("token")).distinct()
    centres = keys.groupBy("token").agg(F.min(F.struct("rare", "class")).alias("centre"), F.min("class").alias("least"), F.max("class").alias("last")).where("least <> last").select("token", "centre")
    near = keys.join(centres, "token").where("class <> centre.class").select(F.col("class").alias("a"), F.col("centre.class").alias("b"), F.col("centre.rare").alias("rare")).distinct()
    near = written(near)
    alike = written(_bounded(near.select("a", "b"), some, ALIKE))
    linked = written(_verified(written(alike.where(F.col("best") * 100 >= percent - 0.001).select("a", "b")), docs, classes, size, percent))
    comps = written(components(linked).select(F.col("node").alias("class"), "comp"))
    best = alike.join(near, ["a", "b"]).groupBy("a").agg(F.min(F.struct("rare", "b")).alias("centre")).select(F.col("a").alias("class"), F.col("centre.b").alias("group"))
    groups = _gathered(best)
    groups = groups.union(groups.select("group").distinct().select(F.col("group").alias("class"), "group"))
    # a class without a group is one of its own; hub: the group's first component
    known = written(classes.select("class", "n").join(groups, "class", "left").withColumn("group", F.coalesce("group", "class")).join(comps, "class", "left").withColumn("comp", F.coalesce("comp", "class")))
    hubs = known.where("class = group").select("group", F.col("comp").alias("hub"))

    # the token-group matrix, of shingles that several classes have
    rows = some.select("class", "rare", F.posexplode("prefix").alias("place", "token"))
    frequent = rows.where("place >= rare").select("token", "class", "place").distinct()
    # the others have at most FREQUENT documents each, but for those beyond MAX_FREQUENT;
    # both sides read all three columns, so that one shuffle serves them
    others = rows.where("place < rare").select("token", "class", "place").repartition("token")
    shared = others.groupBy("token").agg(F.min("class").alias("least"), F.max("class").alias("last"), F.min("place").alias("first")).where("least <> last and first >= 0").select("token")
    rows = written(frequent.unionByName(others.join(shared.hint("merge"), "token").select("token", "class", "place").distinct())).join(known, "class")
    # reach: how large a partner may be, times percent, if this shingle is the first in common
    rows = written(rows.withColumn("reach", (F.col("n") - F.col("place")) * (100 + percent) - F.col("n") * percent).drop("place"))
    matrix = rows.groupBy("token", "group").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("reach").alias("reach"), F.min("comp").alias("one"), F.max("comp").alias("other"))
    both_reach = (F.col("q.reach") >= F.col("g.least") * percent) & (F.col("g.reach") >= F.col("q.n") * percent)
    elsewhere = (F.col("q.group") < F.col("g.group")) | ((F.col("q.group") == F.col("g.group")) & (F.col("g.one") < F.col("g.other")))
    opened = rows.alias("q").join(matrix.alias("g"), "token").where(elsewhere & both_reach & (F.col("q.n") * 100 >= F.col("g.least") * percent) & (F.col("g.most") * 100 >= F.col("q.n") * percent))
    opened = opened.select(F.col("q.class").alias("class"), F.col("q.comp").alias("comp"), F.col("q.group").alias("own"), F.col("g.group").alias("group")).distinct()
    sizes = known.groupBy("group").agg(F.count("*").alias("size"))
    opened = written(opened.join(hubs, "group").where("own <> group or comp <> hub").join(sizes, "group").select("class", "comp", "group", "size"))
    members = known.select("group", F.col("class").alias("b"), F.col("comp").alias("with"))
    few = opened.where(F.col("size") <= PAIRED).join(members, "group").where("class <> b and comp <> with").select(F.least("class", "b").alias("a"), F.greatest("class", "b").alias("b")).distinct()
    more = _verified(written(_bounded(written(few), some, percent).select("a", "b")), docs, classes, size, percent)
    many = opened.where(F.col("size") > PAIRED).select("group", "class", "comp")
    inside = _links_in_groups(many, known.select("group", "class", "comp"), docs, classes, size, percent)
    final = written(components(linked.union(more).union(inside)).select(F.col("node").alias("class"), F.col("comp").alias("group")))

    return cards, classes.join(final, "class", "left").withColumn("group", F.coalesce("group", "class"))


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by
    links) of every row of docs."""
    cards, named = _class_groups(docs, size, percent)
    some = cards.where("n > 0")
    least = named.groupBy("group").agg(F.min("first_id").alias("component_id"))
    component = named.join(least, "group").select("class", "component_id")
    linked_rows = some.select("doc_id", "n", "class").join(component, "class").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked_rows.unionAll(cards.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def _with_class(docs: DataFrame, name: str, size: int) -> DataFrame:
    """docs with the class of each row's text (0 without a shingle) as ``name``."""

    def make(batch):
        for part, raw, at in chunks(batch, "text"):
            _, every, own = token_sets(raw, at, size)
            yield part, [_signed(digests(every, own))]

    return with_arrow_columns(docs, [T.StructField(name, T.LongType())], make)


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component: that of the smallest doc_id (null ids last).

    Rows are told apart by doc_id and class (the set of shingles), so each text of
    a doc_id that repeats, and each row without an id, is judged by its own
    component. Texts without a shingle are no copies of others; of rows that
    repeat such a text under the same doc_id, one stays.
    """
    cards, named = _class_groups(docs, size, percent)
    keys = cards.groupBy("doc_id", "class").agg(F.count("*").alias("rows"), F.max("n").alias("n"))
    keys = written(keys)
    grouped = written(keys.where("n > 0").join(named.select("class", "group"), "class"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "class")
    best = grouped.groupBy("group").agg(F.min(order).alias("best"))
    ranked = grouped.join(best, "group")
    is_best = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("class") == F.col("best.class"))
    drop = written(ranked.where(~is_best).select("doc_id", "class"))
    again = keys.where("rows > 1 and (n > 0 or doc_id is not null)").select("doc_id", "class")

    name, text = free_name(docs, "_class"), free_name(docs, "_own_text")
    same = lambda k: F.col("doc_id").cast("long").eqNullSafe(k["_doc"]) & (F.col(name) == k["_of"])
    named_keys = lambda k: small(k.select(F.col("doc_id").alias("_doc"), F.col("class").alias("_of")))
    kept, gone = _with_class(docs, name, size), named_keys(drop)
    kept = kept.join(gone, same(gone), "left_anti")
    if again.limit(1).count():
        twice = named_keys(again)
        once = kept.join(twice, same(twice), "left_anti")
        # texts without a shingle share the class 0
        several = kept.join(twice, same(twice), "left_semi").withColumn(text, F.when(F.col(name) == 0, F.sha2(F.col("text").cast("string"), 256)))
        kept = once.unionByName(several.dropDuplicates(["doc_id", name, text]).drop(text))
    return kept.select(*docs.columns)
