"""N-gram Jaccard join with adaptive multi-match prefixes.

Every text is the set of its distinct shingles of ``k`` words. Sets are ordered by a corpus-wide frequency sketch of
fixed size, rare shingles first. If x and y are linked and l <= both least overlaps, they share at least l shingles
among the first |x| - need(x) + l of x and |y| - need(y) + l of y, need(x) = ceil(similarity |x|). Each document
chooses its own l: longer prefixes cost index entries but ask for more matches, and l minimises the
estimated sum, though it is never under ``least(n)``, which grows with the size n of the set. A pair is a
candidate when its prefixes share at least min(l_x, l_y) shingles.

1. Equal sets are one class, found by combining aggregates. From here on only one row of a class moves.
2. Prefix shingles found in one class only can link nothing and are dropped. The smallest class that holds a
   shingle leads it; a class joins the groups of its leaders with its remaining prefix, and matches are counted
   there by a matrix product. Every partner of x asks for at least m = least(need(x)) matches, and the rarest of the
   shared shingles has m - 1 more frequent ones beside it, so x joins for all but its m - 1 most frequent shingles:
   documents that meet others in a few phrases by chance join no group at all.
3. Candidates leave a group as clusters, one row per class, never as pairs. Their whole sets are then compared
   exactly, and the links leave as the edges of a spanning forest.
4. Components of the links come from a distributed large-star small-star job.

Groups above a bound are dealt to pairs of blocks, so a frequent shingle or a copy group of any size is many
bounded tasks, and no group's pairs are written or shuffled.

Defined cases: a null or empty text, or one without words, has the empty set, links with nothing and is its own
component; a text of fewer than ``k`` words is one shingle, its whole sequence; a repeated row is linked with its
twin; a null id ranks behind all others and its row is in the component its text belongs to, whose id is
the smallest that is not null; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, as_rows, beside, by_group, components, in_blocks, long_array, stage
from .features import distinct_counts
from .words import Words, scramble, shingles, steps

#: counters of the frequency sketch
SKETCH_BITS = 18
#: longest extension of a prefix, and the longest that sets of one size all have
MOST, COMMON = 32, 16
#: documents that any shingle is expected to meet by chance, which the sketch is too coarse to show
CHANCE = 0.1
#: members of a block where prefixes are compared, and where whole sets are
PREFIX_BLOCK, SET_BLOCK = 512, 512
#: slots of the filter that says which rows may matter
SLOTS = 1 << 20


def slot(id):
    return F.pmod(F.xxhash64(F.coalesce(id.cast("long"), F.lit(-1))), F.lit(SLOTS)).cast("int")


def sets_of(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingles, ends) of the texts: text i has shingles[ends[i]:ends[i + 1]], in ascending order."""
    words = Words(texts)
    values, owner = shingles(words, k)
    values, owner, _ = distinct_counts(words, values, owner)
    return values, np.searchsorted(owner, np.arange(len(texts) + 1))


def signatures(values: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that name a set."""
    out = []
    for salt in (0x632BE59BD9B4E019, 0xE220A8397B1DCDAF):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(scramble(values ^ np.uint64(salt)), dtype=np.uint64)])
        out.append((total[ends[1:]] - total[ends[:-1]]).view(np.int64))
    return out[0], out[1]


def sketch(rows: DataFrame, k: int) -> np.ndarray:
    """Shingle counts of the whole corpus by 2**SKETCH_BITS hash buckets, an array of fixed size."""
    size, chunk = 1 << SKETCH_BITS, 1 << 13

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for _, texts in steps(batches, 1):
            values, _ = shingles(Words(texts), k)
            total += np.bincount((values >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=size)
        part = TaskContext.get().partitionId()
        parts = range(size // chunk)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(parts), pa.int32()),
                pa.array([part % 64] * len(parts), pa.int32()),
                pa.array([total[i * chunk : (i + 1) * chunk].tobytes() for i in parts], pa.binary()),
            ],
            ["chunk", "salt", "counts"],
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds up what a task was dealt, one array per chunk."""
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(counts, np.int64)
                total[at] = total[at] + own if at in total else own.copy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([c.tobytes() for c in total.values()], pa.binary())], ["chunk", "counts"]
        )

    found = rows.mapInArrow(count, "chunk int, salt int, counts binary")
    once = found.repartition("chunk", "salt").select("chunk", "counts").mapInArrow(add, "chunk int, counts binary")
    twice = once.repartition("chunk").mapInArrow(add, "chunk int, counts binary")
    out = np.zeros(size, np.int64)
    for row in twice.collect():
        out[row.chunk * chunk : (row.chunk + 1) * chunk] += np.frombuffer(row.counts, np.int64)
    return out


def least(n: int, percent: int) -> int:
    """Matches that every set of ``n`` shingles asks for at least; does not fall as ``n`` grows.

    The l of the cheapest prefix where each shingle meets CHANCE others: sqrt(CHANCE n base / (1 + CHANCE)).
    """
    need = -(-percent * n // 100)
    return max(1, min(COMMON, need, int(np.sqrt(CHANCE * n * (n - need) / (1 + CHANCE)))))


def prefix(values: np.ndarray, counts: np.ndarray, typical: float, need: int, low: int) -> tuple[int, np.ndarray]:
    """(l, prefix) of one set by estimated cost: index entries, postings met, and a whole comparison per candidate."""
    order = np.lexsort((values, counts))
    base = len(values) - need
    most = min(MOST, need)
    others = np.maximum(CHANCE, counts[order[: base + most]] - typical)
    met = np.cumsum(others)
    tries = np.arange(1, most + 1)
    at = base + tries - 1
    cost = at + met[at] + len(values) * met[at] / tries
    best = max(low, int(tries[cost.argmin()]))
    return best, values[order[: base + best]]


def prefixes(rows: DataFrame, k: int, percent: int, counts: np.ndarray) -> DataFrame:
    """(row, id, n, s, t, matches, spare, prefix) per document, written as a table; s and t name the set."""
    sent = rows.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        mean = table.mean()
        typical = mean + 3 * np.sqrt(mean) + 1
        row = TaskContext.get().partitionId() << 36
        for batch, texts in steps(batches, 1):
            values, ends = sets_of(texts, k)
            found = table[(values >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
            s, t = signatures(values, ends)
            n = np.diff(ends)
            need = -(-percent * n // 100)
            chosen = [
                prefix(values[a:b], found[a:b], typical, int(m), least(int(b - a), percent)) if b > a else (0, values[:0])
                for a, b, m in zip(ends, ends[1:], need)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + len(texts)), pa.int64()),
                    batch.column(0),
                    pa.array(n, pa.int64()),
                    pa.array(s, pa.int64()),
                    pa.array(t, pa.int64()),
                    pa.array([c[0] for c in chosen], pa.int32()),
                    pa.array([least(int(m), percent) - 1 for m in need], pa.int32()),
                    long_array([c[1] for c in chosen]),
                ],
                ["row", "id", "n", "s", "t", "matches", "spare", "prefix"],
            )
            row += len(texts)

    return stage(rows.mapInArrow(run, "row long, id long, n long, s long, t long, matches int, spare int, prefix array<long>"))


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Common members of every left with every right set."""
    flat = np.concatenate(sets)
    values, code, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)
    place = np.full(len(values), -1)
    place[shared] = np.arange(len(shared))
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    column = place[code]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    # members in strips, so that the incidence matrix stays small
    strip = max(64, (1 << 21) // max(1, len(sets)))
    for start in range(0, len(shared), strip):
        a, b = np.searchsorted(column, [start, start + strip])
        m = np.zeros((len(sets), min(strip, len(shared) - start)), np.float32)
        m[owner[a:b], column[a:b] - start] = 1
        out += m[left] @ m[right].T
    return out.astype(np.int64)


def sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the rows of the group's two blocks."""
    block = group.column("block").to_numpy()
    return np.flatnonzero(block == group.column("block_a")[0].as_py()), np.flatnonzero(block == group.column("block_b")[0].as_py())


def forest_edges(keys: np.ndarray, left: np.ndarray, right: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """(smallest key of the tree, key) for every key that ``linked`` joins to another."""
    order = np.argsort(keys, kind="stable")
    rank = np.empty(len(keys), int)
    rank[order] = np.arange(len(keys))
    forest = Forest(len(keys))
    for a, b in zip(*np.nonzero(linked), strict=True):
        forest.join(int(rank[left[a]]), int(rank[right[b]]))
    out = []
    for i in range(len(keys)):
        root = forest.find(i)
        if root != i:
            out.append((int(keys[order[root]]), int(keys[order[i]])))
    return out


def lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    out = []
    for chunk in column.chunks:
        ends = chunk.offsets.to_numpy()
        out += np.split(chunk.values.to_numpy()[ends[0] : ends[-1]], (ends - ends[0])[1:-1])
    return out


def clusters(classes: DataFrame, percent: int) -> DataFrame:
    """(cluster, class): classes that a chain of candidate pairs of one group connects, smallest class first."""
    index = classes.select("class", F.explode("prefix").alias("shingle"))
    led = index.groupBy("shingle").agg(F.min("class").alias("leader"), F.count("*").alias("held")).where("held > 1")
    shared = index.join(led.hint("merge"), "shingle")
    own = shared.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("held", "shingle", "leader"))).alias("all"))
    own = own.join(classes.select("class", "n", "matches", "spare"), "class").where(F.size("all") > F.col("spare"))
    rarest = F.slice("all", F.lit(1), F.size("all") - F.col("spare"))
    members = stage(
        own.select("class", "n", "matches", F.col("all.shingle").alias("shared"), F.explode(F.array_distinct(rarest["leader"])).alias("leader"))
    )
    dealt = in_blocks(members, ["leader"], "class", PREFIX_BLOCK)

    def candidates(group: pa.Table) -> list[tuple]:
        left, right = sides(group)
        if not len(left) or not len(right) or group.num_rows < 2:
            return []
        keys, n, matches = (group.column(c).to_numpy() for c in ("class", "n", "matches"))
        common = overlaps(lists(group.column("shared")), left, right)
        enough = common >= np.minimum(matches[left][:, None], matches[right][None, :])
        small, large = np.minimum(n[left][:, None], n[right][None, :]), np.maximum(n[left][:, None], n[right][None, :])
        edges = forest_edges(keys, left, right, enough & (100 * small >= percent * large) & (keys[left][:, None] != keys[right][None, :]))
        return [(root, root) for root in {a for a, _ in edges}] + edges

    return by_group(dealt, ["leader", "block_a", "block_b"], candidates, "cluster long, class long").distinct()


def links(rows: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Edges (a, b) of spanning forests of the links between classes."""
    found = stage(clusters(classes, percent))
    needed = stage(found.select("class").distinct().join(classes.select("class", "id", "n", "s", "t"), "class"))
    wanted = np.zeros(SLOTS, bool)
    # at most SLOTS numbers, whatever the corpus
    wanted[[r.slot for r in needed.select(slot(F.col("id")).alias("slot")).distinct().toLocalIterator()]] = True
    sent = rows.sparkSession.sparkContext.broadcast(wanted)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = (b.filter(pa.array(sent.value[b.column(2).to_numpy()])) for b in batches)
        for _, texts in steps(kept, 1):
            values, ends = sets_of(texts, k)
            s, t = signatures(values, ends)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.diff(ends), pa.int64()),
                    pa.array(s, pa.int64()),
                    pa.array(t, pa.int64()),
                    pa.array([values[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary()),
                ],
                ["n", "s", "t", "members"],
            )

    read = rows.withColumn("slot", slot(F.col("id"))).mapInArrow(collect, "n long, s long, t long, members binary")
    named = needed.select("class", "n", "s", "t")
    # a class is its n, s and t: one row of each stays where the join has put it
    sets = read.join(named.hint("merge"), ["n", "s", "t"]).dropDuplicates(["n", "s", "t"])
    sets = stage(sets.select("class", "n", "members"))
    dealt = in_blocks(found, ["cluster"], "class", SET_BLOCK).join(sets.hint("merge"), "class")

    def compare(group: pa.Table) -> list[tuple]:
        left, right = sides(group)
        if not len(left) or not len(right) or group.num_rows < 2:
            return []
        keys, n = group.column("class").to_numpy(), group.column("n").to_numpy()
        common = overlaps([np.frombuffer(m, np.uint64) for m in group.column("members").to_pylist()], left, right)
        union = n[left][:, None] + n[right][None, :] - common
        return forest_edges(keys, left, right, (100 * common >= percent * union) & (keys[left][:, None] != keys[right][None, :]))

    return by_group(dealt, ["cluster", "block_a", "block_b"], compare, "a long, b long").distinct()


def near_components(docs: DataFrame, k: int, percent: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """row, id, n, s, t, component, component_id of every document, written as a table."""
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    own = prefixes(rows, k, percent, sketch(rows, k))
    # equal sets have equal prefixes, so any row's will do
    classes = stage(
        own.where("n > 0")
        .groupBy("n", "s", "t")
        .agg(
            F.min(F.struct("row", "id")).alias("first"), F.min("id").alias("least"), F.first("matches").alias("matches"), F.first("spare").alias("spare"), F.first("prefix").alias("prefix")
        )
        .select(F.col("first.row").alias("class"), F.col("first.id").alias("id"), "least", "n", "s", "t", "matches", "spare", "prefix")
    )
    roots = components(links(rows, classes, k, percent)).withColumnRenamed("node", "class")
    rooted = classes.select("class", "n", "s", "t", "least").join(roots, "class", "left")
    rooted = stage(rooted.withColumn("component", F.coalesce("root", "class")).drop("root"))
    ids = stage(rooted.groupBy("component").agg(F.min("least").alias("component_id")))
    named = stage(rooted.join(ids, "component").select("n", "s", "t", "component", "component_id"))
    found = own.where("n > 0").select("row", "id", "n", "s", "t").join(named.hint("merge"), ["n", "s", "t"])
    empty = own.where("n = 0").select("row", "id", "n", "s", "t", F.col("row").alias("component"), F.col("id").alias("component_id"))
    return found.unionByName(empty)


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_shingles, component_id of every document; linked when 100 |x and y| >= percent |x or y|."""
    found = near_components(docs, k, percent, id, text)
    return found.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), "component_id")


def drop_near(docs: DataFrame, k: int = 5, percent: int = 80, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component, that with the smallest id; all columns kept.

    Only rows that may belong to a component of several rows are shuffled; the rest pass straight through.
    """
    found = stage(near_components(docs, k, percent, id, text))
    heads = found.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("head"), F.count("*").alias("size"))
    several = stage(heads.where("size > 1").select("component", F.col("head.row").alias("kept_row")))
    touched = stage(found.join(several.hint("merge"), "component").select("id", "n", "s", "t", (F.col("row") == F.col("kept_row")).alias("kept")))
    wanted = np.zeros(SLOTS, bool)
    wanted[[r.slot for r in touched.select(slot(F.col("id")).alias("slot")).distinct().toLocalIterator()]] = True
    sent = docs.sparkSession.sparkContext.broadcast(wanted)
    names = docs.columns
    inner = [F.col(f"`{c}`") for c in names]

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield as_rows(batch.filter(pa.array(~sent.value[batch.column(len(names)).to_numpy()])), names)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = (b.filter(pa.array(sent.value[b.column(1).to_numpy()])) for b in batches)
        for batch, texts in steps(kept, 2):
            values, ends = sets_of(texts, k)
            s, t = signatures(values, ends)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(ends), pa.int64()), pa.array(s, pa.int64()), pa.array(t, pa.int64()), batch.column(3)],
                ["d", "n", "s", "t", "id"],
            )

    free = beside(docs, slot(F.col(f"`{id}`"))).mapInArrow(untouched, docs.schema)
    whole = docs.select(
        F.struct(*inner).alias("d"), slot(F.col(f"`{id}`")).alias("slot"), F.col(f"`{text}`").cast("string").alias("x"), F.col(f"`{id}`").cast("long").alias("id")
    )
    kind = whole.schema["d"].dataType.simpleString()
    checked = whole.mapInArrow(named, f"d {kind}, n long, s long, t long, id long")
    # rows of the slots that touch no component have no partner here and stay
    verdict = touched.groupBy("id", "n", "s", "t").agg(F.max("kept").alias("kept"))
    on = [checked[c].eqNullSafe(verdict[c]) for c in ("id", "n", "s", "t")]
    joined = checked.join(verdict.hint("merge"), on, "left").select(checked["*"], verdict["kept"])
    same = joined.where("kept IS NULL")
    one = joined.where("kept").dropDuplicates(["id", "n", "s", "t"])
    return free.unionByName(same.unionByName(one).select("d.*"))
