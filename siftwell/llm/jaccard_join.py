"""N-gram Jaccard join: documents whose sets of word n-grams overlap, found by prefixes and joined in tries.

1. A first pass counts n-grams in a table of fixed size, by hash. The counts order all n-grams, rare ones first. Any
   order would be right; this one makes the n-grams that sets are joined on rare, so common passages join nothing.
2. A second pass writes, per document, the size and digest of its set and the first n-grams in that order. Two sets
   that reach the threshold share one of these. Documents with equal sets form a class.
3. Classes that share such an n-gram and a band of sizes form a group, named after the smallest class in it, its head.
   Groups with the same head are one: near copies share many n-grams and nearly all of these have the same head, so a
   class is in few groups, and any two that can link meet in one. No pair is listed.
4. A group's sets go to one task, those of a large group in blocks of bounded size to one task for each two blocks. There
   they form a trie: sets in their global order lie sorted, with the depth each shares with the one before. Overlaps with
   all other sets at once are carried down the trie and shared by the sets below; a subtree is left as soon as what
   remains of its sets cannot make up for what is missing. Of the links found a task returns a forest.
   This is done twice: first with the beginnings of the sets only, which must share enough of themselves already, then
   with whole sets, but only those that are still together.

N-grams are known by a 64-bit hash of their words, sets by a 128-bit digest.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.batches import slices
from siftwell.llm.bits import bits
from siftwell.llm.components import components
from siftwell.llm.shared import ship
from siftwell.storage import staged

GRAM, PERCENT = 3, 90
COUNTER_BITS = 20
KEPT_WORDS = 300_000
# N-grams in a block of a group; a task holds two blocks.
BLOCK_GRAMS = 1 << 20
BLOCK = 64
# Of a set's n-grams, in hundredths, how many more than those joined on are kept for the first tries.
MORE = 5

_MIX = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_known = _Words()


def grams(text: str | None, size: int) -> np.ndarray:
    """The distinct n-grams of a text as sorted hashes; a text with fewer words has them all as one, an empty one none."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(_known) > KEPT_WORDS:
        _known.clear()
    h = np.array([_known[w] for w in words], np.uint64)
    n = min(size, len(words))
    places = len(words) - n + 1
    out = np.full(places, n, np.uint64)
    for k in range(n):
        out = (out ^ h[k : k + places]) * _MIX[0]
        out ^= out >> np.uint64(29)
        out *= _MIX[1]
    out ^= out >> np.uint64(32)
    return np.unique(out)


def _ordered(found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Rare first, as far as the counters tell, equal ones by hash."""
    return found[np.lexsort((found, counts[found >> np.uint64(64 - COUNTER_BITS)]))]


def _counted(docs: DataFrame, size: int) -> np.ndarray:
    """Counters of n-grams by the first bits of their hash, over all documents; their number is fixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTER_BITS, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [grams(t, size) for t in part.column("text").to_pylist()]
                found = np.concatenate(sets) >> np.uint64(64 - COUNTER_BITS)
                total += np.bincount(found.astype(np.int64), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["counter", "n"])

    rows = docs.select("text").mapInArrow(run, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << COUNTER_BITS, np.int64)
    out[rows.column("counter").to_numpy()] = rows.column("n").to_numpy()
    return out


def linked(sets: list[np.ndarray], whole: np.ndarray, own: np.ndarray, block: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A forest over the sets whose trees are what links of `percent` hundredths or more connect.

    Sets are in the global order. Of sets given by their beginning only, smaller than their `whole` size, those are
    connected that can still link. Two are compared if one is marked as own and if their blocks differ, or there is only
    one block.
    """
    raw = [s.tobytes() for s in sets]
    order = sorted(range(len(sets)), key=raw.__getitem__)
    sizes = np.array([len(sets[i]) for i in order], np.int64)
    own, block, whole = own[order], block[order], whole[order]
    all_pairs = len(set(block.tolist())) == 1
    _, tokens, counts = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True)
    holders = np.repeat(np.arange(len(order)), sizes)[np.argsort(tokens, kind="stable")]
    starts, ends = np.cumsum(counts) - counts, np.cumsum(sizes)

    def holding(some: np.ndarray) -> np.ndarray:
        """How many of these n-grams each set has; those of one set only are left out."""
        some = some[counts[some] > 1]
        n = counts[some]
        at = np.repeat(starts[some] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(holders[at], minlength=len(order))

    tree = list(range(len(order)))

    def root(x: int) -> int:
        while tree[x] != x:
            tree[x] = x = tree[tree[x]]
        return x

    # Overlaps with all sets after each block of the path that leads to the set before.
    path, previous, out = [np.zeros(len(order), np.int64)], tokens[:0], []
    for x, end in enumerate(ends.tolist()):
        n = int(sizes[x])
        mine = tokens[end - n : end]
        top = min(n, len(previous), (len(path) - 1) * BLOCK)
        differ = np.flatnonzero(mine[:top] != previous[:top])
        del path[(int(differ[0]) if len(differ) else top) // BLOCK + 1 :]
        previous = mine
        others = np.flatnonzero((own[x + 1 :] | own[x]) & (all_pairs | (block[x + 1 :] != block[x]))) + x + 1
        # The overlap of whole sets, less what one of them may have after its beginning.
        need = -(-(whole[x] + whole[others]) * percent // (100 + percent))
        need = np.maximum(1, need + np.minimum(n - whole[x], sizes[others] - whole[others]))
        while len(others):
            depth = min((len(path) - 1) * BLOCK, n)
            have = path[-1][others]
            alive = have + np.minimum(n - depth, sizes[others] - have) >= need
            others, need = others[alive], need[alive]
            if depth == n:
                break
            if len(others):
                path.append(path[-1] + holding(mine[depth : depth + BLOCK]))
        for y in others.tolist():
            a, b = root(x), root(y)
            if a != b:
                tree[b] = a
                out.append((order[x], order[y]))
    return out


def _groups(classes: DataFrame, percent: int) -> DataFrame:
    """head, band, key, n and own: each class with a set beside which another may link; `own` if the band is its own."""
    band = F.floor(F.log(F.col("n").cast("double")) / float(-np.log(percent / 100)))
    joined = F.expr(f"slice(prefix, 1, CAST(n - (n * {percent} + 99) div 100 + 1 AS int))")
    tokens = classes.select("key", "n", band.alias("band"), F.explode(joined).alias("gram"))
    shared = tokens.groupBy("gram").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("gram")
    tokens = staged(tokens.join(shared.hint("merge"), "gram"))
    # Sizes of linked sets differ by less than one band, so a set meets those of its own band and of the next.
    placed = tokens.withColumns({"own": F.lit(True)}).union(tokens.withColumns({"band": F.col("band") + 1, "own": F.lit(False)}))
    heads = placed.groupBy("gram", "band").agg(F.min("key").alias("head"), F.count(F.lit(1)).alias("members"), F.max("own").alias("any"))
    heads = heads.where("members > 1 AND any").select("gram", "band", "head")
    return placed.join(heads.hint("merge"), ["gram", "band"]).select("head", "band", "key", "n", "own").distinct()


def _links(docs: DataFrame, rows: DataFrame, counts: np.ndarray, size: int, percent: int) -> DataFrame:
    """a and b, keys of sets: links whose components are those of all links between different sets."""
    known = rows.where("key is not null").groupBy("key", F.col("n_shingles").alias("n"), "prefix")
    classes = staged(known.agg(F.min(F.struct("text_hash", "doc_id")).alias("text")))
    members = staged(_groups(classes, percent))
    load = members.groupBy("head", "band").agg(F.ceil(F.sum("n") / BLOCK_GRAMS).alias("blocks"))
    dealt = members.join(load.hint("merge"), ["head", "band"]).withColumns({"block": F.pmod(F.xxhash64("key"), F.col("blocks"))})
    dealt = dealt.withColumns({"other": F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))})
    dealt = dealt.select("key", "n", "head", "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "own")
    task = ["head", "band", "i", "j"]
    begun = dealt.join(classes.select("key", F.col("prefix").alias("grams")).hint("merge"), "key").repartition(*task).sortWithinPartitions(*task)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ["root", *task, "key", "n", "own", "block"]
        for held in _tasks(batches, task):
            root = _roots(_forest(held, percent))
            rows = [(root[i], *held[i][:-1]) for i in sorted(root)]
            if rows:
                kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.bool_(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], columns)

    met = staged(begun.mapInArrow(meet, "root long, head binary, band long, i long, j long, key binary, n long, own boolean, block long"))
    ends = met.select("key").distinct().join(classes.select("key", "text.*").hint("merge"), "key")
    marked = bits(ends.select("text_hash", F.coalesce("doc_id", F.lit(0)).alias("doc_id")), "text_hash", "doc_id")
    shared = docs.sparkSession.sparkContext.broadcast((counts, marked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, marked = shared.value
        for batch in batches:
            ids = pa.compute.fill_null(batch.column("doc_id"), 0).to_numpy()
            wanted = marked.hit(batch.column("text_hash").to_numpy(), ids)
            for part in slices(batch.filter(pa.array(wanted)), "text"):
                sets = [_ordered(grams(t, size), counts) for t in part.column("text").to_pylist()]
                keys = [hashlib.blake2b(np.sort(s).tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["key", "grams"]
                )

    sets = docs.mapInArrow(run, "key binary, grams array<long>").dropDuplicates(["key"])
    part = ["root", *task]
    whole = met.join(sets.hint("merge"), "key").repartition(*part).sortWithinPartitions(*part)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _tasks(batches, part):
            key = len(part)
            found = [(held[x][key], held[y][key]) for x, y in _forest(held, percent)]
            a, b = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return staged(whole.mapInArrow(join, "a binary, b binary"))


def _roots(forest: list[tuple[int, int]]) -> dict[int, int]:
    """Of each number that a forest connects with another, one that stands for its tree."""
    near: dict[int, list[int]] = {}
    for x, y in forest:
        near.setdefault(x, []).append(y)
        near.setdefault(y, []).append(x)
    out: dict[int, int] = {}
    for start in near:
        waiting = [start] if start not in out else []
        while waiting:
            x = waiting.pop()
            if x not in out:
                out[x] = start
                waiting += near[x]
    return out


def _tasks(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[list[tuple]]:
    """Runs of rows that agree in the columns `by`, each row as those columns, key, n, own, block and grams."""
    group, held = None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in (*by, "key", "n", "own", "block")]
        lists = batch.column("grams")
        values, offsets = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
        for k, row in enumerate(zip(*columns)):
            if row[: len(by)] != group:
                if len(held) > 1:
                    yield held
                group, held = row[: len(by)], []
            held.append((*row, values[offsets[k] : offsets[k + 1]].copy()))
    if len(held) > 1:
        yield held


def _forest(held: list[tuple], percent: int) -> list[tuple[int, int]]:
    n, own, block, sets = zip(*(row[-4:] for row in held))
    return linked(list(sets), np.array(n), np.array(own), np.array(block), percent)


def _labelled(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows of `docs` as doc_id, text_hash, n_shingles and key of their set; and key and label of the sets that link."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    counts = _counted(docs, size)
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for text in part.column("text").to_pylist():
                    found = grams(text, size)
                    n = len(found)
                    first = _ordered(found, shared.value)[: n - -(-n * percent // 100) + 1 + n * MORE // 100].view(np.int64)
                    rows.append((n, hashlib.blake2b(found.tobytes(), digest_size=16).digest() if n else None, first))
                n, keys, first = zip(*rows)
                offsets = pa.array(np.cumsum([0, *map(len, first)]), pa.int32())
                prefixes = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(first), pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_hash"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), prefixes],
                    ["doc_id", "text_hash", "n_shingles", "key", "prefix"],
                )

    rows = staged(docs.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, key binary, prefix array<long>"))
    labels = staged(components(_links(docs, rows, counts, size, percent)))
    return rows.drop("prefix"), labels.select(F.col("node").alias("key"), "label")


def jaccard_join(docs: DataFrame, size: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of `docs` (doc_id, text and whatever else).

    Two documents link when their sets of `size`-word n-grams (ASCII letters without case) have a Jaccard similarity of
    `percent` hundredths or more; component_id is the smallest doc_id reachable by links, the document itself included.
    Null and empty texts have no n-grams and link with nothing. Rows with equal doc_id count as one document. Rows
    with a null doc_id link like others; their component_id is null if it has no row with a doc_id. An empty table gives
    an empty one; other columns play no part.
    """
    rows, labels = _labelled(docs, size, percent)
    sets = rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"))
    sets = staged(sets.join(labels.hint("merge"), "key", "left").select("key", "least", F.coalesce("label", "key").alias("label")))
    # Rows that share a doc_id hold their components together.
    several = rows.where("key is not null").groupBy("doc_id").agg(F.min("key").alias("a"), F.max("key").alias("b"))
    several = several.where("doc_id is not null AND a <> b").select("doc_id", "a")
    held = rows.select("doc_id", "key").join(several.hint("merge"), "doc_id").select("a", F.col("key").alias("b")).distinct()
    ends = sets.select("key", "label")
    held = held.join(ends.select(F.col("key").alias("a"), F.col("label").alias("la")).hint("merge"), "a")
    held = held.join(ends.select(F.col("key").alias("b"), F.col("label").alias("lb")).hint("merge"), "b")
    merged = components(held.select(F.col("la").alias("a"), F.col("lb").alias("b")))
    sets = sets.join(merged.select(F.col("node").alias("label"), F.col("label").alias("wider")).hint("merge"), "label", "left")
    sets = staged(sets.select("key", "least", F.coalesce("wider", "label").alias("label")))
    smallest = sets.groupBy("label").agg(F.min("least").alias("component"))
    known = sets.select("key", "label").join(smallest.hint("merge"), "label").select("key", "component")
    out = rows.join(known.hint("merge"), "key", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def representatives(docs: DataFrame, size: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs` that stand for their component, with all columns: one row each.

    `size` and `percent` are those of `jaccard_join`, but every row counts as a document of its own, whatever its
    doc_id. Of a component the row with the smallest doc_id stays; null comes after all others, and among equal ones the
    smallest hash of the text decides. Rows without n-grams stay.
    """
    rows, labels = _labelled(docs, size, percent)
    rows = rows.where("key is not null").join(labels.hint("merge"), "key", "left").select("doc_id", "text_hash", F.coalesce("label", "key").alias("label"))
    first = rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first"))
    ranked = rows.join(first.hint("merge"), "label").select("doc_id", "text_hash", F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash").eqNullSafe(F.col("first")).alias("stays"))
    # Rows that agree in doc_id and hash of the text have one set, and one answer.
    decided = ranked.groupBy("doc_id", "text_hash").agg(F.max("stays").alias("stays"))
    key = [F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id")]
    # The columns travel as one, so none of their names can clash.
    named = docs.select(F.struct(*docs.columns).alias("row"), *key, F.xxhash64("text").alias("hash"))
    decided = decided.select(*key, F.col("text_hash").alias("hash"), "stays")
    kept = named.join(decided.hint("merge"), ["none", "id", "hash"], "left").where("stays is null OR stays")
    # The join has brought equal rows together, so this sorts but moves nothing.
    copy = F.row_number().over(Window.partitionBy("none", "id", "hash").orderBy("hash"))
    return kept.withColumns({"copy": copy}).where("copy = 1 OR stays is null").select("row.*")
