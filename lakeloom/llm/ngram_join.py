"""N-gram Jaccard self-join by vertical partitioning.

All n-grams have one global order: rare ones by hash, then the frequent ones by
frequency and hash. Two sets that reach the threshold share a few n-grams of
their prefixes in this order, which gives candidate pairs. The n-grams are cut
into fragments by ranges of their hash; for the candidates every fragment counts
its own part of the overlap, and the parts are summed per pair.

Only one set of each content takes part. N-grams that many prefixes share are
not expanded into pairs: their sets are compared with a few leaders first, and
again in further rounds, until all of them are in one component or compared.
Rare n-grams that two sets do not share rule most of these comparisons out.
That is enough for components. The join itself, ``similar_pairs``, compares all
sets of such an n-gram in tiles and returns every link with its overlap.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.components import components
from lakeloom.llm.tables import HashTable, small, with_row_key
from lakeloom.llm.text import BLANK_SPLIT, Texts, chunks, rows_of, shingle_hashes
from lakeloom.session import materialize

U8 = np.uint64
#: log2 of the number of fragments.
FRAGMENT_BITS = 3
FRAGMENTS = 1 << FRAGMENT_BITS
#: Frequent n-grams, broadcast to be ordered last: at most this many, from as many of each task.
FREQUENT, TASK_FREQUENT = 262_144, 16_384
#: Sets of one n-gram that are paired at once; larger blocks go by rounds of leaders.
BLOCK = 64
#: Leaders of a block in the first round, and how many times more in each next one.
LEADERS, LEADERS_GROW = 4, 64
#: Leaders of an n-gram that lie in one row, about.
LEADER_ROW = 64
#: Rounds in which a set's overlap with one other is counted, before all pairs left are.
SPARSE = 1
#: Sets of one n-gram on each side of a tile, when all of them are compared.
TILE = 256
#: Prefix postings in a task that finds pairs, and pairs in a task that counts overlaps.
TASK_POSTINGS, TASK_PAIRS = 400_000, 20_000
#: Set sizes from which two and three n-grams of a prefix have to be common.
TWO_FROM, THREE_FROM = 48, 96


def _common(size: np.ndarray) -> np.ndarray:
    """N-grams that a set of this size shares with a similar one within both prefixes, at least."""
    return 1 + (size >= TWO_FROM) + (size >= THREE_FROM)


class Sets:
    """Distinct shingles of each text of a chunk, sorted, and an id of their content (0: none)."""

    def __init__(self, chunk: Texts, k: int):
        low = chunk.lowered()
        starts, ends, counts = low.words(BLANK_SPLIT)
        shingles, made = shingle_hashes(low.span_hashes(starts, ends), counts, k)
        last = np.cumsum(made)
        self.sets = [np.unique(shingles[b - n : b]) for b, n in zip(last.tolist(), made.tolist(), strict=True)]
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        ids = [int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) for s in self.sets]
        self.ids = np.where(self.sizes > 0, np.array(ids, np.int64), 0)

    def new(self, seen: set[int]) -> np.ndarray:
        """Rows of the non-empty sets that are not in ``seen``, which remembers a bounded number."""
        out = []
        for i, x in enumerate(self.ids.tolist()):
            if x and x not in seen:
                if len(seen) >= 1_000_000:
                    seen.clear()
                seen.add(x)
                out.append(i)
        return np.array(out, np.int64)

    def flat(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams, row of each) of some rows, end to end."""
        if not len(rows):
            return np.empty(0, U8), np.empty(0, np.int64)
        return np.concatenate([self.sets[i] for i in rows]), np.repeat(rows, self.sizes[rows])


def _members(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        grams, counts = np.empty(0, U8), np.empty(0, np.int64)
        ids_type = None
        for batch in batches:
            ids_type = batch.schema.field(0).type
            for chunk in chunks(batch.column(2)):
                made = Sets(chunk, k)
                key, count = np.unique(made.flat(made.new(seen))[0], return_counts=True)
                both, at = np.unique(np.concatenate([grams, key]), return_inverse=True)
                total = np.bincount(at, np.concatenate([counts, count]), len(both)).astype(np.int64)
                if len(both) > 16 * TASK_FREQUENT:
                    top = np.sort(np.argsort(-total, kind="stable")[: 4 * TASK_FREQUENT])
                    both, total = both[top], total[top]
                grams, counts = both, total
                n = len(chunk)
                yield pa.RecordBatch.from_arrays(
                    [*rows_of(batch, chunk, ["doc_id", "_row_"]), pa.array(made.sizes), pa.array(made.ids), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())],
                    ["doc_id", "row", "n", "set_id", "gram", "count"],
                )
        top = np.argsort(-counts, kind="stable")[:TASK_FREQUENT]
        top = top[counts[top] > 1]
        n = len(top)
        if n:
            empty = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, ids_type), pa.nulls(n, pa.binary()), empty, empty, pa.array(grams[top].view(np.int64)), pa.array(counts[top])],
                ["doc_id", "row", "n", "set_id", "gram", "count"],
            )

    return run


_POSTINGS = "bucket int, grams binary, sets binary, sizes binary, rares binary"


def _postings(k: int, num: int, den: int, buckets: int, frequent):
    """Prefixes of all sets, packed by bucket of their n-gram; bucket -1 has the frequent n-grams.

    A posting has the set's size and the number of rare n-grams in its prefix, -1
    if there are no others in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = HashTable(*frequent.value)
        seen: set[int] = set()
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                made = Sets(chunk, k)
                gram, row = made.flat(made.new(seen))
                if not len(gram):
                    continue
                rank = table.get(gram).astype(np.int64)
                order = np.argsort(row * 64 + rank, kind="stable")  # ties stay in the order of hashes
                gram, row, rank = gram[order], row[order], rank[order]
                size = made.sizes[row]
                first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                place = np.arange(len(row)) - np.repeat(first, size[first])
                # of so long a prefix, at least _common(size) n-grams are in a similar set's prefix
                keep = np.flatnonzero(place < size - (size * num + den - 1) // den + _common(size))
                gram, row, rank, size = gram[keep], row[keep], rank[keep], size[keep]
                rare = np.bincount(row, rank == 0, len(chunk)).astype(np.int64)
                rare[rare == np.bincount(row, minlength=len(chunk))] = -1
                bucket = np.where(rank > 0, -1, (gram % U8(buckets)).astype(np.int64))
                order = np.argsort(bucket, kind="stable")
                bucket = bucket[order]
                cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                ends = np.append(cuts[1:], len(bucket))
                columns = [
                    gram[order],
                    made.ids[row[order]],
                    size[order].astype("<i4"),
                    rare[row[order]].astype("<i4"),
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(bucket[cuts], pa.int32()),
                        *(pa.array([c[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()) for c in columns),
                    ],
                    ["bucket", "grams", "sets", "sizes", "rares"],
                )

    return run


def _unpacked(table: pa.Table | pa.RecordBatch) -> list[np.ndarray]:
    kinds = {"grams": "<u8", "sets": "<i8", "sizes": "<i4", "rares": "<i4"}
    return [
        np.frombuffer(b"".join(table.column(c).to_pylist()), kind).astype(kind if c in ("grams", "sets") else np.int64)
        for c, kind in kinds.items()
    ]


_PAIRS = (
    "a bigint, b bigint, na bigint, nb bigint, ra bigint, rb bigint, hits bigint, "
    "gram bigint, set_id bigint, n bigint, rare bigint"
)
_BLOCK_ROW = ("gram", "set_id", "n", "rare")
#: A pair of sets, their sizes and the rare n-grams in their prefixes.
_PAIR = ("a", "b", "na", "nb", "ra", "rb")


def _find_pairs(num: int, den: int):
    """In a bucket of n-grams: pairs with the number of n-grams they share, and the rows of large blocks."""

    def run(table: pa.Table) -> pa.Table:
        gram, set_id, n, rare = _unpacked(table)
        order = np.lexsort((set_id, gram))
        gram, set_id, n, rare = (x[order] for x in (gram, set_id, n, rare))
        # the same set from several tasks
        once = np.append(True, (gram[1:] != gram[:-1]) | (set_id[1:] != set_id[:-1]))
        gram, set_id, n, rare = (x[once] for x in (gram, set_id, n, rare))
        first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
        size = np.diff(np.append(first, len(gram)))
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for m in range(2, BLOCK + 1):
            at = first[size == m]
            if len(at):
                i, j = np.triu_indices(m, 1)
                left.append((at[:, None] + i).ravel())
                right.append((at[:, None] + j).ravel())
        a, b = np.concatenate(left), np.concatenate(right)
        keep = den * np.minimum(n[a], n[b]) >= num * np.maximum(n[a], n[b])
        a, b = a[keep], b[keep]
        order = np.lexsort((set_id[b], set_id[a]))
        a, b = a[order], b[order]
        x, y = set_id[a], set_id[b]
        once = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))[: len(a)])
        hits = np.diff(np.append(once, len(a)))
        a, b = a[once], b[once]
        big = np.flatnonzero(np.repeat(size > BLOCK, size))
        some = lambda v: pa.concat_arrays([pa.array(v, pa.int64()), pa.nulls(len(big), pa.int64())])
        more = lambda v: pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(v, pa.int64())])
        return pa.table(
            {
                "a": some(set_id[a]),
                "b": some(set_id[b]),
                "na": some(n[a]),
                "nb": some(n[b]),
                "ra": some(rare[a]),
                "rb": some(rare[b]),
                "hits": some(hits),
                "gram": more(gram[big].view(np.int64)),
                "set_id": more(set_id[big]),
                "n": more(n[big]),
                "rare": more(rare[big]),
            }
        )

    return run


def _frequent_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gram, *rest = _unpacked(batch)
        yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), *map(pa.array, rest)], list(_BLOCK_ROW))


def _segments(k: int):
    """(set_id, fragment, grams): 52 or more bits of each n-gram, six bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                made = Sets(chunk, k)
                rows = made.new(seen)
                if not len(rows):
                    continue
                gram, row = made.flat(rows)
                segment = row * FRAGMENTS + (gram >> U8(64 - FRAGMENT_BITS)).astype(np.int64)
                cuts = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
                ends = np.append(cuts[1:], len(segment))
                raw = np.ascontiguousarray(gram.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(made.ids[segment[cuts] // FRAGMENTS]),
                        pa.array(segment[cuts] % FRAGMENTS, pa.int32()),
                        pa.array([raw[6 * a : 6 * b] for a, b in zip(cuts.tolist(), ends.tolist(), strict=True)], pa.binary()),
                    ],
                    ["set_id", "fragment", "grams"],
                )

    return run


def _partial_overlaps(pairs: pa.Table, segments: pa.Table) -> pa.Table:
    """Overlap of each pair's segments in one fragment."""
    a, b = pairs.column("a").to_numpy(), pairs.column("b").to_numpy()
    out = np.zeros(len(a), np.int64)
    ids = segments.column("set_id").to_numpy()
    if len(ids) and len(a):
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        raw = segments.column("grams").combine_chunks().take(pa.array(order))
        raw = raw.combine_chunks() if isinstance(raw, pa.ChunkedArray) else raw
        size = np.array([len(x) // 6 for x in raw.to_pylist()], np.int64)
        packed = np.frombuffer(b"".join(raw.to_pylist()), np.uint8).reshape(-1, 6)
        gram = np.zeros((len(packed), 8), np.uint8)
        gram[:, :6] = packed
        kinds, gram = np.unique(gram.view("<u8").ravel(), return_inverse=True)
        first = np.cumsum(size) - size
        keys = np.sort(np.repeat(np.arange(len(ids)), size) * len(kinds) + gram)
        ia, ib = (np.minimum(np.searchsorted(ids, x), len(ids) - 1) for x in (a, b))
        there = np.flatnonzero((ids[ia] == a) & (ids[ib] == b))
        step = max(1, 4_000_000 // max(1, int(size.max())))
        for at in range(0, len(there), step):
            pick = there[at : at + step]
            n = size[ia[pick]]
            inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            wanted = np.repeat(ib[pick], n) * len(kinds) + gram[np.repeat(first[ia[pick]], n) + inner]
            place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            hits = np.concatenate([[0], np.cumsum(keys[place] == wanted)])
            last = np.cumsum(n)
            out[pick] = hits[last] - hits[last - n]
    return pa.table({"a": a, "b": b, "na": pairs.column("na"), "nb": pairs.column("nb"), "overlap": out})


def _near_each_other(pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b, na, nb, ra, rb) with a ``key`` that those of one group of similar sets mostly share.

    It is the least set that ``a`` is paired with, so that segments of a group go
    to one task instead of one for each of its sets. Where more pairs than a task
    takes would share it, the key is ``a``.
    """
    ends = pairs.select(F.col("a").alias("set_id"), F.col("b").alias("other")).unionByName(
        pairs.select(F.col("b").alias("set_id"), F.col("a").alias("other"))
    )
    label = ends.groupBy("set_id").agg(F.least(F.min("other"), F.col("set_id")).alias("label"), F.count_if(F.col("other") > F.col("set_id")).alias("n"))
    sizes = label.groupBy("label").agg(F.sum("n").alias("pairs"))
    key = F.when(F.col("pairs") <= TASK_PAIRS, F.col("label")).otherwise(F.col("set_id"))
    keys = label.join(sizes, "label").select(F.col("set_id").alias("a"), key.alias("key"))
    return pairs.join(keys, "a").select(*_PAIR, "key")


def _verify(pairs: DataFrame, segments: DataFrame, num: int, den: int, label: str) -> DataFrame:
    """The pairs (a, b, na, nb, overlap) that reach the threshold; ``pairs`` is a written table of distinct ones.

    Pairs are dealt to tasks by their ``key``: of a leader's pairs the other end,
    so that its segments go to one task and only the few leaders' to many; of
    others one for most of a group.
    """
    buckets = max(1, -(-pairs.count() // TASK_PAIRS))
    dealt = pairs.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")).drop("key")
    needed = (
        dealt.select("bucket", F.col("a").alias("set_id"))
        .unionByName(dealt.select("bucket", F.col("b").alias("set_id")))
        .distinct()
    )
    parts = segments.join(small(materialize(needed, f"{label}_needed"), 16), "set_id")
    each = dealt.withColumn("fragment", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))))
    overlaps = (
        each.groupBy("bucket", "fragment")
        .cogroup(parts.groupBy("bucket", "fragment"))
        .applyInArrow(_partial_overlaps, "a bigint, b bigint, na bigint, nb bigint, overlap bigint")
    )
    total = overlaps.groupBy("a", "b", "na", "nb").agg(F.sum("overlap").alias("overlap"))
    return materialize(total.where(f"{den} * overlap >= {num} * (na + nb - overlap)"), label)


def _leader_pairs(blocks: DataFrame, few: DataFrame, leaders: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(pairs, leaders) of the next round for blocks that hold several components.

    A block's rows are (gram, frequent, set_id, n, rare, root). Leaders come from
    outside its largest component, sets of small components first, of these the ones
    with the fewest rare n-grams: a set near the middle of its group has few of its own,
    and it is so in all its blocks, so that they choose the same leaders. A leader
    meets the sets of all its blocks that are in other components, and need not
    be looked at again. All its meetings with one set are counted up in one place
    and make one pair or none: what the two share of their prefixes decides.
    ``few`` (a, b, hits) has what they share besides.
    """
    parts = blocks.groupBy("gram", "root").agg(F.count(F.lit(1)).alias("size"))
    largest = parts.groupBy("gram").agg(
        F.max_by("root", F.struct("size", "root")).alias("largest"), F.count(F.lit(1)).alias("n_roots")
    )
    open_ = blocks.join(largest.where("n_roots > 1").select("gram", "largest"), "gram")
    outside = open_.where("root <> largest").join(parts, ["gram", "root"])
    rank = F.row_number().over(Window.partitionBy("gram").orderBy("size", _own("rare"), "root", "set_id"))
    chosen = outside.withColumn("rank", rank).where(F.col("rank") <= leaders).select("set_id").distinct()
    chosen = materialize(chosen, "leaders")
    # an n-gram's leaders lie in rows of about LEADER_ROW, and its sets meet a row at a time
    leader = open_.join(chosen, "set_id", "left_semi")
    rows = leader.groupBy("gram").agg(F.ceil(F.count(F.lit(1)) / LEADER_ROW).alias("rows"))
    leader = (
        leader.join(rows, "gram")
        .groupBy("gram", F.expr("pmod(xxhash64(set_id), rows)").alias("row"))
        .agg(F.collect_list(F.struct(F.col("set_id").alias("id"), "n", "rare", "root")).alias("met"))
    )
    # without a rare n-gram in common, all that is shared is frequent
    alike = (
        f"m.root <> root and {den} * least(n, m.n) >= {num} * greatest(n, m.n) "
        f"and (not frequent or {_possible('n', 'm.n', 'rare', 'm.rare', '0', num, den)})"
    )
    counted = "'rarely', int(not frequent), 'often', int(frequent), 'hits', 0L"
    met = (
        open_.join(leader, "gram")
        .withColumn(
            "met",
            F.expr(
                f"transform(filter(met, m -> {alike}), "
                f"m -> named_struct('id', m.id, 'n', m.n, 'rare', m.rare, {counted}))"
            ),
        )
        .where("size(met) > 0")
        .select("set_id", "n", "rare", "met")
    )
    besides = few.select(F.col("a").alias("set_id"), F.col("b").alias("l"), "hits").unionByName(
        few.select(F.col("b").alias("set_id"), F.col("a").alias("l"), "hits")
    )
    besides = besides.join(chosen.select(F.col("set_id").alias("l")), "l", "left_semi").select(
        "set_id",
        F.lit(0).cast("bigint").alias("n"),
        F.lit(0).cast("bigint").alias("rare"),
        F.expr("array(named_struct('id', l, 'n', 0L, 'rare', 0L, 'rarely', 0, 'often', 0, 'hits', hits))").alias("met"),
    )
    found = (
        met.unionByName(besides)
        .repartition("set_id")
        .sortWithinPartitions("set_id")
        .mapInArrow(_meetings(num, den), "a bigint, b bigint, na bigint, nb bigint, ra bigint, rb bigint, key bigint")
    )
    # two leaders meet from both sides
    return _once(found), chosen


def _meetings(num: int, den: int):
    """From rows of one set after the other, each with leaders it meets: the pairs that may be similar.

    Each pair is counted up and judged once, however many n-grams it shares.
    """
    sums = [("rarely", "sum"), ("often", "sum"), ("hits", "sum"), ("na", "max"), ("nb", "max"), ("ra", "max"), ("rb", "max")]
    names = ["set_id", "id", *(name for name, _ in sums)]

    def added(tables: list[pa.Table]) -> pa.Table:
        done = pa.concat_tables(tables).group_by(["set_id", "id"], use_threads=False).aggregate(sums)
        return done.select(["set_id", "id", *(f"{name}_{how}" for name, how in sums)]).rename_columns(names)

    def flat(batch: pa.RecordBatch) -> pa.Table:
        lists = batch.column("met")
        owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        fields = dict(zip((f.name for f in lists.type.value_type), lists.flatten().flatten(), strict=True))
        set_id, n, rare = (batch.column(c).to_numpy()[owner] for c in ("set_id", "n", "rare"))
        met = fields["rarely"].to_numpy() + fields["often"].to_numpy() > 0
        least = np.iinfo(np.int64).min
        # rows of hits only do not know the sets
        sides = {"na": n, "nb": fields["n"].to_numpy(), "ra": rare, "rb": fields["rare"].to_numpy()}
        return pa.table(
            {
                "set_id": set_id,
                "id": fields["id"],
                **{c: fields[c].cast(pa.int64()) for c in ("rarely", "often", "hits")},
                **{c: np.where(met, x, least) for c, x in sides.items()},
            }
        )

    def judged(t: pa.Table) -> pa.RecordBatch:
        left, right, rarely, often, hits, na, nb, ra, rb = (t.column(c).to_numpy() for c in names)
        need = _common(np.minimum(na, nb))
        shared = rarely + hits
        most = (num + den) * np.minimum(na - ra + shared, nb - rb + shared)
        possible = np.where((ra >= 0) & (rb >= 0), most >= num * (na + nb), shared >= need)
        keep = ((often > 0) & (often >= need)) | ((rarely > 0) & possible)
        left, right, na, nb, ra, rb = (x[keep] for x in (left, right, na, nb, ra, rb))
        swap = left > right
        ends = [np.where(swap, y, x) for a, b in ((left, right), (na, nb), (ra, rb)) for x, y in ((a, b), (b, a))]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (*ends, left)], [*_PAIR, "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            both = added([flat(batch)] if held is None else [held, flat(batch)])
            # the last set may go on in the next batch
            last = pc.equal(both.column("set_id"), batch.column("set_id")[-1])
            held = both.filter(last)
            yield judged(both.filter(pc.invert(last)))
        if held is not None:
            yield judged(held)

    return run


def _need(na: str, nb: str) -> Column:
    size = F.least(na, nb)
    return 1 + (size >= TWO_FROM).cast("bigint") + (size >= THREE_FROM).cast("bigint")


def _possible(na: str, nb: str, ra: str, rb: str, shared: str, num: int, den: int) -> str:
    """Whether two sets can be similar that have so many rare n-grams and share so many of them.

    A prefix that reaches the frequent n-grams has all rare ones of its set.
    """
    return f"{num + den} * least({na} - {ra} + {shared}, {nb} - {rb} + {shared}) >= {num} * ({na} + {nb})"


def _own(rare: str) -> Column:
    """To order sets by the rare n-grams in their prefix; those whose prefix holds no others come last."""
    return F.when(F.col(rare) >= 0, F.col(rare)).otherwise(F.lit(2**31 - 1))


def _once(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(*_PAIR).agg(F.max("key").alias("key"))


def _candidates(docs: DataFrame, id_col: str, text_col: str, words: int, num: int, den: int) -> tuple[DataFrame, ...]:
    """(source, members, counted, blocks): rows, their sets, pairs of small blocks and the rows of large ones."""
    spark = docs.sparkSession
    source = with_row_key(docs, [F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text_")], "keyed")
    source = source.select("doc_id", "_row_", "_text_")
    kind = source.schema[0].dataType.simpleString()
    first = materialize(
        source.mapInArrow(
            _members(words), f"doc_id {kind}, row binary, n bigint, set_id bigint, gram bigint, count bigint"
        ),
        "sets",
    )
    members = first.where("row is not null").select("doc_id", "row", "n", "set_id")
    total = members.agg(F.sum("n")).first()[0] or 0
    top = (
        first.where("gram is not null")
        .groupBy("gram")
        .agg(F.sum("count").alias("count"))
        .where(F.col("count") > BLOCK)
        .orderBy(F.desc("count"), "gram")
        .limit(FREQUENT)
        .toArrow()
    )
    keys = top.column("gram").to_numpy().view(U8)
    ranks = np.minimum(62, np.log2(top.column("count").to_numpy() + 1)).astype(np.int32)
    frequent = spark.sparkContext.broadcast((keys, ranks))
    buckets = max(16, -(-total * (den - num) // den // TASK_POSTINGS))
    postings = materialize(source.mapInArrow(_postings(words, num, den, buckets, frequent), _POSTINGS), "prefixes")
    found = materialize(
        postings.where("bucket >= 0").groupBy("bucket").applyInArrow(_find_pairs(num, den), _PAIRS), "found"
    )
    # partial counts of the buckets, summed per pair
    counted = found.where("a is not null").groupBy("a", "b", "na", "nb", "ra", "rb").agg(F.sum("hits").alias("hits"))
    enough = (F.col("hits") >= _need("na", "nb")) | F.expr(
        "ra >= 0 and rb >= 0 and " + _possible("na", "nb", "ra", "rb", "hits", num, den)
    )
    counted = materialize(counted.withColumn("enough", enough), "counted")
    shared = materialize(
        postings.where("bucket < 0")
        .mapInArrow(_frequent_rows, "gram bigint, set_id bigint, n bigint, rare bigint")
        .withColumn("frequent", F.lit(True))
        .unionByName(found.where("gram is not null").select(*_BLOCK_ROW, F.lit(False).alias("frequent")))
        .distinct(),
        "shared",
    )
    # a set that shares no rare n-gram, and has too many of them, is similar to none
    hopeful = counted.select(F.col("a").alias("set_id")).unionByName(counted.select(F.col("b").alias("set_id")))
    hopeful = hopeful.unionByName(shared.where("not frequent or rare < 0").select("set_id")).distinct()
    alone = f"{num + den} * (n - greatest(rare, 0)) < {num} * (n + ceil({num} * n / {den}))"
    shared = (
        shared.where(f"not ({alone})").unionByName(shared.where(alone).join(hopeful, "set_id", "left_semi"))
    )
    many = shared.groupBy("gram").count().where("count > 1").select("gram")
    blocks = materialize(shared.join(many, "gram", "left_semi"), "blocks")
    return source, members, counted, blocks


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    similarity: tuple[int, int] = (80, 100),
) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id), one row per row of ``docs``.

    Words are runs without white space after lower-casing A-Z; a document's set
    is its distinct shingles of ``words`` words, of fewer words the whole
    sequence. Two documents link when den * intersection >= num * union.
    ``component_id`` is the smallest id reachable by links, a document's own
    included; ``class_id`` is the same for equal sets (null for empty ones).

    A null or empty text has the empty set, links with nothing and is its own
    component. Null ids take part and are never the smallest; a component of
    null ids only has a null ``component_id``. Repeated ids are documents of
    their own that share an id. An empty table gives no rows. Other columns are
    not read. Shingles and sets are compared by 64-bit hashes, overlaps by 51
    bits of them.
    """
    num, den = similarity
    source, members, counted, blocks = _candidates(docs, id_col, text_col, words, num, den)
    pairs = _near_each_other(counted.where("enough").select(*_PAIR))
    few = counted.where("not enough").select("a", "b", "hits")
    roots = _linked(source, members, pairs, few, blocks, words, num, den)
    named = members.join(roots.withColumnRenamed("id", "set_id"), "set_id", "left").withColumn(
        "root", F.when(F.col("n") > 0, F.coalesce("root", "set_id"))
    )
    named = materialize(named, "named")
    least = named.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return named.join(least, "root", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("set_id")).alias("class_id"),
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def _verified(source, members, pairs: DataFrame, words: int, num: int, den: int, number: int | str) -> DataFrame:
    """The pairs that reach the threshold, by the texts of the sets they name."""
    rows = members.where("n > 0").groupBy("set_id").agg(F.min("row").alias("_row_"))
    sets = pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id")))
    wanted = materialize(rows.join(sets.distinct(), "set_id", "left_semi").select("_row_"), f"wanted{number}")
    texts = source.join(small(wanted, 16), "_row_", "left_semi").select("_row_", "_text_")
    segments = materialize(
        texts.mapInArrow(_segments(words), "set_id bigint, fragment int, grams binary"), f"segments{number}"
    )
    return _verify(pairs, segments, num, den, f"links{number}")


def _likeliest_others(pairs: DataFrame, label: str) -> DataFrame:
    """Of each set's pairs the one whose other set has the fewest rare n-grams, then the least, written.

    What a set has in common with a group it shares with many; a rare n-gram is
    mostly its own and counts against every pair. So most of a group of near
    copies meets the set at its middle, which is similar to them even where they
    are not similar to each other.
    """
    likeliest = (
        pairs.select(F.col("a").alias("set_id"), F.col("b").alias("other"), _own("rb").alias("own"))
        .unionByName(pairs.select(F.col("b").alias("set_id"), F.col("a").alias("other"), _own("ra").alias("own")))
        .groupBy("set_id")
        .agg(F.min(F.struct("own", "other"))["other"].alias("other"))
    )
    ends = likeliest.select(F.least("set_id", "other").alias("a"), F.greatest("set_id", "other").alias("b")).distinct()
    return materialize(pairs.join(ends, ["a", "b"], "left_semi"), f"first{label}")


def _between(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs of two components."""
    for end in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("id").alias(end), F.col("root").alias(f"_{end}")), end, "left")
    return pairs.where("coalesce(_a, a) <> coalesce(_b, b)").drop("_a", "_b")


def _linked(source, members, pairs, few, blocks, words, num, den) -> DataFrame:
    """(id, root) of the sets that have links."""

    def settled(pairs: DataFrame, roots: DataFrame | None, number: int) -> tuple[DataFrame, bool]:
        """Roots after the links among ``pairs``, a written table, and whether there were any.

        A pair within a component need not be looked at, and one link a set joins most
        of a group. So each set meets the likeliest other it is paired with first; of
        what is left, the pairs between components go on to the next round.
        """
        grown = False
        for step in range(SPARSE + 1):
            label = f"{number}_{step}"
            now = _likeliest_others(pairs, label) if step < SPARSE else pairs
            links = _verified(source, members, now.drop("ra", "rb"), words, num, den, label).select("a", "b")
            if roots is None or not links.isEmpty():
                grown = True
                if roots is not None:
                    # the stars so far stand for all earlier links
                    links = roots.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(links)
                roots = components(links, f"roots{label}_")
            if step == SPARSE:
                break
            pairs = materialize(_between(pairs.join(now.select("a", "b"), ["a", "b"], "left_anti"), roots), f"left{label}")
            if pairs.isEmpty():
                break
        return roots, grown

    number, count = 0, LEADERS
    blocks = blocks.withColumn("root", F.col("set_id"))
    more, leaders = _leader_pairs(blocks, few, count, num, den)
    pairs = materialize(_once(pairs.unionByName(more)), "pairs0")
    roots, grown = settled(pairs, None, 0)
    while not leaders.isEmpty():
        number, count = number + 1, count * LEADERS_GROW
        left = blocks.join(small(leaders, 8), "set_id", "left_anti")
        if grown:
            left = left.drop("root").join(roots.withColumnRenamed("id", "set_id"), "set_id", "left")
            left = left.withColumn("root", F.coalesce("root", "set_id"))
        blocks = materialize(left, f"blocks{number}")
        pairs, leaders = _leader_pairs(blocks, few, count, num, den)
        if leaders.isEmpty():
            break  # no leader, no pair
        pairs = materialize(pairs, f"pairs{number}")
        grown = False
        if not pairs.isEmpty():
            roots, grown = settled(pairs, roots, number)
    return roots


def _tile_pairs(num: int, den: int):
    """In a tile of sets that share an n-gram: pairs whose first common one it is and that may be similar."""

    def run(table: pa.Table) -> pa.Table:
        gram, i, j = (table.column(c)[0].as_py() for c in ("gram", "i", "j"))
        part = table.column("part").to_numpy()
        set_id, n, rare = (table.column(c).to_numpy() for c in ("set_id", "n", "rare"))
        left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
        columns, cells, row = [], [], np.arange(len(part))
        for name in ("others", "frequents"):
            lists = table.column(name).combine_chunks()
            lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
            columns.append(lists.flatten().to_numpy())
            cells.append(np.repeat(row, lists.value_lengths().to_numpy()))
        grams, owner = np.concatenate(columns), np.concatenate(cells)
        is_frequent = np.repeat([False, True], [len(c) for c in columns])
        # others and frequents have no n-gram in common
        kinds, at, seen = np.unique(grams, return_inverse=True, return_counts=True)
        frequent = np.zeros(len(kinds), bool)
        frequent[at] = is_frequent
        # n-grams of one set only add nothing
        use = np.flatnonzero(seen > 1)
        place = np.full(len(kinds), -1, np.int64)
        place[use] = np.arange(len(use))
        keep = place[at] >= 0
        at, owner = place[at[keep]], owner[keep]
        shape = len(left), len(right)
        earlier, rarely, often = (np.zeros(shape, np.float32) for _ in range(3))
        for low in range(0, len(use), 2048):
            pick = (at >= low) & (at < low + 2048)
            width = min(2048, len(use) - low)
            has = np.zeros((len(part), width), np.float32)
            has[owner[pick], at[pick] - low] = 1
            some = use[low : low + width]
            for total, those in ((earlier, kinds[some] < gram), (rarely, ~frequent[some]), (often, frequent[some])):
                if those.any():
                    total += has[left][:, those] @ has[right][:, those].T
        na, nb, ra, rb = n[left][:, None], n[right][None], rare[left][:, None], rare[right][None]
        least = np.minimum(na, nb)
        fit = (earlier == 0) & (den * least >= num * np.maximum(na, nb)) & (rarely + often >= _common(least))
        bound = np.minimum(na - ra + rarely, nb - rb + rarely)
        fit &= (ra < 0) | (rb < 0) | ((num + den) * bound >= num * (na + nb))
        fit &= set_id[left][:, None] < set_id[right][None] if i == j else True
        x, y = np.nonzero(fit)
        x, y = left[x], right[y]
        swap = set_id[x] > set_id[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        return pa.table({"a": set_id[x], "b": set_id[y], "na": n[x], "nb": n[y]})

    return run


def _all_pairs(counted: DataFrame, blocks: DataFrame, num: int, den: int) -> DataFrame:
    """All pairs (a, b, na, nb) that may be similar, each once.

    A pair comes from the small blocks alone, from them and what it shares in
    large blocks, or from the tiles of the large block of its first n-gram there.
    """
    kind = lambda which: F.array_sort(F.collect_set(F.when(F.expr(which), F.col("gram"))))
    sets = materialize(
        blocks.groupBy("set_id", "n", "rare").agg(kind("frequent").alias("frequents"), kind("not frequent").alias("others")),
        "block_sets",
    )
    side = lambda x: sets.select(F.col("set_id").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in ("frequents", "others")))
    both = lambda c: F.coalesce(F.size(F.array_intersect(f"a_{c}", f"b_{c}")), F.lit(0))
    few = counted.where("not enough").join(side("a"), "a").join(side("b"), "b").withColumn("h", F.col("hits") + both("others"))
    few = few.where(
        (F.col("h") + both("frequents") >= _need("na", "nb"))
        & F.expr(f"ra < 0 or rb < 0 or {_possible('na', 'nb', 'ra', 'rb', 'h', num, den)}")
    )
    parts = blocks.groupBy("gram").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("parts"))
    part = F.pmod(F.xxhash64("set_id"), F.col("parts"))
    dealt = (
        blocks.select("gram", "set_id")
        .join(parts, "gram")
        .withColumn("part", part)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("gram", "set_id", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
        .join(sets, "set_id")
    )
    tiles = dealt.groupBy("gram", "i", "j").applyInArrow(_tile_pairs(num, den), "a bigint, b bigint, na bigint, nb bigint")
    columns = ("a", "b", "na", "nb")
    small_blocks = counted.where("enough").select(*columns)
    return small_blocks.unionByName(few.select(*columns)).unionByName(tiles).distinct()


def similar_pairs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    similarity: tuple[int, int] = (80, 100),
) -> tuple[DataFrame, DataFrame]:
    """(classes, links): (doc_id, n_shingles, class_id), one row per row of ``docs``, and (a, b, na, nb, overlap).

    The similarity join. Rows of equal sets are one class; ``links`` has every
    pair of classes, a < b, with den * overlap >= num * union, their sizes and
    their overlap, each once. Sets, null texts and ids are those of
    :func:`near_duplicates`. A group of m classes that are all alike has
    m (m - 1) / 2 links, so work and result grow with the square of m.
    """
    num, den = similarity
    source, members, counted, blocks = _candidates(docs, id_col, text_col, words, num, den)
    pairs = materialize(_all_pairs(counted, blocks, num, den), "pairs")
    # dealt by both ends, so that a task needs few sets of a large group
    side = math.isqrt(pairs.count() // TASK_PAIRS) + 1
    end = lambda c: F.pmod(F.xxhash64(c), F.lit(side))
    links = _verified(source, members, pairs.withColumn("key", end("a") * side + end("b")), words, num, den, 0)
    classes = members.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("set_id")).alias("class_id")
    )
    return classes, links


def named_pairs(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, overlap) by ids: links between the classes' smallest ids, and from these to each other member.

    With both, any two similar rows are named: those of one class, and those of two linked ones.
    """
    known = classes.where("class_id is not null")
    first = materialize(
        known.groupBy("class_id").agg(F.min("doc_id").alias("least"), F.max("n_shingles").alias("n"), F.count(F.lit(1)).alias("rows")),
        "class_names",
    )
    name = lambda x: first.select(F.col("class_id").alias(x), F.col("least").alias(f"{x}_id"))
    far = links.join(name("a"), "a").join(name("b"), "b")
    turned = F.expr("coalesce(a_id > b_id, false)")
    pick = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x))
    far = far.select(
        pick("a_id", "b_id").alias("a"),
        pick("b_id", "a_id").alias("b"),
        pick("na", "nb").alias("n_a"),
        pick("nb", "na").alias("n_b"),
        "overlap",
    )
    # of rows that share the smallest id, or have none, one stands for the class
    same = known.join(first.where("rows > 1"), "class_id").groupBy("class_id", "least", "n", "doc_id").agg(F.count(F.lit(1)).alias("times"))
    times = F.col("times") - F.col("doc_id").eqNullSafe(F.col("least")).cast("int")
    same = same.withColumn("times", times).where("times > 0").withColumn("_", F.explode(F.sequence(F.lit(1).cast("bigint"), "times")))
    return far.unionByName(
        same.select(F.col("least").alias("a"), F.col("doc_id").alias("b"), F.col("n").alias("n_a"), F.col("n").alias("n_b"), F.col("n").alias("overlap"))
    )
