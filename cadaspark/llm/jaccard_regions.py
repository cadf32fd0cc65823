"""Exact join of texts by Jaccard similarity of word shingles, as a metric-space join with pivots.

The distance is 1 - |x & y| / |x | y| and two texts link at ``RADIUS`` or less. Equal sets are one point. Random pivots are of no use
here: nearly all distances are 1, so every window would reach every region. Pivots are therefore first chosen in projections:
shingles fall by hash into k parts, and k exceeds the number d of shingles in which two linked sets of that size can differ, so that linked
sets agree on at least k - d parts. All sets with the same part form a neighbourhood, whose least member is the pivot. With the parts of a
set ordered from rare to frequent, linked sets agree on one of the first d + 1 of each; a set therefore lies in the regions of the pivots of these
parts only, which is the replication at the boundaries. Parts that no other set holds come first, so a set of which fewer than k - d parts are
shared, such as one that has a passage in common with others, lies in no region. Two linked sets meet in at least one.

Of equal texts only the one with the least id sends its parts: copies would make every part a shared one. The parts of all others travel once,
packed: a task sends four bytes of a part's hash and the set's id to the bucket of the hash, many at
a time, and a bucket tells who shares what. A part that many sets of one task hold (a large group of near copies) sends one of them,
and its other holders learn the pivot by a salted join. Only then do the sets themselves travel, once to meet the list of their regions and once to
each region, in six bytes a shingle, most of which compress to five.

Regions that are small enough are joined in one task: distances to a pivot give links, and by the triangle inequality a linked set
needs no look of its own when nothing outside the pivot's component lies within its window. Larger regions lose what is linked to the
pivot and lies outside all windows, and the rest is divided again with new parts and pivots; what does not shrink is joined block
against block. So nothing is dropped and no task holds more than a region of bounded size.

Edge cases: null and empty texts have an empty set, link with nothing and are their own component; fewer words than a shingle
give one shingle of the whole sequence; equal texts are in one component; rows that share an id count as linked; a null id
takes no part and gets a null component.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadaspark.llm.arrow import fresh, release, slices
from cadaspark.llm.components import components
from cadaspark.sources.scratch import forget, keep, large

# A region is joined in one task up to this many sets and shingles; larger ones are divided.
LEAF_SETS, LEAF_SHINGLES = 4_000, 2_000_000
# Rounds of dividing before what is left is joined block against block.
ROUNDS = 4
# Classes of sizes, in steps of the largest ratio between linked sets.
CLASS_STEPS = 4
# A task packs about this many parts before it sends them, and a bucket is meant for about so many.
PACKED, BUCKET = 250_000, 1_000_000
LEAST_BUCKETS = 64
# A part held by so many sets of one pack sends one of them; its other holders are told by a join in SALTS shares.
HEAVY, SALTS = 64, 16
# Fixed bits of the filter of ids whose sets are needed (4 MB); when it fills, more sets travel than needed.
FILTER_BITS = 1 << 25
# Further partitions for sets of which too many parts were empty.
MORE = 8
# Words whose hash a task remembers.
REMEMBERED = 100_000
# After a group of so many bytes a task gives back what it has freed; smaller ones leave little behind.
RELEASED = 1_000_000
MIX = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX[3]
    h = (h ^ (h >> np.uint64(29))) * MIX[0]
    return h ^ (h >> np.uint64(32))


class Words(dict):
    """64-bit hash of a word, remembered within one task."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, width: int, known: Words | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text; A-Z are lower-cased, words end at blanks."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64)
    known = Words() if known is None else known
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    with np.errstate(over="ignore"):
        total = np.zeros(len(h) - width + 1, dtype=np.uint64)
        for i in range(width):
            total = _mixed(total + h[i : len(h) - width + 1 + i] + MIX[i % 3])
    return np.unique(total)


class Plan:
    """Threshold ``percent``: sets link when 100 * intersection >= percent * union."""

    def __init__(self, percent: int = 90, width: int = 3) -> None:
        self.percent, self.width = percent, width
        self.radius = 1 - percent / 100

    def links(self, both: np.ndarray, size_x: np.ndarray, size_y: np.ndarray) -> np.ndarray:
        return 100 * both >= self.percent * (size_x + size_y - both)

    def differ(self, n: int) -> int:
        """The most shingles in which a set of n and a linked one can differ."""
        # union u <= n / t and difference d <= (1 - t) u
        return (100 - self.percent) * n // self.percent

    def classes_of(self, n: int) -> list[int]:
        """Size classes in which a set may meet a partner: its own, and the one below for the lowest step of a class."""
        step = math.floor(math.log(n) / math.log(100 / self.percent) + 1e-9)
        own = step // CLASS_STEPS
        return [own - 1, own] if step % CLASS_STEPS == 0 else [own]

    def parts_of(self, size_class: int) -> int:
        """More parts than linked sets of the class can differ in, with room for parts that stay empty."""
        largest = math.ceil((100 / self.percent) ** (CLASS_STEPS * (size_class + 1) + 1))
        most = self.differ(largest)
        return most + most // 16 + 6

    def parts(self, h: np.ndarray, salt: int) -> list[tuple[np.ndarray, int]]:
        """For each class of a set: hashes of its parts that are not empty, and how many of them linked sets need not agree on, less one.

        Below zero, too many parts are empty and agreement on one is not sure.
        """
        n = len(h)
        if self.differ(n) < 1:
            return []  # only an equal set can link
        out = []
        with np.errstate(over="ignore"):
            salted = _mixed(h + np.uint64(salt + 1) * MIX[1])
            for size_class in self.classes_of(n):
                parts = self.parts_of(size_class)
                part = ((salted >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
                order = np.argsort(part, kind="stable")
                part = part[order]
                first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                sums = np.add.reduceat(_mixed(salted[order] ^ MIX[2]), first)
                keys = _mixed(sums + (part[first] + np.uint64((size_class + 1) << 32)) * MIX[0])
                out.append((keys, len(keys) - self.differ(n) - 1))
        return out

    def projections(self, h: np.ndarray, salt: int) -> tuple[bool, np.ndarray]:
        """Hashes of as many parts as linked sets can differ in and one, and whether agreement on one of them is sure."""
        found = self.parts(h, salt)
        keys = [k[: self.differ(len(h)) + 1] for k, _ in found]
        return all(slack >= 0 for _, slack in found), np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64)


def pack_set(h: np.ndarray) -> bytes:
    """A set in 48 bits a shingle, in order: the upper bytes repeat and compress."""
    low = np.sort(h & np.uint64((1 << 48) - 1))
    return (low >> np.uint64(40)).astype(np.uint8).tobytes() + (low >> np.uint64(32)).astype(np.uint8).tobytes() + low.astype(np.uint32).tobytes()


def unpack_set(packed: bytes) -> np.ndarray:
    n = len(packed) // 6
    upper, middle = np.frombuffer(packed, np.uint8, n).astype(np.uint64), np.frombuffer(packed, np.uint8, n, n).astype(np.uint64)
    return upper << np.uint64(40) | middle << np.uint64(32) | np.frombuffer(packed, np.uint32, n, 2 * n)


def _batch(columns: dict[str, pa.Array], rows: int) -> pa.RecordBatch:
    arrays = [columns.get(f.name, None) for f in TOLD]
    arrays = [pa.nulls(rows, f.type) if a is None else a.cast(f.type) for a, f in zip(arrays, TOLD, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, [f.name for f in TOLD])


# Rows of a text (doc_id to slack2), of a pack of parts (bucket, keys, owners, marks) or of heavy parts (heavy_key, heavy_id, heavy_class).
# ``slack`` is how many of the shared parts of a set need no region, by class.
TOLD = pa.schema([
    ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("fingerprint", pa.binary()), ("slack", pa.int64()), ("slack2", pa.int64()),
    ("bucket", pa.int64()), ("keys", pa.binary()), ("owners", pa.binary()), ("marks", pa.binary()),
    ("heavy_key", pa.int64()), ("heavy_id", pa.int64()), ("heavy_class", pa.int64()),
])
TOLD_DDL = ", ".join(f"{f.name} {'binary' if f.type == pa.binary() else 'bigint'}" for f in TOLD)
# Marks of a part in a pack: it stands for several sets; it is of the set's second class.
SEVERAL, SECOND = 1, 2


def _packs(keys: np.ndarray, owners: np.ndarray, second: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Parts and the ids of their sets, by bucket; heavy parts send their least id, and a row for every holder."""
    if not len(keys):
        return
    bucket = (keys >> np.uint64(32)) % np.uint64(buckets)
    place = (bucket << np.uint64(32) | keys & np.uint64(0xFFFFFFFF)).view(np.int64)
    order = np.lexsort((owners, place))
    place, owners, second = place[order], owners[order], second[order]
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    times = np.diff(np.append(first, len(place)))
    heavy = np.repeat(times >= HEAVY, times)
    for start in range(0, int(heavy.sum()), 100_000):
        some = slice(start, start + 100_000)
        k, o, c = place[heavy][some], owners[heavy][some], second[heavy][some]
        yield _batch({"heavy_key": pa.array(k), "heavy_id": pa.array(o), "heavy_class": pa.array(c.astype(np.int64))}, len(k))
    sent = ~heavy
    sent[first] = True
    marks = (heavy[sent] * SEVERAL + second[sent] * SECOND).astype(np.uint8)
    place, owners = place[sent], owners[sent]
    order = np.lexsort((owners, place >> 32))  # the parts of a set next to each other, so that its id compresses
    place, owners, marks = place[order], owners[order], marks[order]
    bounds = np.searchsorted(place >> 32, np.arange(buckets + 1))
    filled = np.flatnonzero(np.diff(bounds))
    for start in range(0, len(filled), 64):
        some = filled[start : start + 64]
        spans = [slice(bounds[b], bounds[b + 1]) for b in some]
        packed = {
            "bucket": pa.array(some),
            "keys": pa.array([place[x].astype(np.uint32).tobytes() for x in spans], pa.binary()),
            "owners": pa.array([owners[x].tobytes() for x in spans], pa.binary()),
            "marks": pa.array([marks[x].tobytes() for x in spans], pa.binary()),
        }
        yield _batch(packed, len(some))


def senders(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, text and ``sends``, whether a text sends its parts, and how many bytes the different texts have.

    The least id of each text sends, and so do a few other rows that pass the filter of these ids.
    """
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    same = F.substring(F.unhex(F.sha2("text", 256)), 1, 16).alias("same")
    known = texts.where("doc_id is not null and text is not null").groupBy(same)
    least = keep(known.agg(F.min("doc_id").alias("doc_id"), F.max(F.octet_length("text")).alias("size")).drop("same"), "different-texts")
    held = id_filter(least)
    chars = least.agg(F.sum("size")).first()[0] or 0
    forget(least)
    return _looked_up(texts, held).select("doc_id", "text", F.col("hit").alias("sends")), chars


def buckets_for(chars: int, plan: Plan) -> int:
    # a word takes five bytes at least; parts are about the share of shingles in which linked sets can differ
    return int(max(LEAST_BUCKETS, plan.differ(chars // 5) // BUCKET))


def measured(texts: DataFrame, plan: Plan, buckets: int, salt: int = 0, sizes: tuple[int, int] | None = None) -> DataFrame:
    """Rows of ``TOLD`` for every text of ``senders``, or for those with so many shingles; within a pack equal sets send the parts of the least id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[int | None, list[tuple[np.ndarray, int]]]] = {}
        waiting, known = 0, Words()

        def packs() -> Iterator[pa.RecordBatch]:
            sent = [(i, k, c) for i, found in held.values() if i is not None for c, (k, _) in enumerate(found)]
            if sent:
                sizes_of = [len(k) for _, k, _ in sent]
                ids, second = (np.repeat(np.array(v, dtype=np.int64), sizes_of) for v in ([i for i, _, _ in sent], [c for _, _, c in sent]))
                yield from _packs(np.concatenate([k for _, k, _ in sent]), ids, second, buckets)

        for batch in slices(batches, 1):
            rows = []
            for i, text, sends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h = shingles(text, plan.width, known)
                if sizes and not sizes[0] <= len(h) <= sizes[1]:
                    continue
                if not len(h):
                    rows.append((i, 0, None, None, None))
                    continue
                mark = xxhash.xxh3_128_digest(h.tobytes())
                if not sends:
                    rows.append((i, len(h), mark, None, None))
                    continue
                if mark in held:
                    least, found = held[mark]
                else:
                    least, found = i, plan.parts(h, salt)
                    waiting += sum(len(k) for k, _ in found)
                slack = [v for _, v in found] + [None, None]
                rows.append((i, len(h), mark, slack[0], slack[1]))
                held[mark] = (i if least is None else least if i is None else min(i, least), found)
            if rows:
                i, n, mark, slack, slack2 = zip(*rows, strict=True)
                columns = {
                    "doc_id": pa.array(i, pa.int64()), "n_shingles": pa.array(n, pa.int64()), "fingerprint": pa.array(mark, pa.binary()),
                    "slack": pa.array(slack, pa.int64()), "slack2": pa.array(slack2, pa.int64()),
                }
                yield _batch(columns, len(rows))
            if waiting > PACKED:
                yield from packs()
                held, waiting = {}, 0
        yield from packs()
        held.clear()
        known.clear()
        release()

    return texts.select("doc_id", "text", "sends").mapInArrow(run, TOLD_DDL)


def _sure() -> Column:
    return F.least(F.coalesce("slack", F.lit(0)), F.coalesce("slack2", F.lit(0))) >= 0


def _place(salt: int = 0) -> Column:
    return F.pmod(F.xxhash64(F.col("doc_id").cast("bigint"), F.lit(salt)), F.lit(FILTER_BITS)).cast("bigint")


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(place, F.lit(64)).cast("int"))


def id_filter(ids: DataFrame, salt: int = 0) -> DataFrame:
    """(filter_word, filter_bits) of some ids: at most FILTER_BITS / 64 rows, whatever their number."""
    words = ids.select(F.shiftright(_place(salt), 6).alias("filter_word"), _bit(_place(salt)).alias("b"))
    return keep(words.groupBy("filter_word").agg(F.bit_or("b").alias("filter_bits")), "id-filter")


def _looked_up(df: DataFrame, held: DataFrame, hit: str = "hit", salt: int = 0) -> DataFrame:
    """Adds whether the ``doc_id`` of a row passes a filter; null ids never pass."""
    met = df.join(F.broadcast(held), F.shiftright(_place(salt), 6) == F.col("filter_word"), "left")
    found = F.col("doc_id").isNotNull() & F.coalesce(F.col("filter_bits").bitwiseAND(_bit(_place(salt))) != 0, F.lit(False))
    return met.select(*[F.col(f"`{c}`") for c in df.columns], found.alias(hit))


def passing(df: DataFrame, held: DataFrame, yes: bool = True, salt: int = 0) -> DataFrame:
    """Rows whose ``doc_id`` passes a filter, or those that it is sure not to hold; null ids never pass."""
    hit = fresh(df, "hit")
    found = _looked_up(df, held, hit, salt)
    return found.where(F.col(hit) if yes else ~F.col(hit)).drop(hit)


def sets_of(docs: DataFrame, ids: DataFrame, plan: Plan) -> DataFrame:
    """doc_id and the packed set of every text whose id is among ``ids``, and of a few others that pass their filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in slices(batches, 1):
            packed = [pack_set(shingles(t, plan.width, known)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["doc_id", "set"])
        known.clear()
        release()

    narrow = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return passing(narrow, id_filter(ids)).mapInArrow(run, "doc_id bigint, set binary")


def shared_parts(told: DataFrame) -> DataFrame:
    """(cell, doc_id): every set with the pivots, the least ids, of the rarest of its parts that other sets hold; from kept rows of ``TOLD``.

    The result is kept, and neither the rows nor what was made of them is needed any more.
    """

    def run(table: pa.Table) -> pa.Table:
        keys, owners, marks = (
            np.frombuffer(b"".join(table.column(c).to_pylist()), dtype=t)
            for c, t in (("keys", np.uint32), ("owners", np.int64), ("marks", np.uint8))
        )
        order = np.lexsort((owners, keys))
        place = (table.column("bucket")[0].as_py() << 32) | keys[order].astype(np.int64)
        owners, marks = owners[order], marks[order]
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        times = np.diff(np.append(first, len(place)))
        heavy = np.maximum.reduceat(marks & SEVERAL, first) > 0
        # how many holders a part has; a heavy one has more than are seen here, so it comes after all others
        holders = np.repeat(times + (heavy.astype(np.int64) << 40), times)
        pivot, shared = np.repeat(owners[first], times), np.repeat((times > 1) | heavy, times)
        return pa.table({
            "doc_id": pa.array(owners[shared]), "second": pa.array((marks[shared] & SECOND > 0).astype(np.int64)),
            "holders": pa.array(holders[shared]), "place": pa.array(place[shared]), "cell": pa.array(pivot[shared]),
            "heavy": pa.array(np.repeat(heavy, times)[shared]),
        })

    schema = "doc_id bigint, second bigint, holders bigint, place bigint, cell bigint, heavy boolean"
    packs = told.where("bucket is not null").select("bucket", "keys", "owners", "marks")
    met = keep(packs.groupBy("bucket").applyInArrow(run, schema), "shared-parts")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    pivots = met.where("heavy").groupBy("place").agg(F.max("holders").alias("holders"), F.max("cell").alias("cell"))
    more = told.where("heavy_key is not null").select(
        F.col("heavy_id").alias("doc_id"), F.col("heavy_class").alias("second"), F.col("heavy_key").alias("place"),
        F.pmod("heavy_id", F.lit(SALTS)).cast("int").alias("salt"),
    ).join(pivots.select("*", salts), ["place", "salt"])
    columns = ["doc_id", "second", "holders", "place", "cell"]
    every = met.where("not heavy").select(*columns).union(met.where("heavy").select(*columns).union(more.select(*columns)).distinct())
    slack = told.where("slack is not null").groupBy("doc_id").agg(F.min("slack").alias("slack"), F.min("slack2").alias("slack2"))
    mine = Window.partitionBy("doc_id", "second")
    placed = every.join(slack, "doc_id").withColumns({
        "from_rare": F.row_number().over(mine.orderBy("holders", "place")), "shared": F.count("*").over(mine),
    })
    spare = F.when(F.col("second") == 0, F.col("slack")).otherwise(F.col("slack2"))
    cells = keep(placed.where(F.col("from_rare") <= F.col("shared") - spare).select("cell", "doc_id").distinct(), "part-regions")
    forget(met)
    return cells


def _regions(keyed: DataFrame, salt: int) -> DataFrame:
    """(cell, doc_id) of all regions with at least two sets inside the regions that are divided, from (outer, doc_id, keys, out).

    The pivot of a neighbourhood is its least member in an order that changes from round to round. ``out`` is whether a set still looks
    for links; neighbourhoods without such a set are left.
    """
    single = keyed.select("outer", F.explode("keys").alias("key"), "doc_id", "out")
    order = F.struct(F.xxhash64("doc_id", F.lit(salt)), F.col("doc_id").alias("d"))
    common = single.groupBy("outer", "key").agg(
        F.min(order).alias("p"), F.max(order).alias("q"), F.count("*").alias("n"), F.max("out").alias("out")
    ).where("p != q and out")
    common = keep(common.select("outer", "key", "n", F.col("p.d").alias("pivot"), F.col("q.d").alias("other")), "divided-parts")
    # two members are known already; only parts with more of them meet the sets again
    pairs = common.where("n = 2").select("outer", "pivot", F.explode(F.array("pivot", "other")).alias("doc_id"))
    many = common.where("n > 2").select("outer", "key", "pivot")
    met = single.join(many, ["outer", "key"]).select("outer", "pivot", "doc_id").union(pairs)
    return met.select(F.xxhash64("outer", "pivot").alias("cell"), "doc_id").distinct()


def _centres(keyed: DataFrame) -> DataFrame:
    """(outer, pivot): in each region the set whose parts most others share."""
    single = keyed.select("outer", F.explode("keys").alias("key"), "doc_id")
    common = single.groupBy("outer", "key").agg(F.count("*").alias("n")).where("n > 1")
    liked = single.join(common, ["outer", "key"]).groupBy("outer", "doc_id").agg(F.sum("n").alias("n"))
    return liked.groupBy("outer").agg(F.max_by("doc_id", F.struct("n", -F.col("doc_id"))).alias("pivot"))


def leaf_links(ids: np.ndarray, sets: list[np.ndarray], plan: Plan) -> list[tuple[int, int]]:
    """Links that connect all components among some sets, by the triangle inequality around pivots."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    words, flat = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), sizes)
    order = np.argsort(flat, kind="stable")
    holders, starts = owner[order], np.searchsorted(flat[order], np.arange(len(words) + 1))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    label = np.arange(m)
    open_ = np.ones(m, dtype=bool)
    out: list[tuple[int, int]] = []
    # sets that hold much of what is common come first: their balls are large
    weight = np.diff(starts)[flat]
    rank = np.argsort(-np.add.reduceat(weight, bounds[:-1]) / sizes, kind="stable")
    for i in rank:
        if not open_[i]:
            continue
        mine = flat[bounds[i] : bounds[i + 1]]
        both = np.bincount(np.concatenate([holders[starts[w] : starts[w + 1]] for w in mine]), minlength=m)
        far = 1 - both / (sizes + sizes[i] - both)
        near = plan.links(both, sizes, sizes[i])
        for j in np.flatnonzero(near & (label != label[i])):
            if label[j] != label[i]:
                out.append((int(ids[i]), int(ids[j])))
                label[label == label[j]] = label[i]
        open_[i] = False
        outside = far[label != label[i]]
        nearest = outside.min() if len(outside) else np.inf
        # a linked set whose window holds nothing outside the component has nothing left to find
        open_[near & (far + plan.radius + 1e-9 < nearest)] = False
    return out


def _joined_leaves(members: DataFrame, plan: Plan) -> DataFrame:
    """Links (a, b) inside every cell of (cell, doc_id, set)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        sets = [unpack_set(s) for s in table.column("set").to_pylist()]
        found = leaf_links(table.column("doc_id").to_numpy(), sets, plan) if len(sets) > 1 else []
        del sets
        if table.nbytes > RELEASED:
            release()
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return members.select("cell", "doc_id", "set").groupBy("cell").applyInArrow(run, "a bigint, b bigint")


def _pivot_distances(members: DataFrame, plan: Plan) -> DataFrame:
    """Adds ``far`` and ``near`` (distance to the pivot, whether it links) to (.., set, pivot_set)."""
    names = members.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far, near = [], []
            for s, p in zip(batch.column("set").to_pylist(), batch.column("pivot_set").to_pylist(), strict=True):
                x, y = unpack_set(s), unpack_set(p)
                both = len(np.intersect1d(x, y, assume_unique=True))
                far.append(1 - both / (len(x) + len(y) - both))
                near.append(bool(plan.links(both, len(x), len(y))))
            kept = [batch.column(n) for n in names if n not in ("set", "pivot_set")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(far), pa.array(near)], [*[n for n in names if n not in ("set", "pivot_set")], "far", "near"]
            )

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in members.schema if f.name not in ("set", "pivot_set"))
    return members.mapInArrow(run, f"{kept}, far double, near boolean")


def _blocks(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """(cell, doc_id) of regions that did not shrink, as pairs of blocks: every two sets of a region meet in at least one pair."""
    wide = sizes.select(
        "outer",
        F.greatest(F.ceil(2 * F.col("sets") / LEAF_SETS), F.ceil(2 * F.col("shingles") / LEAF_SHINGLES)).cast("int").alias("k"),
    )
    placed = members.join(wide, "outer").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(77)), F.col("k")).cast("int"))
    placed = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    pair = F.xxhash64("outer", F.least("block", "other"), F.greatest("block", "other"))
    return placed.select(pair.alias("cell"), "doc_id").distinct()


def _more_parts(texts: DataFrame, points: DataFrame, plan: Plan, buckets: int) -> DataFrame:
    """Regions from further parts around sets of which too many parts were empty, until each has met its partners.

    What is left after ``MORE`` partitions meets all sets of its sizes in one region, which is divided like any other.
    """
    unsure = points.where("not sure")
    cells = None
    for salt in range(1000, 1000 + MORE):
        low, high = unsure.agg(F.min("n_shingles"), F.max("n_shingles")).first()
        again = keep(measured(texts, plan, buckets, salt, (low * plan.percent // 100, high * 100 // plan.percent + 1)), "projections")
        more = shared_parts(again).select(F.xxhash64("cell", F.lit(salt)).alias("cell"), "doc_id")
        cells = more if cells is None else cells.union(more)
        left = again.where("n_shingles is not null").where(~_sure()).select("doc_id", "n_shingles").distinct()
        unsure = keep(left.join(unsure.select("doc_id").distinct(), "doc_id", "left_semi"), "unsure")
        forget(again)
        if unsure.limit(1).count() == 0:
            return cells
    low, high = unsure.agg(F.min("n_shingles"), F.max("n_shingles")).first()
    band = points.where(F.col("n_shingles").between(low * plan.percent // 100, high * 100 // plan.percent + 1))
    return cells.union(band.select(F.lit(-1).cast("bigint").alias("cell"), "doc_id").distinct())


def _keys_again(members: DataFrame, plan: Plan, salt: int) -> DataFrame:
    """(outer, doc_id, sure, keys) with the parts of another round, from (outer, doc_id, set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [plan.projections(unpack_set(s), salt) for s in batch.column(2).to_pylist()]
            keys = pa.array([k.tolist() for _, k in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([s for s, _ in found]), keys], ["outer", "doc_id", "sure", "keys"]
            )

    narrow = members.select("outer", "doc_id", "set")
    return narrow.mapInArrow(run, "outer bigint, doc_id bigint, sure boolean, keys array<bigint>")


def link_table(docs: DataFrame, cells: DataFrame, points: DataFrame, plan: Plan, buckets: int) -> DataFrame:
    """Links (a, b) between different sets. ``points``: doc_id, n_shingles, sure, one row per distinct set; ``cells``: from ``shared_parts``."""
    spark = docs.sparkSession
    size_of = points.select("doc_id", "n_shingles").distinct()
    if points.where("not sure").limit(1).count():
        cells = cells.union(_more_parts(docs, points, plan, buckets)).distinct()
    # equal sets are represented by one of them; regions left with a single set have nothing to find
    cells = keep(cells.join(size_of, "doc_id"), "regions")
    links = spark.createDataFrame([], "a bigint, b bigint")
    sets = None
    for salt in range(1, ROUNDS + 1):
        sizes = cells.groupBy("cell").agg(F.count("*").alias("sets"), F.sum("n_shingles").alias("shingles")).where("sets > 1")
        sizes = keep(sizes.select("*", ((F.col("sets") > LEAF_SETS) | (F.col("shingles") > LEAF_SHINGLES)).alias("large")), "region-sizes")
        some = sizes.where("large").limit(1).count() > 0
        places = cells.join(sizes.where("not large").select("cell"), "cell", "left_semi").select("cell", "doc_id")
        places = keep(places.distinct(), "leaf-places")
        here = sets_of(docs, places.select("doc_id"), plan) if sets is None else sets
        links = links.union(_joined_leaves(here.join(places.hint("merge"), "doc_id"), plan))
        if not some:
            return links
        rest = cells.join(sizes.where("large").select("cell"), "cell", "left_semi")
        rest = keep(rest.select(F.col("cell").alias("outer"), "doc_id", "n_shingles"), "divided")
        # the sets of large regions are met again in every round
        sets = keep(sets_of(docs, rest.select("doc_id"), plan).dropDuplicates(["doc_id", "set"]), "sets") if sets is None else sets
        again = keep(_keys_again(rest.join(sets, "doc_id"), plan, salt), "projections")
        aims = keep(_centres(again), "centres")
        pivot_sets = sets.join(aims.select(F.col("pivot").alias("doc_id")).distinct(), "doc_id")
        pivot_sets = pivot_sets.select(F.col("doc_id").alias("pivot"), F.col("set").alias("pivot_set"))
        placed = rest.join(sets, "doc_id").join(aims.join(pivot_sets, "pivot"), "outer")
        spread = keep(_pivot_distances(placed, plan), "pivot-distances")
        near = spread.where("near and doc_id != pivot")
        links = links.union(near.select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")))
        # linked sets stay only where the window of a set outside the pivot's ball reaches them
        edge = spread.where("not near").groupBy("outer").agg(F.min("far").alias("nearest"))
        left = spread.join(edge, "outer").where(f"not near or far + {plan.radius + 1e-9} >= nearest")
        left = keep(left.select("outer", "doc_id", "n_shingles", (~F.col("near")).alias("out")), "left-over")
        if left.limit(1).count() == 0:
            return links
        if salt == ROUNDS or again.where("not sure").limit(1).count():
            sizes = left.groupBy("outer").agg(F.count("*").alias("sets"), F.sum("n_shingles").alias("shingles"))
            return links.union(_joined_leaves(_blocks(left, sizes).join(sets, "doc_id"), plan))
        divided = again.join(left.select("outer", "doc_id", "out"), ["outer", "doc_id"])
        cells = keep(_regions(divided, salt).join(size_of, "doc_id"), "regions")
    return links


def classes(docs: DataFrame, plan: Plan | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text, ...)."""
    plan = plan or Plan()
    texts, chars = senders(docs)
    buckets = buckets_for(chars, plan)
    told = keep(measured(texts, plan, buckets), "shingle-sets")
    rows = told.where("n_shingles is not null").select("doc_id", "n_shingles", "fingerprint", _sure().alias("sure"))
    rows = keep(rows, "set-rows")
    cells = shared_parts(told)
    forget(told)
    known = rows.where("doc_id is not null and fingerprint is not null")
    # only sets that several ids hold are joined, in shares: one set may be held by very many
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    first = known.groupBy("fingerprint").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep < last")
    first = first.select("fingerprint", "rep", salts)
    salted = known.select("*", F.pmod("doc_id", F.lit(SALTS)).cast("int").alias("salt"))
    mine = salted.join(first, ["fingerprint", "salt"], "left")
    mine = keep(mine.select("doc_id", "n_shingles", "sure", F.coalesce("rep", "doc_id").alias("rep")), "equal-sets")
    points = mine.where("doc_id = rep").select("doc_id", "n_shingles", "sure")
    links = link_table(texts, cells, points, plan, buckets)
    equal = mine.where("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = keep(components(links.union(equal)), "components")
    done = rows.select("doc_id", "n_shingles").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return done.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, plan: Plan | None = None) -> DataFrame:
    """The row with the least id of every component, with all its columns.

    Of rows that share an id the one with the least text stays, and of equal ones any.
    """
    told = keep(classes(docs, plan), "jaccard-classes").where("doc_id is not null")
    gone = keep(told.where("doc_id != component_id").select("doc_id").distinct(), "gone")
    # most rows are sure to stay or to go and do not travel: of the others some id that stays falls on the bits of one that goes
    held = id_filter(gone)
    stays = told.where("doc_id = component_id").select("doc_id")
    doubted = keep(passing(stays, held).distinct(), "doubted")
    again = passing(passing(docs, held), id_filter(doubted, 1), salt=1)
    doubtful = again.join(large(doubted), "doc_id", "left_semi")
    out = passing(docs, held, yes=False).select(*docs.columns).union(doubtful.select(*docs.columns))
    repeated = keep(told.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.limit(1).count() > 0:
        # rows whose id no other row has do not travel
        many = id_filter(repeated)
        whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        named = passing(out, many).groupBy("doc_id").agg(F.min_by(whole, F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("row")).select("row.*")
        out = named.unionByName(passing(out, many, yes=False))
    return out.select(*docs.columns)
