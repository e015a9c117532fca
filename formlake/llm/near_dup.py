"""MinHash near-duplicate groups: universal hash minima, bands, verification, connected components.

Texts with equal sets of shingles are one class. Classes that agree in a band share a bucket. A bucket is
never expanded into its pairs. First every class is compared with the pivot (of its up to 32 buckets) that
it shares most buckets with, and the links found are drawn together. Buckets whose classes are by then in one
component are done: a pair inside a component can't change it. In the others, blocks of classes are compared
with each other inside one task, which gives out links only; a block of one component is not compared with
another block of the same.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formlake.llm import words as W
from formlake.llm.common import distinct_names, is_small, release, sized, store

SHINGLE = 5
#: 32 bands of 4 minima: two texts of similarity 0.75 miss all bands with probability 5e-6.
BANDS, ROWS = 32, 4
#: Links have 100 * intersection >= 75 * union.
PERCENT = 75
#: A pair is read whole if 55 % of its 128 minima agree: at similarity 0.75 fewer do with probability 2e-7.
MIN_AGREEING = 0.55
#: Classes are compared in blocks of about so many bytes of shingles, and so many classes.
BLOCK_BYTES, BLOCK_CLASSES = 256 << 10, 256
#: From so many classes of one component in a bucket on, they have blocks of their own.
PURE_MEMBERS = 16

_U = np.uint64
_random = np.random.default_rng(7)
_MULTIPLY = _random.integers(1 << 62, size=BANDS * ROWS, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_ADD = _random.integers(1 << 62, size=BANDS * ROWS, dtype=np.int64).astype(_U) * _U(2)
_SPREAD = _random.integers(1 << 62, size=ROWS, dtype=np.int64).astype(_U) * _U(2) + _U(1)

_SKETCH = ("doc_id long, text_hash long, n_shingles long, set_key long, bands array<long>, signature binary")


def distinct_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted set of shingle hashes of every row, letter case of A-Z aside."""
    hashes, at = W.shingles(W.words(texts, fold=True), k)
    sets = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        own = np.sort(hashes[a:b])
        if len(own) > 1:
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        sets.append(own)
    return sets


def set_key(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the least value of every hash function x -> (a x + b) >> 32 modulo 2^64."""
    flat = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), BANDS * ROWS), np.uint32)
    scratch = np.empty_like(flat)
    for j in range(BANDS * ROWS):
        np.multiply(flat, _MULTIPLY[j], out=scratch)
        np.add(scratch, _ADD[j], out=scratch)
        np.right_shift(scratch, _U(32), out=scratch)
        out[:, j] = np.minimum.reduceat(scratch, at)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """One bucket number for each set and band."""
    parts = least.reshape(len(least), BANDS, ROWS).astype(_U)
    return W.mix((parts * _SPREAD).sum(axis=2, dtype=_U) + (np.arange(BANDS, dtype=_U) + _U(1)) * _MULTIPLY[0])


def _sketcher(k: int):
    def sketch(batches):
        seen: set[int] = set()  # classes of this task, 8 bytes a row of it
        for part in W.slices(batches, "text"):
            sets = distinct_sets(part.column(2), k)
            keys: list[int | None] = [set_key(s) if len(s) else None for s in sets]
            fresh = []  # copies within a task carry no signature: one is enough to find the class's partners
            for i, key in enumerate(keys):
                if key is not None and key not in seen:
                    seen.add(key)
                    fresh.append(i)
            bands: list = [None] * len(sets)
            signatures: list = [None] * len(sets)
            if fresh:
                least = minima([sets[i] for i in fresh])
                buckets = band_keys(least).view(np.int64)
                low = least.astype(np.uint8)
                for row, i in enumerate(fresh):
                    bands[i], signatures[i] = buckets[row], low[row].tobytes()
            yield pa.RecordBatch.from_arrays([
                part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()),
                pa.array(keys, pa.int64()), pa.array(bands, pa.list_(pa.int64())),
                pa.array(signatures, pa.binary()),
            ], ["doc_id", "text_hash", "n_shingles", "set_key", "bands", "signature"])

    return sketch


def _confirmer(k: int, percent: int):
    """Pairs of which enough minima agree, and then enough of the whole sets."""

    def confirm(batches):
        for part in W.slices(W.slices(batches, "ta"), "tb"):
            signatures = [np.stack([np.frombuffer(x.as_buffer(), np.uint8) for x in part.column(c)]) for c in ("sa", "sb")]
            share = (signatures[0] == signatures[1]).mean(axis=1)
            part = part.filter(pa.array(share >= _least_agreement()))
            left, right = (
                distinct_sets(pa.array([zlib.decompress(x) for x in part.column(c).to_pylist()], pa.binary()), k)
                for c in ("ta", "tb")
            )
            keep = []
            for x, y in zip(left, right, strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return confirm


_WHOLE = "set_key long, text binary, shingles binary, bands array<long>, signature binary"


def _whole(k: int):
    """Packed text, set and sketch of each wanted class; drops rows whose text is another's (ids can repeat)."""

    def check(batches):
        for part in W.slices(batches, "text"):
            sets = distinct_sets(part.column("text"), k)
            same = pa.array([
                len(s) > 0 and set_key(s) == w
                for s, w in zip(sets, part.column("set_key").to_pylist(), strict=True)], pa.bool_())
            part = part.select(["set_key", "text"]).filter(same)
            sets = [s for s, own in zip(sets, same.to_pylist(), strict=True) if own]
            if not sets:
                continue
            least = minima(sets)
            texts = [zlib.compress(x.as_buffer(), 3) for x in part.column("text")]
            yield pa.RecordBatch.from_arrays([
                part.column("set_key"), pa.array(texts, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary()),
                pa.array(list(band_keys(least).view(np.int64)), pa.list_(pa.int64())),
                pa.array([row.tobytes() for row in least.astype(np.uint8)], pa.binary()),
            ], ["set_key", "text", "shingles", "bands", "signature"])

    return check


def _texts(classes: DataFrame, signed: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """The whole of these classes; the text is that of any document of the class."""
    owners = signed.groupBy("set_key").agg(F.min("doc_id").alias("wanted")).join(classes, "set_key", "left_semi")
    owners = store(owners, "owners")
    same = F.col("doc_id").eqNullSafe(F.col("wanted"))
    texts = docs.select("doc_id", "text").join(sized(owners), same).select("set_key", "text")
    return texts.mapInArrow(_whole(k), _WHOLE)


def _block(column: pa.ListArray, i: int):
    """(keys, roots, buckets, signatures, sets) of the block in row i."""
    rows = column.values.slice(column.offsets[i].as_py(), column.offsets[i + 1].as_py() - column.offsets[i].as_py())
    field = {n: rows.field(n) for n in ("set_key", "root", "bands", "signature", "shingles")}
    sets = [np.frombuffer(x.as_buffer(), _U) for x in field["shingles"]]
    return (
        field["set_key"].to_numpy(), field["root"].to_numpy(),
        np.array(field["bands"].to_pylist(), np.int64).reshape(len(sets), BANDS),
        np.stack([np.frombuffer(x.as_buffer(), np.uint8) for x in field["signature"]]), sets,
    )


def _least_agreement() -> float:
    """Only the low byte of a minimum is kept, so 1 in 256 agrees by chance."""
    return MIN_AGREEING + (1 - MIN_AGREEING) / 256


def _between_blocks(percent: int):
    """Links between classes of different components in two blocks of a bucket.

    A pair is looked at only in its first common bucket. Components that a task has found linked count as one
    from then on: a task gives out no more links than it takes to join them.
    """

    def compare(batches):
        joined: dict[int, int] = {}

        def top(root: int) -> int:
            while joined.get(root, root) != root:
                joined[root] = root = joined.get(joined[root], joined[root])
            return root

        for batch in batches:
            links: list[tuple[int, int]] = []
            lefts, rights = batch.column("left"), batch.column("right")
            for i, (bucket, same) in enumerate(zip(batch.column("bucket").to_pylist(), batch.column("same").to_pylist(),
                                                   strict=True)):
                ka, ra, ba, sa, xa = _block(lefts, i)
                kb, rb, bb, sb, xb = _block(rights, i)
                na, nb = np.array([len(x) for x in xa]), np.array([len(x) for x in xb])
                mask = (ra[:, None] != rb) & (100 * np.minimum(na[:, None], nb) >= percent * np.maximum(na[:, None], nb))
                if same:
                    mask &= ka[:, None] < kb
                x, y = np.nonzero(mask)
                for at in range(0, len(x), 1 << 13):
                    p, q = x[at:at + (1 << 13)], y[at:at + (1 << 13)]
                    common = ba[p] == bb[q]
                    first = ba[p, common.argmax(axis=1)] == bucket
                    p, q = p[first], q[first]
                    likely = (sa[p] == sb[q]).mean(axis=1) >= _least_agreement()
                    for i_a, i_b in zip(p[likely].tolist(), q[likely].tolist(), strict=True):
                        r, s = top(int(ra[i_a])), top(int(rb[i_b]))
                        if r == s:
                            continue
                        both = len(np.intersect1d(xa[i_a], xb[i_b], assume_unique=True))
                        if 100 * both >= percent * (na[i_a] + nb[i_b] - both):
                            links.append((int(ka[i_a]), int(kb[i_b])))
                            joined[r] = s
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[j] for x in links], pa.int64()) for j in (0, 1)], ["a", "b"])
        W.give_back()

    return compare


def _confirmed(pairs: DataFrame, signed: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that are links, judged on whole texts."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("set_key")).distinct()
    texts = _texts(ends, signed, docs, k).select("set_key", "text", "signature")
    texts = store(texts.dropDuplicates(["set_key"]), "texts")
    both = pairs.join(texts.toDF("a", "ta", "sa"), "a").join(texts.toDF("b", "tb", "sb"), "b")
    links = store(both.mapInArrow(_confirmer(k, percent), "a long, b long"), "links")
    release(texts)
    return links


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), root being the least node it can reach."""
    links = stars(edges)
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def stars(edges: DataFrame, max_turns: int | None = None) -> DataFrame:
    """Edges (u, v), v < u, that join the same nodes as ``edges`` (a, b); at the end each node to its root.

    Alternates large-star (every larger neighbour is tied to the least neighbour) and small-star (all
    smaller neighbours are) until nothing changes. Both are a grouped minimum and a join, so a node with
    many neighbours is combined before the shuffle and its join can be split. With ``max_turns`` it stops
    early, and some components are still several stars.
    """

    links = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links, before = _stored_edges(links)
    turns = 0
    while before[0] and turns != max_turns:
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small, after = _stored_edges(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        release(links)
        links, turns = small, turns + 1
        if after == before:
            break
        before = after
    return links


def _stored_edges(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """Writes edges, and counts and sums up what was written: equal figures mean that nothing changed."""
    edges = store(edges, "edges")
    total = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return edges, tuple(edges.agg(F.count(F.lit(1)), total).first())


def _first_pairs(members: DataFrame) -> DataFrame:
    """Every class with the pivot it shares most buckets with."""
    shared = members.where("set_key <> pivot").groupBy("set_key", "pivot").agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy("set_key").orderBy(F.desc("n"), "pivot")
    first = shared.withColumn("place", F.row_number().over(best)).where("place = 1")
    return first.select(F.least("set_key", "pivot").alias("a"), F.greatest("set_key", "pivot").alias("b")).distinct()


def _open_buckets(members: DataFrame, roots: DataFrame, first: DataFrame) -> DataFrame:
    """(bucket, set_key, root) of buckets that hold several components and pairs not yet looked at."""
    placed = members.join(roots.withColumnRenamed("node", "set_key"), "set_key", "left").select(
        "bucket", "set_key", "pivot", F.coalesce("root", "set_key").alias("root"))
    placed = store(placed, "placed")
    other = F.when(F.col("set_key") != F.col("pivot"), F.col("set_key"))
    buckets = placed.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high"),
        F.max("pivot").alias("pivot"), F.max(other).alias("other"),
    ).where("low <> high")
    pair = buckets.select("bucket", "n", F.least("pivot", "other").alias("a"), F.greatest("pivot", "other").alias("b"))
    done = first.select("a", "b", F.lit(True).alias("done"))
    still = pair.join(done, ["a", "b"], "left").where("n > 2 or done is null").select("bucket")
    return placed.select("bucket", "set_key", "root").join(still, "bucket", "left_semi")


def _open_links(placed: DataFrame, signed: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between different components within the open buckets."""
    placed = store(placed, "open")
    classes = placed.select("set_key").distinct()
    sets = store(_texts(classes, signed, docs, k).drop("text").dropDuplicates(["set_key"]), "sets")
    # Classes of a component with many members in the bucket share blocks, which never meet each other.
    own = placed.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n")).where(f"n >= {PURE_MEMBERS}")
    own = own.select("bucket", "root", F.col("root").alias("pure"))
    placed = store(placed.join(own, ["bucket", "root"], "left"), "placed")
    sizes = sets.select("set_key", F.octet_length("shingles").alias("size"))
    parts = placed.join(sizes, "set_key").groupBy("bucket", "pure").agg(
        F.greatest(F.ceil(F.sum("size") / BLOCK_BYTES), F.ceil(F.count(F.lit(1)) / BLOCK_CLASSES)).alias("parts"))
    key = (F.col("m.bucket") == F.col("p.bucket")) & F.col("m.pure").eqNullSafe(F.col("p.pure"))
    part = F.pmod(F.xxhash64("set_key"), "parts")
    dealt = placed.alias("m").join(parts.alias("p"), key).select("m.bucket", "m.pure", "set_key", "root", part.alias("part"))
    row = F.struct("set_key", "root", "bands", "signature", "shingles")
    blocks = dealt.join(sets, "set_key").groupBy("bucket", "pure", "part").agg(F.collect_list(row).alias("rows"))
    blocks = blocks.withColumn("block", F.xxhash64("pure", "part"))
    left, right = blocks.alias("l"), blocks.alias("r")
    meet = (
        (F.col("l.bucket") == F.col("r.bucket")) & (F.col("l.block") <= F.col("r.block"))
        & ~F.coalesce(F.col("l.pure") == F.col("r.pure"), F.lit(False))
    )
    pairs = left.join(right, meet).select(
        "l.bucket", (F.col("l.block") == F.col("r.block")).alias("same"), F.col("l.rows").alias("left"),
        F.col("r.rows").alias("right"))
    links = store(pairs.mapInArrow(_between_blocks(percent), "a long, b long"), "open-links")
    release(sets)
    return links


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept, text_hash (``xxhash64`` of the text) and
    component_key (equal within a component; null without words).

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. A text with fewer than ``k`` words has its whole
    sequence as its only shingle. Null, empty and blank texts have no shingles, no links, and form a
    component of their own. component_id is the least doc_id of the component; a null doc_id counts as larger than
    any other (a component of null ids has a null component_id, and its rows are kept). Repeated rows
    are in one component, and all those with its least id are marked kept. An empty table gives an empty table.
    Extra columns are ignored, whatever their names.
    """
    docs = distinct_names(df, doc_id=id_col, text=text_col)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    signed = store(docs.mapInArrow(_sketcher(k), _SKETCH), "sketches")

    bands = signed.where("bands is not null").select("set_key", F.explode("bands").alias("bucket"))
    # The pivot is the class that is least when its bits are crossed with the bucket's: another in each bucket.
    crossed = F.col("set_key").bitwiseXOR(F.col("bucket"))
    shared = (
        bands.groupBy("bucket").agg(F.min(crossed).alias("low"), F.max(crossed).alias("high"))
        .where("low <> high").select("bucket", F.col("low").bitwiseXOR(F.col("bucket")).alias("pivot"))
    )
    members = store(bands.join(shared, "bucket").distinct(), "members")

    first = store(_first_pairs(members), "first-pairs")
    links = stars(_confirmed(first, signed, docs, k, percent), max_turns=2)
    # A node goes with its least neighbour; each root with itself, as it has no smaller one.
    roots = links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    more = _open_links(_open_buckets(members, roots, first), signed, docs, k, percent)
    joined = store(components(links.select(F.col("u").alias("a"), F.col("v").alias("b")).union(more)), "components")
    release(members, first, links)

    ids = signed.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("least_id"))
    ids = ids.join(joined.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn(
        "root", F.coalesce("root", "set_key"))
    named = ids.groupBy("root").agg(F.min("least_id").alias("component_id"))
    linked = ids.join(named, "root").select("set_key", "component_id", F.col("root").alias("component_key"))
    out = signed.select("doc_id", "text_hash", "n_shingles", "set_key").join(linked, "set_key", "left")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"), "text_hash", "component_key",
    )


def without_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """The rows of ``df``, unchanged: one of each component of ``near_duplicates``, that with its least id.

    If several rows have that id, one of those with the least hash of the text stays. Rows without words are
    in no component; of those with equal ids one stays.
    """
    found = store(near_duplicates(df, id_col, text_col, k, percent), "near-duplicates")
    rows = found.groupBy("doc_id", "component_key", "text_hash", "kept").agg(F.count(F.lit(1)).alias("n"))
    first = Window.partitionBy("doc_id", "component_key").orderBy("text_hash")
    rows = store(rows.withColumn("stays", F.col("kept") & (F.row_number().over(first) == 1)), "verdicts")
    text_hash = F.xxhash64(df[text_col])

    def same(other: DataFrame):
        return df[id_col].cast("long").eqNullSafe(other["doc_id"]) & (text_hash == other["text_hash"])

    gone = sized(rows.where("not stays").select("doc_id", "text_hash").distinct())
    out = df.join(gone, same(gone), "left_anti")
    repeated = rows.where("stays and n > 1").select("doc_id", "text_hash").distinct()
    if is_small(repeated, 0):
        return out
    repeated = sized(repeated)
    keys = {"_near_id": df[id_col], "_near_hash": text_hash}
    one = out.join(repeated, same(repeated), "left_semi").withColumns(keys).dropDuplicates(list(keys)).drop(*keys)
    return out.join(repeated, same(repeated), "left_anti").unionByName(one)
