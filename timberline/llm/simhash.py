"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of at most 23 bits. Every 23-bit word lies within distance 3 of
exactly one codeword of the perfect binary Golay code, so it decodes to a codeword index of 12 bits; a word and its
23 neighbours at distance 1 decode to six codewords at most. Two words at distance 0 or 1 therefore share a key if one
side files the index of its own word and the other the indices of its neighbourhood.

Two fingerprints with three errors at most have, over three segments, by the pigeonhole principle either

* one segment without an error and another with one at most (the key is the exact segment and a Golay index), or
* one error in each segment (the key is three Golay indices).

Fingerprints that share a key are verified with their true distance. Within a key's group only a spanning forest of
the verified links is emitted, never all pairs; a group that a sample shows to be large is cut into blocks and every
pair of blocks is a group of its own, so no task holds an unbounded group. Components come from large-star/small-star
rounds over the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.rows import comparable, row_hashes
from timberline.sources.shared import materialise

#: Bits of each segment; 64 in sum, 23 at most each.
SEGMENTS = (22, 21, 21)
#: Fingerprints that one group of a key may hold before it is cut into blocks.
BLOCK = 4096
#: One fingerprint of so many is counted to find large groups. It only decides where groups are cut.
SAMPLE = 32
SEED = 42

#: Fixed value: generator polynomial of the binary Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY = 0b101011100011


# ---- fingerprints


def shingles(text: str, width: int) -> Iterator[bytes]:
    """Word shingles of the lower-cased (A-Z) text; a shorter text gives the whole sequence, an empty one nothing."""
    words = text.encode().lower().split()  # bytes: A-Z and \x20 \x09-\x0D only
    if len(words) <= width:
        return iter([b" ".join(words)] if words else [])
    return map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash over XXH64 of the shingles, repeats included; 0 without words. A bit is set if over half are."""
    import xxhash

    h = np.array(list(map(xxhash.xxh64_intdigest, shingles(text or "", width), repeat(SEED))), dtype=np.uint64)
    if not len(h):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) and the long columns of `keep` for each row; null texts count as empty."""
    names = ["doc_id", "fp", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), width) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), *b.columns[2:]], names)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *keep)
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))


# ---- keys


def golay_table() -> np.ndarray:
    """Index of the codeword nearest to each 23-bit word, made from the generator polynomial."""
    index = np.arange(1 << 12, dtype=np.int64)
    code = np.zeros(1 << 12, dtype=np.int64)
    for i in range(12):  # the product with the generator over GF(2)
        code ^= np.where(index >> i & 1, GOLAY << i, 0)
    table = np.full(1 << 23, -1, dtype=np.int16)
    bits = [1 << i for i in range(23)]
    for errors in (0, 1, 2, 3):
        for e in combinations(bits, errors):
            table[code ^ sum(e)] = index
    return table


_table: list[np.ndarray] = []


def own_index(word: np.ndarray) -> np.ndarray:
    """Codeword index of each word; the table is built once for each worker process."""
    if not _table:
        _table.append(golay_table())
    return _table[0][word].astype(np.int64)


def near_indices(word: np.ndarray, bits: int) -> np.ndarray:
    """n x 6: the distinct codeword indices of the word and its neighbours at distance 1; -1 where there are fewer."""
    found = np.sort(np.stack([own_index(word ^ e) for e in (0, *(1 << i for i in range(bits)))], axis=1), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return -np.sort(-found, axis=1)[:, :6]


def segments(fp: np.ndarray) -> list[np.ndarray]:
    """The segments of unsigned 64-bit fingerprints, low bits first."""
    starts = np.cumsum((0, *SEGMENTS[:-1]))
    return [(fp >> np.uint64(s) & np.uint64((1 << b) - 1)).astype(np.int64) for s, b in zip(starts, SEGMENTS, strict=True)]


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of fp, key) for every key of every fingerprint. Two fingerprints within distance 3 share a key."""
    seg, rows = segments(fp), np.arange(len(fp))
    own = [own_index(s) for s in seg]
    near = [near_indices(s, b) for s, b in zip(seg, SEGMENTS, strict=True)]
    out = []

    def file(table: int, key: np.ndarray, real: np.ndarray) -> None:
        row = np.broadcast_to(rows.reshape(-1, *[1] * (key.ndim - 1)), key.shape)
        out.append((row[real], key[real] << 3 | table))

    for table, (i, j) in enumerate((i, j) for i in range(3) for j in range(3) if i != j):
        # segment i without an error, j with one at most; the neighbourhood holds the word's own index too
        file(table, seg[i][:, None] << 12 | near[j], near[j] >= 0)
    # one error at most in each: a side files its own index in two segments and its neighbourhood in the third, or
    # the other way about
    file(6, (own[0] << 24 | own[1] << 12)[:, None] | near[2], near[2] >= 0)
    a, b = near[0][:, :, None], near[1][:, None, :]
    file(6, a << 24 | b << 12 | own[2][:, None, None], (a >= 0) & (b >= 0))
    return np.concatenate([r for r, _ in out]), np.concatenate([k for _, k in out])


def keyed(fps: DataFrame) -> DataFrame:
    """key and fp for every key of every fingerprint in the column fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fp), 2048):
                row, key = keys(fp[at : at + 2048].view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[at : at + 2048][row])], ["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


# ---- links


def forest(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(root, member) for the components of distinct fingerprints under links of so many bits; no row for a root.

    Each fingerprint that is reached is compared only with those not reached yet, so a dense cloud costs far less
    than its pairs.
    """
    left, roots, members = fp, [], []
    while len(left) > 1:
        root, left, todo = left[0], left[1:], [left[0]]
        while todo and len(left):
            hit = np.bitwise_count((left ^ todo.pop()).view(np.uint64)) <= distance
            if hit.any():
                found, left = left[hit], left[~hit]
                todo += found.tolist()
                roots.append(np.full(len(found), root))
                members.append(found)
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *roots]), np.concatenate([none, *members])


def links_in_runs(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Links (a < b) in runs of equal (key, cell) of rows sorted by key, cell, fp."""

    def work(key: np.ndarray, cell: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        new = np.ones(len(fp), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])
        fresh = new.copy()
        fresh[1:] |= fp[1:] != fp[:-1]
        fp, new = fp[fresh], new[fresh]
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(fp)))
        a, b = [], []
        for k in range(2, 9):  # small runs: all their pairs at once
            at = start[size == k]
            for i in range(k):
                for j in range(i + 1, k):
                    x, y = fp[at + i], fp[at + j]
                    ok = np.bitwise_count((x ^ y).view(np.uint64)) <= distance
                    a.append(x[ok])
                    b.append(y[ok])
        for s, k in zip(start[size > 8], size[size > 8], strict=True):
            x, y = forest(fp[s : s + k], distance)
            a.append(x)
            b.append(y)
        pairs = np.stack([np.concatenate(a), np.concatenate(b)], axis=1) if a else np.zeros((0, 2), dtype=np.int64)
        pairs = np.unique(pairs, axis=0) if len(pairs) else pairs
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        cols = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(cols[0]):
            continue
        last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
        cut = len(last) - int(np.argmax(~last[::-1])) if not last.all() else 0  # where the batch's last run begins
        if held and (cut or held[-1][0][-1] != cols[0][0] or held[-1][1][-1] != cols[1][0]):
            yield work(*(np.concatenate(x) for x in zip(*held, tuple(c[:cut] for c in cols), strict=True)))
            held = []
            cols = tuple(c[cut:] for c in cols)
        elif cut:
            yield work(*(c[:cut] for c in cols))
            cols = tuple(c[cut:] for c in cols)
        held.append(cols)
    if held:
        yield work(*(np.concatenate(x) for x in zip(*held, strict=True)))


def links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """Distinct links a < b between the distinct fingerprints of the column fp that connect exactly what all pairs
    within the distance (3 at most) connect."""
    if not 0 <= distance <= 3:
        raise ValueError("the keys cover 0 to 3 differing bits")
    rows = keyed(fps)
    sample = keyed(fps.where(F.pmod(F.xxhash64("fp"), F.lit(SAMPLE)) == 0))
    hot = sample.groupBy("key").count().where(F.col("count") * SAMPLE > BLOCK).select("key", F.ceil(F.col("count") * SAMPLE / BLOCK).cast("int").alias("parts"))
    hot = materialise(hot, "hot_keys")
    if hot.isEmpty():
        rows = rows.withColumn("cell", F.lit(0))
    else:
        part = F.pmod(F.xxhash64("fp", "key"), F.col("parts")).cast("int")
        cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least(part, j) * F.col("parts") + F.greatest(part, j))
        rows = rows.join(hot, "key", "left").select("key", "fp", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(cells)).alias("cell"))
    rows = rows.select("key", "cell", "fp").repartition("key", "cell").sortWithinPartitions("key", "cell", "fp")
    return rows.mapInArrow(lambda batches: links_in_runs(batches, distance), "a long, b long").distinct()


def stars(edges: DataFrame) -> DataFrame:
    """Components of the links a, b as rows (a, b): a is the least node of b's component, no row for a itself.

    Large-star and small-star rounds until nothing changes; each round's links are written to the shared folder.
    """

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    before = mark(edges)
    while before[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select("m", F.explode(F.array("a", "b")).alias("b")).where("m <> b").select(F.col("m").alias("a"), "b").distinct()
        edges = materialise(small, "links")
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges


# ---- the operator


def _components(fps: DataFrame, distance: int) -> DataFrame:
    """fp, root and component_id of all fingerprints of fps (doc_id, fp), written."""
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least_doc")), "distinct_fingerprints")
    star = stars(links(distinct, distance)).select(F.col("a").alias("root"), F.col("b").alias("fp"))
    member = distinct.join(star, "fp", "left").select("fp", "least_doc", F.coalesce("root", "fp").alias("root"))
    whole = member.groupBy("root").agg(F.min("least_doc").alias("component_id"))
    return materialise(member.join(whole, "root").select("fp", "root", "component_id"), "components")


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 3) -> DataFrame:
    """doc_id, fp, root and component_id for each row of docs (columns doc_id, text; others are ignored).

    fp is the fingerprint's 64 bits as a long. Rows are linked if their fingerprints differ in `distance` bits at
    most; component_id is the least doc_id that can be reached, root the least fingerprint.

    Null and empty texts, and texts of white space, have fingerprint 0 and are linked like any other. Repeated rows
    stay and get the same component. A null doc_id is kept; a component of null ids only has a null component_id.
    An empty table gives no rows. Texts are read whole.
    """
    fps = materialise(fingerprints(docs, width), "fingerprints")
    return fps.join(_components(fps, distance), "fp").select("doc_id", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, width: int = 3, distance: int = 3) -> DataFrame:
    """The rows of docs that stay: of each component the row with the least doc_id (nulls last); of several such rows
    the least one over all columns, once. All columns are kept.

    What decides is found on ids, fingerprints and row hashes. Texts are read for the fingerprints, and once more for
    the rows that stay, which a join by row hash picks; only rows that share their component's least doc_id are
    compared whole. Null and empty texts have fingerprint 0 and are a component like any other. An empty table gives no
    rows. Extra columns may have any name and type.
    """
    own = ["_hash1", "_hash2"]
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(whole, *[h.alias(n) for h, n in zip(row_hashes(docs), own, strict=True)], "doc_id", "text")
    fps = materialise(fingerprints(rows, width, tuple(own)), "fingerprints")
    least = fps.join(_components(fps, distance), "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stay = materialise(least.groupBy("root").agg(F.count("*").alias("n"), *[F.max(h).alias(h) for h in own]), "stay")
    rows = rows.select("_row", *own)
    # the narrow side is built, the texts stream past it: at every size the same join, without a sort of texts
    kept = rows.join(stay.where("n = 1").select(own).hint("shuffle_hash"), own, "left_semi").select("_row")
    if not stay.where("n > 1").isEmpty():
        ties = least.join(stay.where("n > 1").select("root"), "root", "left_semi").select("root", *own).distinct()
        tied = rows.join(ties, own).groupBy("root").agg(F.min_by("_row", F.struct(*comparable(docs, "_row."))).alias("_row"))
        kept = kept.unionByName(tied.select("_row"))
    return kept.select("_row.*")
