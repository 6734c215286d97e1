"""Near-duplicate documents by one-permutation hashing.

Every document's set of word shingles is hashed once.  The hash space is cut
into bins of which each keeps its least value; an empty bin borrows from a
full one by its own random order of bins (optimal densification).  Runs of
bins form bands, and documents that agree on a band share a bucket.  A bucket
of m documents gives the m - 1 edges of a star around its least id, never the
pairs.  Every edge is confirmed on the full sets.

A bucket may mix several groups, or documents that only share a passage.  Its
members that the centre turned down are compared with each other exactly, in
blocks of bounded size, by the product of their membership matrix with itself;
a block gives the edges of a spanning forest of its confirmed links, never the
pairs.  Members that a centre turned down are also compared with all those it
took, in such blocks too.  One minus the similarity is a distance, so only
those turned down that still lie within twice the threshold's distance of the
centre can be linked with one it took; the others are left out there without
loss.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .core import Scratch, arrow_batches, forget, whole_row
from .words import WordHasher, constants, mix, shingle_sets

#: Bins of a signature (a power of two), rows of a band and bands: at a
#: similarity of 0.75 a pair shares no band in one of a million cases.
BINS, ROWS, BANDS = 256, 5, 51
#: Members of a star that are confirmed by one task at most, about.
STAR = 64
#: Members of a block in which documents are compared, about.
BLOCK = 512
#: Shingles of a block, about: a block of long texts has fewer members.
BLOCK_SHINGLES = 1 << 20
SKETCH = "row long, doc_id long, n_shingles long, k1 long, k2 long, bands array<long>"


def probe_order(bins: int = BINS) -> np.ndarray:
    """rank[i, j]: the place of bin j in the order in which bin i looks for a full bin."""
    keys = mix(np.arange(bins * bins, dtype=np.uint64) + np.uint64(77)).reshape(bins, bins)
    return keys.argsort(axis=1).argsort(axis=1)


def signature(values: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The densified signature of a sorted, not empty array of distinct hashes."""
    shift = np.uint64(64 - int(len(rank)).bit_length() + 1)
    bins = (values >> shift).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
    full = bins[first]
    out = np.zeros(len(rank), np.uint64)
    out[full] = values[first]
    if len(full) < len(rank):
        empty = np.setdiff1d(np.arange(len(rank)), full, assume_unique=True)
        out[empty] = values[first][rank[np.ix_(empty, full)].argmin(axis=1)]
    return out


def band_hashes(signatures: np.ndarray, rows: int = ROWS, bands: int = BANDS) -> np.ndarray:
    parts = signatures[:, : rows * bands].reshape(-1, bands, rows)
    return mix((parts * constants(rows, 11)).sum(axis=2, dtype=np.uint64) + constants(bands, 13)).view(np.int64)


def sketches(n: int):
    def run(batches):
        import pyarrow as pa

        forget()
        hasher, rank = WordHasher(), probe_order()
        for batch in batches:
            sets = list(shingle_sets(batch.column(2), n, hasher))
            full = [i for i, s in enumerate(sets) if len(s)]
            bands = band_hashes(np.stack([signature(sets[i], rank) for i in full])) if full else np.zeros((0, BANDS), np.int64)
            sizes = np.zeros(len(sets) + 1, np.int64)
            sizes[np.array(full, np.int64) + 1] = BANDS
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)),
                    pa.array(np.array([np.bitwise_xor.reduce(s) if len(s) else 0 for s in sets], np.uint64).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(sizes.cumsum(), pa.int32()), pa.array(bands.ravel())),
                ],
                names=["row", "doc_id", "n_shingles", "k1", "k2", "bands"],
            )

    return run


def confirm(n: int, percent: int):
    """Rows sorted by star, the centre first; one set is held at a time."""

    def run(batches):
        import pyarrow as pa

        hasher, star, centre = WordHasher(), None, None
        for batch in batches:
            out = ([], [], [], [])
            keys = zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)
            for (c, salt, role, doc), own in zip(keys, shingle_sets(batch.column(4), n, hasher), strict=True):
                if role == 0:
                    star, centre = (c, salt), own
                elif star == (c, salt):
                    both = len(np.intersect1d(centre, own, assume_unique=True))
                    union = len(centre) + len(own) - both
                    row = (c, doc, union > 0 and 100 * both >= percent * union, union > 0 and 100 * both >= (2 * percent - 100) * union)
                    for x, y in zip(out, row, strict=True):
                        x.append(y)
            types = (pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=["c", "d", "ok", "near"])

    return run


def verdicts(edges: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(c, d, ok, near) for each edge, near if d can be linked with a document that c took; wide stars are dealt out in parts, each with its own copy of the centre."""
    wide = edges.groupBy("c").count().where(F.col("count") > STAR).select("c", F.ceil(F.col("count") / STAR).alias("parts"))
    salted = edges.join(wide, "c", "left").select("c", F.pmod(F.xxhash64("d"), F.coalesce("parts", F.lit(1))).alias("salt"), "d")
    rows = salted.select("c", "salt", F.lit(1).alias("role"), "d").union(salted.select("c", "salt").distinct().select("c", "salt", F.lit(0), F.col("c")))
    return (
        rows.join(docs.select(F.col("row").alias("d"), "text"), "d")
        .select("c", "salt", "role", "d", "text")
        .repartition("c", "salt")
        .sortWithinPartitions("c", "salt", "role")
        .mapInArrow(confirm(n, percent), "c long, d long, ok boolean, near boolean")
    )


def set_bytes(n: int):
    """(d, members): the shingle set of each text as little-endian 64-bit integers."""

    def run(batches):
        import pyarrow as pa

        hasher = WordHasher()
        for batch in batches:
            sets = [s.astype("<u8").tobytes() for s in shingle_sets(batch.column(1), n, hasher)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["d", "members"])

    return run


def overlaps(sets: list[np.ndarray], first: int) -> np.ndarray:
    """both[i, j]: how many members the i-th of the first sets shares with set j."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], (np.cumsum(times > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((first, len(sets)), np.float32)
    for low in range(0, int((times > 1).sum()), 4096):
        a, b = np.searchsorted(column, (low, low + 4096))
        part = np.zeros((len(sets), 4096), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        both += part[:first] @ part.T
    return both.astype(np.int64)


def forest(percent: int):
    """The edges (c, d) of a spanning forest over one block's confirmed links.

    Where rows have a column ``taken``, only links between rows that have it
    and rows that don't are looked for.
    """

    def run(table):
        import pyarrow as pa

        ids, first = np.unique(table.column("d").to_numpy(), return_index=True)
        down = len(ids)
        if "taken" in table.column_names:
            taken = np.asarray(table.column("taken").to_pylist(), bool)[first]
            order = np.argsort(taken, kind="stable")
            ids, first, down = ids[order], first[order], int((~taken).sum())
        sets = [np.frombuffer(x, "<u8") for x in table.column("members").take(pa.array(first)).to_pylist()]
        sizes = np.array([len(s) for s in sets], np.int64)
        both = overlaps(sets, down)
        linked = 100 * both >= percent * (sizes[:down, None] + sizes[None, :] - both)
        if down < len(ids):
            across = np.zeros((len(ids), len(ids)), bool)
            across[:down, down:] = linked[:, down:]
            linked = across | across.T
        left, edges = np.ones(len(ids), bool), ([], [])
        for start in range(len(ids)):
            if left[start]:
                left[start] = False
                queue = [start]
                while queue:
                    at = queue.pop()
                    new = np.flatnonzero(linked[at] & left)
                    left[new] = False
                    edges[0].extend([int(ids[at])] * len(new))
                    edges[1].extend(ids[new].tolist())
                    queue.extend(new.tolist())
        return pa.table({"c": pa.array(edges[0], pa.int64()), "d": pa.array(edges[1], pa.int64())})

    return run


def parts_of(sizes: Column, of: Column | None = None) -> Column:
    """In how many blocks the members that ``of`` holds for are dealt, by their count and their shingles."""
    of = F.lit(True) if of is None else of
    members, amount = F.count(F.when(of, 1)), F.coalesce(F.sum(F.when(of, sizes)), F.lit(0))
    return F.least(members, F.greatest(F.ceil(members / BLOCK), F.ceil(amount / BLOCK_SHINGLES))).cast("int")


def taken_or_not(done: DataFrame, docs: DataFrame, sizes: DataFrame, scratch: Scratch, n: int, percent: int) -> DataFrame:
    """Links (c, d) between members that a centre took and near ones that it turned down, in whatever buckets."""
    sides = done.where("ok or near").select(F.col("c").alias("centre"), "d", F.col("ok").alias("taken")).join(sizes, "d")
    parts = sides.groupBy("centre").agg(parts_of(F.col("size"), ~F.col("taken")).alias("down_parts"), parts_of(F.col("size"), F.col("taken")).alias("taken_parts")).where("down_parts > 0 and taken_parts > 0")
    rows = scratch.save(sides.drop("size").join(parts, "centre"), "sides")
    texts = docs.join(rows.select(F.col("d").alias("row")).distinct(), "row", "left_semi").select("row", "text")
    sets = scratch.save(texts.mapInArrow(set_bytes(n), "d long, members binary"), "side_sets")
    own = F.pmod(F.xxhash64("d"), F.when(F.col("taken"), F.col("taken_parts")).otherwise(F.col("down_parts"))).cast("int")
    across = F.explode(F.sequence(F.lit(0), F.when(F.col("taken"), F.col("down_parts")).otherwise(F.col("taken_parts")) - 1))
    dealt = rows.select("centre", "d", "taken", own.alias("own"), across.alias("other"))
    i, j = F.when(F.col("taken"), F.col("other")).otherwise(F.col("own")), F.when(F.col("taken"), F.col("own")).otherwise(F.col("other"))
    dealt = dealt.select("centre", "d", "taken", i.alias("i"), j.alias("j"))
    return dealt.join(sets, "d").groupBy("centre", "i", "j").applyInArrow(forest(percent), "c long, d long")


def turned_down(active: DataFrame, docs: DataFrame, sizes: DataFrame, scratch: Scratch, n: int, percent: int) -> DataFrame:
    """Links (c, d) among the members (hash, d) that their buckets' centres turned down."""
    parts = active.join(sizes, "d").groupBy("hash").agg(parts_of(F.col("size")).alias("parts"), F.count("*").alias("m")).where("m > 1").drop("m")
    own = F.pmod(F.xxhash64("d"), F.col("parts")).cast("int")
    rows = scratch.save(active.join(parts, "hash").select("hash", "d", own.alias("own"), "parts"), "turned_down")
    texts = docs.join(rows.select(F.col("d").alias("row")).distinct(), "row", "left_semi").select("row", "text")
    sets = scratch.save(texts.mapInArrow(set_bytes(n), "d long, members binary"), "sets")
    dealt = rows.select("hash", "d", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    dealt = dealt.select("hash", "d", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return dealt.join(sets, "d").groupBy("hash", "i", "j").applyInArrow(forest(percent), "c long, d long")


def grouped(docs: DataFrame, scratch: Scratch, shingle: int, percent: int) -> DataFrame:
    """(row, doc_id, n_shingles, component_id, first) for rows (row, doc_id, text) of a written table, row being unique.

    ``first`` marks one row of each component: that of the least doc_id, a null
    one last, and of several such the least row.
    """
    all_ = scratch.save(docs.select("row", "doc_id", "text").mapInArrow(sketches(shingle), SKETCH), "sketch")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "row")).alias("least")
    groups = scratch.save(all_.where("n_shingles > 0").groupBy("n_shingles", "k1", "k2").agg(first).withColumn("rep", F.col("least.row")), "groups")
    sizes = groups.select(F.col("rep").alias("d"), F.col("n_shingles").alias("size"))
    members = all_.where("n_shingles > 0").select("row", F.posexplode("bands").alias("band", "hash")).join(groups.select(F.col("rep").alias("row")), "row", "left_semi")
    members = scratch.save(members.select("hash", "row"), "members")
    keys = scratch.save(all_.drop("bands"), "keys")
    centres = members.groupBy("hash").agg(F.min("row").alias("c"), F.count("*").alias("m")).where("m > 1").select("hash", "c")
    stars = scratch.save(members.join(centres, "hash").where("row <> c").select("hash", "c", F.col("row").alias("d")), "stars")
    scratch.drop("members", "sketch")
    done = verdicts(stars.select("c", "d").distinct(), docs, shingle, percent)
    done = scratch.save(done.groupBy("c", "d").agg(F.max("ok").alias("ok"), F.max("near").alias("near")), "verdicts")
    active = scratch.save(stars.join(done.where("not ok"), ["c", "d"], "left_semi").select("hash", "d"), "active")
    scratch.drop("stars")
    more = scratch.save(turned_down(active, docs, sizes, scratch, shingle, percent).distinct(), "more")
    scratch.drop("turned_down", "sets", "active")
    across = scratch.save(taken_or_not(done, docs, sizes, scratch, shingle, percent).distinct(), "across")
    scratch.drop("sides", "side_sets")
    found = components(done.where("ok").select("c", "d").union(more).union(across), scratch, "c", "d")
    scratch.drop("verdicts", "more", "across")
    labelled = groups.join(found, F.col("rep") == F.col("node"), "left").select("n_shingles", "k1", "k2", "least", F.coalesce("component", "rep").alias("label"))
    labelled = scratch.save(labelled, "labelled")
    firsts = labelled.groupBy("label").agg(F.min("least").alias("first"))
    whole = labelled.join(firsts, "label").select("n_shingles", "k1", "k2", F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("first_row"))
    return (
        keys.join(whole, ["n_shingles", "k1", "k2"], "left")
        .select("row", "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce(F.col("row") == F.col("first_row"), F.lit(True)).alias("first"))
    )


def near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs(doc_id, text).

    Documents are linked when 100 * intersection >= percent * union of their
    shingle sets.  A null or blank text has no shingles and is linked with
    nothing; a text of fewer words is one shingle.  Rows with equal sets share
    a component; a repeated row gets one result row each time, and rows that
    share an id but not a text are documents of their own.  A row without id
    links others like any row, but has a null component and is not kept.  No
    rows give no rows.
    """
    arrow_batches(spark)
    scratch = Scratch(spark, "neardup")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = grouped(scratch.save(rows, "rows"), scratch, shingle, percent)
    return found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = 5, percent: int = 75) -> DataFrame:
    """The rows of docs, all columns, of which one of each group of near duplicates stays.

    It is the one of the least doc_id, a null one last; of rows that share that
    id one stays.  Rows without words are no near duplicates and all stay.
    """
    arrow_batches(spark)
    scratch = Scratch(spark, "neardup")
    rows = scratch.save(docs.select(F.monotonically_increasing_id().alias("row"), whole_row(docs).alias("doc")), "rows")
    plain = rows.select("row", F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("doc.text").cast("string").alias("text"))
    found = grouped(plain, scratch, shingle, percent)
    return rows.join(found.where("not first").select("row"), "row", "left_anti").select("doc.*")
