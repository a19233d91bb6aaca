"""N-gram Jaccard join with Bayesian candidate pruning.

Documents with the same set of word shingles form one class and are compared once. MinHash bands
bring classes together; within a bucket, signatures are compared a few values at a time and a pair
is dropped as soon as the posterior probability that its similarity reaches the threshold falls
below a tolerance. Survivors are verified by exact intersections of their shingle sets.

Nothing quadratic is ever written: a bucket sends on a spanning forest of its survivors, and the
verification, in blocks of bounded size, sends on one row per member with its number of links.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportlake.llm.common import attach, stored, table
from reportlake.llm.textmap import joined_hashes, mix, slices, text_bytes, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
#: A pair at the threshold shares no band with probability (1 - 0.8 ** ROWS) ** BANDS = 3e-6.
BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
#: MinHash values compared at a time, and the posterior below which a pair is dropped.
STEP, TOLERANCE = 8, 1e-6
#: Members of a block of signatures; shingles of a block of sets.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Columns of one piece of an incidence matrix.
PIECE = 2048
#: Classes that are broadcast to read their documents again; beyond, Spark joins by shuffle.
BROADCAST_ROWS = 200_000

_FACTORS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
_ADDED = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def required_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, hashes: int = HASHES) -> np.ndarray:
    """For n compared values, the fewest matches with which a pair stays.

    With a uniform prior, P(similarity >= t | m of n match) is the probability that of n + 1 draws
    with chance t at most m succeed.
    """
    need = np.zeros(hashes + 1, dtype=np.int64)
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, hashes + 2)))])
    for n in range(1, hashes + 1):
        m = np.arange(n + 2)
        each = logs[n + 1] - logs[m] - logs[n + 1 - m] + m * np.log(threshold) + (n + 1 - m) * np.log1p(-threshold)
        need[n] = np.searchsorted(np.cumsum(np.exp(each)), tolerance)
    return need


def survivors(left: np.ndarray, right: np.ndarray | None, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two signature blocks (of one block, if right is None) that are not dropped."""
    if right is None:
        i, j = np.triu_indices(len(left), 1)
        right = left
    else:
        i, j = (x.ravel() for x in np.indices((len(left), len(right))))
    matches = np.zeros(len(i), dtype=np.int64)
    for at in range(0, left.shape[1], STEP):
        matches += (left[i, at : at + STEP] == right[j, at : at + STEP]).sum(axis=1)
        stay = matches >= need[min(at + STEP, left.shape[1])]
        i, j, matches = i[stay], j[stay], matches[stay]
        if not len(i):
            break
    return i, j


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each member's component."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        root = root[root]
        if (root == before).all():
            break
    while (root != root[root]).any():
        root = root[root]
    return root


def shared_counts(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of all intersections of sorted sets, as products of incidence matrices in pieces."""
    both = left if right is None else [*left, *right]
    values, times = np.unique(np.concatenate(both), return_counts=True)
    if right is None:
        common = values[times > 1]
    else:
        common = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        every = np.concatenate(sets)
        at = np.minimum(np.searchsorted(common, every), max(len(common) - 1, 0))
        ok = common[at] == every if len(common) else np.zeros(len(every), bool)
        order = np.argsort(at[ok], kind="stable")
        return row[ok][order], at[ok][order]

    a = places(left)
    b = a if right is None else places(right)
    n, m = len(left), len(left if right is None else right)
    out = np.zeros((n, m), dtype=np.float32)
    for begin in range(0, len(common), PIECE):
        pieces = []
        for (row, at), size in ((a, n), (b, m)):
            lo, hi = np.searchsorted(at, (begin, begin + PIECE))
            piece = np.zeros((size, min(PIECE, len(common) - begin)), dtype=np.float32)
            piece[row[lo:hi], at[lo:hi] - begin] = 1
            pieces.append(piece)
        out += pieces[0] @ pieces[1].T
    return out


def verified(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose exact Jaccard similarity is at least the threshold."""
    shared = shared_counts(left, right).astype(np.float64)
    n, m = (np.array([len(s) for s in x], dtype=float) for x in (left, left if right is None else right))
    # whole numbers on both sides, so a similarity of exactly the threshold counts
    enough = shared * (1 + threshold) >= threshold * (n[:, None] + m[None, :]) - 1e-9
    return np.nonzero(np.triu(enough, 1) if right is None else enough)


def grouped(df: DataFrame, keys: list[str], function: Callable, schema: str) -> DataFrame:
    """``function`` of every group's rows (a Table), one group at a time; keys are bigints."""

    def run(batches):
        held, current = [], None

        def done():
            return function(current, pa.Table.from_batches(held))

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys], axis=1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(key)]):
                this = tuple(key[a].tolist())
                if this != current and held:
                    yield from done()
                    held = []
                current = this
                held.append(batch.slice(a, b - a))
        if held:
            yield from done()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _sets(column: pa.Array, size: int) -> list[np.ndarray]:
    raw, ends = text_bytes(column)
    hashes, bounds = joined_hashes(*word_hashes(raw, ends), size)
    return [np.unique(hashes[a:b]) for a, b in zip(bounds, bounds[1:])]


def _sketches(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Per row: number, id, text hash, number of shingles, two hashes of their set, signature."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"),
        F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("key"),
        F.col(text_col).alias("text"),
    )

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = _sets(part.column(3), size)
                n = np.array([len(s) for s in sets])
                every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                full = np.flatnonzero(n)
                begins = (np.cumsum(n) - n)[full]
                signature = np.zeros((len(sets), HASHES), dtype="<u4")
                one, two = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                if len(full):
                    one[full] = np.add.reduceat(mix(every), begins)
                    two[full] = np.add.reduceat(mix(every ^ np.uint64(0x5851F42D4C957F2D)), begins)
                    for h in range(HASHES):
                        value = (every * _FACTORS[h] + _ADDED[h]) >> np.uint64(32)
                        signature[full, h] = np.minimum.reduceat(value, begins)
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:3], pa.array(n, pa.int64()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
                        pa.array([s.tobytes() for s in signature], pa.binary()),
                    ],
                    ["row", "id", "key", "n", "one", "two", "signature"],
                )

    id_type = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"row bigint, id {id_type}, key bigint, n bigint, one bigint, two bigint, signature binary")


def components(edges: DataFrame) -> DataFrame:
    """For every node of ``edges`` (a, b: bigint) the least node of its component: node, root.

    Each round joins every node to its least neighbour and contracts the graph, so the number of
    edges falls quickly; rounds are stored in the shared folder and nothing reaches the driver but
    counts.
    """
    edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    ends = edges.select(F.explode(F.array("a", "b")).alias("node"))
    found = stored(ends.distinct().withColumn("root", F.col("node")), "roots")
    while edges.limit(1).count():
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("up"))
        parent = stored(parent, "parents")
        # a parent that is joined to another node itself: two steps at once
        above = parent.select(F.col("a").alias("up"), F.col("up").alias("above"))
        parent = stored(parent.join(above, "up", "left").select("a", F.coalesce("above", "up").alias("up")), "parents")
        low, high = (parent.select(F.col("a").alias(c), F.col("up").alias(f"up_{c}")) for c in ("a", "b"))
        found = stored(
            found.join(parent.withColumnRenamed("a", "root"), "root", "left").select("node", F.coalesce("up", "root").alias("root")),
            "roots",
        )
        moved = edges.join(low, "a").join(high, "b").select(F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b"))
        edges = stored(moved.where("a <> b").distinct(), "edges")
    return found


def _blocked(df: DataFrame, count, keys: list[str]) -> DataFrame:
    """Every member once for each pair of blocks that its block is in: ``i`` <= ``j``, ``blk``."""
    blocks = F.greatest(F.lit(1), F.ceil(count)).cast("long")
    out = df.withColumn("blocks", blocks).withColumn("blk", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    out = out.withColumn("other", F.explode_outer(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return out.select(*[c for c in out.columns if c not in ("blocks", "other")], F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"))


def _candidate_edges(reps: DataFrame) -> DataFrame:
    """A spanning forest of the pairs that share a band and survive the pruning."""
    width = 4 * ROWS
    keys = F.array(*[F.xxhash64(F.substring("signature", 1 + b * width, width), F.lit(b)) for b in range(BANDS)])
    members = stored(reps.select("rep", F.explode(keys).alias("band")), "bands")
    buckets = members.groupBy("band").agg(
        F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y")
    )
    # documents that are alike meet in many bands: buckets of the same members are looked at once
    buckets = stored(buckets.where("size > 1").groupBy("size", "x", "y").agg(F.min("band").alias("band")).drop("x", "y"), "buckets")
    total = members.count()
    met = attach(members, buckets, ["band"], "size", total)
    met = _blocked(met, F.col("size") / BLOCK, ["band"]).select("band", "i", "j", "rep", "blk")
    met = met.join(reps.select("rep", "signature"), "rep")
    need = required_matches()

    def run(key, rows):
        rep = rows.column("rep").to_numpy()
        order = np.argsort(rep, kind="stable")
        rep = rep[order]
        signs = np.frombuffer(b"".join(rows.column("signature").to_pylist()), dtype="<u4").reshape(len(rep), HASHES)[order]
        if key[1] == key[2]:
            i, j = survivors(signs, None, need)
        else:
            block = rows.column("blk").to_numpy()[order]
            left, right = np.flatnonzero(block == key[1]), np.flatnonzero(block == key[2])
            i, j = survivors(signs[left], signs[right], need)
            i, j = left[i], right[j]
        root = roots(len(rep), i, j)
        joined = np.flatnonzero(root != np.arange(len(rep)))
        yield pa.RecordBatch.from_arrays([pa.array(rep[joined]), pa.array(rep[root[joined]])], ["a", "b"])

    return grouped(met, ["band", "i", "j"], run, "a bigint, b bigint")


def _verified(docs, reps, found, id_col, text_col, size, threshold) -> DataFrame:
    """Per member and pair of blocks: the documents it is linked to there, and the least member linked."""
    whole = reps.join(found.select(F.col("node").alias("rep"), "root"), "rep")
    sums = whole.groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"))
    n = whole.count()
    whole = stored(attach(whole.select("rep", "id", "key", "size", "root"), sums, ["root"], "members", n), "members")
    wanted = whole.select("rep", F.col("id").alias("wid"), F.col("key").alias("wkey"))
    wanted = F.broadcast(wanted) if n <= BROADCAST_ROWS else wanted
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("key"), F.col(text_col).alias("text"))
    texts = texts.join(wanted, texts["id"].eqNullSafe(F.col("wid")) & (texts["key"] == F.col("wkey"))).select("rep", "text")

    def shingles(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [s.tobytes() for s in _sets(part.column(1), size)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["rep", "set"])

    sets = stored(texts.mapInArrow(shingles, "rep bigint, set binary"), "sets").dropDuplicates(["rep"])
    blocks = F.greatest(F.col("members") / (2 * BLOCK), F.col("shingles") / BLOCK_SHINGLES)
    met = _blocked(whole.select("rep", "size", "root", "members", "shingles").join(sets, "rep"), blocks, ["root"])
    met = met.select("root", "i", "j", "rep", "blk", "size", "set")

    def run(key, rows):
        rep, weight, block = (rows.column(c).to_numpy() for c in ("rep", "size", "blk"))
        order = np.argsort(rep, kind="stable")
        rep, weight, block = rep[order], weight[order], block[order]
        raw = rows.column("set").to_pylist()
        own = [np.frombuffer(raw[k], dtype=np.uint64) for k in order]
        links = np.zeros(len(rep), dtype=np.int64)
        if key[1] == key[2]:
            i, j = verified(own, None, threshold)
        else:
            left, right = np.flatnonzero(block == key[1]), np.flatnonzero(block == key[2])
            if not len(left) or not len(right):
                return
            i, j = verified([own[k] for k in left], [own[k] for k in right], threshold)
            i, j = left[i], right[j]
        np.add.at(links, i, weight[j])
        np.add.at(links, j, weight[i])
        root = roots(len(rep), i, j)
        yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(links), pa.array(rep[root])], ["rep", "links", "low"])

    return stored(grouped(met, ["root", "i", "j"], run, "rep bigint, links bigint, low bigint"), "links")


def _classes(docs: DataFrame, id_col: str, text_col: str, size: int, threshold: float) -> DataFrame:
    """Per row: id, key, row, root (number of its class), class_id, rep_id, n_same, n_links."""
    rows = stored(_sketches(docs, id_col, text_col, size), "sketches")
    total = rows.count()
    sets = rows.where("n > 0").groupBy("one", "two").agg(
        F.count(F.lit(1)).alias("size"), F.min(F.struct("id", "row", "key", "n", "signature")).alias("first")
    )
    reps = stored(
        sets.select("one", "two", "size", F.col("first.row").alias("rep"), "first.id", "first.key", "first.n", "first.signature"),
        "reps",
    )
    found = components(_candidate_edges(reps))
    links = _verified(docs, reps, found, id_col, text_col, size, threshold)
    classes = components(links.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    counted = links.groupBy("rep").agg(F.sum("links").alias("links"))
    named = reps.select("one", "two", "size", "rep", "id").join(counted, "rep", "left")
    named = named.join(classes.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    least = named.groupBy("root").agg(F.min(F.struct("id", "rep")).alias("least"))
    named = stored(
        named.join(least, "root").select(
            "one", "two", "size", F.col("least.rep").alias("root"), F.col("least.id").alias("class_id"), F.col("id").alias("rep_id"),
            (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        ),
        "classes",
    )
    met = attach(rows.where("n > 0").select("id", "key", "row", "one", "two"), named, ["one", "two"], "size", total)
    one = F.lit(1).cast("long")
    alone = rows.where("n = 0").select(
        "id", "key", "row", F.col("row").alias("root"), F.col("id").alias("class_id"), F.col("id").alias("rep_id"),
        one.alias("n_same"), (one - 1).alias("n_links"),
    )
    return met.withColumnRenamed("size", "n_same").select(alone.columns).unionByName(alone)


def near_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, threshold: float = THRESHOLD
) -> DataFrame:
    """Per row: id, class_id, rep_id, n_same and n_links.

    Words are runs of 0-9, a-z and characters beyond ASCII, A-Z lower-cased; a text's shingles are
    its runs of ``size`` words, or all its words if there are fewer. Two documents are linked when
    the Jaccard similarity of their shingle sets is at least ``threshold``. class_id is the least id
    of the documents connected by links, rep_id the least id with the same shingle set, n_same the
    number of rows with that set, and n_links the number of other rows this one is linked to.

    Null, empty and wordless texts are linked to nothing; repeated rows are linked to each other;
    a null id is less than any other. Only id and text are read.
    """
    found = _classes(docs, id_col, text_col, size, threshold)
    return found.select(F.col("id").alias(id_col), "class_id", "rep_id", "n_same", "n_links")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows, with all their columns, less all but one of each class of near duplicates.

    The one with the least id stays. Rows with the same id and text stay or go together.
    """
    found = _classes(docs, id_col, text_col, **{"size": SHINGLE, "threshold": THRESHOLD, **options})
    gone = stored(found.where("row <> root").select("id", "key", "root"), "gone")
    kept = found.where("row = root").select(F.col("id").alias("kid"), F.col("key").alias("kkey"))
    gone = gone.select(F.col("id").alias("__gid"), F.col("key").alias("__gkey")).distinct()
    gone = gone.join(kept, F.col("__gid").eqNullSafe(F.col("kid")) & (F.col("__gkey") == F.col("kkey")), "left_anti")
    key = F.coalesce(F.xxhash64(docs[text_col]), F.lit(0))
    return docs.join(gone, docs[id_col].eqNullSafe(F.col("__gid")) & (key == F.col("__gkey")), "left_anti")


def op3_near_join(spark, sf_dir):
    return near_classes(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE
d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS r, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i : i + 4], ' ') AS g
      FROM (SELECT r, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n, string_agg(g, '|' ORDER BY g) AS body FROM s GROUP BY r),
pairs AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE c * 1.8 >= 0.8 * (x.n + y.n) - 1e-9),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a),
least AS (SELECT a AS r, min(b) AS low FROM reach GROUP BY a),
counted AS (SELECT a AS r, count(*) AS n_links FROM ways GROUP BY a),
same AS (SELECT body, min(r) AS low, count(*) AS n FROM n GROUP BY body)
SELECT d.doc_id, c.doc_id AS class_id, coalesce(p.doc_id, d.doc_id) AS rep_id, coalesce(same.n, 1) AS n_same,
       coalesce(n_links, 0) AS n_links
FROM d JOIN least USING (r) JOIN d c ON c.r = least.low LEFT JOIN counted ON counted.r = d.r
LEFT JOIN n ON n.r = d.r LEFT JOIN same USING (body) LEFT JOIN d p ON p.r = same.low
"""
