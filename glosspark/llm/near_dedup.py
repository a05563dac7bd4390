"""MinHash near-dedup: a chosen-path set similarity join.

A document's set are its distinct word shingles. Equal sets are one class, so groups of
copies never reach the join. Every class gets paths of `ROOT` minwise tokens, one per tree;
classes with the same path share a node. A pair of similarity s meets in a node of depth d with
probability s^d per tree, and all trees are independent, so `trees` gives as many as keep the
odds that a pair at the least similarity meets in none of them at `MISS` or less.

Candidates are confirmed on the full sets, in rounds that follow the components found so far.
First each class is compared with one leader (random per node), which joins up large groups
with one comparison per member. Then nodes that hold several components are looked at: one
with at most `FEW` pairs across components per member is small and compares them all; a larger
one compares its members with a new leader, and is small if those links make it so. The classes
of the nodes still large go to deeper paths in fresh trees, and as the odds to meet fall with the
depth, the number of trees rises so that `MISS` holds at every depth by itself. Where the trees
would cost more than to compare all these classes with one another, that is done instead. A pair
is thus missed only if it meets in no tree of one of the depths it came to. Only pairs inside a
component already found are left out, so the components are those of the confirmed links.

Before full sets are fetched, pairs are compared by odd sketches: a set's sketch has a bit per
bin, toggled by every member in it. Bits that differ between two sketches are at most the
symmetric difference of the sets, so a pair whose sketches differ too much is no link, for
certain; this drops near misses without reading their texts and loses nothing. The members of a
node are compared in bounded blocks (`BLOCK` members, each with the node's few minor members or
its leader), so a large node is no large task and its pairs never become rows.

Defined cases: without words (or text) a document's set is empty and linked with nothing;
fewer words than a shingle are one shingle; rows with equal doc_id are one document (with
several texts, linked through any of them); a null doc_id is a document per set, its
component_id null unless it reaches a doc_id; equal rows get equal answers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glosspark.llm import packed as P
from glosspark.llm.common import by_rows, checkpointed, mix64, rolling, small_side, word_hashes
from glosspark.llm.components import components, merged

SHINGLE = 3
PERCENT = 85                # least similarity: 100 * intersection >= PERCENT * union
TREES = 16                  # at least
MISS = 1e-6                 # odds that a pair at the least similarity meets in no tree of a depth
ROOT = 3
STEP = 2                    # tokens by which paths of large nodes get longer
FEW = 256
SKETCH_BITS = 1 << 15       # of the longest sketch; a set of n has 4 n to 8 n bits, at least 256
BLOCK = 1024                # members of a node in one block
BUCKET_ROWS = 8192          # rows of blocks in one task's turn
SLICE = 4 << 20
_NO_ID = 1 << 62            # classes without a doc_id are numbered from here

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, shingle: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h, doc, _, size = word_hashes(_LOWER[raw], offsets)
    r = rolling(h, shingle)
    head = np.cumsum(size) - size
    out = []
    for at, n in zip(head, size):
        if n >= shingle:
            out.append(np.unique(r[at:at + n - shingle + 1]))
        else:
            out.append(rolling(h[at:at + n], n) if n else np.zeros(0, np.uint64))
    return out


def trees(percent: int, depth: int) -> int:
    """Independent trees so that a pair of similarity `percent` meets at `depth` in none of them with odds of at most MISS."""
    return max(TREES, math.ceil(math.log(MISS) / math.log1p(-min(percent / 100, 0.999) ** depth)))


def minwise(sets: list[np.ndarray], tokens: int, first: int = 0) -> np.ndarray:
    """(sets, tokens) uint32: for each of `tokens` hash functions, numbered from `first`, the least value in the set."""
    out = np.zeros((len(sets), tokens), np.uint32)
    some = [i for i, s in enumerate(sets) if len(s)]
    if some:
        flat = np.concatenate([sets[i] for i in some])
        at = np.cumsum([0] + [len(sets[i]) for i in some[:-1]])
        factors = mix64(np.arange(first + 1, first + tokens + 1, dtype=np.uint64)) | np.uint64(1)
        for k in range(tokens):
            out[some, k] = np.minimum.reduceat(flat * factors[k], at) >> np.uint64(32)
    return out


def paths(sets: list[np.ndarray], depth: int, number: int) -> pa.Array:
    """For each set its paths of `depth` tokens in `number` trees; no other depth has the same hash functions."""
    sig = minwise(sets, number * depth, (depth - ROOT) << 32)
    return pa.array([[row[k:k + depth].tobytes() for k in range(0, len(row), depth)] for row in sig], pa.list_(pa.binary()))


def _deeper(depth: int, number: int):
    def run(batches):
        for batch in by_rows(batches):
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("items")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([len(s) for s in sets], pa.int64()), paths(sets, depth, number)], names=["node", "n", "paths"])
    return run


def _describe(shingle: int, number: int):
    schema = pa.schema([("did", pa.int64()), ("x", pa.int64()), ("n", pa.int64()), ("g1", pa.int64()), ("g2", pa.int64()), ("paths", pa.list_(pa.binary())), ("sketch", pa.binary())])

    def run(batches):
        for batch in batches:
            raw, off = P.text_parts(batch.column("text"))
            for lo, hi in P.slices(off, SLICE):
                sets = shingle_sets(raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], shingle)
                total = [np.array([mix64(s).sum(dtype=np.uint64), mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)]).view(np.int64) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("did").slice(lo, hi - lo), batch.column("x").slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([t[0] for t in total], pa.int64()), pa.array([t[1] for t in total], pa.int64()),
                     paths(sets, ROOT, number),
                     pa.array([odd_sketch(s) for s in sets], pa.binary())], schema=schema)
    return run


def _set_of(shingle: int):
    def run(batches):
        for batch in batches:
            raw, off = P.text_parts(batch.column("text"))
            for lo, hi in P.slices(off, SLICE):
                sets = shingle_sets(raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], shingle)
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(lo, hi - lo), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "items"])
    return run


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                both = int(np.count_nonzero(q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p))
                ok.append(100 * both >= percent * (len(p) + len(q) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(keep)
    return run


def odd_sketch(items: np.ndarray) -> bytes:
    """Parity of the number of items in each bin; a power of two of bins, following the size."""
    bits = max(256, min(SKETCH_BITS, 1 << (4 * len(items) - 1).bit_length()))
    return np.packbits((np.bincount((items & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def fold(sketches: np.ndarray, words: int) -> np.ndarray:
    """Rows of 64-bit words -> the sketches with fewer bins."""
    while sketches.shape[-1] > words:
        half = sketches.shape[-1] // 2
        sketches = sketches[..., :half] ^ sketches[..., half:]
    return sketches


def differing(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Bits that differ between a sketch and each of `many`: at most the symmetric difference."""
    words = min(one.shape[-1], many.shape[-1])
    return np.bitwise_count(fold(one, words) ^ fold(many, words)).sum(axis=-1, dtype=np.int64)


def _close(percent: int):
    """Keeps pairs (a, b, n, m, x, y) whose sketches x and y leave a link possible."""
    def run(batches):
        for batch in batches:
            least = (100 - percent) * (batch.column("n").to_numpy() + batch.column("m").to_numpy())
            apart = np.array([differing(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64))
                              for x, y in zip(batch.column("x"), batch.column("y"))], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array((100 + percent) * apart <= least))
    return run


def _compare(percent: int):
    """Blocks of nodes (a table sorted here by block) -> the pairs of a probe and a member that lie
    in different components and whose sizes and sketches leave a link possible."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table):
        table = table.combine_chunks()
        block, node, n, label, major = (table.column(c).to_numpy() for c in ("block", "node", "n", "label", "major"))
        few, probe = (table.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("few", "probe"))
        sketch = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("sketch")]
        order = np.argsort(block, kind="stable")
        lefts, rights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for rows in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
            asks, members = rows[probe[rows]], rows[~probe[rows]]
            if not len(asks) or not len(members):
                continue
            widths = np.array([len(sketch[i]) for i in members])
            stacks = {w: (members[widths == w], np.stack([sketch[i] for i in members[widths == w]])) for w in np.unique(widths)}
            for p in asks:
                for w, (of, stack) in stacks.items():
                    if w > 2 * len(sketch[p]) or 2 * w < len(sketch[p]):      # sizes more than a link's apart
                        continue
                    fit = (label[of] != label[p]) & (100 * np.minimum(n[of], n[p]) >= percent * np.maximum(n[of], n[p]))
                    if few[p]:
                        fit &= (label[of] == major[p]) | (node[of] > node[p])
                    at = np.flatnonzero(fit)
                    if len(at):
                        ok = of[at[(100 + percent) * differing(sketch[p], stack[at]) <= (100 - percent) * (n[of[at]] + n[p])]]
                        lefts.append(np.full(len(ok), node[p]))
                        rights.append(node[ok])
        p, q = np.concatenate(lefts), np.concatenate(rights)
        return pa.Table.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], schema=schema)
    return run


class _Join:
    """The classes of one corpus, their trees, and the components found so far."""

    def __init__(self, texts: DataFrame, shingle: int, percent: int):
        self.percent = percent
        described = checkpointed(texts.select("did", "x", "text").mapInArrow(
            _describe(shingle, trees(percent, ROOT)), "did long, x long, n long, g1 long, g2 long, paths array<binary>, sketch binary"))
        self.rows = described.select("did", "x", "n", "g1", "g2")
        classes = described.filter("n > 0").groupBy("g1", "g2").agg(F.min(F.struct("did", "x")).alias("r"), F.first("n").alias("n"),
                                                                      F.first("paths").alias("paths"), F.first("sketch").alias("sketch"))
        no_id = F.lit(_NO_ID) + F.shiftrightunsigned("g1", 2)
        self.classes = checkpointed(classes.select(
            "g1", "g2", "n", "paths", "sketch", F.col("r.did").alias("did"), F.col("r.x").alias("x"),
            F.when(F.col("r.did") == P.LAST_ID, no_id).otherwise(F.col("r.did")).alias("node")))
        self.texts, self.shingle = texts, shingle
        self.labels = self.sets = None

    def similar_size(self, a: str, b: str):
        return F.lit(100) * F.least(a, b) >= F.lit(self.percent) * F.greatest(a, b)

    def level(self, rows: DataFrame, depth: int) -> DataFrame:
        """rows (node, n, paths) -> a row per path that two or more share, with its key and leader."""
        keyed = rows.select("node", "n", F.posexplode("paths").alias("tree", "path")).select("node", "n", F.xxhash64(F.lit(depth), "tree", "path").alias("key"))
        of = (keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct(F.xxhash64("key", "node").alias("r"), "node", "n")).alias("leader"))
              .filter("size > 1").drop("size"))
        return checkpointed(keyed.join(of, "key"))

    def deeper(self, nodes: DataFrame, depth: int, number: int) -> DataFrame:
        """The level of the classes `nodes` at `depth` in `number` fresh trees."""
        of = self.sets.join(small_side(nodes), "node").select("node", "items")
        return self.level(checkpointed(of.mapInArrow(_deeper(depth, number), "node long, n long, paths array<binary>")), depth)

    def load_sets(self, nodes: DataFrame) -> None:
        """Full sets of all classes that share a node with another."""
        wanted = checkpointed(nodes.select("node").distinct().join(self.classes.select("node", "did", "x"), "node"))
        found = self.texts.join(small_side(wanted), ["did", "x"]).select("node", "text")
        found = found.mapInArrow(_set_of(self.shingle), "node long, items binary")
        self.sets = checkpointed(found.dropDuplicates(["node", "items"]))

    def plausible(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sketches leave a link possible."""
        of = self.classes.select("node", "n", "sketch")
        return checkpointed(pairs.join(of.withColumnsRenamed({"node": "a", "sketch": "x"}), "a")
                            .join(of.withColumnsRenamed({"node": "b", "n": "m", "sketch": "y"}), "b")
                            .select("a", "b", "n", "m", "x", "y").mapInArrow(_close(self.percent), "a long, b long"))

    def confirm(self, pairs: DataFrame) -> None:
        """Adds the links among the checkpointed `pairs` (a, b) and the components they make."""
        left = self.sets.withColumnsRenamed({"node": "a", "items": "x"}).join(small_side(pairs), "a")
        asked = checkpointed(pairs.select("b").distinct())
        right = self.sets.withColumnsRenamed({"node": "b", "items": "y"}).join(small_side(asked), "b")
        found = checkpointed(left.join(right, "b").select("a", "b", "x", "y").mapInArrow(_confirm(self.percent), "a long, b long"))
        if found.limit(1).count():
            self.labels = components(found) if self.labels is None else merged(self.labels, found)

    def mixed(self, rows: DataFrame) -> DataFrame:
        """rows in nodes that hold several components, with their label, the label of the node's
        largest component, and whether the pairs across components are few."""
        known = rows.sparkSession.createDataFrame([], "node long, label long") if self.labels is None else self.labels
        got = rows.join(known, "node", "left").withColumn("label", F.coalesce("label", "node"))
        per = got.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
        of = (per.groupBy("key").agg(F.max(F.struct("c", "label")).alias("m"), F.sum("c").cast("double").alias("all"), F.sum(F.pow("c", F.lit(2))).alias("same"),
                                     F.count(F.lit(1)).alias("labels"))
              .filter("labels > 1").select("key", F.col("m.label").alias("major"), F.col("all").cast("long").alias("members"), ((F.col("all") * F.col("all") - F.col("same")) / 2 <= FEW * F.col("all")).alias("few")))
        return checkpointed(got.join(of, "key"))

    def compare(self, rows: DataFrame) -> None:
        """Adds the links among the pairs of `across`."""
        pairs = self.across(rows)
        if pairs.limit(1).count():
            self.confirm(pairs)

    def across(self, rows: DataFrame) -> DataFrame:
        """Plausible pairs across the components of mixed nodes: all of a small one (its minor
        components against every member), each member with the leader in a larger one."""
        blocks = F.ceil(F.col("members") / BLOCK).cast("int")
        rows = rows.select("key", "node", "n", "label", "major", "few", blocks.alias("blocks"),
                           F.when(F.col("few"), F.col("label") != F.col("major")).otherwise(F.col("node") == F.col("leader.node")).alias("asks"))
        rows = checkpointed(rows.join(self.classes.select("node", "sketch"), "node"))
        cols = ["node", "n", "label", "major", "few", "sketch"]
        members = rows.select("key", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("salt"), F.lit(False).alias("probe"), *cols)
        probes = rows.filter("asks").select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("salt"), F.lit(True).alias("probe"), *cols)
        block = F.xxhash64("key", "salt")
        total = rows.agg(F.sum(1 + F.when(F.col("asks"), F.col("blocks")).otherwise(0)).alias("s")).first()["s"] or 0
        buckets = P.bucket_count(total, BUCKET_ROWS, rows.sparkSession)
        dealt = members.unionByName(probes).select(F.pmod(block, F.lit(buckets)).alias("bucket"), block.alias("block"), "probe", *cols)
        return checkpointed(dealt.groupBy("bucket").applyInArrow(_compare(self.percent), "a long, b long").distinct())


def _links(texts: DataFrame, shingle: int, percent: int) -> _Join:
    j = _Join(texts, shingle, percent)
    at, depth = j.level(j.classes.select("node", "n", "paths"), ROOT), ROOT
    if at.limit(1).count() == 0:
        return j
    j.load_sets(at)

    # each class with one leader, the one it meets most often
    met = at.filter("node <> leader.node").filter(j.similar_size("n", "leader.n")).groupBy("node", F.col("leader.node").alias("other")).count()
    best = met.groupBy("node").agg(F.max(F.struct("count", "other")).alias("m"))
    j.confirm(j.plausible(checkpointed(best.select(F.col("node").alias("a"), F.col("m.other").alias("b")))))

    while True:
        at = j.mixed(at)
        j.compare(at)
        while True:                 # the links found make some of the large nodes small
            large = at.filter("not few").select("key", "node", "n", "leader")
            if large.limit(1).count() == 0:
                return j
            at = j.mixed(large)
            turned = at.filter("few")
            if turned.limit(1).count() == 0:
                break
            j.compare(turned)
        left = checkpointed(at.select("node").distinct())
        number = trees(percent, depth + STEP)
        if left.count() <= 2 * FEW * number:
            whole = j.classes.join(small_side(left), "node").select(F.lit(0).cast("long").alias("key"), "node", "n", F.struct(F.lit(0).cast("long").alias("r"), "node", "n").alias("leader"))
            j.compare(j.mixed(whole).withColumn("few", F.lit(True)))
            return j
        depth += STEP
        at = j.deeper(left, depth, number)


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(id, x, n_shingles, component_id, kept) per row; x is a hash of the text. `kept` holds for
    one document of each component: the one whose doc_id names it or, where no member has a
    doc_id, the first of its first class."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(P.LAST_ID)).alias("did"), F.xxhash64(text).alias("x"), text.alias("text"))
    j = _links(texts, shingle, percent)
    found = j.classes.select("g1", "g2", "node", F.col("x").alias("first_x"))
    if j.labels is not None:
        found = found.join(j.labels, "node", "left")
    else:
        found = found.withColumn("label", F.lit(None).cast("long"))
    found = found.select("g1", "g2", "node", "first_x", F.coalesce("label", "node").alias("label"))
    rows = j.rows.join(found, ["g1", "g2"], "left")
    alone = F.col("n") == 0
    comp = F.when(alone, F.col("did")).otherwise(F.col("label"))
    kept = F.when(alone, F.lit(True)).when(comp < _NO_ID, F.col("did") == comp).otherwise((F.col("node") == comp) & (F.col("x") == F.col("first_x")))
    no_id = (F.col("did") == P.LAST_ID)
    return rows.select(F.when(no_id, F.lit(None).cast("long")).otherwise(F.col("did")).alias("id"), "x", F.col("n").alias("n_shingles"),
                       F.when(comp >= _NO_ID, F.lit(None).cast("long")).otherwise(comp).alias("component_id"), kept.alias("kept"))
