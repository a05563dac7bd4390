"""N-gram Jaccard join by universe partition and the pigeonhole principle (exact).

A document's set are its distinct word shingles, as hashes. Equal sets are one class, so copies
never reach the join. Two sets of a and b shingles are links if they differ in at most
H = floor((a + b) * (100 - percent) / (100 + percent)) shingles.

*Segments.* Classes are put into size bands. A band has a scheme: the universe of hashes is cut
into M equal ranges, so a set falls into M segments. A set is indexed under its own band's scheme,
and probes that and the schemes of smaller bands that hold partners, as the larger of a pair. A
segment's key is the sum of its mixed hashes, so leaving one shingle out is a subtraction.

*Leaders.* Members of a key are first compared with one leader, the same one across the keys of a
family, which joins large families by one comparison per member. Keys whose members are all in
one component are done.

*Allocation.* A probe spends units on its segments: one unit finds the partners whose segment is
equal, two units also those whose segment has one shingle more or less (one-deletion
neighbourhoods, indexed in bands of up to `DELETION_SIZE`). If it spends H + 1 units, every
partner is found: H differences cannot use up all of them. A unit costs the indexed sets of other
components that it meets. Segments that meet none cost nothing, so most sets need no probe at all;
the other units go to the cheapest segments, which leaves out what very many share. A set whose
non-empty segments cannot take H + 1 units (rare) meets all sets of that scheme instead.

*Verification.* The members outside a key's largest component (or its probes, where these are fewer) are
compared with all of the key, in blocks of bounded size, by odd sketches: bits that differ are at most the
symmetric difference, so what they rule out is certainly no link. What is left is compared by the sets of hashes in
the same task, which goes on only across components that its links leave apart, so pairs never become rows and a task
gives fewer links than it has sets. Those links are compared word by word on the texts themselves. Only pairs inside
one component are left out, so components are those of all links.

Equality of sets rests on 128 bits of keyed sums of 64-bit shingle hashes made from BLAKE2b of the words;
links between different sets are confirmed on the words.

Defined cases: without words (or text) a set is empty and linked with nothing; fewer words than a
shingle are one shingle; rows with equal doc_id are one document, linked through any of its texts;
a null doc_id is a document per set, its component_id null unless it reaches a doc_id; other columns are
not read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosspark.llm import packed as P
from glosspark.llm.common import by_rows, checkpointed, mix64, rolling, small_side, word_hashes
from glosspark.llm.components import components, merged
from glosspark.llm.words import LOWER

SHINGLE, PERCENT = 5, 80
SLICE = 4 << 20
BAND = 1.5                  # largest size of a band by its smallest, about
SLACK = 1.25                # segments by the units that the largest sets need
DELETION_SIZE = 64          # bands up to this size index one-deletion neighbourhoods
KEYS = 500_000              # keys in one task's turn, about
PART_BYTES = 16 << 20       # hashes of a family's members, and of its asking sets, in one block, about
STARS = 6                   # rounds of comparisons with leaders, at most
_NO_ID = 1 << 62            # classes without a doc_id are numbered from here
EQUAL, LESS = 0, 1          # a key of a whole segment, of one without a shingle


# --- schemes ------------------------------------------------------------------

def reach(a, b, percent: int):
    """Most shingles in which linked sets of a and b can differ."""
    return (a + b) * (100 - percent) // (100 + percent)


def least_partner(n, percent: int):
    """Size of the smallest set that a set of n can be linked to."""
    return -(-n * percent // 100)


def bands(percent: int, largest: int = 1 << 40) -> list[tuple[int, int, int]]:
    """(smallest size, largest size, segments) of each band. Sets below the first are linked to equal ones only."""
    low = next(n for n in range(1, 10_000) if least_partner(n + 1, percent) <= n) if percent < 100 else 10_000
    out = []
    while low <= largest:
        high = max(low, int(BAND * low))
        units = reach(high, 100 * high // percent, percent) + 1
        if high <= DELETION_SIZE:
            segments = max(2, -(-units * 2 // 3))       # most take two units
        else:
            segments = int(SLACK * units) + 1
        out.append((low, high, segments))
        low = high + 1
    return out


def shingle_hashes(raw: np.ndarray, offsets: np.ndarray, shingle: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, spread evenly over 64 bits."""
    h, _, _, size = word_hashes(LOWER[raw], offsets)
    r = rolling(h, shingle)
    head = np.cumsum(size) - size
    return [np.unique(r[at:at + n - shingle + 1]) if n >= shingle else rolling(h[at:at + n], n) if n else np.zeros(0, np.uint64) for at, n in zip(head, size)]


def sketch(items: np.ndarray) -> bytes:
    """Parity of the number of items per bin; a set of n has n to 2 n bins, 64 at least."""
    bits = max(64, 1 << (len(items) - 1).bit_length())
    return np.packbits((np.bincount((items & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def apart(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Least symmetric difference that the sketches leave between one set and each of many."""
    words = min(one.shape[-1], many.shape[-1])

    def fold(x):
        while x.shape[-1] > words:
            half = x.shape[-1] // 2
            x = x[..., :half] ^ x[..., half:]
        return x
    return np.bitwise_count(fold(one) ^ fold(many)).sum(axis=-1, dtype=np.int64)


def _describe(shingle: int):
    schema = pa.schema([("did", pa.int64()), ("x", pa.int64()), ("n", pa.int64()), ("g1", pa.int64()), ("g2", pa.int64()), ("sketch", pa.binary())])

    def run(batches):
        for batch in by_rows(batches):
            raw, off = P.text_parts(batch.column("text"))
            for lo, hi in P.slices(off, SLICE):
                sets = shingle_hashes(raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], shingle)
                g = [np.array([mix64(s ^ np.uint64(k)).sum(dtype=np.uint64) for k in (1, 0x5851F42D4C957F2D)]).view(np.int64) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("did").slice(lo, hi - lo), batch.column("x").slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([t[0] for t in g], pa.int64()), pa.array([t[1] for t in g], pa.int64()), pa.array([sketch(s) if len(s) else None for s in sets], pa.binary())], schema=schema)
    return run


# --- keys ------------------------------------------------------------------------

def segment_keys(items: np.ndarray, scheme: int, segments: int, deletions: bool):
    """(key, segment, kind) of a set under a scheme. Without deletions, empty segments are left out."""
    mixed = mix64(items)
    seg = ((items >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)
    at = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
    total = np.zeros(segments, np.uint64)
    total[seg[at]] = np.add.reduceat(mixed, at)
    tag = mix64(np.uint64(scheme << 32) + np.arange(segments, dtype=np.uint64))
    places = np.arange(segments) if deletions else seg[at]
    keys = mix64(total[places] ^ tag[places])
    if not deletions:
        return keys, places, np.zeros(len(keys), np.int64)
    less = mix64((total[seg] - mixed) ^ tag[seg])
    return np.concatenate((keys, less)), np.concatenate((places, seg)), np.repeat([EQUAL, LESS], [len(keys), len(less)])


def _keys(shingle: int, percent: int, buckets: int):
    """Class texts -> blocks of keys, dealt by key. `tie` is the number of segments with a key and the scheme, `pos` the
    segment, the kind and whether the set is indexed there (else it only probes)."""
    plan = bands(percent)
    lows = np.array([b[0] for b in plan])

    def run(batches):
        for batch in by_rows(batches):
            raw, off = P.text_parts(batch.column("text"))
            node = batch.column("node").to_numpy()
            for lo, hi in P.slices(off, SLICE):
                did, tie, doc, pos, h = [], [], [], [], []
                for i, s in enumerate(shingle_hashes(raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], shingle)):
                    own = scheme = int(np.searchsorted(lows, len(s), "right")) - 1
                    while scheme >= 0 and plan[scheme][1] >= least_partner(len(s), percent):
                        _, high, segments = plan[scheme]
                        k, seg, kind = segment_keys(s, scheme, segments, high <= DELETION_SIZE)
                        where = (seg << 2) | (kind << 1) | int(scheme == own)
                        order = np.argsort(where, kind="stable")
                        doc.append(np.full(len(k), len(did)))
                        did.append(node[lo + i])
                        tie.append((int((kind == EQUAL).sum()) << 8) | scheme)
                        pos.append(where[order])
                        h.append(k[order])
                        scheme -= 1
                if did:
                    yield P.table(P.blocks(0, buckets, np.array(did, np.int64), np.array(tie, np.int64), np.concatenate(doc), np.concatenate(pos), np.concatenate(h)), P.BLOCK_ARROW)
    return run


SHARED = "node long, tie long, pos long, key long, leader long"
_SHARED = pa.schema([(c, pa.int64()) for c in ("node", "tie", "pos", "key", "leader")])


def _shared(group: pa.Table) -> pa.Table:
    """All keys of a bucket -> the rows of keys that an indexed and another set have. The leader is the indexed set with the least hash."""
    node, tie, pos, h, _, _ = P.unblock(group.to_pylist(), np.uint64)
    order = np.lexsort((mix64(node.view(np.uint64)), 1 - (pos & 1), h))
    h, node, tie, pos = h[order], node[order], tie[order], pos[order]
    at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    size = np.diff(np.append(at, len(h)))
    several = np.repeat((size > 1) & (pos[at] & 1 == 1), size)
    leader = np.repeat(node[at], size)
    return pa.Table.from_arrays([pa.array(c[several]) for c in (node, tie, pos, h.view(np.int64), leader)], schema=_SHARED)


# --- allocation --------------------------------------------------------------------

def allocate(units: int, offers: list) -> tuple[set, set] | None:
    """Cheapest way to spend `units` on offers (segment, cost of the first unit, cost of the second or None), as
    (segments with a unit, segments with two), or None where they cannot take so many."""
    every = sorted([(c, 0, s) for s, c, _ in offers] + [(max(c, d), 1, s) for s, c, d in offers if d is not None])
    if len(every) < units:
        return None
    one, two = set(), set()
    for _, second, s in every[:units]:
        (two if second else one).add(s)
    return one, two


_PROBES = pa.schema([("node", pa.int64()), ("key", pa.int64()), ("scheme", pa.int32())])


def _choose(percent: int):
    """(node, n, tie, rows of (pos, key, equal, less)) -> (node, key, scheme): the keys a set probes. `equal` and `less` count the
    indexed sets of other components with that key, by their kind. The key is null where a set cannot spend its units."""
    plan = bands(percent)

    def run(batches):
        for batch in batches:
            n, tie, node = (batch.column(c).to_numpy() for c in ("n", "tie", "node"))
            scheme = tie & 255
            high = np.array([plan[k][1] for k in scheme], np.int64)
            units = reach(n, np.minimum(n, high), percent) + 1
            rows = batch.column("rows")
            flat = rows.flatten()
            pos, key, equal, less = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("pos", "key", "equal", "less"))
            start = np.concatenate(([0], np.cumsum(rows.value_lengths().to_numpy())))
            of = np.repeat(np.arange(len(n)), np.diff(start))
            small = high <= DELETION_SIZE
            # sets without deletions: the cheapest segments beyond the free ones
            need = units - ((tie >> 8) - np.diff(start))
            order = np.lexsort((equal, of))
            rank = np.empty(len(of), np.int64)
            rank[order] = np.arange(len(of)) - start[of[order]]
            take = ~small[of] & (rank < need[of]) & (equal > 0)
            lost = np.flatnonzero(~small & (units > tie >> 8))
            for i in np.flatnonzero(small):
                lo, hi = start[i], start[i + 1]
                cost = {s: [0, 0] for s in range(plan[scheme[i]][2])}
                for p, a, b in zip(pos[lo:hi].tolist(), equal[lo:hi].tolist(), less[lo:hi].tolist()):
                    c = cost[p >> 2]
                    if (p >> 1) & 1:
                        c[1] += a
                    else:
                        c[0], c[1] = a, c[1] + b
                one, two = allocate(int(units[i]), [(s, c, d) for s, (c, d) in cost.items()])
                for j in range(lo, hi):
                    s, kind = pos[j] >> 2, (pos[j] >> 1) & 1
                    take[j] = s in two if kind == LESS else s in one
            got = np.flatnonzero(take)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((node[of[got]], node[lost]))), pa.array(list(key[got]) + [None] * len(lost), pa.int64()),
                                              pa.array(np.concatenate((scheme[of[got]], scheme[lost])).astype(np.int32))], schema=_PROBES)
    return run


# --- comparing -------------------------------------------------------------------------

_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("least", pa.int64())])


def _plausible(percent: int):
    """Pairs (a, b, n, m, x, y) -> those whose sketches x and y leave a link possible, with the least difference."""
    def run(batches):
        for batch in batches:
            far = np.array([apart(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(batch.column("x"), batch.column("y"))], np.int64)
            ok = far <= reach(batch.column("n").to_numpy(), batch.column("m").to_numpy(), percent)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(far)], schema=_PAIR).filter(pa.array(ok))
    return run


def _items(shingle: int):
    """Class texts -> (node, items): the sorted distinct shingle hashes."""
    def run(batches):
        for batch in by_rows(batches):
            raw, off = P.text_parts(batch.column("text"))
            for lo, hi in P.slices(off, SLICE):
                sets = shingle_hashes(raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], shingle)
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(lo, hi - lo), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "items"])
    return run


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _compare(percent: int, rejected: frozenset = frozenset()):
    """Blocks of families: rows (key, node, label), members (`probe` false) and asking sets, and the sets (node, items) -> links
    that join the components of every asking set and member of a common key that are linked: fewer than there are components.
    Pairs in `rejected` are none."""
    def run(table: pa.Table, sets: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        key, node = (table.column(c).to_numpy() for c in ("key", "node"))
        probe = table.column("probe").to_numpy(zero_copy_only=False).astype(bool)
        of_set = {k: i for i, k in enumerate(sets.column("node").to_pylist())}
        items = [np.frombuffer(x.as_buffer(), np.uint64) for x in sets.column("items")]
        sketches = [np.frombuffer(sketch(x), np.uint64) for x in items]
        at = np.array([of_set[k] for k in node.tolist()], np.int64)
        n, width = np.array([len(x) for x in items], np.int64), np.array([len(x) for x in sketches])
        root = np.unique(table.column("label").to_numpy(), return_inverse=True)[1]
        comp = np.arange(int(root.max()) + 1 if len(root) else 0)       # components joined here
        members = np.flatnonzero(~probe)
        members = members[np.argsort(key[members], kind="stable")]
        asks = np.flatnonzero(probe)
        asks = asks[np.argsort(node[asks], kind="stable")]
        lo, hi = np.searchsorted(key[members], key[asks], "left"), np.searchsorted(key[members], key[asks], "right")
        links = []
        cuts = np.flatnonzero(np.diff(node[asks])) + 1
        for first, last in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(asks)]))) if len(asks) else ():
            p = asks[first]
            mine = at[p]
            of = np.concatenate([members[a:b] for a, b in zip(lo[first:last], hi[first:last])])
            of = of[(comp[root[of]] != comp[root[p]]) & (least_partner(np.maximum(n[at[of]], n[mine]), percent) <= np.minimum(n[at[of]], n[mine]))]
            of = of[np.unique(node[of], return_index=True)[1]]
            far = np.zeros(len(of), np.int64)
            for w in np.unique(width[at[of]]):
                some = np.flatnonzero(width[at[of]] == w)
                far[some] = apart(sketches[mine], np.stack([sketches[i] for i in at[of[some]]]))
            near = np.flatnonzero(far <= reach(n[at[of]], n[mine], percent))
            for q in of[near[np.argsort(far[near], kind="stable")]]:
                if comp[root[q]] == comp[root[p]]:
                    continue
                x, y = sorted((items[mine], items[at[q]]), key=len)
                both = int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))
                pair = (min(int(node[p]), int(node[q])), max(int(node[p]), int(node[q])))
                if 100 * both >= percent * (len(x) + len(y) - both) and pair not in rejected:
                    links.append(pair)
                    comp[comp == comp[root[q]]] = comp[root[p]]
        return pa.Table.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], schema=_LINK)
    return run


def word_shingles(text: bytes, shingle: int) -> set:
    """The set itself: tuples of words."""
    w = text.lower().split()
    return set(zip(*(w[i:] for i in range(shingle)))) if len(w) >= shingle else {tuple(w)} if w else set()


def _confirm(shingle: int, percent: int):
    """(a, b, x, y) with the texts x and y -> the pairs (a, b) that are links, by their words."""
    def run(batches):
        last, of = None, set()
        for batch in batches:
            ok = []
            for b, x, y in zip(batch.column("b").to_pylist(), batch.column("x"), batch.column("y")):
                if b != last:
                    last, of = b, word_shingles(y.as_buffer().to_pybytes(), shingle)
                one = word_shingles(x.as_buffer().to_pybytes(), shingle)
                both = len(one & of)
                ok.append(100 * both >= percent * (len(one) + len(of) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))
    return run


class _Join:
    """The classes of one corpus and the components found so far."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int):
        self.shingle, self.percent = shingle, percent
        text = F.coalesce(F.col(text_col), F.lit(""))
        self.texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(P.LAST_ID)).alias("did"), F.xxhash64(text).alias("x"), text.alias("text"))
        described = checkpointed(self.texts.mapInArrow(_describe(shingle), "did long, x long, n long, g1 long, g2 long, sketch binary"))
        classes = described.filter("n > 0").groupBy("g1", "g2").agg(F.min(F.struct("did", "x")).alias("r"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
        own = F.lit(_NO_ID) + F.shiftrightunsigned(F.xxhash64("g1", "g2"), 2)
        classes = checkpointed(classes.select("g1", "g2", "n", "sketch", "r.did", "r.x", F.when(F.col("r.did") == P.LAST_ID, own).otherwise(F.col("r.did")).alias("node")))
        shared = classes.groupBy("node").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("g1", "g2")).alias("first")).filter("c > 1").select("node", "first")
        shared = checkpointed(shared)                       # doc_ids that are first in several classes: with different texts
        self.rows, self.labels = described.select("did", "n", "g1", "g2"), None
        if shared.limit(1).count():
            other = F.col("first").isNotNull() & (F.struct("g1", "g2") != F.col("first"))
            classes = checkpointed(classes.join(small_side(shared), "node", "left").withColumn("node", F.when(other, own).otherwise(F.col("node"))).drop("first"))
        self.classes = classes
        several = described.filter(F.col("n") > 0).filter(F.col("did") != P.LAST_ID).groupBy("did").agg(F.min(F.struct("g1", "g2")).alias("lo"), F.max(F.struct("g1", "g2")).alias("hi"))
        several = checkpointed(several.filter("lo <> hi").select("did"))
        if several.limit(1).count():                        # one document with several texts links their classes
            at = described.join(small_side(several), "did").join(classes.select("g1", "g2", "node"), ["g1", "g2"]).select("did", "node")
            links = at.join(at.groupBy("did").agg(F.min("node").alias("a")), "did").select("a", F.col("node").alias("b")).filter("a <> b")
            self.link(checkpointed(links))

    def link(self, found: DataFrame) -> None:
        """Adds checkpointed links (a, b)."""
        if found.limit(1).count():
            self.labels = components(found) if self.labels is None else merged(self.labels, found)

    def labelled(self, rows: DataFrame) -> DataFrame:
        """rows (node, ...) with the label of their component."""
        if self.labels is None:
            return rows.withColumn("label", F.col("node"))
        return rows.join(small_side(self.labels), "node", "left").withColumn("label", F.coalesce("label", "node"))

    def class_texts(self, classes: DataFrame) -> DataFrame:
        """(node, text) of checkpointed classes (node, did, x)."""
        return self.texts.join(small_side(classes), ["did", "x"]).select("node", "text").dropDuplicates(["node"])

    def shared_keys(self) -> DataFrame:
        """SHARED rows of all classes that can have partners."""
        low = bands(self.percent)[0][0]
        plan = self.classes.filter(F.col("n") >= low)
        total = plan.agg(F.sum("n")).first()[0] or 0
        buckets = P.bucket_count(total * 6 // 10, KEYS, plan.sparkSession)
        wanted = checkpointed(plan.select("node", "did", "x"))
        found = self.texts.join(small_side(wanted), ["did", "x"]).select("node", "text")
        return checkpointed(found.mapInArrow(_keys(self.shingle, self.percent, buckets), P.BLOCK_SCHEMA).groupBy("bucket").applyInArrow(_shared, SHARED))

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """Adds the links among checkpointed pairs (a, b) of classes, and returns them."""
        sets = self.sets
        left = sets.withColumnsRenamed({"node": "a", "text": "x"}).join(small_side(pairs.select("a", "b")), "a")
        asked = checkpointed(pairs.select("b").distinct())
        right = sets.withColumnsRenamed({"node": "b", "text": "y"}).join(small_side(asked), "b")
        found = checkpointed(left.join(right, "b").select("a", "b", "x", "y").mapInArrow(_confirm(self.shingle, self.percent), "a long, b long"))
        self.link(found)
        return found

    def plausible(self, pairs: DataFrame) -> DataFrame:
        """Checkpointed pairs (a, b) whose sizes and sketches leave a link possible."""
        of = self.classes.select("node", "n", "sketch")
        both = (pairs.join(of.withColumnsRenamed({"node": "a", "sketch": "x"}), "a")
                .join(of.withColumnsRenamed({"node": "b", "n": "m", "sketch": "y"}), "b")
                .filter(F.ceil(F.greatest("n", "m") * F.lit(self.percent) / F.lit(100)) <= F.least("n", "m")))
        return checkpointed(both.select("a", "b", "n", "m", "x", "y").mapInArrow(_plausible(self.percent), "a long, b long, least long"))

    def open_keys(self, rows: DataFrame) -> DataFrame:
        """rows of keys that two or more components share, with their label."""
        at = self.labelled(rows.drop("label"))
        mixed = at.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key")
        return checkpointed(at.join(mixed, "key"))

    def lead(self, rows: DataFrame) -> None:
        """Compares each member with the leader of another component that it meets most often."""
        met = rows.filter("node <> leader").groupBy("node", "leader").count()
        best = met.groupBy("node").agg(F.max(F.struct("count", "leader")).alias("m")).select("node", F.col("m.leader").alias("leader"))
        pairs = best.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"), "leader")
        self.confirm(self.plausible(checkpointed(pairs.select("a", "b").distinct())))

    def probes(self, rows: DataFrame) -> DataFrame:
        """The keys that the sets of open rows probe: (node, key, scheme)."""
        kind = F.shiftright("pos", 1).bitwiseAND(F.lit(1))
        indexed = F.col("pos").bitwiseAND(F.lit(1)) == 1
        per = rows.filter(indexed).groupBy("key", "label").agg(F.sum(1 - kind).alias("equal"), F.sum(kind).alias("less"))
        of = per.groupBy("key").agg(F.sum("equal").alias("all_equal"), F.sum("less").alias("all_less"))
        costs = (rows.join(of, "key", "left").join(per, ["key", "label"], "left")
                 .select("node", "tie", "pos", "key", *[(F.coalesce(f"all_{c}", F.lit(0)) - F.coalesce(c, F.lit(0))).alias(c) for c in ("equal", "less")]))
        grouped = costs.groupBy("node", "tie").agg(F.collect_list(F.struct("pos", "key", "equal", "less")).alias("rows"))
        sized = grouped.join(self.classes.select("node", "n"), "node").select("node", "n", "tie", "rows")
        return checkpointed(sized.mapInArrow(_choose(self.percent), "node long, key long, scheme int"))

    def across(self, rows: DataFrame, probes: DataFrame, rejected: frozenset = frozenset()) -> DataFrame:
        """Pairs (a, b) of a probe and an indexed set of another component in a probed key that are links by their hashes; of
        those inside what a task has joined already, none."""
        chosen = probes.filter("key is not null").select("key", "node").distinct().withColumn("asks", F.lit(True))
        keys = chosen.select("key").distinct()
        at = rows.select("key", "node", "label").distinct().join(keys, "key").join(chosen, ["key", "node"], "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
        lost = checkpointed(probes.filter("key is null").select("node", "scheme").distinct())
        if lost.limit(1).count():                           # these meet every set of the scheme's band
            low = F.array(*[F.lit(b[0]) for b in bands(self.percent)])
            band = F.size(F.filter(low, lambda v: v <= F.col("n"))) - 1
            every = self.classes.withColumn("scheme", band).join(F.broadcast(lost.select("scheme").distinct()), "scheme").select("scheme", "node").withColumn("asks", F.lit(False))
            whole = every.unionByName(lost.withColumn("asks", F.lit(True))).groupBy("scheme", "node").agg(F.max("asks").alias("asks"))
            at = at.unionByName(self.labelled(whole.select((-1 - F.col("scheme")).cast("long").alias("key"), "node", "asks")).select("key", "node", "label", "asks"))
            wanted = rows.select("node").unionByName(whole.select("node")).distinct()
            self.sets = checkpointed(self.class_texts(checkpointed(wanted.join(self.classes.select("node", "did", "x"), "node"))))
        at = checkpointed(at)
        per = at.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("asks").cast("long")).alias("asking"))
        of = (per.groupBy("key").agg(F.max(F.struct("c", "label")).alias("m"), F.sum("c").alias("members"), F.sum("asking").alias("asking"))
              .select("key", F.col("m.label").alias("major"), (F.col("members") - F.col("m.c") < F.col("asking")).alias("by_minor")))
        cols = ["key", "node", "label"]
        at = at.join(of, "key").select("major", *cols, F.when(F.col("by_minor"), F.col("label") != F.col("major")).otherwise(F.col("asks")).alias("asks"))
        at = checkpointed(at)
        # a family are the keys of one largest component: its members and its asking sets are dealt to parts, and a block is a part of each
        once = at.groupBy("major", "node").agg(F.max("asks").alias("asks")).join(self.classes.select("node", (8 * F.col("n") + 64).alias("bytes")), "node")
        count = lambda c: F.greatest(F.ceil(F.sum(c) / PART_BYTES), F.lit(1)).cast("int")
        parts = checkpointed(once.groupBy("major").agg(count("bytes").alias("parts"), count(F.when(F.col("asks"), F.col("bytes")).otherwise(0)).alias("turns")))
        at = at.join(small_side(parts), "major")
        place = lambda c: F.pmod(F.xxhash64("node"), c).cast("int")
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        members = at.select("major", place("parts").alias("part"), every("turns").alias("turn"), F.lit(False).alias("probe"), *cols)
        asking = at.filter("asks").select("major", every("parts").alias("part"), place("turns").alias("turn"), F.lit(True).alias("probe"), *cols)
        dealt = checkpointed(members.unionByName(asking))
        of = self.classes.select("node", "n")
        total = dealt.select("major", "part", "turn", "node").distinct().join(of, "node").agg(F.sum(8 * F.col("n") + 64)).first()[0] or 0
        buckets = P.bucket_count(total, 2 * PART_BYTES, at.sparkSession)
        dealt = dealt.select(F.pmod(F.xxhash64("major", "part", "turn"), F.lit(buckets)).cast("int").alias("bucket"), "probe", *cols)
        wanted = checkpointed(dealt.select("bucket", "node").distinct())
        needed = checkpointed(wanted.select("node").distinct())
        items = self.sets.join(small_side(needed), "node").select("node", "text").mapInArrow(_items(self.shingle), "node long, items binary")
        sets = checkpointed(items).join(small_side(wanted), "node").select("bucket", "node", "items")
        found = dealt.groupBy("bucket").cogroup(sets.groupBy("bucket")).applyInArrow(_compare(self.percent, rejected), "a long, b long")
        return checkpointed(found.distinct())

    def run(self) -> None:
        open_ = self.shared_keys()
        if open_.limit(1).count() == 0:
            return
        wanted = checkpointed(open_.select("node").distinct().join(self.classes.select("node", "did", "x"), "node"))
        self.sets = checkpointed(self.class_texts(wanted))
        self.lead(open_)
        open_ = self.open_keys(open_)
        before = None
        for turn in range(STARS):
            left = open_.count()
            if left == 0:
                return
            if before is not None and left > 0.9 * before:
                break
            before = left
            # another leader: the indexed set with the least hash of this turn, for the members outside its component
            indexed = open_.filter(F.col("pos").bitwiseAND(F.lit(1)) == 1)
            of = indexed.groupBy("key").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "label"), F.xxhash64(F.lit(turn), "node"), "node", "label")).alias("l"))
            led = open_.drop("leader").join(of.select("key", F.col("l.node").alias("leader"), F.col("l.label").alias("led")), "key").filter(F.col("led") != F.col("label"))
            self.lead(led.select("node", "leader"))
            open_ = self.open_keys(open_)
        probes, rejected = self.probes(open_), frozenset()
        while True:
            pairs = self.across(open_, probes, rejected)
            odd = pairs.join(self.confirm(pairs), ["a", "b"], "left_anti").collect()
            if not odd:             # else hashes of different shingles met, and other links may be hidden by these
                return
            rejected |= {(r["a"], r["b"]) for r in odd}
            open_ = self.open_keys(open_)


def similar_groups(docs: DataFrame, id_col="doc_id", text_col="text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) per row: the size of its set and the smallest id it reaches by links."""
    j = _Join(docs, id_col, text_col, shingle, percent)
    j.run()
    found = j.labelled(j.classes.select("g1", "g2", "node")).select("g1", "g2", "label")
    rows = j.rows.join(found, ["g1", "g2"], "left")
    comp = F.when(F.col("n") == 0, F.col("did")).otherwise(F.col("label"))
    return rows.select(F.when(F.col("did") == P.LAST_ID, F.lit(None).cast("long")).otherwise(F.col("did")).alias("id"), F.col("n").alias("n_shingles"),
                       F.when(comp >= _NO_ID, F.lit(None).cast("long")).otherwise(comp).alias("component_id"))
