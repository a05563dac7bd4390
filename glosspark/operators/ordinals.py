"""Dense ordinals and exact rank cuts without a single-task window.

* `with_ordinal` numbers rows 0..n-1 in partition order (what zipWithIndex
  does): a per-partition count (one row per partition) is turned into
  offsets and broadcast back. Used for physical line numbers of one text
  file and after a distributed sort.
* `exact_cut` assigns rows to sides 0..k by their rank in a 120-bit
  pseudo-random order (hash of key, then hash of the row) so that side sizes
  are exact. It narrows the boundary with 16-bit histograms (at most 65 536
  rows per collect), never sorts the whole table, and handles a group of
  identical rows of any size (a hot key) by per-partition quotas.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOCAL_BITS = 33
_MASK = (1 << _LOCAL_BITS) - 1


def hash60(*parts) -> Column:
    """60-bit non-negative hash of ':'-joined parts (md5, so SQL engines can reproduce it)."""
    s = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substr(F.md5(s), F.lit(1), F.lit(15)), 16, 10).cast("bigint")


def with_ordinal(df: DataFrame, name: str = "ord") -> DataFrame:
    """Number rows 0..n-1 in partition order (file order for one text file, sort order after orderBy)."""
    tagged = df.withColumn("_mid", F.monotonically_increasing_id())
    pid = F.shiftright("_mid", _LOCAL_BITS)
    counts = tagged.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    # One row per input partition: the window below runs over a bounded, tiny table.
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    out = tagged.join(F.broadcast(offsets), pid == F.col("_pid"))
    return out.withColumn(name, F.col("_off") + F.col("_mid").bitwiseAND(F.lit(_MASK))) \
              .drop("_mid", "_pid", "_off")


def sorted_ordinal(df: DataFrame, order_cols: list, name: str = "ord", partitions: int | None = None) -> DataFrame:
    """Dense 0-based rank by `order_cols` via a range-partitioned sort (no global window).

    Range bounds come from a sample whose outcome depends on row order after
    the previous shuffle, so the sorted data is materialised once with a
    reliable checkpoint (the cluster's shared checkpoint folder): the counting
    and numbering passes then read the very same partitions, and a lost
    executor cannot make them disagree."""
    from glosspark.session import cut_lineage
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols))
    return with_ordinal(ranged, name)


# ---------------------------------------------------------------------------
# exact cut


_CHUNKS = [(0, 44), (0, 28), (0, 12), (0, 0), (1, 44), (1, 28), (1, 12), (1, 0)]
_SMALL = 50_000


def rank_keys(df: DataFrame, key: Column, content: list, seed) -> DataFrame:
    """Attach the pseudo-random order (_h, _t): hash of seed:key, tie-break hash of the row."""
    return df.withColumn("_h", hash60(F.lit(str(seed)), key)) \
             .withColumn("_t", hash60(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in content]))


def _prefix_filter(prefix: list) -> Column:
    cond = F.lit(True)
    for (k, shift), v in prefix:
        cond = cond & (F.shiftright(F.col(("_h", "_t")[k]), shift) == F.lit(v))
    return cond


def _locate(keys: DataFrame, n: int, rank: int):
    """Find the composite key at 0-based position `rank` (0 <= rank < n).

    Returns (h, t, before, count): `before` rows have a smaller key, `count`
    rows have key (h, t), and so does the row at `rank`. Each step collects at
    most 2^16 histogram rows.
    """
    prefix: list = []
    before = 0
    size = n
    for k, shift in _CHUNKS:
        if size <= _SMALL:
            break
        col = ("_h", "_t")[k]
        hist = sorted((r[0], r[1]) for r in keys.filter(_prefix_filter(prefix))
                      .groupBy(F.shiftright(F.col(col), shift).alias("b")).count().collect())
        for b, c in hist:
            if before + c > rank:
                prefix.append(((k, shift), b))
                size = c
                break
            before += c
    else:
        # all 120 bits fixed: one group of identical keys
        return dict(prefix)[(0, 0)], dict(prefix)[(1, 0)], before, size
    rows = sorted((r[0], r[1], r[2]) for r in keys.filter(_prefix_filter(prefix))
                  .groupBy("_h", "_t").count().collect())
    for h, t, c in rows:
        if before + c > rank:
            return h, t, before, c
        before += c
    raise AssertionError("rank outside the located bucket")


def _quota_side(group: DataFrame, thresholds: list[int], base: int, side_col: str) -> DataFrame:
    """Sides inside a group of identical rows: row g (0-based, partition order) gets
    base + #{thresholds <= g}. Identical rows make the choice of physical rows irrelevant;
    only per-partition counts (deterministic) are used. The partition id is read from a
    column computed right above the group's own partitioning (a task's partition id would
    be the id inside any later union)."""
    tagged = group.withColumn("_pid", F.spark_partition_id())
    counts = dict((r[0], r[1]) for r in tagged.groupBy("_pid").count().collect())
    offsets, acc = {}, 0
    for pid in sorted(counts):
        offsets[pid] = acc
        acc += counts[pid]
    ths = sorted(thresholds)
    schema = T.StructType(group.schema.fields + [T.StructField(side_col, T.IntegerType())])
    names = group.columns

    def assign(batches):
        g = None
        for pdf in batches:
            if len(pdf) == 0:
                continue
            if g is None:
                g = offsets[int(pdf["_pid"].iloc[0])]    # a partition the count did not see must fail, not restart at 0
            out = pdf[names].copy()
            out[side_col] = [base + bisect.bisect_right(ths, i) for i in range(g, g + len(pdf))]
            g += len(pdf)
            yield out

    return tagged.mapInPandas(assign, schema)


def exact_cut(df: DataFrame, cuts, side_col: str = "_side") -> DataFrame:
    """Side i = rows whose rank in (_h, _t) order lies in [cuts[i-1], cuts[i]).

    `cuts` is a list, or a function of the row count returning one (the count
    then comes from the same pass that materialises the narrow key columns).
    `df` must carry `_h`/`_t` (see `rank_keys`) and be deterministic.
    """
    from pyspark import StorageLevel

    keys = df.select("_h", "_t").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = keys.count()
        if callable(cuts):
            cuts = cuts(n)
        bounds = []
        for c in sorted(cuts):
            if c <= 0:
                bounds.append(("none",))
            elif c >= n:
                bounds.append(("all",))
            else:
                h, t, before, cnt = _locate(keys, n, c)
                bounds.append(("key", h, t, c - before, cnt))
    finally:
        keys.unpersist()

    h, t = F.col("_h"), F.col("_t")
    side = F.lit(0)
    groups: dict = {}
    for b in bounds:
        if b[0] == "none":
            side = side + 1
        elif b[0] == "key":
            bh, bt, take, cnt = b[1], b[2], b[3], b[4]
            gt = (h > bh) | ((h == bh) & (t > bt))
            if cnt == 1:      # a unique key: the row at the cut opens the next side
                side = side + F.when(gt | ((h == bh) & (t == bt)), 1).otherwise(0)
            else:             # identical rows straddle the cut: per-partition quotas
                side = side + F.when(gt, 1).otherwise(0)
                groups.setdefault((bh, bt), []).append(take)
    out = df.withColumn(side_col, side.cast("int"))
    for (bh, bt), ths in groups.items():
        # side of the group before its own cuts are applied
        base = sum(1 for b in bounds if b[0] == "none") + sum(
            1 for b in bounds if b[0] == "key" and (bh, bt) > (b[1], b[2]))
        is_g = (h == bh) & (t == bt)
        fixed = _quota_side(out.filter(is_g).drop(side_col), ths, base, side_col)
        out = out.filter(~is_g).unionByName(fixed)
    return out


def cut_points(n: int, fractions: list[float], mode: str = "ceil") -> list[int]:
    """Cut positions for split fractions; `ceil` matches the test-size rounding of the reference."""
    import math
    pts, acc = [], 0
    for f in fractions[:-1]:
        acc += math.ceil(f * n) if mode == "ceil" else int(f * n)
        pts.append(acc)
    return pts

