"""Spelling variants, the n-gram Jaccard join and collocations against brute force; word hashes."""

import collections
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glosspark.llm import block_dedup, collocations, jaccard_join, near_dedup, quotient, spelling, words
from glosspark.llm.common import documents, mix64
from tests.llm.test_operators import LONG, _brute_components, _odd_rows, SCHEMA

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(_odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# --- words ---------------------------------------------------------------------

def _thue_morse(bits):
    s = "a"
    for _ in range(bits):
        s += s.translate(str.maketrans("ab", "ba"))
    return s


def test_words_that_differ_by_a_pattern_do_not_meet(spark):
    """Thue-Morse words of 2048 letters, which meet in every polynomial hash modulo 2^64."""
    one = _thue_morse(11)
    two = one.translate(str.maketrans("ab", "ba"))
    rest = [f"w{i}" for i in range(24)]
    rows = [(1, " ".join([one, *rest])), (2, " ".join([two, *rest[:23], "other"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # one window of 20 words without the first or the last word is the same in both, those with the first are not
    got = {r["id"]: r["n_removed"] for r in block_dedup.remove_repeats(df).collect()}
    assert got == {1: 0, 2: 23}
    apart = spark.createDataFrame([(1, " ".join([one, *rest[:19]])), (2, " ".join([two, *rest[:19]]))], "doc_id long, text string")
    assert {r["n_removed"] for r in block_dedup.remove_repeats(apart).collect()} == {0}
    short = spark.createDataFrame([(1, " ".join([one, *rest[:2]])), (2, " ".join([two, *rest[:2]]))], "doc_id long, text string")
    assert {r["component_id"] for r in near_dedup.near_duplicates(short).collect()} == {1, 2}
    assert {r["component_id"] for r in jaccard_join.similar_groups(short).collect()} == {1, 2}


def test_codes_follow_the_words():
    texts = ["", "b a  b", "a", "", "c\tb"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0] + [len(t.encode()) for t in texts])
    code, s, e, doc, distinct = words.coded(raw, off, (raw != 32) & (raw != 9))
    spelled = distinct.to_pylist()
    assert [spelled[c].decode() for c in code] == ["b", "a", "b", "a", "c", "b"] and doc.tolist() == [1, 1, 1, 2, 4, 4]
    assert len(set(spelled)) == 3 and [raw[a:b].tobytes().decode() for a, b in zip(s, e)] == ["b", "a", "b", "a", "c", "b"]


# --- spelling --------------------------------------------------------------------

def _brute_spelling(rows):
    counts = collections.Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            counts[w[:h % len(w)] + w[h % len(w) + 1:] if h % 199 == 0 else w] += 1
    vocab = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {}
    letters = [chr(c) for c in spelling.LETTERS]
    for w in vocab:
        some = {w[:i] + w[i + 1:] for i in range(len(w))} | {w[:i] + c + w[i + 1:] for i in range(len(w)) for c in letters} \
            | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        near[w] = sorted((x for x in some if x in vocab and x != w), key=lambda x: (-vocab[x], x))
    form = {w: x[0] if x and vocab[x[0]] >= 5 * vocab[w] else None for w, x in near.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w
    return {(w, form[w], root(w), n, len(near[w]), vocab.get(form[w])) for w, n in vocab.items()}


def _spelling(df):
    return {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in spelling.spelling_groups(spelling.vocabulary(df)).collect()}


def test_spelling_against_brute_force(spark):
    df = documents(spark, "/root/testdata/sf0.01")
    want = _brute_spelling([(r["doc_id"], r["text"]) for r in df.collect()])
    assert _spelling(df) == want and sum(w[1] is not None for w in want) > 100


def test_spelling_chains_ties_and_odd_rows(spark, odd, none, monkeypatch):
    monkeypatch.setattr(spelling, "FILTER_BYTES", 64)       # filters that accept nearly everything
    text = " ".join(["kitten"] * 5 + ["mitten"] * 25 + ["mittens"] * 125 + ["zitten"] * 25 + ["été"] * 9 + ["créées"] * 6 + ["Créés"] * 30 + ["ÀÿÀÿÀÿ"] * 5 + ["x" * 3000] * 6 + ["x" * 2999] * 40)
    rows = [(-(1 << 40) - k, t) for k, t in enumerate([None, "", text, "a-b_c1d"])] + [(None, "abcdef " * 7), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("w")).withColumn("n", F.lit(1))
    want = _brute_spelling(rows)
    assert _spelling(df) == want
    by = {w[0]: w for w in want}
    assert by["kitten"][1:3] == ("mitten", "mittens") and by["x" * 3000][1] == "x" * 2999
    assert _spelling(odd) == _brute_spelling([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert _spelling(none) == set()


def test_edits_have_the_hashes_of_what_they_make():
    words_ = ["abcdef", "aabbcc", "ééabàz", "zzzzzz"]
    everything = {m: np.full(1, ~np.uint64(0)) for m in range(4, 9)}
    for m, at, cells in spelling.by_length(words_):
        made = collections.defaultdict(set)
        for r, word in spelling.edits(cells, everything):
            made[words_[at[r]]].add("".join(map(chr, word)))
        for w in words_:
            want = {w[:i] + w[i + 1:] for i in range(m)} | {w[:i] + chr(c) + w[i + 1:] for i in range(m) for c in spelling.LETTERS if chr(c) > w[i]}
            assert made[w] == want
    for w, x in itertools.product(words_, words_):            # a filter of one word accepts just its own edits, as hashes say
        (m, _, cells), = spelling.by_length([x])
        h = spelling.place_hash(np.arange(m)[None, :], cells).sum(axis=1, dtype=np.uint64)
        block, mask = spelling.places_of(h, 4)
        bits = np.zeros(4, np.uint64)
        np.bitwise_or.at(bits, block, mask)
        (_, _, own), = spelling.by_length([w[:-1] + "b"])
        assert any("".join(map(chr, e)) == x for _, e in spelling.edits(own, {m: bits})) == (w == x and x[-1] > "b")


# --- Jaccard join --------------------------------------------------------------------

def _groups(df, **how):
    return {r["id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similar_groups(df, **how).collect()}


@pytest.mark.parametrize("whole", [False, True])
def test_jaccard_join(spark, odd, whole):
    df = documents(spark, SF) if whole else odd
    want = _brute_components([(r["doc_id"], r["text"]) for r in df.collect()], 5, 80)
    assert _groups(df) == {i: x[:2] for i, x in want.items()}


@pytest.mark.parametrize("size", [4, 9, 24, 60, 130])
def test_jaccard_join_at_the_threshold(spark, size):
    """Sets at, above and below 80 %, of sizes in bands with and without deletions, among families that share text."""
    rng = np.random.default_rng(size)
    rows = []
    for family in range(40):
        base = [f"f{family % 8}w{i}" if i % 3 else f"w{i}" for i in range(size)]
        for _ in range(4):
            w = list(base)
            for k in range(int(rng.integers(0, max(2, size // 8)))):
                at = int(rng.integers(0, len(w)))
                kind = rng.integers(0, 3)
                if kind == 0:
                    w[at] = f"x{rng.integers(0, 9)}"
                elif kind == 1:
                    w.insert(at, f"y{rng.integers(0, 9)}")
                elif len(w) > 1:
                    del w[at]
            rows.append((len(rows), " ".join(w)))
    want = _brute_components(rows, 2, 80)
    got = _groups(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2)
    assert got == {i: x[:2] for i, x in want.items()} and len({x[1] for x in want.values()}) > 8


def test_jaccard_join_without_ids_and_several_texts(spark, none):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(5, a), (5, b), (7, b + " end"), (3, "start " + a), (None, a), (None, "q r s"), (None, None), (9, b), (9, b), (11, " \t")]
    got = collections.defaultdict(set)
    for r in jaccard_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1)).withColumn("x", F.lit(2))).collect():
        got[r["id"]].add((r["n_shingles"], r["component_id"]))
    assert got[5] == {(26, 3)} and got[7] == {(27, 3)} and got[3] == {(27, 3)} and got[9] == {(26, 3)} and got[11] == {(0, 11)}
    assert got[None] == {(26, 3), (1, None), (0, None)} or got[None] == {(26, 3), (1, None), (0, (1 << 63) - 1)}
    assert jaccard_join.similar_groups(none).count() == 0


def test_segments_bound_the_differences():
    """Of sets that differ in d shingles, at most d segments differ, and a segment one shingle apart has a common key."""
    rng = np.random.default_rng(5)
    for n, segments in ((8, 3), (50, 9), (400, 120)):
        one = np.unique(mix64(rng.integers(1, 1 << 62, n, dtype=np.uint64)))
        extra = mix64(rng.integers(1, 1 << 62, 1, dtype=np.uint64))
        two = np.unique(np.concatenate((one[1:], extra)))
        k, s, kind = jaccard_join.segment_keys(one, 0, segments, True)
        q, t, kind2 = jaccard_join.segment_keys(two, 0, segments, True)
        same = sum(k[(s == i) & (kind == 0)][0] == q[(t == i) & (kind2 == 0)][0] for i in range(segments))
        assert segments - 2 <= same <= segments - 1
        wholes, lesses = set(k[kind == 0]) | set(k[kind == 1]), set(q[kind2 == 0]) | set(q[kind2 == 1])
        changed = set(((np.setxor1d(one, two) >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).tolist())
        assert len(changed) == 1 or all((set(k[s == i]) & lesses) and (set(q[t == i]) & wholes) for i in changed)


def test_allocation_is_the_cheapest():
    rng = np.random.default_rng(2)
    for _ in range(200):
        offers = [(s, int(rng.integers(0, 9)), int(rng.integers(0, 9)) if rng.random() < 0.7 else None) for s in range(5)]
        most = sum(1 + (d is not None) for _, _, d in offers)
        for units in range(most + 2):
            found = jaccard_join.allocate(units, offers)
            assert (found is None) == (units > most)
            if found:
                one, two = found
                assert len(one) + len(two) == units and two <= one


def test_jaccard_near_misses_make_no_rows_per_pair(spark, monkeypatch):
    """Families of texts that nearly link: the comparison gives fewer links than there are sets, in one block or in many."""
    rng = np.random.default_rng(5)
    rows = []
    for family in range(3):
        base = [f"f{family}w{i}" for i in range(60)]
        for _ in range(60):
            w = list(base)
            for at in rng.choice(60, int(rng.integers(1, 4)), replace=False):
                w[at] = f"x{rng.integers(0, 1000)}"
            rows.append((len(rows), " ".join(w)))
    want = {i: x[:2] for i, x in _brute_components(rows, 2, 80).items()}
    made, across = [], jaccard_join._Join.across

    def counted(self, open_, *rest):
        found = across(self, open_, *rest)
        made.append((found.count(), open_.select("node").distinct().count()))
        return found
    monkeypatch.setattr(jaccard_join._Join, "across", counted)
    monkeypatch.setattr(jaccard_join, "STARS", 0)           # nothing joined by leaders but the first
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert _groups(df, shingle=2) == want and len({x[1] for x in want.values()}) > 3
    assert made and all(n < sets for n, sets in made), made
    monkeypatch.setattr(jaccard_join, "PART_BYTES", 4096, raising=False)
    assert _groups(df, shingle=2) == want


def test_jaccard_links_that_words_reject(spark):
    """A rejected pair hides no other link of its component."""
    import pyarrow as pa
    same = np.arange(1, 101, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    rows = pa.table({"key": [7] * 6, "node": [1, 2, 3] * 2, "label": [1, 2, 3] * 2, "probe": [False] * 3 + [True] * 3})
    sets = pa.table({"node": [1, 2, 3], "items": pa.array([np.sort(same[:k]).tobytes() for k in (100, 99, 98)], pa.binary())})
    assert jaccard_join._compare(80)(rows, sets).num_rows == 2
    left = jaccard_join._compare(80, frozenset({(1, 2)}))(rows, sets).to_pylist()
    assert sorted((x["a"], x["b"]) for x in left) == [(1, 3), (2, 3)]


# --- collocations ----------------------------------------------------------------------

def _brute_collocations(rows, least=10, top=2000):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, t in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = {}
    for lang, c in f.items():
        covered = collections.defaultdict(int)
        for x, a in c.items():
            if len(x) == 3 and a >= least:
                for y in (x[:2], x[1:]):
                    covered[y] = max(covered[y], a)
        scored = []
        for x, a in c.items():
            if len(x) > 1 and a >= least and not (x in covered and 100 * covered[x] >= 50 * a):
                s, k = min((1000000 * a * a // (c[x[:k]] * c[x[k:]]), k) for k in range(1, len(x)))
                scored.append((-s, -a, " ".join(x).encode(), c[x[:k]], c[x[k:]]))
        for rank, (s, a, x, l, r) in enumerate(sorted(scored)[:top], 1):
            out[lang, rank] = (x.decode(), -a, l, r, n[lang], -s)
    return out


def _collocations(df, **how):
    return {(r["lang"], r["rank"]): (r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in collocations.collocations(df, **how).collect()}


def test_collocations_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SLICE", 100_000)     # many shards
    monkeypatch.setattr(collocations, "ENTRIES", 5_000)     # many filters a task
    monkeypatch.setattr(collocations, "BUCKET_ENTRIES", 20_000)
    df = documents(spark, "/root/testdata/sf0.01")
    want = _brute_collocations([(r["lang"], r["text"]) for r in df.collect()])
    assert _collocations(df) == want and len(want) > 500


def test_collocations_of_odd_rows(spark, odd, none):
    rows = [(None, "New York is big. " * 12), ("und", "new york, new york"), ("en", "a b c\td e " * 15), ("en", None), ("en", ""), ("de", "x"), ("en", ". , ; :" * 20),
            ("fr", "été à été\r\nà " * 11), ("fr", LONG), ("en", "A B " * 2000)]
    df = spark.createDataFrame(rows, "lang string, text string").withColumn("word", F.lit("w")).withColumn("n", F.lit(3)).withColumn("shard", F.lit(0))
    assert _collocations(df) == _brute_collocations(rows)
    assert _collocations(df, least=2, top=7) == _brute_collocations(rows, 2, 7)
    assert _collocations(odd) == _brute_collocations([(r["lang"], r["text"]) for r in odd.collect()])
    assert _collocations(none) == {}


def test_scores_are_exact_beyond_64_bits(spark):
    a, l, r = 3_000_000_007, 3_000_000_019, 9_000_000_011
    got = spark.createDataFrame([(a, l, r)], "f long, l long, r long").select(collocations._cut("f", "l", "r", 1).alias("c")).first()["c"]
    assert got["score"] == 1_000_000 * a * a // (l * r)


@pytest.mark.parametrize("bits", [2, 3, 7, 17, 21, 32])
def test_quotient_filters_lose_nothing(bits):
    rng = np.random.default_rng(bits)
    top, half = (1 << bits) - 1, collocations.halves(bits)
    for bucket_bits in (0, 1, min(5, half)):
        total = collections.Counter()
        by = collections.defaultdict(list)
        for _ in range(3):
            w = rng.integers(0, top, (3, 400), dtype=np.uint64, endpoint=True)
            w[:, :100] = w[:, 100:200]
            total.update(zip(*(x.tolist() for x in w)))
            left, right = collocations.pack(*w, bits)
            assert all((x == y).all() for x, y in zip(collocations.unpack(left, right, bits), w))
            mixed = quotient.permute(left, right, half)
            assert all((x == y).all() for x, y in zip(quotient.restore(*mixed, half), (left, right)))
            for row in quotient.encode(*quotient.tally(*mixed), half, bucket_bits):
                by[row["bucket"]].append(row)
        got = {}
        for rows in by.values():
            left, right, n = quotient.merge(rows, half, bucket_bits)
            got.update(zip(zip(*(x.tolist() for x in collocations.unpack(*quotient.restore(left, right, half), bits))), n.tolist()))
        assert got == total


def test_mixing_keeps_columns_with_its_own_names(spark):
    from glosspark.llm import mixing
    names = ["_key", "_left", "_src", "_epochs", "_cut", "_tied"]
    df = documents(spark, SF, "doc_id", "text", "source").limit(50)
    clashing = df.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    got = {r["doc_id"]: r for r in mixing.mix(clashing).collect()}
    want = {r["doc_id"]: r["taken"] for r in mixing.mix(df).collect()}
    assert {i: r["taken"] for i, r in got.items()} == want and all(r[n] == f"{n}{i}" for i, r in got.items() for n in names)


def test_near_dedup_stage_keeps_columns_with_its_own_names(spark):
    import corpus_pipeline as cp
    df = documents(spark, SF).withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in ("_x", "_did")})
    out = cp.near_dedup_stage(spark, df, SF)
    rows = out.collect()
    assert out.columns == df.columns and rows and all(r["_x"] == f"_x{r['doc_id']}" and r["_did"] == f"_did{r['doc_id']}" for r in rows)


def _filtered(monkeypatch, stride, n=600_000):
    """Merged counts of one shard of `n` words by strides, and the most memory numpy held meanwhile."""
    import tracemalloc

    import pyarrow as pa
    rng = np.random.default_rng(3)
    tokens = np.minimum(rng.zipf(1.3, n), 50_000).astype("<u4")
    ids = [(k << 32) | (k + 1) for k in range(50_000) if k % 5]
    batch = pa.RecordBatch.from_pylist([{"tokens": collocations.planes(tokens), "entries": 50_000, "ids": ids}],
                                       schema=pa.schema([("tokens", pa.binary()), ("entries", pa.int32()), ("ids", pa.list_(pa.int64()))]))
    monkeypatch.setattr(collocations, "STRIDE", stride, raising=False)
    tracemalloc.start()
    held = [b for b in collocations._filters(16, 2)([batch])]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    by = collections.defaultdict(list)
    for r in (r for b in held for r in b.to_pylist()):
        by[r["bucket"]].append(r)
    return {k: [x.tolist() for x in quotient.merge(rows, collocations.halves(16), 2)] for k, rows in by.items()}, peak


def test_collocations_count_a_shard_in_strides(monkeypatch):
    """The memory of a task does not follow the words of a shard, and n-grams across strides are counted."""
    whole, _ = _filtered(monkeypatch, 1 << 30)
    cut, peak = _filtered(monkeypatch, 1 << 16)
    assert cut == whole and len(whole) > 1
    assert peak < 60 << 20


def test_arrow_batches_are_small(spark):
    """Rows of 1 MB go to Python in batches of a few, and the session's own setting is put back."""
    from glosspark.llm import common
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    df = spark.range(0, 24, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))

    def sizes(batches):
        import pyarrow as pa
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})
    got = [r["n"] for r in common.checkpointed(df.mapInArrow(sizes, "n long")).collect()]
    assert sum(got) == 24 and max(got) <= 6 and spark.conf.get(name) == before


def test_arrays_count_for_a_broadcast(spark):
    """A side of 40 MB in arrays is not broadcast; one of 8 MB is."""
    from glosspark.llm.common import small_side
    for rows, sent in ((5, False), (1, True)):
        side = spark.range(rows).select(F.col("id").alias("k"), F.array_repeat(F.col("id"), 1_000_000).alias("ids"))
        assert ("broadcast" in small_side(side)._jdf.queryExecution().analyzed().toString()) == sent
