"""Each operator against a brute-force version on odd rows and on whole small tables."""

import collections
import hashlib
import pickle
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glosspark.llm import block_dedup, decontam, langid, mixing, near_dedup, pii, quotes, secret_crf, suffix_dedup, topk
from glosspark.llm.common import by_rows, documents
from glosspark.llm.components import components, merged

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, _hit string"
LONG = " ".join(f"w{i * 7919 % 1000}" for i in range(30000))
PASSAGE = " ".join(f"pass{i}" for i in range(40))


def _odd_rows():
    rows = [(1, None), (2, ""), (3, "one two"), (4, PASSAGE), (5, "x " + PASSAGE + " y"), (6, PASSAGE), (6, PASSAGE),
            (7, "a" * 500), (8, LONG), (9, "new start " + LONG[:3000]), (10, " \t\n "), (11, "été " * 60), (12, "one two")]
    return [(i, t, None if t is None else "en", None if i == 3 else f"s{i % 2}", 0, 0.5, "k", "h") for i, t in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(_odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _sha(b):
    return hashlib.sha256(b).hexdigest()


def _brute_repeats(rows, units, size, glue):
    seen, out = {}, {}
    for i, t in sorted({(i, t or "") for i, t in rows}):
        w = units(t)
        gone = [False] * len(w)
        for p in range(len(w) - size + 1):
            key = bytes(w[p:p + size]) if isinstance(w, bytes) else tuple(w[p:p + size])
            if key in seen:
                gone[p:p + size] = [True] * size
            seen.setdefault(key, 1)
        out[i] = (len(w), sum(gone), _sha(glue([x for x, g in zip(w, gone) if not g])))
    return out


@pytest.mark.parametrize("whole", [False, True])
def test_block_dedup(spark, odd, whole):
    df = documents(spark, SF) if whole else odd
    got = {r["id"]: (r["n_words"], r["n_removed"], _sha(r["kept"].encode())) for r in block_dedup.remove_repeats(df).collect()}
    assert got == _brute_repeats([(r["doc_id"], r["text"]) for r in df.collect()], lambda t: t.encode().split(), 20, b" ".join)


@pytest.mark.parametrize("whole", [False, True])
def test_suffix_dedup(spark, odd, whole, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 2 if whole else 512)     # also the path of crowded anchors
    monkeypatch.setattr(suffix_dedup, "SLICE", 50_000)                # long texts in segments
    df = documents(spark, SF) if whole else odd
    got = {r["id"]: (r["n_bytes"], r["n_removed"], _sha(bytes(r["kept"]))) for r in suffix_dedup.remove_repeats(df).collect()}
    assert got == _brute_repeats([(r["doc_id"], r["text"]) for r in df.collect()], lambda t: t.encode(), 100, bytes)


@pytest.mark.parametrize("length", [1, 5, 8, 9, 20, 37])
def test_previous_factors(length):
    rng = np.random.default_rng(length)
    for raw in (b"abracadabra-abracadabra" * 3, b"a" * 90, bytes(rng.integers(97, 99, 300, np.uint8)), bytes(length), b"\0\1" * 60 + b"\0" * 40):
        text, starts = raw, np.arange(len(raw) - length + 1)
        found = suffix_dedup.Suffixes(np.frombuffer(raw, np.uint8), starts, length)
        place = rng.permutation(len(starts)) // 2                   # positions in another order, with ties
        for position in (starts, place):
            def common(i, j):
                return next((k for k in range(length) if text[i + k] != text[j + k]), length)
            want = [max((common(i, j) for j in starts if position[j] < position[i]), default=0) for i in starts]
            assert suffix_dedup.previous_factors(found, position).tolist() == want
            assert suffix_dedup.repeats(found, position).tolist() == [w >= length for w in want]


def test_previous_smaller():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 7, 64, 301):
        v = rng.integers(0, 1 + n // 3, n)
        want = [next((j for j in range(i - 1, -1, -1) if v[j] < v[i]), -1) for i in range(n)]
        assert suffix_dedup.previous_smaller(v, np.arange(n)).tolist() == want


def _brute_components(rows, k, percent):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i:i + k]) for i in range(len(w) - k + 1)])
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    index = collections.defaultdict(list)
    for i in sorted(sets):
        common = collections.Counter(j for s in sets[i] for j in index[s])
        for s in sets[i]:
            index[s].append(i)
        for j, n in common.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


@pytest.mark.parametrize("whole", [False, True])
def test_near_dedup(spark, odd, whole):
    df = documents(spark, SF) if whole else odd
    got = {r["id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df).collect()}
    assert got == _brute_components([(r["doc_id"], r["text"]) for r in df.collect()], 3, 85)


@pytest.mark.parametrize("shingle,percent,own,changed", [(3, 85, 3, 3), (5, 80, 2, 2)])
def test_near_dedup_inside_a_family_of_near_misses(spark, monkeypatch, shingle, percent, own, changed):
    """Pairs just above the least similarity among many texts of one template that are no links."""
    monkeypatch.setattr(near_dedup, "FEW", 4)
    rng = np.random.default_rng(11)
    rows = []
    for family in range(150):
        words = [f"t{i}" for i in range(120)]
        for k in rng.choice(120, own, replace=False):
            words[k] = f"own{family}x{k}"
        rows.append((len(rows), " ".join(words)))
        if family % 2 == 0:
            kept = np.flatnonzero([w[0] == "t" for w in words])
            for k in rng.choice(kept, changed, replace=False):
                words[k] = f"more{family}x{k}"
            rows.append((len(rows), " ".join(words)))
    got = {r["id"]: (r["n_shingles"], r["component_id"], r["kept"])
           for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=shingle, percent=percent).collect()}
    want = _brute_components(rows, shingle, percent)
    linked = [i for i, (_, c, _) in want.items() if c != i]
    assert len(linked) > 60 and sum(got[i] != want[i] for i in want) == 0


def test_trees_keep_the_odds_at_every_depth():
    for percent in (50, 80, 85, 95):
        for depth in (3, 5, 8, 15):
            assert (1 - (percent / 100) ** depth) ** near_dedup.trees(percent, depth) <= 1e-6


def test_near_dedup_without_ids(spark):
    df = spark.createDataFrame([(None, "a b c d"), (None, "a  b c d"), (None, "e f g h"), (None, None)], "doc_id long, text string")
    rows = near_dedup.near_duplicates(df).collect()
    assert len(rows) == 4 and sum(r["kept"] for r in rows) == 3 and all(r["component_id"] in (None, (1 << 63) - 1) for r in rows)


def test_odd_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(3)
    for size in (1, 5, 70, 3000, 20000):
        one = near_dedup.mix64(np.unique(rng.integers(1, 1 << 60, size, dtype=np.uint64)))
        for extra in (0, 1, size // 10, size):
            other = np.unique(np.concatenate((one[extra // 2:], near_dedup.mix64(rng.integers(1, 1 << 60, extra, dtype=np.uint64)))))
            x, y = (np.frombuffer(near_dedup.odd_sketch(s), np.uint64) for s in (one, other))
            got, real = int(near_dedup.differing(x, y[None])[0]), len(np.setxor1d(one, other))
            assert got <= real and (real > 0.16 * size or got >= 0.8 * real - 4)


def test_components_after_more_links(spark):
    first = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (20, 21)], "a long, b long")
    more = spark.createDataFrame([(3, 8), (30, 31), (31, 20), (8, 3)], "a long, b long")
    got = {r["node"]: r["label"] for r in merged(components(first), more).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 20: 20, 21: 20, 30: 20, 31: 20}


def test_secret_scan_masks_in_one_pass(spark, odd):
    rows = odd.limit(0).select("doc_id", "text").unionByName(spark.createDataFrame([(1, None), (2, ""), (3, "password = hunter22 end")], "doc_id long, text string"))
    got = {r["doc_id"]: r["text"] for r in secret_crf.scan(rows, secret_crf.train(rows), mask="[SECRET]").collect()}
    assert got[1] is None and got[2] == "" and "hunter22" not in got[3] and got[3].endswith(" end")


def test_language_id(spark, odd):
    docs = documents(spark, "/root/testdata/sf0.01")
    model = langid.train(docs.filter(~langid.held_out()))
    rows = langid.identify(docs, model).withColumn("h", langid.held_out()).collect()
    held = [r for r in rows if r["h"]]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) == r["h"] for r in rows)
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.98
    by = {r["doc_id"]: r for r in langid.identify(odd, model).collect()}
    assert len(by) == 12 and by[1]["lang_pred"] == by[2]["lang_pred"] == by[10]["lang_pred"] == "und" and by[1]["score"] == 0 and by[1]["rejected"]
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_top_k(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=8).round(1)], i) for i in range(600)]
    rows += [(600, None, 0), (601, [float("nan")] * 8, 0), (602, [None] * 8, 0), (603, [], 0), (604, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "id long, e array<double>, score long").repartition(5)
    vecs = df.select("id", topk.quantised(F.col("e")).alias("vec")).filter("vec is not null")
    got = collections.defaultdict(list)
    for r in topk.top_k(vecs, vecs.filter("id % 20 = 0"), 20, query_block=10).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["id"], r["score"]))
    v = np.floor(64 * np.array([r[1] for r in rows[:600]])).astype(np.int64)
    for q in range(0, 600, 20):
        s = v @ v[q]
        assert got[q] == [(i, s[i]) for i in sorted((i for i in range(600) if i != q), key=lambda i: (-s[i], i))[:20]]
    assert set(got) == set(range(0, 600, 20))


def _brute_pii(t):
    def digits(s):
        return [int(c) for c in s if c.isdigit()]

    def luhn(d):
        return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15)]
    found = [(m.start(), k, m.end(), n) for k, (n, p, ok) in enumerate(kinds) for m in re.finditer(p, t or "", re.ASCII) if ok(m[0])]
    return ",".join(f"{n}:{s}:{e}" for s, _, e, n in sorted(found))


def test_pii(spark):
    texts = [None, "", "a@b.c_d@e.f and x@y", "é a.b+c@mail.example.com 1.2.3.4.5.6.7.8 300.1.1.1 010.020.030.040", "card 4111 1111 1111 1111 or 4041894974608795 4111-1111-1111-1112",
             "+49 (30) 1234-5678 +1 +123456789012345678", "9" * 20000, "a." * 20000, "x@" * 500, "acct DE89370400440532013000 ssn 123-45-6789 and 123-45-6789"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(r["doc_id"] + 100, r["text"]) for r in documents(spark, SF).collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    base = pii.joined(F.filter("pii", lambda s: s["rank"] < 4))
    got = {r["doc_id"]: r for r in pii.scan(df).select("doc_id", base.alias("b"), pii.joined(F.col("pii")).alias("all")).collect()}
    for i, t in rows:
        assert got[i]["b"] == _brute_pii(t), t
    assert got[9]["all"] == "iban:5:27,ssn:32:43"      # the second number has no context word near


def test_decontamination(spark, odd, none):
    items = [(1, "One TWO"), (2, " ".join(PASSAGE.split()[3:20])), (3, None), (4, "!!"), (None, "pass1 pass2")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 60):                         # in one pass and in several
        by = collections.defaultdict(list)
        for r in decontam.contamination(odd, bench, block_bytes=block).collect():
            by[r["doc_id"]].append((r["n_words"], r["n_hit"], r["items"], r["contaminated"]))
        assert by[3] == [(2, 2, ["1"], True)] and by[1] == [(0, 0, [], False)]
        assert by[5] == [(42, 19, ["2"], True)] and len(by[6]) == 2
    assert decontam.contamination(none, bench).count() == 0


def test_wu_manber_against_windows(spark):
    docs, bench = documents(spark, SF).collect(), spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    wins = collections.defaultdict(set)
    for b in bench:
        w = decontam.words_of(b["text"])
        for i in range(max(1, len(w) - 9)):
            wins[tuple(w[i:i + 10])].add(b["item_id"])
    tables = decontam.tables([(b["item_id"], b["text"]) for b in bench])
    for d in docs:
        w = decontam.words_of(d["text"])
        hit, items, want, ids = bytearray(len(w)), set(), bytearray(len(w)), set()
        for t in tables:
            t.search(w, hit, items)
        for m in {len(k) for k in wins}:
            for i in range(len(w) - m + 1):
                if tuple(w[i:i + m]) in wins:
                    want[i:i + m] = b"\x01" * m
                    ids |= wins[tuple(w[i:i + m])]
        assert hit == want and items == ids


def test_wu_manber_on_random_words():
    rng = random.Random(3)
    for trial in range(200):
        known = [f"{chr(97 + i % 26)}{i // 26}" * rng.randint(1, 3) for i in range(rng.choice([2, 5, 40]))]
        bench = [(rng.choice([1, 2, 3, None]), " ".join(rng.choices(known, k=rng.randint(0, 14)))) for _ in range(rng.randint(0, 8))] + [(9, None)]
        w = rng.choices(known + ["unknown"], k=rng.choice([0, 1, 3, 20, 700]))        # 700: several stretches
        hit, items, want, ids = bytearray(len(w)), set(), bytearray(len(w)), set()
        decontam.Searches(bench, 4).search([x.encode() for x in w], hit, items)
        for i, t in bench:
            b = (t or "").split()
            m = min(4, len(b))
            for string in {tuple(b[k:k + m]) for k in range(len(b) - m + 1)} if b else ():
                for p in range(len(w) - m + 1):
                    if tuple(w[p:p + m]) == string:
                        want[p:p + m] = b"\1" * m
                        ids.add(i)
        assert hit == want and items == ids, trial


def test_search_tables_are_small_and_passes_add_up(spark):
    """16 MB of benchmark in several passes, over documents that hold parts of it."""
    items = [(i, " ".join(f"{j * 2654435761 % 99991:x}" for j in range(i * 10000, i * 10000 + 10000))) for i in range(340)]
    size = sum(len(t) for _, t in items)
    assert size > 16 << 20
    part, n = [], 0
    for i, t in items[:20]:
        part.append((i, t))
        n += len(t)
    assert len(pickle.dumps(decontam.Searches(part))) < 20 * n
    rows = [(i, "start " + " ".join(t.split()[50:90]) + " end") for i, t in items[::30]] + [(999, "nothing of it here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], str(r["doc_id"]) in r["items"]) for r in decontam.contamination(docs, bench, block_bytes=6 << 20).collect()}
    assert got == {i: (42, 40, True) for i, _ in rows[:-1]} | {999: (4, 0, False)}


def test_secrets(spark, odd):
    docs = documents(spark, "/root/testdata/sf0.01")
    model = secret_crf.train(docs)
    assert model.useful
    t = 'Token: token:abcdefgh PASSWORD="hunter22" AKIA' + "A1" * 9 + " " + "0f" * 13
    assert [k for _, _, k in secret_crf.base_spans(t)] == ["assign", "access", "hex"]
    assert secret_crf.redact(t, secret_crf.base_spans(t)).count("[SECRET]") == 3
    rows = secret_crf.scan(odd, model).collect()
    assert len(rows) == 13 and {r["doc_id"] for r in rows if r["secrets"]} == {7}      # its run of one hex digit
    for r in secret_crf.scan(docs, model).collect():
        got = [(s["start"], s["end"], s["kind"]) for s in r["secrets"] if s["kind"] != "crf"]
        assert got == secret_crf.base_spans(r["text"])


def test_viterbi_is_exact():
    rng = np.random.default_rng(3)
    trans = rng.normal(size=(3, 3))
    for n in range(1, 7):
        e = rng.normal(scale=3, size=(n, 3))
        best = max(np.ndindex(*[3] * n), key=lambda y: sum(e[i, y[i]] for i in range(n)) + sum(trans[a, b] for a, b in zip((0, *y), (*y, 0))))
        assert secret_crf.tag(e, trans).tolist() == list(best)


def test_mix(spark, odd, none):
    df = mixing.mix(documents(spark, SF))
    rows, again = df.collect(), {r["doc_id"]: r["taken"] for r in df.repartition(7).collect()}
    by = collections.defaultdict(list)
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"] and again[r["doc_id"]] == r["taken"]
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        by[r["source"]].append(r)
    total = sum(r["size"] for r in rows)
    for rs in by.values():
        assert sum(r["taken"] for r in rs) == int(rs[0]["target"] + 1e-9) and rs[0]["source_size"] == sum(r["size"] for r in rs)
        assert rs[0]["target"] <= 2 * rs[0]["source_size"]
    assert abs(sum(rs[0]["target"] for rs in by.values()) - 1.5 * total) < 1e-6 * total
    assert mixing.mix(odd).count() == 13 and mixing.mix(none).count() == 0


def test_quotes(spark):
    rows = [(1, 0, "u", "Hello there.\nSecond line!"), (1, 1, "a", "> hello  THERE\n> second line\nMy answer"),
            (1, 2, "u", ">> Hello there.\n>> Second line!\n> My answer\nThanks"), (2, 0, "u", "> My answer\nfrom elsewhere"),
            (3, 0, "u", None), (3, 1, "u", ""), (3, 1, "u", ""), (None, 1, "u", "> My answer"), (4, 0, "u", "> unknown\n> !!\nbody")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("own"))
    got = {(r["conv_id"], r["turn"]): r for r in quotes.reply_ordered(df).collect()}
    assert got[1, 1]["body"] == "My answer" and (got[1, 1]["parent_conv"], got[1, 1]["parent_turn"]) == (1, 0)
    assert got[1, 2]["n_passages"] == 2 and got[1, 2]["n_linked"] == 2 and got[1, 2]["parent_turn"] == 1 and got[1, 2]["depth"] == 2
    assert (got[2, 0]["thread_conv"], got[2, 0]["depth"], got[2, 0]["position"]) == (1, 2, 3)
    assert got[4, 0]["n_linked"] == 0 and got[4, 0]["body"] == "body" and got[None, 1]["parent_conv"] is None and got[3, 0]["body"] == ""
    assert quotes.reply_ordered(df).count() == 9 and quotes.reply_ordered(df.limit(0)).count() == 0


def _brute_threads(rows):
    """Quotation linking of (conv, turn, text) rows by plain loops."""
    def norm(t):
        return " ".join("".join(c if c.isalpha() or c.isnumeric() else " " for c in t.lower()).split())

    def passages(text):
        out, last = [], None
        for line in (text or "").split("\n"):
            mark = re.match(r"(?:[ \t]*>)+", line)
            rest, level = (line[mark.end():], mark[0].count(">")) if mark else (line, 0)
            level = -1 if not rest.strip(" ") else level
            if level >= 0:
                if level != last:
                    out.append((level, []))
                out[-1][1].append(rest)
            last = level
        return out

    here, own, result = {}, {}, {}
    for c, t, x in sorted(rows):
        own[c, t] = "\n".join(s for s in (x or "").split("\n") if not re.match(r"[ \t]*>", s)).strip()
        for text in [own[c, t]] + [s for level, lines in passages(x) if level == 0 for s in [" ".join(lines), *lines]]:
            here.setdefault(norm(text), []).append((c, t))
    for c, t, x in rows:
        found, n = collections.defaultdict(lambda: [0, None]), 0
        for level, lines in passages(x):
            n += level > 0
            for weight, text in [(len(lines) + 1, " ".join(lines)), *[(1, s) for s in lines]] if level else []:
                places = here.get(norm(text), []) if norm(text) else []
                near = min((p for p in places if p[0] == c), default=None)
                near, to = (1, near) if near and near < (c, t) else (0, min(places, default=None))
                if to and to < (c, t):
                    found[to][0] = max(found[to][0], near)
                    if level == 1:
                        found[to][1] = (found[to][1] or 0) + weight
        best = max(((near, w, p) for p, (near, w) in found.items() if w is not None), default=(0, 0, (None, None)))
        result[c, t] = (own[c, t], n, len(found), *best[2])
    threads = collections.defaultdict(list)
    for m in result:
        root, depth = m, 0
        while result[root][3] is not None:
            root, depth = result[root][3:], depth + 1
        threads[root].append((depth, m))
    return {m: (*result[m], *root, depth, k) for root, ms in threads.items() for k, (depth, m) in enumerate(sorted(ms))}


def test_quotes_against_loops(spark):
    chat = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "text").dropDuplicates(["conv_id", "turn"])
    mail = quotes.as_mail(chat)
    want = _brute_threads([tuple(r) for r in mail.collect()])
    got = {(r[0], r[1]): tuple(r)[2:] for r in quotes.reply_ordered(mail).select(
        "conv_id", "turn", "body", "n_passages", "n_linked", "parent_conv", "parent_turn", "thread_conv", "thread_turn", "depth", "position").collect()}
    assert got == want and max(v[-2] for v in want.values()) > 1


def test_quotes_keep_columns_of_any_name(spark):
    rows = [(1, 0, "hello there", 1, 2, 3, 4), (1, 1, "> hello there\nyes", 5, 6, 7, 8)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string, c long, _cut long, rc long, units long")
    got = {r["turn"]: r for r in quotes.reply_ordered(df).collect()}
    assert [tuple(got[k][c] for c in ("c", "_cut", "rc", "units", "text")) for k in (0, 1)] == [(*r[3:], r[2]) for r in rows]
    assert got[1]["parent_turn"] == 0 and "text" not in quotes.reply_ordered(df, keep_text=False).columns


def test_empty_tables(spark, none):
    for df in (block_dedup.remove_repeats(none), suffix_dedup.remove_repeats(none), near_dedup.near_duplicates(none),
               langid.identify(none, langid.train(none)), secret_crf.scan(none, secret_crf.train(none)), pii.scan(none)):
        assert df.count() == 0
    e = spark.createDataFrame([], "id long, vec array<long>")
    assert topk.top_k(e, e, 20).count() == 0


def test_batches_by_rows_keep_every_row():
    import pyarrow as pa
    batches = [pa.RecordBatch.from_pydict({"a": list(range(n)), "t": ["x"] * n}) for n in (0, 1, 7, 8, 9)]
    got = list(by_rows(iter(batches), 4))
    assert [r for b in got for r in b.to_pylist()] == [r for b in batches for r in b.to_pylist()]
    assert max(b.num_rows for b in got) == 4
