"""Secret scanning with a linear-chain conditional random field.

Three fixed patterns (`assign`, `access`, `hex`) give the base spans, which always stay.
A CRF adds spans of kind `crf`: tokens are tagged as secret begin, inside or outside from
their shape, their own and neighbouring words (hashed) and file features, and decoded with
Viterbi. It is trained here, with stochastic gradient descent in numpy, on a bounded sample
(`SAMPLE_DOCS` documents, at most `PIECES` pieces of `PIECE` tokens); only feature numbers
travel to the driver.

Labels are the base spans, but the base patterns already find those, so the field must not
learn the patterns themselves. Every labelled place is also learnt from `VARIANTS` respellings:
its value is written anew in another alphabet and length, and its keyword and separator are
replaced, which hides both. Unlabelled tokens that look random may be secrets in a form the
patterns do not know: they are left out of the loss (their tag is summed over, not fixed).

Texts are read `TEXT_CHUNK` characters at a time with the neighbouring tokens of the cut, so a
very long text costs memory for its scores only. Decoding is exact and split: where "outside" beats the other tags by more than any
transition can return, the best path must be outside, so only the short stretches between
such tokens go through Viterbi, all of a batch at once.

Defined cases: null and empty texts have no spans; a failing match is dropped and not
searched again; added spans overlap no base span; repeated rows get their own equal spans;
with no sample or no labelled token the CRF adds nothing; other columns are kept.
"""

from __future__ import annotations

import random
import re
import string

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glosspark.llm.common import by_rows, mix64, sharing

# The base patterns and their least lengths.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ["assign", "access", "hex", "crf"]

_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(ACCESS)
_HEX = re.compile(r"[0-9a-f]{24,}")      # a run that long, whole: the same as filtering runs

SAMPLE_DOCS = 4000
PIECE = 64
PIECES = 6000
STEPS = 250
STEP_PIECES = 50    # labelled pieces in a step of training, and as many others
RATE = 0.5
HIDDEN = 0.5        # share of pieces whose words are hidden in a step, so that shapes are learnt too
L2 = 1e-4
VARIANTS = 8        # respellings of each labelled text
MIN_CHARS = 8       # an added span has at least so many characters
LEAST_ODD = 10      # a token looks random from so many characters on, with letters and digits in turn
MIN_MARGIN = 2.0    # and beats the all-outside path by so much
TEXT_CHUNK = 1 << 18

_ALPHABETS = ["0123456789abcdef", "0123456789ABCDEF", string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits,
              string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "-_."]
_SEPARATORS = [" ", "=", " = ", ": ", ":", '="', ' = "', '": "']

OUT, BEGIN, INSIDE = 0, 1, 2


def base_spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind), by start, then kind as listed."""
    t = text or ""
    out = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(t) if len(m[2]) >= LEAST["assign"]]
    out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(t) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(t)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _values(text: str) -> list[tuple[int, int]]:
    """The secret itself in each base span (for labels)."""
    out = [m.span(2) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    return out + [(s, e) for s, e, k in base_spans(text) if k != "assign"]


def respelled(text: str, seed: int) -> tuple[str, list[tuple[int, int]]]:
    """The text with every labelled value written in another alphabet and length, and its keyword
    and separator replaced; and where the new values are."""
    draw = random.Random(seed)
    found = [(m.start(), *m.span(2)) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    found += [(s, s, e) for s, e, k in base_spans(text) if k != "assign"]
    parts, spans, at, size = [], [], 0, 0
    for lead, s, e in sorted(found):
        if lead < at:                     # inside the one before it
            continue
        word = "".join(draw.choices(string.ascii_lowercase, k=draw.randint(2, 10))) + draw.choice(_SEPARATORS) if draw.random() < 0.8 else ""
        parts += [text[at:lead], word]
        size += lead - at + len(word)
        value = "".join(draw.choices(draw.choice(_ALPHABETS), k=draw.randint(10, 64)))
        parts.append(value)
        spans.append((size, size + len(value)))
        size, at = size + len(value), e
    return "".join(parts) + text[at:], spans


# --- tokens and features -----------------------------------------------------

_SPACE, _LOWER, _UPPER, _DIGIT, _JOIN, _PUNCT = range(6)
_CLASS = np.full(256, _PUNCT, np.uint8)
for _c in (9, 10, 11, 12, 13, 32):
    _CLASS[_c] = _SPACE
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = _LOWER, _UPPER, _DIGIT, _LOWER
for _c in "_-+/.":
    _CLASS[ord(_c)] = _JOIN
#: sizes of the feature tables, in the order of the columns of `features`
SHAPES, TURNS, WORDS, FILES = 512, 4, 4096, 16
TABLES = [SHAPES * TURNS, WORDS, WORDS, WORDS, WORDS, SHAPES, SHAPES, FILES]
_OFFSETS = np.cumsum([0] + TABLES[:-1])
N_FEATURES = int(sum(TABLES))


def file_feature(text: str) -> int:
    """How much of the whole text is digits, and `=` or `:`, in four steps each."""
    filled = max(1, len(text) - sum(map(text.count, " \t\n\x0b\x0c\r")))
    digits, signs = sum(map(text.count, string.digits)) / filled, (text.count("=") + text.count(":")) / filled
    return int(np.digitize(digits, (0.01, 0.05, 0.2))) * 4 + int(np.digitize(signs, (0.002, 0.01, 0.04)))


def features(text: str, file: int | None = None):
    """Token starts, ends and feature numbers (tokens x tables): own shape, own word, the
    words one and two before and one after, the shapes before and after, the file; and which
    tokens look random."""
    file = file_feature(text) if file is None else file
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    cls = _CLASS[np.minimum(code, 255)]
    n = len(code)
    wordy = (cls >= _LOWER) & (cls <= _JOIN)
    new = np.empty(n, bool)
    if n:
        new[0] = True
        new[1:] = ~(wordy[1:] & wordy[:-1])
    begins = np.flatnonzero(new & (cls != _SPACE))
    if not len(begins):
        return begins, begins, np.zeros((0, len(TABLES)), np.int64), np.zeros(0, bool)
    cuts = np.flatnonzero(new)
    at = np.searchsorted(cuts, begins)
    ends = np.append(cuts[1:], n)[at]
    size = ends - begins

    def per_token(x):
        c = np.concatenate(([0], np.cumsum(x)))
        return c[ends] - c[begins]

    digits, uppers, lowers, joins = (per_token(cls == k) for k in (_DIGIT, _UPPER, _LOWER, _JOIN))
    turn = np.zeros(n, np.int64)
    turn[1:] = (cls[1:] != cls[:-1])
    turns = per_token(turn) - turn[begins]
    length = np.digitize(size, (2, 4, 7, 11, 16, 24, 36))                       # 8
    ratio = np.where(digits == 0, 0, np.digitize(digits / size, (0.2, 0.5)) + 1)  # 4
    shape = (((length * 4 + ratio) * 2 + (uppers > 0)) * 2 + (lowers > 0)) * 2 + (joins > 0)
    shape = shape * 2 + (cls[begins] == _PUNCT)
    own = shape * TURNS + np.where(turns < 2, 0, 1 + (turns * 6 >= size) + (turns * 3 >= size))
    odd = (size >= LEAST_ODD) & (digits > 0) & (lowers + uppers > 0) & (turns * 3 >= size)
    low = np.where(cls == _UPPER, code + 32, code).astype(np.uint64)
    # hash of the token: each character scrambled with its place in the token, summed
    place = np.zeros(n, np.uint64)
    place[begins] = begins.astype(np.uint64)
    place = np.maximum.accumulate(place)
    mixed = mix64(low * np.uint64(0x100000001B3) + (np.arange(n, dtype=np.uint64) - place))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)))
    word = (mix64(total[ends] - total[begins]) >> np.uint64(52)).astype(np.int64)
    word[odd] = 0                             # a random token says nothing as a word

    def moved(x, k):
        out = np.zeros(len(x), np.int64)
        if k > 0:
            out[k:] = x[:-k]
        else:
            out[:k] = x[-k:]
        return out

    cols = [own, word, moved(word, 1), moved(word, 2), moved(word, -1), moved(shape, 1), moved(shape, -1),
            np.full(len(begins), file)]
    return begins, ends, np.stack(cols, axis=1) + _OFFSETS, odd


def labels(values, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    tag = np.zeros(len(begins), np.int64)
    for s, e in values:
        a, b = np.searchsorted(ends, s, "right"), np.searchsorted(begins, e, "left")
        tag[a:b] = INSIDE
        if b > a:
            tag[a] = BEGIN
    return tag


# --- training ----------------------------------------------------------------

class Crf:
    def __init__(self, weights=None, trans=None):
        self.weights = np.zeros((N_FEATURES, 3), np.float32) if weights is None else weights
        self.trans = np.zeros((3, 3)) if trans is None else trans

    @property
    def useful(self) -> bool:
        return bool(np.any(self.weights))


def _logsum(x, axis):
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


def _expected(e: np.ndarray, tr: np.ndarray, m: np.ndarray):
    """Expected tags (b, t, 3) and transitions (3, 3) of all paths, by forward and backward sums."""
    b, t, _ = e.shape
    alpha, beta = np.empty((b, t, 3)), np.zeros((b, t, 3))
    alpha[:, 0] = e[:, 0]
    for i in range(1, t):
        nxt = _logsum(alpha[:, i - 1, :, None] + tr, 1) + e[:, i]
        alpha[:, i] = np.where(m[:, i, None], nxt, alpha[:, i - 1])
    for i in range(t - 2, -1, -1):
        nxt = _logsum(tr + (e[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
        beta[:, i] = np.where(m[:, i + 1, None], nxt, beta[:, i + 1])
    z = _logsum(alpha[:, -1], 1)[:, None, None]
    p = np.exp(alpha + beta - z) * m[..., None]
    pair = np.exp(alpha[:, :-1, :, None] + tr + (e + beta)[:, 1:, None, :] - z[..., None]) * m[:, 1:, None, None]
    return p, pair.sum(axis=(0, 1))


def fit(feats: np.ndarray, tags: np.ndarray, mask: np.ndarray, known: np.ndarray, seed: int = 11) -> Crf:
    """feats (pieces, PIECE, tables); tags, mask and known (pieces, PIECE). The likelihood of the
    known tags, summed over those of the other tokens: its gradient is the difference of
    what all paths and the paths through the known tags expect."""
    if not len(feats) or not (tags > 0).any():
        return Crf()
    rng = np.random.default_rng(seed)
    w, tr = np.zeros((N_FEATURES + 1, 3)), np.zeros((3, 3))        # the last row is no feature and stays 0
    gw2, gt2 = np.full(w.shape, 1e-6), np.full((3, 3), 1e-6)
    some = (tags > 0).any(axis=1)
    sides = [x for x in (np.flatnonzero(some), np.flatnonzero(~some)) if len(x)]
    for _ in range(STEPS):
        pick = np.concatenate([rng.choice(x, STEP_PIECES) for x in sides])
        f, y, m = feats[pick], tags[pick], mask[pick]
        b = len(pick)
        f[rng.random(b) < HIDDEN, :, 1:5] = N_FEATURES
        e = w[f].sum(axis=2)
        barred = known[pick][..., None] & (np.arange(3) != y[..., None])
        p, gt = _expected(e, tr, m)
        q, gq = _expected(np.where(barred, -1e4, e), tr, m)
        p, gt = p - q, gt - gq
        flat = f[m]
        gw = np.stack([np.bincount(flat.ravel(), np.repeat(p[m][:, k], flat.shape[1]), N_FEATURES + 1) for k in range(3)], axis=1)
        gw, gt = gw / b + L2 * w, gt / b + L2 * tr
        gw2 += gw * gw
        gt2 += gt * gt
        w -= RATE * gw / np.sqrt(gw2)
        w[-1] = 0
        tr -= RATE * gt / np.sqrt(gt2)
    return Crf(w[:-1].astype(np.float32), tr)


def train(docs: DataFrame, id_col="doc_id", text_col="text", sample_docs=SAMPLE_DOCS, pieces=PIECES) -> Crf:
    """Fit on pieces of a hash-chosen sample: all pieces with a labelled token, as they are and
    respelled, and an eighth of the others."""
    n = docs.count()
    if not n:
        return Crf()
    rows = docs.select(F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("h")) \
        .filter(F.col("text").isNotNull()).filter(F.pmod("h", F.lit(1 << 30)) < int(min(1.0, sample_docs / n) * (1 << 30)))

    def cut(batches):
        for pdf in batches:
            out = []
            for text, h in zip(pdf["text"], pdf["h"]):
                values = _values(text)
                forms = [(text, values)] + [respelled(text, int(h) + k) for k in range(VARIANTS if values else 0)]
                for k, (form, spans_) in enumerate(forms):
                    begins, ends, f, odd = features(form)
                    y = labels(spans_, begins, ends)
                    sure = (y > 0) | ~odd
                    for at in range(0, len(y), PIECE):
                        key = int(mix64(np.array([(int(h) + at * (VARIANTS + 1) + k) & (2**64 - 1)], np.uint64))[0] >> np.uint64(2))
                        some, upto = y[at:at + PIECE].any(), at + PIECE
                        if some or (k == 0 and key % 8 == 0):
                            out.append((not some, key, f[at:upto].astype(np.uint16).tobytes(), y[at:upto].astype(np.uint8).tobytes(),
                                        sure[at:upto].tobytes()))
            yield pd.DataFrame(out, columns=["plain", "key", "f", "y", "sure"])

    cutted = rows.mapInPandas(cut, "plain boolean, key long, f binary, y binary, sure binary")
    got = [r for plain in (False, True)
           for r in cutted.filter(F.col("plain") == plain).orderBy("key", "f").limit(pieces // 2).collect()]
    f = np.zeros((len(got), PIECE, len(TABLES)), np.int64)
    y, m, known = np.zeros((len(got), PIECE), np.int64), np.zeros((len(got), PIECE), bool), np.ones((len(got), PIECE), bool)
    for i, r in enumerate(got):
        k = len(r["y"])
        y[i, :k], m[i, :k] = np.frombuffer(r["y"], np.uint8), True
        f[i, :k] = np.frombuffer(r["f"], np.uint16).reshape(k, -1)
        known[i, :k] = np.frombuffer(r["sure"], bool)
    return fit(f, y, m, known)


# --- decoding ----------------------------------------------------------------

def viterbi(e: np.ndarray, trans: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Best tags of padded stretches (n, t, 3) that have an outside token on both sides."""
    n, t, _ = e.shape
    back = np.zeros((n, t, 3), np.int8)
    score = e[:, 0] + trans[OUT]
    for i in range(1, t):
        via = score[:, :, None] + trans
        back[:, i] = via.argmax(axis=1)
        score = np.where((i < lengths)[:, None], via.max(axis=1) + e[:, i], score)
    tags = np.zeros((n, t), np.int64)
    now = (score + trans[:, OUT]).argmax(axis=1)
    for i in range(t - 1, -1, -1):
        live = i < lengths
        tags[live, i] = now[live]
        if i:
            now = np.where(live, back[np.arange(n), i, now], now)
    return tags


def tag(emissions: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Viterbi path of one sequence with outside tokens assumed before and after it."""
    tags = np.zeros(len(emissions), np.int64)
    gain = max(trans[a, x] + trans[x, b] - trans[a, OUT] - trans[OUT, b] for a in range(3) for b in range(3) for x in (BEGIN, INSIDE))
    open_ = emissions[:, OUT] - emissions[:, 1:].max(axis=1) <= gain
    edge = np.diff(np.concatenate(([0], open_.astype(np.int8), [0])))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = stops - starts
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):                   # stretches of like length together
        top = size[order[at]] * 2
        upto = int(np.searchsorted(size[order], top, "right"))
        pick = order[at:upto]
        idx = starts[pick][:, None] + np.arange(size[pick].max())
        live = idx < stops[pick][:, None]
        e = emissions[np.minimum(idx, len(emissions) - 1)]
        got = viterbi(e, trans, size[pick])
        tags[idx[live]] = got[live]
        at = upto
    return tags


#: a character at which a text may be cut: none of a word's
_EDGE = re.compile(r"[^A-Za-z0-9_+/.\x80-\U0010ffff-]")


def emissions(text: str, model: Crf, chunk: int = TEXT_CHUNK):
    """Token starts and ends of the whole text and their scores (tokens x 3). A chunk ends where no
    token is cut, and hands its last token and the two before it on to the next one, so the
    result is that of the text read at once."""
    file, n = file_feature(text), len(text)
    parts, left, fresh, end = [], 0, 0, 0
    while end < n:
        edge = _EDGE.search(text, min(n, end + chunk))
        end = edge.start() if edge else n
        begins, ends, f, _ = features(text[left:end], file)
        if len(begins) < 4 and end < n:
            continue                           # hardly a token yet: read on
        e = np.zeros((len(begins), 3))
        for k in range(f.shape[1]):
            e += model.weights[f[:, k]]
        give = slice(int(np.searchsorted(begins + left, fresh)), len(begins) if end == n else len(begins) - 1)
        parts.append((begins[give] + left, ends[give] + left, e[give]))
        if end < n:
            left, fresh = left + int(begins[-3]), left + int(begins[-1])
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 3))
    return tuple(np.concatenate(x) for x in zip(*parts))


def crf_spans(text: str, model: Crf, base) -> list[tuple[int, int, str]]:
    """Spans the CRF adds: tagged tokens, joined while inside, clear of base spans."""
    begins, ends, e = emissions(text, model)
    if not len(begins):
        return []
    tags = tag(e, model.trans)
    out = []
    hits = np.flatnonzero(tags != OUT)
    k = 0
    while k < len(hits):
        j = k + 1
        while j < len(hits) and hits[j] == hits[j - 1] + 1 and tags[hits[j]] == INSIDE:
            j += 1
        a, b = hits[k], hits[j - 1]
        s, t = int(begins[a]), int(ends[b])
        margin = float((e[hits[k:j], tags[hits[k:j]]] - e[hits[k:j], OUT]).sum())
        if t - s >= MIN_CHARS and margin >= MIN_MARGIN and not any(s < y and x < t for x, y, _ in base):
            out.append((s, t, "crf"))
        k = j
    return out


def spans(text: str | None, model: Crf) -> list[tuple[int, int, str]]:
    base = base_spans(text)
    if text and model.useful:
        base = sorted(base + crf_spans(text, model, base), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return base


SPAN_TYPE = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                                      T.StructField("kind", T.StringType())]))


def scan(docs: DataFrame, model: Crf, text_col: str = "text", out_col: str = "secrets", mask: str | None = None) -> DataFrame:
    """`docs` with array<struct<start, end, kind>> of its text: code points, end exclusive. With a
    `mask`, the text has it in place of every span: scan and redaction share one Python worker."""
    shared = sharing(docs.sparkSession, model)
    base = docs.drop(out_col)
    names = base.columns
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches):
        m = shared()
        for batch in by_rows(batches):
            got = [[{"start": s, "end": e, "kind": k} for s, e, k in spans(t.as_py(), m)] for t in batch.column(names.index(text_col))]
            cols = list(batch.columns)
            if mask is not None:
                at = names.index(text_col)
                texts = [redact(t.as_py(), [(x["start"], x["end"]) for x in found], mask) if found else t.as_py() for t, found in zip(batch.column(at), got)]
                cols[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(cols + [pa.array(got, kind)], names=names + [out_col])

    return base.mapInArrow(run, T.StructType(base.schema.fields + [T.StructField(out_col, SPAN_TYPE)]))


def redact(text: str, found, mask: str = "[SECRET]") -> str:
    """The text with every span replaced (overlapping spans as one); spans by start."""
    out, at, open_to = [], 0, -1
    for s, e, *_ in found:
        if s >= open_to:
            out += [text[at:s], mask]
        open_to = at = max(open_to, e)
    return "".join(out) + text[at:]
