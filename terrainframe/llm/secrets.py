"""Secret scans: fixed patterns, and a linear-chain conditional random field that tags tokens begin, inside or outside.

Base spans are pattern matches (kinds assign, access, hex), leftmost and non-overlapping per kind; a span is the whole match.
The field's features are a token's shape, the shapes of two tokens before and one after, the words there (hashed, ``WORD_BUCKETS``
weights for each of the three places) and the file's digit and symbol shares. Weights come from maximum likelihood over a bounded sample:
at most about ``TRAIN_DOCS`` documents, drawn by the hash of their ids; of each whole text ``WINDOWS_A_TEXT`` windows around tagged
tokens and two others, at random places; of these at most ``TRAIN_WINDOWS`` with a secret and as many without. They are tagged
by the base patterns, and joined by windows into which generated credentials, or harmless long tokens, are set. Decoding is Viterbi over
the whole text. Its spans of ``LEAST`` or more characters, with letters and digits, that touch no base span are added as kind crf.

Plan: one count, one pass that draws windows (a bounded number of rows to the driver, where the weights are fitted), one
Arrow UDF over the texts. A token's scores are computed once a worker and kept in a memo of ``MEMO`` entries. A text in
which outside beats the other tags at each token by more than transitions can return is outside as a whole, and isn't decoded.
All patterns are linear in the text, runs of blanks included.

Edge cases: a null text is empty; an empty text has no span; equal rows give equal spans; without any document the field
is fitted on generated windows alone.
"""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrainframe.llm.common import discard, forget_long, materialise
from terrainframe.llm.lockstep import viterbi
from terrainframe.llm.packing import slices

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

TRAIN_DOCS, TRAIN_WINDOWS, WINDOWS_A_TEXT, AROUND, STEPS, LEAST, MEMO, SLICE = 2000, 1200, 4, 10, 100, 8, 500_000, 1_500_000
#: Characters of a training token: what its shape tells doesn't change beyond.
TOKEN_MOST = 400
#: Blanks before a token belong to its match, so that places are sums of lengths; blanks at the end are a match of their own.
TOKEN = re.compile(r"\s*+(?:[^\s\x00-\x1f!-*,:-<>-@\[-^`{-\x7f]+|\S|\Z)")
#: A credential has letters and digits; numbers alone are left to other rules.
LETTER, DIGIT = re.compile("[A-Za-z]"), re.compile("[0-9]")
OUT, BEGIN, INSIDE = 0, 1, 2
N_SHAPES, N_FILE = 56, 6
#: Weights for hashed words at each of the places two before, one before and one after a token.
WORD_BUCKETS, WORD_PENALTY = 1024, 2e-3
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key", "key", "credential", "auth", "bearer", "pwd")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def secret_parts(text: str) -> list[tuple[int, int]]:
    """The value parts of base spans: what the field learns to tag."""
    out = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    return out + [(a, b) for a, k, b in base_spans(text) if k]


def plain(token: str) -> tuple | None:
    """For letters in lower, title or upper case, with or without a last point: what their shape depends on."""
    bare = token[:-1] if token[-1] == "." else token
    if bare.isalpha() and (case := 1 if bare.islower() else 2 if bare.istitle() else 3 if bare.isupper() else 0) and bare.lower() not in _WORDS:
        return len(token), len(bare), case, bare.isascii()
    return None


def shape(token: str) -> list[int]:
    """Numbers of the features that hold for a token (given without blanks), below ``N_SHAPES``."""
    n = len(token)
    out = [0, 1 + min(7, n // 4 if n < 16 else 4 + (n - 16) // 8)]
    lower, upper = sum("a" <= c <= "z" for c in token), sum("A" <= c <= "Z" for c in token)
    digits = sum("0" <= c <= "9" for c in token)
    other = n - lower - upper - digits
    if n == 1 and not lower + upper + digits:
        return out + [10 + ("=:\"'`|,.;()[]{}<>@".find(token) + 1 if token.isascii() else 0)]
    if not token.isascii():
        out.append(9)
    out.append(29 + (lower > 0) + 2 * (upper > 0) + 4 * (digits > 0))
    if upper == 1 and lower and "A" <= token[0] <= "Z":
        out.append(37)
    if digits:
        turns = sum((a.isdigit()) != (b.isdigit()) for a, b in zip(token, token[1:], strict=False))
        out.append(38 + min(3, turns // 2))
    if n >= 8 and digits + other:
        out.append(42 + min(3, len(set(token)) * 4 // n))
        if not token.lower().strip("0123456789abcdef"):
            out.append(46)
        if upper and lower and sum(a.islower() and b.isupper() for a, b in zip(token, token[1:], strict=False)) >= 2:
            out.append(47)
    if other:
        out.append(48 + ("_" in token or "-" in token) + 2 * ("+" in token or "/" in token))
    low = token.lower().rstrip("=.")
    if low in _WORDS or low.endswith(("_key", "_token", "_secret", "_password")):
        out.append(52)
    if token[-1] == "=":
        out.append(53)
    if re.match(r"(?:AKIA|ghp_|gho_|sk[-_]|eyJ|xox[abp]-)", token):
        out.append(54)
    if "." in token[:-1]:
        out.append(55)
    return out


def file_features(tokens: int, digits: int, symbols: int) -> list[int]:
    share = lambda x: 0 if x * 200 < tokens else 1 if x * 20 < tokens else 2
    return [share(digits), 3 + share(symbols)]


def matches(text: str) -> list[str]:
    """Tokens with the blanks before them."""
    found = TOKEN.findall(text)
    while found and not found[-1].strip():
        found.pop()
    return found


def word_bucket(token: str) -> int:
    """Bucket of a word (two letters or more, any case), or -1 for other tokens."""
    bare = token.rstrip(".,")
    return zlib.crc32(bare.lower().encode("utf-8", "surrogatepass")) % WORD_BUCKETS if len(bare) > 1 and bare.isalpha() else -1


def tokenize(text: str) -> tuple[list[str], list[int], list[int]]:
    """Tokens with their starts and ends."""
    tokens, starts, ends, at = [], [], [], 0
    for t in matches(text):
        at += len(t)
        bare = t.lstrip()
        tokens.append(bare)
        starts.append(at - len(bare))
        ends.append(at)
    return tokens, starts, ends


def tags(starts: list[int], ends: list[int], parts: list[tuple[int, int]]) -> list[int]:
    out = [OUT] * len(starts)
    for a, b in parts:
        tag = BEGIN
        for i in range(bisect_right(ends, a), bisect_left(starts, b)):
            out[i] = tag
            tag = INSIDE
    return out


def windows(text: str) -> Iterator[tuple[list[str], list[int], list[int]]]:
    """Training windows of a whole text: around tagged tokens, and two others. (tokens, tags, file features)"""
    tokens, starts, ends = tokenize(text)
    if not tokens:
        return
    found = tags(starts, ends, secret_parts(text))
    about = file_features(len(tokens), sum(t[0].isdigit() for t in tokens), sum(len(t) == 1 and not t.isalnum() for t in tokens))
    tagged = [i for i, k in enumerate(found) if k == BEGIN]
    rng = random.Random(len(text))
    for i in [*rng.sample(tagged, min(WINDOWS_A_TEXT, len(tagged))), rng.randrange(len(tokens)), rng.randrange(len(tokens))]:
        a, b = max(0, i - AROUND), i + AROUND
        yield tokens[a:b], found[a:b], about


def generated(samples: list[list[str]], n: int = 600) -> Iterator[tuple[list[str], list[int], list[int]]]:
    """Windows without secrets into which a credential of some common form is set."""
    rng = random.Random(11)
    plain = "abcdefghijklmnopqrstuvwxyz"
    forms = [
        lambda: "".join(rng.choices("0123456789abcdef", k=rng.choice((20, 24, 32, 40, 64)))),
        lambda: "".join(rng.choices(plain + plain.upper() + "0123456789+/", k=rng.choice((24, 32, 40, 44)))) + "=" * rng.randrange(3),
        lambda: "AKIA" + "".join(rng.choices(plain.upper() + "0123456789", k=16)),
        lambda: rng.choice(("ghp_", "gho_", "sk-", "sk_live_")) + "".join(rng.choices(plain + plain.upper() + "0123456789", k=36)),
        lambda: "".join(rng.choices(plain + plain.upper() + "0123456789_-.", k=rng.randrange(10, 20))) + str(rng.randrange(10, 99)),
    ]
    for _ in range(n):
        words = rng.choice(samples) if samples else ["the", "of", "and"]
        at = rng.randrange(len(words) + 1)
        key, quote = rng.choice(_WORDS), rng.choice(('"', "'", ""))
        lead = [*([key] if rng.random() < 0.8 else []), rng.choice(("=", ":")), *[quote] * bool(quote)]
        if rng.random() < 0.15:
            lead = []
        yield [*words[:at], *lead, rng.choice(forms)(), *[quote] * bool(quote and lead), *words[at:]], [OUT] * (at + len(lead)) + [BEGIN] + [OUT] * (len(words) - at + bool(quote and lead)), [rng.randrange(2), 3 + rng.randrange(3)]


def harmless(samples: list[list[str]], n: int = 300) -> Iterator[tuple[list[str], list[int], list[int]]]:
    """Windows into which an address, a link, a date or a number is set: long mixed tokens that are no secrets."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(4, 14)))
    forms = [
        lambda: f"{word()}.{rng.randrange(100):02}@{word()}{rng.randrange(10)}.{word()}.com",
        lambda: f"https://{word()}{rng.randrange(99)}.{word()}.org/{word()}/{rng.randrange(10**5)}.html",
        lambda: f"{rng.randrange(1900, 2100)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}T{rng.randrange(10**6)}",
        lambda: str(rng.randrange(10**15, 10**16)),
        lambda: f"{word()}_{word()}{rng.randrange(99)}",
        lambda: f"+{rng.randrange(1, 99)}-{rng.randrange(100, 999)}-{rng.randrange(10**6, 10**7)}",
    ]
    for _ in range(n):
        words = rng.choice(samples) if samples else ["the", "of", "and"]
        at = rng.randrange(len(words) + 1)
        tokens = [*words[:at], *tokenize(rng.choice(forms)())[0], *words[at:]]
        yield tokens, [OUT] * len(tokens), [rng.randrange(2), 3 + rng.randrange(3)]


def fit_weights(given: list[tuple[list[str], list[int], list[int]]]) -> dict:
    """Maximum likelihood with a small quadratic penalty, by adaptive gradient steps over all windows at once."""
    longest, n = max(len(t) for t, _, _ in given), len(given)
    width = 4 * N_SHAPES + N_FILE
    x = np.zeros((n, longest, width), np.float32)
    y = np.zeros((n, longest), np.int64)
    used = np.zeros((n, longest), np.float32)
    memo: dict[str, list[int]] = {}
    #: Buckets of the words two before, one before and one after; the last row of weights stays zero.
    near = np.full((3, n, longest), WORD_BUCKETS, np.int64)
    for i, (tokens, found, about) in enumerate(given):
        own = np.array([WORD_BUCKETS if (b := word_bucket(t)) < 0 else b for t in tokens])
        near[0, i, 2 : len(own)], near[1, i, 1 : len(own)], near[2, i, : len(own) - 1] = own[:-2], own[:-1], own[1:]
        shapes = [memo[t] if t in memo else memo.setdefault(t, shape(t)) for t in tokens]
        for t, s in enumerate(shapes):
            for lag, block in ((0, 0), (1, 1), (2, 2), (-1, 3)):
                if 0 <= t + lag < len(tokens):
                    x[i, t + lag, [block * N_SHAPES + k for k in s]] = 1
            x[i, t, [4 * N_SHAPES + k for k in about]] = 1
            y[i, t], used[i, t] = found[t], 1
    w, change, words = np.zeros((width, 3)), np.zeros((3, 3)), np.zeros((3, WORD_BUCKETS + 1, 3))
    seen_v = np.full(words.shape, 1e-6)
    barred = np.zeros((3, 3))
    barred[OUT, INSIDE] = -1e4
    flat = x.reshape(-1, width)
    truth = np.eye(3)[y] * used[..., None]
    pairs = (truth[:, :-1, :, None] * truth[:, 1:, None, :]).sum((0, 1))
    seen_w, seen_c = np.full(w.shape, 1e-6), np.full(change.shape, 1e-6)

    def total(a: np.ndarray, axis: int) -> np.ndarray:
        top = a.max(axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis))

    for _ in range(STEPS):
        e = ((flat @ w.astype(np.float32)).reshape(n, longest, 3).astype(float) + words[0, near[0]] + words[1, near[1]] + words[2, near[2]]) * used[..., None]
        c = change + barred
        ahead, behind = np.zeros((n, longest, 3)), np.zeros((n, longest, 3))
        ahead[:, 0] = e[:, 0] + np.array([0, 0, -1e4])
        for t in range(1, longest):
            step = total(ahead[:, t - 1, :, None] + c, 1) + e[:, t]
            ahead[:, t] = np.where(used[:, t, None] > 0, step, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            step = total(c + (e[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where(used[:, t + 1, None] > 0, step, behind[:, t + 1])
        z = total(ahead[:, -1], 1)
        own = np.exp(np.minimum(0, ahead + behind - z[:, None, None])) * used[..., None]
        two = np.exp(np.minimum(0, ahead[:, :-1, :, None] + c + (e + behind)[:, 1:, None, :] - z[:, None, None, None])) * used[:, 1:, None, None]
        lost = (truth - own).reshape(-1, 3)
        grad_v = np.stack([np.column_stack([np.bincount(place.ravel(), lost[:, k], WORD_BUCKETS + 1) for k in range(3)]) for place in near]) / n - WORD_PENALTY * words
        grad_v[:, WORD_BUCKETS] = 0
        grad_w = flat.T @ (truth - own).reshape(-1, 3).astype(np.float32) / n - 1e-4 * w
        grad_c = (pairs - two.sum((0, 1))) / n - 1e-4 * change
        seen_w += grad_w**2
        seen_c += grad_c**2
        seen_v += grad_v**2
        w += 0.5 * grad_w / np.sqrt(seen_w)
        change += 0.5 * grad_c / np.sqrt(seen_c)
        words += 0.2 * grad_v / np.sqrt(seen_v)
    return {"key": uuid4().hex, "w": w.astype(np.float32), "words": words.astype(np.float32), "change": (change + barred).astype(np.float32)}


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS) -> dict:
    """A model of at most ``TRAIN_WINDOWS`` windows with secrets and as many without, of about ``train_docs`` documents drawn by a hash of id and text.

    Windows are drawn by hash in the plan, so the driver gets no more of them, however many rows have no id or one; a window's tokens are cut to ``TOKEN_MOST`` characters.
    """
    text = F.col(text_col).cast("string")
    known = docs.select(F.xxhash64(F.col(id_col).cast("string"), text).alias("h"), text.alias("text")).where(F.col("text").isNotNull())
    count = known.count()

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x for t in batch.column(0).to_pylist() for x in windows(t)]
            tokens = [[t[:TOKEN_MOST] for t in r[0]] for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.list_(pa.string())), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.list_(pa.int64())), pa.array([any(r[1]) for r in rows], pa.bool_())], names=["tokens", "tags", "about", "tagged"])

    drawn = known.where(F.pmod("h", F.lit(1 << 24)) < F.lit(min(1.0, train_docs / max(1, count)) * (1 << 24))).select("text")
    found = materialise(drawn.mapInArrow(draw, "tokens array<string>, tags array<long>, about array<long>, tagged boolean"), "training-windows")
    some = lambda tagged: found.where(F.col("tagged") == tagged).orderBy(F.xxhash64("tokens", "tags"), "tokens", "tags", "about").limit(TRAIN_WINDOWS).collect()
    given = sorted((list(r.tokens), list(r.tags), list(r.about)) for r in [*some(True), *some(False)])
    discard(found)
    order = random.Random(7)
    order.shuffle(given)
    tagged, others = [x for x in given if any(x[1])], [x for x in given if not any(x[1])]
    plain_windows = [t for t, _, _ in others]
    return fit_weights([*tagged[:TRAIN_WINDOWS], *others[:TRAIN_WINDOWS], *generated(plain_windows), *harmless(plain_windows)])


class Tagger:
    """A token's part in its own scores and in those of the tokens next to it, kept by token."""

    def __init__(self, model: dict):
        self.w, self.change, self.words = model["w"], model["change"], model["words"]
        free = self.change[self.change > -1e3]
        self.margin = 2 * max(0.0, float(free.max() - self.change[OUT, OUT]))
        self.clear()

    def clear(self) -> None:
        self.memo: dict[str, int] = {}
        self.alike: dict[tuple, int] = {}
        self.rows = np.zeros((1, 4, 3), np.float32)
        self.kind = np.zeros(1, np.int8)

    def learn(self, tokens: set[str]) -> None:
        if max(len(self.memo), len(self.rows)) + len(tokens) > MEMO:
            self.clear()
        new = list(tokens.difference(self.memo))
        if not new:
            return
        blocks = self.w[: 4 * N_SHAPES].reshape(4, N_SHAPES, 3)
        rows, kinds, memo, alike, n = [], [], self.memo, self.alike, len(self.rows)
        for t in new:
            bare = t.lstrip()
            key, bucket = plain(bare), word_bucket(bare)
            if key:
                key = (*key, bucket)
            row = alike.get(key) if key else None
            if row is None:
                row = n + len(rows)
                own = blocks[:, shape(bare)].sum(1)
                own[1] += self.words[1, bucket]
                own[2] += self.words[0, bucket]
                own[3] += self.words[2, bucket]
                rows.append(own)
                kinds.append(1 if bare[0].isdigit() else 2 if len(bare) == 1 and not bare.isalnum() else 0)
                if key:
                    alike[key] = row
            memo[t] = row
        if rows:
            self.rows, self.kind = np.concatenate((self.rows, np.array(rows, np.float32))), np.concatenate((self.kind, np.array(kinds, np.int8)))

    def added(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """Spans of begin and inside tokens, by text."""
        found = [matches(t) for t in texts]
        known = set().union(*found)
        self.learn(known)
        get = self.memo.__getitem__
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        if not lengths.sum():
            return out
        first = np.cumsum(lengths + 2) - lengths
        ids = np.zeros(int((lengths + 2).sum()) + 1, np.int64)
        inner = np.ones(len(ids), bool)
        inner[first - 1] = inner[first - 2] = inner[-1] = False
        ids[inner] = np.fromiter((x for t in found for x in map(get, t)), np.int64, int(lengths.sum()))
        forget_long(self.memo, known)
        owner = np.repeat(np.arange(len(texts)), lengths)
        scores = self.rows[ids, 0]
        scores[1:] += self.rows[ids[:-1], 1]
        scores[2:] += self.rows[ids[:-2], 2]
        scores[:-1] += self.rows[ids[1:], 3]
        scores = scores[inner]
        kinds = self.kind[ids[inner]]
        digits, symbols = np.bincount(owner, kinds == 1, len(texts)), np.bincount(owner, kinds == 2, len(texts))
        about = np.array([self.w[[4 * N_SHAPES + k for k in file_features(int(n), int(d), int(s))]].sum(0) for n, d, s in zip(lengths, digits, symbols, strict=True)], np.float32)
        scores += about[owner]
        open_ = scores[:, OUT] - scores[:, 1:].max(1) <= self.margin
        texts_open = np.flatnonzero(np.bincount(owner, open_, len(texts)))
        if not len(texts_open):
            return out
        chosen = np.isin(owner, texts_open)
        start = np.array([0, 0, -1e4], np.float32)
        labels = viterbi(scores[chosen], lengths[texts_open], self.change, start)
        at = 0
        for i in texts_open:
            own = labels[at : at + lengths[i]]
            at += lengths[i]
            hits = np.flatnonzero(own)
            if not len(hits):
                continue
            ends = np.cumsum(np.fromiter(map(len, found[i]), np.int64, len(found[i])))
            for j in hits:
                if own[j] == BEGIN or not out[i]:
                    out[i].append((int(ends[j]) - len(found[i][j].lstrip()), int(ends[j])))
                else:
                    out[i][-1] = (out[i][-1][0], int(ends[j]))
        return [[(a, a + n) for a, b in spans if (n := len(texts[i][a:b].rstrip(".,"))) >= LEAST and LETTER.search(texts[i][a:b]) and DIGIT.search(texts[i][a:b])] for i, spans in enumerate(out)]


def spans(texts: list[str], tagger: Tagger) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end): base spans, and the field's that touch none of them (the last end of those that start before it tells)."""
    out = []
    for text, more in zip(texts, tagger.added(texts), strict=True):
        base = base_spans(text)
        starts, last = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
        free = lambda a, b: not (k := bisect_left(starts, b)) or last[k - 1] <= a  # noqa: B023, E731
        out.append(sorted(base + [(a, 3, b) for a, b in more if free(a, b)]))
    return out


_ONE: dict[str, Tagger] = {}


def scan(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """``docs`` with ``secrets``: an array of (kind, start, end), by start and then kind as in ``KINDS``; ends exclusive."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if model_key not in _ONE:
            _ONE.clear()
            _ONE[model_key] = Tagger(shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.to_pylist()]
            found = [x for a, b in slices(texts, SLICE) for x in spans(texts[a:b], _ONE[model_key])]
            yield pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in row] for row in found], kind)

    model_key = model["key"]
    return docs.drop("secrets").withColumn("secrets", F.arrow_udf(find, "array<struct<kind:string,start:long,end:long>>")(F.col(text_col).cast("string")))
