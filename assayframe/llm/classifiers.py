"""Text classifiers that are trained here: quality from positives and unlabelled text, toxicity by boosted trees.

Quality learns from every row, in parts of bounded size; toxicity on a bounded sample of rows (``sample``, a
documented parameter; rows with the lowest hash of doc_id, so any cluster picks the same). Both score every row in
one pass over whole texts.
A null text counts as empty; empty texts get a score like any other. Rows whose doc_id is null are
scored, but never learned from. Repeated rows and further columns of the input do no harm. Without
any labelled row of a kind the score is one half (quality) or zero (toxicity).
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .shards import trim

_SYMBOLS, _PUNCT, _ENDS = list(b"#*$%&|<>"), list(b",;:-()'\""), list(b".!?")


def held_out(modulus: int = 3, left: int = 1) -> F.Column:
    """Rows that nothing is learned from: crc32 of doc_id as text leaves ``left``."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == left, F.lit(False))


def bounded(rows: DataFrame, n: int) -> DataFrame:
    """At most ``n`` rows, those whose doc_id hashes lowest."""
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


# ---- quality: positive-unlabelled learning ------------------------------------------------------


def shape(text: bytes | None) -> list[float]:
    """Dense features of one whole text; nothing but the text goes in."""
    text = text or b""
    c = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    n, w = max(len(text), 1), max(len(words), 1)
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:]))) if w > 1 else 1
    upper, lower = int(c[65:91].sum()), int(c[97:123].sum())
    longest = max(map(len, words), default=0)
    return [
        np.log1p(len(words)),
        np.log1p(len(text)) / 10,
        float(c[_SYMBOLS].sum()) / w,
        float(c[124]) / w,
        float(c[33]) / w,
        float(c[63]) / w,
        float(c[46]) / w,
        float(c[_PUNCT].sum()) / w,
        float(c[_ENDS].sum()) / max(len(lines), 1),
        upper / max(upper + lower, 1),
        float(c[48:58].sum()) / n,
        float(c[128:].sum()) / n,
        n / w,
        longest,
        np.log(distinct + 1) / np.log(w + 1),
        pairs / max(w - 1, 1),
        1 - len(set(lines)) / max(len(lines), 1),
        w / max(len(lines), 1),
    ]


def shapes(docs: DataFrame) -> DataFrame:
    return common.map_text(
        docs, ["doc_id"], lambda cols, texts: {"doc_id": cols["doc_id"], "x": [shape(t) for t in texts]}, "doc_id bigint, x array<double>"
    )


_SIZE = 20_000


def cuts_of(shaped: DataFrame, bins: int = 12) -> list[np.ndarray]:
    """Where bins of each feature end, by quantiles of all rows: values are counted with nine binary digits after the first."""

    def run(batches):
        for batch in batches:
            x = _matrix(batch)
            for j in range(x.shape[1]):
                v, n = np.unique(x[:, j].astype(np.float32).view(np.int32) >> 14, return_counts=True)
                yield pa.RecordBatch.from_pydict({"j": pa.array([j] * len(v), pa.int32()), "v": pa.array(v, pa.int32()), "n": pa.array(n, pa.int64())})

    counted = shaped.select("x").mapInArrow(run, "j int, v int, n bigint").groupBy("j", "v").agg(F.sum("n").alias("n")).collect()
    out = []
    for j in range(len(shape(None))):
        v, n = (np.array(c) for c in zip(*sorted((r.v, r.n) for r in counted if r.j == j)))
        value, upto = (v.astype(np.int32) << 14).view(np.float32).astype(float), n.cumsum()
        cuts = np.unique(value[np.searchsorted(upto, np.linspace(0, 1, bins + 1)[1:-1] * upto[-1])])
        # rare extremes matter as much as quantiles: three more cuts between the largest quantile and the maximum
        out.append(np.unique(np.concatenate([cuts, np.linspace(cuts[-1], value[-1], 5)[1:-1]])))
    return out


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def halves(positive: np.ndarray, unlabelled: np.ndarray, k: int) -> list[float]:
    """What :func:`class_prior` has to know of a part: rows in the other halves, and shares of them above thresholds on their scores.

    A model tells half of the positives from half of the unlabelled. Thresholds that leave few positives are not looked at.
    """
    w, b = fitted(positive[::2], unlabelled[::2], k, 0.5, rounds=300)
    p, u = (np.sort(_sigmoid(w[x[1::2]].sum(1) + b)) for x in (positive, unlabelled))
    if len(p) < 20 or len(u) < 20:
        return []
    t = np.quantile(p, np.linspace(0, 0.5, 101))
    return [len(p), len(u), *(1 - np.searchsorted(p, t, "left") / len(p)), *(1 - np.searchsorted(u, t, "left") / len(u))]


def class_prior(parts: Iterable[list[float]], sure: float = 2.0) -> float:
    """Share of good texts among the unlabelled, from trusted positives and unlabelled text alone.

    Above any threshold on scores lies at most prior times the positives' share of the unlabelled, and just that where
    no bad text scores so high; so the smallest ratio of the two shares, over all parts, is the estimate. It is a low one, by ``sure``
    standard errors of each share: too high a prior lets bad texts pass as good, one slightly too low costs little.
    """
    p = u = fp = fu = 0
    for n, m, *shares in parts:
        p, u, fp, fu = p + n, u + m, fp + n * np.array(shares[:101]), fu + m * np.array(shares[101:])
    if not p:
        return 0.5
    fp, fu = fp / p, fu / u
    error = lambda f, n: sure * np.sqrt(f * (1 - f) / n)
    return float(np.clip(((fu - error(fu, u)) / (fp + error(fp, p))).min(), 0.05, 0.95))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fitted(p: np.ndarray, u: np.ndarray, k: int, prior: float, rounds: int = 1000, rate: float = 0.1, l2: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights of ``k`` bins and a constant, fitted to the non-negative unbiased risk of rows of bins.

    Risk: prior * E_pos[l(f)] + max(0, E_unl[l(-f)] - prior * E_pos[l(-f)]), with logistic loss l.
    Where the second part would turn negative its gradient is reversed, so the model can't gain by
    calling the trusted positives negative.
    """
    w, b = np.zeros(k), np.log(prior / (1 - prior))
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    push = lambda i, g: np.bincount(i.ravel(), np.repeat(g, i.shape[1]), k) / len(i)
    for t in range(1, rounds + 1):
        sp, su = _sigmoid(w[p].sum(1) + b), _sigmoid(w[u].sum(1) + b)
        rest = np.mean(-np.log(1 - su + 1e-12)) - prior * np.mean(-np.log(1 - sp + 1e-12))
        first = np.append(prior * push(p, sp - 1), prior * np.mean(sp - 1))
        second = np.append(push(u, su) - prior * push(p, sp), su.mean() - prior * sp.mean())
        g = first + second if rest >= 0 else -second
        g[:-1] += l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


class PositiveUnlabelled:
    """Additive logistic model over the bins that ``cuts`` make of each feature."""

    def __init__(self, cuts: list[np.ndarray]):
        self.cuts, self.w, self.b = cuts, np.zeros(0), 0.0
        self.at = np.cumsum([0] + [len(c) + 1 for c in cuts])

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Bins of a row's features, each counted from its feature's first."""
        return np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.w[self.bins(x) + self.at[:-1]].sum(1) + self.b)


def parts_of(coded: DataFrame, good: DataFrame, size: int) -> DataFrame | None:
    """``(part, kind, o, code)``: all rows dealt to parts of about ``size``, and to each part about half as many positives.

    Every row is in one part as unlabelled. Positives all go to as many parts, to one only where there are enough of them.
    Without rows or positives there is nothing to learn.
    """
    trusted = coded.join(good, "doc_id", "left_semi")
    n, p = coded.count(), trusted.count()
    if not p:
        return None
    parts = -(-n // size)
    times = min(parts, -(-size // 2 * parts // p))
    part = lambda i: F.pmod(F.xxhash64("o", F.lit("part")) + i, F.lit(parts)).cast("int").alias("part")
    rows = coded.select(part(F.lit(0)), F.lit(0).alias("kind"), "o", "code")
    again = trusted.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).select(part(F.col("i")), F.lit(1).alias("kind"), "o", "code")
    return rows.unionByName(again).repartition(min(3 * parts, 2000), "part").sortWithinPartitions("part", "kind", "o", "code")


def each_part(parts: DataFrame, at: np.ndarray, f: Callable) -> Iterator[tuple[int, list[float]]]:
    """Rows, and ``f(positive, unlabelled)``, of every part, on the executors and in order."""

    def run(batches):
        now, held = None, {0: [], 1: []}
        for batch in batches:
            part, kind = (batch.column(c).to_numpy() for c in ("part", "kind"))
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(part), len(at) - 1)
            new = np.flatnonzero(np.diff(part)) + 1
            for i, j in zip([0, *new.tolist()], [*new.tolist(), len(part)]):
                if j > i:
                    if now is not None and part[i] != now:
                        yield from done(held)
                        held = {0: [], 1: []}
                    now = part[i]
                    for x in (0, 1):
                        held[x].append(code[i:j][kind[i:j] == x])
        yield from done(held)
        trim()

    def done(held):
        u, p = (np.concatenate(held[x]).astype(np.int64) + at[:-1] if held[x] else np.zeros((0, 0)) for x in (0, 1))
        if len(u) and len(p):
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(u)], pa.int64()), "x": pa.array([f(p, u)], pa.list_(pa.float64()))})

    for r in parts.mapInArrow(run, "n bigint, x array<double>").toLocalIterator():
        yield r.n, r.x


def fit_quality(docs: DataFrame, labels: DataFrame, size: int = _SIZE) -> PositiveUnlabelled | float:
    """Learn from all trusted positives and all rows, as unlabelled ones, that are not held out.

    Bins are those of all rows. Parts of about ``size`` rows are fitted for themselves, and the model's weights are
    the mean of theirs, so the work grows with the rows and no task holds more than a part; up to ``size`` rows are one part.
    The labels' negatives are not looked at; the class prior is :func:`class_prior`'s.
    """
    train = labels.where("doc_id is not null and quality is not null").where(~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    good = train.where("quality = 1").select("doc_id")
    shaped = common.store(shapes(docs.where("doc_id is not null").where(~held_out())), "shapes")
    if shaped.isEmpty():
        return 0.5
    model = PositiveUnlabelled(cuts_of(shaped))

    def codes(batches):
        for batch in batches:
            if batch.num_rows:
                rows = model.bins(_matrix(batch)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r.tobytes() for r in rows], pa.binary())], names=["doc_id", "code"])

    coded = common.store(shaped.mapInArrow(codes, "doc_id bigint, code binary").withColumn("o", F.xxhash64("doc_id", "code")), "codes")
    common.drop(shaped)
    parts, k, at = parts_of(coded, good, size), int(model.at[-1]), model.at
    if parts is None:
        return 0.5
    prior = class_prior(x for _, x in each_part(parts, at, lambda p, u: halves(p, u, k)) if x)
    total, weights = 0, np.zeros(k + 1)
    for n, x in each_part(parts, at, lambda p, u: np.append(*fitted(p, u, k, prior)).tolist()):
        total, weights = total + n, weights + n * np.array(x)
    common.drop(coded)
    if not total:
        return 0.5
    model.w, model.b = weights[:-1] / total, float(weights[-1] / total)
    return model


def score_quality(docs: DataFrame, labels: DataFrame, size: int = _SIZE) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``: how likely a text is good."""
    model = fit_quality(docs, labels, size)

    def run(cols: dict, texts: list) -> dict:
        if isinstance(model, float):
            return {"doc_id": cols["doc_id"], "score": [model] * len(texts)}
        return {"doc_id": cols["doc_id"], "score": model.score(np.array([shape(t) for t in texts], float))}

    return _decided(common.map_text(docs, ["doc_id"], run, "doc_id bigint, score double"), 0.5)


def _decided(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, size: int = _SIZE) -> DataFrame:
    """The rows of ``docs`` whose own text scores ``threshold`` or more; all columns, in one pass."""
    model = fit_quality(docs, labels, size)
    if isinstance(model, float):
        return docs if model >= threshold else docs.limit(0)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                scores = model.score(np.array([shape(t) for t in batch.column("__text").to_pylist()], float))
                yield batch.filter(scores >= threshold).drop_columns(["__text"])

    return docs.withColumn("__text", F.col("text").cast("binary")).mapInArrow(run, docs.schema)


# ---- toxicity: boosted trees over dense features ------------------------------------------------

_TOKEN = re.compile(r"[^\W\d_]+")
_MASKED = re.compile(r"[^\W\d_][*@$!0-9]+[^\W\d_]")
_PLAIN = str.maketrans("013457@$!", "oieastasi")
#: Words that address the reader, in the languages of the corpus (fixed values).
YOU = frozenset("you your yours yourself tu te toi vous votre vos du dich dir dein deine ihr euch usted ustedes ti tus vosotros".split())
_STEMS = (4, 5, 6)
_FOLDS = 6


def _keys(token: str) -> list[str]:
    return [token] + [token[:k] + "*" for k in _STEMS if len(token) > k]


def learn_lexicon(labelled: DataFrame, folds: int = 1, least: int = 4, odds: float = 3.0, most: int = 5000) -> list[dict[str, float]]:
    """Words and stems (4 to 6 letters, marked ``*``) with their log odds of standing in a toxic text.

    The first lexicon is learned from all of ``labelled(text, toxic, fold)``, the others without one fold
    each. Texts are counted on the executors; at most ``most`` entries come back, the most frequent in toxic texts.
    """

    def run(cols: dict, texts: list) -> dict:
        out: dict[str, list] = {"k": [], "toxic": [], "fold": []}
        for t, y, f in zip(texts, cols["toxic"], cols["fold"]):
            got = {k for w in set(_TOKEN.findall((t or b"").decode("utf-8", "replace").lower())) for k in _keys(w)}
            out["k"] += got
            out["toxic"] += [y] * len(got)
            out["fold"] += [f] * len(got)
        return out

    seen = common.map_text(labelled, ["toxic", "fold"], run, "k string, toxic int, fold bigint")
    part = lambda c: [F.sum(F.when(F.col("fold") == f, c).otherwise(0)).alias(f"x{f}") for f in range(folds)]
    counts = seen.groupBy("k").agg(F.sum("toxic").alias("t"), F.array(*part(F.col("toxic"))).alias("ts"), F.array(*part(F.lit(1))).alias("ns"))
    rows = counts.where(F.col("t") >= least).where("log((t + 0.5D) / (aggregate(ns, 0L, (a, x) -> a + x) - t + 0.5D)) > -6").orderBy(F.desc("t"), "k").limit(most * 8).collect()
    sizes = {r.fold: (r.p, r.n) for r in labelled.groupBy("fold").agg(F.sum("toxic").alias("p"), F.count("*").alias("n")).collect()}

    def one(without: int | None) -> dict[str, float]:
        used = [f for f in range(folds) if f != without]
        pos, n = (sum(sizes.get(f, (0, 0))[k] for f in used) for k in (0, 1))
        if not pos or pos == n:
            return {}
        out = {}
        for r in rows:
            t, all_ = sum(r.ts[f] for f in used), sum(r.ns[f] for f in used)
            w = float(np.log((t + 0.5) / (pos + 1.0)) - np.log((all_ - t + 0.5) / (n - pos + 1.0)))
            if t >= least and w >= odds:
                out[r.k] = w
        return dict(sorted(out.items(), key=lambda x: (-x[1], x[0]))[:most])

    return [one(None), *([one(f) for f in range(folds)] if folds > 1 else [])]


class Words(dict):
    """Weight of each word under the lexicon, remembered; forgotten when it grows too large."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon

    def __missing__(self, w: str) -> float:
        if len(self) > 500_000:
            self.clear()
        got = self[w] = max(self.lexicon.get(k, 0.0) for k in _keys(w))
        return got


def manners(text: bytes | None, words: Words) -> list[float]:
    """Dense features: lexicon densities, second person near a hit, capitals, punctuation, obfuscation."""
    raw = (text or b"").decode("utf-8", "replace")
    low = raw.lower()
    tokens = _TOKEN.findall(low)
    n = max(len(tokens), 1)
    weights = np.fromiter(map(words.__getitem__, tokens), float, len(tokens))
    hits = np.flatnonzero(weights)
    strong = int((weights >= 5).sum())
    you = [i for i, t in enumerate(tokens) if t in YOU] if len(hits) else []
    near = 0
    for i in hits.tolist():
        k = bisect_right(you, i)
        near += any(abs(you[j] - i) <= 5 for j in (k - 1, k) if 0 <= j < len(you))
    masked = [w for m in _MASKED.finditer(raw) for w in [_around(raw, m)]]
    veiled = sum(words[w] > 0 for w in masked)
    letters = sum(map(len, tokens)) or 1
    return [
        float(len(hits)),
        len(hits) / n,
        float(strong),
        strong / n,
        float(weights.max()) if len(tokens) else 0.0,
        float(weights.sum()) / n,
        len({tokens[i] for i in hits.tolist()}) if len(hits) else 0.0,
        near / n,
        float(near),
        _capitals(raw, low) / letters,
        raw.count("!") / n,
        (raw.count("?") + raw.count(",") + raw.count(".")) / n,
        len(masked) / n,
        float(veiled),
        np.log1p(n),
    ]


def _capitals(raw: str, low: str) -> int:
    """Letters that lower case changes, of the whole text."""
    if len(raw) != len(low):
        return sum(c != c.lower() for c in raw)
    a, b = (np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in (raw, low))
    return int(np.count_nonzero(a != b))


def _around(raw: str, m: re.Match) -> str:
    """The word that a masked spot stands in, with look-alikes turned to letters."""
    a, b = m.start(), m.end()
    while a and not raw[a - 1].isspace() and m.start() - a < 20:
        a -= 1
    while b < len(raw) and not raw[b].isspace() and b - m.end() < 20:
        b += 1
    return "".join(_TOKEN.findall(raw[a:b].lower().translate(_PLAIN)))


class Boosted:
    """Logistic gradient boosting over quantile-binned features, trees of fixed depth."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, least: float = 5.0):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        self.cuts = [np.unique(np.append(c, [0.0, v.max() * 0.5])) for c, v in zip(self.cuts, x.T)]
        q, self.bins = self._bin(x), max(len(c) for c in self.cuts) + 1
        share = min(max(y.mean(), 1e-4), 1 - 1e-4)
        self.base, self.depth, self.trees = float(np.log(share / (1 - share))), depth, []
        f = np.full(len(y), self.base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(q, y - p, np.maximum(p * (1 - p), 1e-6), least)
            f += rate * self._leaf(tree, q)
            self.trees.append((tree[0], tree[1], rate * tree[2]))

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)], 1)

    def _grow(self, q, g, h, least):
        """Level by level: for each node the split with the largest gain over all features and bins."""
        node, cols = np.zeros(len(q), int), q.shape[1]
        feature, cut = [], []
        for level in range(self.depth):
            width = 1 << level
            best = np.zeros(width), np.zeros(width, int), np.full(width, self.bins)
            for j in range(cols):
                key = node * self.bins + q[:, j]
                gs = np.bincount(key, g, width * self.bins).reshape(width, -1).cumsum(1)
                hs = np.bincount(key, h, width * self.bins).reshape(width, -1).cumsum(1)
                ga, ha = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (ga - gs) ** 2 / (ha - hs + 1) - ga**2 / (ha + 1)
                gain[(hs < least / 10) | (ha - hs < least / 10)] = 0
                k = gain.argmax(1)
                more = gain[np.arange(width), k] > best[0]
                for a, b in zip(best, (gain[np.arange(width), k], np.full(width, j), k)):
                    a[more] = b[more]
            feature.append(best[1])
            cut.append(best[2])
            node = node * 2 + (q[np.arange(len(q)), best[1][node]] > best[2][node])
        leaves = 1 << self.depth
        value = np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + 1)
        return feature, cut, value

    def _leaf(self, tree, q):
        node, rows = np.zeros(len(q), int), np.arange(len(q))
        for feature, cut in zip(tree[0], tree[1]):
            node = node * 2 + (q[rows, feature[node]] > cut[node])
        return tree[2][node]

    def margin(self, x: np.ndarray) -> np.ndarray:
        q = self._bin(x)
        return self.base + sum(self._leaf(t, q) for t in self.trees)


class Isotonic:
    """Non-decreasing map from margins to probabilities, by pooling adjacent violators."""

    def __init__(self, margin: np.ndarray, y: np.ndarray):
        blocks: list[list[float]] = []
        for m, v in sorted(zip(margin.tolist(), y.tolist())):
            blocks.append([v, 1.0, m, m])
            while len(blocks) > 1 and (blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1] or blocks[-2][3] == blocks[-1][2]):
                s, n, _, hi = blocks.pop()
                blocks[-1][0] += s
                blocks[-1][1] += n
                blocks[-1][3] = hi
        self.x = np.array([(b[2] + b[3]) / 2 for b in blocks])
        self.y = np.array([(b[0] + 0.02) / (b[1] + 0.04) for b in blocks])

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(margin, self.x, self.y), 0, 1)


class Toxicity:
    def __init__(self, lexicon: dict[str, float], trees: Boosted, scale: Isotonic):
        self.words, self.trees, self.scale = Words(lexicon), trees, scale

    def __reduce__(self):
        return Toxicity, (self.words.lexicon, self.trees, self.scale)

    def score(self, texts: list) -> np.ndarray:
        return self.scale(self.trees.margin(np.array([manners(t, self.words) for t in texts], float)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 24_000) -> Toxicity | None:
    """Learn from at most ``sample`` labelled rows, in folds: features of a row come from a lexicon learned without its fold.

    Five folds give the trees, the sixth the calibration; the model's own lexicon is learned from all.
    """
    train = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    picked = bounded(train, sample).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(_FOLDS)))
    rows = common.store(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "toxic", "fold"), "toxic")
    whole, *others = learn_lexicon(rows, _FOLDS)
    words = [Words(x) for x in others]

    def run(cols: dict, texts: list) -> dict:
        return {**cols, "x": [manners(t, words[f]) for t, f in zip(texts, cols["fold"])]}

    got = common.map_text(rows, ["toxic", "fold"], run, "toxic int, fold bigint, x array<double>").orderBy("fold", "toxic", "x").collect()
    common.drop(rows)
    x, y, fold = np.array([r.x for r in got], float), np.array([r.toxic for r in got], float), np.array([r.fold for r in got])
    tune = fold == _FOLDS - 1 if len(got) else fold
    if not len(got) or not tune.any() or tune.all() or len(set(y[~tune])) < 2:
        return None
    trees = Boosted(x[~tune], y[~tune])
    return Toxicity(whole, trees, Isotonic(trees.margin(x[tune]), y[tune]))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = 24_000) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``: how likely a text is toxic."""
    model = fit_toxicity(docs, labels, sample)

    def run(cols: dict, texts: list) -> dict:
        return {"doc_id": cols["doc_id"], "score": model.score(texts) if model else [0.0] * len(texts)}

    return _decided(common.map_text(docs, ["doc_id"], run, "doc_id bigint, score double"), threshold)
