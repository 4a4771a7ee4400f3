r"""Personal data: base patterns, and terms that reveal them by corpus co-occurrence.

Base spans (e-mail, ip, card, phone) are found in every whole text. Terms that stand within ``window``
words of a base span are then weighed against the whole corpus: with n(t) all occurrences of a
term and n(t, near) those near a protected entity, its disclosure is the pointwise mutual
information log2(P(near | t) / P(near)), where P(near | t) is the lower end of its 95 % Wilson
interval. No term can disclose more than -log2 P(near), which vanishes as entities grow common, so
terms pass that disclose ``bits``, or ``part`` of that most if it is less. Of those, terms seen near
entities of ``least`` documents and mostly there (``share``) are generalised wherever they stand in a
document that holds an entity.

Counts cover all documents. Only terms that occur near an entity need a corpus count; which ones
they are goes to the scan as a bitmap of fixed size, whose false hits a join then removes.

A null text counts as empty; a null doc_id is a row like any other. Repeated rows each get the same
result. Columns of the input besides doc_id and text are kept by :func:`sanitise`.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W\d_]{2,}")
_BITS = 1 << 23


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` in code points, sorted; each kind leftmost and non-overlapping.

    Every pattern is scanned in time linear in the text: the local part of an e-mail is the
    whole run before its ``@``, and digit runs are never entered in the middle.
    """
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, 0, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGIT.findall(m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def near_terms(text: str, spans: list[tuple[int, int, int]], window: int) -> list[tuple[str, int, int]]:
    """``(term, start, end)`` of the words within ``window`` words of a span, and in none."""
    found: dict[int, tuple[str, int, int]] = {}
    merged: list[list[int]] = []
    for start, _, end in spans:
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    for i, (start, end) in enumerate(merged):
        low = max(merged[i - 1][1] if i else 0, start - 40 * window)
        left = [m for m in _WORD.finditer(text, low, start) if m.start() > low or not low or not text[low - 1].isalpha()]
        high = merged[i + 1][0] if i + 1 < len(merged) else len(text)
        right = islice(_WORD.finditer(text, end, high), window)
        for m in [*left[-window:], *right]:
            found[m.start()] = (m.group().lower(), m.start(), m.end())
    return [found[k] for k in sorted(found)]


def _scan(docs: DataFrame, window: int) -> DataFrame:
    """One row per document: its base spans, and the terms near them."""

    def run(cols: dict, texts: list) -> dict:
        out: dict[str, list] = {"doc_id": cols["doc_id"], "key": [], "spans": [], "term": [], "place": []}
        for t in texts:
            text = (t or b"").decode("utf-8", "replace")
            spans = base_spans(text)
            near = near_terms(text, spans, window) if spans else []
            out["key"].append(int(np.uint64(xxhash.xxh64_intdigest(t or b"", 42)).view(np.int64)))
            out["spans"].append([x for a, k, b in spans for x in (a, k, b)])
            out["term"].append([n[0] for n in near])
            out["place"].append([x for n in near for x in n[1:]])
        return out

    return common.map_text(docs, ["doc_id"], run, "doc_id bigint, key bigint, spans array<int>, term array<string>, place array<int>")


def _bitmap(terms: DataFrame) -> np.ndarray:
    """Which slots of a bitmap of fixed size (1 MB) the terms' hashes take."""
    slot = F.xxhash64("term").bitwiseAND(F.lit(_BITS - 1))
    words = terms.select((slot / 32).cast("long").alias("i"), F.expr(f"shiftleft(1L, cast(xxhash64(term) & {_BITS - 1} as int) & 31)").alias("b"))
    out = np.zeros(_BITS // 32, np.int64)
    for r in words.groupBy("i").agg(F.bit_or("b").alias("b")).toLocalIterator():
        out[r.i] = r.b
    return out


def disclosing(docs: DataFrame, scanned: DataFrame, bits: float = 6.0, share: float = 0.5, least: int = 8, part: float = 0.5) -> DataFrame:
    """``(term, bits)`` of the terms that reveal protected entities."""
    places = scanned.where(F.size("term") > 0).select("doc_id", F.explode("term").alias("term"))
    near = places.groupBy("doc_id", "term").count().groupBy("term").agg(F.sum("count").alias("near"), F.count("*").alias("docs"))
    near = common.store(near.where(F.col("docs") >= least), "near")
    marks = _bitmap(near)
    mask = _BITS - 1

    def run(cols: dict, texts: list) -> dict:
        counts: Counter = Counter()
        total, slots = 0, {}
        for t in texts:
            words = _WORD.findall((t or b"").decode("utf-8", "replace").lower())
            total += len(words)
            for w in words:
                got = slots.get(w)
                if got is None:
                    at = xxhash.xxh64_intdigest(w.encode(), 42) & mask
                    got = slots[w] = bool(marks[at >> 5] >> (at & 31) & 1)
                if got:
                    counts[w] += 1
        counts[""] = total
        return {"term": list(counts), "n": list(counts.values())}

    totals = common.store(common.map_text(docs, [], run, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n")), "totals")
    words = totals.where("term = ''").agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
    beside = scanned.agg(F.coalesce(F.sum(F.size("term")), F.lit(1))).first()[0]
    p, z2 = F.col("near") / F.col("n"), 1.96**2
    low = (p + z2 / (2 * F.col("n")) - 1.96 * F.sqrt(p * (1 - p) / F.col("n") + z2 / (4 * F.col("n") * F.col("n")))) / (1 + z2 / F.col("n"))
    common_ = min(max(beside, 1) / max(words, 1), 1.0)
    weighed = near.join(totals, "term").select("term", F.log2(F.greatest(low, F.lit(1e-12)) / F.lit(common_)).alias("bits"), low.alias("low"))
    return weighed.where((F.col("bits") >= min(bits, part * -math.log2(common_))) & (F.col("low") >= share)).select("term", "bits")


def _places(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``(doc_id, key, term, a, b)``: words outside base spans, of documents that have some, that may be one of ``terms``."""
    marks, mask = _bitmap(terms), _BITS - 1

    def run(cols: dict, texts: list) -> dict:
        out: dict[str, list] = {n: [] for n in ("doc_id", "key", "term", "a", "b")}
        slots: dict[str, bool] = {}
        for doc_id, t in zip(cols["doc_id"], texts):
            text = (t or b"").decode("utf-8", "replace")
            spans = base_spans(text)
            if not spans:
                continue
            key, i, end = int(np.uint64(xxhash.xxh64_intdigest(t, 42)).view(np.int64)), 0, 0
            for m in _WORD.finditer(text):
                while i < len(spans) and spans[i][0] < m.end():
                    end = max(end, spans[i][2])
                    i += 1
                if m.start() < end:
                    continue
                w = m.group().lower()
                got = slots.get(w)
                if got is None:
                    if len(slots) > 500_000:
                        slots.clear()
                    at = xxhash.xxh64_intdigest(w.encode(), 42) & mask
                    got = slots[w] = bool(marks[at >> 5] >> (at & 31) & 1)
                if got:
                    for n, x in zip(out, (doc_id, key, w, m.start(), m.end())):
                        out[n].append(x)
        return out

    return common.map_text(docs, ["doc_id"], run, "doc_id bigint, key bigint, term string, a int, b int")


def find(docs: DataFrame, window: int = 4, **thresholds) -> DataFrame:
    """``(doc_id, key, spans, added)``: flat arrays of start, kind, end; ``added`` null where no term was."""
    scanned = common.store(_scan(docs, window), "pii")
    terms = common.store(disclosing(docs, scanned, **thresholds), "terms")
    rows = scanned.select("doc_id", "key", "spans")
    if terms.isEmpty():
        return rows.withColumn("added", F.lit(None).cast("array<int>"))
    where = scanned.where(F.size("term") > 0).select("doc_id", "key", F.explode(F.expr("transform(term, (t, i) -> struct(t as term, get(place, 2 * i) as a, get(place, 2 * i + 1) as b))")).alias("x"))
    where = where.select("doc_id", "key", "x.term", "x.a", "x.b").unionByName(_places(docs, terms)).join(terms, "term", "left_semi")
    added = where.groupBy("doc_id", "key").agg(F.flatten(F.transform(F.sort_array(F.collect_set(F.struct("a", "b"))), lambda s: F.array(s.a, F.lit(4), s.b))).alias("added"))
    same = rows.doc_id.eqNullSafe(added.doc_id) & (rows.key == added.key)
    return rows.join(added, same, "left").select(rows.doc_id, rows.key, "spans", "added")


def _listed(flat: str) -> F.Column:
    """``kind:start:end`` of a flat array, comma-joined, by start and then kind."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    three = f"transform(sequence(0, size({flat}) div 3 - 1), i -> array(get({flat}, cast(3 * i as int)), get({flat}, cast(3 * i + 1 as int)), get({flat}, cast(3 * i + 2 as int))))"
    return F.expr(f"if(size({flat}) = 0, '', array_join(transform(array_sort({three}), s -> concat_ws(':', get({names}, get(s, 1)), get(s, 0), get(s, 2))), ','))")


def report(docs: DataFrame, **options) -> DataFrame:
    """The contract's columns, one row per input row."""
    found = find(docs, **options)
    counts = [F.expr(f"cast(size(filter(spans, (x, i) -> i % 3 = 1 and x = {k})) as long) as n_{KINDS[k]}") for k in range(4)]
    found = found.withColumn("every", F.concat("spans", F.coalesce("added", F.array().cast("array<int>"))))
    return found.select("doc_id", *counts, F.sha2(_listed("spans").cast("binary"), 256).alias("base_sha256"), _listed("every").alias("spans"))


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every span generalised to its kind in brackets; same columns, n_chars kept true."""
    found = find(docs, **options)
    hit = found.where((F.size("spans") > 0) | F.col("added").isNotNull()).dropDuplicates(["doc_id", "key"])
    hit = hit.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), F.concat("spans", F.coalesce("added", F.array().cast("array<int>"))).alias("__spans"))
    hit = common.store(hit, "hits")

    def cover(text: str, flat: list[int]) -> str:
        out, at = [], 0
        for a, k, b in sorted(zip(flat[::3], flat[1::3], flat[2::3])):
            if a >= at:
                out += [text[at:a], f"[{KINDS[k].upper()}]"]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def run(batches):
        for batch in batches:
            text, flat = batch.column("text").to_pylist(), batch.column("__spans").to_pylist()
            new = [cover(t, f) if t and f else t for t, f in zip(text, flat)]
            cols = {n: batch.column(n) for n in names} | {"text": pa.array(new, pa.string())}
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([len(t) if f and t else n for t, f, n in zip(new, flat, batch.column("n_chars").to_pylist())], batch.column("n_chars").type)
            yield pa.RecordBatch.from_pydict({n: cols[n] for n in names})

    names = docs.columns
    same = docs.doc_id.eqNullSafe(hit["__id"]) & (F.xxhash64(F.coalesce(docs.text, F.lit(""))) == hit["__key"])
    joined = docs.join(hit, same, "left").select(*[docs[n] for n in names], "__spans")
    return joined.mapInArrow(run, docs.schema)
