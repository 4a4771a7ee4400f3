"""Each operator against a brute-force version, planted cases, and odd input."""

import collections
import hashlib
import math
import os
import random
import re
import types
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from assayframe.llm import backoff_lm, classifiers, common, decontaminate, pieces, pii, quality_rules, shards, simhash, substring_dedup, suffix_dedup

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SYLLABLES = "an ber co de er fi ga he in ka lo mi no ou pa re sti ta un ver".split()


def prose(seed, n):
    r = random.Random(seed)
    words = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n)]
    return " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(words))


def corpus():
    r = random.Random(3)
    texts = [prose(i, r.randint(60, 160)) for i in range(30)]
    shared = prose(900, 60)
    texts += [texts[0], texts[1], texts[2] + " " + prose(77, 3), prose(50, 30) + " " + shared + " " + prose(51, 20), prose(52, 8) + "\n" + shared + "\n" + prose(53, 40)]
    texts += ["", None, "a", "a b", "Of " * 400, "x\n" * 90, "word\tword\nword " * 40, prose(99, 5000)]
    return texts


def frame(spark, texts, first=0):
    rows = [(i + first, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    """Ordinary texts, copies, and odd ones, with a null id, a row twice, and columns named like internal ones."""
    df = frame(spark, corpus())
    more = spark.createDataFrame([(None, "no id here", "en", "s", 10), (0, corpus()[0], "en", "s", 1)], DOCS)
    return df.unionByName(more).withColumns({"h": F.lit(1), "o": F.lit(2), "t": F.lit("x"), "key": F.lit(5), "fp": F.lit(3), "n": F.lit(0)}).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute_print(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = words(low)
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 3 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(fps, limit=3):
    """Smallest id reachable, by plain search."""
    ids = list(fps)
    out = {}
    for i in sorted(ids, key=lambda x: (x is None, x)):
        if i in out:
            continue
        queue, out[i] = [i], i
        while queue:
            a = queue.pop()
            for b in ids:
                if b not in out and bin(fps[a] ^ fps[b]).count("1") <= limit:
                    out[b] = i
                    queue.append(b)
    return out


class TestSimhash:
    def test_brute(self, docs):
        got = simhash.near_duplicates(docs).collect()
        assert len(got) == docs.count()
        fps = {r.doc_id: brute_print(r.text) for r in docs.collect()}
        assert all(r.fingerprint == f"{fps[r.doc_id]:016x}" for r in got)
        want = reach(fps)
        assert {r.doc_id: r.component_id for r in got} == want

    def test_hot_bucket_is_dealt_again_exactly(self, spark):
        r = random.Random(5)
        base = r.getrandbits(64)
        fps = {base}
        for _ in range(60):
            x = r.choice(sorted(fps))
            fps.add(x ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
        fps |= {r.getrandbits(64) for _ in range(50)}
        signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
        nodes = spark.createDataFrame(signed, "fp bigint")
        want = reach({x: x for x in sorted(fps)})
        groups = collections.Counter(want.values())
        for limit in (4096, 3):
            roots = {r.node: r.root for r in common.components(simhash.links(nodes, limit=limit)).collect()}
            found = collections.Counter(roots.get(x[0], x[0]) for x in signed)
            assert sorted(found.values()) == sorted(groups.values())

    def test_components_of_a_chain_and_a_star(self, spark):
        edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
        got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
        assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 140))

    def test_keep_one(self, docs, none):
        kept = [r.doc_id for r in simhash.keep_one(docs).collect()]
        assert len(kept) == len(set(kept)) and 30 not in kept and 0 in kept
        assert simhash.near_duplicates(none).count() == 0

    def test_keep_one_of_null_and_repeated_ids(self, spark):
        texts = [prose(400 + i, 80) for i in range(6)]
        rows = [(None, texts[0]), (None, texts[1]), (None, texts[0]), (5, texts[2]), (5, texts[3]), (5, texts[3]), (6, texts[4]), (None, texts[4]), (7, texts[5])]
        df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
        got = collections.Counter((r.doc_id, r.text) for r in simhash.keep_one(df).collect())
        assert got == collections.Counter([(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (6, texts[4]), (7, texts[5])])


class TestQualityRules:
    def brute(self, t):
        w = words(t)
        win = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        cover = {j for i in range(len(w) - 2) if win[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover)

    def test_base(self, docs, none):
        got = quality_rules.judge(docs)
        assert got.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
        text = {r.doc_id: r.text for r in docs.collect()}
        rows = got.collect()
        assert len(rows) == docs.count()
        for r in rows:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == self.brute(text[r.doc_id])
            assert r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words) and not (r.base_failed and r.kept)
        assert quality_rules.judge(none).count() == 0

    def test_junk_goes_and_prose_stays(self, spark):
        good = [prose(i, 120) for i in range(60)]
        bad = [" ".join(w + "###" for w in prose(100 + i, 80).split()) for i in range(8)]
        bad += [prose(200 + i, 80).upper().replace(" ", "!! ") for i in range(8)]
        got = {r.doc_id: r.kept for r in quality_rules.judge(frame(spark, good + bad)).collect()}
        assert all(got[i] for i in range(60)) and not any(got[i] for i in range(60, 76))

    def test_native(self, docs):
        plan = quality_rules.judge(docs)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


class TestPieces:
    def test_library(self):
        sentencepiece = pytest.importorskip("sentencepiece")
        sp, p = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.Pieces.load(MODEL)
        r = random.Random(1)
        texts = [t or "" for t in corpus()] + ["".join(r.choice("abcdeinorst  \n\t.,éñ汉字012ABC😀aaa") for _ in range(r.randint(0, 90))) for _ in range(300)]
        texts += ["a" * 500 + "international" * 30, " lead", "trail ", "a  b   c"]
        assert p.encode(texts) == sp.encode(texts)
        assert [p.decode(i) for i in p.encode(texts)] == texts

    def test_unigram_scores(self):
        r = random.Random(2)
        vocab = sorted({"".join(r.choice("ab▁") for _ in range(n)) for n in (1, 2, 3, 4) for _ in range(30)} | {"a", "b", "▁"})
        vocab = [v for v in vocab if not re.search("[^▁]▁", v)]
        scores = [-r.uniform(1, 5) * len(v) ** 0.7 for v in vocab]
        p = pieces.Pieces(["<unk>", *vocab], [0.0, *scores], "u" + "n" * len(vocab), False, True)
        best = dict(zip(vocab, scores))

        def brute(s):
            b = [0.0] + [-math.inf] * len(s)
            for e in range(1, len(s) + 1):
                b[e] = max(b[k] + best.get(s[k:e], -math.inf) for k in range(e))
            return b[-1]

        for _ in range(100):
            t = "".join(r.choice("ab ") for _ in range(r.randint(1, 60)))
            ids = p.encode([t])[0]
            assert p.decode(ids) == t and abs(sum(p.score[i] for i in ids) - brute("▁" + t.replace(" ", "▁"))) < 1e-9

    def test_few_words_are_remembered(self):
        p, r = pieces.Pieces.load(MODEL), random.Random(3)
        texts = [" ".join("".join(r.choices("abcdeinorst", k=8)) for _ in range(2500)) for _ in range(120)]
        for k in range(0, len(texts), 10):
            p.encode_bytes(texts[k : k + 10])
        assert sum(map(len, p.known)) < 250_000  # of 300,000

    def test_large_batches_go_in_parts(self):
        batch = pa.RecordBatch.from_pydict({"doc_id": list(range(200)), "text": [f"{i} " + "abc def " * 4000 for i in range(200)]})
        docs = types.SimpleNamespace(columns=batch.schema.names, schema=[], mapInArrow=lambda run, schema: run)
        parts = list(pieces.encode(docs, MODEL)(iter([batch])))
        assert [i for x in parts for i in x.column("doc_id").to_pylist()] == list(range(200)) and all(x for p in parts for x in p.column("round_trip").to_pylist())
        assert max(sum(len(t) for t in p.column("text").to_pylist()) for p in parts) < 3e6

    def test_parts_of_a_long_text_and_remembered_words(self, monkeypatch):
        texts = ["a  bc " * 40 + " end", None, "", "bc a", " "]
        want = pieces.Pieces.load(MODEL).encode(texts)
        monkeypatch.setattr(pieces, "_PART", 7)
        monkeypatch.setattr(pieces, "_KEPT", 1)
        p = pieces.Pieces.load(MODEL)
        assert p.encode(texts) == want and p.encode(texts) == want

    def test_frames(self, docs, none):
        got = pieces.digest(docs, MODEL).collect()
        assert len(got) == docs.count() and all(r.round_trip for r in got)
        wide = pieces.encode(docs, MODEL)
        assert wide.columns == [*docs.columns, "ids", "n_tokens", "round_trip"]
        assert [r.ids for r in wide.where("text is null").collect()] == [None] and [r.ids for r in wide.where("text = ''").collect()] == [[]]
        assert pieces.digest(none, MODEL).count() == 0


class TestSubstringDedup:
    def test_planted(self, docs, none):
        rows = substring_dedup.passages(docs).collect()
        found = {r.doc_id for r in rows}
        assert {0, 1, 2, 30, 31, 32, 33, 34} <= found and not found & set(range(3, 30)) and 42 not in found
        text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
        for r in rows:
            assert len(text[r.doc_id][r.a : r.b].split()) == r.n_words
            assert r.removed == (r.doc_id != r.keeper_doc_id) or r.doc_id == r.keeper_doc_id
        assert any(r.removed for r in rows if r.doc_id == 34) and not any(r.removed for r in rows if r.doc_id in (0, 33))
        assert substring_dedup.passages(none).count() == 0

    def test_near_copies_and_hot_buckets(self, spark):
        base = prose(5, 400).split()
        texts = []
        for i in range(12):
            w = list(base)
            w[17 + 31 * i] = f"changed{i}"
            texts.append(" ".join(w))
        many = frame(spark, texts)
        a = {(r.doc_id, r.a): r.class_id for r in substring_dedup.passages(many).collect()}
        b = {(r.doc_id, r.a): r.class_id for r in substring_dedup.passages(many, limit=2).collect()}
        assert a == b and len({d for d, _ in a}) == 12


    def test_a_bucket_looks_at_few_pairs_and_links_the_same(self, monkeypatch):
        r, rows = np.random.default_rng(3), []
        common = np.arange(10, dtype=np.int64)
        for _ in range(300):
            own = np.concatenate([common, r.integers(1 << 40, 1 << 62, r.integers(1, 60))])
            rows += [own] + [np.concatenate([own[k:], r.integers(1 << 40, 1 << 62, k)]) for k in range(r.integers(0, 5))]
        rows = [(c, np.unique(s)) for c, s in enumerate(rows)]
        looked, alike = [], substring_dedup._alike
        monkeypatch.setattr(substring_dedup, "_alike", lambda a, b, share: looked.append(1) or alike(a, b, share))

        def classes(links):
            root = list(range(len(rows)))
            for a, b in links:
                x, y = root[a], root[b]
                root = [x if v == y else v for v in root]
            return {frozenset(i for i, v in enumerate(root) if v == x) for x in root}

        links = substring_dedup._forest(rows, 0.8)
        assert len(looked) < 5 * len(rows)
        assert len(classes(links)) == len(rows) - len(links) < len(rows)
        assert classes(links) == classes(substring_dedup._forest(rows, 0.8, len(rows)))

    def test_unlike_lines_seldom_meet_and_alike_ones_do(self, monkeypatch):
        got = {}
        cutter = substring_dedup.Cutter
        monkeypatch.setattr(substring_dedup, "Cutter", lambda *args: got.update(cut=cutter(*args)) or 1 / 0)
        with pytest.raises(ZeroDivisionError):
            substring_dedup.passages(None)  # what it cuts with by default
        r = np.random.default_rng(5)

        def met(part, pairs):
            words = [r.integers(0, 1 << 63, 100, np.uint64) for _ in range(2 * pairs)]
            for a, b in zip(words[::2], words[1::2]):
                b[:part] = a[:part]
            keys = got["cut"].sketch(np.arange(0, 200 * pairs + 1, 100), np.concatenate(words))[0]
            return (keys[::2] == keys[1::2]).any(1).mean()

        assert met(90, 3000) >= 0.995  # similarity 0.81
        assert met(25, 3000) < 0.01  # similarity 0.12

    def test_words_and_sets_of_many_at_once(self):
        r = random.Random(4)
        mark: dict[int, bytes] = {}
        for _ in range(300):
            text = "".join(r.choice(["a", "B", "b", "c ", "é", "\n", " ", "\x0b", "x" * 70, "X" * 70, "x" * 64, "x" * 65, "\x1f", "汉", "\x00"]) for _ in range(r.randint(0, 60))).encode()
            page, words = substring_dedup.Page(text, 16, 8), text.lower().split()
            assert [text[a:b].lower() for a, b in zip(page.a, page.b)] == words
            assert all(mark.setdefault(h, w) == w for h, w in zip(page.h.tolist(), words, strict=True))
        assert len(set(mark.values())) == len(mark) > 300
        cut, h = substring_dedup.Cutter(6, 2, 0, 5), np.array([r.getrandbits(64) for _ in range(90_000)], np.uint64)
        cuts = np.cumsum([0, *(r.choice([1, 3, 25, 400, 60_000]) for _ in range(4)), 20_000, 7])
        cuts = cuts[cuts <= len(h)]
        keys, sets = cut.sketch(cuts, h)[0], cut.sets(cuts, h)
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            own = np.array([0, b - a])
            assert (keys[k] == cut.sketch(own, h[a:b])[0][0]).all() and (sets[k] == np.unique(cut.shingles(own, h[a:b])[0])).all()

    def test_recall_of_changed_paragraphs_and_of_passages_inside_lines(self, spark):
        r = random.Random(8)
        texts, changed, inside = [], {}, {}
        for i in range(60):
            a = prose(3000 + i, 60).split()
            b = list(a)
            b[r.randrange(5, 55)] = "altered"
            texts += [prose(4000 + i, 80) + "\n\n" + " ".join(a) + "\n\n" + prose(4100 + i, 50), prose(4200 + i, 90) + "\n\n" + " ".join(b) + "\n\n" + prose(4300 + i, 40)]
            changed[2 * i + 1] = (" ".join(b), len(shingle_set(a) & shingle_set(b)) / len(shingle_set(a) | shingle_set(b)))
        for i in range(60):
            p = prose(5000 + i, 51 + i % 10)
            texts += [prose(6000 + i, 70) + " " + p + " " + prose(6100 + i, 33), prose(6200 + i, 41) + " " + p + " " + prose(6300 + i, 77)]
            inside[len(texts) - 1] = p
        rows = [x for x in substring_dedup.passages(frame(spark, texts)).collect() if x.removed]
        part = lambda d, p: sum(max(0, min(x.b, (texts[d].index(p) + len(p))) - max(x.a, texts[d].index(p))) for x in rows if x.doc_id == d) / len(p)
        alike = [d for d, (_, share) in changed.items() if share >= 0.8]
        assert len(alike) == 60 and sum(part(d, changed[d][0]) >= 0.99 for d in alike) >= 57
        assert all(part(d, p) >= 0.6 for d, p in inside.items())
        assert {x.doc_id for x in rows} <= set(changed) | set(inside)


def shingle_set(w):
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


class TestDecontaminate:
    def test_planted(self, spark, docs, none):
        items = [prose(700 + i, 40) for i in range(20)]
        bench = spark.createDataFrame([*enumerate(items), (20, None), (21, ""), (None, "x y z")], "item_id bigint, text string")
        w = items[3].split()
        para = " ".join(x for i, x in enumerate(w) if i % 6)
        texts = [prose(i, 150) + " " + items[i % 20] + " " + prose(i + 40, 90) for i in range(10)] + [prose(60, 80) + " " + para + " " + prose(61, 80)] + [prose(300 + i, 200) for i in range(20)]
        found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame(spark, texts), bench).collect()}
        assert found == {(i, i) for i in range(10)} | {(10, 3)}
        assert decontaminate.without_leaks(frame(spark, texts), bench).count() == 20
        assert decontaminate.leaks(docs, bench).where("doc_id < 30").count() == 0
        assert decontaminate.leaks(none, bench).count() == 0 and decontaminate.leaks(docs, bench.limit(0)).count() == 0
        assert decontaminate.without_leaks(docs, bench).count() == docs.count()

    def test_recall_of_the_space(self, spark):
        """Of the passages that plain cosine over all terms puts at 0.35 or more, nine in ten are candidates at the defaults."""
        split = lambda t: decontaminate.words(t.encode())
        items = [split(prose(700 + i, 40)) for i in range(30)]
        r, texts = random.Random(2), []
        for i in range(90):
            some = [w.decode() for w in items[i % 30] if r.random() > 0.25]  # a quarter of the words is gone, others stand between
            for _ in range(6):
                some.insert(r.randrange(len(some)), prose(r.random(), 1))
            texts.append(split(prose(i, 40) + " " + " ".join(some) + " " + prose(i + 400, 70)))
        space, idf = decontaminate.fit(frame(spark, [b" ".join(t).decode() for t in texts]), items, 64, 32, 10_000)

        def vector(words):
            n = collections.Counter(w for w in words if w in idf)
            v = {w: c * idf[w] for w, c in n.items()}
            size = math.sqrt(sum(x * x for x in v.values())) or 1.0
            return {w: x / size for w, x in v.items()}

        own = [vector(x) for x in items]
        want = set()
        for d, t in enumerate(texts):
            for at in range(0, len(t), 32):
                v = vector(t[at : at + 64])
                want |= {(d, k) for k, x in enumerate(own) if sum(y * v.get(w, 0.0) for w, y in x.items()) >= 0.35}
        got = {(d, k) for d, _, k, _ in space.search(texts, 0.2)}
        assert len(want) > 60 and len(want & got) >= 0.9 * len(want)
        # counting answers first loses nothing that verification accepts
        match = decontaminate.Matcher(items, idf, 0.5, 16, 0.8, 0.5)
        found = [{(d, at, k) for d, at, k, _ in space.search(texts, 0.2, m) if match.check(texts[d], at, 64, k)} for m in (None, match)]
        assert found[0] == found[1] and len({(d, k) for d, _, k in found[0]}) >= 60

    def test_lcs(self):
        r = random.Random(4)
        for _ in range(50):
            a, b = ([r.choice([b"a", b"b", b"c"]) for _ in range(r.randint(0, 12))] for _ in range(2))
            t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
            assert decontaminate.lcs(a, b) == t[-1][-1]


def labelled(spark, texts, labels, name):
    docs = frame(spark, texts)
    return docs, spark.createDataFrame([(i, y, y) for i, y in enumerate(labels)], "doc_id bigint, quality int, toxic int")


class TestClassifiers:
    def test_quality(self, spark, docs, none):
        texts, y = [], []
        for i in range(400):
            junk = i % 7 == 0
            t = prose(i, 40 + i % 90)
            texts.append(" ".join(x + "$$$" for x in t.split()) if junk and i % 2 else t.upper().replace(" ", "!! ") if junk else t)
            y.append(int(not junk))
        d, labels = labelled(spark, texts, y, "quality")
        rows = classifiers.score_quality(d, labels).collect()
        held = [r for r in rows if r.held_out]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
        assert np.mean([r.predicted == y[r.doc_id] for r in held]) > 0.95
        assert classifiers.score_quality(docs, labels).count() == docs.count()
        assert classifiers.score_quality(none, labels).count() == 0 and classifiers.score_quality(docs, labels.limit(0)).count() == docs.count()
        kept = classifiers.keep_good(d, labels)
        assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.predicted}

    def test_quality_learns_from_every_row(self, spark):
        texts = [" ".join(x + "$$$" for x in prose(i, 30).split()) if i % 7 == 0 else prose(i, 40 + i % 90) for i in range(600)]
        docs, labels = labelled(spark, texts, [int(i % 7 > 0) for i in range(600)], "quality")
        order = [r.doc_id for r in docs.orderBy(F.xxhash64("doc_id"), "doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
        first = classifiers.fit_quality(docs, labels, 100)
        changed = docs.withColumn("text", F.when(F.col("doc_id") == order[-1], F.lit("A1? " * 900)).otherwise(F.col("text")))
        other = classifiers.fit_quality(changed, labels, 100)
        assert not np.array_equal(first.w, other.w)
        good = first.score(np.array([classifiers.shape(t.encode()) for t in texts])) >= 0.5
        assert np.mean(good == [i % 7 > 0 for i in range(600)]) > 0.95

    def test_quality_deals_every_row(self, spark):
        coded = spark.createDataFrame([(i, i * 7919, bytes([i % 256])) for i in range(1000)], "doc_id bigint, o bigint, code binary")
        for trusted, size in ((30, 100), (700, 100), (30, 5000)):
            rows = classifiers.parts_of(coded, coded.where(F.col("doc_id") < trusted).select("doc_id"), size).collect()
            assert sorted(r.o for r in rows if r.kind == 0) == [i * 7919 for i in range(1000)]
            times = {len({r.part for r in rows if r.kind and r.o == i * 7919}) for i in range(trusted)}
            assert len(times) == 1 and sum(r.kind for r in rows) == trusted * times.pop()

    def test_toxicity(self, spark, docs, none):
        texts, y = [], []
        for i in range(900):
            bad = i % 5 == 0
            w = prose(i, 60).split()
            if bad:
                w[10], w[30] = random.Random(i).choice(["idiot", "moron", "zorkal" + SYLLABLES[i % 20]]), "you"
            texts.append(" ".join(w))
            y.append(int(bad))
        d, labels = labelled(spark, texts, y, "toxic")
        rows = classifiers.score_toxicity(d, labels).collect()
        held = [r for r in rows if r.held_out]
        assert np.mean([r.predicted == y[r.doc_id] for r in held]) > 0.95
        assert classifiers.score_toxicity(docs, labels).count() == docs.count()
        assert classifiers.score_toxicity(none, labels).count() == 0 and classifiers.score_toxicity(docs, labels.limit(0)).count() == docs.count()

    def test_isotonic_and_trees(self):
        r = np.random.default_rng(0)
        x = r.normal(size=(2000, 4))
        y = (x[:, 0] + x[:, 1] ** 2 > 1).astype(float)
        trees = classifiers.Boosted(x, y)
        assert np.mean((trees.margin(x) > 0) == y) > 0.95
        scale = classifiers.Isotonic(trees.margin(x), y)
        p = scale(np.linspace(-5, 5, 50))
        assert (np.diff(p) >= 0).all() and 0 <= p.min() and p.max() <= 1


class TestLanguageModel:
    def test_base_and_known(self, docs, none):
        rows = backoff_lm.score(docs).collect()
        assert len(rows) == docs.count()
        lists, train = {}, collections.Counter()
        for r in docs.collect():
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or "")
            lists[r.doc_id] = [*words(low), "\n"]
            if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 7 != 2:
                train.update(lists[r.doc_id])
        n, v = sum(train.values()), len(train)
        for r in rows:
            w = lists[r.doc_id]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(train[x] > 0 for x in w), n)
            assert abs(r.base_score - sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w)) < 1e-6
        held = [r for r in rows if r.held_out]
        assert held and all(r.score <= 0 for r in rows)
        assert backoff_lm.score(none).count() == 0

    def test_probabilities_sum_to_one(self, spark):
        docs = frame(spark, [" ".join(random.Random(i).choices(["a", "b", "c", "d"], [6, 3, 2, 1], k=60)) for i in range(40)])
        model, _ = backoff_lm.fit(docs, size=1000)
        every = [*model.id]
        assert model.arcs and model.fail
        for context in ([], [b"a"], [b"a", b"b"], [b"d", b"d"]):
            before = model.walk(context)[0]
            total = sum(10 ** (model.walk([*context, w])[0] - before) for w in every)
            norm = 10**model.norm
            assert abs(total - (norm - 1) / norm) < 0.02  # the rest is kept for words never seen

    def test_the_model_is_whole_whatever_the_cache_holds(self, spark):
        texts = [" ".join(random.Random(i).choices([f"w{j}" for j in range(30)], range(1, 31), k=50)) for i in range(60)] + ["", None, "w1", "never seen w2 w3"]
        df = frame(spark, texts)
        model, _ = backoff_lm.fit(df, size=10**9)  # two occurrences are enough: a walk over every state and arc
        assert backoff_lm.fit(df, size=20)[0].args[2] != model.args[2]
        for size in (20, 200_000):
            for r in backoff_lm.score(df, size=size).collect():
                w = backoff_lm.tokens((texts[r.doc_id] or "").encode())
                train = dict(zip(model.args[0], model.args[1]))
                rare = [x for x in w if x not in model.id]
                once = sum(math.log10(2) for x in rare if r.n_known and not r.held_out)
                assert train and abs(model.walk(w)[0] + once - r.score) < 1e-6, (size, r)


    def test_shards_grow_with_the_texts_whatever_the_session_says(self, spark, docs, monkeypatch):
        want = sorted(map(str, backoff_lm.score(docs).collect()))
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
        monkeypatch.setattr(shards, "_TEXT", size // 40)
        number, dealt = shards.parts_of(docs), []
        repartition = type(docs).repartition
        monkeypatch.setattr(type(docs), "repartition", lambda self, n, *cols: dealt.append(n) or repartition(self, n, *cols))
        assert number >= 40 > int(spark.conf.get("spark.sql.shuffle.partitions"))
        got = sorted(map(str, backoff_lm.score(docs).collect()))
        assert [g[: g.index("base_score")] for g in got] == [w[: w.index("base_score")] for w in want] and dealt.count(number) == 8

    def test_a_text_may_hold_a_word_more_often_than_two_bytes_count(self, spark):
        docs = frame(spark, ["w " * 70_000, "a b w", "w a", *["a b c"] * 9])
        rows = {r.doc_id: r for r in backoff_lm.score(docs, size=1).collect()}
        assert rows[0].n_known == rows[0].n_tokens == 70_001

    def test_a_chunk_of_one_text(self, spark):
        docs = frame(spark, ["a b c a b", "a b c"])
        for some in (docs.where("doc_id = 0"), docs.repartition(2, "doc_id")):
            rows = backoff_lm.score(some, size=1).collect()
            assert len(rows) == some.count() and all(r.n_known == r.n_tokens > 1 and r.score < 0 for r in rows)

    def test_hashes_tell_words_apart(self):
        r = random.Random(4)
        texts = [None, b"", b" ", b"A a\tb\x0bB\x0cx\ry\nz", b"x" * 513 + b" " + b"X" * 512 + b" y " + b"x" * 513, b"\x00 a\x00 a"]
        texts += [bytes(r.choice(b"aB \n\t\x00c\xc3\xa9") for _ in range(r.randint(0, 60))) for _ in range(2000)]
        lists = [[backoff_lm.END, *backoff_lm.tokens(t)] for t in texts]
        row, place, h, _ = backoff_lm._grams(texts)
        seen = {}
        for i, at, word, key in zip(row.tolist(), place.tolist(), [w for x in lists for w in x], h.tolist(), strict=True):
            assert lists[i][at] == word and seen.setdefault(word, key) == key
        assert len(set(seen.values())) == len(seen)

    def test_planes_return(self):
        for kind in ("u2", "i8", "f8"):
            for n in (0, 1, 5):
                x = np.arange(n).astype(kind)
                assert backoff_lm._back(backoff_lm._planes(x), kind).tolist() == x.tolist()

    def test_mixed_order_adds_alike(self):
        r = np.random.default_rng(3)
        x = r.integers(0, 1 << 63, 50).astype(np.uint64)[r.integers(0, 50, 20_000)]
        for y in (r.integers(0, 90, 20_000).astype(np.uint64), np.zeros(20_000, np.uint64)):
            (a, b), n = shards.mixed([x, y], np.ones(len(x), np.int64))
            assert dict(zip(zip(a.tolist(), b.tolist()), n.tolist())) == collections.Counter(zip(x.tolist(), y.tolist())) and len(n) == len(set(zip(a.tolist(), b.tolist())))
            assert (np.diff((a >> np.uint64(32)).astype(np.int64)) >= 0).all()


class TestPii:
    PATTERNS = {
        0: re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), 1: re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        2: re.compile(r"[0-9]([\x20-]?[0-9])+"), 3: re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
    }

    def brute(self, t):
        out = []
        for k, p in self.PATTERNS.items():
            for m in p.finditer(t):
                d = re.sub(r"\D", "", m.group())
                ok = k == 0 or (k == 1 and all(int(x) <= 255 for x in m.group().split("."))) or (k == 2 and 12 <= len(d) <= 19 and pii.luhn(d)) or (k == 3 and 9 <= len(d) <= 15)
                if ok:
                    out.append((m.start(), k, m.end()))
        return sorted(out)

    def test_patterns(self):
        r = random.Random(8)
        for _ in range(4000):
            t = "".join(r.choice("ab.@-+ 0123456789()%_é") for _ in range(r.randint(0, 60)))
            assert pii.base_spans(t) == self.brute(t), t
        assert pii.base_spans("4111 1111 1111 1111") == [(0, 2, 19)]
        assert pii.base_spans("a" * 50_000 + "@" + "1" * 50_000) == []

    def test_terms_that_reveal(self, spark, docs, none):
        texts = [prose(i, 20) + f" Quillhaven writes from user{i}@mail.example.com today " + prose(i + 50, 30) for i in range(20)] + [prose(200 + i, 80) for i in range(40)]
        d = frame(spark, texts)
        rows = {r.doc_id: r for r in pii.report(d, bits=3.0).collect()}
        for i in range(20):
            base = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in self.brute(texts[i]))
            assert rows[i].n_email == 1 and rows[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
            at = texts[i].index("Quillhaven")
            assert f"term:{at}:{at + 10}" in rows[i].spans and base in rows[i].spans
        assert all(rows[i].spans == "" for i in range(20, 60))
        clean = {r.doc_id: r for r in pii.sanitise(d, bits=3.0).collect()}
        assert "Quillhaven" not in clean[3].text and "[EMAIL]" in clean[3].text and clean[3].n_chars == len(clean[3].text)
        assert clean[30].text == texts[30]
        assert pii.report(docs).count() == docs.count() and pii.report(none).count() == 0
        assert pii.sanitise(docs).columns == docs.columns and pii.sanitise(docs).count() == docs.count()

    def test_terms_pass_where_entities_are_common(self, spark):
        tails = ["Quillhaven" if i == 3 else "" for i in range(30)]
        texts = [prose(i, 20) + f" Quillhaven writes from user{i}@mail.example.com today " + prose(i + 50, 30) + " " + tails[i] for i in range(30)] + [prose(200 + i, 30) for i in range(10)]
        texts += [prose(300, 30) + " a@b.example.com"] + [prose(301, 40) + " Quillhaven"]
        rows = {r.doc_id: r.spans for r in pii.report(frame(spark, texts)).collect()}
        for i in range(30):
            at = texts[i].index("Quillhaven")
            assert f"term:{at}:{at + 10}" in rows[i]
        assert f"term:{len(texts[3]) - 10}:{len(texts[3])}" in rows[3]  # far from the entity, in its document
        assert rows[41] == "" and "term" not in rows[40]


class TestSuffixDedup:
    def brute(self, rows, n):
        seen, out = set(), {}
        for d, u, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
            b, cov = (t or "").encode(), bytearray(len((t or "").encode()))
            for i in range(len(b) - n + 1):
                if b[i : i + n] in seen:
                    cov[i : i + n] = b"\1" * n
                else:
                    seen.add(b[i : i + n])
            kept = bytes(c for c, m in zip(b, cov) if not m)
            out.setdefault(d, set()).add((len(b), sum(cov), len(re.findall(b"\1+", bytes(cov))), hashlib.sha256(kept).hexdigest()))
        return out

    def check(self, df, n=100, **options):
        text = F.col("text").cast("binary")
        rows = list({(r.doc_id, r.u, r.text) for r in df.select("doc_id", "text", F.xxhash64(text, F.col("doc_id").isNull()).alias("u")).collect()})
        want = self.brute(rows, n)
        got = suffix_dedup.removed(df, n, **options).collect()
        assert len(got) == df.count()
        found = {}
        for r in got:
            found.setdefault(r.doc_id, set()).add((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
        assert found == want

    def test_corpus(self, docs, none):
        self.check(docs)
        assert suffix_dedup.removed(none).count() == 0

    def test_repetitive(self, spark):
        r = random.Random(6)
        parts = ["".join(r.choice("ab \n") for _ in range(r.randint(30, 260))) for _ in range(25)] + ["ab" * 130, "a" * 300, "é" * 90]
        texts = ["".join(r.choice(parts) for _ in range(r.randint(1, 6))) for _ in range(60)]
        self.check(frame(spark, texts, 10))
        self.check(frame(spark, texts, 10), block=500)  # many small blocks
        self.check(frame(spark, texts, 10), hot=2)  # anchors that are too hot for one task
        self.check(frame(spark, texts, 10).withColumn("doc_id", F.expr("if(doc_id % 3 = 0, null, doc_id div 4)")))  # one doc_id, several texts

    def test_index(self):
        r = random.Random(9)
        texts = ["".join(r.choice("ab") for _ in range(r.randint(0, 60))).encode() for _ in range(40)]
        first = np.cumsum([0] + [len(t) + 1 for t in texts])
        index = suffix_dedup.RunIndex(texts, np.arange(first[-1]), 8)
        bwt, rows = "".join(chr(h) for h in np.repeat(index.heads, np.diff(np.append(index.starts, first[-1])))), 0
        assert sorted(bwt) == sorted(b"".join(texts).translate(bytes((c + 1) % 256 for c in range(256))).decode() + "\0" * len(texts))
        where = {}
        for i, t in enumerate(texts):
            for p in range(len(t) - 7):
                where.setdefault(t[p : p + 8], int(first[i]) + p)
        for who, at, earliest in index.stream():
            for i, p, e in zip(who.tolist(), at.tolist(), earliest.tolist()):
                assert where[texts[i][p : p + 8]] == e
                rows += 1
        assert rows == sum(max(len(t) - 7, 0) for t in texts)


def test_null_and_clashing_columns_survive(docs):
    assert {"h", "o", "t", "key"} <= set(docs.columns) and docs.where("doc_id is null").count() == 1
    assert os.path.exists(MODEL)


def test_latent_space_comes_from_all_documents(spark):
    import numpy as np

    from assayframe.llm import decontaminate

    items = [[f"w{k}".encode() for k in range(i, i + 30)] for i in range(0, 300, 30)]
    few = [(i, " ".join(f"w{(7 * i + j) % 300}" for j in range(40))) for i in range(60)]
    late = few + [(10**9 + i, None if i == 5 else " ".join(f"w{(11 * i + 5 * j) % 300}" for j in range(40))) for i in range(60)]
    make = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    whole = decontaminate.fit(make(late), items, 8, 32, 40)[0]
    # rows count whatever their id is, null too, and each as often as it stands there
    unnamed = decontaminate.fit(make([(None, t) for _, t in late]), items, 8, 32, 40)[0]
    twice = decontaminate.fit(make(late + late[60:]), items, 8, 32, 40)[0]
    near = lambda a, b: np.abs(a.items @ a.items.T - b.items @ b.items.T).max()
    assert near(whole, unnamed) < 1e-4
    assert near(whole, twice) > 1e-3


def test_shuffle_files_go_with_their_store(spark):
    from assayframe.llm import common, shards

    before = shards._shuffles(spark)
    kept = common.store(spark.range(1000).selectExpr("id % 7 as k").repartition("k").groupBy("k").count(), "swept")
    assert shards._shuffles(spark) <= before
    assert kept.count() == 7
