r"""Quality rules under weak supervision, in DataFrame and SQL functions only.

Each rule votes that a text is good (1), bad (-1), or abstains (0). Expectation-maximisation over
the table of vote patterns (at most 3 ** number of rules rows, whatever the corpus) estimates how
often each rule votes so on good and on bad texts (a rule that abstains is no evidence); the posterior probability of "good" then
decides, in place of a demand that all rules pass. The whole iteration is one ``aggregate``
expression over the pattern table.

A null text has no words: its counts are zero, it fails the base rule, and it is not kept.
Rows with any doc_id, null or repeated, are kept as rows; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÀÂÇÈÉÊËÎÏÔÙÛÜÁÍÑÓÚ"
#: name -> (bad when, good when, prior belief that a bad vote is right) over the columns of features(); neither: abstain.
RULES = {
    "symbols": ("n_symbols > 0.3 * n_words", "n_symbols <= 0.02 * n_words", 0.95),
    "repeats": ("n_repeat_words > 0.3 * n_words", "n_repeat_words <= 0.1 * n_words", 0.95),
    "lines": ("n_dup_lines > 0.3 * n_lines", "n_dup_lines = 0", 0.6),
    "capitals": ("n_upper > 0.4 * word_chars", "n_upper <= 0.2 * word_chars", 0.95),
    "shouts": ("n_shouts > 0.3 * n_words", "n_shouts <= 0.05 * n_words", 0.95),
    "word_length": ("word_chars > 12 * n_words or word_chars < 2 * n_words", "word_chars between 3 * n_words and 9 * n_words", 0.7),
    "stops": ("n_stops < 0.002 * n_words or n_stops > 0.6 * n_words", "n_stops between 0.01 * n_words and 0.4 * n_words", 0.6),
    "vocabulary": ("n_distinct < 0.15 * n_words", "n_distinct > 0.3 * n_words", 0.8),
}
#: Log odds that a vote which is no fault may have: weak, as each kind of bad text passes the rules made for the others.
PASS = (0.0, 0.15)
#: Prior votes for each vote that a rule casts against a text.
BELIEF = 3.0
ROUNDS, SMOOTH, START = 25, 1.0, 0.9


def _count(chars: str) -> F.Column:
    return F.length("t") - F.length(F.translate("t", chars, ""))


def features(docs: DataFrame) -> DataFrame:
    """One row per document with the counts that the rules read; repeats within a text only, so no shuffle."""
    w = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    w = w.withColumn("b", F.trim(F.col("t"), F.lit(SPACE)))
    w = w.withColumn("w", F.when(F.col("b") == "", F.array().cast("array<string>")).otherwise(F.split("b", r"[\x20\x09-\x0D]+")))
    w = w.withColumn("n", F.size("w")).withColumn(
        "h",
        F.expr("if(n < 3, cast(array() as array<bigint>), transform(sequence(0, n - 3), i -> xxhash64(get(w, i), get(w, i + 1), get(w, i + 2))))"),
    )
    w = w.withColumn("lines", F.expr(r"filter(split(t, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')"))
    w = w.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.translate("t", SPACE, "")).cast("long").alias("word_chars"),
        _count("[#*$%&|<>]"[1:-1]).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        _count(UPPER).cast("long").alias("n_upper"),
        _count("!").cast("long").alias("n_shouts"),
        _count(".").cast("long").alias("n_stops"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        # windows in order of their hash, only where some hash repeats
        F.expr("if(size(array_distinct(h)) = size(h), null, array_sort(transform(h, (x, i) -> struct(x, i))))").alias("s"),
    )
    w = w.withColumn("p", F.expr("sort_array(filter(transform(s, (e, j) -> if(e.x = get(s, j - 1).x or e.x = get(s, j + 1).x, e.i, null)), v -> v is not null))"))
    covered = F.expr("aggregate(transform(p, (v, j) -> least(3, coalesce(get(p, j + 1), v + 3) - v)), 0L, (a, b) -> a + b)")
    return w.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("s", "p")


def votes() -> F.Column:
    return F.array(*[F.expr(f"case when {bad} then -1 when {good} then 1 else 0 end") for bad, good, _ in RULES.values()])


def fit(voted: DataFrame) -> DataFrame:
    """One row ``m``: the prior's log odds, and each rule's log odds when it votes bad, good, or abstains.

    Rules that never overlap say nothing about each other, so each has a prior: BELIEF votes for
    each that it cast against a text, of which the share in RULES is right.
    """
    last = len(RULES) - 1
    patterns = voted.groupBy("v").agg(F.count("*").cast("double").alias("n"))
    packed = patterns.agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("pats"))
    beliefs = "array(" + ", ".join(f"{p}D" for *_, p in RULES.values()) + ")"
    sums = lambda w, when: f"aggregate(zip_with(pats, q, (e, g) -> if({when}, e.n * {w}, 0D)), 0D, (a, x) -> a + x)"
    good, bad, cast = sums("g", "true"), sums("(1D - g)", "true"), f"({BELIEF}D * {sums('1D', 'get(e.v, j) = -1')})"
    fault = (
        f"ln(({sums('g', 'get(e.v, j) = -1')} + (1D - get({beliefs}, j)) * {cast} + {SMOOTH}D) / ({good} + {cast} + {2 * SMOOTH}D))"
        f" - ln(({sums('(1D - g)', 'get(e.v, j) = -1')} + get({beliefs}, j) * {cast} + {SMOOTH}D) / ({bad} + {cast} + {2 * SMOOTH}D))"
    )
    passed = lambda v: (
        f"least({PASS[1]}D, greatest({PASS[0]}D, ln(({sums('g', f'get(e.v, j) = {v}')} + {SMOOTH}D) / ({good} + {2 * SMOOTH}D))"
        f" - ln(({sums('(1D - g)', f'get(e.v, j) = {v}')} + {SMOOTH}D) / ({bad} + {2 * SMOOTH}D))))"
    )
    each = lambda x: f"transform(sequence(0, {last}), j -> {x})"
    step = f"""transform(array(<q>), q -> named_struct('prior', ln({good} + {SMOOTH}D) - ln({bad} + {SMOOTH}D),
        'bad', {each(f"least(0D, {fault})")}, 'good', {each(passed(1))}, 'none', {each(passed(0))}))[0]"""
    start = f"transform(pats, e -> if(exists(e.v, x -> x = -1), 1D - {START}D, {START}D))"
    again = f"transform(pats, e -> {posterior('e.v', 's')})"
    model = packed.select("pats", F.expr(step.replace("<q>", start)).alias("m0"))
    return model.select(F.expr(f"aggregate(sequence(2, {ROUNDS}), m0, (s, r) -> {step.replace('<q>', again)})").alias("m"))


def posterior(v: str, m: str) -> str:
    vote = f"aggregate(transform({v}, (x, j) -> case x when -1 then get({m}.bad, j) when 1 then get({m}.good, j) else get({m}.none, j) end), 0D, (a, b) -> a + b)"
    return f"1D / (1D + exp(-({m}.prior + {vote})))"


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The contract's columns, then the posterior probability ``p_good``."""
    voted = common.store(features(docs).withColumn("v", votes()), "votes")
    out = voted.withColumn("m", fit(voted).scalar())
    out = out.withColumn("p_good", F.expr(posterior("v", "m")))
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.col("p_good") >= threshold)).alias("kept"), "p_good",
    )
