"""Quality rules: a threshold table compiled into one Spark projection (no user functions, no shuffle).

Empty and null texts have no words, fail the base rule (fewer than 20 words) and are not kept. Rows are judged one by one,
so repeated rows get the same verdict; columns of the input never clash with the measures, which get a prefix.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import plain_names, read

WINDOW = 8  # words in a window of the repetition count
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30

# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in a is that for it with as was on be are this by from at or an not "
    "der die das und in zu den von ist mit sich auf für nicht ein eine dem des im "
    "de la le et les des en un une du que est pour qui dans par sur pas au "
    "el los las del se por con no una su para es al lo como más y"
).split()

#: (rule, numerator, denominator, least, most); None: open. A ratio over 0 counts as 0.
RULES: tuple[tuple[str, str, str, float | None, float | None], ...] = (
    ("mean_word_length", "word_chars", "n_words", 2.0, 14.0),
    ("symbols_per_word", "n_symbols", "n_words", None, 0.20),
    ("shouts_per_word", "n_shouts", "n_words", None, 0.40),
    ("stop_word_ratio", "n_stop_words", "n_words", 0.02, None),
    ("duplicate_line_ratio", "n_dup_lines", "n_lines", None, 0.50),
)

_WHITE = "\t\n\x0b\x0c\r"
_P = "__qr_"


def _count_chars(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def _pairs(h: Column) -> Column:
    """(hash, place) of each window, sorted; null where all hashes are distinct, which settles most texts."""
    return F.when(F.size(F.array_distinct(h)) < F.size(h), F.expr(f"sort_array(transform({_P}h, (x, i) -> struct(x as h, i as i)))"))


def _repeat_words(pairs: Column) -> Column:
    """Words in windows that occur twice or more: both neighbours of each equal pair are repeated places; the sum goes over
    how far each place's window reaches beyond the place before it."""
    twice = F.zip_with(
        pairs, F.slice(pairs, 2, F.greatest(F.size(pairs) - 1, F.lit(0))),
        lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"])).otherwise(F.array().cast("array<int>")),
    )
    places = F.sort_array(F.array_distinct(F.flatten(twice)))
    reach = F.aggregate(
        places, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).cast("long").alias("n"), i.cast("int").alias("last")),
        lambda a: a["n"],
    )
    return F.coalesce(reach, F.lit(0).cast("long"))


def measure(df: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """The input's columns and __qr_: the measures, base_failed and kept."""
    # Each measure is taken in the first projection that can, so that long columns are copied as seldom as possible.
    t, blank = F.coalesce(F.col(text_col), F.lit("")), " " * len(_WHITE)
    df = df.withColumns({
        _P + "words": F.array_remove(F.split(F.translate(t, _WHITE, blank), " "), ""),
        _P + "lines": F.filter(F.split(t, "\n"), lambda x: F.trim(F.translate(x, _WHITE, blank)) != ""),
        _P + "word_chars": F.length(F.translate(t, _WHITE + " ", "")).cast("long"),
        _P + "n_symbols": _count_chars(t, "#*$%&|<>"),
        _P + "n_shouts": _count_chars(t, "!"),
    })
    w, lines = F.col(_P + "words"), F.col(_P + "lines")
    df = df.withColumns({
        _P + "n_words": F.size(w).cast("long"),
        _P + "n_stop_words": F.size(F.filter(w, lambda x: F.lower(x).isin(*dict.fromkeys(STOP_WORDS)))).cast("long"),
        _P + "n_lines": F.size(lines).cast("long"),
        _P + "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        _P + "h": F.transform(w, lambda x: F.xxhash64(x)),
    }).drop(_P + "words", _P + "lines")
    for step in (1, 2, 4):  # hashes of 2, 4 and 8 words
        h = F.col(_P + "h")
        left = F.greatest(F.size(h) - step, F.lit(0))
        df = df.withColumn(_P + "h", F.zip_with(F.slice(h, 1, left), F.slice(h, 1 + step, left), lambda x, y: F.xxhash64(x, y)))
    df = df.withColumn(_P + "pairs", _pairs(F.col(_P + "h"))).drop(_P + "h")
    df = df.withColumn(_P + "n_repeat_words", _repeat_words(F.col(_P + "pairs"))).drop(_P + "pairs")
    c = {k: F.col(_P + k) for k in ("n_words", "word_chars", "n_symbols", "n_shouts", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words")}
    failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEATED_PERCENT * c["n_words"])
    tests = []
    for _, over, under, least, most in rules:
        ratio = F.when(c[under] > 0, c[over] / c[under]).otherwise(0.0)
        tests += [ratio >= least] * (least is not None) + [ratio <= most] * (most is not None)
    df = df.withColumns({_P + "base_failed": failed, _P + "kept": ~failed & reduce(lambda a, b: a & b, tests, F.lit(True))})
    return df


def keep_good(df: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """The rows that pass all rules, with the input's columns.

    The verdict meets a test that isn't deterministic (and always true), else the optimizer would push the filter below the
    projections and write every measure out once for each of its uses.
    """
    plain, back = plain_names(df)
    judged = measure(plain, plain.columns[df.columns.index(text_col)], rules)
    judged = judged.withColumn(_P + "keep", F.col(_P + "kept") & (F.monotonically_increasing_id() >= 0))
    return judged.where(F.col(_P + "keep")).select(*back)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = measure(read(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return out.select("doc_id", *(F.col(_P + n).alias(n) for n in names))
