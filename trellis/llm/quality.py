"""Quality rules by distribution divergence, with DataFrame functions only.

A document is compared with the reference of its language: the histogram of character classes and
the histogram of common words, both summed over all documents of the language that pass the base rules,
so rows those rules reject do not shape it. It follows that a verdict hangs on the corpus it is given in.
The distance is Jensen-Shannon's (square root of the divergence to base 2, so 0 to 1). Short documents are
noisy, so each comparison has a minimum length below which it never rejects.

Defined results: a null text is the empty text; a null or unknown language is the group "other",
whose common words are not compared; an empty table gives an empty result; repeated rows are each
judged alone; ``keep_good`` carries the rows whole, so further columns may have any name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, Workspace

# Common function words by language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "on", "for", "with"],
    "de": ["der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "auf", "ist", "ein"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "une", "que", "est", "dans"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un"],
}
CLASSES = ["upper case", "digit", "blank", "symbol", "mark", "bytes beyond ASCII", "rest"]
SYMBOLS, MARKS = r"[#*$%&|<>]", r"[.,;:!?]"
#: Rejected above these distances, from these lengths on.
MAX_CHAR_DISTANCE, MIN_CHARS = 0.25, 200
MAX_WORD_DISTANCE, MIN_WORDS = 0.32, 100
#: The base rules: fewest words, most per cent of words in repeated three-word windows.
LEAST_WORDS, MOST_REPEATED = 50, 50


def _without(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _shift(name: str, x: Column, bits: Column) -> Column:
    return F.call_function(name, x, bits)


def _window_keys(w: Column, bits: Column) -> Column:
    """A sorted number for each three-word window: bits of its hash, then its position in the last ``bits``, which
    hold any position of this text; null below four words."""
    n = F.size(w)
    shifted = F.arrays_zip(*(F.slice(w, k, n - 2).alias(f"w{k}") for k in (1, 2, 3)))
    key = lambda x, i: _shift("shiftleft", F.xxhash64(x["w1"], x["w2"], x["w3"]), bits).bitwiseOR(i.cast("long"))
    return F.when(n >= 4, F.sort_array(F.transform(shifted, key)))


def _alike(keys: Column, w: Column, bits: Column) -> Column:
    """Windows (text, position) whose hash bits occur twice or more, sorted by text; a superset of the repeated ones."""
    m = F.size(keys) - 1
    same = F.zip_with(F.slice(keys, 1, m), F.slice(keys, 2, m), lambda a, b: F.when(_shift("shiftright", a, bits) == _shift("shiftright", b, bits), F.array(a, b)))
    at = F.array_distinct(F.flatten(F.filter(same, lambda p: p.isNotNull())))
    place = lambda x: x.bitwiseAND(_shift("shiftleft", F.lit(1).cast("long"), bits) - 1).cast("int")
    return F.sort_array(F.transform(at, lambda x: F.struct(F.concat_ws(" ", F.get(w, place(x)), F.get(w, place(x) + 1), F.get(w, place(x) + 2)).alias("t"), place(x).alias("i"))))


def _repeat_count(windows: Column) -> Column:
    """Words covered by windows that equal a neighbour in ``windows``, which is sorted by text.

    A covered stretch grows by min(3, gap to the window before it).
    """
    m = F.size(windows) - 1
    pairs = F.zip_with(F.slice(windows, 1, m), F.slice(windows, 2, m), lambda a, b: F.when(a["t"] == b["t"], F.array(a["i"], b["i"])))
    starts = F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))
    covered = F.aggregate(
        starts, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda acc, x: F.struct(x.alias("last"), (acc["n"] + F.least(F.lit(3), x - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    return F.coalesce(F.when(m > 0, covered), F.lit(0)).cast("long")


def histograms(df: DataFrame) -> DataFrame:
    """Adds h_lang, h_chars (bytes by class), h_words (counts of the common words, then others), _t and _w (the words).

    Only words written exactly like a common word count as it: the reference is counted alike.
    """
    t = F.coalesce("text", F.lit(""))
    blank = reduce(lambda x, c: F.replace(x, F.lit(c), F.lit(" ")), BLANKS[1:], t)
    lists = F.create_map(*(x for k, v in COMMON_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    lang = F.when(F.col("lang").isin(*COMMON_WORDS), F.col("lang")).otherwise("other")
    df = df.withColumns({"h_lang": lang, "_t": t, "_b": blank, "_l": lists[lang]})
    df = df.withColumns({"_w": F.array_remove(F.split("_b", " "), ""), "word_chars": F.length(F.replace("_b", F.lit(" "), F.lit(""))).cast("long")})
    n = F.length("_t")
    classes = [_without(F.col("_t"), r"\p{Lu}"), _without(F.col("_t"), "[0-9]"), n - F.col("word_chars"), _without(F.col("_t"), SYMBOLS), _without(F.col("_t"), MARKS), F.octet_length("_t") - n]
    hits = [F.size("_w") - F.size(F.array_remove("_w", F.col("_l")[i])) for i in range(12)]
    df = df.withColumns({"_c": F.array(*(c.cast("double") for c in classes)), "_h": F.when(F.col("h_lang") != "other", F.array(*(h.cast("double") for h in hits)))})
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return df.withColumns({
        "h_chars": F.concat("_c", F.array(F.octet_length("_t") - total("_c"))),
        "h_words": F.concat("_h", F.array(F.size("_w") - total("_h"))),
    }).drop("_c", "_h", "_b", "_l")


def references(hist: DataFrame) -> dict[str, dict[str, list[float]]]:
    """Shares by language over the rows of ``hist``; five rows at most, whatever the input."""
    sums = [F.sum(F.col("h_chars")[i]).alias(f"c{i}") for i in range(7)] + [F.sum(F.col("h_words")[i]).alias(f"w{i}") for i in range(13)]
    out = {}
    for r in hist.groupBy("h_lang").agg(*sums).collect():
        out[r["h_lang"]] = {}
        for kind, n in (("c", 7), ("w", 13)):
            v = [r[f"{kind}{i}"] or 0.0 for i in range(n)]
            out[r["h_lang"]][kind] = [x / sum(v) for x in v] if sum(v) else [0.0] * n
    return out


def _distance(counts: Column, refs: dict[str, list[float]]) -> Column:
    """Jensen-Shannon distance of each row's counts to the shares of its language; 0 without either.

    JSD = H((p+q)/2) - (H(p) + H(q)) / 2, summed class by class.
    """
    if not refs:
        return F.lit(0.0)
    share = F.create_map(*(x for k, v in refs.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))[F.col("h_lang")]
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    xlog = lambda x: F.when(x > 0, x * F.log2(x)).otherwise(0.0)
    shares = F.zip_with(counts, F.array_repeat(total, F.size(counts)), lambda x, t: x / t)
    terms = F.zip_with(shares, share, lambda p, q: (xlog(p) + xlog(q)) / 2 - xlog((p + q) / 2))
    jsd = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.coalesce(F.sqrt(F.greatest(jsd, F.lit(0.0))), F.lit(0.0))).otherwise(0.0)


def judge(docs: DataFrame, *carry: str) -> DataFrame:
    """The columns ``carry`` of ``docs`` (which has text and lang) with the base counts, both distances and ``kept``.

    The text is gone through once: counts and histograms are written, then summed for the references
    and compared with them.
    """
    df = histograms(docs)
    df = df.withColumn("_bits", F.length(F.bin(F.size("_w").cast("long")))).withColumns({
        "_keys": _window_keys(F.col("_w"), F.col("_bits")),
        "n_words": F.size("_w").cast("long"),
        "_lines": F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
    })
    df = df.withColumns({
        "_win": _alike(F.col("_keys"), F.col("_w"), F.col("_bits")),
        "n_symbols": F.col("h_chars")[3].cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
    }).withColumn("n_repeat_words", _repeat_count(F.col("_win")))
    df = df.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
    df = df.withColumn("n_text", F.length("_t"))
    df = Workspace(docs.sparkSession, "quality").save(df.select(*carry, "h_lang", "h_chars", "h_words", "n_text", *RESULT[:6]), "counts")
    refs = references(df.where("not base_failed"))
    df = df.withColumns({
        "char_distance": _distance(F.col("h_chars"), {k: v["c"] for k, v in refs.items()}),
        "word_distance": F.coalesce(_distance(F.col("h_words"), {k: v["w"] for k, v in refs.items() if k != "other"}), F.lit(0.0)),
    })
    far = (F.col("n_text") >= MIN_CHARS) & (F.col("char_distance") > MAX_CHAR_DISTANCE)
    strange = (F.col("n_words") >= MIN_WORDS) & (F.col("word_distance") > MAX_WORD_DISTANCE)
    return df.withColumn("kept", ~F.col("base_failed") & ~far & ~strange).select(*carry, *RESULT)


RESULT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance"]


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return judge(docs, "doc_id").drop("char_distance", "word_distance")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns, whatever their names."""
    return judge(docs.select(F.struct("*").alias("_row"), "text", "lang"), "_row").where("kept").select("_row.*")
