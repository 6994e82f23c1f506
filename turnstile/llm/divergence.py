"""Quality rules: base counts, and the Jensen-Shannon distance of a text to its language.

Two histograms of each text, of character classes and of the language's `COMMON` commonest words (and all
others as one), are compared with those of its language, the sums over the language's texts that pass the base
rules. The distance (base 2, 0 to 1) is the square root of the Jensen-Shannon divergence. A text fails
beyond `FARTHEST`. Guards: a text of fewer than `LEAST_WORDS` words is not judged by its words, a language
with fewer than `LEAST_REFERENCE` words not at all.

Everything is column expressions: texts are never exploded but to count words by language, which is
combined before the shuffle; the histograms are arrays of a fixed length in the text's own row.

Nulls: a NULL text has no words (all counts 0, base_failed). Rows with a NULL language form a language of
their own. Repeated rows count each. Columns of the input named like a result are replaced, others pass. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnstile.llm import common as C

COMMON = 20
#: Greatest distance by character classes and by words.
FARTHEST = {"char_distance": 0.3, "word_distance": 0.45}
LEAST_WORDS, LEAST_REFERENCE = 50, 2_000
#: Disjoint, the commonest first.
CLASSES = {
    "lower": "[a-z]",
    "space": r"[\x20\x09-\x0D]",
    "upper": "[A-Z]",
    "digit": "[0-9]",
    "stop": "[.,;:!?'\"()-]",
    "symbol": "[#*$%&|<>]",
    "wide": r"[^\x00-\x7F]",
}


def _words(text: str) -> Column:
    return F.regexp_extract_all(text, F.lit(C.WORD), F.lit(0))


def _class_counts(d: DataFrame) -> DataFrame:
    """d with _chars, the number of characters of each class in _text. Small letters and white space are
    taken out one after the other; little is left for the other classes."""
    out = lambda text, name: F.regexp_replace(text, CLASSES[name] + "+", "")
    lost = lambda text, rest: (F.length(text) - F.length(rest)).cast("long")
    d = d.withColumn("_rest", out("_text", "lower")).withColumn("_marks", out("_rest", "space"))
    first = [lost("_text", "_rest").alias("lower"), lost("_rest", "_marks").alias("space")]
    others = [lost("_marks", out("_marks", name)).alias(name) for name in list(CLASSES)[2:]]
    return d.withColumn("_chars", F.struct(*first, *others)).drop("_rest", "_marks")


def _repeat_words(words: str) -> Column:
    """Words inside three-word windows that stand twice or more."""
    n = f"size({words})"
    windows = f"IF({n} < 3, array(), transform(sequence(0, greatest({n} - 3, 0)), i -> xxhash64(get({words}, i), get({words}, i + 1), get({words}, i + 2))))"
    pairs = "sort_array(transform(_w3, (x, i) -> struct(x, i)))"
    same = "transform(_s, (s, j) -> IF(s.x = get(_s, j - 1).x OR s.x = get(_s, j + 1).x, s.i, NULL))"
    places = "transform(_p, (p, j) -> least(3, coalesce(get(_p, j + 1) - p, 3)))"
    # Names for the steps: transform over an array of one element binds its lambda's variable.
    step = lambda value, name, body: f"get(transform(array({value}), {name} -> {body}), 0)"
    total = f"aggregate({places}, 0L, (a, b) -> a + b)"
    found = step(pairs, "_s", step(f"sort_array(filter({same}, p -> p IS NOT NULL))", "_p", total))
    return F.expr(step(windows, "_w3", f"IF(size(array_distinct(_w3)) = size(_w3), 0L, {found})"))


def base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with _text, _words (its words), _chars (the class counts) and the base columns."""
    d = docs.withColumn("_text", F.coalesce(F.col(text_col), F.lit(""))).withColumn("_words", _words("_text"))
    lines = F.expr(r"filter(split(_text, '\n', -1), l -> l RLIKE '[^\\x20\\x09-\\x0D]')")
    d = d.withColumn("n_words", F.size("_words").cast("long")).withColumn("_length", F.length("_text"))
    d = _class_counts(d).withColumn("_lines", lines)
    d = d.withColumn("word_chars", F.col("_length") - F.col("_chars.space")).withColumn("n_symbols", F.col("_chars.symbol"))
    d = d.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines")
    d = d.withColumn("n_repeat_words", _repeat_words("_words"))
    return d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _distance(own: str, other: str) -> Column:
    """Jensen-Shannon distance of two arrays of counts; NULL if one is empty."""
    total = lambda a: f"aggregate({a}, 0D, (x, y) -> x + y)"
    term = "CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0D END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0D END"
    # transform over an array of one element names the totals: they are summed up once.
    share = lambda a: f"get(transform(array({total(a)}), t -> transform({a}, x -> x / t)), 0)"
    found = total(f"zip_with({share(own)}, {share(other)}, (p, q) -> {term})")
    return F.expr(f"CASE WHEN {total(own)} > 0 AND {total(other)} > 0 THEN sqrt(greatest(0D, {found} / 2)) END")


def judge(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(id_col, base columns, char_distance, word_distance, kept) of every row."""
    d = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(lang_col), F.lit("")).alias("_lang"), F.col(text_col).alias("_source_text"))
    counted = d.select("_lang", F.explode(_words(F.coalesce("_source_text", F.lit("")))).alias("w")).groupBy("_lang", "w").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy(F.col("n").desc(), "w"))
    common = counted.withColumn("r", rank).where(f"r <= {COMMON}").groupBy("_lang")
    common = common.agg(F.sort_array(F.collect_list(F.struct("r", "w")))["w"].alias("_common"), F.max(F.octet_length("w")).alias("_longest"))
    common = C.store(common, "common")  # a row for each language

    d = base_counts(d.join(common, "_lang", "left"), "_source_text")
    chars = F.array(*[F.col(f"_chars.{name}").cast("double") for name in CLASSES])
    # Common words are short: the others are not looked up.
    place = "filter(transform(filter(_words, w -> octet_length(w) <= _longest), w -> array_position(_common, w)), p -> p > 0)"
    cells = f"transform(sequence(1, {COMMON}), k -> cast(size(filter(_at, p -> p = k)) AS double))"
    words = F.expr(f"get(transform(array(coalesce({place}, array())), _at -> concat(array(cast(n_words - size(_at) AS double)), {cells})), 0)")
    d = d.select("_id", "_lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", chars.alias("_chars"), words.alias("_hist"))
    d = C.store(d, "histograms")

    cell = lambda name, n: F.array(*[F.sum(F.col(name)[i]) for i in range(n)])
    refs = d.where("not base_failed").groupBy("_lang").agg(F.sum("n_words").alias("_n"), cell("_chars", len(CLASSES)).alias("_ref_chars"), cell("_hist", COMMON + 1).alias("_ref_hist"))
    d = d.join(refs.where(f"_n >= {LEAST_REFERENCE}"), "_lang", "left")
    d = d.withColumn("char_distance", _distance("_chars", "_ref_chars"))
    d = d.withColumn("word_distance", F.when(F.col("n_words") >= LEAST_WORDS, _distance("_hist", "_ref_hist")))
    far = F.lit(False)
    for name, most in FARTHEST.items():
        far = far | F.coalesce(F.col(name) > most, F.lit(False))
    kept = ~F.col("base_failed") & ~far
    return d.select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", kept.alias("kept"))
