"""Quality rules in DataFrame functions throughout: base counts, then divergence from the language.

Two histograms of a document, over character classes and over the common words
of its language, are compared with those of all documents of that language by
Jensen-Shannon distance. References are counted over the whole table, grouped
before they are shuffled, and written: what a language adds is one row, so the
join back is a broadcast when the optimizer finds the files small and a shuffle
when it doesn't. Texts never leave the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchframe.llm.common import save

# Blanks, words as runs of anything else, and character classes in the order in which they are taken out of a text.
BLANKS = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
CLASSES = {
    "lower": r"\p{Ll}+",
    "blank": GAP,
    "upper": r"\p{Lu}+",
    "letter": r"[\p{L}\p{M}]+",
    "digit": r"\p{Nd}+",
    "stop": r"[.,;:!?'\x22()-]+",
    "symbol": r"[#*$%&|<>]+",
}
WINDOW = 5
MIN_WORDS, MAX_REPEATED_PERCENT = 10, 20
COMMON = 400  # a common word is at least one in so many words of its language: never more words than that
SLOTS = 1024  # of the table by which a word finds itself among the common ones
REFERENCE_WORDS = 2_000  # a language with fewer words judges nobody
JUDGED_WORDS = 50  # shorter documents have histograms of chance
BASE, NOISE = 0.24, 0.2  # a distance may be BASE + NOISE * sqrt(bins / words): the second part is what few words do by chance


def with_words(docs: DataFrame, text: str = "text", out: str = "words") -> DataFrame:
    solid = F.btrim(F.col(text), F.lit(BLANKS))
    none = F.array().cast("array<string>")
    return docs.withColumn(out, F.when(solid == "", none).otherwise(F.split(solid, GAP)))


def with_classes(docs: DataFrame, text: str = "text", out: str = "classes") -> DataFrame:
    """Add code points by class, in the order of ``CLASSES``, then the rest."""
    rest, sizes = F.col(text), [F.char_length(text)]
    for k, pattern in enumerate(CLASSES.values()):
        docs = docs.withColumn(f"__rest{k}", F.regexp_replace(rest, pattern, ""))
        rest = F.col(f"__rest{k}")
        docs = docs.withColumn(f"__size{k}", F.char_length(rest))
        if k:
            docs = docs.drop(f"__rest{k - 1}")
        sizes.append(F.col(f"__size{k}"))
    taken = [(a - b).cast("long") for a, b in zip(sizes, sizes[1:], strict=False)]
    docs = docs.withColumn(out, F.array(*taken, sizes[-1].cast("long")))
    return docs.drop(f"__rest{len(CLASSES) - 1}", *[f"__size{k}" for k in range(len(CLASSES))])


def with_hashes(docs: DataFrame, words: str = "words") -> DataFrame:
    """Replace the words by ``hashes`` of 64 bits, which stand for them from here on, and ``n_words``."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return docs.withColumns({"hashes": hashes, "n_words": F.size(words).cast("long")}).drop(words)


def with_repeats(docs: DataFrame, out: str = "n_repeat_words") -> DataFrame:
    """Add the number of words inside windows that the text holds twice or more, from ``hashes``.

    Windows are hashed in turn, and sorted with their places where some are
    equal at all, so the work is n log n on any text.
    """
    window = "xxhash64({})".format(", ".join(f"hashes[i + {k}]" for k in range(WINDOW)))
    docs = docs.withColumn("__windows", F.expr(f"if(size(hashes) < {WINDOW}, cast(array() as array<bigint>), transform(sequence(0, size(hashes) - {WINDOW}), i -> {window}))"))
    placed = "sort_array(transform(__windows, (v, i) -> named_struct('v', v, 'i', i)))"
    docs = docs.withColumn("__placed", F.expr(f"if(size(array_distinct(__windows)) < size(__windows), {placed}, cast(array() as array<struct<v: bigint, i: int>>))")).drop("__windows")
    twice = "filter(__placed, (s, k) -> get(__placed, k - 1).v <=> s.v or get(__placed, k + 1).v <=> s.v)"
    docs = docs.withColumn("__places", F.expr(f"sort_array(transform({twice}, s -> s.i))")).drop("__placed")
    gaps = f"transform(__places, (p, k) -> least({WINDOW}, coalesce(get(__places, k + 1) - p, {WINDOW})))"
    docs = docs.withColumn(out, F.expr(f"cast(aggregate({gaps}, 0, (a, x) -> a + x) as bigint)"))
    return docs.drop("__places")


def references(docs: DataFrame) -> DataFrame:
    """One row per language: ``lang, total, class_shares, slots, at, places, shares``, counted over all of ``docs`` (``text, lang``).

    ``shares`` are those of the common words, the last one that of all others. A
    word's hash modulo ``slots`` leads to its place among them: ``slots`` is the
    first number tried that keeps all common words apart, ``at`` and ``places``
    hold their hashes and places there. A null language is a language; one of
    fewer than ``REFERENCE_WORDS`` words has no row.
    """
    classes = with_classes(docs).groupBy("lang").agg(*[F.sum(F.col("classes")[k]).alias(f"c{k}") for k in range(len(CLASSES) + 1)])
    classes = classes.select("lang", F.array(*[f"c{k}" for k in range(len(CLASSES) + 1)]).alias("classes"))
    words = with_words(docs).select("lang", F.explode("words").alias("word"))
    words = words.groupBy("lang", F.xxhash64("word").alias("hash")).agg(F.count("*").alias("n"))
    totals = words.groupBy("lang").agg(F.sum("n").alias("total")).where(F.col("total") >= REFERENCE_WORDS).withColumnRenamed("lang", "of")
    common = words.join(totals, F.col("lang").eqNullSafe(F.col("of"))).where(F.col("n") * COMMON >= F.col("total"))
    found = common.groupBy("of").agg(F.sort_array(F.collect_list(F.struct("hash", "n"))).alias("common"))
    found = _beside(_beside(totals.withColumnRenamed("of", "lang"), found, "of"), classes.withColumnRenamed("lang", "of"), "of")
    found = found.withColumn("common", F.coalesce("common", F.expr("cast(array() as array<struct<hash: bigint, n: bigint>>)")))
    apart = "size(array_distinct(transform(common, c -> pmod(c.hash, m)))) = size(common)"
    found = found.withColumn("slots", F.expr(f"get(filter(sequence({SLOTS}, {SLOTS * 512}, {SLOTS - 1}), m -> {apart}), 0)"))
    found = found.withColumn("slots", F.coalesce("slots", F.raise_error(F.lit("no table keeps the common words apart")).cast("int")))
    found = found.withColumn("held", F.expr("array_sort(transform(common, (c, i) -> named_struct('slot', cast(pmod(c.hash, slots) as int), 'hash', c.hash, 'place', i)))"))
    filled = "transform(sequence(0, slots - 1), s -> get(filter(held, e -> e.slot = s), 0))"
    found = found.withColumn("table", F.expr(filled))
    return found.select(
        "lang",
        "total",
        F.expr("transform(classes, c -> c / aggregate(classes, 0L, (a, x) -> a + x))").alias("class_shares"),
        "slots",
        F.expr("transform(table, e -> e.hash)").alias("at"),
        F.expr("transform(table, e -> e.place)").alias("places"),
        F.expr("transform(concat(common.n, array(total - aggregate(common.n, 0L, (a, x) -> a + x))), c -> c / total)").alias("shares"),
    )


def _beside(left: DataFrame, right: DataFrame, of: str) -> DataFrame:
    return left.join(right, F.col("lang").eqNullSafe(F.col(of)), "left").drop(of)


def _with_word_counts(docs: DataFrame) -> DataFrame:
    """Add ``counts``: a document's common words as ``place, n``, and ``others``, how many words are none, from ``hashes``."""
    slot = "cast(pmod(h, slots) as int)"
    docs = docs.withColumn("__found", F.expr(f"sort_array(transform(filter(hashes, h -> get(at, {slot}) <=> h), h -> get(places, {slot})))"))
    docs = docs.withColumn("__ends", F.expr("if(size(__found) = 0, cast(array() as array<int>), filter(sequence(1, size(__found)), k -> not get(__found, k) <=> __found[k - 1]))"))
    counts = "transform(__ends, (e, j) -> named_struct('place', __found[e - 1], 'n', e - coalesce(get(__ends, j - 1), 0)))"
    return docs.withColumns({"counts": F.expr(counts), "others": F.expr("n_words - size(__found)")}).drop("__found", "__ends", "hashes", "at", "places")


def _part(p: str, q: str) -> str:
    """What one bin, of the share ``p`` here and ``q`` there, adds to twice the divergence."""
    side = "if({0} > 0, {0} * log2(2 * {0} / ({0} + {1})), 0)"
    return f"{side.format(p, q)} + {side.format(q, p)}"


def _distance(twice: str) -> Column:
    return F.expr(f"sqrt(greatest(0, {twice}) / 2)")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``kept`` and both distances of each row of ``docs``.

    A document fails when it has fewer than ``MIN_WORDS`` words or more than
    ``MAX_REPEATED_PERCENT`` of its words stand in repeated windows. Of the
    others, those with ``JUDGED_WORDS`` words whose language has a reference go
    when a distance exceeds what its number of bins and words allows.

    Defined cases: a null text counts as empty (all counts 0, failed); documents
    of a null language are compared with each other; distances are null where
    nothing is judged; repeated rows and null ids each keep their row; an empty
    table gives no row; other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).alias("lang"))
    known = save(references(rows), "languages").withColumnRenamed("lang", "of")
    symbols = F.char_length("text") - F.char_length(F.translate("text", SYMBOLS, ""))
    solid = F.char_length("text") - F.col("classes")[list(CLASSES).index("blank")]
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    out = with_classes(rows).withColumns({"n_symbols": symbols.cast("long"), "word_chars": solid.cast("long"), "__lines": lines})
    out = out.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long")).drop("__lines")
    out = with_repeats(with_hashes(with_words(out).drop("text")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    out = out.withColumn("base_failed", failed).join(known, F.col("lang").eqNullSafe(F.col("of")), "left")
    out = _with_word_counts(out)
    chars = "aggregate(classes, 0L, (a, x) -> a + x)"
    by_class = f"aggregate(zip_with(transform(classes, c -> c / chars), class_shares, (p, q) -> {_part('p', 'q')}), 0D, (a, x) -> a + x)"
    bins = "concat(counts, if(others > 0, array(named_struct('place', size(shares) - 1, 'n', others)), cast(array() as array<struct<place: int, n: int>>)))"
    # A common word that the document lacks adds its whole share; all shares together are 1.
    present = f"aggregate(transform({bins}, c -> named_struct('p', c.n / n_words, 'q', shares[c.place])), 0D, (a, c) -> a + {_part('c.p', 'c.q')} - c.q)"
    judged = (F.col("n_words") >= JUDGED_WORDS) & F.col("total").isNotNull()
    out = out.withColumn("chars", F.expr(chars))
    out = out.withColumns({"class_distance": F.when(judged, _distance(by_class)), "word_distance": F.when(judged, _distance(f"1 + {present}"))})
    allowed = lambda bins: BASE + NOISE * F.sqrt(bins / F.col("n_words"))
    near = (F.col("class_distance") <= allowed(F.lit(len(CLASSES) + 1))) & (F.col("word_distance") <= allowed(F.size("shares")))
    kept = ~F.col("base_failed") & F.coalesce(near, F.lit(True))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "class_distance", "word_distance")
