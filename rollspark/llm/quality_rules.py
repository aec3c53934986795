"""Quality rules: divergence of a document's histograms from language references, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import let, released, written

#: Words whose shares are compared: letters and the marks, apostrophes and hyphens inside them.
LETTERS = r"^\\p{L}[\\p{L}\\p{M}\'\\-]*$"
#: The words of a text, split in compiled code, without a lambda.
WORDS = r"array_remove(split(_text, '\\s+'), '')"
#: Classes of characters, which share none; what is in none of them is "other". Digits stand with the letters without case,
#: since a key or a number in a short clean text is no sign of junk.
CLASSES = (r"\\p{Ll}\\p{Lo}\\p{M}\\p{N}", r"\\s", r"\\p{Lu}", r".,;:''\"?()\\-", r"#*$%&|<>!")
SYMBOLS = r"[#*$%&|<>]"


def common_words(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = 12, min_texts: int = 20, max_languages: int = 200, error: float = 0.1) -> dict[str | None, list[str]]:
    """The ``most`` commonest words of each language, and under None of all languages together.

    A word counts by the distinct texts that hold it, so a page that is copied often counts once; the number is a sketch of
    their hashes with the relative ``error``, merged within tasks first, so that what is shuffled is a sketch for each word of
    a task. Words of one text are left out, ties go to the smaller word. Languages: those with ``min_texts`` distinct texts, and
    of these the ``max_languages`` with the most; the list of all comes from theirs, or from all rows where there are none. The
    result is all that the driver sees.
    """
    # The empty word stands for the texts themselves.
    words = F.expr(f"array_union(filter(array_distinct({WORDS}), x -> x rlike '{LETTERS}'), array(''))")
    named = docs.select(F.col(lang).alias("_lang"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    # A text is hashed before its words are rows, else it would be hashed for each of them. No list is empty or null, and the
    # outer explode needs no filter that says so, for which the words would be made again.
    listed = named.select("_lang", F.xxhash64("_text").alias("_h"), words.alias("_words")).select("_lang", "_h", F.explode_outer("_words").alias("_word"))
    held = listed.groupBy("_lang", "_word").agg(F.approx_count_distinct("_h", error).alias("_n"))
    held = written(held.where("_n > 1 or _word = ''"), "common-words")
    sizes = held.where((F.col("_word") == "") & F.col("_lang").isNotNull() & (F.col("_n") >= min_texts)).orderBy(F.desc("_n"), "_lang").limit(max_languages).collect()
    names = [r["_lang"] for r in sizes]
    place = F.row_number().over(Window.partitionBy("_lang").orderBy(F.desc("_n"), "_word"))
    own = held.where(F.col("_lang").isin(names) & (F.col("_word") != "")).withColumn("_k", place).where(F.col("_k") <= most)
    found: dict[str | None, list[str]] = {name: [] for name in names}
    sums: dict[str, int] = {}
    for r in own.orderBy("_lang", "_k").collect():
        found[r["_lang"]].append(r["_word"])
        sums[r["_word"]] = sums.get(r["_word"], 0) + r["_n"]
    if not names:
        rest = held.where("_word <> ''").groupBy("_word").agg(F.sum("_n").alias("_n")).orderBy(F.desc("_n"), "_word").limit(most).collect()
        sums = {r["_word"]: r["_n"] for r in rest}
    found[None] = sorted(sums, key=lambda w: (-sums[w], w))[:most]
    released(held)
    return found


def _bins(common: dict[str | None, list[str]], most: int) -> dict[str | None, list[str]]:
    """The words of each language's histogram: those of all, then its own others; empty strings fill the places left."""
    both = {k: common[None] + [""] * (most - len(common[None])) + [w for w in ws if k is not None and w not in common[None]] for k, ws in common.items()}
    return {k: ws + [""] * (2 * most - len(ws)) for k, ws in both.items()}


def _by_language(values: dict[str | None, list], lang):
    """A column: the value of the row's language, else the one under None."""
    named = [x for k, v in values.items() if k is not None for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*named), lang), F.lit(values[None])) if named else F.lit(values[None])


def rule_counts(docs: DataFrame, bins: dict[str | None, list[str]], text: str = "text") -> DataFrame:
    """Add the counts of the rules: ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``,
    ``chars`` (character classes) and ``hits`` (the ``bins`` of the row's ``lang``, then the other words). Null text counts as
    empty.

    Everything is counted inside the row: repeated three-word windows are found by sorting the windows' hashes, so a
    long text costs n log n and nothing is shuffled. Steps are columns of their own, so that all but the lambdas is compiled.
    """
    # The input row is one column, so its names clash with none made here.
    words = docs.select(F.struct(*docs.columns).alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    words = words.withColumns({"_words": F.expr(WORDS), "_bins": _by_language(bins, F.col("_row.lang"))})
    grams = let("transform(_words, w -> xxhash64(w))", "h", "if(size(h) < 3, array(), transform(sequence(0, size(h) - 3), i -> xxhash64(h[i], h[i + 1], h[i + 2])))")
    # One pass over the text takes out most of it by the simplest of tests; what is left is short.
    words = words.withColumns({"_grams": F.expr(grams), "_rest": F.regexp_replace("_text", "[a-z ]+", "")})
    words = words.withColumn("_word_chars", F.length(F.array_join("_words", "")))
    # Windows with an equal one beside them, in order of their hashes; then the words that they cover, in order of their places.
    covered = let(
        "sort_array(transform(_grams, (x, i) -> struct(x, i)))",
        "s",
        "aggregate(sort_array(transform(filter(s, (y, k) -> (k > 0 and s[k - 1].x = y.x) or (k + 1 < size(s) and s[k + 1].x = y.x)), y -> y.i)), "
        "struct(-3 as at, 0 as n), (a, i) -> struct(i as at, a.n + least(3, i - a.at) as n), a -> a.n)",
    )
    repeated = f"if(size(array_distinct(_grams)) = size(_grams), 0, {covered})"
    lines = let(r"filter(split(_text, '\n'), l -> l rlike '\\S')", "l", "size(l) - size(array_distinct(l))")
    # White space is what is in no word, so it goes together with the first class.
    chars = "array(_word_chars - length(t1), length(_text) - _word_chars, length(t1) - length(t2), length(t2) - length(t3), length(t3) - length(t4), length(t4))"
    for i, taken in reversed(list(enumerate((CLASSES[0] + CLASSES[1], *CLASSES[2:]), 1))):
        chars = let(f"regexp_replace({f't{i - 1}' if i > 1 else '_rest'}, '[{taken}]+', '')", f"t{i}", chars)
    # Words of the bins are picked out first; then each bin's are what goes when they are taken away.
    hits = let(
        "filter(_words, w -> w in ({}))".format(", ".join(f"'{_quoted(w)}'" for w in sorted({w for ws in bins.values() for w in ws}))),
        "c",
        "transform(_bins, v -> if(v = '', 0, size(c) - size(array_remove(c, v))))",
    )
    hits = let(hits, "b", "concat(b, array(size(_words) - aggregate(b, 0, (a, x) -> a + x)))")
    return words.select(
        *[F.col("_row")[c].alias(c) for c in docs.columns],
        F.expr("size(_words)").cast("long").alias("n_words"),
        F.col("_word_chars").cast("long").alias("word_chars"),
        F.regexp_count("_rest", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.expr(lines).cast("long").alias("n_dup_lines"),
        F.expr(repeated).cast("long").alias("n_repeat_words"),
        F.expr(chars).alias("chars"),
        F.expr(hits).alias("hits"),
    )


def _quoted(word: str) -> str:
    return word.replace("\\", "\\\\").replace("'", "\\'")


def divergence(ours: str, theirs: str) -> str:
    """SQL for the Jensen-Shannon distance (square root, base 2) between an array of counts and one of probabilities."""
    body = (
        "sqrt(greatest(0D, aggregate(zip_with(transform(c, x -> x / tot), q, (p, r) -> "
        "0.5D * (if(p > 0, p * log2(2 * p / (p + r)), 0D) + if(r > 0, r * log2(2 * r / (p + r)), 0D))), 0D, (a, x) -> a + x)))"
    )
    return let(ours, "c", let(theirs, "q", let("cast(aggregate(c, 0, (a, x) -> a + x) as double)", "tot", f"if(tot > 0, {body}, 1D)")))


def _references(clean: DataFrame, most: int) -> dict[str, dict[str | None, list[int]]]:
    """Summed histograms by kind and language, and of all under None, where a language's own words are among the others."""
    width = {"chars": len(CLASSES) + 1, "hits": 2 * most + 1}
    sums = [F.sum(F.col(c)[i]).alias(f"{c}{i}") for c in width for i in range(width[c])]
    pools = {r["_known"]: r for r in clean.groupBy("_known").agg(*sums).collect()}
    found = {c: {k: [r[f"{c}{i}"] or 0 for i in range(n)] for k, r in pools.items()} for c, n in width.items()}
    pooled = {c: [sum(v[i] for v in per.values()) for i in range(width[c])] for c, per in found.items()}
    pooled["hits"] = pooled["hits"][:most] + [0] * most + [sum(pooled["hits"][most:])]
    return {c: {**{k: v for k, v in per.items() if k is not None and sum(v)}, None: pooled[c]} for c, per in found.items()}


def _with_distances(rows: DataFrame, reference: dict[str, dict[str | None, list[int]]], most: int) -> DataFrame:
    shares = {c: {k: [x / (sum(v) or 1) for x in v] for k, v in per.items()} for c, per in reference.items()}
    held = rows.withColumns({"_qc": _by_language(shares["chars"], F.col("lang")), "_qw": _by_language(shares["hits"], F.col("lang"))})
    # A language without a clean text is held against all, which know no words of its own.
    folded = F.expr(f"concat(slice(hits, 1, {most}), array_repeat(0, {most}), array(aggregate(slice(hits, {most + 1}, {most + 1}), 0, (a, x) -> a + x)))")
    held = held.withColumn("_hits", F.when(F.col("lang").isin([k for k in reference["hits"] if k is not None]), F.col("hits")).otherwise(folded))
    return held.withColumns({"char_distance": F.expr(divergence("chars", "_qc")), "word_distance": F.expr(divergence("_hits", "_qw"))}).drop("_qc", "_qw", "_hits")


def quality_rules(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    max_char_distance: float = 0.13,
    max_word_distance: float = 0.40,
    min_chars: int = 200,
    min_words: int = 100,
    columns: list[str] | None = None,
    common: int = 12,
    min_texts: int = 20,
) -> DataFrame:
    """Judge documents by base rules and by Jensen-Shannon distance to the references of their language.

    Each language with ``min_texts`` distinct texts has its ``common`` commonest words (``common_words``), and references of its
    own: pooled histograms over all its distinct texts that pass the base rules and then over the half of them that is
    nearest to that pool; a document of another or no language, or of one without such texts, is held against the words and the pool of
    all. ``kept`` is false if a base rule fails, if the character classes are further than ``max_char_distance`` away (texts of ``min_chars`` and more) or the common words
    further than ``max_word_distance`` (texts of ``min_words`` and more). Null, empty or blank text: no words, so
    ``base_failed``. Repeated rows are judged alike; an empty table gives an empty result; all input columns (or the ``columns`` named) stay,
    whatever their names, and an input column with the name of a result column is replaced.
    """
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars", "hits", "base_failed", "char_distance", "word_distance", "kept")
    columns = [c for c in columns or docs.columns if c not in made]
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    # The input row is one column, so its names clash with none made here.
    row = F.struct(*columns) if columns else F.struct(F.lit(0).alias("none"))
    used = docs.select(row.alias("row"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    bins = _bins(common_words(used, most=common, min_texts=min_texts), common)
    counted = rule_counts(used, bins).withColumn("base_failed", failed).withColumn("h", F.xxhash64("text"))
    counted = written(counted.select("row", "lang", "h", *made[:8]), "rule-counts")

    # References are a few rows of sums, whatever the input. Those of all clean rows come first; the final ones pool the half
    # of each language's rows that lies nearest to them, so that oddities among the clean rows do not shape what they are held to.
    known = F.when(F.col("lang").isin([k for k in bins if k is not None]), F.col("lang"))
    clean = counted.where(~F.col("base_failed") & (F.col("n_symbols") * 50 < F.col("word_chars"))).withColumn("_known", known)
    # A text that is there many times counts once in its language.
    clean = written(clean.select("_known", "lang", "h", "chars", "hits").dropDuplicates(["_known", "h"]), "clean-texts")
    first = _with_distances(clean, _references(clean, common), common)
    half = {r["_known"]: r["m"] for r in first.groupBy("_known").agg(F.percentile_approx("char_distance", 0.5, 1000).alias("m")).collect()}
    near = F.coalesce(*[F.when(F.col("_known").eqNullSafe(F.lit(k)), F.lit(m)) for k, m in half.items()], F.lit(-1.0))
    judged = _with_distances(counted, _references(first.where(F.col("char_distance") <= near), common), common)
    odd = ((F.col("char_distance") > max_char_distance) & (F.aggregate("chars", F.lit(0), lambda a, x: a + x) >= min_chars)) | (
        (F.col("word_distance") > max_word_distance) & (F.col("n_words") >= min_words)
    )
    return judged.select(*[F.col("row")[c].alias(c) for c in columns], *made[:8], "char_distance", "word_distance", (~F.col("base_failed") & ~odd).alias("kept"))
