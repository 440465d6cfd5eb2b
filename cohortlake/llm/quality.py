"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a condition that rejects a text. On a sample of all rows its cost
is what it takes beyond the counts that every text has, its selectivity the share
it rejects; the rules are then ordered by rejection per cost and become one CASE,
which stops at the first that rejects. A cost is counted, not timed: the characters
or words of the sample that a rule's measures pass over, times the work of each,
so the order is the same in every run. What only later rules read is not
computed for a text that an earlier one rejects: its distinct words, its
capitals, digits and marks, and, where the counts of all texts are not asked
for, its windows of words. The order changes what is computed, never the verdict.

Defined results: a null text has no words, like an empty one; it fails the rule
of least words. Ids, ties, repeated rows and other columns play no part; a column
of the name of a result gives way to it, and names that begin with ``__quality_``
are the module's own; an empty table gives an empty result. Texts of any length are
judged whole.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


SPACE = " \t-\r"  # space and U+0009 to U+000D, in a class of a pattern
SYMBOLS = "#*$%&|<>"
WINDOW = 8
SAMPLE = 2000
#: Work of a measure for each character or word of a text, one pass of a pattern over a character being 1; measured once, on 3,000 documents.
WORK = {"n_distinct_words": ("words", 10.0), "n_capitals": ("chars", 1.0), "n_digits": ("chars", 1.0), "n_marks": ("chars", 1.0), "n_brackets": ("chars", 1.0), "n_top_word": ("words", 12.0), "n_links": ("words", 2.0), "n_repeat_words": ("words", 17.0)}
COMPARED = 1.0  # work of a condition on counts that are there
Condition = Callable[[Callable[[str], Column]], Column]


def words(text: Column) -> Column:
    """Maximal runs of characters other than space and U+0009 to U+000D."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def _own(name: str) -> Column:
    return F.col(f"__quality_{name}")


def _add(df: DataFrame, **new: Column) -> DataFrame:
    return df.withColumns({f"__quality_{k}": v for k, v in new.items()})


BASE = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _most(words_: Column) -> Column:
    """How often the most frequent word stands, if that is over two fifths of the words; else at most that.

    In order, such a word takes up over two fifths of the places in a row, so it
    stands at the first place or two or four fifths on.
    """

    def times(s: Column, fifths: int) -> Column:
        return F.size(s) - F.size(F.array_remove(s, F.get(s, F.floor(F.size(s) * fifths / 5).cast("int"))))

    return F.get(F.transform(F.array(F.sort_array(words_)), lambda s: F.greatest(*[F.coalesce(times(s, k), F.lit(0)) for k in (0, 2, 4)])), F.lit(0))


def _measures(docs: DataFrame, text_col: str) -> tuple[DataFrame, Callable[[str], Column]]:
    """The rows with their words, lines and cheap counts, and every other measure by its name.

    Needs no shuffle: all is counted within the row. Each step names what later
    steps read more than once, so arrays are made once a row.
    """
    out = _add(docs, text=F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    out = _add(out, words=words(_own("text")), lines=F.filter(F.split(_own("text"), "\n"), lambda x: F.rlike(x, F.lit(f"[^{SPACE}]"))))
    number = lambda chars: F.length(F.regexp_replace(_own("text"), f"[^{chars}]+", ""))
    cheap = {
        "n_words": F.size(_own("words")),
        "word_chars": F.length(F.regexp_replace(_own("text"), f"[{SPACE}]+", "")),
        "n_symbols": number(SYMBOLS),
        "n_lines": F.size(_own("lines")),
        "n_dup_lines": F.size(_own("lines")) - F.size(F.array_distinct(_own("lines"))),
    }
    out = _add(out, **{k: v.cast("bigint") for k, v in cheap.items()})
    dear = {
        "n_distinct_words": F.size(F.array_distinct(_own("words"))),
        "n_capitals": number("A-Z"),
        "n_digits": number("0-9"),
        "n_marks": number("!?"),
        "n_brackets": number(r"()\[\]{}"),
        "n_top_word": _most(_own("words")),
        "n_links": F.size(F.filter(_own("words"), lambda w: F.contains(w, F.lit("://")) | F.startswith(w, F.lit("www.")))),
    }
    return out, lambda name: dear[name].cast("bigint") if name in dear else _own(name)


def _zipped(left: Column, right: Column, by: int) -> Column:
    """The fingerprints of runs at each place that ``left`` begins and ``right``, ``by`` places on, ends."""
    n = F.greatest(F.least(F.size(left), F.size(right) - by), F.lit(0))
    return F.zip_with(F.slice(left, 1, n), F.slice(right, by + 1, n), lambda a, b: F.xxhash64(a, b))


def _windows(out: DataFrame, asked: Column, window: int) -> DataFrame:
    """Adds the count of words in repeated windows; null where not asked for."""
    most = lambda x: F.greatest(x, F.lit(0))
    some = _own("words").isNotNull() & asked & (F.size(_own("words")) >= window)
    out = _add(out, hash1=F.when(some, F.transform(_own("words"), lambda w: F.xxhash64(w))).otherwise(F.array().cast("array<bigint>")))
    # fingerprints of runs of 1, 2, 4 .. words, each from two neighbours, joined to the width asked for
    width, joined, done = 1, None, 0
    while True:
        if window & width:
            run = _own(f"hash{width}")
            if joined is not None:
                out = _add(out, joined=_zipped(_own(joined), run, done))
            joined, done = ("joined" if joined is not None else f"hash{width}"), done + width
        if 2 * width > window:
            break
        run = _own(f"hash{width}")
        out = _add(out, **{f"hash{2 * width}": _zipped(run, run, width)})
        width *= 2
    out = _add(out, grams=_own(joined))
    # only a text with a repeated window sorts its windows; equal neighbours give the places
    twice = F.size(F.array_distinct(_own("grams"))) < F.size(_own("grams"))
    out = _add(out, sorted=F.when(twice, F.sort_array(F.transform(_own("grams"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    n = most(F.size(_own("sorted")) - 1)
    same = F.zip_with(F.slice(_own("sorted"), 1, n), F.slice(_own("sorted"), 2, n), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    out = _add(out, at=F.when(_own("sorted").isNotNull(), F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))))
    k = most(F.size(_own("at")) - 1)
    gaps = F.zip_with(F.slice(_own("at"), 1, k), F.slice(_own("at"), 2, k), lambda a, b: F.least(b - a, F.lit(window)))
    repeated = F.when(_own("at").isNotNull(), F.aggregate(gaps, F.lit(window), lambda acc, g: acc + g)).otherwise(F.lit(0)).cast("bigint")
    return _add(out, n_repeat_words=F.when(asked, repeated))


@dataclass(frozen=True)
class Rule:
    """``rejects`` makes the condition from what gives a measure by its name."""

    name: str
    rejects: Condition
    reads_windows: bool = False


def rules() -> list[Rule]:
    """The rules over measures, in whole numbers."""
    return [
        Rule("few_words", lambda c: c("n_words") < 20),
        Rule("repeated_words", lambda c: 100 * c("n_repeat_words") > 30 * c("n_words"), reads_windows=True),
        Rule("repeated_lines", lambda c: 100 * c("n_dup_lines") > 30 * c("n_lines")),
        Rule("symbols", lambda c: 10 * c("n_symbols") > c("n_words")),
        Rule("short_words", lambda c: c("word_chars") < 2 * c("n_words")),
        Rule("long_words", lambda c: c("word_chars") > 20 * c("n_words")),
        Rule("few_distinct_words", lambda c: 50 * c("n_distinct_words") < c("n_words")),
        Rule("capitals", lambda c: 2 * c("n_capitals") > c("word_chars")),
        Rule("digits", lambda c: 2 * c("n_digits") > c("word_chars")),
        Rule("marks", lambda c: c("n_marks") > c("n_words")),
        Rule("brackets", lambda c: 5 * c("n_brackets") > c("n_words")),
        Rule("one_word", lambda c: 5 * c("n_top_word") > 2 * c("n_words")),
        Rule("links", lambda c: 5 * c("n_links") > c("n_words")),
    ]


def work_of(rule: Rule) -> Column:
    """What the rule takes for a text beyond the counts that every text has."""
    read: set[str] = set()
    rule.rejects(lambda name: (read.add(name), F.lit(1))[1])
    size = {"chars": F.length(_own("text")), "words": F.size(_own("words"))}
    out = F.lit(COMPARED)
    for name in sorted(read & WORK.keys()):
        unit, each = WORK[name]
        out = out + each * size[unit]
    return out


def order_rules(docs: DataFrame, chosen: list[Rule], text_col: str = "text", sample_rows: int = SAMPLE) -> list[tuple[Rule, float, float]]:
    """(rule, share rejected, work a text) by rejection per work, best first; of equals the cheaper, then by name.

    About ``sample_rows`` rows are drawn from all partitions; one job counts what
    each rule rejects and takes on them.
    """
    texts = docs.select(F.col(f"`{text_col}`").alias("text"))
    sample = texts.sample(False, min(1.0, sample_rows / max(1, texts.count())), 11)
    out, measure_of = _measures(sample, "text")
    if any(r.reads_windows for r in chosen):
        out = _windows(out, F.lit(True), WINDOW)
    found = out.agg(F.count(F.lit(1)).alias("n"), *[x for i, r in enumerate(chosen) for x in (F.count_if(F.coalesce(r.rejects(measure_of), F.lit(False))).alias(f"hits{i}"), F.sum(work_of(r)).alias(f"work{i}"))]).first()
    n = max(1, found["n"])
    ranked = [(r, found[f"hits{i}"] / n, (found[f"work{i}"] or 0.0) / n or COMPARED) for i, r in enumerate(chosen)]
    return sorted(ranked, key=lambda x: (-x[1] / x[2], x[2], x[0].name))


def cascade(ordered: list[Rule], measure_of: Callable[[str], Column]) -> Column:
    """The name of the first rule that rejects, null if none does."""
    out = F
    for rule in ordered:
        out = out.when(F.coalesce(rule.rejects(measure_of), F.lit(False)), F.lit(rule.name))
    return out.otherwise(F.lit(None).cast("string")) if ordered else F.lit(None).cast("string")


def apply_cascade(docs: DataFrame, ordered: list[Rule], text_col: str = "text", verdict_col: str = "rejected_by", with_stats: bool = False, window: int = WINDOW) -> DataFrame:
    """The rows with the verdict of the rules in this order and, with ``with_stats``, a struct ``stats`` of the base counts."""
    nth = next((i for i, r in enumerate(ordered) if r.reads_windows), len(ordered))
    out, measure_of = _measures(docs, text_col)
    out = _add(out, first=cascade(ordered[:nth], measure_of))
    out = _windows(out, F.lit(True) if with_stats else _own("first").isNull() & F.lit(nth < len(ordered)), window)
    out = _add(out, verdict=F.coalesce("__quality_first", cascade(ordered[nth:], measure_of)))
    # one row each; a filter on the verdict then stays above and does not copy the arrays into its condition
    result = F.struct(F.col("__quality_verdict").alias("v"), *([F.struct(*[_own(k).alias(k) for k in BASE]).alias("s")] if with_stats else []))
    new = {verdict_col: F.col("__quality_result.v")} | ({"stats": F.col("__quality_result.s")} if with_stats else {})
    kept = [F.col(f"`{x}`") for x in docs.columns if x not in new]
    out = out.select(*kept, F.explode(F.array(result)).alias("__quality_result"))
    return out.select(*kept, *[v.alias(k) for k, v in reversed(new.items())])


def apply_rules(docs: DataFrame, text_col: str = "text", chosen: list[Rule] | None = None, sample_rows: int = SAMPLE, verdict_col: str = "rejected_by", with_stats: bool = False) -> DataFrame:
    """The rows with ``verdict_col``, the name of a rule that rejects them or null.

    Costs and selectivities are estimated on about ``sample_rows`` rows; the
    rules see every row. ``with_stats`` adds the base counts of every row.
    """
    ordered = [r for r, _, _ in order_rules(docs, chosen or rules(), text_col, sample_rows)]
    return apply_cascade(docs, ordered, text_col, verdict_col, with_stats)


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts and verdict for every text of ``documents``."""
    out = apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), with_stats=True)
    s = lambda x: F.col(f"stats.{x}")
    base = (s("n_words") < 20) | (100 * s("n_repeat_words") > 30 * s("n_words"))
    return out.select("doc_id", *[s(x).alias(x) for x in BASE if x != "n_lines"], base.alias("base_failed"), (~base & F.col("rejected_by").isNull()).alias("kept"))


OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (
  SELECT *, list_transform(range(1, len(words) - 6), lambda i: array_to_string(words[i:i+7], ' ')) AS grams FROM w),
r AS (
  SELECT *, list_filter(range(1, len(grams) + 1), lambda i: list_count_map[grams[i]] > 1) AS hits
  FROM (SELECT *, list_histogram(grams) AS list_count_map FROM g)),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(list_distinct(words)) AS n_distinct_words,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals, length(regexp_replace(text, '[^0-9]', '', 'g')) AS n_digits,
         list_max(map_values(list_histogram(words))) AS n_top_word, len(list_filter(words, lambda w: contains(w, '://') OR starts_with(w, 'www.'))) AS n_links,
         length(regexp_replace(text, '[^!?]', '', 'g')) AS n_marks, length(regexp_replace(text, '[^][(){}]', '', 'g')) AS n_brackets, len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         CASE WHEN len(hits) = 0 THEN 0 ELSE 8 + coalesce(list_sum(list_transform(range(1, len(hits)), lambda i: least(8, hits[i+1] - hits[i]))), 0) END::BIGINT AS n_repeat_words
  FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * n_dup_lines > 30 * n_lines
            OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR 50 * n_distinct_words < n_words OR 2 * n_capitals > word_chars OR 2 * n_digits > word_chars
            OR n_marks > n_words OR 5 * n_brackets > n_words OR 5 * n_top_word > 2 * n_words OR 5 * n_links > n_words) AS kept
FROM m
"""
