"""Quality rules: base rules with fixed cutoffs, then adaptive fences from mergeable quantile sketches.

Metrics are log-odds of junk (symbols among characters, repeated lines among lines, each smoothed by half a count) and
the logarithm of the mean word length, so texts without any junk differ by their length and a group's spread is never
degenerate. A sketch of a metric counts values in bins of equal width (bins of equal ratio of the odds); sketches merge
by adding counts, a quantile is off by less than one bin, and reruns agree. One is kept for each (lang, source), and
those of one language add up to the language's.

A group's quantile is shrunk to its language's as if PRIOR documents of the language belonged to the group. A fence
stands SPREAD half-spreads from the median; the half-spread of an upper fence is the distance of the nearer quartile, that
of a lower fence the distance of the upper quartile. Junk moves neither much as long as it is the lesser part of its
group, so a source with much junk does not vouch for it. Nothing else decides: there are no fixed cutoffs besides the
base rules.

Defined results: null or empty text has no words, so the base rules reject it; null lang or source is a group of its
own; repeated rows and ties are judged one by one, a value on its fence is kept; very long texts are measured whole; an
empty table gives an empty result; extra columns are ignored by judge() and kept by filter_documents() whatever their
names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm import text as T
from loomgraph.session import ensure_importable, materialize

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
SPREAD = 6.0
PRIOR = 100
#: metric: (width of a bin, least half-spread, which fences it has)
METRICS = {"symbol_odds": (0.05, 0.25, "high"), "dup_line_odds": (0.05, 0.25, "high"), "word_length_log": (0.005, 0.02, "both")}

STATS_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _first_seen(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """True where an equal (doc, key) stands earlier in the array."""
    tagged = keys ^ T.mix(docs.astype(np.uint64) + np.uint64(1))
    order = np.argsort(tagged, kind="stable")
    later = np.zeros(len(keys), bool)
    same = tagged[order][1:] == tagged[order][:-1]
    later[order[1:][same]] = True
    return later


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of each document of one slice."""
    words = T.words(data, offsets)
    n_words = np.diff(words.bounds)
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
    prefix = T.prefix_hash(data)

    lines = T.runs(data != 10, offsets)
    first_word = np.searchsorted(words.starts, lines.starts)
    has_word = (first_word < len(words.starts)) & (np.append(words.starts, 0)[first_word] < lines.ends)
    starts, ends, docs = lines.starts[has_word], lines.ends[has_word], lines.docs[has_word]
    bounds = np.searchsorted(docs, np.arange(len(offsets)))
    dup_line = _first_seen(T.span_hash(prefix, starts, ends), docs)

    hashes = T.span_hash(prefix, words.starts, words.ends)
    windows = T.ngrams(hashes, WINDOW)
    at = np.flatnonzero(T.window_starts(words.bounds, WINDOW))
    tagged = windows[at] ^ T.mix(words.docs[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(tagged, kind="stable")
    same = tagged[order][1:] == tagged[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    repeated = T.covered(at[twice], WINDOW, len(hashes))

    return {
        "n_words": n_words,
        "word_chars": T.per_doc(chars[words.ends] - chars[words.starts], words.bounds),
        "n_symbols": T.per_doc(_SYMBOL[data], offsets),
        "n_dup_lines": T.per_doc(dup_line, bounds),
        "n_repeat_words": T.per_doc(repeated, words.bounds),
        "n_lines": np.diff(bounds),
    }


def _measure_batches(batches):
    for batch in batches:
        data, offsets = T.utf8(batch.column("text"))
        parts = [measure(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in T.slices(offsets)]
        if parts:
            columns = {k: pa.array(np.concatenate([p[k] for p in parts]).astype(np.int64)) for k in parts[0]}
            ids = {c: batch.column(c) for c in batch.schema.names if c != "text"}
            yield pa.RecordBatch.from_pydict(ids | columns)


def stats(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base counts of every document, from one pass over the texts."""
    ensure_importable(docs.sparkSession)
    counts = STATS_SCHEMA.split(", ", 1)[1]
    own = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string"))
    return own.mapInArrow(_measure_batches, f"doc_id long, lang string, source string, {counts}")


def _log_odds(part: Column, whole: Column) -> Column:
    return F.log((part + 0.5) / (F.greatest(whole - part, F.lit(0)) + 0.5))


def with_metrics(counts: DataFrame) -> DataFrame:
    return counts.withColumns(
        {
            "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
            "symbol_odds": _log_odds(F.col("n_symbols"), F.col("word_chars")),
            "dup_line_odds": _log_odds(F.col("n_dup_lines"), F.col("n_lines")),
            # as if 20 words of 5 characters were added
            "word_length_log": F.log((F.col("word_chars") + 100) / (F.col("n_words") + 20)),
        }
    )


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, metric, bin, n): adding n over sources, or over tables, merges sketches."""
    entries = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.floor(F.col(m) / width).cast("int").alias("bin")) for m, (width, *_) in METRICS.items()]))
    return measured.select("lang", "source", entries.alias("e")).groupBy("lang", "source", "e.metric", "e.bin").agg(F.count(F.lit(1)).alias("n"))


def quartiles(bins: DataFrame, *group: str) -> DataFrame:
    """The three quartiles of each sketch, in values: the middle of the bin that holds them."""
    upto = F.sum("n").over(Window.partitionBy(*group, "metric").orderBy("bin"))
    total = F.sum("n").over(Window.partitionBy(*group, "metric"))
    width = F.create_map(*[x for m, (w, *_) in METRICS.items() for x in (F.lit(m), F.lit(w))])[F.col("metric")]
    placed = bins.withColumns({"upto": upto, "total": total})
    at = lambda q: ((F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("bin"))) + 0.5) * F.first(width)).alias(f"q{int(100 * q)}")
    return placed.groupBy(*group, "metric").agg(F.first("total").alias("total"), at(0.25), at(0.5), at(0.75))


def fences(measured: DataFrame) -> DataFrame:
    """One row for each (lang, source): g_lang, g_source, and lower and upper fence of each metric."""
    bins = materialize(sketches(measured), "sketches")
    own = quartiles(bins, "lang", "source")
    of_lang = quartiles(bins.groupBy("lang", "metric", "bin").agg(F.sum("n").alias("n")), "lang")
    of_lang = of_lang.select(F.col("lang").alias("l_lang"), F.col("metric").alias("l_metric"), *[F.col(q).alias(f"l_{q}") for q in ("q25", "q50", "q75")])
    both = own.join(of_lang, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("metric") == F.col("l_metric")))
    q25, q50, q75 = ((F.col("total") * F.col(q) + PRIOR * F.col(f"l_{q}")) / (F.col("total") + PRIOR) for q in ("q25", "q50", "q75"))
    least = F.create_map(*[x for m, (_, s, _) in METRICS.items() for x in (F.lit(m), F.lit(s))])[F.col("metric")]
    high = q50 + SPREAD * F.greatest(F.least(q50 - q25, q75 - q50), least)
    limits = both.select("lang", "source", "metric", high.alias("high"), (q50 - SPREAD * F.greatest(q75 - q50, least)).alias("low"))
    out = {}
    for m, (*_, sides) in METRICS.items():
        out[f"{m}_high"] = F.max(F.when(F.col("metric") == m, F.col("high")))
        if sides == "both":
            out[f"{m}_low"] = F.max(F.when(F.col("metric") == m, F.col("low")))
    return limits.groupBy(F.col("lang").alias("g_lang"), F.col("source").alias("g_source")).agg(*[v.alias(k) for k, v in out.items()])


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, counts, metrics, fences, base_failed and kept for every document."""
    counts = with_metrics(materialize(stats(docs), "quality"))
    # Sketches skip what the base rules reject: junk must not set the fences.
    limits = fences(counts.where(~F.col("base_failed")))
    joined = counts.join(limits, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    inside = F.lit(True)
    for m, (*_, sides) in METRICS.items():
        inside = inside & F.coalesce(F.col(m) <= F.col(f"{m}_high"), F.lit(True))
        if sides == "both":
            inside = inside & F.coalesce(F.col(m) >= F.col(f"{m}_low"), F.lit(True))
    return joined.withColumn("kept", ~F.col("base_failed") & inside).drop("g_lang", "g_source")


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns.

    Documents whose rows share a doc_id are kept when any row of that id is; rows without doc_id likewise. The semi join
    reads the small verdict table.
    """
    verdicts = judge(docs).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    left = whole.join(verdicts, F.col("row.doc_id").cast("long").eqNullSafe(F.col("kept_id")), "left_semi")
    return left.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
