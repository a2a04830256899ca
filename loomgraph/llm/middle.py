"""Fill-in-the-middle rewriting of texts, in Arrow-batched pandas functions.

A text is a sequence of units: a word with the white space before it, or the white space at its end. Numbers that a seed
and the doc_id give choose two unit boundaries and the form; the text is cut there into prefix, middle and suffix, and a
reordered text with sentinels before its parts takes its place.

A text's unit ends fill one compact array of machine integers, and two lookups in it cut the text, so a text needs 4
bytes a unit beside itself, however long it is. Spark hands batches of rows to the function and no row meets another:
nothing is shuffled, and a lost executor costs its own batches only.

Defined results: null is the empty text, which is plain and has no units; a null doc_id counts as the empty word after the
seed; repeated rows are rewritten alike, each by itself; texts that hold a sentinel stay plain; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.session import ensure_importable

#: Fixed values of the format.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Possessive: what has been taken is never given back, so a run of white space of any length is passed once.
UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"
SEED, RATE, SPM_RATE = 42, 50, 80

KINDS = "n long, form string, prefix_chars long, middle_chars long"


def unit_ends(text: str) -> array:
    """Where each unit ends, in code points."""
    import regex

    return array("I", (m.end() for m in regex.finditer(UNIT, text)))


def draws(doc_id: str, seed: int) -> list[int]:
    """Four numbers of 32 bits that depend on the seed and the doc_id alone."""
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def rewrite(doc_id: str, text: str, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of prefix and middle, new text)."""
    ends = unit_ends(text)
    n = len(ends)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, PLAIN, None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    first, second = (ends[i - 1] if i else 0 for i in (a, b))
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if h4 % 100 < spm_rate:
        return n, SPM, first, second - first, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, PSM, first, second - first, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text that rewrite() made output from: sentinels stand only where it put them."""
    if form == PLAIN:
        return output
    first, second = (PREFIX, SUFFIX) if form == PSM else (SUFFIX, PREFIX)
    head, _, middle = output.partition(MIDDLE)
    one, _, two = head.removeprefix(first).partition(second)
    return (one + middle + two) if form == PSM else (two + middle + one)


def _function(schema: str, make, seed: int, rate: int, spm_rate: int):
    """A pandas function of (doc_id, text) whose rows are (what rewrite() gives but the text, make(output, form))."""

    @F.pandas_udf(schema)
    def apply(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        names = [part.split()[0] for part in schema.split(", ")]
        for doc_ids, texts in batches:
            rows = []
            for doc_id, text in zip(doc_ids, texts, strict=True):
                *kinds, output = rewrite(doc_id or "", text or "", seed, rate, spm_rate)
                rows.append((*kinds, *make(output, kinds[1])))
            out = pd.DataFrame(rows, columns=names, dtype=object)
            yield out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    return apply


def _with(docs: DataFrame, udf) -> DataFrame:
    ensure_importable(docs.sparkSession)
    # As text: a batch with a null would turn numbers into floating point.
    number: Column = F.col("doc_id").cast("long").cast("string")
    return docs.withColumn("rewritten", udf(number, F.col("text").cast("string")))


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """docs with text replaced by the rewritten text, and n, form, prefix_chars, middle_chars of that rewriting.

    rate: per cent of texts to rewrite; spm_rate: per cent of these in the order suffix, prefix, middle. Columns of docs
    with one of these four names are replaced; all others stay.
    """
    udf = _function(f"{KINDS}, output string", lambda output, form: (output,), seed, rate, spm_rate)
    out = _with(docs, udf)
    return out.withColumns({"text": F.col("rewritten.output")} | {c: F.col(f"rewritten.{c}") for c in ("n", "form", "prefix_chars", "middle_chars")}).drop("rewritten")


def digests(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of every row: no text leaves the workers."""
    sha = lambda text: hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
    udf = _function(f"{KINDS}, output_sha256 string, restored_sha256 string", lambda output, form: (sha(output), sha(restore(output, form))), seed, rate, spm_rate)
    return _with(docs.select("doc_id", "text"), udf).select(F.col("doc_id").cast("long").alias("doc_id"), "rewritten.*")
