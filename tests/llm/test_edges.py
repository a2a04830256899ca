"""Edge cases: stage functions on odd tables, very long texts, large close groups, indexes by themselves."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import fingerprints, licenses, lm, mixing, neardup, packing, quality, substrings, suffixes, tokens, winnow

from . import brute

SENTENCE = "The quick brown fox jumps over the lazy dog while thirteen other animals look on in silence today."
CLASH = ["cut_id", "cut_text", "row", "gone_id", "kept_id", "mix_row", "class", "band", "block", "rank", "source_size", "salt", "kept", "queue", "at"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)
ROWS = [
    (1, SENTENCE, "en", "a"), (2, SENTENCE, "en", "a"), (2, SENTENCE, "en", "a"), (3, None, None, None), (4, "", "en", "b"), (5, " \n ", "en", "b"),
    (None, SENTENCE + " And more.", "en", "a"), (None, None, "en", None), (6, "Before that: " + SENTENCE, "en", "b"), (7, " ".join(f"w{i}" for i in range(40)), "en", "b"),
]


def table(spark, rows):
    full = [(d, t, lang, s, None if t is None else len(t), *[f"{c}-{d}" for c in CLASH]) for d, t, lang, s in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.mark.parametrize("stage", [quality.filter_documents, neardup.deduplicate, substrings.remove_duplicates, mixing.mix_documents], ids=lambda f: f.__name__)
def test_stages_keep_clashing_columns_and_odd_rows(spark, stage):
    docs = table(spark, ROWS)
    got = stage(docs)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    rows = got.collect()
    for r in rows:
        assert all(r[c] == f"{c}-{r.doc_id}" for c in CLASH)
    ids = Counter(r.doc_id for r in rows)
    if stage is quality.filter_documents:
        assert {1, 2, 6} <= set(ids) and not {3, 4, 5} & set(ids)
    elif stage is neardup.deduplicate:
        assert ids == Counter({1: 1, 3: 1, 4: 1, 5: 1, 7: 1, None: 2})  # 6 shares 14 of 16 shingles with 1
    elif stage is substrings.remove_duplicates:
        text = {r.doc_id: r.text for r in rows}
        assert 2 not in ids and text[6].split() == ["Before", "that:"] and text[1] == SENTENCE and ids[None] == 2
    assert stage(table(spark, [])).collect() == []


def test_packing_odd_rows(spark):
    got = packing.pack(table(spark, ROWS)).collect()
    assert {r.doc_id for r in got} == {d for d, *_ in ROWS} and {(2, 1), (2, 2)} <= {(r.doc_id, r.copy) for r in got}
    assert sorted(r.offset for r in got)[0] == 0 and sum(r.length for r in got) == sum(r.doc_tokens for r in got if r.start == 0)


@pytest.mark.parametrize("turn", [0, 1])
def test_near_duplicates_do_not_depend_on_the_order_of_rows(spark, turn):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a, "en", "s"), (1, b, "en", "s"), (2, b + " extra", "en", "s"), (3, a + " more", "en", "s"), (None, a, "en", "s")]
    rows = rows[::-1] if turn else rows
    got = {(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(table(spark, rows)).collect()}
    assert got == {(1, 1, True), (2, 1, False), (3, 1, False), (None, 1, False)}


def test_near_duplicates_in_chunks(spark, monkeypatch):
    """A group of near copies about as similar as the threshold, dealt over many chunks."""
    monkeypatch.setattr(neardup, "CHUNK_BYTES", 40_000)
    rng, rows = random.Random(11), []
    for g in range(2):
        base = [f"t{g}x{i}" for i in range(100)]
        for i in range(250):
            text = list(base)
            for _ in range(rng.choice([1, 2, 2, 3, 3, 4, 5])):
                text[rng.randrange(100)] = f"n{rng.randrange(10**6)}"
            rows.append((g * 1000 + i, " ".join(text), "en", "s"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(table(spark, rows)).collect()}
    want = brute.near_duplicates([(d, t) for d, t, *_ in rows])
    assert got == want and 2 < len({c for _, c in want.values()}) < 400


def test_a_second_batch_meets_the_levels_of_the_first():
    rng = random.Random(4)
    texts = [bytes(rng.choice(b"ab") for _ in range(300)) for _ in range(40)]
    texts += [texts[3][40:200] + texts[7][:90], texts[0]]
    family, length, first = suffixes.SuffixFamily(12), 12, {}
    for d, text in enumerate(texts):
        starts = np.arange(len(text) - length + 1)
        got = family.add(np.frombuffer(text, np.uint8), starts, np.full(len(starts), d, np.uint64))
        windows = [text[i : i + length] for i in starts]
        assert got.tolist() == [first.get(w, d) < d for w in windows]
        for w in windows:
            first.setdefault(w, d)
        sizes = [len(x) for x in family.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))
        for level in family.levels:
            assert (level.suffixes[:-1] < level.suffixes[1:]).all()
    assert sum(map(len, family.levels)) == len(first)


def test_factors_reach_as_far_as_the_reference():
    words = [np.random.default_rng(5).integers(1, 2**62, 60).astype(np.uint64)]
    words.append(np.concatenate([words[0][10:30], np.arange(5, dtype=np.uint64), words[0][40:52]]))
    first = np.array([0, 60])
    got = substrings.parse(winnow.Reference(np.concatenate(words), first, np.array([48, 25]), np.array([1, 2], np.uint64)))
    assert not got[:48].any() and np.flatnonzero(got[48:]).tolist() == list(range(8))


def test_very_long_texts(spark):
    rng = random.Random(9)
    ws = [f"word{rng.randrange(5000)}" for _ in range(180_000)]
    long = " ".join(w + ("\n" if i % 50 == 0 else "") for i, w in enumerate(ws))
    assert len(long) > 1_400_000
    rows = [(1, long, "en", "a"), (2, long + " tail", "en", "a"), (3, "short text", "en", "a")]
    docs, pairs = table(spark, rows), [(d, t) for d, t, *_ in rows]
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.repeated_words(docs).collect()} == brute.word_dedup(pairs)
    assert {r.doc_id: (r.n_removed, r.n_spans) for r in suffixes.repeated_bytes(docs).collect()} == {1: (0, 0), 2: (len(long), 1), 3: (0, 0)}
    assert {r.doc_id: r.n_words for r in quality.judge(docs).collect()} == {1: len(ws), 2: len(ws) + 1, 3: 2}
    assert {r.doc_id: r.n_tokens for r in lm.score_documents(docs).collect()} == {1: len(ws) + 1, 2: len(ws) + 2, 3: 3}
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    assert got[1].near_next > 0.999 and got[3].near_next < 0.1 and got[1].n_chars == len(long)
    assert {r.doc_id: r.n_paragraphs for r in licenses.scan(docs).collect()} == {1: 1, 2: 1, 3: 1}
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokens.default_tokenizer())
    want = {d: len(model.encode(t, add_special_tokens=False).ids) for d, t in pairs}
    assert {r.doc_id: r.n_tokens for r in tokens.token_counts(docs).collect()} == want
    packed = packing.pack(docs).groupBy("doc_id").agg(F.sum("length")).collect()
    assert {r[0]: r[1] for r in packed} == {d: n + 1 for d, n in want.items()}
