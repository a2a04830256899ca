"""Each stage of the pipeline on what its predecessor kept, against brute force."""

import random
from collections import Counter

import corpus_pipeline
from tokenizers import Tokenizer

from loomgraph.llm import quality, tokens
from loomgraph.session import materialize

from . import brute

SF = "/root/testdata/sf0.001"


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, steps = zip(*corpus_pipeline.STAGES)
    assert names == ("quality_rules", "near_dedup", "substring_dedup", "source_mixing", "sequence_packing")
    tables = [docs]
    for step in steps:
        tables.append(materialize(step(spark, tables[-1], SF), "stage"))
    start, kept, distinct, cut, mixed, packed = tables
    for t in tables[1:5]:
        assert t.columns == docs.columns and t.dtypes == docs.dtypes

    verdicts = {r.doc_id for r in quality.judge(start).where("kept").collect()}
    assert {d for d, _ in pairs(kept)} == verdicts
    good = {d for d, t in pairs(start) if not brute.quality(t)["base_failed"]}
    assert verdicts <= good and len(verdicts) > 0.8 * len(good)

    found = brute.near_duplicates(pairs(kept))
    assert {d for d, _ in pairs(distinct)} == {d for d, (_, c) in found.items() if d == c}

    gone, texts = brute.removed(pairs(distinct), brute.words, 13), dict(pairs(distinct))
    want = {d: [w for i, w in enumerate(brute.words(t)) if i not in gone[d]] for d, t in texts.items()}
    got = {r.doc_id: r for r in cut.collect()}
    assert {d: brute.words(r.text) for d, r in got.items()} == {d: ws for d, ws in want.items() if ws or not gone[d]}
    assert all(r.n_chars == len(r.text) for d, r in got.items() if gone[d])
    assert all(r.text == texts[d] for d, r in got.items() if not gone[d])

    copies = Counter(d for d, _ in pairs(mixed))
    assert set(copies) <= set(got) and max(copies.values()) <= 2
    model = Tokenizer.from_file(tokens.default_tokenizer())
    total = sum(len(model.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in pairs(mixed))
    assert packed.agg({"length": "sum"}).first()[0] == total
    assert packed.selectExpr("max(sequence_id)").first()[0] == (total - 1) // 2048


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "copy"] and out.count() > 0


SYLLABLES = [a + b + c for a in "bdflmnrst" for b in "aeiou" for c in ("n", "rt", "st", "ver", "ling")]


def clean(i):
    """A text of words of usual length that the quality rules keep."""
    rng = random.Random(i)
    return "\n".join(" ".join(rng.choice(SYLLABLES) for _ in range(14)).capitalize() + "." for _ in range(8))


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, queue int, words long, block long, copy long"


def write(spark, tmp_path, rows):
    full = [(d, t, lang, s, None if t is None else len(t), 1, 2, 3, 4) for d, t, lang, s in rows]
    spark.createDataFrame(full, COLUMNS).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, write(spark, tmp_path, [])).collect() == []


def test_nulls_repeats_long_texts_and_clashing_columns(spark, tmp_path):
    long = "\n".join(clean(1000 + i) for i in range(300))
    near = clean(1) + " one more word here"
    rows = [
        (1, clean(1), "en", "a"), (2, clean(1), "en", "a"), (3, near, None, None), (4, clean(4), None, "b"), (5, None, "en", "a"), (6, "", None, None), (7, " \n ", "en", "b"),
        (8, "too short", "en", "a"), (9, long, "en", "a"), (10, clean(10), "en", None), (11, clean(11), "de", "b"), (12, clean(12), "en", "a"),
    ]
    where = write(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{where}/documents.parquet")
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = materialize(step(spark, docs, where), "edge")
        assert [c.name for c in docs.schema] == [c.split()[0] for c in COLUMNS.split(", ")], name
        ids = {r.doc_id for r in docs.collect()}
        # Clean documents stay, short and blank ones go with the first stage, copies with the second.
        assert {1, 4, 10, 11, 12} <= ids if name != "source_mixing" else ids, name
        assert not ids & {5, 6, 7, 8} and (name == "quality_rules" or not ids & {2, 3}), (name, ids)
    lengths = Counter()
    for r in corpus_pipeline.run(spark, where).collect():
        lengths[r.doc_id, r.copy] += r.length
        assert r.length > 0 and r.offset + r.length <= 2048
    assert {d for d, _ in lengths} == ids
