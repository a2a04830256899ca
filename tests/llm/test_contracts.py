"""Every query against its brute-force version: on a generated table and on fixtures with edge cases."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import fingerprints, licenses, lm, mixing, neardup, packing, quality, queries, substrings, suffixes, tokens, winnow

from . import brute

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept int, tokens int, component int"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
SENTENCE = "The quick brown fox jumps over the lazy dog while thirteen other animals look on in silence today."
EDGE = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, "one", "en", None), (5, "one", "en", "b"),
    (6, "Licensed under the MIT License.", "en", "b"), (7, LONG, "en", "a"), (8, LONG + " tail", "en", "a"), (9, SENTENCE, "en", "b"),
    (10, "Before. " + SENTENCE + " After that.", "en", "b"), (11, SENTENCE, "en", "b"), (12, "a  b   c \n\n d  ", "en", "b"),
    (13, "größe ÄÖ <|endoftext|> 日本語 text", None, "b"), (14, "x " * 500, "en", "c"), (15, "line a\nline a\nline a\nother | b | c", "en", "c"),
    (16, "one two three", "en", "c"), (17, "One TWO three", "en", "c"), (18, "x" * 3000, "en", "c"), (20, "x" * 3000, "en", "c"),
]


def documents(spark, rows):
    full = [(d, t, lang, s, None if t is None else len(t), 1, 2, 3) for d, t, lang, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def cases(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in table.collect()]
    return [(table, rows), (documents(spark, EDGE), EDGE)]


def pairs(rows):
    return [(d, t) for d, t, *_ in rows]


def test_license_scan(spark, cases):
    assert licenses.classifier(spark).accuracy > 0.95
    table, rows = cases[0]
    got = {r.doc_id: r for r in licenses.scan(table).collect()}
    assert len(got) == len(rows)
    names = {"Apache License, Version 2.0": "apache-2.0", "the MIT License": "mit", "GNU General Public License, version 3": "gpl", "CC BY-NC 4.0": "cc-by-nc"}
    for d, t in pairs(rows):
        assert set(got[d].families) >= {f for n, f in names.items() if n in (t or "")}
        assert not got[d].families or any(m in t.lower() for m in licenses.MARKS)


def test_license_templates_and_hard_negatives(spark):
    marked = lambda t: any(m in t.lower() for m in licenses.MARKS)
    lines = [(t, f) for f, ts in licenses.TEMPLATES.items() for t in ts if marked(t)] + [(t, None) for t in licenses.NEGATIVES]
    rows = [(i, "Some text before.\n" + t + "\nand after", "en", "a") for i, (t, _) in enumerate(lines)]
    got = {r.doc_id: r.families for r in licenses.scan(documents(spark, rows)).collect()}
    for i, (t, f) in enumerate(lines):
        assert got[i] == ([f] if f else []), t


def test_license_templates_without_marks_and_wrapped(spark):
    lines = [(t, f) for f, ts in licenses.TEMPLATES.items() for t in ts]
    wrapped = lambda t: "\n".join(" ".join(t.split()[i : i + 6]) for i in range(0, len(t.split()), 6))
    rows = [(2 * i + j, f"Some text before.\n\n{x}\n\nand after", "en", "a") for i, (t, _) in enumerate(lines) for j, x in enumerate((t, wrapped(t)))]
    got = {r.doc_id: r for r in licenses.scan(documents(spark, rows)).collect()}
    for d, r in got.items():
        t, f = lines[d // 2]
        assert (r.families, r.n_paragraphs, r.n_confirmed) == ([f], 3, 1), t
        assert {p.line for p in r.paragraphs} == {2}


def test_license_scan_knows_what_it_does_not_know(spark):
    """Licences of other families, wrapped or not, are unknown, those that took no part in training too."""
    lines = [*licenses.OTHERS, *licenses.HELD_OUT, "Licensed under the Mulan Permissive Software License v2", "Licensed under the NTP License"]
    rows = [(i, f"Some text before.\n\n{t}\n\nand after", "en", "a") for i, t in enumerate(lines)]
    got = {r.doc_id: r for r in licenses.scan(documents(spark, rows)).collect()}
    for i, t in enumerate(lines):
        assert (got[i].families, got[i].n_paragraphs, got[i].n_unknown) == ([], 3, 1), t
        assert [(p.line, p.family) for p in got[i].paragraphs] == [(2, licenses.UNKNOWN)], t


def test_license_scan_lists_unseen_licences_and_no_prose(spark):
    """Notices of licences that took no part in training are listed, alone and inside other text; prose is not."""
    assert licenses.classifier(spark).notices > 0.95
    unseen = [
        "Distributed under the ISC License", "Licensed under the Mulan Permissive Software License v2", "Licensed under the GNU Affero General Public License version 3", "Released under the Fair License",
        "This module is licensed under the terms of the Q Public License", "SPDX-License-Identifier: OFL-1.1", "This package is available under the Beerware license", "Licensed under the Intel Open Source License",
    ]
    prose = [
        "The quick brown fox ran home", "A driving licence was found in the river", "The old dog had permission to sleep on the sofa", "The farm came under the domain of the abbey", "", "They reserved two seats by the door",
        "No warrant was signed that day", "The singer sold the copyright of her songs", "The state redistributes some of the money", "Her license to practice law was suspended",
    ]
    inside = lambda t: f"The house stood at the end of the lane and nobody went there. {t}. In the morning they walked to the river and came back late."
    lines = [*unseen, *map(inside, unseen), *prose, *map(inside, prose)]
    got = {r.doc_id: r for r in licenses.scan(documents(spark, [(i, t, "en", "a") for i, t in enumerate(lines)])).collect()}
    listed = [i in got and got[i].n_unknown + got[i].n_confirmed for i in range(len(lines))]
    n = 2 * len(unseen)
    assert sum(listed[:n]) >= n - 2, [lines[i] for i in range(n) if not listed[i]]
    assert sum(listed[n:]) <= 1, [lines[i] for i in range(n, len(lines)) if listed[i]]


def test_license_scan_is_that_of_all_pieces(spark, cases):
    """The whole result against a plain loop over every piece, on whole documents, edge cases, ties and mixed texts."""
    lines = [*licenses.OTHERS[:8], *licenses.NEGATIVES[:8], *(ts[0] for ts in licenses.TEMPLATES.values())]
    mixed = [(1000 + i, f"{a}. {b}\r\nmore\n \n\n{c}\n\n{c}\n{a}", "en", "a") for i, (a, b, c) in enumerate(zip(lines, lines[5:] + lines[:5], lines[11:] + lines[:11]))]
    mixed.append((None, "Licensed under the MIT License\n\nLicensed under the Fair License", None, None))
    model = licenses.classifier(spark)
    for table, rows in [*cases, (documents(spark, mixed), mixed)]:
        want = brute.license_scan(pairs(rows), model)
        for r in licenses.scan(table).collect():
            n, families, entries = want[r.doc_id]
            assert (r.n_paragraphs, r.families) == (n, families), r.doc_id
            assert len(r.paragraphs) == len(entries) and (r.n_confirmed, r.n_unknown) == (len({i for i, f in entries if f != "unknown"}), len([f for _, f in entries if f == "unknown"]))
            for p in r.paragraphs:
                assert entries[p.line, p.family] == pytest.approx((p.probability, p.template_share), abs=1e-5), (r.doc_id, p)  # literals of six digits


def test_one_text_of_many_notices(spark):
    """Every notice of a long text stands, each in its paragraph; what a paragraph holds does not touch the others."""
    lines = [(f, ts[0]) for f, ts in licenses.TEMPLATES.items() if ts]
    alone = {r.doc_id: r for r in licenses.scan(documents(spark, [(i, t, "en", "a") for i, (_, t) in enumerate(lines)])).collect()}
    many = [lines[i % len(lines)] for i in range(500)]
    got = licenses.scan(documents(spark, [(1, "\n\n".join(t for _, t in many), "en", "a")])).first()
    assert (got.n_paragraphs, got.n_confirmed, got.families) == (500, 500, sorted({f for f, _ in many}))
    assert [(p.line // 2, p.family, p.probability) for p in got.paragraphs] == [(i, p.family, p.probability) for i in range(500) for p in alone[i % len(lines)].paragraphs]


def test_license_gate_misses_no_template():
    import random

    weights, gate, rng = licenses.bigram_weights(), set(licenses.gate_words()), random.Random(2)
    for t in [t for ts in licenses.TEMPLATES.values() for t in ts]:
        grams = licenses._template_bigrams(t)
        for _ in range(200):  # any part of the bigrams that can be confirmed has a gate word
            some = rng.sample(grams, rng.randrange(1, len(grams) + 1))
            if sum(weights[g] for g in some) >= licenses.CONFIRM * sum(weights[g] for g in grams):
                assert any(set(g.split()) & gate for g in some), t


def test_license_scores_are_those_of_the_trained_weights(spark):
    """The plan's probability of a paragraph against the regression worked out in numpy."""
    import numpy as np

    model = licenses.classifier(spark)
    lines = [t for ts in licenses.TEMPLATES.values() for t in ts]
    got = {r.doc_id: r.paragraphs for r in licenses.scan(documents(spark, [(i, t, "en", "a") for i, t in enumerate(lines)])).collect()}
    frame = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    words = licenses._words(F.col("line"))
    grams = dict(frame.select("id", licenses._hashed(F.concat(words, licenses._bigrams(words)))).collect())
    for i, t in enumerate(lines):
        z = (model.weights[grams[i]].sum(0)) / math.sqrt(len(grams[i])) + model.bias
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        family = licenses.FAMILIES[int(p.argmax())]
        assert any(x.family == family and x.probability >= p.max() - 1e-6 for x in got[i]), t


def test_lm_scoring(cases):
    import zlib

    for table, rows in cases:
        got = {r.doc_id: r for r in lm.score_documents(table).collect()}
        toks = {d: [*brute.words(brute.ascii_lower(t or "")), None] for d, t in pairs(rows)}
        held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in toks}
        counts = Counter(w for d, ws in toks.items() if not held[d] for w in ws)
        total = sum(counts.values())
        for d, ws in toks.items():
            r = got[d]
            base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (len(counts) + 1))) for w in ws)
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(ws), sum(counts[w] > 0 for w in ws), total)
            assert math.isclose(r.base_score, base, rel_tol=1e-9)
            assert r.score < 0
        if rows is not EDGE:
            out = [r for r in got.values() if r.held_out]
            assert sum(r.score for r in out) > sum(r.base_score for r in out) * 0.97
            assert all(math.isclose(r.perplexity, 10 ** (-r.score / r.n_tokens), rel_tol=1e-9) for r in out)


def test_lm_probabilities_add_up(spark):
    """Over the vocabulary, the end token and the unknown word, after words that are contexts."""
    rows = [(i, " ".join("abcde"[(i * 7 + j * j) % 5] + "xy"[(i + j) % 2] for j in range(40)), "en", "s") for i in range(40)]
    model = lm.Model(documents(spark, rows))
    assert len(model.contexts) == 10 and model.vocabulary == 11
    vocabulary = sorted({w for _, t, *_ in rows for w in t.split()})
    probes = [f"{u} {w}" for u in vocabulary for w in [*vocabulary, "zzz"]] + vocabulary + ["zzz", ""]
    got = {probes[r.doc_id]: 10**r.score for r in model.score(documents(spark, [(i, t, "en", "s") for i, t in enumerate(probes)])).collect()}
    every = [*vocabulary, "zzz"]
    start = model_probabilities(model, None)
    assert math.isclose(sum(start.values()), 1, abs_tol=1e-9)
    for u in vocabulary:
        after = model_probabilities(model, u)
        assert math.isclose(sum(after.values()), 1, abs_tol=1e-9)
        for w in every:
            ends = model_probabilities(model, w)["end"]
            assert math.isclose(got[f"{u} {w}"], start[u] * after[w] * ends, rel_tol=1e-9)


def model_probabilities(model, context):
    """Predictive probabilities after a word (None: the start), from the state of the model and the formula."""
    import numpy as np

    from loomgraph.llm import text as T

    name = lambda w: int(lm.word_hashes(*T.utf8(__import__("pyarrow").array([w])))[0][0])
    place = {int(h): i for i, h in enumerate(model.contexts)}
    c = len(place) + 1 if context is None else place.get(name(context), len(place))
    counts, tables, parents = {}, {}, {}
    for r in model.state.collect():
        bucket = lm.Bucket(r.asDict(), model.samples[-1], model.discounts, model.vocabulary, model.n_contexts)
        kept, n = lm.grow(r["kept"]), len(bucket.counts)
        samples = kept[n:].reshape(2 * lm.KEPT, -1)
        for i, w in enumerate(bucket.words):
            parents[int(w)] = samples[:, i]
        for i in np.flatnonzero(bucket.contexts == c):
            counts[int(bucket.words[bucket.word_of[i]])], tables[int(bucket.words[bucket.word_of[i]])] = bucket.counts[i], kept[:n][i]
    d0, d = model.discounts
    seen, out = model.context_totals[c], {}
    names = {name(w): w for w in ["ax", "ay", "bx", "by", "cx", "cy", "dx", "dy", "ex", "ey"]} | {int(lm.END): "end", 0: "zzz"}
    for h in [*parents, 0]:
        p = (counts.get(h, 0) - d * tables.get(h, 0) / lm.KEPT) / (1 + seen)
        for s, sample in enumerate(model.samples):
            customers, own = parents[h][2 * s : 2 * s + 2] if h else (0, 0)
            parent = (customers - d0 * own + (1 + d0 * sample.tables) / (model.vocabulary + 1)) / (1 + sample.customers)
            p += (1 + d * sample.of_context[c]) / (1 + seen) * parent / lm.KEPT
        out[names[h]] = p
    return out


def test_gibbs_sampling_has_the_exact_posterior_of_table_counts():
    """p(t) is in proportion to S(c, t) a^t, with generalized Stirling numbers S of the discount."""
    import numpy as np

    d, n = 0.5, 4000
    for c, a in ((2, 0.3), (5, 2.0), (12, 0.8)):
        stirling = {(1, 1): 1.0}
        for m in range(1, c):
            for t in range(1, m + 2):
                stirling[m + 1, t] = stirling.get((m, t - 1), 0.0) + (m - t * d) * stirling.get((m, t), 0.0)
        weights = np.array([stirling[c, t] * a**t for t in range(1, c + 1)])
        rng = np.random.default_rng(1)
        tables = lm.Tables(np.full(n, c), np.full(n, 1), np.full(n, c))
        for _ in range(25):
            for dishes, matrix, rows in tables.steps(np.full(n, c)):
                tables.leave(dishes, matrix, rows, rng)
                tables.sit(dishes, matrix, rows, np.full(len(rows), a), d, rng)
            assert (tables.customers == c).all()
            tables = lm.Tables(tables.customers, tables.tables, tables.sizes())
        got = np.bincount(tables.tables, minlength=c + 1)[1:] / n
        assert np.abs(got - weights / weights.sum()).max() < 0.04


def test_lm_contexts_grow_with_the_corpus(spark):
    seen = []
    for copies in (1, 8):
        text = [" ".join(f"w{int(1e4 * ((i * 31 + j * 17) % 997 / 997) ** 4)}" for j in range(100)) for i in range(40 * copies)]
        table = documents(spark, [(5 * i, t, "en", "s") for i, t in enumerate(text)])
        words = Counter(w for d, t in table.select("doc_id", "text").where(~lm.held_out(F.col("doc_id"))).collect() for w in brute.words(t))
        total = sum(words.values())
        model = lm.Model(table)
        assert len(model.contexts) == sum(lm.CONTEXTS * n >= total**0.5 for n in words.values()) <= lm.CONTEXTS * total**0.5
        seen.append(len(model.contexts))
    assert seen[0] < seen[1]


def test_every_word_is_a_context(spark):
    """Rare words keep what follows them apart, though frequent words make up most of the corpus."""
    import numpy as np

    filler = " ".join("the of and to in is".split()[(j * j + j // 7) % 6] for j in range(400))
    rows = [(5 * i, f"{filler} rare{i % 30} next{i % 30} {filler}", "en", "s") for i in range(90)]
    model = lm.Model(documents(spark, rows))
    probes = [f"rare{i} next{j}" for i in range(30) for j in (i, (i + 1) % 30)]
    got = [r.score for r in model.score(documents(spark, [(i, t, "en", "s") for i, t in enumerate(probes)])).orderBy("doc_id").collect()]
    assert all(own > crossed + 1 for own, crossed in zip(got[::2], got[1::2]))
    # Each word's numbers as a context, which met from all buckets, against its pairs in all buckets.
    customers, tables, want = Counter(), Counter(), {}
    for r in model.state.collect():
        bucket = lm.Bucket(r.asDict(), None, model.discounts, model.vocabulary)
        for name, c, t in zip(bucket.names[bucket.of].tolist(), bucket.counts.tolist(), bucket.below.tables.tolist()):
            customers[name] += c
            tables[name] += t
        seen = np.bincount(bucket.word_of, bucket.counts, len(bucket.words))
        want |= dict(zip(bucket.words.tolist(), zip(seen.tolist(), lm.grow(r["around"]).reshape(lm.KEPT, -1)[-1].tolist())))
    assert {name: (customers[name], tables[name]) for name in customers} == want and len(want) == model.vocabulary


def test_lm_without_training_rows_and_without_ids(spark):
    import zlib

    out = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1]
    rows = [(i, f"word{i} and more", "en", "a") for i in out]
    for r in lm.score_documents(documents(spark, rows)).collect():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.score, r.perplexity) == (True, 4, 0, 0, 0.0, 1.0)
    got = lm.score_documents(documents(spark, [*rows, (None, "word7 and more", None, None), (None, None, None, None)])).collect()
    assert len(got) == len(rows) + 2 and {(r.held_out, r.train_tokens) for r in got if r.doc_id is None} == {(False, 5)}
    assert {(r.n_tokens, r.n_known) for r in got if r.doc_id is None} == {(4, 4), (1, 1)} and all(r.n_known == 3 + (r.doc_id == 7) for r in got if r.doc_id is not None)


def test_sweeps_keep_every_customer(spark):
    import numpy as np

    model = lm.Model(documents(spark, [(i, " ".join(f"w{(i * j) % 17}" for j in range(200)), "en", "s") for i in range(60)]))
    customers = np.zeros(model.n_contexts, int)
    for r in model.state.collect():
        bucket = lm.Bucket(r.asDict(), model.samples[-1], model.discounts, model.vocabulary, model.n_contexts)
        sizes, first = bucket.below.sizes(), np.cumsum(bucket.below.tables) - bucket.below.tables
        assert (sizes > 0).all() and (np.add.reduceat(sizes, first) == bucket.counts).all()
        above = bucket.above.sizes()
        assert (above > 0).all() and above.sum() == bucket.below.tables.sum()
        customers += np.bincount(bucket.contexts, bucket.counts, model.n_contexts).astype(np.int64)
    assert (customers == model.context_totals).all()
    assert 0 < model.samples[-1].of_context.sum() == model.samples[-1].customers


def test_quality(cases):
    for table, rows in cases:
        got = {r.doc_id: r.asDict() for r in quality.judge(table).collect()}
        assert len(got) == len(rows)
        for d, t in pairs(rows):
            want = brute.quality(t)
            assert {k: got[d][k] for k in want} == want, d
        passed = [r for r in got.values() if not r["base_failed"]]
        exact = brute.fences([(r["lang"], r["source"], {m: r[m] for m in quality.METRICS}) for r in passed], quality.METRICS)
        for r in got.values():
            margins = []
            for m, (width, _, sides) in quality.METRICS.items() if not r["base_failed"] else ():
                low, high = exact[r["lang"], r["source"]][m]
                # a quantile of the sketch is off by half a bin, a fence by 13 halves
                margins += [((high - r[m]), 6.6 * width)] + [((r[m] - low), 6.6 * width)] * (sides == "both")
            if r["base_failed"] or any(x < -slack for x, slack in margins):
                assert not r["kept"], r
            elif all(x > slack for x, slack in margins):
                assert r["kept"], r


def test_quality_rejects_the_junk_of_a_source_with_a_third_of_it(spark):
    def text(i, symbols):
        return " ".join([f"word{(i * 31 + j * 7) % 9973}" for j in range(60)] + ["#" * symbols]) + f" end{i}"

    def rows(start, source, lang, symbols):
        return [(start + i, text(start + i, symbols if i % 5 < 2 else 4), lang, source) for i in range(100)]

    docs = rows(0, "dirty", "en", 80) + rows(1000, "clean", "en", 4) + rows(2000, "other", "en", 4) + rows(3000, "only", "de", 400)
    got = {r.doc_id: r.kept for r in quality.judge(documents(spark, docs)).collect()}
    assert got == {d: not (d % 5 < 2 and (d < 1000 or d >= 3000)) for d, *_ in docs}


def test_quality_fences_follow_the_source(spark):
    """The same share of symbols is usual in one source and far out in another."""

    def text(i, symbols):
        return " ".join([f"word{1000 + (i * 31 + j * 7) % 8999}" for j in range(60 + i % 40)] + ["#" * symbols]) + f" end{i}"

    docs = [(i, text(i, 40 + i % 30), "en", "code") for i in range(400)] + [(1000 + i, text(i, i % 3), "en", "prose") for i in range(400)]
    docs += [(500, text(7, 60), "en", "code"), (1500, text(7, 60), "en", "prose")]
    got = {r.doc_id: r for r in quality.judge(documents(spark, docs)).collect()}
    assert got[500].kept and not got[1500].kept
    assert got[500].symbol_odds_high > got[1500].symbol_odds_high + 1
    assert sum(not r.kept for r in got.values()) <= 3


def test_token_counts(cases):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokens.default_tokenizer())
    for table, rows in cases:
        got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(table).collect()}
        for d, t in pairs(rows):
            n = len(model.encode(t or "", add_special_tokens=False).ids)
            assert got[d] == (len((t or "").encode()), n, n > 512), d


def test_fast_ids_and_safe_parts_are_the_library_s():
    import itertools

    import numpy as np
    from tokenizers import Tokenizer

    model, own = Tokenizer.from_file(tokens.default_tokenizer()), tokens.Encoder(tokens.default_tokenizer())
    texts = ["".join(x) for x in itertools.product([" ", "\n", "a", "'s", "\t", "é.", "<|endoftext|>"], repeat=5)]
    want = [x.ids for x in model.encode_batch(texts, add_special_tokens=False)]
    assert own.splits and [np.frombuffer(x, own.dtype).tolist() for x in own.encode(texts)] == want
    for text in texts[:4000]:
        parts = tokens.safe_parts(text, 2)
        assert "".join(parts) == text
        assert sum((list(own.ids(p)) for p in parts), []) == list(own.ids(text))


def test_near_duplicates(cases):
    for table, rows in cases:
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(table).collect()}
        assert got == brute.near_duplicates(pairs(rows))


def test_near_duplicates_of_many_close_groups(spark):
    import random

    rng = random.Random(5)
    base = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(160):
        text = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
            text[rng.randrange(120)] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(text), "en", "s"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(documents(spark, rows)).collect()}
    assert got == brute.near_duplicates(pairs(rows))


def test_word_dedup(cases):
    for table, rows in cases:
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.repeated_words(table).collect()}
        assert got == brute.word_dedup(pairs(rows))


def test_without_the_parse_no_word_is_removed(cases):
    for table, _ in cases:
        nothing = winnow.FirstOccurrences(table, substrings.LENGTH, substrings.ANCHOR, winnow.WordUnits, lambda reference: np.zeros(int(reference.count.sum()), bool))
        assert nothing.run(substrings._finish, substrings.RESULT).agg(F.sum("n_removed")).first()[0] == 0


def test_byte_dedup(cases):
    for table, rows in cases:
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.repeated_bytes(table).collect()}
        assert got == brute.byte_dedup(pairs(rows))


def test_dedup_of_spliced_passages(spark):
    import random

    rng = random.Random(3)
    passages = [" ".join(rng.choice("ab cd ef gh ij".split()) + str(rng.randrange(60)) for _ in range(60)) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            ws = rng.choice(passages).split(" ")
            a, n = rng.randrange(50), rng.randrange(5, 40)
            parts += ws[a : a + n] + [f"own{rng.randrange(10**6)}" for _ in range(rng.randrange(4))]
        rows.append((i * 3 % 121, " ".join(parts), "en", "s"))
    table = documents(spark, rows)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.repeated_words(table).collect()}
    assert got == brute.word_dedup(pairs(rows))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.repeated_bytes(table).collect()}
    assert got == brute.byte_dedup(pairs(rows))
    cut = {r.doc_id: r.text for r in substrings.remove_duplicates(table).collect()}
    gone = brute.removed(pairs(rows), brute.words, 13)
    for d, t in pairs(rows):
        assert brute.words(cut.get(d)) == [w for i, w in enumerate(brute.words(t)) if i not in gone[d]]


def test_packing(cases):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokens.default_tokenizer())
    for table, rows in cases:
        got = packing.pack(table).collect()
        by_doc, by_sequence = defaultdict(list), defaultdict(list)
        for r in got:
            by_doc[r.doc_id].append(r)
            by_sequence[r.sequence_id].append(r)
        for d, t in pairs(rows):
            ids = [*model.encode(t or "", add_special_tokens=False).ids, 1]
            at = 0
            for r in sorted(by_doc[d], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == brute.crc(ids[at : at + r.length])
                at += r.length
            assert at == len(ids)
        last = max(by_sequence)
        assert sorted(by_sequence) == list(range(last + 1))
        source = {d: s for d, _, _, s in rows}
        share = Counter()
        for r in got:
            share[source[r.doc_id]] += r.length
        total = sum(share.values())
        large = [s for s in share if s is not None and share[s] * packing.WINDOW >= 4 * total]
        for q, pieces in by_sequence.items():
            at = 0
            for r in sorted(pieces, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at == packing.WINDOW or q == last and at <= packing.WINDOW
            if q < last:
                for s in large[1:]:
                    n = sum(r.length for r in pieces if source[r.doc_id] == s)
                    assert abs(n - packing.WINDOW * share[s] / total) < 2 or max(share, key=share.get) == s


def test_packing_meets_the_targets_of_its_query(cases):
    table, rows = cases[0]
    source = {d: s for d, _, _, s in rows}
    names = sorted({s for s in source.values()}, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    got = packing.pack(table, packing.WEIGHTS).collect()
    last = {s: max(r.sequence_id for r in got if source[r.doc_id] == s) for s in names}
    for q in range(min(last.values())):  # before any queue runs dry
        for s in names:
            n = sum(r.length for r in got if r.sequence_id == q and source[r.doc_id] == s)
            assert abs(n - packing.WINDOW * weight[s] / sum(weight.values())) < 2  # a difference of two deficits below one token


def test_shares_of_large_numbers_are_exact():
    import random

    import numpy as np

    rng = random.Random(1)
    cases = [(rng.randrange(w + 1), rng.randrange(w + 1), w) for w in [rng.randrange(1, 2 ** rng.randrange(2, 62)) for _ in range(5000)]]
    got = packing.share(*(np.array(x, np.int64) for x in zip(*cases)))
    assert got.tolist() == [a * b // w for a, b, w in cases]


def test_packing_numbers_equal_rows(spark):
    rows = [(1, SENTENCE, "en", "a")] * 3 + [(2, "other", "en", "a")]
    got = {(r.doc_id, r.copy) for r in packing.pack(documents(spark, rows)).collect()}
    assert got == {(1, 1), (1, 2), (1, 3), (2, 1)}


def test_packing_targets():
    import numpy as np

    quotas = packing.Quotas([5000, 1000, 300], [1.0, 1.0, 0.0], window=100)
    parts = [quotas.pieces(np.array([q]), np.array([0]), np.array([n])) for q, n in enumerate((5000, 1000, 300))]
    assert [int(p[2].sum()) for p in parts] == [5000, 1000, 300]
    cells = sorted((int(w), int(o), int(n)) for p in parts for _, _, n, w, o in zip(*p))
    at = 0
    for w, o, n in cells:
        assert (w * 100 + o) == at
        at += n
    first = {q: int(sum(n for n, w in zip(p[2], p[3]) if w < 5)) for q, p in enumerate(parts)}
    assert abs(first[0] - first[1]) <= 2


def test_mixing(cases):
    for table, rows in cases:
        got = mixing.mix(table).collect()
        sizes, longest = Counter(), Counter()
        for d, t, _, s in rows:
            sizes[s] += len(brute.words(t))
            longest[s] = max(longest[s], len(brute.words(t)))
        want, taken = brute.targets(sizes), Counter()
        for r in got:
            assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9)
            assert 0 <= r.taken <= 2 * r.size
            taken[r.source] += r.taken
        assert len(got) == len(rows)
        for s in sizes:
            assert abs(taken[s] - want[s]) <= longest[s] + 0.1 * sizes[s]
        assert sorted(map(tuple, mixing.mix(table).collect())) == sorted(map(tuple, got))
        out = mixing.mix_documents(table)
        assert out.columns == table.columns
        assert Counter(r.doc_id for r in out.collect()) == Counter({r.doc_id: r.copies for r in got if r.copies})


def test_fingerprints(cases):
    for table, rows in cases:
        generated = rows is not EDGE
        want = brute.edited(pairs(rows))
        text = {d: t or "" for d, t in pairs(rows)}
        order = sorted(text)
        for block_bytes in (20_000, 8 << 20):
            got = {r.doc_id: r for r in fingerprints.fingerprints(table, block_bytes).collect()}
            assert {d: (r.n_chars, r.edited_sha256) for d, r in got.items()} == want
            prints = {}
            for d, r in got.items():
                assert prints.setdefault(text[d], r.fingerprint) == r.fingerprint
                follower = text[order[(order.index(d) + 1) % len(order)]]
                half = len(text[d]) // 2
                for near, other in ((r.near_edited, text[d][: len(text[d]) - half] + follower[:half]), (r.near_next, follower)):
                    assert 0 <= near <= 1 and math.isclose(near, likeness_by_sets(text[d], other), abs_tol=1e-12), d
        near = [r for r in got.values() if r.n_chars > 200]
        assert not generated or sum(r.near_edited > r.near_next for r in near) >= 0.95 * len(near)


def likeness_by_sets(a, b):
    x, y = (set(fingerprints.paragraphs([t.encode()])[1].tolist()) for t in (a, b))
    return 1 - len(x ^ y) / (len(x) + len(y)) if x or y else 1.0


def test_fingerprints_are_those_of_the_text_alone_and_subtract():
    import base64

    import numpy as np

    a, b = LONG, LONG.replace("w5x5", "changed", 3)
    cells = []
    for texts in ([a, b], [SENTENCE, a, b]):
        prints = fingerprints.encode(len(texts), fingerprints.paragraphs([t.encode() for t in texts]))[-2:]
        cells.append(prints)
    assert cells[0] == cells[1]
    x, y = (np.frombuffer(base64.b64decode(p), fingerprints.CELL) for p in cells[0])
    _, found, done = fingerprints.peel(1, fingerprints.CELLS, x["count"].astype(np.int64) - y["count"], x["xor"] ^ y["xor"], x["check"] ^ y["check"])
    own = [set(fingerprints.paragraphs([t.encode()])[1].tolist()) for t in (a, b)]
    assert done.all() and set(found.tolist()) == own[0] ^ own[1] and 2 <= len(found) <= 12


def test_peeling_counts_the_difference_exactly():
    import numpy as np

    rng = np.random.RandomState(1)
    for n in (0, 1, 5, 20, 200, 3000):
        common, a, b = (rng.randint(1, 2**62, k).astype(np.uint64) for k in (50, n, n // 2))
        left, right = np.concatenate([common, a]), np.concatenate([common, b])
        got = fingerprints.differing(1, (np.zeros(len(left), int), left), (np.zeros(len(right), int), right))
        assert got[0] == n + n // 2


EMPTY_QUERIES = [quality.judge, tokens.token_counts, neardup.near_duplicates, packing.pack, mixing.mix, fingerprints.fingerprints, substrings.repeated_words, suffixes.repeated_bytes, licenses.scan, lm.score_documents]


@pytest.mark.parametrize("operator", EMPTY_QUERIES, ids=lambda f: f.__name__)
def test_empty_table(spark, operator):
    assert operator(documents(spark, [])).collect() == []


@pytest.mark.parametrize("operator", EMPTY_QUERIES, ids=lambda f: f.__name__)
def test_repeated_rows(spark, operator):
    rows = [(1, SENTENCE, "en", "a")] * 3 + [(2, None, None, None)] * 2
    got = Counter(r.doc_id for r in operator(documents(spark, rows)).collect())
    assert set(got) == {1, 2} and (operator is packing.pack or got == {1: 3, 2: 2})
