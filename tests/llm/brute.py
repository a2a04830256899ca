"""Plain Python versions of the operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def quality(text):
    text = text or ""
    ws = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(ws) - 4):
        at.setdefault(tuple(ws[i : i + 5]), []).append(i)
    repeated = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    return {
        "n_words": len(ws), "word_chars": sum(map(len, ws)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": dup, "n_repeat_words": len(repeated),
        "base_failed": len(ws) < 10 or 100 * len(repeated) > 20 * len(ws),
    }


def shingles(text):
    ws = words(ascii_lower(text or ""))
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set()


def components(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_duplicates(docs):
    sets = {d: shingles(t) for d, t in docs}
    having = {}
    for d, s in sets.items():
        for x in s:
            having.setdefault(x, []).append(d)
    common = {}
    for ds in having.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                common[a, b] = common.get((a, b), 0) + 1
    links = [(a, b) for (a, b), n in common.items() if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)]
    return {d: (len(sets[d]), c) for d, c in components(sets, links).items()}


def removed(docs, units, length):
    """For each document, the set of unit positions covered by a window that also starts in a smaller document."""
    first = {}
    for d, seq in sorted((d, units(t)) for d, t in docs):
        for i in range(len(seq) - length + 1):
            first.setdefault(tuple(seq[i : i + length]) if isinstance(seq, list) else seq[i : i + length], d)
    out = {}
    for d, t in docs:
        seq = units(t)
        out[d] = {
            j for i in range(len(seq) - length + 1)
            if first[tuple(seq[i : i + length]) if isinstance(seq, list) else seq[i : i + length]] < d for j in range(i, i + length)
        }
    return out


def word_dedup(docs):
    gone = removed(docs, words, 13)
    return {d: (len(ws := words(t)), len(gone[d]), hashlib.sha256(" ".join(w for i, w in enumerate(ws) if i not in gone[d]).encode()).hexdigest()) for d, t in docs}


def byte_dedup(docs):
    gone = removed(docs, lambda t: (t or "").encode(), 50)
    out = {}
    for d, t in docs:
        data, cut = (t or "").encode(), gone[d]
        spans = sum(1 for i in cut if i - 1 not in cut)
        out[d] = (len(data), len(cut), spans, hashlib.sha256(bytes(b for i, b in enumerate(data) if i not in cut)).hexdigest())
    return out


def edited(docs):
    out, rows = {}, sorted((d, t or "") for d, t in docs)
    for i, (d, t) in enumerate(rows):
        n, after = len(t), rows[(i + 1) % len(rows)][1]
        out[d] = (n, hashlib.sha256((t[: n - n // 2] + after[: n // 2]).encode()).hexdigest())
    return out


def crc(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


def targets(sizes):
    """sizes: source -> words. Shares 150 % of all sizes by weight 3, 1, 2, ... with a cap of twice the size."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def fences(rows, metrics):
    """rows: (lang, source, {metric: value}); the exact fences of each (lang, source): metric -> (low, high)."""

    def quartiles(values):
        values = sorted(values)
        return [values[-(-len(values) * q // 4) - 1] for q in (1, 2, 3)]

    by_lang, by_group = {}, {}
    for lang, source, values in rows:
        for m, v in values.items():
            by_lang.setdefault((lang, m), []).append(v)
            by_group.setdefault((lang, source, m), []).append(v)
    out = {}
    for (lang, source, m), values in by_group.items():
        n = len(values)
        a, b, c = ((n * x + 100 * y) / (n + 100) for x, y in zip(quartiles(values), quartiles(by_lang[lang, m])))
        least = metrics[m][1]
        out.setdefault((lang, source), {})[m] = (b - 6 * max(c - b, least), b + 6 * max(min(b - a, c - b), least))
    return out


def license_scan(pairs, model):
    """{doc_id: (n_paragraphs, families, {(line, family): (probability, template share)})}, all pieces of all paragraphs."""
    import math

    import xxhash

    from loomgraph.llm import licenses as L

    word_list = lambda t: [w for w in re.split("[^a-z0-9+]+", t.lower()) if w]
    grams_of = lambda ws: [f"{a} {b}" for a, b in zip(ws, ws[1:])]
    weight = L.bigram_weights()
    templates = {f: [list(dict.fromkeys(grams_of(word_list(t)))) for t in ts] for f, ts in L.TEMPLATES.items()}
    share = lambda t, held: sum(weight[g] for g in t if g in held) / sum(weight[g] for g in t)
    out = {}
    for doc, text in pairs:
        lines = re.sub("\r\n?", "\n", text or "").split("\n")
        paragraphs, at = [], None
        for i, line in enumerate(lines):
            if not line.strip(" \t"):
                at = None
            elif at is None:
                at = [i, [line]]
                paragraphs.append(at)
            else:
                at[1].append(line)
        families, entries = set(), {}
        for first, own in paragraphs:
            words = word_list("\n".join(own))
            parts = [words, *map(word_list, own)]
            parts += [words[i : i + span] for span in L.SPANS for i in range(0, max(1, len(words)), span // 2)]
            stand, open_ = [], []
            for part in {tuple(p) for p in parts}:
                held = set(grams_of(part))
                marked = any(m in " ".join(part) for m in L.MARKS)
                if not marked and not any(share(t, held) >= L.CONFIRM - 1e-9 for ts in templates.values() for t in ts):
                    continue
                hashed = {xxhash.xxh64(g.encode(), seed=42).intdigest() % L.FEATURES for g in [*part, *held]}
                z = [model.bias[f] + sum(model.weights[h][f] for h in hashed) / math.sqrt(max(1, len(hashed))) for f in range(len(L.FAMILIES))]
                e = [math.exp(x - max(z)) for x in z]
                p = [x / sum(e) for x in e]
                family = L.FAMILIES[p.index(max(p))]
                found, best = max([(share(t, held), sorted(set(t) & held)) for t in templates.get(family, [])], default=(0.0, []))
                if max(p) >= model.cutoff and found >= L.CONFIRM - 1e-9:
                    stand.append((family, max(p), found, set(best)))
                elif p[-1] < model.prose:
                    open_.append((1 - p[-1], found))
            stand = [s for s in stand if not any(s[0] != o[0] and s[3] < o[3] for o in stand)]
            for family in {s[0] for s in stand}:
                families.add(family)
                entries[first, family] = max(s[1:3] for s in stand if s[0] == family)
            if not stand and open_:
                entries[first, L.UNKNOWN] = max(open_)
        out[doc] = (sum(bool(re.search(r"\S", "\n".join(o))) for _, o in paragraphs), sorted(families), entries)
    return out
