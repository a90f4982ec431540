import random
import zlib
import re
from collections import Counter

import numpy as np
from placelore.llm import ngramjoin, phrases, spelling
from placelore.llm.unionfind import components

WIDE = "doc_id long, text string, lang string, word string, n long, class long, key string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, g, "x", 1, 2, "y") for d, t, g in rows], WIDE)


def prose(rng, n, words=400):
    return [f"w{int(words * rng.random() ** 2)}" for _ in range(n)]


def test_components_over_several_rounds(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(300)] + [(1000 + rng.randrange(400), 1000 + rng.randrange(400)) for _ in range(250)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    df = spark.createDataFrame([*edges, (None, 3), (5000, 5000)], "a long, b long").repartition(7)
    got = {r.node: r.label for r in components(df, one_task=20).collect()}
    assert got == {**{x: find(x) for x in top}, 5000: 5000}
    assert components(df.limit(0)).count() == 0


def brute_join(rows, percent=85, size=4):
    sets, least = [], {}
    for _, t, _ in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None:
                continue
            same, both = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if both and 100 * same >= percent * both or rows[i][0] == rows[j][0] and sets[i] and sets[j]:
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    twin = {frozenset(s): least[find(i)] for i, s in enumerate(sets) if rows[i][0] is not None and s}
    return sorted((str(d), len(sets[i]), str(least[find(i)] if d is not None else twin.get(frozenset(sets[i])))) for i, (d, _, _) in enumerate(rows))


def joined(df, **options):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngramjoin.jaccard_join(df, **options).collect())


def test_join_equals_all_pairs(spark):
    rng, rows = random.Random(5), []
    common = prose(rng, 40)
    for group in range(14):
        base = prose(rng, rng.choice([3, 4, 12, 60, 300, 1200])) + (common if group % 3 == 0 else [])
        for _ in range(rng.randrange(1, 9)):
            text = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 30))):
                text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows) * 7 % 997, " ".join(text).upper() if rng.random() < 0.3 else " ".join(text), "en"))
    rows += [(900, None, None), (901, "", "en"), (902, " \t\n", "en"), (903, "one two", "en"), (904, "ONE  two", None), rows[3], (5, rows[0][1], "en"), (None, rows[0][1], "en"), (None, None, None), (906, "a " * 5000, "en"), (907, "a " * 6000, "en")]
    rng.shuffle(rows)
    assert joined(frame(spark, rows)) == brute_join(rows)
    assert joined(frame(spark, rows), block=3) == brute_join(rows)
    assert joined(frame(spark, rows).limit(0)) == []


def test_join_of_a_large_loose_group(spark):
    """Copies that differ in their own words: many pairs are on either side of the bound, and the hub is like few of them."""
    rng = random.Random(6)
    base = prose(rng, 150)
    rows = []
    for i in range(120):
        text = list(base)
        for at in rng.sample(range(150), rng.choice([1, 2, 3, 4, 5])):
            text[at] = f"y{rng.randrange(40)}"
        rows.append((i, " ".join(text), "en"))
    assert joined(frame(spark, rows), block=16) == brute_join(rows)


def test_no_similar_pair_is_cut_by_the_bounds():
    rng = np.random.default_rng(1)
    sets = []
    for _ in range(40):
        base = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 900)), dtype=np.uint64))
        sets += [base, *[np.unique(np.concatenate([base[rng.random(len(base)) > 0.06], rng.integers(0, 2**63, len(base) // 40, dtype=np.uint64)])) for _ in range(3)]]
    sets = [s for s in sets if len(s)]
    n = np.array([len(s) for s in sets])
    bits = ngramjoin.bitmaps(sets).view(np.uint64)
    tree = ngramjoin.Tree(np.arange(len(sets)), n, n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64), np.arange(len(sets)), bits)
    found = {tuple(sorted(p)) for p in ngramjoin.walk(tree, tree, 85, True)}
    want = {(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))}
    assert want and want <= found and len(found) < len(sets) ** 2 / 8


def brute_phrases(rows, least, most, longest=5):
    counts, words = {}, Counter()
    for _, t, g in rows:
        g = "und" if g is None else g
        c = counts.setdefault(g, Counter())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", "".join(x.lower() if "A" <= x <= "Z" else x for x in t or "")):
            w = re.findall("[^ \t]+", piece)
            words[g] += len(w)
            c.update(tuple(w[i:i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = []
    for g, c in counts.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in cand.items():
            if any(b >= a and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            score, k = min((1000 * a * words[g] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(g, i + 1, p.decode(), -a, l, r, words[g], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:most])]
    return sorted(out)


def test_phrases_equal_plain_counting(spark):
    rng, rows = random.Random(7), []
    fixed = [["new", "york", "city", "hall"], ["über", "den", "dächern"], ["a", "a", "a", "a", "a", "a"], ["of", "the"]]
    for i in range(300):
        text = []
        for _ in range(rng.randrange(30)):
            text += rng.choice(fixed) if rng.random() < 0.4 else [rng.choice("abcdefgh") + rng.choice("xyz")]
            text += rng.choice([[], [], ["."], [",\t"], ["\n"]])
        rows.append((rng.choice([i, i, None]), " ".join(text).title() if i % 5 == 0 else " ".join(text), rng.choice(["en", "en", "de", None])))
    rows += [(1, None, "en"), (2, "", None), (3, "x" * 50_000, "fr"), (4, " ".join(["long text"] * 9000), "es"), rows[0], rows[0]]
    for least, share in ((20, 4), (8, 1), (40, 1000)):  # the last sample is all but empty: everything comes from the border
        got = sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in phrases.collocations(frame(spark, rows), least, most=60, share=share).collect())
        assert got == brute_phrases(rows, least, 60)
    assert phrases.collocations(frame(spark, rows).limit(0)).count() == 0


def test_scores_past_64_bits(spark, monkeypatch):
    counts = [("en", 0, "", 9 * 10**15), ("en", 1, "a", 10**15), ("en", 1, "b", 10**15 + 7), ("en", 2, "a b", 10**15 - 1)]
    monkeypatch.setattr(phrases, "frequent_phrases", lambda *a: spark.createDataFrame(counts, "lang string, size int, phrase string, n long"))
    assert phrases.collocations(frame(spark, [(1, "", "en")])).collect()[0].score == 1000 * (10**15 - 1) * 9 * 10**15 // (10**15 * (10**15 + 7))


def brute_words(rows, least, min_count, dropped):
    counts = Counter()
    for d, t, _ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(x.lower() if "A" <= x <= "Z" else x for x in w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % dropped == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= least and n >= min_count}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(words, factor=5):
    out, form = {}, {}
    for w, n in words.items():
        close = [x for x in words if near(w, x)]
        best = min(close, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= factor * n else None
        out[w] = (n, len(close))
    rows = []
    for w, (n, k) in out.items():
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n, k, words[form[w]] if form[w] else None))
    return sorted(rows, key=str)


def test_spellings_equal_brute_force(spark):
    rng = random.Random(8)
    letters = "abcdéÿ×"
    base = ["".join(rng.choice(letters) for _ in range(rng.choice([5, 6, 7, 9, 12, 33, 40, 70, 150]))) for _ in range(40)]
    pool = list(base)
    for w in base * 4:
        i = rng.randrange(len(w))
        pool.append(rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1:], w + "a", w[1:]]))
    weight = {w: rng.choice([1, 5, 25, 125]) for w in pool}
    rows = [(i, " ".join(rng.choices(pool, [weight[w] for w in pool], k=60)).upper() if i % 4 == 0 else "-".join(rng.choices(pool, k=60)), "en") for i in range(60)]
    rows += [(None, None, None), (70, "", "en"), (None, "abcdefg " * 9, "en"), (71, "abcdef " * 3000, "en"), rows[0], (72, "q" * 3000 + " " + "q" * 2999, "x"), (72, "q" * 3000 + " " + "q" * 2999, "x")]
    rows += [(82, "abcabcab " * 130 + "abcabca " * 12 + "abcabc " * 2, "en")]
    words = brute_words(rows, 6, 2, 7)
    got = spelling.group_spellings(frame(spark, rows), 6, 2, dropped=7).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got), key=str) == brute_variants(words)
    assert any(r.form and r.root != r.form for r in got)
    assert spelling.group_spellings(frame(spark, rows).limit(0)).count() == 0
