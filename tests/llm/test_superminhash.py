import random

import numpy as np
from placelore.llm.superminhash import linked_in, near_duplicates, shingles, signatures

SCHEMA = "doc_id long, text string, n long, hub string, class string"


def brute(rows, percent=85):
    """Components by comparing all pairs of documents."""
    def words(t):
        return tuple((t or "").encode().lower().split())

    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({w[i:i + 5] for i in range(max(1, len(w) - 4))} if w else set())
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same, both = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if both and 100 * same >= percent * both or rows[i][0] == rows[j][0] and rows[i][0] is not None:
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((str(d), len(sets[i]), str(least.get(find(i)))) for i, (d, _) in enumerate(rows))


def result(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "x", "y") for d, t in rows], SCHEMA)


def test_estimates_similarity():
    rng = np.random.default_rng(0)
    for share in (0.85, 0.5):
        same = int(2 * 200 * share / (1 + share))
        found = []
        for _ in range(150):
            a = rng.integers(0, 2**63, 200, dtype=np.uint64)
            b = np.concatenate([a[:same], rng.integers(0, 2**63, 200 - same, dtype=np.uint64)])
            s = signatures(np.concatenate([a, b]), np.repeat([0, 1], 200), 2, 64)
            found.append((s[0] == s[1]).mean())
        assert abs(np.mean(found) - same / (400 - same)) < 0.015
        assert np.std(found) < (share * (1 - share) / 64) ** 0.5  # below that of independent permutations


def test_signature_is_a_permutation_for_one_element():
    s = signatures(np.array([9], np.uint64), np.array([1]), 2, 32)
    assert sorted(s[1].astype(int)) == list(range(32)) and np.isinf(s[0]).all()


def test_against_all_pairs(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for size in (12, 40, 120, 300):
        for _ in range(4):
            base = [rng.choice(vocabulary) for _ in range(size)]
            for _ in range(12):
                copy = list(base)
                for _ in range(rng.choice([0, 0, 1, 2, 3, size // 40 + 1])):
                    copy[rng.randrange(size)] = rng.choice(vocabulary)
                rows.append((n, " ".join(copy).title() if rng.random() < 0.3 else "\n".join(copy)))
                n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "two words"), (n + 4, "Two  Words"), (n + 5, "two"), (0, rows[0][1]), (n + 6, "É é é é é é"), (n + 7, "é é é é é é"), (None, rows[7][1]), (None, None)]
    rng.shuffle(rows)
    got = near_duplicates(frame(spark, rows).repartition(3), block=4)
    assert result(got) == brute(rows)
    kept = [r for r in got.collect() if r.kept]
    assert all(r.doc_id == r.component_id for r in kept)


def test_a_chain_links_through_strays(spark):
    """Around a hub each next copy differs by a little more; the far ones are linked only with each other."""
    words = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(words[2 * i:] + [f"n{j}" for j in range(2 * i)])) for i in range(14)]
    assert result(near_duplicates(frame(spark, rows), block=2)) == brute(rows)


def test_a_group_of_near_copies_gives_no_more_links_than_it_has_classes():
    """Sixty strays, all similar to each other: one link less than strays, none within one component."""
    strays = [(i, 100, np.array([*range(1000, 1030), i]), i) for i in range(60)]
    found = linked_in(strays, strays, 85)
    assert len(found) == 59
    joined = {0}
    for _ in found:
        joined |= {x for pair in found if joined & set(pair) for x in pair}
    assert joined == set(range(60))
    assert linked_in([(*x[:3], 7) for x in strays], [(*x[:3], 7) for x in strays], 85) == []


def test_long_texts_and_many_copies(spark):
    text = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(i, text) for i in range(60)] + [(60, text + " end"), (61, "other words stand here alone")]
    assert result(near_duplicates(frame(spark, rows))) == brute(rows[58:62] + rows[:58])


def test_empty_and_null_tables(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    got = near_duplicates(frame(spark, [(1, None), (2, None)])).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_shingles_of_short_texts():
    assert len(shingles(b"a b c")) == 1 and len(shingles(b"a b c d e f")) == 2 and len(shingles(b"")) == len(shingles(None)) == 0
    assert (shingles(b"A b\tc") == shingles(b"a B c")).all() and (shingles(b"a b") != shingles(b"b a")).all()
