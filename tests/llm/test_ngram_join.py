import random

import numpy as np

import hazeloom.llm.ngram_join as ngram_join_module
from hazeloom.llm.components import connected_components
from hazeloom.llm.ngram_join import in_blocks, keep_one_of_each, ngram_join
from hazeloom.llm.regions import link_counts, spanning_links

SPACES = " \t\n\x0b\x0c\r"


def shingles(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else " " if c in SPACES else c for c in text or "")
    w = [x for x in text.split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((doc, len(s), least[find(i)] if s else doc) for i, (doc, s) in enumerate(sets))


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = [(900, None), (901, ""), (902, " \n"), (903, "Short one"), (904, "short  ONE"), (905, "a"), (906, "b " * 30_000), (907, "b " * 20_000), (908, "É é x y z"), (909, "é é x y z")]
    for i in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(3, 120))]
        if i % 3 == 0:
            base += passage
        for k in range(rng.choice([1, 1, 2, 6, 14])):
            text = list(base)
            for _ in range(rng.randrange(0, 1 + len(text) // 25)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            if rng.random() < 0.4:
                text = text[: int(len(text) * rng.uniform(0.75, 1))] + [rng.choice(vocabulary) for _ in range(rng.randrange(4))]
            rows.append((rng.randrange(1000, 10**9), " ".join(text)))
    rows += [(7, passage_text := " ".join(passage))] + [(10**10 + i, passage_text) for i in range(30)]
    rng.shuffle(rows)
    return rows


def variants(seed):
    """Texts around the limit of similarity to each other, with and without their common origin."""
    rng, rows = random.Random(seed), []
    for k, (n, edits) in enumerate([(50, 1), (40, 2), (50, 3)]):
        base = [f"{k}x{i}" for i in range(200)]
        for _ in range(n):
            text = list(base)
            for _ in range(rng.randrange(1, edits + 3)):
                text[rng.randrange(200)] = rng.choice(["new", f"n{rng.randrange(10**6)}"])
            rows.append((len(rows) * 7 % 1009, " ".join(text)))
    return rows


def test_against_brute_force(spark, monkeypatch):
    blocks = []
    monkeypatch.setattr(ngram_join_module, "in_blocks", lambda *a, **k: blocks.append(1) or in_blocks(*a, **k))
    for rows, options in (
        (corpus(1), {"sample_one_in": 1, "sample_least": 2, "hot_rows": 3}),  # classes and components of over 3 rows broadcast
        (corpus(3) + variants(4), {"region_limit": 600, "broadcast_rows": 0, "frequent_most": 0}),  # large regions: cut again, then by blocks
    ):
        docs = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, component_id string, n int")
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join(docs, **options).collect())
        assert got == brute(rows)
    assert blocks


def test_regions_against_all_pairs():
    rng = np.random.default_rng(8)
    for size, edits, percent in ((5, 3, 80), (60, 12, 80), (150, 20, 80), (100, 30, 60), (80, 2, 100)):
        base = rng.integers(0, 2**63, 120, dtype=np.uint64)
        sets = [np.unique(np.concatenate((base[: rng.integers(60, 120)][rng.integers(0, edits) :], rng.integers(0, 300, rng.integers(0, edits), dtype=np.uint64)))) for _ in range(size)]
        comp = np.where(rng.random(size) < 0.3, 0, np.arange(size))
        want, got = comp.copy(), comp.copy()
        for i in range(size):
            for j in range(i):
                common = len(np.intersect1d(sets[i], sets[j]))
                if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                    want[want == want[i]] = want[j]
        for i, j in spanning_links(comp, sets, percent):
            common = len(np.intersect1d(sets[i], sets[j]))
            assert got[i] != got[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common)
            got[got == got[i]] = got[j]
        assert len(set(zip(want, got, strict=True))) == len(set(want)) == len(set(got))


def linking(a, b, percent=80):
    return bool(a and b) and 100 * len(a & b) >= percent * len(a | b)


def test_all_links_are_counted(spark):
    """Also those that connect nothing more; copies are one set."""
    rows = corpus(5) + variants(6)
    sets = {i: frozenset(shingles(t)) for i, t in rows}
    every = set(sets.values())
    want = {s: sum(linking(s, other) for other in every if other != s) for s in every}
    assert max(want.values()) > 10
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for options in ({}, {"region_limit": 600, "broadcast_rows": 0}):  # components in a task, then in blocks
        got = {r.doc_id: r.n_links for r in ngram_join(docs, **options).collect()}
        assert got == {i: want[s] for i, s in sets.items()}


def test_counts_of_links_against_all_pairs():
    rng = np.random.default_rng(9)
    for size, edits, percent in ((1, 3, 80), (3, 4, 80), (60, 12, 80), (100, 30, 60), (40, 2, 100)):
        base = rng.integers(0, 2**63, 120, dtype=np.uint64)
        sets = [np.unique(np.concatenate((base[: rng.integers(60, 120)][rng.integers(0, edits) :], rng.integers(0, 300, rng.integers(0, edits), dtype=np.uint64)))) for _ in range(size)]
        block = rng.integers(0, 2, size)
        links = np.array([[i != j and linking(set(a.tolist()), set(b.tolist()), percent) for j, b in enumerate(sets)] for i, a in enumerate(sets)])
        assert link_counts(sets, percent).tolist() == links.sum(1).tolist()
        assert link_counts(sets, percent, block).tolist() == (links & (block[:, None] != block)).sum(1).tolist()


def test_null_and_repeated_ids_and_empty(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    docs = spark.createDataFrame([(1, a), (1, a), (1, b), (None, b), (None, None), (2, None), (2, None)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join(docs).collect()) == sorted(
        [("1", 3, "1"), ("1", 3, "1"), ("1", 2, "1"), ("None", 2, "1"), ("None", 0, "None"), ("2", 0, "2"), ("2", 0, "2")]
    )
    assert ngram_join(docs.limit(0)).count() == 0
    rows = [(3, a), (3, a), (4, a + " x"), (5, b), (6, None), (6, None), (None, b), (7, a), (3, b + " y z"), (8, a.upper())]
    some = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, root string")
    for limit in (100, 0):
        kept = keep_one_of_each(some, broadcast_rows=limit, hot_rows=1)
        assert kept.columns == some.columns
        assert sorted((r.doc_id, str(r.text)) for r in kept.collect()) == sorted([(3, a), (4, a + " x"), (5, b), (6, "None"), (6, "None"), (3, b + " y z")])


def test_near_copies_under_repeated_and_null_ids(spark):
    rows = []
    for i in range(24):
        text = " ".join(f"t{i}w{k}" for k in range(40))
        rows += [((None, 1, 2)[i % 3], text), ((1, None, 2, None)[i % 4], text + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (100, 0):
        got = ngram_join(docs, broadcast_rows=limit).collect()
        assert sorted((r.n_shingles, r.n_copies, r.n_links) for r in got) == [(36, 1, 1)] * 24 + [(37, 1, 1)] * 24
        assert keep_one_of_each(docs, broadcast_rows=limit).count() == 24


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 500 for i in range(500, 560)}
