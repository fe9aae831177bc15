from hazeloom.llm.mixing import RING, STEP, mix_sources, mixed_documents, slot_schedule, source_targets, words_taken


def fill(sizes, weights, most):
    """Targets by resharing until none is above."""
    total, target, capped = sum(sizes.values()), {}, {}
    while True:
        left = {s: w for s, w in weights.items() if s not in capped}
        rest = total - sum(capped.values())
        target = {s: rest * w / sum(left.values()) for s, w in left.items()}
        over = [s for s in left if target[s] > most * sizes[s]]
        if not over:
            return target | capped
        capped |= {s: most * sizes[s] for s in over}


def test_targets_and_taken(spark):
    rows = [(i, "w " * ((i * 7) % 90), ["b", "a", None, "z", "hot", "hot", "hot"][i % 7]) for i in range(700)]
    rows += [(5000, None, "a"), (5001, "", "empty"), (5002, "x", "tiny"), (5003, "y " * 5000, "z"), (1, "w " * 7, "a"), (1, "w " * 7, "a"), (None, "q r", None)]
    docs = spark.createDataFrame([(*r, 1, "e") for r in rows], "doc_id long, text string, source string, size int, target string")
    sized, sources, parts = mix_sources(docs, block_words=16)
    got = words_taken(sized, sources, parts).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    names = sorted((s for s in sizes if s is not None)) + [None]
    want = fill(sizes, {s: i % 3 + 1 for i, s in enumerate(names)}, 3)
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = words_taken(*mix_sources(docs.repartition(5), block_words=16)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_schedule_interleaves_sources(spark):
    sized = spark.createDataFrame([("a", 60_000), ("b", 60_000), ("c", 60_000)], "source string, size long")
    slots = slot_schedule(source_targets(sized), block_words=10, chunk=100).orderBy("slot").collect()
    assert sum(r.words for r in slots) == 180_000
    for at in range(0, len(slots) - 600, 600):  # any stretch has about a sixth, a third and a half
        n = sum(r.source == "c" for r in slots[at : at + 600])
        assert abs(n - 300) < 12


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert words_taken(*mix_sources(docs)).count() == 0
    docs = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    assert {(r.doc_id, r.taken, r.target) for r in words_taken(*mix_sources(docs)).collect()} == {(1, 0, 0.0), (2, 0, 0.0)}


def test_mixed_documents(spark):
    rows = [(i, "w " * 10, "a", "x") for i in range(30)] + [(i, "w " * 10, "b", "y") for i in range(100, 130)] + [(1, None, "a", "z"), (200, "w", None, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, t_id string")
    got = mixed_documents(docs, block_words=10)
    assert got.columns == docs.columns
    n = {s: sum(r.source == s for r in got.collect()) for s in ("a", "b", None)}
    assert n[None] == 3 and 18 <= n["a"] <= 21 and 38 <= n["b"] <= 41
    assert mixed_documents(docs.limit(0)).count() == 0


def test_schedule_slot_by_slot(spark):
    """Points of the golden ratio, arcs, ranks and blocks dealt one by one in plain lines."""
    sizes, targets = {"a": 700, "b": 90, None: 400}, {"a": 500.0, "b": 270.0, None: 420.0}
    sources = spark.createDataFrame([(s, sizes[s], targets[s]) for s in sizes], "source string, source_size long, target double")
    got = sorted((tuple(r) for r in slot_schedule(sources, block_words=16).select("slot", "source", "epoch", "block", "words").collect()), key=str)
    names = sorted(s for s in sizes if s) + [None]
    ends, total = {}, 0.0
    goal = {s: int(g) for s, g in targets.items()}
    blocks = {s: -(-sizes[s] // 16) for s in names}
    need = {s: goal[s] // sizes[s] * blocks[s] + -(-(goal[s] % sizes[s]) // 16) for s in names}
    for s in names:
        low = total
        total += targets[s]
        ends[s] = (int(low / sum(targets.values()) * RING), int(total / sum(targets.values()) * RING))
    slots, ranks, want = sum(need.values()), dict.fromkeys(names, 0), []

    def deal(slot, s):
        k, ranks[s] = ranks[s], ranks[s] + 1
        if k < need[s]:
            epoch, block = divmod(k, blocks[s])
            want.append((slot, s, epoch, block, min(16, sizes[s] - block * 16, goal[s] - epoch * sizes[s] - block * 16)))

    for slot in range(slots):
        point = slot * STEP % RING
        deal(slot, next(s for s in names if ends[s][0] <= point < ends[s][1]))
    for s in names:
        while ranks[s] < need[s]:
            deal(slots, s)
    assert got == sorted(want, key=str)


def test_equal_rows_and_many_sources(spark):
    rows = [(None, "w " * 7, "hot")] * 900 + [(i, "w " * (i % 20), f"s{i % 400}") for i in range(1600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    options = {"block_words": 16, "buckets": 64, "copies_together": 10}
    got = words_taken(*mix_sources(docs, **options)).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in got)
    taken = {}
    for r in got:
        taken.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert len(taken) == 401 and all(abs(a - b) <= 1 for a, b in taken.values())
    again = words_taken(*mix_sources(docs.repartition(7), **options)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
