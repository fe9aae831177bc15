import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from hazeloom.llm.packing import WordIds, best_fit, pack

PATH = public_tokenizers.path("word_bpe_49k.json")


def naive(lengths, capacity):
    left, out = [], []
    for n in lengths:
        fits = [r for r in left if r >= n]
        if fits:
            left[left.index(min(fits))] -= n
        else:
            left.append(capacity - n)
        out.append(sorted(left))
    return out[-1] if out else []


def test_best_fit_against_naive_search():
    rng = random.Random(2)
    for capacity in (1, 2, 7, 100, 2048):
        lengths = sorted((rng.randrange(1, capacity + 1) for _ in range(500)), reverse=True)
        for order in (lengths, lengths[::-1]):
            bins, offsets = best_fit(order, capacity)
            used = {}
            for b, o, n in zip(bins, offsets, order, strict=True):
                assert o == used.get(b, 0)
                used[b] = o + n
            assert sorted(capacity - u for u in used.values()) == naive(order, capacity)
    assert best_fit([], 5) == ([], [])


def test_ids_as_the_library():
    library, own, rng = Tokenizer.from_file(PATH), WordIds(PATH), random.Random(4)
    bits = ["The", "it's", " ", "\n", "\t", "\x1c", "\x85", "\xa0", "É", "é", "́", "ß", "Σ", "ΑΣ", "<|endoftext|>", "<|startoftext|>", "<|", "12", "漢", "😀", "!!", "　", "İ", "x" * 50]
    for _ in range(500):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(40)))
        assert np.frombuffer(own.ids(t.encode()), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_pack_round_trip(spark):
    library, rng = Tokenizer.from_file(PATH), random.Random(9)
    rows = [(i, " ".join(rng.choice(["thee", "a", "nd", "Xq"]) for _ in range(rng.randrange(300))), 1) for i in range(300)]
    rows += [(1000, None, 1), (1001, "", 1), (1002, "word " * 9000, 1), (1003, "word " * 2047, 1), (1004, "word " * 2048, 1), (5, rows[5][1], 1), (None, "null id", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = pack(docs, PATH, shard_pieces=120).collect()
    whole, places = {}, {}
    for r in got:
        assert r.length == len(r.ids) // 4 <= 2048 and r.ids_crc32 == zlib.crc32(bytes(r.ids))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        whole.setdefault(r.doc_id, {}).setdefault(r.piece, set()).add((r.start, bytes(r.ids)))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    for i, t, _ in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        assert whole[i] == {k: {(k * 2048, ids[k * 8192 : (k + 1) * 8192])} for k in range(-(-len(ids) // 8192))}
    total = sum(r.length for r in got)
    assert len(places) <= total / 2048 * 1.02 + 4
    assert sorted(map(str, got)) == sorted(map(str, pack(docs.repartition(3), PATH, shard_pieces=120).collect()))
    assert pack(docs.limit(0), PATH).count() == 0


def test_every_plain_character_as_the_library():
    library, own = Tokenizer.from_file(PATH), WordIds(PATH)
    plain = [chr(c) for c in (*range(33, 127), *range(0xC0, 0x100)) if c not in (0xD7, 0xF7)]
    rng = random.Random(6)
    for t in plain + ["".join(rng.choice(plain) for _ in range(rng.randrange(1, 12))) for _ in range(6000)] + ["don'tell", "'S'LL", "<|ENDOFTEXT|>", "x<|endoftext|>'s"]:
        assert np.frombuffer(own.ids(t.encode()), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_equal_rows_are_dealt_to_many_shards(spark):
    rows = [(7, "same text in a third of the rows")] * 1500 + [(None, "thee")] * 300 + [(i, "a nd " * (i % 50)) for i in range(2500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = pack(docs, PATH, shard_pieces=100).collect()
    shards = {}
    for r in got:
        shards[r.sequence_id >> 32] = shards.get(r.sequence_id >> 32, 0) + 1
    assert len(got) == len(rows) and len(shards) == 43 and max(shards.values()) < 300
    assert sorted(map(str, got)) == sorted(map(str, pack(docs.repartition(2), PATH, shard_pieces=100).collect()))
