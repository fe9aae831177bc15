import base64
import random
import time

import public_tokenizers
import pytest
import sentencepiece

from hazeloom.llm.packing import WordIds
from hazeloom.llm.tokens import PieceMerger, TokenCounter, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def texts(n=400):
    rng = random.Random(5)
    alphabet = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "\r\n", "é", "漢字", "ﬁ", "▁", "　", "\xa0", "<s>", "</s>", "<0x0A>", "<unk>", "😀", "tion", "1", "2024", "--", "==", "é", "\x00"]
    out = ["", " ", "\n", "a", " a", "a ", "aaaa" * 300, "ab" * 2000, "the quick brown fox\n\njumps", "x" * 5000, "-=" * 999, "▁▁a", "a ▁b", "the" * 900]
    return out + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 120))) for _ in range(n)]


def test_every_text_as_the_library(library):
    counter = TokenCounter(MODEL)
    for t in texts():
        assert counter.count_all([t.encode()]) == [len(library.encode(t))], repr(t)
    assert counter.count_all([t.encode() for t in texts()]) == [len(library.encode(t)) for t in texts()]


def test_words_in_one_batch_as_one_by_one():
    merger = PieceMerger(MODEL)
    words = [t.replace(" ", "▁")[:200] for t in texts(50) if t]
    assert merger.counts(words).tolist() == [merger.counts([w])[0] for w in words]


def test_table(spark, library):
    rows = [(i, t, 0) for i, t in enumerate(texts(60))] * 2 + [(None, None, 1), (7, "long " * 5000, 1)]
    rows = [r for r in rows if r[1] is None or "\x00" not in r[1]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(map(str, token_counts(docs, MODEL).collect()))
    want = [(i, len((t or "").encode()), len(library.encode(t or ""))) for i, t, _ in rows]
    from pyspark.sql import Row

    assert got == sorted(str(Row(doc_id=i, n_bytes=b, n_tokens=n, over_limit=n > 4096)) for i, b, n in want)
    assert token_counts(docs.limit(0), MODEL).count() == 0


def long_texts():
    rng = random.Random(9)
    raw = rng.randbytes(400_000)
    return {
        "hex": raw.hex(),
        "base64": base64.b64encode(raw).decode(),
        "one word again": "the" * 200_000,
        "letters": "".join(rng.choice("etaoinshr") for _ in range(400_000)),
        "script": "".join(chr(rng.choice([rng.randrange(0x4E00, 0x9FA5), rng.randrange(0x3041, 0x3097)])) for _ in range(200_000)),
        "one letter": "a" * 500_000,
        "signs": "-=" * 200_000 + "\u2581" * 1000,
    }


@pytest.mark.parametrize("name", sorted(long_texts()))
def test_long_texts_without_blanks(library, name):
    text = long_texts()[name]
    began = time.time()
    got = TokenCounter(MODEL).count_all([text.encode()])
    assert time.time() - began < 15
    assert got == [len(library.encode(text))]
    began = time.time()
    coder = WordIds(public_tokenizers.path("word_bpe_49k.json"))
    ids = coder.ids(text.encode())
    assert time.time() - began < 15 and len(ids) // 4 == len(coder.tokenizer.encode(text, add_special_tokens=False).ids)


def test_heap_and_rounds_agree():
    merger, rng = PieceMerger(MODEL), random.Random(2)
    words = ["".join(rng.choice(["t", "th", "he", "in", "\u2581", "1", "é", "漢", "s", "tion"]) for _ in range(rng.randrange(2, 90))) for _ in range(300)]
    assert merger.merged_together(words).tolist() == [merger.merged_by_heap(w) for w in words] == [sum(map(merger.merged_by_heap, merger.cut(w))) for w in words]
