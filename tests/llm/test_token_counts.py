import random

import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from seqloom.llm import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def texts():
    rng = random.Random(1)
    pool = list("ab c'sd\n\t 1é́​　\x1f\x85|<>_-.ßΣ漢🙂 ")
    fixed = ["", "a", "<|endoftext|>x <|endoftext|>", "héllo  wörld\n\n x", "   a", "\x1c\x1d b", "don't I'll  ", "a\r\n\tb   ", "�", "x' s", "123 4567٣٤", "a<|endoftext|", " ", "word " * 20_000, "y" * 5000]
    return fixed + ["".join(rng.choices(pool, k=rng.randrange(60))) for _ in range(1500)]


def test_counts_equal_the_library(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_ENTRIES", 50)
    own = texts()
    want = [len(e.ids) for e in Tokenizer.from_file(PATH).encode_batch(own, add_special_tokens=False)]
    monkeypatch.setattr(token_counts, "SLICE_BYTES", 3000)
    counter = token_counts.TokenCounter(PATH)
    assert counter.count(own) == want
    for _ in range(2):
        assert counter.count_column(pa.array(own)).tolist() == want
    assert counter.count_column(pa.array(["x", *own, "y"]).slice(1, len(own))).tolist() == want
    assert counter.count_column(pa.array([None, ""], pa.string())).tolist() == [0, 0] and counter.count_column(pa.array([], pa.string())).tolist() == []


def test_words_with_inner_breaks_equal_the_library():
    rng = random.Random(3)
    words = ["foo", "bar's", "x\ny", "é.", "12", "don't", "a\tb", "\n", "漢字", "end\n", "\nstart", "a\u3000b", "\x1c", "🙂"]
    own = [rng.choice([" ", "", "\n"]).join(rng.choices(words, k=rng.randrange(1, 9))) for _ in range(3000)]
    want = [len(e.ids) for e in Tokenizer.from_file(PATH).encode_batch(own, add_special_tokens=False)]
    assert token_counts.TokenCounter(PATH).count_column(pa.array(own)).tolist() == want


def test_proved_strings_are_one_token_alone():
    whole = sorted(token_counts.TokenCounter(PATH).prove_whole())
    assert len(whole) > 30_000
    library = Tokenizer.from_file(PATH)
    assert all(len(e.ids) == 1 for e in library.encode_batch(random.Random(2).sample(whole, 2000), add_special_tokens=False))


def test_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "é", 5), (None, "a b", 5), (2, "é", 5), (3, "hello " * 600, 5)], "doc_id long, text string, n_tokens int").repartition(2)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(df, lambda: PATH).collect())
    assert got == [("1", 0, 0, False), ("2", 2, 1, False), ("2", 2, 1, False), ("3", 3600, 601, True), ("None", 3, 2, False)]
    assert token_counts.count_tokens(df.limit(0), lambda: PATH).collect() == []
