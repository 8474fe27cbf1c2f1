import random
import zlib
from array import array
from collections import defaultdict

import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from seqloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def library(texts):
    t = Tokenizer.from_file(PATH)
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_word_ids_equal_the_library():
    rng = random.Random(1)
    pool = list("ab c'sd\n\t 1é́　​\x1f\x85|<>_-.ßΣ漢🙂İ")
    texts = ["", "<|endoftext|>x <|endoftext|>", "x\x85y᠎z", "ΑΣ ΑΣ."] + ["".join(rng.choices(pool, k=rng.randrange(60))) for _ in range(2000)]
    words = packing.WordIds(PATH)
    for column in (pa.array(texts), pa.array(["other", *texts, "more"]).slice(1, len(texts))):
        ids, starts = words.ids(column)
        assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == library(texts)
    ids, starts = words.ids(pa.array([None, ""], pa.string()))
    assert len(ids) == 0 and starts.tolist() == [0, 0, 0]


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(4)
    lengths = sorted((rng.randint(1, 64) for _ in range(500)), reverse=True)
    room, want = [], []
    for n in lengths:  # the same rule by linear search
        fits = [r for r in room if r >= n]
        if fits:
            r = min(fits)
            room.remove(r)
        else:
            r = 64
        want.append(r)
        if r > n:
            room.append(r - n)
    assert [64 - o for _, o in packing.best_fit(lengths, 64)] == want


def test_pieces_cover_each_document_once_and_sequences_have_no_gaps(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 50)
    monkeypatch.setattr(packing, "SLICE_BYTES", 5000)
    monkeypatch.setattr(packing, "CACHE_ENTRIES", 3)
    rng = random.Random(6)
    texts = [None, "", "word", "a b " * 3000] + [" ".join(rng.choices(["alpha", "beta", "x1"], k=rng.randrange(1500))) for _ in range(150)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, offset int").repartition(4)
    packed = packing.pack(docs, lambda: PATH)
    rows = packed.collect()
    ids = {i: [*own, 1] for i, own in enumerate(library([t or "" for t in texts]))}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(array("I", own).tobytes()) and r.doc_tokens == len(ids[r.doc_id]) and len(own) == r.length > 0
        by_doc[r.doc_id].append((r.start, r.length))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert by_doc.keys() == ids.keys()
    for parts, total in ((v, len(ids[k])) for k, v in by_doc.items()):
        assert sum(n for _, n in parts) == total and all(a + n == b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:]))
    for parts in by_sequence.values():
        ends = 0
        for offset, n in sorted(parts):
            assert offset == ends
            ends += n
        assert ends <= 2048
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed, docs, lambda: PATH).collect()}
    for r in rows:
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == ids[r.doc_id][r.start : r.start + r.length]


def test_repeats_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "same words")] * 3 + [(None, "x")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in packing.pack(docs, lambda: PATH).collect()) == ["1", "1", "1", "None"]
    assert packing.pack(docs.limit(0), lambda: PATH).collect() == []
