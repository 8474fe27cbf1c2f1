import hashlib
import io
import random

import zstandard

from seqloom.llm import warc


def brute(rows):
    """The contract's result; of equal rows it doesn't matter which is the response."""
    first, out = {}, []
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    for k in order:
        page, _, html = rows[k]
        payload = (html or "").encode()
        shared = len(payload) >= 100
        if shared and payload in first:
            out.append((page, len(payload), hashlib.sha256(payload).hexdigest(), "revisit", first[payload]))
        else:
            if shared:
                first[payload] = page
            out.append((page, len(payload), hashlib.sha256(payload).hexdigest(), "response", None))
    return sorted(map(str, out))


def pages():
    rng = random.Random(3)
    bodies = ["x" * 99, "é" * 50, "y" * 100, "", None, "\r\n\r\nWARC/1.1\r\n" * 20, "z" * 300_000] + ["".join(rng.choices("ab \r\n<>é", k=rng.randrange(60, 900))) for _ in range(20)]
    rows = [(i * 3 % 101, rng.choice(["http://a.example/x y\r\nz", None, ""]), rng.choice(bodies)) for i in range(101)]
    return rows + rows[:4] + [(None, None, bodies[2]), (None, None, bodies[2])]


def test_round_trip_equals_brute_force(spark, tmp_path):
    rows = pages()
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    got = warc.archive(df).collect()
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) == brute(rows)


def test_bundles_are_seekable_and_plain_zstandard(spark, tmp_path):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    bundles = warc.write(df, str(tmp_path / "bundles"), frame_bytes=2000, bundle_bytes=3000)
    found = bundles.collect()
    assert len(found) > 2 and len({r.bundle for r in found}) == len(found)
    n = 0
    for r in found:
        content = bytes(r.content)
        bundle = warc.Bundle(content)
        stream = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content), read_across_frames=True).read()
        assert stream == b"".join(bundle.frames())
        for name in bundle.index():
            own = bundle.fetch(name)
            assert own.startswith(b"WARC/1.1\r\n") and f"WARC-Record-ID: {name}".encode() in own and own.endswith(b"\r\n\r\n")
            n += 1
    assert n == len(rows)
    sizes = {r.bundle: r.bytes for r in warc.export(bundles, str(tmp_path / "files")).collect()}
    for r in found:
        assert (tmp_path / "files" / f"{r.bundle}.warc.zst").read_bytes() == bytes(r.content) and sizes[r.bundle] == len(r.content)


def test_empty_table(spark):
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
