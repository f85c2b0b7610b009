import hashlib
import zlib

from tidemark.llm import media


def test_round_trip_and_ties(spark):
    texts = [(1, "hé" * 500), (2, None), (3, ""), (4, "hé" * 500), (None, "x" * 576), (1, "hé" * 500), (7, "ab " * 40000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "'z' AS media", "1 AS prints")
    rows = media.media_columns(docs).collect()
    assert len(rows) == len(texts)
    for r, (k, t) in zip(rows, texts, strict=True):
        raw = (t or "").encode()
        pad = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (r.doc_id, r.n_bytes, r.payload_bytes) == (k, len(raw), len(pad))
        assert media.from_wav(bytes(r.media)) == pad
        assert r.payload_sha256 == hashlib.sha256(pad).hexdigest() and r.tail_crc32 == zlib.crc32(pad[-32:])
        assert r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest() and r.media_bytes == len(r.media)
    assert rows[0].prints == rows[3].prints == rows[5].prints
    assert media.media_columns(docs.limit(0)).count() == 0


def test_peak_of_a_tone(spark):
    import numpy as np

    t = np.arange(576 * 6)
    (found,) = media.fingerprints([(128 + 100 * np.sin(2 * np.pi * 20 * t / 576)).astype(np.uint8)])
    assert found and all(p[2] == p[3] == 20 for p in found if p[1] == 0)
