from pathlib import Path

import duckdb
import pytest

from . import plain

SF = "/root/testdata/sf0.001"
P = pytest.importorskip("public_tokenizers")


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables")
def test_pipeline(spark):
    import corpus_pipeline

    from .test_operators import library

    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "n-gram Jaccard join", "mixing sources", "byte-level BPE"]
    rows = duckdb.sql(f"SELECT doc_id, text, source FROM read_parquet('{SF}/documents.parquet')").fetchall()
    rows = [r for r in rows if plain.quality(r[1])[-1]]
    kept = {d for d, _, _, stays, _ in plain.exact([r[:2] for r in rows]) if stays}
    rows = [r for r in rows if r[0] in kept]
    kept = {d for d, _, c in plain.near([r[:2] for r in rows], 5, 80) if d == c}
    rows = [r for r in rows if r[0] in kept]
    taken = {d: -(-t // n) if n else 0 for d, n, _, _, t in plain.mix(rows)}
    codes = library()
    want = []
    for d, text, _ in rows:
        ids = codes.encode_ordinary(text or "")
        want += [(d, len(ids), plain.sha(" ".join(map(str, ids))), plain.sha(text or ""))] * taken[d]
    out = corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, out)) == sorted(want)
