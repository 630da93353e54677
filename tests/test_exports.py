import pytest
from pyspark.sql import functions as F

from quarry.functions import signatures
from quarry.operators import triples

# RFC 8032, section 7.1, tests 1 and 2 (fixed values).
VECTORS = [
    ("d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "", "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
    ("3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72", "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
]


def test_signatures(spark):
    rows = [(k, m, s) for k, m, s in VECTORS] + [(VECTORS[0][0], "01", VECTORS[0][2]), ("00", "", VECTORS[0][2])]
    df = spark.createDataFrame(rows, "k string, m string, s string").select(signatures.signed(F.unhex("k"), F.unhex("m"), F.unhex("s")).alias("ok"))
    assert [r["ok"] for r in df.collect()] == [True, True, False, False]


def test_triples(spark):
    nodes = spark.createDataFrame([("a b*~", "city", None, 'quote " back \\n slash\nline\t   end \x01 \ue000 \\u0041 \\\\t', "f")], "id string, kind string, name string, text string, source string")
    edges = spark.createDataFrame([("a b*~", "c", "in")], "src string, dst string, relation string")
    out = triples.graph_triples(nodes, edges, "urn:q:")
    lines = triples.to_lines(out)
    assert all("\n" not in r["value"] and " " not in r["value"] for r in lines.collect())
    assert out.first()["s"] == "urn:q:node/a%20b%2A~"
    assert sorted(map(tuple, triples.from_lines(lines).collect())) == sorted(map(tuple, out.collect()))
    with pytest.raises(ValueError):
        triples.graph_triples(nodes, edges.union(edges), "urn:q:")
