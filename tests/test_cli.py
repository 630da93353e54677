import json

import pytest

from quarry import cli
from quarry.sources import directory

DECLARED = """
name = "shop"
snapshot_date = "2026-01-01"
[[tables]]
name = "Firm"
file = "firms.csv"
id = "id"
text = "Firm {id}: {title}"
display_name = "title"
edges = [{ column = "city", to = "City", relation = "located_in" }]
[[tables]]
name = "City"
file = "cities.csv"
id = "id"
text = "City {name}"
[[documents]]
glob = "*.*"
"""


@pytest.fixture
def folder(tmp_path):
    (tmp_path / directory.FILE).write_text(DECLARED)
    (tmp_path / "firms.csv").write_text("id,title,city\n1,Bittern Works,7\n2,Plover Holdings,\n3,Same Name,7\n4,Same Name,7\n")
    (tmp_path / "cities.csv").write_text("id,name\n7,Aachen\n")
    (tmp_path / "note.md").write_text("# Renewal\n\nThe zebra agreement renews yearly.\n")
    return str(tmp_path)


def test_ask(spark, folder, capsys, tmp_path):
    assert cli.main(["ask", folder, "What about Bittern Works?"], spark) == 0
    assert capsys.readouterr().out == "City Aachen\n  ↳ cities.csv (row 1)\nFirm 1: Bittern Works\n  ↳ firms.csv (row 1)\n"
    assert cli.main(["ask", folder, "zebra agreement"], spark) == 0
    assert "The zebra agreement renews yearly." in capsys.readouterr().out
    assert cli.main(["ask", folder, "xylophone"], spark) == 1
    assert cli.main(["ingest", folder, str(tmp_path / "out")], spark) == 0
    assert spark.read.parquet(str(tmp_path / "out/records")).count() == 6 and spark.read.parquet(str(tmp_path / "out/edges")).count() == 3
    assert cli.main(["nonsense"], spark) == 2


@pytest.mark.parametrize("bad", ["x = [", "name = 'x'", DECLARED.replace("firms.csv", "../firms.csv"), DECLARED.replace('glob = "*.*"', 'glob = "/etc/*"'), DECLARED.replace('glob = "*.*"', ""), DECLARED.replace('id = "id"', "id = 3", 1)])
def test_bad_declarations(bad):
    with pytest.raises(directory.DeclarationError):
        directory.parse(bad)


def test_bundles(spark, tmp_path, capsys):
    plain, sealed = tmp_path / "plain.json", tmp_path / "sealed.json"
    plain.write_text(json.dumps({"engine": "1.0", "leaves": {"b": {"y": 1.5, "x": "é"}, "a": [1]}, "claims": [{"recorded": True, "rederived": True}]}))
    assert cli.main(["seal", str(plain)], spark) == 0
    sealed.write_text(capsys.readouterr().out)
    assert cli.main(["verify", str(sealed)], spark) == 0
    for old, new, code in (('"y":1.5', '"y":1.50', 4), ('"rederived":true', '"rederived":false', 2), ('"engine":"1.0"', '"engine":"9"', 3), ('"a":[1]', '"a":{"redacted":true}', 3), ("{", "[", 4)):
        sealed.with_suffix(".bent").write_text(sealed.read_text().replace(old, new, 1))
        assert cli.main(["verify", str(sealed.with_suffix(".bent"))], spark) == code, old


def test_ledger_and_proof(spark, tmp_path, capsys):
    path = tmp_path / "log.txt"
    path.write_text("a\nb\nc\nd\ne\n")
    assert cli.main(["ledger", "head", str(path)], spark) == 0
    head = capsys.readouterr().out.strip()
    assert cli.main(["ledger", "prove", str(path), "2"], spark) == 0
    found = json.loads(capsys.readouterr().out)
    from quarry.operators import integrity

    assert found["head"] == head and integrity.check_inclusion(b"c", [tuple(x) for x in found["path"]], head)
    assert cli.main(["ledger", "check", str(path), "3"], spark) == 0 and cli.main(["ledger", "check", str(path), "9"], spark) == 1
    assert cli.main(["proof"], spark) == 0 and capsys.readouterr().out.splitlines()[-1] == "PROVED"
