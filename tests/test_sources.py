import csv
import json

import pytest
from pyspark.sql import functions as F

from quarry.operators import sinks, triples
from quarry.sources import datasets
from quarry.sources.remote import PER_PAGE, RemotePages


def write(path, rows):
    with open(path, "w", newline="") as f:
        w = csv.DictWriter(f, list(rows[0]))
        w.writeheader()
        w.writerows(rows)


def erp_slice(tmp_path):
    write(tmp_path / "addresses.csv", [{"ADDRESSID": "1", "COUNTRY": "DE", "REGION": "NW"}, {"ADDRESSID": "2", "COUNTRY": "", "REGION": ""}])
    write(tmp_path / "customers.csv", [{"CUSTOMER": "7", "ADDRESSID": "1"}, {"CUSTOMER": "8\x1b[0m", "ADDRESSID": " "}])
    write(tmp_path / "sales_docs.csv", [{"SALESDOCUMENT": "9", "TRANSACTIONCURRENCY": "EUR", "SALESDOCUMENTTYPE": "T", "INCOTERMSCLASSIFICATION": "I", "CREATIONDATE": "2020-01-01"}])
    write(tmp_path / "sales_items.csv", [{"SALESDOCUMENT": "9", "SALESDOCUMENTITEM": "10", "SOLDTOPARTY": "7", "PRODUCT": "p"}])
    return str(tmp_path)


def test_erp_slice(spark, tmp_path):
    nodes, edges = datasets.keyed(spark, erp_slice(tmp_path), datasets.ERP_SLICE, "erp", "2026-01-01")
    text = {r["id"]: r["text"] for r in nodes.collect()}
    assert text["Address:1"] == "Address 1: country DE, region NW." and text["Address:2"] == "Address 2: country unknown."
    assert text["Customer:8"] == "Customer 8 (address )." and text["SalesItem:9/10"] == "Sales document 9 item 10: product p, sold to 7."
    assert sorted(map(tuple, edges.collect())) == [("Customer:7", "Address:1", "located_at"), ("SalesItem:9/10", "Customer:7", "sold_to"), ("SalesItem:9/10", "SalesDoc:9", "line_of")]
    assert nodes.filter("id = 'SalesDoc:9'").first()["source"] == "erp/sales_docs.csv"
    write(tmp_path / "customers.csv", [{"CUSTOMER": "7"}])
    with pytest.raises(ValueError, match="ADDRESSID"):
        datasets.keyed(spark, str(tmp_path), datasets.ERP_SLICE, "erp", "x")
    write(tmp_path / "customers.csv", [{"CUSTOMER": "7", "ADDRESSID": "1"}] * 2)
    with pytest.raises(ValueError, match="more than once"):
        datasets.keyed(spark, str(tmp_path), datasets.ERP_SLICE, "erp", "x")


def test_erp_tables(spark, tmp_path):
    write(tmp_path / "I_Customer.csv", [{"Customer": "1", "CustomerName": "Bittern", "CustomerAccountGroup": "G", "Country": "DE", "AddressID": "5"}])
    write(tmp_path / "I_AddrOrgNamePostalAddress.csv", [{"AddressID": "5", "OrganizationName": "Bittern", "StreetName": "S", "HouseNumber": "1", "PostalCode": "52062", "CityName": "Aachen", "Country": "DE"}])
    write(tmp_path / "I_SalesDocument.csv", [{"SalesDocument": "3", "SoldToParty": "1", "TotalNetAmount": "1234.5", "TransactionCurrency": "EUR", "SalesDocumentDate": "2020-01-01"}])
    write(tmp_path / "I_SalesDocumentItem.csv", [{"SalesDocument": "3", "SalesDocumentItem": "10", "SalesDocumentItemText": "bolt", "Material": "M", "OrderQuantity": "2", "NetAmount": "1234.5", "TransactionCurrency": "EUR"}])
    nodes, edges = datasets.keyed(spark, str(tmp_path), datasets.ERP, "erp", "x")
    got = {r["id"]: r for r in nodes.collect()}
    assert got["I_SalesDocument:3"]["text"] == "Sales document 3: sold-to party 1, net value EUR 1,234.50, dated 2020-01-01."
    assert got["I_SalesDocumentItem:3-10"]["text"] == "Item 10 of sales document 3: bolt (material M), quantity 2, net EUR 1,234.50."
    assert got["I_Customer:1"]["name"] == "Bittern" and got["I_AddrOrgNamePostalAddress:5"]["attributes"]["CityName"] == "Aachen"
    assert sorted(r["relation"] for r in edges.collect()) == ["has_address", "line_of", "sold_to"]


def test_documents_with_manifest(spark, tmp_path):
    (tmp_path / "b.md").write_text("# Head\n\nOne\n\nTwo\n")
    (tmp_path / "c.md").write_text("not listed")
    (tmp_path / "MANIFEST.json").write_text(json.dumps({"snapshot_date": "2026-01-02", "documents": ["b.md"]}))
    rows = datasets.documents(spark, str(tmp_path), "docs").orderBy("id").collect()
    assert [(r["id"], r["source"], r["locator"], r["ingested_at"], r["text"]) for r in rows] == [("b:chunk1", "docs/b.md", "lines 1-3, paragraph 1", "2026-01-02", "# Head\n\nOne"), ("b:chunk2", "docs/b.md", "lines 5-5, paragraph 2", "2026-01-02", "Two")]


def test_invented_firms_do_not_depend_on_partitions(spark):
    a = sorted(map(tuple, datasets.invented_firms(spark, 50).collect()))
    assert a == sorted(map(tuple, datasets.invented_firms(spark, 50).repartition(3).collect())) and len({r[1] for r in a}) == 50


def test_firms_are_resolved_and_ranked(spark):
    from quarry.plans import evidence

    out = evidence.ranked_firms(spark, "").collect()
    assert len(out) == 2 and {(r["clusters"], r["largest"]) for r in out} == {(146, 2)}  # two short names with GmbH and AG stay below the ratio


def fetch(target, page, per_page):
    return [json.dumps({"n": k, "of": target}) for k in range((page - 1) * per_page, min(page * per_page, 250))]


def test_remote_pages(spark):
    spark.dataSource.register(RemotePages)
    read = lambda cap: spark.read.format("remote_pages").option("transport", "tests.test_sources:fetch").option("target", "x").option("cap", cap).load().collect()
    rows = read(300)
    assert sum(r["value"] is not None for r in rows) == 250 and not any(r["miss"] for r in rows)
    rows = read(PER_PAGE + 20)
    assert sum(r["value"] is not None for r in rows) == 120 and sum(r["miss"] is not None for r in rows) == 1


def test_snapshot_is_swapped_in(spark, tmp_path):
    path = str(tmp_path / "snap")
    df = spark.createDataFrame([(1, "password=abcdefgh1"), (2, None)], "id int, text string")
    assert sinks.write_snapshot(df, path) == {"sensitive-assignment": 1}
    assert sinks.write_snapshot(df.filter("id = 1"), path) == {"sensitive-assignment": 1}
    assert [r["text"] for r in spark.read.parquet(path).collect()] == ["password=***SCRUBBED***"] and len(list(tmp_path.iterdir())) == 1


class Link:
    def __init__(self, folder):
        self.folder = folder

    def update(self, text):
        import uuid

        (self.folder / uuid.uuid4().hex).write_text(text)


def test_batched_inserts(spark, tmp_path):
    nodes = spark.createDataFrame([(f"n{i}", "k", None, "t", "s", {"b": "2", "a": "1"}) for i in range(7)], "id string, kind string, name string, text string, source string, attributes map<string,string>")
    lines = triples.to_lines(triples.graph_triples(nodes, spark.createDataFrame([], "src string, dst string, relation string"), "urn:q:"))
    sinks.insert_lines(lines.coalesce(1), "urn:g", lambda: Link(tmp_path), 10)
    texts = [p.read_text() for p in tmp_path.iterdir()]
    assert sorted(t.split()[0] for t in texts) == ["DROP", "INSERT", "INSERT", "INSERT"] and sum(t.count("urn:q:prop/attributes") for t in texts) == 7
    said = spark.createDataFrame([(0, "c1", "n1", 0.9, "named")], "i long, chunk string, node string, confidence double, reason string")
    assert triples.mention_triples(said, "urn:q:").count() == 4


def test_journal(spark, tmp_path):
    path = str(tmp_path / "journal")
    scores = spark.createDataFrame([(1.0,), (0.95,)], "faithfulness double")
    sinks.append_journal(scores, path, "2026-01-01", "gold")
    sinks.append_journal(scores.filter("faithfulness = 1"), path, "2026-01-02", "gold")
    assert [tuple(r) for r in sinks.badge(spark.read.json(path)).collect()] == [("gold", 1.0, "green")]
