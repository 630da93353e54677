"""Queries over the driver's tables: each applies a Quarry operator to whole tables; SQL states what it must return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import evaluation, graph, integrity, resolution, retrieval, temporal, totals
from ..sources import chunking, readers


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """order -> customer -> nation -> region as one edge table."""
    parts = [
        graph.key_edges(_t(spark, d, "orders"), "order", "o_orderkey", "customer", "o_custkey", "sold_to"),
        graph.key_edges(_t(spark, d, "customer"), "customer", "c_custkey", "nation", "c_nationkey", "located_in"),
        graph.key_edges(_t(spark, d, "nation"), "nation", "n_nationkey", "region", "n_regionkey", "part_of"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_EDGES = """
    SELECT 'order:' || o_orderkey AS src, 'customer:' || o_custkey AS dst, 'sold_to' AS relation FROM orders
    UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'located_in' FROM customer
    UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'part_of' FROM nation"""


def _totals(spark: SparkSession, d: str) -> DataFrame:
    return totals.subtotals(_t(spark, d, "orders"), "o_custkey", "o_orderpriority", "o_totalprice")


_TOTALS = """
    SELECT *, count(*) OVER (PARTITION BY entity) AS currencies FROM (
        SELECT o_custkey AS entity, coalesce(o_orderpriority, '?') AS currency, sum(o_totalprice::DECIMAL(38,2)) AS total, count(*) AS n FROM orders GROUP BY ALL)"""


def edge_table(spark, d):
    """Foreign keys as one edge table."""
    return _edges(spark, d)


def denormalised(spark, d):
    """Nation joined to the customer; the balance carries over only where the customer is its nation's only one in a segment."""
    c = totals.guarded(_t(spark, d, "customer"), ["c_nationkey", "c_mktsegment"], "c_acctbal", "balance")
    n = _t(spark, d, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").select("c_custkey", "n_name", "balance")


def reverse_traversal(spark, d):
    """Orders of the customers of one nation, repeats kept."""
    e = _edges(spark, d)
    nation = spark.createDataFrame([("nation:7",)], "id string")
    return graph.sources_of(e, graph.sources_of(e, nation, "located_in"), "sold_to")


def path_join(spark, d):
    """Line item to region along five keys."""
    li, o, c, n, r = (_t(spark, d, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    path = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    return path.groupBy("r_name", "l_returnflag").agg(F.sum(F.col("l_extendedprice").cast("decimal(38,2)")).alias("total"), F.count(F.lit(1)).alias("n"))


def dangling_edges(spark, d):
    """Edges whose ends are no nodes; here the suppliers without a part in the line items."""
    li = _t(spark, d, "lineitem").select(F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("dst"), F.lit("supplied_by").alias("relation")).distinct()
    nodes = _t(spark, d, "supplier").filter("s_acctbal >= 0").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("id")).unionByName(_t(spark, d, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id")))
    return graph.dangling(nodes, li)


def neighbourhood(spark, d):
    """One hop either way from a customer and a nation."""
    return graph.neighbours(_edges(spark, d), spark.createDataFrame([("customer:1",), ("nation:3",)], "id string"))


def hops(spark, d):
    """Everything within two hops of a region, with the least hop."""
    return graph.within_hops(_edges(spark, d), spark.createDataFrame([("region:2",)], "id string"), 2)


def entity_components(spark, d):
    """Components over the edges; each is a region with all that belongs to it."""
    e = _edges(spark, d)
    nodes = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    return graph.components(nodes, e, "src", "dst")


def last_write(spark, d):
    """add_node: the last row of a key wins, at the place of the first."""
    rows = _t(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), "event_type")
    return graph.latest(rows)


def currency_totals(spark, d):
    """A1, A2: totals of an entity in each currency, and whether a grand total is refused."""
    return _totals(spark, d)


def best_by_currency(spark, d):
    """A3: the largest total in each currency."""
    return totals.superlative(_totals(spark, d))


def neighbours_in_rank(spark, d):
    """Neighbours in each ranking."""
    return totals.ranked_pairs(_totals(spark, d))


def comparisons(spark, d):
    """A4: each customer with the next by key."""
    t = totals.subtotals(_t(spark, d, "orders"), "o_custkey", "o_orderstatus", "o_totalprice")
    pairs = _t(spark, d, "customer").select(F.col("c_custkey").alias("left"), (F.col("c_custkey") + 1).alias("right"))
    return totals.compare(t, pairs)


def kind_counts(spark, d):
    """A5: counts of event kinds in one pass."""
    return totals.counts_by_kind(_t(spark, d, "events"), "user_id", "event_type", {"clicks": "click", "purchases": "purchase"})


def longest_names(spark, d):
    """The display name of each brand."""
    return totals.display_names(_t(spark, d, "part"), "p_brand", "p_name")


def value_sets(spark, d):
    """Distinct values of each source."""
    return totals.value_sets(_t(spark, d, "documents"), "source", "lang", "langs")


def stated_conflicts(spark, d):
    """The first number of two digits or more that the documents of a source state, where it differs."""
    c = totals.conflicts(_t(spark, d, "documents"), "source", "text", r"([0-9]{2,})")
    return c.select("entity", F.size("stated").cast("long").alias("distinct_stated"), "clauses", F.element_at("stated", 1).alias("first_stated"))


def scores(spark, d):
    """Ratios by group, all three scores together."""
    l = _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    s = evaluation.scorecard(l, "lang", F.col("quality") == 1, F.col("toxic") == 0, F.col("n_chars") > 500)
    return s.select("lang", "cases", *(F.round(c, 9).alias(c) for c in ("faithfulness", "coverage", "quality", "trustworthy")))


def tally_pivot(spark, d):
    """Detected of applicable by priority and family."""
    o = _t(spark, d, "orders")
    return evaluation.tally(o, ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"], F.col("o_totalprice") > 100000, F.col("o_custkey") % 2 == 0)


def pair_quality(spark, d):
    """Precision and recall of a rule against labels."""
    l = _t(spark, d, "labels").join(_t(spark, d, "documents"), "doc_id")
    p = evaluation.precision_recall(l, F.col("n_chars") > 1000, F.col("quality") == 1)
    return p.select(F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


def document_frequency(spark, d):
    """Document frequency, occurrences and mean length over retrieval tokens."""
    p = retrieval.postings(_t(spark, d, "documents"), "doc_id")
    return p.filter("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("occurrences"))


_TOKENS = """
    SELECT doc_id, CASE WHEN length(t) > 3 AND ends_with(t, 's') THEN t[:-2] ELSE t END AS term FROM (
        SELECT doc_id, unnest(regexp_extract_all(replace(replace(replace(replace(lower(text), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), '[a-z0-9]+')) AS t FROM documents)
    WHERE length(t) >= 2 AND t NOT IN (""" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + ")"


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def bm25_top(spark, d):
    """The five best documents for every benchmark passage."""
    hits = retrieval.bm25(_t(spark, d, "documents"), _questions(spark, d), 5, "doc_id")
    return hits.select("qid", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


def cosine_top(spark, d):
    """The five nearest vectors of every twentieth vector."""
    v = _t(spark, d, "embeddings")
    hits = retrieval.nearest(v, v.filter("vec_id % 20 = 0"), 5)
    return hits.select("qid", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


def recurrence_counts(spark, d):
    """How many earlier events of its user and kind each event has."""
    return temporal.recurrences(_t(spark, d, "events"), ["user_id", "event_type"], "ts").select("event_id", "earlier")


def filled_forward(spark, d):
    """Lines without a value take the last one of their user."""
    e = _t(spark, d, "events").withColumn("v", F.when(F.col("event_type") == "click", F.col("event_id")))
    return temporal.forward_fill(e, "user_id", "event_id", "v", "last_click").select("event_id", "last_click")


def step_lines(spark, d):
    """Events inside the first to last click of their user, both ends in."""
    e = _t(spark, d, "events")
    steps = e.filter("event_type = 'click'").groupBy("user_id").agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    return temporal.in_steps(e, steps, "user_id", "event_id", "ts").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def tail_bytes(spark, d):
    """The last turns of a conversation that fit 2,000 bytes."""
    return temporal.tail_by_bytes(_t(spark, d, "conversations").filter("text is not null"), "conv_id", "turn", "text", 2000).select("conv_id", "turn", "bytes")


def newest_first(spark, d):
    """The three newest orders of a customer, and how many are left out."""
    top, rest = temporal.newest(_t(spark, d, "orders"), "o_custkey", [F.desc("o_orderdate"), F.col("o_orderkey")], 3)
    return top.join(rest, "o_custkey").select("o_custkey", "o_orderkey", "omitted")


def manifest_changes(spark, d):
    """Leaves of two manifests that are missing, unexpected or differ."""
    c = _t(spark, d, "customer")
    old = integrity.leaves(c.filter("c_custkey % 7 <> 0").select(F.col("c_custkey").cast("string").alias("k"), F.col("c_name").alias("v")), "k", "v")
    new = integrity.leaves(c.filter("c_custkey % 5 <> 0").select(F.col("c_custkey").cast("string").alias("k"), F.when(F.col("c_custkey") % 3 == 0, F.lit("x")).otherwise(F.col("c_name")).alias("v")), "k", "v")
    return integrity.manifest_diff(old, new)


def manifest_commitment(spark, d):
    """One root over all leaves."""
    return integrity.manifest_root(integrity.leaves(_t(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("k"), "n_name"), "k", "n_name"))


def ledger_tree(spark, d):
    """All levels of the Merkle tree over the customers' names."""
    levels = integrity.merkle_levels(graph.numbered(_t(spark, d, "customer").select("c_custkey", "c_name"), ["c_custkey"], "i"), "i", "c_name")
    out = None
    for k, level in enumerate(levels):
        part = level.select(F.lit(k).alias("level"), "i", F.lower(F.hex("hash")).alias("hash"))
        out = part if out is None else out.unionByName(part)
    return out


def paragraph_chunks(spark, d):
    """Located paragraphs; sentences are put in paragraphs first, as the documents have no blank lines."""
    docs = _t(spark, d, "documents").select("doc_id", F.regexp_replace("text", r"\.\n", ".\n\n").alias("text"))
    return chunking.paragraphs(docs).select("doc_id", "chunk", "start_line", "end_line", F.md5("text").alias("text_md5"))


def name_keys(spark, d):
    """Comparison keys of part names."""
    return _t(spark, d, "part").select("p_partkey", X.normalize(F.col("p_name")).alias("key"), F.size(X.name_tokens(F.col("p_name"))).cast("long").alias("tokens"))


def scrubbed(spark, d):
    """Control sequences and credentials taken out of every text, with counts."""
    docs = _t(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    clean, hits = X.scrub(F.col("text"))
    return docs.select("doc_id", F.md5(clean.cast("binary")).alias("clean_md5"), sum(hits.values()).cast("long").alias("hits"))


_SCRUBBED = "regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\\x1b\\][^\\x07\\x1b]*(?:\\x07|\\x1b\\\\)', '', 'g'), '\\x1b\\[[0-?]*[ -/]*[@-~]', '', 'g'), '[\\x00-\\x08\\x0b-\\x1f\\x7f-\\x{9f}]', '', 'g')"


def _scrub_sql() -> str:
    steps, hits, inner = "", [], f"SELECT doc_id, {_SCRUBBED} AS t0 FROM documents"
    for k, (_, pattern, to) in enumerate(X.SECRETS):
        pattern, to = pattern.replace("'", "''"), to.replace("$1", "\\1")
        inner = f"SELECT *, len(regexp_extract_all(t{k}, '{pattern}')) AS h{k}, regexp_replace(t{k}, '{pattern}', '{to}', 'g') AS t{k + 1} FROM ({inner})"
        hits.append(f"h{k}")
    return f"SELECT doc_id, md5(t{len(X.SECRETS)}) AS clean_md5, {' + '.join(hits)} AS hits FROM ({inner}){steps}"


def money_text(spark, d):
    """Totals as text."""
    return _totals(spark, d).select("entity", "currency", X.money(F.col("currency"), F.col("total")).alias("shown"))


def edit_distances(spark, d):
    """Edit distance of neighbouring part names."""
    p = _t(spark, d, "part").select("p_partkey", "p_name")
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next_name"))
    return p.join(q, "p_partkey").select("p_partkey", F.levenshtein("p_name", "next_name").cast("long").alias("distance"))


def phrase_hits(spark, d):
    """Documents that hold each of some whole phrases, counted."""
    held = _t(spark, d, "documents").select(F.explode(X.held_phrases(F.coalesce("text", F.lit("")), ["the", "of the", "de la", "nicht"])).alias("wanted"))
    return held.groupBy("wanted").agg(F.count(F.lit(1)).alias("n"))


def resolved_names(spark, d):
    """Resolutions between the parts' names, with the largest brand that uses each as corroborating field."""
    names = _t(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("seq"), F.max("p_brand").alias("brand")).select("seq", F.col("seq").alias("id"), "name", "brand")
    return resolution.resolve(names, resolution.generic_tokens(spark, names), fields=("brand",))


def document_mentions(spark, d):
    """The benchmark passages, taken as names, in the documents."""
    names = _t(spark, d, "benchmark").select(F.concat(F.lit("item:"), F.col("item_id").cast("string")).alias("id"), F.col("text").alias("name"))
    return resolution.mentions(_t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")), names)


def enumeration(spark, d):
    """A bounded universe: claims whose cited records are all true."""
    u = evaluation.universe(spark, 6, 3)
    return u.agg(F.count(F.lit(1)).alias("states"), F.count_if(F.col("cited").bitwiseAND(F.col("truth")) == F.col("cited")).alias("sound"), F.count_if(F.col("cited") == 0).alias("uncited"))


def locators(spark, d):
    """Locators and templated text of rows."""
    n = _t(spark, d, "nation")
    return n.select("n_nationkey", readers.render_locator(readers.locator("table-row", row=F.col("n_nationkey"), table=F.lit("nation"))).alias("locator"), readers.template("Nation {n_name} in region {n_regionkey}").alias("text"))


QUERIES = {f.__name__: f for f in (edge_table, denormalised, reverse_traversal, path_join, dangling_edges, neighbourhood, hops, entity_components, last_write, currency_totals, best_by_currency, neighbours_in_rank, comparisons, kind_counts, longest_names, value_sets, stated_conflicts, scores, tally_pivot, pair_quality, document_frequency, bm25_top, cosine_top, recurrence_counts, filled_forward, step_lines, tail_bytes, newest_first, manifest_changes, manifest_commitment, ledger_tree, paragraph_chunks, name_keys, scrubbed, money_text, edit_distances, phrase_hits, resolved_names, document_mentions, enumeration, locators)}



def _ledger_sql(levels: int = 24) -> str:
    """Level by level; a level over a single node is empty."""
    steps = ["l0 AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS i, sha256(unhex('00') || encode(c_name)) AS h FROM customer)"]
    for k in range(1, levels):
        steps.append(f"l{k} AS (SELECT i // 2 AS i, CASE WHEN count(*) = 2 THEN sha256(unhex('01') || unhex(arg_min(h, i)) || unhex(arg_max(h, i))) ELSE min(h) END AS h FROM l{k - 1} WHERE (SELECT count(*) FROM l{k - 1}) > 1 GROUP BY 1)")
    return "WITH " + ", ".join(steps) + " " + " UNION ALL ".join(f"SELECT {k} AS level, i, h AS hash FROM l{k}" for k in range(levels))


#: A comparison key, for text whose letters beyond ASCII are all accented ones.
_KEY = "regexp_replace(strip_accents(replace(replace(replace(replace(lower({0}), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss')), '[^a-z0-9]', '', 'g')"
_BENCH = _TOKENS.replace("doc_id", "item_id").replace("FROM documents", "FROM benchmark")
ORACLE_SQL = {
    "edge_table": _EDGES,
    "denormalised": "SELECT c_custkey, n_name, CASE WHEN count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) = 1 THEN c_acctbal END AS balance FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey",
    "reverse_traversal": "SELECT 'order:' || o_orderkey AS id FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 7",
    "path_join": "SELECT r_name, l_returnflag, sum(l_extendedprice::DECIMAL(38,2)) AS total, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL",
    "dangling_edges": """
        WITH e AS (SELECT DISTINCT 'part:' || l_partkey AS src, 'supplier:' || l_suppkey AS dst, 'supplied_by' AS relation FROM lineitem),
        n AS (SELECT 'supplier:' || s_suppkey AS id FROM supplier WHERE s_acctbal >= 0 UNION ALL SELECT 'part:' || p_partkey FROM part)
        SELECT *, src AS missing FROM e WHERE src NOT IN (SELECT id FROM n) UNION ALL SELECT *, dst FROM e WHERE dst NOT IN (SELECT id FROM n)""",
    "neighbourhood": f"WITH e AS ({_EDGES}) SELECT DISTINCT id FROM (SELECT dst AS id FROM e WHERE src IN ('customer:1', 'nation:3') UNION ALL SELECT src FROM e WHERE dst IN ('customer:1', 'nation:3'))",
    "hops": f"WITH e AS ({_EDGES}) SELECT 'region:2' AS id, 0 AS hop UNION ALL SELECT src, 1 FROM e WHERE dst = 'region:2' UNION ALL SELECT a.src, 2 FROM e a JOIN e b ON a.dst = b.src WHERE b.dst = 'region:2'",
    "entity_components": f"""
        WITH e AS ({_EDGES}), r AS (
            SELECT 'order:' || o_orderkey AS id, n_regionkey AS r FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
            UNION ALL SELECT 'customer:' || c_custkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey
            UNION ALL SELECT 'nation:' || n_nationkey, n_regionkey FROM nation UNION ALL SELECT DISTINCT 'region:' || n_regionkey, n_regionkey FROM nation)
        SELECT id, min(id) OVER (PARTITION BY r) AS entity_id FROM r""",
    "last_write": "SELECT user_id AS id, min(event_id) AS seq, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1",
    "currency_totals": _TOTALS,
    "best_by_currency": f"SELECT currency, arg_max(entity, struct_pack(t := total, e := -entity)) AS entity, max(total) AS total, count(*) AS compared FROM ({_TOTALS}) GROUP BY currency",
    "neighbours_in_rank": f"""
        SELECT currency, entity AS higher, lower, total - next AS margin FROM (
            SELECT *, lead(entity) OVER w AS lower, lead(total) OVER w AS next FROM ({_TOTALS}) WINDOW w AS (PARTITION BY currency ORDER BY total DESC, entity)) WHERE next IS NOT NULL AND total <> next""",
    "comparisons": """
        WITH t AS (SELECT o_custkey AS e, count(DISTINCT o_orderstatus) AS n, max(o_orderstatus) AS c, sum(o_totalprice::DECIMAL(38,2)) AS total FROM orders GROUP BY 1)
        SELECT c_custkey AS "left", c_custkey + 1 AS "right", CASE WHEN a.n IS NULL OR b.n IS NULL THEN 'refused: no rows' WHEN a.n > 1 OR b.n > 1 THEN 'refused: mixed currencies'
            WHEN a.c <> b.c THEN 'refused: different currencies' WHEN a.total = b.total THEN 'same' WHEN a.total > b.total THEN 'exceeds' ELSE 'is below' END AS verdict
        FROM customer LEFT JOIN t a ON a.e = c_custkey LEFT JOIN t b ON b.e = c_custkey + 1""",
    "kind_counts": "SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'purchase') AS purchases FROM events GROUP BY 1",
    "longest_names": "SELECT p_brand AS entity, arg_max(p_name, struct_pack(n := length(p_name), s := p_name)) AS name FROM part GROUP BY 1",
    "value_sets": "SELECT source, array_to_string(list_sort(list(DISTINCT lang)), ',') AS langs, count(*) AS n FROM documents GROUP BY 1",
    "stated_conflicts": """
        WITH s AS (SELECT source AS entity, regexp_extract(text, '([0-9]{2,})', 1) AS stated FROM documents)
        SELECT entity, count(DISTINCT stated) AS distinct_stated, count(*) AS clauses, min(stated) AS first_stated FROM s WHERE stated <> '' GROUP BY 1 HAVING count(DISTINCT stated) >= 2""",
    "scores": """
        SELECT lang, count(*) AS cases, round(avg((quality = 1)::INT), 9) AS faithfulness, round(avg((toxic = 0)::INT), 9) AS coverage, round(avg((n_chars > 500)::INT), 9) AS quality,
               round(avg((l.quality = 1 AND toxic = 0 AND n_chars > 500)::INT), 9) AS trustworthy
        FROM labels l JOIN documents USING (doc_id) GROUP BY lang""",
    "tally_pivot": "SELECT o_orderpriority, " + ", ".join(f"count(*) FILTER (o_orderstatus = '{s}' AND o_totalprice > 100000 AND o_custkey % 2 = 0) AS \"{s}_detected\", count(*) FILTER (o_orderstatus = '{s}' AND o_custkey % 2 = 0) AS \"{s}_applicable\"" for s in "FOP") + " FROM orders GROUP BY 1",
    "pair_quality": "SELECT round(count(*) FILTER (n_chars > 1000 AND quality = 1) / count(*) FILTER (n_chars > 1000), 9) AS precision, round(count(*) FILTER (n_chars > 1000 AND quality = 1) / count(*) FILTER (quality = 1), 9) AS recall FROM labels JOIN documents USING (doc_id)",
    "document_frequency": f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS occurrences FROM ({_TOKENS}) GROUP BY term",
    "bm25_top": f"""
        WITH t AS ({_TOKENS}), p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), l AS (SELECT doc_id, count(*) AS len FROM t GROUP BY 1),
        s AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM t) / (SELECT count(*) FROM documents) AS mean), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
        q AS (SELECT item_id AS qid, term, count(*) AS times FROM ({_BENCH}) GROUP BY ALL),
        r AS (SELECT qid, doc_id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))) AS score FROM q JOIN p USING (term) JOIN f USING (term) JOIN l USING (doc_id), s GROUP BY ALL)
        SELECT qid, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM r QUALIFY rank <= 5""",
    "cosine_top": """
        WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
        SELECT q.vec_id AS qid, v.vec_id, round(list_cosine_similarity(v.e, q.e), 6) AS score FROM v, v q WHERE q.vec_id % 20 = 0
        QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(v.e, q.e), 9) DESC, v.vec_id) <= 5""",
    "recurrence_counts": "SELECT event_id, rank() OVER (PARTITION BY user_id, event_type ORDER BY ts) - 1 AS earlier FROM events",
    "filled_forward": "SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS last_click FROM events",
    "step_lines": "WITH s AS (SELECT user_id, min(ts) AS a, max(ts) AS b FROM events WHERE event_type = 'click' GROUP BY 1) SELECT user_id, count(*) AS n FROM events JOIN s USING (user_id) WHERE ts BETWEEN a AND b GROUP BY 1",
    "tail_bytes": "SELECT conv_id, turn, bytes FROM (SELECT conv_id, turn, sum(strlen(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS bytes FROM conversations WHERE text IS NOT NULL) WHERE bytes <= 2000",
    "newest_first": "SELECT o_custkey, o_orderkey, greatest(count(*) OVER (PARTITION BY o_custkey) - 3, 0) AS omitted FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) <= 3",
    "manifest_changes": """
        WITH a AS (SELECT c_custkey::VARCHAR AS name, sha256(c_name) AS d FROM customer WHERE c_custkey % 7 <> 0), b AS (SELECT c_custkey::VARCHAR AS name, sha256(CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE c_name END) AS d FROM customer WHERE c_custkey % 5 <> 0)
        SELECT coalesce(a.name, b.name) AS name, CASE WHEN b.d IS NULL THEN 'missing' WHEN a.d IS NULL THEN 'unexpected' ELSE 'differs' END AS change FROM a FULL JOIN b ON a.name = b.name WHERE a.d IS DISTINCT FROM b.d""",
    "manifest_commitment": "SELECT 'sha256:' || sha256(string_agg(x, chr(10) ORDER BY x)) AS root, count(*) AS leaves FROM (SELECT n_nationkey || '=sha256:' || sha256(n_name) AS x FROM nation)",
    "ledger_tree": _ledger_sql(),
    "paragraph_chunks": """
        WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(text, '\\.\\n', E'.\\n\\n', 'g'), '\\n$', ''), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(regexp_replace(text, '\\.\\n', E'.\\n\\n', 'g'), '\\n$', ''), chr(10)), 1) AS n FROM documents),
        b AS (SELECT *, trim(line) = '' AS blank, coalesce(lag(trim(line) = '') OVER (PARTITION BY doc_id ORDER BY n), true) AS gap FROM l),
        g AS (SELECT *, sum((NOT blank AND gap)::INT) OVER (PARTITION BY doc_id ORDER BY n) AS block FROM b)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block) AS chunk, min(n) AS start_line, max(n) AS end_line, md5(string_agg(line, chr(10) ORDER BY n)) AS text_md5 FROM g WHERE NOT blank GROUP BY doc_id, block""",
    "name_keys": "SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS key, len(list_filter(string_split_regex(p_name, '[\\s\\-_/.,&]+'), lambda x: length(regexp_replace(lower(x), '[^a-z0-9]', '', 'g')) >= 2)) AS tokens FROM part",
    "scrubbed": _scrub_sql(),
    "money_text": f"SELECT entity, currency, currency || ' ' || format('{{:,.2f}}', total::DOUBLE) AS shown FROM ({_TOTALS})",
    "edit_distances": "SELECT a.p_partkey, levenshtein(a.p_name, b.p_name) AS distance FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1",
    "phrase_hits": "SELECT wanted, count(*) AS n FROM documents, (VALUES ('the'), ('of the'), ('de la'), ('nicht')) w(wanted) WHERE contains(' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ', ' ' || wanted || ' ') GROUP BY 1",
    "document_mentions": f"""
        WITH t AS (SELECT doc_id, {_KEY.format("text")} AS body FROM documents), k AS (SELECT 'item:' || item_id AS node, {_KEY.format("text")} AS key FROM benchmark),
        n AS (SELECT *, CASE {" ".join(f"WHEN ends_with(key, '{x}') THEN CASE WHEN length(key) - {len(x)} >= {X.MIN_STEM} THEN key[:-{len(x) + 1}] END" for x in X.LEGAL_SUFFIXES)} END AS stem FROM k)
        SELECT doc_id AS chunk, node, CASE WHEN contains(body, key) THEN 1.0 ELSE 0.9 END AS confidence FROM t JOIN n ON contains(body, key) OR contains(body, stem)""",
    "enumeration": "WITH t AS (SELECT unnest(range(64)) AS truth), c AS (SELECT unnest(range(64)) AS cited) SELECT count(*) AS states, count(*) FILTER (cited & truth = cited) AS sound, count(*) FILTER (cited = 0) AS uncited FROM t, c WHERE bit_count(cited) <= 3",
    "locators": "SELECT n_nationkey, 'row ' || n_nationkey || ', table nation' AS locator, 'Nation ' || n_name || ' in region ' || n_regionkey AS text FROM nation",
}
