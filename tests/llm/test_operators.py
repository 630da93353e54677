import base64
import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.llm import byte_bpe, exact_dedup, html_text, jaccard_join, pii, quality_rules, repeated_passages, source_mix, token_counts, url_filters

from . import plain

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, source string, kept boolean, n long, did string, label int, token double, bucket int, size string, at int, group_size int"


def texts(seed=1, n=120):
    r = random.Random(seed)
    base = [" ".join(f"w{r.randint(0, 200)}" for _ in range(r.randint(1, 90))) for _ in range(25)]
    rows = []
    for i in range(n):
        words = r.choice(base).split(" ")
        for _ in range(r.choice([0, 0, 1, 2, 6])):
            words[r.randrange(len(words))] = f"Ü{r.randint(0, 9)}"
        rows.append((3 * i, " ".join(words) + r.choice(["", "\n", " x@y.example 10.2.3.4"])))
    rows += [(1000, None), (1001, ""), (1001, ""), (1002, " \n\t"), (None, base[0]), (None, None), (1003, base[1]), (1003, base[1]), (1004, "é" * 3000), (1005, "a b " * 900), (1006, "one two three"), (1007, "ONE  two three")]
    return rows


def frame(spark, rows):
    """With nulls, repeated rows, and columns whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, None if k % 7 == 0 else f"s{k % 4}", None, 1, "x", 2, 0.5, 3, "y", 4, 5) for k, (d, t) in enumerate(rows)], SCHEMA).repartition(3)


def got(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(spark):
    rows = texts()
    assert got(exact_dedup.exact_dedup(frame(spark, rows))) == plain.exact(rows)
    assert got(exact_dedup.exact_dedup(frame(spark, rows), huge_bytes=100)) == plain.exact(rows)
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0
    left = exact_dedup.drop_copies(frame(spark, rows))
    assert left.columns == frame(spark, rows).columns
    assert got(left, "doc_id", F.coalesce("text", F.lit(""))) == sorted(((d, t) for t, d in {t or "": max((i for i, x in rows if (x or "") == (t or "") and i is not None), default=None) for _, t in rows}.items()), key=repr)


def test_fingerprints_compose():
    import numpy as np

    r = random.Random(2)
    for n in (0, 1, 5, exact_dedup.CHUNK, exact_dedup.CHUNK + 7, 3 * exact_dedup.CHUNK):
        data = bytes(r.randrange(256) for _ in range(n))
        for base, p, f in zip(exact_dedup.BASES, exact_dedup.PRIMES, exact_dedup.fingerprint(np.frombuffer(data, np.uint8)), strict=True):
            assert f == int.from_bytes(b"") if not n else True
            x = 0
            for b in data[: 2000 if n > 2000 else n]:
                x = (x * base + b) % p
            if n <= 2000:
                assert f == x
        a, b = np.frombuffer(data[: n // 3], np.uint8), np.frombuffer(data[n // 3 :], np.uint8)
        assert exact_dedup.combine(exact_dedup.fingerprint(a), exact_dedup.fingerprint(b), len(b)) == exact_dedup.fingerprint(np.frombuffer(data, np.uint8))


def test_collisions_are_told_apart(spark, monkeypatch):
    rows = [(1, "abc"), (2, "abd"), (3, "abc"), (4, "xyz"), (5, "abd")]
    real = exact_dedup.fingerprints
    monkeypatch.setattr(exact_dedup, "fingerprints", lambda docs, huge: real(docs, huge).withColumn("f1", F.lit(1).cast("long")).withColumn("f2", F.lit(1).cast("long")))
    monkeypatch.setattr(exact_dedup, "_hash_batch", _same)
    assert got(exact_dedup.exact_dedup(frame(spark, rows))) == plain.exact(rows)


def _same(batch):
    import pyarrow as pa

    one = pa.array([1] * batch.num_rows, pa.int64())
    return pa.record_batch([*batch.columns[:-1], one, one], [*batch.schema.names[:-1], "f1", "f2"])


def test_repeated_passages(spark):
    rows = texts(3)
    assert got(repeated_passages.remove_repeats(frame(spark, rows))) == plain.repeats(rows)
    assert repeated_passages.remove_repeats(empty(spark), texts=True).count() == 0
    few = got(repeated_passages.remove_repeats(frame(spark, rows[:40]), texts=True), "doc_id", "n_removed", "spans", "kept")
    assert all(n == sum(s["end"] - s["start"] for s in spans) for _, n, spans, _ in few) and any(n for _, n, _, _ in few)


def test_pieces_of_huge_texts(monkeypatch):
    import numpy as np

    monkeypatch.setattr(repeated_passages, "BLOCK", 400)
    r = random.Random(1)
    for _ in range(20):
        parts = ["".join(r.choice("ab c") for _ in range(r.choice([0, 3, 49, 50, 51, 700, 1500]))) for _ in range(5)]
        data, offsets = np.frombuffer("".join(parts).encode(), np.uint8), np.cumsum([0] + [len(x) for x in parts])
        starts = [x + at for p, _, at in repeated_passages.parses(data, offsets, 50) for x in p.windows(np.arange(len(p.start)))[0].tolist()]
        assert sorted(starts) == [int(o) + i for o, x in zip(offsets, parts) for i in range(len(x) - 49)]


class Local:
    """Record batches whose Arrow functions run in this process, where constants can be changed and memory seen."""

    def __init__(self, *batches):
        self.batches = batches

    def mapInArrow(self, run, _):
        return Local(*run(iter(self.batches)))

    def groupBy(self, key):
        import pyarrow as pa
        import pyarrow.compute as pc

        whole = pa.Table.from_batches(self.batches)
        self.groups = [whole.filter(pc.equal(whole[key], k)) for k in whole[key].unique()]
        return self

    def applyInArrow(self, meet, _):
        return [x for t in self.groups for x in meet(t).to_pylist()]


def did_text(rows):
    import pyarrow as pa

    return pa.record_batch([pa.array([repeated_passages.NO_ID if d is None else d for d, _ in rows], pa.int64()), pa.array([t or "" for _, t in rows])], ["did", "text"])


def test_memory_of_a_map_unit():
    import tracemalloc

    r = random.Random(31)
    rows = [(k, r.randbytes(100_000).hex()) for k in range(40)]
    repeated_passages.phrase_findings(Local(did_text(rows[:10])), 50, 256)
    batch = Local(did_text(rows))
    tracemalloc.start()
    assert not repeated_passages.phrase_findings(batch, 50, 256)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6 * sum(len(t) for _, t in rows), peak


@pytest.mark.parametrize(("unit", "portions"), [(40, 3), (1 << 20, 8)])
def test_repeats_over_small_units(monkeypatch, unit, portions):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(repeated_passages, "BLOCK", 400)
    monkeypatch.setattr(repeated_passages, "PORTIONS", portions)
    monkeypatch.setattr(repeated_passages, "UNIT_ROWS", {"phrases": unit, "windows": unit})
    rows = texts(32)
    batch = did_text(rows)
    found = repeated_passages.phrase_findings(Local(batch), 50, 256)
    asks = {}
    for x in found:
        if x["kind"] == repeated_passages.ASK:
            asks.setdefault(x["did"], set()).add(x["value"])
    lists = [sorted(asks.get(d, ())) for d in batch["did"].to_pylist()]
    asked = pa.record_batch([*batch.columns, pa.array(lists, pa.list_(pa.int64()))], ["did", "text", "triggers"]).filter(pa.array([bool(x) for x in lists]))
    assert asked.num_rows
    found += repeated_passages.window_findings(Local(asked), 50, 256)
    out = []
    for d, t in rows:
        own, data = repeated_passages.NO_ID if d is None else d, np.frombuffer((t or "").encode(), np.uint8)
        lost = [np.sort(np.array([x["value"] for x in found if x["did"] == own and x["kind"] == k], np.int64).view(np.uint64)) for k in (repeated_passages.PHRASE, repeated_passages.WINDOW)]
        kept, spans = repeated_passages.cut(data, *lost, 50)
        out.append((d, len(data), len(data) - len(kept), len(spans), plain.sha(kept)))
    assert sorted(out, key=repr) == plain.repeats(rows)


@pytest.mark.parametrize("rule", [jaccard_join.Rule(4, 85), jaccard_join.Rule(2, 60, heavy=3, pairs=20, left=1), jaccard_join.Rule(3, 70, table_rows=40)])
def test_jaccard_join(spark, rule):
    rows = texts(4)
    assert got(jaccard_join.near_duplicates(frame(spark, rows), rule)) == plain.near(rows, rule.words, rule.percent)
    assert jaccard_join.near_duplicates(empty(spark), rule).count() == 0


def test_jaccard_join_of_rows_that_share_an_id(spark):
    r = random.Random(21)
    base = [[f"b{k}x{i}" for i in range(r.randint(40, 120))] for k in range(12)]
    rows = []
    for k in range(150):
        words = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 3])):
            words[r.randrange(len(words))] = f"e{r.randint(0, 30)}"
        rows.append((r.choice([None, None, 1, 2, 3, 3, 100 + k, 100 + k]), " ".join(words)))
    rule = jaccard_join.Rule(3, 80, heavy=3)
    assert got(jaccard_join.near_duplicates(frame(spark, rows), rule)) == plain.near(rows, 3, 80)


def test_source_mix(spark):
    rows = [(d, t, s) for d, t, s in got(frame(spark, texts(5)), "doc_id", "text", "source") if d is not None and d != 1003 and d != 1001]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found, want = got(source_mix.mix_sources(df)), sorted(plain.mix(rows), key=repr)
    assert [x[:3] + x[4:] for x in found] == [x[:3] + x[4:] for x in want]
    assert all(abs(a[3] - b[3]) < 1e-6 for a, b in zip(found, want, strict=True))
    assert all(x[4] <= 2 * x[1] for x in found)
    assert source_mix.mix_sources(empty(spark)).count() == 0
    assert source_mix.mix_sources(frame(spark, texts(5))).count() == len(texts(5))
    taken = got(source_mix.apply_mix(df), "doc_id")
    assert sorted(d for (d,) in taken) == sorted(d for d, n, _, _, t in want for _ in range(-(-t // n) if n else 0))


def test_mix_of_overlapping_sources(spark):
    rows = [(i, "w " * 10, ["a"] if i < 10 else ["a", "b"] if i < 15 else ["b"]) for i in range(20)]
    out = got(source_mix.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source array<string>"), weights=(1, 1)), "doc_id", "size", "taken")
    assert all(t <= 2 * n for _, n, t in out) and sum(t for *_, t in out) > 0


def test_flow_prefers_fresh_words():
    # two patterns can serve quota 0; none is repeated before both are used up
    assert source_mix.route([((0,), 10), ((0,), 10)], [25], 2) in ([[10, 5], [10, 0]], [[10, 0], [10, 5]])
    assert source_mix.water_fill([10, 100], [5, 1], 60, 2) == [20, 40]


def test_url_filters(spark):
    urls = ["https://a.example.com/en/7?x", "http://example.com/en/7x/y", "ftp://com/en/", "http://EXAMPLE.net/de/81", "http://example.net/de/7", "http://x.org/es/q#top", "http://xorg/es/q", "http://a.de/login/", "http://a.de/en/logins", "http://b.de/a/wp-admin/x", "x.doubleclick.net/q", "http://x.doubleclick.net/q", None, "", "://", "http://a b.com/en/"]
    rows = spark.createDataFrame([(i if i else None, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    out = {u: r for u, r in zip([urls[i or 0] for i in [None, *range(1, len(urls))]], sorted(url_filters.filter_urls(rows, url_filters.BASE_RULES + url_filters.PATTERNS).collect(), key=lambda r: r[0] or 0))}
    assert [out[u]["rule"] for u in urls] == ["example.com/en/7", "example.com/en/7", "com/en/", "example.net/de/8", "net/de/", "org/es/", None, None, None, None, None, None, None, None, None, "com/en/"]
    assert [out[u]["verdict"] for u in urls] == ["allow", "allow", "block", "block", "allow", "block", "allow", "block", "allow", "block", "allow", "block", "allow", "allow", "allow", "block"]
    assert (out[urls[0]]["host"], out[urls[0]]["path"], out[None]["host"], out[None]["path"]) == ("a.example.com", "/en/7", "", "")
    assert url_filters.filter_urls(rows.limit(0), url_filters.BASE_RULES).count() == 0


def library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_text(r, k):
    kinds = ["ab é  \n'sſ1٣漢😀\x1c\x85.!tTinghe\t", None, "aeht ", None]
    if k % 4 == 1:
        return "".join(chr(r.choice([r.randint(0, 127), r.randint(0, 0xD7FF), r.randint(0x10000, 0x1FFFF)])) for _ in range(r.randint(0, 30)))
    if k % 4 == 3:
        return "".join(r.choice(["the", "ing", "tion", "er", "an", " on", "<|endoftext|>"]) for _ in range(r.randint(1, 60)))
    return "".join(r.choice(kinds[k % 4]) for _ in range(r.randint(0, 60)))


def test_byte_bpe_is_the_librarys():
    own, other, r = byte_bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, kept=50), library(), random.Random(1)
    own.transducer.limit = 2000  # tables are emptied on the way
    for k in range(1500):
        text = odd_text(r, k)
        ids = own.encode(text)
        assert ids == other.encode_ordinary(text)
        assert own.decode(ids) == text


def test_byte_bpe_codes_a_match_once():
    own, other, met = byte_bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN), library(), []
    encode = own.transducer.encode
    own.transducer.encode = lambda piece: met.append(piece) or encode(piece)
    texts_ = ["so zorblatique, zorblatique. (zorblatique) zorblatique", "zorblatique; no zorblatique!", "so  zorblatique\t:"]
    for text in texts_:
        assert own.encode(text) == other.encode_ordinary(text)
    assert met.count(b" zorblatique") == 1 and met.count(b"zorblatique") == 1


def test_byte_bpe_together_and_alone():
    own, other, r = byte_bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, kept=50), library(), random.Random(4)
    own.STEP = 7
    mixed = ["", " ", "a", "a ", " a", "a  b", "a\n b", "a\u3000 b", "é 漢 😀", "x" * 100 + ", a1b2 " + "y" * 70] + [odd_text(r, k) for k in range(300)] + [" ".join(r.choice(["on", "to,", "tone.", "it's", "x\ny", "\x85z", "é!"]) for _ in range(r.randint(1, 90))) for _ in range(300)]
    own.transducer.limit = 500
    for some in (mixed[:10], mixed, mixed[:1], []):
        rows = own.round_trips(some, {"ids", "decoded"})
        assert len(rows) == len(some)
        for text, row in zip(some, rows):
            ids = other.encode_ordinary(text)
            assert (row["ids"].tolist(), row["decoded"], row["n_tokens"]) == (ids, text, len(ids))
            assert (row["ids_sha256"], row["decoded_sha256"]) == (plain.sha(" ".join(map(str, ids))), plain.sha(text))
        assert len(own.spaced.now) <= 50 + 7 and len(own.transducer.arcs) <= 500 + 400


def test_incremental_utf8():
    r = random.Random(2)
    for _ in range(200):
        data = "".join(r.choice("aé漢😀") for _ in range(20)).encode()
        stream, at, out = byte_bpe.Utf8Stream(), 0, ""
        while at < len(data):
            step = r.randint(1, 3)
            out += stream.feed(data[at : at + step])
            at += step
        assert out + stream.close() == data.decode()
    stream = byte_bpe.Utf8Stream()
    assert stream.feed(b"a\xf0\x9f") + stream.close() == "a�"


def test_byte_bpe_query(spark):
    rows, other = texts(6), library()
    out = got(byte_bpe.encode_decode(frame(spark, rows), P.path("byte_bpe_50k.tiktoken"), P.PATTERN))
    want = []
    for d, t in rows:
        ids = other.encode_ordinary(t or "")
        want.append((d, len(ids), ids, t or "", plain.sha(" ".join(map(str, ids))), plain.sha(t or "")))
    assert out == sorted(want, key=repr)
    ids = byte_bpe.encode_decode(frame(spark, rows), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, ("ids",))
    assert got(byte_bpe.decode_ids(ids, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)) == sorted(((d, t or "") for d, t in rows), key=repr)
    assert byte_bpe.encode_decode(empty(spark), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_token_counts(spark):
    from tokenizers import Tokenizer

    library, own, r = Tokenizer.from_file(P.path("byte_bpe_50k.json")), token_counts.Counter(P.path("byte_bpe_50k.json"), kept=300), random.Random(3)
    for k in range(600):
        text = odd_text(r, k) + "x" * (r.randint(0, 300) if k % 9 == 0 else 0)
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert own.counts([text]) == [n]
        assert not text or own.spliced(text, r.randint(20, 60), r.randint(2, 10)) == n
    rows = texts(7)
    want = sorted(((d, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for d, t in rows), key=repr)
    assert got(token_counts.token_counts(frame(spark, rows), P.path("byte_bpe_50k.json"))) == want
    assert token_counts.token_counts(empty(spark), P.path("byte_bpe_50k.json")).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_pii(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits)))
            good = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(digits) <= 19 and total % 10 == 0, "phone": 9 <= len(digits) <= 15}
            if good[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii_patterns():
    r = random.Random(4)
    for k in range(4000):
        text = "".join(r.choice(["aB1.@-+ %é", "0123456789. -", "+12 ()3.-45"][k % 3]) for _ in range(r.randint(0, 30)))
        assert pii.base_spans(text) == plain_pii(text), text
    assert pii.base_spans("pay 4111 1111 1111 1111 now") == [(4, 2, 23)]


def test_pii_query(spark):
    rows = texts(8) + [(2000 + i, f"{'filler ' * i} the nightingale wrote to bob@corp.example about {i} things") for i in range(6)] + [(2100 + i, f"plain text {i} on things and birds the") for i in range(900)]
    out = {}
    for r in pii.personal_data(frame(spark, rows)).collect():
        out.setdefault(r["doc_id"], []).append(r)
    for d, t in rows:
        base = plain_pii(t or "")
        assert any(plain.sha(pii.render(base)) == r["base_sha256"] and (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(sum(s[1] == k for s in base) for k in range(4)) for r in out[d])
    told = out[2003][0]["spans"]
    text = dict(rows)[2003]
    at = text.index("nightingale")
    assert f"term:{at}:{at + 11}" in told and f"email:{text.index('bob@')}" in told
    assert "term" not in out[2100][0]["spans"]
    assert pii.sanitise(text, [(at, 4, at + 11), *pii.base_spans(text)]).count("[EMAIL]") == 1
    assert pii.personal_data(empty(spark)).count() == 0


def test_quality_rules(spark):
    rows = texts(9) + [(3000, "word " * 60), (3001, " ".join(f"u{i}" for i in range(100)) + " " + " ".join(f"u{i}" for i in range(40))), (3002, " ".join(f"u{i}" for i in range(60)))]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert got(quality_rules.quality_rules(frame(spark, rows)), "doc_id", *names) == sorted(((d, *plain.quality(t)) for d, t in rows), key=repr)
    assert quality_rules.quality_rules(empty(spark)).count() == 0
    left = quality_rules.drop_failing(frame(spark, rows))
    assert left.columns == frame(spark, rows).columns
    assert got(left, "doc_id") == sorted(((d,) for d, t in rows if plain.quality(t)[-1]), key=repr)


def test_suffix_array():
    import numpy as np

    r = random.Random(5)
    for _ in range(300):
        ids = [r.randint(0, r.choice([1, 3, 20])) for _ in range(r.randint(1, 40))]
        order, common = quality_rules.suffix_array(np.array(ids))
        assert order.tolist() == sorted(range(len(ids)), key=lambda i: ids[i:])
        for k in range(1, len(ids)):
            a, b = ids[order[k - 1] :], ids[order[k] :]
            assert common[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_html_text(spark):
    page = '<body><header>H</header><nav>a<p>b</nav><main><article class=post><header><h1>T &amp;&nbsp;x</h1></header><p>one<br>two<ul><li>l1<li>l2</ul><div class="ad">x<div>y</div></div><p>three<form>f</form></article><section id="comments"><article class="comment"><p>cc</article></section></main><aside>s</aside><footer>f</footer>'
    assert html_text.blocks(page) == ["T & x", "one two", "l1", "l2", "three"]
    assert html_text.blocks("a < b & c <p>x <b>y") == ["a < b & c", "x y"]
    assert html_text.blocks("<div><script>if(a<b){}</script>t</div><nav>zz<article>ok") == ["ok"]
    menu = "home news sport weather travel food music books"
    rows = [(i, f"http://h/{i}", f"<p>{menu}</p><p>page {i} says something of its own, {i * i}</p>", "x") for i in range(30)] + [(None, None, None, "x"), (40, "http://k/", "", "x"), (41, "http://k/", page, "x"), (41, "http://k/", page, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    out = {r["page_id"]: r for r in html_text.main_text(df, group_pages=12).collect()}
    assert all(out[i]["text"] == f"page {i} says something of its own, {i * i}" for i in range(30))
    assert (out[None]["text"], out[40]["n_chars"], out[41]["text"]) == ("", 0, "T & x\n\none two\n\nl1\n\nl2\n\nthree")
    assert html_text.main_text(df).count() == 34 and html_text.main_text(df.limit(0)).count() == 0


def planted_pages(n, every, seed=3):
    r = random.Random(seed)
    line = "this notice stands at the foot of each section page"
    return [(i, f"http://h/{i}", f"<p>{' '.join(f'v{r.randint(0, 5000)}' for _ in range(60))}</p>" + f"<p>{line}</p>" * (i % every == 0), "x") for i in range(n)], line


def test_html_runs_are_counted_over_the_whole_host(spark, monkeypatch):
    rows, line = planted_pages(90, 2)
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    whole = got(html_text.main_text(df, min_share=0.48))
    assert len(whole) == 90 and not any(line in r[2] for r in whole)
    for size in (4, 7, 20):
        assert got(html_text.main_text(df, min_share=0.48, group_pages=size)) == whole
    assert sum(line in r[2] for r in got(html_text.main_text(df, min_share=0.52, group_pages=7))) == 45
    monkeypatch.setattr(html_text, "BROADCAST_BYTES", -1)
    assert got(html_text.main_text(df, min_share=0.48, group_pages=7)) == whole


def test_html_boilerplate_on_few_pages_goes_and_copies_stay(spark):
    rows, line = planted_pages(60, 6)
    few = [(100 + i, f"http://few/{i}", h, "x") for i, (_, _, h, _) in enumerate(planted_pages(5, 1, 4)[0])]
    article = " ".join(f"a{i}" for i in range(70))
    copies = [(200 + i, f"http://h/c{i}", f"<p>{article}</p>", "x") for i in range(20)]
    df = spark.createDataFrame(rows + few + copies, "page_id long, url string, html string, host string")
    out = {r["page_id"]: r["text"] for r in html_text.main_text(df).collect()}
    assert len(out) == 85 and not any(line in t for t in out.values())
    assert all(len(t.split()) == 60 for i, t in out.items() if i < 200) and all(out[200 + i] == article for i in range(20))


def test_pii_terms_of_rare_entities(spark):
    rows = [(i, f"plain text on things and birds number{i % 40} {i}") for i in range(800)]
    rows += [(900, f"the zanzibar clerk {'and birds ' * 60} ann@corp.example"), (901, f"bob@corp.example {'plain text ' * 40} harpsichord things"), (902, "things bob@corp.example harpsichord")]
    rows += [(903, "eve@corp.example number7"), (904, "tim@corp.example kumquat"), (905, "a kumquat on things")]
    spans = {r["doc_id"]: r["spans"] for r in pii.personal_data(frame(spark, rows)).collect()}
    for d, word in ((900, "zanzibar"), (901, "harpsichord"), (902, "harpsichord")):
        at = dict(rows)[d].index(word)
        assert f"term:{at}:{at + len(word)}" in spans[d]
    assert all("term" not in spans[d] for d in (0, 903, 904, 905))


def test_terms_are_those_of_the_definition(spark):
    r = random.Random(11)
    vocabulary = [f"w{i}ord" for i in range(60)]
    mails = [f"m{i}@corp.example" for i in range(6)]
    rows = [(i, " ".join([*(r.choice(vocabulary) for _ in range(r.randint(1, 12))), *([r.choice(mails)] if r.random() < 0.1 else []), *([f"rare{r.randint(0, 400)}"] if r.random() < 0.3 else [])])) for i in range(500)]
    rows += [(1000 + i, rows[i][1]) for i in range(40)] + [(2000, None), (2001, "")]
    rule = pii.Disclosure(min_share=0.5, min_bits=3.0)
    want = plain.terms(rows, plain_pii, min_bits=3.0)
    assert want
    out = {x["doc_id"]: x["spans"] for x in pii.personal_data(frame(spark, rows), rule).collect()}
    for d, text in rows:
        spans = plain_pii(text or "") + [(m.start(), 4, m.end()) for m in re.finditer(r"[^\W_]{3,}", text or "") if m[0].lower() in want]
        assert out[d] == pii.render(sorted(spans))


def test_pii_takes_linear_time():
    import time

    began = time.time()
    assert pii.base_spans("7" * 1_000_000) == [] and pii.base_spans("1." * 300_000)
    text = "x@y.example " * 100_000
    assert len(pii.base_spans(text)) == 100_000 and len(pii.render(pii.base_spans("1.2.3.4 " * 20_000)).split(",")) == 20_000
    assert time.time() - began < 20


def test_boilerplate_is_that_of_the_definition(spark):
    r = random.Random(12)
    lines = [" ".join(f"l{k}x{i}" for i in range(r.randint(6, 14))) for k in range(12)]
    pages = []
    for i in range(120):
        own = [" ".join(f"v{r.randint(0, 4000)}" for _ in range(r.randint(5, 40))) for _ in range(3)]
        shared = [x for k, x in enumerate(lines) if r.random() < [0.02, 0.04, 0.08, 0.3, 0.6, 1][k % 6]]
        blocks = own + shared
        r.shuffle(blocks)
        pages.append((f"h{i % 3}", blocks))
    rows = [(i, f"http://{h}/{i}", "".join(f"<p>{b}</p>" for b in blocks), "x") for i, (h, blocks) in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string").repartition(3)
    want = plain.boilerplate(pages)
    for size in (400, 9):
        assert [x[2] for x in sorted(map(tuple, html_text.main_text(df, group_pages=size).collect()))] == want
    assert want != ["\n\n".join(b) for _, b in pages]


def test_routing_is_the_cheapest():
    r = random.Random(13)
    for _ in range(60):
        n = r.randint(1, 3)
        patterns = [(tuple(sorted(r.sample(range(n), r.randint(1, min(n, 2))))), r.randint(0, 3)) for _ in range(r.randint(1, 3))]
        quotas = [r.randint(0, 7) for _ in range(n)]
        flows = source_mix.route(patterns, quotas, 2)
        assert (sum(map(sum, flows)), sum(f[1] for f in flows)) == plain.cheapest(patterns, quotas, 2)
        assert all(0 <= x <= w for f, (_, w) in zip(flows, patterns) for x in f)


def test_url_rules_with_odd_tokens(spark):
    rules = [url_filters.host_rule("Example.com/En/x", "block"), url_filters.host_rule("example.com/a%2Fb/c", "block"), url_filters.pattern_rule("digits", r"\0.*[0-9]{9}", (), "block"), url_filters.host_rule("org", "block")]
    urls = ["http://example.com/En/xy", "http://EXAMPLE.com/En/x", "http://example.com/en/x", "http://example.com/a%2Fb/c", "http://a.de/123456789", "http://a.org/z", "http://a.de/", "http://a.orgs/"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = [r["verdict"] for r in url_filters.filter_urls(rows, rules).orderBy("page_id").collect()]
    assert out == ["block", "block", "allow", "block", "block", "block", "allow", "allow"]
    assert url_filters.filter_urls(rows, rules[2:3]).filter("verdict = 'block'").count() == 1


CLASH = "doc_id long, text string, source string, _s string, _id long, _times int, _copy int, _sha string, id long, row string, key long, digest string, sha string, times int"


def clashing(spark, rows):
    return spark.createDataFrame([(d, t, s, "a", 1, 2, 3, "b", 4, "c", 5, "d", "e", 6) for d, t, s in rows], CLASH)


def test_stages_take_odd_tables(spark):
    import corpus_pipeline

    base = " ".join(f"w{i}" for i in range(80))
    rows = [(1, base, "a"), (2, base, "a"), (3, base + " x", None), (None, base, "b"), (4, None, "a"), (5, "", None), (3, base + " x", None), (6, " ".join(f"z{i}" for i in range(70)), "a")]
    df = clashing(spark, rows)
    assert got(quality_rules.drop_failing(df), "doc_id") == [(1,), (2,), (3,), (3,), (6,), (None,)]
    assert got(exact_dedup.drop_copies(df), "doc_id") == [(2,), (3,), (5,), (6,)]
    assert got(jaccard_join.keep_one(df), "doc_id") == [(1,), (4,), (5,), (6,)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, "").columns == df.columns, name
        none = stage(spark, df.limit(0), "")
        assert none.columns == df.columns and none.count() == 0, name
    assert corpus_pipeline.encode(spark, df, "").count() == len(rows) and corpus_pipeline.encode(spark, df.limit(0), "").count() == 0
    taken = got(source_mix.apply_mix(df), "doc_id", "_copy")
    assert taken and {c for _, c in taken} == {3}


def test_mix_of_null_and_empty_arrays(spark):
    rows = [(1, "w w w", None), (2, "w w", []), (3, "w", ["a", None]), (4, "w w", ["a"])]
    out = {x["doc_id"]: x for x in source_mix.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source array<string>")).collect()}
    assert out[2]["taken"] == 0 and out[2]["source_size"] == 0 and out[1]["source_size"] == 4 and len(out) == 4


def test_long_texts(spark):
    r = random.Random(14)
    unbroken = "".join(r.choice("abcdefgh") for _ in range(200_000))
    words = " ".join(f"w{r.randint(0, 30_000)}" for _ in range(60_000))
    rows = [(1, unbroken), (2, words), (3, words + " again"), (4, unbroken[:150_000] + words[:1000])]
    df = frame(spark, rows)
    out = got(repeated_passages.remove_repeats(df), "doc_id", "n_removed")
    assert out[0] == (1, 0) and out[1] == (2, 0) and out[2][1] >= len(words) and out[3][1] == 151_000
    assert [x[2] for x in got(jaccard_join.near_duplicates(df))] == [1, 2, 2, 4]
    other = library()
    assert got(byte_bpe.encode_decode(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, ("n_tokens",))) == [(d, len(other.encode_ordinary(t))) for d, t in rows]
    assert [x[1] for x in got(quality_rules.quality_rules(df), "doc_id", "kept")] == [False, True, True, True]
