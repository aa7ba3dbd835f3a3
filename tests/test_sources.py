import io
import json
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.plans import evaluation, runs
from quern.sources import crawl, extract, store, urls
from quern.streaming import ledger

POLICY = {"law.example": [r"/doc/\d+", "/start"]}


@pytest.mark.parametrize(
    "url,ok",
    [("https://law.example/doc/1", 1), ("https://law.example:443/doc/1", 1), ("https://LAW.example/start", 1), ("http://law.example/doc/1", 0), ("https://sub.law.example/doc/1", 0), ("https://law.example.evil/doc/1", 0),
     ("https://u@law.example/doc/1", 0), ("https://law.example:8443/doc/1", 0), ("https://law.example/doc/../doc/1", 0), ("https://law.example/%2e%2e/doc/1", 0), ("https://law.example/doc%2f1", 0), ("https://law.example/doc/%2525", 0),
     ("https://law.example/doc/1?x=1", 0), ("https://law.example/doc/1#a", 0), ("https://law.example/other", 0), ("https://law.example/list?p=2", 1), (None, 0), ("", 0)],
)
def test_allowed(rows, url, ok):
    assert rows("u string", (url,)).select(urls.allowed(F.col("u"), POLICY, ["https://law.example/list?p=2"])).first()[0] is bool(ok)


def test_links_and_limits(rows):
    html = '<a href="/doc/2#x">Two</a> <A HREF=\'doc/3\'><b>Th</b>ree</a><a href="/doc/2">again</a><a name=x>no</a><a href="/other">o</a>'
    found = urls.links(rows("page_id string, url string, html string", ("p", "https://law.example/start", html), ("q", "https://law.example/", None)))
    assert [(r["url"], r["link_text"]) for r in found.orderBy("pos").collect()] == [("https://law.example/doc/2", "Two"), ("https://law.example/doc/3", "Three"), ("https://law.example/other", "o")]
    kept, rest = urls.capped_links(found, [(r"https://law\.example/doc/.*", 5), (".*", 50)], 2)
    assert {r["url"] for r in kept.collect()} == {"https://law.example/doc/2", "https://law.example/doc/3"} and [tuple(r) for r in rest.collect()] == [("p", "LINK_LIMIT", 1)]
    assert [tuple(r) for r in urls.added_only(rows("key string, value string", ("a", "1")), rows("key string, value string", ("a", "2"))).collect()] == [("a", "1")]


def test_crawl(spark, rows):
    site = {"https://law.example/start": '<a href="/doc/1">a</a><a href="/doc/2">b</a><a href="http://evil/">e</a><a href="/doc/1">a</a>', "https://law.example/doc/1": '<a href="/start">back</a><a href="/doc/3">c</a>', "https://law.example/doc/3": "end"}

    def fetch(wave):
        def get(batches):
            for b in batches:
                yield pd.DataFrame({"url": b["url"], "html": [site.get(u) for u in b["url"]], "code": [None if u in site else "HTTP_STATUS" for u in b["url"]]})

        return wave.mapInPandas(get, "url string, html string, code string")

    start = rows("url string", ("https://law.example/start",))
    docs, failures = crawl.crawl(start, fetch, POLICY, [(".*", 50)])
    assert [(r["url"][-6:], r["depth"]) for r in docs.orderBy("depth", "url").collect()] == [("/start", 0), ("/doc/1", 1), ("/doc/3", 2)]
    assert {(r["url"], r["code"]) for r in failures.collect()} == {("http://evil/", "URL_POLICY"), ("https://law.example/doc/2", "HTTP_STATUS")}
    one, limit = crawl.crawl(start, fetch, POLICY, [(".*", 50)], max_documents=1)
    assert one.count() == 1
    d = crawl.depths(rows("url string, observed_from string", ("a", None), ("b", "a"), ("c", "b"), ("z", "y")), "a")
    assert {tuple(r) for r in d.collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_html():
    html = '<title>My  law</title><nav>menu</nav><p>a<br>b</p><script>x</script><table><tr><th colspan=2>h</th></tr><tr><td>1</td><td rowspan="2">2</td></tr></table><p>x<img src=f>y</p><div hidden>z</div>'
    text, title, issue = extract.html_text(html)
    assert title == "My law" and issue is None
    assert text.split("\n") == ["a", "b", '<th colspan="2">h', '1\t<td rowspan="2">2', "x[GAP: img]y", "[GAP: div]"]
    assert extract.html_text('<div id="c"><p>in</p></div><p>out', ("div", "c"))[0] == "in" and extract.html_text("<p class=x>a</p><p>b", removed=(".x",))[0] == "b"
    assert extract.html_text("a�")[2] == "undecodable" and extract.html_text("<p> ")[2] == "empty" and extract.html_text(None)[2] == "empty"


def test_references_that_are_cut_off():
    html = '<title>a&amp;&amp</title><p>b&amp;&am</p>c&ampamp; &lt &notit; &#38; &#38 &x26; &nbsp;&eacute;&ampd; R&D<a href="?a=1&copy=2">e</a>'
    assert extract.html_text(html, terminated=True) == ("b&&am\nc&ampamp; &lt &notit; & &#38 &x26; é&ampd; R&De", "a&&amp", None)
    assert extract.html_text(html)[1] == "a&&"


def docx(body, **parts):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        for name, xml in parts.items():
            z.writestr(f"word/{name}.xml" if "." not in name else name, f"<w:{name} {w}>{xml}</w:{name}>")
    return out.getvalue()


def test_docx(rows):
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    table = f"<w:tbl><w:tr><w:tc>{p('A')}</w:tc><w:tc>{p('B')}</w:tc></w:tr></w:tbl>"
    note = f'<w:footnote w:id="2">{p("two")}</w:footnote>'
    raw = docx(p("x") + table + '<w:p><w:r><w:footnoteReference w:id="2"/></w:r></w:p><w:p><w:r><w:drawing/></w:r></w:p>', footnotes=note)
    text, issue = extract.docx_text(raw)
    assert issue is None and text.split("\n") == ["x", "A\tB", "[footnote 2]", "[GAP: drawing]", "[footnote 2] two"]
    assert extract.docx_text(docx("<w:ins/>"))[1] == "tracked changes" and extract.docx_text(docx("<w:p><w:r><w:rPr><w:vanish/></w:rPr></w:r></w:p>"))[1] == "hidden text"
    both = '<mc:AlternateContent xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"><mc:Fallback>' + p("old") + "</mc:Fallback><mc:Choice>" + p("new") + "</mc:Choice></mc:AlternateContent>"
    assert extract.docx_text(docx(both)) == ("new", None)
    assert extract.docx_text(docx("<w:r>" * 3000 + "</w:r>" * 3000))[1] == "nested too deep"
    assert extract.docx_text(b"no zip")[1] == "not a document" and extract.docx_text(None)[1] == "empty"
    assert rows("raw binary", (raw,), (None,)).select(extract.docx_extracted("raw").alias("x")).select("x.issue").collect() == [(None,), ("empty",)]


def test_pages_plain_text_and_routing(rows):
    r = extract.paged_text(rows("id int, page int, text string, graphics boolean", (1, 1, "one", False), (1, 2, " ", None), (1, 3, "x�", None), (2, 1, "", None))).orderBy("id").collect()
    assert r[0]["text"] == "[PDF PAGE 1]\none\n[PDF PAGE 2]\n[GAP: page]\n[PDF PAGE 3]\n[GAP: page]\n" and r[0]["n_unreadable"] == 2 and r[1]["issue"] == "no readable page"
    assert r[0]["text"][r[0]["boundaries"][1]["start"] :].startswith("[PDF PAGE 2]")
    x = rows("raw binary", ("é".encode(),), (b"\xff",), (b" ",)).select(extract.plain_extracted(F.col("raw")).alias("x")).select("x.*").collect()
    assert [tuple(v) for v in x] == [("é", None), (None, "undecodable"), (None, "empty")]
    k = rows("m string, u string", ("text/html", "x"), (None, "a/b.DOCX"), ("application/pdf", ""), ("text/plain", ""), ("image/png", "x")).select(extract.extractor_of(F.coalesce("m", F.lit("")), F.col("u"))).collect()
    assert [v[0] for v in k] == ["html", "docx", "pdf", "text", None]


def test_json_files(spark, tmp_path):
    path = str(tmp_path / "q.json")
    store.save_json(path, [{"no": 2, "family": "F"}, {"no": 1, "family": "G", "other": 1}])
    schema = StructType.fromDDL("no int, family string")
    assert [r["no"] for r in store.read_json(spark, path, schema).orderBy("no").collect()] == [1, 2]
    assert [r["keys"] for r in store.unknown_keys(spark, path, schema).collect()] == [["other"]]
    assert json.loads((tmp_path / "q.json").read_text())[0]["no"] == 2 and len(list(tmp_path.iterdir())) == 1


def test_blobs_and_paths(tmp_path):
    path = str(tmp_path / "b")
    store.write_once(path, b"x")
    store.write_once(path, b"x")
    with pytest.raises(FileExistsError):
        store.write_once(path, b"y")
    assert (tmp_path / "b").read_bytes() == b"x"
    (tmp_path / "link").symlink_to("/etc")
    assert store.safe_path(str(tmp_path), "a/b").endswith("a/b")
    for bad in ("/etc", "../x", "a/../../x", "link/passwd", "", ".", "a\\b"):
        with pytest.raises(ValueError):
            store.safe_path(str(tmp_path), bad)
    assert store.canonical_hash({"b": 1, "a": 2}) == store.canonical_hash({"a": 2, "b": 1})


def test_inventory(spark, rows):
    import hashlib

    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    url = "https://law.example/doc/1"
    own = "s_" + h(url)[:20]
    schema = "id string, url string, sha256 string, text_sha256 string, boundaries array<struct<start:int,`end`:int>>, extraction_gaps array<string>, partial boolean"
    docs = rows(schema, (own, url, h("raw"), h("text"), [(0, 4)], [], False), ("s_x", url, h("raw"), h("other"), [(0, 9)], ["g"], False))
    blobs = rows("id string, raw binary, text string", (own, b"raw", "text"), ("s_x", b"raw", "text"))
    got = {(r["id"], r["issue"]) for r in store.inventory_issues(docs, blobs, urls.allowed(F.col("url"), POLICY)).collect()}
    assert got == {("s_x", "id is not of url"), ("s_x", "text checksum"), ("s_x", "offsets"), ("s_x", "partial flag")}


def test_verified_texts(spark, rows, tmp_path):
    import hashlib

    for name, raw in {"a": b"good", "b": b"changed", "c": b"\xff", "d": b" "}.items():
        (tmp_path / f"{name}.txt").write_bytes(raw)
    h = lambda b: hashlib.sha256(b).hexdigest()
    inv = rows("id string, text_sha256 string, kind string, title string", ("a", h(b"good"), None, "t"), ("b", h(b"x"), None, "t"), ("c", h(b"\xff"), None, "t"), ("d", h(b" "), None, "t"), ("e", h(b""), "navigation", "t"))
    got = store.verified_texts(spark, str(tmp_path), inv)
    assert {r["id"]: r["issue"] for r in got.collect()} == {"a": None, "b": "checksum", "c": "undecodable", "d": "blank", "e": "no file"}
    assert [tuple(r) for r in store.corpus(inv, got).collect()] == [("a", "t", "good")]


def test_export_orders_by_number(rows):
    q = rows("no int, status string", (2, "validated"), (1, "validated"), (3, "draft"))
    c = rows("question_no int, citation_id string", (1, "C10"), (1, "C2"), (3, "C1"))
    a, b = store.exported(q, c)
    assert [r["no"] for r in a.collect()] == [1, 2] and [r["citation_id"] for r in b.collect()] == ["C2", "C10"]
    w = store.with_citations(q, c).orderBy("no").collect()
    assert [len(r["citations"]) for r in w] == [2, 0, 1] and w[0]["citations"][0]["citation_id"] == "C2"


def test_an_evaluation_run(rows):
    corpus = rows("chunk_id string, source_id string, title string, text string", ("a", "s_a", "T", "the tax rate is ten percent"), ("b", "s_b", "T", "land and water"))
    q = rows("no int, family string, tax_category string, country string, case_year int, question string, answer_value string", (1, "F1", "1000", "KZ", 2020, "what is the tax rate?", "10"), (2, "F2", "2000", "KZ", 2020, "how much land?", None))
    c = rows("question_no int, citation_id string, official_title string, article_section string, supporting_passage string", (1, "C1", "T", "1", "tax rate is ten"))
    data = evaluation.dataset(q, c)
    assert evaluation.dataset(q, c, limit=1).count() == 1 and evaluation.dataset(q, c, families=["F2"]).count() == 1
    with pytest.raises(ValueError):
        evaluation.dataset(q, c, families=["F9"])
    asked = evaluation.prompts(data, ["bm25_rag_cot", "closed_book_program_cot"], evaluation.passages(data, corpus, 1)).cache()
    assert "ten percent" in asked.filter("no = 1 and condition = 'bm25_rag_cot'").first()["prompt"]

    def respond(batches):
        for b in batches:
            yield b.assign(raw_response=["```python\nans = 5 + 5\n```" if "```python" in p else "\\boxed{insufficient information}" if "land" in p.split("[QUESTION]")[1] else "[FINAL ANSWER]: 10 %" for p in b["prompt"]])

    given = evaluation.responses(asked, None, respond)
    done = evaluation.responses(asked, given.withColumn("raw_response", F.when(F.col("raw_response").contains("boxed"), "[EVALUATION ERROR x").otherwise(F.col("raw_response"))), respond)
    assert done.count() == 4
    records = evaluation.answered(asked, done)
    s = {r["condition"]: (r["total"], r["em"]) for r in evaluation.summary(records).collect()}
    assert s == {"bm25_rag_cot": (2, 1.0), "closed_book_program_cot": (2, 0.5)}


def test_run_reports(rows):
    a = rows("family_id string", ("A-F01",), ("A-F02",))
    r = runs.rollup(a, rows("family_id string, status string", ("A-F01", "validated"), ("A-F02", "pending")), rows("no int", (1,)))
    assert tuple(r.first()) == (2, 1, 1, 1, ["A-F02"], False)
    assert runs.countries(r).first()["complete"] is False
    f = runs.routed_feedback(rows("issue string", ("Question 2 is wrong",), ("all",)), rows("question_no int", (1,), (2,)))
    assert {tuple(x) for x in f.collect()} == {(2, "Question 2 is wrong"), (1, "all"), (2, "all")}


def test_ledger_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [("L", "a", "reserve", 20, 1), ("L", "b", "reserve", 90, 2), ("L", "a", "settle", 5, 3), ("L", "c", "reserve", 85, 4), ("M", "d", "reserve", 20, 1)]
    (tmp_path / "in" / "x.json").write_text("\n".join(json.dumps(dict(zip(("ledger", "id", "kind", "tokens", "seq"), r))) for r in rows))
    stream = spark.readStream.schema("ledger string, id string, kind string, tokens long, seq long").json(str(tmp_path / "in"))
    q = ledger.admitted(stream, 2, 100).writeStream.format("memory").queryName("quern_ledger").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {(r["ledger"], r["id"], r["status"]): (r["calls_used"], r["tokens_used"]) for r in spark.table("quern_ledger").collect()}
    assert got == {("L", "a", "pending"): (1, 20), ("L", "b", "refused"): (1, 20), ("L", "a", "completed"): (1, 15), ("L", "c", "pending"): (2, 100), ("M", "d", "pending"): (1, 20)}


def test_resume_and_states(spark, rows, tmp_path):
    batch = rows("key int, v string", (1, "a"), (2, "b"))
    path = str(tmp_path / "done")
    assert ledger.resumed(batch, path, "key").count() == 2
    batch.filter("key = 1").write.parquet(path)
    assert [r["key"] for r in ledger.resumed(batch, path, "key").collect()] == [2]
    s = rows("family string, attempt int, status string, fingerprint string", ("a", 1, "needs_correction", "x"), ("a", 2, "needs_correction", "x"), ("b", 1, "needs_correction", "x"), ("b", 2, "validated", "x"), ("c", 1, "validated", "y"), ("c", 2, "created", "y"))
    assert [r["family"] for r in ledger.repeated_failures(s).collect()] == ["a"]
    assert [tuple(r) for r in ledger.bad_transitions(s).collect()] == [("c", 2, "validated", "created")]
