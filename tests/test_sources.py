from pyspark.sql import functions as F

from sheaf.operators import cleaning as P
from sheaf.operators import documents as D
from sheaf.operators import links as L
from sheaf.sources import landing, tables, xml
from sheaf.streaming import ingest


def test_csv_keeps_newlines_quotes_and_blanks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "b"\nc, d'), (2, "  padded "), (3, None)], "id int, text string")
    tables.write_csv(rows, str(tmp_path / "x"))
    back = tables.read_csv(spark, str(tmp_path / "x"), "id int, text string")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_keyed_json_scan(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"1": {"x": 2},\n "2": "raw text", "3": null}')
    got = {r.id: r.raw for r in tables.read_keyed_json(spark, str(tmp_path / "a.json"), one_per_line=False).collect()}
    assert got == {"1": '{"x":2}', "2": "raw text", "3": None}


def test_large_objects_are_cut_between_members(spark, tmp_path):
    import json
    import random

    pick = random.Random(4)
    odd = ["}", "{", '"', "\\\\", ",", "[", "]", "\\n", "x", ":", "é", "}}", '"}']

    def value(depth):
        kind = pick.randrange(6 if depth else 4)
        if kind < 2:
            return "".join(pick.choices(odd, k=pick.randrange(6)))
        if kind < 4:
            return None if kind == 2 else pick.randrange(99)
        if kind == 4:
            return [value(depth - 1) for _ in range(pick.randrange(3))]
        return {f"k{i}": value(depth - 1) for i in range(pick.randrange(4))}

    want = {}
    for f in range(4):
        data = {f"{f}-{i}": value(3) if pick.random() < 0.4 else {"s": value(2), "t": value(1)} for i in range(120)}
        want |= data
        (tmp_path / f"{f}.json").write_text(json.dumps(data, indent=pick.choice([None, 2]), ensure_ascii=False) + pick.choice(["", "\n"]))
    (tmp_path / "lines.json").write_text('{"l1": {"a": 1}}\n{"l2": {"b": "}"}, "l3": 5}\n{}\n')
    want |= {"l1": {"a": 1}, "l2": {"b": "}"}, "l3": 5}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = tables.read_keyed_json(spark, str(tmp_path), one_per_line=False).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == len(want)

    def read(raw):
        try:
            return json.loads(raw)
        except (TypeError, ValueError):
            return raw

    plain = {k: v if not isinstance(v, str) else read(v) for k, v in want.items()}
    assert {r.id: read(r.raw) for r in got} == plain


def test_tei(spark):
    good = (
        "<TEI><teiHeader><titleStmt><title>A &amp; B</title></titleStmt><abstract><p>Abs</p></abstract></teiHeader>"
        "<text><body><div><head>H</head><p>See <ref>1</ref>.</p></div></body></text></TEI>"
    )
    rows = spark.createDataFrame(
        [("d/7_1.tei.xml", good), ("d/8_1.xml", "<TEI><p>"), ("d/9_1.xml", good.replace("A &amp; B", ""))],
        "path string, content string",
    )
    got = [r[0] for r in rows.select(xml.tei_text(F.col("path"), F.col("content"))).collect()]
    assert got[0] == "Paper #: 7_1\nTitle: A & B\nAbs\nH\nSee 1.\n"
    assert got[1] == ""
    assert got[2].split("\n")[1] == ""


def test_bioc_with_single_and_repeated_children(spark):
    doc = (
        '<collection><document><passage><text>Paper 12</text></passage><passage><text>t</text>'
        '<annotation id="a"><infon key="identifier"/><infon key="type">time</infon><text>5 h</text></annotation>'
        '</passage><relation><infon key="type">test_1</infon><node refid="a"/></relation></document></collection>'
    )
    inner = doc.removeprefix("<collection>").removesuffix("</collection>")
    for content in (doc, inner, '<?xml version="1.0"?>\n' + doc):
        parsed = xml.parse_bioc(spark.createDataFrame([(content,)], "content string"))
        assert xml.bioc_annotations(parsed).collect() == [("12", 1, 1 << 32, "a", "time", None, "5 h")]
        assert xml.bioc_relations(parsed).collect() == [("12", 0, "test_1", "a")]
        assert [r.text for r in xml.bioc_passages(parsed).collect()] == ["Paper 12", "t"]
        assert xml.unparsed(parsed).count() == 0
    two = doc.replace("</collection>", inner.replace("12", "13") + "</collection>")
    files = spark.createDataFrame([(two,), ("<collection/>",), ("no xml",), (None,)], "content string")
    parsed = xml.parse_bioc(files)
    assert [r.paper for r in xml.bioc_annotations(parsed).collect()] == ["12", "13"]
    assert xml.unparsed(parsed).count() == 3


def test_tei_markup_that_is_none(spark):
    body = (
        'a &lt; b &#60; &#x3C; c &amp;lt; <![CDATA[<p> & ]]> <ref target="x>y">1</ref> <!-- no > --> &#8451;'
        "</p><p>next</p>  <p>third"
    )
    tei = f'<t:TEI xmlns:t="u"><t:text><t:body><t:div><t:p>{body}</t:p></t:div></t:body></t:text></t:TEI>'
    tei = tei.replace("</p>", "</t:p>").replace("<p>next", "<t:p>next").replace("<p>third", "<t:p>third")
    rows = spark.createDataFrame([("x.xml", tei), ("y.xml", tei.replace("</t:TEI>", "")), ("z.xml", None)], "path string, content string")
    got = [r[0] for r in rows.select(xml.tei_text(F.col("path"), F.col("content"))).collect()]
    assert got[0].split("\n", 3)[3].split("\n")[0] == "a < b < < c &lt; <p> &  1  \u2103"
    assert [line.strip() for line in got[0].strip().split("\n")[-2:]] == ["next", "third"]
    assert got[1:] == ["", ""]


def test_bioc_collections_are_cut_at_documents(spark, tmp_path):
    def document(i):
        return (
            f"<document><id>{i}</id>\n<passage><sentence><text>No {i}</text><annotation id='s'><infon key='type'>time</infon><text>{i}</text></annotation>"
            "<relation><infon key='type'>r1</infon><node refid='s'/></relation></sentence></passage><passage><text>\u00e9</text>"
            "<relation><infon key='type'>r2</infon><node refid='d'/></relation></passage>"
            "<annotation id='d'><infon key='type'>top</infon><text>x</text></annotation></document>"
        )

    (tmp_path / "many.xml").write_text("<?xml version='1.0'?>\n<collection>" + "\n".join(map(document, range(200))) + "\n</collection>\n")
    (tmp_path / "one.xml").write_text(document(1000))
    (tmp_path / "bad.xml").write_text("<collection>" + document(2000) + "<document><passage></document></collection>")
    (tmp_path / "none.xml").write_text("<collection><source>s</source></collection>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        parsed = xml.read_bioc(spark, str(tmp_path))
        assert parsed.rdd.getNumPartitions() > 10
        notes = xml.bioc_annotations(parsed).collect()
        links = xml.bioc_relations(parsed).collect()
        texts = xml.bioc_passages(parsed).collect()
        unread = [r.path.rsplit("/", 1)[-1] for r in xml.unparsed(parsed).collect()]
        without = sorted(r.path.rsplit("/", 1)[-1] for r in xml.without_records(spark, str(tmp_path), parsed).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    papers = sorted(str(i) for i in [*range(200), 1000, 2000])
    assert sorted(r.paper for r in notes if r.node_id == "s" and r.passage == 0 and r.pos == 0 and r.text == r.paper) == papers
    assert sorted(r.paper for r in notes if r.node_id == "d" and r.passage is None and r.pos == 2 << 32) == papers
    assert sorted((r.paper, r.rel_pos, r.test_name, r.node_id) for r in links) == sorted(
        x for p in papers for x in ((p, 0, "r1", "s"), (p, 1, "r2", "d"))
    )
    assert len(texts) == 2 * len(papers) and {r.text for r in texts if r.passage == 1} == {"\u00e9"}
    assert unread == ["bad.xml"] and without == ["none.xml"]


def test_harvest_stops_at_the_first_empty_page(spark):
    page = '{"message": {"items": [%s]}}'
    item = '{"DOI": "10/%s"}'
    rows = [
        (2024, 0, page % (item % "a" + ', {"URL": "no doi"}')),
        (2024, 1000, page % ""),
        (2024, 2000, page % (item % "late")),
        (2023, 10_000, page % (item % "too far")),
        (2019, 0, page % (item % "too old")),
        (2020, 0, page % (item % "b")),
    ]
    got = landing.land_works(spark.createDataFrame(rows, "year int, offset int, body string"))
    assert sorted(r.DOI for r in got.collect()) == ["10/a", "10/b"]


def test_link_rules(spark):
    html = (
        '<div id="recommended-articles"><a href="/pdf/r.pdf">r</a></div>'
        '<a href="/x/file.pdf">1</a><a href="/x/data.PDF">2</a><a class="c" href=\'http://h/pdf/1?a=1\'>3</a>'
        '<a href="http://h/pdf/1?a=2">4</a><a href="https://scholar.google.com/pdf/">5</a>'
        '<ol class="references"><li><a href="/pdf/ref">6</a></li></ol>'
    )
    pages = spark.createDataFrame([(1, "http://s/a;p?q#f", html), (2, "http://s/b", "<p/>")], "page_id int, url string, html string")
    links = L.full_text_links(L.anchors(pages, L.without_blocks(F.col("html"))))
    firsts = L.first_per_base(links)
    assert sorted(r.href for r in firsts.collect()) == ["/x/data.PDF", "http://h/pdf/1?a=1"]
    # The plain concatenation holds no lower-case marker, so only one is left.
    assert [r.target for r in L.downloadable(firsts).collect()] == ["http://h/pdf/1?a=1"]
    assert [r.page_id for r in L.pages_without_links(pages, links).collect()] == [2]
    assert {r.page_id: r.n_links for r in L.link_counts(pages, firsts).collect()} == {1: 2, 2: 0}


def test_first_three_existing_files(spark):
    papers = spark.createDataFrame([(0,), (1,)], "row long")
    files = spark.createDataFrame(
        [(0, 2, "b"), (0, 5, ""), (0, 6, "f"), (0, 4, "d"), (0, 7, "never")], "row long, i int, text string"
    )
    out = D.attach_files(papers, files, "row").select("row", D.concat_texts(F.col("files")).alias("t"))
    assert dict(out.collect()) == {0: "bd", 1: ""}


def test_expand_tests(spark):
    rows = spark.createDataFrame(
        [(1, "{'time': '5 h', 'humidity': None}", None), (2, "[{'time': 1}, {'time': 2}]", "junk"), (3, None, None)],
        "p int, test_1 string, test_2 string",
    )
    tests, rejected = P.expand_tests(rows, ("test_1", "test_2"))
    assert sorted((r.p, r.time, r.humidity) for r in tests.collect()) == [(1, "5 h", None), (2, "1", None), (2, "2", None)]
    assert [(r.p, r.test, r.cell) for r in rejected.collect()] == [(2, "test_2", "junk")]


def test_repair_reads_the_original_columns(spark):
    rows = spark.createDataFrame([(5.0, None), (5.0, 6.0), (None, None)], "efficiency_cont double, efficiency_tret double")
    got = [(r.efficiency_cont, r.efficiency_tret) for r in P.repair_retained(rows).collect()]
    assert got == [(None, 5.0), (5.0, 6.0), (None, None)]


def test_stream_takes_each_file_once(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = spark.range(1).schema
    for upper in (10, 20):
        spark.range(upper - 10, upper).write.mode("append").parquet(source)
        ingest.append_new_files(spark, source, schema, target)
        assert spark.read.parquet(target).count() == upper


def test_blocks_are_cut_in_one_walk(spark):
    import time

    from sheaf.operators.links import cut_blocks

    nested = '<p>a</p><DIV class="x" ID="r"><div><div >deep</div></div>in</div >b<divan>c</divan><div id="r">open'
    assert cut_blocks(nested, "div", "id", "r") == "<p>a</p>b<divan>c</divan>"
    assert cut_blocks("no tags", "div", "id", "r") == "no tags"
    deep = "<div>" * 50_000 + "x" + "</div>" * 50_000
    page = deep + '<div id="r">' + deep + "</div>" + deep
    started = time.perf_counter()
    assert cut_blocks(page, "div", "id", "r") == deep + deep
    assert time.perf_counter() - started < 5
    rows = spark.createDataFrame([(1, None), (2, ""), (3, nested)], "i int, html string")
    got = [r[0] for r in rows.orderBy("i").select(L.without_blocks(F.col("html"), (("div", "id", "r"),))).collect()]
    assert got == [None, "", "<p>a</p>b<divan>c</divan>"]
