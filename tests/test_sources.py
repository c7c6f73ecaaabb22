import zipfile

from tracewell.sources import files

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def p(text, style=None):
    s = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{s}<w:r><w:t>{text}</w:t></w:r></w:p>"


def docx(path):
    cell = lambda x: f"<w:tc>{p(x)}</w:tc>"
    table = f"<w:tbl><w:tr>{cell('K')}{cell('V')}</w:tr><w:tr>{cell('a')}{cell('')}</w:tr></w:tbl>"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{p('Title', 'H1')}{p('Some body text')}{p('- item')}{table}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>')
        z.writestr("word/header1.xml", f"<w:hdr {W}>{p('Top line')}</w:hdr>")


def test_word_files(spark, tmp_path):
    docx(tmp_path / "a.docx")
    docx(tmp_path / "~$a.docx")
    (tmp_path / "bad.DOCX").write_bytes(b"no zip")
    (tmp_path / "c.txt").write_text("x")
    got = {r["filename"]: r for r in files.docx_documents(files.scan(spark, str(tmp_path))).collect()}
    assert set(got) == {"a.docx", "bad.DOCX"}
    a = got["a.docx"]
    assert a["full_text"] == "Top line\n\nTitle\n\nSome body text\n\n- item\n\nK\n\nV\n\na"
    assert (a["headings"], a["lists"], a["paragraphs"], a["headers_footers"]) == (["Title"], ["- item"], ["Some body text"], ["Top line"])
    t = a["tables"][0]
    assert (t["rows"], t["cols"], t["headers"], t["flat_text"]) == (2, 2, ["K", "V"], "K V a")
    assert a["section_count"] == 2 and a["page_count"] == 1 and len(a["fingerprint"]) == 64
    assert got["bad.DOCX"]["full_text"] == "[Unreadable Document: bad.DOCX]"
    assert files.scan(spark, str(tmp_path / "missing")).count() == 0


def test_page_rows_with_recognition(spark):
    kind = "filepath string, page_num int, text string, images int, image binary, blocks array<struct<text:string,max_font:double,bold:boolean>>, cells array<array<array<string>>>"
    rows = [
        ("f", 2, "", 1, bytearray(b"i"), [], []),
        ("f", 1, "A page with enough text to be read.", 0, None, [("Head", 16.0, False), ("- x", 9.0, False), ("Body", 9.0, False)], [[["h"], [None]]]),
    ]
    r = files.page_documents(spark.createDataFrame(rows, kind), ocr=lambda b: "recognised").first()
    assert r["full_text"] == "A page with enough text to be read.\n\nrecognised"
    assert (r["headings"], r["lists"], r["paragraphs"], r["is_scanned_pdf"]) == (["Head"], ["- x"], ["Body"], True)
    assert [x["page_num"] for x in r["pages"]] == [1, 2] and r["pages"][0]["tables"][0]["flat_text"] == "h"


def test_html_is_escaped(spark):
    d = spark.createDataFrame([("f", ["a<b"], ["p & q"], [])], "filepath string, headings array<string>, paragraphs array<string>, tables array<struct<cell_text:array<array<string>>>>")
    assert files.render_html(d).first()["html"] == "<h2>a&lt;b</h2><p>p &amp; q</p>"


def test_word_files_are_rendered_in_order_with_runs_and_merged_cells(spark, tmp_path):
    import zipfile

    from tracewell.sources import files

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda text, style="": f'<w:p>{f"""<w:pPr><w:pStyle w:val="{style}"/></w:pPr>""" if style else ""}<w:r>{text}</w:r></w:p>'
    t = lambda x: f"<w:t>{x}</w:t>"
    cell = lambda x, more="": f"<w:tc><w:tcPr>{more}</w:tcPr>{p(t(x))}</w:tc>"
    table = "<w:tbl><w:tr>" + cell("a", '<w:gridSpan w:val="2"/>') + "</w:tr><w:tr>" + cell("b") + cell("c") + "</w:tr><w:tr>" + cell("", "<w:vMerge/>") + cell("d") + "</w:tr></w:tbl>"
    body = p(t("Top"), "Heading1") + p(t("x") + "<w:tab/>" + t("y") + "<w:br/>" + t("z")) + p(t("Sub"), "Heading2") + p(t("- item")) + table
    styles = "".join(f'<w:style w:styleId="Heading{i}"><w:name w:val="heading {i}"/></w:style>' for i in (1, 2))
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles {w}>{styles}</w:styles>")
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    got = {r["filepath"].rsplit("/", 1)[1]: r["html"] for r in files.render_files(files.scan(spark, str(tmp_path))).collect()}
    assert got["broken.docx"] == "<p>[Unreadable Document: broken.docx]</p>"
    assert got["d.docx"].split("\n", 1)[0] == "<h1>Top</h1>" and "<p>x\ty\nz</p>\n<h2>Sub</h2>\n<p>- item</p>\n" in got["d.docx"]
    rows = [["a", "a"], ["b", "c"], ["b", "d"]]
    assert files.docx_documents(files.scan(spark, str(tmp_path))).where("filename = 'd.docx'").first()["tables"][0]["cell_text"] == rows


def test_structured_documents_of_pages(spark, tmp_path):
    from tracewell.sources.testdata import structured_documents

    html = """<html><script>var x = "<p>no</p>";</script><header>Top <b>line</b></header><p>Before.</p><h1>One</h1><p>First  part.</p>
    <ul><li>a</li><li>b c</li></ul><h2>Two</h2><table><tr><th>H1</th><th>H2</th></tr><tr><td>1</td><td>2</td></tr></table><footer>End</footer></html>"""
    rows = [(1, "http://x/y/a.html", html), (2, "http://x/b", None), (3, None, "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["doc_id"]: r for r in structured_documents(spark, str(tmp_path)).collect()}
    d = got[1]
    assert d["headings"] == ["One", "Two"] and d["paragraphs"] == ["Before.", "First part."] and d["lists"] == ["a", "b c"]
    assert d["headers_footers"] == ["Top line", "End"] and d["filename"] == "a.html" and d["section_count"] == 3
    t = d["tables"][0]
    assert (t["rows"], t["cols"], t["headers"], t["flat_text"]) == (2, 2, ["H1", "H2"], "H1 H2 1 2") and t["cell_text"] == [["H1", "H2"], ["1", "2"]]
    assert [p["text"] for p in d["pages"]] == ["Top line Before.", "One First part. a b c", "Two H1 H2 1 2 End"] and d["page_count"] == 3
    assert d["pages"][2]["headings"] == ["Two"] and len(d["pages"][2]["tables"]) == 1 and "no" not in d["full_text"].split()
    assert got[2]["full_text"] == got[3]["full_text"] == "" and got[2]["headings"] == []


def test_structured_pages_are_compared_by_all_their_parts(spark):
    from tracewell.queries import structured_search

    rows = structured_search(spark, "/root/testdata/sf0.001").collect()
    own = [r for r in rows if r["query_id"] == r["doc_id"]]
    assert len(rows) == 15 and len(own) == 3
    for r in own:
        scores = r["component_scores"]
        assert r["verified_source"] and not r["rejected"] and r["overall_score"] == r["text_coverage"] == r["front_coverage"] == 100
        assert scores["headings"] == scores["paragraphs"] == scores["headers_footers"] == scores["structure"] == 100
