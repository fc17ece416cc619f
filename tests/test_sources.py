"""Extraction of plain text, article XML and scans."""

import json

import pytest

from tessera.sources import ocr, plain, replay, tables


def test_charsets():
    assert plain.decode("é".encode()) == ("é", "utf-8", 0) and plain.decode(b"\xef\xbb\xbfa")[2] == 3
    assert plain.decode(b"\xff\xfea\0") == ("a", "utf-16-le", 2)
    assert plain.decode(b"caf\xe9", markup=True)[0] == "café" and plain.decode(b"caf\xe9", "utf-8", override="latin1")[0] == "café"
    assert plain.decode(b'<meta charset="iso-8859-1">\xe9', markup=True)[0].endswith("é")
    for bad in ((b"caf\xe9",), (b"a\x01",), (b"a", "koi8"), (b"\xef\xbb\xbfa", "latin1"), (b"\xff\xfea\0", "utf-16be"), (b"\xe9", "utf-8", True)):
        with pytest.raises(ValueError):
            plain.decode(*bad)


def test_detection():
    assert [plain.detect(x) for x in (b"<?xml version='1.0'?><article>", b"<!DOCTYPE html><p>", b"plain", b"a <div class=x> b")] == ["jats", "html", "txt", "html"]
    assert plain.detect(b"words", "text/html; charset=utf-8") == "html"
    for bad in ((b"<?xml version='1.0'?><other/>",), (b"%PDF-1.7",), (b"  ",), (b"x", "image/png"), (b"x" * (plain.LARGEST + 1),), (b"<!odd thing>",)):
        with pytest.raises(ValueError):
            plain.detect(*bad)


def test_text_blocks_keep_bytes():
    raw = "﻿ACONITUM\n\nFürst paragraph\nof two lines.\n\nHead: pain é\n\n".encode() + b"x" * 4000
    rows = plain.text_blocks(raw)
    assert [(k, h) for k, h, *_ in rows][:3] == [("heading", ""), ("paragraph", "ACONITUM"), ("heading", "")] and len(rows) == 6
    assert all(raw[a:b].decode() == t for _, _, t, a, b in rows)


ARTICLE = """<article><front><article-title>Títle</article-title><abstract><p>Short.</p></abstract><funding-group>Paid</funding-group></front><body><sec><title>Methods</title><p>One <i>two</i> three.</p>
<sec><title>Doses</title><table-wrap><table><tr><th>A</th><th>B</th></tr><tr><td><p>1</p></td><td>2 x</td></tr></table><table-wrap-foot>Note</table-wrap-foot></table-wrap></sec><fig><caption><p>Seen</p></caption><graphic href="f.png"/></fig><fig>none</fig></sec></body>
<back><ack>Thanks</ack><ref-list><title>References</title><ref><p>Author</p> 1999</ref></ref-list></back></article>""".encode()


def test_article_blocks():
    rows = plain.article_blocks(ARTICLE)
    assert [(k, h, t) for k, h, t, *_ in rows] == [
        ("heading", "Títle", "Títle"), ("paragraph", "", "Short."), ("funding", "", "Paid"), ("heading", "Methods", "Methods"), ("paragraph", "Methods", "One two three."), ("heading", "Doses", "Doses"),
        ("table", "Methods / Doses", "A | B |\n1 | 2 x |"), ("table_footnote", "Methods / Doses", "Note"), ("paragraph", "Methods", "Seen"), ("caption", "Methods", "Seen"), ("figure", "Methods", "Seen [image reference: f.png]"), ("acknowledgment", "", "Thanks"), ("reference", "", "Author 1999"),
    ]
    assert all(ARTICLE[a : a + 1] == b"<" and ARTICLE[b - 1 : b] == b">" for *_, a, b, _ in rows) and [x for *_, x in rows if x] == ["figure", "reference"]
    for bad in (b"<other/>", b"<article><!ENTITY x 'y'></article>", b"<article><p>open</article>", b"<article>" + b"<sec>" * 70, b"<article/>"):
        with pytest.raises(ValueError):
            plain.article_blocks(bad)


def test_documents(spark, tmp_path):
    page = "<html><head><title>Ä b</title></head><body><p>É one</p><table><tr><td>ü</td></tr></table>"
    files = {"a.xml": ARTICLE, "b.html": page.encode("cp1252"), "c.txt": "HEAD LINE\n\nwörds".encode(), "d.html": page.encode("utf-16"), "e.bin": b"%PDF-", "f.txt": b"  "}
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    rows = {r.path.rpartition("/")[2]: r for r in plain.documents(tables.originals(spark, str(tmp_path / "*"))).collect()}
    assert {n: (r.format, r.charset, r.title) for n, r in rows.items()} == {"a.xml": ("jats", "utf-8", "Títle"), "b.html": ("html", "cp1252", "Ä b"), "c.txt": ("txt", "utf-8", ""), "d.html": ("txt", "utf-16-le", ""), "e.bin": (None, None, None), "f.txt": (None, None, None)}
    assert [files["b.html"][b.start : b.end].decode("cp1252") for b in rows["b.html"].blocks] == ["<p>É one</p>", "<td>ü</td>"] and rows["e.bin"].problem


def test_manifests_and_reports(spark, tmp_path):
    files = spark.createDataFrame([("a", 1, "aa"), ("b", 2, "bb"), ("c", 3, "cc"), ("x", 1, "xx")], "path string, length long, sha256 string")
    manifest = spark.createDataFrame([("a", 1, "AA"), ("b", 9, "bb"), ("c", 3, "dd"), ("y", 1, "yy")], "path string, bytes long, sha256 string")
    assert {r.path: r.problem for r in tables.manifest_problems(files, manifest).collect()} == {"b": "size", "c": "content", "x": "not listed", "y": "missing"}
    maps = [("good", i) for i in range(3)] + [("late", 1), ("late", 2), ("twice", 0), ("twice", 0), ("gap", 0), ("gap", 2)]
    assert {r.source: r.problem for r in tables.page_map_problems(spark.createDataFrame(maps, "source string, page int")).collect()} == {"late": "start", "twice": "repeated", "gap": "gap"}
    for n in (1, 2):
        tables.report(spark.range(n), str(tmp_path / "report"))
        assert spark.read.json(str(tmp_path / "report")).count() == n and not (tmp_path / "report.part").exists()


def test_saved_answers(spark, tmp_path):
    search = {"response": {"numFound": 3, "docs": [{"identifier": "plants01", "title": ["A", "B"], "year": 1900}, {"identifier": "../odd", "title": "x"}, {"identifier": "b", "creator": " C "}]}}
    item = {"metadata": {"title": "T", "date": "1901", "creator": ["D", "E"]}, "files": [{"name": "a.PDF", "size": "10", "source": "original"}, {"name": "../b.pdf", "size": "10"}, {"name": "c.pdf", "size": "0"}, {"name": "d.pdf", "size": "9", "private": "true"}, {"name": "e.txt", "size": "9"}]}
    shut = {"metadata": {"title": "S", "access-restricted-item": "true"}, "files": [{"name": "a.pdf", "size": "10"}]}
    papers = {"resultList": {"result": [{"id": "1", "doi": "10.1234/AB", "pmid": "1", "pmcid": "77", "title": "A  b", "authorString": "P Q", "pubYear": "2001"}]}}
    others = {"message": {"items": [{"DOI": "10.5555/z", "title": ["Z"], "author": [{"given": "A", "family": "B"}, {"family": "C"}], "issued": {"date-parts": [[1999, 2]]}}]}}
    for name, x in {"s": search, "i": item, "j": shut, "p": papers, "q": others}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(x))
    read = lambda name: replay.answers(spark, str(tmp_path / f"{name}.json"))
    assert [(r.identifier, r.title, r.creator, r.year, r.total) for r in replay.archive_works(read("s")).collect()] == [("plants01", "A, B", "", "1900", 3), ("b", "", "C", "", 3)]
    assert [(r.title, r.creator, r.year, [(f.name, f.bytes) for f in r.pdfs]) for r in replay.archive_items(read("[ij]")).orderBy("title").collect()] == [("S", "", "", []), ("T", "D, E", "1901", [("a.PDF", 10)])]
    got = sorted((r.provider, r.doi, r.pmid, r.pmcid, r.title, r.authors, r.year) for r in replay.paper_works(read("[pq]")).collect())
    assert got == [("crossref", "10.5555/z", None, None, "Z", "A B, C", 1999), ("europepmc", "10.1234/ab", "1", "PMC77", "A b", "P Q", 2001)]


def test_more_catalogues(spark):
    from tessera.sources import catalogues as C

    xml = """<?xml version="1.0"?><PubmedArticleSet><PubmedArticle><MedlineCitation><PMID Version="1">11</PMID><Article><Journal><JournalIssue><PubDate><Year>2003</Year></PubDate></JournalIssue></Journal>
<ArticleTitle>Moss on <i>walls</i> &amp; stones </ArticleTitle><Abstract><AbstractText Label="A">First.</AbstractText><AbstractText>Second.</AbstractText></Abstract><AuthorList><Author><LastName>Fern</LastName><ForeName>Anna</ForeName></Author><Author><LastName>Moss</LastName></Author></AuthorList>
<PublicationTypeList><PublicationType UI="D1">Review</PublicationType><PublicationType>Trial</PublicationType></PublicationTypeList></Article></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType="pubmed">11</ArticleId><ArticleId IdType="doi">10.1234/AB</ArticleId><ArticleId IdType="pmc">PMC7</ArticleId></ArticleIdList></PubmedData></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>12</PMID><Article><ArticleTitle>Alone</ArticleTitle></Article></MedlineCitation></PubmedArticle></PubmedArticleSet>"""
    semantic = '{"total":2,"next":1,"data":[{"paperId":"p1","title":" A  b","year":1999,"authors":[{"name":"A B"},{"name":"C"}],"publicationTypes":["Review"],"externalIds":{"DOI":"10.2345/X","PubMed":"5","PubMedCentral":"8"},"abstract":"t"},{"paperId":"p2"}]}'
    cite = '{"data":{"attributes":{"doi":"10.3456/y","titles":[{"title":"T"}],"creators":[{"name":" "},{"givenName":"A","familyName":"B"},{"name":"C, D"}],"publicationYear":2001,"types":{"resourceTypeGeneral":"Dataset"}}}}'
    pay = '{"doi":"10.4567/Z","is_oa":true,"best_oa_location":{"url_for_pdf":"https://h.org/a.pdf","url_for_landing_page":"https://h.org/a","version":"v"},"oa_locations":[{"url_for_pdf":"https://h.org/a.pdf","url_for_landing_page":"http://h.org/b"},{"url_for_landing_page":"https://u@h.org/c"},{"url_for_pdf":"https://i.org/d.pdf","license":"cc-by"}]}'
    saved = spark.createDataFrame([("x", xml), ("s", semantic), ("c", cite), ("n", cite.replace('"T"', '" "')), ("u", pay), ("v", '{"doi":"10.5678/q"}'), ("bad", "<<{{")], "path string, raw string")
    row = lambda r: (r.path, r.position, r.native_id, r.doi, r.pmid, r.pmcid, r.title, r.authors, r.year, r.kind, r.abstract)
    got = sorted(map(row, C.pubmed_works(saved).collect()))
    assert got[0] == ("x", 0, "11", "10.1234/ab", "11", "PMC7", "Moss on walls & stones", "Anna Fern, Moss", 2003, "Review, Trial", "First. Second.")
    assert got[1][:7] == ("x", 1, "12", None, "12", None, "Alone") and got[1][8] is None and len(got) == 2
    got = sorted(map(row, C.semantic_works(saved).collect()), key=str)
    assert got[0] == ("s", 0, "p1", "10.2345/x", "5", "PMC8", "A b", "A B, C", 1999, "Review", "t") and got[1][:4] == ("s", 1, "p2", None)
    assert [row(r)[:9] for r in C.datacite_works(saved).collect()] == [("c", 0, "10.3456/y", "10.3456/y", None, None, "T", "A B, C, D", 2001)]
    got = sorted((r.path, r.doi, r.open, r.place, r.format, r.url, r.license) for r in C.open_locations(saved).collect())
    assert got == [("u", "10.4567/z", True, 0, "pdf", "https://h.org/a.pdf", None), ("u", "10.4567/z", True, 1, "landing", "https://h.org/a", None), ("u", "10.4567/z", True, 2, "pdf", "https://i.org/d.pdf", "cc-by"), ("v", "10.5678/q", False, None, None, None, None)]


def test_pages_follow_their_tokens(spark):
    from tessera.sources import catalogues as C

    rows = [("a", None, "t1"), ("a", "t1", "t2"), ("a", "t2", None), ("b", "", "u1"), ("b", "u2", "u3"), ("b", "u3", None), ("c", None, "w"), ("c", "w", "w")]
    got = {(r.search, r.token or "", r.number) for r in C.unbroken(spark.createDataFrame(rows, "search string, token string, next string")).collect()}
    assert got == {("a", "", 0), ("a", "t1", 1), ("a", "t2", 2), ("b", "", 0), ("c", "", 0), ("c", "w", 1)} or got == {("a", "", 0), ("a", "t1", 1), ("a", "t2", 2), ("b", "", 0), ("c", "", 0)}


def test_scans():
    alto = b"<alto xmlns='x'><TextLine><String CONTENT='a'/><SP/><String CONTENT='b'/></TextLine><TextLine><String CONTENT='c'/></TextLine></alto>"
    assert ocr.alto_text(alto) == "a b\nc\n"
    assert ocr.grey_measures(b"P5\n# made\n2 2\n255\n\x00\xff\xff\xff") == (0.25, 0.0)
    with pytest.raises(ValueError):
        ocr.grey_measures(b"P5 9 9 255 x")
    image = b"P5 3 3 255\n" + bytes([0, 0, 0, 0, 90, 90, 0, 90, 200])
    dark, edges = ocr.grey_measures(image)
    assert dark == 8 / 9 and edges == 4 / 9
    for wrong in (image + b"x", b"P5 3 3 255\t" + image[11:], b"P2" + image[2:]):
        with pytest.raises(ValueError):
            ocr.grey_measures(wrong)
