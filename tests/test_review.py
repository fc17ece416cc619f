"""Edited reviews, front matter and the reader; cases of our own."""

import time
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.functions import front
from tessera.functions.review import mapped, plain_lines, rendered, review
from tessera.sources import reader

BLOCKS = ["FOREWORD.", "A stamp of the lender", "MOSS.—(Bryum.)", "Grows on walls. Not seen in sand."]


def kept(edited, originals):
    return [o[s[0] : s[1]] if s else None for o, s in zip(originals, mapped(edited, originals))]


def test_cleaned_text_goes_back_to_its_blocks():
    text = rendered(BLOCKS)
    assert kept(text, BLOCKS) == BLOCKS and rendered(["a", None, "b"]) == "a\n\nb\n\n"
    cleaned = text.replace("A stamp of the lender\n\n", "").replace("Grows on walls. Not seen in sand.", "Grows on walls.")
    assert kept(cleaned, BLOCKS) == ["FOREWORD.", None, "MOSS.—(Bryum.)", "Grows on walls."]
    for bad in (cleaned.replace("Grows on walls.", "Grows on roofs."), cleaned.replace("FOREWORD.\n\n", "") + "\n\nFOREWORD.", cleaned + "more"):
        with pytest.raises(ValueError, match="order and wording"):
            mapped(bad, BLOCKS)
    assert mapped("", BLOCKS) == [None] * 4 == mapped(" \r\n ", BLOCKS)


def test_paragraphs_within_a_block_stay_together():
    blocks = ["One.\n\nTwo.\n\nThree.", "Two.", "Three.\n\nFour."]
    assert kept("One.\n\nTwo.\n\nThree.\n\nFour.", blocks) == ["One.\n\nTwo.\n\nThree.", None, "Four."]
    assert kept("Two.\n\nTwo.\n\nFour.", blocks) == ["Two.", "Two.", "Four."]
    assert kept("ne.\n\nTw", ["One.\n\nTwo."]) == ["ne.\n\nTw"]
    with pytest.raises(ValueError):  # a word cannot be shared by two blocks
        mapped("One. Tw", ["One.", "Two."])


def test_line_ends_of_the_original_stay():
    block = "MOSS.\r\nWall: green.\rSand: none.\n"
    assert plain_lines(block)[0] == "MOSS.\nWall: green.\nSand: none.\n" and len(plain_lines(block)[1]) == len(block)
    assert kept(rendered([block]), [block]) == [block.strip()]
    assert kept("Wall: green.\nSand: none.\n", [block]) == ["Wall: green.\rSand: none."]


def test_reviews_as_a_table(spark):
    blocks = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "c"), (4, 1, None)], "key long, number int, original string")
    edits = spark.createDataFrame([(1, "b"), (2, "x"), (3, ""), (4, None), (5, "y")], "key long, edited string")
    got = {(r.key, r.number): (r.start, r.end, r.excerpt, r.problem and r.problem[:4]) for r in review(blocks, edits).collect()}
    assert got == {(1, 1): (None, None, None, None), (1, 2): (0, 1, "b", None), (2, None): (None, None, None, "keep"), (4, 1): (None, None, None, None), (5, None): (None, None, None, "keep")}


CARD = "Mosses of the  walls / by A.B. Fern.\nContributors\nFern, A. B. 1838-1917.\nPublication/Creation\nLeeds : Moss & Son, 1899.\nPersistent URL\nhttps://wellcomecollection.org/works/abc"
PAGE = "THE BOOK OF FERNS\nBY\nANNA MOSS\nFifth Edition"
COVER = "Moss et al. Systematic Reviews (2023) 12:191\nhttps://doi.org/10.1/x\nRESEARCH Open Access\nGrowth of moss:\n1,2*\nA review of walls\nA. Moss1,2, B. Fern 3* and C. Stone\nAbstract\nBy the wall"


def test_front_matter(spark):
    texts = {"card": CARD, "page": PAGE, "volume": "FERNS OF THE NORTH\nVOLUME ii\nBY THE LATE ANNA MOSS", "cover": COVER, "none": "", "odd": "Digitized by Google\nhttp://x.org/aaaa\nby Anna\nCopyright 1900 by X\nshort\nA good long title.", "long": "x" * 200 + "\nBy " + "A" * 400}
    rows = spark.createDataFrame(list(texts.items()), "k string, t string").select("k", front.front_matter(F.col("t")).alias("f")).select("k", "f.*")
    got = {r.k: tuple(r)[1:] for r in rows.collect()}
    assert got["card"] == ("Mosses of the walls", "A. B. Fern", "", "Leeds : Moss & Son, 1899", "Wellcome Collection", "https://wellcomecollection.org/works/abc")
    assert got["page"] == ("THE BOOK OF FERNS", "ANNA MOSS", "Fifth Edition", "", "", "")
    assert got["volume"][:3] == ("FERNS OF THE NORTH", "ANNA MOSS", "Volume II")
    assert got["cover"] == ("Growth of moss: A review of walls", "A. Moss1,2, B. Fern and C. Stone", "", "Moss et al. Systematic Reviews (2023) 12:191", "Systematic Reviews / BMC", "https://doi.org/10.1/x")
    assert got["none"] == ("",) * 6 and got["long"][:2] == ("", "")
    assert got["odd"][:2] == ("A good long title", "Google")


def test_front_pages_of_scans(spark):
    rows = [("a", 0, "1", "text"), ("a", 1, "A TITLE OF LENGTH\nsecond edition", "text"), ("a", 2, "by\nAnna Fern", "ocr"), ("a", 1, "x", "ocr"), ("b", 7, "A LATE TITLE", "text"), ("b", 0, "THE OCR TITLE", "ocr"), ("b", 1, "ANOTHER TITLE\nby Bo", "ocr"), ("b", 4, "third edition", "ocr")]
    got = {r.source: (r.title, r.author, r.edition) for r in front.of_scans(spark.createDataFrame(rows, "source string, page int, text string, read string")).collect()}
    assert got == {"a": ("A TITLE OF LENGTH", "Anna Fern", "second edition"), "b": ("THE OCR TITLE", "Bo", "")}


def test_shown_markup_keeps_type_and_nothing_active():
    page = """<html><head><title>T</title><style>p{background:url(https://spy.example/x)}</style></head><body onload=x()><h2 id="part">Moss &amp; fern</h2><dir><li><font color="red"><i>Bry.</i></font> plain <b>bold</b></li></dir>
<a href="https://spy.example/c" name="next">On</a><img src="https://spy.example/p"><script>fetch('https://spy.example')</script><iframe src=x>in</iframe><form><p>f</p><form>g</form></form><font color="url(x)" id='a"b'>z</font><p onclick=x>'q' "r" <x-y>w</x-y><br><hr/></body></html>"""
    got = reader.safe_markup(page)
    for part in ('<h2 id="part">Moss &amp; fern</h2>', '<ul><li><font style="color:red"><i>Bry.</i></font> plain <b>bold</b></li></ul>', '<a id="next">On</a>', "<font>z</font>", "<p>&#39;q&#39; &#34;r&#34; w<br><hr></p>"):
        assert part in got, (part, got)
    for part in ("spy.example", "script", "iframe", "img", "style>", "href", "onclick", "<form", "x-y", ">T<", "url("):
        assert part not in got
    assert reader.safe_markup("<p>a<b>c</p>d</i>") == "<p>a<b>c</b></p>d" and reader.safe_markup("") == ""


def test_shown_markup_of_all_pages_is_sound():
    """Every page of a table: only listed elements and attributes, each closed in its place, and the same again when rewritten."""

    class Sound(HTMLParser):
        def handle_starttag(self, tag, attrs):
            assert tag in reader.SHOWN and {k for k, _ in attrs} <= {"id", "style"}
            if tag not in ("br", "hr"):
                self.open.append(tag)

        def handle_endtag(self, tag):
            assert self.open.pop() == tag

    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).column(0).to_pylist():
        body = reader.safe_markup(page or "")
        own = Sound()
        own.open = []
        own.feed(body)
        assert not own.open and reader.safe_markup(body) == body


def test_shown_markup_takes_linear_time():
    for part in ("<p>", "<form>", "<b></i>", "<a name=x>", "</p>", "<p></b>"):
        began = time.perf_counter()
        reader.safe_markup(part * (1_000_000 // len(part)))
        assert time.perf_counter() - began < 30


def test_passage_targets(spark):
    rows = [(0, "o", "é猫 <i> & 'x'", 1, 2), (1, "é猫", "é猫", 0, 2), (2, "a", "é猫", -1, 2), (3, "a", "é猫", 1, 1), (4, "a", "é猫", 0, 3), (5, None, "ab", 0, 1)]
    df = spark.createDataFrame(rows, "k int, o string, r string, s int, e int")
    got = {r.k: r.t for r in df.select("k", reader.target(F.col("o"), F.col("r"), F.col("s"), F.col("e")).alias("t")).collect()}
    assert "<pre>é<mark>猫</mark> &lt;i&gt; &amp; &#39;x&#39;</pre>" in got[0] and "corrected" in got[0] and "corrected" in got[5]
    assert "<mark>é猫</mark>" in got[1] and "corrected" not in got[1] and got[2] is got[3] is got[4] is None


def test_places_move_with_corrections(spark):
    """abcdefgh with cd -> X and f -> YYY: abXeYYYgh."""
    df = spark.range(9).select(F.col("id").cast("int").alias("p"), F.expr("array(named_struct('at', 2, 'removed', 2, 'added', 1), named_struct('at', 5, 'removed', 1, 'added', 3))").alias("c"))
    rows = df.select("p", reader.moved(F.col("c"), F.col("p")).alias("a"), reader.moved(F.col("c"), F.col("p"), True).alias("b")).orderBy("p").collect()
    assert [(r.a, r.b) for r in rows] == [(0, 0), (1, 1), (2, 2), (2, 3), (3, 3), (4, 4), (7, 7), (8, 8), (9, 9)]


def test_article_tables():
    assert reader.article_table(b'<table><tr><th colspan="2" x="1">a &amp; b</th></tr><tr><td rowspan="0">1<break/><b>2</b> 3</td>skip<td/></tr></table>') == '<table><tr><th colspan="2">a &amp; b</th></tr><tr><td>1<br>2 3</td><td></td></tr></table>'
    assert reader.article_table(b"<p>x</p>") is None and reader.article_table(b"<table>") is None


def test_rows_of_many_documents_leave_together():
    import pandas as pd

    from tessera.functions import review as own

    rows = pd.DataFrame([(k, "a\n\nb" if k % 3 else "c", [1, 2], ["a", "xb"]) for k in range(500)], columns=["key", "edited", "numbers", "originals"])
    (one,) = own.reviewed(iter([rows]))
    parts = list(own.reviewed(iter([rows]), most=1000))
    assert len(parts) > 50 and pd.concat(parts, ignore_index=True).equals(one)
    assert len(one) == sum(2 if k % 3 else 1 for k in range(500))
