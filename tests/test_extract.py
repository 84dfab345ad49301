import io
import json
import zipfile

from pyspark.sql import functions as F

from linespan.operators.scoring import score_schema
from linespan.sources import extract as E


def test_formats(spark, tmp_path):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("word/document.xml", '<w:d xmlns:w="u"><w:p><w:t>one</w:t><w:t> two</w:t></w:p><w:p><w:t>three</w:t></w:p></w:d>')
    files = {
        "a.docx": z.getvalue(), "b.pdf": b"%PDF", "c.html": b"<title>T</title><p>x<br>y</p><table><tr><td>1</td><td>2</td></tr></table><script>no</script>",
        "d.eml": b"From: a@example.com\nSubject: hi\n\nbody line\n", "e.fb2": b"<f><body><p>para</p></body></f>", "f.docx": b"junk",
    }
    for k, v in files.items():
        (tmp_path / k).write_bytes(v)
    got = {r["path"][-6:]: (r["lines"], r["reason"]) for r in E.read_documents(spark, str(tmp_path)).collect()}
    assert got["a.docx"[-6:]][0] == ["one two", "three"] and got["/c.html"[-6:]][0] == ["T", "x", "y", "1 | 2"]
    assert got["/d.eml"][0] == ["From: a@example.com", "Subject: hi", "body line"] and got["/e.fb2"][0] == ["para"]
    assert got["/b.pdf"][1] == E.REFUSED["pdf"] and got["f.docx"][1].startswith("unreadable docx")


def _files(parts):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        for name, text in parts.items():
            f.writestr(name, text)
    return z.getvalue()


def _shown(name, data):
    doc, why = E._read(name, data)
    assert why is None
    assert all(m["at"] == s["start"] - 1 for m, s in zip(doc.markers, doc.sections, strict=True))
    return doc.lines, [m["text"].strip("- ") for m in doc.markers], [(s["kind"], s["num"], s["start"], s["end"]) for s in doc.sections]


def test_a_book_follows_its_spine():
    page = "<html><head><title>no</title></head><body><h1>{0}</h1><p>text of {0}\u00ad</p></body></html>"
    opf = """<package xmlns="u" xmlns:dc="d"><metadata><dc:creator>An Author</dc:creator></metadata><manifest><item id="n" href="nav.xhtml" properties="nav"/>
      <item id="x" href="t/a%20z.xhtml"/><item id="y" href="t/b.xhtml"/><item id="e" href="t/empty.xhtml"/></manifest><spine><itemref idref="n"/><itemref idref="y"/><itemref idref="e"/><itemref idref="x"/></spine></package>"""
    book = _files({"META-INF/container.xml": '<c><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></c>', "O/p.opf": opf, "O/nav.xhtml": page.format("nav"),
                   "O/t/a z.xhtml": page.format("Last"), "O/t/b.xhtml": page.format("First"), "O/t/empty.xhtml": "<html><body></body></html>"})
    lines, markers, sections = _shown("b.epub", book)
    assert lines == ["An Author", "First", "text of First", "Last", "text of Last"]
    assert markers == ["chapter 1: First", "chapter 2: Last"] and sections == [("chapter", 1, 2, 3), ("chapter", 2, 4, 5)]


def test_slides_follow_their_relations():
    body = lambda *texts, **a: "<s {}>{}</s>".format(" ".join(f'{k}="{v}"' for k, v in a.items()), "".join(f"<p><r><t>{t}</t></r></p>" for t in texts))
    rel = lambda *rs: "<R>" + "".join(f'<Relationship Id="{i}" Type="http://x/{k}" Target="{t}"/>' for i, k, t in rs) + "</R>"
    notes = '<n><spTree><sp><nvPr><ph type="sldNum"/></nvPr><p>7</p></sp><sp><nvPr><ph type="body"/></nvPr><p>say this</p></sp></spTree></n>'
    deck = _files({
        "ppt/presentation.xml": '<p xmlns:r="rel"><l><sldId id="1" r:id="r2"/><sldId id="2" r:id="r1"/></l></p>', "ppt/_rels/presentation.xml.rels": rel(("r1", "slide", "slides/slide1.xml"), ("r2", "slide", "/ppt/slides/slide2.xml")),
        "ppt/slides/slide1.xml": body("second", show="0"), "ppt/slides/slide2.xml": "<s><p><t>first</t></p><tbl><tr><tc><p>a</p></tc><tc><p>b</p><p>c</p></tc></tr></tbl></s>",
        "ppt/slides/_rels/slide2.xml.rels": rel(("x", "notesSlide", "../notesSlides/n.xml")), "ppt/notesSlides/n.xml": notes,
    })
    lines, markers, sections = _shown("d.pptx", deck)
    assert lines == ["first", "a | bc", "say this", "second"] and markers == ["slide 1", "notes 1", "slide 2 (hidden)"]
    assert sections == [("slide", 1, 1, 2), ("notes", 1, 3, 3), ("slide", 2, 4, 4)]
    odp = """<o xmlns:draw="d" xmlns:presentation="p"><styles><style name="dp1"><props presentation:visibility="hidden"/></style></styles>
      <draw:page><p>one</p><presentation:notes><p>note</p></presentation:notes></draw:page><draw:page draw:style-name="dp1"><h>two</h></draw:page></o>"""
    assert _shown("d.odp", _files({"content.xml": odp}))[:2] == (["one", "note", "two"], ["slide 1", "notes 1", "slide 2 (hidden)"])


def test_rich_text():
    rtf = (rb"{\rtf1\ansi\ansicpg1251\deff0\uc1{\fonttbl{\f0\fcharset204 A;}{\f1\fcharset0 B;}}{\info{\title hidden}}{\*\generator gone;}"
           rb"\f0 \'c8\'ed \u8722?4\'b0C\par {\f1 caf\'e9}{\footnote a note}\par \trowd x\cell y\cell\row \u-10179?\u-8704? \{b\}\~c{\header no}\par}")  # fmt: skip
    lines, markers, _ = _shown("a.rtf", rtf)
    assert lines == ["Ин −4°C", "café", "x | y", "😀 {b} c", "a note"] and markers == ["footnotes"]


def test_mail_with_attachments():
    inner = b"Subject: in\nContent-Type: multipart/mixed; boundary=i\n\n--i\n\nInside.\n--i\nContent-Disposition: attachment; filename=deep.txt\n\ndeep\n--i--\n"
    mail = (b"From: a@example.com\nSubject: hi\nContent-Type: multipart/mixed; boundary=b\n\n--b\n\nBody.\n--b\nContent-Disposition: attachment; filename=n.txt\n\nl1\nl2\n"
            b"--b\nContent-Type: image/png\nContent-Disposition: attachment; filename=p.png\n\nx\n--b\nContent-Type: message/rfc822\n\n" + inner + b"\n--b--\n")  # fmt: skip
    lines, markers, sections = _shown("m.eml", mail)
    assert markers == ["attachments", "attachment: n.txt", "attachment: p.png", "attachment: message.eml", "attachments"]
    assert lines[:3] == ["From: a@example.com", "Subject: hi", "Body."] and "(not extracted: unsupported format: image (PNG), no OCR)" in lines
    assert lines[-3:] == ["Subject: in", "Inside.", "deep.txt (text/plain, 4 bytes)"]
    assert sections[3][2:] == (len(lines) - 2, len(lines)) and sections[4][2:] == (len(lines), len(lines))


def test_books_and_texts_with_notes():
    fb2 = b"<F><description><title-info><author><n>A</n><n>B</n></author><book-title>T</book-title></title-info></description><body><section><title><p>One</p></title><p>x<b>y</b></p></section></body><body name='notes'><section><p>n1</p></section></body></F>"
    assert _shown("a.fb2", fb2) == (["T", "A B", "One", "xy", "n1"], ["chapter 1: One", "notes"], [("chapter", 1, 3, 4), ("notes", None, 5, 5)])
    odt = '<o xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="t"><office:text><h>H</h><p>a<note text:note-class="footnote"><note-citation>1</note-citation><note-body><p>foot</p></note-body></note>b</p><table><table-row><table-cell><p>1</p></table-cell><table-cell><p>2</p></table-cell></table-row></table></office:text></o>'
    assert _shown("a.odt", _files({"content.xml": odt})) == (["H", "ab", "1 | 2", "foot"], ["footnotes"], [("footnotes", None, 4, 4)])


def _score(spark, want, got):
    df = spark.createDataFrame([(json.dumps(want), json.dumps(got) if got is not None else None)], "w string, g string")
    return df.select(score_schema(F.col("w"), F.col("g")).alias("s")).first()["s"].asDict()


def test_scores(spark):
    c = _score(spark, {"a": 12.5, "b": None, "c": {"any": ["x", "y"]}, "d": {"conflict": ["1", "2"]}, "l": [{"k": "p"}, {"k": "q"}]},
               {"a": {"value": "12,500"}, "b": "new", "c": "Y", "d": {"value": ["1", "2"], "conflict": True}, "l": [{"k": "q"}, {"k": "z"}]})
    assert (c["correct"], c["invented"], c["conflicts_caught"], c["list_matched"], c["list_answered"]) == (2, 1, 1, 1, 2)
    assert (c["fields"], c["wrong"], c["answered_values"], c["right_values"]) == (4, 0, 4, 3)
    want = {"l": [{"k": "a", "n": {"v": None}}, {"k": {"any": ["b", "a"]}, "n": {"v": 5}}, "plain"], "x": {"y": "z", "q": {"conflict": ["1", "2"]}}, "e": None, "m": "gone"}
    got = {"l": [{"k": "a", "n": {"v": {"value": 5}}}, {"k": "A."}, {"value": "plain"}, 7], "x": {"y": ["q", "z"], "q": {"value": ["1", "3"], "conflict": True}}, "m": {"value": None}}
    c = _score(spark, want, got)
    assert (c["list_expected"], c["list_answered"], c["list_matched"]) == (3, 4, 3)
    assert {k: v for k, v in c.items() if v and not k.startswith("list")} == {"fields": 4, "correct": 1, "wrong": 1, "missed": 1, "null_expected": 1, "null_ok": 1, "conflicts_expected": 1, "answered_values": 3, "right_values": 1}
    c = _score(spark, want, None)
    assert (c["missed"], c["null_ok"], c["list_matched"], c["answered_values"]) == (3, 1, 0, 0)
