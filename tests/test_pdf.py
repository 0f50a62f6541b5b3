"""The decoder on small files made here, and the audit of a folder of them."""

import json
import zlib

import pytest

from glyphlake.plans.audit import audit
from glyphlake.sources import pdf
from glyphlake.sources.pdf_objects import PdfError
from glyphlake.streaming.arrivals import arriving_events, run_once


def build(objects: dict[int, bytes], extra: bytes = b"") -> bytes:
    body = b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in objects.items())
    return body + b"trailer\n<< /Root 1 0 R " + extra + b">>\n%%EOF"


def stream(data: bytes, entries: bytes = b"", flate: bool = False) -> bytes:
    data = zlib.compress(data) if flate else data
    return b"<< /Length %d %s%s >>\nstream\n%s\nendstream" % (len(data), entries, b" /Filter /FlateDecode" if flate else b"", data)


def one_page(content: bytes, font: bytes = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", page: bytes = b"", more: dict | None = None, root: bytes = b"") -> bytes:
    return build({1: b"<< /Type /Catalog /Pages 2 0 R %s >>" % root, 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 612 792] >>", 3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> /XObject << /X 6 0 R >> >> %s >>" % page, 4: stream(content, flate=True), 5: font} | (more or {}))


def kinds(data: bytes, kind: str) -> list[dict]:
    return [p for _, k, p in pdf.file_events(data) if k == kind]


def test_text_and_its_places():
    g = kinds(one_page(b"BT /F1 12 Tf 100 700 Td (Hi \\(x\\)) Tj [<41> -1000 (B)] TJ ET"), "glyph")
    assert "".join(x["raw_unicode"] for x in g) == "Hi (x)AB" and (g[0]["x"], g[0]["y"], g[0]["font_size_pt"]) == (100, 700, 12)
    assert g[-1]["x"] - g[-2]["x"] == pytest.approx(6 + 12)


def test_unicode_maps():
    assert pdf.to_unicode(b"1 beginbfchar <01> <0041> endbfchar 1 beginbfrange <02> <04> <0061> endbfrange 1 beginbfrange <05> <06> [<0078> <D83DDE00>] endbfrange") == ({1: "A", 2: "a", 3: "b", 4: "c", 5: "x", 6: "\U0001f600"}, None)
    assert pdf.to_unicode(b"1 beginbfchar <00G1> <0041> endbfchar")[1] == "MALFORMED_TOUNICODE_CMAP"
    assert pdf.to_unicode(b"begincmap endcmap")[1] == "INVALID_TOUNICODE_CMAP"


def test_composite_fonts():
    font = b"<< /Type /Font /Subtype /Type0 /BaseFont /ABCDEF+X /Encoding /Identity-H /DescendantFonts [<< /Type /Font /W [1 [250 500]] /DW 1000 >>] >>"
    g = kinds(one_page(b"BT /F1 10 Tf <000100020003> Tj ET", font), "glyph")
    assert [x["raw_unicode"] for x in g] == [None] * 3 and [round(x["x"], 3) for x in g] == [0, 2.5, 7.5]
    bad = kinds(one_page(b"BT /F1 10 Tf <0001> Tj ET", b"<< /Type /Font /Subtype /Type0 /BaseFont /X >>"), "glyph")
    assert bad[0]["mapping_untrusted"] and bad[0]["font_name"] == "<malformed-font>"


def test_graphics():
    data = one_page(b"q 100 0 0 50 10 20 cm /X Do Q 0 0 100 100 re W n 50 50 100 100 re f 2 w 0 0 m 10 0 l S", more={6: stream(b"", b"/Subtype /Image /Width 1 /Height 1")})
    assert [(i["x0"], i["y0"], i["x1"], i["y1"]) for i in kinds(data, "image")] == [(10, 20, 110, 70)]
    assert [(p["kind"], p["x0"], p["x1"]) for p in kinds(data, "path")] == [("fill", 50, 100), ("stroke", 0, 10)]  # butt ends


def test_replacement_text_and_forms():
    data = one_page(b"/Span << /ActualText (fi) >> BDC BT /F1 9 Tf (ab) Tj ET EMC /X Do", more={6: stream(b"BT /F1 9 Tf (c) Tj ET", b"/Subtype /Form")})
    assert [(g["actual_text"], g["in_form"]) for g in kinds(data, "glyph")] == [("fi", False), ("fi", False), (None, True)]


def test_objects_in_streams_and_errors():
    inner = b"2 0 5 60 << /Type /Pages /Kids [3 0 R] /Count 1 >>".ljust(68) + b"<< /Type /Font /Subtype /Type1 >>"
    data = build({1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Type /Page /Parent 2 0 R >>", 9: stream(inner, b"/Type /ObjStm /N 2 /First 8", True)})
    assert [k for _, k, _ in pdf.file_events(data)].count("page") == 1
    for bad, said in ((b"hello", "Not a PDF"), (build({1: b"<< /Type /Catalog >>"}, b"/Encrypt 9 0 R"), "encryption is not supported"), (build({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [] >>"}), "contains no pages")):
        with pytest.raises(PdfError, match=said):
            pdf.file_events(bad)


def test_a_folder_is_audited(spark, tmp_path):
    files = {"text.pdf": one_page(b"BT /F1 12 Tf 72 700 Td (Searchable text) Tj ET"), "empty.PDF": one_page(b""), "tiny.pdf": one_page(b"BT /F1 2.5 Tf 72 700 Td (small) Tj ET"), "order.pdf": one_page(b"BT /F1 12 Tf 100 700 Td (B) Tj -28 0 Td (A) Tj ET"),
             "scan.pdf": one_page(b"q 612 0 0 792 0 0 cm /X Do Q BT /F1 12 Tf 72 700 Td (few) Tj ET", more={6: stream(b"", b"/Subtype /Image")}), "broken.pdf": b"%PDF-nothing", "notes.txt": b"x"}
    (tmp_path / "in").mkdir()
    for name, data in files.items():
        (tmp_path / "in" / name).write_bytes(data)
    pages, done = audit(spark, str(tmp_path / "in"))
    got = {r["file_id"].rsplit("/", 1)[1]: (r["classification"], r["findings"]) for r in pages.collect()}
    assert got == {"text.pdf": ("NATIVE_TEXT", []), "empty.PDF": ("BLANK", ["NO_TEXT_LAYER"]), "tiny.pdf": ("NATIVE_TEXT", ["TINY_TEXT"]), "order.pdf": ("NATIVE_TEXT", ["READING_ORDER_DIVERGENCE"]), "scan.pdf": ("SPARSE_OCR", ["SPARSE_TEXT_OVER_FULL_PAGE_IMAGE"])}
    errors = {r["file_id"].rsplit("/", 1)[1]: r["error"] for r in done.collect()}
    assert len(errors) == 6 and errors["broken.pdf"] and not errors["text.pdf"]
    assert pdf.decode(spark, str(tmp_path / "in"), most_bytes=100).filter("kind = 'error'").count() == 6
    for _ in range(2):  # a second run finds nothing new
        run_once(arriving_events(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert spark.read.parquet(str(tmp_path / "out")).filter("kind in ('file', 'error')").count() == 6


FIRST_PAGE = {"text.pdf": one_page(b"BT /F1 12 Tf 72 700 Td (Searchable text) Tj ET")}


def reports_of(spark, tmp_path, files, **more):
    from glyphlake.operators import reports

    (tmp_path / "in").mkdir()
    for name, data in files.items():
        (tmp_path / "in" / name).write_bytes(data)
    _, rows = audit(spark, str(tmp_path / "in"), **more)
    rows = rows.cache()
    name = lambda r: r["file_id"].rsplit("/", 1)[1]
    told = {name(r): json.loads(r["json"]) for r in reports.report_json(rows.filter("error IS NULL")).collect()}
    return told, {name(r): r for r in rows.collect()}, {name(r): r["report"] for r in reports.text_report(rows.filter("error IS NULL")).collect()}


def test_bad_files_are_rows_of_their_own(spark, tmp_path):
    """Whatever is wrong with a file, the others have their report."""
    page = b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R %s >>"
    boxes = {f"box{k}.pdf": one_page(b"", more={3: page % e}) for k, e in enumerate((b"/MediaBox [0 0 null 9]", b"/MediaBox [0 0 9]", b"/CropBox 7", b"/Rotate /X", b"/Annots [<< /AP [1] /Rect [1 2] >> 7 null]", b"/Resources 5"))}
    told, rows, _ = reports_of(spark, tmp_path, FIRST_PAGE | boxes | {"none.pdf": b"x", "cut.pdf": one_page(b"x")[:20], "flat.pdf": one_page(b"BT /F1 1 Tf (x) Tj ET", page=b"/MediaBox [0 0 0 9]")})
    assert set(told) >= {"text.pdf", *boxes} and rows["none.pdf"]["error"] and rows["cut.pdf"]["error"] and not told["text.pdf"]["needsAttention"]
    flat = told["flat.pdf"]["pages"][0]["spatialEvidence"]
    assert not flat["assessed"] and flat["pageWidthPoints"] is None and flat["locations"] == [] and flat["totalLocationCount"] == 0 and told["flat.pdf"]["pages"][0]["tinyTextGlyphCount"] == 1


def test_the_whole_report(spark, tmp_path):
    """A page with everything: text in order, an image, paths, optional content, an annotation with an appearance, a form, surfaces."""
    content = b"BT /F1 12 Tf 72 700 Td (ab) Tj /F1 2 Tf 0 -20 Td (c) Tj ET q 306 0 0 396 0 0 cm /X Do Q /OC /L BDC 10 10 20 20 re f EMC 50 60 30 20 re f /OC /V BDC 5 5 5 5 re f EMC"
    page = b"/Resources << /Font << /F1 5 0 R >> /XObject << /X 6 0 R >> /Properties << /L 7 0 R /V 8 0 R >> >> /Annots [9 0 R 10 0 R] /Rotate 90"
    more = {
        3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R " + page + b" >>", 6: stream(b"", b"/Subtype /Image"), 7: b"<< /Type /OCG /Name (off) >>", 8: b"<< /Type /OCMD /OCGs [7 0 R] /P /AllOff >>",
        9: b"<< /Subtype /Widget /FT /Sig /Rect [100 100 150 120] /AP << /N 11 0 R /D 11 0 R >> /T (s) >>", 10: b"<< /Subtype /Text /Rect [1 1 5 5] /F 2 >>", 11: stream(b"BT /F1 9 Tf (xy) Tj ET", b"/Resources << /Font << /F1 5 0 R >> >>"),
    }
    root = b"/OCProperties << /OCGs [7 0 R] /D << /OFF [7 0 R] >> >> /AcroForm << /Fields [9 0 R] >> /Names << /EmbeddedFiles << /Names [(a) 7 0 R] >> >> /AF [7 0 R] /Collection << >>"
    told, rows, said = reports_of(spark, tmp_path, {"all.pdf": one_page(content, more=more, root=root)})
    x = told["all.pdf"]
    assert list(x) == ["schemaVersion", "file", "fileSizeBytes", "pageCount", "inspectedPageCount", "encrypted", "extractionAllowed", "tinyTextThresholdPoints", "parseHealth", "completeness", "documentSurfaces", "needsAttention", "pagesNeedingAttention", "pages"]
    s = x["documentSurfaces"]
    assert s == {"assessed": True, "complete": True, "acroFormFieldCount": 1, "signatureFieldCount": 1, "widgetWithoutAppearanceCount": 0, "xfaPresent": False, "embeddedFileCount": 1, "associatedFileReferenceCount": 1, "portfolioPresent": True}
    p = x["pages"][0]
    assert list(p) == ["pageNumber", "glyphCount", "unicodeCharacterCount", "missingUnicodeGlyphCount", "replacementCharacterCount", "tinyTextGlyphCount", "classification", "textSurfaces", "semanticMapping", "readingOrder", "geometryVisibility", "visualContent", "annotationAppearances", "optionalContent", "unicodeProfile", "spatialEvidence", "needsAttention", "fonts", "findings"]
    assert (p["glyphCount"], p["tinyTextGlyphCount"], p["textSurfaces"]["pageContentGlyphCount"], p["geometryVisibility"]["visibleGlyphCount"]) == (3, 1, 3, 5)
    v = p["visualContent"]
    assert v == {"assessed": True, "imageCount": 1, "maxImageCoverageRatio": 0.25, "combinedImageCoverageRatio": 0.25, "imageOccupiedGridCellCount": 16, "imageTextOverlapGridCellCount": 0, "imageTextOverlapRatio": 0.0, "paintedVectorPathCount": 3, "annotationCount": 2, "widgetAnnotationCount": 1, "optionalContentPresent": True}
    assert p["annotationAppearances"] == {"assessed": True, "appearanceStreamCount": 1, "glyphCount": 2, "unicodeCharacterCount": 2, "missingUnicodeGlyphCount": 0, "replacementCharacterCount": 0}
    # Two references and two annotations without one: each of those adds three failures.
    assert p["optionalContent"] == {"complete": False, "referenceCount": 2, "membershipReferenceCount": 1, "hiddenInViewReferenceCount": 1, "hiddenInPrintReferenceCount": 1, "hiddenInExportReferenceCount": 1, "evaluationFailureCount": 6}
    e = p["spatialEvidence"]
    assert (e["assessed"], e["pageWidthPoints"], e["pageHeightPoints"], e["rotationDegrees"], e["coordinateSpace"]) == (True, 792.0, 612.0, 90, "TOP_LEFT_DISPLAY_POINTS")
    assert [(q["code"], q["xPoints"]) for q in e["locations"]] == [("TINY_TEXT", 680.0)] and e["totalLocationCount"] == 1
    r = e["visualRegions"]
    assert r["counts"] == {"imageCount": 1, "annotationCount": 0, "formFieldCount": 1, "vectorPathCount": 2} and r["totalRegionCount"] == 4 and not r["regionsTruncated"]
    assert [(q["type"], q["xPoints"], q["yPoints"], q["widthPoints"], q["heightPoints"]) for q in r["regions"]][:2] == [("IMAGE", 0.0, 0.0, 396.0, 306.0), ("FORM_FIELD", 100.0, 100.0, 20.0, 50.0)]
    assert p["fonts"] == [{"name": "Helvetica", "subtype": "Type1", "encoding": "<implicit>", "embedded": False, "damaged": False, "vertical": False, "toUnicodePresent": False, "subset": False, "glyphCount": 3, "rawUnmappedGlyphCount": 0}]
    assert [f["code"] for f in p["findings"]] == ["TINY_TEXT"] and p["unicodeProfile"]["scripts"] == ["LATIN"] and not x["completeness"]["optionalContent"]
    assert "Result: 1 of 1 page needs attention" in said["all.pdf"] and rows["all.pdf"]["attention"]


def test_older_versions_leave_out_what_came_later(spark, tmp_path):
    from glyphlake.operators import reports

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pdf").write_bytes(one_page(b"q 9 0 0 9 0 0 cm /X Do Q 1 1 5 5 re f", more={6: stream(b"", b"/Subtype /Image")}))
    rows = audit(spark, str(tmp_path / "in"))[1].cache()
    got = {v: json.loads(reports.report_json(rows, v).first()["json"])["pages"][0] for v in range(1, 7)}
    assert "classification" not in got[1] and "spatialEvidence" not in got[2] and "visualRegions" not in got[3]["spatialEvidence"]
    regions = {v: got[v]["spatialEvidence"]["visualRegions"] for v in (4, 5, 6)}
    assert "counts" not in regions[4] and [regions[v]["totalRegionCount"] for v in (4, 5, 6)] == [1, 1, 2] and "vectorPathCount" not in regions[5]["counts"]


def test_limits_end_a_file_with_their_code(spark, tmp_path):
    two = one_page(b"1 1 2 2 re f 3 3 2 2 re f BT /F1 9 Tf (abc) Tj ET", page=b"/Annots [<< /Subtype /Text >> << /Subtype /Text >>]")
    for code in ("GLYPH_COUNT", "SEMANTIC_CHARACTER_COUNT", "PAINTED_VECTOR_PATH_COUNT", "ANNOTATION_COUNT"):
        with pytest.raises(pdf.LimitError, match="configured"):
            pdf.file_events(two, limits={code: 1})
    images = one_page(b"/X Do /X Do", more={6: stream(b"", b"/Subtype /Image")})
    with pytest.raises(pdf.LimitError, match="image-count limit of 1"):
        pdf.file_events(images, limits={"IMAGE_COUNT": 1})
    pdf.file_events(images, limits={"IMAGE_COUNT": 2})
    _, rows, _ = reports_of(spark, tmp_path, FIRST_PAGE | {"two.pdf": two}, limits={"PAINTED_VECTOR_PATH_COUNT": 1})
    assert rows["two.pdf"]["limit_code"] == "PAINTED_VECTOR_PATH_COUNT" and rows["text.pdf"]["error"] is None


def locked(permissions: int, password: bytes = b"") -> bytes:
    """A file with RC4 of 128 bits."""
    from hashlib import md5

    from glyphlake.sources.pdf_security import PADDING, rc4

    owner, ident = bytes(range(32)), b"0123456789abcdef"
    key = md5((password + PADDING)[:32] + owner + (permissions & 0xFFFFFFFF).to_bytes(4, "little") + ident).digest()
    for _ in range(50):
        key = md5(key[:16]).digest()
    user = rc4(key, md5(PADDING + ident).digest())
    for k in range(1, 20):
        user = rc4(bytes(c ^ k for c in key), user)
    hidden = lambda n, data: rc4(md5(key + n.to_bytes(3, "little") + b"\0\0").digest()[:16], data)
    return build(
        {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 9 9] >>", 3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>", 4: stream(hidden(4, b"BT /F1 9 Tf (open) Tj ET")), 5: b"<< /Type /Font /Subtype /Type1 /BaseFont /H >>"},
        b"/ID [<%s> <00>] /Encrypt << /Filter /Standard /V 2 /R 3 /Length 128 /P %d /O <%s> /U <%s> >> " % (ident.hex().encode(), permissions, owner.hex().encode(), (user + bytes(16)).hex().encode()),
    )


def test_encrypted_files():
    assert "".join(g["raw_unicode"] for g in kinds(locked(-1), "glyph")) == "open" and kinds(locked(-1), "file")[0]["encrypted"]
    for data, said in ((locked(-1 & ~16), "do not allow"), (locked(-1, b"secret"), "password")):
        with pytest.raises(PdfError, match=said):
            pdf.file_events(data)


def test_layers():
    from glyphlake.sources.pdf_layers import Layers
    from glyphlake.sources.pdf_objects import Document, Ref

    objects = {1: b"<< /Type /Catalog /OCProperties << /D << /OFF [2 0 R] >> >> >>", 2: b"<< /Type /OCG >>", 3: b"<< /Type /OCG /Usage << /Print << /PrintState /OFF >> >> >>"}
    rules = {10: b"/OCGs [2 0 R 3 0 R]", 11: b"/OCGs [2 0 R 3 0 R] /P /AllOn", 12: b"/OCGs [2 0 R] /P /AnyOff", 13: b"/OCGs [3 0 R] /P /AllOff", 14: b"/OCGs []", 15: b"/VE [/And 2 0 R 3 0 R]", 16: b"/VE [/Or 2 0 R 3 0 R]", 17: b"/VE [/Not 2 0 R]", 18: b"/VE [/Not 2 0 R 3 0 R]", 19: b"/VE [/And 19 0 R]", 20: b"/VE [/Xor 2 0 R]", 21: b"/OCGs [19 0 R 2 0 R] /P /AnyOn"}
    doc = Document(build(objects | {k: b"<< /Type /OCMD " + v + b" >>" for k, v in rules.items()}))
    layers = Layers(doc, doc.get(Ref(1, 0)))
    hidden = lambda d="view": [layers.hidden(Ref(k, 0), d) for k in (2, 3, *rules)]
    assert hidden() == [True, False, False, True, False, True, False, True, False, False, None, None, None, None]
    assert hidden("print")[:4] == [True, True, True, True]


def test_a_batch_from_its_list_to_its_reports(spark, tmp_path):
    import io

    from glyphlake.plans import batch_run

    (tmp_path / "w/docs").mkdir(parents=True)
    (tmp_path / "w/docs/a b.pdf").write_bytes(FIRST_PAGE["text.pdf"])
    (tmp_path / "w/tiny.pdf").write_bytes(one_page(b"BT /F1 2 Tf 72 700 Td (small) Tj ET"))
    (tmp_path / "list").mkdir()
    names = [("docs/a b.pdf", "added"), ("tiny.pdf", "modified"), ("gone.pdf", "added"), ("old.pdf", "removed"), ("x.md", "added"), ("tiny.pdf", "renamed")]
    (tmp_path / "list/1.json").write_text(json.dumps([{"filename": n, "status": s} for n, s in names]))
    (tmp_path / "event.json").write_text(json.dumps({"number": 7, "pull_request": {"changed_files": len(names)}}))
    env = {"WORKSPACE": str(tmp_path / "w"), "EVENT_PATH": str(tmp_path / "event.json"), "CHANGED_FILES": str(tmp_path / "list"), "REPOSITORY": "o/r", "SUMMARY": str(tmp_path / "summary"), "OUTPUT": str(tmp_path / "output"), "INPUT_REPORT_PATH": "out/r.json"}
    out, err = io.StringIO(), io.StringIO()
    assert batch_run.main(spark, env, out, err) == 2 and not err.getvalue()
    assert out.getvalue().splitlines() == ["::warning file=tiny.pdf,title=PDF text-layer finding::Page 1: TINY_TEXT", "::error file=gone.pdf,title=PDF audit failed::input: gone.pdf is missing, or no regular file"]
    x = json.loads((tmp_path / "w/out/r.json").read_text())
    assert [(f["path"], f["status"]) for f in x["files"]] == [("docs/a b.pdf", "passed"), ("tiny.pdf", "attention"), ("gone.pdf", "error")] and x["files"][0]["report"]["file"] == "docs/a b.pdf" and x["conclusion"] == "error"
    assert (tmp_path / "summary").read_text().endswith("| <code>gone.pdf</code> | Error | input: gone.pdf is missing, or no regular file |\n\nFull machine-readable report: <code>out/r.json</code>\n")
    assert (tmp_path / "output").read_text() == "files_checked=3\nfiles_with_findings=1\nfiles_failed=1\nreport_path=out/r.json\n"
    assert batch_run.main(spark, env | {"INPUT_MAX_FILES": "1"}, out, err) == 2 and "FILE_COUNT" in err.getvalue()


def test_the_command_line_prints_reports(spark, tmp_path):
    import io

    from glyphlake import cli

    (tmp_path / "a.pdf").write_bytes(FIRST_PAGE["text.pdf"])
    out, err = io.StringIO(), io.StringIO()
    assert cli.main(["--json", str(tmp_path)], out, err) == 0 and json.loads(out.getvalue())["schemaVersion"] == 6
    (tmp_path / "b.pdf").write_bytes(b"%PDF-broken")
    out = io.StringIO()
    assert cli.main([str(tmp_path)], out, err) == 2 and "Result: no inspected text-layer problems were found" in out.getvalue() and "b.pdf" in err.getvalue()


def test_areas_of_turned_images():
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    assert pdf.polygon_area(square) == pdf.polygon_area(square[::-1]) == 4 and pdf.cut_to(square, (5, 5, 6, 6)) == []
    assert pdf.polygon_area(pdf.cut_to(square, (1, -1, 9, 1))) == 1
    turned = [(0.0, 1.0), (1.0, 0.0), (0.0, -1.0), (-1.0, 0.0)]
    assert pdf.polygon_area(pdf.cut_to(turned, (0, -9, 9, 9))) == 1 and pdf.polygon_area(pdf.cut_to(turned, (-9, -9, 9, 9))) == 2
    data = one_page(b"q 100 100 -100 100 300 300 cm /X Do Q q 0 0 50 9 re W n 100 0 0 100 0 0 cm /X Do Q", more={6: stream(b"", b"/Subtype /Image")})
    assert [round(i["area"], 6) for i in kinds(data, "image")] == [20_000, 450]
