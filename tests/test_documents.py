"""Document parsing and inspection, the gateway's tables, and the streams."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from palisade.operators import gateway
from palisade.operators.chunks import chunked
from palisade.sources.documents import FAILED, extract, inspect_documents, render_report

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def package(parts: dict[str, str]) -> bytes:
    with io.BytesIO() as held:
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            for part in parts.items():
                z.writestr(*part)
        return held.getvalue()


def docx(*paragraphs: str, **more: str) -> bytes:
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    return package({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", **more})


def xlsx() -> bytes:
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    sheet = f'<worksheet {S}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>hello</t></is></c><c r="C1"><v>5</v></c></row><row r="3"><c r="A3"><f>1+1</f><v>2</v></c></row></sheetData></worksheet>'
    book = f'<workbook {S} xmlns:r="{rel}"><sheets><sheet name="x" sheetId="1" state="hidden" r:id="r1"/></sheets></workbook>'
    return package({"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>', "xl/worksheets/s.xml": sheet})


def test_extract():
    assert extract(docx("a", "b")).units == [("word part 1, paragraph 1", "a"), ("word part 1, paragraph 2", "b")]
    found = extract(xlsx())
    assert found.units[0] == ("sheet 1, row 1", "hello | 5") and found.issues == ["sheet 1, row 3: formula results are not evaluated"]
    assert extract(docx("a", **{"word/media/x": "png", "word/media/": ""})).issues
    for bad in (b"", b"text", package({"x": "y"}), docx("a").replace(b"PK", b"XX"), docx("a", **{"word/x.xml": "<!DOCTYPE a><a/>"})):
        with pytest.raises(Exception):
            extract(bad)


def test_inspection(spark):
    files = spark.createDataFrame([(bytearray(d),) for d in (docx("all fine"), docx("card 4111 1111", "1111 1111"), b"%PDF-1.4", xlsx())], "content binary")
    got = {r["format"] + str(r["decision"]): r for r in inspect_documents(files).collect()}
    assert got["docxALLOWED"]["complete"]
    across = got["docxBLOCKED"]["findings"]
    assert any(f["location"] == "cross-unit text" and "CREDIT_CARD" in f["analysis"]["matched_policy_codes"] and f["characters"] is None for f in across)
    assert got["unknownBLOCKED"]["issues"] == [FAILED, "No extractable text"]
    assert not got["xlsxBLOCKED"]["complete"]


def test_chunks_overlap(spark):
    df = spark.createDataFrame([("x" * 16000,), ("",), (None,)], "text string")
    assert [(r["offset"], r["characters"]) for r in chunked(df).collect()] == [(0, 8000), (7500, 8000), (15000, 1000)]


def test_report_is_escaped():
    body, page = render_report({"decision": "BLOCKED", "findings": [{"location": "<x>", "decision": "BLOCKED", "matched_policy_codes": ["A"]}]})
    assert "&lt;x&gt;" in page and "<x>" not in page and '"BLOCKED"' in body


def test_rate_limit_and_audit(spark):
    rows = [(i, f"2026-01-01 00:00:{i:02d}", "a") for i in range(4)] + [(9, "2026-01-01 00:01:00", "a")]
    df = spark.createDataFrame(rows, "n int, ts string, identity string").withColumn("ts", F.to_timestamp("ts"))
    got = gateway.rate_limit(df, order="n", limit=2).orderBy("n").collect()
    assert [r["denied"] for r in got] == [False, False, True, True, False]
    assert sorted((r["requests"], r["denied"]) for r in gateway.rate_counts(df, limit=2).collect()) == [(1, 0), (4, 2)]
    prompts = spark.createDataFrame([("x" * 16001,), (" ",), ("cvv 123",), (None,)], "prompt string")
    from palisade.operators.decide import analyze

    events = gateway.audit_events(analyze(gateway.valid_prompts(prompts), "prompt"), user=None).collect()
    assert len(events) == 1 and events[0]["decision"] == "BLOCKED" and "prompt" not in events[0].asDict()
    assert gateway.health([]) == "unavailable"


def test_streams(spark, tmp_path):
    from palisade.streaming.gateway import audit_stream, rate_stream

    source = tmp_path / "in"
    spark.createDataFrame([("cvv 123", "a", "2026-01-01 00:00:01"), ("fine", "a", "2026-01-01 00:00:02"), ("late", "b", "2026-01-01 01:00:00")], "prompt string, identity string, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(source))
    stream = lambda: spark.readStream.schema("prompt string, identity string, ts timestamp").parquet(str(source))
    audit_stream(stream(), str(tmp_path / "audit"), str(tmp_path / "c1")).awaitTermination(120)
    assert sorted(r["decision"] for r in spark.read.parquet(str(tmp_path / "audit")).collect()) == ["ALLOWED", "ALLOWED", "BLOCKED"]
    rate_stream(stream(), str(tmp_path / "rate"), str(tmp_path / "c2"), limit=1).awaitTermination(120)
    assert [(r["requests"], r["denied"]) for r in spark.read.parquet(str(tmp_path / "rate")).collect()] == [(2, 1)]


def workbook(cells: str, styles: str, properties: str = "") -> bytes:
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    return package(
        {
            "xl/workbook.xml": f'<workbook {S} xmlns:r="{rel}">{properties}<sheets><sheet name="x" sheetId="1" r:id="r1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="/xl/s.xml"/></Relationships>',
            "xl/styles.xml": f"<styleSheet {S}>{styles}</styleSheet>", "xl/s.xml": f'<worksheet {S}><sheetData><row r="1">{cells}</row></sheetData></worksheet>',
        }
    )


def test_cell_types():
    from palisade.sources.cells import kind_of

    codes = {164: "yyyy\\-mm\\-dd", 165: "[h]:mm", 166: "[$-409]d/m/yy", 167: '0.00" days"', 168: "[Red]#,##0;d"}
    fmt = "<numFmts>" + "".join(f'<numFmt numFmtId="{n}" formatCode="{c.replace(chr(34), "&quot;")}"/>' for n, c in codes.items()) + "</numFmts>"
    styles = fmt + "<cellXfs>" + "".join(f'<xf numFmtId="{n}"/>' for n in (0, 14, 9, 20, 164, 165, 166, 167, 168, 46)) + "</cellXfs>"
    values = [("0", "5"), ("0", "5.0"), ("0", "1E3"), ("1", "45292"), ("1", "45292.5"), ("1", "1"), ("1", "59"), ("1", "61"), ("2", "0.25"), ("3", "0.5"), ("4", "36526"), ("5", "1.5"), ("6", "0.75"), ("7", "3"), ("8", "4"), ("9", "2"), ("1", "99999999"), ("77", "8")]
    cells = "".join(f'<c s="{s}"><v>{v}</v></c>' for s, v in values) + '<c t="b"><v>1</v></c><c t="e"><v>#DIV/0!</v></c><c t="str"><v>45292</v></c>'
    got = extract(workbook(cells, styles)).units[0][1].split(" | ")
    assert got == [
        "5", "5.0", "1000.0", "2024-01-01 00:00:00", "2024-01-01 12:00:00", "1900-01-01 00:00:00", "1900-02-28 00:00:00", "1900-03-01 00:00:00", "0.25", "12:00:00", "2000-01-01 00:00:00",
        "1 day, 12:00:00", "18:00:00", "3", "4", "2 days, 0:00:00", "#VALUE!", "8", "True", "#DIV/0!", "45292",
    ]
    early = workbook('<c s="1"><v>45292</v></c>', styles, '<workbookPr date1904="1"/>')
    assert extract(early).units[0][1] == "2028-01-02 00:00:00"
    assert [kind_of(c) for c in ("General", "0%", '"day" 0', "h:mm AM/PM", "[mm]:ss", "@", "")] == ["number", "number", "number", "date", "elapsed", "number", "number"]


def test_reports_as_files_and_documents_over_the_limit(spark, tmp_path, monkeypatch):
    import json

    files = spark.createDataFrame([(bytearray(docx("all fine")),), (bytearray(b"PK" + bytes(20 * 1024 * 1024)),)], "content binary")
    reports = inspect_documents(files).cache()
    rows = {r["over_limit"]: r for r in reports.collect()}
    assert rows[False]["sha256"] == rows[False]["doc"] and rows[True]["sha256"] is None and rows[True]["issues"][0] == FAILED and rows[True]["decision"] == "BLOCKED"
    from palisade.sources.documents import write_reports

    write_reports(reports, str(tmp_path / "r"))
    write_reports(reports, f"file://{tmp_path}/r")
    names = sorted(p.name for p in (tmp_path / "r").iterdir())
    assert names == sorted(f"{r['doc']}.{x}" for r in rows.values() for x in ("json", "html"))
    told = json.loads((tmp_path / "r" / f"{rows[False]['doc']}.json").read_text())
    assert told["decision"] == "ALLOWED" and told["findings"][0]["decision"] == "ALLOWED" and "all fine" not in (tmp_path / "r" / f"{rows[False]['doc']}.html").read_text()
