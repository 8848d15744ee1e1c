"""Readers on files made here, the store and the streams."""

import io
import zipfile
import zlib

from pyspark.sql import functions as F

from fathomry.operators import bm25
from fathomry.sources import files, office, pdf, store
from fathomry.streaming import events


def archive(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/") + ".xml", text)
    return out.getvalue()


XLSX = archive(
    xl__workbook='<workbook xmlns="m"><sheets><sheet name="Pay"/></sheets></workbook>',
    xl__sharedStrings="<sst><si><t>Name</t></si><si><r><t>To</t></r><r><t>tal</t></r></si></sst>",
    xl__worksheets__sheet1='<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2" t="inlineStr"><is><t>Ann</t></is></c><c r="B2" t="b"><v>1</v></c><c r="C2"><v>12.5</v></c></row></sheetData></worksheet>',
)
DOCX = archive(word__document="<document><body><p><r><t>One</t><tab/><t>two</t></r></p><tbl><tr><tc><p><r><t>a</t></r></p></tc><tc><p><r><t>b</t></r></p></tc></tr></tbl></body></document>")


def make_pdf(content, extra=b"", packed=False):
    body = zlib.compress(content) if packed else content
    head = b"/Filter /FlateDecode " if packed else b""
    return b"%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj\n2 0 obj<</Type/Pages/Kids[3 0 R]/Count 1/Resources<</Font<</F1 5 0 R>>>>>>endobj\n3 0 obj<</Type/Page/Parent 2 0 R/Contents 4 0 R>>endobj\n4 0 obj<<" + head + b"/Length " + str(len(body)).encode() + b">>stream\n" + body + b"\nendstream endobj\n5 0 obj<</Type/Font" + (b"/ToUnicode 6 0 R" if extra else b"") + b">>endobj\n" + extra


def test_office_files():
    assert office.xlsx_text(XLSX) == "=== Sheet: Pay ===\nName\t\tTotal\nAnn\tTRUE\t12.5"
    assert office.docx_text(DOCX) == "One\ttwo\n\na\tb" and office.column_number("AA7") == 26


def test_pdf_text():
    assert pdf.pdf_text(make_pdf(b"BT (Hello \\(world\\)) Tj 0 -14 Td (next) Tj ET")) == "Hello (world)\nnext"
    assert pdf.pdf_text(make_pdf(b"BT [(Hel) -20 (lo) -400 (you)] TJ ET", packed=True)) == "Hello you"
    cmap = b"beginbfchar <0001> <0041> endbfchar beginbfrange <0002> <0003> <0042> endbfrange"
    extra = b"6 0 obj<</Length " + str(len(cmap)).encode() + b">>stream\n" + cmap + b"\nendstream endobj"
    assert pdf.pdf_text(make_pdf(b"BT /F1 12 Tf <000100020003> Tj ET", extra)) == "ABC"
    assert pdf.pdf_text(b"no pdf at all") == "" and pdf.pdf_text(make_pdf(b"q 1 0 0 1 0 0 cm Q")) == ""
    assert pdf.healed("W o r d  t w o") == "Word two" and pdf.run_length(b"\x02abc\xfed\x80") == b"abcddd"
    assert pdf.lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == b"-----A---B"
    assert pdf.unpredict(bytes([2, 1, 2, 2, 1, 1]), 12, 2) == bytes([1, 2, 2, 3])


def test_folders(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in (("a.txt", b"alpha\xff"), ("sub/b.md", b"beta"), ("c.xyz", b"x"), (".hidden.txt", b"x"), ("e.txt", b"  "), ("s.xlsx", XLSX), ("bad.docx", b"broken"), ("p.pdf", make_pdf(b"BT (text) Tj ET"))):
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[-1]: (r.text, r.error is None) for r in files.read_folder(spark, str(tmp_path)).collect()}
    assert got.pop("s.xlsx")[0].startswith("=== Sheet: Pay") and not got.pop("bad.docx")[1]
    assert got == {"a.txt": ("alpha", True), "b.md": ("beta", True), "p.pdf": ("text", True)}
    out = files.stream_folder(spark, str(tmp_path)).writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / ".ck")).trigger(availableNow=True).start()
    out.awaitTermination()
    assert spark.table("arrived").count() == 5


def test_store(spark, tmp_path):
    posts = bm25.postings(spark.createDataFrame([(1, "a b a")], "doc_id long, text string"))
    store.save({"postings": posts}, f"{tmp_path}/i")
    assert sorted(map(tuple, store.load(spark, f"{tmp_path}/i")["postings"].collect())) == sorted(map(tuple, posts.collect()))


def test_streamed_postings_equal_the_batch(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    events.ingest_postings(stream, f"{tmp_path}/out", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").select("doc_id", "term", "tf", "dl")
    expected = bm25.postings(docs).select("doc_id", "term", "tf", "dl")
    assert got.count() == expected.count() and got.exceptAll(expected).isEmpty()


def test_streamed_trips(spark, tmp_path):
    rows = spark.createDataFrame([(7, f"2024-01-01 00:0{i}:00", "high") for i in range(4)] + [(8, "2024-01-01 00:00:00", "high")], "user_id long, ts string, severity string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/e")
    events.windowed_trips(stream, 10, 3).writeStream.format("memory").queryName("trips").outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert {r.user_id for r in spark.table("trips").collect()} == {7}
