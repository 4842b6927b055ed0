"""Spreadsheets written and read back, and encodings told from bytes."""

import datetime
import hashlib
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tesserae.operators import export as ex
from tesserae.sources import ingest, xlsx

TEXTS = ["plain", " <a & b> ", "two\nlines\tand a tab", "_x0041_ stays", "bell \x07 and \x1f", "é漢😀", "'\"", "x" * 40_000, "", None, "1", "TRUE"]


def test_odd_cells_come_back(spark, tmp_path):
    rows = [(i, t, i / 3, i % 2 == 0, [t or "", "z"], datetime.date(2024, 2, 29), 10**17 + i) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "n long, text string, share double, even boolean, many array<string>, day date, large long")
    path = f"file://{tmp_path}/sheets.xlsx"
    ex.write_xlsx(df.repartition(3), path)
    got = {r.n: r for r in ingest.read_any(spark, path).collect()}
    for n, text, share, even, many, day, large in rows:
        r = got[str(n)]
        assert r.text == (text or None) and float(r.share) == share and r.even == str(even).lower() and r.day == str(day) and r.large == str(large)
        assert r.many == "|".join(many)


def test_files_hold_so_many_rows_and_appear_on_commit(spark, tmp_path):
    path = f"file://{tmp_path}/sheets"
    df = spark.range(25).select(F.col("id").alias("a b"), (F.col("id") * 2).alias("c`d"))
    xlsx.write(df.coalesce(1), path, rows=10)
    names = sorted(p.name for p in (tmp_path / "sheets").iterdir())
    assert len(names) == 3 and all(n.startswith("part-") for n in names)
    assert sorted((int(r[0]), int(r[1])) for r in xlsx.read(spark, path).collect()) == [(i, 2 * i) for i in range(25)]
    xlsx.write(df.limit(0), path, "overwrite")
    assert [p.name for p in (tmp_path / "sheets").iterdir()] == ["part-empty.xlsx"] and xlsx.read(spark, path).columns == ["a b", "c`d"] and xlsx.read(spark, path).count() == 0
    with pytest.raises(Exception, match="boom"):
        xlsx.write(df.select(F.when(F.col("a b") == 24, F.raise_error(F.lit("boom"))).otherwise(F.col("a b")).alias("x")).coalesce(1), path)
    assert len([p for p in (tmp_path / "sheets").iterdir() if not p.name.startswith("_")]) == 1


def test_sheets_of_other_programs(spark, tmp_path):
    """Shared strings, rich text, gaps, formulas, blank headers and a sheet that is not the first part."""
    main, links = xlsx.MAIN, xlsx.LINKS
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{links}"><sheets><sheet name="b" sheetId="2" r:id="r2"/><sheet name="a" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{xlsx.PACKAGE}/relationships"><Relationship Id="r1" Type="t" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="t" Target="/xl/worksheets/sheet9.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{main}"><si><t>name</t></si><si><r><t>ri</t></r><r><t>ch</t></r><rPh sb="0" eb="1"><t>no</t></rPh></si></sst>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData><row><c><v>9</v></c></row></sheetData></worksheet>',
        "xl/worksheets/sheet9.xml": f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>n</t></is></c></row><row r="2"/><row r="5"><c r="A5" t="s"><v>1</v></c><c r="C5"><f>1+1</f><v>2</v></c><c r="E5"><v>7</v></c></row><row r="6"><c r="C6" t="b"><v>1</v></c></row></sheetData></worksheet>',
    }
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as held:
        for name, content in parts.items():
            held.writestr(name, content)
    assert [tuple(r) for r in ingest.read_any(spark, f"file://{tmp_path}/a.xlsx").select("name", "n").collect()] == [("rich", "2"), (None, "true")]


def test_columns_are_lettered():
    assert [xlsx.column_name(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert all(xlsx.column_number(xlsx.column_name(i) + "12") == i for i in range(2000))
    out = io.BytesIO()
    sheet = xlsx.Sheet(out, ["a"])
    sheet.add([float("nan")])
    sheet.close()
    assert list(xlsx.rows_of(out.getvalue())) == [["a"], ["nan"]]


@pytest.mark.parametrize(
    ("text", "encoding", "told"),
    [
        ("déjà vu, où est la forêt ? Ça va très bien", "latin-1", "ISO-8859-1"),
        ("“quoted” – Crème brûlée 5 €", "cp1252", "windows-1252"),
        ("Größe, Mädchen, Füße, schön", "latin-1", "ISO-8859-1"),
        ("El niño comió piñas mañana", "latin-1", "ISO-8859-1"),
        ("Zażółć gęślą jaźń", "iso-8859-2", "ISO-8859-2"),
        ("Příliš žluťoučký kůň úpěl ďábelské ódy", "iso-8859-2", "ISO-8859-2"),
        ("árvíztűrő tükörfúrógép", "iso-8859-2", "ISO-8859-2"),
        ("これは日本語のテキストです。カタカナも", "shift_jis", "Shift_JIS"),
        ("plain words only", "ascii", "UTF-8"),
        ("naïve Ωμέγα", "utf-8", "UTF-8"),
        ("id,text\nsome plain words", "utf-16-le", "UTF-16LE"),
        ("id,text\nsome plain words é", "utf-16-be", "UTF-16BE"),
        ("with a mark", "utf-16", "UTF-16"),
        ("", "utf-8", "UTF-8"),
    ],
)
def test_encodings_are_told(text, encoding, told):
    assert ingest.encoding_of(text.encode(encoding)) == told


def test_packed_exports_are_recognised_and_read_back(spark, tmp_path):
    from tesserae.operators import export as ex
    from tesserae.sources import ingest as ig

    rows = [(1, 'é;"x"\nnext'), (2, "plain")]
    df = spark.createDataFrame(rows, "id long, text string")
    for name, write in (("a.csv", lambda p: ex.write_csv(df, p, sep="|", compression="gzip")), ("a.jsonl", lambda p: ex.write_json(df, p, "gzip"))):
        path = f"file://{tmp_path}/{name}"
        write(path)
        assert all(f.endswith(".gz") for f, _ in ig.data_files(spark, path)) and ig.head(spark, path)[:2] != b"\x1f\x8b"
        assert sorted((int(r.id), r.text) for r in ig.read_any(spark, path).collect()) == rows


def test_csv_cells_come_back_letter_by_letter(spark, tmp_path):
    """Empty is not null, and no letter is lost from a quoted cell; short rows and cells with nothing in them are null."""
    texts = [None, "", " ", '"', '""', "\x00", 'a\x00"b', "\n\x00", "a\rb\r\nc", ";'a';'b';'c';" * 50, "\\", '\\"', "|\t,"]
    rows = [(str(i), t, "en") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id string, text string, lang string")
    for sep in ",;|\t":
        path = f"file://{tmp_path}/{ord(sep)}.csv"
        ex.write_csv(df.coalesce(1), path, sep=sep)
        assert sorted(map(tuple, ingest.read_csv(spark, path).collect()), key=lambda r: int(r[0])) == rows
    (tmp_path / "short.csv").write_text('a,b\n1,\n2,""\n3\n4,x,y\n5,z,""\n')
    assert sorted(map(tuple, ingest.read_csv(spark, f"file://{tmp_path}/short.csv").collect())) == [("1", None), ("2", ""), ("3", None), ("5", "z")]


def test_delimiter_is_one_of_the_header():
    assert ingest.delimiter_of("id,text\n" + "".join(f"""{i},";'a';'b';"\n""" for i in range(9))) == ","
    assert ingest.delimiter_of("a;b,c\n1;2,5\n3;4,5\n") in ";,"


def test_empty_texts_of_csv_exports_are_those_of_the_sql(spark, tmp_path):
    from tesserae.plans import exports

    rows = [(0, "", "en", "a", 0), (1, None, "de", "b", 0), (2, 'x\x00"', None, "c", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    want = [(str(i), t if t is None else hashlib.md5(t.encode()).hexdigest(), lang) for i, t, lang, _, _ in rows]
    for name in ("csv_sink", "source_brandwatch", "source_meta", "source_news", "source_twitter"):
        got = exports.QUERIES[name](spark, f"file://{tmp_path}").select("post_id", "text_md5", "language")
        assert sorted(map(tuple, got.collect())) == want, name
    told = {r.column: r.filled for r in exports.QUERIES["suggest_mapping_rows"](spark, f"file://{tmp_path}").collect()}
    assert told["Body"] == 1 and told["user.Lang"] == 2
