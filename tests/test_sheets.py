"""Folders of sheets with different layouts."""

import io
import zipfile

from pyspark.sql import functions as F

from tideline.sources import sheets


def workbook(*tables: tuple[str, dict[int, list]]) -> bytes:
    """An XLSX file: sheets with rows by their number; texts are shared, inline or formulas' results in turn."""
    shared, parts = [], {}
    for k, (_, rows) in enumerate(tables):
        xml = []
        for n, cells in rows.items():
            row = []
            for c, v in enumerate(cells):
                ref = f"{chr(65 + c)}{n + 1}"
                if v is None:
                    continue
                if isinstance(v, str) and (c + n) % 2:
                    shared.append(v)
                    row.append(f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>')
                elif isinstance(v, str):
                    row.append(f'<c r="{ref}" t="inlineStr"><is><r><t>{v[:1]}</t></r><r><t>{v[1:]}</t></r></is></c>')
                else:
                    row.append(f'<c r="{ref}"><v>{v}</v></c>')
            xml.append(f'<row r="{n + 1}">{"".join(row)}</row>')
        parts[f"xl/worksheets/sheet{k}.xml"] = f'<worksheet xmlns="m"><sheetData>{"".join(xml)}</sheetData></worksheet>'
    parts["xl/workbook.xml"] = '<workbook xmlns="m" xmlns:r="r"><sheets>' + "".join(f'<sheet name="{name}" r:id="i{k}"/>' for k, (name, _) in enumerate(tables)) + "</sheets></workbook>"
    parts["xl/_rels/workbook.xml.rels"] = '<Relationships xmlns="p">' + "".join(f'<Relationship Id="i{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(len(tables))) + "</Relationships>"
    parts["xl/sharedStrings.xml"] = '<sst xmlns="m">' + "".join(f"<si><t>{x}</t></si>" for x in shared) + "</sst>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_three_layouts_in_one_frame(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.csv").write_text("﻿Table 1,,\nBanks,Gross NPA,\n,FY2021,2022\nAxis Bank,\"1,234.5\",-\nTotal,9,9\nNationalised Banks,,\nYes Bank,NA,7\n")
    (tmp_path / "sub" / "b.XLSX").write_bytes(workbook(("One", {3: [None, "Name of the Bank", "net npa", None, "Unnamed: 4"], 4: [None, None, "Mar 2023", "Mar 2024", "2024"], 5: [1, "Axis Bank", 5, 6.5, 8], 7: [2, " Old Bank ", "*", "n.a.", 8]}), ("No header", {0: ["x", "y"]}), ("Two", {0: ["NAME OF BANK", "car"], 1: [None, "2025"], 2: ["Axis Bank", "12"]})))
    (tmp_path / "broken.xlsx").write_bytes(b"no zip")
    (tmp_path / "notes.txt").write_text("Banks,x\n,2021\nA,1\n")
    cells = sheets.read_cells(spark, str(tmp_path))
    got = sorted((r.file.rsplit("/", 1)[-1], r.sheet, r.bank, r.metric, r.year, r.value, r.text) for r in sheets.bank_metrics(cells).collect())
    assert got == sorted([
        ("a.csv", "", "Axis Bank", "Gross NPA", 2021, 1234.5, "1,234.5"), ("a.csv", "", "Yes Bank", "Gross NPA", 2022, 7.0, "7"),
        ("b.XLSX", "One", "Axis Bank", "Net NPA", 2023, 5.0, "5"), ("b.XLSX", "One", "Axis Bank", "Net NPA", 2024, 6.5, "6.5"), ("b.XLSX", "One", "Old Bank", "Net NPA", 2024, None, "n.a."),
        ("b.XLSX", "Two", "Axis Bank", "Capital Adequacy Ratio (Basel-III)", 2025, 12.0, "12"),
    ])
    wide = sheets.union_by_name(sheets.read_tables(cells))
    assert {"Banks", "Gross NPA", "Name of the Bank", "net npa", "NAME OF BANK", "car"} <= set(wide.columns)
    assert wide.where(F.col("NAME OF BANK") == "Axis Bank").first()["car"] == "12"


def test_repeated_names_get_suffixes(spark):
    df = spark.createDataFrame([(["a", "b", "a", None, " a ", "a.1", " ", "b"],), ([],)], "x array<string>")
    assert [r.y for r in df.select(sheets.suffixed(F.col("x")).alias("y")).collect()] == [["a", "b", "a.2", None, "a.3", "a.1", None, "b.1"], []]


def test_an_empty_folder(spark, tmp_path):
    (tmp_path / "x.csv").write_text("")
    assert sheets.bank_metrics(sheets.read_cells(spark, str(tmp_path))).count() == 0
