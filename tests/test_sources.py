"""Sources: workbook folders, CSV file-order row numbers, distributed row
index against brute force."""

import io
import os
import zipfile

from pyspark.sql import functions as F

from conftest import SF_SMALL, write_csv
from ledgerspark.operators.rowindex import with_row_index
from ledgerspark.sources.csv import read_journal_csv
from ledgerspark.sources.preview import preview
from ledgerspark.sources.workbook import read_workbooks, workbook_sheets, workbook_table

_CT = '<?xml version="1.0" encoding="UTF-8"?>'
_MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_RNS = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def _col(i):
    s = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        s = chr(65 + r) + s
    return s


def make_xlsx(sheets: dict[str, list[list]]) -> bytes:
    shared: list[str] = []

    def cell(ref, v):
        if v is None:
            return ""
        if isinstance(v, (int, float)):
            return f'<c r="{ref}"><v>{v}</v></c>'
        if v not in shared:
            shared.append(v)
        return f'<c r="{ref}" t="s"><v>{shared.index(v)}</v></c>'

    parts = {}
    for k, (name, rows) in enumerate(sheets.items(), start=1):
        xml_rows = "".join(
            f'<row r="{r + 1}">' + "".join(cell(f"{_col(c)}{r + 1}", v) for c, v in enumerate(row)) + "</row>"
            for r, row in enumerate(rows)
        )
        parts[f"xl/worksheets/sheet{k}.xml"] = f"{_CT}<worksheet {_MAIN}><sheetData>{xml_rows}</sheetData></worksheet>"
    sheets_xml = "".join(f'<sheet name="{n}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, start=1))
    rels = "".join(
        f'<Relationship Id="rId{k}" Type="worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)
    )
    sst = "".join(f"<si><t>{s}</t></si>" for s in shared)
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/workbook.xml", f"{_CT}<workbook {_MAIN} {_RNS}><sheets>{sheets_xml}</sheets></workbook>")
        z.writestr(
            "xl/_rels/workbook.xml.rels",
            f'{_CT}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>',
        )
        z.writestr("xl/sharedStrings.xml", f"{_CT}<sst {_MAIN}>{sst}</sst>")
        for p, x in parts.items():
            z.writestr(p, x)
    return buf.getvalue()


def test_workbook_folder(spark, workdir):
    folder = os.path.join(workdir, "books")
    os.makedirs(folder)
    head = ["日期", "凭证号", "科目编码", "科目名称", "摘要", "金额"]
    with open(os.path.join(folder, "a.xlsx"), "wb") as f:
        f.write(make_xlsx({"明细账": [head, ["2024-01-02", "001", 1001, "Cash", "x", 100.5], ["2024-01-03", "002", 1002, "Bank", None, -3]], "Other": [["a"], ["b"]]}))
    with open(os.path.join(folder, "b.xlsx"), "wb") as f:
        f.write(make_xlsx({"明细账": [head, ["2024-02-01", "003", 1001.0, "Cash", "y", 7]]}))
    sheets = sorted((os.path.basename(r["file"]), r["sheet"], r["sheet_index"]) for r in workbook_sheets(spark, folder).collect())
    assert sheets == [("a.xlsx", "Other", 1), ("a.xlsx", "明细账", 0), ("b.xlsx", "明细账", 0)]
    cells = read_workbooks(spark, folder, sheet="明细账")
    t = workbook_table(cells, head).orderBy("source_file", "source_row").collect()
    assert [(r["source_row"], r["凭证号"], r["科目编码"], r["金额"], r["摘要"]) for r in t] == [
        (1, "001", "1001", "100.5", "x"),
        (2, "002", "1002", "-3", None),
        (1, "003", "1001", "7", "y"),
    ]
    assert read_workbooks(spark, folder).count() == 4


def test_typed_cells_headers_and_row_numbers(spark, workdir):
    """Date cells, repeated headers and rows that the sheet leaves out."""
    styles = (
        f"{_CT}<styleSheet {_MAIN}><numFmts><numFmt numFmtId='170' formatCode='yyyy/m/d;@'/>"
        "<numFmt numFmtId='171' formatCode='\"day\" 0.00'/></numFmts><cellXfs><xf numFmtId='0'/><xf numFmtId='14'/>"
        "<xf numFmtId='170'/><xf numFmtId='171'/><xf numFmtId='22'/></cellXfs></styleSheet>"
    )
    rows = (
        "<row r='2'><c t='str'><v>d</v></c><c t='str'><v>amt</v></c><c t='str'><v>amt</v></c></row>"
        "<row r='3'><c s='1'><v>45292</v></c><c><v>1</v></c><c><v>2</v></c></row>"
        "<row r='6'><c s='2'><v>45293</v></c><c s='3'><v>45293</v></c><c s='4'><v>45293.5</v></c></row>"
    )
    raw = io.BytesIO(make_xlsx({"S": [["x"]]}))
    with zipfile.ZipFile(raw) as old:
        parts = {n: old.read(n) for n in old.namelist()}
    parts["xl/worksheets/sheet1.xml"] = f"{_CT}<worksheet {_MAIN}><sheetData>{rows}</sheetData></worksheet>".encode()
    parts["xl/styles.xml"] = styles.encode()
    folder = os.path.join(workdir, "typed")
    os.makedirs(folder)
    with zipfile.ZipFile(os.path.join(folder, "t.xlsx"), "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)
    table = workbook_table(read_workbooks(spark, folder), ["d", "amt", "amt_1"])
    got = sorted(tuple(r)[2:] for r in table.collect())
    assert got == [(1, "2024-01-01", "1", "2"), (4, "2024-01-02", "45293", "2024-01-02 12:00:00")]


def test_csv_source_row_across_splits(spark, workdir):
    lines = ["id,val"] + [f"{i},{'x' * 50}" for i in range(1, 3001)]
    for k in range(3):
        write_csv(workdir, f"part{k}.csv", "\n".join(lines[: 1 + 1000 * (k + 1)]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        df = read_journal_csv(spark, [os.path.join(workdir, f"part{k}.csv") for k in range(3)])
        bad = df.filter(F.col("source_row") != F.col("id").cast("long")).count()
        assert bad == 0
        assert df.count() == 6000
        assert df.rdd.getNumPartitions() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_row_index_matches_brute_force(spark):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity")
    got = with_row_index(li, [F.col("l_quantity").desc(), "l_orderkey", "l_linenumber"], "rn")
    rows = got.select("l_orderkey", "l_linenumber", "rn").collect()
    pdf = li.toPandas().sort_values(["l_quantity", "l_orderkey", "l_linenumber"], ascending=[False, True, True])
    expect = {(int(a), int(b)): i + 1 for i, (a, b) in enumerate(zip(pdf.l_orderkey, pdf.l_linenumber))}
    assert {(r[0], r[1]): r[2] for r in rows} == expect


def test_preview_text_and_columns_only(spark):
    df = spark.createDataFrame([(2, None, 1.5), (1, "a", None)], "source_row int, a string, b double")
    rows = preview(df, 10).collect()
    assert [tuple(r) for r in rows] == [("1", "a", ""), ("2", "", "1.5")]
    assert preview(df, 0).count() == 0 and preview(df, 0).columns == ["source_row", "a", "b"]


def test_csv_quotes_breaks_orders_and_surplus_cells(spark, workdir):
    write_csv(workdir, "a.csv", 'id,text,n\n1,"He said ""hi"", ok",z\n2,"two\nlines",y\n3,a,b,surplus\n4,short\n')
    write_csv(workdir, "b.csv", "n,id,text\nq,5,plain\n")
    write_csv(workdir, "c.csv", "id,id,\n6,7,8\n")
    rows = {r["id"]: r for r in read_journal_csv(spark, workdir).collect()}
    assert (rows["1"]["text"], rows["1"]["n"]) == ('He said "hi", ok', "z")
    assert (rows["2"]["text"], rows["2"]["n"], rows["2"]["source_row"]) == ("two\nlines", "y", 2)
    assert (rows["5"]["text"], rows["5"]["n"], rows["5"]["source_file"]) == ("plain", "q", "b.csv")
    assert (rows["6"]["id_1"], rows["6"]["column2"]) == ("7", "8")
    assert {k for k, r in rows.items() if r["_malformed"] is not None} == {"3", "4"}


def test_malformed_records_are_rejected_with_a_reason(spark, workdir):
    from ledgerspark.operators import clean
    from ledgerspark.schema import BatchInfo, DirectAmount, Profile

    write_csv(workdir, "m.csv", "d,v,c,n,s,a\n2024-01-02,V1,1,Cash,x,10\n2024-01-02,V2,1,Cash,x,10,99\n")
    names = dict(zip(("posting_date", "voucher_id", "ac_code", "ac_caption", "description"), "dvcns"))
    src = read_journal_csv(spark, workdir)
    flagged = clean.map_ledger(src, Profile("p", names, DirectAmount("a")), BatchInfo("c", 2024, "b", F.col("source_file")))
    assert [r["voucher_id"] for r in clean.ledger_rows(flagged).collect()] == ["V1"]
    assert [(r["source_row"], r["error_message"]) for r in clean.error_rows(flagged).collect()] == [(2, "列数与表头不符")]


def test_row_numbers_by_file_and_by_order(spark, workdir):
    write_csv(workdir, "nb.csv", "id\n" + "\n".join(str(i) for i in range(1, 501)) + "\n")
    df = read_journal_csv(spark, os.path.join(workdir, "nb.csv"))
    assert df.filter(F.col("source_row") != F.col("id").cast("long")).count() == 0
    li = spark.range(0, 300).select(F.col("id"), (F.col("id") % 7).alias("k"))
    rows = with_row_index(li, [F.col("k"), "id"], "rn").collect()
    want = {i: n + 1 for n, i in enumerate(sorted(range(300), key=lambda i: (i % 7, i)))}
    assert {r["id"]: r["rn"] for r in rows} == want


def test_journal_rows_are_numbered_before_text_is_made(spark, monkeypatch):
    from ledgerspark.sources import journal_fixture as fx

    sorted_columns = []
    own = fx.with_row_index
    monkeypatch.setattr(fx, "with_row_index", lambda df, *a, **k: sorted_columns.extend(df.columns) or own(df, *a, **k))
    raw = fx.raw_journal(spark, "/root/testdata/sf0.001")
    assert sorted_columns and not [c for c in sorted_columns if c.startswith("src_")]
    assert raw.select("source_row").distinct().count() == raw.count() > 0


def test_csv_files_grow_in_number_not_in_rows(spark, monkeypatch):
    import glob

    from ledgerspark.plans import registry

    made = []
    monkeypatch.setattr(registry, "scratch_path", lambda s, n, f=registry.scratch_path: made.append(f(s, n)) or made[-1])
    monkeypatch.setattr(registry, "_CSV_FILE_ROWS", 250)
    out = registry.QUERIES["csv_source"](spark, "/root/testdata/sf0.001")
    n = out.count()
    assert out.filter("file_order_ok").count() == n > 2000
    assert len(glob.glob(f"{made[-1]}/*/*.csv")) >= n // 250


def test_the_overview_s_imports_share_one_join(spark, monkeypatch):
    from ledgerspark.plans import registry

    plans = []
    own = registry.import_batch
    told = lambda raw: plans.append(raw._jdf.queryExecution().optimizedPlan().toString())
    monkeypatch.setattr(registry, "import_batch", lambda raw, *a, **k: told(raw) or own(raw, *a, **k))
    registry.QUERIES["dataset_overview"](spark, "/root/testdata/sf0.001")
    assert len(plans) == 3 and not [p for p in plans if "Join" in p]
