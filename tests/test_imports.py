"""Files from elsewhere: by cases on real files."""

import datetime as dt
import hashlib
import os
import zipfile

from pyspark.sql import functions as F

from studylake.operators import imports
from studylake.sources import word

STAMP = dt.datetime(2025, 7, 5, 14, 39, tzinfo=dt.UTC)


def written(folder, name, text):
    path = folder / name
    path.write_bytes(text.encode())
    os.utime(path, (STAMP.timestamp(),) * 2)


def test_a_folder_is_planned_brought_in_and_verified(spark, tmp_path):
    folder = tmp_path / "Drop" / "_Past" / "Accounting" / "Study Terms"
    folder.mkdir(parents=True)
    written(folder, "Accounts recievable.md", "---\ntype: \nReviewed: \ntags:\n---\n\n# At a Glance\n- Asset [[Credit.PNG]] [[x/y.pdf|p]] [[Other]]\n")
    written(folder, "Cost Side.md", "---\ntags:\n  - Accounting\nDate: '[[<% tp.date.now(\"YYYY-MM-DD\") %>]]'\ntype: Transaction\n---\n\nThe debit half of the entry.\n")
    written(folder, "Perpetual.md", "---\ntitle: Perpetual Inventory System\ncreated: 2025-06-30\ntags: [inventory, accounting]\n---\n\nStock is updated per sale.\n")
    written(folder, "Accrued.md", "")
    written(folder, "Retained.md", "---\ntags:\n---\n")
    written(folder, "Drawing.md", "---\nexcalidraw-plugin: parsed\ntags: [excalidraw]\n---\n\n# Data\n")
    written(folder, "Mine.md", "---\nid: 1\n---\n\nbody\n")
    written(folder, "202507051440.md", "stamped")
    none = spark.createDataFrame([], "source string, id string")
    files = imports.files_of(spark, str(folder))
    where = F.lit("Drop/_Past/Accounting/Study Terms")
    plan = imports.decided(files, where, "30-Resources", none)
    got = {r["source"]: r for r in plan.collect()}
    assert {s: r["reason"] for s, r in got.items() if r["action"] == "skip"} == {"Retained.md": "no body", "Drawing.md": "a drawing", "Mine.md": "has an id"}
    side, own, stamped = got["Cost Side.md"], got["Perpetual.md"], got["202507051440.md"]
    assert side["provisional"] and side["created_from"] == "file-mtime" and side["tags"] == ["accounting", "study-terms"]
    assert own["title"] == "Perpetual Inventory System" and own["created"].date() == dt.date(2025, 6, 30) and not own["provisional"] and own["tags"] == ["accounting", "study-terms", "inventory"]
    assert own["dest"] == "30-Resources/Accounting/Study Terms/perpetual-inventory-system--20250630T000000.md"
    assert stamped["created_from"] == "filename" and stamped["id"].startswith("20250705T144000-")
    assert {r["asset"] for r in imports.shown_assets(plan, files).collect()} == {"Credit.PNG", "y.pdf"}
    made = imports.manifest(plan, files, "first")
    rows = {r["source"]: r for r in made.collect()}
    assert len(rows) == 4 and rows["Cost Side.md"]["sha256"] == hashlib.sha256((folder / "Cost Side.md").read_bytes()).hexdigest()
    made.write.parquet(str(tmp_path / "manifest"))
    again = imports.decided(files, where, "30-Resources", spark.read.parquet(str(tmp_path / "manifest")).select("source", "id"))
    assert again.filter("action = 'adopt'").count() == 0 and again.filter("reason = 'already adopted'").count() == 4
    written(folder, "Cost Side.md", "changed")
    (folder / "Perpetual.md").unlink()
    states = imports.verified(spark.read.parquet(str(tmp_path / "manifest")), imports.files_of(spark, str(folder)))
    assert {r["source"]: r["state"] for r in states.collect() if r["state"] != "intact"} == {"Cost Side.md": "changed", "Perpetual.md": "missing"}


def docx(path, paragraphs):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    made = "".join(f'<w:p><w:pPr>{"<w:numPr/>" if s == "List" else f"<w:pStyle w:val=\"{s}\"/>"}</w:pPr>{x}</w:p>' for s, x in paragraphs)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(word.PART, f"<w:document {w}><w:body>{made}</w:body></w:document>")


def test_word_documents(spark, tmp_path):
    run = lambda t: f"<w:r><w:t>{t}</w:t></w:r>"
    docx(tmp_path / "a.docx", [("Heading1", run("Mitosis &amp; ") + run("meiosis")), ("Normal", run("is defined") + "<w:r><w:tab/></w:r>" + run("as division")), ("Normal", ""), ("Normal", ""), ("List", run("Prophase")), ("Heading7", run("Deep"))])
    (tmp_path / "b.docx").write_bytes(b"no archive")
    with zipfile.ZipFile(tmp_path / "c.docx", "w") as z:
        z.writestr("other.xml", "<x/>")
    (tmp_path / "d.txt").write_text("no")
    got = {r["path"][-6:]: r for r in word.word_files(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.docx", "b.docx", "c.docx"} and got["a.docx"]["error"] is None
    assert got["a.docx"]["text"] == "## Mitosis & meiosis\nis defined as division\n\n- Prophase\n#### Deep"
    assert got["b.docx"]["text"] is None and "BadZipFile" in got["b.docx"]["error"] and "KeyError" in got["c.docx"]["error"]
