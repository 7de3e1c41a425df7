import io
import zipfile

import packages
import pytest
from pyspark.sql import functions as F

from paperloom.__main__ import main
from paperloom.functions.pages import Options
from paperloom.plans.convert import convert
from paperloom.sources.files import collect
from paperloom.sources.sinks import write_documents, write_report, zip_documents
from paperloom.streaming.watch import watch


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("in")
    (root / "sub").mkdir()
    (root / "Nota é.docx").write_bytes(packages.docx())
    (root / "sub" / "deck.pptx").write_bytes(packages.pptx())
    (root / "old.docx").write_bytes(bytes.fromhex("D0CF11E0A1B11AE1") + b"rest")
    (root / "broken.docx").write_bytes(b"PK nothing")
    (root / "~$x.docx").write_bytes(b"junk")
    (root / "real.pdf").write_bytes(b"%PDF-1.7 x")
    (root / "n.txt").write_text("skipped")
    return str(root)


@pytest.fixture(scope="module")
def made(spark, folder):
    files = collect(spark, [folder], [True])
    return convert(files, Options(anonymize=("email",)))


@pytest.fixture(scope="module")
def units(made):
    rows = made.units.join(made.files.select("doc_id", "name"), "doc_id").collect()
    return {(r.name, r.unit_no): r for r in rows}


def test_word_sections(units):
    doc = {n: r for (name, n), r in units.items() if name.endswith("docx")}
    assert sorted(doc) == [1, 2, 3, 4]
    assert doc[1].markdown == "Intro **bolder** and *it*[site](https://example.org/)[^1]\n\n[^1]: seven"
    assert doc[2].title == "Chapter one"
    assert doc[2].markdown.split("\n") == ["# Chapter one", "", "2024\\. Een jaar \\*ster\\*", "", "kept", "", "1. first", "   1. nested", "2. second", "   1. again", "- dot", "   - deep"]
    assert doc[3].markdown.startswith("# Chapter two\n\n| wide |  | c\\|d |\n|---|---|---|\n| x<br>y |  | z |\n\n![a map](figures/nota-img1.png)\n\nsee[^2][^1]\n\n[^2]: nine")
    assert "[^1]:" not in doc[3].markdown and "gone" not in doc[2].markdown
    assert doc[4].markdown == "# Chapter three"


def test_slides(units):
    deck = {n: r for (name, n), r in units.items() if name.endswith("pptx")}
    assert deck[1].markdown == "## Dia 1: Deck title\n\n- one\n   - two\n- three\n\n**Notities:**\n\n> say this"
    assert deck[2].markdown == "## Dia 2: Box title _(verborgen dia)_\n\nleft\n\nright\n\nearly\n\nlate"
    assert "| h1 | h2 |\n|---|---|\n| a\\|b | c |" in deck[3].markdown
    assert "_Grafiek: Sales_\n\n|  | Reeks 1 |\n|---|---|\n| q1 | 5 |\n| q2 |  |" in deck[3].markdown
    assert "![city map](figures/deck-dia3-img1.png)" in deck[3].markdown
    assert deck[3].warnings == ["ingesloten object niet omgezet"] and deck[1].tables == 0 and deck[3].tables == 2


def test_files_and_report(made):
    rows = {r.bestand: r for r in made.report().collect()}
    assert set(rows) == {"Nota é.docx", "deck.pptx", "old.docx", "broken.docx", "real.pdf"}
    assert rows["deck.pptx"].status == "klaar" and rows["deck.pptx"].eenheden == "3 slides" and rows["deck.pptx"].map == "sub-deck"
    assert all(rows[n].status.startswith("mislukt") for n in ("old.docx", "broken.docx", "real.pdf"))
    assert rows["deck.pptx"]["met waarschuwing"] == 1


def test_documents_and_figures(spark, made, tmp_path):
    docs = {r.doc_id: r.document for r in made.documents().collect()}
    word = next(d for d in docs.values() if "sections: 4" in d)
    assert word.startswith('---\ntitle: "My & title"\nsource_file: "Nota é.docx"\nsections: 4\nextracted_with: "docx_convert (stdlib)"\nanonymized: [email]\n---\n\n<!-- section 1 -->\n\nIntro')
    assert word.endswith("<!-- section 4 -->\n\n# Chapter three\n")
    figures = {r.path: bytes(r.bytes) for r in made.figures.collect()}
    assert figures == {"figures/nota-img1.png": b"png", "figures/deck-dia3-img1.png": b"img"}
    edits = made.units.filter("kind = 'docx' AND unit_no = 4").select("doc_id", "unit_no", F.lit("edited").alias("edited"), F.lit(True).alias("reviewed"))
    row = made.review_report(edits).filter("formaat = 'docx'").first()
    assert (row.nagekeken, row.aangepast, row["map in zip"]) == (1, 1, "nota-e")
    assert any("edited" in r.document for r in made.documents(edits).collect())
    entries = made.documents().select("doc_id", F.lit("x.md").alias("name"), F.encode("document", "utf-8").alias("content"))
    archive = zip_documents(entries).first().archive
    assert zipfile.ZipFile(io.BytesIO(bytes(archive))).namelist() == ["x.md"]
    write_documents(made.documents().withColumn("folder", F.col("doc_id")), str(tmp_path / "out"))
    written = {r.value for r in spark.read.text(str(tmp_path / "out"), wholetext=True).select("value").collect()}
    assert written - {""} == set(docs.values())
    write_report(made.report(), made.report().columns, str(tmp_path / "report"))
    text = next((tmp_path / "report").glob("part-*")).read_bytes()
    assert text.startswith("﻿bestand;pad".encode()) and text.endswith(b"\r\n")


@pytest.fixture(scope="module")
def decks(tmp_path_factory):
    root = tmp_path_factory.mktemp("decks")
    (root / "deck.pptx").write_bytes(packages.pptx())
    return str(root)


def test_options(spark, decks):
    files = collect(spark, [decks], [True])
    bare = convert(files, Options(ignore_images=True, speaker_notes=False, anonymize=()), pages="1,3-9")
    texts = [r.markdown for r in bare.units.collect()]
    assert len(texts) == 2 and not any("figures/" in x or "Notities" in x for x in texts)
    assert Options.of({"dpi": 5, "nonsense": 1}).dpi == 5
    with pytest.raises(ValueError):
        Options.of({"anonymize": ["nope"]})


def test_command_line(spark, decks, tmp_path, capsys):
    assert main([decks, "-o", str(tmp_path / "out"), "--no-images", "--anonymize", "none"]) == 0
    text = (tmp_path / "out" / "deck" / "deck.md").read_text()
    assert next((tmp_path / "out" / "overzicht").glob("part-*")).read_text("utf-8-sig").splitlines()[1].startswith("deck.pptx;")
    assert "## Dia 1: Deck title" in text and "deck.pptx;deck.pptx;pptx;3 slides;3;1;;deck;klaar" in capsys.readouterr().err


def test_probe_by_stream(spark, decks, tmp_path):
    """A stream converts like a batch."""
    out = str(tmp_path / "units")
    query = watch(spark, decks, str(tmp_path / "cp"), lambda c, n: c.units.select("unit_no", "title").write.mode("append").parquet(out), Options(anonymize=()), once=True)
    query.awaitTermination(300)
    assert {(r.unit_no, r.title) for r in spark.read.parquet(out).collect()} == {(1, "Deck title"), (2, "Box title"), (3, "")}
