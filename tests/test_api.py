"""The service from upload to answer, and its errors."""

import json

import pytest

from folioquery.api import Engine, ServiceError
from folioquery.sources import documents


def test_from_upload_to_answer(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "rates.txt").write_text("The repo rate is set by the central bank. It is announced six times a year.")
    (folder / "fees.txt").write_text("Fees of R2 million apply under code 511 01.")
    engine = Engine(spark, f"file://{tmp_path}/store")
    for wrong in (lambda: engine.search(["x"]), lambda: engine.document("none"), lambda: engine.upload(f"file://{tmp_path}/odd.doc")):
        (tmp_path / "odd.doc").write_text("x")
        with pytest.raises(ServiceError):
            wrong()
    listed = engine.upload(f"file://{folder}").collect()
    assert {r["filename"] for r in listed} == {"rates.txt", "fees.txt"} and engine.health()["generation"] > 0
    best = engine.search(["what is code 511 01?"], top_k=1).first()
    assert best["filename"] == "fees.txt" and best["score"] > best["similarity"]
    out = engine.chat(["who sets the repo rate?"])
    assert "[1]" in out["answers"].first()["answer"] and out["citations"].count() >= 1
    assert out["evaluation"].where("cited").first()["answer_similarity"] is not None
    with pytest.raises(ServiceError) as error:
        engine.search([" "])
    assert error.value.status == 400
    assert engine.delete(listed[0]["document_id"]) == 1 and engine.documents().count() == 1


def test_pdf_by_a_plugged_reader(spark, tmp_path):
    words = [{"text": "Hello", "x0": 36, "x1": 60, "top": 100, "bottom": 110}, {"text": "there", "x0": 64, "x1": 90, "top": 100, "bottom": 110}]
    (tmp_path / "a.pdf").write_text(json.dumps([{"words": words}]))
    (tmp_path / "b.pdf").write_text("no pages")
    found = documents.files(spark, f"file://{tmp_path}/*.pdf")
    read = documents.parsed(found, lambda content: json.loads(content))
    rows = documents.blocks(documents.pages_of_documents(read)).collect()
    assert [(r["pdf_page"], r["raw_text"], r["filename"]) for r in rows] == [(1, "Hello there", "a.pdf")]
    assert [r["filename"] for r in read.where("error IS NOT NULL").collect()] == ["b.pdf"]
    engine = Engine(spark, f"file://{tmp_path}/store", extract=lambda content: json.loads(content))
    assert {r["filename"]: r["status"] for r in engine.upload(f"file://{tmp_path}/*.pdf").collect()} == {"a.pdf": "completed", "b.pdf": "failed"}
    assert engine.search(["hello"]).first()["filename"] == "a.pdf"
