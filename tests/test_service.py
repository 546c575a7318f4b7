"""Settings, events and the command."""

import json
import logging
import re

import pytest
from foliant import __main__ as command
from foliant import events
from foliant.functions import normalize as N
from foliant.operators import model as M
from foliant.operators.engine import Engine
from foliant.operators.match import Template
from foliant.operators.settings import Settings
from foliant.sources.templates import read_templates
from pyspark.sql import functions as F

TEXT = "Acme B.V.\nFactuurnummer: INV-2024-17\nFactuurdatum: 03-02-2024\nValuta: EUR\nTotaal incl. BTW: 121,00\n"


def test_settings():
    plain = Settings.read({})
    assert plain.folders == ("/app/templates",) and plain.store == "/app/templates" and plain.provider is None
    assert not plain.options.use_model and not plain.options.heal and plain.options.rounds == 3
    full = Settings.read({"OCR_LLM_PROVIDER": "Ollama", "OLLAMA_MODEL": "m", "OLLAMA_TIMEOUT": "x", "OCR_TEMPLATE_DIRS": " a, ,b", "OCR_TEMPLATE_HEALING_MAX_ATTEMPTS": "0", "OCR_AUTO_GENERATE_TEMPLATES": "on", "OCR_REQUIRED_FIELDS": "date, date,amount"})
    assert full.folders == ("a", "b") and full.store == "b" and full.options.rounds == 1 and full.options.heal and full.options.required == ("date", "amount")
    assert full.provider.template_model == "m" and full.provider.seconds == 60 and full.provider.pages == 4
    assert M.provider({"OCR_OPENROUTER_FALLBACK": "yes"}) == "openrouter" and M.provider({"OCR_LLM_PROVIDER": "x", "OCR_OPENROUTER_FALLBACK": "yes"}) == "none"
    with pytest.raises(ValueError):
        Settings.read({"OCR_REQUIRED_FIELDS": " , "})


def test_engine_of_settings(spark, tmp_path):
    (tmp_path / "nl").mkdir()
    (tmp_path / "nl" / "t.yml").write_text("issuer: Acme\nkeywords: [Acme]\nfields: {date: '(\\d+)'}\n")
    made = Settings.read({"OCR_TEMPLATE_DIRS": f"{tmp_path},{tmp_path}/none", "OCR_LLM_PROVIDER": "ollama"}).engine(spark, {"ollama": lambda p: M.NoAdapter()})
    assert [t.issuer for t in made.templates] == ["Acme"] and made.options.use_model


def test_events(monkeypatch, capsys):
    line = lambda **more: json.loads(events.JsonLines().format(logging.makeLogRecord({"name": "foliant", "levelname": "INFO", "msg": "m", "created": 0.5} | more)))
    assert line() == {"timestamp": "1970-01-01T00:00:00.500+00:00", "level": "INFO", "logger": "foliant", "message": "m"}
    assert line(action="a", context={"b": {1}, "é": None})["context"] == {"b": [1], "é": None}
    fault = (ValueError, ValueError("x"), None)
    monkeypatch.delenv("OCR_DEBUG", raising=False)
    assert "exception" not in line(exc_info=fault)
    monkeypatch.setenv("OCR_DEBUG", "yes")
    assert "ValueError: x" in line(exc_info=fault)["exception"]
    before = events.log.handlers[:], events.log.level, events.log.propagate
    try:
        events.configure(force=True)
        events.event("template.stored", path="p", round=None)
        told = json.loads(capsys.readouterr().err)
        assert told["action"] == "template.stored" and told["context"] == {"path": "p"}
    finally:
        events.log.handlers[:], events.log.level, events.log.propagate = before


def test_counts_come_with_the_pass(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, "nothing"), (3, None)], "doc_id long, text string")
    responses, counts = events.observed(Engine([Template("Acme", ("Acme",), {"date": r"Factuurdatum: (\S+)"}, ("t.yml",))]).extract(docs))
    got = [r["status"] for r in responses.collect()]
    assert counts.get == {"documents": 3} | {s: got.count(s) for s in ("success", "partial", "failed")}


def test_sessions(spark):
    names = [r[0] for r in spark.createDataFrame([("/a/b.c/" + "n" * 50 + ".tar.pdf",), (".hidden",), ("plain",)], "path string").select(N.session(F.col("path"))).collect()]
    assert [bool(re.fullmatch(p + "-[0-9a-f]{32}", n)) for p, n in zip(("ocr-n{40}", r"ocr-\.hidden", "ocr-plain"), names, strict=True)] == [True] * 3
    assert len({n[-32:] for n in names}) == 3


def test_command(spark, tmp_path, capsys):
    sample, folder = tmp_path / "sample.txt", tmp_path / "templates"
    sample.write_text(TEXT)
    given = [str(sample), "--issuer", "Acme B.V.", "--invoice-number-label", "Factuurnummer", "--date-label", "Factuurdatum", "--amount-label", "Not there", "--template-dir", str(folder)]
    assert command.main(given, spark) == 0 and "Not there" in capsys.readouterr().out
    assert command.main(given, spark) == 0  # nothing is overwritten
    assert sorted(p.name for p in folder.rglob("*.yml")) == ["template.yml", "template_1.yml"]
    assert command.main([*given, "--output", str(tmp_path / "own" / "one.yml")], spark) == 0 and (tmp_path / "own" / "one.yml").exists()
    good, bad = read_templates(spark, str(folder))
    assert len(good) == 2 and not bad and good[0].issuer == "Acme B.V."
    scan = tmp_path / "sample.pdf"
    scan.write_bytes(b"%PDF")
    assert command.main([str(scan), *given[1:]], spark) == 2
    assert command.main([str(scan), *given[1:]], spark, reader=lambda content: [TEXT]) == 0
    assert len(list(folder.rglob("*.yml"))) == 3
