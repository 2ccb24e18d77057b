from pathlib import Path

PACKAGE = Path(__file__).resolve().parents[1] / "weft"


def sources(below):
    return {f: f.read_text() for f in below.rglob("*.py")}


def test_nothing_imports_the_subpackage():
    for f, text in sources(PACKAGE).items():
        if "llm" not in f.parts:
            assert "weft.llm" not in text and "from . import llm" not in text, f


def test_no_unsafe_shortcuts():
    for f, text in sources(PACKAGE).items():
        assert "localCheckpoint" not in text and "crossJoin" not in text and ".rdd" not in text and "toPandas" not in text, f
