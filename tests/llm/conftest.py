import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "The quick brown fox jumps over the lazy dog while {} other animals of the forest look at it and are not at all amused by this"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls everywhere, empty and long texts, copies, repeated rows."""
    long = " ".join(f"word{i % 977} of the text, number {i}." for i in range(30_000))
    rows = [
        (1, PROSE.format("seven"), "en", "a", 10), (2, PROSE.format("seven"), "en", "a", 10), (2, PROSE.format("seven"), "en", "a", 10), (3, PROSE.format("eight"), None, None, None),
        (4, "", "en", "a", 0), (5, None, "en", "a", None), (None, PROSE.format("seven").upper(), "en", "b", 1), (None, None, None, None, None), (6, long, "en", "a", 5),
        (7, "  \n\t ", "fr", "a", 5), (8, "#$%& ||| 123 €漢字\U0001f600 ééé", "de", "a", 5), (9, "Hi", "en", "c", 2), (10, "line one\nline one\nline one\n" * 30, "en", "c", 2),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
