import re
import zlib

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def crc(doc_id, modulus):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % modulus


@pytest.fixture
def documents(spark):
    """Makes a documents table of (doc_id, text) rows; further columns have names that operators use inside."""
    def make(rows):
        return spark.createDataFrame(
            [(i, t, "en", "s", None, "x", 1) for i, t in rows], DOC + ", fp string, rate int").repartition(3)

    return make


#: Nulls, empty and blank texts, a repeated row, one doc_id with two texts, separators and odd characters.
ODD = [
    (0, "One two three four five six seven eight nine ten."), (1, None), (2, ""), (3, " \t\n"), (4, "word"),
    (5, "Ein\x0bZwei\x1cDrei vier fünf Été été"), (6, "same text here"), (6, "same text here"), (7, "first"), (7, "second"),
    (None, "no id"), (None, None), (8, "long " * 3000), (9, "wörter! " * 40 + "<|endoftext|> it's | a|b don't."),
]
