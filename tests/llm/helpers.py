"""Brute-force versions and awkward rows."""

import re
import zlib

LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{i} the of" for i in range(12_000))

#: Nulls, empty texts, white space alone, repeated rows, ties, other scripts, a very long text.
AWKWARD = [
    (1, "the quick brown fox jumps over the lazy dog and runs away"), (2, "the quick brown fox jumps over the lazy dog and runs away"), (3, None), (4, ""), (5, "   \n\t "), (6, "one"), (7, "one two"), (8, "ONE two"),
    (9, "Ünïcode wörds — 日本語 テキスト …"), (10, LONG), (11, LONG + " tail"), (12, "aaaa" * 200), (None, "the quick brown fox"), (13, "x" * 500), (13, "x" * 500), (14, "ÉCOLE École école"), (15, "\u00a0\u3000 odd  spaces \x1c"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, id long, items string"


def frame(spark, rows=AWKWARD):
    """Rows with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 0.5, 7, "z") for i, t in rows], SCHEMA)


def lower(text):
    return (text or "").translate(LETTERS)


def white_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def letter_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def fold(key, n):
    return zlib.crc32(str(key).encode()) % n


class Groups:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
