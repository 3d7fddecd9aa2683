"""Small tables with every odd case, and plain versions of the rules."""

from __future__ import annotations

import random
import re
import zlib

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASHES = ("row", "order", "fp", "key", "size", "copies", "mix_rate", "SIMHASH_KEY", "found_items", "found_language", "dedup_row",
           "anchor", "features", "label", "best", "part", "shape", "host", "template", "kept", "recipe")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sentence(rng, count):
    return " ".join("".join(rng.choice(WORDS) for _ in range(rng.randint(1, 2))) for _ in range(count))


def odd_rows(rng=None):
    """Nulls in every column, empty, blank and very long texts, copies, near copies, repeated rows and ids."""
    rng = rng or random.Random(7)
    base, other = sentence(rng, 160).split(), sentence(rng, 90).split()
    long = sentence(rng, 30_000)
    changed = list(base)
    changed[20] = "changed"
    shared = base[40:110]
    texts = [
        (10, " ".join(base), "en", "a"), (3, " ".join(base), "en", "b"), (7, " ".join(changed), "en", None), (7, " ".join(changed), "en", None),
        (8, " ".join(other), "de", "b"), (8, " ".join(other[::-1]), "de", "b"), (9, " ".join(other[:30] + shared + other[30:]), None, "a"),
        (1, None, "en", "a"), (2, "", "fr", "b"), (4, " \t\n ", None, None), (5, long, "de", "a"), (6, long, "de", "a"),
        (None, " ".join(base), "en", "a"), (None, None, None, None), (11, "one", "en", "c"), (12, "One", "en", "c"), (13, "één ÉÉN ñ", "es", "\U0001f600"),
        (14, "12 34 — !!", "en", "\uffff"), (15, "x" * 5000 + " " + "y" * 3000, "en", "a"), (16, " ".join(other + base), "de", "z"),
    ]
    return [(d, t, lang, s, None if t is None else len(t)) for d, t, lang, s in texts]


def documents(spark, rows=None, clashes=True):
    frame = spark.createDataFrame(odd_rows() if rows is None else rows, SCHEMA)
    return frame.withColumns({c: F.lit("x") for c in CLASHES}) if clashes else frame


def crc(value):
    return zlib.crc32(str(value).encode())


def counted(rows):
    """Rows as a sorted list that may hold nulls."""
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))
