"""Small frames with every awkward row the operators must take."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, score string, n_removed string, key string"


def documents(spark, rows, schema=DOCS):
    """Rows of (doc_id, text, lang) among columns whose names the operators use themselves."""
    full = [(i, t, lang, "src", None if t is None else len(t), "x", "y", "z", "w") for i, t, lang in rows]
    return spark.createDataFrame(full, schema)


def awkward():
    prose = "Der Hund schläft am warmen Ofen und träumt von weiten Feldern im Sommer. " * 3
    return [
        (1, None, None), (2, "", "en"), (3, "   \n\t ", "en"), (4, prose, "de"), (4, prose, "de"), (None, prose, None),
        (5, "word " * 30_000, "en"), (6, "a" * 100_000, "en"), (7, "🙂 漢字 ß é " * 4, None), (8, "12 34\n12 34\n", "en"),
    ]
