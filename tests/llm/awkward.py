"""Rows that operators must survive: nulls, empty and long texts, ties, repeats, clashing column names."""

from __future__ import annotations

from pyspark.sql import functions as F

#: Names that operators use inside; as extra input columns they must do no harm.
CLASHING = ("rep", "root", "n", "doc", "body", "part", "label", "kept", "score", "rank", "name", "_id", "_key", "_gone",
            "q", "p", "words", "payload", "digest", "copies", "held_out", "n_removed", "_row", "id")


def clash(df):
    taken = set(df.columns)
    return df.withColumns({c: F.lit("extra") for c in CLASHING if c not in taken})


def texts() -> list[tuple[int | None, str | None]]:
    line = "one line of twelve words that many documents here will share again today"
    block = "\n".join(f"block line number {k} has a few words of its own inside" for k in range(6))
    base = " ".join(f"word{k}" for k in range(60))
    near = base.replace("word59", "other")
    return [
        (1, base), (2, base), (3, near), (4, None), (5, ""), (6, "   \n\t \n"), (7, "Single"), (8, "two words"),
        (9, "two words"), (10, f"start\n{line}\nend"), (11, f"{line}\nother start\n\n{line}"), (12, block),
        (13, f"head\n{block}\ntail"), (14, block), (15, " ".join(f"long{k % 977}" for k in range(30_000))),
        (16, "\n".join(["la la la"] * 40)), (17, "ÄÖÜ ß ñ 日本語 Ω"), (None, base), (None, None), (18, block + "\n" + line),
        (20, "the quick brown fox jumps over the lazy dog while seven wizards boil strong coffee at dawn"),
        (21, "x y z The quick, brown fox jumps over the lazy dog - while seven wizards boil strong coffee at dawn! q"),
        (22, "quick brown fox"), (19, near),
    ]
