"""Small document tables with every awkward case, and plain re-implementations."""

import random
import re

from pyspark.sql import functions as F

BLANK_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
# columns that operators use inside
CLASH = ["kept", "size", "host", "path", "n", "value", "digest", "rank", "shard", "evidence", "taken", "score", "token", "part"]

WORDS = "the of and to in is that it was for on are with as his they at be this from have or by one had not but what all were when we there can an your which".split()


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "a", "er", "ing", "ó"]) for _ in range(n))


def edge_texts():
    """Texts with nulls, empty and blank texts, copies, near copies, short and very long ones."""
    base = prose(1, 120)
    near = base.split(" ")
    near[60] = "changed"
    return [
        None, "", " \n\t ", "one", "One", "two words", "TWO words", base, base, " ".join(near), base.upper(), base + " tail",
        prose(2, 40), prose(2, 40) + "\n" + prose(2, 40), "x" * 5000, prose(3, 30_000), prose(3, 30_000), "é ü ß 漢字 " * 30,
        "line a b c d\nline a b c d\n\nline a b c d", "a b c d e f g h " * 6,
    ]


def documents(spark, texts=None, clash=True):
    texts = edge_texts() if texts is None else texts
    rows = [(i, t, ["en", "fr", None][i % 3], ["s1", "s2", None, "s1"][i % 4], len(t or "")) for i, t in enumerate(texts)]
    rows.append((None, "row without an id " * 10, "en", "s1", 180))
    if texts:
        rows.append(rows[-2])  # a repeated row
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(f"clash {c}") for c in CLASH}) if clash else df


def empty(df):
    return df.where("false")
