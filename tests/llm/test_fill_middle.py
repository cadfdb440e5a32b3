"""Cuts and forms against a plain version over code points, and exact round trips."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from shelflink.llm import fill_middle as M

TEXTS = [
    None, "", "a", "é", "漢字と kana", "word word\n\tword", "😀😀 x 😀", "has <S> inside", "<P", "ends in <", "a<<b>M>", "Zoë's café — naïve", "x" * 50, "ÀÉ" * 40, "tab\tnew\r\nline",
]


def plain(doc_id, text, unit="token"):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text) if unit == "token" else list(text)
    drawn = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(drawn[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_against_plain_version(spark):
    rng = random.Random(4)
    made = ["".join(rng.choice("ab Z é漢😀<>PSM\n") for _ in range(rng.randrange(60))) for _ in range(300)]
    rows = [(k, t) for k, t in enumerate(TEXTS + made)] + [(None, "no id"), (None, None), (3, TEXTS[3]), (3, TEXTS[3])]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, output string, n int")
    for unit in ("token", "char"):
        out = M.fill_in_middle(docs, unit=unit).withColumn("back", M.restored(F.col("output"), F.col("form")))
        got = sorted((tuple(r) for r in out.collect()), key=repr)
        assert got == sorted(((i, *plain(i, t, unit), t or "") for i, t in rows), key=repr)
    assert {plain(i, t)[1] for i, t in rows} == {"plain", "psm", "spm"}
    assert M.fill_in_middle(docs.limit(0)).collect() == []


def test_exceptions_convert_both_ways():
    text = "añb漢😀" * 30 + "plain" * 20 + "é"
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    index = M.Exceptions(raw)
    assert index.points == len(text) and len(index.byte) == sum(ord(c) > 127 for c in text)
    for point in range(len(text) + 1):
        byte = len(text[:point].encode())
        assert index.to_byte(point) == byte and index.to_point(byte) == point


def test_very_long_text_in_pieces():
    rng = random.Random(2)
    text = "".join(rng.choice(["abc", " ", "漢", "é", "\n"]) for _ in range(1_200_000))
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    assert len(raw) > 2 * (1 << 20)
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    for h1, h2 in ((5, len(units) - 3), (len(units) // 2, len(units)), (0, 777_777)):
        n, places, points = M.cut(raw, h1, h2, "token")
        assert n == len(units)
        assert points == [len("".join(units[:k])) for k in sorted((h1, h2))]
        assert places == [len("".join(units[:k]).encode()) for k in sorted((h1, h2))]
