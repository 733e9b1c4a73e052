"""Dialects of files, names beyond ASCII, and codes that differ."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from tidecast.functions.text import LEGAL, normalize_name, to_ascii
from tidecast.sources import sales_files


def _ascii(s):
    return unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode()


def test_every_character_decomposes_as_the_rule_says(spark):
    chars = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x10000 or unicodedata.decomposition(chr(c)))]
    df = spark.createDataFrame([("x" + c + "y",) for c in chars], "s string").repartition(4)
    wrong = [(r.s, r.got) for r in df.select("s", to_ascii(F.col("s")).alias("got")).collect() if r.got != _ascii(r.s)]
    assert wrong == [] and len(chars) > 60000


def test_names(spark):
    names = ["Việt Nam ế", "ﬁne & ﬂat GmbH", "ＡＣＭＥ　Ｃｏ．，Ｌｔｄ", "Łódź № 5", "㎏ ½ Ⅷ", "", None, "ﬃ" * 5000, "Ångström AB", "e\u0301cole", "x\ty\nz", "日本"]
    got = {r.s: r.n for r in spark.createDataFrame([(n,) for n in names], "s string").select("s", normalize_name(F.col("s")).alias("n")).collect()}
    for n in names:
        plain = "".join(c if c.isalnum() else " " for c in _ascii(n or "").lower().replace("&", " and "))
        assert got[n] == " ".join(w for w in plain.split() if w not in LEGAL)


@pytest.mark.parametrize("d", [",", "\t", ";", "|"])
@pytest.mark.parametrize("q", ['"', "'"])
def test_files_are_read_whatever_divides_them(spark, tmp_path, d, q):
    lines = [d.join(["month", "client name", "qty"])] + [d.join([f"2020-{m:02d}-01", f"{q}Smith{d} {q}{q}J{q}{q} & sons{q}", "1.5" if d == "," else "1,5"]) for m in range(1, 13)]
    (tmp_path / "t.csv").write_text("\n".join(lines) + "\n\n")
    df = sales_files.read_table(spark, str(tmp_path / "t.csv"))
    assert df.columns == ["month", "client name", "qty"] and df.count() == 12
    assert {r["client name"] for r in df.collect()} == {f"Smith{d} {q}J{q} & sons"}
    assert sales_files.read_table(spark, str(tmp_path / "t.csv"), rows=3).count() == 3


def test_dialects_of_odd_files(spark):
    files = {
        "one column": ["a", "b", "", "c"], "few broken": ["x;y;z"] * 20 + ["note, of one line"], "apostrophes": ["it's,5", "o'clock,6", "x,7"], "windows": ["a|b\r", "1|2\r"],
        "text": ["a,b", "c d e", "f"], "null": [None, "a\tb"],
    }
    df = spark.createDataFrame([(f, line) for f, lines in files.items() for line in lines], "file string, line string").withColumn("quote", F.lit(1))
    got = {r.file: (r.delimiter, r.fields) for r in sales_files.dialects(df).collect()}
    assert got == {"one column": (",", 1), "few broken": (";", 3), "apostrophes": (",", 2), "windows": ("|", 2), "text": (",", 1), "null": ("\t", 2)}
    assert sales_files.dialects(df.limit(0)).count() == 0


def test_codes_differ(spark):
    values = [f"ABCD{x}F{i}" for x in "EXYZ" for i in range(30)] + ["abcd_2", "ABCD 3", "all", "  ", "!!", "ABCDEF_2"]
    got = {r.v: r.code for r in sales_files.stable_codes(spark.createDataFrame([(v,) for v in values * 2], "v string"), "v", 6).collect()}
    assert got.keys() == set(values) and len(set(got.values())) == len(got) and all(1 <= len(c) <= 6 for c in got.values())
    assert got["ABCDEF0"] == "ABCDEF" and got["all"] == "ALL_"
