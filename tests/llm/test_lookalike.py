import hashlib
import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quirework.llm import lookalike as L


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("Ｆｕｌｌ　ｗｉｄｔｈ１", "Full width1"),
        ("été", "été"),
        ("a​b­c﻿", "abc"),
        ("a b c", "a b c"),
        ("Jean‐Luc‑X", "Jean-Luc-X"),
        ("ofﬁce ﬆone ĳ", "office stone ij"),
        ("Nаthаniеl", "Nathaniel"),
        ("Вусыpолaс", "Вусыролас"),
        ("Ｍа​сSirreуonin", "MacSirreyonin"),
        ("u‍̈ber", "über"),
        ("Tuёt Cat", "Tuët Cat"),
        ("у моря", "у моря"),
        ("x² ™ “q” — … ª œ ß", "x² ™ “q” — … ª œ ß"),
        ("<p>a  b</p>\n\t", "<p>a  b</p>\n\t"),
        ("Αθήνα", "Αθήνα"),
        ("Aθήνα", "Αθήνα"),
        ("", ""),
        (None, None),
    ],
)
def test_clean(raw, want):
    assert L.clean(raw) == want


@given(st.text(alphabet=st.sampled_from("aАеó̈​­ ﬁＡ-‐1оpж<>\n　Ёëї"), max_size=30))
def test_clean_is_a_fixed_point_and_invisible_free(text):
    once = L.clean(text)
    assert L.clean(once) == once
    assert not any(unicodedata.category(c) == "Cf" for c in once)


def test_long_texts_are_done_whole():
    assert L.clean("é" * 200_000 + "​") == "é" * 200_000


def test_cells(spark, rows):
    cells = spark.createDataFrame([("f", 1, 0, "a b", 5), ("f", 1, 0, "a b", 5), ("f", 2, 1, "ab", 5), ("f", None, 0, None, 5), ("f", None, 0, "​", 5), ("f", 4, 0, "", 5)], "field string, row_key bigint, pos int, text string, clean_md5 int")
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()  # noqa: E731, S324
    assert rows(L.unclean_cells(cells)) == [("f", None, 0, md5("")), ("f", 1, 0, md5("a b")), ("f", 1, 0, md5("a b"))]
    assert rows(L.unclean_cells(cells.limit(0))) == []
