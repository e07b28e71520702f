import pytest

from quirework.operators import packed
from quirework.operators.packed import automaton, known_spans, segment

TERMS = ["Letters, French", "Letters", "Bookbinding; selected works", "FICTION / Astronomy / General", "Railways -- History", "Cookery, Manuals, handbooks, etc."]


@pytest.mark.parametrize(
    ("element", "values"),
    [
        ("Letters, French", ["Letters, French"]),
        ("Letters, quiet tides", ["Letters", "quiet tides"]),
        ("Letters, Frenchy", ["Letters", "Frenchy"]),
        ("a / FICTION / Astronomy / General / b", ["a", "FICTION / Astronomy / General", "b"]),
        (r"Bookbinding\; selected works; x", ["Bookbinding; selected works", "x"]),
        ("Cookery, Manuals, handbooks, etc. ; y ;", ["Cookery, Manuals, handbooks, etc.", "y"]),
        ('"so-called ""lonely"" mystery", Letters, French', ['so-called "lonely" mystery', "Letters, French"]),
        ("“Unlisted, One”, b", ["Unlisted, One", "b"]),
        ('["a, b", "c \\"d\\""]', ["a, b", 'c "d"']),
        ('so-called "urban" families', ['so-called "urban" families']),
        ("a；b、c·d•e|f\tg\nh", list("abcdefgh")),
        ("  ;; ;", []),
        ("", []),
        (None, []),
        ('"never closed, x', ['"never closed', "x"]),
        ("[not json; x]", ["[not json", "x]"]),
        (";".join(["x" * 50] * 400), ["x" * 50] * 400),
    ],
)
def test_segment(element, values):
    assert segment(element, known_spans(element or "", automaton(TERMS))) == values


def test_unpack_by_automaton_and_by_join(spark, rows):
    records = spark.createDataFrame(
        [("b", 1, ["x", "Letters, French; y"], 9), ("b", 1, ["x", "Letters, French; y"], 9), ("b", 2, ["Letters, French"], 9), ("b", 3, None, 9), ("b", 4, [], 9), ("b", 5, [None, "a|b", ""], 9), ("b", None, ["p;q"], 9)],
        "src string, record_id bigint, subjects array<string>, row int",
    )
    terms = spark.createDataFrame([(t,) for t in [*TERMS, None, ""]], "term string")
    want = sorted(
        [("b", 1, 1, "x"), ("b", 1, 2, "Letters, French"), ("b", 1, 3, "y")] * 2 + [("b", 5, 1, "a"), ("b", 5, 2, "b"), ("b", None, 1, "p"), ("b", None, 2, "q")],
        key=lambda r: tuple((x is not None, str(x)) for x in r),
    )
    assert rows(packed.unpack(records, terms)) == want
    assert rows(packed.unpack(records, terms, limit=1)) == want
    assert rows(packed.unpack(records.limit(0), terms)) == []
    assert len(rows(packed.unpack(records, terms.limit(0)))) > 0
