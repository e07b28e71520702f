from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirework.functions import ion
from quirework.sources import kfx as K

SYMBOL = st.integers(1, 2000).map(ion.Symbol)
SCALAR = st.none() | st.booleans() | st.integers(-(1 << 70), 1 << 70) | st.text(max_size=30) | st.binary(max_size=30) | st.floats(allow_nan=False) | st.integers(10, 2000).map(ion.Symbol) | st.decimals(allow_nan=False, allow_infinity=False, places=3)
VALUE = st.recursive(SCALAR, lambda x: st.lists(x, max_size=4) | st.lists(x, max_size=3).map(ion.SExp) | st.lists(st.tuples(st.integers(10, 900).map(ion.Symbol), x), max_size=4).map(ion.Struct), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(VALUE)
def test_ion_round_trip(value):
    [got] = ion.loads(ion.dumps(value))
    assert got == value and type(got) is type(value)


def test_ion_texts():
    table = ion.Annotated((ion.Symbol(3),), ion.Struct([(ion.Symbol(7), ["own"])]))
    got = ion.loads(ion.dumps(table, ion.Symbol(10), ion.Annotated((ion.Symbol(10),), 5), ion.Timestamp((2020, 1, 2, 3, 4, 5), -60, Decimal("0.25"))))
    assert str(got[0]) == "own" and got[1].value == 5 and got[2] == ion.Timestamp((2020, 1, 2, 3, 4, 5), -60, Decimal("0.25"))
    for raw in (b"\xf1", b"\x8e\x99x", ion.MARK + b"\x83a"):
        with pytest.raises((ValueError, IndexError)):
            ion.loads(raw)


def test_containers(spark, rows):
    parts = [(900, 260, ion.Struct([(ion.Symbol(176), ion.Symbol(901))])), (901, 259, [ion.Symbol(902), "é"]), (902, 145, "text"), (903, 417, b"\xff\xd8"), (904, 164, None)]
    raw = K.build_container("CR!1", parts)
    assert list(K.Container(raw).values()) == parts
    files = spark.createDataFrame([("a", bytearray(raw)), ("b", bytearray(raw[:-3])), ("c", bytearray(b"x")), ("d", None)], "path string, content binary")
    assert rows(K.read_kfx(files.where("path = 'a'"), "containers")) == [("a", "CR!1", 5, len(raw), None)]
    e, r = K.read_kfx(files, "entities"), K.read_kfx(files, "references")
    assert {x[0] for x in rows(e) if x[-1]} == {"b", "c", "d"}
    assert [x[1:3] for x in rows(r) if x[0] == "a"] == [(900, 901), (901, 902)]
    assert rows(K.container_report(e))[0] == ("a", "content", 1, 9)
    assert sorted(rows(K.dependencies(r, e))) == [("a", "section", "storyline", 1), ("a", "storyline", "content", 1)]
    assert sorted(rows(K.unreferenced(r, e))) == [("a", 903, "raw_media"), ("a", 904, "external_resource")]
    assert K.read_kfx(files.limit(0), "entities").count() == 0
