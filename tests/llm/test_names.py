from itertools import combinations

import pytest

from quirework.llm import names as N

GROUPS = [
    ["Katherine P. van Norjavufal", "van Norjavufal, Katherine", "Kathy van Norjavufal", "K.P. van Norjavufal", "Norjavufal, Katherine van", "katherine van norjavufal", "van Norjaavufal, Katherine", "Kаtherine van Norjavufal"],
    ["Jürgen van Norjavufal", "van Norjavufal, J.", "Jurgen van Norjavufal", "VAN NORJAVUFAL, JÜRGEN"],
    ["Bill Sumnatuvus", "William Sumnatuvus", "Sumnatuvus, William", "Dr. William Sumnatuvus", "Will Sumnatuvus"],
    ["Jean-Luc Ginyiqasám", "J.-L.L. Ginyiqasám", "GINYIQASAM, Jean-Luc"],
    ["Sonbuwapus Press", "The Sonbuwapus Press", "Sonbuwapus Pr.", "Press, Sonbuwapus", "Sonbuwapus Press Ltd."],
    ["Sonbuwapus University Library", "Sonbuwapus Univ. Library"],
    ["Tomasz Fempulusos"],
    ["Lucía Fempulusos", "L. Fempulusos"],
]
# So that given names are commoner than any family's.
OTHERS = [f"{family}, {given}" for family in ("Rorqafapul", "Dokkizopur", "Tirzaweval", "Lanlisapom", "Busfeqoras") for given in ("Katherine", "William", "Jürgen", "Jean-Luc", "Lucía", "Tomasz")]


def test_variants(spark, rows):
    names = [n for g in GROUPS for n in g] + OTHERS
    df = spark.createDataFrame([(n, "x") for n in [*names, names[0], None, "", "—"]], "name string, plain string")
    want = sorted(tuple(sorted(p)) for g in GROUPS for p in combinations(g, 2))
    assert sorted(rows(N.name_pairs(df))) == want


def test_slips(spark, rows):
    counted = spark.createDataFrame([("norjavufal", 9), ("norjaavufal", 1), ("nrojavufal", 1), ("norjavuful", 1), ("norjavxxal", 1), ("other", 5), ("othex", 4), ("katherine", 1), ("kathrine", 7), ("hkon", 1), ("håkon", 3), ("abc", 1), ("abd", 1)], "token string, df bigint")
    want = [("norjaavufal", "norjavufal"), ("norjavuful", "norjavufal"), ("nrojavufal", "norjavufal"), ("othex", "other"), ("kathrine", "katherine"), ("hkon", "håkon")]
    assert sorted(rows(N.slips(counted))) == sorted(want)


def test_soft_similarity():
    assert N.distance("abcd", "abdc") == 1 and N.distance("abcd", "") == 3 and N.distance("kitten", "sitten") == 1
    assert N.soft("othex", "other") == 0.8 and N.soft("abc", "abd") == 0 and N.soft("j.", "j.") == 1
    rare, common = 8.0, 2.0
    assert N.similarity([("norjavufal", rare), ("lucía", common)], [("norjavuful", rare + 2), ("lucía", common)]) > 0.9
    assert N.similarity([("norjavufal", rare), ("lucía", common)], [("norjavufal", rare), ("tomasz", common)]) == 0
    assert N.similarity([("norjavufal", rare)], [("norjavufal", rare), ("press", common)]) > N.similarity([("norjavufal", common)], [("norjavufal", common), ("press", rare)])


@pytest.mark.parametrize("times", [1, 4])
def test_more_data_of_the_same_kind_change_no_link(spark, rows, times):
    """A slip of 3 names against 9, and of 12 against 36; every copy of the corpus has families of its own."""
    names = []
    for family in ("Borqafapul", "Dokkizopur", "Tirzaweval", "Lanlisapom")[:times]:
        slip = family[:5] + "x" + family[6:]
        names += [f"{family}, {g}" for g in ("Katherine", "Dorothea", "Tomasz")] + [f"Katherine {slip}", f"{slip}, Katherine", f"T. {slip}"]
    got = rows(N.name_pairs(spark.createDataFrame([(n,) for n in names], "name string")))
    assert len(got) == times * 4


def test_entities(spark, rows):
    got = rows(N.name_entities(spark.createDataFrame([("Bill Sumnatuvus",), ("Sumnatuvus, William",), ("Tomasz Fempulusos",)], "name string")))
    assert sorted(r[2] for r in got) == [1, 2, 2] and len({r[1] for r in got}) == 2


def test_empty_and_odd(spark, rows):
    df = spark.createDataFrame([("A",), ("A.",), ("x" * 3000,), ("...",), (None,)], "name string")
    assert rows(N.name_pairs(df)) in ([("A", "A.")], [])
    assert rows(N.name_pairs(df.limit(0))) == []
