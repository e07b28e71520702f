import pytest

from quirework.llm import mojibake as M

SOUND = [
    "le troisième jour, une étrange lumière à la fenêtre", "la même fenêtre était déjà fermée", "It’s a novel — and “slow”", "über den Dächern große Mühle", "żółty kamień był w wieży sprzedał",
    "под серым небом старый долг", "ночной поезд за болотом", "CORAÇÃO E MAÇÃ", "PÂTÉ © CRÈME", "ÐÍSIR OG ÞULUR", "Å: En ø i havet", "NAÏVETÉ À L’ŒUVRE", "Её младший брат", "時計職人は夜明け前に港を離れた",
]


LEARNED = [("cp1252", "utf_8", 50), ("mac_roman", "utf_8", 20), ("cp437", "utf_8", 20), ("cp1251", "utf_8", 20), ("cp1252", "cp1251", 9), ("cp1252", "cp1250", 9)]


def _model(extra=()):
    counts = {}
    for text in [*SOUND * 20, *extra]:
        for c in M.contexts(text):
            counts[c] = counts.get(c, 0) + 1
    return M.Likelihood(counts)


def _sloppy(raw):
    return "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in raw)


def test_sound_text_is_no_case():
    model = _model()
    assert [M.restore(t, LEARNED, model) for t in [*SOUND, "plain", "“LIBERTÉ”", "MAÇÔ"]] == [None] * (len(SOUND) + 3)


@pytest.mark.parametrize("text", SOUND[:6] + SOUND[-2:])
@pytest.mark.parametrize("read", ["sloppy", "twice", "mac_roman", "cp437"])
def test_utf8_read_wrongly(text, read):
    raw = text.encode()
    bad = {"sloppy": lambda: _sloppy(raw), "twice": lambda: _sloppy(_sloppy(raw).encode()), "mac_roman": lambda: raw.decode("mac_roman"), "cp437": lambda: raw.decode("cp437")}[read]()
    assert M.restore(bad, LEARNED, _model()) == text


def test_rounds_have_no_bound():
    bad = "fenêtre fermée"
    for _ in range(6):
        bad = _sloppy(bad.encode())
    assert M.restore(bad, LEARNED, _model()) == "fenêtre fermée"


@pytest.mark.parametrize(("text", "meant"), [("ночной поезд под серым небом", "cp1251"), ("sprzedał żółty kamień", "cp1250")])
def test_single_byte_read_wrongly(text, meant):
    bad = text.encode(meant).decode("cp1252")
    assert M.restore(bad, LEARNED, _model([bad])) == text
    assert M.restore(bad, [x for x in LEARNED if x[1] != meant], _model([bad])) is None


def test_partly_garbled_and_lost():
    model = _model()
    assert M.restore("la même fenêtre Ã©tait fermÃ©e", LEARNED, model) == "la même fenêtre était fermée"
    assert M.restore("It�s a novel", LEARNED, model) == ""


def test_declared_encodings():
    assert [M.page(x) for x in ("Cp1252", "Utf8", "Unknown(437)", "Unknown(10000)", "Unknown(0)", None, "")] == ["cp1252", "utf_8", "cp437", "mac_roman", None, None, None]


def test_what_explains_a_mapping():
    names = lambda g, c: {h for i, h in enumerate(M.hypotheses()) if M.explained(g, c) >> i & 1}
    assert {("cp1252", "utf_8"), ("latin_1", "utf_8")} <= names("Ã©", "é") and ("mac_roman", "utf_8") not in names("Ã©", "é")
    assert ("cp1252", "utf_8") in names("ÃƒÂ©", "é")
    assert ("cp1252", "cp1251") in names("ê", "к")
    assert names("é", "ê") == names("é", "ê") and M.explained("x", "é") == 0


CLEAN = ["la fenêtre était fermée", "le café du théâtre", "une forêt dorée", "il y a été blessé près du château"]
RUSSIAN = ["разбитое окно с северного берега видел библиотекарь", "деревянный мост похоронил маленький фонарь"]


def _cells(spark, texts):
    return spark.createDataFrame([(i, "title", t, None, "x") for i, t in enumerate(texts)], "record_id bigint, field string, text string, declared string, n string")


def test_twins_teach_the_transformations(spark, rows):
    bad = [_sloppy(t.encode()) for t in CLEAN] + [t.encode("cp1251").decode("cp1252") for t in RUSSIAN] + [t.encode().decode("cp1251", "ignore") for t in RUSSIAN]
    late = [_sloppy("l’œuvre à naître".encode()), "под серым небом".encode("cp1251").decode("cp1252")]
    cells = _cells(spark, (CLEAN + RUSSIAN + ["l’œuvre à naître", "под серым небом"]) * 3 + bad + late)
    words = M.word_counts(cells)
    learned = M.learn(cells, words)
    assert {x[:2] for x in learned} >= {("cp1252", "utf_8"), ("cp1252", "cp1251")}
    got = {r[0]: r[2] for r in rows(M.restore_garbled(cells))}
    assert {r: got.get(r) for r in range(24, 30)} == dict(zip(range(24, 30), CLEAN + RUSSIAN, strict=True))
    assert got[32] == "l’œuvre à naître" and got[33] == "под серым небом" and not set(got) & set(range(24))


def test_without_twins_nothing_is_restored(spark, rows):
    bad = [_sloppy(t.encode()) for t in CLEAN]
    assert rows(M.restore_garbled(_cells(spark, bad))) == []
    assert len(rows(M.restore_garbled(_cells(spark, bad + CLEAN * 3)))) == len(bad)


def test_cells(spark, rows):
    texts = CLEAN * 3 + [_sloppy(t.encode()) for t in CLEAN]
    own = [(i, "title", t, "Cp1252", "x") for i, t in enumerate(texts)] + [(100, "title", None, None, "x"), (101, "title", "", "", "x"), (None, "title", _sloppy("été là".encode()), "Unknown(0)", "x"), (102, "title", "ascii", "Utf8", "x"), (103, "title", "lost �", None, "x")]
    cells = spark.createDataFrame(own, "record_id bigint, field string, text string, declared string, n string")
    got = {r[0]: r[2] for r in rows(M.restore_garbled(cells))}
    assert got == {**{12 + i: CLEAN[i] for i in range(4)}, None: "été là", 103: ""}
    assert rows(M.restore_garbled(cells.limit(0))) == []


def test_header_cells(spark, rows):
    headers = spark.createDataFrame([(1, "a", None), (2, None, "b")], "record_id bigint, title string, description string")
    files = spark.createDataFrame([(1, "Utf8", "t"), (1, "Cp1252", "t")], "record_id bigint, encoding string, title string")
    assert sorted(rows(M.header_cells(headers, files)), key=str) == sorted([(1, "title", "a", "Cp1252"), (1, "description", None, "Cp1252"), (2, "title", None, None), (2, "description", "b", None)], key=str)
