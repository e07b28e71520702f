import numpy as np
import pytest

from quirework.llm import langid as G

TEXT = {
    "en": "The old lighthouse kept the winter light. A quiet stranger carried the last letter over the rooftops. Nobody would forgive the harbour master. The river opened the empty garden toward evening. They walked beneath the bridge when the storm was over.",
    "fr": "Le vieux phare gardait la lumière de l'hiver. Un étranger silencieux portait la dernière lettre au-dessus des toits. Personne ne pardonnait au maître du port. La rivière ouvrait le jardin désert vers le soir. Ils marchaient sous le pont quand l'orage était fini.",
    "de": "Der alte Leuchtturm behielt das Winterlicht. Ein stiller Fremder trug den letzten Brief über die Dächer. Niemand verzieh dem Hafenmeister. Der Fluss öffnete gegen Abend den leeren Garten. Sie gingen unter der Brücke, als der Sturm vorbei war.",
    "ru": "Старый маяк хранил зимний свет. Тихий незнакомец нёс последнее письмо над крышами. Никто не простил начальника порта. Река открыла пустой сад к вечеру. Они шли под мостом, когда буря прошла.",
}


def _doc(lang, k):
    s = TEXT[lang].split(". ")
    return ". ".join(s[k % 5 :] + s[: k % 5]).replace("..", ".")


def test_phrases_are_longest_matches():
    a = G.Automaton("abcabdabe")
    for text, want in (("abc", 1), ("abcabd", 1), ("cabdz", 2), ("zz", 2), ("abeabc", 2), ("", 1)):
        codes = np.array([[a.symbols.get(c, 0) for c in text] or [0]], np.int32)
        translate = np.arange(a.width, dtype=np.int32)
        assert a.phrases(codes, np.array([len(text)]), translate)[0] in (want, want + (text == "zz"))


def test_segments_and_labels(spark, rows):
    train = [(1000 + 100 * n + i, _doc(lang, i), lang.upper() + "-XX") for n, lang in enumerate(TEXT) for i in range(8)]
    mixed = TEXT["en"].split(". ")[0] + ". " + TEXT["de"].split(". ")[1] + ".\n<p>" + TEXT["en"].split(". ")[3] + ".</p>"
    docs = [(1, _doc("fr", 1), "french"), (2, _doc("fr", 2), None), (3, _doc("de", 2), "en"), (4, mixed, "en"), (5, None, None), (6, "", "xx"), (7, "123 ...", "und"), (8, _doc("ru", 3), " RUS "), (2, _doc("fr", 2), "n/a"), (9, (TEXT["de"] + " ") * 300, "mul"), (10, "OEBPS/c00.xhtml\t12\n" + _doc("fr", 0), "fr")]
    df = spark.createDataFrame([(*r, "x") for r in train + docs], "doc_id bigint, text string, lang string, label string")
    got = [r[:3] for r in rows(G.mislabelled(df).select("doc_id", "seg_no", "lang"))]
    assert sorted(set(got)) == [(2, 1, "fr"), (3, 1, "de"), (4, 1, "en"), (4, 2, "de"), (4, 3, "en"), (9, 1, "de")]
    assert all(0 <= r[0] <= 1 for r in rows(G.segment_languages(df).select("confidence")))
    assert rows(G.mislabelled(df.limit(0))) == []
    assert rows(G.mislabelled(df.where("lang is null"))) == []


@pytest.mark.parametrize(("label", "want"), [("EN", "en"), ("pt-BR", "pt"), ("ger", "de"), ("Dutch", "nl"), ("n/a", None), ("", None), (None, None), ("unknown", None), ("fra_FR", "fr")])
def test_labels(spark, label, want):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(label,)], "l string")
    assert df.select(G.label_language(F.col("l"))).first()[0] == want
