import pytest

pytest.importorskip("vecloom.llm")

WORDS = {
    "en": "the and that with from this have were their which would about there could other after first people water".split(),
    "de": "der und nicht eine werden schon über können zwischen straße mädchen größe auch sich wird dass für wenn".split(),
    "fr": "les des une dans pour être avec cette même après déjà très où été leur plus sous chez français garçon".split(),
}
#: Names that operators use inside or return.
CLASH = "fp string, mark string, size long, copy string, id string, runs string, score double, lang_pred string, spans string, _id long, _gone long, payload string, digest string, v string"


def text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "", ",", ".\n"]).replace("\n", "") for _ in range(n))


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Null in every column, empty, blank and long texts, repeated rows and ids, and columns with clashing names."""
    long = "lang und breit " * 20_000
    rows = [
        (1, "Hello there, write to bob@mail.com or 10.0.0.1 now", "en", "a", 5),
        (1, "Hello there, write to bob@mail.com or 10.0.0.1 now", "en", "a", 5),
        (1, "another text under the same id", "en", "a", 5),
        (2, None, "en", "b", None),
        (3, "", None, None, 0),
        (4, " \t\n ", "de", "b", 4),
        (5, long, "de", "c", len(long)),
        (None, "no id but words enough for a few shingles here", "en", None, 1),
        (None, None, None, None, None),
        (6, "12345 !!! 678", "fr", "c", 3),
        (7, "x" * 50_000, "en", "c", 50_000),
        (8, "😀 ünï 中文   text\x00nul", "fr", "a", 9),
    ]
    clash = ("c", "c", 7, "c", "c", "c", 0.5, "c", "c", 3, 4, "c", "c", "c")
    return spark.createDataFrame([r + clash for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + CLASH)
