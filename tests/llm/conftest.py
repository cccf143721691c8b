import pytest

#: Null, empty, blank, odd, tied, repeated and long texts; ids null and repeated.
LONG = ("alpha beta gamma delta epsilon zeta eta theta. " * 4000).strip()
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and then it runs home to the small red house by the river again.", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog and then it runs home to the small red house by the river again.", "en", "b"),
    (3, None, "en", "a"),
    (4, "", None, None),
    (5, " \n\t ", "fr", "c"),
    (6, LONG, "en", "d"),
    (7, "Été déjà là, où ça?\nÉté déjà là, où ça?\n日本語 😀 <|endoftext|>  double  spaces \n", "fr", "b"),
    (8, "word", "fr", "c"),
    (9, "one two", None, "d"),
    (None, "no id here", "en", "a"),
    (1, "The quick brown fox jumps over the lazy dog and then it runs home to the small red house by the river again.", "en", "a"),
    (10, "### $$$ %%% &&& *** ### $$$ %%% &&& *** ### $$$ %%% &&& *** ### $$$ %%% &&& *** x y z", "en", "a"),
]


OWN_NAMES = ("_doc", "_id", "_kept", "_marks", "_nth", "_text", "_th", "_words", "lang_pred", "mean_word", "n_lines", "n_removed", "posterior", "row", "votes")


@pytest.fixture(scope="session")
def odd(spark):
    """Odd documents, with extra columns whose names operators use themselves."""
    rows = [(i, t, lang, s, len(t or ""), 1, "x", 2.0, [3]) for i, t, lang, s in ROWS]
    docs = spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, fp int, h string, score double, n_words array<int>"
    )
    return docs.selectExpr("*", *(f"'own' as {c}" for c in OWN_NAMES))


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
