"""Label normalisers on hand-made labels (expected values worked out from the rules)."""

import pytest

from railyard.functions.lines import canonical_line_ah, canonical_line_az, normalize_line

CASES = [
    # raw, A-H rules, any-letter rules, forecast rules
    ("a", "A", "A", "A"),
    ("LineaB", "B", "B", "B"),
    ("Línea C", "C", "C", "C"),
    ("LÍNEA D", "D", "D", "LÍNEA D"),
    ("\tE", "E", "E", "E"),
    ("Premetro", "E", "O", "P"),
    ("P", "P", "P", "P"),
    ("Linea 7", "A", "A", "Linea 7"),
    ("", "", "", ""),
    (None, None, None, None),
    ("  h  ", "H", "H", "H"),
    ("Lina x", "A", "X", "X"),
    ("zz", "zz", "Z", "zz"),
    ("Bus 12", "B", "S", "B"),
    ("123", "123", "123", "123"),
]


@pytest.mark.parametrize("fn,idx", [(canonical_line_ah, 1), (canonical_line_az, 2), (normalize_line, 3)])
def test_label_rules(spark, fn, idx):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, raw string")
    got = {r.i: r.out for r in df.select("i", fn("raw").alias("out")).collect()}
    for i, c in enumerate(CASES):
        assert got[i] == c[idx], (fn.__name__, c[0], got[i], c[idx])


UNICODE_CASES = [
    # raw, A-H rules, any-letter rules, forecast rules (as Python's re reads them)
    ("lineaſ", "A", "S", "lineaſ"),        # long s folds to s under ignore-case
    ("Línea B", "B", "B", "B"),       # no-break space is whitespace
    ("Linea c", "C", "C", "C"),       # em space too
    ("lineaı", "A", "I", "lineaı"),  # dotless i folds to i
]


@pytest.mark.parametrize("fn,idx", [(canonical_line_ah, 1), (canonical_line_az, 2), (normalize_line, 3)])
def test_label_rules_unicode(spark, fn, idx):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(UNICODE_CASES)], "i int, raw string")
    got = {r.i: r.out for r in df.select("i", fn("raw").alias("out")).collect()}
    for i, c in enumerate(UNICODE_CASES):
        assert got[i] == c[idx], (fn.__name__, c[0], got[i], c[idx])
