import re

import pytest
from pyspark.sql import functions as F

from folioflow.functions import text as tx
from folioflow.functions import validation as v
from folioflow.functions.errors import ContentError, EngineError, PrerequisiteError, RegistryError, ValidationError, describe

NBSP, BOM, ZW, EM = chr(0xA0), chr(0xFEFF), chr(0x200B), chr(0x2003)


def ev(spark, texts, column):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("t"))).collect()]


def test_trim_and_titles(spark):
    texts = [NBSP + " a  b" + EM, BOM + ZW, "", None, "\t Mixed" + NBSP + NBSP + "CASE \n", "x" + ZW + "y"]
    assert ev(spark, texts, tx.trim) == ["a  b", ZW, "", None, "Mixed" + NBSP + NBSP + "CASE", "x" + ZW + "y"]
    assert ev(spark, texts, tx.norm_title) == ["a b", "", "", None, "mixed case", "xy"]


def test_search_form_is_the_same_for_texts_and_queries(spark):
    texts = ["Cross- reference", "CIE -based", " A\n\nB ", "a - b-c", NBSP + "x", ""]
    assert ev(spark, texts, tx.norm_search) == [tx.norm_query(t) for t in texts] == ["cross-reference", "cie-based", " a b ", "a-b-c", " x", ""]


@pytest.mark.parametrize("text,word", [("aaaa", "aa"), ("the other the", "the"), ("", "x"), ("a.b.c", ".")])
def test_occurrences(spark, text, word):
    assert ev(spark, [text], lambda t: tx.count_occurrences(t, word)) == [text.count(word)]
    assert ev(spark, [text], lambda t: tx.index_of(t, word)) == [text.find(word)]


def test_snippets_against_a_plain_version(spark):
    import random

    rng = random.Random(4)
    for _ in range(12):
        text = " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(0, 60)))
        normal, at, q = max(1, len(text) - rng.randint(0, 3)), rng.randint(-1, max(0, len(text) - 1)), rng.randint(1, 9)
        s = 0 if at <= 0 or not text else min(int(at / normal * len(text)), len(text) - 1)
        a, b = max(0, s - 75), min(len(text), s + q + 75)
        want = ("..." if a > 0 else "") + text[a:b].strip() + ("..." if b < len(text) else "")
        assert ev(spark, [text], lambda t, at=at, n=normal, q=q: tx.snippet(t, F.lit(at), F.lit(n), q)) == [want]


def test_section_numbers_with_invisible_characters(spark):
    titles = ["1 " + ZW + "Scope", BOM + "7.3 Objects", "7.3.4\tString", NBSP + "8" + NBSP + "X", ZW, None]
    assert ev(spark, titles, tx.section_number) == ["1", "7.3", "7.3.4", "8", None, None]


def test_likely_terms(spark):
    texts = ["array", "a" * 80, "a" * 79, "ends.", "ends:", "ends)", "NOTE 1", "EXAMPLE x", "[x", "For the purposes of", "ISO 9", "3.1.2", "3.1 x", ""]
    assert ev(spark, texts, tx.is_likely_term) == [True, False, True] + [False] * 9 + [True, False]


def test_word_edges_are_ascii(spark):
    pattern = f"{tx.BEFORE_WORD}may{tx.AFTER_WORD}"
    assert ev(spark, ["emay", chr(0xE9) + "may", "may_", "a may.", "may" + chr(0xE9)], lambda t: F.rlike(t, F.lit(pattern))) == [False, True, False, True, True]


def test_validators():
    assert v.section("7") == "7" and v.query("x" * 500) and v.max_depth(None) is None and v.max_depth(10) == 10 and v.max_results(None) == 10 and v.max_results(50) == 50
    assert v.level(" SHALL not ") == "shall not" and v.level(None) is None and v.term(" a ") == "a" and v.table_index(0) == 0 and v.spec(None) is None and v.optional_section(None) is None
    bad = [
        (v.section, 3, "must be a string"), (v.section, " \t", "must not be empty"), (v.query, None, "must be a string"), (v.query, "x" * 501, "too long"), (v.term, "", "must not be empty"), (v.term, "x" * 201, "too long"), (v.term, 1, "must be a string"),
        (v.max_depth, 0, "max_depth"), (v.max_depth, 11, "max_depth"), (v.max_depth, 1.5, "integer"), (v.max_depth, True, "max_depth"), (v.max_depth, "2", "max_depth"), (v.max_results, 51, "max_results"), (v.max_results, 0, "max_results"),
        (v.level, "must", "Invalid requirement level"), (v.level, 1, "must be a string"), (v.table_index, -1, "table_index"), (v.table_index, True, "table_index"), (v.table_index, 1.0, "table_index"), (v.spec, "", "non-empty string"), (v.spec, "x" * 51, "50 characters"), (v.spec, 7, "non-empty string"),
    ]
    for f, value, message in bad:
        with pytest.raises(ValidationError, match=re.escape(message)):
            f(value)


def test_error_codes():
    codes = [describe(e("x"))["code"] for e in (ValidationError, RegistryError, ContentError, PrerequisiteError, EngineError, ValueError)]
    assert codes == ["VALIDATION_ERROR", "REGISTRY_ERROR", "CONTENT_ERROR", "PREREQUISITE_ERROR", "INTERNAL_ERROR", "INTERNAL_ERROR"]
