import pytest
from pyspark.sql import functions as F

from glossmeter import dims as D, messages as M


def test_catalogues_agree(spark):
    assert M.catalogue_problems(M.catalogue_df(spark)).count() == 0
    for locale in M.MESSAGES:
        assert set(M.LANGUAGE_NAMES[locale]) == set(D.LANGUAGES) and set(M.UNITS[locale]) == set(D.CORPORA)


def test_catalogue_faults_are_found(spark):
    broken = {"en": {"a": "{x} and {y}", "b": "plain", "c": "{z}"}, "vi": {"a": "{y} và", "b": " ", "d": "thừa"}}
    got = {(r.locale, r.key, r.problem) for r in M.catalogue_problems(M.catalogue_df(spark, broken)).collect()}
    assert got == {("vi", "a", "placeholders"), ("vi", "b", "empty"), ("vi", "c", "missing"), ("vi", "d", "unknown")}


def test_messages_take_columns(spark):
    df = spark.createDataFrame([("A = B", "medium"), ("C", "odd")], "names string, grade string")
    rows = df.select(M.message("en", "cap_shared_tokenizer", names=F.col("names")), M.confidence(F.col("grade"), "vi")).collect()
    assert rows[0][0] == "A = B: identical token counts (one shared tokenizer)" and rows[0][1] == "trung bình"
    assert rows[1][1] is None
    with pytest.raises(KeyError):
        M.message("en", "no_such_key")
    with pytest.raises(KeyError):
        M.message("vi", "cap_unpriced")
