import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from qirtas.llm.forms import comparison_key, disguised, per_value, plain


@pytest.mark.parametrize(
    "text,want",
    [
        ("ﬁnal", "final"), ("Ｓｅｎｄｅｒ", "Sender"), ("a b", "a b"), ("a​b", "ab"), ("011‑0009", "011-0009"), ("Größe", "Größe"), ("K", "K"),
        ("Аmount", "Amount"), ("Το", "To"), ("ІР-504829", "IP-504829"), ("Ϲοral Саsh", "Coral Cash"), ("Магазин Чайка", "Магазин Чайка"), ("Mагазин", "Магазин"),
        ("Αγορά Νήσος", "Αγορά Νήσος"), ("التاریخ", "التاريخ"), ("۰۱۲", "٠١٢"), ("ﺍﻟﻤﺒﻠﻎ", "المبلغ"), ("x²", "x²"), ("a  b", "a  b"), ("شُكْراً", "شُكْراً"), ("", ""), ("O0", "O0"),
    ],
)
def test_plain(text, want):
    assert plain(text) == want


@settings(max_examples=300)
@given(st.text(alphabet=st.characters(min_codepoint=32, max_codepoint=0x6FF) | st.sampled_from("ＡＢﬁ​⁦　ΑВсﺍ²½"), max_size=30))
def test_laws(text):
    once = plain(text)
    assert plain(once) == once
    assert unicodedata.is_normalized("NFC", once)
    assert comparison_key(once) == comparison_key(text)


def test_key_makes_equal_looking_equal():
    assert comparison_key("STRASSE  x²") == comparison_key("straße x2 ")


def test_per_value_runs_once_for_each():
    import pandas as pd

    seen = []
    got = per_value(lambda v: seen.append(v) or v.upper())(pd.Series(["a", None, "a", "b"], dtype=object))
    assert list(got) == ["A", None, "A", "B"] and seen == ["a", "b"]
    assert list(per_value(str)(pd.Series([None, None], dtype=object))) == [None, None]


def test_table(spark):
    long = "Аb" * 100_000
    data = [("r", 1, "Аmount", ["Аmount", "Amount", None], "t"), ("r", 2, "plain", None, None), (None, None, None, [], None), ("r", 3, "", [""], None), ("r", 4, long, ["a b"], None), ("r", 1, "Аmount", ["Аmount", "Amount", None], "t")]
    df = spark.createDataFrame(data, "receipt_id string, line_no int, text string, alts array<string>, TEXT string")
    got = [tuple(r) for r in disguised(df).select("receipt_id", "line_no", "field", "pos", "plain").collect()]
    one = [("r", 1, "text", 0, "Amount"), ("r", 1, "alts", 0, "Amount")]
    assert sorted(got) == sorted([*one, *one, ("r", 4, "text", 0, "Ab" * 100_000), ("r", 4, "alts", 0, "a b")])
    assert disguised(df.limit(0)).count() == 0
