import random

import pytest

from qirtas.llm import truncation as T

DIFF = "Fix the loader\n\nIt works now.\n\ndiff --git a/x/y.py b/x/y.py\nindex 1..2 100644\n--- a/x/y.py\n+++ b/x/y.py\n@@ -1,2 +1,3 @@ def f\n a = 1\n+b = 2\n c = 3"


@pytest.mark.parametrize(
    "text,state",
    [
        (DIFF, "diff"), (DIFF + "\n", "diff"), (DIFF[:-8], "open"), (DIFF[:128], "open"), (DIFF[:90], "open"), ("Fix the loader", "title"), ("Fix…", "mark"), ("Fix the lo...", "mark"), ("A\n\nIt works now.", "prose"),
        ("commit 12ab\nAuthor: A <a@b.c>\nDate: now\n\n    Fix", "title"), ("commit 12ab\nAuthor: A <a@b", "open"), ("From: A <a", "open"), ("A\n\nSigned-off-by: X <x@y.z>", "trailer"), ("A\n\nSigned-off-by: X <x", "open"),
        ("Merge\n\n# Conflicts:\n#\tx/y.py", "list"), ("Merge\n\n# Conflicts:\n#\tx/y", "open"), ("Merge\n\n# Conflicts:", "open"), ("A\n\n 2 files changed", "open"),
        ("B\n\ndiff --git a/x.bin b/x.bin\nindex 1..2 100644\nBinary files a/x.bin and b/x.bin differ", "diff"), ("B\n\ndiff --git a/x.bin b/x.bin\nindex 1..2 100644\nBinary files a/x", "open"),
    ],
)
def test_tail(text, state):
    assert T.tail(1, "s", text)[3] == state


def corpus(size=300):
    rnd = random.Random(1)
    verbs, things, ends = ["Fix", "Rework", "Drop"], ["config reader", "label matcher", "queue depth"], ["during rollback", "on slow networks", ""]
    docs = []
    for k in range(size):
        title = f"{rnd.choice(verbs)} {rnd.choice(things)} {rnd.choice(ends)}".strip()
        body = f"The {rnd.choice(things)} was wrong {rnd.choice(ends) or 'before'}. Nothing else depends on the {rnd.choice(things)}{rnd.choice([' wr', ' mat', '']) if size > 300 and k % 400 == 0 else ''}."
        docs.append((k, "mail" if k % 3 == 0 else "forge", f"{title}\n\n{body}" + ("\n-- \n2.4.1\n" if k % 3 == 0 else "")))
    return docs


def test_more_text_does_not_make_cut_words_known(spark):
    """The ends of cut words are met as words too, the more text there is: what counts is their share."""
    cut = {100_000: "Fix config read", 100_001: "Rework label mat", 100_002: "Fix queue depth\n\nThe label matcher was wr"}
    for size in (300, 4000):
        df = spark.createDataFrame([(k, s, x) for k, s, x in corpus(size)] + [(k, "forge", x) for k, x in cut.items()], "doc_id bigint, source string, text string")
        assert {r["doc_id"] for r in T.judged(df).where("cut").collect()} == set(cut), size


def test_table(spark):
    docs = corpus()
    cut = {1000: "Fix config read", 1001: "Rework label mat", 1002: "Drop queue depth on slow", 1003: "Fix queue depth\n\nThe label matcher was wr", 1004: DIFF[:-8], 1005: "Fix label matcher..."}
    whole = {1100: "Fix config reader", 1101: "Odd title", 1102: DIFF, 1103: "fix", 1104: "Drop label matcher during rollback"}
    rows = [(k, "forge", t, "x") for k, t in {**cut, **whole}.items()] + [(k, s, t, None) for k, s, t in docs]
    rows += [(1200, "mail", "Fix queue depth\n\nThe queue depth was wrong during rollback.", None)]  # unsigned, where all sign
    rows += [(1300, "forge", None, None), (1301, "forge", "", None), (1302, None, "Fix config reader", None), (None, "forge", "Fix config read", None), (1303, "forge", "word " * 100_000 + "end.", None), (1000, "forge", cut[1000], "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string, TEXT string")
    judged = T.judged(df).select("doc_id", "source", "cut").collect()
    assert {r["doc_id"] for r in judged if r["cut"]} == {*cut, 1200}
    assert sum(r["doc_id"] == 1000 for r in judged) == 2 and 1302 in {r["doc_id"] for r in judged} and 1300 not in {r["doc_id"] for r in judged}
    rate = {r["source"]: r for r in T.rates(T.judged(df)).collect()}
    assert rate["mail"]["cut_documents"] == 1 and rate["forge"]["cut_documents"] == 7
    assert T.judged(df.limit(0)).count() == 0
