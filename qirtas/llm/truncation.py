"""Text cut off by field limits or in transfer: truncated records, and how often each source truncates.

Three kinds of evidence, all from the whole texts of all documents:

* Structure. A commit record promises what it holds: a hunk header states its numbers of lines, a file header is followed
  by hunks, a sender line by a message, a source that signs its records signs each of them. A promise left open is a cut.
* Vocabulary trie. The words of the corpus form a trie; its nodes are the rows of a table, so that it may be of any size.
  A final token that is no known word but a proper prefix of known words is a cut; the same trie under the preceding word
  tells a cut from an end where the token by itself is a word ("config read" of "config reader"), and how often lines end
  after a pair tells a title that stops in the middle ("Merge branch").
* Length. A source whose broken records crowd at one length has a field limit; a text of that length that ends without a
  closing mark is a cut even where its structure and its final token could be whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qirtas.runtime import only, written

# --- Fixed values -----------------------------------------------------------------------------------------------------
CUT_MARKS = r"(?:\.\.\.|…|\[…\]|\[\.\.\.\]|\[(?:cut|truncated|snip|more)\]|<(?:cut|truncated)>|\((?:cut|truncated)\))\s*$"
CLOSING = tuple(".!?。؟:;)]}>\"'»”`")
TRAILER = r"(?:Signed-off-by|Co-authored-by|Reviewed-by|Acked-by|Tested-by|Reported-by|Refs|Fixes|Closes|See-also|Change-Id|Cc|Link): "
SIGNATURE = r"\n-- \n\d[\d.]*\n*$"
# ----------------------------------------------------------------------------------------------------------------------

#: A title's final pair counts as an ordinary end if at least this share of its occurrences end a title.
END_SHARE = 0.03
#: A token is no word of its own if it stands alone at most this share as often as longer words run through its node.
KNOWN_SHARE = 0.05
#: Occurrences that a continuation needs to be one.
KNOWN = 2
#: Occurrences from which on the places where a word or a pair stands say something.
OFTEN = 20
#: Broken records of one source and length that show a field limit, if they are at least half of its records of that length.
CROWD = 5

_HUNK = re.compile(r"@@ -\d+(?:,(\d+))? \+\d+(?:,(\d+))? @@")
_MARK, _TRAILER, _SIGNATURE = re.compile(CUT_MARKS, re.I), re.compile(TRAILER), re.compile(SIGNATURE)
_TOKEN = re.compile(r"\w+")
_BASE85 = re.compile(r"[A-Za-z][!-~]*$")
_HEADER = re.compile(r"(?:commit [0-9a-f]|From: |Author: |Date: |Subject: |From [0-9a-f]{40})")

SHAPE_SCHEMA = "doc_id bigint, source string, length int, state string, signed boolean, prev string, last string, title_end boolean, closed boolean"


def shape(token: str) -> str:
    """The token with its runs of digits as one 0."""
    return re.sub(r"\d+", "0", token)


def diff_state(lines: list[str]) -> str:
    """Where a diff ends: 'open' where more is promised, 'done' where all that was promised is there, 'binary' where it
    ends in a complete binary patch."""
    old = new = 0
    state = "done"
    rest = 0  # characters of base85 that a line of a binary patch must have
    for at, line in enumerate(lines):
        last = at == len(lines) - 1
        if old > 0 or new > 0:
            if line[:1] == "+":
                new -= 1
                continue
            if line[:1] == "-":
                old -= 1
                continue
            if line[:1] == " " or (not line and not last):
                old, new = old - 1, new - 1
                continue
            if line[:1] == "\\" or not line:
                continue
            old = new = 0
        if m := _HUNK.match(line):
            old, new = int(m[1] or 1), int(m[2] or 1)
            state = "hunk"
        elif line.startswith("@@"):
            state = "open"
        elif line.startswith("diff --git "):
            state = "open"
        elif line.startswith(("Binary files ", "GIT binary patch", "rename to ", "new mode ", "copy to ", "deleted file mode ")):
            state = "binary" if line.startswith("GIT") else "done" if not line.startswith("Binary") or line.rstrip().endswith("differ") else "open"
        elif line.startswith(("index ", "--- ", "+++ ", "similarity ", "old mode", "new file", "rename from", "copy from")) and state != "hunk":
            state = "done" if state == "done" and line.startswith("index ") else "open"
        elif state == "binary" and line.startswith(("literal ", "delta ")):
            rest = 1
        elif state == "binary" and rest and line and _BASE85.match(line):
            n = ord(line[0]) - 64 if line[0].isupper() else ord(line[0]) - 96 + 26
            rest = 2 if len(line) - 1 >= -(-n // 4) * 5 else 3
    if old > 0 or new > 0:
        return "open"
    if state == "binary":
        return "binary" if rest == 2 else "open"
    return "open" if state == "open" else "done"


def tail(doc_id: int, source: str | None, text: str) -> tuple:
    """A row of SHAPE_SCHEMA: how the text ends.

    state: open (structure promises more), mark (a mark was put at the cut), diff, binary (a complete diff), title (in its first line), prose, list (a path or other line of a list), trailer. prev, last: the final two
    tokens with digits as 0. closed: whether the text ends with a closing mark.
    """
    stripped = text.rstrip()
    signed = bool(_SIGNATURE.search(text))
    words = _TOKEN.findall(stripped[-400:])
    prev, last = (shape(words[-2]) if len(words) > 1 else ""), (shape(words[-1]) if words else "")
    closed = stripped.endswith(CLOSING)
    row = lambda state, title=False: (doc_id, source, len(text), state, signed, prev, last, title, closed)
    if _MARK.search(text):
        return row("mark")
    at = text.find("diff --git ") if text.startswith("diff --git ") else text.find("\ndiff --git ") + 1
    if at > 0 or text.startswith("diff --git "):
        body = _SIGNATURE.sub("\n", text[at:]) if signed else text[at:]
        return row({"open": "open", "binary": "binary"}.get(diff_state(body.split("\n")), "diff"))
    if re.search(r"\n \d+ files? changed[^\n]*\n*$", text):
        return row("open")
    if "\n" in text and re.search(r"\n(?:diff|diff -|diff --|diff --g|diff --gi|diff --git)\s?$", text):
        return row("open")
    # header lines of the exports, then the message
    lines = text.split("\n")
    headed = bool(_HEADER.match(lines[0]))
    k = 0
    if headed:
        while k < len(lines) and lines[k].strip() and _HEADER.match(lines[k]) or (k < len(lines) and k and lines[k].startswith((" ", "\t")) and lines[k - 1].startswith("Subject: ")):
            k += 1
        if lines[0].startswith("commit "):
            if k >= len(lines) or not any(x.strip() for x in lines[k:]):
                return row("open")
        elif any(x.startswith("Subject: ") for x in lines[:k]):
            k = next(i for i, x in enumerate(lines) if x.startswith("Subject: "))
        else:
            return row("open")
        if k < len(lines) and lines[k].strip() and not lines[k].startswith(("Subject: ", " ", "\t")):
            return row("open")
    message = "\n".join(lines[k:]).strip()
    if signed:
        return row("diff")
    final = message.rsplit("\n", 1)[-1]
    if "\n" not in message:
        return row("title", True)
    if _TRAILER.match(final.strip()):
        return row("open" if "-by: " in final and not final.rstrip().endswith(">") else "trailer")
    if final.strip() == "# Conflicts:" or final.startswith("#\t") and "." not in final:
        return row("open")
    if final.strip().startswith(("#", "* ", "- ")) and not closed:
        return row("list")
    return row("prose")


def _tails(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [f.split()[0] for f in SHAPE_SCHEMA.split(", ")]
    for b in batches:
        yield pd.DataFrame([tail(d, s, t) for d, s, t in zip(b["doc_id"], b["source"], b["text"])], columns=names)


def tails(documents: DataFrame) -> DataFrame:
    """How each text ends, one row for each document whose text is neither null nor blank."""
    rows = documents.where(F.col("text").rlike(r"\S")).select("doc_id", "source", "text")
    return rows.mapInPandas(_tails, SHAPE_SCHEMA)


def _tokens(text: F.Column) -> F.Column:
    return F.regexp_replace(text, r"[0-9]+", "0")


def vocabulary(documents: DataFrame) -> DataFrame:
    """word, n: how often each word stands in the texts before their last token."""
    words = F.regexp_extract_all(_tokens(F.col("text")), F.lit(r"(?U)\w+"), F.lit(0))
    return documents.select(F.explode(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def message_lines(text: str) -> list[str]:
    """The lines of the message: without the export's header lines, the diff and the signature."""
    at = text.find("\ndiff --git ")
    lines = (text[:at] if at >= 0 else "" if text.startswith("diff --git ") else text).split("\n")
    k = 0
    while k < len(lines) and _HEADER.match(lines[k]) and not lines[k].startswith("Subject: "):
        k += 1
    if k < len(lines) and lines[k].startswith("Subject: "):
        lines[k] = lines[k][9:]
    return [x for x in lines[k:] if x.strip()]


def _pair_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        n: Counter = Counter()
        ends: Counter = Counter()
        for text in b["text"]:
            lines = [[shape(w) for w in _TOKEN.findall(x)] for x in message_lines(text)]
            words = [w for x in lines for w in x]
            # the last token of the message counts where a diff or a signature follows it
            stop = len(words) if "\ndiff --git " in text or "\n-- \n" in text else len(words) - 1
            first = len(lines[0]) - 1 if lines else -1
            for k in range(1, stop):
                pair = words[k - 1], words[k]
                n[pair] += 1
                ends[pair] += k == first
        yield pd.DataFrame([(*p, c, ends[p]) for p, c in n.items()], columns=["prev", "word", "n", "ends"])


def pairs(documents: DataFrame) -> DataFrame:
    """prev, word, n (occurrences in messages before their last token), ends (of these, at the end of a first line)."""
    counts = documents.select("text").mapInPandas(_pair_counts, "prev string, word string, n bigint, ends bigint")
    return counts.groupBy("prev", "word").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))


def _nodes(words: DataFrame, context: list[str]) -> DataFrame:
    """The trie's nodes below each context: node, through (occurrences of longer words below it)."""
    prefixes = F.expr("transform(sequence(1, length(word) - 1), k -> substring(word, 1, k))")
    return words.where(F.length("word") > 1).select(*context, F.explode(prefixes).alias("node"), "n").groupBy(*context, "node").agg(F.sum("n").alias("through"))


def judged(documents: DataFrame) -> DataFrame:
    """doc_id, source, length, state, cut: whether each text was cut; see the module.

    Null and blank texts and rows without an id have no row; a null source is a source of its own. Documents are judged one by one: copies get the same answer.
    """
    docs = only(documents, "doc_id", "source", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    ends = written(tails(docs), "tails")
    words = written(vocabulary(docs), "vocabulary")
    two = written(pairs(docs), "pairs")
    asked = ends.select("prev", F.col("last").alias("word")).distinct()
    lasts = asked.select("word").distinct()
    # only nodes that a final token asks for are kept
    uni = lasts.join(words.select("word", F.col("n").alias("seen")), "word", "left").join(_nodes(words, []).withColumnRenamed("node", "word"), "word", "left")
    below = _nodes(two.select("prev", "word", "n"), ["prev"]).withColumnRenamed("node", "word").withColumnRenamed("through", "pair_through")
    bi = asked.join(two.select("prev", "word", F.col("n").alias("pair_n"), F.col("ends").alias("pair_ends")), ["prev", "word"], "left").join(below, ["prev", "word"], "left")
    at_end = two.groupBy("word").agg(F.sum("n").alias("word_n"), F.sum("ends").alias("word_ends"))
    finals = ends.where(F.col("title_end")).groupBy("prev", F.col("last").alias("word")).agg(F.count(F.lit(1)).alias("finals"))
    sources = ends.groupBy("source").agg(F.avg(F.col("signed").cast("int")).alias("signs"))
    crowded = ends.groupBy("source", "length").agg(F.count_if(F.col("state") == "open").alias("crowd"), F.count(F.lit(1)).alias("same_length"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    known = ends.withColumnRenamed("last", "word")
    for extra, on in ((uni, ["word"]), (bi, ["prev", "word"]), (at_end, ["word"]), (finals, ["prev", "word"])):
        known = known.join(extra, on, "left")
    known = known.join(sources.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    known = known.join(crowded.select(F.col("source").alias("_s"), F.col("length").alias("_l"), "crowd", "same_length"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("length") == F.col("_l")), "left").drop("_s", "_l")
    wordlike = F.col("word").rlike(r"(?U)^[\p{L}_]")
    prefix = wordlike & (zero("seen") <= KNOWN_SHARE * zero("through")) & (zero("through") >= KNOWN)
    pair_prefix = wordlike & (zero("pair_n") + zero("finals") <= 1 + F.floor(zero("pair_through") / 20)) & (zero("pair_ends") == 0) & (zero("pair_through") >= KNOWN)
    middle = wordlike & (zero("pair_n") >= OFTEN) & (zero("pair_ends") + zero("finals") < F.greatest(F.lit(END_SHARE) * (zero("pair_n") + zero("finals")), F.lit(1.5)))
    middle_word = wordlike & (zero("word_n") >= OFTEN) & (zero("word_ends") == 0) & (zero("pair_ends") == 0) & (zero("finals") <= 1)
    limit = (zero("crowd") >= CROWD) & (2 * zero("crowd") >= zero("same_length")) & ~F.col("closed")
    cut = (
        F.when(F.col("state").isin("open", "mark"), True)
        .when((F.col("signs") > 0.5) & ~F.col("signed"), True)
        .when(F.col("state") == "diff", (prefix & ~F.col("closed") | limit) & ~F.col("signed"))
        .when(F.col("state") == "binary", False)
        .when(F.col("state") == "trailer", prefix & ~F.col("closed") | limit)
        .when(F.col("state") == "list", prefix | pair_prefix | limit)
        .when(F.col("state") == "title", ~F.col("closed") & (prefix | pair_prefix | middle | middle_word) | limit)
        .otherwise(~F.col("closed") & (prefix | pair_prefix) | limit)
    )
    return known.select("doc_id", "source", "length", "state", "signed", "prev", "word", "closed", "seen", "through", "pair_n", "pair_ends", "pair_through", "word_n", "word_ends", "finals", limit.alias("at_limit"), F.coalesce(cut, F.lit(False)).alias("cut"))


def rates(judgements: DataFrame) -> DataFrame:
    """source, documents, cut, rate: how often each source truncates, over documents with text."""
    return judgements.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if("cut").alias("cut_documents")).withColumn("rate", F.round(F.col("cut_documents") / F.col("documents"), 6))
