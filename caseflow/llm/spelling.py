"""Spelling variants by a trie-node pair dictionary.

The words form two tries, one of them read backwards, whose nodes are numbered: a prefix is a node of the one, a suffix of the other. For each position
of a word the pair (node of what stands before, node of what stands after) is written down twice: once with the letter there skipped, once with nothing
skipped. Two words that differ by one replaced letter have the same pair with that letter skipped; where a word has one letter more, its pair with the
letter skipped is a pair of the shorter word with nothing skipped. Pairs are integers and name prefix and suffix exactly, so what
meets is near without a further check. In a run of equal letters only the first counts as skipped for a shorter word, so every near pair meets once.

A pair's words agree in all but one letter, so there are as many at most as the alphabet has letters, and one shorter word.
Each word gets the number of the others and the best of them there; pairs of words are never written out. Nodes of up to three letters are numbered by their letters,
so no short prefix, which very many words share, is ever looked up; deeper nodes get numbers from a table of the distinct ones.

Null words are left out, and counts of a word given several times are added up. The empty word and words of one letter are words like others.
Ties go to the smaller word in code-point order. An empty table gives an empty result, and columns besides word and n are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.session import pin

#: Letters up to which a node is numbered by its letters, 21 bits each.
SHALLOW = 3


def _spelled(part: Column) -> Column:
    """A number of its own, not negative, for every string of at most ``SHALLOW`` code points."""
    number = F.lit(0).cast("long")
    for i in range(1, SHALLOW + 1):
        letter = F.when(F.length(part) >= i, F.ascii(F.substring(part, i, 1)) + 1).otherwise(0)
        number = F.shiftleft(number, 21) + letter.cast("long")
    return number


def _nodes(words: DataFrame, part: str, label: str) -> DataFrame:
    """Deep nodes of a trie, numbered below zero: (part, node). ``part`` is the node of a word at depth ``i``."""
    deep = words.select(F.explode(F.expr(f"transform(sequence({SHALLOW + 1}, greatest({SHALLOW + 1}, length(word))), i -> {part})")).alias("part"))
    distinct = deep.filter(F.length("part") > SHALLOW).distinct()
    # Written before it is read, so that a task that is run again can't number its rows anew.
    return pin(distinct.select("part", (-1 - F.monotonically_increasing_id()).alias("node")), label)


def _numbered(pairs: DataFrame, column: str, nodes: DataFrame) -> DataFrame:
    """``pairs`` with the number of the node in ``column`` in its place."""
    shallow = pairs.filter(F.length(column) <= SHALLOW).withColumn(column, _spelled(F.col(column)))
    others = pairs.filter(F.length(column) > SHALLOW).join(nodes.withColumnRenamed("part", column), column).drop(column).withColumnRenamed("node", column)
    return shallow.unionByName(others)


def word_pairs(words: DataFrame) -> DataFrame:
    """(word, n, head, tail, gap, first) for every position of every word, head and tail being node numbers.

    ``gap`` rows skip nothing; in the others ``first`` says that the skipped letter is the first of a run of equal ones.
    """
    heads = _nodes(words, "left(word, i)", "heads")
    tails = _nodes(words, "right(word, i)", "tails")
    places = words.select("word", "n", F.expr("explode(sequence(0, length(word)))").alias("i"))
    head = F.expr("left(word, i)")
    gaps = places.select("word", "n", head.alias("head"), F.expr("substring(word, i + 1)").alias("tail"), F.lit(True).alias("gap"), F.lit(False).alias("first"))
    first = F.expr("i = 0 OR substring(word, i + 1, 1) != substring(word, i, 1)")
    skips = places.filter("i < length(word)").select("word", "n", head.alias("head"), F.expr("substring(word, i + 2)").alias("tail"), F.lit(False).alias("gap"), first.alias("first"))
    return _numbered(_numbered(gaps.unionByName(skips), "head", heads), "tail", tails)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best, best_n) for every word that has one at a distance of one letter; best is the one of largest n."""
    groups = word_pairs(words).groupBy("head", "tail").agg(F.collect_list(F.struct("word", "n", "gap", "first")).alias("members"))
    met = groups.filter(F.size("members") > 1).select("members", F.explode("members").alias("x"))
    # Two gaps would be one word, which is here once.
    others = F.expr("filter(members, y -> y.word != x.word AND IF(x.gap, y.first, NOT y.gap OR x.first))")
    best = F.expr("array_min(transform(others, y -> named_struct('rank', -y.n, 'word', y.word)))")
    seen = met.select(F.col("x.word").alias("word"), others.alias("others")).select("word", F.size("others").cast("long").alias("k"), best.alias("best"))
    total = seen.filter("k > 0").groupBy("word").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))
    return total.select("word", "n_near", F.col("best.word").alias("best"), (-F.col("best.rank")).alias("best_n"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) for every word of ``links`` (word, form), by doubling: links lead to ever more frequent words, so they end."""
    reached = pin(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = pin(reached.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        reached = after.select("word", "root")
        if not after.filter("moved").limit(1).count():
            return reached


def group_variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """One row per word of ``words`` (word, n): word, n, n_near, form (its most frequent near word if ``ratio`` times as frequent), form_n, root."""
    known = pin(words.filter("word IS NOT NULL").groupBy("word").agg(F.sum("n").cast("long").alias("n")), "words")
    near = known.join(near_words(known), "word", "left")
    fits = F.col("best_n") >= ratio * F.col("n")
    named = pin(
        near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("best")).alias("form"), F.when(fits, F.col("best_n")).alias("form_n")),
        "forms",
    )
    ends = roots(named.filter("form IS NOT NULL"))
    return named.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def count_words(docs: DataFrame, form_of: Column, text: str = "text", pattern: str = r"[A-Za-zÀ-ÿ]+", shortest: int = 6, least: int = 5) -> DataFrame:
    """(word, n): distinct forms of at least ``shortest`` code points and ``least`` occurrences in all whole texts.

    ``form_of`` turns the column ``run``, a match of ``pattern`` with A-Z in lower case and at least ``shortest`` long, into the word that it counts as; it
    may use all columns of ``docs``. Occurrences are counted where they are read before anything moves. A column of ``docs`` named run is not seen.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    matches = F.regexp_extract_all(F.translate(F.col(text), upper, lower), F.lit(pattern), F.lit(0))
    runs = docs.select(*(c for c in docs.columns if c not in (text, "run")), F.explode(matches).alias("run")).filter(F.length("run") >= shortest)
    counts = runs.groupBy(form_of.alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return counts.filter((F.length("word") >= shortest) & (F.col("n") >= least))
