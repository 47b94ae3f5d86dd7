"""Quality by weak supervision: rules vote good, vote bad or abstain, and a label model weighs them.

Expectation-maximisation estimates, for each rule, how often it is right about good and about bad documents, from the way the
rules agree over all documents; the posterior probability of a good document replaces all-must-pass filtering.

Everything is built from DataFrame functions. Measures are taken inside each row, without a shuffle. The model sees only
counts of vote patterns, at most 3 to the number of rules, so its input does not grow with the corpus, and those few rows are
also all that is broadcast.

Null and empty texts have no words: all measures are 0 and every rule but the length rule abstains. Rows are judged one by
one, so repeated rows agree. An empty table gives an empty result. Input columns other than the text and ``keep`` are ignored,
and those of ``keep`` that clash with a result are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.session import pin

#: Fixed characters of the measures: white space, symbols.
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 5


def _count(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_marked (words with a
    symbol), n_capitals and n_shouts instead of the text."""
    t = F.col("_t")
    at = lambda i: F.get("_words", i)
    step = docs.withColumn("_t", F.coalesce(F.col(text), F.lit(""))).drop(text)
    step = step.select(
        *(c for c in step.columns if c != "_t"),
        F.array_remove(F.split(F.translate(t, "\t\n\x0b\x0c\r", "     "), " "), "").alias("_words"),
        F.filter(F.split(t, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        F.length(F.translate(t, BLANKS, "")).cast("long").alias("word_chars"),
        _count(t, SYMBOLS).alias("n_symbols"),
        _count(t, CAPITALS).alias("n_capitals"),
        _count(t, "!").alias("n_shouts"),
    )
    hashes = F.transform("_words", lambda w, i: F.xxhash64(w, *(at(i + k) for k in range(1, WINDOW))))
    n = F.size("_words")
    step = step.select(
        "*",
        n.cast("long").alias("n_words"),
        F.size(F.filter("_words", lambda w: F.length(F.translate(w, SYMBOLS, "")) < F.length(w))).cast("long").alias("n_marked"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= WINDOW, F.slice(hashes, 1, F.greatest(n - WINDOW + 1, F.lit(1)))).alias("_hashes"),
    ).drop("_lines")
    # Equal windows have equal hashes, so a text whose hashes all differ repeats nothing. The others compare the words.
    some = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    windows = F.transform(
        F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.struct(F.concat_ws(" ", F.slice("_words", i, WINDOW)).alias("s"), i.alias("p"))
    )
    step = step.withColumn("_sorted", F.when(some, F.sort_array(windows))).drop("_words", "_hashes")
    near = lambda x, i: (x["s"] == F.get("_sorted", i - 1)["s"]) | (x["s"] == F.get("_sorted", i + 1)["s"])
    step = step.withColumn("_at", F.array_sort(F.transform(F.filter("_sorted", lambda x, i: F.coalesce(near(x, i), F.lit(False))), lambda x: x["p"])))
    covered = F.transform("_at", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_at", i + 1) - p, F.lit(WINDOW))))
    step = step.drop("_sorted").withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).cast("long"))
    # A generator of one row: no filter on a measure moves below it, where the optimizer would write out the arrays it is made of in full.
    return step.drop("_at").select(F.inline(F.array(F.struct(*(c for c in step.columns if c != "_at")))))


def default_rules() -> dict[str, Column]:
    """Votes over the measures: 1 good, -1 bad, 0 abstains."""
    c = F.col
    has = c("n_words") > 0

    def vote(bad: Column, good: Column) -> Column:
        return F.when(~has, 0).when(bad, -1).when(good, 1).otherwise(0)

    return {
        "length": F.when(c("n_words") < 10, -1).when(c("n_words") >= 30, 1).otherwise(0),
        "symbols": vote(c("n_symbols") * 20 > c("word_chars"), c("n_symbols") * 100 <= c("word_chars")),
        "marked_words": vote(c("n_marked") * 10 > c("n_words"), c("n_marked") * 50 <= c("n_words")),
        "repetition": vote(c("n_repeat_words") * 5 > c("n_words"), c("n_repeat_words") * 20 <= c("n_words")),
        "lines": vote(c("n_dup_lines") * 10 > c("n_lines") * 3, c("n_dup_lines") == 0),
        "capitals": vote(c("n_capitals") * 10 > c("word_chars") * 3, c("n_capitals") * 10 <= c("word_chars")),
        "shouting": vote(c("n_shouts") * 50 > c("word_chars"), c("n_shouts") * 500 <= c("word_chars")),
        "word_length": vote(
            (c("word_chars") < c("n_words") * 2) | (c("word_chars") > c("n_words") * 15),
            c("word_chars").between(c("n_words") * 3, c("n_words") * 10),
        ),
    }


def _posterior(votes: str, model: str) -> str:
    """Probability of a good document, given its votes and (prior, right about good, right about bad)."""
    return f"""1 / (1 + exp(-aggregate(sequence(0, size({votes}) - 1), ln({model}.prior) - ln(1 - {model}.prior), (sum, j) -> sum + CASE {votes}[j]
        WHEN 1 THEN ln({model}.good[j]) - ln(1 - {model}.bad[j])
        WHEN -1 THEN ln(1 - {model}.good[j]) - ln({model}.bad[j]) ELSE 0 END)))"""


def fit_label_model(patterns: DataFrame, rules: int, rounds: int = 60, start: tuple[float, float, float] = (0.85, 0.97, 0.3)) -> DataFrame:
    """One row per vote pattern (votes, n) with its posterior, after ``rounds`` of expectation-maximisation.

    Patterns are rows of one array here: at most 3**rules of them. ``start`` is the first (share of good documents, accuracy
    on good ones, accuracy on bad ones: rules rarely blame good documents, and a bad one fails some of them); one pseudo-document per outcome keeps all rates off 0 and 1.
    """
    row = patterns.agg(F.collect_list(F.struct("votes", "n")).alias("patterns"))
    prior, good, bad = start
    first = f"named_struct('prior', {prior}D, 'good', array_repeat({good}D, {rules}), 'bad', array_repeat({bad}D, {rules}))"

    def total(when: str, weight: str) -> str:
        return f"aggregate(weighed, 1D, (s, p) -> s + CASE WHEN {when} THEN p.{weight} ELSE 0D END)"

    def rate(vote: int, weight: str) -> str:
        return f"transform(sequence(0, {rules - 1}), j -> {total(f'p.votes[j] = {vote}', weight)} / (1 + {total('p.votes[j] != 0', weight)}))"

    weigh = f"transform(patterns, p -> named_struct('votes', p.votes, 'g', p.n * {_posterior('p.votes', 'model')}, 'b', p.n * (1 - {_posterior('p.votes', 'model')})))"
    update = f"""named_struct('prior', {total('true', 'g')} / (1 + {total('true', 'g')} + {total('true', 'b')} - 1), 'good', {rate(1, 'g')}, 'bad', {rate(-1, 'b')})"""
    # An array of one element binds the weighed patterns once per round.
    em = f"aggregate(sequence(1, {rounds}), {first}, (model, round) -> transform(array({weigh}), weighed -> {update})[0])"
    fitted = row.withColumn("model", F.expr(em))
    exploded = fitted.select(F.explode("patterns").alias("p"), "model").select("p.votes", "p.n", "model")
    return exploded.select("votes", "n", F.expr(_posterior("votes", "model")).alias("posterior"), "model")


def judge_quality(
    docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: dict[str, Column] | None = None, least: float = 0.5, rounds: int = 60
) -> DataFrame:
    """``keep`` columns of every document with the measures, votes, posterior and good (posterior at least ``least``)."""
    rules = rules or default_rules()
    made = {"n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_marked", "n_capitals", "n_shouts", "votes", "posterior", "good"}
    keep = tuple(c for c in keep if c not in made)
    measured = measure(docs.select(*keep, F.col(text).alias("_text")), "_text")
    voted = pin(measured.withColumn("votes", F.array(*(v.cast("int") for v in rules.values()))), "votes")
    patterns = voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n"))
    model = fit_label_model(patterns, len(rules), rounds).select("votes", "posterior")
    # At most 3 ** len(rules) rows.
    return voted.join(F.broadcast(model), "votes").withColumn("good", F.col("posterior") >= least)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def keep_good(docs: DataFrame, text: str = "text", rules: dict[str, Column] | None = None, least: float = 0.5, rounds: int = 60) -> DataFrame:
    """The rows of ``docs`` that are good and don't fail the basic limits.

    Texts are measured once; the rows wait in a written table until the model knows all votes.
    """
    rules = rules or default_rules()
    votes = F.array(*(v.cast("int") for v in rules.values())).alias("votes")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_text"))
    judged = pin(measure(rows, "_text").select("_row", votes, base_failed().alias("failed")), "judged")
    patterns = judged.select("votes").groupBy("votes").agg(F.count(F.lit(1)).alias("n"))
    model = fit_label_model(patterns, len(rules), rounds).select("votes", "posterior")
    kept = judged.filter(~F.col("failed")).join(F.broadcast(model), "votes")
    return kept.filter(F.col("posterior") >= least).select("_row.*")
