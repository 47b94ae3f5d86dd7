"""Secret scanning: fixed patterns, and a battery of randomness tests over other long tokens.

A token's encoding is inferred from its characters. Under the hypothesis that it is random in that alphabet, three tests give
p-values: chi-squared uniformity, runs about the alphabet's middle, and lag-1 serial correlation. They tell long ordinary tokens from random ones, and hardly
short ones. So the other side is tested too: under the hypothesis that a token is ordinary, that is made of words, numbers and signs with the letter pairs of the corpus, how
much better random characters explain it gives a p-value (a likelihood ratio of e**x has one of at most e**-x, at any length). A token
is reported if the second test finds it more random than ordinary text, and the first three do not reject that it is random.

Both decisions control the false-discovery rate (Benjamini-Hochberg), separately for each encoding and length band, over all tokens of the corpus: the
one bounds the ordinary tokens among the reported, the other the random ones among the rejected.

The rank that Benjamini-Hochberg needs comes from counts of p-values in fine bins (each p-value rounded up to its bin's edge,
which keeps the control), so what is gathered is bounded by bins and bands, not by tokens; of letter pairs there are 702. All of it is DataFrame functions.

Null texts are empty, and very long ones are scanned whole. Rows are scanned one by one; an empty table gives an empty result; columns other than the text and
``keep`` are ignored, and those of ``keep`` that clash with a result are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseflow.session import pin

#: Fixed patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")

#: Alphabets by name: characters in their order, and the pattern of a token in it. The first that fits is taken.
ENCODINGS = {
    "hex": ("0123456789abcdef", "^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$"),
    "hex_upper": ("0123456789ABCDEF", "^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$"),
    "base32": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "^(?=.*[A-Z])(?=.*[2-7])[A-Z2-7]+=*$"),
    "base36": ("0123456789abcdefghijklmnopqrstuvwxyz", "^(?=.*[0-9])(?=.*[a-z])[0-9a-z]+$"),
    "base36_upper": ("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "^(?=.*[0-9])(?=.*[A-Z])[0-9A-Z]+$"),
    "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/]+=*$"),
    "base64url": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", "^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9_-]+=*$"),
    # What fits no encoding as a whole is tested by its letters and digits, unless they are plain words (capitals at most in front) or digits only.
    "parts": ("0123456789abcdefghijklmnopqrstuvwxyz", "^(?=.*[0-9])(?=.*[a-z])[^A-Z]+$"),
    "parts_upper": ("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "^(?=.*[0-9])(?=.*[A-Z])[^a-z]+$"),
    "parts_mixed": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "^(?=.*[a-z])(?=.*[A-Z])(?=.*(?:[0-9]|[a-z][A-Za-z]*[A-Z])).+$"),
}
BINS_PER_DECADE = 64
SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"


def spans(text: str, pattern: str, kind: str, keep: str = "true") -> Column:
    """Leftmost non-overlapping matches as (kind, start, end) in code points, those for which ``keep`` holds.

    The pieces between the matches and the matches themselves add up to each match's place. ``keep`` may use ``hit.`1` `` (the
    match) and ``hit.`2` `` (group 2 of an assignment, else the match).
    """
    group = 2 if pattern is ASSIGN else 0
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    return F.expr(f"""
        aggregate(
            arrays_zip(split({text}, '{quoted}'), regexp_extract_all({text}, '{quoted}', 0), regexp_extract_all({text}, '{quoted}', {group})),
            named_struct('at', 0L, 'found', CAST(array() AS {SPAN})),
            (acc, hit) -> named_struct(
                'at', acc.at + length(hit.`0`) + coalesce(length(hit.`1`), 0),
                'found', CASE WHEN hit.`1` IS NOT NULL AND ({keep}) THEN concat(acc.found, array(named_struct(
                    'kind', '{kind}', 'start', acc.at + length(hit.`0`), 'end', acc.at + length(hit.`0`) + length(hit.`1`)))) ELSE acc.found END),
            acc -> acc.found)""")


def _upper_tail(z: str) -> str:
    """1 - normal distribution function of a column named ``z`` (Zelen and Severo's approximation, error under 1e-7)."""
    t = f"(1 / (1 + 0.2316419D * abs({z})))"
    poly = f"{t} * (0.319381530D + {t} * (-0.356563782D + {t} * (1.781477937D + {t} * (-1.821255978D + {t} * 1.330274429D))))"
    tail = f"(0.3989422804014327D * exp(-{z} * {z} / 2) * {poly})"
    return f"(CASE WHEN {z} >= 0 THEN {tail} ELSE 1 - {tail} END)"


def battery(tokens: DataFrame, token: str) -> DataFrame:
    """``tokens`` with encoding, n (its length without padding), p_uniform, p_runs, p_serial and p (Bonferroni over the three).

    The encoding is null for tokens in no listed alphabet, such as plain words and numbers, and so are their p-values.
    """
    encoding, alphabet = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (characters, pattern) in reversed(ENCODINGS.items()):
        fits = F.col(token).rlike(pattern)
        encoding, alphabet = F.when(fits, F.lit(name)).otherwise(encoding), F.when(fits, F.lit(characters)).otherwise(alphabet)
    step = tokens.withColumns({"encoding": encoding, "_alphabet": alphabet})
    step = step.withColumn("_x", F.expr(
        f"CASE WHEN encoding IS NOT NULL THEN transform(filter(split(rtrim('=', {token}), ''), c -> c != '' AND locate(c, _alphabet) > 0), c -> locate(c, _alphabet) - 1) END"
    ))
    step = step.withColumns({"n": F.size("_x"), "_a": F.length("_alphabet")})
    step = step.withColumn("_bins", F.expr("least(_a, greatest(2, n div 5))"))
    step = step.withColumn("_chi", F.expr("""
        aggregate(sequence(0, _bins - 1), 0D, (sum, b) -> sum + transform(array(named_struct(
            'seen', size(filter(_x, v -> v * _bins div _a = b)),
            'due', n * size(filter(sequence(0, _a - 1), v -> v * _bins div _a = b)) / CAST(_a AS double))),
            c -> (c.seen - c.due) * (c.seen - c.due) / c.due)[0])"""))
    step = step.withColumn("_free", F.expr("CAST(_bins - 1 AS double)"))
    step = step.withColumns({
        "_z1": F.expr("(pow(_chi / _free, 1 / 3D) - (1 - 2 / (9 * _free))) / sqrt(2 / (9 * _free))"),
        "_z2": F.expr("""abs(aggregate(sequence(1, n - 1), 0, (s, i) -> s + IF((_x[i] * 2 >= _a) != (_x[i - 1] * 2 >= _a), 1, 0)) - (n - 1) / 2D) / sqrt((n - 1) / 4D)"""),
        "_z3": F.expr("""abs(aggregate(sequence(1, n - 1), 0D, (s, i) -> s + (_x[i] - (_a - 1) / 2D) * (_x[i - 1] - (_a - 1) / 2D)) / ((_a * _a - 1) / 12D) / sqrt(n - 1))"""),
    })
    step = step.withColumns({
        "p_uniform": F.expr(_upper_tail("_z1")), "p_runs": F.expr(f"least(1D, 2 * {_upper_tail('_z2')})"), "p_serial": F.expr(f"least(1D, 2 * {_upper_tail('_z3')})"),
    })
    step = step.withColumn("p", F.expr("least(1D, 3 * least(p_uniform, p_runs, p_serial))"))
    return step.drop("_alphabet", "_x", "_a", "_bins", "_chi", "_free", "_z1", "_z2", "_z3")


#: The model of ordinary tokens: chances of the next kind of character. Kinds are a-z, a capital after something else, a further capital, digits, signs, and the start.
#: Words are long, begin with one capital at most or are all capitals; numbers are short and stand behind words rather than in them.
STEPS = {
    "small": {"small": 5 / 6, "capital": 1 / 15, "digit": 1 / 30, "sign": 1 / 15},
    "capital": {"small": 3 / 5, "capitals": 1 / 3, "digit": 1 / 30, "sign": 1 / 30},
    "capitals": {"small": 1 / 20, "capitals": 17 / 20, "digit": 1 / 20, "sign": 1 / 20},
    "digit": {"small": 1 / 20, "capital": 1 / 10, "digit": 7 / 20, "sign": 1 / 2},
    "sign": {"small": 1 / 2, "capital": 1 / 4, "digit": 1 / 6, "sign": 1 / 12},
    "start": {"small": 1 / 2, "capital": 1 / 4, "digit": 1 / 6, "sign": 1 / 12},
}
KIND_NAMES = tuple(STEPS)
SIGNS = "+/_-="


def letter_pairs(docs: DataFrame, text: str, shortest: int = 4, prior: float = 20.0) -> list[float]:
    """Costs (-ln of chances) of letter j after letter i at 26 i + j, and of a first letter j at 676 + j, in the words of all texts.

    Words are runs of at least ``shortest`` letters a-z after lower-casing A-Z; ``prior`` occurrences of each letter, all letters alike, smooth the counts.
    """
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = docs.select(F.explode(F.regexp_extract_all(lowered, F.lit(f"[a-z]{{{shortest},}}"), F.lit(0))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    places = words.select("n", F.expr("""explode(transform(sequence(1, length(word)), i ->
        IF(i = 1, 676, 26 * (ascii(substring(word, i - 1, 1)) - 97)) + ascii(substring(word, i, 1)) - 97))""").alias("place"))
    counts = [0.0] * 702
    for row in places.groupBy("place").agg(F.sum("n").alias("n")).collect():  # at most 702 rows
        counts[row.place] = float(row.n)
    costs = []
    for at in range(0, 702, 26):
        total = sum(counts[at : at + 26]) + prior * 26
        costs += [-math.log((n + prior) / total) for n in counts[at : at + 26]]
    return costs


def ordinary_cost(token: str, costs: list[float]) -> Column:
    """-ln of the chance of a token in the model of ordinary ones: ``STEPS`` between kinds of characters, the letter pairs of the corpus, digits and signs all alike."""
    cost = lambda chance: repr(-math.log(chance)) if chance else "1e3D"
    step = f"array({', '.join(cost(STEPS[k].get(j, 0)) for k in KIND_NAMES for j in KIND_NAMES)})"
    pairs = f"array({', '.join(map(repr, costs))})"
    small, capital, capitals, digit, sign, start = range(6)
    kind = f"IF(c BETWEEN 97 AND 122, {small}, IF(c BETWEEN 65 AND 90, IF(s.kind IN ({capital}, {capitals}), {capitals}, {capital}), IF(c BETWEEN 48 AND 57, {digit}, {sign})))"
    letter = "IF(c BETWEEN 97 AND 122, c - 97, IF(c BETWEEN 65 AND 90, c - 65, 26))"
    # A word goes on from letter to letter, unless a capital comes after a small one.
    return F.expr(f"""
        aggregate(transform(filter(split({token}, ''), x -> x != ''), x -> ascii(x)),
            named_struct('kind', {start}, 'letter', 26, 'cost', 0D),
            (s, c) -> transform(array(named_struct('kind', {kind}, 'letter', {letter})), z -> named_struct(
                'kind', z.kind, 'letter', z.letter,
                'cost', s.cost + {step}[6 * s.kind + z.kind] + CASE WHEN z.kind = {digit} THEN {cost(1 / 10)} WHEN z.kind = {sign} THEN {cost(1 / len(SIGNS))}
                    ELSE {pairs}[26 * IF(z.kind = {capital}, 26, s.letter) + z.letter] END))[0],
            s -> s.cost)""")


def random_cost(token: str) -> Column:
    """-ln of the chance of a token of random characters: of its encoding's alphabet, or of the kinds that it holds if these are fewer; sixteen alphabets are as likely."""
    kinds = " + ".join(f"IF({token} RLIKE '[{c}]', {n}, 0)" for c, n in (("a-z", 26), ("A-Z", 26), ("0-9", 10), ("^A-Za-z0-9", len(SIGNS))))
    own = "CASE encoding " + " ".join(f"WHEN '{k}' THEN {len(a) + len(SIGNS) * k.startswith('parts')}" for k, (a, _) in ENCODINGS.items()) + " END"
    return F.expr(f"length({token}) * ln(least({kinds}, {own})) + ln(16)")


def thresholds(tested: DataFrame, rate: float) -> DataFrame:
    """Largest bin of p-values rejected, per band (encoding and length): Benjamini-Hochberg over bin counts.

    ``tested`` has band and bin; higher bins hold smaller p-values. A bin's p-value is its upper edge.
    """
    counts = tested.groupBy("band", "bin").agg(F.count(F.lit(1)).alias("n"))
    # A band has a few thousand bins at most, however many tokens there are.
    smaller = W.partitionBy("band").orderBy(F.col("bin").desc())
    ranked = counts.withColumns({"rank": F.sum("n").over(smaller), "m": F.sum("n").over(W.partitionBy("band"))})
    edge = F.pow(F.lit(10.0), -F.col("bin") / BINS_PER_DECADE)
    return ranked.filter(edge <= rate * F.col("rank") / F.col("m")).groupBy("band").agg(F.min("bin").alias("bin"))


def find_secrets(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), least: int = 16, rate: float = 0.05) -> DataFrame:
    """``keep`` columns of every document with base (fixed patterns' spans) and spans (with those of random tokens), in order.

    Letter pairs are counted over all texts of ``docs``. Random tokens are runs of ``[A-Za-z0-9+/_-]`` of ``least`` or more characters, with ``=`` as trailing padding only, that are not
    inside a base span; those that a base span covers in part are tested whole.
    """
    keep = tuple(c for c in keep if c not in {"base", "spans"})
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    none = F.expr(f"CAST(array() AS {SPAN})")
    token = f"[A-Za-z0-9+/_-]{{{least},}}+(?:={{1,6}}(?![A-Za-z0-9+/_=-]))?"
    t = F.col("_t")

    def when(seen: Column, found: Column) -> Column:
        return F.when(seen, found).otherwise(none)

    found = rows.select(
        *keep,
        when(t.rlike(r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""), spans("_t", ASSIGN, "assign", "length(hit.`2`) >= 12")).alias("_assign"),
        when(t.contains("AKIA"), spans("_t", ACCESS, "access")).alias("_access"),
        when(t.rlike(HEX), spans("_t", HEX, "hex")).alias("_hex"),
        when(t.rlike(token), spans("_t", token, "random")).alias("_long"),
        t.alias("_t"),
    )
    order = "CASE x.kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS)) + " END"
    in_order = lambda array: F.expr(f"transform(array_sort(transform({array}, x -> named_struct('start', x.start, 'k', {order}, 'end', x.end, 'kind', x.kind))), x -> named_struct('kind', x.kind, 'start', x.start, 'end', x.end))")
    found = found.withColumn("base", in_order("concat(_assign, _access, _hex)")).drop("_assign", "_access", "_hex")
    found = found.withColumn("_tokens", F.expr("""
        transform(filter(_long, x -> NOT exists(base, b -> b.start <= x.start AND x.end <= b.end)),
            x -> named_struct('kind', x.kind, 'start', x.start, 'end', x.end, 'token', substring(_t, CAST(x.start + 1 AS int), CAST(x.end - x.start AS int))))"""))
    found = pin(found.drop("_t", "_long"), "secrets")
    tokens = found.select(F.explode("_tokens").alias("x")).select("x.token").filter("token IS NOT NULL")
    # Copies of a token are one discovery, and its verdict does not depend on how often it is copied.
    tested = battery(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("copies")), "token").filter("encoding IS NOT NULL AND n >= 2")
    bin_of = lambda p: F.expr(f"CAST(floor(-log10(greatest({p}, 1e-300)) * {BINS_PER_DECADE}) AS int)")
    # How much better random characters explain the token, without its padding.
    gain = ordinary_cost("_bare", letter_pairs(rows, "_t")) - random_cost("_bare")
    tested = tested.withColumn("_bare", F.expr("rtrim('=', token)")).withColumn("p_ordinary", F.exp(-F.greatest(F.lit(0.0), gain)))
    tested = pin(tested.select(
        "token", F.concat_ws(":", "encoding", F.expr("CAST(floor(2 * log2(n)) AS string)")).alias("band"), bin_of("p").alias("bin"), bin_of("p_ordinary").alias("ordinary_bin"), "p", "p_ordinary",
    ), "tested")
    limits = thresholds(tested.select("band", "bin"), rate).withColumnRenamed("bin", "limit")
    bounds = thresholds(tested.select("band", F.col("ordinary_bin").alias("bin")), rate).withColumnRenamed("bin", "bound")
    judged = tested.join(limits, "band", "left").join(bounds, "band")
    random = judged.filter("(limit IS NULL OR bin < limit) AND ordinary_bin >= bound").select("token")
    # Documents meet the verdicts by token: only rows that hold tokens take part, and copies of a document share its list.
    holders = found.filter(F.size("_tokens") > 0).select(F.col("_tokens.token").alias("_list")).distinct()
    # Written, so that both sides of the join below are read from tables, and a list of very many documents can be split.
    verdicts = pin(
        holders.select("_list", F.explode(F.array_distinct("_list")).alias("token")).join(random, "token")
        .groupBy("_list").agg(F.collect_set("token").alias("_random")), "verdicts"
    )
    extra = "transform(filter(_tokens, x -> array_contains(coalesce(_random, array()), x.token)), x -> named_struct('kind', x.kind, 'start', x.start, 'end', x.end))"
    joined = found.filter(F.size("_tokens") > 0).withColumn("_list", F.col("_tokens.token")).join(verdicts, "_list", "left")
    others = found.filter(F.size("_tokens") == 0).select(*keep, "base", F.col("base").alias("spans"))
    return joined.withColumn("spans", in_order(f"concat(base, {extra})")).select(*keep, "base", "spans").unionByName(others)


def redact(name: str, spans_name: str, mark: str) -> Column:
    """The text in column ``name`` with every span, overlapping ones as one, replaced by ``mark``."""
    return F.expr(f"""
        transform(array(aggregate({spans_name}, named_struct('at', 0L, 'out', ''),
            (acc, s) -> CASE WHEN s.end <= acc.at THEN acc
                WHEN s.start < acc.at THEN named_struct('at', s.end, 'out', acc.out)
                ELSE named_struct('at', s.end, 'out', concat(acc.out, substring({name}, CAST(acc.at + 1 AS int), CAST(s.start - acc.at AS int)), '{mark}')) END)),
            acc -> concat(acc.out, substring({name}, CAST(acc.at + 1 AS int))))[0]""")


def listed(array: str) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(array, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
