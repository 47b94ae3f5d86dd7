"""Operators 11 to 13 against plain versions on whole small tables, and on awkward input."""

import base64
import hashlib
import math
import random
import re
import zlib
from array import array
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseflow.llm import archive, components, decontaminate, jaccard, online_packing, queries, reputation, runs, secrets, shards, spelling, surrogates
from caseflow.session import checkpoint_root
from test_llm_operators import AWKWARD, CLASHES, DOCS, LONG, plain_components

BYTE_BPE = queries.tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def texts(spark, smoke_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{smoke_dir}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(*row, 7, "x", "y", "z", 1, 2, 3, "v", "h", 5) for row in AWKWARD], f"{DOCS}, {CLASHES}")


# --- spelling variants ----------------------------------------------------------------------------


def plain_counts(texts):
    seen = Counter()
    for i, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 6 and n >= 5}


def edits(word, alphabet):
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in alphabet}
    out |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in alphabet}
    return out - {word}


def plain_variants(counts):
    alphabet, rows = {c for w in counts for c in w}, {}
    for word, n in counts.items():
        near = [w for w in edits(word, alphabet) if w in counts]
        best = min(near, key=lambda w: (-counts[w], w), default=None)
        rows[word] = (n, len(near), best if best is not None and counts[best] >= 5 * n else None)
    out = {}
    for word, (n, k, form) in rows.items():
        root = word
        while rows[root][2] is not None:
            root = rows[root][2]
        out[word] = (n, k, form, None if form is None else counts[form], root)
    return out


def test_variants_of_the_whole_table(spark, smoke_dir, texts):
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in queries.op11_spelling_variants(spark, smoke_dir).collect()}
    want = plain_variants(plain_counts(texts.items()))
    assert got == want and any(v[2] for v in want.values())


def test_variants_of_dense_words(spark):
    """Short words over few letters: runs of equal letters, many neighbours, chains of forms, a letter beyond 16 bits."""
    rng = random.Random(3)
    counts = {"".join(rng.choice("abé𝄞") for _ in range(rng.randint(1, 6))): rng.choice([1, 5, 7, 30, 200, 1100, 9000]) for _ in range(700)} | {"": 3}
    rows = [(w, n, "x") for w, n in counts.items()]
    df = spark.createDataFrame([*rows, (None, 4, "x"), ("aaaa", 2, "x"), ("aaaa", 3, "x")], "word string, n long, root string")
    counts["aaaa"] = counts.get("aaaa", 0) + 5
    got = spelling.group_variants(df).collect()
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in got} == plain_variants(counts) and len(got) == len(counts)
    assert any(r.form is not None and r.root != r.form for r in got)
    assert spelling.group_variants(df.filter("false")).collect() == []


def test_counts_of_awkward_rows(spark, awkward):
    docs = awkward.withColumn("run", F.lit(9))
    extra = spark.createDataFrame([(i, "Éclairs éclairs " * 3 + "same-SAME rowses") for i in range(2000, 2500)] + [(None, "rowses")], "doc_id long, text string")
    docs = docs.unionByName(extra, allowMissingColumns=True)
    got = {r.word: r.n for r in spelling.count_words(docs, queries.variant_of_run()).collect()}
    want = plain_counts([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert got == want and len(want) == 3 and want["rowses"] < 501  # capitals outside A-Z stay, and some runs lost a letter


# --- online packing -------------------------------------------------------------------------------


def unpacked(rows, ids_of, length):
    """Checks that the pieces of each row tile its ids, and each sequence its pieces; the padding that is left."""
    for key, pieces in rows.items():
        stream, at = ids_of[key], 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(stream) // 4
            assert r.ids_crc32 == zlib.crc32(stream[4 * at : 4 * (at + r.length)])
            at += r.length
        assert 4 * at == len(stream)
    sequences, padding = defaultdict(list), 0
    for pieces in rows.values():
        for r in pieces:
            sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= length
        padding += length - at if at & (at - 1) else 0
    return padding, sum(len(s) for s in ids_of.values()) // 4


def ids_with_end(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BYTE_BPE)
    return {i: array("I", [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]).tobytes() for i, t in texts.items()}


def test_online_packing_of_the_whole_table(spark, smoke_dir, texts):
    rows = defaultdict(list)
    for r in queries.op12_online_packing(spark, smoke_dir).collect():
        rows[r.doc_id].append(r)
    assert set(rows) == set(texts)
    padding, total = unpacked(rows, ids_with_end(texts), 2048)
    assert padding == 0
    # Cuts are made at the ends of sequences only, one at each at most.
    pieces = [r for p in rows.values() for r in p]
    assert len(pieces) <= len(rows) + len({r.sequence_id for r in pieces}) and total == sum(r.length for r in pieces)


@pytest.mark.parametrize("text", [
    "a  b", " a", "a ", "\n\n x\ty", "don't we'll 'tis it's", "x y   z　", "\x1c a\x1db", "café 12,5 ½ ²³ ٣٤ 王小明 🙂🙂", "<|endoftext|> a<|endoftext|>", "a\r\nb\x85c d", "_a_ -- ...  \t ", "",
])
def test_chunks_have_the_ids_of_the_whole_text(text):
    assert online_packing.chunks_for(BYTE_BPE).of_text(text) == online_packing.chunks_for(BYTE_BPE).encode(text)


def test_level_is_the_best_by_definition():
    rng = np.random.default_rng(1)
    for _ in range(300):
        packer = online_packing.Packer(16, 10**6)
        packer.level[1:16] = rng.integers(0, 4, 15)
        size = int(rng.integers(1, 17))

        def squares(at, levels=packer.level, size=size):
            after = levels.copy()
            if at:
                after[at] -= 1
            after[at + size] += 1
            return int((after[1:16] ** 2).sum())

        fits = [0, *(h for h in range(1, 16 - size + 1) if packer.level[h])]
        assert squares(packer.best_level(size)) == min(map(squares, fits))


@pytest.mark.parametrize("open_windows", [3, 10**6])
def test_documents_that_never_fit_together(spark, open_windows):
    """Each takes more than half a window, so all windows would stay open."""
    texts = {i: "word " * (39 + i % 7) for i in range(300)}
    packed = online_packing.pack_online(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), BYTE_BPE, length=64, open_windows=open_windows, with_ids=True)
    rows = defaultdict(list)
    for r in packed.collect():
        rows[r.doc_id].append(r)
        assert zlib.crc32(array("i", r.ids).tobytes()) == r.ids_crc32
    assert unpacked(rows, ids_with_end(texts), 64)[0] == 0


def test_online_packing_of_awkward_rows(awkward):
    rows = online_packing.pack_online(awkward, BYTE_BPE, keep=("doc_id", "text", "length", "shard")).collect()
    assert all(r.shard == 2 and r.length <= 2048 for r in rows)  # the column length of the table gives way to the result's
    tokens = {r[1]: len(ids) // 4 for r in AWKWARD for ids in [ids_with_end({0: r[1]})[0]]}
    assert Counter(r.text for r in rows if r.start == 0) == Counter(r[1] for r in AWKWARD)
    assert sum(r.length for r in rows) == sum(tokens[r[1]] for r in AWKWARD)
    assert online_packing.pack_online(awkward.filter("false"), BYTE_BPE).collect() == []


# --- periodic runs ----------------------------------------------------------------------------------


def plain_runs(words, shortest=6, exponent=4):
    found, n = {}, len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(shortest, exponent * q) and j > i:
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((a, n, q) for (a, n), q in found.items())


def agreed_words(i, text):
    words = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    n, h = len(words), zlib.crc32(str(i).encode())
    if i is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]


def plain_row(words):
    found = plain_runs(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    dropped = {k for a, n, q in found for k in range(a + q, a + n)}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        digest("".join(f"{a},{n},{q}\n" for a, n, q in found)), digest(" ".join(w for k, w in enumerate(words) if k not in dropped)),
    )


def row_of(r):
    return (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)


def test_runs_of_the_whole_table(spark, smoke_dir, texts):
    got = {r.doc_id: row_of(r) for r in queries.op13_periodic_runs(spark, smoke_dir).collect()}
    assert set(got) == set(texts) and sum(r[0] > 0 for r in got.values()) > 5
    short = {i: t for i, t in texts.items() if len(t or "") < 20_000}
    assert len(short) > 0.9 * len(texts)
    for i, text in short.items():
        assert got[i] == plain_row(agreed_words(i, text)), i


@pytest.mark.parametrize("longest", [2, 1 << 15])
def test_runs_of_repetitive_words(monkeypatch, longest):
    monkeypatch.setattr(runs, "LONGEST_BLOCK", longest)
    rng = random.Random(longest)
    for _ in range(150):
        docs = []
        for _ in range(rng.randint(1, 4)):
            words, size = [], rng.choice([0, 5, 30, 120, 300])
            while len(words) < size:
                unit = [rng.randint(0, rng.choice([0, 1, 3])) for _ in range(rng.choice([1, 2, 3, 5, 8, 16, 17, 31, 40]))]
                words += (unit * rng.randint(1, 9))[: rng.randint(1, 200)]
            docs.append(words)
        flat, bounds = [], []
        for i, words in enumerate(docs):
            bounds.append((len(flat), len(flat) + len(words)))
            flat += [w + 100 for w in words] + [i]
        want = [(a + low, n, q) for (low, _), words in zip(bounds, docs, strict=True) for a, n, q in plain_runs(words)]
        assert runs.find_in_words(np.array(flat, np.int64), np.array(bounds, np.int64)) == sorted(want)


@pytest.mark.parametrize("size", [1, 2, 8, 64])
def test_convolution_is_exact(size):
    rng = np.random.default_rng(size)
    x = rng.integers(0, 4, 12 * size)
    squares = np.concatenate(([0], np.cumsum(x * x)))
    starts = np.arange(0, 8 * size, size)
    got = runs.squared_differences(x, starts, size, size, squares)
    want = [[((x[b : b + size] - x[b + d : b + d + size]) ** 2).sum() for b in starts] for d in range(size, 2 * size)]
    assert (got == np.array(want) % runs.MODULUS).all()


def test_words_that_differ_by_the_modulus_are_different():
    x = np.array([5 + runs.MODULUS * (i % 2) for i in range(40)] + [0], np.int64)
    assert runs.find_in_words(x, np.array([[0, 40]])) == [(0, 40, 2)]


def test_long_periods():
    for n, period in ((30_000, 1), (150_000, 37_000)):
        x = np.concatenate((np.resize(np.arange(period) + 5, n), [0]))
        assert runs.find_in_words(x, np.array([[0, n]])) == [(0, n, period)]


def test_runs_of_awkward_rows(spark, awkward):
    rows = runs.find_runs(awkward.withColumn("runs", F.lit(3)), keep=("doc_id", "runs", "key")).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in AWKWARD) and rows[0].key == "z"
    by = {r.doc_id: r for r in rows}
    assert (by[1].n_words, by[1].runs, by[1].collapsed) == (0, [], "") == (by[2].n_words, by[2].runs, by[2].collapsed)
    assert by[4].collapsed == LONG and by[4].n_words == 20_000
    texts = spark.createDataFrame([(1, "a b " * 9), (None, "x x\tx\x0bx x\nx y"), (2, "x x " * 3)], "doc_id long, text string")
    assert {r.doc_id: (r.runs, r.collapsed) for r in runs.find_runs(texts).collect()} == {
        1: ([(0, 18, 2)], "a b"), None: ([(0, 6, 1)], "x y"), 2: ([], "x x x x x x"),
    }
    assert runs.find_runs(awkward.filter("false")).collect() == []
    planted = queries.with_planted_runs(awkward).collect()
    assert {r.doc_id: r.text for r in planted if r.doc_id in (1, 2, None)} == {1: None, 2: "", None: AWKWARD[8][1]}
    with pytest.raises(ValueError):
        runs.find_in_words(np.zeros(20, np.int64), np.array([[0, 19]]), exponent=3)


# --- similarity join: what was changed after the first tests --------------------------------------


def linked_as(docs, sets, side, percent=80):
    """Components of all links, by comparing every pair."""
    label = {d: d for d in docs}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if (side is None or side[i] != side[j]) and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(docs[i]), root(docs[j])
                label[max(a, b)] = min(a, b)
    return {d: root(d) for d in docs}


@pytest.mark.parametrize("sided", [False, True])
def test_spanning_links_say_what_all_links_say(sided):
    rng = np.random.default_rng(4)
    for _ in range(60):
        base = [np.unique(rng.integers(0, 2**63, 30).astype(np.uint64)) for _ in range(3)]
        sets = []
        for _ in range(int(rng.integers(2, 25))):
            s = base[rng.integers(0, 3)]
            s = s[rng.random(len(s)) > rng.choice([0, 0.1, 0.3])]
            sets.append(s if len(s) else base[0])
        side = rng.integers(0, 2, len(sets)).tolist() if sided else None
        if sided and len(set(side)) == 1:
            continue
        docs = rng.permutation(100)[: len(sets)].tolist()
        got = jaccard.spanning_links(docs, sets, 80, side)
        assert linked_as(docs, sets, side) == joined(docs, got)


def joined(docs, links):
    nodes, label = components.smallest_reachable(np.array([a for a, _ in links], np.int64), np.array([b for _, b in links], np.int64))
    return {d: d for d in docs} | dict(zip(nodes.tolist(), label.tolist(), strict=True))


def test_shortened_hashes_miss_no_link():
    """Values that become equal when shortened hide a part of an intersection."""
    a = np.sort(np.array([5 << 40, (5 << 40) + 1, 6 << 40, 7 << 40, 8 << 40], np.uint64))
    short = [jaccard._long(jaccard._short(s)) for s in (a, a[:4])]
    assert len(np.unique(short[0])) == 4 and jaccard.spanning_links([1, 2], short, 80) == [(2, 1)] == jaccard.spanning_links([1, 2], [a, a[:4]], 80)


@pytest.mark.parametrize("fail", [False, True])
def test_clusters_are_compared_again_where_a_short_link_fails(spark, monkeypatch, fail):
    """Whether the links of shortened hashes all pass the exact check or some seem to fail, what is connected is the same."""
    if fail:
        exact = jaccard._compared
        monkeypatch.setattr(jaccard, "_compared", lambda *args: exact(*args).filter("a % 3 = 0"))
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 8)
    rng = np.random.default_rng(8)
    rows = []
    for base in range(3):
        first = [f"b{base}x{x}" for x in range(60)]
        for _ in range(12):
            copy = list(first)
            for _ in range(int(rng.integers(0, 4))):
                copy[int(rng.integers(0, 60))] = f"n{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(copy[: int(rng.integers(50, 61))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    sets = {i: len(set(zip(*(w[k:] for k in range(5)), strict=False))) for i, t in rows for w in [t.split()]}
    clusters = spark.createDataFrame([(i, 0, n) for i, n in sets.items()], "doc long, cluster long, n_shingles long")
    links = [(r.a, r.b) for r in jaccard.compare_blocks(docs, clusters, 5, 80).collect()]
    want = {i: c for i, (_, c) in plain_components(dict(rows)).items()}
    assert joined([i for i, _ in rows], links) == want and len(set(want.values())) > 3


def test_keep_first_loses_no_text_of_a_repeated_id(spark):
    text = lambda k: " ".join(f"{k}w{i}" for i in range(30))
    rows = [(1, text("a"), "x"), (2, text("b"), "x"), (2, text("c"), "x"), (3, text("d"), "x"), (3, text("d"), "w"), (4, text("a"), "x"), (4, text("e"), "x"), (None, text("a"), "x"), (0, text("c"), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = Counter((r.doc_id, r.text, r.lang) for r in jaccard.keep_first(docs).collect())
    assert got == Counter([(1, text("a"), "x"), (2, text("b"), "x"), (3, text("d"), "w"), (4, text("e"), "x"), (None, text("a"), "x"), (0, text("c"), "x")])


def test_links_are_thinned_to_stars(spark, monkeypatch):
    monkeypatch.setattr(components, "TOGETHER", 50)
    rng = np.random.default_rng(6)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 120, (400, 2))]
    nodes = sorted({x for p in pairs for x in p})
    got = {r.node: r.component for r in components.components(spark.createDataFrame([*pairs, (None, 3), (4, None)], "a long, b long").repartition(5)).collect()}
    assert {n: n for n in nodes} | got == joined(nodes, pairs)
    assert components.components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).collect() == []


# --- secret scan: the battery and the model of ordinary tokens -------------------------------------


def plain_battery(token, alphabet):
    x = [alphabet.index(c) for c in token.rstrip("=") if c in alphabet]
    n, a = len(x), len(alphabet)
    bins = min(a, max(2, n // 5))
    chi = 0.0
    for b in range(bins):
        due = n * sum(v * bins // a == b for v in range(a)) / a
        chi += (sum(v * bins // a == b for v in x) - due) ** 2 / due
    free, tail = bins - 1, lambda z: math.erfc(z / math.sqrt(2)) / 2
    uniform = tail(((chi / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free)))
    flips = sum((p * 2 >= a) != (q * 2 >= a) for p, q in zip(x, x[1:], strict=False))
    runs_p = 2 * tail(abs(flips - (n - 1) / 2) / math.sqrt((n - 1) / 4))
    mean = (a - 1) / 2
    serial = 2 * tail(abs(sum((p - mean) * (q - mean) for p, q in zip(x, x[1:], strict=False))) / ((a * a - 1) / 12) / math.sqrt(n - 1))
    return uniform, min(1, runs_p), min(1, serial)


def plain_ordinary_cost(token, costs):
    total, before, letter = 0.0, "start", 26
    for c in token:
        if c.isupper():
            kind = "capitals" if before.startswith("capital") else "capital"
        else:
            kind = "small" if c.islower() else "digit" if c.isdigit() else "sign"
        total -= math.log(secrets.STEPS[before][kind])
        if c.isalpha():
            total += costs[26 * (26 if kind == "capital" or letter == 26 else letter) + ord(c.lower()) - 97]
            letter = ord(c.lower()) - 97
        else:
            total += math.log(10 if kind == "digit" else 5)
            letter = 26
        before = kind
    return total


def test_the_model_of_ordinary_tokens_is_one_of_chances():
    """Only then is a likelihood ratio of e**x met with a chance of e**-x at most."""
    assert all(sum(steps.values()) == pytest.approx(1) for steps in secrets.STEPS.values())


def test_battery_and_cost_by_definition(spark):
    rng = random.Random(12)
    tokens = ["".join(rng.choice(secrets.ENCODINGS[name][0]) for _ in range(n)) for name in ("hex", "base64", "base36_upper", "base32") for n in (20, 33, 64)]
    tokens += ["AbsoluteLinkError2", "/etc/apache2/mime-types_x", "deadbeef00000000", "XMLHttpRequest+99/aB=="]
    texts = spark.createDataFrame([("The quick brown fox; jumps OVER the lazy dog. don't",), (None,), ("",), ("the the theory",)], "text string")
    costs = secrets.letter_pairs(texts, "text")
    pairs = Counter()
    for word in ("quick", "brown", "jumps", "over", "lazy", "theory"):
        pairs.update((a, b) for a, b in zip("^" + word, word, strict=False))
    for i, a in enumerate("abcdefghijklmnopqrstuvwxyz^"):
        total = sum(n for (x, _), n in pairs.items() if x == a) + 20 * 26
        for j, b in enumerate("abcdefghijklmnopqrstuvwxyz"):
            assert costs[26 * i + j] == pytest.approx(-math.log((pairs[a, b] + 20) / total))
    df = spark.createDataFrame([(t,) for t in tokens], "token string")
    for r in secrets.battery(df, "token").withColumn("cost", secrets.ordinary_cost("token", costs)).collect():
        assert r.cost == pytest.approx(plain_ordinary_cost(r.token, costs))
        want = plain_battery(r.token, secrets.ENCODINGS[r.encoding][0])
        assert (r.p_uniform, r.p_runs, r.p_serial) == pytest.approx(want, abs=2e-6) and r.p == pytest.approx(min(1, 3 * min(want)), abs=1e-5)


def test_identifiers_and_paths_are_ordinary(spark):
    """Names and paths of the standard library, one per text: under one in a hundred is reported, beside random tokens that are."""
    import pathlib
    import sysconfig

    found = set()
    for path in sorted(pathlib.Path(sysconfig.get_paths()["stdlib"]).glob("*.py"))[:150]:
        found |= set(re.findall(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,60}(?![A-Za-z0-9+/_=-])", path.read_text(errors="ignore")))
    plain = sorted(t for t in found if re.search("[a-z]{3}|[A-Z]{3}", t))
    rng = random.Random(7)
    base62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    planted = ["".join(rng.choice(base62) for _ in range(n)) for n in [20] * 30 + [40] * 30]
    docs = spark.createDataFrame([(i, f"see {t} there") for i, t in enumerate([*plain, *planted])], "doc_id long, text string")
    spotted = {r.doc_id for r in secrets.find_secrets(docs).collect() if any(s.kind == "random" for s in r.spans)}
    wrong = [plain[i] for i in spotted if i < len(plain)]
    assert len(plain) > 1500 and len(wrong) <= 0.01 * len(plain), wrong[:20]
    assert len([i for i in spotted if i >= len(plain)]) >= 0.9 * len(planted)


# --- archive, shards, reputation --------------------------------------------------------------------


def test_records_are_rebuilt_byte_for_byte(spark):
    rows = [(3, "http://a", "<p>é</p>"), (1, "http://b/%0A", "<p>é</p>"), (2, None, None), (4, "http://c\r\nX: y%0D", "\r\n\r\nWARC-Type: revisit\r\n\r\n"), (5, "http://d", "x" * 100_000), (None, "http://e", "<p>é</p>")]
    pages = spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, record string, bytes long")
    path = f"{checkpoint_root(spark)}/archive-rebuilt"
    archive.write_archive(pages, path, date="2020-02-02T02:02:02Z")
    back = archive.rebuild_records(spark, path).collect()
    assert Counter((r.id, r.url) for r in back) == Counter((i, u or "") for i, u, _ in rows)
    bodies = dict((i, (h or "").encode()) for i, _, h in rows)
    for r in back:
        sha1 = base64.b32encode(hashlib.sha1(bodies[r.id]).digest()).decode()
        assert (r.bytes, r.sha1) == (len(bodies[r.id]), sha1)
        want = [f"WARC/1.0\r\nWARC-Type: {r.type}", f"WARC-Record-ID: <urn:page:{'' if r.id is None else r.id}>", "WARC-Date: 2020-02-02T02:02:02Z"]
        want.append("WARC-Target-URI: " + ("http://c%0D%0AX: y%250D\r\nX-Escaped-Target-URI: percent" if r.id == 4 else r.url))
        want += ["Content-Type: text/html", f"WARC-Payload-Digest: sha1:{sha1}"]
        if r.type == "revisit":
            want += [f"WARC-Refers-To: <urn:page:{r.refers_to}>", f"WARC-Profile: {archive.REVISIT_PROFILE}", "Content-Length: 0"]
            assert bytes(r.record) == "\r\n".join(want).encode() + b"\r\n\r\n" + b"\r\n\r\n"
        else:
            want.append(f"Content-Length: {len(bodies[r.id])}")
            assert bytes(r.record) == "\r\n".join(want).encode() + b"\r\n\r\n" + bodies[r.id] + b"\r\n\r\n"
    assert {r.id: r.refers_to for r in back if r.type == "revisit"} == {3: 1, None: 1}
    for damaged in (bytes(back[0].record)[:-1], bytes(back[0].record) + b"x", b"HTTP/1.1\r\n\r\n"):
        with pytest.raises((ValueError, KeyError)):
            archive.parse_record(damaged)
    empty = f"{checkpoint_root(spark)}/archive-empty"
    archive.write_archive(pages.filter("false"), empty)
    assert archive.rebuild_records(spark, empty).collect() == []


def test_strings_are_ranked_whole(spark):
    names = ["source-01", "source-02", "source-02", None, "source-10", "", "source-1"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i long, n string")
    got = {r.i: r.n for r in shards.by_rank(df, "n").collect()}
    held = [n for n in names if n is not None]
    assert got == {i: None if n is None else sum(m < n for m in held) for i, n in enumerate(names)}
    many = spark.range(400).select("id", F.concat(F.lit("source-0"), (F.col("id") % 2).cast("string")).alias("source"))
    placed = shards.hilbert_shards(many, [F.col("source")], F.lit(1), {"source": F.col("source")}, ["source"], 4, bits=2).collect()
    cells = defaultdict(set)
    for r in placed:
        cells[r.source].add(r.curve)
    assert len(placed) == 400 and not cells["source-00"] & cells["source-01"]


def test_suffixes_ports_and_clashing_columns(spark):
    hosts = ["a.co.uk", "www.b.co.uk:8080", "c.example.com.", "localhost:80", "", "co.uk"]
    df = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", *(c.alias(n) for c, n in zip(reputation.domain_and_suffix(F.col("h"), queries.LONG_SUFFIXES), "ds", strict=True)))
    assert {r.h: (r.d, r.s) for r in df.collect()} == {
        "a.co.uk": ("a.co.uk", "co.uk"), "www.b.co.uk:8080": ("b.co.uk", "co.uk"), "c.example.com.": ("example.com", "com"),
        "localhost:80": ("localhost", "localhost"), "": ("", ""), "co.uk": ("co.uk", "co.uk"),
    }
    pages = spark.createDataFrame([(i, f"http://x{i % 3}.{'ab'[i % 2]}.co.uk/p", 1 - i % 2, "h", 9) for i in range(200)] + [(999, None, None, "h", 9)], "page_id long, url string, outcome int, host string, n long")
    rows = {r.page_id: r for r in reputation.judge_urls(pages, "outcome", [], keep=("page_id", "host", "n", "outcome"), long_suffixes=queries.LONG_SUFFIXES).collect()}
    assert rows[0].host == "x0.a.co.uk" and rows[0].rate > 0.9 and rows[1].rate < 0.1 and rows[999].host == ""
    assert reputation.judge_urls(pages.filter("false"), "outcome", []).collect() == []


# --- surrogates -------------------------------------------------------------------------------------


def rewritten(spark, *texts, key="k1"):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in sorted(surrogates.replace_entities(docs, key).collect(), key=lambda r: r.doc_id)]


def shape(text):
    return re.sub("[0-9]", "0", text)


@pytest.mark.parametrize("number", ["+49 30 1234567", "+33 1 23 45 67 89", "+34 912 345 678", "+44 20 7946 0958", "+17435553824", "+1 (743) 555-3824", "743-555-3824", "+49 (30) 901820-12"])
def test_telephone_numbers_of_many_forms(spark, number):
    whole, again = rewritten(spark, f"Call {number}, or write.", f"({number})")
    found = whole.removeprefix("Call ").removesuffix(", or write.")
    assert found != number and shape(found) == shape(number) and again == f"({found})"
    digits, new = (re.sub("[^0-9]", "", n) for n in (number, found))
    kept = 0 if len(digits) <= 10 else 1 if len(digits) == 11 and digits[0] == "1" else 2
    assert new[:kept] == digits[:kept] and new[kept:] != digits[kept:]


def test_other_numbers_stay(spark):
    text = "1 + 2 = 3, 2024-01-02, +5, 12 34, 1000000, version 1.2.3, 3782-822463-10006"
    assert rewritten(spark, text) == [text]


def test_card_numbers_of_other_groupings(spark):
    amex, plain, long = rewritten(spark, "3782-822463-10005", "378282246310005", "6304 0000 0000 0000 000")
    assert re.fullmatch(r"3\d{3}-\d{6}-\d{5}", amex) and amex.replace("-", "") == plain != "378282246310005"
    assert re.fullmatch(r"6\d{3} \d{4} \d{4} \d{4} \d{3}", long)
    for card in (plain, long.replace(" ", "")):
        assert sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(card))) % 10 == 0


@pytest.mark.parametrize(("titled", "untitled", "other"), [
    ("Mr Peter Brown", "Peter Brown", "Dr Brown"), ("Frau Jürgen-Ute Özil".replace("Jürgen-Ute", "Ute"), "Ute Özil", "Prof. Özil"), ("Señora Pilar Núñez", "Pilar Núñez", "Dr Núñez"),
    ("Mme Zoé Lefèvre", "Zoé Lefèvre", "Dr Lefèvre"), ("г-н Пётр Иванов", "Пётр Иванов", "г-н Иванов"),
])
def test_a_person_is_one_over_all_forms(spark, titled, untitled, other):
    first, family = untitled.split()
    text, elsewhere = rewritten(spark, f"{titled} came. {untitled} said so; {first} left, {family}'s hat stayed. {other} knew. {family}er", f"x {other} y")
    title = titled.removesuffix(untitled)
    new = re.match(rf"{title}(\S+) (\S+) came", text)
    assert new and new[1] != first and new[2] != family
    tail = other.removesuffix(family)
    assert text == f"{title}{new[1]} {new[2]} came. {new[1]} {new[2]} said so; {new[1]} left, {new[2]}'s hat stayed. {tail}{new[2]} knew. {family}er"
    assert elsewhere == f"x {tail}{new[2]} y"


def test_gender_of_a_first_name_follows_its_titles(spark):
    one, two, three = rewritten(spark, "Mrs Kim Lee and Dr Kim Lee", "Dr Kim Lee", "Dr Alex Roe")
    first = one.split()[1]
    assert first.split("-")[0] in surrogates.FIRST["person_f", "latin"] and one.split()[5] == first == two.split()[1]
    assert three.split()[1].split("-")[0] in surrogates.FIRST["person_x", "latin"]


def test_han_names(spark):
    one, two = rewritten(spark, "我见到王小明先生和李芳女士。", "王小明先生")
    new = re.fullmatch("我见到(.{3})先生和(.{2})女士。", one)
    assert new and new[1] != "王小明" and new[2] != "李芳" and two == f"{new[1]}先生"
    assert new[1][1] in surrogates.GIVEN["han_m"] and new[2][1] in surrogates.GIVEN["han_f"]


def test_surrogates_of_the_whole_table(spark, smoke_dir, texts):
    """Entities against the same patterns in another engine; text around them stays, and surrogates keep entities apart and together."""
    import regex

    def luhn(digits):
        return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0

    def plain(text):
        def disjoint(found):
            out, at = [], 0
            for a, b, kind in sorted((a, -b, kind) for a, b, kind in found):
                if a >= at:
                    out.append((kind, a, -b))
                    at = -b
            return out

        found = []
        for kind, (_, pattern) in surrogates.PATTERNS.items():
            for m in regex.finditer(pattern.replace(r"\p{IsHan}", r"\p{Han}"), text):
                digits = re.sub("[^0-9]", "", m[0])
                if (kind != "card" or luhn(digits)) and (kind != "phone_i" or 8 <= len(digits) <= 15):
                    found.append((m.start(), m.end(), kind.removesuffix("_i")))
        found = disjoint(found)
        names = {text[a:b] for kind, a, b in found if kind.startswith("person")}
        if not names:
            return found
        tokens = sorted(names | {t for n in names for t in n.split(" ")}, key=lambda t: (-len(t), t))
        again = [(m.start(), m.end(), "person_y") for m in regex.finditer(rf"(?<!\p{{L}})(?:{'|'.join(tokens)})(?!\p{{L}})", text)]
        return disjoint([(a, b, kind) for kind, a, b in found] + again)

    rows = surrogates.replace_entities(spark.read.parquet(f"{smoke_dir}/documents.parquet"), "k").collect()
    assert Counter(r.doc_id for r in rows) == Counter(list(texts))
    put = defaultdict(set)
    for r in rows:
        text = texts[r.doc_id] or ""
        assert [(e.kind, e.start, e.end) for e in r.entities] == plain(text), r.doc_id
        pieces, at = [], 0
        for e in r.entities:
            assert e.value == text[e.start : e.end]
            pieces.append(re.escape(text[at : e.start]))
            at = e.end
        around = re.fullmatch("(.+?)".join([*pieces, re.escape(text[at:])]), r.text or "", re.DOTALL)
        assert around, r.doc_id
        for e, new in zip(r.entities, around.groups(), strict=True):
            if e.kind in ("email", "ip", "card"):
                put[e.kind, e.canon].add(re.sub("[ -]", "", new))
    assert len(put) > 10 and all(len(v) == 1 for v in put.values()) and len({(k, *v) for (k, _), v in put.items()}) == len(put)


def test_windows_are_dealt_out_whatever_items_they_come_from(spark):
    """One repeated id holds all windows, as null ids and other items do; all groups together find what one automaton finds."""
    text = " ".join(f"w{i}" for i in range(300))
    items = spark.createDataFrame([(7, text), (7, text), (None, text), (8, " ".join(text.split()[40:60])), (9, "W299 w0")], "item_id long, text string")
    table = {bytes(r.window): sorted(r["items"]) for r in decontaminate.window_table(items.selectExpr("item_id AS item", "text AS words"), 10).collect()}
    assert len(table) == 292 and table[b"w299 w0"] == [9] and table[b"w40 w41 w42 w43 w44 w45 w46 w47 w48 w49"] == [7, 8]
    docs = spark.createDataFrame([(1, f"x {' '.join(text.split()[35:55])} y w299, W0!"), (2, None)], "doc_id long, text string")
    one, many = (sorted((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), str(r.spans)) for r in decontaminate.find_leaks(docs, items, automaton_bytes=n).collect()) for n in (4 << 20, 3000))
    assert one == many and one[0][:4] == (1, 24, 22, (7, 8, 9))
    assert [r.n_hit for r in decontaminate.find_leaks(docs, items.filter("false")).collect()] == [0, 0]


def test_a_word_with_its_marks_is_remembered():
    chunks = online_packing.ChunkIds(BYTE_BPE)
    ids = chunks.of_text("Many words, many words,")
    assert " words," in chunks and chunks.of_text("Many words, many words,") == ids == chunks.encode("Many words, many words,")
