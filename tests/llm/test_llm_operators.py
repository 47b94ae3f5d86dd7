"""Every operator against a plain version on whole small tables, and on awkward input."""

import base64
import hashlib
import random
import re
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseflow.llm import archive, components, decontaminate, jaccard, packing, quality, queries, repeats, reputation, secrets, shards, surrogates
from caseflow.session import checkpoint_root

BLANK = re.compile(r"[\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = "n_words long, spans string, items string, key string, component_id long, shard int, length int, votes string, text_hash string, hash long"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(20_000))
AWKWARD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, LONG, "en", "a", len(LONG)), (5, "one", None, "b", 3),
    (6, "same words in all of these rows here", "en", "b", 36), (7, "same words in all of these rows here", "en", "b", 36),
    (7, "same words in all of these rows here", "en", "b", 36), (None, "same words in all of these rows here", "en", None, 36),
    (8, "a" * 5000, "xx", "c", 5000), (9, "é" * 300 + " ☃ 𝄞", "fr", "c", 304),
]


def words(text):
    return [w for w in BLANK.split(text or "") if w]


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


@pytest.fixture(scope="module")
def docs(spark, smoke_dir):
    return spark.read.parquet(f"{smoke_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(*row, 7, "x", "y", "z", 1, 2, 3, "v", "h", 5) for row in AWKWARD]
    return spark.createDataFrame(rows, f"{DOCS}, {CLASHES}")


def as_dict(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# --- plain versions -----------------------------------------------------------------------------


def plain_quality(text):
    w = words(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = set()
    for i in range(len(w) - 4):
        if windows[tuple(w[i : i + 5])] > 1:
            hit.update(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_secrets(text):
    text = text or ""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found, key=lambda x: (x[1], secrets.KINDS.index(x[0])))


def plain_leaks(texts, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for item, text in items:
        w = word.findall(lower(text))
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(item)
    sizes = {len(w) for w in windows}
    out = {}
    for doc, text in texts.items():
        w = word.findall(lower(text))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out[doc] = (len(w), len(hit), sorted(x for x in found if x is not None))
    return out


def plain_shingles(text):
    w = words(lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def plain_components(texts):
    sets = {i: plain_shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= 80 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in sets}


def plain_repeats(rows, length):
    raw = [(t or "").encode() for t in rows]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


# --- the queries over the whole small tables -----------------------------------------------------


def test_quality_measures_and_verdicts(spark, smoke_dir, texts):
    rows = as_dict(queries.op1_quality_rules(spark, smoke_dir))
    assert set(rows) == set(texts)
    for i, r in rows.items():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_quality(texts[i])
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_label_model_agrees_with_labels(spark, smoke_dir):
    kept = as_dict(queries.op1_quality_rules(spark, "/root/testdata/sf0.01"))
    labels = as_dict(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    pairs = [(kept[i].kept or kept[i].base_failed and kept[i].n_words < 10, r.quality) for i, r in labels.items()]
    good = [k for k, q in pairs if q == 1]
    bad = [k for k, q in pairs if q == 0]
    assert sum(good) / len(good) > 0.97
    assert sum(bad) / len(bad) < 0.1


def test_label_model_recovers_planted_accuracies(spark):
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(4000):
        good = rng.random() < 0.8
        votes = [int(rng.choice([0, 1 if rng.random() < a else -1], p=[0.2, 0.8])) if good else int(rng.choice([0, -1 if rng.random() < b else 1], p=[0.2, 0.8])) for a, b in ((0.98, 0.6), (0.95, 0.7), (0.99, 0.5), (0.97, 0.8))]
        rows.append((votes,))
    patterns = spark.createDataFrame(rows, "votes array<int>").groupBy("votes").count().withColumnRenamed("count", "n")
    model = quality.fit_label_model(patterns, 4).first().model
    assert abs(model.prior - 0.8) < 0.05
    assert abs(model.good[0] - 0.98) < 0.03 and abs(model.bad[3] - 0.8) < 0.08


def test_secret_base_spans(spark, smoke_dir, texts):
    rows = as_dict(queries.op3_secret_scan(spark, smoke_dir))
    for i, r in rows.items():
        found = plain_secrets(texts[i])
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(listed.split(",")) - {""} <= set(r.spans.split(","))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x[0] for x in found) for k in secrets.KINDS[:3])


def test_random_tokens_found_and_ordinary_ones_left(spark):
    rng = np.random.default_rng(3)
    alphabet = secrets.ENCODINGS["base64"][0]
    random = ["".join(rng.choice(list(alphabet), 48)) for _ in range(60)]
    random = [t for t in random if re.search("[0-9]", t)]
    plain = [f"section{'abcd'[i % 4]}{'Aa' * 12}{'eaea' * 5}{i}" for i in range(60)]
    rows = [(i, f"é see {t} there") for i, t in enumerate(random + plain)]
    found = as_dict(secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")))
    hits = [any(s.kind == "random" for s in found[i].spans) for i in range(len(rows))]
    assert sum(hits[: len(random)]) >= 0.85 * len(random)
    assert not any(hits[len(random) :])
    first = next(s for i in range(len(random)) for s in found[i].spans)
    assert first.start == 6 and first.end == 54


def test_random_tokens_of_every_shape(spark):
    rng = np.random.default_rng(8)
    draw = lambda characters, n: "".join(rng.choice(list(characters), n))
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    shapes = {
        "name=value": lambda: ("AWS_SECRET_ACCESS_KEY=", draw(upper + lower + digits, 40), ""),
        "parameter": lambda: ("https://h.example.org/?sig=", draw(upper + lower + digits, 28), "&x=1"),
        "padded": lambda: ("x ", draw(upper + lower + digits, 42) + "==", " y"),
        "upper": lambda: ("x ", draw(upper + digits, 27) + "0189A", " y"),
        "short": lambda: ("x ", draw(upper + lower + digits, 18), " y"),
        "no digit": lambda: ("x ", draw(upper + lower, 24), " y"),
        "parts": lambda: ("x ", draw(lower + digits, 12) + "-" + draw(lower + digits, 12), " y"),
        "partly covered": lambda: ("x ", draw(upper + lower, 12) + "Z" + draw("0123456789abcdef", 16) + "Z" + draw(upper + lower, 12), " y"),
    }
    rows, due = [], []
    for shape, make in shapes.items():
        for _ in range(30):
            before, token, after = make()
            due.append((shape, len(before), len(before) + len(token)))
            rows.append((len(rows), before + token + after))
    plain = ["internationalisation", "Donaudampfschifffahrtsgesellschaft", "Nord-Ostsee-Kanal-Verwaltung", "1234567890123456789012", "a" * 40]
    rows += [(len(rows) + i, t) for i, t in enumerate(plain)]
    found = as_dict(secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")))
    hits = Counter(shape for i, (shape, a, b) in enumerate(due) if any((s.kind, s.start, s.end) == ("random", a, b) for s in found[i].spans))
    assert all(hits[shape] >= 25 for shape in shapes), hits
    assert not any(s.kind == "random" for i in range(len(due), len(rows)) for s in found[i].spans)


def test_leaks(spark, smoke_dir, texts):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{smoke_dir}/benchmark.parquet").collect()]
    want = plain_leaks(texts, items)
    rows = as_dict(queries.op5_decontaminate(spark, smoke_dir))
    assert any(v[1] for v in want.values())
    for i, (n, hit, found) in want.items():
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        assert (rows[i].n_words, rows[i].n_hit, rows[i].n_items, rows[i].items_sha256, rows[i].contaminated) == (n, hit, len(found), digest, hit > 0)


def test_leaks_with_a_benchmark_cut_into_groups(spark):
    items = [(i, f"item number {i} has exactly these eleven words in it Ä {i}") for i in range(40)] + [(99, "tiny"), (None, "nameless one"), (98, None), (97, "..")]
    rows = [(1, "so: ITEM number 7 has-exactly these\neleven words, in it ä 7 and tiny Nameless one"), (2, None), (3, ""), (4, "nothing here")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole, cut = (as_dict(decontaminate.find_leaks(docs, bench, automaton_bytes=n)) for n in (1 << 20, 300))
    assert whole == cut
    want = plain_leaks(dict(rows), items)
    assert {i: (r.n_words, r.n_hit, r["items"]) for i, r in whole.items()} == want
    (a, b), last = whole[1].spans[0], whole[1].spans[-1]
    assert rows[0][1][a:b].startswith("number 7") or rows[0][1][a:b].startswith("ITEM number 7")
    assert rows[0][1][last[0] : last[1]].endswith("Nameless one")


def test_jaccard_components(spark, smoke_dir, texts):
    rows = as_dict(queries.op6_jaccard_join(spark, smoke_dir))
    assert {i: (r.n_shingles, r.component_id) for i, r in rows.items()} == plain_components(texts)


@pytest.mark.parametrize("paired", [jaccard.PAIRED, 1])
def test_jaccard_on_near_copies(spark, monkeypatch, paired):
    """Many texts around the limit, of all sizes: chains, small sets, and groups that meet in blocks."""
    monkeypatch.setattr(jaccard, "PAIRED", paired)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 16)
    rng = np.random.default_rng(11)
    rows = []
    for size in (1, 3, 5, 6, 8, 12, 25, 60, 200):
        base = [f"w{x}" for x in rng.integers(0, 10_000, size)]
        for _ in range(14):
            copy = list(base)
            for _ in range(int(rng.integers(0, max(1, size // 22) + 1))):
                copy[int(rng.integers(0, len(copy)))] = f"n{rng.integers(0, 10**6)}"
            if rng.random() < 0.3:
                copy = copy[: max(1, int(len(copy) * rng.uniform(0.75, 1)))]
            rows.append((len(rows) * 3 % 1009, " ".join(copy)))
    found = as_dict(jaccard.similar_components(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: (r.n_shingles, r.component_id) for i, r in found.items()} == plain_components(dict(rows))


def test_signatures_meet_for_every_similar_pair():
    scheme, rng = jaccard.Scheme(80), np.random.default_rng(2)
    for _ in range(400):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = a.copy()
        while len(b) > 1 and rng.random() < 0.97:
            c = b[rng.random(len(b)) > 0.02]
            c = np.unique(np.concatenate((c, rng.integers(0, 2**63, int(rng.integers(0, 1 + len(a) // 40 + 1))).astype(np.uint64))))
            if len(np.intersect1d(a, c)) * 100 < 80 * len(np.union1d(a, c)):
                break
            b = c
        owner, sig = jaccard.signatures([a, b], scheme)
        assert set(sig[owner == 0]) & set(sig[owner == 1])


def test_components_of_long_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 4000)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(301))
    assert all(got[1000 + i] == 1000 for i in range(200))
    assert got[5000] == 4000


@pytest.mark.parametrize("block", [50_000, 3])
def test_repeats(spark, docs, texts, block):
    rows = as_dict(repeats.find_repeats(docs, block=block))
    want = dict(zip(texts, plain_repeats(list(texts.values()), 200), strict=True))
    assert sum(v[1] for v in want.values()) > 0
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in rows.items()} == want


def test_packing_ids_places_and_number_of_sequences(spark, smoke_dir, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    rows = queries.op8_best_fit_packing(spark, smoke_dir).collect()
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    total = 0
    for i, text in texts.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        assert sorted(got[i]) == [(k, a, len(ids[a : a + 4096]), zlib.crc32(array("I", ids[a : a + 4096]).tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= -(-total // 4096) + 2


def test_words_are_tokenised_as_texts():
    known = packing.WordIds(queries.tokenizer_path(), most=50)
    rng = np.random.default_rng(1)
    letters = [chr(c) for c in [*range(1, 0x180), 0x300, 0x301, 0x3A3, 0x212A, 0x2028, 0x3000, 0x4E2D, 0x1F600]]
    for _ in range(2000):
        text = "".join(rng.choice(letters, int(rng.integers(0, 14)))) + str(rng.choice(["", " it's", " Wörter,", " <|endoftext|>x", " a...b"]))
        assert np.frombuffer(known.of_text(text), "<u4").tolist() == known.tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_plan_places_everything_and_is_tight():
    rng = np.random.default_rng(4)
    for _ in range(20):
        counts = np.zeros(101, np.int64)
        np.add.at(counts, rng.integers(1, 101, 300), 1)
        counts[7] += 10**9
        plan = packing.plan(counts, 100)
        placed = np.zeros(101, np.int64)
        for pattern, times in plan:
            assert sum(pattern) <= 100
            for size in pattern:
                placed[size] += times
        assert (placed == counts).all()
        assert sum(t for _, t in plan) <= -(-int((counts * np.arange(101)).sum()) // 100) * 1.03
        assert len(plan) < 1000


def test_host_rules_and_parts(spark):
    rows = [
        (1, "https://Blog.Example.ORG/es/1?x#y"), (2, "http://example.org/en/12"), (3, "http://a.com/fr/"), (4, "http://com/de/x"), (5, "http://xcom/de/x"),
        (6, None), (7, "no scheme"), (8, "http://h.org"), (9, "http://h.org?q=/a"), (10, "x://y://z/p#f"), (11, "http://notexample.org/es/"), (12, "://"),
    ]
    pages = spark.createDataFrame([(*r, None) for r in rows], "page_id long, url string, outcome int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in reputation.judge_urls(pages, "outcome", queries.URL_RULES).collect()}
    assert got[1] == ("blog.example.org", "/es/1", "example.org/es/", "block")
    assert got[2] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[3] == ("a.com", "/fr/", "com/fr/", "allow") and got[4] == ("com", "/de/x", "com/de/", "block")
    assert got[5][2] is None and got[6][:3] == ("", "", None) and got[7][:3] == ("", "", None)
    assert got[8][:3] == ("h.org", "", None) and got[9][:2] == ("h.org", "") and got[10][:2] == ("y:", "//z/p")
    assert got[11][2] == "org/" and got[12][:2] == ("", "")


def test_reputation_shrinks_and_blocks_only_on_evidence(spark):
    rows = [(f"http://bad.evil{i}.test/", 1) for i in range(4) for _ in range(50)] + [("http://once.fine.net/", 1)] + [("http://big.fine.net/", k % 20 == 0) for k in range(400)]
    rows += [(f"http://h{i}.fine.net/", 0) for i in range(30)] + [("http://unseen.new.net/", None)]
    pages = spark.createDataFrame([(i, u, None if o is None else int(o)) for i, (u, o) in enumerate(rows)], "page_id long, url string, outcome int")
    got = {r.host: r for r in reputation.judge_urls(pages, "outcome", []).collect()}
    assert got["bad.evil0.test"].verdict == "block"
    assert got["once.fine.net"].verdict == "allow" and 0.05 < got["once.fine.net"].rate < 0.9
    assert got["unseen.new.net"].verdict == "allow" and got["unseen.new.net"].n == 0


def test_archive_round_trip(spark):
    rows = [(3, "http://a", "<p>é</p>"), (1, "http://b", "<p>é</p>"), (2, None, None), (4, "http://c\r\nX: y", ""), (5, "http://d", "x" * 100_000), (5, "http://d", "x" * 100_000), (None, "http://e", "<p>é</p>"), (None, "http://f", "only nameless")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = f"{checkpoint_root(spark)}/archive-test"
    archive.write_archive(pages, path)
    back = archive.read_archive(spark, path, with_payload=True).collect()
    assert Counter((r.id, bytes(r.body)) for r in back) == Counter((i, (h or "").encode()) for i, _, h in rows)
    for r in back:
        assert r.bytes == len(r.body) and r.sha1 == base64.b32encode(hashlib.sha1(r.body).digest()).decode()
        assert r.header.startswith("WARC/1.0\r\nWARC-Type: ") and r.header.endswith("\r\n\r\n") and "\r\nX: y" not in r.header
    kinds = {(r.id, r.type, r.refers_to) for r in back}
    assert {(1, "response", None), (3, "revisit", 1), (None, "revisit", 1), (2, "response", None), (4, "revisit", 2), (5, "response", None), (None, "response", None)} == kinds
    assert spark.read.parquet(f"{path}/payloads").count() == 4


def test_archive_detects_damage(spark):
    path = f"{checkpoint_root(spark)}/archive-damage"
    archive.write_archive(spark.createDataFrame([(1, "u", "body")], "page_id long, url string, html string"), path)
    broken = spark.read.parquet(f"{path}/payloads").withColumn("body", F.lit(b"other")).collect()
    spark.createDataFrame(broken, "sha256 string, body binary").write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="doesn't match"):
        archive.read_archive(spark, path).collect()


def test_warc_query(spark, smoke_dir):
    pages = as_dict(spark.read.parquet(f"{smoke_dir}/pages.parquet"), "page_id")
    rows = as_dict(queries.op9_warc_archive(spark, smoke_dir), "page_id")
    first = {}
    for i in sorted(pages):
        first.setdefault(pages[i].html or "", i)
    for i, p in pages.items():
        raw, owner = (p.html or "").encode(), first[p.html or ""]
        want = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if owner == i else "revisit", None if owner == i else owner)
        assert tuple(rows[i][c] for c in ("payload_bytes", "payload_digest", "record_type", "refers_to")) == want


def test_shards(spark, smoke_dir, texts):
    rows = queries.op10_hilbert_shards(spark, smoke_dir).collect()
    assert {r.doc_id for r in rows} == set(texts)
    by = defaultdict(list)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        by[r.shard].append(r)
    total, largest = sum(r.size for r in rows), max(r.size for r in rows)
    for shard, members in by.items():
        assert 0 <= shard < 40
        assert sorted(r.slot for r in members) == list(range(len(members)))
        assert abs(sum(r.size for r in members) - total / 40) <= largest
    ordered = [[r.curve for r in by[s]] for s in sorted(by)]
    assert all(max(a) <= min(b) for a, b in zip(ordered, ordered[1:], strict=False))


def test_hilbert_neighbours():
    for dims, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        index = shards.hilbert_index([grid[:, i] for i in range(dims)], bits)
        assert sorted(index) == list(range(len(grid)))
        path = grid[np.argsort(index)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_surrogates(spark):
    rows = [
        (1, "Mail Jo.Doe99@Corp.example.com or jo.doe99@corp.EXAMPLE.com, call +1 (743) 555-3824 or +1 743-555-3824."),
        (2, "Card 4111 1111 1111 1111 and 4111111111111111, not 4111111111111112. From 10.20.30.40, not 300.1.1.1 or 1.2.3.4.5"),
        (3, "Mr Peter Brown met Mrs Anna Brown, then Mr Peter Brown and г-жа Мария Петрова."), (4, None), (5, ""),
        (6, "jo.doe99@corp.example.com again"), (7, "nothing personal"), (7, "nothing personal"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in surrogates.replace_entities(docs, "k1").collect()}
    one = re.fullmatch(r"Mail (\S+@\S+) or (\S+@\S+), call \+1 \((\d{3})\) (\d{3})-(\d{4}) or \+1 (\d{3})-(\d{3})-(\d{4})\.", got[1].text)
    assert one and one[1] == one[2] and one.groups()[2:5] == one.groups()[5:8] and "743" not in one[3]
    assert got[6].text == f"{one[1]} again" and re.fullmatch(r"[a-z]{2}\.[a-z]{3}\d\d@m[0-9a-f]{8}\.example\.com", one[1])
    two = re.fullmatch(r"Card (\d{4}) (\d{4}) (\d{4}) (\d{4}) and (\d{16}), not 4111111111111112\. From (\d+(?:\.\d+){3}), not 300\.1\.1\.1 or 1\.2\.3\.4\.5", got[2].text)
    assert two and "".join(two.groups()[:4]) == two[5] != "4111111111111111" and two[6] != "10.20.30.40"
    digits = [int(c) for c in reversed(two[5])]
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    three = re.fullmatch(r"Mr (\w+ \w+) met Mrs (\w+ \w+), then Mr (\w+ \w+) and г-жа ([А-я]+ [А-я]+)\.", got[3].text)
    assert three and three[1] == three[3] != "Peter Brown" and three[1].split()[0] in surrogates.FIRST["person_m", "latin"]
    assert three[2].split()[0] in surrogates.FIRST["person_f", "latin"] and three[4].split()[0] in surrogates.FIRST["person_f", "cyrillic"]
    assert got[4].text is None and got[5].text == "" and got[7].text == "nothing personal"
    other = {r.doc_id: r.text for r in surrogates.replace_entities(docs, "k2").collect()}
    assert other[2] != got[2].text


def test_surrogates_stay_distinct(spark):
    """One-letter mail names and short family names run out; redrawing keeps all of them apart."""
    kinds = [("email", f"{a}@x.example.com") for a in "abcdefghijklmnopqrstuvwxyz0123456789"] + [("ip", f"10.0.{i // 250}.{i % 250}") for i in range(800)]
    kinds += [("person_m", f"N{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(600)]
    known = spark.createDataFrame(kinds, "kind string, canon string")
    rows = surrogates.surrogate_map(known, "k").collect()
    assert len(rows) == len(kinds) and len({(r.kind, r.surrogate) for r in rows}) == len(kinds)
    assert not {r.surrogate for r in rows} & {c for _, c in kinds}


# --- awkward input ---------------------------------------------------------------------------------

OPERATORS = {
    "quality": lambda d: quality.judge_quality(d),
    "keep_good": lambda d: quality.keep_good(d),
    "surrogates": lambda d: surrogates.replace_entities(d, "k"),
    "secrets": lambda d: secrets.find_secrets(d),
    "leaks": lambda d: decontaminate.find_leaks(d, d.select(F.col("doc_id").alias("item_id"), F.lit("one").alias("text")).limit(1)),
    "jaccard": lambda d: jaccard.similar_components(d),
    "keep_first": lambda d: jaccard.keep_first(d),
    "repeats": lambda d: repeats.find_repeats(d),
    "packing": lambda d: packing.pack(d, queries.tokenizer_path()),
    "shards": lambda d: shards.hilbert_shards(
        d, [F.col("n_chars"), F.col("lang")], F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16, {"doc_id": F.col("doc_id")}, ["doc_id"], 5
    ),
    "reputation": lambda d: reputation.judge_urls(d.withColumns({"url": F.concat(F.lit("http://"), "text"), "outcome": F.lit(None).cast("int")}), "outcome", queries.URL_RULES, keep=("doc_id",)),
}


@pytest.mark.parametrize("block", [50_000, 5])
def test_repeats_of_an_anchor_that_is_often_in_one_run_of_texts(spark, block):
    drawn = random.Random(3)
    noise = lambda n: "".join(drawn.choice("abcdefghij klmno") for _ in range(n))
    passage = noise(230)
    rows = [(i, noise(drawn.randint(0, 300)) + passage + noise(drawn.randint(0, 300))) for i in range(20)]
    found = as_dict(repeats.find_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), block=block))
    for (i, _), want in zip(rows, plain_repeats([t for _, t in rows], 200), strict=True):
        assert (found[i].n_bytes, found[i].n_removed, found[i].n_spans, found[i].kept_sha256) == want[:4]


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, awkward, name):
    assert OPERATORS[name](awkward.filter("false")).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(awkward, name):
    rows = OPERATORS[name](awkward).collect()
    ids = Counter(r.doc_id for r in rows)
    if name == "keep_good":
        assert ids == Counter([4])
    elif name == "keep_first":
        assert ids == Counter([1, 2, 3, 4, 5, 6, None, 8, 9])
    elif name == "packing":
        assert set(ids) == {r[0] for r in AWKWARD} and sum(r.length for r in rows if r.doc_id == 1) == 1
    else:
        assert ids == Counter(r[0] for r in AWKWARD)
    if name == "jaccard":
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
        assert got[None][1] is None and got[7] == (4, 6) and got[2] == (0, 2) and got[1] == (0, 1) and got[5] == (1, 5)
    if name == "repeats":
        want = plain_repeats([r[1] for r in AWKWARD], 200)
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == Counter((a[0], *w) for a, w in zip(AWKWARD, want, strict=True))
    if name == "quality":
        assert all((r.n_words, r.n_repeat_words) == (plain_quality(t)[0], plain_quality(t)[4]) for r in rows for t in [next(x[1] for x in AWKWARD if x[0] == r.doc_id)])


@pytest.mark.parametrize(("copies", "sent"), [(2, None), (9, None), (9, 0)])
def test_jaccard_copies_do_not_sign(spark, monkeypatch, copies, sent):
    """Of equal sets one document makes signatures, however many copies a text has and wherever they are read."""
    if sent is not None:
        monkeypatch.setattr(jaccard, "SENT_BYTES", sent)
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(20)]
    near = [f"{t} w{i}" for i, t in enumerate(texts[:5])]
    rows = [(100 * c + i, t) for c in range(copies) for i, t in enumerate(texts + near)]
    # Two texts under one id, one of them first of its set; a row without an id and one without words.
    rows += [(5000, texts[7]), (5000, "only here five words long"), (None, texts[8]), (5001, " ")]
    signed, sign = [], jaccard.sign

    def recorded(docs, *args):
        signed.extend(r.doc_id for r in docs.select("doc_id").collect())
        return sign(docs, *args)

    monkeypatch.setattr(jaccard, "sign", recorded)
    found = {(r.doc_id, r.component_id) for r in jaccard.similar_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    assert set(signed) - {5001} == {*range(25), 5000}
    own = {i: i if i < 20 else i - 20 for i in range(25)}
    expected = {(100 * c + i, own[i]) for c in range(copies) for i in range(25)} | {(5000, 7), (None, None), (5001, 5001)}
    assert found == expected
