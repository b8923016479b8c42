"""Ranked search, periodic runs and the token automaton against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from ledgerframe.llm import automaton, periods, search
from ledgerframe.llm.automaton import Codec, TokenAutomaton, encode_decode
from ledgerframe.llm.tokens import default_tokenizer

SCHEMA = "doc_id long, text string, doc string, n long, at string, counts string, query string, rank int, score string, ids string"


def with_more(spark, rows):
    """Rows of (doc_id, text) with columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, "d", 1, "a", "c", "q", 2, "s", "i") for r in rows], SCHEMA)


# Ranked search


def plain_terms(text):
    out, word = [], ""
    for ch in (text or "") + " ":
        if ch.isascii() and not ch.isalnum():
            out += [word] if word else []
            word = ""
        else:
            word += ch.lower() if ch.isascii() else ch
    return out


def plain_search(docs, items, top=10):
    counts = [(i, Counter(plain_terms(t))) for i, t in docs]
    total, held = sum(sum(c.values()) for _, c in counts), sum(1 for _, c in counts if c)
    frequency = Counter(t for _, c in counts for t in c)
    out = Counter()
    for item, text in items:
        scored = []
        for i, c in counts:
            if c:
                mark = 100 - 75 + (75 * sum(c.values()) * held) // total
                score = sum(math.floor(1000 * math.log((2 * held + 2) / (2 * frequency[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * mark)) for t in plain_terms(text) if c[t])
                if score > 0:
                    scored.append((-score, i is None, i))
        out.update((item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1))
    return out


def corpus(rng, n):
    vocabulary = ["w%d" % i for i in range(60)] + ["É", "中文", "X9"]
    topics = [rng.sample(vocabulary, 12) for _ in range(4)]
    rows = [(i, rng.choice([" ", "\n", ", ", "-"]).join(rng.choices(rng.choice(topics), k=rng.randint(0, 40)))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "!!"), (None, rows[0][1]), (None, None), (3, rows[3][1]), (2**62 + 1, "W1 w1 W1 x9 " * 400), *((n + 10 + i, rows[1][1]) for i in range(15))]


@pytest.mark.parametrize("settings", [{}, {"BATCH": 8, "LEAF_DOCS": 2, "LEAF_QUERIES": 2, "FAN": 2, "SEEDS": 16}, {"FAN": 3, "LEAF_QUERIES": 1, "SEEDS": 1}])
def test_ranked_search_equals_scores_of_all_pairs(spark, monkeypatch, settings):
    for k, v in settings.items():
        monkeypatch.setattr(search, k, v)
    rng = random.Random(len(settings))
    rows = corpus(rng, 150)
    items = [(i, " ".join(rng.choices(rows[rng.randrange(150)][1].split() or ["none"], k=rng.randint(1, 12)))) for i in range(25)]
    items += [(90, None), (91, "?"), (92, "unknown words"), (5, items[5][1]), (6, "w1 w1 w2"), (None, "w3 É")]
    docs = with_more(spark, rows)
    asked = spark.createDataFrame([(*r, 1, 2) for r in items], "item_id long, text string, doc_id int, rank int")
    for size in (search.BLOCK_BYTES, 300):
        got = Counter(tuple(r) for r in search.ranked_search(docs, asked, block_bytes=size).select("item_id", "rank", "doc_id", "score").collect())
        assert got == plain_search(rows, items)
    few = Counter(tuple(r) for r in search.ranked_search(docs, asked, top=3).collect())
    assert few == plain_search(rows, items, 3)


def test_ranked_search_without_rows(spark):
    docs, items = with_more(spark, [(1, "a b")]), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert [tuple(r)[:3] for r in search.ranked_search(docs, items).collect()] == [(1, 1, 1)]
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0)), (with_more(spark, [(1, None), (2, "-")]), items)):
        found = search.ranked_search(d, i)
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() == 0


def test_both_trees_prune():
    """Topics that share no terms: what a query scores is little more than its own topic's documents."""
    rng = random.Random(4)
    topics = [["t%dx%d" % (k, i) for i in range(30)] for k in range(16)]
    queries = search.Queries([(i, " ".join(rng.sample(topics[i % 16], 6))) for i in range(160)])
    counted = [Counter(t.encode() for t in rng.choices(topics[i % 16], k=30)) for i in range(3200)]
    frequency = Counter(queries.vocabulary[t] for c in counted for t in c if t in queries.vocabulary)
    docs = []
    for c in counted:
        held = sorted((queries.vocabulary[t], n) for t, n in c.items() if t in queries.vocabulary)
        docs.append((np.array([k for k, _ in held], dtype=np.int64), search.shares(np.array([n for _, n in held], dtype=np.int64), 100)))
    queries.weigh(len(docs), frequency)
    seen = Counter()
    best = search.search(queries, docs, seen=seen)
    assert seen["scores"] < 160 * 3200 // 8 and seen["node pairs"] < 160 * 3200 // 100
    vectors = [dict(zip(c.tolist(), (n * queries.weights[c]).tolist())) for c, n in queries.counts]
    for q in range(160):
        scores = sorted((sum(v * vectors[q].get(k, 0) for k, v in zip(c.tolist(), x.tolist())) for c, x in docs), reverse=True)[:10]
        assert sorted((s for s, _ in best[q]), reverse=True)[:10] == scores


# Periodic runs


def plain_runs(words, least=6, power=4):
    n, out = len(words), []
    for p in range(1, n // power + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            size = j + p - i
            if j > i and size >= max(least, power * p) and not any(all(words[x] == words[x + q] for x in range(i, i + size - q)) for q in range(1, p)):
                out.append((i, size, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words(rng):
    n, k = rng.randint(1, 70), rng.randint(1, 5)
    words = [rng.randint(1, k) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        a, p = rng.randrange(n), rng.randint(1, 7)
        for i in range(a + p, min(n, a + p * rng.randint(2, 6) + rng.randint(0, 2))):
            words[i] = words[i - p]
    return words


@pytest.mark.parametrize("seed", range(4))
def test_lyndon_lengths_and_runs_equal_plain_ones(seed):
    rng = random.Random(seed)
    texts = [some_words(rng) for _ in range(300)]
    for words in texts:
        known, named = np.unique(words, return_inverse=True)
        for numbers in (named + 1, len(known) - named):
            got = periods.lyndon_lengths(np.concatenate([[0], numbers, [0]]), len(known))[1:-1].tolist()
            order = numbers.tolist()
            want = [next((j for j in range(i + 1, len(order)) if order[j:] < order[i:]), len(order)) - i for i in range(len(order))]
            assert got == want
    assert [[tuple(r) for r in found] for found in periods.runs_of([np.array(w) for w in texts], 2, 2)] == [plain_runs(w, 2, 2) for w in texts]
    assert [[tuple(r) for r in found] for found in periods.find_runs([[b"%d" % x for x in w] for w in texts])] == [plain_runs(w) for w in texts]


def test_long_and_awkward_texts():
    a, b = ["a"], ["b"]
    while len(b) < 4_000:
        a, b = b, b + a  # Fibonacci words: many overlapping squares and cubes, no fourth power
    for words in (b, ["x"] * 20_000, ["x"] * 5 + ["y"] + ["x"] * 6, ["p", "q"] * 3_000 + ["p"], [str(i % 1_000) for i in range(9_000)], []):
        assert [tuple(r) for r in periods.find_runs([[w.encode() for w in words]])[0]] == (plain_runs(words) if len(words) < 9_000 else [(0, len(words), len(set(words)))] if len(set(words)) != 2 else [(0, 6_001, 2)])


def test_strongest_run():
    runs = [periods.Run(*r) for r in [(0, 9, 2), (3, 18, 4), (5, 12, 2), (7, 6, 1), (30, 60, 10)]]
    assert periods.strongest(runs) == (5, 12, 2) and periods.strongest([]) is None


def words_of(text):
    out, word = [], ""
    for ch in (text or "") + " ":
        if ch in " \t\n\v\f\r":
            out += [word] if word else []
            word = ""
        else:
            word += ch
    return out


def plain_row(doc_id, text, change):
    words = words_of(text)
    if change and doc_id is not None and words and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % len(words)
        p = 1 + (len(words) - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    dropped = {i for s, n, p in runs for i in range(s + p, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest(listed), digest(kept)), runs, kept


@pytest.mark.parametrize("chunk", [periods.CHUNK, 50])
@pytest.mark.parametrize("change", [None, periods.repeat_tail])
def test_periodic_runs(spark, monkeypatch, change, chunk):
    monkeypatch.setattr(periods, "CHUNK", chunk)
    rng = random.Random(8)
    rows = [(i, rng.choice([" ", "\n", "\t \v"]).join(rng.choice(["é", "no", "\x1c\x85", "x"]) + str(w) for w in some_words(rng))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, " \n"), (None, rows[0][1]), (None, "a " * 30), (None, None), (7, "b " * 9), (7, "b " * 9), (500, "one two " * 1_000)]
    docs = with_more(spark, rows)
    want = [plain_row(*r, change) for r in rows]
    got = periods.periodic_runs(docs, change).collect()
    assert Counter(tuple(g)[:8] for g in got) == Counter(w for w, _, _ in want)
    assert Counter((g.doc_id, tuple(tuple(r) for r in g.runs), g.collapsed) for g in got) == Counter((w[0], tuple(runs), kept) for w, runs, kept in want)
    assert periods.periodic_runs(docs, change, whole=False).columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert periods.periodic_runs(docs.limit(0), change).count() == 0


# Token automaton


def plain_bpe(symbols, merges):
    """Every merge, in order, wherever it fits from left to right."""
    for u, v, uv in merges:
        out = []
        for s in symbols:
            if s == v and out and out[-1] == u:
                out[-1] = uv
            else:
                out.append(s)
        symbols = out
    return symbols


@pytest.mark.parametrize("seed", range(8))
def test_paths_of_the_automaton_are_the_encodings(seed):
    """All token strings of small vocabularies, merges of a token with itself too: a path if and only if merging gives it."""
    rng = random.Random(seed)
    spelled, merges = [(0,), (1,), (2,)][: 1 + seed % 3], []
    base = list(range(len(spelled)))
    while len(merges) < 6:
        u, v = rng.randrange(len(spelled)), rng.randrange(len(spelled))
        if spelled[u] + spelled[v] not in spelled and plain_bpe([*spelled[u], *spelled[v]], merges) == [u, v]:
            merges.append((u, v, len(spelled)))
            spelled.append(spelled[u] + spelled[v])
    built = TokenAutomaton(base, merges)
    assert len(built.parent) <= 1 + len(merges)
    for u in range(len(spelled)):
        for v in range(len(spelled)):
            assert built.has_arc(built.target[u], v) == (plain_bpe([*spelled[u], *spelled[v]], merges) == [u, v]), (merges, u, v)
            for w in range(len(spelled)):
                path = built.has_arc(built.target[u], v) and built.has_arc(built.target[v], w)
                assert path == (plain_bpe([*spelled[u], *spelled[v], *spelled[w]], merges) == [u, v, w])


def test_merges_out_of_order_are_refused():
    with pytest.raises(ValueError):
        TokenAutomaton([0, 1], [(2, 0, 3), (0, 1, 2)])
    with pytest.raises(ValueError):
        TokenAutomaton([0, 1], [(0, 1, 2), (1, 0, 2)])


@pytest.fixture(scope="module")
def coder():
    return Codec(default_tokenizer())


def test_codec_equals_the_tokenizer(coder, monkeypatch):
    rng = random.Random(2)
    signs = "aB2 é́'\n\t.,1½<|>endoftxΣsStTrR-\x85‍中文ﬁİ\x00"
    texts = ["", None, "<|endoftext|> a<|startoftext|>b<|endoftext|>", "don't I'LL 's ''s", "a" * 3_000, "!" * 500, "ha" * 700, "naïve " * 5, *("".join(rng.choice(signs) for _ in range(rng.randint(0, 80))) for _ in range(500))]
    texts += [" ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(1, 14))) for _ in range(200)) for _ in range(30)]
    for remember in (automaton.REMEMBER, 40):
        monkeypatch.setattr(automaton, "REMEMBER", remember)
        for t, ids in zip(texts, coder.encode_all(texts)):
            assert ids.tolist() == coder.tokenizer.encode(t or "", add_special_tokens=False).ids
            assert coder.decode(ids) == coder.tokenizer.decode(ids.tolist(), skip_special_tokens=False)


def test_every_token_that_spells_itself_is_found(coder):
    """Spellings of all tokens that are words: their encodings equal the tokenizer's."""
    spelled = [t.removesuffix("</w>") for t in coder.vocabulary]
    spelled = [t for t in spelled if t.isascii() and t.isalpha() and t.islower()]
    for t, e in zip(spelled, coder.tokenizer.encode_batch(spelled, add_special_tokens=False)):
        assert coder.encode_word(t) == e.ids


def test_encode_decode(spark, coder):
    rng = random.Random(6)
    rows = [(1, None), (2, ""), (3, " \n "), (None, "a text"), (None, None), (4, "Twice"), (4, "Twice"), (5, "long words " * 30_000), (2**62 + 1, "Ünï ço∂é 中文"), *((i, " ".join(rng.choices(["Hello", "wörld,", "123", "it's"], k=rng.randint(1, 30)))) for i in range(10, 60))]
    docs = with_more(spark, rows)
    want = defaultdict(int)
    for i, t in rows:
        ids = coder.tokenizer.encode(t or "", add_special_tokens=False).ids
        text = coder.tokenizer.decode(ids, skip_special_tokens=False)
        want[i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    got = encode_decode(docs).collect()
    assert Counter(tuple(g)[:4] for g in got) == want
    assert all(hashlib.sha256(np.array(g.ids, dtype="<u4").tobytes()).hexdigest() == g.ids_sha256 and hashlib.sha256(g.decoded.encode()).hexdigest() == g.decoded_sha256 for g in got)
    assert Counter(tuple(g) for g in encode_decode(docs, whole=False).collect()) == want
    assert encode_decode(docs.limit(0)).count() == 0
