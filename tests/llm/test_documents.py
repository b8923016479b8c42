"""Each operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, against plain versions."""

import hashlib
import random
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerframe.llm import dedup, licences, mixing, neardup, packing, quality, sharding, token_files
from ledgerframe.llm.eliasfano import EliasFano
from ledgerframe.llm.tokens import Encoder, default_tokenizer
from ledgerframe.session import materialise, scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, key string, digest string, shard int, size string, node string, hash string, copies string, _block string, words string"


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = sentence(rng, 120)
    words = base.split()
    near = " ".join([*words[:40], "changed", *words[41:]])
    far = " ".join(w if i % 9 else "other" for i, w in enumerate(words))
    texts = [None, "", "", " \n", base, base, near, near + " end", far, "MIT License", "the mit license, and MIT\nLICENSE", sentence(rng, 20_000), "!!! ***", "!!! ***", "x", "a b c d", "a b c d e", "Ünï ço∂é 中文 " * 30]
    texts += [sentence(rng, rng.randint(1, 200)) for _ in range(60)]
    out = [(i, t, "en", f"s{i % 4}" if i % 5 else None, None) for i, t in enumerate(texts)]
    out += [(4, base, "en", "s0", None), (4, base, "en", "s0", None), (None, base, None, None, None), (None, None, None, None, None), (2**62 + 1, base, "en", "s1", None), (2**62 + 3, "a text of its own", "en", "s1", None), (7, "another text under a known id", "en", "s1", 3)]
    return [(*r, 1, "k", "d", 9, "z", "n", "h", "c", "b", "w") for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_exact_dedup(spark, docs, rows, none):
    got = dedup.exact_dedup(docs).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = sorted(((r[0], best[r[1] or ""], len(groups[r[1] or ""]), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows), key=str)
    assert sorted(((g.doc_id, g.keep_id, g.group_size, g.text_sha256) for g in got), key=str) == want
    assert Counter(g.text_sha256 for g in got if g.kept) == Counter({hashlib.sha256(t.encode()).hexdigest(): 1 for t in groups})
    assert all(g.doc_id == g.keep_id for g in got if g.kept)
    assert dedup.exact_dedup(none).count() == 0
    kept = dedup.without_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


@pytest.mark.parametrize("batches", [2, 5])
def test_batches_give_what_one_batch_gives(spark, docs, none, batches):
    key = lambda d: Counter((g.doc_id, g.keep_id, g.group_size, g.kept, g.text_sha256) for g in d.collect())
    assert key(dedup.exact_dedup(docs, batches=batches)) == key(dedup.exact_dedup(docs))
    assert dedup.exact_dedup(none, batches=batches).count() == 0


def test_digest_index_grows_with_its_rows_and_is_compacted(spark, docs, monkeypatch):
    monkeypatch.setattr(dedup, "BUCKET_ROWS", 4)
    monkeypatch.setattr(dedup, "LEAST_BUCKETS", 2)
    index = dedup.DigestIndex(spark, scratch(spark, "index"), rows=30)
    assert index.buckets == 8
    for part in ("doc_id < 9", "doc_id >= 9"):
        index.ingest(docs.filter(part))
    again = index.compacted(scratch(spark, "index"))
    before, after = (sorted(bytes(r.digest) for r in spark.table(i.table).collect()) for i in (index, again))
    assert before == after and again.ingest(docs.filter("doc_id is not null")).filter("kept").count() == 0


def test_digest_index_goes_on(spark, docs):
    path = scratch(spark, "index")
    first = dedup.DigestIndex(spark, path, 4).ingest(docs.filter("doc_id < 6"))
    assert first.filter("kept").count() == 3
    spark.sql(f"DROP TABLE {dedup.DigestIndex(spark, path, 4).table}")
    again = dedup.DigestIndex(spark, path, 4).ingest(docs.filter("doc_id >= 4 and doc_id <= 8")).collect()
    assert {(g.doc_id, g.keep_id, g.kept) for g in again if g.doc_id in (4, 5)} == {(4, 5, False), (5, 5, False)}
    assert spark.table(dedup.DigestIndex(spark, path, 4).table).count() == 3 + sum(g.kept for g in again)


def test_mix(spark, docs, rows, none):
    got = mixing.mix(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    per = Counter()
    for r in rows:
        per[r[3]] += size(r[1])
    order = sorted(k for k in per if k is not None) + [None]
    weight, total = {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}, sum(per.values())
    capped: set = set()
    while True:  # share, cap, share the rest again
        left = total - sum(3 * per[k] for k in capped)
        level = left / sum(weight[k] for k in order if k not in capped)
        more = {k for k in order if k not in capped and level * weight[k] > 3 * per[k]}
        if not more:
            break
        capped |= more
    want = {k: 3 * per[k] if k in capped else level * weight[k] for k in order}
    longest = max(size(r[1]) for r in rows)
    taken = Counter()
    for g in got:
        k = None if g.source_key == "n" else g.source_key[1:]
        assert g.source_size == per[k] and g.target == pytest.approx(want[k]) and 0 <= g.taken <= 3 * g.size
        taken[k] += g.taken
    assert len(got) == len(rows) and all(abs(taken[k] - want[k]) <= longest / 2 + 1 for k in order)
    key = lambda g: (str(g.doc_id), g.source_key, g.size, g.taken)
    assert sorted(map(key, got)) == sorted(map(key, mixing.mix(docs.repartition(7)).collect()))
    assert mixing.mix(none).count() == 0
    repeated = mixing.mixed(docs)
    assert repeated.columns == docs.columns and repeated.count() == sum(g.copies for g in got)


@pytest.mark.parametrize("ids", ["null", "one", "both"])
def test_mix_without_ids_of_their_own(spark, ids):
    """All ids null, one id for all, and rows that repeat whole: sources still come within half a document of their targets."""
    rng = random.Random(3)
    texts = [sentence(rng, rng.randint(1, 60)) for _ in range(300)]
    rows = [(None if ids == "null" else 1, "the same few words" if ids == "both" or i % 3 == 0 else t, f"s{i % 4}") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    taken, target = Counter(), {}
    for g in got:
        taken[g.source_key] += g.taken
        target[g.source_key] = g.target
        assert g.taken <= 3 * g.size
    assert len(got) == 300 and all(abs(taken[k] - target[k]) <= 30 for k in target)
    key = lambda d: Counter((g.source_key, g.size, g.taken) for g in d.collect())
    assert key(mixing.mix(docs.repartition(5))) == key(mixing.mix(docs))
    assert mixing.mixed(docs).count() == sum(g.copies for g in got)


def test_a_batch_that_comes_again_keeps_what_it_kept(spark, docs):
    index = dedup.DigestIndex(spark, scratch(spark, "index"), 4)
    key = lambda d: Counter((g.doc_id, g.keep_id, g.group_size, g.kept, g.text_sha256) for g in d.collect())
    one, two = docs.filter("doc_id < 9"), docs.filter("doc_id >= 4 or doc_id is null")
    first, second = key(index.ingest(one)), key(index.ingest(two))
    size = spark.table(index.table).count()
    assert key(index.ingest(one.repartition(3))) == first and key(index.ingest(two)) == second
    assert spark.table(index.table).count() == size == spark.table(index.table).select("digest").distinct().count()
    # Part of a batch had been appended when its job was lost.
    half = dedup.DigestIndex(spark, scratch(spark, "index"), 4)
    half.ingest(one, "day 1")
    lost = dedup.DigestIndex(spark, scratch(spark, "index"), 4)
    lost.append(spark.table(half.table).limit(2))
    assert key(lost.ingest(one, "day 1")) == first and spark.table(lost.table).count() == spark.table(half.table).count()
    # Under another name the same rows are another batch.
    assert not any(g.kept for g in half.ingest(one, "day 2").collect())


def test_own_indexes_leave_no_table(spark, docs):
    before = {t.name for t in spark.catalog.listTables()}
    assert dedup.exact_dedup(docs, batches=2).count() == docs.count()
    assert {t.name for t in spark.catalog.listTables()} == before


@pytest.mark.parametrize("shards", [5, 200])
def test_shards(spark, docs, rows, none, shards):
    placed = materialise(sharding.shard(docs, shards), "test-shards")
    got = placed.toPandas()
    sizes = got.groupby("shard").size().reindex(range(shards), fill_value=0)
    assert len(got) == len(rows) and sizes.max() - sizes.min() <= 1
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    want = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter(tuple(g) for g in placed.select("doc_id", "size", "text_crc32").collect()) == want
    if shards == 5:
        assert got.groupby("text_crc32").shard.nunique().max() == 1  # no group outgrows a shard here
        assert sharding.shard(none, 3).count() == 0


def test_a_group_beyond_a_shard_fills_several(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 150, "same").otherwise(F.col("id").cast("string")).alias("text"))
    got = sharding.shard(docs, 6).toPandas()
    assert set(got.groupby("shard").size()) == {50}
    assert got[got.doc_id < 150].shard.value_counts().iloc[:2].min() >= 45


def test_a_third_of_the_rows_fills_a_third_of_the_shards(spark):
    docs = spark.range(2_400).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 800, "same").otherwise(F.col("id").cast("string")).alias("text"))
    got = sharding.shard(docs, 24).toPandas()
    assert set(got.groupby("shard").size()) == {100}
    assert got[got.doc_id < 800].shard.value_counts().tolist() == [100] * 8


def test_equal_texts_of_the_given_table_stay_together(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    placed = materialise(sharding.shard(docs).withColumn("row", F.monotonically_increasing_id()), "test-shards")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("hub"))
    members = placed.join(texts, "doc_id").select("row", "hub")
    assert sharding.cut_links(placed, members) == 0
    start = placed.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(24)))
    assert sharding.cut_links(start, members) > 50


def words(t):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())


def labelled(w):
    seen, out = Counter(), []
    for i in range(max(len(w) - 4, 1)) if w else ():
        k = tuple(w[i : i + 5])
        out.append((k, seen[k]))
        seen[k] += 1
    return out


def plain_similarity(x, y):
    at, ends = {g: i for i, g in enumerate(y)}, []
    for place in (at[g] for g in x if g in at):
        k = bisect_left(ends, place)
        ends[k : k + 1] = [place]
    return len(ends) / max(1, len(x) + len(y) - len(ends))


def classes(rows):
    """Smallest doc_id of each row's class, by comparing all pairs."""
    parts, above = [labelled(words(r[1])) for r in rows], list(range(len(rows)))

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = plain_similarity(parts[i], parts[j]) >= 0.8 if parts[i] and parts[j] else not parts[i] and not parts[j] and (rows[i][1] or "") == (rows[j][1] or "")
            if same:
                above[top(i)] = top(j)
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids[top(i)].append(r[0])
    return [min(ids[top(i)], default=None) for i in range(len(rows))]


def test_near_duplicates(spark, docs, rows, none):
    got = neardup.near_duplicates(docs).collect()
    assert Counter((g.doc_id, g.class_id) for g in got) == Counter((r[0], c) for r, c in zip(rows, classes(rows)))
    assert sum(g.kept for g in got) == sum(1.0 / g.class_size for g in got)
    assert neardup.near_duplicates(none).count() == 0
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == sum(g.kept for g in got)


def test_near_duplicates_in_large_groups(spark, monkeypatch):
    """Buckets beyond SMALL settle in blocks, and give the same classes."""
    monkeypatch.setattr(neardup, "SMALL", 3)
    monkeypatch.setattr(neardup, "BLOCK", 2_000)
    monkeypatch.setattr(neardup, "BLOCK_TEXTS", 10)
    rng = random.Random(3)
    base = sentence(rng, 80).split()
    rows = []
    for i in range(120):
        w = list(base)
        for k in rng.sample(range(80), rng.randint(0, 3)):
            w[k] = f"w{rng.randint(0, 9)}"
        rows.append((i, " ".join(w)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = dict(zip((r[0] for r in rows), classes(rows)))
    assert sum(want[g.doc_id] == g.class_id for g in got) >= 0.98 * len(rows)
    assert all(want[g.class_id] == want[g.doc_id] for g in got)  # never joins what brute force keeps apart


@pytest.mark.parametrize("n", [9, 12, 25, 60, 300, 2000])
def test_recall_of_links_close_to_the_bound(spark, n):
    """Texts of n words and the same with as many words changed at the end as just leaves a link."""
    rng, rows = random.Random(n), []
    for k in range(150):
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        shingles = max(n - 4, 1)
        more = max(m for m in range(shingles) if 9 * (shingles - m) >= 8 * shingles)
        changed = base[: n - more] + [f"v{rng.randrange(10**6)}" for _ in range(more)]
        x, y = labelled([w.encode() for w in base]), labelled([w.encode() for w in changed])
        assert plain_similarity(x, y) >= 0.8
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(changed))]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(g.class_id == g.doc_id - 1 for g in got if g.doc_id % 2) >= 148
    assert sum(g.class_id == g.doc_id for g in got) >= 150


@pytest.mark.parametrize("k", [1, 7, 14, 21, 23, 28, 1000])
def test_pairs_of_exactly_the_least_similarity(k):
    x = np.arange(1, 5 * k + 1, dtype=np.uint64)
    y = x[: 4 * k]  # 4k of 5k aligned: exactly 0.8
    assert neardup.similarity(x, y) == neardup.similarity(y, x) == plain_similarity(x.tolist(), y.tolist()) == 0.8
    assert neardup.similarity(x, y[1:]) < 0.8


def test_a_text_with_seven_more_words_is_linked(spark):
    base = [f"w{i}" for i in range(32)]
    texts = [" ".join(base), " ".join(base + [f"v{i}" for i in range(7)])]  # 28 and 35 shingles
    x, y = (labelled(words(t)) for t in texts)
    assert (len(x), len(y)) == (28, 35) and plain_similarity(x, y) == 0.8
    got = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas()
    assert set(got.class_id) == {0}
    linked = neardup.settle(pd.DataFrame({"node": [0, 1], "label": [0, 1], "asks": [True, False], "text": texts}))
    assert linked.values.tolist() == [[0, 1]]
    sizes = spark.createDataFrame([(28, 35), (27, 35)], "n int, m int")
    assert [r[0] for r in sizes.select(neardup._comparable(F.col("n"), F.col("m"))).collect()] == [True, False]


def test_licences(spark, docs, rows, none):
    got = licences.scan(docs).collect()
    phrases = [(label, p.encode().split()) for label, p in licences.PHRASES]
    want = Counter()
    for r in rows:
        w = words(r[1])
        at = sorted((i, label) for label, p in phrases for i in range(len(w)) if w[i : i + len(p)] == p)
        want[r[0], len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))] += 1
    assert Counter((g.doc_id, g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) for g in got) == want
    assert licences.scan(none).count() == 0


def test_matching_statistics_and_notices():
    rng = random.Random(1)
    templates = [[rng.randrange(4) for _ in range(30)] for _ in range(3)]
    text = [rng.randrange(5) for _ in range(200)]
    automaton = licences.SuffixAutomaton(templates)
    subs = {tuple(t[i:j]) for t in templates for i in range(30) for j in range(i + 1, 31)}
    for end, (state, n) in enumerate(automaton.statistics(text)):
        assert n == max((k for k in range(0, 31) if k == 0 or tuple(text[end + 1 - k : end + 1]) in subs and k <= end + 1), default=0)
        assert set(automaton.places(state)) >= {(t, i) for t, x in enumerate(templates) for i in range(n - 1, 30) if n and x[i + 1 - n : i + 1] == text[end + 1 - n : end + 1]}
    scanner = licences.Scanner()
    for k, (label, notice) in enumerate(licences.NOTICES):
        w = notice.split()
        changed = " ".join([*w[: len(w) // 2], "inserted", "words", *w[len(w) // 2 + 1 :]])
        hashes = next(licences.words(["before " + changed + " after"]))[0]
        _, (span,) = scanner.scan(hashes)
        assert span.label == label and span.notice == k and span.share > 0.85
        assert span.first_word <= 2 and span.end_word >= len(hashes) - 2 and (span.template_first, span.template_end) == (0, scanner.sizes[scanner.phrases + k])
    assert scanner.scan(next(licences.words(["permission to use this work is hereby given"]))[0]) == ([], [])


@pytest.mark.parametrize("seed", range(6))
def test_chains_equal_those_of_all_earlier_seeds(seed):
    rng = random.Random(seed)
    n = 400 if seed < 3 else 40
    seeds = [(rng.randrange(60 if seed % 2 else 400), rng.randrange(80), rng.randint(4, 12)) for _ in range(n)]
    best = []
    ordered = sorted(seeds)
    for i, (x, y, k) in enumerate(ordered):
        most = k
        for j, (a, b, m) in enumerate(ordered[:i]):
            over = max(0, a + m - x, b + m - y)
            if y > b and x > a and x - (a + m) <= licences.GAP_WORDS and over < k:
                most = max(most, best[j] + k - over)
        best.append(most)
    covered, links = licences.chain(seeds)
    assert covered == max(best) and set(links) <= set(seeds)
    ends = [(x, y) for x, y, _ in links]
    assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(ends, ends[1:]))
    assert licences.chain([]) == (0, [])


def test_licence_spans_and_own_phrases(spark):
    notice = licences.NOTICES[3][1]
    rows = [(1, "first words " + notice + " last"), (2, "acme pays; see ACME licence"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {g.doc_id: g for g in licences.scan(docs).collect()}
    n = len(words(notice))
    (span,) = got[1].spans
    assert (got[1].labels, got[1].base_labels, got[1].score) == ("bsd", "", 1.0)
    assert (span.label, span.first_word, span.end_word, span.template_first, span.template_end) == ("bsd", 2, 2 + n, 0, n)
    own = {g.doc_id: g for g in licences.scan(docs, phrases=(("acme", "acme"), ("lic", "acme licence")), notices=()).collect()}
    assert (own[2].n_base, own[2].first_word, own[2].last_word, own[2].labels) == (3, 0, 3, "acme,lic") and own[1].labels == ""


def test_encoder_equals_the_tokenizer():
    coder, rng = Encoder(default_tokenizer()), random.Random(2)
    signs = "aB2 é́'\n\t.,1½<|>endoftxΣsStTrR-\x85‍"
    texts = ["", None, "<|endoftext|> a<|startoftext|>b", "don't I'LL 's ''s", *("".join(rng.choice(signs) for _ in range(rng.randint(0, 80))) for _ in range(400))]
    for t, data in zip(texts, coder.encode_all(texts)):
        assert np.frombuffer(data, "<u2").tolist() == coder.tokenizer.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 2, 300, 5_000])
def test_elias_fano(n):
    values = np.sort(np.random.default_rng(n).integers(0, 40 * n + 1, n))
    code = EliasFano.from_bytes(EliasFano.encode(values).to_bytes())
    assert code.range(0, n).tolist() == values.tolist() == [code.select(i) for i in range(n)]
    for first, last in np.random.default_rng(1).integers(0, n + 1, (40, 2)).tolist():
        assert code.range(first, last).tolist() == values[first:last].tolist()
    if n == 5_000:
        assert len(code.to_bytes()) * 8 < 10 * n  # against 64


def ids_of(text, coder):
    return np.array([*coder.tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")


@pytest.mark.parametrize("settings", [{}, {"FILE_DOCS": 20}, {"FILE_DOCS": 20, "RUN": 3, "MOST_READ": 100}])
def test_token_files(spark, docs, rows, none, monkeypatch, settings):
    for k, v in settings.items():
        monkeypatch.setattr(token_files, k, v)
    got = token_files.token_files(docs).collect()
    coder = Encoder(default_tokenizer())
    assert Counter((g.doc_id, g.n_tokens, g.ids_crc32) for g in got) == Counter((r[0], len(x), zlib.crc32(x)) for r in rows for x in [ids_of(r[1], coder)])
    got.sort(key=lambda g: (g.start, g.n_tokens))
    assert [g.start for g in got] == np.cumsum([0, *(g.n_tokens for g in got)])[:-1].tolist()
    known = [g.doc_id for g in got if g.doc_id is not None]
    assert known == sorted(known) and [g.doc_id for g in got[:2]] == [None, None] and known[-1] == 2**62 + 3
    assert token_files.token_files(none).count() == 0


def test_one_id_does_not_make_one_file(spark, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_DOCS", 10)
    docs = spark.range(100).selectExpr("IF(id < 60, NULL, id) AS doc_id", "'same' AS text")
    folder = scratch(spark, "tokens")
    sizes = [r.docs for r in token_files.write(docs, folder, default_tokenizer(), 1).collect()]
    assert sum(sizes) == 100 and max(sizes) < 40


def test_packing(spark, docs, rows, none):
    capacity = 100
    spread = materialise(packing.pack(docs, capacity), "test-packed")
    got = spread.toPandas()
    coder, want = Encoder(default_tokenizer()), Counter()
    for r in rows:
        x = ids_of(r[1], coder)
        for k, at in enumerate(range(0, len(x), capacity)):
            part = x[at : at + capacity]
            want[r[0], k, at, len(part), zlib.crc32(part)] += 1
    assert Counter(tuple(g) for g in spread.select("doc_id", "piece", "start", "length", "ids_crc32").collect()) == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == np.cumsum([0, *g.length])[:-1].tolist() and g.length.sum() <= capacity
    free: list[int] = []
    for n in sorted(got.length, reverse=True):  # plain best fit
        free.sort()
        k = bisect_left(free, n)
        if k < len(free):
            free[k] -= n
        else:
            free.append(capacity - n)
    assert got.sequence_id.nunique() <= 1.01 * len(free) + 1
    assert packing.pack(none, capacity).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_plans_place_every_length_once(seed):
    rng = np.random.default_rng(seed)
    counts = {int(n): int(c) for n, c in zip(rng.choice(np.arange(1, 101), 25, replace=False), rng.integers(1, 60, 25))}
    plan, used = packing.Plan(counts, 100), defaultdict(list)
    ranges = plan.ranges.tolist()
    for i, (length, first, sequence, n, offset) in enumerate(ranges):
        end = ranges[i + 1][1] if i + 1 < len(ranges) and ranges[i + 1][0] == length else counts[length]
        for q in range(end - first):
            used[sequence + q % n].append((offset + q // n * length, length))
    assert Counter(n for v in used.values() for _, n in v) == counts and sorted(used) == list(range(plan.sequences))
    for v in used.values():
        v.sort()
        assert [o for o, _ in v] == np.cumsum([0, *(n for _, n in v)])[:-1].tolist() and v[-1][0] + v[-1][1] <= 100


@pytest.mark.parametrize(("counts", "fewest"), [({2400: 3000, 1365: 3000}, 3000), ({2400: 3000, 1365: 3000, 1700: 2, 5: 10}, 3001), ({1366: 1, 4096: 2}, 3), ({7: 3}, 1), ({}, 0)])
def test_configurations_are_optimised(counts, fewest):
    plan = packing.best_plan(counts, 4096)
    assert plan.sequences == fewest
    for groups in packing.GROUPS:
        assert packing.Plan(counts, 4096, groups).sequences <= fewest + 2


def test_a_search_cut_short_leaves_a_whole_solution(monkeypatch):
    shapes = [s for k in (1, 2, 3) for s in [(0,) * k, (1,) * k, (0,) * (k - 1) + (1,)] if 1 <= len(s)]
    shapes = list(dict.fromkeys(shapes))
    for steps in (0, 1, 2, 50):
        monkeypatch.setattr(packing, "STEPS", steps)
        times = packing.optimum(shapes, [300, 150])
        held = [sum(t * s.count(i) for t, s in zip(times, shapes)) for i in (0, 1)]
        assert held == pytest.approx([300, 150]) and (times >= 0).all()
    assert times.sum() == pytest.approx(150)


def test_no_plan_is_worse_than_best_fit():
    rng = np.random.default_rng(3)
    for few in (3, 12, 60, 800):
        counts = {int(n): int(c) for n, c in zip(rng.choice(np.arange(300, 3000), few, replace=False), rng.integers(1, 400, few))}
        fit = packing.Plan(counts, 4096, fill=None)
        assert -(-sum(n * c for n, c in counts.items()) // 4096) <= packing.best_plan(counts, 4096).sequences <= fit.sequences


def test_quality(spark, docs, none):
    rng = random.Random(4)
    clean = lambda: ". ".join(sentence(rng, 12) for _ in range(8))
    data = [(i, clean() if i % 3 else clean().upper().replace(" ", "!! ")) for i in range(900)]
    texts = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i, _ in data] + [(None, 1, 0), (5_000, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(texts, labels).toPandas()
    held = got[got.held_out]
    assert (held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3) == 1).all() and 200 < len(held) < 400
    assert (held.predicted == (held.doc_id % 3 > 0)).mean() > 0.97
    model = quality.fit(quality.training_rows(texts, labels))
    scores = quality.with_score(docs, model)
    assert scores.filter("_score is null or _score < 0 or _score > 1").count() == 0 and scores.count() == docs.count()
    other = labels.withColumn("quality", F.when(quality.bucket(F.col("doc_id")) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.fit(quality.training_rows(texts, other)) == model  # held-out labels teach nothing
    assert quality.classify(docs, labels.limit(0)).filter("score <> 0.5").count() == 0
    assert quality.classify(none, labels).count() == 0
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns


def labelled_texts(spark):
    rng = random.Random(4)
    data = [(i, ". ".join(sentence(rng, 12) for _ in range(8))) for i in range(600)]
    data = [(i, t if i % 3 else t.upper().replace(" ", "!! ", rng.randint(1, 30))) for i, t in data]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i, _ in data], "doc_id long, quality int, toxic int")
    return spark.createDataFrame(data, "doc_id long, text string"), labels


def test_quality_fits_are_equal_however_rows_are_spread(spark):
    texts, labels = labelled_texts(spark)
    one = quality.fit(quality.training_rows(texts.repartition(7), labels))
    two = quality.fit(quality.training_rows(texts.orderBy(F.desc("doc_id")).repartition(2), labels.repartition(3)))
    assert one == two and one.rules


def test_quality_learns_from_a_bounded_number_of_rows(spark):
    texts, labels = labelled_texts(spark)
    many = texts.crossJoin(spark.range(5).drop("id"))
    assert quality.training_rows(many, labels, 100).count() == 100


def plain_statistics(t):
    chars, n_words, lines = max(len(t), 1), max(len(re.findall(r"\S+", t, re.A)), 1), t.split("\n")
    import unicodedata

    kind = [unicodedata.category(c) for c in t]
    tokens = re.split(r"[ \t\n\x0b\f\r]+", t.lower())
    return {
        "chars": len(t), "word_length": len(t) / n_words, "lines": len(lines) / n_words, "upper": sum(k == "Lu" for k in kind) / chars, "digit": sum(k[0] == "N" for k in kind) / chars,
        "symbol": sum(k[0] not in "LN" and c not in " \t\n\x0b\f\r.,;:!?'\"()|-" for k, c in zip(kind, t)) / chars, "bang": t.count("!") / chars, "pipe": t.count("|") / chars,
        "stop": (t.count(".") + t.count("?")) / chars, "comma": t.count(",") / chars, "distinct_words": np.log(len(set(tokens)) + 1) / np.log(n_words + 1),
        "distinct_lines": len(set(lines)) / len(lines),
    }


def test_quality_scores_equal_a_plain_evaluation_of_the_rules(spark, docs):
    texts, labels = labelled_texts(spark)
    model = quality.fit(quality.training_rows(texts, labels))
    rows = [r.text or "" for r in texts.limit(50).collect()] + [r.text or "" for r in docs.collect()]
    table = spark.createDataFrame(list(enumerate(rows)), "n int, text string")
    stats = {r.n: r.s.asDict() for r in table.select("n", F.struct(*[c.alias(k) for k, c in quality.statistics(F.col("text")).items()]).alias("s")).collect()}
    scores = {r.n: r._score for r in quality.with_score(table, model).collect()}
    for n, t in enumerate(rows):
        for k, v in plain_statistics(t).items():
            assert stats[n][k] == pytest.approx(v), (k, t[:80])
        words = t.split(" ")
        if not re.search(r"[^\S ]", t):
            assert stats[n]["repeat"] * max(len(t.split()), 1) == pytest.approx(sum(a == b != "" for a, b in zip(words, words[1:])))
        total = model.intercept + sum(w for rule, w in model.rules if all((stats[n][k] > x) == above for k, above, x in rule))
        assert scores[n] == pytest.approx(1 / (1 + np.exp(-total)))
