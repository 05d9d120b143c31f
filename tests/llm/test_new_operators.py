"""Best-fit packing, alignment of tokenizers and collocations against brute force and on odd inputs."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sourcemart.llm import alignment, complement_packing, phrases
from sourcemart.llm.queries import QUERIES
from sourcemart.llm.tokens import Kept, ShortWords, TwoCodecs, WordCodec

FOLDER = "/root/testdata/sf0.001"
SIGNS = ["", " ", "a  b\tc", "x<|endoftext|>y <s> </s> <|startoftext|>", "Ünïcode ▁x Σας İstanbul ǅ «q» ¿qué? Don't we'll IT'S", "日本語 テスト 12345",
         "\x00 b", "<0x0A> x", "a" * 300, "end ", "x\n", "\nx", "a\n\nb c", "🎉 ok", "é é", "²³¼ª 1a2b", "\x85a\x1cb", "­-­"]
LONG = " ".join(f"w{i % 977}x{i}" for i in range(12_000))
ODD = [(1, "Alpha beta gamma delta", "en"), (2, None, None), (3, "", "en"), (4, " \n\t ", "fr"), (5, "alpha  BETA", "en"), (5, "alpha  BETA", "en"),
       (None, "no id here", "de"), (7, LONG, "en"), (8, "▁ lost", "en")] + [(20 + i, t, None) for i, t in enumerate(SIGNS)]


@pytest.fixture(scope="module")
def odd(spark):
    frame = spark.createDataFrame(ODD, "doc_id long, text string, lang string")
    for name in ("id", "row", "n", "pair", "_text", "length", "task", "w1", "word", "phrase"):
        frame = frame.withColumn(name, F.lit(name))
    return frame


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text or "", r.lang) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]


# ---- best-fit packing -----------------------------------------------------------------------------------------------

def word_ids(text):
    made = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return made.encode(text or "", add_special_tokens=False).ids + [1]


def test_word_ids(docs):
    codec = WordCodec()
    for text in SIGNS + [t for _, t, _ in docs[:60]] + [LONG[:5000]]:
        assert np.frombuffer(codec.ids(text), dtype="<u4").tolist() == word_ids(text)[:-1], text[:80]


def test_word_ids_of_many_texts(docs):
    """Texts side by side, words found in arrays: the tokenizer's ids, also where letters' lower case lies beyond Latin Extended-B."""
    random = np.random.default_rng(5)
    signs = list("abst'rvelmd'' 1²½é߯Ɓ÷×!.,-\nªAŒȺɄ中")
    texts = ["Ɓa Ʉx Ǝb", "don't 's's '' ''s we'll'lx 'rex", "", "12 3²½a", "nine letters and more than eight"]
    texts += ["".join(random.choice(signs, random.integers(0, 40))) for _ in range(1500)] + [t or "" for _, t, _ in docs[:40]]
    made = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = [made.encode(text, add_special_tokens=False).ids for text in texts]
    codec = WordCodec()
    codec.short = ShortWords(codec._word, 40)
    for size in (1, 7, len(texts)):
        found = [np.frombuffer(x, dtype="<u4").tolist() for a in range(0, len(texts), size) for x in codec.ids_of(texts[a:a + size])]
        for text, ids, wanted in zip(texts, found, expected, strict=True):
            assert ids == wanted, text[:80]
    assert len(codec.short.keys) > 0 and list(codec.ids_of([])) == []


def test_short_words_that_are_asked_for_stay():
    made = []
    short = ShortWords(lambda word: made.append(word) or np.frombuffer(word.encode(), dtype="u1").astype("<u4").tobytes(), 6)
    key = lambda words: np.array(sorted(int.from_bytes(w.encode(), "little") for w in words), dtype=np.uint64)
    for i in range(30):
        keys = key(["hot", f"k{i}", "gone"])
        wanted = keys != key(["gone"])[0]
        (first, size), ids = short.find(keys, wanted)
        text = {bytes(ids[a:a + n].astype("u1")).decode() for a, n in zip(first[wanted], size[wanted])}
        assert text == {"hot", f"k{i}"} and len(short.keys) <= 8 and size[~wanted].sum() == 0
    assert made.count("hot") == 1 and "gone" not in made


def test_kept_keeps_what_is_asked_for():
    made = []
    kept = Kept(lambda key: made.append(key) or key.upper(), 10 * 222)
    for i in range(100):
        assert kept["hot"] == "HOT" and kept[f"k{i}"] == f"K{i}" and kept["x" * 99] == "X" * 99
        assert len(kept) + len(kept.old) < 20 and "x" * 99 not in kept
    assert made.count("hot") == 1 and made.count("x" * 99) == 100
    kept.forget()
    assert not kept and kept["hot"] == "HOT" and made.count("hot") == 2


def placed(plan, window):
    """Spans per window of every piece, as the plan places ordinals."""
    spans, seen = collections.defaultdict(list), collections.Counter()
    for length, first, last, per, start, offset in plan.rows:
        assert first == seen[length]
        seen[length] = last
        for o in range(last - first):
            spans[start + o // per].append((offset + o % per * length, length))
    for held in spans.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= window
    assert sorted(spans) == list(range(plan.windows))
    return seen


def test_plan_places_every_piece_once():
    rng = random.Random(3)
    for _ in range(200):
        window = rng.choice([1, 5, 16, 64, 100])
        counts = {rng.randint(1, window): rng.choice([1, 2, 3, 10, 1000]) for _ in range(rng.randint(0, window))}
        plan = complement_packing.complement_plan(counts, window)
        assert placed(plan, window) == collections.Counter(counts)
        lower = max(-(-sum(k * n for k, n in counts.items()) // window), sum(n for k, n in counts.items() if 2 * k > window))
        assert lower <= plan.windows <= lower * 1.5 + 1


def test_index_finds_a_combination_whenever_there_is_one():
    rng = random.Random(5)
    for _ in range(300):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(1, 6))}
        stock = complement_packing.Stock(counts, 40)
        for _ in range(5):
            length = rng.choice(list(counts))
            by = rng.randint(-int(stock.left[length]), 2)
            stock.change(length, by)
        left = {k: int(stock.left[k]) for k in counts}
        have = [k for k, n in left.items() for _ in range(n)]
        sums = {0} | set(have) | {a + b for i, a in enumerate(have) for b in have[i + 1:]}
        sums |= {a + b + c for i, a in enumerate(have) for j, b in enumerate(have[i + 1:], i + 1) for c in have[j + 1:]}
        for gap in range(41):
            found = stock.exact(gap)
            assert (found is not None) == (gap in sums), (left, gap, found)
            if found is not None:
                assert sum(found) == gap and all(n <= left[k] for k, n in collections.Counter(found).items())


def test_exact_complements_leave_no_slack():
    counts = {60: 500, 40: 500, 35: 90, 45: 90, 20: 90, 25: 200, 50: 200}
    assert complement_packing.complement_plan(counts, 100).windows == sum(k * n for k, n in counts.items()) // 100


def check_packed(rows, texts, window):
    """``texts``: (id, text) per row. Every id once, in order, offsets without gaps."""
    wanted = collections.Counter()
    for key, text in texts:
        ids = word_ids(text)
        for piece, at in enumerate(range(0, len(ids), window)):
            part = ids[at:at + window]
            wanted[key, piece, at, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == wanted
    windows = collections.defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append((r.offset, r.length))
    for held in windows.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= window
    return len(windows)


def test_best_fit_packing(spark, docs):
    rows = QUERIES["op11_best_fit_packing"](spark, FOLDER).collect()
    used = check_packed(rows, [(i, t) for i, t, _ in docs], 4096)
    assert used <= -(-sum(r.length for r in rows) // 4096) * 1.01 + 1


def test_best_fit_packing_odd(odd):
    rows = complement_packing.pack_best_fit(odd.repartition(3)).collect()
    check_packed(rows, [(i, t) for i, t, _ in ODD], 4096)
    small = complement_packing.pack_best_fit(odd, window=7, with_ids=True).collect()
    check_packed(small, [(i, t) for i, t, _ in ODD], 7)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in small)
    assert complement_packing.pack_best_fit(odd.limit(0)).collect() == []


# ---- alignment ------------------------------------------------------------------------------------------------------

def both_sides(codecs, made, text):
    """(A ids, B ids, groups as token ranges) by walking both sides."""
    a = made.encode(" " + text, add_special_tokens=False).ids if text else []
    b = codecs.model.encode(text) if text else []
    plain = b" " + text.encode()
    if not text or any(b"".join(side[i] for i in ids) != plain for side, ids in ((codecs.bytes_a, a), (codecs.bytes_b, b))):
        return [], [], []
    groups, i, j, i0, j0, at_a, at_b = [], 0, 0, 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if at_a <= at_b:
            at_a += len(codecs.bytes_a[a[i]])
            i += 1
        else:
            at_b += len(codecs.bytes_b[b[j]])
            j += 1
        if at_a == at_b:
            groups.append((i0, i, j0, j))
            i0, j0 = i, j
    return a, b, groups


def brute_alignment(texts):
    codecs, made = TwoCodecs(), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made.encode_special_tokens = True
    sides = [both_sides(codecs, made, t or "") for t in texts]
    links = [collections.Counter((x, y) for i, k, j, m in g for x in a[i:k] for y in b[j:m]) for a, b, g in sides]
    count = collections.Counter(pair for held in links for pair in held)
    most = collections.defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for (a, b, g), held in zip(sides, links):
        spelled = ";".join(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])) for i, k, j, m in g)
        out.append((len(a), len(b), len(g), sum(held.values()), sum(n for p, n in held.items() if count[p] == most[p[0]]),
                    sum(n * count[p] for p, n in held.items()), hashlib.sha256(spelled.encode()).hexdigest() if a else ""))
    return out


def plain_rows(rows):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows)


@pytest.mark.parametrize("frequent", [alignment.FREQUENT_ROWS, 40, 0])
def test_alignment(spark, docs, frequent):
    rows = alignment.align(spark.read.parquet(f"{FOLDER}/documents.parquet").repartition(3), frequent_rows=frequent).collect()
    assert plain_rows(rows) == sorted((False, i, *found) for (i, _, _), found in zip(docs, brute_alignment([t for _, t, _ in docs])))


def test_alignment_odd(odd):
    want = sorted((i is None, i or 0, *found) for (i, _, _), found in zip(ODD, brute_alignment([t for _, t, _ in ODD])))
    assert plain_rows(alignment.align(odd).collect()) == want
    assert sum(1 for w in want if w[2] == 0) >= 5
    assert alignment.align(odd.limit(0)).collect() == []


def test_cuts_of_random_ends(monkeypatch):
    """Groups are the ranges between common ends, however far apart these are."""
    rng = np.random.default_rng(7)
    for probes in (1, 8):
        monkeypatch.setattr(alignment, "PROBES", probes)
        for _ in range(200):
            n = int(rng.integers(1, 300))
            share = rng.choice([0.02, 0.3, 0.95])
            a = np.flatnonzero(np.append(rng.random(n) < share, True)) + 1
            b = np.flatnonzero(np.append(rng.random(n) < rng.choice([0.02, 0.3]), True)) + 1
            one = lambda x: np.array([x])
            a0, a1, b0, b1 = alignment.shared_cuts(a, b, one(0), one(len(a)), one(0), one(len(b)))
            common = np.intersect1d(a, b)
            assert a[a1 - 1].tolist() == common.tolist() and b[b1 - 1].tolist() == common.tolist()
            assert a0.tolist() == [0, *a1[:-1]] and b0.tolist() == [0, *b1[:-1]]


def test_pairs_in_blocks(monkeypatch):
    codecs = TwoCodecs()
    texts = SIGNS + ["abcabc " * 40, "the cat the cat"]
    whole = alignment.Aligned(codecs, texts).merged_pairs()
    monkeypatch.setattr(alignment, "PAIR_BLOCK", 3)
    parts = alignment.Aligned(codecs, texts).merged_pairs()
    assert all((x == y).all() for x, y in zip(whole, parts))


# ---- collocations ---------------------------------------------------------------------------------------------------

def brute_phrases(rows, least=10, top=2000, shadow=50):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i:i + k])] += 1
    out = []
    for (lang, p), a in f.items():
        if len(p) == 1 or a < least:
            continue
        if len(p) == 2 and any(p in (q[:2], q[1:]) for (x, q), m in f.items() if x == lang and len(q) == 3 and m >= least and 100 * m >= shadow * a):
            continue
        score, _, left, right = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), left, right))
    ranked, rank = [], collections.Counter()
    for lang, score, a, phrase, left, right in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            ranked.append((lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return ranked


PHRASES = [("red apple pie. Red apple pie, red apple", "en"), ("a a a a a a", "en"), ("big data; BIG data\tbig   data", None), ("x y z x y z x y z", "en"),
           ("é é é é é é", "fr"), (None, "en"), ("", None), ("the cat! the cat? the cat: the dog the cat", "en"), (" \n ", "de"), ("x y z w x y z", ""),
           ("w" * 50 + " " + "w" * 51, "en")]


@pytest.mark.parametrize("least, top, shadow", [(2, 2000, 50), (1, 5, 80), (3, 2000, 101)])
def test_collocations_small(spark, monkeypatch, least, top, shadow):
    frame = spark.createDataFrame(PHRASES * 3, "text string, lang string").repartition(4)
    for name in ("id", "word", "n", "w1", "rank", "score", "phrase", "l"):
        frame = frame.withColumn(name, F.lit(name))
    found = phrases.collocations(frame, least=least, top=top, shadow=shadow).collect()
    assert sorted(tuple(r) for r in found) == sorted(brute_phrases(PHRASES * 3, least, top, shadow))
    assert phrases.collocations(frame.limit(0)).collect() == []


def test_trie_bursts_and_spills_whole_subtrees():
    rng = random.Random(11)
    for words, burst, most in ((2, 8, 60), (3, 8, 60), (3, 2, 10_000), (2, 10_000, 40)):
        trie, want, got = phrases.BurstTrie(words, burst, most), collections.Counter(), collections.Counter()
        ids = [2**64 - 1, 0, 1, 2] + [rng.getrandbits(64) for _ in range(40)]
        runs, leaves = [], 1
        for _ in range(60):
            some = np.array([[rng.choice(ids[:3] + ids) for _ in range(words)] for _ in range(30)], dtype=np.uint64)
            paths = [np.ascontiguousarray(some[:, k]) for k in range(words)]
            for row in some.tolist():
                want[tuple(row)] += 1
            trie.add(*phrases.merged(phrases.path_keys(paths), paths))
            assert trie.bounds == sorted(set(trie.bounds)) and trie.bounds[0] == 0
            leaves = max(leaves, len(trie.leaves))
            runs.append(list(trie.spill()))
            assert trie.held <= most
        runs.append(list(trie.spill(last=True)))
        assert trie.held == 0 and (leaves > 1) == (burst < 100)
        for run in runs:
            keys, roots = [], []
            for batch in run:
                columns = [c.to_numpy().view(np.uint64) for c in batch.columns]
                keys += phrases.path_keys(columns[:-1]).tolist()
                for *path, n in zip(*[c.tolist() for c in columns]):
                    got[tuple(path)] += n
            roots = [k >> 60 for k in keys]
            assert all(a <= b for a, b, x, y in zip(keys, keys[1:], roots, roots[1:]) if x == y)      # sorted within a subtree
            assert len(set(roots)) == sum(a != b for a, b in zip(roots, roots[1:])) + bool(roots)     # which leaves in one run
        assert got == want


def test_scores_beyond_64_bits(spark):
    cases = [(10**12, 10**12, 10**12), (10**12 - 1, 10**13 + 7, 10**12 + 9), (3, 7, 11), (999_999_999_999, 10**14, 10**14 + 1), (12, 144, 1)]
    frame = spark.createDataFrame(cases, "a long, l long, r long")
    got = [r.s for r in frame.select(phrases.cut_score(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()]
    assert got == [1_000_000 * a * a // (left * right) for a, left, right in cases]


def test_colliding_ids_change_the_seed(spark, monkeypatch):
    frame = spark.createDataFrame([("a b a b a b", "en")] * 4, "text string, lang string")
    monkeypatch.setattr(phrases, "count_words", lambda docs, text, lang, seed: spark.createDataFrame(
        [(1, "en", "a", 12), (1 if seed == phrases.SEEDS[0] else 2, "en", "b", 12)], "id long, lang string, word string, n long"))
    assert phrases.checked_words(frame, "text", "lang")[1] == phrases.SEEDS[1]
