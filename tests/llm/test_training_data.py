"""The training-data operators against brute force, and on odd inputs."""

import hashlib
import json
import random
import re
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from gleaner.llm import fingerprints, licenses, line_dedup, mixing, near_duplicates, packing, passages, quality_rules, sharding, token_counts, tokenization

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {i: chr(i + 32) for i in range(65, 91)}
CLASHING = ("_", "gone_lines", "gone_id", "own", "whole", "carry", "size", "path", "token", "id", "row", "line", "text_left", "rules", "takes", "_size", "words")


def vocabulary(n=400, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice("abdeilnorstuv") for _ in range(rng.randint(2, 9))) for _ in range(n)]


def corpus(n=120, seed=3):
    """Random prose with exact copies, near copies, shared passages and lines."""
    rng, words = random.Random(seed), vocabulary()
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared_line, passage = prose(9).capitalize() + ".", prose(70)
    out = []
    for k in range(n):
        lines = [prose(rng.randint(5, 40)) + "." for _ in range(rng.randint(1, 8))]
        if k % 7 == 0:
            lines.insert(rng.randint(0, len(lines)), shared_line)
        if k % 9 == 0:
            lines[0] += " " + passage + " " + prose(5)
        text = "\n".join(lines)
        if k % 11 == 1 and out:
            text = out[rng.randrange(len(out))]
        if k % 13 == 2 and out:
            w = out[rng.randrange(len(out))].split(" ")
            w[rng.randrange(len(w))] = "changed"
            text = " ".join(w)
        out.append(text)
    return out


def table(spark, texts, ids=None, source=lambda k: f"s{k % 3}"):
    rows = [(k if ids is None else ids[k], t, "en", source(k), len(t or ""), *[f"x{k}"] * len(CLASHING)) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING))


@pytest.fixture(scope="module")
def texts():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return table(spark, texts).repartition(3).cache()


ODD = ["", None, " \n\t ", "one", "a b c d", "\n\nx\n\n", "Ünïcödé 漢字 😀 <|endoftext|> ~ it's 42!!", "the " * 300, "word" * 20_000, "same text here", "same text here", "K cc by Kelvin", "\x00\x1c\x85\xa0"]


@pytest.fixture(scope="module")
def odd(spark):
    ids = [*range(len(ODD) - 3), None, None, 3]
    return table(spark, ODD, ids, lambda k: None if k % 4 == 0 else f"s{k % 2}")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, 0) for k in range(40)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "pack": lambda d, _: packing.pack(d), "mix": lambda d, _: mixing.mix(d, d.columns), "rules": lambda d, x: quality_rules.judged(d, x, d.columns, "rules_"), "licenses": lambda d, _: licenses.scan(d),
    "tokens": lambda d, _: token_counts.count_tokens(d), "shard": lambda d, _: sharding.shard(d, 3), "near": lambda d, _: near_duplicates.near_duplicates(d), "passages": lambda d, _: passages.repeated_passages(d),
    "lines": lambda d, _: line_dedup.without_repeats(d), "fingerprints": lambda d, _: fingerprints.fingerprints(d),
}
ONE_EACH = {"mix", "rules", "licenses", "tokens", "shard", "near", "fingerprints"}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_and_empty_tables(spark, odd, labels, name):
    n = OPERATORS[name](odd, labels).count()
    assert n == len(ODD) or name not in ONE_EACH
    assert OPERATORS[name](odd.limit(0), labels.limit(0)).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))


def test_token_counts_equal_the_library(docs, odd, texts, tokenizer):
    for d, plain in ((docs, texts), (odd, ODD)):
        want = sorted((len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for t in plain)
        assert sorted((r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(d).collect()) == want


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_other_tokenizers_take_whole_texts(docs, texts, name):
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, tokenizer=name).collect()}
    if name.endswith(".json"):
        want = [len(Tokenizer.from_file(str(public_tokenizers.path(name))).encode(t, add_special_tokens=False).ids) for t in texts]
    else:
        import sentencepiece

        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path(name))).encode(texts)]
    assert [got[k] for k in range(len(texts))] == want


def test_which_tokenizers_encode_words_alone():
    rules = lambda name: json.loads(Path(public_tokenizers.path(name)).read_text())
    word = rules("word_bpe_49k.json")
    assert tokenization.words_alone(word) and not tokenization.words_alone(rules("byte_bpe_50k.json"))
    blank = {**word, "added_tokens": [{"content": "a b"}]}
    cased = {**word, "normalizer": {"type": "NFC"}}
    spaced = json.loads(json.dumps(word).replace("[^\\\\s", "[^"))
    assert spaced != word and not any(map(tokenization.words_alone, (blank, cased, spaced, {})))


@pytest.mark.parametrize(("window", "most_open"), [(64, 1 << 22), (64, 500), (2048, 1 << 22)])
def test_packing_is_an_exact_cut(docs, texts, tokenizer, window, most_open):
    rows = packing.pack(docs, window=window, most_open=most_open).collect()
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_window[r.sequence_id].append(r)
    for k, t in enumerate(texts):
        ids, at = [*tokenizer.encode(t, add_special_tokens=False).ids, 1], 0
        for r in sorted(by_doc[k], key=lambda r: r.start):
            part = b"".join(i.to_bytes(4, "little") for i in ids[r.start : r.start + r.length])
            assert r.start == at and r.ids_crc32 == zlib.crc32(part) and r.doc_tokens == len(ids)
            at += r.length
        assert at == len(ids)
    fill = []
    for found in by_window.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        fill.append(at)
    assert max(fill) <= window and sum(f < window for f in fill) <= docs.rdd.getNumPartitions()


def test_level_choice_minimises_the_sum_of_squares():
    rng, packer = random.Random(5), packing.LevelPacker(32, 1 << 22)
    for k in range(400):
        size, counts = rng.randint(1, 31), packer.count.copy()

        def after(h, size=size, counts=counts):
            c = counts.copy()
            c[h] -= h > 0
            c[h + size] += h + size < 32
            return int((c**2).sum())

        allowed = [h for h in range(33 - size) if h == 0 or counts[h]]
        assert after(packer.level(size)) == min(map(after, allowed))
        list(packer.add((k, 0, b"\0\0\0\0" * size, size), size))


def fill_targets(size):
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    left, free, out = 1.5 * sum(size.values()), set(size), {}
    while over := [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * size[s]]:
        for s in over:
            out[s] = 2.0 * size[s]
            left -= out[s]
            free.discard(s)
    return out | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}


@pytest.mark.parametrize("which", ["plain", "hot", "odd"])
def test_mixing_meets_its_targets(spark, texts, odd, which):
    d = {"plain": lambda: table(spark, texts), "hot": lambda: table(spark, texts, source=lambda k: "s0" if k % 3 else f"t{k % 5}"), "odd": lambda: odd}[which]()
    rows = mixing.mix(d).select("id", "source", "size", "source_size", "target", mixing.taken_words().alias("taken")).collect()
    size, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        size[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    want = fill_targets(size)
    assert all(abs(r.target - want[r.source]) < 1e-6 and r.source_size == size[r.source] for r in rows)
    assert all(abs(taken[s] - want[s]) < 1 for s in size)
    again = mixing.mix(d).select("id", "size", mixing.taken_words().alias("taken")).collect()
    assert sorted((str(r.id), r.size, r.taken) for r in again) == sorted((str(r.id), r.size, r.taken) for r in rows)


def test_mixing_tree(spark, texts):
    """Every place of the quota goes to one shard, shards are of equal size, and over seeds each source's share of a shard spreads as draws without replacement do."""
    from collections import Counter

    d = table(spark, texts, source=lambda k: f"s{k % 2}")
    rows = mixing.mix(d, levels=3).selectExpr("id", "explode(takes) t").selectExpr("id", "t.shard", "t.pass", "t.shuffle_key", "t.taken").collect()
    assert set(r.shard for r in rows) <= set(range(8)) and len({r.shuffle_key for r in rows}) == len(rows) == len({(r.id, r["pass"]) for r in rows})
    places = spark.createDataFrame([(s, k) for s, n in ((1, 90), (2, 54)) for k in range(n)], "source_place int, k int").cache()
    counts = []
    for seed in range(12):
        split = mixing.split_quotas(places, 3, f"seed{seed}").collect()
        assert len({(r.source_place, r.k) for r in split}) == len(split) == 144 and set(Counter(r.shard for r in split).values()) == {18}
        by = Counter((r.shard, r.source_place) for r in split)
        counts += [by[s, 2] for s in range(8)]
    mean, spread = 18 * 54 / 144, 18 * (54 / 144) * (90 / 144) * (144 - 18) / 143
    assert abs(sum(counts) / len(counts) - mean) < 1e-9 and 0.6 * spread < sum((c - mean) ** 2 for c in counts) / len(counts) < 1.5 * spread
    assert sum(r.taken for r in rows) == sum(r.taken for r in mixing.mix(d, levels=0).select(mixing.taken_words().alias("taken")).collect())


def test_mixing_carries_any_column(spark, texts):
    d = table(spark, texts[:30])
    rows = mixing.mix(d, d.columns).select("carry.*").collect()
    assert sorted(tuple(r[c] for c in d.columns) for r in rows) == sorted(map(tuple, d.collect()))


def counted(t):
    w, seen, cover = WORD.findall(t), defaultdict(list), set()
    for k in range(len(w) - 4):
        seen[tuple(w[k : k + 5])].append(k)
    for at in seen.values():
        if len(at) > 1:
            cover.update(p for k in at for p in range(k, k + 5))
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)


def test_statistics_equal_brute_force(spark, texts, odd, labels):
    more = [*texts[:20], "a b c d e " * 30, "x x x x x x x x", "p q r s t u p q r s t", "l one\nl one\n \n \nl one"]
    for d, plain in ((table(spark, more), more), (odd, ODD)):
        rows = quality_rules.judged(d, labels, ["doc_id"], "q").select("q.*", "q_base_failed", "q_kept").collect()
        assert sorted(tuple(r[c] for c in quality_rules.BASE) for r in rows) == sorted(counted(t or "") for t in plain)
        for r in rows:
            assert r.q_base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.q_kept and r.q_base_failed)


def test_rules_are_learned_and_hold_out(spark):
    """Junk in symbols or capitals is told from prose on documents without labels."""
    rng, words = random.Random(2), vocabulary()
    rows = []
    for k in range(600):
        kind, w = rng.choice(["good", "good", "symbols", "capitals"]), [rng.choice(words) for _ in range(rng.randint(20, 60))]
        w = [x + rng.choice(["$$$", "***"]) for x in w] if kind == "symbols" else [x.upper() + "!!" for x in w] if kind == "capitals" else w
        rows.append((k, " ".join(w), kind == "good"))
    d = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(good)) for k, _, good in rows[:300]], "doc_id long, quality int")
    kept = {r.doc_id for r in quality_rules.judged(d, labels, ["doc_id"], "q").where("q_kept").collect()}
    held = [(k in kept) == good for k, _, good in rows[300:]]
    assert sum(held) >= 0.95 * len(held) and sum(k not in kept for k, _, good in rows if good) <= 0.02 * len(rows)


def test_first_literal_has_the_largest_gain(spark):
    """The literal that a rule begins with, against all thresholds at quantiles of all features, counted plainly."""
    from math import ceil, log2

    rng = random.Random(9)
    rows = [(rng.random() < 0.4, rng.randrange(3), rng.random(), rng.random()) for _ in range(300)]
    rows = [(bad, fold, round(x + bad * (0.6 if rng.random() < 0.9 else 0), 3), y) for bad, fold, x, y in rows]
    train = spark.createDataFrame(rows, "bad boolean, fold int, x double, y double")
    (first, *_), *_ = quality_rules.learn(train, ["x", "y"], bins=16, least_precision=0.8)
    grown, gains = [r for r in rows if r[1] != 0], {}
    share = sum(r[0] for r in grown) / len(grown)
    for at, name in ((2, "x"), (3, "y")):
        values = sorted(r[at] for r in rows)
        for t in {values[ceil(k / 16 * len(rows)) - 1] for k in range(1, 16)}:
            for above in (False, True):
                held = [r[0] for r in grown if (r[at] > t) == above]
                if sum(held) >= 5:
                    gains[name, above, t] = sum(held) * (log2(sum(held) / len(held)) - log2(share))
    assert gains[first.feature, first.above, first.threshold] == max(gains.values())


def test_labels_that_repeat_or_conflict(spark, texts):
    labels = spark.createDataFrame([(k % 20, k % 2, 0) for k in range(60)] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    assert quality_rules.judged(table(spark, texts), labels, ["doc_id"], "q").count() == len(texts)


def test_licences(spark):
    plain = [
        "All rights reserved. all RIGHTS reserved", "Licensed under CC BY-NC 4.0.", "Released under the MIT License.", "GNU General Public License, version 3", "nothing here",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "by cc by", "the mit of license", "ALL rights reserved cc by", None, "Kcc by",
    ]
    rows = {r.doc_id: r for r in licenses.scan(table(spark, plain)).collect()}
    for k, t in enumerate(plain):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOW))
        at = [(i, label) for phrase, label, _ in licenses.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        r = rows[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(at, default=[None])[0], max(at, default=[None])[0])
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert [rows[k].labels for k in (1, 2, 3, 4, 5, 7)] == ["cc-by,cc-by-nc", "mit", "gpl,gpl-3.0", "", "mit", ""]
    assert rows[4].score == 0 and rows[2].score == 1 and 0 < rows[5].score <= 1


def test_licence_postings_agree_on_a_start(spark):
    """A label needs two of the template's rarest words at their places and its key phrase; words elsewhere don't count, long templates do."""
    t = licenses.Template("own", "alpha beta " + " ".join(f"w{k}" for k in range(60)) + " gamma delta", "gamma delta")
    base = " ".join(f"w{k}" for k in range(60))
    plain = [f"x alpha beta {base} gamma delta y", f"alpha beta {base} gamma", "gamma delta", f"alpha alpha beta {base} gamma delta", "delta gamma", f"{base} gamma delta", f"alpha beta {base} q gamma delta"]
    scan = lambda most, agree: {r.doc_id: r for r in licenses.scan(table(spark, plain), (t,), most=most, agree=agree).collect()}
    rows = scan(64, 40)
    assert {k for k in rows if rows[k].labels == "own"} == {0, 3, 5} and rows[0].score == 1 == rows[3].score and rows[5].score == 62 / 64
    assert {k for k, r in scan(64, 2).items() if r.labels == "own"} == {0, 2, 3, 5, 6} and not any(r.labels for r in scan(64, 65).values() if r.doc_id in (1, 4))


@pytest.mark.parametrize("rows", [0, 1, 5, 120])
def test_shards_are_exact_and_uniform(spark, texts, rows):
    got = sharding.shard(table(spark, texts[:rows]), shards=7, block_rows=16).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
        assert r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
    sizes = [len(by[s]) for s in range(7)]
    assert sum(sizes) == rows and max(sizes) - min(sizes) <= 1 and all(sorted(x) == list(range(len(x))) for x in by.values())


def test_draws_follow_the_hypergeometric_law():
    from math import comb

    for good, bad, n in ((50, 70, 30), (5, 5, 5), (1, 100, 50), (1000, 20, 1015)):
        low, chances = sharding._chances(good, bad, n)
        for k in range(max(0, n - bad), min(good, n) + 1):
            assert abs(chances[k - low] - comb(good, k) * comb(bad, n - k) / comb(good + bad, n)) < 1e-12
    rng = __import__("numpy").random.default_rng(1)
    got = [sharding._draw(rng, 10**10, 15 * 10**10, 4 * 10**6) for _ in range(300)]
    mean, spread = 250_000, 250_000 * 15 / 16
    assert abs(sum(got) / 300 - mean) < 4 * (spread / 300) ** 0.5 and 0.75 < sum((x - mean) ** 2 for x in got) / 300 / spread < 1.3


def test_rows_spread_uniformly_over_shards_and_slots(spark, texts):
    """Over seeds each row is in each shard, and in the front half of its shard, about equally often."""
    shard, front = defaultdict(int), 0
    d = table(spark, texts[:48]).cache()
    for seed in range(16):
        for r in sharding.shard(d, shards=4, seed=seed, block_rows=8).collect():
            shard[r.doc_id % 4, r.shard] += 1
            front += r.slot < 6
    assert len(shard) == 16 and all(24 <= n <= 72 for n in shard.values()) and front == 16 * 24
    assert sum((n - 48) ** 2 / 48 for n in shard.values()) < 40


def test_matrix_has_exact_margins():
    m = sharding.communication_matrix([10, 0, 3, 999], 16)
    assert m.sum(axis=1).tolist() == [10, 0, 3, 999] and m.sum(axis=0).max() - m.sum(axis=0).min() <= 1 and m.min() >= 0
    big = sharding.communication_matrix([3 * 10**9, 10**9], 2)
    assert big.sum(axis=1).tolist() == [3 * 10**9, 10**9] and big.sum(axis=0).tolist() == [2 * 10**9] * 2


def shingle_set(t, span):
    w = WORD.findall((t or "").translate(LOW))
    return frozenset(tuple(w[k : k + span]) for k in range(max(1, len(w) - span + 1))) if w else frozenset()


@pytest.mark.parametrize("seed", [3, 4])
@pytest.mark.parametrize("span", [4, 5])
def test_components_equal_brute_force(spark, seed, span):
    plain = corpus(seed=seed)
    base = corpus(3, seed=9)[2] + " " + " ".join(vocabulary(120, 8))
    rng = random.Random(seed)
    for _ in range(150):  # more than a leaf holds, all alike
        w = base.split(" ")
        w[rng.randrange(len(w))] = rng.choice(vocabulary())
        plain.append(" ".join(w))
    sets, root = [shingle_set(t, span) for t in plain], list(range(len(plain)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(plain)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: r for r in near_duplicates.near_duplicates(table(spark, plain), span=span).collect()}
    for k in range(len(plain)):
        assert (got[k].n_shingles, got[k].component_id, got[k].kept) == (len(sets[k]), find(k), find(k) == k)


def test_nodes_beyond_a_leaf_are_whole(spark, monkeypatch):
    """With leaves of 4 and trees of depth 2 the nodes at full depth are large; no link is lost."""
    monkeypatch.setattr(near_duplicates, "LEAF", 4)
    test_components_equal_brute_force(spark, 3, 4)


@pytest.mark.parametrize(("leaf", "tile", "depth"), [(100, 256, 8), (8, 4, 3)])
def test_graded_copies_of_one_text(spark, monkeypatch, leaf, tile, depth):
    """A large group in which many sets are near the threshold, some below it: components as by brute force, and no more rows of tiles than parts need."""
    for k, v in {"LEAF": leaf, "TILE": tile, "DEPTH": depth}.items():
        monkeypatch.setattr(near_duplicates, k, v)
    rng, words = random.Random(4), vocabulary(2000, 5)
    text = [rng.choice(words) for _ in range(120)]
    plain = []
    for k in range(160):
        w = list(text)
        for at in rng.sample(range(120), rng.choice([0, 1, 2, 3, 5, 8, 12])):
            w[at] = f"new{k}x{at}"
        plain.append(" ".join(w))
    sets, root = [shingle_set(t, 5) for t in plain], list(range(160))
    top = lambda x: x if root[x] == x else top(root[x])
    for a in range(160):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * len(sets[a] | sets[b]):
                root[max(top(a), top(b))] = min(top(a), top(b))
    got = {r.doc_id: r for r in near_duplicates.near_duplicates(table(spark, plain)).collect()}
    assert {k: r.component_id for k, r in got.items()} == {k: top(k) for k in range(160)}
    assert all(r.kept == (k == r.component_id) and r.n_shingles == len(sets[k]) for k, r in got.items()) and len({r.component_id for r in got.values()}) > 10


def test_passages_are_found_whole(spark, texts):
    found = defaultdict(list)
    for r in passages.repeated_passages(table(spark, texts)).collect():
        found[r.doc_id].append((r.start_word, r.start_word + r.n_words))
    words, at = [WORD.findall(t.translate(LOW)) for t in texts], defaultdict(set)
    for k, w in enumerate(words):
        for i in range(len(w) - 49):
            at[tuple(w[i : i + 50])].add((k, i))
    repeated = {p for places in at.values() if len({k for k, _ in places}) > 1 for p in places}
    # a window that only two documents share may reach a few words beyond the passage that they share with others
    covered = lambda k, i: max((min(b, i + 50) - max(a, i) for a, b in found[k]), default=0)
    assert repeated and all(covered(k, i) >= 40 for k, i in repeated) and sum(covered(k, i) == 50 for k, i in repeated) >= 0.99 * len(repeated)
    near = {k for k, _ in repeated}
    alike = {k for k in range(len(texts)) if any(j != k and len(shingle_set(texts[j], 5) & shingle_set(texts[k], 5)) >= 30 for j in range(len(texts)))}
    assert set(found) <= near | alike


def test_passages_of_common_lines_are_found(spark):
    rng, words = random.Random(8), iter(f"w{k}" for k in range(10**6))
    some = lambda n: [next(words) for _ in range(n)]
    texts = []
    for _ in range(6):
        lines = [some(20) for _ in range(3)]
        passage = [x for line in lines for x in line]
        # many documents hold one line of the passage, before and after the two that hold all of it, one of these after a part of it
        held = [some(40) + rng.choice(lines) + some(40) for _ in range(60)]
        held[20:20] = [some(30) + passage + some(30), some(20) + passage[:30] + some(40) + passage + some(20)]
        texts.append(held)
    flat, want = [], []
    for held in texts:
        want += [(len(flat) + 20, 30), (len(flat) + 21, 90)]
        flat += [" ".join(x) for x in held]
    got = {(r.doc_id, r.start_word, r.n_words) for r in passages.repeated_passages(table(spark, flat)).collect()}
    assert got == {(doc, at, 60) for doc, at in want}


def test_recall_of_variants(spark):
    """Passages of 52 to 200 words in which words are put in, left out or changed, at a five-word similarity of 0.8 or more: nine of ten are found, and nothing else is."""
    rng, words = random.Random(12), [f"v{k}" for k in range(4000)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    shset = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    stock, plain, held = [prose(20) for _ in range(2)], [], defaultdict(int)
    kinds = ("put in", "left out", "changed")
    for k in range(240):
        kind, n = kinds[k % 3], rng.choice([52, 60, 75, 90, 120, 200])
        p = stock[0] + prose(n - 40) + stock[1] if k % 4 == 0 else prose(n)
        v = list(p)
        while True:
            w, at = list(v), rng.randrange(2, len(v) - 2)
            w[at : at + (kind != "put in")] = [] if kind == "left out" else [f"own{rng.random()}"]
            if len(shset(p) & shset(w)) < 0.8 * len(shset(p) | shset(w)) or len(w) < 50:
                break
            v = w
            if rng.random() < 0.4:
                break
        plain += [" ".join(prose(rng.randrange(20, 80)) + x + prose(rng.randrange(20, 80))) for x in (p, v)]
    plain += [" ".join(prose(150)) for _ in range(100)]
    found = {r.doc_id: r.cluster_id for r in passages.repeated_passages(table(spark, plain)).collect()}
    for k in range(240):
        held[kinds[k % 3]] += found.get(2 * k) == found.get(2 * k + 1) is not None
    assert all(n >= 0.9 * 80 for n in held.values()), dict(held)
    assert not [k for k in found if k >= 480]


def test_copies_of_a_whole_text_are_passages(spark):
    words = [f"z{k}" for k in range(200)]
    plain = [" ".join(words[:80]), " ".join(words[:80]), " ".join(words[80:140]), " ".join(words[:40]), " ".join(words[:40]), None]
    rows = sorted((r.doc_id, r.start_word, r.n_words, r.cluster_id, r.kept) for r in passages.repeated_passages(table(spark, plain)).collect())
    assert rows == [(0, 0, 80, 0, True), (1, 0, 80, 0, False)]


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return len(b) - len(a) <= 1 and (a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :])


def test_lines_equal_brute_force(spark, texts):
    rng, plain = random.Random(6), list(texts)
    for k in range(40):  # lines one edit apart, short and long
        x = rng.choice(plain[rng.randrange(len(texts))].split("\n")) * rng.choice([1, 1, 12])
        i, c = rng.randrange(len(x) + 1), rng.choice("qé ")
        plain.append("\n".join([rng.choice([x[:i] + c + x[i:], x[:i] + x[i + 1 :], x[:i] + c + x[i + 1 :]]), "Short.", f"Shor{k}."]))
    first, places = {}, []
    for k, t in enumerate(plain):
        for i, x in enumerate(t.split("\n")):
            if WORD.search(x):
                first.setdefault(x, (k, i))
                places.append((k, i, x))
    near, stay = {}, []
    for x in sorted(first, key=first.get):  # a line is dropped for a line that stays, never for a dropped one
        near[x] = min((first[y] for y in stay if min(len(x), len(y)) >= line_dedup.LEAST and one_edit(x, y)), default=None)
        if near[x] is None:
            stay.append(x)
    want = {(k, i): ((near[x] or first[x]), int(near[x] is not None)) for k, i, x in places if (near[x] or first[x]) != (k, i)}
    got = {(r.doc_id, r.line_no): ((r.kept_doc_id, r.kept_line_no), r.edits) for r in line_dedup.dropped(table(spark, plain)).collect()}
    assert got == want and any(v[1] for v in want.values())
    left = {r.doc_id: r for r in line_dedup.without_repeats(table(spark, plain)).collect()}
    for k, t in enumerate(plain):
        kept = "\n".join(x for i, x in enumerate(t.split("\n")) if (k, i) not in want)
        assert (left[k].text == kept and left[k].n_chars == len(kept)) if WORD.search(kept) else k not in left


def test_no_line_is_dropped_for_a_dropped_line(spark):
    x = "the quick brown fox jumps over it"
    chain = [x, x + "1", x + "12", x + "123", "the quikc brown fox", x + "12"]
    got = {r.doc_id: (r.kept_doc_id, r.edits) for r in line_dedup.dropped(table(spark, chain)).collect()}
    assert got == {1: (0, 1), 3: (2, 1), 5: (2, 0)}
    rows = {r.doc_id: r for r in line_dedup.without_repeats(table(spark, chain)).collect()}
    assert set(rows) == {0, 2, 4} and all(rows[k].text == chain[k] and all(rows[k][c] == f"x{k}" for c in CLASHING) for k in rows)


def test_rows_of_one_id_lose_their_own_lines(spark):
    texts = ["aa\nbb", "cc\naa", "dd\nee", "dd\nee", "ff\ngg", "hh\nff", "ii\njj", "ii\njj", "", "", "kk\nll", "kk\nll\nmm"]
    ids = [None, None, None, None, 7, 7, 8, 8, None, None, None, 9]
    left = [(r.doc_id, r.text) for r in line_dedup.without_repeats(table(spark, texts, ids)).collect()]
    lines_left = lambda i: sorted(x for d, t in left if d == i for x in t.split("\n"))
    # of rows that differ each line stays once, equal rows of an id share each decision, and rows without a word stay
    assert lines_left(None) == ["", "", *"aa bb cc dd ee kk ll".split()] and lines_left(7) == ["ff", "gg", "hh"] and lines_left(8) == ["ii", "ii", "jj", "jj"] and lines_left(9) == ["mm"]
    same = spark.createDataFrame([(None, "x y\nz"), (None, "x y\nz"), (None, " "), (None, " ")], "doc_id long, text string")
    assert sorted(r.text for r in line_dedup.without_repeats(same).collect()) == [" ", " ", "x y\nz"]


def piecewise(raw, least=32, most=128):
    """Context-triggered piecewise hashing, byte by byte."""
    letters, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", (1 << 32) - 1
    rolling = []
    for i in range(len(raw)):
        x = sum(raw[i - k] * pow(0x01000193, k + 1, 1 << 32) for k in range(min(7, i + 1))) & low
        x ^= x >> 15
        x = x * 0x2C1B3C6D & low
        rolling.append(x ^ (x >> 13))
    ends = lambda b: [i + 1 for i, x in enumerate(rolling) if x % b == b - 1]
    block = 3
    while raw and len(ends(2 * block)) >= least:
        block *= 2

    def signature(b):
        cuts = ends(b)[: most - 1]
        cuts += [len(raw)] if not cuts or cuts[-1] != len(raw) else []
        return "".join(letters[zlib.crc32(raw[a:z]) >> 26] for a, z in zip([0, *cuts], cuts)) if raw else ""

    return f"{block}:{signature(block)}:{signature(2 * block)}"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def alike(a, b):
    if a == b:
        return 1.0
    (k, *x), (m, *y) = a.split(":"), b.split(":")
    if a == "3::" or b == "3::":
        return 0.0
    like = lambda p, q: 1 - edits(p, q) / max(len(p), len(q)) if p or q else 1.0
    if k == m:
        return max(like(x[0], y[0]), like(x[1], y[1]))
    return like(x[0], y[1]) if int(k) == 2 * int(m) else like(x[1], y[0]) if int(m) == 2 * int(k) else 0.0


PERIODIC = ["ab" * 20_000, "the " * 9_000, "abc" * 9_000, "a" * 5_000, "", "x"]


def test_fingerprints(spark, texts):
    plain = [*texts[:60], *PERIODIC]
    rows = {r.doc_id: r for r in fingerprints.fingerprints(table(spark, plain).repartition(5)).collect()}
    for k, t in enumerate(plain):
        after, cut = plain[(k + 1) % len(plain)], len(t) // 4
        changed = (t[: len(t) - cut] + after[:cut]).encode()
        mine, other, following = piecewise(t.encode()), piecewise(changed), piecewise(after.encode())
        assert (rows[k].n_chars, rows[k].edited_sha256, rows[k].fingerprint, rows[k].edited_fingerprint) == (len(t), hashlib.sha256(changed).hexdigest(), mine, other)
        assert abs(rows[k].near_edited - alike(mine, other)) < 1e-9 and abs(rows[k].near_next - alike(mine, following)) < 1e-9
        assert len(mine) < 300
    long = [k for k, t in enumerate(plain[:60]) if len(t) > 400]
    mean = lambda c: sum(rows[k][c] for k in long) / len(long)
    assert mean("near_edited") > 0.6 and mean("near_next") < 0.2
    only = fingerprints.fingerprints(table(spark, ["only one text"])).first()
    assert only.near_next == 1.0


def test_fingerprints_of_rows_without_ids(spark, odd, texts):
    assert len({r.fingerprint for r in fingerprints.fingerprints(odd).collect()}) < len(ODD)
    many = table(spark, [*texts[:40], *["same"] * 20], [None] * 60)
    rows = fingerprints.fingerprints(many.repartition(6)).collect()
    assert sorted(r.fingerprint for r in rows) == sorted(fingerprints.fingerprint(t.encode()) for t in [*texts[:40], *["same"] * 20]) and sum(r.near_next == 1 for r in rows) >= 19


@pytest.mark.parametrize("which", ["odd", "empty", "repeated"])
def test_pipeline_on_odd_tables(spark, odd, labels, texts, tmp_path, which):
    """Every stage runs on what the one before left, whatever the rows, and keeps the columns with their values."""
    d = str(tmp_path)
    one = {"odd": lambda: odd, "empty": lambda: odd.limit(0), "repeated": lambda: table(spark, [*texts[:20], *texts[:20]], [*range(20), *[None] * 10, *range(10, 20)])}[which]()
    one.write.parquet(f"{d}/documents.parquet")
    labels.write.parquet(f"{d}/labels.parquet")
    now = spark.read.parquet(f"{d}/documents.parquet")
    given = {r.x for r in now.select(F.col("row").alias("x")).collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, now, d).write.parquet(f"{d}/{k}")
        after = spark.read.parquet(f"{d}/{k}")
        assert after.columns == now.columns and {r.x for r in after.select(F.col("row").alias("x")).collect()} <= given
        assert all(len({r[c] for c in CLASHING}) == 1 for r in after.collect())
        now = after
    last = corpus_pipeline.STAGES[-1][1](spark, now, d).collect()
    assert len(last) >= now.count()


def test_pipeline_stages(spark, texts, tmp_path):
    d = str(tmp_path)
    table(spark, texts).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    now = spark.read.parquet(f"{d}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, d)
        out.write.parquet(f"{d}/{k}")
        after = spark.read.parquet(f"{d}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == now.columns
            assert name != "quality_rules" or {r.doc_id for r in after.collect()} == {k for k, t in enumerate(texts) if counted(t)[0] >= 10 and 100 * counted(t)[4] <= 20 * counted(t)[0]}
            now = after
    tokens = {r.sequence_id: 0 for r in after.collect()}
    assert tokens and corpus_pipeline.run(spark, d).count() == after.count()


@pytest.mark.parametrize("rounds", [0, 3])
def test_rulers_of_growing_length_are_settled_at_once(spark, rounds, monkeypatch):
    """A chain of 120 lines, each within one edit of the next only: every second one stays, in a few rounds."""
    monkeypatch.setattr(line_dedup, "ROUNDS", rounds or 1)
    rulers = ["-" * n + "=x" for n in range(20, 140)]
    random.Random(4).shuffle(rulers)
    order = sorted(range(len(rulers)), key=lambda k: len(rulers[k]))
    kept: set[int] = set()
    near = {order[k]: [order[j] for j in (k - 1, k + 1) if 0 <= j < len(order)] for k in range(len(order))}
    for k in range(len(rulers)):
        if not kept & set(near[k]):
            kept.add(k)
    rows = line_dedup.dropped(table(spark, ["\n".join(rulers), "one other line of some length"])).collect()
    assert {r.line_no for r in rows} == set(range(len(rulers))) - kept
    assert all(r.kept_line_no == min(j for j in near[r.line_no] if j in kept and j < r.line_no) for r in rows)


def test_large_components_go_on_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "MOST_MEETINGS", 10)
    monkeypatch.setattr(line_dedup, "ROUNDS", 1)
    lines = ["-" * n + "=x" for n in range(20, 26)]
    assert sorted(r.line_no for r in line_dedup.dropped(table(spark, ["\n".join(lines)])).collect()) == [1, 3, 5]


@pytest.mark.parametrize("size", [10, 30, 120])
def test_groups_of_variants_are_one_cluster(spark, size):
    """A passage of 60 words and variants with one word changed (0.84 like it, mostly under 0.8 like each other), each in prose of its own."""
    rng = random.Random(size)
    words = lambda k: ["".join(rng.choice("abdeilnorstuv") for _ in range(rng.randint(3, 9))) for _ in range(k)]
    base, texts = words(60), []
    for v in range(size + 1):
        p = list(base)
        if v:
            p[rng.randrange(5, 55)] = words(1)[0]
        texts.append(" ".join([*words(rng.randint(20, 80)), *p, *words(rng.randint(20, 80))]))
    rng.shuffle(texts)
    rows = passages.repeated_passages(table(spark, texts)).collect()
    clusters = defaultdict(set)
    for r in rows:
        clusters[r.cluster_id].add(r.doc_id)
    assert max(map(len, clusters.values())) >= 0.9 * len(texts)


def test_spanning_trees_link_what_any_pairs_link():
    """At every threshold the tree's edges make the components that all pairs make."""
    rng = random.Random(3)
    for _ in range(20):
        members = [np.unique([rng.randrange(60) for _ in range(rng.randint(10, 60))]).astype(np.uint64) for _ in range(rng.randint(2, 25))]
        shared = lambda a, b, m=members: len(set(m[a].tolist()) & set(m[b].tolist()))
        edges = passages.spanning(members)
        for least in range(passages.PARAGRAPH, 60, 3):

            def parts(pairs, n=len(members), least=least, shared=shared):
                of = list(range(n))
                for a, b in pairs:
                    if shared(a, b) >= least:
                        x, y = of[a], of[b]
                        of = [x if o == y else o for o in of]
                return {frozenset(k for k in range(n) if of[k] == o) for o in of}

            assert parts(edges) == parts([(a, b) for a in range(len(members)) for b in range(a)])


def test_crowds_are_compared_whole(spark, monkeypatch):
    """Of a passage's variants that few or none of their like stand beside: in crowds no link is lost, whatever the size of groups and blocks."""
    rng = np.random.default_rng(11)
    words = [f"w{k}" for k in range(4000)]
    texts = []
    for base in range(3):  # three passages share their middle, so all meet in the same pairs of tokens
        passage = [*rng.choice(words, 40).tolist(), *[f"m{k}" for k in range(40)], *rng.choice(words, 40).tolist()]
        for _ in range(12):
            variant = list(passage)
            for at in (*rng.choice(38, 2), *(80 + rng.choice(38, 2))):
                variant[at] = f"x{rng.integers(1 << 30)}"
            texts.append(" ".join([*rng.choice(words, 60).tolist(), *variant, *rng.choice(words, 60).tolist()]))
    def clusters():
        return {r.doc_id: r.cluster_id for r in passages.repeated_passages(table(spark, texts)).collect()}

    whole = clusters()
    monkeypatch.setattr(passages, "GROUP", 10)
    monkeypatch.setattr(passages, "BLOCK", 5)
    monkeypatch.setattr(passages, "MERGED", 3)
    assert len(whole) == 36 and clusters() == whole


def test_trees_of_blocks_stand_for_all_pairs():
    rng = np.random.default_rng(5)
    members = [np.unique(rng.choice(300, rng.integers(40, 120))).astype(np.uint64) for _ in range(30)]
    edges = []
    for i in range(0, 30, 10):
        for j in range(i, 30, 10):
            at = [*range(i, i + 10), *([] if i == j else range(j, j + 10))]
            edges += [(at[a], at[b], n) for a, b, n in passages.weighed([members[k] for k in at], 0 if i == j else 10)]
    x, y, n = (np.array(c) for c in zip(*edges, strict=True))
    kept = passages.one_tree(x, y, n)
    assert sorted(n[kept].tolist()) == sorted(e[2] for e in passages.weighed(members))


def _union(pairs):
    to = {x: x for p in pairs for x in p}

    def top(x):
        while to[x] != x:
            x = to[x]
        return x

    for a, b in pairs:
        p, q = sorted((top(a), top(b)))
        to[q] = p
    return {x: top(x) for x in to}


def _jobs(spark, work):
    """How many jobs of Spark work() runs, and what it gives."""
    spark.sparkContext.setJobGroup(group := f"jobs-{id(work)}", "")
    out = work()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)), out


@pytest.mark.parametrize("at_once", [1 << 18, 0])
def test_few_edges_are_joined_in_one_task(spark, monkeypatch, at_once):
    """A path, a star and random edges: one round whatever the shape where edges are few, the same components in rounds."""
    from gleaner.llm import components as module

    monkeypatch.setattr(module, "AT_ONCE", at_once)
    rng = np.random.default_rng(3)
    pairs = [(k, k + 1) for k in range(100, 160)] + [(900, k) for k in range(901, 940)] + [(int(a), int(b)) for a, b in rng.integers(2000, 2100, (60, 2))] + [(5, 5)]
    rng.shuffle(pairs)
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in pairs], "a long, b long")
    jobs, got = _jobs(spark, lambda: {r.node: r.root for r in module.components(edges).collect()})
    assert got == _union([(a, b) for a, b in pairs if a != b])
    assert jobs <= 8 or not at_once
    assert module.components(edges.where("a < 0")).collect() == []


def test_levels_of_trees_are_counted_together(spark, monkeypatch):
    """Leaves are those of trees that branch level by level; with nodes that are large to full depth, in few jobs."""
    from gleaner.llm import near_duplicates as module

    monkeypatch.setattr(module, "LEAF", 5)
    rng = np.random.default_rng(8)
    tokens = rng.integers(0, 4, (400, module.TREES * module.DEPTH)).astype(int)
    tokens[:60] = tokens[0]
    tokens[200:240, ::3] = tokens[200, ::3]
    classes = spark.createDataFrame([(k, t.tolist()) for k, t in enumerate(tokens)], "cid long, tokens array<int>").localCheckpoint()
    wanted = set()
    for tree in range(module.TREES):
        nodes = [range(len(tokens))]
        for level in range(1, module.DEPTH + 1):
            parts = {}
            for n, node in enumerate(nodes):
                for cid in node:
                    parts.setdefault((n, tokens[cid, tree * module.DEPTH + level - 1]), []).append(cid)
            ended = [p for p in parts.values() if len(p) > 1 and (len(p) <= module.LEAF or level == module.DEPTH)]
            wanted |= {(tree, frozenset(p), len(p) > module.LEAF) for p in ended}
            nodes = [p for p in parts.values() if len(p) > module.LEAF]
    jobs, rows = _jobs(spark, lambda: module.leaves(classes).collect())
    got = {}
    for r in rows:
        got.setdefault((r["path"], r["count"], r["big"]), set()).add(r["cid"])
    assert all(len(cids) == count for (_, count, _), cids in got.items())
    assert sorted((sorted(c), big) for (_, _, big), c in got.items()) == sorted((sorted(c), big) for _, c, big in wanted)
    assert jobs <= 30


def test_levels_of_a_stage_make_no_rows_each(spark, monkeypatch):
    """A large group of copies has one row for each class and tree in a stage, however many levels the stage has."""
    plans, write = [], near_duplicates.written
    monkeypatch.setattr(near_duplicates, "LEAF", 5)
    monkeypatch.setattr(near_duplicates, "written", lambda df, label: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, label))
    classes = spark.createDataFrame([(k, [1] * (near_duplicates.TREES * near_duplicates.DEPTH)) for k in range(30)], "cid long, tokens array<int>").localCheckpoint()
    rows = near_duplicates.leaves(classes).collect()
    assert len(rows) == 30 * near_duplicates.TREES and all(r["count"] == 30 and r.big for r in rows)
    # the trees alone are exploded: where the first stage is counted and where its rows are dealt out
    assert sum("Generate" in p for p in plans) == 2


def test_candidates_take_along_whose_they_are(spark):
    """A candidate's two sides meet in one join on its number; whose they are comes along with the words."""
    words = " ".join(f"w{k}" for k in range(80))
    docs = spark.createDataFrame([(7, words), (9, "before it " + words)], "doc_id long, text string")
    classes = passages._texts(docs, "doc_id", "text").select(F.col("doc").alias("cid"), F.col("doc").alias("rep"), "h1", "h2")
    met = spark.createDataFrame([(3, 9, 2, 60, 7, 0, 58)], "chain long, doc long, low int, high int, head long, head_low int, head_high int")
    found = passages.verified(met, classes, docs, 0.8, 50, "doc_id", "text")
    assert [tuple(r) for r in found.collect()] == [(9, 2, 82, 7, 0, 80)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 3  # of texts on both sides, and of the two


def test_stretches_of_a_text_share_its_rows(spark, monkeypatch):
    """Candidates of one document, numbered in many partitions, cost a row with its text for each CUTS of them, and none is lost."""
    tables, write = [], passages.written
    monkeypatch.setattr(passages, "written", lambda df, label: tables.append((label, write(df, label))) or tables[-1][1])
    words = " ".join(f"w{k}" for k in range(80))
    docs = spark.createDataFrame([(7, words), (9, "before it " + words)], "doc_id long, text string")
    classes = passages._texts(docs, "doc_id", "text").select(F.col("doc").alias("cid"), F.col("doc").alias("rep"), "h1", "h2")
    met = spark.createDataFrame([(k << 33, 9, 2, 60, 7, 0, 58) for k in range(100)], "chain long, doc long, low int, high int, head long, head_low int, head_high int")
    found = passages.verified(met, classes, docs, 0.8, 50, "doc_id", "text")
    assert [tuple(r) for r in found.collect()] == [(9, 2, 82, 7, 0, 80)]
    cuts = [t.select("rep", F.explode("cuts.chain").alias("chain")) for label, t in tables if label == "cuts"]
    assert [sorted(r.chain for r in t.collect()) for t in cuts] == [[k << 33 for k in range(100)]] * 2
    assert [t.count() for label, t in tables if label == "cuts"] == [2, 2]
