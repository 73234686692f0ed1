"""The corpus operators against brute force, and on nulls, empty and long texts, ties, repeats and empty tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, components, grammar, lengths, lines, mixing, pseudo_lm, quality, queries, simhash, toxicity, vptree

DATA = "/root/testdata/sf0.001"
RANKS, WORDS, BYTES = (public_tokenizers.path(n) for n in (
    "byte_bpe_50k.tiktoken", "word_bpe_49k.json", "byte_bpe_50k.json"))


def texts_of(rows):
    return [(r[1], r[2]) for r in rows]


def table_rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def edge_texts():
    from llm_edges import edge_rows

    return texts_of(edge_rows())


# Token counts


def test_long_white_space_is_counted():
    """The same as the encoder's own count where that can count, and a count where it can't."""
    enc = lengths.encoder(RANKS)
    for blank in (" ", "\n", "\t", "\u2003", " \n", "\x1c"):
        for k in (1999, 2000, 2001, 5000):
            for before, after in (("", ""), ("a b", ""), ("", "c"), ("a b", "c d"), ("a\n", "'s"), ("1", "  2")):
                text = before + blank * k + after
                assert lengths.encoded_length(enc, text) == len(enc.encode_ordinary(text)), (blank, k, before, after)
    long = "x" + " " * 3_000_000 + "\n" * 1_000_000 + "y"
    assert 0 < lengths.encoded_length(enc, long) < len(long)
    assert abs(lengths.encoded_length(enc, long + long) - 2 * lengths.encoded_length(enc, long)) <= 2


def check_lengths(docs, texts):
    enc = lengths.encoder(RANKS)
    sizes = [len(enc.encode_ordinary(t or "")) for _, t in texts]
    table = lengths.context_table(lengths.length_histogram(docs, RANKS))
    got = {r["n_tokens"]: r for r in table.collect()}
    assert sorted(got) == sorted(set(sizes))
    for limit, r in got.items():
        assert r["n_docs"] == sizes.count(limit)
        assert r["docs_at_least"] == sum(s >= limit for s in sizes)
        assert r["tokens_at_least"] == sum(s for s in sizes if s >= limit)
        assert r["truncated_tokens"] == sum(min(s, limit) for s in sizes)
        assert r["share_at_most"] == pytest.approx(sum(s <= limit for s in sizes) / len(sizes))
        assert r["total_tokens"] == sum(sizes)
    limits = [0, 1, 7, 100, 10**6]
    for r in lengths.limit_answers(table, limits).collect():
        assert r["truncated_tokens"] == sum(min(s, r["limit"]) for s in sizes)
        assert r["docs_over"] == sum(s > r["limit"] for s in sizes)
    for r in lengths.quantiles(table, [0.1, 0.5, 1.0]).collect():
        assert r["n_tokens"] == min(s for s in sizes if sum(x <= s for x in sizes) / len(sizes) >= r["prob"])


def test_lengths(edges, nothing, documents):
    check_lengths(documents, table_rows(documents))
    check_lengths(edges, edge_texts())
    assert lengths.context_table(lengths.length_histogram(nothing, RANKS)).count() == 0


# Lines


def plain_lines(texts, min_docs=5):
    def key(x):
        return re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))

    holders = defaultdict(set)
    for d, t in texts:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                holders[key(x)].add(-(2**63) if d is None else d)
    out = Counter()
    for d, t in texts:
        ls = (t or "").split("\n")
        n = -(2**63) if d is None else d
        kept = [x for x in ls if len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == n]
        out[(d, len(ls), len(ls) - len(kept), "\n".join(kept))] += 1
    return out


def got_lines(docs):
    return Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in lines.dedup_lines(docs).collect())


def test_lines(spark, edges, nothing, documents):
    assert got_lines(documents) == plain_lines(table_rows(documents))
    want = plain_lines(edge_texts())
    assert got_lines(edges) == want and any(k[2] for k in want)
    assert lines.dedup_lines(nothing).count() == 0


def test_hot_line_over_many_tasks(spark):
    """A line in every document, some of them many times, crosses tasks and leaves one holder only."""
    hot = "x" * 45
    texts = [(i, "\n".join([hot] * (200 if i == 7 else 3) + [f"own {i} " + "y" * 40])) for i in range(400)]
    texts += [(1000 + i, "z" * 50) for i in range(4)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "23"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert got_lines(docs) == plain_lines(texts)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_stream_lets_rows_go(monkeypatch, spark):
    monkeypatch.setattr(lines, "HELD_ROWS", 3)
    rows = [(1, 1, d, 0, 0, p, 9) for d in range(9, 0, -1) for p in range(3)]
    rows += [(2, 2, d, 0, 0, 0, 9) for d in range(9, 0, -1)] + [(3, 3, 1, 0, 0, 0, 9)]
    import pyarrow as pa

    names = ["h1", "h2", "doc", "t1", "t2", "pos", "n_lines"]
    table = pa.table({n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(names)})
    for size in (1, 2, 5, 100):
        out = [b.to_pydict() for b in lines._Stream(0, 5).batches(table.to_batches(max_chunksize=size)) if b is not None]
        flat = [(k, h, d) for b in out for k, h, d in zip(b["kind"], b["h1"], b["doc"])]
        assert sorted(d for k, h, d in flat if k == lines.DROP and h == 2) == list(range(1, 9))
        assert sum(k == lines.OPEN and h == 1 for k, h, _ in flat) == 27
        runs = {h: b for b in out for k, h in zip(b["kind"], b["h1"]) if k == lines.RUN}
        assert set(runs) == {1, 3} and runs[1]["n_docs"][-1] == 9


# Near-duplicates


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(ids, prints):
    lab = np.array(ids, float)
    near = np.bitwise_count(np.array(prints, np.uint64)[:, None] ^ np.array(prints, np.uint64)[None, :]) <= 3
    while True:
        new = np.array([lab[n].min() for n in near])
        if (new == lab).all():
            return new
        lab = new


def check_simhash(docs, texts):
    prints = [plain_fingerprint(t) for _, t in texts]
    labels = plain_components([np.inf if d is None else d for d, _ in texts], prints)
    want = Counter((d, f"{p:016x}", None if c == np.inf else int(c)) for (d, _), p, c in zip(texts, prints, labels))
    got = simhash.near_duplicates(docs).collect()
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want
    kept = simhash.keep_one(docs)
    classes = set(plain_components(list(range(len(texts))), prints))
    assert kept.columns == docs.columns and kept.count() == len(classes)


def test_simhash(edges, nothing, documents):
    check_simhash(documents, table_rows(documents))
    check_simhash(edges, edge_texts())
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.keep_one(nothing).count() == 0


def test_links_reach_three_bits(spark):
    """Chains and stars of fingerprints up to three bits apart, and four bits apart, in every place of the word."""
    rng = np.random.default_rng(3)
    prints = set()
    for _ in range(40):
        x = int(rng.integers(0, 2**63)) * 2 + int(rng.integers(0, 2))
        for k in (0, 1, 2, 3, 4):
            y = x
            for b in rng.choice(64, k, replace=False):
                y ^= 1 << int(b)
            prints.add(y)
    prints |= {0, 2**64 - 1, 2**64 - 2}
    prints = sorted(prints)
    df = spark.createDataFrame([(int(np.array(p, np.uint64).view(np.int64)),) for p in prints], "fp long")
    got = {int(np.array(r["fp"]).view(np.uint64)): r["root"] for r in simhash.near_components(df).collect()}
    want = plain_components(list(range(len(prints))), prints)
    assert len(set(zip(want, (got[p] for p in prints)))) == len(set(want)) == len(set(got.values()))


def test_variants_stream_in_any_batches():
    """Edges don't depend on where a task's sorted variants are cut into batches."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, base ^ np.uint64(3), base ^ np.uint64(1 << 40)]))
    fp, which = np.repeat(fps, 200), np.tile(np.arange(200), len(fps))
    order = np.argsort((fp ^ simhash.MASKS[which]).view(np.int64), kind="stable")
    fp, which = fp[order].view(np.int64), which[order]

    def found(size):
        cut = (pa.RecordBatch.from_arrays([pa.array(fp[i : i + size]), pa.array(which[i : i + size])], ["fp", "mask"])
               for i in range(0, len(fp), size))
        return {tuple(r.values()) for b in simhash._meet(cut) for r in b.to_pylist()}

    assert found(1) == found(7) == found(len(fp)) != set()
    assert list(simhash._meet(iter([]))) == []


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(1, 61)} | {i: 100 for i in range(101, 140)}


# Quality


def plain_quality(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    grams = Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for x in (text or "").split("\n"):
        if re.search("[^\x20\x09-\x0d]", x):
            dup += x in seen
            seen.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)


def plain_votes(text):
    """The rules on one text: -1 abstains, 0 is bad, 1 is good."""
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n, joined = len(words), "".join(words)
    _, chars, symbols, dup, repeats = plain_quality(text)
    letters, capitals = len(re.findall("[A-Za-z]", joined)), len(re.findall("[A-Z]", joined))
    per = lambda x, y: x / max(y, 1)
    return (0 if per(symbols, n) >= 0.2 else -1,
            0 if n >= 20 and (per(joined.count("!"), n) >= 0.3 or (letters >= 20 and per(capitals, letters) >= 0.4)) else -1,
            0 if n >= 20 and (per(repeats, n) >= 0.35 or per(dup, n) >= 0.03) else -1,
            0 if n >= 20 and per(chars, n) >= 14 else -1,
            1 if n >= 20 and per(len(set(words)), n) >= 0.5 and per(symbols, n) <= 0.02 and per(capitals, letters) <= 0.1
            and per(repeats, n) <= 0.15 else -1)


def plain_posteriors(votes, sides=(0, 0, 0, 0, 1)):
    """Expectation-maximisation document by document."""
    import math

    k = len(sides)
    number = [sum(v[r] >= 0 for v in votes) for r in range(k)]

    start = [((v.count(1) + 0.5) / (v.count(1) + 4 * v.count(0) + 1)) for v in votes]

    def weigh(p):
        weight = []
        for r in range(k):
            repeated = 0.0
            for s in range(k):
                if s == r or sides[s] != sides[r] or not number[r] or not number[s]:
                    continue
                together, least, chance = sum(v[r] >= 0 and v[s] >= 0 for v in votes), min(number[r], number[s]), 0.0
                for mine in ([1 - x for x in p], p):
                    one, two = (sum(m for m, v in zip(mine, votes) if v[x] >= 0) for x in (r, s))
                    chance += one * two / sum(mine)
                repeated += min(max((together - chance) / max(least - chance, 1e-12), 0), 1) * least
            weight.append(1 / (1 + repeated / max(number[r], 1e-12)))
        return weight

    def settle(weight):
        p = start
        for _ in range(200):
            prior = min(max((sum(p) + 1) / (len(p) + 2), 0.02), 0.98)
            rates = []
            for r in range(k):
                rate = []
                for z in (0, 1):
                    mine = [x if z else 1 - x for x in p]
                    trusted = 0.25 * number[r] * (sides[r] == z)
                    rate.append((sum(m for m, v in zip(mine, votes) if v[r] >= 0) + trusted + 1) / (sum(mine) + trusted + 2))
                rates.append(rate)

            def total(v, said):
                odds = math.log(prior / (1 - prior))
                for r in range(k):
                    if v[r] >= 0:
                        odds += weight[r] * math.log(rates[r][1] / rates[r][0])
                    elif not said:
                        odds += weight[r] * math.log((1 - rates[r][1]) / (1 - rates[r][0]))
                return 1 / (1 + math.exp(-max(-500, min(500, odds))))

            p = [total(v, False) for v in votes]
        return p, [total(v, True) for v in votes]

    return settle(weigh(settle(weigh(start))[0]))[1]


def test_quality(edges, nothing, documents):
    """Counts, votes, posterior and verdict of every document, against plain loops."""
    for docs, texts in ((documents, table_rows(documents)), (edges, edge_texts())):
        rows = quality.judge(docs).collect()
        names = [f"vote_{r.name}" for r in quality.standard_rules()]
        got = Counter((r["doc_id"], *(r[f] for f in quality.FEATURES[:5]), *(r[n] for n in names), r["base_failed"], round(r["quality"], 6), r["kept"])
                      for r in rows)
        votes = [plain_votes(t) for _, t in texts]
        want = Counter()
        for (d, t), v, p in zip(texts, votes, plain_posteriors(votes)):
            m = plain_quality(t)
            failed = m[0] < 50 or 100 * m[4] > 50 * m[0]
            want[(d, *m, *v, failed, round(p, 6), not failed and p >= 0.5)] += 1
        assert got == want
    assert quality.judge(nothing).count() == 0


def test_quality_agrees_with_labels(spark):
    """Labels are never learned from; the posterior ranks them and no document with an uncontradicted bad vote is kept."""
    root = "/root/testdata/sf0.01"
    marks = spark.read.parquet(f"{root}/labels.parquet").where("quality is not null")
    rows = quality.judge(spark.read.parquet(f"{root}/documents.parquet")).join(marks.select("doc_id", F.col("quality").alias("label")), "doc_id").collect()
    good, bad = ([r["quality"] for r in rows if r["label"] == k] for k in (1, 0))
    auc = np.mean([np.mean(np.array(good) > b) + 0.5 * np.mean(np.array(good) == b) for b in bad])
    assert auc >= 0.99
    for r in rows:
        said = [r[f"vote_{x.name}"] for x in quality.standard_rules()]
        if not r["base_failed"]:
            assert r["kept"] == (0 not in said) or 1 in said


def test_votes_recover_accuracies():
    """One-sided rules of known rates on invented truths, two of them firing together: the posterior finds the truth."""
    rng = np.random.default_rng(5)
    truth = rng.random(20000) < 0.8
    votes = np.full((20000, 5), -1)
    for r, (side, hit, slip) in enumerate(((0, 0.6, 0.02), (0, 0.5, 0.01), (0, 0.3, 0.03), (1, 0.7, 0.1))):
        fires = rng.random(20000) < np.where(truth == side, hit, slip)
        votes[fires, r] = side
    votes[:, 4] = votes[:, 1]  # the same rule again
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.fit_votes(patterns, counts, [0, 0, 0, 1, 0])
    assert model.weights[1] < 0.5 < min(model.weights[0], model.weights[2]) and model.weights[3] == 1.0
    for r in (0, 1, 2):
        assert model.rates[r][0] > 3 * model.rates[r][1]
    assert model.rates[3][1] > 2 * model.rates[3][0]
    odds = quality._odds(model.prior, np.array(model.rates), np.array(model.weights), votes >= 0)
    assert np.mean((odds >= 0) == truth) > 0.93


@pytest.mark.parametrize("times", [1, 1000])
def test_votes_do_not_depend_on_the_size(times):
    """Exclusive kinds of bad documents, the largest of them met by one rule alone: none is taken for good."""
    patterns = np.array([[-1, -1, 1], [0, -1, -1], [-1, 0, -1], [0, 0, -1], [-1, -1, -1]])
    counts = np.array([8000, 700, 300, 10, 100]) * times
    model = quality.fit_votes(patterns, counts, [0, 0, 1])
    odds = quality._odds(model.prior, np.array(model.rates), np.array(model.weights), patterns >= 0)
    assert (odds >= 0).tolist() == [True, False, False, False, True]


# Token files


def test_token_files(spark, edges, nothing, documents, tmp_path):
    tok = Tokenizer.from_file(WORDS)
    for name, docs, texts in (("d", documents, table_rows(documents)), ("e", edges, edge_texts())):
        path = str(tmp_path / name)
        grammar.write_token_files(docs, path, WORDS)
        rows = sorted(grammar.read_token_files(spark, path).collect(), key=lambda r: r["start"])
        want = [(d, np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for d, t in texts]
        assert Counter((r["doc_id"], bytes(r["ids"])) for r in rows) == Counter(want)
        order = [-1 if r["doc_id"] is None else r["doc_id"] for r in rows]
        assert order == sorted(order)
        start = 0
        for r in rows:
            assert (r["start"], r["n_tokens"]) == (start, len(r["ids"]) // 4) and r["ids_crc32"] == zlib.crc32(r["ids"])
            start += r["n_tokens"]
        block = spark.read.parquet(path).orderBy("part", "block").first().asDict()
        opened = grammar.Block(block)
        whole, at = opened.all_ids(), 0
        for i, n in enumerate(block["n_ids"][:20]):
            assert (opened.document(i) == whole[at : at + n]).all()
            assert (opened.span(i, n // 3, n - n // 4) == whole[at + n // 3 : at + n - n // 4]).all()
            at += n
    grammar.write_token_files(nothing, str(tmp_path / "n"), WORDS)
    assert grammar.read_token_files(spark, str(tmp_path / "n")).count() == 0


def test_no_pair_is_left_that_pays():
    """Rules are made until no pair within documents occurs four times; copies become few symbols."""
    rng = np.random.default_rng(2)
    passage = rng.integers(0, 40_000, 700)
    docs = [np.concatenate([rng.integers(0, 40_000, 50), passage, [2]]) for _ in range(9)] + [rng.integers(0, 30, 4000)]
    ids, n = np.concatenate(docs), np.array([len(d) for d in docs])
    made = grammar.compress(ids, n, 49_408)
    block = grammar.Block({**made, "vocab": 49_408, "n_ids": n, "n_symbols": made["n_symbols"]})
    assert (block.all_ids() == ids).all()
    pairs, at = Counter(), 0
    for k in made["n_symbols"]:
        s = block.symbols[at : at + k].tolist()
        at += k
        taken = {}
        for i, p in enumerate(zip(s, s[1:])):
            if taken.get(p) != i - 1:  # of three equal symbols only one pair can be replaced
                pairs[p] += 1
                taken[p] = i
    assert max(pairs.values()) < 4
    assert made["n_symbols"][:9].max() < 70 and block.lengths.max() > 600
    for doc in (0, 4, 9):
        assert (block.document(doc) == docs[doc]).all() and (block.span(doc, 17, 333) == docs[doc][17:333]).all()


def test_word_encoder_matches_the_library():
    """Every kind of text, also with few pieces remembered: the same ids as the whole pipeline of the library."""
    tok, rng = Tokenizer.from_file(WORDS), np.random.default_rng(8)
    alphabet = [*"abcxyzABCÉÀÍéàíßÿñ", " ", " ", "\n", "\t", ".", ",", "!", "?", "-", "'", "s", "1", "23", "<", "|", ">", "œ", "ſ", "×", "÷",
                "\u0301", "Σ", "\x00", "\x1c", "\u2003", "日本", "<|endoftext|>", "don't", "it's", "..."]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 60))) for _ in range(600)] + ["", " ", "ÀÍ àí", "a" * 3000]
    for limit in (grammar.KNOWN_PIECES, 50):
        enc = grammar.WordEncoder(WORDS)
        held, grammar.KNOWN_PIECES = grammar.KNOWN_PIECES, limit
        try:
            for i in range(0, len(texts), 37):
                part = texts[i : i + 37]
                ids, n = enc.encode([t.encode() for t in part])
                want = [tok.encode(t, add_special_tokens=False).ids for t in part]
                assert n.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]
        finally:
            grammar.KNOWN_PIECES = held


def test_grammar_replaces_runs_without_overlap():
    for vocab in (10, 70_000):
        ids = np.array([1] * 301 + [1, 2] * 200 + [3, 1, 2] * 100)
        made = grammar.compress(ids, np.array([301, 400, 300]), vocab)
        row = made | {"vocab": vocab, "n_ids": [301, 400, 300]}
        assert (grammar.Block(row).all_ids() == ids).all() and sum(made["n_symbols"]) < len(ids) / 5


# Scores of a language model


def test_pseudo_likelihood(edges, nothing, documents):
    model = pseudo_lm.fit(documents)
    sides = np.exp(model.window).reshape(pseudo_lm.GROUPS, pseudo_lm.CLASSES, pseudo_lm.CLASSES, -1).sum(axis=2)
    assert np.allclose(sides, 1)
    assert np.allclose(np.bincount(model.classes, weights=np.exp(model.within), minlength=pseudo_lm.CLASSES)[1:], 1)
    again = pseudo_lm.fit(documents.repartition(7))
    assert (model.window == again.window).all() and (model.within == again.within).all()
    rows = {r["doc_id"]: r for r in pseudo_lm.pseudo_likelihood(documents, model).collect()}
    flat = np.log(1 / pseudo_lm.CLASSES)
    for d, t in table_rows(documents)[:20]:
        cs = [0, 0, *model.classes[[zlib.crc32(w) & 65535 for w in t.encode().lower().split()]], 0, 0]
        ws = t.encode().lower().split()
        table = model.window.reshape(pseudo_lm.GROUPS, pseudo_lm.CLASSES, pseudo_lm.CLASSES, pseudo_lm.CLASSES, -1)
        g, want = model.groups, 0.0
        for i, w in enumerate(ws):
            want += model.within[zlib.crc32(w) & 65535] + table[g[cs[i]], cs[i + 1], cs[i + 2], cs[i + 3], g[cs[i + 4]]]
        assert rows[d]["n_words"] == len(ws) and rows[d]["log_likelihood"] == pytest.approx(want)
    counted = sum(model.window[np.flatnonzero(np.isfinite(model.window))]) / len(model.window)
    assert counted < 0 and flat < 0
    for r in pseudo_lm.pseudo_likelihood(edges).collect():
        assert (r["n_words"] == 0) == (r["mean_log_likelihood"] is None) and r["log_likelihood"] <= 0
    assert pseudo_lm.pseudo_likelihood(nothing).count() == 0


def test_pseudo_likelihood_knows_words_and_their_order(spark, documents, monkeypatch):
    """Against plain counts over several blocks and buckets; text in order beats the same words shuffled."""
    monkeypatch.setattr(pseudo_lm, "BLOCK_WORDS", 4000)
    monkeypatch.setattr(pseudo_lm, "BUCKET_KEYS", 6000)
    fits, fit = [], pseudo_lm.fit
    monkeypatch.setattr(pseudo_lm, "fit", lambda rows: fits.append(fit(rows)) or fits[-1])
    rng = np.random.default_rng(5)
    names = [f"w{i}" for i in rng.permutation(900)]
    order = [[names[(a + i) % 900] for i in range(60)] for a in rng.integers(0, 900, 300)]
    mean = []
    for texts in (order, [list(rng.permutation(t)) for t in order]):
        df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)] + [(300, None), (301, " ")], "doc_id long, text string")
        rows = {r["doc_id"]: r for r in pseudo_lm.pseudo_likelihood(df).collect()}
        assert len(rows) == 302 and rows[300]["n_words"] == rows[301]["n_words"] == 0
        mean.append(np.mean([rows[i]["mean_log_likelihood"] for i in range(300)]))
        m, words, pairs = fits[-1], Counter(), Counter()
        for t in texts:
            words.update([*t, ""])
            pairs.update(zip(["", *t], [*t, ""]))
        for i in (0, 7, 299):
            t = [w.encode() for w in texts[i]]
            sym = np.array([zlib.crc32(w) & 65535 for w in t])
            window = m.window[pseudo_lm._windows(m.classes[sym], np.array([len(t)]), m.groups)]
            want, around = 0.0, ["", *texts[i], ""]
            for j, w in enumerate(texts[i]):
                base = np.exp(window[j] + m.within[sym[j]]) * words[w] / m.counts[sym[j]]
                l, r = around[j], around[j + 2]
                want += np.log((base + (pairs[l, w] - 1 + pseudo_lm.PRIOR * base) / (words[l] - 1 + pseudo_lm.PRIOR)
                                + (pairs[w, r] - 1 + pseudo_lm.PRIOR * base) / (words[r] - 1 + pseudo_lm.PRIOR)) / 3)
            assert rows[i]["log_likelihood"] == pytest.approx(want)
    assert mean[0] > mean[1] + 3
    texts = [(d, (t or "").split()) for d, t in table_rows(documents)]
    mixed = spark.createDataFrame([(d, " ".join(rng.permutation(t))) for d, t in texts], "doc_id long, text string")
    real, shuffled = (df.agg(F.sum("log_likelihood")).first()[0] for df in map(pseudo_lm.pseudo_likelihood, (documents, mixed)))
    assert real > shuffled


# Toxicity


def plain_segments(scores):
    """Maximal segments by their definition: repeatedly the best one, then what lies on either side of it."""
    best, found = None, []
    for a in range(len(scores)):
        total = 0.0
        for b in range(a, len(scores)):
            total += scores[b]
            if total > 0 and (best is None or total > best[2] + 1e-12):
                best = (a, b + 1, total)
    if best is None:
        return found
    a, b, s = best
    shift = [(x + b, y + b, z) for x, y, z in plain_segments(scores[b:])]
    return plain_segments(scores[:a]) + [(a, b, s)] + shift


def test_segments():
    rng = np.random.default_rng(2)
    for n in range(40):
        scores = rng.normal(-0.3, 1, n)
        got, want = toxicity.maximal_segments(scores), plain_segments(list(scores))
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert np.allclose([g[2] for g in got], [w[2] for w in want])


def test_toxicity_on_held_out(spark):
    root = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{root}/{t}.parquet") for t in ("documents", "labels"))
    rows = queries.op7_toxicity(spark, root).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    hit = [(r["toxic"], r["predicted"]) for r in rows]
    assert sum(t == p for t, p in hit) / len(hit) > 0.98
    assert sum(p for t, p in hit if t) / sum(t for t, _ in hit) > 0.9
    other = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit_odds(docs, labels), toxicity.fit_odds(docs, other)
    assert a.words == b.words and a.heads == b.heads and len(a.words) > 1000


def plain_toxicity(docs, marks):
    """Scores of all texts: word counts, odds, tail and curve by loops over the labelled documents."""
    import math

    part = lambda i: zlib.crc32(str(i).encode()) % 5
    plain = lambda w: w.decode("utf-8", "replace").lower().strip("!?.,;:()[]{}<>\"'`*#$%&|-_/\\~")
    raw = {i: (t or "").encode() for i, t in docs}
    train = [(raw[i], marks[i]) for i in raw if i in marks and part(i) in (1, 2, 3)]
    word, head = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for t, label in train:
        own = {plain(w) for w in t.split()}
        for table, names in ((word, own), (head, {w[:4] for w in own})):
            for n in names:
                table[n][0] += label
                table[n][1] += 1
    rate = (sum(x for _, x in train) + 0.5) / (len(train) + 1)
    odds = lambda p: min(max(math.log(p / (1 - p)) - math.log(rate / (1 - rate)), -2), 7) - 1.5
    by_head = {h: (t + 3 * rate) / (n + 3) for h, (t, n) in head.items()}

    def value(w):
        w = plain(w)
        if w in word:
            t, n = word[w]
            p = (t + 3 * by_head[w[:4]]) / (n + 3)
            if n >= 20 or (n >= 2 and p > by_head[w[:4]]):
                return odds(p)
        return odds(by_head[w[:4]]) if head.get(w[:4], [0, 0])[1] >= 2 else -1.5

    known = {}
    scores = {i: np.array([known.setdefault(w, value(w)) if w not in known else known[w] for w in t.split()], float) for i, t in raw.items()}
    held = [(scores[i], marks[i]) for i in raw if i in marks and part(i) == 4]
    cells, tail = np.zeros(256), np.zeros(256 * 64)
    for s, label in held:
        if not label:
            np.add.at(cells, ((s + 3.5) / 0.05).astype(int).clip(0, 255), 1)
            for _, _, x in toxicity.maximal_segments(s):
                tail[min(int(x / 0.05), len(tail) - 1)] += 1
    middle = -3.5 + (np.arange(256) + 0.5) * 0.05
    p = cells / cells.sum()
    decay = 5.0
    if p[middle > 0].sum() and (p * middle).sum() < 0:
        lo, hi = 1e-3, 5.0
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if (p * np.exp(mid * middle)).sum() > 1 else (mid, hi)
        decay = hi
    size = (tail[40:].sum() + 0.5) * math.exp(2 * decay) / (cells.sum() + 1)

    def evidence(s):
        found = [decay * x - math.log(max(size * len(s), 1e-12)) for _, _, x in toxicity.maximal_segments(s)]
        return math.log1p(sum(e for e in found if e > 0))

    x = np.array([min(int(evidence(s) / 0.02), 399) for s, _ in held])
    x, y = np.where(x == 0, 0.0, (x + 0.5) * 0.02), np.array([label for _, label in held], float)
    a = b = 0.0
    for _ in range(500):  # plain Newton steps on the penalised likelihood, document by document
        q = 1 / (1 + np.exp(-np.clip(a + b * x, -500, 500)))
        w = np.maximum(q * (1 - q), 1e-9)
        grad = np.array([(y - q).sum() - 0.01 * a, ((y - q) * x).sum() - 0.01 * b])
        hess = np.array([[w.sum() + 0.01, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 0.01]])
        step = np.clip(np.linalg.solve(hess, grad), -2, 2)
        a, b = a + step[0], b + step[1]
    return {i: 1 / (1 + math.exp(-min(max(a + b * evidence(s), -500), 500))) for i, s in scores.items()}


def test_toxicity_against_plain_scores(spark):
    root = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text").collect()]
    marks = {r["doc_id"]: int(r["toxic"] > 0) for r in spark.read.parquet(f"{root}/labels.parquet").where("toxic is not null").collect()}
    want = plain_toxicity(docs, marks)
    got = {r["doc_id"]: r["score"] for r in queries.op7_toxicity(spark, root).collect()}
    assert set(got) == set(want)
    assert np.array([got[i] for i in want]) == pytest.approx(np.array(list(want.values())), abs=1e-6)


def test_toxicity_edges(spark, edges, nothing):
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    rows = toxicity.score(edges, labels).collect()
    assert len(rows) == edges.count() and all(0 <= r["toxic_score"] <= 1 for r in rows)
    assert toxicity.score(nothing, labels).count() == 0
    assert {r["toxic_score"] for r in toxicity.score(edges, labels.limit(0)).collect()} == {0.0}


# Mixing


def test_mixing_agrees_with_sql(spark, oracle):
    from compare import difference

    assert difference(queries.op8_mixing(spark, DATA).toPandas(), oracle.execute(queries.ORACLES["op8_mixing"]).df()) is None


def test_line_dedup_agrees_with_sql(spark, oracle):
    from compare import difference

    got = queries.op2_line_dedup(spark, DATA).toPandas()
    assert difference(got, oracle.execute(queries.ORACLES["op2_line_dedup"]).df()) is None


def test_mixing(edges, nothing, spark):
    got = mixing.allocation(edges).collect()
    assert len(got) == edges.count() and all(r["taken"] <= 2 * r["size"] for r in got)
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, mixing.allocation(edges.repartition(3)).collect()))
    out = mixing.mixed(edges)
    assert out.columns == edges.columns
    assert mixing.allocation(nothing).count() == 0 and mixing.mixed(nothing).count() == 0


@pytest.mark.parametrize("piece", [20_000, 64])
def test_equal_rows_are_drawn_one_by_one(spark, monkeypatch, piece):
    """A thousand equal rows come as near to their target as different ones, and the mix writes what was allocated."""
    monkeypatch.setattr(mixing, "SLICE", piece)
    rows = [(i, "v " * 10, "a") for i in range(1000)] + [(7, "w " * 10, "b")] * 1000 + [(8, "w " * 10, "c")] * 1000
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.allocation(docs).groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.count("*").alias("n")).collect()
    assert sorted((round(r["target"]), r["n"]) for r in got) == [(8333, 1000), (16667, 1000), (20000, 1000)]
    assert all(abs(r["taken"] - r["target"]) <= 5 for r in got)
    out = mixing.mixed(docs)
    words = {r["source"]: r["words"] for r in out.groupBy("source").agg((10 * F.count("*")).alias("words")).collect()}
    assert words == {"a": 20000, "b": 8330, "c": 16670}


def test_null_ids_have_keys_of_their_own(spark):
    rows = [(None, f"text number {i}", "s") for i in range(400)] + [(1, "x " * 3600, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    drawn = mixing.draw(docs).where("source_size = 1200").collect()
    taken = [r["copies"] for r in drawn]
    assert abs(3 * sum(taken) - drawn[0]["target"]) <= 3
    keys = mixing._units(docs, "mix").where("doc_id is null").select("key").distinct().count()
    assert keys == 400


def test_slices_are_even(spark, monkeypatch):
    """Documents of unlike weights, sorted by key, spread evenly: no slice holds far more than its share."""
    monkeypatch.setattr(mixing, "SLICE", 100)
    rows = [(i, " ".join(f"w{j % (1 + i % 40)}" for j in range(40)), "s") for i in range(10_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    units = mixing._units(docs, "mix")
    above = F.aggregate("mixture", F.lit(0.0), lambda s, x: s + x["p"] * F.exp(-x["w"] * F.col("key")))
    cells = units.join(mixing._mixture(units), ["no_source", "source"]).groupBy(F.floor((1 - above) * 100).alias("slice")).count().collect()
    assert len(cells) >= 99 and max(r["count"] for r in cells) < 200


def test_mixing_agrees_with_sql_on_repeats(spark, oracle):
    """The registered SQL and the query agree where rows and null ids repeat."""
    import duckdb
    import tempfile

    from compare import difference

    folder = tempfile.mkdtemp()
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    docs = docs.unionByName(docs.limit(9)).unionByName(docs.limit(7).withColumn("doc_id", F.lit(None).cast("long")))
    docs.write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    got, want = queries.op8_mixing(spark, folder).toPandas(), con.execute(queries.ORACLES["op8_mixing"]).df()
    assert difference(got.astype({"doc_id": "Int64"}), want.astype({"doc_id": "Int64"})) is None


def test_hot_source_meets_its_target(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE", 50)
    rows = [(i, "w " * (1 + i * 7 % 13), "big" if i % 3 else f"s{i % 5}") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    by = defaultdict(list)
    for r in mixing.allocation(docs).collect():
        by[(r["source_size"], r["target"])].append(r["taken"])
    assert all(abs(sum(t) - target) <= 7 for (_, target), t in by.items())
    assert sum(target for _, target in by) == pytest.approx(1.5 * sum(size for size, _ in by))


# Nearest neighbours


def plain_nearest(ids, vectors, asked, k):
    for q in asked:
        x = vectors[list(ids).index(q)]
        score = (vectors * x).sum(1)
        score[ids == q] = -np.inf
        order = np.lexsort((ids, -score))[:k]
        yield q, [int(i) for i in ids[order] if i != q]


def test_tree_is_exact_at_factor_one():
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(1500, 12)) * rng.uniform(0.2, 3, (1500, 1))
    vectors[300:700] = vectors[300]
    ids = rng.permutation(1500).astype(np.int64)
    tree = vptree.Tree.build(ids, ids, vectors, 32)
    asked = ids[::25]
    score, place = tree.search(asked, vectors[::25], 20, 1.0)
    for i, (q, want) in enumerate(plain_nearest(ids, vectors, asked, 20)):
        assert tree.ids[place[i]].tolist() == want
        found, _ = tree.search(asked[i : i + 1], vectors[::25][i : i + 1], 20, 1.0, score[i, -1:])
        assert (found[0] == score[i]).all()


def clustered(n=6000, norms=False, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(30, 32))[rng.integers(30, size=n)] + 0.25 * rng.normal(size=(n, 32))
    return x * rng.lognormal(0, 0.5, (n, 1)) if norms else x


@pytest.mark.parametrize("norms", [False, True])
def test_trees_leave_out_most_pairs(norms):
    """On vectors in clusters a tree scans few of them, all neighbours at factor one and nearly all at the one in use."""
    x = clustered(norms=norms)
    rows, asked = np.arange(len(x)), np.arange(0, len(x), 20)
    exact = x[asked] @ x.T
    exact[np.arange(len(asked)), asked] = -np.inf
    want = np.argsort(-exact, axis=1, kind="stable")[:, :20]
    for factor, least in ((1.0, 1.0), (vptree.FACTOR, 0.95)):
        tree = vptree.Tree.build(rows, rows, x)
        _, place = tree.search(asked, x[asked], 20, factor)
        assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(tree.ids[place].tolist(), want.tolist())]) >= least
        assert tree.scanned < 0.3 * len(asked) * len(x)


def test_trees_scan_wanted_leaves_by_few_products():
    """On vectors without clusters every leaf is wanted; 400 queries over 6,000 rows take a fraction of a second."""
    import time

    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 64))
    x /= np.sqrt((x**2).sum(1))[:, None]
    rows, asked = np.arange(len(x)), np.arange(0, len(x), 15)
    tree = vptree.Tree.build(rows, rows, x)
    began = time.thread_time()
    score, place = tree.search(asked, x[asked], 20, 1.0)
    assert time.thread_time() - began < 2
    for i, (_, want) in enumerate(plain_nearest(rows, x, asked[:20], 20)):
        assert tree.ids[place[i]].tolist() == want
    copies = vptree.Tree.build(rows, rows, np.repeat(x[:4], 1500, 0))
    _, place = copies.search(asked, copies.vectors[np.argsort(copies.rows)][asked], 20)
    assert all(copies.ids[p].tolist() == [j for j in range(q // 1500 * 1500, q // 1500 * 1500 + 21) if j != q][:20]
               for q, p in zip(asked, place))


def test_nearest(spark):
    root = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{root}/embeddings.parquet").toPandas()
    ids, vectors = table["vec_id"].to_numpy(), np.array(table["embedding"].tolist(), float)
    got = defaultdict(list)
    for r in queries.op9_nearest(spark, root).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    want = dict(plain_nearest(ids, vectors, ids[ids % 20 == 0], 20))
    assert set(got) == set(want)
    assert np.mean([len(set(got[q]) & set(w)) / len(w) for q, w in want.items()]) >= 0.9


def test_nearest_edges(spark):
    """Vectors that take no part; rows that share an id, also as queries; rows without one; unlike lengths; ties."""
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (7, [None, 1.0]), (None, [1.0, 1.0]), (20, [2.0, 0.0]), (20, [0.5, 0.5]), (40, [1.0, 2.0, 3.0]), (41, [])]
    df = spark.createDataFrame([(v, i, "x") for i, v in rows], "embedding array<float>, vec_id long, score string")
    got = [tuple(r) for r in vptree.nearest(df, F.col("vec_id") % 20 == 0, k=20, factor=1.0, shard_rows=2).collect()]
    want = Counter({(0, 20, 2.0): 1, (0, 1, 1.0): 1, (0, 2, 1.0): 1, (0, None, 1.0): 1, (0, 20, 0.5): 1,
                    (20, 0, 2.0): 1, (20, 1, 2.0): 1, (20, 2, 2.0): 1, (20, None, 2.0): 1, (20, 20, 1.0): 2,
                    (20, None, 1.0): 1, (20, 0, 0.5): 1, (20, 1, 0.5): 1, (20, 2, 0.5): 1})
    assert Counter((q, v, s) for q, _, v, s in got) == want
    assert sorted(r for q, r, *_ in got if q == 20) == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    assert [v for q, r, v, _ in sorted(got, key=lambda x: x[1]) if q == 0] == [20, 1, 2, None, 20]
    assert vptree.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_every_row_of_an_id_is_a_candidate(spark):
    df = spark.createDataFrame([(5, [1.0, 0.0]), (5, [0.5, 0.5]), (20, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in vptree.nearest(df, F.col("vec_id") % 20 == 0).orderBy("rank").collect()]
    assert got == [(20, 1, 5, 1.0), (20, 2, 5, 0.5)]


@pytest.mark.parametrize("kind", ["one long", "spread norms", "clusters"])
def test_nearest_over_several_shards(spark, monkeypatch, kind):
    """Exact at factor one; the recall of the factor in use, where shards are ruled out by their bounds."""
    monkeypatch.setattr(vptree, "PIVOT_ROWS", 300)
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(3000, 16))
    vectors /= np.sqrt((vectors**2).sum(1))[:, None]
    if kind == "one long":
        vectors[1234] *= 10
    elif kind == "spread norms":
        vectors *= rng.lognormal(0, 1, (3000, 1))
    else:
        vectors = clustered(3000)
    ids = np.arange(3000)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    want = dict(plain_nearest(ids, vectors, ids[ids % 20 == 0], 20))
    for factor, least in ((1.0, 1.0), (vptree.FACTOR, 0.95)):
        got = defaultdict(list)
        for r in vptree.nearest(df, F.col("vec_id") % 20 == 0, factor=factor, shard_rows=400).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append(r["vec_id"])
        assert set(got) == set(want) and (least < 1 or dict(got) == want)
        assert np.mean([len(set(got[q]) & set(w)) / 20 for q, w in want.items()]) >= least


# BPE


def test_texts_are_grouped_by_size():
    big = bpe.BYTES_AT_ONCE
    assert list(bpe._groups([])) == []
    assert list(bpe._groups([0, 3, big + 9, 1, big])) == [(0, 2), (2, 3), (3, 4), (4, 5)]
    assert [b - a for a, b in bpe._groups([1] * 600)] == [256, 256, 88]


def test_bpe(edges, nothing, documents):
    tok = Tokenizer.from_file(BYTES)
    for docs, texts in ((documents, table_rows(documents)), (edges, edge_texts())):
        want = Counter()
        for d, t in texts:
            ids = tok.encode(t or "", add_special_tokens=False).ids
            back = tok.decode(ids, skip_special_tokens=False)
            want[(d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                  hashlib.sha256(back.encode()).hexdigest())] += 1
        assert Counter(tuple(r) for r in bpe.round_trip(docs, BYTES).collect()) == want
    assert bpe.round_trip(nothing, BYTES).count() == 0


def test_bpe_odd_texts():
    tok, own = Tokenizer.from_file(BYTES), bpe.byte_pairs(BYTES)
    texts = ["a\t\n b", " \x1c x\x1f ", "aaaaaaa" * 50, "a  b   c\n\n\nd  ", " x　　y", "<|endoftext|>x <|endoftext|>",
             "日本語 👩‍👩‍👧 é", "we're I'LL 1234 5½²", "\r\n\r\n x", " ", "﻿\x85q"]
    for t, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t
        assert own.decode(ids) == t


def test_bpe_long_words(monkeypatch):
    """Pair by pair gives what rounds give, for words of any kind; a word of 100,000 letters takes seconds."""
    import time

    tok, own, rng = Tokenizer.from_file(BYTES), bpe.byte_pairs(BYTES), np.random.default_rng(4)
    words = ["".join(rng.choice(list(a), n)) for n in (2, 3, 50, 700) for a in ("ab", "abcdefgh", "etaoinsr", "aéß")] + ["a" * 999]
    for w in words:
        want = tok.encode(w, add_special_tokens=False).ids
        assert own._merge_long(w.encode()).tolist() == own._merge_rounds([w.encode()])[0].tolist() == want
    monkeypatch.setattr(bpe, "LONG_WORD", 40)
    assert [x.tolist() for x in own.merge([w.encode() for w in words])] == [tok.encode(w, add_special_tokens=False).ids for w in words]
    monkeypatch.undo()
    long = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 100_000))
    began = time.time()
    ids = np.frombuffer(own.encode([long])[0], "<u4").tolist()
    assert time.time() - began < 10 and ids == tok.encode(long, add_special_tokens=False).ids


def plain_mix(rows):
    """How often each (doc_id, text) is written: keys, epochs and the part of an epoch, document by document."""
    import math

    sizes = defaultdict(int)
    units = []
    for nth_of, r in zip(numbered_repeats(rows), rows):
        words = re.findall("[^\x20\x09-\x0d]+", r["text"] or "")
        name = str(r["doc_id"]) if r["doc_id"] is not None else hashlib.md5((r["text"] or "").encode()).hexdigest()
        digest = hashlib.md5((f"mix:{name}" + (f":{nth_of}" if nth_of > 1 else "")).encode()).hexdigest()
        u = (int(digest[:13], 16) + 0.5) / 16**13
        weight = 0.5 + 0.5 * (len(set(words)) / max(len(words), 1))
        units.append((r["source"], -math.log(u) / weight, r["doc_id"], len(words), r))
        sizes[r["source"]] += len(words)
    names = sorted(sizes, key=lambda x: (x is None, x))
    weights = {n: (3.0, 1.0, 2.0)[i % 3] for i, n in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weights[n] for n in open_)
        full = [n for n in open_ if weights[n] * level > 2.0 * sizes[n]]
        for n in full or open_:
            target[n] = min(2.0 * sizes[n], weights[n] * level)
            left -= target[n] if full else 0
        open_ = open_.difference(full) if full else set()
    out, placed = Counter(), defaultdict(int)
    for source, _, doc_id, size, r in sorted(units, key=lambda u: (u[0] is None, u[0] or "", u[1], u[2])):
        epochs = math.floor(target[source] / sizes[source]) if sizes[source] else 0
        extra = placed[source] + size / 2 <= target[source] - epochs * sizes[source]
        placed[source] += size
        out[(doc_id, r["text"])] += epochs + extra if size else max(epochs, 1)
    return out


def numbered_repeats(rows):
    seen = Counter()
    for r in rows:
        seen[tuple(r)] += 1
        yield seen[tuple(r)]


def test_pipeline_against_a_plain_chain(spark, tmp_path, monkeypatch):
    """run() on a small table: each stage's kept rows, texts and numbers against plain code on its own input."""
    import corpus_pipeline as pipeline

    root = str(tmp_path)
    source = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 400")
    line = "This line is long enough to be counted among the repeated ones."
    planted = [(1000 + i, f"{line}\nown words {i} of text number {i * i}", "en", "planted", 10) for i in range(8)]
    columns = source.columns
    extra = spark.createDataFrame(planted, "doc_id long, text string, lang string, source string, n_chars long").select(*columns)
    source.unionByName(extra).coalesce(2).write.parquet(f"{root}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.01/labels.parquet").write.parquet(f"{root}/labels.parquet")
    stages = {}

    def spied(name, stage):
        def call(spark, docs, sf_dir):
            out = stage(spark, docs, sf_dir)
            stages[name] = (docs.collect(), out)
            return out
        return call

    monkeypatch.setattr(pipeline, "STAGES", [(n, spied(n, f)) for n, f in pipeline.STAGES])
    result = pipeline.run(spark, root).collect()
    kept = {name: stages[after][0] for name, after in zip(list(stages), list(stages)[1:])}
    assert all(out.columns == columns for _, out in list(stages.values())[:-1])
    docs = spark.read.parquet(f"{root}/documents.parquet")
    # Toxicity: the rows that the plain score leaves.
    labelled = {r["doc_id"]: int(r["toxic"] > 0) for r in spark.read.parquet(f"{root}/labels.parquet").where("toxic is not null").collect()}
    scores = plain_toxicity([(r["doc_id"], r["text"]) for r in docs.collect()], labelled)
    want = sorted(i for i, s in scores.items() if s < 0.5)
    assert sorted(r["doc_id"] for r in kept["toxicity"]) == want
    gone = set(scores).difference(want)
    assert np.mean([i in gone for i, t in labelled.items() if t and i in scores]) > 0.7
    assert np.mean([i in gone for i, t in labelled.items() if not t and i in scores]) < 0.02
    # Lines: those of at least 40 characters in five documents stay in the largest id only.
    texts = {r["doc_id"]: r["text"] for r in kept["toxicity"]}
    held = defaultdict(set)
    strip = lambda x: re.sub("^[\x20\x09-\x0d]+|[\x20\x09-\x0d]+$", "", x).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for i, t in texts.items():
        for x in (t or "").split("\n"):
            held[strip(x)].add(i)
    often = {x: max(ids) for x, ids in held.items() if len(x) >= 40 and len(ids) >= 5}
    plain = {i: "\n".join(x for x in (t or "").split("\n") if often.get(strip(x), i) == i) for i, t in texts.items()}
    assert {r["doc_id"]: r["text"] or "" for r in kept["line_dedup"]} == plain
    assert all(r["n_chars"] == len(plain[r["doc_id"]]) for r in kept["line_dedup"] if plain[r["doc_id"]] != texts[r["doc_id"]])
    assert line in plain[1007] and line not in plain[1000]
    # Near-duplicates: the smallest id of each class.
    prints = [simhash.fingerprint((r["text"] or "").encode().lower().split()) for r in kept["line_dedup"]]
    classes = plain_components([r["doc_id"] for r in kept["line_dedup"]], prints)
    assert sorted(r["doc_id"] for r in kept["near_duplicates"]) == sorted(set(classes))
    # Mixing: as often as the plain draw takes each.
    mixed = Counter((r["doc_id"], r["text"]) for r in kept["mixing"])
    assert mixed == Counter({k: n for k, n in plain_mix(kept["near_duplicates"]).items() if n})
    # Encoding: the library's ids, one row for each copy.
    tok = Tokenizer.from_file(BYTES)
    want = Counter()
    for (i, t), n in mixed.items():
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())] += n
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in result) == want
