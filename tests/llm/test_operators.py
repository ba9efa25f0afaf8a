"""Small-fixture tests of the ten operators: brute force, planted cases, nulls, empties, ties, repeats and odd columns."""

import collections
import itertools
import math
import re
import time
import tracemalloc
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from presencekit.llm import exchange, filters, graph, katz, linedup, minhash, mixing, packing, quality, queries, rules, substrings, textops, topk, toxicity
from presencekit.scratch import Scratch

DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t ", "one", "Two words\n\nTwo words", "ÄÖ ü x  y", "a" * 3000, "w " * 5000]


def docs(spark, texts, source="s", first=0):
    return spark.createDataFrame([(first + i, t, "en", source if isinstance(source, str) else source[i], len(t or "")) for i, t in enumerate(texts)], DOC)


def words(t, low=True):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "") if low else t or ""
    return re.findall(r"[^\x20\x09-\x0d]+", t)


def prose(seed, n, vocab=4000):
    rng = np.random.default_rng(seed)
    out = []
    for i, w in enumerate(rng.integers(0, vocab, n)):
        out.append(f"w{w}x" + ("." if i % 11 == 10 else ""))
    return " ".join(out)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# --- kernels


def test_word_hashes():
    texts = [t or "" for t in ODD] + ["ABC abc AbC", "x" * 40 + " y"]
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    h, w = textops.words(np.frombuffer(b"".join(raw), np.uint8), off)
    got = [list(h[w[i] : w[i + 1]]) for i in range(len(texts))]
    assert [len(g) for g in got] == [len(words(t)) for t in texts]
    seen = {}
    for t, g in zip(texts, got):
        for x, y in zip(words(t), g):
            assert seen.setdefault(x, y) == y
    assert len(set(seen.values())) == len(seen)


def test_lookup():
    rng = np.random.default_rng(0)
    for table in (rng.integers(0, 1 << 63, 9000, dtype=np.uint64) * np.uint64(2) + np.uint64(1), np.arange(9000, dtype=np.uint64), np.zeros(0, np.uint64)):
        table = np.unique(table)
        keys = np.concatenate([rng.choice(table, 3000) if len(table) else table, rng.integers(0, 1 << 63, 3000, dtype=np.uint64)])
        place = {int(k): i for i, k in enumerate(table)}
        assert textops.lookup(keys, table).tolist() == [place.get(int(k), -1) for k in keys]


def test_exchange_round_trip(spark):
    def run(batches):
        def records():
            for b in batches:
                x = b.column(0).to_numpy()
                yield (x % 7).astype(np.int32), [x, (x * 2.5)]

        return exchange.scatter(records(), 100)

    got = []
    for b in exchange.shuffled(spark.range(1000).mapInArrow(run, exchange.SCHEMA)).toArrow().to_batches():
        for part, (x, y) in exchange.gather(iter([b]), [np.int64, np.float64]):
            assert (x % 7 == part).all() and (y == x * 2.5).all()
            got += x.tolist()
    assert sorted(got) == list(range(1000))


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(50, 51), (51, 52), (60, 60), (100, 50), (5, 3)]
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "g").collect()}
    assert got == {i: 0 for i in range(31)} | {i: 50 for i in (50, 51, 52, 100)}
    assert graph.components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t"), "g").count() == 0


def test_least_matches_search():
    rng = np.random.default_rng(5)
    for n, m in ((1, 1), (40, 20), (400, 390), (3000, 1000)):
        a, b = rng.integers(-n, n, (2, m))
        near = collections.defaultdict(set)
        for x, y in zip(a.tolist(), b.tolist()):
            near[x].add(y)
            near[y].add(x)
        want = {}
        for x in sorted(near):
            todo = [x]
            while todo:
                if (y := todo.pop()) not in want:
                    want[y] = x
                    todo += near[y]
        ids, low = graph.least(a, b)
        assert dict(zip(ids.tolist(), low.tolist())) == want


@pytest.mark.parametrize("few", [1 << 20, 60, 0])
def test_few_edges_take_no_rounds(spark, monkeypatch, few):
    """A path, a star and a pair: alike whether one task solves the edges, rounds come before or rounds do it all; one table is written where no round is due."""
    monkeypatch.setattr(graph, "FEW", few)
    saved, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name: (saved.append(name), save(self, df, name))[1])
    edges = [(i, i + 1) for i in range(50)] + [(100, 200 + i) for i in range(30)] + [(-7, 1 << 62), (5, 5)]
    want = dict.fromkeys(range(51), 0) | {100: 100} | {200 + i: 100 for i in range(30)} | {-7: -7, 1 << 62: -7}
    got = graph.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "g").collect()
    assert len(got) == len(want) and {r["id"]: r["component"] for r in got} == want
    assert (len(saved) == 1) == (few > len(edges))


def test_saving_leaves_no_shuffle_files(spark):
    """Without any collector having run: a stage's later tables would else lie on disk beside the shuffles of the earlier ones."""
    import glob

    dirs = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    found = lambda: {f for d in dirs for f in glob.glob(f"{d}/**/shuffle_*.data", recursive=True)}
    was, key = found(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    rows = spark.range(2000).withColumn("k", F.col("id") % 70)
    saved = Scratch(spark, "t").save(rows.groupBy("k").count().join(rows.hint("merge"), "k").dropDuplicates(["id"]), "joined")
    for _ in range(100):
        if not (left := found() - was):
            break
        time.sleep(0.1)
    assert not left and saved.count() == 2000 and spark.conf.get(key) == "false"
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        Scratch(spark, "t").save(rows.select(F.expr("1 div (k - 3)").alias("x")), "failed")
    assert spark.conf.get(key) == "false"


# --- 1 mixing


def water(sizes, share=1.5):
    ranked = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(ranked)}
    target, open_, rest = {}, set(sizes), share * sum(sizes.values())
    while open_:
        level = rest / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * level > 2 * sizes[s]}
        if not over:
            return target | {s: w[s] * level for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            rest -= target[s]
        open_ -= over
    return target


def test_mixing(spark):
    rng = np.random.default_rng(0)
    names = [None, "b", "é", "a", "Z", "empty"] + ["hot"] * 6
    src = [names[i % len(names)] for i in range(600)]
    texts = [None if s == "empty" else "w " * int(rng.integers(1, 60)) for s in src]
    df = docs(spark, texts, src)
    got = by_id(mixing.mix_report(spark, df))
    sizes = collections.defaultdict(int)
    for s, t in zip(src, texts):
        sizes[s] += len(words(t))
    want = water(dict(sizes))
    taken = collections.defaultdict(int)
    for i, (s, t) in enumerate(zip(src, texts)):
        r = got[i]
        assert r["size"] == len(words(t)) and r["source_size"] == sizes[s] and math.isclose(r["target"], want[s], abs_tol=1e-6)
        assert r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.25 * want[s] + 100 for s in sizes)
    assert got == by_id(mixing.mix_report(spark, df.repartition(5)))
    mixed = mixing.mix_sources(df.withColumn("_row", F.lit(1)).withColumn("size", F.lit("x")))
    assert mixed.columns == [*df.columns, "_row", "size"]
    n = collections.Counter(r["doc_id"] for r in mixed.collect())
    assert all(n[i] * r["size"] == r["taken"] for i, r in got.items())


def test_mixing_edges(spark):
    assert mixing.mix_report(spark, docs(spark, [])).count() == 0
    assert mixing.mix_sources(docs(spark, [])).count() == 0
    assert by_id(mixing.mix_report(spark, docs(spark, [None, ""])))[0]["taken"] == 0
    odd = docs(spark, ODD).withColumn("doc_id", F.when(F.col("doc_id") > 3, F.col("doc_id")))
    assert mixing.mix_report(spark, odd.unionByName(odd)).count() == 2 * len(ODD)


# --- 2 substrings


def test_substrings(spark):
    passage = prose(1, 60)
    single = prose(2, 60).replace(".", "") + "."  # one long sentence
    a = prose(3, 40) + ".\n" + passage + ".\n" + prose(4, 30)
    b = prose(5, 40) + ".\n" + passage + ".\n" + single
    c = single + "\n" + passage + ". " + prose(6, 30)
    clean = prose(7, 300)
    twice = passage.replace("w", "q") + ".\nmiddle words here.\n" + passage.replace("w", "q") + "."
    got = by_id(substrings.dedup_substrings(spark, docs(spark, [a, b, c, clean, twice, a])))
    assert got[0]["text"] == a and got[3]["text"] == clean and got[3]["n_removed"] == 0
    assert passage not in got[1]["text"] and single in got[1]["text"]
    assert passage not in got[2]["text"] and single not in got[2]["text"] and prose(6, 30) in got[2]["text"]
    assert got[4]["text"].count("q") < twice.count("q") and "middle" in got[4]["text"]
    assert words(got[5]["text"]) == []
    short = "Only. Three. Words."
    assert all(r["text"] == short for r in substrings.dedup_substrings(spark, docs(spark, [short] * 3)).collect())


def runs_gone(texts, least):
    """Sentences that go, by all runs of three: places of words, passages as chains of overlapping runs."""
    parsed, seen, gone = [], set(), {}
    for t in texts:
        parts = [re.split(r"(?<=[.!?])\s+", x) for x in (t or "").split("\n")]
        parsed.append([words(x) for y in parts for x in y if words(x)])
    for d, sents in enumerate(parsed):
        at = np.cumsum([0] + [len(x) for x in sents])
        hits = []
        for k in range(len(sents) - 2):
            key = tuple(w for x in sents[k : k + 3] for w in x)
            if key in seen:
                hits.append((at[k], at[k + 3]))
            seen.add(key)
        chains = []
        for x, y in hits:  # in order of x
            if chains and x < chains[-1][1]:
                chains[-1][1] = max(chains[-1][1], y)
            else:
                chains.append([x, y])
        gone[d] = [k for k in range(len(sents)) if any(x <= at[k] and at[k + 1] <= y and y - x >= least for x, y in chains)]
    return gone


@pytest.mark.parametrize("least", [1, 12])
def test_substrings_match_brute_force(spark, least):
    rng = np.random.default_rng(4)
    pool = [" ".join(rng.choice(["a", "b", "c", "d", "e", "f"], rng.integers(1, 5))) + rng.choice([".", "!", "?"]) for _ in range(8)]
    texts = [rng.choice([" ", "\n"]).join(rng.choice(pool, rng.integers(0, 12))) for _ in range(150)] + ODD[:6]
    want = runs_gone(texts, least)
    got = by_id(substrings.dedup_substrings(spark, docs(spark, texts), least))
    assert sum(map(len, want.values())) > 30 and {d: r["removed"] for d, r in got.items()} == want


def test_substrings_of_passages_cut_inside_sentences(spark):
    plain = lambda seed, n: prose(seed, n).replace(".", "")
    short = [plain(20 + i, 7) + "." for i in range(3)]  # 21 words in whole sentences, 61 with the parts of their neighbours
    left, right = plain(30, 20), plain(31, 20)
    text = lambda i: f"{plain(40 + i, 25)} {left}. " + " ".join(short) + f" {right} {plain(50 + i, 25)}."
    line = lambda i: f"{plain(60 + i, 40)}. {short[0]} {short[1]} {plain(70 + i, 40)}."  # noqa: E731  14 shared words alone
    got = by_id(substrings.dedup_substrings(spark, docs(spark, [text(0), text(1), line(0)])))
    assert got[0]["text"] == text(0) and got[1]["removed"] == [1, 2, 3] and left in got[1]["text"] and right in got[1]["text"]
    assert got[2]["text"] == line(0)


def test_equal_runs_share_a_gram():
    rng = np.random.default_rng(0)
    for _ in range(50):
        both, n = rng.integers(1, 1 << 60, 51), rng.integers(0, 60, 4)
        texts = [np.concatenate([rng.integers(1, 1 << 60, n[2 * i]), both, rng.integers(1, 1 << 60, n[2 * i + 1])]) for i in range(2)]
        raw = [" ".join(map(str, t)).encode() for t in texts]
        x = substrings.Sentences(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), 10**6)
        assert set(x.h[x.doc == 0]) & set(x.h[x.doc == 1])


def test_substrings_edges(spark):
    assert substrings.dedup_substrings(spark, docs(spark, [])).count() == 0
    odd = docs(spark, ODD).withColumn("lost", F.lit(1)).withColumn("doc_id", F.when(F.col("doc_id") > 2, F.col("doc_id")))
    got = substrings.dedup_substrings(spark, odd.unionByName(odd)).collect()
    assert len(got) == 2 * len(ODD)
    assert sum(r["text"] == "" for r in got) >= 4


# --- 3 lines


def lines_gone(texts):
    seen, gone = [], set()
    for d, t in enumerate(texts):
        for k, line in enumerate((t or "").split("\n")):
            if s := frozenset(words(line)):
                if any(100 * len(s & o) >= 80 * len(s | o) for o in seen):
                    gone.add((d, k))
                seen.append(s)
    return gone


class Blobs:
    """Lists of index entries, run here and not in workers."""

    def __init__(self, *cols):
        self.data = np.int64(len(cols[0])).tobytes() + b"".join(np.asarray(c).astype(t).tobytes() for c, t in zip(cols, linedup.KINDS))

    def mapInArrow(self, f, schema):
        return [tuple(r.values()) for b in f(iter([pa.RecordBatch.from_arrays([pa.array([self.data], pa.binary())], names=["data"])])) for r in b.to_pylist()]


@pytest.mark.parametrize("m", [200, 1500])
def test_unlike_lines_take_no_exact_tests(monkeypatch, m):
    """A list's pairs by brute force; all exact bounds are worked out for pairs only that the parities leave."""
    rng = np.random.default_rng(m)
    lines = [{int(x) for x in rng.integers(0, 1 << 40, rng.integers(8, 90))} for _ in range(m // 3)]
    lines += [{*sorted(s)[k % 3 :], *range(k % 2)} for k, s in enumerate(lines + lines)]
    lines = [lines[k] for k in rng.permutation(len(lines))]
    m, n = len(lines), np.array([len(s) for s in lines])
    parity, upper = np.zeros(m, np.uint64), np.zeros(m, np.uint64)
    for k, s in enumerate(lines):
        h = textops.mix(np.array(sorted(s), np.uint64))
        bit = np.uint64(1) << (h & np.uint64(63))
        parity[k], over = np.bitwise_xor.reduce(bit), np.bitwise_xor.reduce(np.where(h & np.uint64(64), bit, np.uint64(0)))
        upper[k] = over if len(s) >= linedup.WIDE else 0
    blobs = Blobs(np.full(m, 9), np.arange(m), np.zeros(m), parity, upper, n, np.zeros(m), np.full(m, 2))
    seen, need = [], linedup._need
    monkeypatch.setattr(linedup, "_need", lambda a, *x: (seen.append(len(a)), need(a, *x))[1])
    got = linedup.candidates(blobs, (80, 100), 0, None)
    assert sum(seen) < m * m / 2 / 5

    def passes(a, b):
        both = -(-80 * (n[a] + n[b]) // 180)
        wide = min(n[a], n[b]) >= linedup.WIDE
        x, y = int(parity[a] ^ parity[b]), int(upper[a] ^ upper[b])
        return min(n[a], n[b]) >= both and (y.bit_count() + (x ^ y).bit_count() if wide else x.bit_count()) <= n[a] + n[b] - 2 * both

    want = {(a, b) for b in range(m) for a in range(b) if passes(a, b)}
    assert {(a, b) for a, _, b, _, _ in got} == want and len(got) == len(want)
    assert {(a, b) for a in range(m) for b in range(a + 1, m) if 100 * len(lines[a] & lines[b]) >= 80 * len(lines[a] | lines[b])} <= want
    for after, until in ((0, 1), (1, 3)):
        nearest = {}
        for a, b in sorted(want, key=lambda x: -x[0]):
            nearest.setdefault(b, []).append(a)
        few = {(a, b, len(x) > until) for b, x in nearest.items() for a in x[after:until]}
        assert {(a, b, more) for a, _, b, _, more in linedup.candidates(blobs, (80, 100), after, until)} == few


def near(text, changes, tag):
    w = text.split()
    for i in changes:
        w[i] = f"{tag}{i}"
    return " ".join(w)


def test_lines(spark, monkeypatch):
    base = prose(1, 40)
    texts = [base + "\nThe end.\nA b c d", near(base, [3, 7], "x") + "\nthe END.", near(base, [1, 2, 3, 4, 5, 9], "y"), "a b c d e\n\n \nthe end.", base + "\n" + base, *ODD]
    rng = np.random.default_rng(5)
    common = [f"c{i}" for i in range(12)]
    texts += ["\n".join(" ".join(rng.choice(common, rng.integers(1, 9))) for _ in range(30)) for _ in range(4)]  # short lines of frequent words
    texts += [near(base, rng.choice(40, rng.integers(0, 9), replace=False), f"v{i}") for i in range(60)]  # one group of near copies
    want = lines_gone(texts)
    df = docs(spark, texts)
    for rounds, block in (((2, 8, 64, None), 8192), ((1, 2, None), 16)):
        monkeypatch.setattr(linedup, "ROUNDS", rounds)
        monkeypatch.setattr(linedup, "BLOCK", block)
        got = by_id(linedup.dedup_lines(spark, df))
        assert {(d, k) for d, r in got.items() for k in r["removed"]} == want
    assert got[0]["text"] == texts[0]
    kept = linedup.filter_lines(spark, df.withColumn("lost", F.lit(7)).withColumn("_rest", F.lit("r")))
    assert kept.columns == [*df.columns, "lost", "_rest"]
    assert 4 not in {r["doc_id"] for r in kept.collect()} and {0, 5, 6, 7} <= {r["doc_id"] for r in kept.collect()}
    assert linedup.dedup_lines(spark, docs(spark, [])).count() == 0
    repeated = df.withColumn("doc_id", F.when(F.col("doc_id") > 2, F.col("doc_id")))
    assert linedup.dedup_lines(spark, repeated.unionByName(repeated)).count() == 2 * len(texts)


# --- 4 quality


def test_quality(spark):
    good = [prose(i, 80).capitalize() for i in range(150)]
    bad = [" | ".join(f"L{i}{j}" for j in range(40)) for i in range(60)] + ["BUY!! " * 30 for _ in range(40)]
    texts, y = good + bad + ODD, [1] * 150 + [0] * 100
    df = docs(spark, texts, [("good.org" if i < 150 else "bad.org") for i in range(len(texts))]).withColumn("x", F.lit(1))
    labels = spark.createDataFrame([(i, v, 0) for i, v in enumerate(y) if i % 3] + [(0, 1, 0), (0, 0, 0), (999, 1, 1), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = by_id(quality.quality_report(spark, df, labels))
    held = [i for i in range(250) if i % 3 == 0]
    assert sum(got[i]["kept"] == bool(y[i]) for i in held) >= 0.97 * len(held)
    out = quality.filter_quality(spark, df, labels)
    assert out.columns == df.columns and {r["doc_id"] for r in out.collect()} == {i for i, r in got.items() if r["kept"]}
    assert quality.quality_report(spark, docs(spark, []), labels).count() == 0
    assert all(r["p"] == 0.5 for r in quality.quality_report(spark, docs(spark, ODD), labels.limit(0)).collect())


def posterior_brute(rows, weight=0.5):
    """(host_rate, site_rate, score) of rows (host, path, p), by loops."""
    def strength(groups):  # (sum, number, prior) of each
        n = sum(g[1] for g in groups)
        q = sum(g[1] * (g[0] / g[1] - g[2]) ** 2 for g in groups)
        between = max(0.0, (q - sum(g[2] * (1 - g[2]) for g in groups)) / n)
        return min(1e4, max(1.0, sum(g[1] * g[2] * (1 - g[2]) for g in groups) / n / max(between, 1e-9) - 1))

    def add(key):
        out = collections.defaultdict(lambda: [0.0, 0])
        for r in rows:
            out[key(r)][0] += r[2]
            out[key(r)][1] += 1
        return out

    logit = lambda x: math.log(min(1 - 1e-6, max(1e-6, x)) / (1 - min(1 - 1e-6, max(1e-6, x))))
    prior = (sum(r[2] for r in rows) + 0.5) / (len(rows) + 1)
    hosts, paths = add(lambda r: r[0]), add(lambda r: r[:2])
    a = strength([(s, n, prior) for s, n in hosts.values()])
    host = {h: (s + a * prior) / (n + a) for h, (s, n) in hosts.items()}
    b = strength([(s, n, host[h]) for (h, _), (s, n) in paths.items()])
    out = []
    for h, p, x in rows:
        s, n = paths[h, p]
        site = (s - x + b * host[h]) / (n - 1 + b)
        out.append((host[h], site, 1 / (1 + math.exp(-logit(x) - weight * (logit(site) - logit(prior))))))
    return out


def test_posterior_matches_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [(f"h{rng.integers(5)}" if rng.random() < 0.9 else None, rng.choice(["a", "b", None]), float(rng.beta(2, 1 + rng.integers(4)))) for _ in range(400)] + [("only", "x", 0.01)]
    df = spark.createDataFrame([(i, h, p, x) for i, (h, p, x) in enumerate(rows)], "doc_id long, host string, path string, p double")
    got = by_id(quality.posterior(df, Scratch(spark, "t")))
    for i, want in enumerate(posterior_brute(rows)):
        assert [got[i][c] for c in ("host_rate", "site_rate", "score")] == pytest.approx(want, rel=1e-9)


def test_quality_shrinks_sparse_sites(spark):
    rows = [("big", "p", 0.9)] * 200 + [("low", "p", 0.2)] * 200 + [("rare", "p", 0.5)] * 1 + [(None, None, 0.5)] * 2
    df = spark.createDataFrame([(i, h, p, x) for i, (h, p, x) in enumerate(rows)], "doc_id long, host string, path string, p double")
    got = by_id(quality.posterior(df, Scratch(spark, "t")))
    prior = sum(r[2] for r in rows) / len(rows)
    assert len(got) == len(rows)
    assert got[0]["score"] > got[0]["p"] and got[200]["score"] < got[200]["p"]
    assert abs(got[400]["site_rate"] - prior) < 0.1


# --- 5 packing


def test_packing(spark):
    from tokenizers import Tokenizer

    texts = [*ODD, "word " * 4095, "word " * 4096, "word " * 9000, "<|endoftext|> <|ENDOFTEXT|> it's DON'T 12ab", "Café İx ŞK", *[prose(i, 50 * i) for i in range(1, 60)]]
    df = docs(spark, texts).withColumn("length", F.lit(0))
    got = packing.pack(spark, df).toPandas()
    tok = Tokenizer.from_file(packing.default_tokenizer())
    for d, g in got.groupby("doc_id"):
        ids = tok.encode(texts[d] or "", add_special_tokens=False).ids + [1]
        g = g.sort_values("piece")
        assert list(g.piece) == list(range(-(-len(ids) // 4096))) and g.length.sum() == len(ids)
        for r in g.itertuples():
            part = ids[r.start : r.start + r.length]
            assert r.start == 4096 * r.piece and len(part) == r.length and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
    assert set(got.doc_id) == set(range(len(texts)))
    g = got.sort_values(["sequence_id", "offset"])
    assert (g.groupby("sequence_id").length.cumsum() - g.length == g.offset).all()
    per = g.groupby("sequence_id").length.sum()
    assert per.max() <= 4096 and len(per) <= -(-got.length.sum() // 4096) + 1
    assert packing.pack(spark, docs(spark, [])).count() == 0
    assert packing.pack(spark, df.filter("doc_id = 3").unionByName(df.filter("doc_id = 3"))).count() == 2
    whole = packing.pack(spark, df, ids=True).filter("doc_id = 3").first()
    assert list(whole["ids"]) == tok.encode("one", add_special_tokens=False).ids + [1]


@pytest.mark.parametrize("name, by_word", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_encode_with_any_tokenizer(name, by_word):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    texts = [t or "" for t in ODD] + [prose(1, 50), "It's THE end, isn't it?", "Æther – naïve ", "<|endoftext|> x", "a  b\n\nc"]
    want = [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]
    assert packing.by_word(path) == by_word
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.encode([t.encode() for t in texts], path)] == want


@pytest.mark.parametrize("n, mu", [(0, 1), (1, 1), (500, 6.5), (5000, 5)])
def test_pack_lengths(n, mu):
    lens = np.clip(np.random.default_rng(n).lognormal(mu, 1, n).astype(int), 1, 512)
    count = np.bincount(lens, minlength=513)
    plan, used = packing.pack_lengths(count, 512), np.zeros(513, int)
    for pattern, times in plan:
        assert sum(pattern) <= 512
        for x in pattern:
            used[x] += times
    assert (used == count).all()
    big = sum(x > 256 for x in lens)
    assert sum(t for _, t in plan) <= max(big, -(-lens.sum() // 512)) + 0.02 * n + 1


# --- 6 top-k


def brute_top(rows, k=5):
    out = {}
    for q, v in rows:
        if q % 50 == 0:
            c = sorted((-int(np.dot(v, w)), i) for i, w in rows if i != q and len(w) == len(v))[:k]
            out[q] = [(i, -s) for s, i in c]
    return out


def test_topk(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "QUERIES", 3)
    monkeypatch.setattr(topk, "PIVOTS", 5)
    monkeypatch.setattr(topk, "SEEDS", 20)
    rng = np.random.default_rng(0)
    vec = [rng.normal(size=8).astype(np.float32).tolist() for _ in range(300)]
    vec += [vec[0]] * 100  # a hot vector, ties
    rows = list(enumerate(vec)) + [(450, [1.0, 2.0]), (451, [3.0, -1.0]), (500, [2.0, 2.0]), (550, [])]
    bad = [(600, None), (601, [None] * 8), (602, [float("nan")] * 8), (650, [float("inf")] + [0.0] * 7), (None, vec[1])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x"))
    got = collections.defaultdict(list)
    for r in topk.top_k(spark, df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    want = brute_top([(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows])
    assert dict(got) == {q: v for q, v in want.items() if v}
    assert topk.top_k(spark, df.limit(0)).count() == 0
    huge = spark.createDataFrame([(i, [3e6 * (i + 1), 2e6]) for i in range(3)], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in topk.top_k(spark, huge).orderBy("rank").collect()] == [2, 1]


# --- 7 near-duplicates


def near_sets(texts, n):
    out = []
    for t in texts:
        w = words(t)
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    return out


def near_components(texts, n=4):
    sets = near_sets(texts, n)
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(range(len(sets)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return sets, [find(i) for i in range(len(sets))]


def test_minhash(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    base, rng = prose(1, 200), np.random.default_rng(3)
    texts = [*ODD, base, base.upper(), near(base, [5], "x"), near(base, [5, 60, 120], "y"), near(base, range(0, 200, 9), "z"), "a b c", "A b\nc", "a b c d", "a b c d e", "a b c d e f"]
    texts += [near(base, rng.choice(200, rng.integers(1, 9), replace=False), f"v{i}_") for i in range(70)]  # chains of near copies
    texts += ["p q r s t " + prose(100 + i, 12) for i in range(30)]  # a shared line, not near
    sets, comp = near_components(texts)
    df = docs(spark, texts).withColumn("component", F.lit(1))
    got = by_id(minhash.near_duplicates(spark, df, shingle=4))
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i]["component_id"] for i in range(len(texts))] == comp
    assert all(r["kept"] == (i == comp[i]) for i, r in got.items())
    out = minhash.drop_near_duplicates(spark, df, 4)
    assert out.columns == df.columns and {r["doc_id"] for r in out.collect()} == {i for i, c in enumerate(comp) if i == c}


def test_minhash_edges(spark):
    assert minhash.near_duplicates(spark, docs(spark, []), shingle=4).count() == 0
    odd = docs(spark, ODD).withColumn("doc_id", F.when(F.col("doc_id") > 3, F.col("doc_id")))
    got = minhash.near_duplicates(spark, odd.unionByName(odd), shingle=4).collect()
    assert len(got) == 2 * len(ODD) and all(r["kept"] for r in got)
    assert minhash.drop_near_duplicates(spark, odd).count() == len(ODD)


def lost_by_estimate():
    """Texts of 8 and 7 words, 5 and 4 shingles, whose registers agree in a band but for less than the estimate asks."""
    for r in range(0, 40_000, 2000):
        texts = [" ".join(f"r{r + i}w{k}" for k in range(n)) for i in range(2000) for n in (8, 7)]
        raw = [t.encode() for t in texts]
        buf, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
        regs = minhash.registers(*textops.shingle_sets(*textops.words(buf, off), 4))
        same = regs[::2] == regs[1::2]
        band = same[:, : minhash.BANDS * minhash.ROWS].reshape(-1, minhash.BANDS, minhash.ROWS).all(2)
        low = np.flatnonzero((minhash.estimate(same.sum(1)) < minhash._floor(0.8)) & band.any(1))
        if len(low):
            k = low[0]
            return texts[2 * k : 2 * k + 2], regs[2 * k : 2 * k + 2], int(band[k].argmax())


def test_minhash_links_any_text_of_a_document(spark):
    base, other = prose(1, 80), prose(2, 80)
    rows = [(1, base), (2, other), (3, base + " x"), (3, other + " y"), (4, prose(3, 80)), (5, prose(3, 80)), (5, None), (6, prose(4, 80))]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOC)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark, df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}


def test_minhash_links_small_sets_whatever_their_estimate(spark):
    texts, regs, band = lost_by_estimate()
    assert near_components(texts)[1] == [0, 0]
    got = by_id(minhash.near_duplicates(spark, docs(spark, texts), shingle=4))
    assert [got[i]["component_id"] for i in (0, 1)] == [0, 0]
    rows = [(1, 0, 0, 2, i, i, band, r.tobytes(), t, n) for i, (t, r, n) in enumerate(zip(texts, regs, (5, 4)))]
    members = spark.createDataFrame(rows, "key long, p int, q int, side int, id long, c long, band int, sketch binary, text string, n long")
    assert [tuple(r) for r in minhash._across(members, (80, 100), 4).collect()] == [(0, 1)]


def test_registers_estimate():
    rng = np.random.default_rng(0)
    pool = textops.mix(np.arange(20_000, dtype=np.uint64))
    for share in (0.5, 0.8, 0.95):
        both, own = int(1000 * share), int(1000 * (1 - share) / 2)
        errors = []
        for _ in range(20):
            x = rng.permutation(pool)
            a, b = np.sort(x[: both + own]), np.sort(np.concatenate([x[:both], x[both + own : both + 2 * own]]))
            r = minhash.registers(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            errors.append(minhash.estimate((r[0] == r[1]).sum()) - both / (both + 2 * own))
        assert abs(np.mean(errors)) < 0.03


# --- 8 toxicity


def test_toxicity(spark):
    rng = np.random.default_rng(1)
    y = rng.random(900) < 0.25
    texts = [prose(i, 60, 300) for i in range(900)]
    for i in np.flatnonzero(y):
        w = texts[i].split()
        w[int(rng.integers(60))] = rng.choice(["Idiot", "scum,", "pathetic."])
        texts[i] = " ".join(w)
    df = docs(spark, texts + ODD).withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(i, 1, int(v)) for i, v in enumerate(y)] + [(5, 1, 1 - int(y[5])), (None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    got = by_id(toxicity.toxicity(spark, df, labels))
    assert len(got) == len(texts) + len(ODD)
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] == (i in set(held)) for i in range(900))
    assert sum(got[i]["predicted"] == int(y[i]) for i in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert by_id(toxicity.toxicity(spark, df, flipped)) == got  # held-out labels teach nothing
    assert all(r["score"] == 0.5 for r in toxicity.toxicity(spark, docs(spark, ODD), labels.limit(0)).collect())
    assert toxicity.toxicity(spark, docs(spark, []), labels).count() == 0


def test_ftrl_matches_scalar_steps():
    """Each coordinate by the update of the method, on its own."""
    rng = np.random.default_rng(2)
    alpha, beta, l1, l2 = 0.7, 1.5, 0.4, 0.2
    model, z, n = toxicity.Ftrl(5, alpha, beta, l1, l2), collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(300):
        at = rng.choice(32, rng.integers(0, 8), replace=False)
        y = int(7 in at or rng.random() < 0.2)
        model.step(at, y)
        own = [*at.tolist(), 32]
        w = {i: weight(i) for i in own}
        g = 1 / (1 + math.exp(-sum(w.values()))) - y
        for i in own:
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
            n[i] += g * g
    at, w = model.sparse()
    assert {int(i): pytest.approx(x, abs=1e-9) for i, x in zip(at, w)} == {i: weight(i) for i in range(33) if weight(i)}


# --- 9 Katz


def good_turing(counts):
    """r* / r for r from 1 to 5 by Katz's formula, 1 above; (r - 1/2) / r where it is not between 0 and 1."""
    n = collections.Counter(counts.values())
    out = {}
    for r in range(1, 6):
        rest = 6 * n[6] / n[1] if n[1] else 1
        ratio = ((r + 1) * n[r + 1] / n[r] / r - rest) / (1 - rest) if n[r] and rest < 1 else -1
        out[r] = ratio if 0 < ratio < 1 else 1 - 0.5 / r
    return lambda c: out.get(c, 1.0)


def katz_brute(texts, ids):
    tok = {i: words(t) + ["</s>"] for i, t in zip(ids, texts)}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in ids}
    c1, c2 = collections.Counter(), collections.Counter()
    for i in ids:
        if not out[i]:
            c1.update(tok[i])
            c2.update(zip(["<s>"] + tok[i][:-1], tok[i]))
    n, v = sum(c1.values()), len(c1)
    d1, d2 = good_turing(c1), good_turing(c2)
    lost = sum(c * (1 - d1(c)) for c in c1.values())
    whole = n if lost > 0 else n + 1
    p1 = {w: d1(c) * c / whole for w, c in c1.items()}
    unk = (1 - sum(p1.values())) if n else 1.0
    seen = collections.defaultdict(dict)
    for (h, w), c in c2.items():
        seen[h][w] = d2(c) * c
    total = c1 | {"<s>": sum(not x for x in out.values())}
    model = {}
    for h, s in seen.items():
        t = total[h] + (sum(s.values()) >= total[h] * (1 - 1e-12))
        alpha = (1 - sum(s.values()) / t) / (1 - sum(p1[w] for w in s))
        model[h] = ({w: x / t for w, x in s.items()}, alpha)
        rest = sum(p for w, p in p1.items() if w not in s) + unk
        assert math.isclose(sum(model[h][0].values()) + alpha * rest, 1, abs_tol=1e-9)  # exactly normalised
    rows = {}
    for i in ids:
        s = 0.0
        for h, w in zip(["<s>"] + tok[i][:-1], tok[i]):
            m, a = model.get(h, ({}, 1.0))
            s += math.log10(m[w] if w in m else a * p1.get(w, unk))
        rows[i] = (out[i], len(tok[i]), sum(w in c1 for w in tok[i]), n, sum(math.log10((c1[w] + 1) / (n + v + 1)) for w in tok[i]), s)
    return rows


@pytest.mark.parametrize("frequent", [(1 << 18, 1 << 20), (20, 30)])
def test_katz(spark, monkeypatch, frequent):
    monkeypatch.setattr(katz, "WORDS", frequent[0])
    monkeypatch.setattr(katz, "BIGRAMS", frequent[1])
    texts = [prose(i, 30 + i, 60 + 8 * (i % 9)) for i in range(80)] + ODD
    df = docs(spark, texts).withColumn("n_tokens", F.lit("x"))
    got, want = by_id(katz.katz_scores(spark, df)), katz_brute(texts, range(len(texts)))
    assert len(got) == len(texts)
    for i, w in want.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4]
        assert math.isclose(r["base_score"], w[4], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(r["score"], w[5], rel_tol=1e-9, abs_tol=1e-9)


def test_filters_take_a_bit_a_place(spark):
    """A task that fills a filter holds its packed bits, not a byte for each, and hands them on in pieces."""
    keys, rows = np.random.default_rng(3).integers(-(2**62), 2**62, 1_000_000), []

    class Keys:
        """As much of a DataFrame as ``build`` asks for, whose one task runs here."""

        sparkSession = spark

        def select(self, *_):
            return self

        filter = repartition = select

        def count(self):
            return len(keys)

        def mapInArrow(self, run, schema):
            for b in run(pa.RecordBatch.from_arrays([pa.array(keys[i : i + 10_000])], names=["key"]) for i in range(0, len(keys), 10_000)):
                rows.extend(b.to_pylist())
            return self

        def toLocalIterator(self):
            return iter(rows)

    tracemalloc.start()
    bits = filters.build(Keys(), "key")
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(bits) == 1 << 21 and most < 6 * len(bits) and len(rows) == 2
    assert filters.has(keys, bits).all() and filters.has(keys + 2**62, bits).mean() < 0.05


def test_katz_at_work(spark, monkeypatch, tmp_path):
    """The query, with filters that let nothing be known in the tasks and pieces of a few records."""
    monkeypatch.setattr(katz, "WORDS", 10)
    monkeypatch.setattr(katz, "BIGRAMS", 5)
    monkeypatch.setattr(katz, "SPLIT", 50)
    monkeypatch.setattr(filters, "build", lambda *_: filters.OPEN)
    texts = [prose(i, 30 + i, 60 + 8 * (i % 9)) for i in range(80)]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got, want = by_id(queries.op9_katz(spark, str(tmp_path))), katz_brute(texts, range(len(texts)))
    assert all(math.isclose(got[i]["score"], w[5], rel_tol=1e-9, abs_tol=1e-9) for i, w in want.items())


def test_katz_beats_base_where_words_follow_words(spark):
    rng, texts = np.random.default_rng(0), []
    for _ in range(120):
        w = [int(rng.integers(80))]
        for _ in range(60):
            w.append((3 * w[-1] + 1) % 80 if rng.random() < 0.8 else int(rng.integers(80)))
        texts.append(" ".join(f"w{x}" for x in w))
    held = katz.katz_scores(spark, docs(spark, texts)).filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert held["s"] > 0.8 * held["b"]


def test_katz_edges(spark):
    assert katz.katz_scores(spark, docs(spark, [])).count() == 0
    odd = docs(spark, ODD).withColumn("doc_id", F.when(F.col("doc_id") > 3, F.col("doc_id")))
    got = katz.katz_scores(spark, odd.unionByName(odd)).collect()
    assert len(got) == 2 * len(ODD) and sum(r["doc_id"] is None for r in got) == 8 and all(math.isfinite(r["score"]) for r in got)
    unknown = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][0]
    r = katz.katz_scores(spark, docs(spark, ["never seen words"], first=unknown)).first()
    assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (True, 4, 0, 0)


# --- 10 rules


def rules_brute(t):
    w = words(t, low=False)
    g = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = collections.Counter(g)
    hit = {i + j for i, x in enumerate(g) if n[x] > 1 for j in range(5)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    symbols = sum(c in "#*$%&|<>" for c in t or "")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)


def test_rules(spark):
    rep = "a b c d e f a b c d e f g h i j k l m n o p q r s t u v w x y z " * 1
    texts = [*ODD, prose(1, 100), rep, "x y z w v " * 4, prose(2, 40) + "\n" + prose(2, 40), " | ".join(["Home", "News"] * 20), "WOW!! " * 20, prose(3, 30) + "\nAll rights reserved.", "# $ % & " * 10]
    df = docs(spark, texts).withColumn("kept", F.lit("x")).withColumn("_words", F.lit(1))
    got = by_id(rules.rules_report(df))
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == rules_brute(t), i
    k = len(ODD)
    assert [got[i]["kept"] for i in range(k, len(texts))] == [True, False, False, False, False, False, True, False]
    full = rules.clean_lines(df)
    assert full.columns == [*df.columns, "quality"]
    assert full.filter(f"doc_id = {k + 6}").first()["quality"]["text"] == prose(3, 30)
    assert rules.rules_report(docs(spark, [])).count() == 0
    for n in (1, 2, 3, 4, 5, 7):
        w = spark.createDataFrame([(words("a b a b a b c d e f g h a b c d e f"),)], "w array<string>")
        g = words("a b a b a b c d e f g h a b c d e f")
        c = collections.Counter(tuple(g[i : i + n]) for i in range(len(g) - n + 1))
        want = len({i + j for i in range(len(g) - n + 1) if c[tuple(g[i : i + n])] > 1 for j in range(n)})
        assert w.select(rules.repeat_words(F.col("w"), n)).first()[0] == want


# --- registration


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    a, b = queries.queries()[name](spark, sf).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    a, b = (x[cols].astype(str).sort_values(cols).reset_index(drop=True) for x in (a, b))
    assert (a == b).all().all()


def test_names():
    assert sorted(queries.queries(), key=lambda n: int(n[2:].split("_")[0])) == [f"op{i}_{x}" for i, x in enumerate(("mixing", "substrings", "lines", "quality", "packing", "topk", "minhash", "toxicity", "katz", "rules"), 1)]
