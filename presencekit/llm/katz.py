"""Operator 9: language-model scores by Katz backoff.

Bigrams over unigrams over one unknown word. Counts r up to 5 are discounted by Good-Turing,
d_r = ((r+1) n_{r+1} / (r n_r) - A) / (1 - A) with A = 6 n_6 / n_1. A history v has the seen words' discounted shares, and
every other word w gets alpha(v) P(w), alpha(v) being what is left over 1 - sum of P over the seen words: the words'
probabilities sum to one. Every bigram is kept, single ones too.

The model is three tables in the shared folder: bigrams (v, w, c), histories (v, log alpha, log total), words (code, c, log P).
Each token is scored by recursion: the bigram, if the model has it, gives log d_c c - log total(v); if not, it backs off
to log alpha(v) and asks for the word, and an absent word takes the mass of unseen ones. The bounded most frequent part of
each table is sent to the tasks; other tokens meet the bigrams in one shuffle of compact blobs and the tables of words in
a second, smaller one. All tokens of a training text are in the model, so those that a Bloom filter of bounded size shows not
to be among the bigrams seen twice were seen once, and ask for nothing. All counts cover all training texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch
from . import exchange, filters, textops, vocabulary

U = np.uint64
START, END = U(1 << 62), U((1 << 62) + 1)
#: Codes of words outside the frequent table have this bit.
RARE = U(1 << 63)
#: Entries of the frequent tables of words and bigrams; largest discounted count.
WORDS, BIGRAMS, K = 1 << 17, 1 << 19, 5
#: Tokens that a mapper combines before it emits, and occurrences of a history that one part counts.
COMBINE, SPLIT = 400_000, 100_000


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 7; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def codes(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A frequent word's number, else its hash with the top bit set."""
    at = textops.lookup(h, words)
    return np.where(at >= 0, at.astype(np.uint64), (h >> U(1)) | RARE)


def tokens(buf: np.ndarray, off: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(history code, token code, text number) of every token of every text, the end included."""
    h, w = textops.words(buf, off)
    n = len(off) - 1
    c = codes(h, words)
    at = w[1:] + np.arange(n)  # places of the ends
    tok = np.empty(len(c) + n, np.uint64)
    is_end = np.zeros(len(tok), bool)
    is_end[at] = True
    tok[is_end], tok[~is_end] = END, c
    hist = np.empty(len(tok), np.uint64)
    hist[1:] = tok[:-1]
    hist[w[:-1] + np.arange(n)] = START
    return hist, tok, np.repeat(np.arange(n), np.diff(w) + 1)


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return textops.mix(textops.mix(v) * U(0x9E3779B97F4A7C15) + w)


def discounts(n: dict[int, int]) -> np.ndarray:
    """d_r for r = 0..K + 1; the last is 1. Where counts of counts are too few to give 0 < d_r < 1, (r - 1/2) / r stands."""
    d = np.ones(K + 2)
    d[0] = 0
    a = (K + 1) * n.get(K + 1, 0) / n[1] if n.get(1) else 1.0
    for r in range(1, K + 1):
        x = ((r + 1) * n.get(r + 1, 0) / (r * n[r]) - a) / (1 - a) if n.get(r) and a < 1 else 0
        d[r] = x if 0 < x < 1 else (r - 0.5) / r
    return d


def _runs(*cols: np.ndarray) -> np.ndarray:
    """Places at which a run of equal values begins in sorted columns."""
    new = np.ones(len(cols[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
    return np.flatnonzero(new)


def bigram_counts(train: DataFrame, words: np.ndarray, often: np.ndarray, n_docs: int) -> DataFrame:
    """(v, w, c, kind): kind 0, all bigrams; kind 1, c bigrams were seen v times (v up to K + 1).

    Parts go by history, those of frequent histories (``often``: their counts) split by the word, and rows come sorted by
    history and word."""
    n_parts = exchange.parts(train)
    split = np.append(-(-often // SPLIT), max(1, -(-n_docs // SPLIT))).astype(np.uint64)

    def part_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
        at = np.where(v == START, U(len(often)), v)
        s = np.ones(len(v), np.uint64)
        s[at < RARE] = split[at[at < RARE].astype(np.int64)]
        return textops.mix(textops.mix(v) * U(0x9E3779B97F4A7C15) + textops.mix(w) % s)

    def records(batches):
        held, n = [], 0

        def out():
            v, w = (np.concatenate(x) for x in zip(*held))
            k = np.lexsort((w, v))
            v, w = v[k], w[k]
            at = _runs(v, w)
            c = np.diff(np.append(at, len(v)))
            v, w = v[at], w[at]
            return (part_key(v, w) % U(n_parts)).astype(np.int32), [v, w, c.astype(np.uint32)]

        for b in batches:
            for _, _, buf, off in textops.chunks(b.column(0)):
                v, w, _ = tokens(buf, off, words)
                held.append((v, w))
                n += len(v)
                if n > COMBINE:
                    yield out()
                    held, n = [], 0
        if held:
            yield out()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(K + 2, np.int64)
        for _, (v, w, c) in exchange.gather(batches, [np.uint64, np.uint64, np.uint32], lambda x: part_key(x[0], x[1]), n_parts):
            k = np.lexsort((w, v))
            v, w, c = v[k], w[k], c[k].astype(np.int64)
            at = _runs(v, w)
            c = np.add.reduceat(c, at) if len(at) else c
            seen += np.bincount(c[c <= K + 1], minlength=K + 2)
            yield pa.RecordBatch.from_arrays([pa.array(textops.signed(v[at])), pa.array(textops.signed(w[at])), pa.array(c), pa.array(np.zeros(len(at), np.int32))], names=["v", "w", "c", "kind"])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, K + 2)), pa.array(np.zeros(K + 1, np.int64)), pa.array(seen[1:]), pa.array(np.ones(K + 1, np.int32))], names=["v", "w", "c", "kind"])

    counted = train.select("text").mapInArrow(lambda it: exchange.scatter(records(it), 1), exchange.SCHEMA)
    return exchange.shuffled(counted).mapInArrow(add, "v long, w long, c long, kind int")


def _keys(pairs: DataFrame) -> DataFrame:
    """(key) of bigrams (v, w)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = pair_key(*(textops.unsigned(b.column(x).to_numpy()) for x in ("v", "w")))
            yield pa.RecordBatch.from_arrays([pa.array(textops.signed(key))], names=["key"])

    return pairs.select("v", "w").mapInArrow(run, "key long")


class Model:
    """A fitted model: tables ``pairs`` (v, w, c) and ``words`` (code, c, lp, la, lt), their frequent parts and its totals."""

    def __init__(self, spark: SparkSession, train: DataFrame, sc: Scratch) -> None:
        self.sc = sc
        counts = sc.save(vocabulary.word_counts(train), "counts")
        sc.tidy()
        self.docs = docs = train.count()
        self.top, self.top_c, low_word = vocabulary.frequent(counts, "w", WORDS)
        top, top_c = self.top, self.top_c
        row = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
        self.n, self.v = row["n"] + docs, row["v"] + (docs > 0)
        few = {r["c"]: r["k"] for r in counts.filter(F.col("c") <= K + 1).groupBy("c").agg(F.count("*").alias("k")).collect()}
        if 0 < docs <= K + 1:
            few[docs] = few.get(docs, 0) + 1
        d1 = discounts(few)
        lost = sum(r * few.get(r, 0) * (1 - d1[r]) for r in range(1, K + 1))
        whole = float(self.n if lost > 0 else self.n + 1)
        prob = lambda c: d1[np.minimum(c, K + 1)] * c / whole
        self.unknown = (whole - self.n + lost) / whole if self.n else 1.0
        self.base0 = -np.log10(self.n + self.v + 1)
        end = prob(np.array([docs]))[0] if docs else self.unknown

        pairs = sc.save(bigram_counts(train, top, top_c, docs), "pairs")
        sc.tidy()
        n2 = {r["v"]: r["n"] for r in pairs.filter("kind = 1").groupBy("v").agg(F.sum("c").alias("n")).collect()}
        self.d2 = d2 = discounts(n2)
        self.pairs = pairs = pairs.filter("kind = 0")
        coded = counts.filter(F.col("c") < low_word).select(F.shiftrightunsigned("w", 1).bitwiseOR(F.lit(-(2**63))).alias("code"), "c")
        share = lambda d, c: F.get(F.array(*[F.lit(float(x)) for x in d]), F.least(F.col(c), F.lit(K + 1)).cast("int")) * F.col(c)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """What each history's seen words take: of its own mass (s of n) and of the frequent words' (p)."""
            for b in batches:
                if not len(b):
                    continue
                v, w, c = textops.unsigned(b.column("v").to_numpy()), textops.unsigned(b.column("w").to_numpy()), b.column("c").to_numpy()
                p, low = np.zeros(len(v)), w < START
                p[low], p[w == END] = prob(top_c[w[low].astype(np.int64)]), end
                at = _runs(v)
                got = [np.add.reduceat(x, at) for x in (d2[np.minimum(c, K + 1)] * c, p, c)]
                yield pa.RecordBatch.from_arrays([pa.array(textops.signed(v[at])), *map(pa.array, got)], names=["v", "s", "p", "n"])

        zero = F.lit(0.0)
        other = pairs.filter("w < 0").join(coded.withColumnRenamed("c", "cw"), F.col("w") == F.col("code"))
        other = other.select("v", zero.alias("s"), (share(d1, "cw") / F.lit(whole)).alias("p"), F.lit(0).cast("long").alias("n"))
        hist = pairs.select("v", "w", "c").mapInArrow(sums, "v long, s double, p double, n long").unionByName(other)
        hist = hist.groupBy("v").agg(*[F.sum(x).alias(x) for x in ("s", "p", "n")])
        # a history without discounted counts would leave nothing: its total grows by one
        total = F.when(F.col("s") >= F.col("n") * (1 - 1e-12), F.col("n") + 1.0).otherwise(F.col("n").cast("double"))
        hist = hist.withColumn("t", total).select("v", F.log10((1 - F.col("s") / F.col("t")) / F.greatest(F.lit(1e-12), 1 - F.col("p"))).alias("la"), F.log10("t").alias("lt"))
        hist = sc.save(hist, "histories")
        rows = hist.filter("v >= 0").toArrow()  # frequent words and the start: bounded
        code, la, lt = textops.unsigned(rows["v"].to_numpy().astype(np.int64)), rows["la"].to_numpy(), rows["lt"].to_numpy()
        #: By frequent word, then the start: log alpha, log total. By frequent word, then the end: log P.
        self.la, self.lt = np.zeros(len(top) + 1), np.zeros(len(top) + 1)
        at = np.where(code == START, U(len(top)), code).astype(np.int64)
        self.la[at], self.lt[at] = la, lt
        self.lp = np.log10(np.append(prob(top_c), end))
        lp = F.log10(share(d1, "c") / F.lit(whole))
        words = coded.join(hist.select(F.col("v").alias("code"), "la", "lt"), "code", "left")
        self.words = sc.save(words.select("code", "c", lp.alias("lp"), F.coalesce("la", zero).alias("la"), F.coalesce("lt", zero).alias("lt")), "words")
        sc.tidy("histories", "counts")
        # bigrams of frequent words only are sent to the tasks
        known = pairs.filter("v >= 0 and w >= 0")
        low_pair = vocabulary.level(known, BIGRAMS)
        rows = known.filter(F.col("c") >= low_pair).select("v", "w", "c").toArrow()
        key = pair_key(*(textops.unsigned(rows[x].to_numpy().astype(np.int64)) for x in ("v", "w")))
        c = rows["c"].to_numpy()[np.argsort(key)].astype(np.int64)
        self.pair_keys, self.pair_y = np.sort(key), np.log10(d2[np.minimum(c, K + 1)] * c)
        self.rest = pairs.filter((F.col("c") < low_pair) | (F.col("v") < 0) | (F.col("w") < 0))
        self.many_words = filters.build(self.words.filter("c > 1"), "code")
        self.many_pairs = filters.build(_keys(self.rest.filter("c > 1")), "key", 27)

    def score(self, docs: DataFrame) -> DataFrame:
        """``docs`` (doc_id, held_out, text) as (doc_id, held_out, n_tokens, n_known, base_score, score). Rows that are not held out
        must be those that the model was fitted on."""
        m, n_parts = self, exchange.parts(docs)
        top, d2, la, lt, lp, pair_keys, pair_y = m.top, m.d2, m.la, m.lt, m.lp, m.pair_keys, m.pair_y
        base, base0, once = np.log10(m.top_c + 1.0) + m.base0, m.base0, np.log10(d2[1])
        end_base, end_known = np.log10(m.docs + 1.0) + base0, m.docs > 0
        many_words, many_pairs = m.many_words, m.many_pairs

        def asked_pairs(b: pa.RecordBatch) -> Iterator[np.ndarray]:
            for _, _, buf, off in textops.chunks(b.column(0)):
                v, w, _ = tokens(buf, off, top)
                key = pair_key(v, w)
                yield np.unique(key[textops.lookup(key, pair_keys) < 0])

        def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for key in asked_pairs(b):
                    yield pa.RecordBatch.from_arrays([pa.array(textops.signed(key))], names=["key"])

        # bigrams seen once matter to held-out texts only
        wanted = m.sc.save(docs.filter("held_out").select("text").mapInArrow(asking, "key long"), "wanted")
        wanted_pairs = filters.build(wanted, "key", 27)
        m.sc.tidy("wanted")
        slot = lambda v: np.where(v >= START, U(len(top)), v).astype(np.int64)

        #: Kinds of records: 0-3 text, 4 rare word and 5 bigram of a fitted text, 6 rare word and 7 bigram of a held-out text, 8 entry of
        #: words, 9 entry of bigrams. Columns: kind, key, row, two numbers or codes, two values.
        kinds = [np.uint8, np.uint64, np.int64, np.uint64, np.uint64, np.float64, np.float64]

        def columns(kind, key, *values):
            n = len(key)
            more = [np.asarray(v).astype(t) for v, t in zip(values, kinds[2:])] + [np.zeros(n, t) for t in kinds[2 + len(values) :]]
            return (key % U(n_parts)).astype(np.int32), [np.full(n, kind, np.uint8) if np.isscalar(kind) else kind.astype(np.uint8), key, *more]

        def texts(batches):
            first = TaskContext.get().partitionId() << 36
            for b in batches:
                ids, held = b.column(0), b.column(1).to_numpy(zero_copy_only=False)
                doc, null = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
                for i, j, buf, off in textops.chunks(b.column(2)):
                    v, w, t = tokens(buf, off, top)
                    new, rare, low = held[i:j][t], w >= RARE, w < START
                    g, s, known = np.full(len(w), base0), np.zeros(len(w)), ~new
                    at = w[low].astype(np.int64)
                    g[low], g[w == END], known[low] = base[at], end_base, True
                    known[w == END] = end_known
                    key = pair_key(v, w)
                    hit = textops.lookup(key, pair_keys)
                    s[hit >= 0] = pair_y[hit[hit >= 0]]
                    s[(hit < 0) & ~new] = once
                    have = (v < RARE) & ((hit >= 0) | ~new)
                    s[have] -= lt[slot(v[have])]
                    word = np.flatnonzero(rare & ~new)
                    many = filters.has(textops.signed(w[word]), many_words)
                    g[word[~many]] += np.log10(2.0)  # seen once; the log of its total is 0
                    rows = first + np.arange(j - i)
                    first += j - i
                    count = lambda x, size=j - i: np.bincount(x, minlength=size)
                    pack = (count(t).astype(np.uint64) << U(32)) | count(t[known]).astype(np.uint64)
                    yield columns(held[i:j] + 2 * null[i:j], textops.mix(rows.astype(np.uint64)), rows, textops.unsigned(doc[i:j].astype(np.int64)), pack, np.bincount(t, g, j - i), np.bincount(t, s, j - i))
                    word = word[many]
                    yield columns(4, w[word], rows[t[word]])
                    word = np.flatnonzero(rare & new)
                    yield columns(6, w[word], rows[t[word]])
                    far = np.flatnonzero((hit < 0) & ~new)
                    far = far[filters.has(textops.signed(key[far]), many_pairs)]
                    yield columns(5, key[far], rows[t[far]])
                    far = np.flatnonzero((hit < 0) & new)
                    yield columns(7, key[far], rows[t[far]], v[far], w[far])

        def word_entries(batches):
            for b in batches:
                k = textops.unsigned(b.column(0).to_numpy())
                zero = np.zeros(len(k))
                yield columns(8, k, zero, zero, zero, np.log10(b.column(1).to_numpy() + 1.0), b.column(2).to_numpy())

        def pair_entries(batches):
            for b in batches:
                v, w = (textops.unsigned(b.column(x).to_numpy()) for x in ("v", "w"))
                key, c = pair_key(v, w), b.column("c").to_numpy()
                ok = (c > 1) | filters.has(textops.signed(key), wanted_pairs)
                yield columns(9, key[ok], np.zeros(ok.sum()), np.zeros(ok.sum()), np.zeros(ok.sum()), np.log10(d2[np.minimum(c[ok], K + 1)] * c[ok]))

        def answers(kind, key, row, a, b, x, y) -> Iterator[list]:
            """Columns row, flags, doc, numbers, known, base, score, code, role, of each kind of record; None for nulls."""
            text = kind < 4
            if text.any():
                yield [row[text], kind[text].astype(np.int32), textops.signed(a[text]), textops.signed(b[text] >> U(32)), textops.signed(b[text] & U(0xFFFFFFFF)), x[text], y[text], None, None]
            for ask in (4, 5, 6, 7):
                q = np.flatnonzero(kind == ask)
                e = np.flatnonzero(kind == (8 if ask in (4, 6) else 9))
                e = e[np.argsort(key[e])]
                at = textops.lookup(key[q], key[e])
                has = at >= 0
                q_in, e_in = q[has], e[at[has]]
                if ask in (4, 6):
                    r, n, gain, value = row[q_in], has[has] * (ask == 6), x[e_in], -y[e_in] * (ask == 4)
                elif ask == 5:
                    r, n, gain, value = row[q_in], np.zeros(len(q_in)), np.zeros(len(q_in)), x[e_in] - once
                else:
                    r, v, w, n, gain, value = row[q], a[q], b[q], np.zeros(len(q)), np.zeros(len(q)), np.zeros(len(q))
                    value[has] = x[e_in]
                    low = v < RARE
                    value[low & has] -= lt[slot(v[low & has])]
                    value[low & ~has] += la[slot(v[low & ~has])]
                    back = ~has & (w < RARE)
                    value[back] += lp[slot(w[back])]
                    for role, of, some in ((0, v, ~low & has), (1, v, ~low & ~has), (2, w, ~has & (w >= RARE))):
                        if some.any():
                            yield [r[some], None, None, None, None, None, None, textops.signed(of[some]), np.full(some.sum(), role, np.int32)]
                u, inv = np.unique(r, return_inverse=True)
                if len(u):
                    yield [u, None, None, None, *(np.bincount(inv, z, len(u)) for z in (n, gain, value)), None, None]

        names, types = ["row", "flags", "doc_id", "n_tokens", "n_known", "base_score", "score", "code", "role"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int32()]

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, cols in exchange.gather(batches, kinds, 1, n_parts):
                for out in answers(*cols):
                    n = len(out[0])
                    yield pa.RecordBatch.from_arrays([pa.nulls(n, k) if z is None else pa.array(np.asarray(z).astype(k.to_pandas_dtype())) for z, k in zip(out, types)], names=names)

        send = lambda df, of: df.mapInArrow(lambda it: exchange.scatter(of(it)), exchange.SCHEMA)
        asks = send(docs.select("doc_id", "held_out", "text"), texts)
        words, pairs = send(m.words.select("code", "c", "lt"), word_entries), send(m.rest.select("v", "w", "c"), pair_entries)
        schema = "row long, flags int, doc_id long, n_tokens long, n_known long, base_score double, score double, code long, role int"
        met = m.sc.save(exchange.shuffled(asks.unionByName(words).unionByName(pairs)).mapInArrow(meet, schema), "met")
        m.sc.tidy("pairs")
        # rare words of held-out texts: 0 history of a seen bigram, 1 history backed off from, 2 word backed off to
        lacking = F.lit(float(np.log10(m.unknown)))
        roles = met.filter("role is not null").groupBy("row", "code", "role").agg(F.count("*").alias("n")).join(m.words.select("code", "lp", F.col("la").alias("_la"), "lt"), "code", "left")
        value = F.when(F.col("role") == 0, -F.coalesce("lt", F.lit(0.0))).when(F.col("role") == 1, F.coalesce("_la", F.lit(0.0))).otherwise(F.coalesce("lp", lacking))
        roles = roles.select("row", *[F.lit(None).alias(c) for c in names[1:6]], (F.col("n") * value).alias("score"))
        got = met.filter("role is null").select(*names[:7]).unionByName(roles)
        got = got.groupBy("row").agg(*[F.max(c).alias(c) for c in names[1:4]], *[F.sum(c).alias(c) for c in names[4:7]])
        return got.select(
            F.when(F.col("flags") < 2, F.col("doc_id")).alias("doc_id"), (F.col("flags") % 2 == 1).alias("held_out"), "n_tokens", "n_known", F.lit(m.n).cast("long").alias("train_tokens"), "base_score", "score"
        )


def katz_scores(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row a row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Trains on the rows that are not held out. Null and empty texts are their end alone; repeated rows count each;
    without training rows every word is the unknown one; an empty table gives an empty one."""
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return Model(spark, rows.filter("not held_out").select("text"), Scratch(spark, "katz")).score(rows)
