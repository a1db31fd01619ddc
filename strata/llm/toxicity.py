"""Toxicity by weak supervision.

Many voters look at a text and fire or abstain: word lists by theme and language,
words and beginnings of words mined from labelled rows, and patterns of spelling.  A generative model of
the votes, fitted by expectation maximisation over all rows it may learn from,
has the voters' accuracies and, given the class, their correlations as a tree:
each voter depends on the class and on the voter it agrees with most.  A label,
where a row has one, is a vote of high accuracy.  The model's posteriors are the
labels of a linear classifier over votes, rates of signs and hashed words, which
scores every text.

The votes are counted by pattern, and a round of the fit sums products of
posteriors over them in tasks; the driver gets one matrix of voters by voters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import wordscan as ws
from strata.llm.shared import id_of, packed, plain, stored, table

#: Rows that mined words and the classifier are fitted on, in expectation, by checksum; all rows if there are fewer.
FIT_ROWS = 20_000
#: Mined voters, and the bytes of the beginnings of words that are mined.  A vote has 64 bits for all voters.
MINED, BEGINNINGS = 44, range(4, 10)
ROUNDS = 5
THRESHOLD = 0.3
BUCKETS = 1 << 14
#: A label agrees with the class with this probability at least.
LABEL_FLOOR = 0.9

#: Words of insult and contempt, by theme and language.
LEXICONS = {
    "en_mind": "idiot idiots idiotic moron morons moronic stupid dumb fool fools imbecile dunce dimwit halfwit brainless clueless",
    "en_worth": "loser losers worthless pathetic useless failure nobody reject trash garbage rubbish scum scumbag vermin filth parasite",
    "en_disgust": "disgusting gross vile repulsive revolting sickening nasty ugly filthy",
    "en_mock": "clown clowns joke jerk freak creep weirdo crybaby coward liar",
    "en_wish": "hate hates kill shut shutup despise",
    "en_swear": "damn crap bastard bastards bitch ass arse asshole shit bullshit fuck fucking piss",
    "de": "idiot idioten trottel depp dummkopf blöd dumm versager wertlos widerlich ekelhaft abschaum müll erbärmlich arschloch scheiße hure",
    "fr": "idiot idiote imbécile crétin crétine débile stupide nul minable pathétique dégoûtant ordure salaud connard merde bouffon",
    "es": "idiota imbécil estúpido estúpida tonto tonta inútil basura asqueroso asquerosa patético escoria payaso mierda cabrón",
}
_PATTERNS = ("shouting", "exclaiming", "masked_word", "stretched_word", "second_person", "lexicon_twice", "mined_twice", "no_word_of_any_list")
_YOU = "you your youre u du dich dein deine tu toi ton te tú usted".split()
_RATES = 5  # capitals, exclamation marks, signs, words of lists, mined words


def _hash(words: list[str]) -> np.ndarray:
    """The hash that a text scan gives to each word."""
    return np.concatenate([w.hash for w in ws.scan(pa.array(words), "alnum", lower=True)]) if words else np.empty(0, np.uint64)


class _Table:
    """Bits by the hash of a word."""

    def __init__(self, pairs: list[tuple[str, int]]):
        bits: dict[int, int] = {}
        for h, (_, more) in zip(_hash([w for w, _ in pairs]).tolist(), pairs):
            bits[h] = bits.get(h, 0) | more
        self.hashes = np.array(sorted(bits), dtype=np.uint64)
        self.bits = np.array([bits[h] for h in sorted(bits)], dtype=np.uint64)
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[self.hashes & np.uint64(0xFFFF)] = True

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the hashes that are known, their bits)."""
        at = np.flatnonzero(self.maybe[hashes & np.uint64(0xFFFF)])
        place = np.searchsorted(self.hashes, hashes[at])
        ok = self.hashes[np.minimum(place, len(self.hashes) - 1)] == hashes[at] if len(at) else np.zeros(0, bool)
        return at[ok], self.bits[place[ok]]


def _beginnings(w: ws.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(words longer than ``size`` bytes that a character ends after, the hash of those bytes)."""
    own = np.flatnonzero(w.end - w.start > size)
    own = own[(w.data[w.start[own] + size] & 0xC0) != 0x80]
    return own, ws.span_hashes(w.data, w.start[own], w.start[own] + size, ws.byte_values(True))


class _Lists:
    """Bits by words and by beginnings of words, which have a ``*`` behind them."""

    def __init__(self, pairs: list[tuple[str, int]]):
        self.words = _Table([(w, v) for w, v in pairs if not w.endswith("*")])
        sizes = {len(w.encode()) - 1 for w, _ in pairs if w.endswith("*")}
        self.starts = {k: _Table([(w[:-1], v) for w, v in pairs if w.endswith("*") and len(w.encode()) == k + 1]) for k in sorted(sizes)}

    def hits(self, w: ws.Words) -> tuple[np.ndarray, np.ndarray]:
        """(document, bits) of every word that is in the lists, once for each list."""
        found = [self.words.look_up(w.hash)]
        for k, known in self.starts.items():
            own, hashes = _beginnings(w, k)
            at, bits = known.look_up(hashes)
            found.append((own[at], bits))
        hit, bits = (np.concatenate(x) for x in zip(*found))
        return np.searchsorted(w.bounds, hit, side="right") - 1, bits


@dataclass
class Voters:
    """The voters: word lists, patterns and one voter for each mined word.  Voter i is bit i of a vote."""

    mined: list[str]  # a word, or a beginning of words with a ``*`` behind it

    def __post_init__(self):
        self.names = [*LEXICONS, *_PATTERNS, *self.mined]
        if len(self.names) > 64:
            raise ValueError("more than 64 voters")
        lists = [*(x.split() for x in LEXICONS.values()), *([] for _ in _PATTERNS), *([m] for m in self.mined)]
        lists[len(LEXICONS) + _PATTERNS.index("second_person")] = _YOU
        self.lists = _Lists([(w, 1 << i) for i, x in enumerate(lists) for w in x])
        self.place = {p: np.uint64(1 << (len(LEXICONS) + i)) for i, p in enumerate(_PATTERNS)}

    def votes(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, ws.Words]]:
        """(first row, votes, rates, words) of slices of a string column; a null text is empty."""
        listed = np.uint64((1 << len(LEXICONS)) - 1)
        single = ~np.uint64((1 << (len(LEXICONS) + len(_PATTERNS))) - 1)
        for (row, part, edge), w in zip(ws.slices(column), ws.scan(column, "alnum", lower=True)):
            per = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[edge])  # noqa: B023, E731
            upper = (part >= 65) & (part <= 90)
            small = (part >= 97) & (part <= 122)
            sign = np.isin(part, np.frombuffer(b"#$%&*@", np.uint8))
            letter = upper | small
            masked, stretched = np.zeros(len(part), bool), np.zeros(len(part), bool)
            masked[:-3] = letter[:-3] & sign[1:-2] & sign[2:-1] & letter[3:]
            stretched[:-3] = letter[:-3] & (part[:-3] == part[1:-2]) & (part[:-3] == part[2:-1]) & (part[:-3] == part[3:])
            near_end = np.concatenate([edge[1:] - k for k in (1, 2, 3)])  # a pattern of four characters that starts here runs into the next text
            near_end = near_end[near_end >= 0]
            masked[near_end] = stretched[near_end] = False
            size, n_upper, n_letters = np.maximum(np.diff(edge), 1), per(upper), per(letter)
            shouts, n_exclaims, n_signs = (n_upper * 10 > n_letters * 3) & (n_letters >= 20), per(part == 33), per(sign)

            doc, bits = self.lists.hits(w)
            votes = np.zeros(w.docs, dtype=np.uint64)
            np.bitwise_or.at(votes, doc, bits)
            n_listed, n_mined = (np.bincount(doc[(bits & some) != 0], minlength=w.docs) for some in (listed, single))
            own = votes & single
            fires = {
                "shouting": shouts, "exclaiming": n_exclaims * 100 > size, "masked_word": per(masked) > 0, "stretched_word": per(stretched) > 0,
                "lexicon_twice": n_listed >= 2, "mined_twice": (own & (own - np.uint64(1)) * (own != 0)) != 0, "no_word_of_any_list": (own == 0) & (n_listed == 0),
            }
            for name, flags in fires.items():
                votes |= np.where(flags, self.place[name], np.uint64(0))
            rates = np.column_stack([n_upper / size, np.minimum(n_exclaims / size * 20, 1), np.minimum(n_signs / size * 20, 1), np.log1p(n_listed), np.log1p(n_mined)])
            yield row, votes, rates, w

    def matrix(self, votes: np.ndarray) -> np.ndarray:
        return (votes[:, None] >> np.arange(len(self.names), dtype=np.uint64) & np.uint64(1)).astype(float)


@dataclass
class LabelModel:
    """The joint distribution of the class, the label and the votes.

    ``fire[y, j, b]`` is the probability that voter j fires in class y where its
    parent in the tree fires (b = 1) or not; roots have the same for both.
    """

    prior: np.ndarray
    label: np.ndarray  # P(label is 1) by class
    parent: np.ndarray
    fire: np.ndarray
    both: np.ndarray = field(repr=False)  # sums of products of votes by class
    total: np.ndarray = field(repr=False)

    @classmethod
    def of_sums(cls, total: np.ndarray, both: np.ndarray, labels: np.ndarray) -> LabelModel:
        """From sums over rows, weighted by the posteriors: rows by class, products of votes by class, labels by class and value."""
        j = both.shape[1]
        n, on = total[:, None] + 2, np.einsum("yii->yi", both)
        rate = (on + 1) / n
        # Mutual information of each pair of voters given the class.
        gain = np.zeros((j, j))
        for y in range(2):
            for a in (0, 1):
                for b in (0, 1):
                    joint = both[y] if a and b else on[y][:, None] - both[y] if a else on[y][None] - both[y] if b else total[y] - on[y][:, None] - on[y][None] + both[y]
                    p = (np.maximum(joint, 0) + 0.5) / n[y]
                    pa_, pb = rate[y] if a else 1 - rate[y], rate[y] if b else 1 - rate[y]
                    gain += n[y] / n.sum() * p * np.log(p / np.outer(pa_, pb))
        parent = np.full(j, -1)
        if j:
            best, source, left = gain[0].copy(), np.zeros(j, int), np.ones(j, bool)
            left[0] = False
            while left.any():  # the tree of greatest mutual information
                k = int(np.flatnonzero(left)[best[left].argmax()])
                parent[k], left[k] = source[k], False
                closer = left & (gain[k] > best)
                best[closer], source[closer] = gain[k][closer], k
        fire = np.repeat(rate[:, :, None], 2, axis=2)
        for k in np.flatnonzero(parent >= 0):
            with_parent = both[:, k, parent[k]]
            known = np.column_stack([total - on[:, parent[k]], on[:, parent[k]]])
            fired = np.column_stack([on[:, k] - with_parent, with_parent])
            fire[:, k] = (np.maximum(fired, 0) + 10 * rate[:, [k]]) / (np.maximum(known, 0) + 10)
        seen = labels + np.array([[49.0, 1.0], [1.0, 49.0]])
        label = seen[:, 1] / seen.sum(axis=1)
        label = np.array([min(label[0], 1 - LABEL_FLOOR), max(label[1], LABEL_FLOOR)])
        return cls((total + 1) / (total.sum() + 2), label, parent, fire, both, total)

    def posterior(self, votes: np.ndarray, label: np.ndarray) -> np.ndarray:
        """P(class 1) of rows of votes (0 or 1) and labels (0, 1, or -1 for none)."""
        given = np.where(self.parent >= 0, votes[:, self.parent], 0).astype(int)
        odds = np.full(len(votes), np.log(self.prior[1] / self.prior[0]))
        for sign, y in ((1, 1), (-1, 0)):
            p = self.fire[y][np.arange(votes.shape[1]), given]
            odds += sign * (np.log(np.where(votes > 0, p, 1 - p)).sum(axis=1))
            odds += sign * np.select([label == 1, label == 0], [np.log(self.label[y]), np.log(1 - self.label[y])], 0.0)
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))

    @cached_property
    def accuracy(self) -> np.ndarray:
        """P(class 1) of rows where each voter fires."""
        on = np.einsum("yii->yi", self.both)
        return (on[1] + self.prior[1]) / (on.sum(axis=0) + 1)

    @cached_property
    def correlation(self) -> np.ndarray:
        """The correlation of each pair of voters within each class."""
        mean = np.einsum("yii->yi", self.both) / np.maximum(self.total[:, None], 1e-9)
        cov = self.both / np.maximum(self.total[:, None, None], 1e-9) - mean[:, :, None] * mean[:, None]
        spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
        return cov / (spread[:, :, None] * spread[:, None])


def fit_label_model(patterns: DataFrame, n_voters: int, rounds: int = ROUNDS) -> LabelModel:
    """The model of counted patterns (votes long, label int or null, n long).

    The first round takes the labels for the classes; without any, rows with two
    or more voters of a word list are taken for toxic.
    """

    def sums(model: LabelModel | None, labelled: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((2, n_voters * n_voters + 3))
            for b in batches:
                x = (b.column("votes").to_numpy().view(np.uint64)[:, None] >> np.arange(n_voters, dtype=np.uint64) & np.uint64(1)).astype(float)
                label = b.column("label").fill_null(-1).to_numpy()
                n = b.column("n").to_numpy().astype(float)
                if model is not None:
                    p = model.posterior(x, label)
                elif labelled:
                    n, p = n * (label >= 0), (label == 1).astype(float)
                else:
                    p = np.where(x[:, : len(LEXICONS)].sum(axis=1) >= 2, 0.9, 0.1)
                for y, weight in enumerate((n * (1 - p), n * p)):
                    out[y, 0] += weight.sum()
                    out[y, 1] += weight[label == 0].sum()
                    out[y, 2] += weight[label == 1].sum()
                    out[y, 3:] += ((x * weight[:, None]).T @ x).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size)), pa.array(out.ravel())], names=["i", "v"])

        return run

    def step(model: LabelModel | None, labelled: bool) -> LabelModel:
        rows = patterns.mapInArrow(sums(model, labelled), "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
        out = np.zeros(2 * (n_voters * n_voters + 3))
        out[rows.column("i").to_numpy()] = rows.column("v").to_numpy()
        out = out.reshape(2, -1)
        return LabelModel.of_sums(out[:, 0], out[:, 3:].reshape(2, n_voters, n_voters), out[:, 1:3])

    model = step(None, not patterns.where("label is not null").isEmpty())
    for _ in range(rounds):
        model = step(model, True)
    return model


def mine_words(rows: DataFrame, size: int = MINED) -> list[str]:
    """The words, and beginnings of words (with a ``*``), that tell toxic rows (text, label 0 or 1) from others best.

    They are ranked by the lower bound of the log odds ratio of having them.  One
    that is mostly in toxic rows that a better one is in too is left out.
    """
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label = b.column("label").to_numpy()
            for w in ws.scan(b.column("text"), "alnum", lower=True):
                doc, low = w.doc_of_word(), fold[w.data]
                for k in (0, *BEGINNINGS):
                    own, hashes = _beginnings(w, k) if k else (np.arange(len(w.hash)), w.hash)
                    order = np.lexsort((doc[own], hashes))
                    own, hashes = own[order], hashes[order]
                    new = np.ones(len(own), dtype=bool)
                    new[1:] = hashes[1:] != hashes[:-1]
                    other = new.copy()
                    other[1:] |= doc[own[1:]] != doc[own[:-1]]  # once a text
                    toxic = label[w.first + doc[own]] == 1
                    first = np.flatnonzero(new)
                    if len(first):
                        a, n = (np.add.reduceat(x.astype(np.int64), first) for x in (other & toxic, other))
                        at = own[first]
                        text = ws.span_strings(low, w.start[at], np.full(len(at), k) if k else w.end[at] - w.start[at])
                        yield pa.RecordBatch.from_arrays([text, pa.array(np.full(len(at), k > 0)), pa.array(a), pa.array(n - a)], names=["gram", "open", "a", "b"])

    total = rows.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    counts = rows.mapInArrow(grams, "gram string, open boolean, a long, b long").groupBy("gram", "open").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("a >= 3")
    odds = lambda x, n: F.log((F.col(x) + 0.5) / (F.lit(n) - F.col(x) + 0.5))
    spread = lambda x, n: 1 / (F.col(x) + 0.5) + 1 / (F.lit(n) - F.col(x) + 0.5)
    bound = odds("a", total[0]) - odds("b", total[1]) - 1.64 * F.sqrt(spread("a", total[0]) + spread("b", total[1]))
    best = counts.withColumn("bound", F.round(bound, 9)).where("bound > 1 and length(gram) >= 3").orderBy(F.col("bound").desc(), F.length("gram").desc(), "open", "gram").limit(10 * size).collect()
    if not best:
        return []
    names = [r.gram + "*" * r.open for r in best]
    lists = _Lists([(x, i + 1) for i, x in enumerate(names)])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((len(names), len(names)))
        for b in batches:
            for w in ws.scan(b.column("text"), "alnum", lower=True):
                doc, at = lists.hits(w)
                has = np.zeros((w.docs, len(names)))
                has[doc, at.astype(np.int64) - 1] = 1
                out += has.T @ has
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size)), pa.array(out.ravel())], names=["i", "v"])

    both = np.zeros(len(names) ** 2)
    sums = rows.where("label = 1").select("text").mapInArrow(together, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    both[sums.column("i").to_numpy()] = sums.column("v").to_numpy()
    both = both.reshape(len(names), -1)
    out: list[int] = []
    for i in range(len(names)):
        if len(out) < size and not any(both[i, o] > 0.8 * both[i, i] for o in out):
            out.append(i)
    return [names[i] for i in out]


def _features(voters: Voters, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, votes, dense features, document, bucket, value): the last three for the hashed words, each text's of length 1."""
    for row, votes, rates, w in voters.votes(column):
        pair = np.unique(w.doc_of_word().astype(np.int64) * BUCKETS + (w.hash & np.uint64(BUCKETS - 1)).astype(np.int64))
        doc = pair // BUCKETS
        value = 1 / np.sqrt(np.maximum(np.bincount(doc, minlength=w.docs), 1))
        yield row, votes, np.column_stack([voters.matrix(votes), rates]), doc, pair % BUCKETS, value[doc]


@dataclass
class ToxicityModel:
    voters: Voters
    labels: LabelModel | None
    weights: np.ndarray
    offset: float

    def score(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """``docs`` with score added (a column of that name is replaced), from 0 to 1; an empty or null text has one too."""
        voters, weights, offset = self.voters, self.weights, self.offset
        dense = len(voters.names) + _RATES

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row, _, x, doc, bucket, value in _features(voters, b.column("text")):
                    odds = x @ weights[:dense] + offset + np.bincount(doc, weights[dense + bucket] * value, minlength=len(x))
                    yield pa.RecordBatch.from_arrays([b.column("row").slice(row, len(x)), pa.array(np.round(1 / (1 + np.exp(-np.clip(odds, -500, 500))), 6))], names=["row", "score"])

        rows = docs.select(packed(docs, "score").alias("row"), plain(text_col).cast("string").alias("text"))
        found = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, score double")
        return found.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns) if c != "score"], "score")


def _fit_classifier(voters: Voters, model: LabelModel, sample: DataFrame) -> tuple[np.ndarray, float]:
    """Weights and offset of a logistic regression of posteriors; ``sample`` has (text, label)."""
    dense = len(voters.names) + _RATES

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label = b.column("label").fill_null(-1).to_numpy()
            for row, votes, x, doc, bucket, value in _features(voters, b.column("text")):
                p = model.posterior(voters.matrix(votes), label[row : row + len(x)])
                cut = np.searchsorted(doc, np.arange(len(x) + 1))
                own = [np.flatnonzero(v) for v in x]
                at = [np.concatenate([o, dense + bucket[lo:hi]]) for o, lo, hi in zip(own, cut[:-1], cut[1:])]
                values = [np.concatenate([v[o], value[lo:hi]]) for v, o, lo, hi in zip(x, own, cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(at, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))], names=["p", "at", "v"])

    size = dense + BUCKETS
    vector = F.udf(lambda at, v: Vectors.sparse(size, at, v), VectorUDT())
    found = sample.mapInArrow(rows, "p double, at array<int>, v array<double>")
    weighted = found.select(F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("p").alias("w")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("p")).alias("w")))).alias("s"), "at", "v").where("s.w > 1e-6")
    train = stored(weighted.select("s.label", "s.w", vector("at", "v").alias("x")), "weighted")
    fit = LogisticRegression(featuresCol="x", labelCol="label", weightCol="w", maxIter=60, regParam=3e-4, standardization=False).fit(train)
    return np.array(fit.coefficients.toArray()), float(fit.intercept)


def fit_toxicity(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", fit_rows: int = FIT_ROWS, mined: int = MINED, rounds: int = ROUNDS) -> ToxicityModel:
    """A model of all of ``docs``, of which ``labels`` (doc_id, toxic 0 or 1) marks some.

    Voters are counted over all rows; words are mined and the classifier is
    fitted on ``fit_rows`` different rows, in expectation, by checksum.  Of several
    labels of an id the larger counts; rows without an id have no label.  Where
    there is nothing to learn from, every score is one half.
    """
    text = F.coalesce(plain(text_col).cast("string"), F.lit(""))
    rows = docs.select(id_of(id_col).alias("doc_id"), text.alias("text"))
    marks = stored(labels.select(id_of("doc_id").alias("doc_id"), F.col("toxic").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label")), "marks")
    share = min(1.0, fit_rows / max(1, rows.count()))
    chosen = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = stored(rows.where(chosen).distinct().join(marks, "doc_id", "left").select("text", "label"), "sample")
    voters = Voters(mine_words(sample.where("label is not null"), mined))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, votes, _, _ in voters.votes(b.column("text")):
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(row, len(votes)), pa.array(votes.view(np.int64))], names=["doc_id", "votes"])

    cast = rows.mapInArrow(vote, "doc_id long, votes long").groupBy("doc_id", "votes").agg(F.count("*").alias("n"))
    cast = stored(cast, "votes")
    named = cast.where("doc_id is not null").join(marks, "doc_id", "left").select("votes", "label", "n")
    patterns = stored(named.unionByName(cast.where("doc_id is null").select("votes", F.lit(None).cast("int").alias("label"), "n")).groupBy("votes", "label").agg(F.sum("n").alias("n")), "patterns")
    if patterns.isEmpty():
        return ToxicityModel(voters, None, np.zeros(len(voters.names) + _RATES + BUCKETS), 0.0)
    model = fit_label_model(patterns, len(voters.names), rounds)
    return ToxicityModel(voters, model, *_fit_classifier(voters, model, sample))


def held_out(id_column: Column) -> Column:
    return F.crc32(id_column.cast("string").cast("binary")) % 4 == 2


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    model = fit_toxicity(docs.where(~F.col("held_out")), table(spark, sf_dir, "labels"))
    return model.score(docs).select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op12_toxicity": op12_toxicity}
ORACLES: dict[str, str] = {}
