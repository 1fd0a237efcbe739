"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier.

1. From at most ``Config.sample`` labelled rows, words and word stems that mark toxic texts are gathered.
   Stems and words that mostly occur in the same texts form one lexicon voter; patterns of spelling vote besides.
2. Every document of the table that may be learned from votes.  The label model sees only how often each
   combination of votes occurs, no labels: it estimates each voter's rates in either class, and voters
   that agree more than their rates explain are taken together, with one rate per combination.
3. A logistic classifier is trained on the label model's posterior labels of the sample, over all lexicon
   entries and patterns, and scores every document.

Labels of rows whose crc32(doc_id as text) mod 3 is 1 are never read.  ``lang``, ``source`` and ``doc_id`` are
no inputs of a score.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollway.llm.common import map_slices, materialize, utf8
from tollway.llm.decontaminate import fold


@dataclass(frozen=True)
class Config:
    """``sample`` bounds the labelled rows that the lexicon and the classifier are fitted on; all other numbers are limits of fitting."""

    sample: int = 20_000
    stems: tuple[int, ...] = (4, 5)
    lexicon: int = 600
    voters: int = 24
    least_share: float = 0.01
    least_texts: int = 5
    least_precision: float = 0.995
    overlap: float = 0.5
    correlation: float = 0.1
    threshold: float = 0.7
    penalty: float = 0.2


PATTERNS = ["shouting", "exclaiming", "masked", "repeating"]


def patterns(raw: bytes, words: list[bytes]) -> list[int]:
    """Which spelling patterns a text shows."""

    n = max(1, len(words))
    letters = max(1, sum(map(len, words)))
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    tests = (upper > 0.5 * letters, raw.count(b"!") > 0.1 * n, raw.count(b"***") > 0.1 * n, n >= 20 and len(set(words)) < 0.3 * n)
    return [i for i, t in enumerate(tests) if t]


def entries(words: set[bytes], stems: tuple[int, ...]) -> set[bytes]:
    """Words (with an end mark) and their stems."""

    out = {w + b"$" for w in words}
    for k in stems:
        out.update(w[:k] for w in words if len(w) > k)
    return out


@dataclass
class Lexicon:
    """Entries, each with the number of its voter; voters past the lexicon ones are patterns."""

    number: dict[bytes, int] = field(default_factory=dict)
    voter_of: list[int] = field(default_factory=list)
    stems: tuple[int, ...] = (4, 5)

    @property
    def lexicon_voters(self) -> int:
        return 1 + max(self.voter_of, default=-1)

    @property
    def voters(self) -> int:
        return self.lexicon_voters + len(PATTERNS)

    def hits(self, raw: bytes, words: list[bytes]) -> list[int]:
        """Numbers of the entries in a text, then of its patterns."""

        distinct = set(words)
        found = {self.number[w] for w in (w + b"$" for w in distinct) if w in self.number}
        for k in self.stems:
            found.update(self.number[s] for s in {w[:k] for w in distinct if len(w) > k} & self.number.keys())
        return sorted(found) + [len(self.voter_of) + p for p in patterns(raw, words)]

    def votes(self, hits: list[int]) -> int:
        """Votes as bits."""

        n, base = len(self.voter_of), self.lexicon_voters
        out = 0
        for h in hits:
            out |= 1 << (self.voter_of[h] if h < n else base + h - n)
        return out


def may_learn(doc_id) -> F.Column:
    """Rows whose labels may be learned from; a null id has no label."""

    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, config: Config) -> DataFrame:
    """(text, toxic) of at most ``config.sample`` labels that may be learned from, by the order of their ids' hashes; written.

    A text with several labels counts as toxic if any says so.
    """

    chosen = labels.filter(may_learn(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(config.sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialize(rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic"), "toxicity-sample")  # at most `sample` ids


def _sketch(words: list[bytes]) -> int:
    """A number that near copies mostly share: the least hash of their three-word shingles."""

    h = np.array([zlib.crc32(w) for w in words], dtype=np.uint64)
    if len(h) < 3:
        return int(h.sum().astype(np.int64))
    return int(((h[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (h[2:] * np.uint64(0x165667B19E3779F9))).min().astype(np.int64))


def _marks(rows: DataFrame, stems: tuple[int, ...], known: dict[bytes, int] | None) -> DataFrame:
    """(entry, sketch) of every text, once each; with ``known``, only those entries, by number."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, sketch = [], []
        for text in batch.column("text").to_pylist():
            words = fold(text)
            own = entries(set(words), stems)
            own = own if known is None else [known[e] for e in own & known.keys()]
            found += own
            sketch += [_sketch(words)] * len(own)
        return pa.RecordBatch.from_arrays([pa.array(found, pa.binary() if known is None else pa.int32()), pa.array(sketch, pa.int64())], names=["entry", "sketch"])

    return map_slices(rows.select("text"), work, f"entry {'binary' if known is None else 'int'}, sketch long")


def _texts(rows: DataFrame) -> int:
    """Texts, near copies once."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([_sketch(fold(t)) for t in batch.column("text").to_pylist()], pa.int64())], names=["sketch"])

    return map_slices(rows.select("text"), work, "sketch long").distinct().count()


def gather_lexicon(rows: DataFrame, config: Config) -> Lexicon:
    """Entries that mark toxic texts, grouped into voters by the texts they share.  Near copies count once.

    The driver gets the entries of at least ``least_share`` of the sample's toxic texts with two counts each, and
    of the ``lexicon`` best the toxic texts they are in.
    """

    toxic, clean = rows.filter("toxic = 1"), rows.filter("toxic = 0")
    n1, n0 = max(1, _texts(toxic)), max(1, _texts(clean))
    least = max(config.least_texts, config.least_share * n1)
    in_toxic = {bytes(r["entry"]): r["n"] for r in _marks(toxic, config.stems, None).groupBy("entry").agg(F.count_distinct("sketch").alias("n")).filter(F.col("n") >= least).toLocalIterator()}
    names = sorted(in_toxic)
    number = {e: i for i, e in enumerate(names)}
    in_clean = {r["entry"]: r["n"] for r in _marks(clean, config.stems, number).groupBy("entry").agg(F.count_distinct("sketch").alias("n")).toLocalIterator()}

    def precise(e: bytes) -> float:
        """Share of toxic texts among those with the entry, as if both classes were equally large."""

        return (in_toxic[e] / n1) / (in_toxic[e] / n1 + (in_clean.get(number[e], 0) + 0.05) / n0)

    marks = sorted((e for e in names if precise(e) >= config.least_precision), key=lambda e: (-in_toxic[e], e))[: config.lexicon]
    texts: dict[bytes, set] = {e: set() for e in marks}
    for r in _marks(toxic, config.stems, {e: i for i, e in enumerate(marks)}).distinct().toLocalIterator():
        texts[marks[r["entry"]]].add(r["sketch"])
    heads: list[bytes] = []
    out = Lexicon(stems=config.stems)
    for e in marks:
        share = [len(texts[e] & texts[h]) / len(texts[e]) for h in heads]
        best = int(np.argmax(share)) if share else -1
        if best >= 0 and (share[best] >= config.overlap and (heads[best].startswith(e.rstrip(b"$")) or e.startswith(heads[best].rstrip(b"$"))) or len(heads) == config.voters):
            voter = best
        else:
            voter = len(heads)
            heads.append(e)
        out.number[e] = len(out.voter_of)
        out.voter_of.append(voter)
    return out


def hits_table(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, hits and votes of every document: a few numbers each."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        hits = []
        for text in batch.column("text").to_pylist():
            hits.append(lexicon.hits(utf8(text), fold(text)))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(hits, pa.list_(pa.int32())), pa.array([lexicon.votes(h) for h in hits], pa.int64())], names=["doc_id", "hits", "votes"])

    return map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, "doc_id long, hits array<int>, votes long")


@dataclass
class LabelModel:
    """Share of toxic texts, and for each clique of voters the rates of its vote combinations in either class.

    A voter that does not fire abstains: texts are toxic in many ways and languages, so the silence of one lexicon
    says nothing.  That all lexicons are silent does, and has rates of its own.
    """

    prior: float
    cliques: list[list[int]]
    rates: list[np.ndarray]  # clique -> (2, 2 ** size)
    lexicons: int  # bits of the lexicon voters
    silent: np.ndarray  # share of texts in either class on which all of these abstain

    def states(self, votes: np.ndarray, clique: list[int]) -> np.ndarray:
        return sum((((votes >> v) & 1) << k for k, v in enumerate(clique)), np.zeros(len(votes), dtype=np.int64))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability that texts with these votes are toxic."""

        log = np.log(np.array([1 - self.prior, self.prior]))[:, None] + np.zeros((2, len(votes)))
        for clique, rate in zip(self.cliques, self.rates, strict=True):
            state = self.states(votes, clique)
            log += np.where(state > 0, np.log(rate[:, state]), 0.0)
        log += np.where(votes & self.lexicons == 0, np.log(self.silent)[:, None], 0.0)
        log -= log.max(axis=0)
        p = np.exp(log)
        return p[1] / p.sum(axis=0)


#: Posteriors are counted in whole shares and texts 16 bits of their number at a time, so that every sum of
#: ``SUM_ROWS`` rows is a whole number below 2^53: the model is the same however the rows are dealt to tasks.
SHARES, SUM_ROWS = 1 << 24, 4096


def part_sums(votes: np.ndarray, n: np.ndarray, p: np.ndarray, cliques: list[list[int]], lexicons: int, pairs: int) -> list[int]:
    """For clean, then toxic texts: their shares, those silent in all lexicons, those in each state of each clique,
    and with ``pairs`` voters, those in which each two of them fire."""

    toxic = np.rint(p * SHARES)
    quiet = votes & lexicons == 0
    states = [sum((((votes >> v) & 1) << k for k, v in enumerate(c)), np.zeros(len(votes), dtype=np.int64)) for c in cliques]
    fired = ((votes[:, None] >> np.arange(pairs)) & 1).astype(float)
    out = [0] * (2 * (2 + sum(1 << len(c) for c in cliques) + pairs * pairs))
    for bits in range(0, 64, 16):
        some = ((n >> bits) & 0xFFFF).astype(float)
        if not some.any():
            continue
        found: list[float] = []
        for w in ((SHARES - toxic) * some, toxic * some):
            found += [w.sum(), w[quiet].sum()]
            for clique, state in zip(cliques, states, strict=True):
                found.extend(np.bincount(state, weights=w, minlength=1 << len(clique)))
            found.extend(((fired * w[:, None]).T @ fired).ravel())
        out = [o + (int(f) << bits) for o, f in zip(out, found, strict=True)]
    return out


def add_up(seen: DataFrame, chance, cliques: list[list[int]], lexicons: int, pairs: int = 0) -> np.ndarray:
    """``part_sums`` of all vote combinations as texts, a row per class; each task hands on one row of sums."""

    def run(batches):
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, SUM_ROWS):
                votes, n = (batch.column(c).slice(at, SUM_ROWS).to_numpy() for c in ("votes", "n"))
                own = part_sums(votes, n, chance(votes), cliques, lexicons, pairs)
                total = own if total is None else [a + b for a, b in zip(total, own, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([[str(t) for t in total]], pa.list_(pa.string()))], names=["sums"])

    out = [0] * (2 * (2 + sum(1 << len(c) for c in cliques) + pairs * pairs))
    for row in seen.select("votes", "n").mapInArrow(run, "sums array<string>").collect():  # one row of fixed width per task
        out = [a + int(b) for a, b in zip(out, row["sums"], strict=True)]
    return np.array([t / SHARES for t in out]).reshape(2, -1)


def model_of(sums: np.ndarray, cliques: list[list[int]], lexicons: int) -> LabelModel:
    """Rates from summed shares, lightly smoothed."""

    weight = sums[:, 0]
    model = LabelModel(float(np.clip(weight[1] / weight.sum(), 1e-4, 0.5)), cliques, [], lexicons, (sums[:, 1] + 0.01) / (weight + 0.02))
    at = 2
    for clique in cliques:
        rate = sums[:, at : at + (1 << len(clique))] + 0.01
        model.rates.append(rate / rate.sum(axis=1, keepdims=True))
        at += 1 << len(clique)
    return model


def expect(seen: DataFrame, cliques: list[list[int]], lexicons: int, rounds: int = 60) -> LabelModel | None:
    """Expectation maximization, a job per round over all vote combinations; None if there are none.

    At first, texts on which a lexicon fires are taken as toxic at 0.9, others at 0.01.
    """

    model, chance = None, lambda votes: np.where(votes & lexicons > 0, 0.9, 0.01)
    for _ in range(rounds):
        sums = add_up(seen, chance, cliques, lexicons)
        if not sums[:, 0].sum():
            return None
        last, model = model, model_of(sums, cliques, lexicons)
        if last and max(np.abs(a - b).max() for a, b in zip([last.silent, *last.rates], [model.silent, *model.rates], strict=True)) < 1e-7:
            break
        chance = model.posterior
    return model


def fit_label_model(seen: DataFrame, lexicon: Lexicon, config: Config) -> LabelModel | None:
    """Voters' rates from all (votes, n), combinations of votes and how many texts have each, without labels.

    First all voters count as independent.  Then pairs whose votes are correlated within the classes, by more than
    ``config.correlation``, are put into cliques of up to three, and the rates are estimated again.  The driver
    gets sums by clique state and by pair of voters, never the combinations.
    """

    m = lexicon.voters
    lexicons = (1 << lexicon.lexicon_voters) - 1
    alone = expect(seen, [[v] for v in range(m)], lexicons)
    if alone is None:
        return None
    strength = []
    for row in add_up(seen, alone.posterior, [], lexicons, m):
        if row[0] < 50:
            continue
        both = row[2:].reshape(m, m) / row[0]
        mean = np.diag(both)
        cov = both - np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        strength += [(abs(cov[a, b]) / (sd[a] * sd[b]) if min(sd[a], sd[b]) > 1e-5 else 0.0, a, b) for a in range(m) for b in range(a)]
    member = {v: [v] for v in range(m)}
    for r, a, b in sorted(strength, reverse=True):
        one, two = member[a], member[b]
        if r > config.correlation and one is not two and len(one) + len(two) <= 3:
            one += two
            for v in two:
                member[v] = one
    return expect(seen, [c for v, c in member.items() if c[0] == v], lexicons)


def fit_linear(rows: list[list[int]], target: np.ndarray, size: int, config: Config) -> np.ndarray:
    """Weights and bias of a logistic classifier on soft labels, by Newton steps with an L2 penalty."""

    x = np.zeros((len(rows), size + 1))
    x[:, size] = 1
    for i, hits in enumerate(rows):
        x[i, hits] = 1
    used = np.flatnonzero(x.any(axis=0))
    x = x[:, used]
    penalty = np.full(len(used), config.penalty)
    penalty[used == size] = 1e-3
    w = np.zeros(len(used))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(penalty), x.T @ (p - target) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    out = np.zeros(size + 1)
    out[used] = w
    return out


def score(docs: DataFrame, labels: DataFrame, config: Config = Config()) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted of every row.

    Null and empty texts have no hits and get the score of the bias alone.  Without a labelled toxic row there is
    no lexicon, and all scores are near 0.  A null doc_id is not held out and has no label; rows with equal ids
    are scored one by one; a label without a document, or a null label, is not used.  Further columns are not
    read; no rows give none.  One pass over all texts, and one that stops at the sample's rows.
    """

    rows = sample(docs, labels, config)
    lexicon = gather_lexicon(rows, config)
    found = materialize(hits_table(docs, lexicon), "hits")
    size = len(lexicon.voter_of) + len(PATTERNS)
    weights = np.zeros(size + 1)
    weights[size] = -4.0
    model = None
    if lexicon.voter_of:
        seen = found.filter(may_learn(F.col("doc_id"))).groupBy("votes").agg(F.count("*").alias("n"))
        model = fit_label_model(materialize(seen, "votes"), lexicon, config)
    if model:
        hits = sorted(list(r["hits"]) for r in hits_table(rows, lexicon).select("hits").toLocalIterator())  # a few numbers of each sampled row
        weights = fit_linear(hits, model.posterior(np.array([lexicon.votes(h) for h in hits], dtype=np.int64)), size, config)
    values = F.array(*[F.lit(float(w)) for w in weights[:size]])
    total = F.aggregate("hits", F.lit(float(weights[size])), lambda s, h: s + F.get(values, h))
    chance = 1 / (1 + F.exp(-total))
    out = found.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False)).alias("held_out"), chance.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= config.threshold).cast("int"))
