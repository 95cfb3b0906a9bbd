"""Toxicity by maximum-scoring segments over token log-odds.

Tokens are lower-cased runs of letters. From a bounded sample of labelled
documents, each token's log-odds between toxic and clean documents are taken
with an informative Dirichlet prior: the balance of the token's family (words
with the same first letters) in the same sample, so rare forms of a known word
lean on their family. A token's score is its log-odds, shrunk by their standard
error; a token that the sample lacks, or without evidence, scores ``DRIFT``,
slightly below zero. A document is scanned once, in linear time, for all maximal
scoring segments (Ruzzo and Tompa). Their scores follow an extreme-value law
under chance (Karlin and Altschul): with its parameters lambda and K fitted on
clean training documents, a segment of score s among n tokens has the p-value
1 - exp(-K n exp(-lambda s)). Scattered hits are weighed together: of the r best
segments, the sum of their normalized scores lambda s - ln(K n) has its own
tail, and the r of the least p-value is the document's evidence. Segments that
are significant alone or together are its toxic passages. The document's score
is the share of toxic documents at such evidence among labelled documents that
the token scores were not counted on (a monotone fit).

Defined results: null or empty text scores as one without evidence; several
labels of one document count as toxic if one does; rows that repeat a document
each have its score; without labelled documents of both classes every score is
0; an empty table gives no row; very long texts are read whole, in time linear in
their length; other columns, whatever their names, are ignored, and
``reject_toxic`` hands them on. Ids are whole numbers; others raise Spark's cast
error.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import held_out, rows_out, slices

#: Bounds of what the classifier is fitted on: labelled documents of each class, and bytes of their texts altogether.
SAMPLE_PER_CLASS = 3_000
SAMPLE_BYTES = 128 << 20
#: Letters that make a token's families, longest first, and the weight of a prior, in documents.
FAMILIES = (6, 5, 4)
PRIOR_WEIGHT = 8.0
#: What a token's log-odds must exceed to count for a passage, and by how many standard errors they shrink.
MARGIN = 1.0
SHRINK = 0.5
DRIFT = -0.1
#: Documents that a token must be in to have a score of its own.
MIN_DOCS = 2
MAX_LAMBDA = 5.0
#: Each part of the sample is judged by the counts of the others.
FOLDS = 4
#: Passages count if their p-value, alone or together, is at most this.
SIGNIFICANT = 0.05
THRESHOLD = 0.3

TOKEN = re.compile(r"[^\W\d_]+")
Scores = dict[str, float]


def tokens_of(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def maximal_segments(scores: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence given by its tokens of positive score.

    Ruzzo and Tompa's scan; tokens between the listed ones score ``drift`` (below
    0) each. A candidate list keeps, for each segment, the running total at its
    left and right ends; every push or merge is paid for once.
    """
    found: list[tuple[int, int, float, float]] = []  # start, end, total left of it, total at its right end
    total, after = 0.0, 0
    for at, score in scores:
        total += drift * (at - after)
        start, left, right = at, total, total + score
        total, after = right, at + 1
        while True:
            k = len(found) - 1
            while k >= 0 and found[k][2] >= left:
                k -= 1
            if k < 0 or found[k][3] >= right:
                break
            start, left = found[k][0], found[k][2]
            del found[k:]
        found.append((start, at + 1, left, right))
    return [(a, b, right - left) for a, b, left, right in found]


Segment = tuple[int, int, float]


@dataclass
class Model:
    """What a fit leaves: scores of the tokens that speak for toxicity, the extreme-value law and the calibration."""

    tokens: Scores = field(default_factory=dict)
    lam: float = 1.0
    k: float = 0.1
    at: list[float] = field(default_factory=lambda: [0.0])
    share: list[float] = field(default_factory=lambda: [0.0])

    def segments(self, tokens: list[str]) -> list[Segment]:
        score = self.tokens.get
        return maximal_segments([(at, s) for at, t in enumerate(tokens) if (s := score(t)) is not None], DRIFT)

    def p_value(self, score: float, n: int) -> float:
        return -math.expm1(-self.k * max(n, 1) * math.exp(-self.lam * score))

    def joint(self, scores: list[float], n: int) -> tuple[float, int]:
        """The surprise (-ln p, 0 or more) of the r best segments of n tokens, for the r where it is largest, and that r.

        The sum T of r normalized scores has the tail exp(-T) T^(r-1) / (r! (r-1)!);
        as several r are tried, the r-th takes 2^-r of the chance allowed.
        """
        floor = max(0.0, math.log(max(self.k * max(n, 1), 1e-300)))
        total, best, count = 0.0, 0.0, 0
        for r, s in enumerate(sorted(scores, reverse=True), 1):
            gain = self.lam * s - floor
            if gain <= 0:  # the rest gains nothing either
                break
            total += gain
            surprise = total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r) - r * math.log(2)
            if total > r - 1 and surprise > best:
                best, count = surprise, r
        return best, count

    def evidence(self, tokens: list[str]) -> float:
        return self.joint([s for _, _, s in self.segments(tokens)], len(tokens))[0]

    def passages(self, tokens: list[str]) -> tuple[list[tuple[int, int, float, float]], float]:
        """(start, end, score, p-value) of the significant passages by start, and the document's evidence."""
        found = self.segments(tokens)
        evidence, r = self.joint([s for _, _, s in found], len(tokens))
        best = sorted(found, key=lambda f: (-f[2], f[0]))
        together = set(best[:r]) if math.exp(-evidence) <= SIGNIFICANT else set()
        return [(a, b, s, p) for a, b, s in found if (p := self.p_value(s, len(tokens))) <= SIGNIFICANT or (a, b, s) in together], evidence

    def probability(self, evidence: float) -> float:
        """The share at this evidence; a hundredth of the score goes on rising where the share doesn't."""
        return 0.99 * float(np.interp(evidence, self.at, self.share)) + 0.01 * evidence / (1 + evidence)


@dataclass
class Counts:
    """Documents of each class (clean, toxic) that a token or a family is in, and their (document, token) pairs."""

    tokens: tuple[Counter, Counter] = field(default_factory=lambda: (Counter(), Counter()))
    families: tuple[Counter, Counter] = field(default_factory=lambda: (Counter(), Counter()))

    def add(self, tokens: list[str], y: int) -> None:
        """A document counts a token once, so one long or repetitive document says little."""
        distinct = set(tokens)
        self.tokens[y].update(distinct)
        self.families[y].update({t[:n] for t in distinct for n in FAMILIES if len(t) > n})

    def without(self, part: Counts) -> Counts:
        return Counts(*(tuple(a - b for a, b in zip(mine, own, strict=True)) for mine, own in ((self.tokens, part.tokens), (self.families, part.families))))

    def scores(self) -> Scores:
        """Log-odds of each token, shrunk towards zero by SHRINK standard errors and then lowered by MARGIN; those above zero.

        The Dirichlet prior is PRIOR_WEIGHT documents, split between the classes as
        the token's longest family is (which leans on the pooled text with the same weight), or else as the pooled text is.
        """
        clean, toxic = self.tokens
        n_clean, n_toxic = (max(1, sum(c.values())) for c in self.tokens)
        pooled = n_toxic / (n_toxic + n_clean)
        out = {}
        for token, seen in toxic.items():
            if seen + clean[token] < MIN_DOCS:
                continue
            family = next((token[:n] for n in FAMILIES if len(token) > n), None)
            share = pooled
            if family is not None:
                t, c = self.families[1][family] + PRIOR_WEIGHT * pooled, self.families[0][family] + PRIOR_WEIGHT * (1 - pooled)
                share = t / (t + c)
            x, y = seen + PRIOR_WEIGHT * share, clean[token] + PRIOR_WEIGHT * (1 - share)
            delta = math.log(x / n_toxic) - math.log(y / n_clean)
            score = delta - SHRINK * math.sqrt(1 / (x + 0.5) + 1 / (y + 0.5)) - MARGIN
            if score > 0:
                out[token] = score
        return out


Docs = list[tuple[list[str], int]]


def set_law(model: Model, docs: Docs) -> None:
    """Lambda solves E[exp(lambda score)] = 1 over clean tokens; K is the maximum-likelihood fit to clean documents' best segments."""
    sample: Counter = Counter()
    best: list[tuple[float, int]] = []
    for tokens, y in docs:
        if y or not tokens:
            continue
        hits = [(at, s) for at, t in enumerate(tokens) if (s := model.tokens.get(t)) is not None]
        sample.update(round(s, 2) for _, s in hits)
        sample[DRIFT] += len(tokens) - len(hits)
        best.append((max((s for _, _, s in maximal_segments(hits, DRIFT)), default=0.0), len(tokens)))
    # A sample without any chance hit must not mean that lambda is unknown: the strongest token counts once more.
    if model.tokens:
        sample[round(max(model.tokens.values()), 2)] += 1
    model.lam = min(MAX_LAMBDA, _lambda(sample))
    model.k = min(1.0, max(1.0, len(best)) / max(1.0, sum(n * math.exp(-model.lam * s) for s, n in best)))


def fit(rows: Iterable[tuple[str, int]]) -> Model:
    """A model from (text, toxic) of labelled documents.

    The law and the calibration are taken from documents that their scores were
    not counted on: each part is judged by the other parts' counts.
    """
    same: dict[str, str] = {}
    parts: list[Docs] = [[] for _ in range(FOLDS)]
    for text, y in rows:  # copies of a text share a part, so none is judged by another's counts
        parts[zlib.crc32(text.encode()) % FOLDS].append(([same.setdefault(t, t) for t in tokens_of(text)], int(y)))
    if len({y for part in parts for _, y in part}) < 2:
        return Model()
    counts, every = [], Counts()
    for part in parts:
        own = Counts()
        for tokens, y in part:
            own.add(tokens, y)
        counts.append(own)
        for mine, other in ((every.tokens, own.tokens), (every.families, own.families)):
            for y in (0, 1):
                mine[y].update(other[y])
    model = Model(tokens=every.scores())
    judged = [(Model(tokens=every.without(own).scores()), part) for own, part in zip(counts, parts, strict=True)]
    for other, part in judged:
        set_law(other, part)
    model.lam = sum(o.lam for o, _ in judged) / FOLDS
    model.k = sum(o.k for o, _ in judged) / FOLDS
    x, y = [], []
    for other, part in judged:
        other.lam, other.k = model.lam, model.k
        x += [other.evidence(d) for d, _ in part]
        y += [label for _, label in part]
    model.at, model.share = monotone(x, y)
    return model


def monotone(x: list[float], y: list[int]) -> tuple[list[float], list[float]]:
    """Share of 1 by evidence, never falling: neighbours out of order are pooled. A pool's share counts one more document, of the mean share, and holds from its least to its largest evidence."""
    mean = sum(y) / len(y)
    tied: dict[float, list[float]] = {}
    for a, b in sorted(zip(x, y, strict=True)):
        pool = tied.setdefault(a, [a, a, 0.0, 0.0])
        pool[2], pool[3] = pool[2] + b, pool[3] + 1
    pools: list[list[float]] = []
    for pool in tied.values():
        pools.append(pool)
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            _, hi, ones, n = pools.pop()
            pools[-1] = [pools[-1][0], hi, pools[-1][2] + ones, pools[-1][3] + n]
    shares = np.maximum.accumulate([(p[2] + mean) / (p[3] + 1) for p in pools]).tolist()
    return [at for p in pools for at in p[:2]], [share for share in shares for _ in (0, 1)]


def _lambda(sample: Counter) -> float:
    values = np.array(list(sample.keys()))
    share = np.array(list(sample.values()), float) / max(1, sum(sample.values()))
    if not (values > 0).any():
        return 1.0
    lo, hi = 1e-3, 20.0
    f = lambda x: float(np.sum(share * np.exp(np.clip(x * values, -700, 700))) - 1)
    if f(lo) > 0:
        return lo
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return max(lo, 1e-3)


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> list[tuple[str, int]]:
    """Texts and labels of a bounded sample, drawn by a hash of the id, evenly over the table; held-out ids never count."""
    marks = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic is not null and doc_id is not null")
    marks = marks.where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("rank", F.xxhash64("doc_id", F.lit("toxicity")))
    drawn = [marks.where(F.col("toxic") == y if y else F.col("toxic") != 1).orderBy("rank", "doc_id").limit(per_class).select("doc_id", "toxic") for y in (1, 0)]
    chosen = F.broadcast(drawn[0].unionByName(drawn[1]))  # at most 2 * per_class rows
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").join(chosen, "doc_id")
    # Rows that repeat a chosen id must not widen the sample beyond its bounds. They come in an order that a hash draws, so a sample cut at SAMPLE_BYTES is fair.
    # Places and sizes are ranked first; only texts that are within the bounds travel, those of equal rows once.
    rows = rows.withColumn("h", F.xxhash64("doc_id", "text"))
    taken: Counter[tuple[int, int]] = Counter()
    size = 0
    for r in rows.select("h", "doc_id", F.octet_length("text").alias("n")).orderBy("h", "doc_id").limit(2 * per_class).collect():
        taken[r.h, r.doc_id] += 1
        size += r.n
        if size >= SAMPLE_BYTES:
            break
    if not taken:
        return []
    last = max(taken)
    within = rows.where((F.col("h") < last[0]) | ((F.col("h") == last[0]) & (F.col("doc_id") <= last[1])))
    texts = {(r.h, r.doc_id): (r.text, int(r.toxic == 1)) for r in within.groupBy("h", "doc_id").agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).toLocalIterator()}
    return [texts[key] for key in sorted(taken) for _ in range(taken[key])]


OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("passages", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("p_value", pa.float64())])))])
PASSAGES = "array<struct<start:bigint,end:bigint,score:double,p_value:double>>"


def find_passages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and the significant toxic passages (token ranges) of each row. One narrow pass over whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # bounded by the sample; plain values, as broadcasts travel by reference to their class

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**shared.value)
        for batch in slices(batches):
            out: dict[str, list] = {"doc_id": batch.column("doc_id"), "score": [], "passages": []}
            for text in batch.column("text").to_pylist():
                found, evidence = model.passages(tokens_of(text))
                out["passages"].append([{"start": a, "end": b, "score": s, "p_value": p} for a, b, s, p in found])
                out["score"].append(round(model.probability(evidence), 9))
            yield rows_out(out, OUT)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id bigint, score double, passages {PASSAGES}")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, held_out, score and predicted; n_passages beside them."""
    scored = find_passages(docs, fit(training_rows(docs, labels)))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("passages").cast("bigint").alias("n_passages"))


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below the threshold, with all their columns. Narrow: a row is judged where it is read."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(fit(training_rows(docs, labels))))
    at = docs.schema.fieldNames().index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**shared.value)
        for batch in slices(batches):
            keep = [model.probability(model.evidence(tokens_of(t))) < THRESHOLD for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
