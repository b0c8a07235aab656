"""Operator 5: toxicity by maximum-scoring segments of token log-odds.

Learning: a word's score is its log-odds between toxic and clean documents under an informative Dirichlet prior (Monroe
et al., Fightin' Words, 2008), less a drift, so that chance text sinks. Scan: the linear-time algorithm of Ruzzo and
Tompa (1999) gives every maximal scoring segment. Calibration: in clean text such segments exceed a score S with an
expected number K n exp(-lambda S) in n words (Karlin and Altschul, 1990); a document's evidence is the sum of -ln E
of its significant segments (E < 1), and a monotone map from evidence to probability comes from labelled rows that the words
weren't learned from.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from juristream.llm.common import BoundedCache, give_back, materialise, scope, tidy

EDGE = b".,;:!?\"'()[]{}<>*#$%&|-_"
#: Upper ends of the evidence bins of the calibration.
BINS = [0.0] + [0.25 * 1.35**i for i in range(22)]
#: Words of which a counting task holds figures at once, and words whose scores a scoring task remembers.
COUNTED, REMEMBERED = 100_000, 200_000


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


def traits(word: bytes) -> tuple[bytes, ...]:
    """What a word is known by: itself and its beginnings of four to eight bytes, so that inflected and compound forms count together."""
    return (word, *(word[:n] + b"*" for n in range(4, 9) if len(word) > n))


@dataclass
class Model:
    """scores: of traits of words stripped of marks, at most as many as learn() was allowed. rest: of a word without a known trait;
    one with several has the largest of their scores."""

    scores: dict[bytes, float] = field(default_factory=dict)
    rest: float = -0.5
    rate: float = 1.0  # lambda
    k: float = 1.0
    levels: list[float] = field(default_factory=lambda: [0.0] * (len(BINS) + 1))  # probability by evidence bin


def segments(points: list[tuple[int, float]], rest: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a sequence that scores `rest` < 0 everywhere but at `points`
    (position, score; ascending). Linear in the number of points.

    Ruzzo and Tompa: keep candidate segments with the sums before (low) and after (high) each. A new one joins the
    nearest earlier candidate with a smaller low if that one's high is smaller than its own; and again.
    """
    first: list[int] = []
    last: list[int] = []
    low: list[float] = []
    high: list[float] = []
    before: list[int] = []  # the nearest candidate with a smaller low
    total, at = 0.0, 0
    for position, score in points:
        total += rest * (position - at)
        at = position + 1
        if score <= 0:
            total += score
            continue
        f, lo = position, total
        total += score
        hi = total
        j = len(first) - 1
        while True:
            while j >= 0 and low[j] >= lo:
                j = before[j]
            if j < 0 or high[j] >= hi:
                break
            f, lo = first[j], low[j]
            del first[j:], last[j:], low[j:], high[j:], before[j:]
            j -= 1
        first.append(f)
        last.append(position)
        low.append(lo)
        high.append(hi)
        before.append(j)
    return [(f, e, h - b) for f, e, b, h in zip(first, last, low, high, strict=True)]


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        scores, rest = model.scores, model.rest
        self.cache = BoundedCache(lambda word: max((scores[t] for t in traits(word.strip(EDGE)) if t in scores), default=rest), REMEMBERED)

    def passages(self, text: str) -> tuple[list[tuple[int, int, float, float]], int]:
        """(first word, last word, score, E-value) of every maximal segment, and the number of words."""
        rest, found = self.model.rest, list(map(self.cache.__getitem__, words_of(text)))
        points = [(i, s) for i, s in enumerate(found) if s != rest]
        expected = self.model.k * max(1, len(found))
        return [(a, b, s, expected * math.exp(-self.model.rate * s)) for a, b, s in segments(points, rest)], len(found)

    def evidence(self, passages: list[tuple[int, int, float, float]]) -> float:
        return sum(-math.log(max(e, 1e-300)) for *_, e in passages if e < 1)

    def probability(self, evidence: float) -> float:
        return self.model.levels[bisect.bisect_left(BINS, evidence)]


def solve_rate(counts: list[tuple[float, float]]) -> float:
    """The positive lambda with sum p exp(lambda s) = 1 over (weight, score) of clean words; needs a negative mean and a positive score."""
    total = sum(w for w, _ in counts)
    excess = lambda x: sum(w * math.exp(min(700.0, x * s)) for w, s in counts) / total - 1
    lo, hi = 1e-6, 1.0
    while excess(hi) < 0 and hi < 64:
        lo, hi = hi, hi * 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if excess(mid) < 0 else (lo, mid)
    return lo


def rising(toxic: list[float], rows: list[float], base: float) -> list[float]:
    """Shares by bin, made non-decreasing by pooling neighbours; each bin counts two more rows at the base rate."""
    pools: list[list[float]] = []
    for t, n in zip(toxic, rows, strict=True):
        pools.append([t + 2 * base, n + 2, 1])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            t1, n1, c1 = pools.pop()
            pools[-1] = [pools[-1][0] + t1, pools[-1][1] + n1, pools[-1][2] + c1]
    return [t / n for t, n, c in pools for _ in range(int(c))]


def learn(documents: DataFrame, labels: DataFrame, **options) -> Model:
    """See _learn. The tables that learning writes are deleted at its end."""
    with scope():
        return _learn(documents, labels, **options)


def _learn(
    documents: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    held_out: int = 2,
    sample_rows: int = 60_000,
    most_words: int = 20_000,
    prior_share: float = 0.1,
    least_z: float = 3.5,
    drift: float = 0.5,
) -> Model:
    """A model from the labelled documents whose crc32(id as text) mod 4 isn't `held_out`.

    At most about `sample_rows` labelled rows are used, those with the smallest hashes: the one bounded sample here, and small
    enough to broadcast, so no other text is moved; their texts are written once, and all else is learned from that table. Words come
    from two of the remainders, the calibration from the third. Equal texts count once, so copies don't lend their words weight. Words
    with |z| >= least_z are kept, the `most_words` of largest |z| (of equal ones the first in byte order).

    Rows without a label or id are skipped; an id labelled more than once counts as its largest label. Without both classes the model
    knows no words and gives every document the base rate (0 if there are no labels).
    """
    fold = lambda c: F.pmod(F.crc32(c.cast("string")), F.lit(4))
    known = labels.where(labels[label_col].isNotNull() & labels[id_col].isNotNull() & (fold(labels[id_col]) != held_out))
    known = known.groupBy(labels[id_col].alias("id")).agg((F.max(label_col) > 0).cast("int").alias("y"))
    n = known.count()
    steps = 1 << 30
    sample = known.where(F.pmod(F.xxhash64("id"), F.lit(steps)) < int(min(1.0, sample_rows / max(1, n)) * steps))
    texts = documents.select(documents[id_col].alias("id"), F.coalesce(documents[text_col], F.lit("")).alias("text"))
    marked = texts.join(F.broadcast(sample), "id").select(F.monotonically_increasing_id().alias("row"), "id", "y", F.xxhash64("text").alias("h"), "text")
    marked = materialise(marked, "labelled-texts")
    one = marked.groupBy("h").agg(F.min(F.struct("id", "row")).alias("one"), F.round(F.avg("y")).cast("int").alias("y"))
    chosen = materialise(one.select("one.row", "y", fold(F.col("one.id")).alias("fold")), "labelled")
    labelled = marked.select("row", "text").join(F.broadcast(chosen), "row").select("y", "fold", "text")
    calibration = (held_out + 1) % 4
    sizes = {(r["y"], r["c"]): r["n"] for r in chosen.groupBy("y", (F.col("fold") == calibration).alias("c")).agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get((1, False), 0), sizes.get((0, False), 0)
    every = sum(sizes.values())
    base = (toxic + sizes.get((1, True), 0)) / every if every else 0.0
    model = Model(rest=-drift, levels=[base] * (len(BINS) + 1))
    if not toxic or not clean:
        return model

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents with each trait, by class, and its occurrences in clean ones; given out whenever many words have come together."""
        seen: dict[bytes, list[int]] = {}

        def out() -> pa.RecordBatch:
            rows = list(seen.items())
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.binary()), *(pa.array([c[i] for _, c in rows], pa.int64()) for i in range(3))], names=["word", "toxic", "clean", "times"])

        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                here: dict[bytes, int] = {}
                for raw in words_of(text.as_py()):
                    here[raw] = here.get(raw, 0) + 1
                whole: dict[bytes, int] = {}
                for raw, times in here.items():
                    if word := raw.strip(EDGE):
                        for trait in traits(word):
                            whole[trait] = whole.get(trait, 0) + times
                for word, times in whole.items():
                    c = seen.setdefault(word, [0, 0, 0])
                    c[1 - y] += 1
                    c[2] += times * (1 - y)
                if len(seen) > COUNTED:
                    yield out()
        yield out()

    train = labelled.where(F.col("fold") != calibration).select("y", "text")
    words = train.mapInArrow(tidy(count), "word binary, toxic long, clean long, times long").groupBy("word").agg(*[F.sum(c).alias(c) for c in ("toxic", "clean", "times")])
    words = materialise(words, "words")
    # The prior adds so many documents to either class, with the word as frequent in them as in all.
    prior_documents = prior_share * (toxic + clean)
    p = F.lit(prior_documents) * (F.col("toxic") + F.col("clean")) / F.lit(float(toxic + clean))
    a, b = F.col("toxic") + p, F.col("clean") + p
    odds = F.ln(a / (toxic + prior_documents - a + 1)) - F.ln(b / (clean + prior_documents - b + 1))
    words = words.withColumn("odds", odds).withColumn("z", F.col("odds") / F.sqrt(1 / a + 1 / b)).withColumn("weight", F.col("times") + p)
    total = words.agg(F.sum("weight")).first()[0]
    kept = words.where(F.abs("z") >= least_z).orderBy(F.desc(F.abs("z")), "word").limit(most_words).select("word", "odds", "weight").collect()  # most_words rows at most
    model.scores = {bytes(r["word"]): r["odds"] - drift for r in kept}
    counts = [(r["weight"], r["odds"] - drift) for r in kept]
    counts.append((max(0.0, total - sum(w for w, _ in counts)), -drift))
    if not any(s > 0 for s in model.scores.values()):
        return model
    model.rate = solve_rate(counts)

    held = labelled.where(F.col("fold") == calibration).select("y", "text")
    base_model = Model(model.scores, model.rest, model.rate)

    def clean_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, found, length = Scorer(base_model), 0, 0
        for batch in batches:
            for text in batch.column(1):
                passages, n = scorer.passages(text.as_py())
                found, length = found + len(passages), length + n
        yield pa.RecordBatch.from_arrays([pa.array([found]), pa.array([length])], names=["found", "length"])

    r = held.where("y = 0").mapInArrow(tidy(clean_segments), "found long, length long").agg(F.sum("found"), F.sum("length")).first()
    model.k = ((r[0] or 0) + 1) / ((r[1] or 0) + 1)
    fixed = Model(model.scores, model.rest, model.rate, model.k)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, rows = Scorer(fixed), [[0, 0] for _ in range(len(BINS) + 1)]
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows[bisect.bisect_left(BINS, scorer.evidence(scorer.passages(text.as_py())[0]))][y] += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), *(pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1))], names=["bin", "clean", "toxic"])

    table = {r["bin"]: r for r in held.mapInArrow(tidy(bins), "bin int, clean long, toxic long").groupBy("bin").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).collect()}
    found = [(table[i]["toxic"], table[i]["toxic"] + table[i]["clean"]) if i in table else (0, 0) for i in range(len(BINS) + 1)]
    model.levels = rising([t for t, _ in found], [n for _, n in found], base)
    return model


def score(documents: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, limit: float = 0.3, with_passages: bool = True) -> DataFrame:
    """Every row's whole text scored: `doc` (a struct of the columns in `keep`, all by default), score (0 to 1), predicted (1 if
    score >= limit) and, if asked for, passages: array of (first_word, last_word, score, e_value) with e_value < 1.

    A null or empty text has no passage and gets the score of no evidence. Null and repeated ids, repeated rows and texts of any length
    are scored like others; an empty table gives an empty one. No shuffle; only the text goes to Python, and only figures come back.
    """
    keep = documents.columns if keep is None else keep
    sent = documents.sparkSession.sparkContext.broadcast(model)
    passage = pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())]))
    more = ", passages: array<struct<first_word: bigint, last_word: bigint, score: double, e_value: double>>" * with_passages

    @F.arrow_udf(f"struct<score: double, predicted: int{more}>")
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(sent.value)
        for texts in batches:
            probability, spans = [], []
            for text in texts:
                passages, _ = scorer.passages(text.as_py() or "")
                probability.append(scorer.probability(scorer.evidence(passages)))
                spans.append([dict(zip(("first_word", "last_word", "score", "e_value"), p, strict=True)) for p in passages if p[3] < 1] if with_passages else None)
            columns = [pa.array(probability, pa.float64()), pa.array([int(p >= limit) for p in probability], pa.int32())] + [pa.array(spans, passage)] * with_passages
            yield pa.StructArray.from_arrays(columns, names=["score", "predicted", *["passages"] * with_passages])
        del scorer
        give_back()

    doc = F.struct(*[documents[c] for c in keep]).alias("doc")
    return documents.select(doc, judged(documents[text_col]).alias("found")).select("doc", "found.*")
