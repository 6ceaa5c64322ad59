"""Quality classifier by co-training.

Two views of a document are judged apart. The text view sees which words occur (hashed into
``COLUMNS`` columns, each once a document); the page view sees source, language and layout
figures (length, lines, word lengths, shares of capitals, digits, signs and distinct words) and
no word. Both are one-pass log-odds models: an aggregation counts, over all rows that train a view,
in how many good and bad documents each column, or each quantile bin of a figure, occurs. The text
view keeps what is significant (a likelihood ratio of ``SIGNIFICANT`` deviations) and has two figures, the sum of
a document's log-odds and the two worst of them, so that one telling word counts in a long text.

In each round a view judges the whole corpus, and the rows that it is sure of, good or bad by a calibrated
threshold for each, train the other view with half weight. Held-out labelled rows calibrate each view
(Platt scaling) and weigh both into one score; then every document is scored.

The good are labelled quality 1 and not toxic. Labels come from at most ``MOST_LABELLED`` labelled
documents, those first by a hash of doc_id (a documented bound: they are broadcast); all other
counts and judgements cover all documents and whole texts. The words of a document are stored once as column
numbers in the shared folder, and every round reads those. The driver sees the summed counts (``COLUMNS`` rows), and
one pair of margins for each held-out doc_id (MOST_LABELLED / HELD_OUT or so).

Defined cases: null text is empty; null source, language or length have values of their own; a null quality
is no label, a null toxic is 0; of repeated labels the worst counts; a null doc_id is scored and never
labelled; repeated rows are scored each, and count each; a score of exactly 0.5 is kept; a very
long text is one row's work, its columns are bounded by ``COLUMNS``; with labels of only one kind every
document gets that kind's score (1.0 without any label); an empty table gives an
empty result; extra columns pass through ``keep_good`` and are ignored by ``scores``."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import free_name, ship, stage

MOST_LABELLED = 16_000
COLUMNS = 1 << 18  # bounds the model, not the words: none is cut for being rarer than others
SIGNIFICANT = 3.0
ROUNDS = 2
SURE = 0.95  # a calibrated probability from which a view may label
PSEUDO_WEIGHT = 0.5
SOURCES = 64  # sources and languages are hashed into so many flags
BINS = 32  # of a layout figure, at most; each has ROWS_PER_BIN labelled rows or so
ROWS_PER_BIN = 20
HELD_OUT = 4  # one labelled row in four calibrates
SIGNS = "|$%&*#@~^<>{}[]()=+_\\/!?;:\"'"
FIGURES = 8


def _layout(text: Column) -> list[Column]:
    """chars, lines, shares of capitals, digits and signs."""
    n = F.greatest(F.char_length(text), F.lit(1))

    def share(chars):
        return 1 - F.char_length(F.translate(text, chars, "")) / n

    return [F.char_length(text), F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1,
            share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share("0123456789"), share(SIGNS)]


def word_columns(text: str):
    """(number of words, of distinct ones, their columns): lower-cased, parted by white space, full stops and commas."""
    from zlib import crc32

    import numpy as np

    words = text.lower().replace(".", " ").replace(",", " ").split()
    distinct = set(words)
    return len(words), len(distinct), np.unique(np.fromiter((crc32(w.encode()) for w in distinct), dtype=np.uint32, count=len(distinct)) & np.uint32(COLUMNS - 1))


def _each(batch):
    """(columns, figures, flags) of each row of an Arrow batch that starts with text, five layout figures and the flags."""
    import numpy as np

    layout = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(1, 6)]) if batch.num_rows else np.zeros((0, 5))
    flags = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (6, 7)]) if batch.num_rows else np.zeros((0, 2))
    for r in range(batch.num_rows):
        n_words, n_distinct, columns = word_columns(batch.column(0)[r].as_py() or "")
        chars, lines, *shares = layout[r]
        n, words = max(chars, 1.0), max(n_words, 1)
        yield columns, [np.log1p(chars), np.log1p(lines), np.log1p(n / lines), np.log1p(n / words), *shares, n_distinct / words], flags[r]


def _inputs() -> list[Column]:
    text = F.coalesce("text", F.lit(""))
    flag = [F.pmod(F.xxhash64(F.lit(name), F.coalesce(F.col(name).cast("string"), F.lit("\x00"))), F.lit(SOURCES)).cast("int") for name in ("source", "lang")]
    return [F.col("text").alias("in0"), *(c.cast("double").alias(f"in{i + 1}") for i, c in enumerate(_layout(text))), *(c.alias(f"in{i + 6}") for i, c in enumerate(flag))]


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, columns, figures, flags): columns as little-endian 32-bit integers, FIGURES doubles, two flags."""
    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            found = [(c.astype("<u4").tobytes(), f, x.tolist()) for c, f, x in _each(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(8), pa.array([c for c, _, _ in found], pa.binary()), pa.array([f for _, f, _ in found], pa.list_(pa.float64())),
                 pa.array([x for *_, x in found], pa.list_(pa.int32()))], ["doc_id", "columns", "figures", "flags"])

    return ship(docs).select(*_inputs(), F.col("doc_id").cast("long")).mapInArrow(rows, "doc_id long, columns binary, figures array<double>, flags array<int>")


def labels_of(labels: DataFrame) -> DataFrame:
    """doc_id, good (1.0 or 0.0): one row per labelled document."""
    good = F.min(((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).cast("double"))
    return labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(good.alias("good"))


class Model:
    """Log-odds of both views as arrays, and their calibration."""

    def __init__(self, words, edges: list, bins):
        self.words, self.edges, self.bins = words, edges, bins
        self.text, self.page, self.both = ([1.0, 1.0], 0.0), ([1.0], 0.0), ([1.0, 1.0, 0.0], 0.0)

    def margins(self, columns, figures, flags) -> tuple[float, float, float]:
        """Sum and two worst of the words' log-odds, and the page view's sum."""
        import numpy as np

        odds = self.words[columns]
        worst = np.partition(odds, 1)[:2] if len(odds) > 2 else odds
        return float(odds.sum()), float(np.minimum(worst, 0).sum()), float(sum(self.bins[c] for c in self.cells(figures, flags)))

    def cells(self, figures, flags) -> list[int]:
        """Places of a document's bins in one row of all bins."""
        from bisect import bisect_right

        return [k * BINS + bisect_right(e, f) for k, (e, f) in enumerate(zip(self.edges, figures, strict=True))] + [
            FIGURES * BINS + k * SOURCES + int(x) for k, x in enumerate(flags)]

    def logits(self, sums: float, worst: float, page: float) -> tuple[float, float, float]:
        (a, b), c = self.text
        (d,), e = self.page
        (u, v, m), w = self.both
        text, page = a * sums + b * worst + c, d * page + e
        return text, page, u * text + v * page + m * min(text, page) + w


def _odds(good, bad, least: float):
    """Smoothed log-odds of counts by class; 0 where the signed root of the likelihood ratio (good and bad
    alike against apart) is under ``least``, a number of standard deviations."""
    import numpy as np

    def surprise(seen, expected):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0.0)

    both, total = good[1] + bad[1], max(good[0] + bad[0], 1e-9)
    ratio = sum(surprise(seen, both * n / total) + surprise(n - seen, n - both * n / total) for n, seen in (good, bad))
    odds = np.log((good[1] + 0.5) / (good[0] + 1)) - np.log((bad[1] + 0.5) / (bad[0] + 1))
    return np.where(2 * ratio >= least * least, odds, 0.0)


def _counted(rows: DataFrame, edges: list, judge: Model | None):
    """Weighted counts ((n, by column) of good and of bad) for the text view and for the page view, over all
    rows that train them: labelled ones, and with ``judge`` those that its other view is sure of."""
    import numpy as np

    width, pages = COLUMNS, FIGURES * BINS + 2 * SOURCES
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(judge)
    frame = Model(None, edges, None)
    sure = float(np.log(SURE / (1 - SURE)))

    def count(batches):
        import pyarrow as pa

        # one row for all documents, then one for each column; by class
        text, page = np.zeros((2, width + 1)), np.zeros((2, pages + 1))
        model = shared.value
        for batch in batches:
            good = batch.column(3).to_pylist()
            for r, g in enumerate(good):
                columns = np.frombuffer(batch.column(0)[r].as_py(), "<u4")
                figures, flags = batch.column(1)[r].as_py(), batch.column(2)[r].as_py()
                if g is not None:
                    to = [(text, int(g), 1.0), (page, int(g), 1.0)]
                elif model is None:
                    continue
                else:
                    by_text, by_page, _ = model.logits(*model.margins(columns, figures, flags))
                    to = [(view, int(p > 0), PSEUDO_WEIGHT) for view, p in ((text, by_page), (page, by_text)) if abs(p) >= sure]
                for view, kind, weight in to:
                    view[kind, 0] += weight
                    view[kind, (columns if view is text else np.array(frame.cells(figures, flags))) + 1] += weight
        out = [(view, kind, np.flatnonzero(table[kind]), table[kind]) for view, table in enumerate((text, page)) for kind in (0, 1)]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([np.full(len(at), 2 * view + kind, dtype=np.int32) for view, kind, at, _ in out])),
            pa.array(np.concatenate([at for *_, at, _ in out]).astype(np.int32)), pa.array(np.concatenate([t[at] for *_, at, t in out]))], ["part", "place", "n"])

    sums = (ship(rows).select("columns", "figures", "flags", "trains").mapInArrow(count, "part int, place int, n double")
            .groupBy("part", "place").agg(F.sum("n").alias("n")).toArrow())  # 2 * (COLUMNS + pages + 2) rows at most
    part, place, n = (sums.column(k).to_numpy() for k in range(3))
    tables = []
    for k, size in ((0, width), (1, width), (2, pages), (3, pages)):
        t = np.zeros(size + 1)
        t[place[part == k]] = n[part == k]
        tables.append((t[0], t[1:]))
    return tables


def fit_logistic(rows, ridge: float = 1e-3) -> tuple[list[float], float]:
    """Weights and bias of a logistic regression of the first column on the others: Newton's method."""
    import numpy as np

    got = np.array(rows, dtype=float)
    x = np.column_stack([got[:, 1:], np.ones(len(got))])
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    x, y, w = x / scale, got[:, 0], np.zeros(x.shape[1])
    pull = np.full(x.shape[1], ridge)
    pull[-1] = 1e-9
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        slope = x.T @ (p - y) / len(y) + pull * w
        bend = (x * (p * (1 - p))[:, None]).T @ x / len(y) + np.diag(pull)
        step = np.linalg.solve(bend, slope)
        w -= step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-8:
            break
    w = w / scale
    return [float(v) for v in w[:-1]], float(w[-1])


def _held_margins(rows: DataFrame, model: Model) -> list[tuple]:
    """(good, sum, worst, page) for each held-out doc_id, at most about MOST_LABELLED / HELD_OUT rows."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def judged(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            got = [shared.value.margins(np.frombuffer(c.as_py(), "<u4"), f.as_py(), x.as_py())
                   for c, f, x in zip(batch.column(0), batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(3), batch.column(4), *(pa.array([g[k] for g in got], pa.float64()) for k in range(3))],
                                             ["doc_id", "good", "m0", "m1", "m2"])

    m = rows.select("columns", "figures", "flags", "doc_id", "good").mapInArrow(judged, "doc_id long, good double, m0 double, m1 double, m2 double")
    return [tuple(r)[1:] for r in m.groupBy("doc_id").agg(*(F.avg(c).alias(c) for c in ("good", "m0", "m1", "m2"))).orderBy("doc_id").collect()]


def _calibrated(rows: DataFrame, model: Model) -> Model:
    held = _held_margins(rows, model)
    model.text = fit_logistic([(g, s, w) for g, s, w, _ in held])
    model.page = fit_logistic([(g, p) for g, _, _, p in held])
    logits = [model.logits(s, w, p)[:2] for _, s, w, p in held]
    # what one view alone can see makes a document bad: the worse view counts for itself
    model.both = fit_logistic([(g, t, p, min(t, p)) for (g, *_), (t, p) in zip(held, logits, strict=True)])
    return model


def _dealt(rows: DataFrame, seen: dict) -> tuple[Column, Column]:
    """Conditions of the labelled rows that are fitted and that calibrate. A kind whose rows all fell on
    one side has its first doc_id by hash dealt to the other; where a kind has one row only, all
    labelled rows do both."""
    known, held = F.col("good").isNotNull(), F.col("fold") == 0
    for kind in (0.0, 1.0):
        out, rest = seen.get((kind, True), 0), seen.get((kind, False), 0)
        if out + rest < 2:
            return known, known
        if not out or not rest:
            moved = rows.filter(F.col("good") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").first()["doc_id"]
            held = F.when(F.col("doc_id") == moved, F.lit(not out)).otherwise(held)
    return known & ~held, known & held


def co_train(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED, rounds: int = ROUNDS, significant: float = SIGNIFICANT):
    """A Model, or the score of all documents (a float) where the labels know one kind only."""
    known = stage(labels_of(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled), "labels")  # small enough to broadcast: most_labelled rows of two numbers
    rows = stage(features(docs).join(F.broadcast(known), "doc_id", "left").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(HELD_OUT))), "features")
    seen = {(r["good"], r["held"]): r["n"] for r in rows.filter("good is not null").groupBy("good", (F.col("fold") == 0).alias("held"))
            .agg(F.count_distinct("doc_id").alias("n")).collect()}
    kinds = {g for g, _ in seen}
    if len(kinds) < 2:
        return min(kinds) if kinds else 1.0
    fitted, held = _dealt(rows, seen)
    rows = rows.withColumn("trains", F.when(fitted, F.col("good")))
    bins = max(2, min(BINS, sum(seen.values()) // ROWS_PER_BIN))
    cuts = [k / bins for k in range(1, bins)]
    edges = rows.filter(fitted).agg(*(F.percentile_approx(F.col("figures")[k], cuts, 10_000).alias(f"f{k}") for k in range(FIGURES))).first()
    edges = [sorted(set(e)) for e in edges]
    # labelled rows that are held out neither train nor are judged
    pool = rows.filter(F.col("trains").isNotNull() | F.col("good").isNull())
    model = None
    for _ in range(rounds + 1):
        text_bad, text_good, page_bad, page_good = _counted(pool, edges, model)
        model = _calibrated(rows.filter(held), Model(_odds(text_good, text_bad, significant), edges, _odds(page_good, page_bad, 0.0)))
    return model


def scored(docs: DataFrame, model: Model, names: list[str], keep: list[str] | None = None) -> DataFrame:
    """docs (all columns, or ``keep``) with the scores of the text view, the page view and both, under three names."""
    keep = docs.columns if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            logits = np.array([shared.value.logits(*shared.value.margins(*f)) for f in _each(batch)]).reshape(-1, 3)
            p = 1 / (1 + np.exp(-np.clip(logits, -700, 700)))
            # the text goes to Python once
            rest = iter(range(8, batch.num_columns))
            yield pa.RecordBatch.from_arrays([*(batch.column(0 if c == "text" else next(rest)) for c in keep), *(pa.array(p[:, k]) for k in range(3))], [*keep, *names])

    fields = {f.name: f for f in docs.schema.fields}
    schema = T.StructType([*(fields[c] for c in keep), *(T.StructField(n, T.DoubleType()) for n in names)])
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # names of the input never meet those of the helpers
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    seen = plain.withColumns({c: F.col(at[c]) for c in ("text", "source", "lang")})
    return ship(seen).select(*_inputs(), *(at[c] for c in keep if c != "text")).mapInArrow(judge, schema)


def _scored(docs: DataFrame, names: list[str], labels: DataFrame, keep: list[str] | None = None, **fit) -> DataFrame:
    model = co_train(docs.select("doc_id", "text", "lang", "source"), labels, **fit)
    if isinstance(model, float):
        return docs.select(*(F.col(f"`{c}`") for c in (keep or docs.columns)), *(F.lit(model).alias(c) for c in names))
    return scored(docs, model, names, keep)


def scores(docs: DataFrame, labels: DataFrame, **fit) -> DataFrame:
    """doc_id, text_score, page_score, score and keep (score at least 0.5) for each row."""
    got = _scored(docs.select("doc_id", "text", "lang", "source"), ["text_score", "page_score", "score"], labels, ["doc_id"], **fit)
    return got.select("doc_id", "text_score", "page_score", "score", (F.col("score") >= 0.5).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, **fit) -> DataFrame:
    """The documents, with all columns and unchanged, that score at least 0.5."""
    names = free_name(docs, "text_score", "page_score", "score")
    return _scored(docs, names, labels, **fit).filter(F.col(names[2]) >= 0.5).select(*(F.col(f"`{c}`") for c in docs.columns))
